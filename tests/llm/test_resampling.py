"""Importance resampling against a plain version."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lumenline.llm import resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS, ITEMS = "doc_id long, text string, score string, weight string", "item_id long, text string"


def plain(docs, items, n, buckets, least, share):
    words = lambda t: WORD.findall((t or "").translate(UPPER))
    grams = lambda w: [" ".join(w[i : i + k]) for k in range(1, n + 1) for i in range(len(w) - k + 1)]
    bucket = lambda g: zlib.crc32(g.encode()) % buckets
    s, t = (Counter(bucket(g) for row in rows for g in grams(words(row[1]))) for rows in (docs, items))
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (S + buckets) / ((s[b] + 1.0) * (T + buckets))))
    out, pool = [], []
    for at, (doc_id, text, *_) in enumerate(docs):
        w = words(text)
        g = grams(w)
        weight = sum(gain(bucket(x)) for x in g) // len(g) if g else 0
        name = f"2024:{'' if doc_id is None else doc_id}"
        h = int(hashlib.sha256(name.encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([doc_id, len(g), weight, score, None])
        if len(w) >= least:
            pool.append((-score, doc_id is None, doc_id or 0, at))
    for rank, (*_, at) in enumerate(sorted(pool)[: len(pool) * share // 100], 1):
        out[at][4] = rank
    return sorted(map(tuple, out), key=repr)


def made(seed):
    dice = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["Straße", "ÉTÉ", "été", "a1", "日本"]
    text = lambda m: dice.choice([" ", ", ", "\n", "_"]).join(dice.choice(vocabulary) for _ in range(m))
    docs = [(i, text(dice.choice([0, 1, 5, 30, 60])), "x", None) for i in range(80)]
    docs += [(None, text(40), None, "y"), (3, None, "", ""), (4, "", "", ""), docs[10], docs[10], (90, "the " * 5000, "", ""), (91, "\x00\x7f .", "", "")]
    return docs, [(i, text(25)) for i in range(9)] + [(None, None)]


@pytest.mark.parametrize(("n", "hot", "bits"), [(1, 1 << 20, 64), (1, 7, 64), (2, 20, 64), (3, 20, 5)])
def test_resampling_equals_plain(spark, n, hot, bits):
    docs, items = made(n)
    found = resampling.resample(
        spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(items, ITEMS), "doc_id", "text", n, 97, 20, 30, hot=hot, bits=bits
    )
    assert found.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    want = plain(docs, items, n, 97, 20, 30)
    got = sorted(map(tuple, found.collect()), key=repr)
    # equal rows tie, so which of them has which rank is open
    assert Counter(r[:4] for r in got) == Counter(r[:4] for r in want)
    assert sorted((r[4], r[0]) for r in got if r[4]) == sorted((r[4], r[0]) for r in want if r[4])


def test_words_that_share_an_id_get_others(spark):
    docs = spark.createDataFrame([(i, f"v{i}") for i in range(40)], "doc_id long, text string")
    table, exceptions = resampling.gram_table(docs, docs.limit(0), "text", 1, 10, bits=4)
    assert exceptions and table.select("gram").distinct().count() == table.count() == 40


def test_words_across_pieces(monkeypatch, spark):
    monkeypatch.setattr(resampling, "PIECE", 10)
    batch = pa.RecordBatch.from_pydict({"text": ["", "abc def", "x" * 50, "", "é b", "c"]})
    assert [p.num_rows for p in resampling._pieces(iter([batch, batch.slice(2, 3)]), "text")] == [2, 1, 3, 1, 2]
    rows, words = resampling.words_of(batch.column("text"))
    assert list(zip(rows.tolist(), words.to_pylist(), strict=True)) == [(1, "abc"), (1, "def"), (2, "x" * 50), (4, "é"), (4, "b"), (5, "c")]


def test_empty_tables(spark):
    none, some = spark.createDataFrame([], DOCS), spark.createDataFrame([(1, "a b", "", ""), (2, None, "", "")], DOCS)
    assert resampling.resample(none, some, "doc_id", "text").count() == 0
    found = resampling.resample(some, none, "doc_id", "text", least=1, share=100)
    assert sorted(r["rank"] or 0 for r in found.collect()) == [0, 1]
    assert resampling.resample(some.where(F.col("doc_id") == 2), none, "doc_id", "text").first()["weight"] == 0
