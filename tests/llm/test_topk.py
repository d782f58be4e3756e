"""Exact top-k search against all pairs."""

import math
import random
import struct

import pytest
from pyspark.sql import functions as F

from lumenline.llm import topk

SCHEMA = "vec_id long, embedding array<float>, rank string, score string"


def plain(rows, k, every):
    own = [(i, [math.floor(1024 * x) for x in v]) for i, v, *_ in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (q, v) in enumerate(own):
        if q is None or q % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w, strict=False)), c is None, c or 0) for b, (c, w) in enumerate(own) if b != a)[:k]
        out += [(q, rank, None if n else c, -s) for rank, (s, n, c) in enumerate(scored, 1)]
    return sorted(out, key=repr)


def found(spark, rows, k, every, counter=None):
    df = spark.createDataFrame(rows, SCHEMA).repartition(5).select("vec_id", "rank", topk.quantised("embedding").alias("v"))
    hits = topk.search(df, "vec_id", "v", F.col("id") % every == 0, k, counter)
    assert hits.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted(map(tuple, hits.collect()), key=repr)


def made(seed, n=300, dims=9):
    dice = random.Random(seed)
    vector = lambda: [dice.choice([0.0, 0.25, -0.5, 1.0, 0.125]) for _ in range(dims)]
    copies = vector()
    rows = [(i, copies if i % 3 == 0 else vector(), "x", None) for i in range(n)]
    odd = [None, [None] * dims, [float("nan")] * dims, [float("inf")] + [0.0] * (dims - 1), [], [0.5], [2.0] * (dims + 3)]
    rows += [(n + 10 * i, v, "", "") for i, v in enumerate(odd)] + [(None, vector(), "", ""), (None, copies, "", ""), rows[0], rows[10], (10, vector(), "", "")]
    return rows


@pytest.mark.parametrize(("k", "every", "block", "rows"), [(10, 10, 32_000_000, 4096), (3, 7, 500, 16), (400, 50, 32_000_000, 4096), (1, 10, 32_000_000, 7)])
def test_search_equals_all_pairs(spark, monkeypatch, k, every, block, rows):
    monkeypatch.setattr(topk, "BLOCK_BYTES", block)
    monkeypatch.setattr(topk, "ROWS", rows)
    assert found(spark, made(k), k, every) == plain(made(k), k, every)


@pytest.mark.parametrize("large", [1e6, 2e6, 3e7])
def test_scores_beyond_doubles(spark, large):
    dice = random.Random(1)
    rows = [(i, [large * dice.choice([1, -1, 0.5]) + dice.choice([0, 0.25, 2]) for _ in range(2)], "", "") for i in range(40)]
    rows = [(i, [struct.unpack("f", struct.pack("f", x))[0] for x in v], *rest) for i, v, *rest in rows]
    got = found(spark, rows, 5, 10)
    if large < 1e7:
        assert got == plain(rows, 5, 10)
    else:  # beyond a long
        assert len(got) == 20 and max(r[3] for r in got) == topk.LONG


def test_cutoffs_leave_few_entries(spark):
    dice = random.Random(5)
    rows = [(i, [dice.gauss(0, 0.125) for _ in range(64)], "", "") for i in range(3000)]
    counter = spark.sparkContext.accumulator(0)
    assert found(spark, rows, 10, 100, counter) == plain(rows, 10, 100)
    assert 30 * 10 < counter.value < 0.1 * 30 * 3000


def test_empty_tables(spark):
    assert found(spark, [], 10, 100) == []
    assert found(spark, [(0, [1.0], "", "")], 10, 100) == []
    assert found(spark, [(0, None, "", ""), (100, [1.0], "", ""), (None, [2.0], "", "")], 10, 100) == [(100, 1, None, 2048 * 1024)]
