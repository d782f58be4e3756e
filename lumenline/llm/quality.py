"""Quality classifier: perplexity under an interpolated modified Kneser-Ney trigram model of trusted text.

Trusted are documents with quality 1 and toxic 0 in ``labels``; of these the ``TRUSTED`` with the smallest hashed ids, up to
``MOST_WORDS`` words in all, are a bounded sample of whole texts, without those of over a tenth of that (all others, and all
unlabelled ones, are only scored).  Of rows with the same id the smallest text stands for them in the sample.  A quarter of the sample is held back, the rest
trains the model; all trusted documents that do not train it set the thresholds.

Counts are sharded by n-gram: trigram counts, continuation counts of bigrams and words, and the totals of each context
come from aggregations by n-gram, and joins by n-gram turn them into probabilities.  A token's log probability is a sum
of terms, each of one n-gram: its word's, the weights of the contexts seen, and the gain of the bigram and trigram seen.  So
a document's perplexity is a join of its n-grams with the table of terms, summed.  A training word makes at most five terms of
12 bytes, so the table has at most 60 * (``MOST_WORDS`` + 3 * ``TRUSTED``) bytes, 240 MB, however large the corpus is; it is
checked against that before it is broadcast.  It is cut into ``SHARDS`` by key; every task joins its documents' n-grams with
one shard after the other.  N-grams are 64-bit mixes: with 4 million terms an unseen n-gram is taken for another with a
probability of 2e-13.

A document is accepted if its perplexity is at most its language's threshold: the ``QUANTILE`` of the perplexities of the
trusted documents in that language that did not train the model, or of all of them where fewer than ``LEAST`` have the
language.  The quantiles are exact: counts by narrow ranges of perplexity tell which values the driver needs to see.

Defined cases: null counts as the empty text, scored by its end token alone; a null language is one of its own; without
any trusted document every document is accepted with a null threshold and perplexity.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenline.llm.common import forget, written

TRUSTED, MOST_WORDS, SHARDS, QUANTILE, LEAST = 4000, 4_000_000, 16, 0.99, 20
START, END = "\x02", "\x03"
KINDS = {"word": 1, "context1": 2, "pair": 3, "context2": 4, "triple": 5}
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Documents scored at a time.
ROWS = 256


def tokens_of(text: str | None) -> list[str]:
    return text.lower().split() if text else []


def _hash(word: str) -> int:
    h = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"), 42)
    return h - 2**64 if h >= 2**63 else h


def ngram_key(kind: str, *parts: np.ndarray) -> np.ndarray:
    """64 bits for an n-gram of word hashes (int64 arrays)."""
    out = np.full(len(parts[0]), KINDS[kind], np.uint64)
    for p in parts:
        out = (out ^ p.view(np.uint64)) * _MIX
        out ^= out >> np.uint64(32)
    return out * _MIX


# --- the model ---------------------------------------------------------------------------------------------------


def trigrams(docs: DataFrame, text: str = "text") -> DataFrame:
    """(a, b, c, n): how often each trigram of word hashes stands in ``docs``, sharded by trigram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter[tuple[int, int, int]] = Counter()
            for t in batch.column(0):
                h = [_hash(w) for w in (START, START, *tokens_of(t.as_py()), END)]
                seen.update(zip(h, h[1:], h[2:], strict=False))
            if seen:
                cols = [pa.array(x, pa.int64()) for x in (*zip(*seen, strict=True), list(seen.values()))]
                yield pa.RecordBatch.from_arrays(cols, names=["a", "b", "c", "n"])

    return docs.select(text).mapInArrow(run, "a long, b long, c long, n long").groupBy("a", "b", "c").agg(F.sum("n").alias("n"))


def _sums(counts: DataFrame, *by: str) -> DataFrame:
    n = F.col("n")
    return counts.groupBy(*by).agg(
        F.sum("n").alias("total"), F.count_if(n == 1).alias("n1"), F.count_if(n == 2).alias("n2"), F.count_if(n >= 3).alias("n3")
    )


def discounts(counts: DataFrame) -> tuple[float, float, float]:
    """The three modified Kneser-Ney discounts from how many n-grams have counts 1 to 4."""
    n = F.col("n")
    r = counts.agg(*(F.count_if(n == k) for k in (1, 2, 3, 4))).first()
    n1, n2, n3, n4 = (max(1, x or 0) for x in r)
    y = n1 / (n1 + 2 * n2)
    made = [k - (k + 1) * y * b / a for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
    return tuple(min(max(d, 0.05), k - 0.05) for k, d in zip((1, 2, 3), made, strict=True))


def _off(n: Column, d: tuple[float, float, float]) -> Column:
    return n - F.when(n == 1, d[0]).when(n == 2, d[1]).otherwise(d[2])


def _gamma(d: tuple[float, float, float]) -> Column:
    return (d[0] * F.col("n1") + d[1] * F.col("n2") + d[2] * F.col("n3")) / F.col("total")


def model_terms(docs: DataFrame) -> tuple[DataFrame, float]:
    """((key, value) terms of natural log probabilities, the term of an unknown word)."""
    return terms_of(written(trigrams(docs), "trigrams"))


def terms_of(c3: DataFrame) -> tuple[DataFrame, float]:
    """:func:`model_terms` of the written counts of trigrams, which are deleted in the end."""
    c2 = written(c3.groupBy("b", "c").agg(F.count("*").alias("n")), "bigrams")
    c1 = c2.groupBy("c").agg(F.count("*").alias("n"))
    d3, d2, d1 = discounts(c3), discounts(c2), discounts(c1)
    all1 = _sums(c1).first()
    types = all1.n1 + all1.n2 + all1.n3 + 1
    spare = (d1[0] * all1.n1 + d1[1] * all1.n2 + d1[2] * all1.n3) / all1.total / types
    p1 = c1.select("c", (_off(F.col("n"), d1) / all1.total + spare).alias("p1"))
    g2 = _sums(c2, "b").select("b", _gamma(d2).alias("g2"), F.col("total").alias("t2"))
    g3 = _sums(c3, "a", "b").select("a", "b", _gamma(d3).alias("g3"), F.col("total").alias("t3"))
    p2 = c2.join(g2, "b").join(p1, "c").select("b", "c", "g2", "p1", (_off(F.col("n"), d2) / F.col("t2") + F.col("g2") * F.col("p1")).alias("p2"))
    p2 = written(p2.select("b", "c", "p2", (F.log("p2") - F.log("g2") - F.log("p1")).cast("float").alias("v")), "pairs")
    p3 = c3.join(g3, ["a", "b"]).join(p2.select("b", "c", "p2"), ["b", "c"])
    p3 = p3.select("a", "b", "c", "g3", "p2", (_off(F.col("n"), d3) / F.col("t3") + F.col("g3") * F.col("p2")).alias("p3"))
    none = F.lit(0).cast("long")
    parts = [
        p1.select(F.lit("word").alias("kind"), F.col("c").alias("x"), none.alias("y"), none.alias("z"), F.log("p1").alias("v")),
        g2.select(F.lit("context1"), "b", none, none, F.log("g2")),
        p2.select(F.lit("pair"), "b", "c", none, F.col("v").cast("double")),
        g3.select(F.lit("context2"), "a", "b", none, F.log("g3")),
        p3.select(F.lit("triple"), "a", "b", "c", F.log("p3") - F.log("g3") - F.log("p2")),
    ]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.union(p)
    used = {"word": 1, "context1": 1, "pair": 2, "context2": 2, "triple": 3}

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kinds = np.array(b.column(0).to_pylist(), object)
            cols = [b.column(k).to_numpy(zero_copy_only=False) for k in (1, 2, 3)]
            key = np.zeros(b.num_rows, np.uint64)
            for kind, n in used.items():
                at = np.nonzero(kinds == kind)[0]
                if len(at):
                    key[at] = ngram_key(kind, *(c[at] for c in cols[:n]))
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), b.column(4).cast(pa.float32())], names=["key", "value"])

    terms = written(rows.mapInArrow(keyed, "key long, value float"), "terms")
    forget(c3.sparkSession, c3, c2, p2)
    return terms, math.log(spare)


class Terms:
    """The table of terms, one broadcast for each shard of keys."""

    def __init__(self, terms: DataFrame, unknown: float):
        spark = terms.sparkSession
        most = 5 * (MOST_WORDS + 3 * TRUSTED)
        if terms.count() > most:
            raise ValueError(f"over {most} terms: the model was not trained on the bounded sample")
        found = terms.toArrow()  # as arrays: row objects of the whole table would fill the driver
        key, value = found["key"].to_numpy().view(np.uint64), found["value"].to_numpy()
        order = np.argsort(key)
        key, value = key[order], value[order]
        bits = np.uint64(64 - (SHARDS.bit_length() - 1))
        ends = np.searchsorted((key >> bits).astype(np.int64), np.arange(SHARDS + 1))
        self.unknown = unknown
        self.shards = [spark.sparkContext.broadcast((key[a:b], value[a:b])) for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _join(keys: np.ndarray, shards: list, missing: np.ndarray | float) -> np.ndarray:
    """The value of each key, ``missing`` where no shard has it."""
    bits = np.uint64(64 - (len(shards).bit_length() - 1))
    out = np.full(len(keys), missing, np.float64)
    home = (keys >> bits).astype(np.int64)
    order = np.argsort(home, kind="stable")
    ends = np.searchsorted(home[order], np.arange(len(shards) + 1))
    for s, sent in enumerate(shards):
        at = order[ends[s] : ends[s + 1]]
        have, values = sent.value
        if len(at) and len(have):
            want = keys[at]
            place = np.minimum(np.searchsorted(have, want), len(have) - 1)
            hit = have[place] == want
            out[at[hit]] = values[place[hit]]
    return out


def perplexity(df: DataFrame, terms: Terms, text: str = "text") -> DataFrame:
    """``df`` without ``text``, with n_tokens (bigint) and perplexity (double) of its texts."""
    kept = [c for c in df.columns if c not in (text, "n_tokens", "perplexity")]
    shards, unknown = terms.shards, terms.unknown

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                b = whole.slice(at, ROWS)
                docs = [tokens_of(t.as_py()) for t in b.column(len(kept))]
                known: dict[str, int] = {}
                flat: list[int] = []
                for words in docs:
                    flat += (_START, _START)
                    for w in words:
                        h = known.get(w)
                        if h is None:
                            h = known[w] = _hash(w)
                        flat.append(h)
                    flat.append(_END)
                ids = np.array(flat, np.int64)
                sizes = np.array([len(w) + 1 for w in docs])
                first = np.cumsum(sizes + 2) - sizes
                place = np.arange(sizes.sum()) + np.repeat(first - (np.cumsum(sizes) - sizes), sizes)
                a, m, c = ids[place - 2], ids[place - 1], ids[place]
                lp = _join(ngram_key("word", c), shards, unknown)
                for kind, parts in (("context1", (m,)), ("pair", (m, c)), ("context2", (a, m)), ("triple", (a, m, c))):
                    lp += _join(ngram_key(kind, *parts), shards, 0.0)
                sums = np.add.reduceat(lp, np.cumsum(sizes) - sizes)
                n = pa.array(sizes - 1, pa.int64())
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], n, pa.array(np.exp(np.minimum(700, -sums / sizes)))], names=[*kept, "n_tokens", "perplexity"])

    base = df.select(*kept, text)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields if f.name != text)
    return base.mapInArrow(run, f"{schema}, n_tokens long, perplexity double")


_START, _END = _hash(START), _hash(END)


def quantiles(held: DataFrame) -> tuple[float | None, dict[str, float]]:
    """The ``QUANTILE`` of ``perplexity`` in all of ``held``, and by ``_lang`` where ``LEAST`` or more have it; between ranks linear."""
    cell = F.floor(F.log("perplexity") * 1000).cast("long")
    counts = [(r["_lang"], r["cell"], r["count"]) for r in held.groupBy("_lang", cell.alias("cell")).count().collect()]
    groups = {None: Counter(), **{k: Counter() for k, _, _ in counts}}
    for k, c, n in counts:
        groups[k][c] += n
        groups[None][c] += n
    wanted: dict[str | None, dict[int, int | None]] = {}
    cells: set[int] = set()
    for k, g in groups.items():
        n = sum(g.values())
        if n and (k is None or n >= LEAST):
            at = QUANTILE * (n - 1)
            wanted[k] = dict.fromkeys((math.floor(at), math.ceil(at)))
            for rank in wanted[k]:
                before = 0
                for c in sorted(g):
                    if rank < before + g[c]:
                        wanted[k][rank] = (c, rank - before)
                        cells.add(c)
                        break
                    before += g[c]
    if not wanted:
        return None, {}
    rows = held.where(cell.isin(sorted(cells))).groupBy("_lang", cell.alias("cell"), "perplexity").count().collect()
    made = {}
    for k, ranks in wanted.items():
        values = []
        for c, nth in (ranks[r] for r in sorted(ranks)):
            for value, n in sorted((r["perplexity"], r["count"]) for r in rows if r["cell"] == c and k in (None, r["_lang"])):
                if nth < n:
                    values.append(value)
                    break
                nth -= n
        part = QUANTILE * (sum(groups[k].values()) - 1) % 1
        made[k] = values[0] + (values[-1] - values[0]) * part
    return made.pop(None), made


def classify(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", trusted: int = TRUSTED) -> DataFrame:
    """``df`` without ``text``, with n_tokens, perplexity, threshold and accepted."""
    all_trusted = labels.where("quality = 1 and toxic = 0").select(F.col("doc_id").alias("_chosen")).distinct()
    chosen = written(all_trusted.orderBy(F.xxhash64("_chosen"), "_chosen").limit(trusted), "chosen")
    is_back = F.pmod(F.xxhash64("_chosen", F.lit("part")), F.lit(4)) == 0
    sample = df.select(id_col, text, F.coalesce(F.col(lang), F.lit("")).alias("_lang")).join(F.broadcast(chosen), F.col(id_col) == F.col("_chosen"))
    sample = sample.groupBy("_chosen").agg(F.min(F.struct(text, "_lang")).alias("r")).select("_chosen", F.col(f"r.{text}").alias(text), "r._lang")
    # whole texts in the order of the hash, as long as their words fit; at most ``trusted`` rows
    words = F.size(F.split(F.trim(F.coalesce(F.col(text), F.lit(""))), r"\s+"))
    sized = written(sample.withColumn("_words", words).where(F.col("_words") <= MOST_WORDS // 10), "sized")
    # the running sum is over ids and numbers, at most ``trusted`` of them; texts don't go through its one task
    up_to = F.sum("_words").over(Window.orderBy(F.xxhash64("_chosen"), "_chosen"))
    fits = sized.select("_chosen", "_words").withColumn("_words", up_to).where(F.col("_words") <= MOST_WORDS).select("_chosen")
    sample = written(sized.join(F.broadcast(fits), "_chosen").select("_chosen", text, "_lang", is_back.alias("back")), "trusted")
    forget(df.sparkSession, sized)
    ids = written(sample.select("_chosen", "back"), "ids")
    chosen = ids.select("_chosen")
    kept = [c for c in df.columns if c not in ("n_tokens", "perplexity", "threshold", "accepted")]
    df = df.select(*kept)
    if not ids.where("not back").head(1):
        made = df.drop(text).withColumn("n_tokens", F.lit(None).cast("long"))
        return made.withColumns({"perplexity": F.lit(None).cast("double"), "threshold": F.lit(None).cast("double"), "accepted": F.lit(True)})
    counts = written(trigrams(sample.where("not back")), "trigrams")
    forget(df.sparkSession, sample)  # texts are no longer needed
    table, unknown = terms_of(counts)
    terms = Terms(table, unknown)
    forget(df.sparkSession, table)
    scored = written(perplexity(df, terms, text), "scored")
    others = all_trusted.join(F.broadcast(chosen.where(~is_back)), "_chosen", "left_anti")
    of_lang = F.coalesce(F.col(lang), F.lit(""))
    values = scored.select(F.col(id_col).alias("_chosen"), of_lang.alias("_lang"), "perplexity")
    held = written(values.join(others, "_chosen").select("_lang", "perplexity"), "held")
    overall, limits = quantiles(held)
    if overall is None:
        overall, limits = quantiles(values.join(chosen, "_chosen").select("_lang", "perplexity"))
    limit = F.lit(overall)
    for k, v in limits.items():
        limit = F.when(of_lang == k, F.lit(v)).otherwise(limit)
    return scored.withColumn("threshold", limit).withColumn("accepted", F.col("perplexity") <= F.col("threshold"))
