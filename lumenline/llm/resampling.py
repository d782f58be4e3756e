"""Importance resampling of documents towards a target distribution of hashed n-grams.

Every distinct word has an integer id in a dictionary; an n-gram is a tuple of ids.  One pass counts the tuples of each
piece of text inside its task, and Spark adds them up: that table has one row a distinct tuple.  There the bytes of a tuple
are put together again from the dictionary, hashed once, and its bucket's counts and gain are joined to it.  A second pass
over the documents takes the gains back by tuple.

A word's id is its XXH64, so texts are encoded without a join; words that share one are found in the table and get other ids
(``_exceptions``), so ids are as distinct as words.  Tuples that are at least one in ``HOT`` of all occurrences, so at most
``HOT`` of them, are given to the tasks of the second pass as sorted arrays of that bound; the rest leave with their
documents and meet the gains by a join on the tuple, where no key has more than one in ``HOT`` of the occurrences.

Ranks come from a sort by range: rows before a range are counted, so no task orders all documents.

Defined cases: null and empty texts have no features and weight 0; a null id counts as the empty string in the draw and
comes last among ties; repeated rows are documents of their own; empty tables give no rows or gains of an empty side.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenline.llm.common import sql_crc32, written

#: A tuple is hot if it is at least one in so many occurrences; there are at most as many hot tuples.
HOT = 1 << 20
#: Bytes of text that are taken apart at a time (one document at least).
PIECE = 16_000_000
#: More words than this that share an id with another would mean that ids are no hashes.
MOST_EXCEPTIONS = 100_000

#: Each byte in lower case, 0 for those that no word holds: all of ASCII but digits and letters.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_LOWER[[b for b in range(128) if not (chr(b).isdigit() or chr(b).isalpha())]] = 0


def words_of(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The row of each word and the words, in order; ``texts`` has no nulls."""
    texts = texts.cast(pa.large_string())
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None and len(texts) else np.zeros(0, np.uint8)
    bounds = bounds - bounds[0] if len(bounds) else np.zeros(1, np.int64)
    low = _LOWER[raw]
    inside = np.zeros(len(low) + 2, bool)
    inside[1:-1] = low != 0
    edge = np.zeros(len(low) + 1, bool)  # a document begins or ends here
    edge[bounds] = True
    starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | edge[:-1]))
    ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | edge[1:])) + 1
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=offsets[1:])
    words = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(low[low != 0])])
    return np.searchsorted(bounds, starts, "right") - 1, words


def _ids(words: list[str], bits: int, exceptions: dict[str, int]) -> np.ndarray:
    """Ids of distinct words."""
    drop = 64 - bits
    found = np.array([xxhash.xxh64_intdigest(w.encode(), 42) >> drop for w in words], np.uint64).astype(np.int64)
    if exceptions:
        for i, w in enumerate(words):
            if w in exceptions:
                found[i] = exceptions[w]
    return found


def _grams(texts: pa.Array, n: int, bits: int, exceptions: dict[str, int]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array | None]]:
    """For runs of 1 to ``n`` words: the row and the place among distinct tuples of each run, the tuples, their words (of one)."""
    rows, words = words_of(texts)
    coded = words.dictionary_encode()
    own = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    ids = _ids(coded.dictionary.to_pylist(), bits, exceptions)
    yield rows, own, ids[:, None], coded.dictionary
    keys, at = own, np.arange(len(own))  # at: where each run begins
    for k in range(2, n + 1):
        stays = at + k - 1 < len(own)
        keys, at = keys[stays], at[stays]
        stays = rows[at + k - 1] == rows[at]
        keys, at = keys[stays], at[stays]
        _, first, keys = np.unique(keys * max(1, len(ids)) + own[at + k - 1], return_index=True, return_inverse=True)
        yield rows[at], keys, ids[own[at[first][:, None] + np.arange(k)]], None


def _pieces(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = np.cumsum(np.diff(np.frombuffer(batch.column(text).cast(pa.large_string()).buffers()[1], np.int64)[: batch.num_rows + 1])) if batch.num_rows else []
        begin = 0
        while begin < batch.num_rows:
            before = sizes[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(sizes, before + PIECE, "right")))
            yield batch.slice(begin, end - begin)
            begin = end


def _list_of(values: np.ndarray) -> pa.Array:
    """A row of ids a tuple."""
    m, k = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(m + 1, dtype=np.int32) * k), pa.array(values.ravel()))


def _counted(df: DataFrame, text: str, n: int, bits: int, exceptions: dict[str, int]) -> DataFrame:
    """(gram, word, n): tuples with their counts, a row or more each; the word only of tuples of one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in _pieces(batches, "text"):
            for _, keys, tuples, words in _grams(piece.column("text"), n, bits, exceptions):
                counts = pa.array(np.bincount(keys, minlength=len(tuples)).astype(np.int64))
                named = pa.nulls(len(tuples), pa.string()) if words is None else words.cast(pa.string())
                yield pa.RecordBatch.from_arrays([_list_of(tuples), named, counts], names=["gram", "word", "n"])

    return df.select(F.coalesce(F.col(text), F.lit("")).alias("text")).mapInArrow(run, "gram array<bigint>, word string, n bigint")


def _exceptions(table: DataFrame, seed: int, bits: int) -> dict[str, int]:
    """Other ids for the words that share one: all but the least word of an id, few as ids are hashes of 64 bits."""
    shared = table.where("word is not null").groupBy("gram").agg(F.count("*").alias("m")).where("m > 1").select("gram")
    clash = table.where("word is not null").join(F.broadcast(shared), "gram").select(F.col("gram")[0].alias("id"), "word").limit(MOST_EXCEPTIONS + 1).collect()
    if len(clash) > MOST_EXCEPTIONS:
        raise ValueError("word ids are no hashes")
    least: dict[int, str] = {}
    for r in clash:
        least[r["id"]] = min(r["word"], least.get(r["id"], r["word"]))
    # a sign bit keeps them apart from shorter ids; of 64 bits, another hash is as good as the first
    return {r["word"]: np.uint64(xxhash.xxh64_intdigest(r["word"].encode(), seed) | (1 << 63) * (bits < 64)).astype(np.int64).item() for r in clash if least[r["id"]] != r["word"]}


def gram_table(source: DataFrame, target: DataFrame, text: str, n: int, buckets: int, bits: int = 64) -> tuple[DataFrame, dict[str, int]]:
    """Distinct tuples (gram, n_source, n_target, bucket) of both sides, written; and the words whose id is not their hash."""
    exceptions: dict[str, int] = {}
    for seed in range(43, 53):
        sides = [_counted(df, text, n, bits, exceptions).withColumn("of_source", F.lit(i == 0)) for i, df in enumerate((source, target))]
        sums = (F.sum(F.when(F.col("of_source") == side, F.col("n")).otherwise(0)).alias(name) for side, name in ((True, "n_source"), (False, "n_target")))
        table = written(sides[0].unionByName(sides[1]).groupBy("gram", "word").agg(*sums), "grams")
        more = _exceptions(table, seed, bits)
        if not more:
            break
        exceptions |= more
    else:
        raise ValueError("no distinct ids for all words")
    spelled = table.where("word is not null")
    if n > 1:
        dictionary = spelled.select(F.col("gram")[0].alias("id"), F.col("word").alias("w"))
        longer = table.where("word is null").select("gram", "n_source", "n_target", F.posexplode("gram").alias("at", "id")).join(dictionary, "id")
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "w"))), lambda x: x["w"]), " ")
        spelled = spelled.select("gram", "word", "n_source", "n_target").unionByName(
            longer.groupBy("gram", "n_source", "n_target").agg(joined.alias("word")).select("gram", "word", "n_source", "n_target")
        )
    hashed = spelled.select("gram", "n_source", "n_target", (F.crc32(F.encode("word", "UTF-8")) % buckets).cast("int").alias("bucket"))
    return written(hashed, "buckets"), exceptions


def gains(table: DataFrame, buckets: int) -> DataFrame:
    """(bucket, gain): at most one row a bucket."""
    by = table.groupBy("bucket").agg(F.sum("n_source").alias("s"), F.sum("n_target").alias("t"))
    total = by.agg(F.coalesce(F.sum("s"), F.lit(0)).alias("S"), F.coalesce(F.sum("t"), F.lit(0)).alias("T")).first()
    own = (F.col("t") + 1).cast("double") * F.lit(float(total["S"] + buckets))
    other = (F.col("s") + 1).cast("double") * F.lit(float(total["T"] + buckets))
    return by.select("bucket", F.floor(1000 * F.log(own / other)).alias("gain"))


def _mixed(tuples: np.ndarray) -> np.ndarray:
    """A number a tuple, for look-ups that are then compared in full."""
    out = tuples[:, 0].astype(np.uint64)
    for j in range(1, tuples.shape[1]):
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + tuples[:, j].astype(np.uint64)
    return out


def _index(hot: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By length: numbers of the hot tuples in order, the tuples and their gains."""
    sizes = np.array([len(x) for x in hot["gram"]] if hot.num_rows else [], np.int64)
    flat = hot["gram"].combine_chunks().flatten().to_numpy() if hot.num_rows else np.zeros(0, np.int64)
    begins, gain = np.cumsum(sizes) - sizes, hot["gain"].to_numpy()
    out = {}
    for k in np.unique(sizes).tolist():
        own = np.flatnonzero(sizes == k)
        tuples = flat[begins[own][:, None] + np.arange(k)]
        order = np.argsort(mixed := _mixed(tuples), kind="stable")
        out[k] = (mixed[order], tuples[order], gain[own][order])
    return out


def _taken(df: DataFrame, text: str, n: int, bits: int, exceptions: dict[str, int], hot: dict) -> DataFrame:
    """``df`` without its text, with n_words, n_features, the sum of its hot tuples' gains, and its other tuples with counts."""
    kept = [c for c in df.columns if c != text]
    base = df.select(*kept, F.coalesce(F.col(text), F.lit("")).alias(text))
    shared = df.sparkSession.sparkContext.broadcast(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for piece in _pieces(batches, text):
            m = piece.num_rows
            n_words, n_features, total = np.zeros(m, np.int64), np.zeros(m, np.int64), np.zeros(m, np.int64)
            rare_rows, rare_grams, rare_counts = [], [], []
            for rows, keys, tuples, words in _grams(piece.column(text), n, bits, exceptions):
                here = np.bincount(rows, minlength=m)
                n_features += here
                if words is not None:
                    n_words += here
                gain, known = np.zeros(len(tuples), np.int64), np.zeros(len(tuples), bool)
                if (k := tuples.shape[1]) in index and len(tuples):
                    numbers, own, values = index[k]
                    at = np.minimum(np.searchsorted(numbers, _mixed(tuples)), len(numbers) - 1)
                    known = (own[at] == tuples).all(axis=1)
                    gain = np.where(known, values[at], 0)
                np.add.at(total, rows, gain[keys])
                rare = ~known[keys]
                pairs, counts = np.unique(rows[rare] * max(1, len(tuples)) + keys[rare], return_counts=True)
                rare_rows.append(pairs // max(1, len(tuples)))
                rare_grams += tuples[pairs % max(1, len(tuples))].tolist()
                rare_counts.append(counts)
            rows = np.concatenate(rare_rows)
            order = np.argsort(rows, kind="stable")
            ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=m))]).astype(np.int32))
            grams = pa.array(rare_grams, pa.list_(pa.int64())).take(pa.array(order))
            counts = pa.array(np.concatenate(rare_counts)[order].astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [*(piece.column(c) for c in kept), pa.array(n_words), pa.array(n_features), pa.array(total), pa.ListArray.from_arrays(ends, grams), pa.ListArray.from_arrays(ends, counts)],
                names=[*kept, "n_words", "n_features", "_hot", "_grams", "_counts"],
            )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields if f.name != text)
    return base.mapInArrow(run, f"{schema}, n_words bigint, n_features bigint, _hot bigint, _grams array<array<bigint>>, _counts array<bigint>")


def weigh(source: DataFrame, target: DataFrame, id_column: str, text: str, n: int = 1, buckets: int = 10_000, hot: int = HOT, bits: int = 64) -> DataFrame:
    """(id, _row, n_words, n_features, weight) of every row of ``source``: the floored mean of its features' gains."""
    table, exceptions = gram_table(source, target, text, n, buckets, bits)
    weights = table.where("n_source > 0").join(F.broadcast(gains(table, buckets)), "bucket").select("gram", "n_source", "gain")
    total = table.agg(F.coalesce(F.sum("n_source"), F.lit(0))).first()[0]
    often = F.col("n_source") * hot >= total
    index = _index(weights.where(often).select("gram", "gain").toArrow())
    rows = _taken(source.select(F.col(id_column).alias("id"), F.col(text).alias("text")), "text", n, bits, exceptions, index)
    rows = written(rows.withColumn("_row", F.monotonically_increasing_id()), "features")
    rare = rows.select("_row", F.explode(F.arrays_zip("_grams", "_counts")).alias("x")).select("_row", F.col("x._grams").alias("gram"), F.col("x._counts").alias("c"))
    # a hot tuple may still be here, where two share a number of the index: so all gains are there to join
    sums = rare.join(weights.select("gram", "gain"), "gram").groupBy("_row").agg(F.sum(F.col("c") * F.col("gain")).alias("_rare"))
    total_gain = F.col("_hot") + F.coalesce("_rare", F.lit(0))
    mean = F.when(F.col("n_features") == 0, F.lit(0)).otherwise(F.expr("(_sum - pmod(_sum, n_features)) div n_features"))
    out = rows.drop("_grams", "_counts").join(sums, "_row", "left").withColumn("_sum", total_gain)
    return out.select(F.col("id").alias(id_column), "_row", "n_words", "n_features", mean.cast("long").alias("weight"))


def drawn(scored: DataFrame, id_column: str, share: int) -> DataFrame:
    """(_row, rank) of the highest ``share`` percent of ``scored`` (id, _row, score), ties by id."""
    order = (F.col("score").desc(), F.col(id_column).asc_nulls_last(), F.col("_row"))
    places = scored.repartitionByRange(*order).sortWithinPartitions(*order)
    places = written(places.select("_row", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("at")), "places")
    sizes = sorted((r["part"], r["m"]) for r in places.groupBy("part").agg(F.count("*").alias("m")).collect())
    before = np.concatenate([[0], np.cumsum([m for _, m in sizes])]).astype(int).tolist()
    most = before[-1] * share // 100
    starts = scored.sparkSession.createDataFrame([(p, b) for (p, _), b in zip(sizes, before, strict=False)], "part int, before long")
    return places.join(F.broadcast(starts), "part").select("_row", (F.col("before") + F.col("at") + 1).alias("rank")).where(F.col("rank") <= most)


def resample(
    source: DataFrame, target: DataFrame, id_column: str, text: str, n: int = 1, buckets: int = 10_000, least: int = 20, share: int = 10,
    seed: int = 2024, hot: int = HOT, bits: int = 64,
) -> DataFrame:
    """Every row's (id, n_features, weight, score, rank): of those with ``least`` words, ``share`` percent are drawn and ranked.

    Score is the weight and a Gumbel variate that the seed and the id fix, so drawing the highest is sampling by weight.
    """
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_column).cast("string"), F.lit("")))
    chance = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    gumbel = F.floor(-1000 * F.log(-F.log((chance + 0.5) / 4294967296.0)))
    scored = written(weigh(source, target, id_column, text, n, buckets, hot, bits).withColumn("score", F.col("weight") + gumbel), "scored")
    ranks = drawn(scored.where(F.col("n_words") >= least), id_column, share)
    return scored.join(ranks, "_row", "left").select(id_column, "n_features", "weight", "score", "rank")


def oracle_sql(buckets: int = 10_000, least: int = 20, share: int = 10, seed: int = 2024) -> str:
    """DuckDB SQL for :func:`resample` of documents towards the benchmark, by single words."""
    cut = r"list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"
    return f"""
WITH docs AS (SELECT doc_id, {cut} AS words FROM documents),
items AS (SELECT {cut} AS words FROM benchmark),
counted AS (
  SELECT word, sum(s) AS s, sum(t) AS t FROM (
    SELECT unnest(words) AS word, 1 AS s, 0 AS t FROM docs UNION ALL SELECT unnest(words), 0, 1 FROM items) GROUP BY word),
hashed AS (SELECT word, s, t, {sql_crc32("word")} % {buckets} AS bucket FROM counted),
by_bucket AS (SELECT bucket, sum(s) AS s, sum(t) AS t FROM hashed GROUP BY bucket),
totals AS (SELECT sum(s) AS s, sum(t) AS t FROM by_bucket),
gained AS (
  SELECT bucket, floor(1000 * ln(((b.t + 1)::DOUBLE * (o.s + {buckets})::DOUBLE) / ((b.s + 1)::DOUBLE * (o.t + {buckets})::DOUBLE)))::BIGINT AS gain
  FROM by_bucket b, totals o),
by_word AS (SELECT word, gain FROM hashed JOIN gained USING (bucket)),
summed AS (
  SELECT doc_id, count(*) AS n, sum(gain)::BIGINT AS total FROM (SELECT doc_id, unnest(words) AS word FROM docs) JOIN by_word USING (word) GROUP BY doc_id),
weighed AS (
  SELECT doc_id, coalesce(n, 0)::BIGINT AS n_features, coalesce((total - ((total % n) + n) % n) // n, 0)::BIGINT AS weight FROM docs LEFT JOIN summed USING (doc_id)),
scored AS (
  SELECT *, weight + floor(-1000 * ln(-ln((('0x' || substr(sha256('{seed}:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score FROM weighed),
ranked AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () * {share} // 100 AS most FROM scored WHERE n_features >= {least})
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= most THEN rank END AS rank FROM scored LEFT JOIN ranked USING (doc_id)"""
