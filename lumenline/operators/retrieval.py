"""Fuzzy retrieval over a table of text lines, and its statistics."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenline.functions import text as T

PAGE = 20
#: Characters of phrases that a task looks for at a time.
PHRASE_CHARS = 4 << 20


def search(
    df: DataFrame,
    query: str,
    *,
    text: str = "x",
    similarity: str = "s",
    order: tuple[str, ...] = ("ord",),
    flag: str | None = None,
    min_ratio: float | None = None,
    min_similarity: float | None = None,
    flag_only: bool = False,
    flag_first: bool = False,
    page: int | None = None,
    page_size: int = PAGE,
) -> DataFrame:
    """Rows that match ``query``, best first, with match_ratio and exact_match.

    The similarity filter reaches the scan (a null similarity passes limits up to 0 only, NaN none); then a bound by length alone; then
    the score, taken once a row: it leaves an array of one, so that the optimizer can't repeat it in the filter.  One word is scored by its
    longest common subsequence, several by the characters they claim.  Ties keep the order of ``order``, so pages are
    stable.  A blank query matches nothing.  Limits that are missing or not finite are 50 and 0; 0 is a limit like any other.
    """
    ratio_limit = float(min_ratio) if min_ratio is not None and math.isfinite(min_ratio) else 50.0
    similarity_limit = float(min_similarity) if min_similarity is not None and math.isfinite(min_similarity) else 0.0
    query = query.strip()
    words = T.query_words(query)
    if not query or words == []:
        found = df.where(F.lit(False)).withColumn("match_ratio", F.lit(0.0)).withColumn("exact_match", F.lit(0))
    else:
        # a whole limit is compared as a whole number, so that a whole column is not cast and the filter reaches the scan
        enough = F.col(similarity) >= (int(similarity_limit) if similarity_limit.is_integer() else similarity_limit)
        if df.schema[similarity].dataType.typeName() in ("double", "float"):
            enough = enough & ~F.isnan(similarity)
        base = df.where(enough | F.col(similarity).isNull() if similarity_limit <= 0 else enough)
        if words is None:
            q = query.lower()
            base = base.where(F.least(F.length(text), F.lit(len(q))) * 100.0 / len(q) >= ratio_limit)
            score = T.lcs_ratio(query, F.col(text))
        else:
            score = T.multiword_ratio(words, F.col(text))
        exact = T.contains_all(words or [query.lower()], F.col(text)).cast("int")
        found = base.select("*", F.explode(F.array(score)).alias("match_ratio")).where(F.col("match_ratio") >= ratio_limit).withColumn("exact_match", exact)
    if flag_only:
        found = found.where(F.col(flag) == 1)
    keys: list[Column] = [F.col(flag).desc()] if flag_first and flag else []
    found = found.orderBy(*keys, F.col("match_ratio").desc(), F.col("exact_match").desc(), *order)
    return found if page is None else found.offset(page * page_size).limit(page_size)


def substring_hits(lines: DataFrame, text: str, phrases: DataFrame, phrase: str, phrase_id: str) -> DataFrame:
    """(``phrase_id``, hits): how many lines contain each phrase, one automaton for all phrases in one scan of the lines.

    Phrases are taken in blocks of about ``PHRASE_CHARS``, one scan each, so no task holds more.  A null phrase or line has no
    hits; the empty phrase is in every other line.  Phrase ids are taken to be unique.
    """
    spark = lines.sparkSession
    known = phrases.select(phrase_id, phrase)
    kind = dict(known.dtypes)[phrase_id]
    blocks = max(1, -(-(known.agg(F.sum(F.length(phrase))).first()[0] or 0) // PHRASE_CHARS))
    found = None
    for b in range(blocks):
        rows = known.where(F.pmod(F.xxhash64(phrase_id), F.lit(blocks)) == b).where(F.col(phrase).isNotNull()).toArrow()
        sent = spark.sparkContext.broadcast((rows.column(0).combine_chunks(), rows.column(1).to_pylist()))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            import ahocorasick  # only here, so that the rest does without

            ids, said = sent.value
            places: dict[str, list[int]] = {}
            for i, t in enumerate(said):
                places.setdefault(t, []).append(i)
            machine = ahocorasick.Automaton()
            for t in places:
                if t:
                    machine.add_word(t, t)
            if len(machine):
                machine.make_automaton()
            hits = dict.fromkeys(places, 0)
            for batch in batches:
                for t in batch.column(0).to_pylist():
                    if t is not None:
                        for w in {x for _, x in machine.iter(t)} if len(machine) else ():
                            hits[w] += 1
                        if "" in hits:
                            hits[""] += 1
            out = [(i, n) for w, n in hits.items() if n for i in places[w]]
            if out:
                at, n = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(at)), pa.array(n, pa.int64())], names=["id", "hits"])

        part = lines.select(text).mapInArrow(run, f"id {kind}, hits long")
        found = part if found is None else found.union(part)
    totals = found.groupBy(F.col("id").alias("_id")).agg(F.sum("hits").alias("hits"))
    met = known.select(phrase_id).join(totals, F.col(phrase_id).eqNullSafe(F.col("_id")), "left")
    return met.select(phrase_id, F.coalesce("hits", F.lit(0)).alias("hits"))


def archive_stats(df: DataFrame, group: str, flag: str) -> DataFrame:
    """One row: groups, rows and flagged rows."""
    return df.agg(F.count_distinct(group).alias("groups"), F.count("*").alias("rows"), F.count_if(F.col(flag) == 1).alias("flagged"))


def buckets(df: DataFrame, value: str, high: float = 0.95, low: float = 0.6) -> DataFrame:
    """One row: values from ``high``, between, and under ``low``."""
    v = F.col(value)
    return df.agg(F.count_if(v >= high).alias("high"), F.count_if((v >= low) & (v < high)).alias("middle"), F.count_if(v < low).alias("low"))


def top_segments(df: DataFrame, key: str, keep: Column, order: list[str], fields: list[str], n: int = 3) -> DataFrame:
    """The ``n`` best rows of each key that pass ``keep``, as an array of structs ordered by ``order`` (ascending).

    Ranks are limited before rows are gathered, so a key never holds more than ``n`` of them.
    """
    w = Window.partitionBy(key).orderBy(*order)
    best = df.where(keep).withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= n)
    top = F.transform(F.array_sort(F.collect_list(F.struct("_k", *fields))), lambda x: x.dropFields("_k"))
    return best.groupBy(key).agg(top.alias("top"))


def counts_by(df: DataFrame, *columns: str) -> DataFrame:
    """(dimension, value, n): the rows by each of the columns on its own, in one pass."""
    pairs = F.array(*(F.struct(F.lit(c).alias("dimension"), F.col(c).cast("string").alias("value")) for c in columns))
    return df.select(F.inline(pairs)).groupBy("dimension", "value").agg(F.count("*").alias("n"))


def histograms(df: DataFrame, group: str, value: Column, name: str) -> DataFrame:
    """(``group``, ``name``, level, n): how often each value is in each group (level 0), in all (2), and all rows (3), in one pass."""
    rows = df.select(F.col(group), value.alias(name))
    sets = rows.groupingSets([[F.col(group), F.col(name)], [F.col(name)], []], F.col(group), F.col(name))
    return sets.agg(F.grouping_id(group, name).cast("int").alias("level"), F.count("*").alias("n")).select(group, name, "level", "n")


def search_totals(hits: DataFrame, frame: str) -> DataFrame:
    """One row: hits, hits with a frame and hits without."""
    return hits.agg(F.count("*").alias("hits"), F.count(frame).alias("with_frame"), F.count_if(F.col(frame).isNull()).alias("missing"))
