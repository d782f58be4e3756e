"""Keyed lookups and integrity checks: markers, missing and orphan keys, coverage, duplicates, nearest offsets, ledgers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def mark(df: DataFrame, members: DataFrame, on: str | list[str], name: str = "d") -> DataFrame:
    """``df`` with ``name`` = 1 where its key is in ``members``, else 0.  The optimizer picks the join by size."""
    keys = [on] if isinstance(on, str) else on
    marked = members.select(*keys).distinct().withColumn(name, F.lit(1))
    return df.join(marked, keys, "left").withColumn(name, F.coalesce(name, F.lit(0)))


def missing_keys(df: DataFrame, lookup: DataFrame, on: list[str]) -> DataFrame:
    """Keys of ``df`` without an entry (swap the arguments for orphans)."""
    return df.select(*on).join(lookup, on, "left_anti")


def key_without_target(df: DataFrame, lookup: DataFrame, on: list[str], target: str, targets: DataFrame) -> DataFrame:
    """Keys with an entry whose target does not exist."""
    return df.select(*on).join(lookup.select(*on, target), on).join(targets.select(target), target, "left_anti").select(*on, target)


def coverage(df: DataFrame, lookup: DataFrame, on: list[str]) -> DataFrame:
    """One row: total, hit, miss and percent hit (null without rows)."""
    m = mark(df.select(*on), lookup, on, "hit_")
    total, hit = F.count("*"), F.coalesce(F.sum("hit_"), F.lit(0))
    return m.agg(total.alias("total"), hit.alias("hit"), (total - hit).alias("miss"), F.round(F.try_divide(hit * 100.0, total), 4).alias("pct"))


def duplicate_groups(df: DataFrame, by: list[str], ordered: str, shown: str) -> DataFrame:
    """Groups of over one row with their count and ``shown`` values in the order of ``ordered``."""
    texts = F.transform(F.array_sort(F.collect_list(F.struct(F.col(ordered).alias("o"), F.col(shown).alias("v")))), lambda x: x["v"])
    return df.groupBy(*by).agg(F.count("*").alias("n"), texts.alias("values")).where("n > 1")


def over_limit(df: DataFrame, by: str, value: Column, limit: Column) -> DataFrame:
    """Per group: rows, largest value, smallest margin, and rows over the limit; a missing limit is 0, so any value is over it."""
    limit = F.coalesce(limit, F.lit(0))
    return df.groupBy(by).agg(
        F.count("*").alias("n"),
        F.max(value).alias("largest"),
        F.min(limit - value).alias("margin"),
        F.count_if(value > limit).alias("n_over"),
    )


def coalesce_lookup(df: DataFrame, first: DataFrame, second: DataFrame, on: str, value: str) -> DataFrame:
    """``value`` from ``first``, else from ``second``, else null; with its ``origin`` (first, second, missing)."""
    a, b = first.select(on, F.col(value).alias("_a")), second.select(on, F.col(value).alias("_b"))
    out = df.join(a, on, "left").join(b, on, "left")
    origin = F.when(F.col("_a").isNotNull(), "first").when(F.col("_b").isNotNull(), "second").otherwise("missing")
    return out.withColumn("origin", origin).withColumn(value, F.coalesce("_a", "_b")).drop("_a", "_b")


def nearest_offset(left: DataFrame, right: DataFrame, key: str, at: str, row: str, found: str, offsets: tuple[int, ...] = (0, 1, -1, 2, -2, 3, -3)) -> DataFrame:
    """(``row``, ``found``, off): the entry of ``right`` at the first of ``offsets`` from ``left``'s place that has one.

    Each row is sent to its few places, so the join stays an equi-join; of several entries at a place the largest counts.
    Rows without any are left out.
    """
    places = F.explode(F.array(*(F.struct(F.lit(p).alias("p"), F.lit(o).alias("off")) for p, o in enumerate(offsets))))
    sent = left.select(row, key, F.col(at).alias("_at"), places.alias("_x")).select(row, key, F.col("_x.p").alias("p"), F.col("_x.off").alias("off"), (F.col("_at") + F.col("_x.off")).alias(at))
    entries = right.groupBy(key, at).agg(F.max(found).alias(found))
    best = F.min(F.struct("p", "off", found))
    return sent.join(entries, [key, at]).groupBy(row).agg(best.alias("b")).select(row, F.col("b.off").alias("off"), F.col(f"b.{found}").alias(found))


def pending(work: DataFrame, done: DataFrame, on: str) -> DataFrame:
    return work.join(done.select(on), on, "left_anti")


def ledger(rounds: list[tuple[str, DataFrame]], columns: list[str]) -> DataFrame:
    """The rounds of a ledger as one table: ``columns``, ``src`` (the round's tag) and ``round`` (its place, from 0)."""
    parts = [df.select(*columns, F.lit(src).alias("src"), F.lit(n).alias("round")) for n, (src, df) in enumerate(rounds)]
    return reduce(DataFrame.unionByName, parts)


def last_round(entries: DataFrame, key: list[str], values: list[str]) -> DataFrame:
    """Of each key of a ledger the ``values``, src and round of the last round that has it; ties within one by ``values``."""
    last = F.max_by(F.struct(*values, "src", "round"), F.struct("round", *values)).alias("x")
    return entries.groupBy(*key).agg(last, F.count("*").alias("entries")).select(*key, "x.*", "entries")


def reconcile(fixes: DataFrame, current: DataFrame, dropped: DataFrame, retimed: DataFrame, reverted: DataFrame) -> DataFrame:
    """Status of each fix (ep, ts, old, new, src): removed, applied, reverted or problem, with the current text.

    A dropped key comes first.  The text is looked up by (ep, ts), else at the key's retimed place, one hop only.  A fix
    counts as reverted if it is listed so (by ep, ts, old, new) and the text is the old one.
    """
    key = ["ep", "ts"]
    out = mark(fixes, dropped, key, "_gone")
    out = out.join(current.select(*key, F.col("text").alias("_now")), key, "left")
    moved = retimed.groupBy("ep", F.col("old_ts").alias("ts")).agg(F.max_by("new_ts", "rank").alias("_to"))
    out = out.join(moved, key, "left")
    there = current.select("ep", F.col("ts").alias("_to"), F.col("text").alias("_later"))
    out = out.join(there, ["ep", "_to"], "left")
    out = mark(out, reverted, ["ep", "ts", "old", "new"], "_back")
    now = F.coalesce("_now", "_later")
    status = (
        F.when(F.col("_gone") == 1, "removed")
        .when(now == F.col("new"), "applied")
        .when((F.col("_back") == 1) & (now == F.col("old")), "reverted")
        .otherwise("problem")
    )
    return out.select("ep", "ts", "src", status.alias("status"), now.alias("current"))


def reverse_lookup(df: DataFrame, mapping: DataFrame, value: str, key: str, order: str, number: str, base: int, last: int) -> DataFrame:
    """``key`` of the mapping's first entry (by ``order``) with this ``value``, else ``base`` + ``number`` up to ``last``, else null."""
    entry = mapping.groupBy(value).agg(F.min_by(key, F.struct(order, key)).alias("_k"))
    computed = F.when(F.col(number).between(1, last), (F.lit(base) + F.col(number)).cast("string"))
    return df.join(entry, value, "left").withColumn(key, F.coalesce(F.col("_k").cast("string"), computed)).drop("_k")


def wanted_frames(entries: DataFrame, videos: DataFrame, video: str, row: str, seconds: str, offsets: tuple[float, ...]) -> DataFrame:
    """(``video``, fno, wanted): the frames to read, and for each the (row, place of the offset) that want it.

    ``videos`` has fps and frames of each video; a frame before its first or after its last is that one.  Rows without a time
    want none.  Only rows of one frame meet, so no group is larger than the entries of one moment.
    """
    places = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.lit(float(o)).alias("off")) for k, o in enumerate(offsets))))
    sent = entries.where(F.col(seconds).isNotNull()).select(video, F.col(row).alias("row"), F.col(seconds).alias("_s"), places.alias("_x")).join(videos, video)
    fno = F.greatest(F.lit(0), F.least(F.col("frames") - 1, F.bround((F.col("_s") + F.col("_x.off")) * F.col("fps"), 0).cast("long")))
    wanted = F.array_sort(F.collect_list(F.struct("row", F.col("_x.k").alias("offset"))))
    return sent.withColumn("fno", fno.cast("long")).groupBy(video, "fno").agg(wanted.alias("wanted"))


def resolve_files(keys: DataFrame, key: str, files: DataFrame, name: str = "name", suffix: str = ".mp4") -> DataFrame:
    """(``key``, ``name``): the first file, by name, that begins with ``[key]`` and ends with ``suffix`` in any case; null without one."""
    own = files.where(F.lower(F.col(name)).endswith(suffix)).select(F.regexp_extract(name, r"^\[([^\]]*)\]", 1).alias(key), name)
    return keys.select(key).join(own.groupBy(key).agg(F.min(name).alias(name)), key, "left")
