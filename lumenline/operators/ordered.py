"""Windows over the ordered rows of a key of any size.

Rows are cut into blocks by ranges of (key, order), so a key with most of the rows is dealt over many tasks.  Windows run
within a key's part of a block; what a row needs from before its block comes from a table of edges, with the last row and
the sums of each part.  A boundary between blocks lies inside one key at most, so only that many keys have edges: two rows
a block, which is what is broadcast.

Orders are taken to be unique within a key; rows that tie come in any order, as in any window.  Null keys are one key.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Columns of a dealt table beside the caller's: block, row number within the key, whether the key has several blocks.
BLOCK, AT, SPANS = "_block", "_at", "_spans"


def pinned(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder, which a cluster names in ``spark.checkpoint.dir``; lineage ends there."""
    spark = df.sparkSession
    held = spark.sparkContext._jsc.sc()
    if held.getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="lumenline-")
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint()


def _same(key: str, edges: str) -> Column:
    return F.col(f"r.{key}").eqNullSafe(F.col(f"{edges}.{key}")) & (F.col(f"r.{BLOCK}") == F.col(f"{edges}.{BLOCK}"))


def dealt(df: DataFrame, key: str, order: list[str], before: dict[str, Column] | None = None, blocks: int | None = None) -> DataFrame:
    """``df`` with ``BLOCK``, ``AT``, ``SPANS``, and for each of ``before`` the value of that expression in the row before.

    ``blocks`` is the number of ranges; without it the session's number of shuffle partitions, fewer for small tables.
    """
    before = before or {}
    ranges = [*([blocks] if blocks else []), F.col(key), *map(F.col, order)]
    rows = df.repartitionByRange(*ranges).withColumn(BLOCK, F.spark_partition_id())
    w = Window.partitionBy(key, BLOCK).orderBy(*order)
    own = {name: F.lag(value).over(w) for name, value in before.items()}
    rows = pinned(rows.withColumns(own | {"_n": F.row_number().over(w), "_end": F.lead(F.lit(1)).over(w).isNull()}))
    by_block = Window.partitionBy(key).orderBy(BLOCK)
    ends = rows.where("_end").select(key, BLOCK, "_n", F.struct(F.lit(0).alias("_"), *(value.alias(name) for name, value in before.items())).alias("_last"))
    ends = ends.withColumns({
        "_parts": F.count("*").over(Window.partitionBy(key)),
        "_before": F.lag("_last").over(by_block),
        "_first": F.sum("_n").over(by_block) - F.col("_n"),
    }).where("_parts > 1")
    edges = ends.select(key, BLOCK, "_before", "_first").alias("e")
    met = rows.alias("r").join(F.broadcast(edges), _same(key, "e"), "left")
    names = [c for c in df.columns if c not in before]
    lags = [F.when(F.col("r._n") == 1, F.col(f"e._before.{name}")).otherwise(F.col(f"r.{name}")).alias(name) for name in before]
    at = (F.col("r._n") + F.coalesce("e._first", F.lit(0))).cast("long")
    return met.select(*(F.col(f"r.{c}") for c in names), *lags, F.col(f"r.{BLOCK}"), at.alias(AT), F.col("e._first").isNotNull().alias(SPANS))


def running(rows: DataFrame, key: str, value: Column, name: str) -> DataFrame:
    """``rows`` of :func:`dealt` with the sum of ``value`` over the key's rows up to and with each."""
    own = F.sum(value).over(Window.partitionBy(key, BLOCK).orderBy(AT).rowsBetween(Window.unboundedPreceding, 0))
    sums = rows.where(SPANS).groupBy(key, BLOCK).agg(F.sum(value).alias("_s"))
    offsets = sums.select(key, BLOCK, (F.sum("_s").over(Window.partitionBy(key).orderBy(BLOCK)) - F.col("_s")).alias("_o")).alias("o")
    met = rows.withColumn(name, own).alias("r").join(F.broadcast(offsets), _same(key, "o"), "left")
    return met.select(*(F.col(f"r.{c}") for c in rows.columns), (F.col(f"r.{name}") + F.coalesce("o._o", F.lit(0))).alias(name))


def plain(rows: DataFrame) -> DataFrame:
    """Without the columns that :func:`dealt` added for itself."""
    return rows.drop(BLOCK, AT, SPANS)
