"""Exact top-k inner products by a three-phase uniform threshold.

A vector's components are cut into ``LISTS`` runs, so a score is the sum of a partial score from each list.  A task owns a
range of rows and, for a query, one list of partial scores for each run:

1. each task sends the highest entries of each of its lists with their whole scores.  The k-th best of a query's whole
   scores is one that k rows reach: a safe cutoff;
2. the cutoffs go to all tasks; a row whose partial scores all lie under cutoff / lists can't reach it, so only rows with
   one partial score of at least that are collected;
3. of these the remaining lists are added up exactly, and what reaches the cutoff leaves its task.

So a query costs the network its local lists and the rows that reach its cutoff, never its pairs.

Equal vectors are one class, searched once, with its ``k + 1`` first rows for members: of a class, no later row can be among
a query's k best.  Queries of a class share its ranked rows, each without itself.  Queries go out in blocks of a bounded
size, each block a pass over the classes.

Vectors are compared as they are; where lengths differ the shorter one counts as zero beyond its end.  Products and sums are
exact: in doubles while all sums stay under 2**53, else in integers of any size; a score beyond a long is given as the
nearest long.

Defined cases: null vectors and those with a null or non-finite component take no part; an empty vector has score 0 with
all; rows with one id are rows of their own; a null id is no query and comes last among ties.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenline.llm.common import written

#: Runs that the components are cut into.
LISTS = 2
#: Entries that a task sends of a list, times k: more give a higher cutoff.
DEPTH = 4
#: Bytes of the vectors of a block of queries.
BLOCK_BYTES = 32_000_000
#: Rows and queries whose scores are in memory at a time.
ROWS, QUERIES = 4096, 512
#: Shares of the queries of a class, so that no task meets all queries that have one vector.
SALTS = 16
LONG = 2**63 - 1


def quantised(vector: str, scale: int = 1024):
    """floor(scale * x) of each component, or null for a vector that takes no part."""
    column = F.col(vector)
    whole = ~F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return F.when(whole, F.transform(column, lambda x: F.floor(x.cast("double") * scale).cast("long")))


def classes(vectors: DataFrame, id_column: str, vector: str, k: int) -> tuple[DataFrame, DataFrame]:
    """(id, row, v) of all rows that take part, and (cls, v, members) of the distinct vectors; both are written."""
    rows = written(
        vectors.select(F.col(id_column).alias("id"), F.col(vector).alias("v")).where("v is not null").withColumn("row", F.monotonically_increasing_id()), "vectors"
    )
    order = [F.col("id").asc_nulls_last(), F.col("row")]
    first = rows.withColumn("_n", F.row_number().over(Window.partitionBy("v").orderBy(*order))).where(F.col("_n") <= k + 1)
    member = F.sort_array(F.collect_list(F.struct("_n", "id", "row")))
    found = first.groupBy("v").agg(member.alias("members")).select(F.monotonically_increasing_id().alias("cls"), "v", "members")
    return rows, written(found, "classes")


def _matrix(column: pa.Array) -> np.ndarray:
    """A list column as rows of int64, short ones filled up with zeros."""
    sizes = np.diff(np.asarray(column.offsets))
    out = np.zeros((len(column), int(sizes.max(initial=0))), np.int64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = np.asarray(column.flatten())
    return out


def _largest(values: np.ndarray) -> float:
    return max(float(values.max(initial=0)), -float(values.min(initial=0)))


class Block:
    """A block of queries: their classes, vectors, and cutoffs once they are known."""

    def __init__(self, found: pa.Table, cutoffs: dict[int, int] | None = None):
        self.cls = found["cls"].to_numpy()
        self.v = _matrix(found["v"].combine_chunks()) if found.num_rows else np.zeros((0, 0), np.int64)
        self.cutoff = cutoffs

    def partial(self, rows: np.ndarray, own: slice) -> list[np.ndarray]:
        """For each list, the scores of ``rows`` with the queries of ``own``: (queries, rows)."""
        width = min(rows.shape[1], self.v.shape[1])
        most = _largest(rows) * _largest(self.v) * max(1, width)
        kind = np.float64 if most < 2**53 else np.int64 if most < 2**62 else object
        cuts = [width * i // LISTS for i in range(LISTS + 1)]
        left, right = self.v[own].astype(kind), rows.astype(kind)
        return [left[:, a:b] @ right[:, a:b].T if b > a else np.zeros((len(left), len(right)), kind) for a, b in zip(cuts, cuts[1:], strict=False)]


def _long(scores: np.ndarray) -> pa.Array:
    return pa.array([max(-LONG, min(LONG, x)) for x in scores.tolist()] if scores.dtype == object else scores.astype(np.int64), pa.int64())


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            piece = batch.slice(at, ROWS)
            yield np.asarray(piece.column("cls")), _matrix(piece.column("v"))


def local_lists(found: DataFrame, block: Broadcast, k: int) -> DataFrame:
    """Phase 1: (q, list, cls, partial, score), the ``k`` highest entries of each task's lists and their whole scores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: Block = block.value
        best: dict[tuple[int, int], list] = {}  # of a slice of queries and a list: partial scores, classes, whole scores
        for cls, rows in _chunks(batches):
            for at in range(0, len(asked.cls), QUERIES):
                parts = asked.partial(rows, slice(at, at + QUERIES))
                score = sum(parts[1:], parts[0])
                for i, part in enumerate(parts):
                    pick = np.argpartition(-part, k - 1, axis=1)[:, :k] if k < part.shape[1] and part.dtype != object else np.argsort(-part, axis=1)[:, :k]
                    new = [np.take_along_axis(part, pick, 1), cls[pick], np.take_along_axis(score, pick, 1)]
                    if (held := best.get((at, i))) is not None:
                        new = [np.concatenate([a, b], axis=1) for a, b in zip(held, new, strict=True)]
                        pick = np.argsort(-new[0], axis=1)[:, :k]
                        new = [np.take_along_axis(x, pick, 1) for x in new]
                    best[at, i] = new
        for (at, i), (part, cls, score) in best.items():
            q = np.repeat(asked.cls[at : at + QUERIES], part.shape[1])
            columns = [pa.array(q), pa.array(np.full(len(q), i, np.int32)), pa.array(cls.ravel()), _long(part.ravel()), _long(score.ravel())]
            yield pa.RecordBatch.from_arrays(columns, names=["q", "list", "cls", "partial", "score"])

    return found.select("cls", "v").mapInArrow(run, "q long, list int, cls long, partial long, score long")


def cutoffs(lists: DataFrame, k: int) -> DataFrame:
    """(q, cutoff): the ``k``-th best whole score among a query's highest entries, or null if there are fewer."""
    ranked = lists.groupBy("q", "cls").agg(F.max("score").alias("score")).withColumn("_n", F.row_number().over(Window.partitionBy("q").orderBy(F.col("score").desc(), "cls"))).where(F.col("_n") <= k)
    return ranked.groupBy("q").agg(F.min("score").alias("cutoff"), F.count("*").alias("m")).select("q", F.when(F.col("m") == k, F.col("cutoff")).alias("cutoff"))


def sufficient(found: DataFrame, block: Broadcast, counter=None) -> DataFrame:
    """Phases 2 and 3: (q, cls, score) of the rows with a partial score that suffices, whose whole score reaches the cutoff.

    ``counter``, if given, is an accumulator of how many entries sufficed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: Block = block.value
        for cls, rows in _chunks(batches):
            for at in range(0, len(asked.cls), QUERIES):
                own = asked.cls[at : at + QUERIES]
                parts = asked.partial(rows, slice(at, at + QUERIES))
                known = np.array([asked.cutoff.get(q) is not None for q in own.tolist()])
                cut = np.array([asked.cutoff.get(q) or 0 for q in own.tolist()], object if parts[0].dtype == object else parts[0].dtype)
                # sums of integers reach a cutoff only if one of them reaches its share, rounded up
                share = np.array([-(-int(c) // LISTS) for c in cut.tolist()], cut.dtype)
                enough = np.zeros(parts[0].shape, bool)
                for part in parts:
                    enough |= (part >= share[:, None]).astype(bool)
                q, v = np.nonzero(enough | ~known[:, None])
                if counter is not None:
                    counter.add(len(q))
                score = sum(part[q, v] for part in parts)
                reach = (score >= cut[q]).astype(bool) | ~known[q]
                q, v, score = q[reach], v[reach], score[reach]
                if len(q):
                    yield pa.RecordBatch.from_arrays([pa.array(own[q]), pa.array(cls[v]), _long(score)], names=["q", "cls", "score"])

    return found.select("cls", "v").mapInArrow(run, "q long, cls long, score long")


def _blocks(asked: DataFrame, n: int, width: int) -> Iterator[pa.Table]:
    """The query classes (cls, v) in blocks of a bounded size."""
    blocks = max(1, -(-n * width * 8 // BLOCK_BYTES))
    if blocks == 1:
        yield asked.toArrow()
        return
    dealt = written(asked.withColumn("block", (F.xxhash64("cls") % blocks + blocks) % blocks), "asked", by="block")
    for i in range(blocks):
        yield dealt.where(F.col("block") == i).select("cls", "v").toArrow()


def search(vectors: DataFrame, id_column: str, vector: str, asks, k: int = 10, counter=None) -> DataFrame:
    """(query_id, rank, id, score): the ``k`` highest inner products of each row for which ``asks``, a condition on ``id``.

    ``vector`` holds arrays of longs (see :func:`quantised`); null ones take no part.
    """
    spark = vectors.sparkSession
    rows, found = classes(vectors, id_column, vector, k)
    queries = rows.where(asks & F.col("id").isNotNull()).withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)))
    asking = written(found.select("cls", "v").join(queries.select("v").distinct(), "v", "left_semi"), "asking")
    size = asking.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("v")), F.lit(0)).alias("w")).first()
    best = []
    top = k + 1  # a query's own class may be there for the query alone
    for part in _blocks(asking, size["n"], size["w"]):
        first = spark.sparkContext.broadcast(Block(part))
        cut = {r["q"]: r["cutoff"] for r in cutoffs(local_lists(found, first, DEPTH * top), top).collect()}
        second = spark.sparkContext.broadcast(Block(part, cut))
        best.append(written(sufficient(found, second, counter), "reached"))
        first.destroy()
        second.destroy()
    reached = best[0]
    for more in best[1:]:
        reached = reached.unionByName(more)
    # of classes: the first by score and first row; then of their members
    ahead = found.select("cls", "members", F.col("members")[0]["id"].alias("f"), F.col("members")[0]["row"].alias("g"))
    by_class = Window.partitionBy("q").orderBy(F.col("score").desc(), F.col("f").asc_nulls_last(), "g")
    near = reached.join(ahead, "cls").withColumn("_n", F.row_number().over(by_class)).where(F.col("_n") <= top)
    near = near.select("q", "score", F.explode("members").alias("m"))
    hit = F.struct((-F.col("score")).alias("s"), F.col("m.id").isNull().alias("n"), F.col("m.id").alias("id"), F.col("m.row").alias("row"), "score")
    lists = near.groupBy("q").agg(F.slice(F.sort_array(F.collect_list(hit)), 1, top).alias("hits"))
    # back to the rows that ask, by vector and share
    named = found.select(F.col("cls").alias("q"), "v").join(lists, "q").withColumn("salt", F.explode(F.array(*(F.lit(i).cast("long") for i in range(SALTS)))))
    own = queries.select("id", "row", "v", "salt").join(named, ["v", "salt"])
    others = F.slice(F.filter("hits", lambda h: h["row"] != F.col("row")), 1, k)
    out = own.select(F.col("id").alias("query_id"), F.posexplode(others).alias("at", "hit"))
    return out.select("query_id", (F.col("at") + 1).alias("rank"), F.col("hit.id").alias(id_column), F.col("hit.score").alias("score"))


def oracle_sql(k: int = 10, every: int = 100, scale: int = 1024) -> str:
    """DuckDB SQL for :func:`search` over ``embeddings``, all pairs."""
    return f"""
WITH own AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * {scale})) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM own q JOIN own c ON q.vec_id <> c.vec_id WHERE q.vec_id % {every} = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= {k}"""
