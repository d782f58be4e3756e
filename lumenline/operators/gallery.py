"""The most alike vector of a gallery of any size for each probe, by exact cosines.

A gallery of up to ``block`` rows is broadcast: its size is counted first.  A larger one is cut into cells around pivots, rows
of it that are broadcast: a row belongs to its nearest pivot, and a cell's radius is the largest angle to it.  No row of a cell
is nearer to a probe than the angle to its pivot less the radius, and the nearest pivot is a row itself; so a probe is
compared only with the cells that can hold a row as near as that.  Probes and gallery meet by one shuffle: a task holds a
group of cells (or a part of one, where a cell is large), and probes stream past, each once however many cells of the group
it visits.  So a probe is sent as often as there are groups of ``HELD`` rows at most, not once for each cell: where nothing can be
pruned, what is on disk is the probes times the groups.  Groups are dealt to several tasks, each with a share of the probes.

The cosine with a vector of length 0 is 0.  Ties go to the smallest id.  Rows without a vector are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenline.operators.ordered import pinned

#: Rows of the gallery that are in memory at a time, and cells at most.
BLOCK, MOST_PIVOTS = 8192, 1024
#: Probes of a chunk that one task takes.
PROBES = 1_000_000
#: Rows of the gallery that a task holds, and into how many groups and shares of the probes both sides are cut at least.
HELD, SHARES = 262_144, 4
#: Angles are kept this much wider than worked out, far above the error of doubles.
SLACK = 1e-6
FOUND = "id long, best double, best_id long"


def _unit(column: pa.Array) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def _angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(a @ b.T, -1.0, 1.0))


def _best(ids: pa.Array, probes: np.ndarray, own: np.ndarray, unit: np.ndarray) -> pa.RecordBatch:
    """The best row of a chunk (``own`` ids in ascending order) for each probe."""
    cosine = probes @ unit.T
    k = cosine.argmax(1)
    return pa.RecordBatch.from_arrays([ids, pa.array(cosine[np.arange(len(k)), k]), pa.array(own[k])], names=["id", "best", "best_id"])


def _matrix(found: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(found["id"].to_numpy(), kind="stable")
    return found["id"].to_numpy()[order], _unit(found["v"].combine_chunks())[order]


def _broadcast(probes: DataFrame, gallery: DataFrame) -> DataFrame:
    sent = probes.sparkSession.sparkContext.broadcast(_matrix(gallery.toArrow()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, unit = sent.value
        for b in batches:
            if b.num_rows:
                yield _best(b.column("id"), _unit(b.column("v")), own, unit)

    return probes.mapInArrow(run, FOUND)


def _cells(gallery: DataFrame, pivots: np.ndarray) -> DataFrame:
    """(cell, angle, id, v) of the gallery."""
    sent = gallery.sparkSession.sparkContext.broadcast(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                angles = _angles(_unit(b.column("v")), sent.value)
                cell = angles.argmin(1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cell.astype(np.int32)), pa.array(angles[np.arange(len(cell)), cell]), b.column("id"), b.column("v")], names=["cell", "angle", "id", "v"]
                )

    return gallery.mapInArrow(run, "cell int, angle double, id long, v array<float>")


def _visits(probes: DataFrame, pivots: np.ndarray, radii: np.ndarray, spans: np.ndarray) -> DataFrame:
    """(id, v, near, cells, groups) of the probes: the cells that can hold their best row, also as bits, and the groups of these.

    ``spans`` (cells, groups) tells in which groups a cell has rows.
    """
    sent = probes.sparkSession.sparkContext.broadcast((pivots, radii, spans))

    def listed(held: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(np.concatenate([[0], held.sum(1).cumsum()]).astype(np.int32), np.nonzero(held)[1].astype(np.int32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        points, widths, parts = sent.value
        for b in batches:
            if b.num_rows:
                angles = _angles(_unit(b.column("v")), points)
                near = angles - widths <= angles.min(1, keepdims=True) + SLACK
                bits = pa.array([r.tobytes() for r in np.packbits(near, axis=1)], pa.binary())
                groups = near.astype(np.float32) @ parts > 0
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("v"), bits, listed(near), listed(groups)], names=["id", "v", "near", "cells", "groups"])

    return probes.mapInArrow(run, "id long, v array<float>, near binary, cells array<int>, groups array<int>")


def _placed(probes: DataFrame, gallery: DataFrame, block: int, rows: int, groups: int) -> tuple[DataFrame, DataFrame, list[int]]:
    """(cell, group, id, v) of the gallery, :func:`_visits` of the probes, and the rows of each cell.

    A row's place is among its cell's, which follow one another; groups cut the places evenly, whatever the cells' sizes.
    """
    wanted = min(MOST_PIVOTS, -(-rows // block))
    sample = gallery.orderBy(F.xxhash64("id"), "id").limit(wanted).toArrow()
    pivots = _matrix(sample)[1]
    placed = pinned(_cells(gallery, pivots))
    stats = {r["cell"]: r for r in placed.groupBy("cell").agg(F.max("angle").alias("radius"), F.count("*").alias("n")).collect()}
    radii = np.array([stats[c]["radius"] if c in stats else -np.inf for c in range(len(pivots))])  # a cell without rows is never near
    sizes = [stats[c]["n"] if c in stats else 0 for c in range(len(pivots))]
    begins = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    total = max(1, int(begins[-1]))
    spans = np.zeros((len(pivots), groups), np.float32)
    for c, n in enumerate(sizes):
        if n:
            spans[c, begins[c] * groups // total : (begins[c] + n - 1) * groups // total + 1] = 1
    at = F.get(F.lit(begins[:-1].tolist()), F.col("cell")) + F.pmod(F.xxhash64("id"), F.get(F.lit(sizes), F.col("cell")))
    own = placed.select("cell", F.floor(at * groups / total).cast("int").alias("group"), "id", "v")
    return own, _visits(probes, pivots, radii, spans), sizes


def visits(probes: DataFrame, gallery: DataFrame, block: int, rows: int) -> tuple[DataFrame, DataFrame]:
    """(cell, chunk, id, v) of the gallery and (cell, chunk, id, v) of the probes that are compared with each, ``block`` rows a chunk.

    It shows how far pruning goes; a row for each cell of a probe is more than is ever written.
    """
    own, listed, sizes = _placed(probes, gallery, block, rows, 1)
    parts = F.get(F.array(*(F.lit(-(-n // block)) for n in sizes)), F.col("cell"))
    own = own.select("cell", F.pmod(F.xxhash64("id"), parts).cast("int").alias("chunk"), "id", "v")
    sent = listed.select("id", "v", F.explode("cells").alias("cell"))
    return own, sent.select("cell", F.explode(F.sequence(F.lit(0), parts.cast("int") - 1)).alias("chunk"), "id", "v")


def _compared(ids: pa.Array, probes: np.ndarray, near: np.ndarray, cells: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """The best row for each probe, of the cells (number, ids in ascending order, vectors) that are near; ties to the smallest id."""
    best, best_id = np.full(len(ids), -np.inf), np.zeros(len(ids), np.int64)
    for cell, own, unit in cells:
        rows = np.flatnonzero(near[:, cell])
        for begin in range(0, len(unit) if len(rows) else 0, BLOCK):
            for at in range(0, len(rows), 1024):
                some = rows[at : at + 1024]
                cosine = probes[some] @ unit[begin : begin + BLOCK].T
                k = cosine.argmax(1)
                top, found = cosine[np.arange(len(k)), k], own[begin + k]
                better = (top > best[some]) | ((top == best[some]) & (found < best_id[some]))
                best[some[better]], best_id[some[better]] = top[better], found[better]
    seen = np.flatnonzero(best > -np.inf)
    return pa.RecordBatch.from_arrays([ids.take(pa.array(seen)), pa.array(best[seen]), pa.array(best_id[seen])], names=["id", "best", "best_id"])


def most_alike(probes: DataFrame, gallery: DataFrame, id_column: str, vector: str, block: int = BLOCK, per_task: int = PROBES) -> DataFrame:
    """(id, best, best_id): each probe's highest cosine with a gallery row, and that row; no rows without a gallery."""
    named = lambda df: df.select(F.col(id_column).cast("long").alias("id"), F.col(vector).cast("array<float>").alias("v")).where("v is not null")
    probes, gallery = named(probes), named(gallery)
    rows = gallery.count()
    if not rows:
        found = probes.sparkSession.createDataFrame([], FOUND)
    elif rows <= block:
        found = _broadcast(probes, gallery)
    else:
        groups = max(SHARES, -(-rows // HELD))
        shares = max(SHARES, -(-probes.count() // per_task))
        own, listed, sizes = _placed(probes, gallery, block, rows, groups)
        share = F.pmod(F.xxhash64("id"), F.lit(shares)).cast("int")
        held = own.select("group", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share"), "cell", "id", "v", F.lit(None).cast("binary").alias("near"))
        sent = listed.select(F.explode("groups").alias("group"), share.alias("share"), F.lit(len(sizes)).alias("cell"), "id", "v", "near")
        # groups and shares by number, so that each is a task; probes come after all cells
        place = (F.col("group") * shares + F.col("share")).cast("int")
        both = held.union(sent).repartitionById(groups * shares, place).sortWithinPartitions("group", "share", "cell", "id")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, parts, cells = None, [], None
            for b in batches:
                keys = np.stack([np.asarray(b.column(c)) for c in ("group", "share", "cell")])
                cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1).tolist(), b.num_rows]
                for begin, end in zip(cuts, cuts[1:], strict=False):
                    if begin == end:
                        continue
                    piece, (*where, cell) = b.slice(begin, end - begin), keys[:, begin].tolist()
                    if where != at:
                        at, parts, cells = where, [], None
                    if cell < len(sizes):
                        if parts and parts[-1][0] == cell:
                            parts[-1][1].append(piece)
                        else:
                            parts.append((cell, [piece]))
                        continue
                    if cells is None:
                        cells = [(c, *_matrix(pa.Table.from_batches(p))) for c, p in parts]
                        parts = []
                    bits = np.frombuffer(b"".join(piece.column("near").to_pylist()), np.uint8).reshape(piece.num_rows, -1)
                    yield _compared(piece.column("id"), _unit(piece.column("v")), np.unpackbits(bits, axis=1), cells)

        found = both.mapInArrow(run, FOUND)
    best = found.groupBy("id").agg(F.max("best").alias("best"), F.min_by("best_id", F.struct(-F.col("best"), F.col("best_id"))).alias("best_id"))
    return best.withColumnRenamed("id", id_column)
