"""Operators over ordered rows of a key: duplicates, runs, sessions, triggers, windows, alignment."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenline.functions import text as T
from lumenline.operators.ordered import AT, BLOCK, SPANS, dealt, pinned, plain, running


def drop_consecutive(df: DataFrame, key: str, order: list[str], value: str, blocks: int | None = None) -> DataFrame:
    """Rows whose value differs from the row before (equal to the last kept one: dropped rows equal it)."""
    rows = dealt(df, key, order, {"_b": F.col(value)}, blocks)
    return plain(rows.where((F.col(AT) == 1) | ~F.col("_b").eqNullSafe(F.col(value)))).drop("_b")


def before(df: DataFrame, key: str, order: list[str], value: str, name: str, blocks: int | None = None) -> DataFrame:
    """``df`` with ``name``: ``value`` of the key's row before, null for its first."""
    return plain(dealt(df, key, order, {name: F.col(value)}, blocks))


def islands(df: DataFrame, key: str, order: list[str], starts: Callable[..., Column], last: dict[str, Column], name: str = "island", blocks: int | None = None) -> DataFrame:
    """Numbers the runs of a key; a run starts where ``starts`` is not false, a function of the columns of ``last`` in the row before."""
    held = {f"_b{i}": value for i, value in enumerate(last.values())}
    rows = dealt(df, key, order, held, blocks)
    start = F.when((F.col(AT) == 1) | F.coalesce(starts(*map(F.col, held)), F.lit(True)), 1).otherwise(0)
    return plain(running(rows, key, start, name)).drop(*held)


def merge_runs(df: DataFrame, key: str, at: str, value: str, score: str, tie: str, step: int = 1, blocks: int | None = None) -> DataFrame:
    """One row a run of equal values at most ``step`` apart: its bounds, size, and the row with the highest score.

    Of rows with that score the first by ``at`` and ``tie`` counts.
    """
    starts = lambda v, t: ~((v == F.col(value)) & (F.col(at) - t <= step))
    runs = islands(df, key, [at, tie], starts, {"value": F.col(value), "at": F.col(at)}, blocks=blocks)
    best = F.min(F.struct((-F.col(score)).alias("s"), F.col(at).alias("a"), F.col(tie).alias("t")))
    out = runs.groupBy(key, "island").agg(F.first(value).alias(value), F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("n"), best.alias("b"))
    return out.select(key, "island", value, "first", "last", "n", F.col("b.a").alias("best_at"), (-F.col("b.s")).alias("best_score"))


def sessions(
    df: DataFrame, key: str, order: str, text: str, similarity: Callable[[Column, Column], Column], least: float = 0.8, blocks: int | None = None
) -> DataFrame:
    """One row a session: rows whose text is like the row before; an empty text on either side breaks it.

    Bounds, their mean (half to even, two digits), rows, and rows with text.
    """
    goes_on = lambda b: (b != "") & (F.col(text) != "") & F.coalesce(similarity(b, F.col(text)) >= least, F.lit(False))
    runs = islands(df, key, [order], lambda b: ~goes_on(b), {"text": F.col(text)}, blocks=blocks)
    mid = F.bround((F.min(order) + F.max(order)) / 2.0, 2)
    return runs.groupBy(key, "island").agg(
        F.min(order).alias("t0"), F.max(order).alias("t1"), mid.alias("mid"), F.count("*").alias("n_points"), F.count_if(F.col(text) != "").alias("n_read")
    )


def _chains(flags: np.ndarray, gap: int) -> tuple[np.ndarray, np.ndarray]:
    """Places that could fire, and for each the last place of the chain that begins there."""
    places = np.flatnonzero(flags)
    follow = np.searchsorted(places, places + max(1, gap))
    last = places.copy()
    for i in range(len(places) - 1, -1, -1):
        if follow[i] < len(places):
            last[i] = last[follow[i]]
    return places, last


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows of sorted batches, a key's part of a block at a time (column 0 numbers the rows of each from 1)."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        cuts = [0, *np.flatnonzero(b.column(0).to_numpy() == 1).tolist(), b.num_rows]
        for begin, end in zip(cuts, cuts[1:], strict=False):
            if end > begin:
                if held and b.column(0)[begin].as_py() == 1:
                    yield pa.Table.from_batches(held)
                    held = []
                held.append(b.slice(begin, end - begin))
    if held:
        yield pa.Table.from_batches(held)


def debounced(df: DataFrame, key: str, order: str, value: str, active: Column, least: float, gap: int, blocks: int | None = None) -> DataFrame:
    """Rows that fire: value differs from the row before by over ``least``, ``gap`` rows after the last that fired, active.

    The row before is always the last one scanned, fired or not.  What happens in a block hangs on the past only by how many
    of its first rows are still too close to the last that fired, fewer than ``gap``.  So a first pass tells, for the places of a
    block where a chain can begin, where it ends; these small tables are folded over a key's blocks, and a second pass fires.
    """
    rows = dealt(df, key, [order], {"_b": F.col(value).cast("double")}, blocks)
    on = (F.col("_b").isNull() | (F.abs(F.col(value) - F.col("_b")) > least)) & active
    local = F.row_number().over(Window.partitionBy(key, BLOCK).orderBy(AT))
    flagged = pinned(rows.select(F.col(key), F.col(order), BLOCK, AT, SPANS, F.coalesce(on, F.lit(False)).alias("_on")))
    placed = flagged.withColumn("_n", local).select("_n", "_on", BLOCK, SPANS, F.col(key), F.col(order))
    kind = flagged.schema[key].dataType.simpleString()

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            places, last = _chains(part["_on"].to_numpy(), gap)
            near = int(np.searchsorted(places, gap)) + 1  # those that a chain can begin at, whatever came before
            made = pa.array([{"n": part.num_rows, "places": places[:near].tolist(), "last": last[:near].tolist()}], TABLE)
            yield pa.RecordBatch.from_arrays([part.column(4).combine_chunks().slice(0, 1), part[BLOCK].combine_chunks().slice(0, 1), made], names=["k", "b", "t"])

    edges = placed.where(SPANS).sortWithinPartitions(key, BLOCK, "_n").mapInArrow(tables, f"k {kind}, b int, t struct<n:bigint,places:array<bigint>,last:array<bigint>>")

    def step(s: Column, x: Column) -> Column:
        hit = F.get(F.filter(F.zip_with(x["t"]["places"], x["t"]["last"], lambda p, e: F.struct(p.alias("p"), e.alias("e"))), lambda c: c["p"] >= s["skip"]), 0)
        left = F.when(hit.isNotNull(), hit["e"] + gap - x["t"]["n"]).otherwise(s["skip"] - x["t"]["n"])
        return F.struct(F.greatest(left, F.lit(0).cast("long")).alias("skip"), F.array_append(s["seen"], F.struct(x["b"].alias("b"), s["skip"].alias("skip"))).alias("seen"))

    start = F.struct(F.lit(0).cast("long").alias("skip"), F.array().cast("array<struct<b:int,skip:bigint>>").alias("seen"))
    folded = edges.groupBy("k").agg(F.aggregate(F.sort_array(F.collect_list(F.struct("b", "t"))), start, step, lambda s: s["seen"]).alias("seen"))
    skips = F.broadcast(folded.select(F.col("k").alias("_k"), F.inline("seen")))
    met = placed.join(skips, placed[key].eqNullSafe(F.col("_k")) & (F.col(BLOCK) == F.col("b")), "left")
    met = met.select("_n", "_on", F.coalesce("skip", F.lit(0)).cast("long").alias("_skip"), F.col(key), F.col(order), BLOCK)
    met = met.sortWithinPartitions(key, BLOCK, "_n")  # the window has dealt them so already

    def fire(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            flags = part["_on"].to_numpy().copy()
            flags[: part["_skip"][0].as_py()] = False
            places, hits, at = np.flatnonzero(flags), [], 0
            while at < len(places):
                hits.append(int(places[at]))
                at = int(np.searchsorted(places, places[at] + max(1, gap)))
            yield from part.select([key, order]).take(pa.array(hits, pa.int64())).to_batches()

    return met.mapInArrow(fire, f"`{key}` {kind}, `{order}` {flagged.schema[order].dataType.simpleString()}")


#: What a block tells of a key that goes on in others: its rows, the places where a chain can begin, and where that ends.
TABLE = pa.struct([("n", pa.int64()), ("places", pa.list_(pa.int64())), ("last", pa.list_(pa.int64()))])


def first_passing(
    df: DataFrame, row: str, priority: str, passes: Column, payload: str, matched: Column | None = None, reasons: tuple[str, str] = ("none", "none")
) -> DataFrame:
    """(``row``, ``payload``, reason): payload of the passing candidate with the lowest priority, else null with a reason.

    The reason is ok, else the second of ``reasons`` where a candidate is ``matched`` that did not pass, else the first.
    """
    best = F.min(F.when(passes, F.struct(F.col(priority).alias("at"), F.col(payload).alias("value"))))
    some = F.bool_or(F.lit(False) if matched is None else F.coalesce(matched, F.lit(False)))
    reason = F.when(F.col("b").isNotNull(), "ok").when(F.col("m"), reasons[1]).otherwise(reasons[0])
    return df.groupBy(row).agg(best.alias("b"), some.alias("m")).select(row, F.col("b.value").alias(payload), reason.alias("reason"))


def until_first(df: DataFrame, key: str, order: str, hit: Column) -> DataFrame:
    """Each key's rows up to and with the first hit."""
    first = df.where(hit).groupBy(F.col(key).alias("_k")).agg(F.min(order).alias("_h"))
    met = df.join(first, F.col(key).eqNullSafe(F.col("_k")), "left")
    return met.where(F.col("_h").isNull() | (F.col(order) <= F.col("_h"))).drop("_k", "_h")


def leader_clusters(
    texts: Column, similarity: Callable[[Column, Column], Column], least: float = 0.8, scores: Column | None = None, prepare: Callable[[Column], Column] | None = None
) -> Column:
    """Clusters of an ordered array: each text joins the first cluster whose leader is like it, else leads a new one.

    Array of (rep, n, score), largest first; ties in order of leaders.  ``score`` is the mean of the members' ``scores``, to
    three digits (0 without any).  ``prepare`` is applied to each text once; ``similarity`` then gets what it gives.
    """
    empty = F.array().cast("array<struct<rep:string,x:string,n:int,sum:double>>")
    scored = F.zip_with(
        texts,
        F.transform(texts, lambda t: F.lit(0.0)) if scores is None else scores,
        lambda t, s: F.struct(t.alias("t"), (prepare(t) if prepare else t).alias("x"), F.coalesce(s.cast("double"), F.lit(0.0)).alias("s")),
    )

    def put(state: Column, x: Column) -> Column:
        hit = F.array_position(F.transform(state, lambda c: F.coalesce(similarity(c["x"], x["x"]) >= least, F.lit(False))), True)

        def added(at: Column) -> Column:
            more = F.transform(
                state,
                lambda c, i: F.struct(
                    c["rep"].alias("rep"), c["x"].alias("x"), (c["n"] + F.when(i + 1 == at, 1).otherwise(0)).alias("n"), (c["sum"] + F.when(i + 1 == at, x["s"]).otherwise(0.0)).alias("sum")
                ),
            )
            return F.when(at == 0, F.array_append(state, F.struct(x["t"].alias("rep"), x["x"].alias("x"), F.lit(1).alias("n"), x["s"].alias("sum")))).otherwise(more)

        return T.let(hit, added)  # else each of the cluster's fields would compare all leaders anew

    found = F.aggregate(scored, empty, put)
    ranked = F.array_sort(F.transform(found, lambda c, i: F.struct((-c["n"]).alias("k"), i.alias("i"), c["rep"].alias("rep"), c["sum"].alias("sum"))))
    return F.transform(ranked, lambda x: F.struct(x["rep"].alias("rep"), (-x["k"]).alias("n"), F.bround(x["sum"] / -x["k"], 3).alias("score")))


def cluster_rows(df: DataFrame, key: str, order: str, text: str, least: float = 0.8, score: str | None = None) -> DataFrame:
    """(``key``, leader, rep, n, score) of the clusters that :func:`leader_clusters` by edit similarity makes, for groups of any size.

    ``leader`` is the ``order`` of a cluster's first row, ``rep`` its text.  Equal texts are one.  Texts can be alike only if
    they share one of their rarest pairs of characters (characters, for ``least`` up to 0.75), as many as the edits allowed may
    change and one more; only such pairs of like lengths are compared.  A text without an earlier one like it that may lead
    leads, those like a leader follow, and so on by rounds; a follower belongs to the first leader in order that it is like.
    Texts that are empty when normed are like none.  ``order`` must be unique within a key; null keys are one.
    """
    if not 0 < least <= 1:
        raise ValueError("least must be above 0 and up to 1")
    k, q = F.col("k"), 2 if least > 0.75 else 1
    points = F.lit(0.0) if score is None else F.coalesce(F.col(score).cast("double"), F.lit(0.0))
    rows = df.select(F.col(key).alias("k"), F.col(order).alias("o"), F.col(text).alias("t"), T.norm_text(F.coalesce(F.col(text), F.lit(""))).alias("x"), points.alias("p"))
    same = F.when(F.col("x") == "", F.col("o"))  # empty ones stay apart
    nodes = rows.groupBy("k", "x", same.alias("e")).agg(F.min("o").alias("o"), F.min_by("t", "o").alias("t"), F.count("*").alias("n"), F.sum("p").alias("p"))
    nodes = pinned(nodes.drop("e"))
    size = F.length("x")
    edits = F.floor((1 - least) * size + 1e-9)
    grams = F.transform(F.sequence(F.lit(1), size - (q - 1)), lambda i: F.substring(F.col("x"), i, F.lit(q)))
    # the second of two equal pairs of characters is another one than the first
    told = F.transform(grams, lambda g, i: F.concat(g, F.size(F.filter(F.slice(grams, F.lit(1), i), lambda h: h == g)).cast("string")))
    held = nodes.where(size >= q).select("k", "o", "x", (q * edits + 1).alias("m"), F.explode(told).alias("g"))
    often = held.groupBy(k.alias("_k"), F.col("g").alias("_g")).agg(F.count("*").alias("c"))
    rare = held.join(often, k.eqNullSafe(F.col("_k")) & (F.col("g") == F.col("_g"))).select("k", "o", "x", "m", "g", "c")
    rare = rare.withColumn("r", F.row_number().over(Window.partitionBy("k", "o").orderBy("c", "g"))).where(F.col("r") <= F.col("m"))
    rare = pinned(rare.select("k", "g", "o", "x"))
    a, b = rare.alias("a"), rare.alias("b")
    shorter, longer = F.least(F.length("a.x"), F.length("b.x")), F.greatest(F.length("a.x"), F.length("b.x"))
    near = F.col("a.k").eqNullSafe(F.col("b.k")) & (F.col("a.g") == F.col("b.g")) & (F.col("a.o") < F.col("b.o")) & (longer - shorter <= F.floor((1 - least) * shorter + 1e-9))
    met = a.join(b, near).select(F.col("a.k").alias("k"), F.col("a.o").alias("a"), F.col("b.o").alias("b"), F.col("a.x").alias("x"), F.col("b.x").alias("y"))
    met = met.dropDuplicates(["k", "a", "b"])
    edges = pinned(met.where(T.normed_similarity(F.col("x"), F.col("y"), least) >= least).select("k", "a", "b"))

    def of(left: DataFrame, at: str, right: DataFrame, how: str) -> DataFrame:
        named = right.select(k.alias("_k"), F.col("o").alias("_o"))
        return left.join(named, k.eqNullSafe(F.col("_k")) & (F.col(at) == F.col("_o")), how)

    left, open_edges, lead = nodes.select("k", "o"), edges, []
    while True:
        waiting = open_edges.select("k", F.col("b").alias("o")).distinct()
        leaders = pinned(of(left, "o", waiting, "left_anti"))
        lead.append(leaders)
        if open_edges.isEmpty():
            break
        follow = pinned(of(open_edges, "a", leaders, "left_semi").select("k", F.col("b").alias("o")).distinct())
        left = pinned(of(of(left, "o", leaders, "left_anti"), "o", follow, "left_anti"))
        open_edges = pinned(of(of(open_edges, "a", left, "left_semi"), "b", left, "left_semi"))
    leaders = reduce(DataFrame.union, lead)
    first = of(edges, "a", leaders, "left_semi").groupBy("k", F.col("b").alias("o")).agg(F.min("a").alias("l"))
    owned = nodes.alias("m").join(first.alias("f"), F.col("m.k").eqNullSafe(F.col("f.k")) & (F.col("m.o") == F.col("f.o")), "left")
    owned = owned.select("m.k", "m.o", "m.t", "m.n", "m.p", F.coalesce("f.l", "m.o").alias("l"))
    out = owned.groupBy("k", "l").agg(F.min_by("t", "o").alias("rep"), F.sum("n").alias("n"), F.bround(F.sum("p") / F.sum("n"), 3).alias("score"))
    return out.select(k.alias(key), F.col("l").alias("leader"), "rep", "n", "score")


def majority_text(clusters: Column, alternatives: int = 3) -> Column:
    """Struct (text, support, alts) of clusters as :func:`leader_clusters` gives them: the largest, and the next ones as (text, n)."""

    def told(found: Column) -> Column:
        others = F.transform(F.slice(found, 2, alternatives), lambda c: F.struct(c["rep"].alias("text"), c["n"].alias("n")))
        return F.struct(F.get(found, 0)["rep"].alias("text"), F.get(found, 0)["n"].alias("support"), others.alias("alts"))

    return T.let(clusters, told)


def text_sessions(
    df: DataFrame,
    key: str,
    order: str,
    texts: str,
    similarity: Callable[[Column, Column], Column],
    least: float = 0.8,
    blocks: int | None = None,
    prepare: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """One row a session of points with several texts each: a point goes on if any of its texts is like any of the point before.

    No texts on either side break it.  Bounds, their mean, points, texts read, and the majority text; sessions without texts go.
    ``prepare`` is applied to each text once before it is compared.
    """
    compared = F.transform(texts, prepare) if prepare else F.col(texts)
    like = lambda was: F.exists(compared, lambda a: F.exists(was, lambda b: similarity(a, b) >= least))
    runs = islands(df, key, [order], lambda was: ~((F.size(texts) > 0) & (F.size(was) > 0) & like(was)), {"texts": compared}, blocks=blocks)
    read = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(texts).alias("x")))), lambda r: r["x"]))
    out = runs.groupBy(key, "island").agg(
        F.min(order).alias("t0"), F.max(order).alias("t1"), F.bround((F.min(order) + F.max(order)) / 2.0, 2).alias("mid"), F.count("*").alias("n_points"), read.alias("read")
    )
    out = out.where(F.size("read") > 0).withColumn("c", majority_text(leader_clusters(F.col("read"), similarity, least, prepare=prepare)))
    return out.select(key, "island", "t0", "t1", "mid", "n_points", F.size("read").alias("n_read"), "c.*")


def windowed_pairs(left: DataFrame, right: DataFrame, key: str, at: str, window: int, score: Column) -> DataFrame:
    """Pairs of a key at most ``window`` apart, with ``similarity``.

    Time is cut into buckets of the window's width and the left side sent to its own and both neighbours, so the join is
    an equi-join.  Columns of the sides must differ but for ``key``; ``at`` is l_``at`` and r_``at``.  Pairs without any
    similarity (0 or less) are none.
    """
    b = lambda c: F.floor(F.col(c) / window)
    sent = left.withColumn("_b", F.explode(F.array(b(f"l_{at}") - 1, b(f"l_{at}"), b(f"l_{at}") + 1)))
    met = sent.join(right.withColumn("_b", b(f"r_{at}")), [key, "_b"]).where(F.abs(F.col(f"l_{at}") - F.col(f"r_{at}")) <= window)
    return met.withColumn("similarity", score).where("similarity > 0").drop("_b")


#: Pairs that a task matches at a time.
MATCH_ROWS = 200_000


def greedy_matching(pairs: DataFrame, key: str, i: str, j: str, similarity: str, rows: int = MATCH_ROWS) -> DataFrame:
    """One-to-one pairs of each key: the most similar first, ties by i then j; each i and j is used once.

    Pairs are cut into blocks by ranges of (key, i), so all pairs of an i are in one block.  A pair is decided there if no pair
    that comes first may still take its i or j: of its block these are known, and of other blocks the first pair of each j is.
    What is left (pairs near the ends of blocks, and those that hang on them) is cut anew, into half as many blocks at most,
    until nothing is: a single block decides all its pairs.  So rounds are the logarithm of the blocks, even where all pairs
    tie and each hangs on the one before.
    """
    own = pairs.select(F.col(key).alias("k"), F.col(i).alias("i"), F.col(j).alias("j"), F.col(similarity).alias("s"))
    kinds = {f.name: f.dataType.simpleString() for f in own.schema.fields}
    schema = f"k {kinds['k']}, i {kinds['i']}, j {kinds['j']}, s {kinds['s']}"
    first = F.struct(F.col("s").isNull().alias("z"), (-F.col("s")).alias("s"), "i", "j")
    same = lambda a, b, *names: reduce(and_, (a[c].eqNullSafe(b[c]) for c in names))
    rest, matched, blocks = pinned(own), [], 0
    while left := rest.count():
        blocks = max(1, min(-(-left // rows), blocks // 2)) if matched else -(-left // rows)
        cut = pinned(rest.repartitionByRange(blocks, "k", "i").withColumn("b", F.spark_partition_id()).withColumn("o", first))
        # of each j in several blocks, the first pair of each block; a block needs the best of the others
        ahead = cut.groupBy("k", "j", "b").agg(F.min("o").alias("o")).groupBy("k", "j").agg(F.slice(F.array_sort(F.collect_list(F.struct("o", "b"))), 1, 2).alias("two"))
        shared = ahead.where(F.size("two") > 1)
        met = cut.join(shared, same(cut, shared, "k", "j"), "left").select(cut["*"], "two")
        other = F.when(F.col("two")[0]["b"] == F.col("b"), F.col("two")[1]["o"]).otherwise(F.col("two")[0]["o"])
        met = met.select("b", "k", "i", "j", "s", "o", F.coalesce(other < F.col("o"), F.lit(False)).alias("late"))
        met = met.repartition(blocks, "b").sortWithinPartitions("b", "k", "o").drop("o")

        def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, used, open_ = (), set(), set()
            for batch in batches:
                verdicts = []
                columns = [batch.column(c).to_pylist() for c in ("b", "k", "i", "j", "late")]
                for b, k, x, y, late in zip(*columns, strict=True):
                    if (b, k) != now:
                        now, used, open_ = (b, k), set(), set()
                    x, y = (0, x), (1, y)
                    if x in used or y in used:
                        verdicts.append(0)
                    elif late or x in open_ or y in open_:
                        open_ |= {x, y}
                        verdicts.append(1)
                    else:
                        used |= {x, y}
                        verdicts.append(2)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("k", "i", "j", "s")), pa.array(verdicts, pa.int8())], names=["k", "i", "j", "s", "v"])

        done = pinned(met.mapInArrow(decide, f"{schema}, v byte").where("v > 0"))
        took = done.where("v = 2").drop("v")
        matched.append(took)
        open_pairs, gone = done.where("v = 1").drop("v"), took.select("k", "j")
        rest = pinned(open_pairs.join(gone, same(open_pairs, gone, "k", "j"), "left_anti"))
    found = reduce(DataFrame.union, matched) if matched else own
    return found.select(F.col("k").alias(key), F.col("i").alias(i), F.col("j").alias(j), F.col("s").alias(similarity))


def verdict(similarity: Column, kind: Column, support: Column, kana: Column) -> Column:
    """confirmed from 0.95 or same; unmatched without a pair or under 0.55; apply_add for a supported addition; else review."""
    return (
        F.when(similarity.isNull() | (similarity < 0.55), "unmatched")
        .when((similarity >= 0.95) | (kind == "same"), "confirmed")
        .when((kind == "add") & (support >= 2) & (kana <= 0.15), "apply_add")
        .otherwise("review")
    )
