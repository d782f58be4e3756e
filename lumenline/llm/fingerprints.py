"""Document fingerprints: spot signatures, all in the JVM.

A spot signature is a common word (the anchor) and the chain of the next ``CHAIN`` content words after it.  The anchors
are spread over running prose but rare in menus and tables, so a document's set of signatures stands for its prose.

A fingerprint is the sorted set of 32-bit signature hashes.  Two fingerprints are likened by Jaccard similarity.  For
joins, sets are partitioned by length: with threshold ``t`` a set of ``n`` can only meet sets of ``t*n .. n/t``, so a
partition meets itself and the next one, and pairs outside the length bound are pruned before any intersection.

Defined cases: a null text counts as empty; an empty text has the empty set; two empty sets are alike (1.0), an empty and
a non-empty one are not (0.0).  A text without any content word has one signature over its words, one without any word
has one over the whole text.  The chain after the start of the text is a signature too, so short texts have one.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenline.llm.common import written

# Common words of four languages.
ANCHORS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "had", "has", "have", "he", "in", "is", "it", "not",
    "of", "on", "or", "that", "the", "this", "to", "was", "were", "which", "will", "with",
    "au", "aux", "avec", "ce", "dans", "des", "du", "elle", "en", "est", "et", "il", "la", "le", "les", "ou", "par",
    "pas", "pour", "que", "qui", "sur", "un", "une",
    "als", "auf", "aus", "das", "dem", "den", "der", "die", "ein", "eine", "einen", "ist", "mit", "nicht", "sich", "und",
    "von", "zu",
    "al", "como", "con", "de", "del", "el", "ella", "las", "lo", "los", "más", "no", "para", "por", "se", "su", "y",
)
#: Content words in a chain.
CHAIN = 2
#: Documents a window partition of ``with_next`` holds on average, and the most partition bounds that are ever made.
BUCKET_ROWS, MAX_BOUNDS = 512, 65_536
#: A key of a join is hot if more than one in ``HOT`` rows have it.
HOT = 10_000
#: Rows of one partition and signature that meet each other at once.
CELL = 2_000


def _with_words(df: DataFrame, text: str, name: str) -> DataFrame:
    """Adds ``{name}_w`` (all words) and ``{name}_c`` (content words): lower case, letters and digits only."""
    words = F.array_remove(F.split(F.lower(F.col(text)), r"[^\p{L}\p{N}]+"), "")
    df = df.withColumn(f"{name}_w", words)
    return df.withColumn(f"{name}_c", F.filter(F.col(f"{name}_w"), lambda w: ~w.isin(*ANCHORS)))


def _hash32(*parts: Column) -> Column:
    return F.xxhash64(*parts).bitwiseAND(F.lit(0xFFFFFFFF))


def with_signatures(df: DataFrame, text: str, name: str) -> DataFrame:
    """Adds ``name``: the sorted set of 32-bit spot signatures of the column ``text`` as ``array<bigint>``.

    The j-th anchor at word p has p - j content words before it; its chain starts at that place among content words.
    """
    df = _with_words(df, text, name)
    w, c = F.col(f"{name}_w"), F.col(f"{name}_c")
    anchors = F.array_compact(F.transform(w, lambda x, i: F.when(x.isin(*ANCHORS), i)))
    chains = F.transform(
        anchors,
        lambda p, j: F.when(F.get(c, p - j).isNotNull(), _hash32(F.get(w, p), *(F.get(c, p - j + k) for k in range(CHAIN)))),
    )
    first = _hash32(F.lit(""), *(F.get(c, F.lit(k)) for k in range(CHAIN)))
    spots = F.array_sort(F.array_distinct(F.array_append(F.array_compact(chains), first)))
    none = F.array().cast("array<bigint>")
    signatures = (
        F.when(F.size(c) > 0, spots)
        .when(F.size(w) > 0, F.array(_hash32(w)))
        .when(F.col(text) != "", F.array(_hash32(F.col(text))))
        .otherwise(none)
    )
    return df.withColumn(name, signatures).drop(f"{name}_w", f"{name}_c")


def as_string(signatures: Column) -> Column:
    """The fingerprint as text: hexadecimal signatures in ascending order, joined by hyphens."""
    return F.array_join(F.transform(signatures, F.hex), "-")


def jaccard(a: Column, b: Column, least: float = 0.0) -> Column:
    """Jaccard similarity of two signature sets; 0.0 without an intersection where lengths alone rule out ``least``."""
    common = F.size(F.array_intersect(a, b))
    m, n = F.size(a), F.size(b)
    exact = common / (m + n - common)
    return (
        F.when((m == 0) & (n == 0), F.lit(1.0))
        .when((m == 0) | (n == 0) | (F.least(m, n) < least * F.greatest(m, n)), F.lit(0.0))
        .otherwise(exact)
    )


def length_partition(signatures: Column, threshold: float) -> Column:
    """The partition of a set's length: sets with similarity ``threshold`` or more are at most one partition apart."""
    return F.floor(F.log(F.greatest(F.size(signatures), F.lit(1))) / F.lit(-math.log(threshold)) + F.lit(1e-9)).cast("int")


def _looked_up(rows: DataFrame, known: DataFrame, keys: list[str], total: int) -> DataFrame:
    """``rows`` that have their ``keys`` in ``known``, with its columns; ``known`` has one row a key and the number ``n_rows`` with it.

    Keys of more than one in ``HOT`` of the ``total`` rows, so fewer than ``HOT`` keys, are looked up in a broadcast of that
    bound; all other rows meet theirs by key.
    """
    hot = written(known.where(F.col("n_rows") > max(1, total // HOT)), "hot")
    light = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(known, keys)
    return light.unionByName(rows.join(F.broadcast(hot), keys))


def near_duplicates(df: DataFrame, id_col: str, text: str, threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Pairs of different fingerprints with Jaccard similarity ``threshold`` or more, and the members of each.

    Returns ``(pairs, members)``: ``pairs`` has rep_a < rep_b (smallest ids with those fingerprints) and similarity;
    ``members`` has every id with the rep of its fingerprint.  Copies are never expanded into pairs.  Each set sends the
    places of its rarest signatures only (a set of n must share one of its rarest n - ceil(t*n) + 1 with any set that
    alike) to the partition of its length and the next; what meets there is pruned by length and by how many signatures
    can still be common, and only then are the two sets fetched and compared exactly.  A cell of a partition and signature
    with more than ``CELL`` rows is cut into pairs of blocks, so that no task gets all that share a signature.

    Defined cases: rows with a null id are members (their rep is null if no other row has that fingerprint) but never
    reps; the empty set is in no pair; of texts with one id and different fingerprints that are reps both, none are paired.
    """
    base = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    keys = ["k1", "k2"]
    made = with_signatures(base, "t", "s").select("id", "s", F.xxhash64("s").alias("k1"), F.xxhash64(F.lit(1), "s").alias("k2"))
    sets = written(made, "sets")
    reps = written(sets.groupBy(*keys).agg(F.min("id").alias("rep"), F.count("*").alias("n_rows")), "reps")
    members = _looked_up(sets.select("id", *keys), reps, keys, sets.count())
    one = sets.where("id IS NOT NULL AND size(s) > 0").groupBy(*keys).agg(F.min(F.struct("id", "s")).alias("r"))
    nodes = written(one.select(F.monotonically_increasing_id().alias("node"), "r.id", "r.s"), "nodes")

    spread = nodes.select("node", F.explode("s").alias("g"))
    counts = written(spread.groupBy("g").agg(F.count("*").alias("n_rows")), "counts")
    total = counts.agg(F.sum("n_rows")).first()[0] or 0
    ranked = _looked_up(spread, counts, ["g"], total).groupBy("node").agg(F.array_sort(F.collect_list(F.struct("n_rows", "g"))).alias("o"))
    n = F.size("o")
    first = F.slice("o", F.lit(1), n - F.ceil(F.lit(threshold) * n - 1e-9).cast("int") + 1)
    part = length_partition(F.col("o"), threshold)
    sent = written(ranked.select("node", n.alias("n"), part.alias("p"), F.posexplode(first).alias("at", "x")).select("node", "n", "p", "at", "x.g"), "sent")

    left = sent.select(
        F.col("node").alias("a"), F.col("n").alias("na"), F.col("at").alias("ia"), F.col("p").alias("own"), "g", F.explode(F.array("p", F.col("p") + 1)).alias("p")
    )
    right = sent.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("at").alias("ib"), "g", "p")
    cells = written(left.groupBy("p", "g").agg(F.count("*").alias("n_rows")).where("n_rows > 1"), "cells")
    total = 2 * sent.count()
    blocks = F.ceil(F.col("n_rows") / CELL).cast("int")
    every = F.explode(F.sequence(F.lit(0), blocks - 1))
    own = lambda node: F.pmod(F.xxhash64(node), blocks).cast("int")
    left = _looked_up(left, cells, ["p", "g"], total).withColumn("x", own("a")).withColumn("y", every).drop("n_rows")
    right = _looked_up(right, cells, ["p", "g"], total).withColumn("y", own("b")).withColumn("x", every).drop("n_rows")
    both = F.least(F.col("na") - F.col("ia"), F.col("nb") - F.col("ib"))
    met = (
        left.join(right, ["p", "g", "x", "y"])
        .where((F.col("own") < F.col("p")) | (F.col("a") < F.col("b")))
        .where(F.least("na", "nb") >= threshold * F.greatest("na", "nb") - 1e-9)
        .where(both >= threshold / (1 + threshold) * (F.col("na") + F.col("nb")) - 1e-9)
    )
    held = [nodes.select(F.col("node").alias(x), F.col("id").alias(f"id_{x}"), F.col("s").alias(f"s_{x}")) for x in ("a", "b")]
    pairs = met.select("a", "b").distinct().join(held[0], "a").join(held[1], "b").where("id_a <> id_b")
    pairs = pairs.select(
        F.least("id_a", "id_b").alias("rep_a"), F.greatest("id_a", "id_b").alias("rep_b"), jaccard(F.col("s_a"), F.col("s_b"), threshold).alias("similarity")
    )
    return pairs.where(F.col("similarity") >= threshold).distinct(), members.select(F.col("id").alias(id_col), "rep")


def with_next(df: DataFrame, id_col: str, carried: dict[str, str], prepared) -> DataFrame:
    """Each row with columns of the row that has the next smaller ``id_col``; the row with the smallest gets the largest's.

    ``carried`` maps a column to the name of its copy from the next row.  ``prepared`` is applied to the rows after they
    are dealt out by id range and before the window.  Ranges end at ids that are in the table, so a range's first row is
    also sent to the range above, where it stands last: no row waits for a single task.  Null ids come last.
    """
    ids = df.select(F.coalesce(F.col(id_col), F.lit(-(2**63))).cast("long").alias("k"))
    rows, most = ids.agg(F.count("k"), F.max("k")).first()
    parts = max(1, min(MAX_BOUNDS, math.ceil(rows / BUCKET_ROWS)))
    bounds = [most] if most is not None else [0]
    if parts > 1:
        shares = [i / parts for i in range(1, parts)]
        bounds = sorted({*ids.agg(F.percentile_approx("k", shares, max(10_000, 4 * parts))).first()[0], most})
    # the range of an id: how many bounds are smaller, found by halving
    table = F.lit(bounds)
    steps = F.lit([2**i for i in reversed(range(len(bounds).bit_length()))])
    k = F.coalesce(F.col(id_col), F.lit(-(2**63))).cast("long")
    place = F.aggregate(steps, F.lit(0), lambda at, s: F.when((at + s <= len(bounds)) & (F.get(table, at + s - 1) < F.col("_k")), at + s).otherwise(at))
    dealt = df.withColumn("_k", k).withColumn("_place", place)
    guest = F.when(F.col("_k") == F.get(table, F.col("_place")), F.pmod(F.col("_place") + 1, F.lit(len(bounds))))
    dealt = dealt.withColumn("_at", F.explode(F.array_compact(F.array(F.struct(F.col("_place").alias("p"), F.lit(0).alias("guest")), F.when(guest.isNotNull(), F.struct(guest.alias("p"), F.lit(1).alias("guest")))))))
    dealt = dealt.select("*", F.col("_at.p").alias("_range"), F.col("_at.guest").alias("_guest")).drop("_at", "_place")
    dealt = prepared(dealt.repartition(F.col("_range")))
    tie = [F.col(c) for c in carried if dict(df.dtypes).get(c) == "string"]
    w = Window.partitionBy("_range").orderBy("_guest", F.col("_k").desc(), *tie)
    out = dealt.select("*", *(F.lead(c).over(w).alias(name) for c, name in carried.items()))
    return out.where("_guest = 0").drop("_k", "_range", "_guest")
