"""SimHash near-duplicates by a self-join of binary tries.

Fingerprints within ``RADIUS`` = 3 bits agree in at least one of four blocks of 16 bits.  So each different fingerprint
is sent to four places, one for each block, keyed by the block and its value; there it stands rotated so that this block
is the first 16 levels of a trie.  In each place the trie is joined with itself: pairs of nodes are walked down together,
each differing bit is added up, and a pair is pruned once it has more than 3.  A sorted array is the trie: a node is a
range of it, its children are the two halves of the range by the next bit.  All tries of a partition go down one level at
a time as numpy arrays, in slices of bounded size.  A place with over ``HELD`` fingerprints is cut into node pairs ``DEEPER``
levels further down: each of them goes to the pairs of its own node with any that the error budget still allows, so a block
value that most fingerprints share is many tasks'.

What leaves a place is not each link but a star of each connected part (its members and its smallest), so a group of many
near copies costs as many rows as it has members; node pairs that are already connected are pruned too.  Stars of all
places are then joined into connected components by alternating star contraction, each round written to the shared
folder.  Documents with the same fingerprint are one node all the way; only their smallest id takes part.

Similar documents (``similar_documents``) differ in more bits than that: with a similarity of 0.8 of their five-word
shingles the angle between their shingle vectors is acos(8/9), so each bit differs with probability ``BIT_APART`` = 0.15.
They get fingerprints of ``WIDE`` = 256 bits of their different shingles and meet in as many places as bring two of
similarity 0.8 together with probability ``RECALL``; a place is keyed by bits drawn from the fingerprint by a fixed seed,
more of them the more fingerprints there are.  There the same trie self-join walks the first 64 bits within the error
budget ``NARROW`` (four standard deviations above the mean), and the pairs it leaves are linked within ``WIDE_RADIUS``
of all 256 bits (nearly four above).  Per place only a spanning forest of the links leaves, the closest links first, so a large
group costs as many rows as it has members.  These links only say which documents can be similar at all: the shingle sets
of each part that they join are then compared exactly, and components come from the exactly similar ones alone.

Defined cases: a null text counts as empty; a text without words has fingerprint 0 and is linked like any other; repeated
ids are allowed; a null id takes part with its fingerprint but is never a component's name unless all its ids are null.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenline.llm.common import forget, written

RADIUS, BITS, BLOCK = 3, 64, 16
SEED = 42
#: Node pairs in a slice of the walk, and fingerprints of whole tries joined at a time.
SLICE, AT_ONCE = 1 << 20, 200_000
#: Fingerprints of a place from which on it is cut into pairs of nodes, and the levels of these.
HELD, DEEPER = 200_000, 6
#: Fingerprint pairs compared at a time.
PAIRS = 1 << 21
WIDE, WIDE_RADIUS, WIDE_SURE, NARROW, RECALL, SIMILARITY = 256, 60, 24, 21, 0.985, 0.8
#: Members of a part whose shingle sets one task compares, and members of many links that every piece of a larger part is given.
PIECE, HUBS = 512, 16
#: Share of differing bits at a similarity of 0.8.
BIT_APART = math.acos(2 * SIMILARITY / (1 + SIMILARITY)) / math.pi
#: Steps between the inputs of the mixes that widen a shingle's hash.
_STEPS = np.arange(1, WIDE // 64 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def shingle_hashes(text: str, size: int) -> np.ndarray:
    """XXH64 of each shingle of ``size`` words, repeats included; of the whole sequence where it is shorter."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    digest, n = xxhash.xxh64_intdigest, len(words) - size + 1
    if n < 1:
        return np.array([digest(b" ".join(words), SEED)], np.uint64)
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    starts = np.zeros(len(words), np.int64)
    np.cumsum(lengths[:-1], out=starts[1:])
    ends = (starts + lengths - 1)[size - 1 :]
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends.tolist(), strict=False)], np.uint64)


def fingerprint(text: str | None, size: int = 3) -> int:
    """Bit b is set if it is set in more than half of the shingle hashes."""
    hashes = shingle_hashes(text or "", size)
    if not len(hashes):
        return 0
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 65_536):
        part = hashes[at : at + 65_536].astype(">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def wide_fingerprint(text: str | None, size: int = 5) -> bytes:
    """``WIDE`` bits as bytes: each set if it is set in more than half of the hashes of the different shingles."""
    hashes = np.unique(shingle_hashes(text or "", size))
    counts = np.zeros(WIDE, np.int64)
    for at in range(0, len(hashes), 16_384):
        x = hashes[at : at + 16_384, None] + _STEPS
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        bits = np.unpackbits(x.astype(">u8").view(np.uint8).reshape(len(x), -1), axis=1)
        counts += bits.sum(0, dtype=np.int64)
    return np.packbits(2 * counts > len(hashes)).tobytes()


def with_wide_fingerprint(df: DataFrame, id_col: str, text: str, size: int = 5) -> DataFrame:
    """(``id_col``, ``fp`` binary of ``WIDE`` bits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = pa.array([wide_fingerprint(t.as_py(), size) for t in b.column(1)], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), made], names=[id_col, "fp"])

    kind = dict(df.dtypes)[id_col]
    return df.select(id_col, text).mapInArrow(run, f"`{id_col}` {kind}, fp binary")


def with_fingerprint(df: DataFrame, id_col: str, text: str, size: int = 3) -> DataFrame:
    """(``id_col``, ``fp`` bigint): the fingerprint's 64 bits as a signed number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = np.array([fingerprint(t.as_py(), size) for t in b.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made.view(np.int64))], names=[id_col, "fp"])

    kind = dict(df.dtypes)[id_col]
    return df.select(id_col, text).mapInArrow(run, f"`{id_col}` {kind}, fp long")


def _settle(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the sets of a[i] and b[i]; each label becomes the smallest place in its set."""
    while True:
        low = np.minimum(labels[a], labels[b])
        high = np.maximum(labels[a], labels[b])
        if (low == high).all():
            return
        np.minimum.at(labels, high, low)
        while True:
            up = labels[labels]
            if (up == labels).all():
                break
            labels[:] = up


def _pairs(a: np.ndarray, b: np.ndarray, la: np.ndarray, lb: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All (i, j) of the ranges a[k] + la[k] and b[k] + lb[k] for each k, at most ``PAIRS`` at a time."""
    ends = np.cumsum(la * lb)
    starts = ends - la * lb
    for at in range(0, int(ends[-1]) if len(ends) else 0, PAIRS):
        nth = np.arange(at, min(at + PAIRS, int(ends[-1])))
        row = np.searchsorted(ends, nth, side="right")
        nth -= starts[row]
        yield a[row] + nth // lb[row], b[row] + nth % lb[row]


def trie_links(
    groups: np.ndarray,
    prints: np.ndarray,
    radius: int = RADIUS,
    skip: int = BLOCK,
    distance: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None,
    most: int = 0,
    forest: list | None = None,
) -> np.ndarray:
    """For each fingerprint the smallest place linked to it, directly or by others of its group.

    ``groups`` and ``prints`` (uint64) are sorted together; the first ``skip`` bits of all prints in a group are the
    same.  Where ``distance(i, j)`` is given, only pairs of at most ``most`` are links, and the
    links (i, j, distance) of a spanning forest are added to ``forest``.
    """
    n = len(prints)
    labels = np.arange(n)

    def link(i: np.ndarray, j: np.ndarray, most: int = most) -> None:
        if distance is None:
            return _settle(labels, i, j)
        d = distance(i, j)
        i, j, d = (x[d <= most] for x in (i, j, d))
        while len(i):  # the closest link of each part, then again for the parts that these make
            order = np.lexsort((j, i, d))
            i, j, d = i[order], j[order], d[order]
            ends = np.concatenate((labels[i], labels[j]))
            _, at = np.unique(ends[np.arange(2 * len(i)).reshape(2, -1).T.ravel()], return_index=True)
            at = np.unique(at // 2)
            forest.append((i[at], j[at], d[at]))
            _settle(labels, i[at], j[at])
            apart = labels[i] != labels[j]
            i, j, d = i[apart], j[apart], d[apart]

    if n < 2:
        return labels
    near = np.nonzero((groups[1:] == groups[:-1]) & (np.bitwise_count(prints[1:] ^ prints[:-1]) <= radius))[0]
    if len(near):
        link(near, near + 1, min(most, WIDE_SURE))  # the others wait for closer ones
    first = np.nonzero(np.r_[True, groups[1:] != groups[:-1]])[0]
    last = np.r_[first[1:], n]
    many = last - first > 1
    first, last = first[many], last[many]
    ones: dict[int, np.ndarray] = {}

    def ones_before(depth: int) -> np.ndarray:
        if depth not in ones:
            bit = (prints >> np.uint64(BITS - 1 - depth)) & np.uint64(1)
            ones[depth] = np.r_[0, np.cumsum(bit.astype(np.int64))]
        return ones[depth]

    zero = np.zeros(len(first), np.int8)
    stack = [(skip, first, last, first, last, zero)]
    while stack:
        depth, al, ah, bl, bh, err = stack.pop()
        if len(al) > SLICE:
            for at in range(0, len(al), SLICE):
                stack.append((depth, *(x[at : at + SLICE] for x in (al, ah, bl, bh, err))))
            continue
        # prune what is connected already: both ranges have one label, the same
        changes = np.r_[0, np.cumsum(labels[1:] != labels[:-1])]
        done = (changes[ah - 1] == changes[al]) & (changes[bh - 1] == changes[bl]) & (labels[al] == labels[bl])
        al, ah, bl, bh, err = (x[~done] for x in (al, ah, bl, bh, err))
        if not len(al):
            continue
        small = ((ah - al) * (bh - bl) <= 64) | (depth == BITS)
        if small.any():
            sa, sb, la, lb = al[small], bl[small], (ah - al)[small], (bh - bl)[small]
            for i, j in _pairs(sa, sb, la, lb):
                hit = (i != j) & (labels[i] != labels[j])
                i, j = i[hit], j[hit]
                hit = np.bitwise_count(prints[i] ^ prints[j]) <= radius
                link(i[hit], j[hit])
        al, ah, bl, bh, err = (x[~small] for x in (al, ah, bl, bh, err))
        if not len(al):
            continue
        c = ones_before(depth)
        am, bm = ah - (c[ah] - c[al]), bh - (c[bh] - c[bl])
        own = (al == bl) & (ah == bh)
        parts = [
            (al, am, bl, bm, err),
            (am, ah, bm, bh, err),
            (al, am, bm, bh, err + 1),
            tuple(x[~own] for x in (am, ah, bl, bm, err + 1)),
        ]
        joined = [np.concatenate(x) for x in zip(*parts, strict=True)]
        live = (joined[0] < joined[1]) & (joined[2] < joined[3]) & (joined[4] <= radius)
        stack.append((depth + 1, *(x[live] for x in joined)))
    return labels


def _stars(groups: np.ndarray, prints: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    labels = trie_links(groups, prints)
    low = nodes.copy()
    np.minimum.at(low, labels, nodes)
    to = low[labels]
    away = to != nodes
    return nodes[away], to[away]


def _edges(a: np.ndarray, b: np.ndarray) -> Iterator[pa.RecordBatch]:
    if len(a):
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def _whole_places(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """The columns of about ``AT_ONCE`` rows at a time, cut where the first column, the place, changes."""
    held: list[list[np.ndarray]] = []
    size = 0
    for batch in batches:
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if not len(cols[0]):
            continue
        if size >= AT_ONCE:
            other = np.nonzero(cols[0] != held[-1][0][-1])[0]
            if len(other):
                held.append([c[: other[0]] for c in cols])
                yield [np.concatenate(x) for x in zip(*held, strict=True)]
                held, size = [], 0
                cols = [c[other[0] :] for c in cols]
        held.append(cols)
        size += len(cols[0])
    if held:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def links(prints: DataFrame, held: int = HELD) -> DataFrame:
    """(a, b): stars that connect what the trie self-joins link; ``prints`` has different fp and its node (bigint).

    Places that are cut are counted first: with N fingerprints at most 4 * N / ``held`` of the 4 * 2**16 places there are.
    """
    blocks = F.explode(F.array(*(F.lit(b) for b in range(BITS // BLOCK))))
    at = prints.select("fp", "node", blocks.alias("block"))
    turned = F.expr(f"shiftleft(fp, {BLOCK} * block) | IF(block = 0, 0L, shiftrightunsigned(fp, {BITS} - {BLOCK} * block))")
    at = at.withColumn("turned", turned)
    value = F.expr(f"CAST(shiftrightunsigned(turned, {BITS - BLOCK}) AS INT)")
    at = at.select("turned", "node", (F.col("block") * 2**BLOCK + value).alias("at"))
    large = written(at.groupBy("at").agg(F.count("*").alias("n")).where(F.col("n") > held).select("at"), "large")
    # a whole place has part 0, a pair of nodes (low, high) has one that names both
    wide = 2 * DEEPER + 1
    rows = at.join(F.broadcast(large), "at", "left_anti").select((F.col("at").cast("long") * 2**wide).alias("place"), "turned", "node")
    own = F.expr(f"CAST(shiftrightunsigned(turned, {BITS - BLOCK - DEEPER}) AS INT) & {2**DEEPER - 1}")
    near = F.array(*(F.lit(x) for x in range(2**DEEPER) if x.bit_count() <= RADIUS))
    cut = at.join(F.broadcast(large), "at").withColumn("own", own).withColumn("other", F.explode(F.transform(near, lambda x: x.bitwiseXOR(F.col("own")))))
    pair = F.least("own", "other") * 2**DEEPER + F.greatest("own", "other")
    cut = cut.select((F.col("at").cast("long") * 2**wide + 2 ** (2 * DEEPER) + pair).alias("place"), "turned", "node")
    dealt = rows.union(cut).repartition(F.col("place")).sortWithinPartitions("place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for place, fp, node in _whole_places(batches):
            fp = fp.view(np.uint64)
            order = np.lexsort((fp, place))
            yield from _edges(*_stars(place[order], fp[order], node[order]))

    return dealt.mapInArrow(run, "a long, b long")


def key_draws(n: int) -> np.ndarray:
    """For each place of a fingerprint the bits of its key, when there are ``n`` fingerprints.

    A key has 16 bits, or 4 less than n's logarithm where that is more, so a place of unrelated fingerprints stays small;
    the number of places follows from ``RECALL``.
    """
    bits = max(16, math.ceil(math.log2(max(n, 1) + 1)) - 4)
    tables = math.ceil(math.log(1 - RECALL) / math.log(1 - (1 - BIT_APART) ** bits))
    random = np.random.default_rng(SEED)
    return np.array([random.permutation(WIDE)[:bits] for _ in range(tables)])


def similar_links(nodes: DataFrame, n: int) -> DataFrame:
    """(a, b, bits): each place's forest of links of ``n`` different fingerprints (fp binary of ``WIDE`` bits, node bigint)."""
    draws = key_draws(n)
    powers = np.int64(1) << np.arange(draws.shape[1], dtype=np.int64)
    words = [f"w{k}" for k in range(WIDE // 64)]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                raw = np.frombuffer(b"".join(part.column(0).to_pylist()), np.uint8).reshape(-1, WIDE // 8)
                bits, cols = np.unpackbits(raw, axis=1), raw.view(">u8").astype(np.uint64).view(np.int64)
                place = np.stack([(t << draws.shape[1]) | (bits[:, d] @ powers) for t, d in enumerate(draws)])
                node = part.column(1).to_numpy(zero_copy_only=False)
                sent = [np.tile(x, len(draws)) for x in (node, *cols.T)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (place.ravel(), *sent)], names=["place", "node", *words])

    dealt = nodes.select("fp", "node").mapInArrow(deal, "place long, node long, " + ", ".join(f"{w} long" for w in words))
    dealt = dealt.repartition(F.col("place")).sortWithinPartitions("place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for place, node, *cols in _whole_places(batches):
            prints = np.stack(cols, axis=1).view(np.uint64)
            order = np.lexsort((prints[:, 0], place))
            prints = prints[order]

            def distance(i: np.ndarray, j: np.ndarray, prints=prints) -> np.ndarray:
                return np.bitwise_count(prints[i] ^ prints[j]).sum(1, dtype=np.int32)

            forest: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            trie_links(place[order], prints[:, 0].copy(), NARROW, 0, distance, WIDE_RADIUS, forest)
            if forest:
                i, j, d = (np.concatenate(x) for x in zip(*forest, strict=True))
                node = node[order]
                a, b = np.minimum(node[i], node[j]), np.maximum(node[i], node[j])
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(d)], names=["a", "b", "bits"])

    return dealt.mapInArrow(run, "a long, b long, bits int")


def shingle_sets(df: DataFrame, size: int) -> DataFrame:
    """(node, shingles array<bigint>) of those rows (node, fp, text) whose text has the fingerprint; one row a node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for node, fp, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if wide_fingerprint(text, size) == fp:
                    made = np.unique(shingle_hashes(text or "", size)).view(np.int64)
                    row = pa.ListArray.from_arrays(pa.array([0, len(made)], pa.int32()), pa.array(made))
                    yield pa.RecordBatch.from_arrays([pa.array([node], pa.int64()), row], names=["node", "shingles"])

    return df.select("node", "fp", "text").mapInArrow(run, "node long, shingles array<long>").dropDuplicates(["node"])


def _linked(labels: np.ndarray, sets: list[np.ndarray]) -> Iterator[tuple[int, int]]:
    """Links that join all parts of the given sets: those of one label, and any of a Jaccard similarity of ``SIMILARITY``.

    A search from set to set; each is compared exactly with all that no part holds yet.
    """
    values, ids = np.unique(np.concatenate(sets), return_inverse=True)
    sizes = np.array([len(x) for x in sets])
    left, flat = np.arange(len(sets)), ids
    seen = np.zeros(len(values), bool)
    own = np.split(ids, np.cumsum(sizes)[:-1])
    front: list[int] = []

    def take(out: np.ndarray) -> None:
        nonlocal left, flat
        front.extend(left[out].tolist())
        flat = flat[np.repeat(~out, sizes[left])]
        left = left[~out]

    while len(left):
        if not front:
            take(labels[left] == labels[left[0]])
            continue
        x = front.pop()
        seen[own[x]] = True
        n = sizes[left]
        both = np.add.reduceat(seen[flat], np.cumsum(n) - n, dtype=np.int64)
        seen[own[x]] = False
        hit = both >= SIMILARITY * (n + sizes[x] - both)
        if hit.any():
            yield from ((x, y) for y in left[hit].tolist())
            take(np.isin(labels[left], labels[left[hit]]))


def exact_links(dealt: DataFrame) -> DataFrame:
    """(a, b): links that join the exactly similar of each piece; ``dealt`` has part, piece, node, label and shingles."""
    dealt = dealt.select("part", "piece", "node", "label", "shingles").repartition("part", "piece").sortWithinPartitions("part", "piece")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple[int, int] | None = None
        held: dict[int, tuple[int, np.ndarray]] = {}

        def made() -> Iterator[pa.RecordBatch]:
            nodes = list(held)
            found = list(_linked(np.array([x for x, _ in held.values()]), [x for _, x in held.values()])) if len(held) > 1 else []
            if found:
                i, j = np.array(found).T
                yield from _edges(np.array(nodes)[i], np.array(nodes)[j])

        for batch in batches:
            part, piece, node, label = (batch.column(k).to_pylist() for k in range(4))
            for k, key in enumerate(zip(part, piece, strict=True)):
                if key != now:
                    yield from made()
                    now, held = key, {}
                held.setdefault(node[k], (label[k], batch.column(4)[k].values.to_numpy()))
        yield from made()

    return dealt.mapInArrow(run, "a long, b long")


def similar_parts(sets: DataFrame, forest: DataFrame) -> DataFrame:
    """(node, component) of exactly similar sets; ``sets`` (node, part, shingles) has the parts that ``forest`` joins.

    A part of up to ``PIECE`` members is one task's.  Larger ones are cut into pieces, each compared with itself and
    ``HUBS`` members of many links; what the largest component so found lacks is then compared with all members.
    """
    key = F.xxhash64("node")
    sizes = sets.groupBy("part").agg(F.count("*").alias("n")).where(F.col("n") > PIECE)
    large = written(sizes.select("part", F.ceil(F.col("n") / PIECE).cast("int").alias("pieces")), "large")
    some = large.head(1)
    cut = sets.join(F.broadcast(large), "part", "left") if some else sets.withColumn("pieces", F.lit(None).cast("int"))
    rows = cut.withColumn("piece", F.pmod(key, F.coalesce("pieces", F.lit(1))).cast("long")).withColumn("label", F.col("node"))
    if some:
        degree = forest.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("links"))
        ranked = sets.select("node", "part").join(F.broadcast(large), "part").join(degree, "node")
        best = ranked.groupBy("part", "pieces", F.pmod(key, F.lit(HUBS)).alias("slot")).agg(F.max(F.struct("links", "node")).alias("best"))
        hubs = best.select(F.col("best.node").alias("node"), "pieces").join(sets, "node")
        hubs = hubs.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces").cast("long") - 1))).withColumn("label", F.col("node"))
        rows = rows.unionByName(hubs.select(*rows.columns))
    first = written(exact_links(rows), "exact")
    found = components(first)
    if not some:
        return found
    found = written(found, "found")
    members = sets.select("node", "part").join(F.broadcast(large), "part").join(found, "node", "left")
    members = members.select("node", "part", "pieces", F.coalesce("component", "node").alias("label"))
    count = members.groupBy("part", "pieces", "label").agg(F.count("*").alias("n"))
    rest = count.groupBy("part", "pieces").agg(F.max(F.struct("n", "label")).alias("most"), F.sum("n").alias("all"))
    rest = rest.select("part", "pieces", F.col("most.label").alias("main"), (F.col("all") - F.col("most.n")).alias("n")).where("n > 0")
    rest = written(rest.withColumn("others", F.ceil(F.col("n") / PIECE).cast("long")), "rest")
    if not rest.head(1):
        return found
    held = members.drop("pieces").join(F.broadcast(rest), "part").join(sets.select("node", "shingles"), "node")
    own, pieces = F.pmod(key, F.col("pieces")).cast("long"), F.col("pieces").cast("long")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    others = held.where("label <> main").withColumn("other", F.pmod(key, F.col("others"))).withColumn("piece", every(pieces))
    all_of = held.withColumn("piece", own).withColumn("other", every(F.col("others")))
    # the others first, so that each is compared before the main component is walked
    met = others.unionByName(all_of.select(*others.columns)).withColumn("piece", F.col("piece") * F.col("others") + F.col("other"))
    return components(first.union(exact_links(met)))


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for each node that has an edge (a, b).

    Large-star and small-star rounds: each halves paths, so the rounds grow with the logarithm of the longest one.
    Every round is written to the shared folder; the one before is deleted.
    """
    spark = edges.sparkSession
    now = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links")
    before = None
    while True:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        # large star: larger neighbours of a node go to the smallest of its neighbourhood
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: smaller neighbours and the node itself go to the smallest
        small_low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(small_low, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(small_low.select("a", F.col("m").alias("b")))
        after = written(small.where("a <> b").distinct(), "links")
        same = after.agg(F.count("a"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if before is not None:
            forget(spark, before)
        if same == now.agg(F.count("a"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first():
            return after.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
        before, now = now, after


def near_duplicates(df: DataFrame, id_col: str, text: str, size: int = 3) -> DataFrame:
    """One row for each row of ``df``: ``id_col``, ``fp`` (bigint) and ``component_id``, the smallest id reachable."""
    prints = written(with_fingerprint(df, id_col, text, size), "fingerprints")
    nodes = written(prints.groupBy("fp").agg(F.min(id_col).cast("long").alias("node")), "nodes")
    found = components(links(nodes.where("node is not null")))
    named = nodes.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return prints.join(named, "fp", "left").select(id_col, "fp", "component_id")


def similar_documents(df: DataFrame, id_col: str, text: str, size: int = 5) -> DataFrame:
    """One row for each row of ``df``: ``id_col``, ``fp`` (binary) and ``component_id``, the smallest id reachable.

    Links are Jaccard similarities of ``SIMILARITY`` or more of the sets of shingles of ``size`` words.
    """
    prints = written(with_wide_fingerprint(df, id_col, text, size), "fingerprints")
    nodes = written(prints.groupBy("fp").agg(F.min(id_col).cast("long").alias("node")), "nodes")
    known = nodes.where("node is not null")
    forest = written(similar_links(known, known.count()).select("a", "b").distinct(), "forest")
    parts = components(forest).withColumnRenamed("component", "part")
    parts = written(parts.union(parts.select("part", "part")).distinct(), "parts")
    texts = df.select(F.col(id_col).cast("long").alias("node"), F.col(text).alias("text")).join(known.join(parts, "node"), "node")
    sets = written(shingle_sets(texts, size).where(F.size("shingles") > 0).join(parts, "node"), "sets")
    found = similar_parts(sets, forest)
    named = nodes.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return prints.join(named, "fp", "left").select(id_col, "fp", "component_id")
