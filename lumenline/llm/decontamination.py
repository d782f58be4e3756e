"""Benchmark decontamination by SimHash windows and a multi-index of Hamming blocks.

A benchmark item and every window of a document with as many words are compared by the weighted Jaccard similarity of
their five-word shingles (weight: how often a shingle occurs).  A pair with similarity 0.8 shares a shingle, so windows
are made only where a shingle of the benchmark stands: at each such place, all windows of the item's size around it.
They are hashed to 64-bit SimHash fingerprints and looked up in the multi-index of the items with as many words: 64 bits cut
into ``RADIUS + 1`` blocks, so that any two fingerprints within ``RADIUS`` bits agree in at least one block; every item of the
length within the radius is found.  Those found are verified by their exact similarity.  (Each occurrence of a shingle is hashed
as a member of its own, so the weighted similarity is that of two sets and no repeated shingle outweighs the others.  Similarity
0.8 then puts about 9 of 64 bits apart; the radius of 21 is four standard deviations more.  Blocks that short select little among
items of one length, about all of them; the length and the shared shingle are what keeps the candidates few.)

The benchmark is given to the tasks whole where its texts are within ``ITEM_BYTES``, else in as many blocks as that takes,
one scan of the documents each.  Words are runs of letters, digits and underscores in lower case.

Defined cases: null and empty documents have no windows; items without words match nothing; an item under five words is
one shingle of its own length; repeated items and documents are each compared; of the windows of a document that match an
item, the most similar counts, then the first.  ``least_words`` leaves out shorter items, which many texts hold by chance.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHINGLE, SIMILARITY, BITS, RADIUS = 5, 0.8, 64, 21
#: Bytes of benchmark text that are given to a task at a time.
ITEM_BYTES = 16 << 20
WORDS = re.compile(r"\w+")
PRIME = np.uint64(0x9E3779B97F4A7C15)
COLUMNS = "item_id long, start_word long, n_words long, hamming int, similarity double"


def words_of(text: str | None) -> list[str]:
    return WORDS.findall(text.lower()) if text else []


def shingles(words: list[str]) -> list[str]:
    if not words:
        return []
    return [" ".join(words[i : i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))]


def weighted_similarity(a: Counter, b: Counter) -> float:
    both = sum(min(n, b[x]) for x, n in a.items() if x in b)
    whole = sum(a.values()) + sum(b.values()) - both
    return both / whole if whole else 0.0


def _bits(parts: list[str]) -> np.ndarray:
    hashes = np.array([xxhash.xxh64_intdigest(x) for x in parts], dtype=">u8")
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1)


def _pack(majority: np.ndarray) -> np.ndarray:
    return np.packbits(majority, axis=1).view(">u8").ravel().astype(np.uint64)


def _nth(part: str, k: int) -> str:
    """The name of the occurrence of a shingle after ``k`` others; no word holds a line break."""
    return f"{part}\n{k}" if k else part


def numbered(parts: list[str]) -> list[str]:
    """The occurrences of the shingles, each with a name of its own, so that a weight is a number of members of a set."""
    seen: Counter = Counter()
    out = []
    for x in parts:
        out.append(_nth(x, seen[x]))
        seen[x] += 1
    return out


def simhash(parts: list[str]) -> int:
    bits = _bits(numbered(parts))
    return int(_pack((2 * bits.sum(0, dtype=np.int64) > len(parts))[None])[0])


class MultiIndex:
    """Fingerprints by each of ``radius + 1`` blocks of their bits."""

    def __init__(self, prints: np.ndarray, radius: int = RADIUS):
        self.prints, self.radius = prints, radius
        edges = np.linspace(0, BITS, radius + 2).astype(int)
        self.blocks = [(np.uint64(BITS - b), np.uint64((1 << (b - a)) - 1)) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        self.tables: list[dict[int, np.ndarray]] = []
        for shift, mask in self.blocks:
            value = ((prints >> shift) & mask).tolist()
            table: dict[int, list[int]] = {}
            for i, v in enumerate(value):
                table.setdefault(v, []).append(i)
            self.tables.append({v: np.array(x) for v, x in table.items()})

    def within(self, fingerprint: int) -> list[tuple[int, int]]:
        """(place, differing bits) of all fingerprints within the radius."""
        f = np.uint64(fingerprint)
        met = [t[v] for (shift, mask), t in zip(self.blocks, self.tables, strict=True) if (v := int((f >> shift) & mask)) in t]
        if not met:
            return []
        at = np.unique(np.concatenate(met))
        apart = np.bitwise_count(self.prints[at] ^ f)
        near = apart <= self.radius
        return list(zip(at[near].tolist(), apart[near].tolist(), strict=True))


class Benchmark:
    """The items of one block, ready to be looked for."""

    def __init__(self, items: list[tuple[int, str | None]], least_words: int = 1):
        self.ids, self.words = [], []
        for i, t in items:
            if len(w := words_of(t)) >= least_words:
                self.ids.append(i)
                self.words.append(w)
        self.counts = [Counter(shingles(w)) for w in self.words]
        by_size: dict[int, list[int]] = {}
        for n, w in enumerate(self.words):
            by_size.setdefault(len(w), []).append(n)
        #: by length in words: the items and their index
        self.index = {k: (of, MultiIndex(np.array([simhash(shingles(self.words[n])) for n in of], np.uint64))) for k, of in by_size.items()}
        #: pairs of a window and an item that the index was asked about, that it found, and that were similar
        self.asked = self.found = self.similar = 0
        self.vocab: dict[str, int] = {}
        for w in self.words:
            for x in w:
                self.vocab.setdefault(x, len(self.vocab) + 1)
        #: by shingle length: the sorted shingle keys, and for each the items with it
        self.keys: dict[int, tuple[np.ndarray, list[list[int]]]] = {}
        by_length: dict[int, dict[int, set[int]]] = {}
        for n, w in enumerate(self.words):
            size = min(SHINGLE, len(w))
            for k in self.keys_of(np.array([self.vocab[x] for x in w]), size).tolist():
                by_length.setdefault(size, {}).setdefault(k, set()).add(n)
        for size, found in by_length.items():
            order = sorted(found)
            self.keys[size] = (np.array(order, np.uint64), [sorted(found[k]) for k in order])

    @staticmethod
    def keys_of(ids: np.ndarray, size: int) -> np.ndarray:
        """A number for each run of ``size`` word numbers."""
        ids = ids.astype(np.uint64)
        n = len(ids) - size + 1
        out = np.zeros(max(0, n), np.uint64)
        for k in range(size):
            out = (out ^ ids[k : k + len(out)]) * PRIME
            out ^= out >> np.uint64(29)
        return out

    def scan(self, text: str | None) -> list[tuple[int, int, int, int, float]]:
        """(item_id, start_word, n_words, hamming, similarity) of each item that the text has a window of."""
        words = words_of(text)
        get = self.vocab.get
        ids = np.fromiter((get(w, 0) for w in words), np.int64, len(words))
        known = np.r_[0, np.cumsum(ids > 0)]
        windows: dict[int, set[int]] = {}
        for size, (order, items) in self.keys.items():
            if len(words) < size:
                continue
            at = np.nonzero(known[size:] - known[:-size] == size)[0]
            if not len(at):
                continue
            keys = self.keys_of(ids, size)[at]
            place = np.minimum(np.searchsorted(order, keys), len(order) - 1)
            hit = order[place] == keys
            for p, k in zip(at[hit].tolist(), place[hit].tolist(), strict=True):
                for n in items[k]:
                    length = len(self.words[n])
                    first = max(0, p - (length - size))
                    last = min(p, max(0, len(words) - length))
                    windows.setdefault(length, set()).update(range(first, max(first, last) + 1))
        best: dict[int, tuple[float, int, int, int]] = {}
        for length, starts in windows.items():
            of, index = self.index[length]
            for s, f in self._prints(words, length, sorted(starts)):
                part = None
                self.asked += len(of)
                for k, apart in index.within(f):
                    n = of[k]
                    self.found += 1
                    part = part or Counter(shingles(words[s : s + length]))
                    similarity = weighted_similarity(part, self.counts[n])
                    self.similar += similarity >= SIMILARITY
                    if similarity >= SIMILARITY and (n not in best or (-similarity, s) < (-best[n][0], best[n][1])):
                        best[n] = (similarity, s, length, apart)
        return [(self.ids[n], s, length, apart, sim) for n, (sim, s, length, apart) in sorted(best.items())]

    @staticmethod
    def _prints(words: list[str], length: int, starts: list[int]) -> Iterator[tuple[int, int]]:
        """The fingerprint of the window at each start; windows that overlap share their shingles' sums."""
        at = 0
        size = min(SHINGLE, length)
        while at < len(starts):
            to = at + 1
            while to < len(starts) and starts[to] <= starts[to - 1] + length and to - at < 4096:
                to += 1
            low, high = starts[at], starts[to - 1] + length
            span = words[low:high]
            parts = [" ".join(span[i : i + size]) for i in range(max(1, len(span) - size + 1))]
            sums = np.zeros((len(parts) + 1, BITS), np.int32)
            np.cumsum(_bits(parts), axis=0, out=sums[1:])
            first = np.array(starts[at:to]) - low
            last = np.minimum(first + length - size + 1, len(parts))
            n = last - first
            totals = sums[last] - sums[first]
            Benchmark._number_repeats(parts, first.tolist(), last.tolist(), totals)
            prints = _pack(2 * totals > n[:, None])
            yield from zip(starts[at:to], prints.tolist(), strict=True)
            at = to


    @staticmethod
    def _number_repeats(parts: list[str], first: list[int], last: list[int], totals: np.ndarray) -> None:
        """Makes the sums of windows of ``parts`` those of :func:`numbered` ones: only repeats within a window differ."""
        latest: dict[str, int] = {}
        again, before = [], []
        for i, x in enumerate(parts):
            if x in latest:
                again.append(i)
                before.append(latest[x])
            latest[x] = i
        if not again:
            return
        change: dict[tuple[str, int], np.ndarray] = {}
        for j, (a, b) in enumerate(zip(first, last, strict=True)):
            seen: Counter = Counter()
            for q in range(bisect_left(again, a), bisect_left(again, b)):
                if before[q] >= a:
                    x = parts[again[q]]
                    seen[x] += 1
                    key = x, seen[x]
                    if key not in change:
                        new, old = _bits([_nth(*key), x]).astype(np.int32)
                        change[key] = new - old
                    totals[j] += change[key]


def benchmark_blocks(benchmark: DataFrame, item_bytes: int = ITEM_BYTES) -> Iterator[list[tuple[int, str | None]]]:
    """The benchmark's (item_id, text) in blocks of about ``item_bytes`` of text."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // item_bytes))
    for b in range(blocks):
        yield [(r.item_id, r.text) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()]


def find_leaks(docs: DataFrame, id_col: str, text: str, benchmark: DataFrame, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """(``id_col``, item_id, start_word, n_words, hamming, similarity): one row for each document and item it holds."""
    kind = dict(docs.dtypes)[id_col]
    out = None
    for items in benchmark_blocks(benchmark, item_bytes):
        sent = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            looked_for = Benchmark(sent.value)
            for batch in batches:
                ids, found = batch.column(0), []
                places: list[int] = []
                for i, t in enumerate(batch.column(1)):
                    for row in looked_for.scan(t.as_py()) if looked_for.ids else ():
                        places.append(i)
                        found.append(row)
                if found:
                    cols = [pa.array(x, t) for x, t in zip(zip(*found, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.float64()), strict=True)]
                    names = [id_col, "item_id", "start_word", "n_words", "hamming", "similarity"]
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(places)), *cols], names=names)

        part = docs.select(id_col, text).mapInArrow(run, f"`{id_col}` {kind}, {COLUMNS}")
        out = part if out is None else out.union(part)
    return out


def without_leaks(docs: DataFrame, text: str, benchmark: DataFrame, least_words: int = SHINGLE, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """The rows of ``docs`` that hold no window of an item of ``least_words`` words or more, whatever their ids; no shuffle."""
    at = docs.columns.index(text)
    schema = docs.schema
    for items in benchmark_blocks(benchmark, item_bytes):
        sent = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            looked_for = Benchmark(sent.value, least_words)
            for batch in batches:
                clean = [not (looked_for.ids and looked_for.scan(t.as_py())) for t in batch.column(at)]
                yield batch.filter(pa.array(clean, pa.bool_()))

        docs = docs.mapInArrow(run, schema)
    return docs
