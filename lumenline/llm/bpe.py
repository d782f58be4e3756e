"""BPE encoding and decoding with a segment tree over the ranks of adjacent pairs.

A word is a row of symbols.  Leaf i of its tree holds ``rank * leaves + i`` for the pair that starts at symbol i (or
``NONE``); an inner node holds the smaller of its children.  The root is thus the leftmost pair of the lowest rank.  A
merge changes three leaves, each updated along one path to the root, until the root is ``NONE``.  Short words are merged
many at a time, one tree a row of a numpy array; a long word has a tree of its own.

The tokenizer file is read as data; its normalizer (NFC, white space to one space, lower case), its split pattern and its
byte alphabet are applied here.  Encoding works on pieces between white space, as neither the normalizer nor the pattern
joins anything across it; pieces seen lately are remembered in a table of bounded size.

Defined cases: null counts as the empty text, which has no ids and decodes to the empty text.  The strings of special
tokens inside a text become their ids, as the library does by default.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

NONE = np.int64(2**62)
#: Words with more symbols have a tree of their own.
BATCH_LEAVES = 64
#: Pieces in each of the two generations of remembered ones.
MEMORY = 300_000
#: Documents in a batch that leaves the encoder.
OUT_ROWS = 256
#: White space as the tokenizer's own patterns know it.
SPACE = regex.compile(r"\s+")
#: Python's str.split() also splits at these, the pattern doesn't.
OTHER_SPLITS = regex.compile("[\x1c-\x1f]")


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: itself where it is printable, else the next from U+0100 on."""
    own = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, extra = [], 0
    for b in range(256):
        out.append(chr(b) if b in own else chr(256 + extra))
        extra += b not in own
    return out


class PairTree:
    """A segment tree over the adjacent pairs of one word, in plain lists."""

    def __init__(self, symbols: list[int], rank_of: dict[int, tuple[int, int]], base: int):
        self.symbols, self.rank_of, self.base = symbols, rank_of, base
        n = len(symbols)
        self.leaves = 1 << max(0, n - 1).bit_length()
        self.right = [*range(1, n + 1)]
        self.left = [*range(-1, n - 1)]
        none = int(NONE)
        tree = [none] * (2 * self.leaves)
        for i in range(n - 1):
            tree[self.leaves + i] = self.key(i, symbols[i], symbols[i + 1])
        for i in range(self.leaves - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])
        self.tree = tree

    def key(self, at: int, a: int, b: int) -> int:
        found = self.rank_of.get(a * self.base + b)
        return int(NONE) if found is None else found[0] * self.leaves + at

    def put(self, at: int, key: int) -> None:
        tree, i = self.tree, self.leaves + at
        tree[i] = key
        i >>= 1
        while i:
            low = min(tree[2 * i], tree[2 * i + 1])
            if tree[i] == low:
                break
            tree[i] = low
            i >>= 1

    def merged(self) -> list[int]:
        s, n = self.symbols, len(self.symbols)
        none = int(NONE)
        while self.tree[1] < none:
            at = self.tree[1] % self.leaves
            gone = self.right[at]
            s[at] = self.rank_of[s[at] * self.base + s[gone]][1]
            after = self.right[at] = self.right[gone]
            self.put(gone, none)
            self.put(at, self.key(at, s[at], s[after]) if after < n else none)
            if after < n:
                self.left[after] = at
            if (before := self.left[at]) >= 0:
                self.put(before, self.key(before, s[before], s[at]))
        out, at = [], 0
        while at < n:
            out.append(s[at])
            at = self.right[at]
        return out


class Tokenizer:
    """The tokenizer of one vocabulary file, with its encoder and decoder."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.tokens = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        steps = spec["pre_tokenizer"]["pretokenizers"]
        self.words = regex.compile(next(x["pattern"]["Regex"] for x in steps if x["type"] == "Split")).findall
        self.base = 1 << 20
        self.rank_of: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.rank_of.setdefault(self.vocab[a] * self.base + self.vocab[b], (rank, self.vocab[a + b]))
        self.pairs = np.array(sorted(self.rank_of), dtype=np.int64)
        self.ranks = np.array([self.rank_of[p][0] for p in self.pairs.tolist()], dtype=np.int64)
        self.results = np.array([self.rank_of[p][1] for p in self.pairs.tolist()], dtype=np.int64)
        alphabet = byte_alphabet()
        self.of_byte = np.array([self.vocab[c] for c in alphabet], dtype=np.int64)
        self.of_last = np.array([self.vocab[c + self.suffix] for c in alphabet], dtype=np.int64)
        self.markers = regex.compile("(" + "|".join(regex.escape(x) for x in self.special) + ")") if self.special else None
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    # --- merging -------------------------------------------------------------------------------------------------

    def look_up(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The place of each pair in the table of pairs, or -1."""
        want = a * self.base + b
        at = np.minimum(np.searchsorted(self.pairs, want), len(self.pairs) - 1)
        return np.where(self.pairs[at] == want, at, -1)

    def merge(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word, as little-endian int32 bytes."""
        out: list[bytes] = [b""] * len(words)
        sized: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            n = len(w)
            if n > BATCH_LEAVES:
                symbols = self.of_byte[np.frombuffer(w, np.uint8)].tolist()
                symbols[-1] = int(self.of_last[w[-1]])
                out[i] = np.array(PairTree(symbols, self.rank_of, self.base).merged(), dtype="<i4").tobytes()
            elif n:
                sized.setdefault(max(2, 1 << (n - 1).bit_length()), []).append(i)
        for leaves, at in sized.items():
            for i, ids in zip(at, self._merge_rows([words[i] for i in at], leaves), strict=True):
                out[i] = ids
        return out

    def _merge_rows(self, words: list[bytes], leaves: int) -> list[bytes]:
        rows = len(words)
        length = np.array([len(w) for w in words])
        raw = np.frombuffer(b"".join(w.ljust(leaves, b"\0") for w in words), np.uint8).reshape(rows, leaves)
        sym = self.of_byte[raw]
        every = np.arange(rows)
        sym[every, length - 1] = self.of_last[raw[every, length - 1]]
        place = np.arange(leaves)
        right = np.broadcast_to(place + 1, (rows, leaves)).copy()
        left = np.broadcast_to(place - 1, (rows, leaves)).copy()
        tree = np.full((rows, 2 * leaves), NONE)
        inside = place[: leaves - 1] < (length - 1)[:, None]
        r, c = np.nonzero(inside)
        found = self.look_up(sym[r, c], sym[r, c + 1])
        ok = found >= 0
        tree[r[ok], leaves + c[ok]] = self.ranks[found[ok]] * leaves + c[ok]
        level = leaves
        while level > 1:
            half = level // 2
            tree[:, half:level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level = half

        def put(rows_: np.ndarray, at: np.ndarray, keys: np.ndarray) -> None:
            i = leaves + at
            tree[rows_, i] = keys
            i = i >> 1
            for _ in range(leaves.bit_length() - 1):
                tree[rows_, i] = np.minimum(tree[rows_, 2 * i], tree[rows_, 2 * i + 1])
                i = i >> 1

        def keys(rows_: np.ndarray, at: np.ndarray, after: np.ndarray) -> np.ndarray:
            found = self.look_up(sym[rows_, at], sym[rows_, after])
            return np.where(found >= 0, self.ranks[found] * leaves + at, NONE)

        live = np.nonzero(tree[:, 1] < NONE)[0]
        while len(live):
            at = tree[live, 1] % leaves
            gone = right[live, at]
            found = self.look_up(sym[live, at], sym[live, gone])
            sym[live, at] = self.results[found]
            after = right[live, gone]
            right[live, at] = after
            put(live, gone, np.full(len(live), NONE))
            has = after < length[live]
            left[live[has], after[has]] = at[has]
            fresh = np.full(len(live), NONE)
            fresh[has] = keys(live[has], at[has], after[has])
            put(live, at, fresh)
            before = left[live, at]
            has = before >= 0
            put(live[has], before[has], keys(live[has], before[has], at[has]))
            live = live[tree[live, 1] < NONE]
        kept = np.zeros((rows, leaves), bool)
        kept[:, 0] = True
        r = every
        at = np.zeros(rows, int)
        while len(r):
            at = right[r, at]
            going = at < length[r]
            r, at = r[going], at[going]
            kept[r, at] = True
        flat = sym[kept].astype("<i4").tobytes()
        ends = (4 * np.cumsum(kept.sum(1))).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    # --- encoding ------------------------------------------------------------------------------------------------

    def _pieces_to_ids(self, pieces: Iterable[str]) -> dict[str, bytes]:
        split, words = [], {}
        for p in pieces:
            norm = unicodedata.normalize("NFC", p)
            norm = "".join(c.lower() for c in norm) if "Σ" in norm else norm.lower()
            found = [w.encode() for w in self.words(norm)]
            split.append((p, found))
            for w in found:
                words.setdefault(w, b"")
        for w, ids in zip(words, self.merge(list(words)), strict=True):
            words[w] = ids
        return {p: b"".join([words[w] for w in found]) for p, found in split}

    def _remember(self, pieces: list[str]) -> dict[str, bytes]:
        """The ids of each different piece, from memory or made now."""
        different = set(pieces)
        known: dict[str, bytes] = {}
        missing = []
        for p in different:
            ids = self.young.get(p)
            if ids is None:
                ids = self.old.get(p)
                if ids is None:
                    missing.append(p)
                    continue
                self.young[p] = ids
            known[p] = ids
        for at in range(0, len(missing), 50_000):
            made = self._pieces_to_ids(missing[at : at + 50_000])
            known |= made
            self.young |= {p: x for p, x in made.items() if len(p) <= 64}
            if len(self.young) > MEMORY:
                self.old, self.young = self.young, {}
        return known

    def _parts(self, text: str) -> list[list[str] | int]:
        """Pieces between white space, and the ids of special tokens, in order."""
        parts = self.markers.split(text) if self.markers and any(x in text for x in self.special) else [text]
        out: list[list[str] | int] = []
        for i, p in enumerate(parts):
            if i % 2:
                out.append(self.special[p])
            elif p:
                out.append([x for x in SPACE.split(p) if x] if OTHER_SPLITS.search(p) else p.split())
        return out

    def encode_batch(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text, as int32 arrays."""
        parts = [self._parts(t) if t else [] for t in texts]
        every: list[str] = []
        for doc in parts:
            for p in doc:
                if not isinstance(p, int):
                    every.extend(p)
        ids_of = self._remember(every)
        out = []
        for doc in parts:
            raw = [np.int32(p).tobytes() if isinstance(p, int) else b"".join([ids_of[x] for x in p]) for p in doc]
            out.append(np.frombuffer(b"".join(raw), dtype="<i4"))
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text that ids stand for: this vocabulary has no decoder, so its tokens joined by spaces."""
        tokens = self.tokens
        return " ".join([tokens[i] for i in ids.tolist()])


_LOADED: dict[str, Tokenizer] = {}


def loaded(path: str) -> Tokenizer:
    """One tokenizer a worker process."""
    if path not in _LOADED:
        _LOADED[path] = Tokenizer(path)
    return _LOADED[path]


def version_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def encode(df: DataFrame, text: str, path: str) -> DataFrame:
    """``df`` with ``ids array<int>`` and ``decoded string`` of the column ``text``; its other columns are kept.

    Columns of ``df`` named ids or decoded give way to the new ones.
    """
    kept = [c for c in df.columns if c not in ("ids", "decoded")]
    base = df.select(*kept)
    place = kept.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = loaded(path)
        for whole in batches:
            for at in range(0, whole.num_rows, OUT_ROWS):
                batch = whole.slice(at, OUT_ROWS)
                ids = tok.encode_batch(batch.column(place).to_pylist())
                ends = np.zeros(len(ids) + 1, np.int32)
                np.cumsum([len(x) for x in ids], out=ends[1:])
                flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.astype(np.int32)))
                decoded = pa.array([tok.decode(x) for x in ids], pa.string())
                yield pa.RecordBatch.from_arrays([*batch.columns, lists, decoded], names=[*kept, "ids", "decoded"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields)
    return base.mapInArrow(run, f"{schema}, ids array<int>, decoded string")
