"""LM scoring with a gated recurrent network written in numpy.

Tokens are runs of anything but ASCII white space, with A-Z in lower case, and one end token a document.  The model
predicts symbols: the ``SYMBOLS`` most frequent tokens, the end token, and a few buckets for all other tokens, by their
length, script and last character.  The output softmax is factored into classes of symbols of similar frequency: the
probability of a symbol is that of its class times that within its class.  A token of a bucket has the bucket's probability
times ``(c + 0.5) / (N_b + 0.5 * (V_b + 1))``, by its training count and the bucket's totals.

Counts cover all documents: every task counts its tokens, counts meet by token.  Training is truncated backpropagation
through windows of ``WINDOW`` steps with the state carried from window to window.  The training documents are dealt by a hash
of their ids into ``ROUNDS`` rounds and, within a round, into groups of about ``GROUP`` tokens, so neither depends on how the
table lies in files.  A group's documents are one stream, cut into ``LANES`` lanes of equal length, so every update has the
same number of tokens, whatever the documents' lengths.  Groups start from the round's weights, and what they come to is
averaged by their tokens, level by level; the next round goes on from there.  Up to the order in which float32 sums are taken
(about 1e-4 of a score) the result does not depend on the number of files or tasks.  Texts are read twice, for the counts and
to write the documents' symbols as a table, from which training and scoring go on; both passes split and look up whole
batches of texts at once.  Scoring carries the state through the whole document.  Counts of frequent tokens go to
the tasks as a table of at most ``FREQUENT`` rows; all other tokens are joined with the counts by the token itself.

Defined cases: null counts as the empty text, which is its end token; equal texts have equal scores; rows with the same id
are scored one by one; a null id is not held out; with no training documents at all every count is 0 and the untrained model
scores.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenline.llm.common import forget, written

SYMBOLS, FREQUENT, BUCKETS = 4000, 200_000, 8
EMBED, HIDDEN, CLASS = 16, 16, 64
WINDOW, LANES, ROUNDS = 16, 128, 4
#: Training tokens of a group, and the most groups of a round; groups of a larger corpus hold more.
GROUP, MOST_GROUPS = 1_000_000, 1 << 16
#: Lanes of scoring, where their number has no say in the result.
SCORED = 1024
#: Rows of the softmax taken at a time.
BLOCK = 2048
#: Tokens whose symbols a task holds at a time, tokens it counts before it hands them on, and bytes of text that it splits at a time.
CHUNK, COUNTED, SPLIT = 3_000_000, 4_000_000, 16 << 20
RATE = 0.01
#: The end symbol, and the end's name among counted tokens, which no token can have.
END, END_TOKEN = 0, " "
#: Symbols in tables: their number is under 65,536.
SYMBOL = np.dtype("<u2")
LOG10 = np.log(10.0)


def split_texts(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.Array, np.ndarray]]:
    """(first row, tokens, how many each row has) of about ``SPLIT`` bytes of the texts (column 1) at a time."""
    texts = pc.fill_null(batch.column(1), "")
    sizes = np.cumsum(pc.binary_length(texts).to_numpy().astype(np.int64))
    at = 0
    while at < len(texts):
        before = int(sizes[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(sizes, before + SPLIT, side="right")))
        lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.ascii_lower(texts.slice(at, to - at))))
        ends = lists.offsets.to_numpy()
        words = lists.flatten()
        counts, real = np.diff(ends), pc.binary_length(words).to_numpy(zero_copy_only=False) > 0
        if not real.all():  # a text of white space only makes an empty one
            counts = np.diff(np.r_[0, np.cumsum(real)][ends - ends[0]])
            words = words.filter(pa.array(real))
        yield at, words, counts
        at = to


def is_held_out(doc_id: object) -> bool:
    return doc_id is not None and crc32(str(doc_id).encode()) % 5 == 1


def buckets_of(tokens: pa.Array) -> np.ndarray:
    """The bucket of each token (none is empty): by length, script and last character."""
    if not len(tokens):
        return np.zeros(0, np.int64)
    sizes = pc.binary_length(tokens).to_numpy(zero_copy_only=False)
    ends = np.frombuffer(tokens.buffers()[1], np.int32)[tokens.offset + 1 : tokens.offset + len(tokens) + 1]
    last = np.frombuffer(tokens.buffers()[2], np.uint8)[ends - 1]
    stop = (last < 128) & ~(((48 <= last) & (last < 58)) | ((97 <= last) & (last < 123)))
    other = pc.utf8_length(tokens).to_numpy(zero_copy_only=False) != sizes
    return (4 * stop + 2 * other + (sizes > 8)).astype(np.int64)


# --- counting ----------------------------------------------------------------------------------------------------


def count_tokens(docs: DataFrame) -> DataFrame:
    """(token, c, a, bucket): how often each token stands in training documents and in all; ``docs``: (id, text)."""
    names = ["token", "c", "a", "bucket"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        size = 0

        def counted(words: pa.Array, c: np.ndarray, a: np.ndarray) -> None:
            held.append(pa.table([words, pa.array(c, pa.int64()), pa.array(a, pa.int64())], names=names[:3]))

        def out() -> Iterator[pa.RecordBatch]:
            if held:
                found = pa.concat_tables(held).group_by("token").aggregate([("c", "sum"), ("a", "sum")]).combine_chunks()
                words = found["token"].combine_chunks()
                words = words if isinstance(words, pa.Array) else pa.concat_arrays(words.chunks)
                sums = [found[c].combine_chunks() for c in ("c_sum", "a_sum")]
                yield from pa.table([words, *sums, pa.array(buckets_of(words).astype(np.int32))], names=names).to_batches()
                held.clear()

        for batch in batches:
            back = np.array([is_held_out(i) for i in batch.column(0).to_pylist()], bool)
            for at, words, counts in split_texts(batch):
                here = back[at : at + len(counts)]
                told = words.dictionary_encode()
                which = told.indices.to_numpy()
                different = len(told.dictionary)
                counted(told.dictionary, np.bincount(which[~np.repeat(here, counts)], minlength=different), np.bincount(which, minlength=different))
                counted(pa.array([END_TOKEN], pa.string()), [int((~here).sum())], [len(here)])
                size += len(words) + len(counts)
                if size >= COUNTED:
                    yield from out()
                    size = 0
        yield from out()

    made = docs.mapInArrow(run, "token string, c long, a long, bucket int")
    return made.groupBy("token").agg(F.sum("c").alias("c"), F.sum("a").alias("a"), F.first("bucket").alias("bucket"))


# --- the network -------------------------------------------------------------------------------------------------


class Network:
    """Weights by name in one flat float32 array, forward and backward passes, Adam.

    The last row of ``wc`` and of each ``wo[c]`` is the bias.  The gates are reset, update and new, in this order.
    """

    def __init__(self, symbols: int, flat: np.ndarray | None = None, logits: np.ndarray | None = None):
        self.symbols = symbols
        self.classes = -(-symbols // CLASS)
        shapes = {
            "embed": (symbols, EMBED), "wx": (EMBED, 3 * HIDDEN), "wh": (HIDDEN, 3 * HIDDEN), "b": (3 * HIDDEN,),
            "wc": (HIDDEN + 1, self.classes), "wo": (self.classes, HIDDEN + 1, CLASS),
        }
        size = sum(int(np.prod(s)) for s in shapes.values())
        self.flat = np.zeros(size, np.float32) if flat is None else np.array(flat, np.float32)
        self.grad = np.zeros(size, np.float32)
        self.w: dict[str, np.ndarray] = {}
        self.g: dict[str, np.ndarray] = {}
        at = 0
        for name, shape in shapes.items():
            n = int(np.prod(shape))
            self.w[name], self.g[name] = self.flat[at : at + n].reshape(shape), self.grad[at : at + n].reshape(shape)
            at += n
        if flat is None:
            rng = np.random.default_rng(1)
            for name in ("embed", "wx", "wh", "wc", "wo"):
                self.w[name][...] = rng.normal(0, 0.1, self.w[name].shape)
            self.w["wc"][HIDDEN], self.w["wo"][:, HIDDEN] = 0, 0
            if logits is not None:
                padded = np.full(self.classes * CLASS, -30.0)
                padded[:symbols] = logits
                by_class = padded.reshape(self.classes, CLASS)
                top = by_class.max(1)
                self.w["wc"][HIDDEN] = top + np.log(np.exp(by_class - top[:, None]).sum(1))
                self.w["wo"][:, HIDDEN] = by_class
        # symbols that only fill the last class up
        self.w["wo"][-1, HIDDEN, symbols - (self.classes - 1) * CLASS :] = -30.0
        self.m, self.v, self.steps = np.zeros(size, np.float32), np.zeros(size, np.float32), 0
        self.part = np.empty(size, np.float32)

    def states(self, x: np.ndarray, start: np.ndarray, h: np.ndarray, keep: bool = False) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
        """States after each step of a window: x (T, k) symbols, start (T, k) whether a document starts.

        The gates' sums are halved for the sigmoids, which are taken by tanh.  Inside, units come before lanes, so that the
        gates of a step are one product and each gate is a piece of it without gaps.  With ``keep`` also what backpropagation
        needs, each (T, units, k): the inputs' embeddings, the state before, its part in the new gate, the reset, update and
        new gates.
        """
        steps, k = x.shape
        half = np.repeat(np.array([0.5, 0.5, 1.0], np.float32), HIDDEN)[:, None]
        wh = self.w["wh"].T * half
        inputs = self.w["embed"].take(x, axis=0).transpose(0, 2, 1)
        gx = np.matmul(self.w["wx"].T * half, inputs)
        gx += self.w["b"][:, None] * half
        out = np.empty((steps, HIDDEN, k), np.float32)
        held = steps if keep else 1
        befores = np.empty_like(out) if keep else None
        gh = np.empty((held, 3 * HIDDEN, k), np.float32)
        rz = np.empty((held, 2 * HIDDEN, k), np.float32)
        new = np.empty((held, HIDDEN, k), np.float32)
        going, any_start = (~start).astype(np.float32), start.any(1).tolist()
        h = np.ascontiguousarray(h.T)
        for t in range(steps):
            at = t if keep else 0
            before = h * going[t] if any_start[t] else h
            g, gates, n = gh[at], rz[at], new[at]
            np.matmul(wh, before, out=g)
            np.add(gx[t, : 2 * HIDDEN], g[: 2 * HIDDEN], out=gates)
            np.tanh(gates, out=gates)
            gates *= np.float32(0.5)
            gates += np.float32(0.5)
            np.multiply(gates[:HIDDEN], g[2 * HIDDEN :], out=n)
            n += gx[t, 2 * HIDDEN :]
            np.tanh(n, out=n)
            h = out[t]
            np.subtract(before, n, out=h)
            h *= gates[HIDDEN:]
            h += n
            if befores is not None:
                befores[t] = before
        kept = (inputs, befores, gh[:, 2 * HIDDEN :], rz[:, :HIDDEN], rz[:, HIDDEN:], new) if keep else ()
        return out.transpose(0, 2, 1), kept

    def log_probs(self, hs: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Natural log of the probability of each symbol y (n,) after each state hs (n, HIDDEN).

        With ``weight`` (n,) also the gradient of the weighted negative sum by hs; the weights' own are added to ``grad``.
        Rows are sorted by class, so that the products within classes are of runs of rows, and taken ``BLOCK`` at a time.
        """
        wc, wo, g = self.w["wc"], self.w["wo"], self.g
        cls = y // CLASS
        order = np.argsort(cls.astype(np.min_scalar_type(self.classes)), kind="stable")
        ends = np.searchsorted(cls[order], np.arange(self.classes + 1)).tolist()
        cls, place = cls[order], (y % CLASS)[order]
        h = np.ones((len(y), HIDDEN + 1), np.float32)
        h[:, :HIDDEN] = hs.take(order, axis=0)
        weight = None if weight is None else weight[order]
        lp = np.empty(len(y), np.float32)
        dh = None if weight is None else np.empty((len(y), HIDDEN), np.float32)
        # while no logit can leave the range of exp, no row needs its largest one taken off
        reach = max(1.0, float(np.abs(hs).max(initial=0))) * max(float(np.abs(wc).sum(0).max()), float(np.abs(wo).sum(1).max()))
        within = np.empty((min(BLOCK, len(y)), CLASS), np.float32)
        back = np.empty((len(within), HIDDEN), np.float32)
        within_back = wo[:, :HIDDEN].transpose(0, 2, 1)

        def softmax(e: np.ndarray, chosen: np.ndarray, rows: slice) -> tuple[np.ndarray, np.ndarray | None]:
            """The log probability of the chosen; e turns from logits into exps.

            With weights, into the gradient but for a factor of each row, which is given too.
            """
            at = np.arange(len(e)) * e.shape[1] + chosen
            if reach > 80:
                e -= e.max(1, keepdims=True)
            flat = e.reshape(-1)
            picked = flat.take(at)
            np.exp(e, out=e)
            total = e @ np.ones(e.shape[1], np.float32)
            if weight is None:
                return picked - np.log(total), None
            flat[at] -= total
            return picked - np.log(total), (weight[rows] / total)[:, None]

        whole = len(y) <= BLOCK  # then each class has one run of rows, and its gradient is written once
        for at in range(0, len(y), BLOCK):
            rows = slice(at, min(at + BLOCK, len(y)))
            hb, size = h[rows], rows.stop - at
            e = hb @ wc
            got, factor = softmax(e, cls[rows], rows)
            if factor is not None:
                g["wc"] += (hb * factor).T @ e
                np.multiply(e @ wc[:HIDDEN].T, factor, out=dh[rows])
            e = within[:size]
            first, last = int(cls[at]), int(cls[rows.stop - 1])
            spans = [(c, max(ends[c], at) - at, min(ends[c + 1], rows.stop) - at) for c in range(first, last + 1) if ends[c] < ends[c + 1]]
            for c, begin, end in spans:
                np.dot(hb[begin:end], wo[c], out=e[begin:end])
            more, factor = softmax(e, place[rows], rows)
            np.add(got, more, out=lp[rows])
            if factor is not None:
                scaled = hb * factor
                for c, begin, end in spans:
                    if whole:
                        np.dot(scaled[begin:end].T, e[begin:end], out=g["wo"][c])
                    else:
                        g["wo"][c] += scaled[begin:end].T @ e[begin:end]
                    np.dot(e[begin:end], within_back[c], out=back[begin:end])
                back[:size] *= factor
                dh[rows] += back[:size]
        place_of = np.empty_like(order)
        place_of[order] = np.arange(len(order))
        return lp.take(place_of), None if dh is None else dh.take(place_of, axis=0)

    def learn(self, x: np.ndarray, y: np.ndarray, start: np.ndarray, valid: np.ndarray, h: np.ndarray) -> np.ndarray:
        """One step of truncated backpropagation; returns the state to carry on."""
        hs, (inputs, before, in_new, r, z, n) = self.states(x, start, h, keep=True)
        steps, k = x.shape
        self.grad[:] = 0
        weight = (valid / max(1, valid.sum())).astype(np.float32).ravel()
        _, dh = self.log_probs(hs.reshape(-1, HIDDEN), y.ravel(), weight)
        dh = np.ascontiguousarray(dh.reshape(steps, k, HIDDEN).transpose(0, 2, 1))
        # what each step's gradient is multiplied with, for all steps at once: for the state's part in the new gate, the
        # sums of the reset and update gates, and the new gate; the state is in the first three, the inputs in the last three
        d = np.empty((steps, 4, HIDDEN, k), np.float32)
        np.multiply(1 - z, 1 - n * n, out=d[:, 3])
        np.multiply(d[:, 3], r, out=d[:, 0])
        np.multiply(d[:, 0], in_new * (1 - r), out=d[:, 1])
        np.multiply(before - n, z * (1 - z), out=d[:, 2])
        back, more = np.zeros((HIDDEN, k), np.float32), np.empty((HIDDEN, k), np.float32)
        wh = np.roll(self.w["wh"], HIDDEN, axis=1)
        going, any_start = (~start).astype(np.float32), start.any(1).tolist()
        by_state, by_input = d.reshape(steps, 4 * HIDDEN, k)[:, : 3 * HIDDEN], d.reshape(steps, 4 * HIDDEN, k)[:, HIDDEN:]
        for t in range(steps - 1, -1, -1):
            back += dh[t]
            d[t] *= back
            back *= z[t]
            np.matmul(wh, by_state[t], out=more)
            back += more
            if any_start[t]:
                back *= going[t]
        self.g["wh"] += np.roll(np.matmul(before, by_state.transpose(0, 2, 1)).sum(0), -HIDDEN, axis=1)
        by_input = by_input.transpose(0, 2, 1)
        self.g["wx"] += np.matmul(inputs, by_input).sum(0)
        self.g["b"] += by_input.sum((0, 1))
        dx = np.matmul(by_input, self.w["wx"].T).reshape(-1)
        places = (x.reshape(-1, 1) * EMBED + np.arange(EMBED)).ravel()
        self.g["embed"] += np.bincount(places, dx, self.g["embed"].size).reshape(-1, EMBED)
        norm = math.sqrt(float(self.grad @ self.grad))
        self.steps += 1
        part = self.part
        np.multiply(self.grad, np.float32(0.1 / max(1.0, norm)), out=part)
        self.m *= np.float32(0.9)
        self.m += part
        part *= part
        self.v *= np.float32(0.99)
        self.v += part
        scale = RATE / (1 + self.steps / 2000) * np.sqrt(1 - 0.99**self.steps) / (1 - 0.9**self.steps)
        np.sqrt(self.v, out=part)
        part += np.float32(1e-8)
        np.divide(self.m, part, out=part)
        part *= np.float32(scale)
        self.flat -= part
        return hs[-1]


class Lanes:
    """Documents packed into lanes that are read side by side, longest lane first; no document is cut."""

    def __init__(self, docs: list[np.ndarray], most: int = LANES):
        sizes = np.array([len(d) for d in docs])
        heap = [(0, lane) for lane in range(min(most, len(docs)))]
        lanes: list[list[int]] = [[] for _ in heap]
        for i in np.argsort(-sizes, kind="stable").tolist():
            load, lane = heapq.heappop(heap)
            lanes[lane].append(i)
            heapq.heappush(heap, (load + int(sizes[i]), lane))
        lanes.sort(key=lambda x: -int(sizes[x].sum()))
        order = [i for lane in lanes for i in lane]
        self.length = np.array([int(sizes[x].sum()) for x in lanes])
        self.offset = np.r_[0, np.cumsum(self.length)[:-1]]
        self.y = np.concatenate([docs[i] for i in order]).astype(np.int32)
        self.doc = np.repeat(order, sizes[order])
        self.first = np.r_[True, self.doc[1:] != self.doc[:-1]]
        self.x = np.where(self.first, END, np.r_[END, self.y[:-1]])

    def windows(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(places, valid), each (WINDOW, lanes still going)."""
        for at in range(0, int(self.length[0]), WINDOW):
            k = int((self.length > at).sum())
            step = at + np.arange(WINDOW)[:, None]
            valid = step < self.length[:k]
            yield np.where(valid, self.offset[:k] + step, 0), valid


def train_on(net: Network, docs: list[np.ndarray]) -> int:
    """Trains on the documents as one stream in up to ``LANES`` lanes of equal length; returns the number of symbols.

    A document that is cut at the end of a lane goes on in the next lane from the zero state.
    """
    y = np.concatenate(docs).astype(np.intp)
    n = len(y)
    first = np.zeros(n, bool)
    first[np.r_[0, np.cumsum([len(d) for d in docs])[:-1]]] = True
    x = np.where(first, END, np.r_[END, y[:-1]])
    lanes = max(1, min(LANES, n // (4 * WINDOW)))
    steps = -(-n // (lanes * WINDOW)) * WINDOW
    x, y, first, valid = (
        np.concatenate([a, np.full(steps * lanes - n, rest, a.dtype)]).reshape(lanes, steps).T
        for a, rest in ((x, END), (y, END), (first, True), (np.ones(n, bool), False))
    )
    h = np.zeros((lanes, HIDDEN), np.float32)
    for at in range(0, steps, WINDOW):
        rows = slice(at, at + WINDOW)
        h = net.learn(x[rows], y[rows], first[rows], valid[rows], h)
    return n


def score(net: Network, docs: list[np.ndarray]) -> np.ndarray:
    """log10 of the probability of each document's symbols; the state is carried through the whole document."""
    lanes = Lanes(docs, SCORED)
    h = np.zeros((len(lanes.length), HIDDEN), np.float32)
    out = np.zeros(len(docs))
    for places, valid in lanes.windows():
        hs, _ = net.states(lanes.x[places], lanes.first[places], h[: places.shape[1]])
        h = hs[-1]
        at = places[valid]
        lp, _ = net.log_probs(hs[valid], lanes.y[at])
        out += np.bincount(lanes.doc[at], lp.astype(np.float64), len(docs))
    return out / LOG10


# --- the operator ------------------------------------------------------------------------------------------------


class Table:
    """The frequent tokens with their counts, the symbols, and the totals that the probabilities are taken from."""

    def __init__(self, rows: list[tuple[str, int, int, int]], total: int, different: int, buckets: dict[int, tuple[int, int]]):
        self.total, self.different = total, different
        self.words = pa.array([r[0] for r in rows], pa.string())
        self.c = np.array([r[1] for r in rows], np.int64)
        bucket = np.array([r[3] for r in rows], np.int64)
        top = np.arange(len(rows)) < SYMBOLS
        self.symbols = 1 + BUCKETS + int(top.sum())
        #: symbols in order of frequency, so that classes hold symbols alike in that
        own = [(int(n), 1 + BUCKETS + i) for i, n in enumerate(self.c[top])]
        sums = [(buckets.get(b, (0, 0))[0], 1 + b) for b in range(BUCKETS)]
        order = sorted([(total, END), *sums, *own], key=lambda x: (-x[0], x[1]))
        self.renamed = np.zeros(self.symbols, np.int64)
        self.renamed[[s for _, s in order[1:] if s != END]] = np.arange(1, self.symbols)
        raw = np.where(top, 1 + BUCKETS + np.arange(len(rows)), 1 + bucket)
        self.symbol = self.renamed[raw] if len(rows) else raw
        self.bucket_symbol = self.renamed[1 : 1 + BUCKETS]
        counts = np.zeros(self.symbols)
        for n, s in [*own, *sums]:
            counts[self.renamed[s]] = n
        self.counts = counts
        self.base = np.log10((self.c + 0.5) / (total + 0.5 * (different + 1)))
        n_b = np.array([buckets.get(b, (0, 0)) for b in range(BUCKETS)], float).reshape(BUCKETS, 2)
        self.in_bucket = np.where(top, 0.0, np.log10((self.c + 0.5) / (n_b[bucket, 0] + 0.5 * (n_b[bucket, 1] + 1)))) if len(rows) else np.zeros(0)

    def ids(self, tokens: pa.Array) -> np.ndarray:
        """The place of each token among the frequent ones, -1 for all others."""
        return pc.fill_null(pc.index_in(tokens, value_set=self.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)

    def symbols_of(self, tokens: pa.Array, ids: np.ndarray) -> np.ndarray:
        """The symbol of each token."""
        out = np.empty(len(ids), np.int32)
        rare = ids < 0
        out[~rare] = self.symbol[ids[~rare]]
        out[rare] = self.bucket_symbol[buckets_of(tokens.filter(pa.array(rare)))]
        return out

    def network(self, documents: int) -> Network:
        counts = self.counts + 0.5
        counts[END] = documents + 0.5
        return Network(self.symbols, logits=np.log(counts / counts.sum()))


def encoded_documents(docs: DataFrame, sent) -> DataFrame:
    """Each row of ``docs`` (id, text) once in numbers: symbols, and what its tokens' counts give.

    ``part`` is -1 for held-out documents, else the training round that takes the document.  ``n_known`` and ``base``
    cover the frequent tokens, ``bucketed`` is their probability within buckets; ``rare`` has the other tokens.  Symbols are
    numbers of ``SYMBOL`` as bytes, which Spark moves and sorts as they are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value
        for b in batches:
            for at, words, counts in split_texts(b):
                ids = table.ids(words)
                rows = len(counts)
                doc = np.repeat(np.arange(rows), counts)
                known = ids >= 0
                here, which = ids[known], doc[known]
                add = lambda values: np.bincount(which, values, rows)  # noqa: B023, E731
                i = b.column(0).slice(at, rows)
                held = np.array([is_held_out(x) for x in i.to_pylist()], bool)
                part = np.where(held, -1, [crc32(b"%r" % (x,)) % ROUNDS for x in i.to_pylist()])
                # each document's symbols, its end after them
                ends = np.cumsum(counts + 1)
                symbols = np.full(int(ends[-1]), END, SYMBOL)
                symbols[np.arange(len(ids)) + doc] = table.symbols_of(words, ids)
                rare = np.r_[0, np.cumsum(np.bincount(doc[~known], minlength=rows))]
                yield pa.RecordBatch.from_arrays([
                    i, pa.array(held), pa.array(part, pa.int32()), pa.array(counts + 1, pa.int64()), pa.array(add(table.c[here] > 0).astype(np.int64)),
                    pa.array(add(table.base[here]), pa.float64()), pa.array(add(table.in_bucket[here]), pa.float64()),
                    pa.Array.from_buffers(pa.binary(), rows, [None, *map(pa.py_buffer, (np.r_[0, ends * SYMBOL.itemsize].astype(np.int32), symbols))]),
                    pa.ListArray.from_arrays(rare.astype(np.int32), words.filter(pa.array(~known))),
                ], names=names)

    names = ["id", "held_out", "part", "n_tokens", "n_known", "base", "bucketed", "symbols", "rare"]
    schema = (
        f"id {docs.dtypes[0][1]}, held_out boolean, part int, n_tokens long, n_known long, base double, bucketed double, "
        "symbols binary, rare array<string>"
    )
    return docs.mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id())


def _symbols(column: pa.Array) -> Iterator[np.ndarray]:
    """The symbols of each document, without a copy."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    values = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    ends = ends.tolist()
    for begin, end in zip(ends, ends[1:], strict=False):
        yield values[begin:end].view(SYMBOL)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    """(rows, symbols) of about ``CHUNK`` tokens of documents at a time; the batches hold (row, symbols)."""
    rows: list[int] = []
    docs: list[np.ndarray] = []
    size = 0
    for b in batches:
        for row, doc in zip(b.column(0).to_pylist(), _symbols(b.column(1)), strict=True):
            rows.append(row)
            docs.append(doc)
            size += len(doc)
            if size >= CHUNK:
                yield rows, docs
                rows, docs, size = [], [], 0
    if docs:
        yield rows, docs


def _trained(docs: DataFrame, groups: int, symbols: int, weights: np.ndarray) -> np.ndarray | None:
    """The average of the weights that the groups of ``docs`` (id, n_tokens, row, symbols) come to."""
    order = F.xxhash64("id", "n_tokens")
    dealt = docs.select(F.pmod(order, F.lit(groups)).cast("int").alias("group"), F.xxhash64(order).alias("order"), "symbols")
    dealt = dealt.repartitionById(groups, F.col("group")).sortWithinPartitions("group", "order")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, net, n, held, size = None, None, 0, [], 0

        def out() -> Iterator[pa.RecordBatch]:
            nonlocal n, held, size
            if held:
                n += train_on(net, held)
                held, size = [], 0
            if n:
                yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([net.flat.tobytes()], pa.binary())], names=["n", "w"])
            n = 0

        for b in batches:
            for group, doc in zip(b.column(0).to_pylist(), _symbols(b.column(2)), strict=True):
                if group != now:
                    yield from out()
                    now, net = group, Network(symbols, weights)
                held.append(doc)
                size += len(doc)
                if size >= CHUNK:
                    n += train_on(net, held)
                    held, size = [], 0
        yield from out()

    def averaged(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n", "w"])
        total = int(pdf["n"].sum())
        mean = sum(np.frombuffer(w, np.float32) * np.float32(n / total) for n, w in zip(pdf["n"], pdf["w"], strict=True))
        return pd.DataFrame({"n": [total], "w": [mean.astype(np.float32).tobytes()]})

    now = written(dealt.mapInArrow(run, "n long, w binary"), "weights")
    while (rows := now.count()) > 16:
        group = F.pmod(F.xxhash64("n", "w"), F.lit(-(-rows // 16)))
        fewer = written(now.groupBy(group.alias("g")).applyInPandas(averaged, "n long, w binary"), "weights")
        forget(docs.sparkSession, now)
        now = fewer
    last = now.toArrow().to_pandas()
    forget(docs.sparkSession, now)
    return np.frombuffer(averaged(last)["w"][0], np.float32) if len(last) else None


def _level():
    """Sixteenths of a doubling of a token's training count."""
    return F.floor(F.log2(F.col("c") + 1) * 16)


def frequent_level(words: DataFrame, most: int = FREQUENT) -> int:
    """The highest level from which on there are ``most`` tokens; 0 if there are fewer.

    No token below it is among the ``most`` first, and a level has few, so the sort that picks them reads little more
    than it keeps. There are at most 16 * 64 levels.
    """
    found = 0
    for level, n in sorted(((int(r.level), r["count"]) for r in words.groupBy(_level().alias("level")).count().collect()), reverse=True):
        found += n
        if found >= most:
            return level
    return 0


def score_documents(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: ``id_col``, held_out, n_tokens, n_known, train_tokens, base_score and score."""
    spark = df.sparkSession
    docs = df.select(id_col, text)
    counts = written(count_tokens(docs), "counts")
    some = counts.agg(F.sum("c"), F.count_if(F.col("c") > 0), F.sum(F.when(F.col("token") == " ", F.col("c")))).first()
    total, different, ends = (int(x or 0) for x in some)
    words = counts.where(F.col("token") != " ")
    top = words.where(_level() >= frequent_level(words)).orderBy(F.col("c").desc(), F.col("a").desc(), "token").select("token", "c", "a", "bucket").limit(FREQUENT).toArrow()
    rows = list(zip(*(top[c].to_pylist() for c in ("token", "c", "a", "bucket")), strict=True))
    held: dict[int, list[int]] = {}
    for _, c, _, b in rows[:SYMBOLS]:
        h = held.setdefault(b, [0, 0])
        h[0] += c
        h[1] += c > 0
    buckets = {
        r.bucket: (int(r.n) - held.get(r.bucket, [0, 0])[0], int(r.v) - held.get(r.bucket, [0, 0])[1])
        for r in words.groupBy("bucket").agg(F.sum("c").alias("n"), F.count_if(F.col("c") > 0).alias("v")).collect()
    }
    table = Table(rows, total, different, buckets)
    sent = spark.sparkContext.broadcast(table)
    symbols, weights = table.symbols, table.network(ends).flat
    encoded = written(encoded_documents(docs, sent), "encoded", by="part")
    groups = max(1, min(MOST_GROUPS, -(-total // (ROUNDS * GROUP))))
    for round_ in range(ROUNDS):
        made = _trained(encoded.where(F.col("part") == round_), groups, symbols, weights)
        weights = weights if made is None else made

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Network(symbols, weights)
        for rows, texts in _chunks(batches):
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(score(net, texts))], names=["row", "score"])

    scored = written(encoded.select("row", "symbols").mapInArrow(run, "row long, score double"), "scored")
    rare = encoded.select("row", F.explode("rare").alias("token"))
    n_b = F.create_map(*(F.lit(x) for b in range(BUCKETS) for x in (b, float(sum(np.array(buckets.get(b, (0, 0))) * (1, 0.5)) + 0.5))))
    c = F.col("c") + 0.5
    known = words.select(
        "token",
        F.log10(c / F.lit(total + 0.5 * (different + 1))).alias("b"),
        F.log10(c / F.element_at(n_b, F.col("bucket"))).alias("s"),
        (F.col("c") > 0).cast("int").alias("k"),
    )
    joined = rare.join(known, "token").groupBy("row").agg(F.sum("b").alias("rare_base"), F.sum("s").alias("rare_score"), F.sum("k").alias("rare_known"))
    end = math.log10((ends + 0.5) / (total + 0.5 * (different + 1)))
    zero = F.lit(0)
    out = written(
        encoded.drop("symbols", "rare").join(scored, "row").join(joined, "row", "left").select(
            F.col("id").alias(id_col),
            "held_out",
            "n_tokens",
            (F.col("n_known") + F.coalesce("rare_known", zero) + int(ends > 0)).cast("long").alias("n_known"),
            F.lit(total).cast("long").alias("train_tokens"),
            (F.col("base") + F.coalesce("rare_base", zero) + end).alias("base_score"),
            (F.col("score") + F.col("bucketed") + F.coalesce("rare_score", zero)).alias("score"),
        ),
        "scores",
    )
    for done in (counts, encoded, scored):
        forget(spark, done)
    return out
