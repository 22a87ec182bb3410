"""A gated recurrent language model in numpy, with a class-factored softmax, over word blocks.

Word counts of all training documents are gathered by a shuffle of distinct words. Words met
`least` times or more, so the more the larger the corpus, are spelled out by the model (the most
frequent `vocabulary` of them: model and sums of models stay in memory). All others, the unseen
too, are read and predicted as rare classes by frequency and hash: PIECES for each power of two of
the count; within its class a word goes by its smoothed share of the counts, so that probabilities
of all words add up to one (unseen words are one word in each piece of the lowest class). Outputs
are in classes, fewer than the square root of their number, the frequent ones in small classes. A minimal gated unit (one gate) reads the
words; its state is carried across windows to a document's end, in training as in scoring
(gradients stop at window edges).

Training covers every training document. A warm start on a bounded number of blocks gives all tasks
the same model to begin with; then each task goes over its own blocks once and the results are
averaged by tokens (parameter mixing), through a fixed number of sums.

Null text: as empty, the end token alone. Null doc_id: its crc32 is null, so it is not held out and
is learned from. Repeated rows: each counts and each has a result. Extra columns are not used.
Empty training set: base and model score every word by the smoothing alone.
"""

from __future__ import annotations

import heapq
import math
import pickle
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from descry.llm._shared import most_frequent, pack, shuffle_partitions, unpack, unpack_words, written
from descry.llm.blocks import BLOCK_BYTES, blocks, places

SMOOTH = 0.1
#: Words the model spells out at most, and their least count; its state; lanes and steps of a window.
VOCABULARY, LEAST, HIDDEN, LANES, STEPS = 16_384, 50, 16, 512, 16
#: Rare classes for each power of two of the count; rows of a softmax and numbers of an array that stay in the processor's cache.
PIECES, CACHED, PART = 16, 1024, 1 << 14
#: Blocks of the warm start; partial sums of the averaged models; tokens a task lays out at once.
WARM_BLOCKS, SUMS, AT_ONCE = 1, 16, 4_000_000
#: Lanes and rates of the warm start and of the pass over all; windows whose outputs are scored together.
WARM_LANES, WARM_RATE, RATE, TOGETHER = 64, 0.1, 0.2, 4
#: How many times longer the windows of the last lanes are; inputs of a softmax up to this have exponentials and sums in 32 bits.
LONGER, SAFE = 4, 60.0
END, RARE = 0, 1


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 10 == 0, F.lit(False))


def class_cuts(weight: np.ndarray) -> np.ndarray:
    """Where the classes of outputs begin, and the end: equal sums of the weights' square roots.

    So frequent outputs are in small classes, and a token costs few outputs of its class on average.
    The classes are three quarters of the square root of the outputs' number; none is empty.
    """
    n = len(weight)
    classes = (3 * math.isqrt(n - 1) + 4) // 4
    upto, at = np.cumsum(np.sqrt(weight)), np.arange(classes)
    first = np.searchsorted(upto, upto[-1] * at / classes)
    first = np.minimum(np.maximum.accumulate(first - at) + at, n - classes + at)
    return np.append(first, n)


class GatedLM:
    """Outputs 0 (end of text), the rare classes from 1 on and then the spelled-out words, most frequent first."""

    def __init__(self, n_out: int, counts: np.ndarray | None = None, hidden: int = HIDDEN, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.n, self.h, self.counts = n_out, hidden, counts
        weight = np.ones(n_out) if counts is None else counts + 1.0
        self.cuts = class_cuts(weight)
        self.classes = len(self.cuts) - 1
        self.sizes = np.diff(self.cuts)
        # Few enough for 16 bits, whose stable sort is by digits.
        self.class_of = np.repeat(np.arange(self.classes, dtype=np.uint16 if self.classes <= 1 << 16 else np.int64), self.sizes)
        normal = lambda *s: rng.normal(0, 0.1, s).astype("f4")
        self.p = {"x": normal(n_out, 2 * hidden), "f": normal(hidden, hidden), "c": normal(hidden, hidden), "bf": np.zeros(hidden, "f4"), "cls": normal(hidden, self.classes), "bc": np.zeros(self.classes, "f4"), "out": normal(n_out, hidden), "bo": np.zeros(n_out, "f4")}
        by = np.add.reduceat(weight, self.cuts[:-1])
        self.p["bo"][:] = np.log(weight / by[self.class_of])
        self.p["bc"][:] = np.log(by / weight.sum())
        self.g2 = {k: np.full_like(v, 1e-3) for k, v in self.p.items()}

    def window(self, inp: np.ndarray, fresh: np.ndarray, h: np.ndarray, keep: bool = False):
        """States over a window, the last, and with keep what its gradient needs. inp, fresh (state starts anew): steps x lanes."""
        p, n, x = self.p, self.h, self.p["x"].take(inp, axis=0)
        hs = np.empty((*inp.shape, n), h.dtype)
        kept = [np.empty_like(hs) for _ in range(4)] if keep else []
        # The gate is one over one plus the exponential of what is taken off here.
        x_f, w_f = -p["bf"] - x[..., :n], -p["f"]
        starts = [np.flatnonzero(row) for row in fresh]
        for t in range(len(inp)):
            f, prev, gated, change = (k[t] for k in kept) if keep else np.empty((4, *h.shape), h.dtype)
            prev[:] = h
            prev[starts[t]] = 0
            np.matmul(prev, w_f, out=f)
            f += x_f[t]
            np.minimum(f, SAFE, out=f)
            np.exp(f, out=f)
            f += 1
            np.reciprocal(f, out=f)
            np.multiply(f, prev, out=gated)
            np.matmul(gated, p["c"], out=change)
            change += x[t, :, n:]
            np.tanh(change, out=change)
            change -= prev
            h = np.multiply(f, change, out=hs[t])
            h += prev
        return hs, h, (*kept, starts)

    def outputs(self, hs: np.ndarray, target: np.ndarray, grads: dict | None = None, scale: float = 1.0):
        """Natural log-probability of each target; with grads also the gradients of `scale` times their sum's negative, by hs returned."""
        p = self.p
        # In order of the classes, so that a class's rows are one slice.
        order = np.argsort(self.class_of[target], kind="stable")
        # Biases are the weights of one more state that is always one.
        hs, target = np.concatenate([hs.take(order, axis=0), np.ones((len(hs), 1), hs.dtype)], 1), target[order]
        w_cls, w_out = np.concatenate([p["cls"], p["bc"][None]]), np.concatenate([p["out"], p["bo"][:, None]], 1)
        ones = np.ones(max(self.classes, int(self.sizes.max()), self.h + 1), hs.dtype)
        most = max(1.0, float(np.abs(hs).max(initial=0))) * max(float((np.abs(w) @ ones[: self.h + 1]).max()) for w in (w_cls.T, w_out))
        shift = most > SAFE
        cls = self.class_of[target]
        cuts = np.searchsorted(cls, np.arange(self.classes + 1))
        # Places of the targets among all outputs of their class's rows.
        place = (np.arange(len(target)) - cuts[cls]) * self.sizes[cls] + target - self.cuts[cls]
        at, total = np.zeros((2, len(target)), hs.dtype), np.ones((2, len(target)), hs.dtype)
        d_h = d_inner = None
        if grads is not None:
            g_cls = np.zeros_like(w_cls)
            grads |= {"cls": g_cls[:-1], "bc": g_cls[-1], "out": np.zeros_like(p["out"]), "bo": np.zeros_like(p["bo"])}
            d_h, d_inner = np.empty((len(hs), self.h), hs.dtype), np.zeros((len(hs), self.h), hs.dtype)
        for a in range(0, len(target), CACHED):
            b = min(a + CACHED, len(target))
            own = np.arange(b - a) * self.classes + cls[a:b]
            z = self.spread(hs[a:b], w_cls, ones, own, at[0, a:b], total[0, a:b], shift)
            if grads is not None:
                z.reshape(-1)[own] -= total[0, a:b]
                g_cls += (hs[a:b] * (scale / total[0, a:b])[:, None]).T @ z
                np.matmul(z, p["cls"].T, out=d_h[a:b])
        for a, b, i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), self.cuts[:-1].tolist(), self.cuts[1:].tolist(), strict=True):
            if a == b or j == i + 1:  # an output alone in its class is certain
                continue
            z = self.spread(hs[a:b], w_out[i:j].T, ones, place[a:b], at[1, a:b], total[1, a:b], shift)
            if grads is not None:
                z.reshape(-1)[place[a:b]] -= total[1, a:b]
                g = (hs[a:b] * (scale / total[1, a:b])[:, None]).T @ z
                grads["out"][i:j], grads["bo"][i:j] = g[:-1].T, g[-1]
                np.matmul(z, p["out"][i:j], out=d_inner[a:b])
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        out = (at - np.log(total)).sum(0)[back]
        if grads is None:
            return out, None
        d_h *= (scale / total[0])[:, None]
        d_inner *= (scale / total[1])[:, None]
        d_h += d_inner
        return out, d_h.take(back, axis=0)

    @staticmethod
    def spread(h, weight, ones, place, at, total, shift: bool):
        """Exponentials of a softmax's inputs; writes the targets' inputs to `at` and each row's sum of exponentials to `total`.

        shift: inputs may be too large for their exponentials, so each row's largest is taken off first.
        """
        z = h @ weight
        if shift:
            z -= z.max(1, keepdims=True)
        z.reshape(-1).take(place, out=at, mode="clip")
        np.exp(z, out=z)
        np.matmul(z, ones[: z.shape[1]], out=total)
        return z

    def learn(self, inp: np.ndarray, fresh: np.ndarray, target: np.ndarray, live: np.ndarray, h: np.ndarray, rate: float, full: int) -> np.ndarray:
        """One step of Adagrad on a window, backwards through its steps only. Returns the state at its end.

        full: tokens of a full window; the fewer a late window has, the less it weighs.
        """
        p, n = self.p, self.h
        hs, last, (f, prev, gated, change, starts) = self.window(inp, fresh, h, keep=True)
        grads: dict[str, np.ndarray] = {}
        if live.all():
            d_out = self.outputs(hs.reshape(-1, n), target.reshape(-1), grads, 1 / full)[1].reshape(hs.shape)
        else:
            d_out = np.zeros_like(hs)
            d_out[live] = self.outputs(hs[live], target[live], grads, 1 / full)[1]
        # Slopes of the two functions, of the candidate (times its gate) and of the gate.
        s_c = change + prev
        s_c *= s_c
        np.subtract(1, s_c, out=s_c)
        s_c *= f
        s_f = f - f * f
        w_f, w_c = p["f"].T.copy(), p["c"].T.copy()
        d_f, d_c = np.empty_like(hs), np.empty_like(hs)
        d_next, d_gated, part = np.zeros_like(h), np.empty_like(h), np.empty_like(h)
        for t in range(len(inp) - 1, -1, -1):
            d = d_out[t]
            d += d_next
            np.multiply(d, s_c[t], out=d_c[t])
            np.matmul(d_c[t], w_c, out=d_gated)
            np.multiply(d, change[t], out=d_f[t])
            np.multiply(d_gated, prev[t], out=part)
            d_f[t] += part
            d_f[t] *= s_f[t]
            np.matmul(d_f[t], w_f, out=d_next)
            d_next += d
            d_gated -= d
            d_gated *= f[t]
            d_next += d_gated
            d_next[starts[t]] = 0
        d_f, d_c = d_f.reshape(-1, n), d_c.reshape(-1, n)
        grads |= {"f": prev.reshape(-1, n).T @ d_f, "c": gated.reshape(-1, n).T @ d_c, "bf": d_f.sum(0)}
        rows, g_rows = sums_by(inp.reshape(-1), np.concatenate([d_f, d_c], 1), self.n)
        for k, g in grads.items():
            descend(p[k], self.g2[k], g, rate)
        g2_rows = self.g2["x"][rows]
        p_rows = p["x"][rows]
        descend(p_rows, g2_rows, g_rows, rate)
        self.g2["x"][rows], p["x"][rows] = g2_rows, p_rows
        return last


def descend(p: np.ndarray, g2: np.ndarray, g: np.ndarray, rate: float) -> None:
    """One step of Adagrad in place, in parts that stay in the processor's cache; g is used up."""
    p, g2, g = p.reshape(-1), g2.reshape(-1), g.reshape(-1)
    for a in range(0, len(g), PART):
        part, sums = g[a : a + PART], g2[a : a + PART]
        square = part * part
        sums += square
        np.sqrt(sums, out=square)
        part /= square
        part *= rate
        p[a : a + PART] -= part


def sums_by(keys: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys (below n) and the sum of each one's rows."""
    by = np.argsort(keys.astype(np.uint16) if n <= 1 << 16 else keys, kind="stable")
    keys = keys[by]
    first = np.flatnonzero(np.diff(keys, prepend=-1))
    times = np.diff(first, append=len(keys))
    out, many = rows.take(by[first], axis=0), np.flatnonzero(times > 1)
    if len(many):
        # Only keys met more than once need sums, which cost a call for each number.
        more = by[np.repeat(times > 1, times)]
        out[many] = np.add.reduceat(rows.take(more, axis=0), np.cumsum(times[many]) - times[many], axis=0)
    return keys[first], out


def lanes(sizes: np.ndarray, n_lanes: int) -> list[list[int]]:
    """Documents dealt to lanes, the longest first, each to the lane with the fewest tokens."""
    n_lanes = max(1, min(n_lanes, len(sizes)))
    heap, out = [(0, i) for i in range(n_lanes)], [[] for _ in range(n_lanes)]
    for d in np.argsort(-sizes, kind="stable").tolist():
        n, i = heapq.heappop(heap)
        out[i].append(d)
        heapq.heappush(heap, (n + int(sizes[d]), i))
    return out


def laid_out(sizes: np.ndarray, n_lanes: int, steps: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Windows over lanes of whole documents: (positions in the documents end to end, which are real), steps x lanes.

    A lane that has ended leaves the later windows; lanes are sorted by length, so the others stay where they are.
    The fewer lanes are left, the more steps a window has (LONGER times at most), for about as many tokens.
    """
    first = np.cumsum(sizes) - sizes
    rng = np.random.default_rng(len(sizes))
    dealt = [rng.permutation(lane) for lane in lanes(sizes, n_lanes)]
    length = np.array([sizes[x].sum() for x in dealt])
    by = np.argsort(-length, kind="stable")
    length, docs = length[by], np.concatenate([dealt[i] for i in by.tolist()])
    begin, each = np.cumsum(length) - length, sizes[docs]
    rows = np.repeat((first[docs] - np.cumsum(each) + each).astype(np.int32 if length.sum() < 1 << 31 else np.int64), each)
    rows += np.arange(len(rows), dtype=rows.dtype)
    t = 0
    while t < length[0]:
        active = int((length > t).sum())
        n = min(steps * min(LONGER, len(length) // active), int(length[0]) - t)
        step = t + np.arange(n)[:, None]
        live = step < length[:active]
        yield np.where(live, rows.take(begin[:active] + step, mode="clip"), 0), live
        t += n


def inputs(tokens: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What is read before each token: the one before it, or the end token where a text starts; and where that is."""
    fresh = np.zeros(len(tokens), bool)
    fresh[np.cumsum(sizes) - sizes] = True
    return np.where(fresh, END, np.roll(tokens, 1)), fresh


def train(model: GatedLM, tokens: np.ndarray, sizes: np.ndarray, rate: float, n_lanes: int = LANES) -> None:
    if not len(sizes):
        return
    inp, fresh = inputs(tokens, sizes)
    h = None
    for at, live in laid_out(sizes, n_lanes, STEPS):
        h = np.zeros((at.shape[1], model.h), "f4") if h is None else h[: at.shape[1]]
        h = model.learn(inp[at], fresh[at], tokens[at], live, h, rate, n_lanes * STEPS)


def log10_probs(model: GatedLM, tokens: np.ndarray, sizes: np.ndarray, n_lanes: int = LANES) -> np.ndarray:
    """log10 probability of each token."""
    out = np.zeros(len(tokens))
    if not len(sizes):
        return out
    inp, fresh = inputs(tokens, sizes)
    h = None
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def close() -> None:
        if held:
            at = np.concatenate([a for a, _ in held])
            out[at] = model.outputs(np.concatenate([s for _, s in held]), tokens[at])[0]
            held.clear()

    for at, live in laid_out(sizes, n_lanes, STEPS):
        h = np.zeros((at.shape[1], model.h), "f4") if h is None else h[: at.shape[1]]
        hs, h, _ = model.window(inp[at], fresh[at], h)
        held.append((at[live], hs[live]))
        if sum(len(a) for a, _ in held) >= TOGETHER * n_lanes * STEPS:
            close()
    close()
    return out / np.log(10)


def words_of(texts: list[str | None]) -> pa.ListArray:
    """The words of each text as bytes; null where it has none. Arrow's ASCII functions know the same letters and white space."""
    t = pc.ascii_trim_whitespace(pc.ascii_lower(pa.array(texts, pa.string())))
    return pc.ascii_split_whitespace(pc.if_else(pc.equal(t, ""), None, t)).cast(pa.list_(pa.binary()))


def rare_class(words: list[bytes], counts: np.ndarray) -> np.ndarray:
    """The rare class of each word, were it not spelled out: the power of two of its count, then a piece of its hash."""
    power = np.maximum(np.frexp(counts.astype("f8"))[1].astype(np.int64) - 1, 0)
    return power * PIECES + np.fromiter((zlib.crc32(w) >> 8 & PIECES - 1 for w in words), np.int64, len(words))


class Gathered:
    """Counts of all training tokens: N, V, the counts by word (a table), the spelled-out words, tokens and words of each rare class."""

    def __init__(self, table: DataFrame, n: int, v: int, ends: int, top: list[tuple[bytes, int]], rare_n: np.ndarray, rare_v: np.ndarray):
        self.table, self.n, self.v, self.ends, self.top, self.rare_n, self.rare_v = table, n, v, ends, top, rare_n, rare_v


def gather(dealt: DataFrame, spark, vocabulary: int, least: int) -> Gathered:
    """dealt: blocks with key columns id and learn (whether a document is learned from)."""

    def per_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The training count of each word of a block, in the order of its number."""
        for batch in batches:
            for i in range(batch.num_rows):
                counts, seq, bucket = unpack(batch.column(batch.schema.get_field_index("payload"))[i].as_py())
                learn = np.array(batch.column(batch.schema.get_field_index("learn"))[i].as_py(), bool)
                of = np.bincount(seq[np.repeat(learn, counts)], minlength=len(bucket))
                block = batch.column(0)[i].as_py()
                at = places(bucket)
                yield pa.RecordBatch.from_arrays([pa.array([block] * len(at), pa.int64()), pa.array(list(at), pa.int32()), pa.array([pack(of[x]) for x in at.values()], pa.binary()), pa.array([int(learn.sum())] + [0] * (len(at) - 1) if at else [], pa.int64())], names=["block", "bucket", "counts", "ends"])
                if not at:
                    yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([-1], pa.int32()), pa.array([pack(of)], pa.binary()), pa.array([int(learn.sum())], pa.int64())], names=["block", "bucket", "counts", "ends"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Counts by word of the buckets of a partition; each bucket is in one partition."""
        held: dict[int, dict[bytes, int]] = {}
        for batch in batches:
            for b, words, counts in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("bucket", "payload", "counts")), strict=True):
                own = held.setdefault(b, {})
                for w, n in zip(unpack_words(words), unpack(counts)[0].tolist(), strict=True):
                    if n:
                        own[w] = own.get(w, 0) + n
        for b, own in held.items():
            top = heapq.nsmallest(vocabulary, (x for x in own.items() if x[1] >= least), key=lambda x: (-x[1], x[0]))
            n = np.fromiter(own.values(), np.int64, len(own))
            rare = rare_class(list(own), n)
            rare_n, rare_v = np.zeros(int(rare.max(initial=-1)) + 1, np.int64), np.bincount(rare)
            np.add.at(rare_n, rare, n)
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([pack_words_counts(own)], pa.binary()), pa.array([int(n.sum())], pa.int64()), pa.array([len(own)], pa.int64()), pa.array([[w for w, _ in top]], pa.list_(pa.binary())), pa.array([[n for _, n in top]], pa.list_(pa.int64())), pa.array([rare_n.tolist()], pa.list_(pa.int64())), pa.array([rare_v.tolist()], pa.list_(pa.int64()))], names=["bucket", "table", "n", "v", "words", "counts", "rare_n", "rare_v"])

    counts = dealt.filter("bucket = -1").select("block", "learn", "payload").mapInArrow(per_block, "block long, bucket int, counts binary, ends long")
    counts = written(counts, "block-counts")
    ends = counts.agg(F.coalesce(F.sum("ends"), F.lit(0)).alias("n")).first()["n"]
    words = dealt.filter("bucket >= 0").select("block", "bucket", "payload").join(counts.select("block", "bucket", "counts"), ["block", "bucket"])
    table = words.repartition(shuffle_partitions(spark), "bucket").mapInArrow(total, "bucket int, table binary, n long, v long, words array<binary>, counts array<long>, rare_n array<long>, rare_v array<long>")
    table = written(table, "word-counts")
    sums = table.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("v"), F.lit(0)).alias("v")).first()
    each = table.select(F.explode(F.arrays_zip("words", "counts")).alias("x")).select("x.words", "x.counts")
    top = [(bytes(r["words"]), r["counts"]) for r in most_frequent(each, "words", "counts", vocabulary)]
    # Of all words by class; those of the spelled-out words are taken off.
    by_class = table.select(F.posexplode(F.arrays_zip("rare_n", "rare_v")).alias("k", "x")).groupBy("k").agg(F.sum("x.rare_n").alias("n"), F.sum("x.rare_v").alias("v")).collect()
    size = PIECES * -(-max([PIECES, *(r["k"] + 1 for r in by_class)]) // PIECES)
    rare_n, rare_v = np.zeros(size, np.int64), np.zeros(size, np.int64)
    for r in by_class:
        rare_n[r["k"]], rare_v[r["k"]] = r["n"], r["v"]
    spelled = rare_class([w for w, _ in top], np.array([n for _, n in top], np.int64))
    np.subtract.at(rare_n, spelled, np.array([n for _, n in top], np.int64))
    np.subtract.at(rare_v, spelled, 1)
    used = PIECES * (int(np.flatnonzero(rare_v).max(initial=0)) // PIECES + 1)
    return Gathered(table.select("bucket", "table"), sums["n"] + ends, sums["v"] + (ends > 0), ends, top, rare_n[:used], rare_v[:used])


def pack_words_counts(own: dict[bytes, int]) -> bytes:
    from descry.llm._shared import pack_words

    words = pack_words(list(own))
    # Counts may pass 2**32: two halves.
    n = np.fromiter(own.values(), np.int64, len(own))
    return len(words).to_bytes(8, "little") + words + pack(n & 0xFFFFFFFF, n >> 32)


def unpack_words_counts(data: bytes) -> dict[bytes, int]:
    cut = 8 + int.from_bytes(data[:8], "little")
    low, high = unpack(data[cut:])
    return dict(zip(unpack_words(data[8:cut]), (low.astype(np.int64) + (high.astype(np.int64) << 32)).tolist(), strict=True))


def answers(dealt: DataFrame, known: Gathered, spark) -> DataFrame:
    """(block, bucket, payload): each block's words' training counts (two halves) and model outputs."""
    top = spark.sparkContext.broadcast({w: i + RARE + len(known.rare_n) for i, (w, _) in enumerate(known.top)})

    def reply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table: dict[int, dict[bytes, int]] = {}
        number = top.value
        for batch in batches:
            out: list[list] = [[], [], []]
            for block, b, data in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                if block is None:  # sorted first within its bucket
                    table = {b: unpack_words_counts(data)}
                    continue
                own, words = table.get(b, {}), unpack_words(data)
                c = np.fromiter((own.get(w, 0) for w in words), np.int64, len(words))
                out[0].append(block)
                out[1].append(b)
                spelled = np.fromiter((number.get(w, 0) for w in words), np.int64, len(words))
                out[2].append(pack(c & 0xFFFFFFFF, c >> 32, np.where(spelled > 0, spelled, RARE + rare_class(words, c))))
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.binary())], names=["block", "bucket", "payload"])

    words = dealt.filter("bucket >= 0").select("block", "bucket", "payload")
    both = words.unionByName(known.table.select(F.lit(None).cast("long").alias("block"), "bucket", F.col("table").alias("payload")))
    met = both.repartition(shuffle_partitions(spark), "bucket").sortWithinPartitions(F.asc("bucket"), F.asc_nulls_first("block"))
    return met.mapInArrow(reply, "block long, bucket int, payload binary")


def tokens_of(seq: np.ndarray, counts: np.ndarray, of_word: np.ndarray, end: int) -> np.ndarray:
    """of_word for every word of the documents, with `end` after each document."""
    out = np.full(len(seq) + len(counts), end, np.int64)
    keep = np.ones(len(out), bool)
    keep[np.cumsum(counts.astype(np.int64) + 1) - 1] = False
    out[keep] = of_word[seq]
    return out


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: int = VOCABULARY, block_bytes: int = BLOCK_BYTES, least: int = LEAST) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row's whole text."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), (~held_out(F.col(id_col))).alias("learn"), F.col(text_col).alias("text"))
    id_type = rows.schema["id"].dataType
    dealt = written(blocks(rows, words_of, ["id", "learn"], "text", block_bytes), "word-blocks")
    known = gather(dealt, spark, vocabulary, least)
    n_rare = len(known.rare_n)
    #: log10 of what the smoothed counts of a rare class's words, and of one unseen, are divided by.
    of_rare = np.log10(known.rare_n + SMOOTH * (known.rare_v + 1))
    seqs = dealt.filter("bucket = -1").select("block", "id", "learn", "payload")

    def join_answers(block: pa.Table, got: pa.Table) -> pa.Table:
        """Model outputs of all tokens, and base sums and known words by document."""
        counts, seq, bucket = unpack(block.column("payload")[0].as_py())
        c, out = np.zeros(len(bucket), np.int64), np.full(len(bucket), RARE, np.int64)
        at = places(bucket)
        for b, data in zip(got.column("bucket").to_pylist(), got.column("payload").to_pylist(), strict=True):
            low, high, number = unpack(data)
            c[at[b]], out[at[b]] = low.astype(np.int64) + (high.astype(np.int64) << 32), number
        all_c = tokens_of(seq, counts, c, known_ends)
        sizes = counts.astype(np.int64) + 1
        first = np.cumsum(sizes) - sizes
        base = np.add.reduceat(np.log10((all_c + SMOOTH) / (n_all + SMOOTH * (v_all + 1))), first)
        rare = np.where(out < RARE + n_rare, np.log10(c + SMOOTH) - of_rare[np.minimum(out - RARE, n_rare - 1)], 0.0)
        rare_sum = np.add.reduceat(tokens_of_float(seq, counts, rare), first)
        tokens = tokens_of(seq, counts, out, END)
        n_known = np.add.reduceat((all_c > 0).astype(np.int64), first)
        col = lambda x, t: pa.array([x.tolist()], pa.list_(t))
        return pa.table([block.column("block").slice(0, 1), block.column("id").slice(0, 1), block.column("learn").slice(0, 1), pa.array([pack(sizes, tokens)], pa.binary()), col(base, pa.float64()), col(rare_sum, pa.float64()), col(n_known, pa.int64())], names=["block", "id", "learn", "payload", "base", "rare", "n_known"])

    known_ends, n_all, v_all = known.ends, known.n, known.v
    fields = [T.StructField("block", T.LongType()), T.StructField("id", T.ArrayType(id_type)), T.StructField("learn", T.ArrayType(T.BooleanType())), T.StructField("payload", T.BinaryType()), T.StructField("base", T.ArrayType(T.DoubleType())), T.StructField("rare", T.ArrayType(T.DoubleType())), T.StructField("n_known", T.ArrayType(T.LongType()))]
    read = written(seqs.groupBy("block").cogroup(answers(dealt, known, spark).groupBy("block")).applyInArrow(join_answers, T.StructType(fields)), "token-blocks")

    n_out = RARE + n_rare + len(known.top)
    start = GatedLM(n_out, np.array([known.ends, *known.rare_n, *(n for _, n in known.top)], np.float64))
    for r in read.select("learn", "payload").orderBy("block").limit(WARM_BLOCKS).toLocalIterator():
        train(start, *learned(bytes(r["payload"]), np.array(r["learn"], bool)), rate=WARM_RATE, n_lanes=WARM_LANES)
    model = mixed(read, start)
    sent = spark.sparkContext.broadcast(pickle.dumps((n_out, model.counts, model.p)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_out, counts, p = pickle.loads(sent.value)
        lm = GatedLM(n_out, counts)
        lm.p = p
        for group in grouped(batches):
            sizes = np.concatenate([s for _, s, _ in group])
            tokens = np.concatenate([t for _, _, t in group])
            logp = log10_probs(lm, tokens, sizes)
            sums = np.add.reduceat(logp, np.cumsum(sizes) - sizes)
            at = 0
            for row, s, _ in group:
                z = at + len(s)
                learn = row["learn"].values.to_pylist()
                cols = [row["id"].values, pa.array([not x for x in learn], pa.bool_()), pa.array(s, pa.int64()), row["n_known"].values, pa.array(np.full(len(s), n_all), pa.int64()), row["base"].values, pa.array(sums[at:z] + row["rare"].values.to_numpy(zero_copy_only=False), pa.float64())]
                yield pa.RecordBatch.from_arrays(cols, names=["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
                at = z

    out = [("id", id_type), ("held_out", T.BooleanType()), ("n_tokens", T.LongType()), ("n_known", T.LongType()), ("train_tokens", T.LongType()), ("base_score", T.DoubleType()), ("score", T.DoubleType())]
    return read.mapInArrow(run, T.StructType([T.StructField(*x) for x in out])).withColumnRenamed("id", id_col)


def tokens_of_float(seq: np.ndarray, counts: np.ndarray, of_word: np.ndarray) -> np.ndarray:
    out = np.zeros(len(seq) + len(counts))
    keep = np.ones(len(out), bool)
    keep[np.cumsum(counts.astype(np.int64) + 1) - 1] = False
    out[keep] = of_word[seq]
    return out


def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
    """Blocks of a partition together, up to AT_ONCE tokens, so that a long text shares its windows with many others."""
    group, held = [], 0
    for batch in batches:
        for i in range(batch.num_rows):
            row = {n: batch.column(j)[i] for j, n in enumerate(batch.schema.names)}
            sizes, tokens = (x.astype(np.int64) for x in unpack(row["payload"].as_py()))
            group.append((row, sizes, tokens))
            held += len(tokens)
            if held >= AT_ONCE:
                yield group
                group, held = [], 0
    if group:
        yield group


def learned(payload: bytes, learn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and sizes of the documents that are learned from."""
    sizes, tokens = (x.astype(np.int64) for x in unpack(payload))
    return tokens[np.repeat(learn, sizes)], sizes[learn]


def mixed(read: DataFrame, start: GatedLM) -> GatedLM:
    """Every partition trains `start` on its own blocks; the models are averaged by their tokens."""
    sent = read.sparkSession.sparkContext.broadcast(pickle.dumps((start.n, start.counts, start.p, start.g2)))

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, counts, p, g2 = pickle.loads(sent.value)
        lm, seen = GatedLM(n, counts), 0
        lm.p, lm.g2 = p, g2
        for group in grouped(batches):
            parts = [(t[np.repeat(m, s)], s[m]) for row, s, t in group if len(m := np.array(row["learn"].as_py(), bool))]
            tokens, sizes = np.concatenate([t for t, _ in parts]), np.concatenate([s for _, s in parts])
            train(lm, tokens, sizes, rate=RATE)
            seen += len(tokens)
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([seen], pa.int64()), pa.array([pickle.dumps(lm.p)], pa.binary())], names=["n", "model"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for batch in batches:
            for w, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                p = pickle.loads(data)
                total = {k: w * v.astype("f8") + (0 if total is None else total[k]) for k, v in p.items()}
                n += w
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([pickle.dumps({k: v / n for k, v in total.items()})], pa.binary())], names=["n", "model"])

    # Added in the order of the partitions that made them, not in that of their arrival, so that sums are the same in each run.
    models = read.select("learn", "payload").mapInArrow(fit, "n long, model binary").withColumn("part", F.spark_partition_id()).repartition(SUMS, "part").sortWithinPartitions("part")
    out, n, total = GatedLM(start.n, start.counts), 0, None
    for r in models.mapInArrow(add, "n long, model binary").toLocalIterator():
        p = pickle.loads(bytes(r["model"]))
        total = {k: r["n"] * v + (0 if total is None else total[k]) for k, v in p.items()}
        n += r["n"]
    out.p = {k: (v / n).astype("f4") for k, v in total.items()} if n else start.p
    return out
