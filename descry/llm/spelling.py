"""Spelling variants: words one edit apart, by composing the minimised vocabulary acceptor with a one-edit transducer and itself.

The composition's states are pairs of acceptor states with the number of edits so far. Before the edit
both states are equal, so the machine falls apart by what has been read: a partition starts it from the
state after the first three code points, and its words are those that share them. Two words of six code
points or more that differ by one edit share their first three or their last three code points, so the
same is done on reversed words, where only pairs with unlike beginnings are taken: each pair is met once.
"""

from __future__ import annotations

import re
import sys
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from descry.llm._shared import LOWER, chunks, texts_of, written

#: Code points that two words share at the start or at the end, and twice that is the least length of a word.
SHARED = 3
LEAST_LENGTH = 2 * SHARED
#: Words of a partition beyond which it is dealt by what is left of a word without one code point.
MOST_WORDS = 4000
#: Different words that a task holds before it sends their counts.
HELD = 400_000
#: Bytes of a word up to which the hash is shifted for all documents of a chunk at once.
TABLED = 48
RUN = re.compile("[a-zÀ-ÿ]{%d,}" % LEAST_LENGTH)


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)
    return t


_CRC = _crc_table()


def shifted(crc: np.ndarray, most: int) -> np.ndarray:
    """Row n: the state crc after n zero bytes, for n up to most. crc32(a + b) is crc32(a) shifted by b's bytes, xor crc32(b)."""
    out = np.empty((most + 1, len(crc)), np.uint32)
    out[0] = crc
    for n in range(most):
        out[n + 1] = (out[n] >> np.uint32(8)) ^ _CRC[out[n] & np.uint32(255)]
    return out


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: int = 199) -> DataFrame:
    """(word, n): occurrences of the runs of letters of six code points or more, after the planted misspellings.

    A run whose hash with its document's id is divisible by `every` loses one code point. A null id
    counts as empty; a null text has no words. Each task sends its own sums, so a word that stands in
    every document is summed where it is read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number: dict[str, int] = defaultdict()
        number.default_factory = number.__len__
        crc, size, sums = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        shorter: dict[str, int] = defaultdict(int)

        def known(names: list[str]) -> tuple[np.ndarray, np.ndarray]:
            raw = [w.encode() for w in names]
            return np.fromiter(map(zlib.crc32, raw), np.uint32, len(raw)), np.fromiter(map(len, raw), np.int64, len(raw))

        def send() -> pa.RecordBatch:
            words, n = list(number) + list(shorter), sums.tolist() + list(shorter.values())
            at = [i for i, k in enumerate(n) if k]
            return pa.RecordBatch.from_arrays([pa.array([words[i] for i in at], pa.string()), pa.array([n[i] for i in at], pa.int64())], names=["word", "n"])

        for batch in batches:
            ids = [b"" if i is None else i.encode() for i in batch.column(0).to_pylist()]
            texts = texts_of(batch, text_col)
            for a, b in chunks(texts):
                found = [RUN.findall(t.translate(LOWER).decode()) for t in texts[a:b]]
                held = len(number)
                seq = np.fromiter((number[w] for ws in found for w in ws), np.int64, sum(map(len, found)))
                if len(number) > held:
                    more = known([*number][held:])
                    crc, size, sums = np.concatenate([crc, more[0]]), np.concatenate([size, more[1]]), np.concatenate([sums, np.zeros(len(number) - held, np.int64)])
                doc = np.repeat(np.arange(b - a), list(map(len, found)))
                begun = np.fromiter((zlib.crc32(i + b":") for i in ids[a:b]), np.uint32, b - a)
                moved = shifted(begun, TABLED)
                n = size[seq]
                h = moved[np.minimum(n, TABLED), doc] ^ crc[seq]
                for i in np.flatnonzero(n > TABLED).tolist():
                    h[i] = zlib.crc32(found_at(found, doc, i).encode(), int(begun[doc[i]]))
                hit = h % np.uint32(every) == 0
                sums += np.bincount(seq[~hit], minlength=len(sums))
                for i in np.flatnonzero(hit).tolist():
                    w = found_at(found, doc, i)
                    if len(w) > LEAST_LENGTH:
                        at = int(h[i]) % len(w)
                        shorter[w[:at] + w[at + 1 :]] += 1
                if len(number) + len(shorter) > HELD:
                    yield send()
                    number.clear()
                    shorter.clear()
                    crc, size, sums = crc[:0], size[:0], sums[:0]
        if number or shorter:
            yield send()

    def found_at(found: list[list[str]], doc: np.ndarray, i: int) -> str:
        d = int(doc[i])
        return found[d][i - int(np.searchsorted(doc, d))]

    own = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias(text_col))
    return own.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Acceptor:
    """The least deterministic acceptor of some sorted, different words; it numbers them in their order.

    arcs[s]: the next state and the number of words of s before those behind the arc, by code point.
    """

    def __init__(self, words: list[str]):
        self.arcs: list[dict[str, tuple[int, int]]] = []
        self.final: list[bool] = []
        self.count: list[int] = []
        register: dict[tuple, int] = {}
        path: list[tuple[dict[str, int], bool]] = [({}, False)]
        before = ""

        def close(upto: int) -> None:
            """States of the last word beyond a length get their number: that of an equal state, if there is one."""
            while len(path) > upto + 1:
                arcs, final = path.pop()
                path[-1][0][before[len(path) - 1]] = self._state(register, arcs, final)

        for w in words:
            n = 0
            while n < len(before) and n < len(w) and before[n] == w[n]:
                n += 1
            close(n)
            path += [({}, False) for _ in range(len(w) - n)]
            path[-1] = (path[-1][0], True)
            before = w
        close(0)
        self.start = self._state(register, *path[0])

    def _state(self, register: dict[tuple, int], arcs: dict[str, int], final: bool) -> int:
        key = (final, *arcs.items())
        if key not in register:
            register[key] = len(self.arcs)
            n, own = int(final), {}
            for c, s in arcs.items():
                own[c] = (s, n)
                n += self.count[s]
            self.arcs.append(own)
            self.final.append(final)
            self.count.append(n)
        return register[key]


class Composition:
    """Acceptor, one-edit transducer and acceptor again: all pairs of words that one edit parts, each once."""

    def __init__(self, acceptor: Acceptor):
        self.a = acceptor
        self._meet: dict[tuple[int, int], list[tuple[int, int]]] = {}
        self._edits: dict[int, list[tuple[int, int]]] = {}

    def meet(self, p: int, q: int) -> list[tuple[int, int]]:
        """After the edit: what both states accept, as numbers from p and from q."""
        if p == q:
            return [(i, i) for i in range(self.a.count[p])]
        got = self._meet.get((p, q))
        if got is None:
            x, y = self.a.arcs[p], self.a.arcs[q]
            got = [(0, 0)] if self.a.final[p] and self.a.final[q] else []
            for c in x.keys() & y.keys():
                (s, m), (t, n) = x[c], y[c]
                got += [(i + m, j + n) for i, j in self.meet(s, t)]
            self._meet[p, q] = got
        return got

    def edits(self, p: int) -> list[tuple[int, int]]:
        """Pairs that part at state p: one code point for another, or one more before a rest that does not begin with it."""
        got = self._edits.get(p)
        if got is None:
            got, arcs = [], [(c, s, m) for c, (s, m) in self.a.arcs[p].items()]
            for k, (c, s, m) in enumerate(arcs):
                for _, t, n in arcs[k + 1 :]:
                    got += [(i + m, j + n) for i, j in self.meet(s, t)]
                if self.a.final[p] and self.a.final[s]:
                    got.append((m, 0))
                own = self.a.arcs[s]
                for d, t, n in arcs:
                    if d != c and d in own:
                        u, more = own[d]
                        got += [(i + m + more, j + n) for i, j in self.meet(u, t)]
            self._edits[p] = got
        return got

    def pairs(self) -> Iterator[tuple[int, int]]:
        """Numbers of both words of each accepted pair."""
        alive: list[bool] = []
        for s, arcs in enumerate(self.a.arcs):  # next states have smaller numbers
            alive.append(bool(self.edits(s)) or any(alive[t] for t, _ in arcs.values()))
        stack = [(self.a.start, 0)] if alive[self.a.start] else []
        while stack:
            s, base = stack.pop()
            for i, j in self.edits(s):
                yield base + i, base + j
            stack += [(t, base + n) for t, n in self.a.arcs[s].values() if alive[t]]


def near_in(words: list[str]) -> Iterator[tuple[str, str]]:
    """Pairs of the words (sorted, different) that one edit parts."""
    deep = 4 * max(map(len, words), default=0) + 1000
    if sys.getrecursionlimit() < deep:
        sys.setrecursionlimit(deep)
    for i, j in Composition(Acceptor(words)).pairs():
        yield words[i], words[j]


def without_one(u: str, v: str) -> str:
    """What is left of two words one edit apart without that edit, where it stands last."""
    n = 0
    while n < min(len(u), len(v)) and u[n] == v[n]:
        n += 1
    longer = u if len(u) >= len(v) else v
    return longer[:n] + longer[n + 1 :]


def pairs_of(kind: str, key: str, words: list[str]) -> Iterator[tuple[str, str]]:
    """One partition's pairs. kind: begin or end, for words that share their first or last code points;
    begin- and end- for words that share what is left of them without one code point (key), of partitions with many words."""
    if len(words) < 2:
        return
    if kind == "begin":
        yield from ((key + u, key + v) for u, v in near_in(sorted(w[SHARED:] for w in words)))
    elif kind == "end":
        for u, v in near_in(sorted(w[::-1][SHARED:] for w in words)):
            u, v = u[::-1] + key, v[::-1] + key
            if u[:SHARED] != v[:SHARED]:
                yield u, v
    else:
        for u, v in near_in(sorted(words)):
            if (u[:SHARED] == v[:SHARED]) == (kind == "begin-") and without_one(u, v) == key:
                yield u, v


def near_words(vocabulary: DataFrame, most_words: int = MOST_WORDS) -> DataFrame:
    """(word, near, near_n): both directions of each pair of words that one edit parts. vocabulary: (word, n) of different words of six code points or more, as a written table.

    A partition of over most_words words is dealt anew, by each word without one of the code points
    that may have been edited: words one edit apart share such a rest, and few words can share one (one
    for each place and letter). A pair that shares several is taken at one of them. The keys of such
    partitions are three code points, so the list of them that is sent to all tasks has a bound.
    """
    begin, end = F.substring("word", 1, SHARED), F.substring("word", -SHARED, SHARED)
    sides = F.explode(F.array(F.struct(F.lit("begin").alias("kind"), begin.alias("key")), F.struct(F.lit("end").alias("kind"), end.alias("key"))))
    rows = vocabulary.select("word", "n", sides.alias("k")).select("k.kind", "k.key", "word", "n")
    sizes = rows.groupBy("kind", "key").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > most_words).select("kind", "key")
    large = F.broadcast(written(sizes, "large-partitions"))
    first = F.when(F.col("kind") == "begin", SHARED + 1).otherwise(1)
    last = F.when(F.col("kind") == "begin", F.char_length("word")).otherwise(SHARED)
    rests = F.transform(F.sequence(first, last), lambda i: F.concat(F.substr("word", F.lit(1), i - 1), F.substr("word", i + 1)))
    split = rows.join(large, ["kind", "key"], "left_semi").select(F.concat("kind", F.lit("-")).alias("kind"), F.explode(F.array_distinct(F.concat(rests, F.array("word")))).alias("key"), "word", "n")
    dealt = rows.join(large, ["kind", "key"], "left_anti").unionByName(split)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}
        at: tuple[str, str] | None = None
        out: list[tuple[str, str, int]] = []

        def send() -> pa.RecordBatch:
            word, near, n = zip(*out, strict=True)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(word, pa.string()), pa.array(near, pa.string()), pa.array(n, pa.int64())], names=["word", "near", "near_n"])

        def close() -> None:
            for u, v in pairs_of(*at, list(held)):
                out.append((u, v, held[v]))
                out.append((v, u, held[u]))

        for batch in batches:
            for kind, key, word, n in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if (kind, key) != at:
                    if at is not None:
                        close()
                        if len(out) > 20_000:
                            yield send()
                    held, at = {}, (kind, key)
                held[word] = n
        if at is not None:
            close()
        if out:
            yield send()

    return dealt.repartition("kind", "key").sortWithinPartitions("kind", "key").mapInArrow(run, "word string, near string, near_n long")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): the end of each word's chain of forms, a word without form left out.

    Each round doubles the length of the way gone; a form is at least so many times as frequent as its
    word, so chains are short. Each round is written, so lineage stays short.
    """
    now = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        step = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        now = written(now.join(step, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        if not now.filter("moved").limit(1).count():
            return now.select("word", "root")
        now = now.drop("moved")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 5, factor: int = 5, every: int = 199, most_words: int = MOST_WORDS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for the words of docs with `least` occurrences or more.

    Words are runs of letters, A-Z lower-cased, of six code points or more. form: the most frequent of
    the words one edit away (ties: the first in code-point order) if it is at least `factor` times as
    frequent, else null; root: the end of the chain of forms, the word itself without one; n_near: how
    many words are one edit away. Null and empty texts have no words, repeated rows count each time, an
    empty table gives no rows, and extra columns are ignored. Words of any length are taken whole.
    """
    counts = word_counts(docs, id_col, text_col, every)
    vocabulary = written(counts.filter((F.col("n") >= least) & (F.char_length("word") >= LEAST_LENGTH)), "vocabulary")
    near = near_words(vocabulary, most_words)
    # Of equal counts the least word: strings are ordered by their UTF-8 bytes, as code points are.
    best = near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), "near")).alias("best"))
    joined = vocabulary.join(best, "word", "left")
    enough = -F.col("best.minus") >= factor * F.col("n")
    table = written(
        joined.select("word", F.when(enough, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(enough, -F.col("best.minus")).alias("form_n")),
        "variants",
    )
    found = roots(table.filter("form is not null"))
    return table.join(found, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
