"""Benchmark decontamination by winnowing.

Of every 9 consecutive 5-gram hashes of words the least is kept; 9 of them span exactly 13 words,
so a document and a benchmark item that share 13 words share a kept hash. Hits are extended: each
13-word window around a hit is compared word by word with the benchmark's windows. Items of fewer
words are looked for as whole n-grams of their length.

A benchmark of up to `most_bytes` of text (its size is measured first) is sent to every task and
the documents are not shuffled. A larger one is joined: kept hashes against kept hashes, then the
windows around the hits against the benchmark's windows.

A document is a doc_id with its text; equal rows are treated alike and all returned. Null text: no
words, never contaminated. Null item text: an item without windows. Null item_id: not counted
among items, but its windows hit. Extra columns are not used. Empty benchmark: nothing is hit.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from descry.llm._shared import LOWER, Member, Words, chunks, text_hash, texts_of

WINDOW, GRAM = 13, 5
#: Bytes of benchmark text up to which it is sent to the tasks.
SENT_BYTES = 2 << 20
#: What a word is made of once A-Z is lower case: digits, a-z and all beyond ASCII.
IS_WORD = np.array([48 <= b <= 57 or 97 <= b <= 122 or b >= 128 for b in range(256)])


def words_of(texts: list[bytes]) -> Words:
    return Words([t.translate(LOWER) for t in texts], IS_WORD)


def winnow(w: Words) -> np.ndarray:
    """The least of the 9 5-gram hashes that begin within each run of 13 words."""
    g, n = w.grams(GRAM), WINDOW - GRAM + 1
    if len(g) < n:
        return np.empty(0, np.uint64)
    least = g[: len(g) - n + 1].copy()
    for j in range(1, n):
        np.minimum(least, g[j : len(g) - n + 1 + j], out=least)
    return least


class Windows:
    """The windows of benchmark items: kept hashes, and each window's words with its items."""

    def __init__(self, items: list[tuple[object, bytes]]):
        self.items_of: dict[bytes, list] = {}
        self.short: dict[int, Member] = {}
        kept, short = [], {}
        for item, text in items:
            w = words_of([text])
            n = len(w.start)
            size = min(n, WINDOW)
            for a in range(n - size + 1 if n else 0):
                owners = self.items_of.setdefault(w.joined(a, size), [])
                if not owners or owners[-1] != item:
                    owners.append(item)
            if n >= WINDOW:
                kept.append(winnow(w))
            elif n:
                short.setdefault(n, []).append(w.grams(n))
        self.kept = Member(np.concatenate(kept) if kept else np.empty(0, np.uint64))
        self.short = {n: Member(np.concatenate(h)) for n, h in short.items()}

    def occurrences(self, w: Words) -> Iterator[tuple[int, int, list]]:
        """(first word, words, items) of every window found; never over the end of a text."""
        text = w.text_of_word()
        for size, at in [(WINDOW, self.kept.find(winnow(w))), *((n, m.find(w.grams(n))) for n, m in self.short.items())]:
            at = at[text[at] == text[at + size - 1]]
            for a in at.tolist():
                if (items := self.items_of.get(w.joined(a, size))) is not None:
                    yield a, size, items


#: The index that this worker made last, kept from one task to the next.
_index: dict[str, Windows] = {}


def indexed(name: str, items: list[tuple[object, bytes]]) -> Windows:
    if name not in _index:
        _index.clear()
        _index[name] = Windows(items)
    return _index[name]


def _sha(items: set) -> str:
    return hashlib.sha256(",".join(sorted(str(x) for x in items if x is not None)).encode()).hexdigest()


def verdict(n_hit, n_words):
    return (n_hit > 0) & (20 * n_hit >= n_words)


def _fields(id_type: T.DataType) -> T.StructType:
    return T.StructType([T.StructField("id", id_type), T.StructField("t", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("n_items", T.LongType()), T.StructField("items_sha256", T.StringType())])


def _by_sending(rows: DataFrame, bench: DataFrame) -> DataFrame:
    items = [(r["item"], b"" if r["text"] is None else r["text"].encode()) for r in bench.collect()]
    sent, name = rows.sparkSession.sparkContext.broadcast(items), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = indexed(name, sent.value)
        for batch in batches:
            texts = texts_of(batch, "text")
            n_words, n_hit, found = [], [], [set() for _ in texts]
            for lo, hi in chunks(texts):
                w = words_of(texts[lo:hi])
                text, hit = w.text_of_word(), np.zeros(len(w.start) + 1, np.int64)
                for a, size, items in windows.occurrences(w):
                    hit[a] += 1
                    hit[a + size] -= 1
                    found[lo + int(text[a])].update(items)
                inside = np.cumsum(hit)[:-1] > 0
                n_words += w.count.tolist()
                n_hit += np.bincount(text[inside], minlength=hi - lo).tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array([len(f - {None}) for f in found], pa.int64()), pa.array(map(_sha, found), pa.string())], names=["id", "t", "n_words", "n_hit", "n_items", "items_sha256"])

    return rows.mapInArrow(run, _fields(rows.schema["id"].dataType))


def _by_joining(rows: DataFrame, bench: DataFrame) -> DataFrame:
    id_type, item_type = rows.schema["id"].dataType, bench.schema["item"].dataType
    lengths = sorted(bench.select(_n_words("text").alias("n")).filter(f"n > 0 and n < {WINDOW}").distinct().toPandas()["n"].tolist())

    def windows(w: Words, runs: bool) -> Iterator[tuple[int, int, int, int]]:
        """(hash, first word, windows in a row with that hash, words in each)."""
        text = w.text_of_word()
        for size, h in [(WINDOW, winnow(w)), *((n, w.grams(n)) for n in lengths)]:
            at = np.arange(len(h))
            at = at[text[at] == text[at + size - 1]] if len(h) else at
            if not runs and size < WINDOW:  # an item's windows: whole short items only
                at = at[w.count[text[at]] == size]
            new = np.flatnonzero(np.concatenate([[True], (h[at[1:]] != h[at[:-1]]) | (at[1:] != at[:-1] + 1)])) if len(at) else at
            for a, b in zip(new.tolist(), [*new[1:].tolist(), len(at)], strict=False):
                yield int(h[at[a]].view(np.int64)), int(at[a]), b - a, size

    def posts(key: str, extra: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = texts_of(batch, "text")
                for lo, hi in chunks(texts):
                    w = words_of(texts[lo:hi])
                    text = w.text_of_word()
                    found = list(windows(w, extra))
                    doc = pa.array([lo + int(text[a]) for _, a, _, _ in found], pa.int64())
                    start = [a - int(w.first[text[a]]) for _, a, _, _ in found]
                    span = [[w.joined(a + i, size).decode() for i in range(n)] for _, a, n, size in found]
                    own = [batch.column(batch.schema.get_field_index(c)).take(doc) for c in ((key, "t") if extra else (key,))]
                    names = [key, "t"] if extra else [key]
                    yield pa.RecordBatch.from_arrays([*own, pa.array([f[0] for f in found], pa.int64()), pa.array(start, pa.int64()), pa.array([f[3] for f in found], pa.int64()), pa.array(span, pa.list_(pa.string()))], names=[*names, "h", "start", "size", "spans"])

        return run

    tail = "h long, start long, size long, spans array<string>"
    doc_posts = rows.mapInArrow(posts("id", True), T.StructType([T.StructField("id", id_type), T.StructField("t", T.LongType()), *T.StructType.fromDDL(tail).fields]))
    item_posts = bench.mapInArrow(posts("item", False), T.StructType([T.StructField("item", item_type), *T.StructType.fromDDL(tail).fields]))
    owners = item_posts.select("item", F.explode("spans").alias("span")).distinct()
    near = doc_posts.join(item_posts.select("h", "size").distinct(), ["h", "size"], "left_semi")
    spans = near.select("id", "t", "start", "size", F.posexplode("spans").alias("i", "span")).select("id", "t", (F.col("start") + F.col("i")).alias("start"), "size", "span")
    hits = spans.join(owners.select("span").distinct(), "span", "left_semi")
    items = hits.select("id", "t", "span").distinct().join(owners, "span").groupBy("id", "t").agg(F.array_sort(F.collect_set(F.col("item").cast("string"))).alias("items"))
    # Runs of hit words: each occurrence adds the words after the furthest end before it.
    places = hits.groupBy("id", "t").agg(F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("size")).alias("stop")))).alias("p"))
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
    step = lambda acc, x: F.struct((acc["n"] + F.greatest(F.lit(0).cast("long"), x["stop"] - F.greatest(acc["end"], x["start"]))).alias("n"), F.greatest(acc["end"], x["stop"]).alias("end"))
    n_hit = places.select("id", "t", F.aggregate("p", zero, step, lambda acc: acc["n"]).alias("n_hit"))
    found = n_hit.alias("h").join(items.alias("i"), F.expr("h.id <=> i.id and h.t = i.t"), "left").select("h.id", "h.t", "n_hit", "items")
    counted = rows.select("id", "t", _n_words("text").alias("n_words"))
    out = counted.alias("c").join(found.alias("f"), F.expr("c.id <=> f.id and c.t = f.t"), "left")
    items = F.coalesce("f.items", F.array().cast("array<string>"))
    return out.select("c.id", "c.t", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"))


def _n_words(text: str):
    return F.size(F.array_remove(F.split(F.coalesce(F.col(text), F.lit("")), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), "")).cast("long")


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", most_bytes: int = SENT_BYTES) -> DataFrame:
    """id, text_hash, n_words, n_hit, n_items, items_sha256 and contaminated of each row.

    n_hit: words inside any occurrence of a benchmark window. contaminated: these are at least one
    and at least a twentieth of the words. text_hash tells texts of one id apart.
    """
    rows = docs.select(F.col(id_col).alias("id"), text_hash(F.col(text_col)).alias("t"), F.col(text_col).cast("string").alias("text"))
    bench = benchmark.select(F.col(item_col).alias("item"), F.col(item_text).cast("string").alias("text"))
    size = bench.agg(F.coalesce(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + F.coalesce(F.octet_length(F.col("item").cast("string")), F.lit(0)) + 64), F.lit(0)).alias("n")).first()["n"]
    found = _by_sending(rows, bench) if size <= most_bytes else _by_joining(rows, bench)
    return found.withColumn("contaminated", verdict(F.col("n_hit"), F.col("n_words"))).withColumnsRenamed({"id": id_col, "t": "text_hash"})
