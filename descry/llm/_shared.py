"""What the text operators share: the shared folder, packed arrays and word tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

#: Bytes A-Z to a-z, all else kept.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: The same, with the six ASCII white-space bytes made spaces.
LOWER_SPACE = bytes(32 if b == 32 or 9 <= b <= 13 else LOWER[b] for b in range(256))
UPPER_ASCII, LOWER_ASCII = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of text handled at once inside a task.
CHUNK = 2 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or one of our own in local mode."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = tempfile.mkdtemp(prefix="spark-descry-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


#: Paths of the tables written so far, for `clear`.
_written: list[str] = []


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: its lineage ends there. `clear` removes it."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> int:
    """Removes the tables that `written` made so far, once no result that reads them is needed; how many."""
    n = len(_written)
    while _written:
        path = spark._jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return n


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened until no column of df has them."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        out.append(n)
        taken.add(n.lower())
    return out


def text_hash(text: Column) -> Column:
    """Tells the texts of one doc_id apart; with doc_id it names a document."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def level_of(count: str) -> Column:
    """A count without its bits after the eight leading ones, so there are some thousand levels at any size."""
    shift = F.greatest(F.length(F.bin(count)) - 8, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", F.col(count), shift), shift)


def most_frequent(counts: DataFrame, word: str, count: str, most: int) -> list[Row]:
    """The `most` rows of largest count (ties by word), in that order; counts should be a written table, as it is read twice.

    A histogram first says which counts are large enough; tasks then answer with rows of those only, not with `most` rows each.
    """
    levels = counts.groupBy(level_of(count).alias("level")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("level")).collect()
    held, least = 0, 0
    for r in levels:
        held, least = held + r["n"], r["level"]
        if held >= most:
            break
    return counts.filter(F.col(count) >= least).orderBy(F.desc(count), word).limit(most).collect()


def most_frequent_bytes(counts: DataFrame, word: str, count: str, most_bytes: int) -> list[Row]:
    """Rows of the largest counts, by count and then word, as many whole levels of counts as have words of `most_bytes` UTF-8 bytes in all or less."""
    levels = counts.groupBy(level_of(count).alias("level")).agg(F.sum(F.octet_length(word)).alias("n")).orderBy(F.desc("level")).collect()
    held, least = 0, None
    for r in levels:
        held += r["n"]
        if held > most_bytes:
            break
        least = r["level"]
    return [] if least is None else counts.filter(F.col(count) >= least).orderBy(F.desc(count), word).collect()


def texts_of(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """The column's UTF-8 bytes; null is empty."""
    col = batch.column(batch.schema.get_field_index(column))
    return [b"" if x is None else x for x in col.cast(pa.binary()).to_pylist()]


def chunks(texts: list[bytes], most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts of about `most` bytes each (one longer text is a range of its own)."""
    at, held = 0, 0
    for i, t in enumerate(texts):
        if i > at and held + len(t) > most:
            yield at, i
            at, held = i, 0
        held += len(t)
    if at < len(texts):
        yield at, len(texts)


def pack(*arrays: np.ndarray) -> bytes:
    """Non-negative integers below 2**32, by planes of bytes, compressed."""
    out = []
    for a in arrays:
        a = np.ascontiguousarray(a, dtype="<u4")
        out += [np.array([a.size], "<u8").tobytes(), np.ascontiguousarray(a.view(np.uint8).reshape(-1, 4).T).tobytes()]
    return zstandard.ZstdCompressor(level=3).compress(b"".join(out))


def unpack(data: bytes) -> list[np.ndarray]:
    raw, at, out = zstandard.ZstdDecompressor().decompress(data), 0, []
    while at < len(raw):
        n = int(np.frombuffer(raw, "<u8", 1, at)[0])
        planes = np.frombuffer(raw, np.uint8, 4 * n, at + 8).reshape(4, n)
        out.append(np.ascontiguousarray(planes.T).view("<u4").ravel())
        at += 8 + 4 * n
    return out


def pack_words(words: list[bytes]) -> bytes:
    head = np.array([len(words), *map(len, words)], "<u4").tobytes()
    return zstandard.ZstdCompressor(level=3).compress(head + b"".join(words))


def unpack_words(data: bytes) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n = int(np.frombuffer(raw, "<u4", 1)[0])
    ends = 4 + 4 * n + np.cumsum(np.frombuffer(raw, "<u4", n, 4), dtype=np.int64)
    starts = [4 + 4 * n, *ends[:-1].tolist()]
    return [raw[a:b] for a, b in zip(starts, ends.tolist(), strict=False)] if n else []


_BASE = np.uint64(0x9E3779B97F4A7C15)
_powers: tuple[np.ndarray, np.ndarray] | None = None


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2**64."""
    global _powers
    if _powers is None or len(_powers[0]) < n:
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        tables = []
        for b in (_BASE, inverse):
            p = np.full(n, b, np.uint64)
            p[0] = 1
            tables.append(np.multiply.accumulate(p))
        _powers = tables[0], tables[1]
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return h ^ (h >> np.uint64(29))


class Words:
    """The words of some texts laid end to end: byte ranges, hashes, and each text's range of words.

    Equal words have equal hashes; different words may share one, so hits are checked on `buf`.
    """

    def __init__(self, texts: list[bytes], is_word: np.ndarray):
        """texts: already folded to one case; is_word: 256 flags, false for what parts words."""
        self.buf = b" ".join(texts) + b" "
        raw = np.frombuffer(self.buf, np.uint8)
        inside = is_word[raw]
        edge = np.flatnonzero(np.diff(inside, prepend=False))
        self.start, self.end = edge[::2], edge[1::2]
        ends = np.cumsum([len(t) + 1 for t in texts])
        first = np.searchsorted(self.start, np.concatenate([[0], ends]))
        self.first, self.count = first[:-1], np.diff(first)
        self.hash = np.empty(len(self.start), np.uint64)
        for a in range(0, len(self.start), 1 << 18):
            b = min(a + (1 << 18), len(self.start))
            lo, hi = int(self.start[a]), int(self.end[b - 1])
            power, inverse = _power_tables(hi - lo + 1)
            sums = np.zeros(hi - lo + 1, np.uint64)
            np.cumsum((raw[lo:hi].astype(np.uint64) + np.uint64(1)) * power[: hi - lo], out=sums[1:])
            s, e = self.start[a:b] - lo, self.end[a:b] - lo
            self.hash[a:b] = mix((sums[e] - sums[s]) * inverse[s] + (e - s).astype(np.uint64))

    def grams(self, k: int) -> np.ndarray:
        """Hash of the k words from each word on, over the ends of texts too; empty if fewer than k."""
        n = len(self.hash) - k + 1
        if n <= 0:
            return np.empty(0, np.uint64)
        out = np.zeros(n, np.uint64)
        for j in range(k):
            out = out * _BASE + self.hash[j : j + n]
        return mix(out)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first)), self.count)

    def joined(self, a: int, n: int) -> bytes:
        """n words from word a on, parted by one space."""
        s, e = self.start[a : a + n].tolist(), self.end[a : a + n].tolist()
        return b" ".join([self.buf[x:y] for x, y in zip(s, e, strict=True)])


class Member:
    """Vectorised membership in a fixed set of 64-bit hashes: a 2**16 bit table, then a sorted search."""

    def __init__(self, values: np.ndarray):
        self.values = np.unique(values.astype(np.uint64))
        self.table = np.zeros(1 << 16, bool)
        self.table[(self.values & np.uint64(0xFFFF)).astype(np.int64)] = True

    def find(self, h: np.ndarray) -> np.ndarray:
        """Positions in h of members."""
        if not len(self.values):
            return np.empty(0, np.int64)
        at = np.flatnonzero(self.table[(h & np.uint64(0xFFFF)).astype(np.int64)])
        where = np.minimum(np.searchsorted(self.values, h[at]), len(self.values) - 1)
        return at[self.values[where] == h[at]]
