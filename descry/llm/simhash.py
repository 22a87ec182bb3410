"""SimHash near-dedup by an inverted index of fingerprint bytes with count filtering.

Equal fingerprints are one class from the start, so copies are never paired. Two fingerprints that
differ in at most 2 of 64 bits share at least 6 of their 8 bytes by position (LEAST_SHARED). Each
fingerprint's bytes are ordered from the rarest of the corpus to the most frequent one; by the
guaranteed count, two that share 6 share at least 4 among the 6 rarest of either, and 6 among all 8.
A posting of one byte would hold 1/256 of all fingerprints or more, and of two bytes 1/65,536, so
the index posts a fingerprint under every four of its 6 rarest bytes; the members of a posting with
over `max_posting` are posted anew under every six of all 8. Pairs that meet in a posting are tallied: how many
positional bytes are equal. Those under 6 go, and the rest is verified by differing bits. Members of
a posting of six bytes with over `max_posting` members differ in the two other bytes alone: each posts itself and its
one-bit changes there, and all that share such a post are linked to its smallest, which links
exactly the members within two bits (they have a common neighbour at one bit or less). So nothing
is capped.

Null text: as empty, fingerprint zero. Null doc_id: linked like any, but never a class id unless
the class has no other (then component_id is null). Repeated rows: one result each. Extra columns
are not used.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from descry.llm._shared import LOWER_SPACE, chunks, fresh, text_hash, texts_of, written
from descry.llm.components import components

SHINGLE, SEED, MAX_BITS = 3, 42, 2
#: Bytes by position that fingerprints within MAX_BITS share at least.
BYTES, LEAST_SHARED = 8, 8 - MAX_BITS
#: Bytes of a posting: first, and for the members of postings that are too large.
LEVELS = (4, 6)
#: Members of a posting up to which all pairs are tallied.
MAX_POSTING = 16
#: A fingerprint that more than this share of all rows have is joined apart; there are at most 1 / HOT of them.
HOT = 0.001


def fingerprint(texts: list[bytes], n: int = SHINGLE) -> np.ndarray:
    """64-bit fingerprints: a bit is set if it is in over half the hashes of the text's shingles."""
    hashes: list[int] = []
    counts = np.zeros(len(texts), np.int64)
    digest = xxhash.xxh64_intdigest
    for i, t in enumerate(texts):
        words = t.translate(LOWER_SPACE).split()
        if not words:
            continue
        before = len(hashes)
        if len(words) < n:
            hashes.append(digest(b" ".join(words), SEED))
        else:
            joined = b" ".join(words)
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
            starts = [0, *ends[: len(words) - n].tolist()]
            hashes += [digest(joined[a:b], SEED) for a, b in zip(starts, (ends[n - 1 :] - 1).tolist(), strict=True)]
        counts[i] = len(hashes) - before
    out = np.zeros(len(texts), np.uint64)
    some = np.flatnonzero(counts)
    if len(some):
        first = np.cumsum(counts[some]) - counts[some]
        h = np.array(hashes, np.uint64)
        for bit in range(64):
            ones = np.add.reduceat(((h >> np.uint64(bit)) & np.uint64(1)).astype(np.int64), first)
            out[some] |= (2 * ones > counts[some]).astype(np.uint64) << np.uint64(bit)
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and fp (the fingerprint's 64 bits as a signed long) of each row's whole text."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch, "text")
            fp = [fingerprint(texts[a:b]) for a, b in chunks(texts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(fp).view(np.int64) if fp else [], pa.int64())], names=["id", "fp"])

    return rows.mapInArrow(run, T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("fp", T.LongType())]))


def byte_at(x: Column, i: int) -> Column:
    return F.shiftright(x, 8 * i).bitwiseAND(F.lit(255))


def shared_bytes(a: Column, b: Column) -> Column:
    """The tally of a pair: positional bytes that are equal."""
    return sum((byte_at(a, i) == byte_at(b, i)).cast("int") for i in range(BYTES))


def rarest_first(fps: DataFrame) -> Column:
    """The positions of fp's bytes, the rarest byte of `fps` first; 2,048 counts are all that is gathered."""
    each = fps.select(F.posexplode(F.array(*[byte_at(F.col("fp"), i) for i in range(BYTES)])).alias("position", "byte"))
    counts = [0] * (256 * BYTES)
    for r in each.groupBy("position", "byte").count().collect():
        counts[256 * r["position"] + r["byte"]] = r["count"]
    n = F.lit(counts)
    seen = F.array(*[F.struct(F.get(n, (byte_at(F.col("fp"), i) + 256 * i).cast("int")).alias("n"), F.lit(i).alias("position")) for i in range(BYTES)])
    return F.transform(F.sort_array(seen), lambda x: x["position"])


def posts(fps: DataFrame, level: int) -> DataFrame:
    """(fp, mask, key): fp (with `places`, its positions by rarity) under every `level` of its first bytes.

    Of BYTES - LEAST_SHARED + level first bytes any two that reach the count share `level`.
    """
    prefix = range(BYTES - LEAST_SHARED + level)
    whole = F.transform("places", lambda p: F.call_function("shiftleft", F.lit(255).cast("long"), 8 * p))
    masked = fps.select("fp", whole.alias("byte"))
    masks = F.array(*[reduce(lambda x, y: x.bitwiseOR(y), (F.get("byte", i) for i in chosen)) for chosen in combinations(prefix, level)])
    return masked.select("fp", F.explode(masks).alias("mask")).withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))


def paired(small: DataFrame) -> DataFrame:
    """(a, b) with a < b of all that meet in a posting, tallied and verified where they meet: a posting is one bounded row."""
    members = small.groupBy("mask", "key").agg(F.sort_array(F.collect_list("fp")).alias("m"))
    reached = F.filter("m", lambda y: (y > F.col("a")) & (shared_bytes(y, F.col("a")) >= LEAST_SHARED))
    met = members.select(F.explode("m").alias("a"), "m").select("a", F.explode(reached).alias("b"))
    return met.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS)


def stars(large: DataFrame) -> DataFrame:
    """(a, b) for postings of six bytes: a star for each neighbour at one bit or less in the two bytes left."""
    one_bit = F.expr("transform(filter(sequence(0, 63), i -> (shiftright(mask, i) & 1) = 0), i -> fp ^ shiftleft(1L, i))")
    around = large.select("fp", "mask", F.explode(F.concat(F.array("fp"), one_bit)).alias("post"))
    least = around.groupBy("mask", "post").agg(F.min("fp").alias("a"), F.collect_set("fp").alias("m")).filter(F.size("m") > 1)
    return least.select("a", F.explode("m").alias("b")).filter("a <> b")


def links(fps: DataFrame, max_posting: int = MAX_POSTING) -> DataFrame:
    """(a, b), fingerprints of `fps` (one column fp, distinct) whose closure is that of all pairs within two bits."""
    left = written(fps.select("fp", rarest_first(fps).alias("places")), "fingerprint-bytes")
    out = []
    for level in LEVELS:
        at = posts(left, level)
        sizes = at.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        at = written(at.join(written(sizes, "postings"), ["mask", "key"]), "posts")
        out.append(paired(at.filter(F.col("n") <= max_posting)))
        large = at.filter(F.col("n") > max_posting)
        if large.isEmpty():
            break
        if level == LEVELS[-1]:
            out.append(stars(large))
        else:
            left = written(left.join(large.select("fp").distinct(), "fp", "left_semi"), "fingerprint-bytes")
    return reduce(DataFrame.unionByName, out).distinct()


def roots(fps: DataFrame) -> DataFrame:
    """(fp, root) of the distinct fingerprints `fps`: the least of all that links reach."""
    joined = components(written(links(fps), "links"), "a", "b")
    # Only those with a link are in `joined`; the rest stands alone.
    return fps.join(joined.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, fingerprint (16 hex digits) and component_id of each row: the smallest id reachable by links."""
    rows = written(fingerprints(docs, id_col, text_col), "fingerprints")
    classes = written(rows.groupBy("fp").agg(F.min("id").alias("least_id"), F.count(F.lit(1)).alias("n")), "classes")
    labelled = written(classes.join(roots(classes.select("fp")), "fp"), "roots")
    least = labelled.groupBy("root").agg(F.min("least_id").alias("component_id"))
    by_fp = written(labelled.join(least, "root").select("fp", "component_id", "n"), "labels")
    # Copies of one text may be a third of all rows: the few such fingerprints are sent, not shuffled to.
    total = classes.agg(F.sum("n").alias("n")).first()["n"] or 0
    hot = F.col("n") > max(HOT * total, MAX_POSTING)
    some, rest = F.broadcast(by_fp.filter(hot)), by_fp.filter(~hot)
    told = rows.join(some, "fp").unionByName(rows.join(some, "fp", "left_anti").join(rest, "fp"))
    return told.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs for each class of near duplicates, with all its columns.

    It is that of the least id (null ids last), then of the least text hash; of rows equal in both
    one stays, that of the least hash of its other columns.
    """
    t, nth = fresh(docs, "t", "nth")
    hashed = docs.withColumn(t, text_hash(F.col(text_col)))
    rows = written(fingerprints(hashed.select(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col(t).alias("t")).alias("at"), text_col), "at", text_col), "fingerprints")
    classes = written(rows.groupBy("fp").agg(F.min("id").alias("at")), "classes")
    first = classes.join(roots(classes.select("fp")), "fp").groupBy("root").agg(F.min("at").alias("at"))
    # A document has one class, so each (id, t) is here once.
    own_id, own_t = fresh(hashed, "own_id", "own_t")
    first = written(first.select(F.col("at.id").alias(own_id), F.col("at.t").alias(own_t)), "first")
    kept = hashed.join(first, F.col(id_col).eqNullSafe(F.col(own_id)) & (F.col(t) == F.col(own_t)), "left_semi")
    others = [c for c in docs.columns if c not in (id_col, text_col)] or [t]
    once = Window.partitionBy(id_col, t).orderBy(F.xxhash64(*[F.col(c) for c in others]))
    return kept.withColumn(nth, F.row_number().over(once)).filter(F.col(nth) == 1).select(*docs.columns)
