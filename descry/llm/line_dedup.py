"""Line dedup with DataFrame functions only.

Line keys are hashed to 128 bits. Occurrences are range-partitioned by (hash, document) with a
secondary sort by position, so one hash that fills a third of the corpus spans many partitions.
Each sorted run is streamed: an occurrence at the least position of its document counts the
document once for the hash, and the counts are summed map-side first. What comes back per document
is a bitmap of lines to drop, compressed, not text: of its 64-line words only those with a drop are
kept, and a run of equal words is one entry, so a boilerplate text of a million lines has one entry.
The bitmaps of all documents are sent if they are small (measured); else texts are joined with them.

Each row is a document, so equal rows count once each (they are all returned, treated alike). Null
text: one empty line. Null doc_id: an ordinary value, each such row a document. Extra columns of
the input are kept by `dedup_lines` and not used; one named like an output is replaced by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from descry.llm._shared import LOWER_ASCII, UPPER_ASCII, fresh, shuffle_partitions, text_hash, written

#: Bitmaps up to this size go to every task.
SENT_BYTES = 32 << 20
SPACE = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    """The line without white space at both ends, A-Z in lower case."""
    bare = F.btrim(line, F.lit(SPACE))
    ascii_only = F.octet_length(bare) == F.char_length(bare)
    return F.when(ascii_only, F.lower(bare)).otherwise(F.translate(bare, UPPER_ASCII, LOWER_ASCII))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def first_occurrences(lines: DataFrame) -> DataFrame:
    """Of the lines (a, b, id, t, pos) those at the least position of their hash in a document; equal rows each keep theirs.

    The sort is what the rank streams over: a row's rank is 1 as long as no smaller position came before.
    """
    n = shuffle_partitions(lines.sparkSession)
    runs = lines.repartitionByRange(n, "a", "b", "id", "t").sortWithinPartitions("a", "b", "id", "t", "pos")
    return runs.withColumn("nth", F.rank().over(Window.partitionBy("a", "b", "id", "t").orderBy("pos"))).filter("nth = 1")


def drop_bitmaps(docs: DataFrame, min_docs: int, min_chars: int, keep_first: bool, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, t, runs): for each document with a line to drop, its bitmap as runs of equal words; see `words_of`."""
    key = F.transform(lines_of(F.col(text_col)), line_key)
    named = F.transform(key, lambda k: F.when(F.char_length(k) >= min_chars, F.struct(F.xxhash64(k).alias("a"), F.xxhash64(F.lit(1), k).alias("b"))))
    # The text's hash is made below the explode, once for a text and not once for a line.
    keyed = docs.select(F.col(id_col).alias("id"), text_hash(F.col(text_col)).alias("t"), named.alias("keys"))
    lines = keyed.select("id", "t", F.posexplode("keys").alias("pos", "h"))
    lines = written(lines.filter("h is not null").select("id", "t", "pos", "h.a", "h.b"), "lines")
    firsts = first_occurrences(lines)
    common = firsts.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n_docs"), F.min(F.struct("id", "t", "pos")).alias("first")).filter(F.col("n_docs") >= min_docs)
    common = written(common.select("a", "b", "first") if keep_first else common.select("a", "b"), "common-lines")
    hit = lines.join(common, ["a", "b"])
    if keep_first:
        hit = hit.filter(~F.struct("id", "t", "pos").eqNullSafe(F.col("first")))
    # A word can be filled twice by equal rows, so bits are joined by OR.
    bits = hit.groupBy("id", "t", F.expr("pos div 64").cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(pos % 64 as int))")).alias("bits"))
    held = bits.groupBy("id", "t").agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("held"))
    return held.select("id", "t", runs_of(F.col("held")).alias("runs"))


def runs_of(held: Column) -> Column:
    """Runs (first, last, bits) of words in a row with equal bits, of the sorted (word, bits)."""
    follows = lambda x, y: (x["word"] + 1 == y["word"]) & (x["bits"] == y["bits"])
    firsts = F.filter(held, lambda y, i: (i == 0) | ~follows(F.get(held, i - 1), y))
    lasts = F.filter(held, lambda x, i: (i == F.size(held) - 1) | ~follows(x, F.get(held, i + 1)))
    return F.zip_with(firsts, lasts, lambda a, b: F.struct(a["word"].alias("first"), b["word"].alias("last"), a["bits"].alias("bits")))


def words_of(runs: Column) -> Column:
    """The bitmap written out: 64-bit words from line 0 to the last drop; bit p % 64 of word p div 64 is line p."""
    before = lambda i: F.coalesce(F.get(runs, i - 1)["last"], F.lit(-1))
    return F.flatten(F.transform(runs, lambda r, i: F.concat(F.array_repeat(F.lit(0).cast("long"), r["first"] - before(i) - 1), F.array_repeat(r["bits"], r["last"] - r["first"] + 1))))


def dedup_lines(docs: DataFrame, min_docs: int = 2, min_chars: int = 1, keep_first: bool = True, id_col: str = "doc_id", text_col: str = "text", sent_bytes: int = SENT_BYTES) -> DataFrame:
    """docs with n_lines, n_dropped and kept_text.

    Lines whose key has min_chars code points or more and is found in min_docs documents or more
    are dropped: all of them, or with keep_first all but the first by (doc_id, text hash, position).
    """
    own_id, own_t, own_runs, own_words = fresh(docs, "id", "t", "runs", "words")
    maps = written(drop_bitmaps(docs, min_docs, min_chars, keep_first, id_col, text_col), "drop-bitmaps")
    # An entry is a row of two keys, or a run of two places and a word; twice that as a hash table.
    size = maps.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("runs")).alias("runs"), F.sum(F.octet_length(F.col("id").cast("string"))).alias("ids")).first()
    small = 2 * (64 * size["n"] + 40 * (size["runs"] or 0) + (size["ids"] or 0)) <= sent_bytes
    maps = maps.toDF(own_id, own_t, own_runs)
    maps = F.broadcast(maps) if small else maps
    on = F.col(id_col).eqNullSafe(F.col(own_id)) & (text_hash(F.col(text_col)) == F.col(own_t))
    lines = lines_of(F.col(text_col))
    word = lambda p: F.coalesce(F.get(F.col(own_words), F.floor(p / 64).cast("int")), F.lit(0).cast("long"))
    dropped = lambda p: F.call_function("shiftright", word(p), (p % 64).cast("int")).bitwiseAND(F.lit(1)) == 1
    kept = F.filter(lines, lambda _, p: ~dropped(p))
    some = F.col(own_words).isNotNull()
    n_dropped = F.when(some, F.aggregate(own_words, F.lit(0).cast("long"), lambda n, w: n + F.bit_count(w))).otherwise(F.lit(0).cast("long"))
    out = docs.join(maps, on, "left").withColumn(own_words, words_of(F.col(own_runs))).withColumns({
        "n_lines": F.size(lines).cast("long"),
        "n_dropped": n_dropped,
        "kept_text": F.when(some, F.array_join(kept, "\n")).otherwise(F.coalesce(F.col(text_col), F.lit(""))),
    })
    return out.drop(own_id, own_t, own_runs, own_words)
