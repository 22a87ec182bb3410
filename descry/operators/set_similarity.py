"""Records of like word sets by exact Jaccard similarity, from an index of each record's rarest words."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from descry.operators.metric_index import written

#: The thresholds tried unless others are given, highest first.
STEPS = tuple(round(0.95 - 0.02 * i, 2) for i in range(48))
#: Joins at most, each for a part of the thresholds.
STAGES = 5
#: Records under one word that one task may join; a more frequent word is dealt in parts.
SALT_ROWS = 100_000


def ordered(df: DataFrame, counts: DataFrame) -> DataFrame:
    """(id, n, words): each row's different words with their counts over the records, rarest first; rows without words are left out."""
    each = df.select("id", F.explode(F.array_distinct("words")).alias("word")).filter("word is not null")
    known = each.join(counts, "word", "left").select("id", F.struct(F.coalesce("count", F.lit(0)).alias("count"), "word").alias("w"))
    return known.groupBy("id").agg(F.array_sort(F.collect_list("w")).alias("words")).select("id", F.size("words").alias("n"), "words")


def _prefixes(df: DataFrame, at_least: float, key: str, salt: Column) -> DataFrame:
    """A row for each of the words of which two sets of such a similarity share one: all but the last ceil(t n) - 1 in the common order."""
    reach = F.col("n") - F.ceil(F.col("n") * at_least - 1e-9) + 1
    own = df.select(F.col("id").alias(key), F.col("n").alias(f"n_{key}"), F.posexplode(F.slice("words", 1, F.greatest(reach, F.lit(1)))).alias(f"at_{key}", "w"))
    return own.select(key, f"n_{key}", f"at_{key}", F.col("w.word").alias("word"), F.ceil(F.col("w.count") / F.lit(SALT_ROWS)).alias("parts")).withColumn("part", salt).drop("parts")


def pairs_from(queries: DataFrame, records: DataFrame, at_least: float) -> DataFrame:
    """(q, r, sim) of all pairs of ordered rows whose similarity is at_least or more, each once.

    Pairs meet at rare words, if their sizes allow the similarity and what is left of both sets after
    the place where they meet does; then their sets are compared. A word of very many records is dealt
    in parts by record, and a query goes to each.
    """
    q = _prefixes(queries, at_least, "q", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("parts") - 1, F.lit(0)))))
    r = _prefixes(records, at_least, "r", F.pmod(F.xxhash64("r"), F.greatest(F.col("parts"), F.lit(1))))
    n_q, n_r = F.col("n_q"), F.col("n_r")
    fits = (n_r >= n_q * at_least - 1e-9) & (n_q >= n_r * at_least - 1e-9)
    most = F.least(n_q - F.col("at_q"), n_r - F.col("at_r"))
    enough = most * (1 + at_least) >= at_least * (n_q + n_r) - 1e-9
    met = q.join(r, ["word", "part"]).filter(fits & enough).select("q", "r").distinct()
    sets = lambda d, key: d.select(F.col("id").alias(key), F.col("n").alias(f"n_{key}"), F.transform("words", lambda w: w["word"]).alias(f"w_{key}"))
    both = met.join(sets(queries, "q"), "q").join(sets(records, "r"), "r").withColumn("both", F.size(F.array_intersect("w_q", "w_r")))
    return both.select("q", "r", (F.col("both") / (n_q + n_r - F.col("both"))).alias("sim")).filter(F.col("sim") >= at_least)


def similar_pairs(queries: DataFrame, records: DataFrame, at_least: int, thresholds: Sequence[float] | None = None) -> DataFrame:
    """(query_id, threshold, record_id, sim): each query's records at the highest threshold that at_least of them reach, else at the lowest.

    Both need (id, words: array of text), each id once. Thresholds are tried from the highest down, a
    part of them at a time, and only queries that are still short go on. Queries without any record at
    the lowest threshold have no rows, nor have rows without words.
    """
    steps = sorted(thresholds or STEPS, reverse=True)
    each = -(-len(steps) // STAGES)
    counts = written(records.select("id", F.explode(F.array_distinct("words")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("count")))
    left, known = written(ordered(queries, counts)), written(ordered(records, counts))
    out = []
    for end in range(each, len(steps) + each, each):
        tried = steps[:end]
        pairs = written(pairs_from(left, known, tried[-1]))
        reached = pairs.groupBy("q").agg(*[F.count_if(F.col("sim") >= t).alias(f"t{i}") for i, t in enumerate(tried)])
        first = [F.when(F.col(f"t{i}") >= at_least, F.lit(t)) for i, t in enumerate(tried)]
        last = end >= len(steps)
        threshold = F.coalesce(*first, F.lit(tried[-1] if last else None).cast("double"))
        done = written(reached.select("q", threshold.alias("threshold")).filter("threshold is not null"))
        out.append(pairs.join(done, "q").filter("sim >= threshold").select(F.col("q").alias("query_id"), "threshold", F.col("r").alias("record_id"), "sim"))
        if last:
            break
        left = written(left.join(done, left["id"] == done["q"], "left_anti"))
        if left.isEmpty():
            break
    return reduce(DataFrame.unionByName, out)


def similar_records(queries: DataFrame, records: DataFrame, at_least: int, thresholds: Sequence[float] | None = None) -> DataFrame:
    """(query_id, threshold, n, hits): the rows of similar_pairs, the ids of each query's records in one list, most similar first."""
    hits = F.array_sort(F.collect_list(F.struct((-F.col("sim")).alias("minus"), "record_id")))
    out = similar_pairs(queries, records, at_least, thresholds).groupBy("query_id").agg(F.first("threshold").alias("threshold"), hits.alias("h"))
    return out.select("query_id", "threshold", F.size("h").alias("n"), F.transform("h", lambda x: x["record_id"]).alias("hits"))
