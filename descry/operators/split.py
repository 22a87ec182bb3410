"""Reproducible folds by hash rank: the same ids fall into the same folds in any run and engine."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from descry.operators.order import bin_of, quantile_edges


def hash_key(seed: int, key: str = "id") -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")).cast("binary"))


def ranked(df: DataFrame, seed: int, strata: Sequence[str] = (), buckets: int = 1 << 16) -> DataFrame:
    """df with `rank` from 0 on by hash within each stratum.

    No task sees a whole stratum: rows are ranked within (stratum, leading part of the hash), of
    which there are `buckets` (a power of 16; 65,536 leave a few million rows in each of 10^11), and
    the buckets' offsets, at most that many for each stratum, are added. Ranks don't depend on it.
    """
    digits = max(1, math.ceil(round(math.log(buckets, 16), 6)))
    hashed = df.withColumn("__h", hash_key(seed)).withColumn("__b", F.substring("__h", 1, digits))
    sizes = hashed.groupBy(*strata, "__b").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*strata).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1) if strata else Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("__o", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    same = [F.col(f"a.{s}").eqNullSafe(F.col(f"o.{s}")) for s in [*strata, "__b"]]
    on = same[0]
    for s in same[1:]:
        on = on & s
    joined = hashed.alias("a").join(offsets.alias("o"), on).select("a.*", "o.__o")
    inner = F.row_number().over(Window.partitionBy(*strata, "__b").orderBy("__h", "id"))
    return joined.withColumn("rank", inner - 1 + F.col("__o")).drop("__h", "__b", "__o")


def k_folds(df: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """df with `fold` 0..k-1; sizes differ by one at most."""
    return ranked(df, seed).withColumn("fold", (F.col("rank") % k).cast("int")).drop("rank")


def stratified_folds(df: DataFrame, k: int, strata: Sequence[str], seed: int = 42) -> DataFrame:
    """Folds within each stratum; plain folds if a stratum has fewer than k rows."""
    least = df.groupBy(*strata).count().agg(F.min("count").alias("n")).first()["n"]
    if least is None or least < k:
        return k_folds(df, k, seed)
    return ranked(df, seed, strata).withColumn("fold", (F.col("rank") % k).cast("int")).drop("rank")


def binned_folds(df: DataFrame, k: int, bins: int, seed: int = 42) -> DataFrame:
    """Folds of a continuous target, stratified by its quantile bins."""
    edges = quantile_edges(df, "property", bins)
    return stratified_folds(df.withColumn("bin", bin_of(F.col("property"), edges)), k, ["bin"], seed)


def set_aside_folds(df: DataFrame, members: DataFrame, k: int, seed: int = 42, strata: Sequence[str] = ()) -> DataFrame:
    """Members of a second dataset and the others folded separately; plain folds if a side has fewer than k rows."""
    marked = df.join(members.select("id").distinct().withColumn("is_member", F.lit(True)), "id", "left").withColumn("is_member", F.coalesce("is_member", F.lit(False)))
    sides = {r["is_member"]: r["count"] for r in marked.groupBy("is_member").count().collect()}
    if min(sides.get(True, 0), sides.get(False, 0)) < k:
        return k_folds(marked, k, seed)
    return stratified_folds(marked, k, ["is_member", *strata], seed)


def hash_split(df: DataFrame, test: float, seed: int = 42) -> DataFrame:
    """split_num 1 for about a share `test` of the rows, by hash; 0 for the rest."""
    unit = F.conv(F.substring(hash_key(seed), 1, 8), 16, 10).cast("long") / float(1 << 32)
    return df.withColumn("split_num", F.when(unit < test, 1).otherwise(0))


def assignments(folded: DataFrame, first_id: int = 2) -> DataFrame:
    """(id, split_num, splitting_id): every row once for each fold, 1 where it is held out; splittings from first_id on."""
    return folded.select("id", "fold", F.explode(F.sequence(F.lit(0), F.lit(int(folded.agg(F.max("fold")).first()[0] or 0)))).alias("k")).select("id", F.when(F.col("fold") == F.col("k"), 1).otherwise(0).alias("split_num"), (F.col("k") + first_id).alias("splitting_id"))


def fold_by_label(df: DataFrame, label: str, held_out: str) -> tuple[DataFrame, DataFrame]:
    """(training, held out) by a fold label in the data; rows without a label train."""
    out = F.coalesce(F.col(label) == held_out, F.lit(False))
    return df.filter(~out), df.filter(out)


def inner_folds(df: DataFrame, k: int, strata: Sequence[str] = (), seed: int = 42) -> DataFrame:
    """Folds of the training part (split_num 0) of a hold-out."""
    own = df.filter("split_num = 0")
    return stratified_folds(own, k, strata, seed) if strata else k_folds(own, k, seed)


def checked_assignments(folded: DataFrame, first_id: int = 2) -> DataFrame:
    """Assignments whose ids are whole numbers; another id, or none, is an error when the rows are made."""
    whole = F.col("id").cast("string").try_cast("long")
    id_ = F.when(whole.isNotNull(), whole).otherwise(F.raise_error(F.concat(F.lit("no whole number for an id: "), F.coalesce(F.col("id").cast("string"), F.lit("null")))).cast("long"))
    return assignments(folded, first_id).withColumn("id", id_)


def predefined(df: DataFrame, folds: DataFrame) -> DataFrame:
    """cv_fold from a table; -1, always in training, for rows in no fold."""
    return df.join(folds.select("id", F.col("fold").alias("cv_fold")), "id", "left").withColumn("cv_fold", F.coalesce("cv_fold", F.lit(-1)))


def shuffled_target(df: DataFrame, seed: int) -> DataFrame:
    """The target permuted: rows in one hash order take the targets of another."""
    a = ranked(df, seed).select("id", "features", "rank")
    b = ranked(df, seed + 1).select("property", "rank")
    return a.join(b, "rank").drop("rank")
