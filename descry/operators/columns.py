"""Screens over descriptor columns, held as names (idx, name) beside an array<double> of features."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from descry.operators.linalg import gram
from descry.sources.tables import shared_dir


def long_form(df: DataFrame) -> DataFrame:
    """(id, idx, x) of every feature."""
    return df.select("id", F.posexplode("features").alias("idx", "x"))


def feature_stats(df: DataFrame) -> DataFrame:
    """One row for each feature: counts, moments, extremes and positives, by one aggregate with map-side sums."""
    x = F.col("x")
    finite = F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)
    return long_form(df).groupBy("idx").agg(
        F.count(F.lit(1)).alias("n"),
        F.count(finite).alias("n_valid"),
        F.avg(finite).alias("mean"),
        F.stddev_pop(finite).alias("std_pop"),
        F.stddev_samp(finite).alias("std_samp"),
        F.min(finite).alias("least"),
        F.max(finite).alias("most"),
        F.count_if(finite != 0).alias("n_nonzero"),
        F.count_if(finite > 0).alias("n_positive"),
        F.coalesce(F.min(F.when(finite > 0, finite)), F.lit(0.0)).alias("least_positive"),
    )


def constant_or_missing(stats: DataFrame) -> DataFrame:
    """Features with a missing value or a single one."""
    return stats.filter((F.col("n_valid") < F.col("n")) | (F.coalesce(F.col("std_samp"), F.lit(0.0)) == 0)).select("idx")


def nearly_constant(stats: DataFrame) -> DataFrame:
    return stats.filter(F.col("std_samp") < F.col("mean") * 1e-6).select("idx")


def all_zero(stats: DataFrame) -> DataFrame:
    return stats.filter(F.coalesce(F.col("n_nonzero"), F.lit(0)) == 0).select("idx")


def valid_in_both(train: DataFrame, test: DataFrame) -> DataFrame:
    """Features without a missing or infinite value in either set."""
    whole = lambda s: s.filter(F.col("n_valid") == F.col("n")).select("idx")
    return whole(train).join(whole(test), "idx", "left_semi")


def named_like(names: DataFrame, regex: str) -> DataFrame:
    return names.filter(F.lower("name").rlike(regex)).select("idx")


LOGP, LOGP_SPLIT, ATOM_COUNT = "logp", "log[_ ]?p", "_acnt"


def between(names: DataFrame, start: str, stop: str, inclusive: bool = True) -> DataFrame:
    """Names from start to stop by position, whichever comes first; complement by anti join."""
    ends = names.filter(F.col("name").isin(start, stop)).agg(F.min("idx").alias("a"), F.max("idx").alias("b"))
    inside = F.col("idx").between(F.col("a"), F.col("b")) if inclusive else (F.col("idx") > F.col("a")) & (F.col("idx") < F.col("b"))
    return names.join(F.broadcast(ends)).filter(inside).select("idx", "name")  # one row is broadcast


def positions(names: DataFrame, wanted: Sequence[str]) -> list[int]:
    """Positions of wanted names in their order; a missing name is an error."""
    at = {r["name"]: r["idx"] for r in names.filter(F.col("name").isin(*wanted)).collect()}
    if missing := [w for w in wanted if w not in at]:
        raise ValueError(f"no such feature: {', '.join(missing)}")
    return [at[w] for w in wanted]


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once a row: as a lambda's variable it is not copied into an inner lambda."""
    return F.element_at(F.transform(F.array(value), use), 1)


def uses(idx: Sequence[int]) -> Column:
    """Whether a row has a value that is not zero at one of the positions."""
    return let(F.col("features"), lambda f: F.exists(F.array(*map(F.lit, idx)), lambda i: F.coalesce(F.get(f, i), F.lit(0.0)) != 0))


def gather(df: DataFrame, idx: Sequence[int]) -> DataFrame:
    """Only the features at the given positions, in that order."""
    at = F.array(*map(F.lit, idx)) if idx else F.array().cast("array<int>")
    return df.withColumn("features", let(F.col("features"), lambda f: F.transform(at, lambda i: F.get(f, i))))


def keep(df: DataFrame, names: DataFrame, dropped: Sequence[int]) -> tuple[DataFrame, DataFrame]:
    """Rows and names without the dropped positions; positions are dealt anew."""
    left = [r for r in names.orderBy("idx").collect() if r["idx"] not in set(dropped)]
    fresh = df.sparkSession.createDataFrame([(i, r["name"]) for i, r in enumerate(left)], "idx int, name string")
    return gather(df, [r["idx"] for r in left]), fresh


def correlated(df: DataFrame, threshold: float) -> list[int]:
    """Features with |r| over the threshold to any earlier one; from sums of products, of features centred in a first pass so that the sums stay exact."""
    means = [r["mean"] or 0.0 for r in feature_stats(df).select("idx", "mean").orderBy("idx").collect()]
    if not means:
        return []
    n, s, g = gram(df.withColumn("features", F.zip_with("features", F.array(*map(F.lit, means)), lambda x, m: x - m)))
    cov = g - np.outer(s, s) / max(n, 1)
    d = np.sqrt(np.maximum(np.diag(cov), 0))
    with np.errstate(divide="ignore", invalid="ignore"):
        r = np.abs(np.nan_to_num(cov / np.outer(d, d)))
    return [j for j in range(len(s)) if (r[:j, j] > threshold).any()]


def sparse(df: DataFrame, min_nonzero: int) -> tuple[DataFrame, list[int]]:
    """Drops features with fewer nonzero values, and the rows that used them. Returns the rows and the dropped positions."""
    few = [r["idx"] for r in feature_stats(df).filter(F.col("n_nonzero") < min_nonzero).select("idx").orderBy("idx").collect()]
    if not few:
        return df, []
    return df.filter(~uses(few)), few


def ill_conditioned(df: DataFrame, threshold: float, protected: Sequence[int] = ()) -> tuple[DataFrame, list[int]]:
    """Drops features whose diagonal of the inverse of X'X is over the threshold, and the rows that used them, until none is.

    Each round drops a feature, so there are no more rounds than features; the rows left are written between rounds.
    """
    gone: list[int] = []
    while True:
        _, _, g = gram(df)
        left = [i for i in range(len(g)) if i not in gone]
        inv = np.diag(np.linalg.pinv(g[np.ix_(left, left)]))
        bad = [i for i, v in zip(left, inv, strict=True) if v > threshold and i not in protected]
        if not bad:
            break
        gone += bad
        path = shared_dir(df.sparkSession)
        df.filter(~uses(bad)).write.parquet(path)
        df = df.sparkSession.read.schema(df.schema).parquet(path)
    return df, sorted(gone)


def group_contribution(df: DataFrame, names: DataFrame, first: str, last: str, extra: Sequence[str], min_nonzero: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Fragment columns and some others, without sparse or ill-conditioned fragments."""
    fragments = [r["name"] for r in between(names, first, last).orderBy("idx").collect()]
    wanted = [*fragments, *(e for e in extra if e not in fragments)]
    rows = gather(df, positions(names, wanted)).withColumn("features", F.transform("features", lambda x: F.coalesce(x, F.lit(0.0))))
    own = df.sparkSession.createDataFrame(list(enumerate(wanted)), "idx int, name string")
    rows, few = sparse(rows, min_nonzero)
    rows, own = keep(rows, own, few)
    protected = [r["idx"] for r in own.filter(F.col("name").isin(*extra)).collect()] if extra else []
    rows, bad = ill_conditioned(rows, threshold, protected)
    return keep(rows, own, bad)


def prepare(df: DataFrame, names: DataFrame, remove_logp: bool = False, remove_corr: float | None = None, remove_constant: bool = True, remove_acnt: bool = False, fragments: tuple[str, str] | None = None, texts: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """The screens in fixed order: fragments, atom counts, columns that hold text (their names, as non_numeric gives them), constants, logP, correlation."""
    ids = lambda d: [r["idx"] for r in d.collect()]
    if fragments:
        df, names = keep(df, names, ids(between(names, *fragments)))
    if remove_acnt:
        df, names = keep(df, names, ids(named_like(names, ATOM_COUNT)))
    if texts:
        df, names = keep(df, names, ids(names.filter(F.col("name").isin(*texts)).select("idx")))
    if remove_constant:
        df, names = keep(df, names, ids(constant_or_missing(feature_stats(df))))
    if remove_logp:
        df, names = keep(df, names, ids(named_like(names, LOGP)))
    if remove_corr is not None:
        df, names = keep(df, names, correlated(df, remove_corr))
    return df, names


def non_numeric(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """Text columns with a value that is no number; empty cells are none."""
    cell = lambda c: F.col(f"`{c}`").cast("string")
    wrong = df.agg(*[F.count_if((F.trim(cell(c)) != "") & cell(c).try_cast("double").isNull()).alias(c) for c in columns]).first()
    return [c for c in columns if wrong[c]]


def common_names(a: DataFrame, b: DataFrame) -> DataFrame:
    """Names in both, in the order of the first."""
    return a.join(b.select("name").distinct(), "name", "left_semi").select("idx", "name")


def is_binary(df: DataFrame) -> bool:
    """Whether every target is 0 or 1; a missing one says no, an empty table yes."""
    r = df.agg(F.bool_and(F.coalesce(F.col("property").isin(0, 1), F.lit(False))).alias("b")).first()
    return r["b"] is None or r["b"]


def scale(df: DataFrame, stats: DataFrame, kind: str = "standard") -> DataFrame:
    """Features scaled by training statistics: population standard deviation or range; a spread of zero counts as one."""
    by = {r["idx"]: r for r in stats.select("idx", "mean", "std_pop", "least", "most").collect()}
    rows = [by[i] for i in range(len(by))]
    shift = [r["mean"] if kind == "standard" else r["least"] for r in rows]
    spread = [(r["std_pop"] if kind == "standard" else r["most"] - r["least"]) or 1.0 for r in rows]
    vector = lambda v: F.array(*[F.lit(float(x)) for x in v])
    centred = F.zip_with("features", vector(shift), lambda x, m: x - m)
    return df.withColumn("features", F.zip_with(centred, vector(spread), lambda x, s: x / s))


