"""Statistics of predictions (id, exp, pred): single aggregates with map-side sums, by any grouping."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def training_mean(train: DataFrame) -> float | None:
    """Mean target over rows with both values."""
    return train.filter("exp is not null and pred is not null").agg(F.avg("exp").alias("m")).first()["m"]


def continuous(df: DataFrame, *by: str, mean: Column | float | None = None, tag: str = "_Test") -> DataFrame:
    """n, n_predicted, Coverage, MAE, RMSE, PearsonRSQ and Q2 (R2 for _Training) by group; null where nothing is predicted.

    mean: of the training targets, a number or a column that is constant in a group. A tag that is
    neither training, test nor external has no Q2 or R2.
    """
    e, p = F.col("exp"), F.col("pred")
    both = e.isNotNull() & p.isNotNull()
    at = F.when(both, e - p)
    centre = mean if isinstance(mean, Column) else F.lit(mean).cast("double")
    sums = df.groupBy(*by).agg(
        F.count(F.when(e.isNotNull(), 1)).alias("n"),
        F.count(F.when(both, 1)).alias("n_predicted"),
        F.avg(F.abs(at)).alias("MAE"),
        F.sqrt(F.avg(at * at)).alias("RMSE"),
        F.regr_r2(p, e).alias("PearsonRSQ"),
        F.sum(at * at).alias("__ss"),
        F.sum(F.when(both, (e - centre) * (e - centre))).alias("__st"),
    )
    out = sums.withColumn("Coverage", F.try_divide("n_predicted", "n"))
    name = {"_Training": "R2", "_Test": "Q2", "_External": "Q2"}.get(tag)
    if name and mean is not None:
        out = out.withColumn(name, 1 - F.try_divide("__ss", "__st"))
    return out.drop("__ss", "__st")


def binary(df: DataFrame, *by: str, cutoff: float = 0.5) -> DataFrame:
    """n, n_predicted, confusion counts, Coverage, Concordance, SN, SP and BA by group."""
    e, p = F.col("exp") >= cutoff, F.col("pred") >= cutoff
    both = F.col("exp").isNotNull() & F.col("pred").isNotNull()
    counts = df.groupBy(*by).agg(
        F.count("exp").alias("n"),
        F.count_if(both).alias("n_predicted"),
        F.count_if(both & e & p).alias("TP"),
        F.count_if(both & e & ~p).alias("FN"),
        F.count_if(both & ~e & p).alias("FP"),
        F.count_if(both & ~e & ~p).alias("TN"),
    )
    share = lambda a, b: F.try_divide(a, b)
    out = counts.withColumns({
        "Coverage": share(F.col("n_predicted"), F.col("n")),
        "Concordance": share(F.col("TP") + F.col("TN"), F.col("n_predicted")),
        "SN": share(F.col("TP"), F.col("TP") + F.col("FN")),
        "SP": share(F.col("TN"), F.col("TN") + F.col("FP")),
    })
    return out.withColumn("BA", (F.col("SN") + F.col("SP")) / 2)


def balanced_accuracy_rounded(df: DataFrame, *by: str) -> DataFrame:
    """BA of values rounded half up to classes 0 and 1; classes without a row have no part in the mean."""
    up = lambda c: F.floor(F.col(c) + 0.5)
    e, p = up("exp"), up("pred")
    both = df.filter("exp is not null and pred is not null")
    rates = both.groupBy(*by).agg(F.try_divide(F.count_if((e == 1) & (p == 1)), F.count_if(e == 1)).alias("a"), F.try_divide(F.count_if((e == 0) & (p == 0)), F.count_if(e == 0)).alias("b"))
    mean = F.try_divide(F.coalesce("a", F.lit(0.0)) + F.coalesce("b", F.lit(0.0)), F.col("a").isNotNull().cast("int") + F.col("b").isNotNull().cast("int"))
    return rates.select(*by, mean.alias("BA"))


def thresholded(df: DataFrame, cutoff: float) -> DataFrame:
    """exp and pred as 0 or 1: at the cutoff or over it is 1."""
    return df.withColumns({c: (F.col(c) >= cutoff).cast("double") for c in ("exp", "pred")})


def inside_outside_binary(df: DataFrame, flag: str, *by: str, cutoff: float = 0.5) -> DataFrame:
    """Balanced accuracy inside and outside, their ratio, and coverage times the inside one; a missing flag is in neither group."""
    inside = binary(df.filter(F.col(flag)), *by, cutoff=cutoff).select(*by, F.col("BA").alias("BA_inside"))
    outside = binary(df.filter(~F.col(flag)), *by, cutoff=cutoff).select(*by, F.col("BA").alias("BA_outside"))
    cover = df.groupBy(*by).agg(F.avg(F.col(flag).cast("int")).alias("Coverage"))
    out = cover.join(inside, list(by), "left").join(outside, list(by), "left")
    return out.withColumn("BA_ratio", F.try_divide("BA_inside", "BA_outside")).withColumn("coverage_BA", F.col("Coverage") * F.col("BA_inside"))


def coverage(df: DataFrame, flag: str, *by: str, binary_target: bool = False) -> DataFrame:
    """Share of rows inside: of those with exp (classes), or with exp and pred (numbers)."""
    counted = F.col("exp").isNotNull() if binary_target else F.col("exp").isNotNull() & F.col("pred").isNotNull()
    return df.groupBy(*by).agg(F.try_divide(F.count_if(counted & F.coalesce(F.col(flag), F.lit(False))), F.count_if(counted)).alias("Coverage"))


def coverage_ratio(df: DataFrame, flag: str, set_col: str = "set") -> DataFrame:
    """One row: coverage of the training and the test rows, and test over training."""
    share = lambda s: F.avg(F.when(F.col(set_col) == s, F.col(flag).cast("int")))
    out = df.agg(share("train").alias("train"), share("test").alias("test"))
    return out.withColumn("ratio", F.try_divide("test", "train"))


def tagged(stats: DataFrame, key: Sequence[str], tag: str) -> DataFrame:
    """(key, name, value) of statistics, their names ending in the tag (_Training, _CV_Training, _Test, _External)."""
    return to_long(stats, key).withColumn("name", F.concat("name", F.lit(tag)))


def known_statistics(long: DataFrame, names: DataFrame, skipped: Sequence[str] = ("n", "n_predicted")) -> DataFrame:
    """Long statistics with the id of their name; skipped and unknown names go."""
    return long.filter(~F.col("name").isin(*skipped)).join(names.select("name", "statistic_id"), "name")


def recomputed(stored: DataFrame, fresh: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, value, recomputed): the stored value, or where it is missing the fresh one."""
    a, b = stored.select(*keys, F.col("value").alias("__a")), fresh.select(*keys, F.col("value").alias("__b"))
    return a.join(b, list(keys), "full").select(*keys, F.coalesce("__a", "__b").alias("value"), (F.col("__a").isNull() & F.col("__b").isNotNull()).alias("recomputed"))


def score_table(scores: DataFrame, metrics: Sequence[str], set_col: str = "set") -> DataFrame:
    """(metric, train, test) from one row of metrics for each set."""
    long = scores.unpivot([set_col], [F.col(m).cast("double").alias(m) for m in metrics], "metric", "value")
    return long.groupBy("metric").pivot(set_col, ["train", "test"]).agg(F.first("value"))


def mean_scores(scores: DataFrame, *by: str) -> DataFrame:
    """Mean score of each key, sorted by it."""
    return scores.groupBy(*by).agg(F.avg("score").alias("score")).orderBy(*by)


def share_visible(df: DataFrame, visible: Column, *by: str) -> DataFrame:
    """Rows, visible ones and their share of the group's."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(visible).alias("n_visible"), F.avg(visible.cast("int")).alias("share"))


def consensus(df: DataFrame, flags: Sequence[str]) -> DataFrame:
    """`inside`: all flags true; a missing flag is outside."""
    both = F.lit(True)
    for f in flags:
        both = both & F.coalesce(F.col(f), F.lit(False))
    return df.withColumn("inside", both)


def inside_outside(df: DataFrame, flag: str, *by: str) -> DataFrame:
    """r2 and RMSE inside and outside, their ratio, and coverage over rows with a flag; a missing flag is in neither group."""
    inside, outside = F.coalesce(F.col(flag), F.lit(False)), F.coalesce(~F.col(flag), F.lit(False))
    err = (F.col("exp") - F.col("pred")) ** 2
    of = lambda c, x: F.when(c, x)
    out = df.groupBy(*by).agg(
        F.count_if(inside).alias("n_inside"),
        F.count_if(outside).alias("n_outside"),
        F.avg(F.col(flag).cast("int")).alias("Coverage"),
        F.regr_r2(of(inside, F.col("pred")), of(inside, F.col("exp"))).alias("r2_inside"),
        F.regr_r2(of(outside, F.col("pred")), of(outside, F.col("exp"))).alias("r2_outside"),
        F.sqrt(F.avg(of(inside, err))).alias("RMSE_inside"),
        F.sqrt(F.avg(of(outside, err))).alias("RMSE_outside"),
        F.stddev_pop(of(inside, err)).alias("__si"),
        F.stddev_pop(of(outside, err)).alias("__so"),
    )
    return out.withColumn("r2_ratio", F.try_divide("r2_inside", "r2_outside")).withColumn("spread_ratio", F.try_divide("__so", "__si")).withColumn("coverage_r2", F.col("Coverage") * F.col("r2_inside")).drop("__si", "__so")


def class_balance(df: DataFrame, group: str, label: str) -> DataFrame:
    """Count and share of each class within each group."""
    from descry.operators.order import share_of_group

    return share_of_group(df.groupBy(group, label).agg(F.count(F.lit(1)).alias("n")), group)


def positive_fraction(df: DataFrame, *by: str) -> DataFrame:
    """Rows with a target and the fraction of positives among them."""
    return df.groupBy(*by).agg(F.count("property").alias("n"), F.try_divide(F.count_if(F.col("property") == 1), F.count("property")).alias("positive"))


def mean_of_folds(fold_stats: DataFrame, names: Sequence[str], *by: str) -> DataFrame:
    """Means of per-fold statistics, not of pooled rows."""
    return fold_stats.groupBy(*by).agg(*[F.avg(n).alias(n) for n in names])


def fit_line(df: DataFrame, *by: str) -> DataFrame:
    """Slope, intercept and r2 of pred on exp."""
    return df.groupBy(*by).agg(F.regr_slope("pred", "exp").alias("slope"), F.regr_intercept("pred", "exp").alias("intercept"), F.regr_r2("pred", "exp").alias("r2"))


def descriptor_r2(df: DataFrame, idx: int) -> DataFrame:
    """Coefficient of determination with the descriptor taken for the truth."""
    x, y = F.get("features", idx), F.col("property")
    both = df.filter(x.isNotNull() & y.isNotNull())
    return both.agg((1 - F.try_divide(F.sum((x - y) ** 2), F.var_pop(x) * F.count(x))).alias("r2"))


def histogram(df: DataFrame, column: str, bins: int, *by: str) -> DataFrame:
    """Counts over shared equal-width bins from 0 on; the maximum is in the last."""
    ends = df.agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    place = F.least(F.lit(bins - 1), F.floor(F.try_divide(F.col(column) - F.col("lo"), width)).cast("int"))
    joined = df.filter(F.col(column).isNotNull()).join(F.broadcast(ends))  # one row is broadcast
    return joined.groupBy(*by, F.coalesce(place, F.lit(0)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def axis_bounds(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.least(F.min("exp"), F.min("pred")).alias("low"), F.greatest(F.max("exp"), F.max("pred")).alias("high"))


def column_counts(df: DataFrame) -> DataFrame:
    """Non-null values of every column, in one row."""
    return df.agg(*[F.count(c).alias(c) for c in df.columns])


def votes(runs: DataFrame, names: str, threshold: int) -> DataFrame:
    """Descriptors that at least `threshold` runs chose, and how many did."""
    return runs.select(F.explode(F.array_distinct(names)).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= threshold)


def best_run(runs: DataFrame, metric: str, larger: bool, *by: str) -> DataFrame:
    pick = F.max_by if larger else F.min_by
    return runs.groupBy(*by).agg(pick(F.struct(*runs.columns), metric).alias("r")).select("r.*")


def max_qualifying(items: Column, keep, value) -> Column:
    """The greatest value over the items of an array that qualify."""
    return F.array_max(F.transform(F.filter(items, keep), value))


def compare(old: DataFrame, new: DataFrame) -> DataFrame:
    """(name, old, new, change) of statistics in either."""
    a, b = old.select("name", F.col("value").alias("old")), new.select("name", F.col("value").alias("new"))
    return a.join(b, "name", "full").withColumn("change", F.col("new") - F.col("old"))


def to_long(stats: DataFrame, key: Sequence[str]) -> DataFrame:
    """(key, name, value) of every statistic that has a value."""
    values = [c for c in stats.columns if c not in key]
    return stats.select(*key, *[F.col(c).cast("double") for c in values]).unpivot(list(key), values, "name", "value").filter("value is not null")


def fold_summary(scores: DataFrame) -> DataFrame:
    """Mean, spread and range of scores by number of folds."""
    return scores.groupBy("n_fold").agg(F.avg("score").alias("mean"), F.stddev_pop("score").alias("std"), (F.max("score") - F.min("score")).alias("range"))
