"""Order statistics, ranks and bins."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from descry.sources.tables import shared_dir


def split_index(n: int, fraction: float) -> int:
    """The place int(n * fraction) of a sorted list, kept within it."""
    return min(int(n * fraction), n - 1)


#: Values that one task may sort.
MOST_IN_TASK = 1_000_000


#: How far from a place its first bracket reaches, as a share of the rows; a miss reaches four times as far.
REACH = 0.001


def values_at(df: DataFrame, column: str, places: list[int], n: int, most: int = MOST_IN_TASK) -> list[float]:
    """The values at places (from 0) of the n sorted non-null values of a column, exactly.

    Up to `most` values, by discrete percentiles aimed at the middle of each place. More are written
    once. Then all places go through the same passes: one mergeable sketch brackets every place, one
    count says what lies below and inside each bracket, and brackets that miss their place or hold
    more than `most` values go round again, the latter with a sketch of what they hold. At the end one
    pass sorts what the brackets hold, each in a group of its own, `most` values at the largest. A
    bracket of one value is that value, however many rows have it.
    """
    rows = df.select(F.col(column).cast("double").alias("x")).filter("x is not null")
    if n <= most:
        wanted = [F.expr(f"percentile_disc({(k + 0.5) / n!r}D) within group (order by x)").alias(f"p{i}") for i, k in enumerate(places)]
        return list(rows.agg(*wanted).first()) if wanted else []
    path = shared_dir(df.sparkSession)
    rows.write.parquet(path)
    rows = df.sparkSession.read.schema("x double").parquet(path)
    found: dict[int, float] = {}
    ready: dict[int, tuple[float, float, int]] = {}
    # Of each place: the bracket that surely holds it (none at first), the rows below and in it, and its reach.
    open_: dict[int, tuple[tuple[float, float] | None, int, int, float]] = {k: (None, 0, n, REACH) for k in dict.fromkeys(places)}
    while open_:
        tries: dict[int, tuple[float, float]] = {}
        for sure in dict.fromkeys(s for s, _, _, _ in open_.values()):
            own = [k for k, state in open_.items() if state[0] == sure]
            part = rows if sure is None else rows.filter(F.col("x").between(*sure))
            at = [(max(0.0, (k - below) / held - reach), min(1.0, (k - below) / held + reach)) for k in own for _, below, held, reach in [open_[k]]]
            edges = part.approxQuantile("x", [f for pair in at for f in pair], min(open_[k][3] for k in own) / 2)
            tries.update({k: (edges[2 * i], edges[2 * i + 1]) for i, k in enumerate(own)})
        counts = rows.agg(*[c for i, (lo, hi) in enumerate(tries.values()) for c in (F.count_if(F.col("x") < lo).alias(f"b{i}"), F.count_if(F.col("x").between(lo, hi)).alias(f"i{i}"))]).first()
        for i, (k, (lo, hi)) in enumerate(tries.items()):
            sure, under, held, reach = open_.pop(k)
            below, inside = counts[f"b{i}"], counts[f"i{i}"]
            if not below <= k < below + inside:
                open_[k] = sure, under, held, 4 * reach
            elif lo == hi:
                found[k] = lo
            elif inside <= most:
                ready[k] = lo, hi, k - below
            elif inside == held:
                open_[k] = sure, under, held, reach / 4
            else:
                open_[k] = (lo, hi), below, inside, REACH
    if ready:
        brackets = F.array(*[F.struct(F.lit(k).cast("long").alias("k"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi"), F.lit(at).alias("at")) for k, (lo, hi, at) in ready.items()])
        held = rows.select("x", F.explode(F.filter(brackets, lambda b: F.col("x").between(b["lo"], b["hi"]))).alias("b"))
        each = held.groupBy("b.k", "b.at").agg(F.sort_array(F.collect_list("x")).alias("v"))
        found |= {r["k"]: r["x"] for r in each.select("k", F.get("v", F.col("at")).alias("x")).collect()}
    return [found[k] for k in places]


def split_value(df: DataFrame, column: str, fraction: float, most: int = MOST_IN_TASK) -> float | None:
    """The value at place int(n * fraction) of the sorted non-null values, without interpolation; null if there are none."""
    n = df.agg(F.count(column).alias("n")).first()["n"]
    return values_at(df, column, [split_index(n, fraction)], n, most)[0] if n else None


def quantiles(df: DataFrame, column: str, fractions: list[float], most: int = MOST_IN_TASK) -> list[float]:
    """Linearly interpolated quantiles; none of an empty column."""
    n = df.agg(F.count(column).alias("n")).first()["n"]
    if n <= most:
        return df.agg(F.percentile(F.col(column).cast("double"), F.array(*map(F.lit, fractions))).alias("q")).first()["q"] or []
    at = [f * (n - 1) for f in fractions]
    places = sorted({i for x in at for i in (math.floor(x), math.ceil(x))})
    value = dict(zip(places, values_at(df, column, places, n, most), strict=True))
    return [value[math.floor(x)] + (x - math.floor(x)) * (value[math.ceil(x)] - value[math.floor(x)]) for x in at]


def top_k(df: DataFrame, key: str | list[str], k: int, *order: Column) -> DataFrame:
    """The first k rows of each key, ranked from 1 as `rank`; ranks are filtered inside the window's group limit."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("rank") <= k)


def keep_last(df: DataFrame, key: str, seq: str) -> DataFrame:
    """Of each key the row of the greatest seq; map-side, by an aggregate instead of a window."""
    return df.groupBy(key).agg(F.max_by(F.struct(*df.columns), seq).alias("r")).select("r.*")


def occurrence(df: DataFrame, *keys: str, order: str) -> DataFrame:
    """The how-manieth row of its key each row is (`nth`), and of how many (`n_of`)."""
    return df.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).withColumn("n_of", F.count(F.lit(1)).over(Window.partitionBy(*keys)))


def share_of_group(counts: DataFrame, group: str, n: str = "n") -> DataFrame:
    return counts.withColumn("share", F.col(n) / F.sum(n).over(Window.partitionBy(group)))


def closest_fold(scores: DataFrame, pooled: float) -> int:
    """The fold whose score is closest to the pooled one; the first of equals."""
    return scores.agg(F.min_by("fold", F.struct(F.abs(F.col("score") - pooled), "fold")).alias("fold")).first()["fold"]


def quantile_edges(df: DataFrame, column: str, bins: int) -> list[float]:
    """bins + 1 linearly interpolated quantiles, equal ones once."""
    return sorted(set(quantiles(df, column, [i / bins for i in range(bins + 1)])))


def bin_of(x: Column, edges: list[float]) -> Column:
    """The bin from 0 on; the last one holds its right edge."""
    inner = edges[1:-1]
    return sum((F.when(x >= e, 1).otherwise(0) for e in inner), F.lit(0)) if inner else F.lit(0)


def freedman_diaconis(df: DataFrame, column: str) -> int:
    """Bins of width 2 IQR n**(-1/3) over the range; 1 where that has no width."""
    r = df.agg(F.count(column).alias("n"), F.min(column).alias("a"), F.max(column).alias("b")).first()
    q = quantiles(df, column, [0.25, 0.75])
    if not q or q[1] == q[0]:
        return 1
    return max(1, math.ceil((r["b"] - r["a"]) / (2 * (q[1] - q[0]) * r["n"] ** (-1 / 3))))


def by_metric(df: DataFrame, metric: str, larger_is_better: bool) -> DataFrame:
    """Best first, nulls last in either direction."""
    return df.orderBy(F.desc_nulls_last(metric) if larger_is_better else F.asc_nulls_last(metric))


def id_sample(df: DataFrame, key: str, start: object, n: int = 1000) -> DataFrame:
    """n rows of consecutive ids from start on."""
    return df.filter((F.col(key) >= start) & F.col(key).isNotNull()).orderBy(key).limit(n)


def largest_coefficients(coefficients: DataFrame, n: int | None = None) -> DataFrame:
    """Coefficients that are not zero, the largest by absolute value first, n at most; equal ones by name."""
    out = coefficients.filter("estimate <> 0").orderBy(F.desc(F.abs("estimate")), "name")
    return out if n is None else out.limit(n)


def top_importances(importances: DataFrame, n: int = 12) -> DataFrame:
    """The n most important features; equal ones by position."""
    return importances.orderBy(F.desc("importance"), "idx").limit(n)


def seeded_start(df: DataFrame, key: str, seed: int) -> object:
    """An id to start a sample from: that of the least seeded hash."""
    return df.filter(F.col(key).isNotNull()).agg(F.min_by(key, F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")).cast("binary"))).alias("k")).first()["k"]
