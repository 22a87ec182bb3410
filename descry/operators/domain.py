"""Applicability domains: is a row inside the region that the training rows cover?

Every measure takes (train, test) of (id, property, features) and returns (flags, cutoff): for each
row (id, set, value, inside, ...), and the training value at its place in order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from descry.operators import stats
from descry.operators.columns import feature_stats, gather, long_form, scale
from descry.operators.knn import SENT_BYTES, neighbours
from descry.operators.linalg import complete_rows, gram, leverages
from descry.operators.metric_index import Pieces, build, written
from descry.operators.order import split_value

FRACTION = 0.95
#: Share of a density that may be left to far blocks.
IGNORED = 1e-12
#: Rows that meet a piece of kernels at once, a double's rounding, and the rounding that squares (over h squared) may have.
ASKING, EPS, ROUGH = 128, 2.0**-52, 1e-10


def _both(train: DataFrame, test: DataFrame) -> tuple[DataFrame, DataFrame]:
    own = feature_stats(train)
    return scale(train, own), scale(test, own)


def _of_sets(train: DataFrame, test: DataFrame) -> DataFrame:
    """(id, set, features) of both sets."""
    return reduce(DataFrame.unionByName, [d.select("id", F.lit(name).alias("set"), "features") for name, d in (("test", test), ("train", train))])


def _flagged(values: DataFrame, fraction: float, inside: Callable[[Column, float], Column]) -> tuple[DataFrame, float | None]:
    """Values of both sets with flags, and the cutoff. The values are written: they are read for the rows' number, for the cutoff and for the flags."""
    values = written(values)
    cutoff = split_value(values.filter("set = 'train'"), "value", fraction)
    return values.withColumn("inside", inside(F.col("value"), cutoff)), cutoff


def knn_distance(train: DataFrame, test: DataFrame, k: int = 3, metric: str = "euclidean", scaled: bool = True) -> tuple[DataFrame, float | None]:
    """Mean distance to the k nearest training rows; inside if at most that of 95 % of the training rows. Neighbours come along."""
    a, b = _both(train, test) if scaled else (train, test)

    near = neighbours(a, _of_sets(a, b), k, metric, tag="set")
    pairs = F.array_sort(F.collect_list(F.struct("rank", F.col("neighbour_id").alias("id"), "distance")))
    return _flagged(near.groupBy("id", "set").agg(F.avg("distance").alias("value"), pairs.alias("neighbours")), FRACTION, lambda v, c: v <= c)


def local_index(d: Column) -> Column:
    """1 / (1 + sum of weighted distances); the nearer a neighbour, the more it weighs."""
    small, large = 5e-4, 5e-2
    f = lambda x: F.when(x <= 0.1, F.lit(small)).otherwise(F.lit(large))
    plus = lambda a, b: a + b
    inverse = F.aggregate(F.transform(d, lambda x: 1 / (f(x) + x)), F.lit(0.0), plus)
    return 1 / (1 + F.aggregate(F.transform(d, lambda x: (f(x) + x) * x), F.lit(0.0), plus) / inverse)


def local_similarity(train: DataFrame, test: DataFrame, k: int = 5) -> tuple[DataFrame, float | None]:
    """Local index over the k nearest; inside if over that of the lowest 5 % of the training rows."""
    a, b = _both(train, test)
    near = neighbours(a, _of_sets(a, b), k, tag="set")
    return _flagged(near.groupBy("id", "set").agg(local_index(F.array_sort(F.collect_list("distance"))).alias("value")), 1 - FRACTION, lambda v, c: v > c)


def leverage(train: DataFrame, test: DataFrame, scaled: bool = True) -> tuple[DataFrame, float | None]:
    """x' (X'X)^-1 x; inside if at most that of 95 % of the training rows."""
    a, b = _both(train, test) if scaled else (train, test)
    inverse = np.linalg.pinv(gram(a)[2])
    values = lambda rows, name: leverages(rows, inverse).select("id", F.lit(name).alias("set"), F.col("leverage").alias("value"))
    return _flagged(values(b, "test").unionByName(values(a, "train")), FRACTION, lambda v, c: v <= c)


def local_and_leverage(train: DataFrame, test: DataFrame) -> DataFrame:
    """(id, set, strength): STRONG inside both domains, MODERATE inside one, WEAK in none."""
    a, b = local_similarity(train, test)[0], leverage(train, test)[0]
    joined = a.select("id", "set", F.col("inside").alias("local")).join(b.select("id", "set", F.col("inside").alias("lev")), ["id", "set"])
    return joined.withColumn("strength", F.when(F.col("local") & F.col("lev"), "STRONG").when(F.col("local") | F.col("lev"), "MODERATE").otherwise("WEAK"))


def _log_kernels(q: np.ndarray, own: Pieces, h: float, left_out: tuple[np.ndarray, np.ndarray] | None = None, wanted: np.ndarray | None = None) -> np.ndarray:
    """Log of the sum of Gaussian kernels at the rows of own, for each row q. left_out: of each row an id, and whether the kernel of that id is left out. wanted: by row and block, what to meet.

    Pieces are met in their order, always by ASKING rows (zeros after the last), so a value doesn't
    depend on what comes along with a row. Squares come from products around a piece's mean; where
    rounding would show in them, they are those of differences.
    """
    n = len(q)
    top, total = np.full(n, -np.inf), np.zeros(n)
    halves, held = np.full((ASKING, 1), -0.5), np.empty(ASKING * max((p[1] - p[0] for p in own.parts), default=0))
    for s, e, block, centre, t, widest in own.parts:
        rows = np.arange(n) if wanted is None else np.flatnonzero(wanted[:, block])
        for a in range(0, len(rows), ASKING):
            at = rows[a : a + ASKING]
            x = np.zeros((ASKING, q.shape[1]))
            x[: len(at)] = q[at] - centre
            size = (x * x).sum(1)
            with np.errstate(over="ignore", invalid="ignore"):
                d = np.matmul(np.hstack([x, -0.5 * size[:, None], halves]) / (h * h), t.T, out=held[: ASKING * (e - s)].reshape(ASKING, -1))[: len(at)]
                rough = np.flatnonzero(~(((np.sqrt(size[: len(at)]) + widest) ** 2 + 1) * EPS * (q.shape[1] + 16) < ROUGH * h * h))
            for i in range(0, len(rough), 16):
                of = rough[i : i + 16]
                d[of] = ((q[at[of], None, :] - own.x[None, s:e, :]) ** 2).sum(2) * (-0.5 / (h * h))
            if left_out is not None:
                d[(left_out[0][at, None] == own.ids[s:e]) & left_out[1][at, None]] = -np.inf
            most = np.maximum(top[at], d.max(1))
            safe = np.where(np.isfinite(most), most, 0.0)
            d -= safe[:, None]
            total[at] = total[at] * np.exp(top[at] - safe) + np.exp(d, out=d).sum(1)
            top[at] = most
    with np.errstate(divide="ignore"):
        return np.where(total > 0, np.where(np.isfinite(top), top, 0.0) + np.log(total), -np.inf)


def density(train: DataFrame, test: DataFrame, h: float = 1.0, block_rows: int = 1 << 14, compat: bool = False, leave_out: bool = False, sent_bytes: int = SENT_BYTES) -> tuple[DataFrame, float | None]:
    """Log of a Gaussian kernel density of the training rows; inside if over that of the lowest 5 % of them.

    Values are compared to nine digits, so that rows which equal the cutoff but for rounding are
    outside, as the cutoff's own row is. leave_out: a training row's own kernel is no part of its
    value, which it rules wherever rows lie far apart. compat: the kernels stand at the training rows
    as they come, while the rows judged are scaled.

    Rows that are not whole have no value. Training rows up to sent_bytes (measured) go to every
    task. More are met through an index; blocks whose kernels together are below IGNORED of the sum
    that nearer ones have for certain are skipped, an error of at most that in the logarithm. A row's
    partial sums are added in the order of their groups of blocks, so a run repeats to the last bit.
    """
    a, b = _both(train, test)
    kernels = train.select("id", F.col("features").cast("array<double>").alias("features")) if compat else a
    rows = _of_sets(a, b)
    out_of = lambda q_id, sets: (q_id, np.array(sets.to_pylist()) == "train") if leave_out else None
    parts = "id long, set string, block long, part double"
    found_as = lambda *columns: pa.RecordBatch.from_arrays(list(map(pa.array, columns)), names=["id", "set", "block", "part"])
    size = kernels.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.size("features")), F.lit(0)).alias("p")).first()
    if size["n"] * (size["p"] + 1) * 8 <= sent_bytes:
        sent_rows = kernels.select("id", "features").orderBy("id").toArrow()
        kept, x = complete_rows(sent_rows.column("features"))
        sent = train.sparkSession.sparkContext.broadcast((sent_rows.column("id").to_numpy()[kept], x))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t_id, t = sent.value
            pieces = None
            for batch in batches:
                at, q = complete_rows(batch.column(2))
                if len(at) and len(t_id):
                    pieces = pieces or Pieces(t_id, t, kind="f8")
                    q_id, sets = batch.column(0).to_numpy(zero_copy_only=False)[at], batch.column(1).take(pa.array(at))
                    yield found_as(q_id, sets, np.zeros(len(at), np.int64), _log_kernels(q, pieces, h, out_of(q_id, sets)))

        found = rows.mapInArrow(run, parts)
    elif (index := build(kernels, block_rows)) is None:
        found = train.sparkSession.createDataFrame([], parts)
    else:
        weight, ignored = np.log(index.count), 0.0 if leave_out else IGNORED
        plain = replace(index, rows=None)

        def choose(x: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            low, high = plain.bounds(x)
            most, least = weight - low**2 / (2 * h * h), weight - high**2 / (2 * h * h)
            top = least.max(1, keepdims=True)
            certain = top + np.log(np.exp(least - top).sum(1, keepdims=True))
            by = np.sort(most, axis=1)
            share = np.cumsum(np.exp(np.minimum(by - certain, 700)), axis=1)
            # A row left out might be all that is certain, so then only what has no weight at all is skipped.
            kept = (share > ignored).argmax(1)
            # With room for rounding, as a task takes the bounds again.
            limit = by[np.arange(len(x)), kept]
            limit -= 1e-6 * (1 + np.abs(limit))
            home = np.full(len(x), -1)
            return again(low, high, np.arange(len(weight)), limit, home), limit, home

        def again(low: np.ndarray, high: np.ndarray, blocks: np.ndarray, limit: np.ndarray, home: np.ndarray) -> np.ndarray:
            return weight[blocks] - low**2 / (2 * h * h) >= limit[:, None]

        def ready(ids: np.ndarray, x: np.ndarray, block: np.ndarray) -> Pieces:
            return Pieces(ids, x, block, kind="f8")

        def work(group: int, own: Pieces, q_id: np.ndarray, sets: pa.Array, q: np.ndarray, limit: np.ndarray, wanted: np.ndarray) -> pa.RecordBatch:
            return found_as(q_id, sets, np.full(len(q_id), group), _log_kernels(q, own, h, out_of(q_id, sets), wanted))

        found = index.meet(rows.select("id", F.col("set").alias("tag"), "features", F.lit(None).cast("double").alias("reach")), (choose, again), parts, ready, work)
    each = found.groupBy("id", "set").agg(F.array_sort(F.collect_list(F.struct("block", "part"))).alias("l"))
    top = F.array_max(F.transform("l", lambda p: p["part"]))
    summed = F.aggregate("l", F.lit(0.0), lambda s, p: s + F.exp(p["part"] - F.col("top")))
    value = written(each.withColumn("top", top).select("id", "set", F.when(F.col("top") == float("-inf"), F.col("top")).otherwise(F.col("top") + F.log(summed)).alias("value")))
    cutoff = split_value(value.filter("set = 'train'"), "value", 1 - FRACTION)
    limit = F.lit(cutoff).cast("double")
    return value.withColumn("inside", (F.round("value", 9) > F.round(limit, 9)) if cutoff not in (None, float("-inf")) else F.col("value") > limit), cutoff


def fragment_range(train: DataFrame, test: DataFrame, names: DataFrame) -> DataFrame:
    """(id, fragment_table, inside): every present fragment must be within the training rows' [least positive, most].

    Fragments that training lacks are passed over; a row without any fragment has no result row.
    """
    ranges = feature_stats(train).select("idx", F.col("least_positive").alias("training_min"), F.col("most").alias("training_max"), F.col("n_positive").alias("training_count"))
    present = long_form(test).filter("x > 0").join(ranges, "idx").join(names, "idx")
    ok = (F.col("x") >= F.col("training_min")) & (F.col("x") <= F.col("training_max")) & (F.col("training_count") > 0)
    row = F.struct(F.col("name").alias("fragment"), F.col("x").alias("test_value"), "training_min", "training_max", "training_count")
    return present.groupBy("id").agg(F.array_sort(F.collect_list(row)).alias("fragment_table"), F.bool_and(ok).alias("inside"))


def marked_fragments(table: Column, in_model: Column) -> Column:
    """Fragment names with * where out of range and ** where the model lacks them."""
    out = lambda f: (f["test_value"] < f["training_min"]) | (f["test_value"] > f["training_max"])
    return F.transform(table, lambda f: F.concat(f["fragment"], F.when(out(f), "*").otherwise(""), F.when(~F.array_contains(in_model, f["fragment"]), "**").otherwise("")))


def neighbour_statistics(near: DataFrame, known: DataFrame, binary: bool = False) -> DataFrame:
    """Statistics by query row of its neighbours' values: MAE, or BA, SN and SP of classes. known: (id, exp, pred)."""
    values = near.join(known.select(F.col("id").alias("neighbour_id"), "exp", "pred"), "neighbour_id")
    return stats.binary(values, "id").select("id", "n", "BA", "SN", "SP") if binary else stats.continuous(values, "id").select("id", "n", "MAE")


def neighbours_listed(train: DataFrame, queries: DataFrame, k: int = 10, metrics: Sequence[str] = ("euclidean", "cosine")) -> DataFrame:
    """(metric, id, rank, neighbour_id, distance, label): the k nearest training rows of each query by each metric, with their class; features scaled by the training rows."""
    a, b = _both(train, queries)
    near = reduce(DataFrame.unionByName, [neighbours(a, b, k, m).withColumn("metric", F.lit(m)) for m in metrics])
    labels = train.select(F.col("id").alias("neighbour_id"), F.col("property").alias("label"))
    return near.join(labels, "neighbour_id", "left").select("metric", "id", "rank", "neighbour_id", "distance", "label")


Flags = tuple[DataFrame, float | None]
#: Measures of the model's own features.
MEASURES: dict[str, Callable[[DataFrame, DataFrame], Flags]] = {
    "knn_euclidean": knn_distance,
    "knn_cosine": lambda a, b: knn_distance(a, b, metric="cosine"),
    "local_similarity": local_similarity,
    "leverage": leverage,
    "density": density,
}
#: Measures of all features, whatever the model uses.
OF_ALL_FEATURES: dict[str, Callable[[DataFrame, DataFrame], Flags]] = {"knn_euclidean_all": knn_distance, "knn_cosine_all": MEASURES["knn_cosine"]}


def evaluate(name: str, train: DataFrame, test: DataFrame, idx: Sequence[int] | None = None, names: DataFrame | None = None) -> Flags:
    """A measure by its name. idx: positions of the model's features (none: all); names: (idx, name) of those, for fragment_counts."""
    if name in OF_ALL_FEATURES:
        return OF_ALL_FEATURES[name](train, test)
    if name not in MEASURES and name != "fragment_counts":
        raise ValueError(f"no such measure: {name}; there are {', '.join([*MEASURES, *OF_ALL_FEATURES, 'fragment_counts'])}")
    if idx is not None:
        train, test = gather(train, idx), gather(test, idx)
    if name == "fragment_counts":
        if names is None:
            raise ValueError("fragment_counts needs the fragments' names")
        return fragment_range(train, test, names), None
    return MEASURES[name](train, test)
