"""Linear fits that outliers do not move, and a kernel's random features for linear learners."""

from __future__ import annotations

import random
import warnings
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Estimator, Model, Transformer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from descry.operators.linalg import gram, with_target
from descry.operators.metric_index import written
from descry.operators.order import split_value
from descry.operators.split import ranked


def _complete(df: DataFrame) -> DataFrame:
    return df.filter("id is not null and property is not null and features is not null and not exists(features, x -> x is null or isnan(x) or abs(x) = double('infinity'))").select("id", F.col("property").cast("double").alias("property"), F.col("features").cast("array<double>").alias("features"))


def line(b: np.ndarray) -> Column:
    """Intercept and coefficients applied to `features`."""
    return F.aggregate(F.zip_with("features", F.array(*[F.lit(float(w)) for w in b[1:]]), lambda x, w: x * w), F.lit(float(b[0])), lambda a, v: a + v)


def sampled_fits(df: DataFrame, trials: int, seed: int) -> np.ndarray:
    """Intercept and coefficients of `trials` least-squares fits, each of as many random rows as it has coefficients.

    The rows are drawn by their rank in a hash order, so any run draws the same ones. Only the drawn
    rows move, trials * width of them whatever the size of df; one task fits one trial.
    """
    return Trials(df, seed).fits(0, trials)


class Trials:
    """Fits of random rows by number: those of one number are alike however they are asked for."""

    def __init__(self, df: DataFrame, seed: int):
        self.rows = written(ranked(df, seed))
        self.n = self.rows.count()
        first = df.select(F.size("features").alias("p")).first()
        self.size = (first["p"] if first else 0) + 1
        if self.n < self.size:
            raise ValueError(f"{self.size} coefficients need as many rows, got {self.n}")
        self.rng, self.drawn = random.Random(seed), []

    def fits(self, first: int, trials: int) -> np.ndarray:
        """The fits of numbers first, first + 1, ..."""
        while len(self.drawn) < first + trials:
            self.drawn.append(self.rng.sample(range(self.n), self.size))
        wanted = self.rows.sparkSession.createDataFrame([(t, r) for t in range(first, first + trials) for r in self.drawn[t]], "trial int, rank long")

        def solve(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
            x = np.column_stack([np.ones(len(own)), np.stack(own["features"].to_list())])
            return pd.DataFrame({"trial": [key[0]], "b": [np.linalg.lstsq(x, own["property"].to_numpy(), rcond=None)[0].tolist()]})

        found = self.rows.join(F.broadcast(wanted), "rank").select("trial", "property", "features").groupBy("trial").applyInPandas(solve, "trial int, b array<double>")
        return np.array([r["b"] for r in sorted(found.collect())])


def enough_trials(inside: int, n: int, size: int, probability: float) -> float:
    """Trials after which, with that probability, one drew `size` of the rows that lie near the line, if `inside` of n do."""
    good = (inside / n) ** size
    return 0.0 if good >= 1 else np.inf if good <= 0 else np.log(1 - probability) / np.log(1 - good)


def consensus(df: DataFrame, trials: int = 100, threshold: float | None = None, seed: int = 42, probability: float | None = 0.99, batch: int = 16) -> np.ndarray:
    """Random sample consensus: least squares of the rows within `threshold` of the trial that most rows are within.

    threshold: the median absolute deviation of the target, unless given. Of trials with equally many
    rows the one of least squared error there wins, then the first. Trials go in batches, and all of a
    batch are judged in one pass over the rows. They end when as many are made as the best share so
    far asks for, to have drawn rows near the line alone with `probability` (None: all `trials`).
    Rows without a target, or that are not whole, are left out.
    """
    rows = written(_complete(df))
    drawn = Trials(rows, seed)
    if threshold is None:
        middle = split_value(rows, "property", 0.5)
        threshold = split_value(rows.select(F.abs(F.col("property") - middle).alias("away")), "away", 0.5)
    best: tuple[int, float, int] | None = None
    m = np.zeros(drawn.size)
    for first in range(0, trials, batch):
        fits = drawn.fits(first, min(batch, trials - first))
        n, sse, at = _judged(rows, fits, threshold)
        if best is None or (-n, sse, first + at) < best:
            best, m = (-n, sse, first + at), fits[at]
        if probability is not None and first + len(fits) >= enough_trials(-best[0], drawn.n, drawn.size, probability):
            break
    near = rows.filter(F.abs(F.col("property") - line(m)) <= threshold)
    # Around the trial's line, whose rest is small, the sums are well conditioned.
    n, _, g = gram(with_target(near.withColumn("property", F.col("property") - line(m))))
    return m + np.linalg.pinv(g[:-1, :-1], hermitian=True) @ g[:-1, -1] if n else m


def _judged(rows: DataFrame, fits: np.ndarray, threshold: float) -> tuple[int, float, int]:
    """Of the fit that most rows are within: how many, their squared error, and its place."""
    sent = rows.sparkSession.sparkContext.broadcast(fits)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sse = np.zeros(len(sent.value), np.int64), np.zeros(len(sent.value))
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                y = batch.column(0).slice(at, 1024).to_numpy(zero_copy_only=False)
                x = batch.column(1).slice(at, 1024).flatten().to_numpy(zero_copy_only=False).reshape(len(y), -1)
                away = np.abs(y[:, None] - x @ sent.value[:, 1:].T - sent.value[:, 0])
                inside = away <= threshold
                n += inside.sum(0)
                sse += (away**2 * inside).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(n)), pa.int32()), pa.array(n), pa.array(sse)], names=["trial", "n", "sse"])

    judged = rows.select("property", "features").mapInArrow(judge, "trial int, n long, sse double")
    r = judged.groupBy("trial").agg(F.sum("n").alias("n"), F.sum("sse").alias("sse")).orderBy(F.desc("n"), "sse", "trial").first()
    return r["n"], r["sse"], r["trial"]


def spatial_median(points: np.ndarray, rounds: int = 1000, tolerance: float = 1e-10) -> np.ndarray:
    """The point of least summed distance (Weiszfeld's steps, kept moving where one lands on a point); a warning if `rounds` end before a step is small."""
    at = np.median(points, axis=0)
    for _ in range(rounds):
        gap = np.linalg.norm(points - at, axis=1)
        off = gap > 1e-12
        if not off.any():
            return at
        pull = ((points[off] - at) / gap[off, None]).sum(0)
        step = pull / (1 / gap[off]).sum() * max(0.0, 1 - (~off).sum() / max(np.linalg.norm(pull), 1e-300))
        at = at + step
        if np.linalg.norm(step) <= tolerance * (1 + np.linalg.norm(at)):
            break
    else:
        warnings.warn(f"the median still moves by {np.linalg.norm(step):.1e} after {rounds} rounds", stacklevel=2)
    return at


def theil_sen(df: DataFrame, subsets: int = 1000, seed: int = 42) -> np.ndarray:
    """The spatial median of the coefficients of `subsets` fits of random rows, intercept first.

    Subsets are drawn at any size of df; a small table's are not enumerated, so some may come twice.
    """
    return spatial_median(sampled_fits(_complete(df), subsets, seed))


class Line(Model):
    """Adds `prediction` by an intercept and coefficients."""

    def __init__(self, b: np.ndarray):
        super().__init__()
        self.b = b

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.withColumn("prediction", line(self.b))


class Robust(Estimator):
    """`consensus` or `theil_sen` as an estimator on rows (id, property, features)."""

    def __init__(self, fit, **params: object):
        super().__init__()
        self.fit_rows, self.params_of_fit = fit, params

    def _fit(self, dataset: DataFrame) -> Line:
        return Line(self.fit_rows(dataset, **self.params_of_fit))


class FourierFeatures(Transformer):
    """Scaled vectors z to k: random Fourier features of the Gaussian kernel exp(-gamma |a - b|^2), gamma = width / number of features.

    Directions follow from the seed, so each task makes the same ones and none are sent.
    """

    width = Param(Params._dummy(), "width", "gamma times the number of features", typeConverter=TypeConverters.toFloat)

    def __init__(self, width: float = 1.0, size: int = 256, seed: int = 42):
        super().__init__()
        self.size, self.seed = size, seed
        self._set(width=width)

    @staticmethod
    def lifted(x: np.ndarray, size: int, seed: int, width: float) -> np.ndarray:
        rng = np.random.default_rng(seed)
        w = rng.normal(0, np.sqrt(2 * width / x.shape[1]), (x.shape[1], size))
        return np.sqrt(2 / size) * np.cos(x @ w + rng.uniform(0, 2 * np.pi, size))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        size, seed, width = self.size, self.seed, self.getOrDefault(self.width)

        @F.pandas_udf("array<double>")
        def lift(z: pd.Series) -> pd.Series:
            return pd.Series(list(FourierFeatures.lifted(np.stack(z.to_list()), size, seed, width))) if len(z) else z

        return dataset.withColumn("k", array_to_vector(lift(vector_to_array("z"))))
