"""Feature selection: subsets scored from the folds' sums of products, so that rows are read once."""

from __future__ import annotations

import json
import warnings
from collections import Counter
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Correlation
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from descry.operators import models
from descry.operators.columns import gather
from descry.operators.importance import permutation_importance
from descry.operators.linalg import Grams, grams_of
from descry.operators.stepwise import eliminated, stepwise

SCORES = "features array<int>, mean double, std double, fitness double"
#: Fitness of a subset from the mean and deviation of its folds' R2 and its length.
Fitness = Callable[[float, float, int], float]


def penalised(penalty: float) -> Fitness:
    """mean - std - penalty * length."""
    return lambda mean, std, length: mean - std - penalty * length


def _fold_scores(grams: list[tuple[int, np.ndarray]], subset: Sequence[int]) -> np.ndarray:
    """R2 on each fold of the least squares of the others, for features at these positions."""
    at = [0, *(i + 1 for i in subset)]
    total, out = sum(g for _, g in grams), []
    for n, g in grams:
        rest = total - g
        b = np.linalg.lstsq(rest[np.ix_(at, at)], rest[at, -1], rcond=None)[0]
        left = g[-1, -1] - 2 * b @ g[at, -1] + b @ g[np.ix_(at, at)] @ b
        spread = g[-1, -1] - g[0, -1] ** 2 / n
        out.append(1 - left / spread if spread > 0 else np.nan)
    return np.array(out)


def score_subsets(candidates: DataFrame, grams: Grams, penalty: float | Fitness = 0.0) -> DataFrame:
    """candidates (features: array of positions) with the mean and deviation of their folds' R2 and
    fitness = mean - std - penalty * length, or a function of these three in place of the penalty. The sums, sent to the tasks, have the size of the
    features squared, whatever the number of rows."""
    fit = penalty if callable(penalty) else penalised(penalty)
    sent = candidates.sparkSession.sparkContext.broadcast([(n, g) for _, (n, _, g) in sorted(grams.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            subsets = batch.column(0).to_pylist()
            scores = [_fold_scores(sent.value, s) for s in subsets]
            mean, std = [float(s.mean()) for s in scores], [float(s.std()) for s in scores]
            fitness = [float(fit(m, d, len(s))) for m, d, s in zip(mean, std, subsets, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(mean, pa.float64()), pa.array(std, pa.float64()), pa.array(fitness, pa.float64())], names=["features", "mean", "std", "fitness"])

    return candidates.select(F.col("features").cast("array<int>").alias("features")).mapInArrow(run, SCORES)


def _best(df: DataFrame, subsets: list[list[int]], grams: Grams, penalty: float | Fitness) -> tuple[list[int], float] | None:
    spark = df.sparkSession
    rows = spark.createDataFrame([(s,) for s in subsets], "features array<int>").repartition(min(len(subsets), spark.sparkContext.defaultParallelism))
    best = score_subsets(rows, grams, penalty).filter(~F.isnan("fitness")).orderBy(F.desc("fitness"), F.to_json("features")).first()
    return None if best is None else (best["features"], best["fitness"])


def forward(df: DataFrame, most: int, penalty: float | Fitness = 0.002) -> list[int]:
    """Greedy: adds the feature that lifts fitness most, until none does or `most` are in."""
    grams, chosen, fitness = grams_of(df), [], -np.inf
    p = len(next(iter(grams.values()))[1]) - 2 if grams else 0
    while len(chosen) < min(most, p):
        best = _best(df, [[*chosen, j] for j in range(p) if j not in chosen], grams, penalty)
        if best is None or best[1] <= fitness:
            break
        chosen, fitness = best
    return chosen


def eliminate(df: DataFrame, start: Sequence[int], size: int, penalty: float | Fitness = 0.002) -> list[int]:
    """Recursive elimination: drops the feature whose loss hurts fitness least, down to `size`."""
    grams, chosen = grams_of(df), list(start)
    while len(chosen) > max(size, 1):
        best = _best(df, [[c for c in chosen if c != j] for j in chosen], grams, penalty)
        if best is None:
            break
        chosen = best[0]
    return chosen


def populations(df: DataFrame, runs: int = 1, generations: int = 20, population: int = 100, penalty: float | Fitness = 0.002, seed: int = 42, among: Sequence[int] | None = None, most: int | None = None) -> list[list[int]]:
    """The best subset of each of `runs` evolutionary searches, which start from seeds of their own.

    A generation of all runs is one scoring job over their different subsets; in each run the better
    half stays and its pairs make the rest. among: the positions to choose from, all unless given;
    most: features of a subset. The driver holds the populations only.
    """
    grams = grams_of(df)
    if not grams:
        return []
    spark, width = df.sparkSession, len(next(iter(grams.values()))[1]) - 2
    at = np.arange(width) if among is None else np.array(sorted(among), int)
    p = len(at)
    if not p:
        return []
    rngs = [np.random.default_rng(seed + r) for r in range(runs)]
    alive = [rng.random((population, p)) < min(0.5, (most or 10) / p) for rng in rngs]

    def narrowed(rows: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        rows[~rows.any(1), 0] = True
        for i in np.flatnonzero(rows.sum(1) > (most or p)).tolist():
            rows[i, rng.permutation(np.flatnonzero(rows[i]))[most:]] = False
        return rows

    best: list[list[int]] = []
    for _ in range(generations):
        alive = [narrowed(a, rng) for a, rng in zip(alive, rngs, strict=True)]
        named = [sorted({tuple(at[row].tolist()) for row in a}) for a in alive]
        rows = spark.createDataFrame([(list(s),) for s in sorted({s for own in named for s in own})], "features array<int>").repartition(spark.sparkContext.defaultParallelism)
        fitness = {tuple(r["features"]): r["fitness"] for r in score_subsets(rows, grams, penalty).filter(~F.isnan("fitness")).collect()}
        best = []
        for r, own in enumerate(named):
            ranked_own = sorted((s for s in own if s in fitness), key=lambda s: (-fitness[s], json.dumps(s, separators=(",", ":"))))
            best.append(list(ranked_own[0]) if ranked_own else [])
            if not ranked_own:
                continue
            kept = np.zeros((min(len(ranked_own), population // 2), p), bool)
            for i, s in enumerate(ranked_own[: len(kept)]):
                kept[i, np.searchsorted(at, s)] = True
            rng = rngs[r]
            a, b = (kept[rng.integers(len(kept), size=population - len(kept))] for _ in range(2))
            alive[r] = np.vstack([kept, np.where(rng.random(a.shape) < 0.5, a, b) ^ (rng.random(a.shape) < 1 / p)])
    return best


def evolve(df: DataFrame, generations: int = 20, population: int = 100, penalty: float | Fitness = 0.002, seed: int = 42, most: int | None = None) -> list[int]:
    """Evolutionary search of one population."""
    found = populations(df, 1, generations, population, penalty, seed, most=most)
    return found[0] if found else []


def evolve_in_stages(df: DataFrame, runs: int = 10, generations: int = 20, population: int = 100, penalty: float | Fitness = 0.002, share: float = 0.2, most_first: int = 50, most: int = 24, seed: int = 42) -> tuple[list[int], dict[int, int]]:
    """Evolution in two stages, and the votes of the first.

    First `runs` searches over all features, subsets of most_first at most; a feature has a vote for
    each run whose best subset holds it. Those with `share` of the votes go on (all that have one, if
    none has so many), and as many searches choose `most` of them at most; the best of their subsets
    by fitness, then by position, is the result.
    """
    first = populations(df, runs, generations, population, penalty, seed, most=most_first)
    votes = Counter(j for s in first for j in s)
    among = [j for j, n in votes.items() if n >= share * runs] or list(votes)
    second = [s for s in populations(df, runs, generations, population, penalty, seed + runs, among, most) if s]
    if not second:
        return [], dict(votes)
    best = _best(df, sorted(map(list, set(map(tuple, second)))), grams_of(df), penalty)
    return (best[0] if best else []), dict(sorted(votes.items()))


def ward_clusters(x: np.ndarray, threshold: float) -> list[int]:
    """Cluster of each row of x: Ward's merges (Lance-Williams) up to a height of threshold; clusters are numbered by first member."""
    n = len(x)
    d = ((x[:, None] - x[None]) ** 2).sum(-1)
    np.fill_diagonal(d, np.inf)
    size, label = np.ones(n), np.arange(n)
    while n > 1:
        i, j = sorted(np.unravel_index(d.argmin(), d.shape))
        if not np.sqrt(d[i, j]) <= threshold:
            break
        with np.errstate(invalid="ignore"):
            d[i] = d[:, i] = ((size + size[i]) * d[i] + (size + size[j]) * d[j] - size * d[i, j]) / (size + size[i] + size[j])
        d[j] = d[:, j] = d[i, i] = np.inf
        size[i] += size[j]
        label[label == j] = i
        d[i, np.isnan(d[i])] = np.inf
    order = {v: k for k, v in enumerate(dict.fromkeys(label.tolist()))}
    return [order[v] for v in label.tolist()]


def uncorrelated(df: DataFrame, threshold: float) -> list[int]:
    """The first feature of each Ward cluster of the rank correlations; the ranks are computed on the cluster, the
    small matrix is clustered on the driver."""
    if df.isEmpty():
        return []
    r = Correlation.corr(df.select(array_to_vector("features").alias("x")), "x", "spearman").first()[0].toArray()
    labels = ward_clusters(np.nan_to_num(r), threshold)
    return [labels.index(c) for c in range(max(labels) + 1)]


def by_importance(df: DataFrame, code: str = "rf", fraction: float = 0.25, least: int = 3, most: int = 30, runs: int = 5, rounds: int = 10, **params: object) -> list[int]:
    """Positions kept by importance: in each run those with at least `fraction` of the largest importance, `least` to `most` of them; the union of the runs, until a round changes nothing; a warning if `rounds` end before that."""
    p = len(df.select("features").first()["features"]) if not df.isEmpty() else 0
    kept = list(range(p))
    for _ in range(rounds):
        own, union = gather(df, kept), set()
        for run in range(runs):
            weights = models.fit(own, code, seed=run, **params).featureImportances.toArray()
            ranked = sorted(range(len(kept)), key=lambda i: (-weights[i], i))
            enough = sum(weights[i] >= fraction * weights[ranked[0]] for i in ranked)
            union |= {kept[i] for i in ranked[: min(max(enough, least), most)]}
        if sorted(union) == kept:
            break
        kept = sorted(union)
    else:
        warnings.warn(f"features still change after {rounds} rounds: {len(kept)} are left", stacklevel=2)
    return kept


def by_lasso(df: DataFrame, penalty: float = 0.01, least_size: float = 1e-9) -> list[int]:
    """Positions whose coefficient a lasso leaves nonzero."""
    coefficients = models.fit(df, "las", regParam=penalty).stages[-1].coefficients.toArray()
    return np.flatnonzero(np.abs(coefficients) > least_size).tolist()


def ward_linear(df: DataFrame, threshold: float, most: int = 11) -> list[int]:
    """The features of largest coefficient in a linear model on one feature of each Ward cluster."""
    kept = uncorrelated(df, threshold)
    fitted = models.fit(gather(df, kept), "reg").stages[-1].coefficients.toArray()
    return [kept[i] for i in sorted(range(len(kept)), key=lambda i: (-abs(fitted[i]), i))[:most] if fitted[i]]


def ward_forest(df: DataFrame, threshold: float, tries: int = 3, most: int = 12) -> list[int]:
    """The most important features of a forest, its parameters by random search over `fold`, on one feature of each Ward cluster."""
    kept = uncorrelated(df, threshold)
    own = gather(df, kept)
    best, _ = models.random_search(own, "rf", tries)
    weights = models.fit(own, "rf", **best).featureImportances.toArray()
    return [kept[i] for i in sorted(range(len(kept)), key=lambda i: (-weights[i], i))[:most]]


def lasso_then_elimination(df: DataFrame, penalty: float = 0.01, least_size: float = 1e-9) -> list[int]:
    """A lasso's features, of those what recursive elimination keeps, and of those what a lasso on them alone leaves nonzero."""
    kept = eliminated(df, by_lasso(df, penalty, least_size))
    return [kept[i] for i in by_lasso(gather(df, kept), penalty, least_size)] if kept else []


#: Ways to select features by name.
METHODS = {
    "importance": by_importance,
    "lasso": by_lasso,
    "lasso_elimination": lasso_then_elimination,
    "forward": forward,
    "stepwise": lambda df, *a, **k: stepwise(df, *a, **k)[0],
    "elimination": eliminated,
    "evolution": evolve,
    "evolution_in_stages": lambda df, *a, **k: evolve_in_stages(df, *a, **k)[0],
    "ward": uncorrelated,
    "ward_linear": ward_linear,
    "ward_forest": ward_forest,
}


#: Names that others take from here.
__all__ = ["METHODS", "grams_of", "permutation_importance", "score_subsets", "select_features"]


def select_features(method: str, df: DataFrame, *args: object, **params: object) -> list[int]:
    if method not in METHODS:
        raise ValueError(f"no such method: {method}; there are {', '.join(METHODS)}")
    return METHODS[method](df, *args, **params)


def stored_embedding(embeddings: DataFrame, dataset: str) -> list[str]:
    """The feature names stored for a dataset (dataset, names: tab-separated); a dataset without one is an error, and so is a text without a tab that names nothing known."""
    row = embeddings.filter(F.col("dataset") == dataset).select("names").first()
    if row is None or not (row["names"] or "").strip():
        raise ValueError(f"no stored features for {dataset}")
    return parse_feature_list(row["names"])


def parse_feature_list(text: str | None) -> list[str]:
    """Tab-separated names; blank is none, other text without a tab is an error."""
    if not (text or "").strip():
        return []
    if "\t" not in text:
        raise ValueError("feature names must be separated by tabs")
    return [x.strip() for x in text.split("\t") if x.strip()]
