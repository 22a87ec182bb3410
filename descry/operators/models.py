"""Fitting and applying models: MLlib estimators by code, least squares from sums of products."""

from __future__ import annotations

import random
from collections.abc import Callable, Sequence
from functools import reduce
from itertools import product

import numpy as np
from pyspark.ml import Estimator, Model, Pipeline, Transformer
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import Evaluator, RegressionEvaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from descry.operators import order, split, stats
from descry.operators.kernel_machine import KernelMachine
from descry.operators.linalg import fold_grams, gram, with_target
from descry.operators.robust import FourierFeatures, Robust, consensus, theil_sen
from descry.sources.tables import shared_dir, write_by

SEED = 42
_COLUMNS = {"featuresCol": "x", "labelCol": "property"}
#: Code to (regressor, classifier); None where there is none.
ESTIMATORS: dict[str, tuple[Callable[..., Estimator] | None, Callable[..., Estimator] | None]] = {
    "reg": (lambda **p: LinearRegression(**_COLUMNS, **{"regParam": 0.0, **p}), lambda **p: LogisticRegression(**_COLUMNS, **p)),
    "las": (lambda **p: LinearRegression(**_COLUMNS, **{"elasticNetParam": 1.0, "regParam": 0.01, "standardization": False, **p}), None),
    "hub": (lambda **p: LinearRegression(**_COLUMNS, **{"loss": "huber", "epsilon": 1.35, "regParam": 1e-4, **p}), None),
    "rf": (lambda **p: RandomForestRegressor(**_COLUMNS, **{"numTrees": 100, "maxDepth": 8, "seed": SEED, **p}), lambda **p: RandomForestClassifier(**_COLUMNS, **{"numTrees": 100, "maxDepth": 8, "seed": SEED, **p})),
    "gbt": (lambda **p: GBTRegressor(**_COLUMNS, **{"maxIter": 50, "maxDepth": 4, "seed": SEED, **p}), lambda **p: GBTClassifier(**_COLUMNS, **{"maxIter": 50, "maxDepth": 4, "seed": SEED, **p})),
    "ransac": (lambda **p: Robust(consensus, **p), lambda **p: LogisticRegression(**_COLUMNS, **p)),
    "theil_sen": (lambda **p: Robust(theil_sen, **p), lambda **p: LogisticRegression(**_COLUMNS, **p)),
    # Support vector machines on the same random features, with their own losses.
    "svm": (lambda **p: KernelMachine(False, **p), lambda **p: KernelMachine(True, **p)),
    # A Gaussian kernel by random features: ridge or logistic on them, in place of a support vector machine's losses.
    "rbf": (lambda **p: LinearRegression(**_COLUMNS, **{"regParam": 1e-3, "standardization": False, **p}), lambda **p: LogisticRegression(**_COLUMNS, **{"regParam": 1e-3, "standardization": False, **p})),
}
#: Parameters that a search tries for each code, unless it is given others.
GRIDS: dict[str, dict[str, Sequence]] = {
    "reg": {},
    "las": {"regParam": [float(x) for x in np.logspace(-4, 0, 20)]},
    "hub": {"epsilon": [1.1, 1.35, 1.5], "regParam": [1e-4, 1e-2]},
    "rf": {"numTrees": [50, 100], "maxDepth": [5, 8]},
    "gbt": {"maxIter": [20, 50], "maxDepth": [3, 5]},
    "ransac": {},
    "theil_sen": {},
    "svm": {"c": [1.0, 10.0, 100.0], "width": [0.5, 1.0]},
    "rbf": {"regParam": [1e-2, 1e-3, 1e-4], "width": [0.5, 1.0, 2.0]},
}
#: Rows beyond which a kernel's grid is not searched: one combination is used.
MOST_FOR_KERNEL_GRID = 20_000


class PopulationScaler(Estimator):
    """Vectors x to z: centred and divided by the population's standard deviation (zero counts as one)."""

    def _fit(self, dataset: DataFrame) -> Transformer:
        each = dataset.select(F.posexplode(vector_to_array("x")).alias("i", "v")).groupBy("i").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
        rows = sorted(each.collect())
        return Scaled([r["m"] for r in rows], [r["s"] or 1.0 for r in rows])


class Scaled(Model):
    def __init__(self, mean: list[float] | None = None, spread: list[float] | None = None):
        super().__init__()
        self.mean, self.spread = mean, spread

    def _transform(self, dataset: DataFrame) -> DataFrame:
        vector = lambda v: F.array(*map(F.lit, v))
        centred = F.zip_with(vector_to_array("x"), vector(self.mean), lambda x, m: x - m)
        return dataset.withColumn("z", array_to_vector(F.zip_with(centred, vector(self.spread), lambda x, s: x / s)))


class BalancedAccuracy(Evaluator):
    """Mean of the two classes' rates of hits; a class without rows has no part in it."""

    def _evaluate(self, dataset: DataFrame) -> float:
        hit = F.col("prediction") == F.col("property")
        rates = dataset.groupBy("property").agg(F.avg(hit.cast("int")).alias("rate"))
        return rates.agg(F.avg("rate").alias("ba")).first()["ba"] or 0.0

    def isLargerBetter(self) -> bool:
        return True


#: Codes whose classifier is a logistic regression with the usual penalty.
LOGISTIC = ("reg", "ransac", "theil_sen")
#: Codes whose features are standardised first.
SCALED = ("reg", "las", "hub", "svm")


def estimator(code: str, binary: bool = False, **params: object) -> Estimator:
    """The estimator of a code, behind a scaler where the method needs one."""
    make = ESTIMATORS[code][1 if binary else 0]
    if make is None:
        raise ValueError(f"{code} fits no {'classes' if binary else 'numbers'}")
    if code == "rbf":
        lift = FourierFeatures(**{n: params.pop(n) for n in ("width", "size", "seed") if n in params})
        return Pipeline(stages=[PopulationScaler(), lift, make(**params).setFeaturesCol("k")])
    if code not in SCALED:
        return make(**params)
    own = make(**params)
    return Pipeline(stages=[PopulationScaler(), own if isinstance(own, KernelMachine) else own.setFeaturesCol("z")])


def _vectors(df: DataFrame) -> DataFrame:
    return df.withColumn("x", array_to_vector("features"))


def fit(train: DataFrame, code: str, binary: bool = False, **params: object) -> Model:
    """A model on rows (property, features); rows without a target are left out.

    A logistic regression's penalty is 1 / (n C), with C = 1 unless it or regParam is given.
    """
    rows = train.filter("property is not null")
    if binary and code in LOGISTIC and "regParam" not in params:
        params["regParam"] = 1 / (max(rows.count(), 1) * params.pop("C", 1.0))
    return estimator(code, binary, **params).fit(_vectors(rows))


def predict(model: Model, rows: DataFrame, binary: bool = False) -> DataFrame:
    """(id, exp, pred); pred is the probability of class 1 if binary."""
    out = model.transform(_vectors(rows))
    pred = vector_to_array("probability")[1] if binary else F.col("prediction")
    return out.select("id", F.col("property").alias("exp"), pred.alias("pred"))


def fold_predictions(df: DataFrame, code: str, binary: bool = False, **params: object) -> DataFrame:
    """(id, exp, pred, cv_fold): each fold predicted by a model of the others; the number of folds is small.

    The rows are computed once and written by fold, so that a model reads the files of its folds and
    a fold's predictions those of that fold alone. Rows without a fold are left out.
    """
    path = shared_dir(df.sparkSession)
    own = df.filter("fold is not null").select("id", "property", "features", *([c] if (c := params.get("weightCol")) else []), F.col("fold").cast("int").alias("fold"))
    write_by(own, path, "fold")
    rows = df.sparkSession.read.schema(own.schema).parquet(path)
    folds = [r["fold"] for r in rows.select("fold").distinct().orderBy("fold").collect()]
    if not folds:
        raise ValueError("no rows with a fold")
    parts = [predict(fit(rows.filter(F.col("fold") != k), code, binary, **params), rows.filter(F.col("fold") == k), binary).withColumn("cv_fold", F.lit(k)) for k in folds]
    return reduce(lambda a, b: a.unionByName(b), parts)


def grid_search(df: DataFrame, code: str, grid: dict[str, Sequence] | None = None, binary: bool = False) -> tuple[dict[str, object], list[tuple[dict[str, object], float]]]:
    """The best parameters by cross-validation over `fold`, and the mean score of each combination (RMSE, or balanced accuracy).

    grid: that of GRIDS unless given (for a kernel, up to MOST_FOR_KERNEL_GRID rows). A single combination is returned without a fit.
    """
    values = GRIDS[code] if grid is None else grid
    if grid is None and code == "rbf" and df.limit(MOST_FOR_KERNEL_GRID + 1).count() > MOST_FOR_KERNEL_GRID:
        return {}, []
    names = list(values)
    return search(df, code, [dict(zip(names, c, strict=True)) for c in product(*(values[n] for n in names))], binary)


def random_search(df: DataFrame, code: str, tries: int, grid: dict[str, Sequence] | None = None, binary: bool = False, seed: int = SEED) -> tuple[dict[str, object], list[tuple[dict[str, object], float]]]:
    """The same over `tries` combinations drawn from the grid without repeats."""
    values = GRIDS[code] if grid is None else grid
    combos = [dict(zip(values, c, strict=True)) for c in product(*values.values())]
    return search(df, code, random.Random(seed).sample(combos, min(tries, len(combos))), binary)


def search(df: DataFrame, code: str, combos: list[dict[str, object]], binary: bool = False) -> tuple[dict[str, object], list[tuple[dict[str, object], float]]]:
    if len(combos) < 2:
        return (combos or [{}])[0], []
    if code == "svm":
        return search_machines(df, combos, binary)
    own = estimator(code, binary)
    stages = own.getStages() if isinstance(own, Pipeline) else [own]
    maps = [{next(s for s in reversed(stages) if s.hasParam(n)).getParam(n): v for n, v in c.items()} for c in combos]
    judge = BalancedAccuracy() if binary else RegressionEvaluator(labelCol="property", metricName="rmse")
    folds = df.agg(F.max("fold")).first()[0] + 1
    cv = CrossValidator(estimator=own, estimatorParamMaps=maps, evaluator=judge, numFolds=folds, foldCol="fold", parallelism=4)
    scores = cv.fit(_vectors(df.filter("property is not null"))).avgMetrics
    best = int(np.argmax(scores) if judge.isLargerBetter() else np.argmin(scores))
    return combos[best], list(zip(combos, scores, strict=True))


def search_machines(df: DataFrame, combos: list[dict[str, object]], binary: bool) -> tuple[dict[str, object], list[tuple[dict[str, object], float]]]:
    """The same for kernel machines: in each fold all combinations of one epsilon, gap and seed are trained in the same passes over the rows."""
    rows = df.filter("property is not null")
    judge = BalancedAccuracy() if binary else RegressionEvaluator(labelCol="property", metricName="rmse")
    scores: list[list[float]] = [[] for _ in combos]
    alike: dict[tuple, list[int]] = {}
    for i, c in enumerate(combos):
        alike.setdefault(tuple(sorted((n, v) for n, v in c.items() if n not in ("c", "width"))), []).append(i)
    for k in range(rows.agg(F.max("fold")).first()[0] + 1):
        learn, apart = _vectors(rows.filter(F.col("fold") != k)), _vectors(rows.filter(F.col("fold") == k))
        scaler = PopulationScaler().fit(learn)
        for rest, members in alike.items():
            base = KernelMachine(binary, **dict(rest))
            widths, cs = ([combos[i].get(n, getattr(base, n)) for i in members] for n in ("width", "c"))
            fits = base.fit_all(scaler.transform(learn), widths, cs)
            for i, w, c in zip(members, widths, cs, strict=True):
                scores[i].append(judge.evaluate(fits[w, c].transform(scaler.transform(apart))))
    mean = [float(np.mean(s)) for s in scores]
    best = int(np.argmax(mean) if judge.isLargerBetter() else np.argmin(mean))
    return combos[best], list(zip(combos, mean, strict=True))


def smallest_gap(df_train: DataFrame, df_test: DataFrame, code: str, combos: list[dict[str, object]], tolerance: float = 0.05, step: float = 0.005) -> tuple[dict[str, object], float]:
    """The combination of the best test r2 whose train and test r2 differ by less than a tolerance, widened by steps until one does; and that tolerance."""
    table = []
    for c in combos:
        model = fit(df_train, code, **c)
        r2 = [predict(model, d).agg(F.regr_r2("pred", "exp").alias("r2")).first()["r2"] or 0.0 for d in (df_train, df_test)]
        table.append((c, r2[1], abs(r2[0] - r2[1])))
    if not table:
        raise ValueError("no combination to try")
    widened = max(0, int(np.ceil((min(g for *_, g in table) - tolerance) / step - 1e-9)))
    while not (near := [x for x in table if x[2] < tolerance + widened * step]):
        widened += 1
    return max(near, key=lambda x: x[1])[0], tolerance + widened * step


def representative_split(df: DataFrame, k: int = 5, binary: bool = False, seed: int = SEED, **params: object) -> DataFrame:
    """df (id, property, features) with `fold` and `split_num`: held out (1) is the fold whose score is closest to that of all folds together.

    Each fold is predicted by a forest of the others (class weights balanced); the score is
    balanced accuracy, or r2.
    """
    folded = split.stratified_folds(df, k, ["property"], seed) if binary else split.k_folds(df, k, seed)
    if binary:
        n = folded.groupBy("property").count().collect()
        total = sum(r["count"] for r in n)
        weight = F.create_map(*[F.lit(x) for r in n for x in (float(r["property"]), total / (len(n) * r["count"]))])
        folded, params = folded.withColumn("weight", weight[F.col("property").cast("double")]), {"weightCol": "weight", **params}
    out = fold_predictions(folded, "rf", binary, **params)
    score = (lambda d, *by: stats.binary(d, *by).select(*by, F.col("BA").alias("score"))) if binary else (lambda d, *by: d.groupBy(*by).agg(F.regr_r2("pred", "exp").alias("score")))
    per = score(out, "cv_fold").withColumnRenamed("cv_fold", "fold")
    chosen = order.closest_fold(per, score(out).first()["score"])
    return folded.drop("weight").withColumn("split_num", (F.col("fold") == chosen).cast("int"))


def score_batch(model: Model, rows: DataFrame, width: int, binary: bool = False) -> DataFrame:
    """(id, exp, pred, status) of every row: ok, or why it has no prediction. A bad row is an answer, not an error."""
    feats = F.col("features")
    status = (
        F.when(feats.isNull(), "no descriptors")
        .when(F.size(feats) != width, F.concat(F.lit(f"expected {width} descriptors, got "), F.size(feats).cast("string")))
        .when(F.exists(feats, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), "missing or infinite descriptor")
        .otherwise("ok")
    )
    judged = rows.withColumn("status", status)
    good = predict(model, judged.filter("status = 'ok'"), binary).withColumn("status", F.lit("ok"))
    bad = judged.filter("status <> 'ok'").select("id", F.col("property").alias("exp"), F.lit(None).cast("double").alias("pred"), "status")
    return good.unionByName(bad)


def y_randomised(train: DataFrame, validation: DataFrame, code: str, seeds: Sequence[int] = (1, 2, 3), **params: object) -> DataFrame:
    """(seed, set, r2): squared correlation on both sets of models fitted to permuted targets, a control that a sound model must beat by far."""
    parts = []
    for seed in seeds:
        model = fit(split.shuffled_target(train.filter("property is not null"), seed), code, **params)
        both = predict(model, train).withColumn("set", F.lit("training")).unionByName(predict(model, validation).withColumn("set", F.lit("validation")))
        parts.append(both.groupBy("set").agg((F.corr("exp", "pred") ** 2).alias("r2")).withColumn("seed", F.lit(seed)))
    return reduce(DataFrame.unionByName, parts).select("seed", "set", "r2")


def models_compared(models: dict[str, Model], test: DataFrame, binary: bool = False) -> DataFrame:
    """One row of statistics on the same test rows for each model."""
    parts = [predict(m, test, binary).withColumn("model", F.lit(name)) for name, m in models.items()]
    return (stats.binary if binary else stats.continuous)(reduce(DataFrame.unionByName, parts), "model")


def logistic_curve(df: DataFrame, l2: float = 0.0) -> tuple[Model, list[tuple[str, float, float]]]:
    """A logistic model and (name, estimate, standard error) by the observed information, intercept first, in the features' own units."""
    rows = df.filter("property is not null")
    model = LogisticRegression(**_COLUMNS, regParam=l2, standardization=False).fit(_vectors(rows))
    coef = [model.intercept, *model.coefficients.toArray().tolist()]
    eta = F.aggregate(F.zip_with("features", F.array(*map(F.lit, coef[1:])), lambda x, w: x * w), F.lit(coef[0]), lambda a, v: a + v)
    p = 1 / (1 + F.exp(-eta))
    root = F.sqrt(p * (1 - p))
    weighted = rows.select(F.transform(F.concat(F.array(F.lit(1.0)), "features"), lambda x: x * root).alias("features"))
    n, _, information = gram(weighted)
    penalty = np.eye(len(coef)) * l2 * n
    penalty[0, 0] = 0
    error = np.sqrt(np.maximum(np.diag(np.linalg.pinv(information + penalty)), 0))
    return model, [(x, float(b), float(e)) for x, b, e in zip(["intercept", *(f"x{i}" for i in range(len(coef) - 1))], coef, error, strict=True)]


def _solve(g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients and (X'X)^-1 from the sums of products of [1, x, y]."""
    inverse = np.linalg.pinv(g[:-1, :-1], hermitian=True)
    return inverse @ g[:-1, -1], inverse


def least_squares(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """(name, estimate, std_error, t) with the intercept first, from one pass of sums of products.

    The features are centred on their means in a first pass, which keeps the sums well conditioned.
    Fewer rows than coefficients: no standard errors.
    """
    rows = df.filter("property is not null")
    n, s, _ = gram(with_target(rows, intercept=False))
    if not n:
        return df.sparkSession.createDataFrame([], "name string, estimate double, std_error double, t double")
    m = s / n
    centred = rows.withColumn("features", F.zip_with("features", F.array(*[F.lit(float(v)) for v in m[:-1]]), lambda x, c: x - c)).withColumn("property", F.col("property") - float(m[-1]))
    _, _, g = gram(with_target(centred))
    b, inverse = _solve(g)
    rest, left = float(g[-1, -1] - b @ g[:-1, -1]), n - len(b)
    # Back to the features as they were: the intercept takes the means.
    back = np.eye(len(b))
    back[0, 1:] = -m[:-1]
    b, inverse = back @ b, back @ inverse @ back.T
    b[0] += m[-1]
    error = np.sqrt(np.maximum(np.diag(inverse) * rest / left, 0)) if left > 0 else [None] * len(b)
    out = [(x, float(v), None if e is None else float(e), float(v / e) if e else None) for x, v, e in zip(["intercept", *names], b, error, strict=True)]
    return df.sparkSession.createDataFrame(out, "name string, estimate double, std_error double, t double")


def fold_least_squares(df: DataFrame) -> DataFrame:
    """(id, exp, pred, cv_fold) by least squares: one pass gives every fold's sums, the others' sums its coefficients."""
    grams = fold_grams(with_target(df.filter("property is not null")), "fold")
    total = sum(g for _, _, g in grams.values())
    coefficients = {k: _solve(total - g)[0].tolist() for k, (_, _, g) in grams.items()}

    def row(c: list[float]) -> Column:
        return F.aggregate(F.zip_with("features", F.array(*map(F.lit, c[1:])), lambda x, w: x * w), F.lit(c[0]), lambda a, v: a + v)

    pred = reduce(lambda out, k: F.when(F.col("fold") == k, row(coefficients[k])).otherwise(out), coefficients, F.lit(None).cast("double"))
    return df.select("id", F.col("property").alias("exp"), pred.alias("pred"), F.col("fold").alias("cv_fold"))
