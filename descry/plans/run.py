"""A whole model run: select, fit, test, cross-validate, score external rows, judge the domain, count."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from descry.operators import domain, models, relational, select, split, stats
from descry.operators.columns import gather


def model_run(train: DataFrame, test: DataFrame, external: DataFrame, code: str = "reg", folds: int = 5, features: Sequence[int] | None = None, method: str | None = None, measure: str = "knn_euclidean", binary: bool = False, selection: dict | None = None, **params: object) -> tuple[DataFrame, DataFrame]:
    """(predictions, statistics) of a model on rows (id, property, features).

    features: positions to use, else those that `method` selects on the training folds, else all.
    External rows that the model was trained on are left out. predictions: (set, id, exp, pred,
    inside), where set is Training, CV, Test or External and inside is null outside of Test and
    External; statistics: one row a set, and one for each side of the domain in Test and External.
    """
    rows = split.stratified_folds(train, folds, ["property"]) if binary else split.k_folds(train, folds)
    if features is None and method is not None:
        features = select.select_features(method, rows, **(selection or {}))
    if features is not None:
        rows, test, external = (gather(d, features) for d in (rows, test, external))
    external = relational.not_in(external, train, "id")
    model = models.fit(rows, code, binary, **params)
    scored = {"Training": models.predict(model, rows, binary), "CV": models.fold_predictions(rows, code, binary, **params).drop("cv_fold"), "Test": models.predict(model, test, binary), "External": models.predict(model, external, binary)}
    judged = test.withColumn("set", F.lit("Test")).unionByName(external.withColumn("set", F.lit("External")))
    # A row's flag does not depend on the other rows, so both sets are judged at once.
    flags = domain.evaluate(measure, rows.drop("fold"), judged.select("id", "property", "features"))[0]
    if "set" in flags.columns:
        flags = flags.filter("set = 'test'")
    flags = flags.select("id", "inside").dropDuplicates(["id"])
    out = reduce(DataFrame.unionByName, [d.withColumn("set", F.lit(name)) for name, d in scored.items()])
    out = out.join(flags, "id", "left").withColumn("inside", F.when(F.col("set").isin("Test", "External"), F.col("inside"))).select("set", "id", "exp", "pred", "inside")
    parts = out.withColumn("rows", F.lit("all")).unionByName(out.filter("inside is not null").withColumn("rows", F.when(F.col("inside"), "inside").otherwise("outside")))
    if binary:
        return out, stats.binary(parts, "set", "rows")
    return out, stats.continuous(parts, "set", "rows", mean=stats.training_mean(scored["Training"]))
