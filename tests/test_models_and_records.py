import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from descry.operators import models, records, select
from descry.streaming import scoring

RECORDS = [(1, "pH", 7.0, 1), (1, "Temp (C)", 20.0, 3), (1, "pH", 8.0, 2), (2, "pH", 6.0, 1), (3, None, None, 1)]


@pytest.fixture(scope="module")
def parameters(spark):
    return spark.createDataFrame(RECORDS, "id int, name string, value double, seq int")


@pytest.mark.parametrize(
    ("way", "want"),
    [
        ("id_suffix", {1: {"ph_1": 7.0, "ph_2": 8.0, "temp_c": 20.0}, 2: {"ph": 6.0}, 3: {}}),
        ("first", {1: {"ph": 7.0, "temp_c": 20.0}, 2: {"ph": 6.0}, 3: {}}),
        ("list", {1: {"ph": [7.0, 8.0], "temp_c": [20.0]}, 2: {"ph": [6.0]}, 3: {}}),
    ],
)
def test_parameter_pivot(parameters, way, want):
    got = records.parameter_pivot(parameters, "id", "name", ["value"], "seq", way).collect()
    assert {r["id"]: {k: v for k, v in r.asDict().items() if k != "id" and v is not None} for r in got} == want


def test_parameter_pivot_edges(parameters):
    two = records.parameter_pivot(parameters, "id", "name", ["value", "seq"], "seq", "first", prefix="exp_")
    assert set(two.columns) == {"id", "exp_ph_value", "exp_ph_seq", "exp_temp_c_value", "exp_temp_c_seq"}
    assert records.parameter_pivot(parameters.limit(0), "id", "name", ["value"], "seq").collect() == []
    with pytest.raises(ValueError, match="more than 1 parameter"):
        records.parameter_pivot(parameters, "id", "name", ["value"], "seq", most_columns=1)
    with pytest.raises(ValueError, match="no such way"):
        records.parameter_pivot(parameters, "id", "name", ["value"], "seq", "last")


def test_reports(spark):
    p = spark.createDataFrame([(1, 2.0, 1.5), (2, 1.0, None), (3, 0.0, 4.0)], "id int, exp double, pred double")
    subs = spark.createDataFrame([(1, "a"), (3, "c")], "id int, name string")
    flags = spark.createDataFrame([(1, True), (2, False)], "id int, inside boolean")
    out = {r["id"]: r for r in records.test_table(p, subs, {"knn": flags}).collect()}
    assert (out[1]["abs_error"], out[1]["AD_knn"], out[2]["abs_error"], out[2]["name"], out[3]["AD_knn"]) == (0.5, True, None, None, None)
    # 1 and 3 are training members, 2 lacks a prediction.
    more = p.unionByName(spark.createDataFrame([(4, 1.0, 2.0)], "id int, exp double, pred double"))
    assert sorted(r["id"] for r in records.external_table(more, subs, subs).collect()) == [4]
    row = p.filter("id = 1").select(records.prediction_report(F.col("id"), F.col("pred"), F.lit(None).cast("boolean"), F.array(F.lit(7)), "mg/L").alias("j")).first()
    assert json.loads(row["j"]) == {"query": 1, "value": 1.5, "unit": "mg/L", "domain": "Unknown", "neighbours": [7]}
    runs = spark.createDataFrame([("r", "rf")], "run_id string, method string")
    stats = spark.createDataFrame([("r", "test", "MAE", 0.5), ("r", "training", "MAE", 0.25)], "run_id string, set string, name string, value double")
    assert json.loads(records.results_document(runs, stats).first()["document"]) == {"details": {"method": "rf"}, "statistics": {"test": {"MAE": 0.5}, "training": {"MAE": 0.25}}}


@pytest.fixture(scope="module")
def line(spark):
    """y = 3 + 2 a - b and noise; c is noise alone."""
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 3)) + [100, 0, 0]
    y = 3 + 2 * x[:, 0] - x[:, 1] + 0.1 * rng.normal(size=300)
    rows = [(i, float(y[i]), x[i].tolist(), i % 5) for i in range(300)]
    return x, y, spark.createDataFrame(rows, "id long, property double, features array<double>, fold int")


def test_least_squares(line):
    x, y, df = line
    a = np.column_stack([np.ones(len(x)), x])
    b, rest = np.linalg.lstsq(a, y, rcond=None)[:2]
    error = np.sqrt(np.diag(np.linalg.inv(a.T @ a)) * rest[0] / (len(y) - 4))
    got = models.least_squares(df, ["a", "b", "c"]).collect()
    assert [r["name"] for r in got] == ["intercept", "a", "b", "c"]
    assert np.allclose([r["estimate"] for r in got], b) and np.allclose([r["std_error"] for r in got], error)
    assert models.least_squares(df.limit(0), ["a", "b", "c"]).count() == 0


def test_fold_predictions(line):
    _, _, df = line
    own = {r["id"]: r["pred"] for r in models.fold_least_squares(df).collect()}
    mllib = {r["id"]: r["pred"] for r in models.fold_predictions(df, "reg").collect()}
    assert own.keys() == mllib.keys() and all(abs(own[i] - mllib[i]) < 1e-4 for i in own)


@pytest.mark.parametrize("code", ["las", "hub", "rf", "gbt"])
def test_estimators(line, code):
    _, _, df = line
    small = {"rf": {"numTrees": 20}, "gbt": {"maxIter": 10}}.get(code, {})
    out = models.predict(models.fit(df, code, **small), df)
    assert out.agg(F.corr("exp", "pred")).first()[0] > 0.9
    if code == "rf":
        both = df.withColumn("property", (F.col("property") > 203).cast("double"))
        p = models.predict(models.fit(both, code, binary=True, **small), both, binary=True)
        assert p.filter("pred < 0 or pred > 1").count() == 0 and p.agg(F.corr("exp", "pred")).first()[0] > 0.8
    if code == "las":
        with pytest.raises(ValueError, match="fits no classes"):
            models.estimator("las", binary=True)


def test_grid_search(line):
    best, scores = models.grid_search(line[2], "las", {"regParam": [0.001, 5.0]})
    assert best == {"regParam": 0.001} and len(scores) == 2


def test_selection(line, spark):
    _, _, df = line
    assert sorted(select.forward(df, 3)) == [0, 1] == sorted(select.eliminate(df, [0, 1, 2], 2))
    assert sorted(select.evolve(df, generations=3, population=12)) == [0, 1]
    scored = select.score_subsets(spark.createDataFrame([([0, 1],), ([2],)], "features array<int>"), select.grams_of(df), 0.01).collect()
    assert scored[0]["mean"] > 0.99 > 0.1 > scored[1]["mean"] and abs(scored[0]["fitness"] - (scored[0]["mean"] - scored[0]["std"] - 0.02)) < 1e-12
    assert select.forward(df.limit(0), 2) == [] == select.evolve(df.limit(0))


def test_score_new(spark, tmp_path):
    schema, place = "id int, score double", str(tmp_path / "place")

    def arrive(rows):
        spark.createDataFrame(rows, "id int, v double").write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("id int, v double").parquet(str(tmp_path / "in"))
        scoring.score_new(stream, lambda d: d.select("id", (F.col("v") * 2).alias("score")), "id", str(tmp_path / "out"), schema, place).awaitTermination()
        return sorted((r["id"], r["score"]) for r in spark.read.schema(schema).parquet(str(tmp_path / "out")).collect())

    assert arrive([(1, 1.0), (2, 2.0), (2, 2.0)]) == [(1, 2.0), (2, 4.0)]
    assert arrive([(2, 9.0), (3, 3.0)]) == [(1, 2.0), (2, 4.0), (3, 6.0)]


def test_answer_requests(spark, tmp_path):
    schema, asked = "id int, model int", []

    def arrive(rows):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))

        def work(d):
            asked.append(sorted((r["id"], r["model"]) for r in d.collect()))
            return d.select("id", "model", (F.col("id") * 10 + F.col("model")).alias("result"))

        scoring.answer_requests(stream, work, ["id", "model"], str(tmp_path / "cache"), schema + ", result int", str(tmp_path / "answers"), str(tmp_path / "place")).awaitTermination()
        return sorted((r["batch"], r["id"], r["model"], r["result"], r["hit"]) for r in spark.read.parquet(str(tmp_path / "answers")).collect())

    first = arrive([(1, 1), (1, 1), (2, 1)])
    assert first == [(0, 1, 1, 11, False), (0, 1, 1, 11, False), (0, 2, 1, 21, False)]
    assert arrive([(1, 1), (1, 2)]) == [*first, (1, 1, 1, 11, True), (1, 1, 2, 12, False)]
    assert asked == [[(1, 1), (2, 1)], [(1, 2)]]


def test_ward_clusters():
    x = np.array([[0.0], [10.0], [0.1], [10.2], [50.0]])
    assert select.ward_clusters(x, 1.0) == [0, 1, 0, 1, 2]
    assert select.ward_clusters(x, 0.01) == [0, 1, 2, 3, 4] and select.ward_clusters(x, 1e9) == [0] * 5
    # Two pairs merge at sqrt(2 * 2 * 2 / (2 + 2)) times the distance of their means.
    pairs = np.array([[0.0], [1.0], [10.0], [11.0]])
    assert select.ward_clusters(pairs, 14.1) == [0, 0, 1, 1] and select.ward_clusters(pairs, 14.2) == [0] * 4
    assert select.ward_clusters(x[:1], 1.0) == [0]


def test_uncorrelated(spark):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(2, 200))
    df = spark.createDataFrame([([float(u), float(u**3), float(v)],) for u, v in zip(a, b, strict=True)], "features array<double>")
    assert select.uncorrelated(df, 0.5) == [0, 2] and select.uncorrelated(df.limit(0), 0.5) == []
