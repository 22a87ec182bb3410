"""Scaling, searches, representative hold-out, selection, batch scoring and neighbours in tiles."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from descry.operators import columns, knn, linalg, models, order, select, split
from descry.sources import tables


@pytest.fixture(scope="module")
def line(spark):
    """y = 3 a - 2 b, c is noise."""
    rng = np.random.default_rng(0)
    x = rng.normal(0, 1, (200, 3))
    rows = [(i, float(3 * a - 2 * b + 0.01 * rng.normal()), [float(a), float(b), float(c)]) for i, (a, b, c) in enumerate(x)]
    return split.k_folds(spark.createDataFrame(rows, "id long, property double, features array<double>"), 4).cache()


def test_scaler_takes_the_population(spark):
    df = spark.createDataFrame([(1, [1.0, 5.0]), (2, [3.0, 5.0])], "id int, features array<double>")
    scaled = models.PopulationScaler().fit(models._vectors(df)).transform(models._vectors(df))
    assert [r["z"].toArray().tolist() for r in scaled.orderBy("id").collect()] == [[-1.0, 0.0], [1.0, 0.0]]


def test_balanced_accuracy_by_hand(spark):
    df = spark.createDataFrame([(1.0, 1.0), (1.0, 0.0), (0.0, 0.0), (0.0, 0.0), (0.0, 1.0), (0.0, 0.0)], "property double, prediction double")
    assert models.BalancedAccuracy().evaluate(df) == pytest.approx((0.5 + 0.75) / 2)
    assert models.BalancedAccuracy().evaluate(df.filter("property = 0")) == 0.75


def test_search(line):
    best, scores = models.grid_search(line, "las", {"regParam": [0.001, 1.0]})
    assert best == {"regParam": 0.001} and len(scores) == 2
    assert models.grid_search(line, "las", {"regParam": [0.5]}) == ({"regParam": 0.5}, [])
    assert models.grid_search(line, "reg") == ({}, [])
    tried, scores = models.random_search(line, "las", 2, {"regParam": [0.001, 0.01, 1.0]})
    assert len(scores) == 2 and tried in [c for c, _ in scores]
    best, tolerance = models.smallest_gap(line.filter("fold > 0"), line.filter("fold = 0"), "las", [{"regParam": 2.0}, {"regParam": 0.001}])
    assert best["regParam"] == 0.001 and tolerance == 0.05


def test_representative_split_is_the_fold_closest_to_all(line):
    out = models.representative_split(line.drop("fold"), 3, numTrees=5, maxDepth=4).cache()
    assert out.groupBy("fold", "split_num").count().count() == 3 and out.filter("split_num = 1").select("fold").distinct().count() == 1
    p = models.fold_predictions(out.select("id", "property", "features", "fold"), "rf", numTrees=5, maxDepth=4).cache()
    pooled = p.agg(F.regr_r2("pred", "exp")).first()[0]
    gaps = {r["cv_fold"]: abs(r["s"] - pooled) for r in p.groupBy("cv_fold").agg(F.regr_r2("pred", "exp").alias("s")).collect()}
    assert out.filter("split_num = 1").first()["fold"] == min(gaps, key=lambda k: (gaps[k], k))
    binary = models.representative_split(line.drop("fold").withColumn("property", (F.col("property") > 1).cast("double")), 3, binary=True, numTrees=5)
    assert binary.filter("split_num = 1").count() > 50 and "weight" not in binary.columns


def test_selection_by_name(line):
    assert 2 not in select.select_features("lasso", line, 0.05) and {0, 1} <= set(select.select_features("lasso", line, 0.05))
    assert set(select.select_features("importance", line, least=1, most=2, runs=2, numTrees=10)) == {0, 1}
    assert select.select_features("ward_linear", line, 0.1, 2) == [0, 1]
    with pytest.raises(ValueError, match="no such method"):
        select.select_features("guess", line)
    gain = {r["idx"]: r["importance"] for r in select.permutation_importance(line, models.fit(line, "reg"), 2).collect()}
    assert gain[0] > gain[1] > 1 and abs(gain[2]) < 0.1 and set(gain) == {0, 1, 2}


def test_feature_lists(spark):
    assert select.parse_feature_list(" ") == [] and select.parse_feature_list("a\t b\t") == ["a", "b"]
    with pytest.raises(ValueError, match="tabs"):
        select.parse_feature_list("a,b")
    df = spark.createDataFrame([("x", "a\tb"), ("y", None)], "dataset string, names string")
    assert select.stored_embedding(df, "x") == ["a", "b"]
    for missing in ("y", "z"):
        with pytest.raises(ValueError, match="no stored features"):
            select.stored_embedding(df, missing)


def test_batch_scoring_answers_for_bad_rows(spark, line):
    model = models.fit(line, "reg")
    rows = [(1, 0.0, [1.0, 1.0, 0.0]), (2, None, None), (3, 1.0, [1.0]), (4, 1.0, [1.0, None, 2.0]), (5, 1.0, [1.0, float("nan"), 2.0])]
    df = spark.createDataFrame(rows, "id int, property double, features array<double>")
    got = {r["id"]: (r["pred"], r["status"]) for r in models.score_batch(model, df, 3).collect()}
    assert got[1][1] == "ok" and abs(got[1][0] - 1) < 0.05
    assert [got[i] for i in (2, 3, 4, 5)] == [(None, "no descriptors"), (None, "expected 3 descriptors, got 1"), (None, "missing or infinite descriptor"), (None, "missing or infinite descriptor")]
    compared = models.models_compared({"a": model, "b": models.fit(line, "las", regParam=1.0)}, line)
    mae = {r["model"]: r["MAE"] for r in compared.collect()}
    assert mae["a"] < mae["b"]


def test_logistic_errors_by_observed_information(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(0, 2, 400)
    y = (rng.random(400) < 1 / (1 + np.exp(-(0.5 + x)))).astype(float)
    df = spark.createDataFrame([(i, float(b), [float(a)]) for i, (a, b) in enumerate(zip(x, y, strict=True))], "id int, property double, features array<double>")
    _, table = models.logistic_curve(df)
    b = np.array([e for _, e, _ in table])
    design = np.column_stack([np.ones(400), x])
    p = 1 / (1 + np.exp(-design @ b))
    want = np.sqrt(np.diag(np.linalg.inv((design * (p * (1 - p))[:, None]).T @ design)))
    assert [n for n, _, _ in table] == ["intercept", "x0"] and np.allclose([e for *_, e in table], want, rtol=1e-6)
    assert np.allclose(design.T @ (y - p), 0, atol=0.05)


def test_leverage_of_many_features(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(0, 1, (60, 400))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, features array<double>")
    inverse = np.linalg.pinv(x.T @ x)
    got = {r["id"]: r["leverage"] for r in linalg.leverages(df, inverse).collect()}
    assert np.allclose([got[i] for i in range(60)], np.einsum("ij,jk,ik->i", x, inverse, x))


@pytest.mark.parametrize("cosine", [False, True])
def test_nearest_in_tiles_as_in_one(monkeypatch, cosine):
    rng = np.random.default_rng(3)
    t = np.round(rng.normal(0, 1, (90, 4)), 1)
    t[40:60] = t[20:40]  # ties
    ids = np.arange(90)
    monkeypatch.setattr(knn, "TILE", 1 << 30)
    whole = knn._nearest(ids, t, ids, t, 5, cosine)
    monkeypatch.setattr(knn, "TILE", 500)
    assert all(np.array_equal(a, b) for a, b in zip(whole, knn._nearest(ids, t, ids, t, 5, cosine), strict=True))
    d = np.round(knn._distances(t, t, cosine), 9)
    np.fill_diagonal(d, np.inf)
    assert whole[1].reshape(90, 5).tolist() == [sorted(range(90), key=lambda j, i=i: (d[i, j], j))[:5] for i in range(90)]


def test_screens_to_a_fixed_point(spark):
    rows = [(i, [float(i % 3), float(i % 3) + 0.01 * (i % 5), float(i % 2)]) for i in range(30)]
    df = spark.createDataFrame(rows, "id int, features array<double>")
    left, gone = columns.ill_conditioned(df, 10.0)
    assert gone == [0, 1]
    assert left.count() == sum(all(r[1][j] == 0 for j in gone) for r in rows)


def test_order_statistics_of_more_than_a_task_sorts(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(0, 1, 3000), np.full(800, 0.25), rng.integers(0, 3, 200).astype(float)])
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)] * 5, "v double")
    by = np.sort(x)
    for f in (0.0, 0.05, 0.5, 0.62, 0.95, 0.9999):
        assert order.split_value(df, "v", f, most=300) == by[int(len(x) * f)] == order.split_value(df, "v", f)
    got = order.quantiles(df, "v", [0, 0.1, 0.33, 1], most=300)
    assert np.allclose(got, np.quantile(x, [0, 0.1, 0.33, 1])) and np.allclose(order.quantiles(df, "v", [0, 0.1, 0.33, 1]), got)
    assert order.split_value(df.filter("v is null"), "v", 0.5) is None and order.quantile_edges(df.filter("v is null"), "v", 3) == []


def test_folds_whatever_the_buckets(spark):
    df = spark.range(500).withColumnRenamed("id", "id")
    folds = [{r["id"]: r["rank"] for r in split.ranked(df, 42, buckets=b).collect()} for b in (16, 256, 4096)]
    assert folds[0] == folds[1] == folds[2] and sorted(folds[0].values()) == list(range(500))
    bad = spark.createDataFrame([("1", 0), ("x", 0)], "id string, fold int")
    with pytest.raises(Exception, match="no whole number for an id: x"):
        split.checked_assignments(bad).collect()


def test_readers_of_logs_and_runs(spark, tmp_path):
    (tmp_path / "log.ndjson").write_text('{"a": 1}\nbroken\n{"a": 2, "b": "x"}\n')
    assert sorted(r["a"] for r in tables.read_ndjson(spark, str(tmp_path / "log.ndjson"), "a int, b string").collect()) == [1, 2]
    for run in ("one", "two"):
        (tmp_path / run).mkdir()
        (tmp_path / run / "results.json").write_text('{"score": 0.5,\n "name": "' + run + '"}')
    got = {r["run"]: r["name"] for r in tables.read_runs(spark, f"{tmp_path}/*/results*.json", "score double, name string").collect()}
    assert got == {"one": "one", "two": "two"}
    tables.write_by(spark.createDataFrame([(1, "train"), (2, "test")], "id int, part string"), str(tmp_path / "out"), "part")
    tables.write_by(spark.createDataFrame([(3, "test")], "id int, part string"), str(tmp_path / "out"), "part")
    assert {(r["id"], r["part"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {(1, "train"), (2, "test"), (3, "test")}
    assert tables.query(spark, "select :x + 1 as y", x=2).first()["y"] == 3
    assert order.split_index(100, 0.95) == 95
