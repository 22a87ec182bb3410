"""Run summaries, bins by rule, whole reports, databases, id lists of splits."""

import json
import math
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from descry.operators import models, relational, robust, select, split, summaries
from descry.sources import tables

DERBY = "org.apache.derby.iapi.jdbc.AutoloadedDriver"


@pytest.fixture()
def url():
    return f"jdbc:derby:memory:{uuid.uuid4().hex};create=true"


def test_jdbc_appends_in_batches_and_reads_in_parts(spark, url):
    rows = spark.range(2500).select(F.expr("nullif(cast(id as int), -1)").alias("K"), F.expr("nullif(cast(id % 7 as int), -1)").alias("R")).repartition(12)
    tables.append_jdbc(rows, url, "points", batch=1000, connections=3, driver=DERBY)
    tables.append_jdbc(spark.createDataFrame([(None, 3)], "K int, R int"), url, "points", driver=DERBY)
    whole = tables.read_jdbc(spark, url, "points", driver=DERBY)
    parts = tables.read_jdbc(spark, url, "points", "K", 4, driver=DERBY)
    by_rule = tables.read_jdbc(spark, url, "points", predicates=["R < 3", "R >= 3"], driver=DERBY)
    assert [d.rdd.getNumPartitions() for d in (whole, parts, by_rule)] == [1, 4, 2]
    want = sorted([(i, i % 7) for i in range(2500)] + [(-1, 3)])
    for d in (whole, parts, by_rule):
        assert sorted((-1 if r[0] is None else r[0], r[1]) for r in d.collect()) == want
    pushed = parts.filter("K < 10")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [*IsNotNull(K), *LessThan(K,10)]" in pushed and parts.filter("K < 10").count() == 10
    empty = spark.createDataFrame([], "K int, R int")
    tables.append_jdbc(empty, url, "nothing", driver=DERBY)
    assert tables.read_jdbc(spark, url, "nothing", "K", driver=DERBY).count() == 0


def test_rows_with_descriptors_of_another_file(spark, tmp_path):
    (tmp_path / "rows.csv").write_text("id,x,note\na,1,n\nb,2,n\nc,3,n\n")
    (tmp_path / "d.tsv").write_text("id\td1\tx\na\t5\t9\nb\t6\t9\n")
    got = tables.read_with_descriptors(spark, str(tmp_path / "rows.csv"), str(tmp_path / "d.tsv"), "id")
    assert {tuple(r) for r in got.collect()} == {("a", "1", "n", "5"), ("b", "2", "n", "6")} and got.columns == ["id", "x", "note", "d1"]
    (tmp_path / "d.tsv").write_text("id\td1\na\t5\na\t6\n")
    with pytest.raises(ValueError, match="'a'"):
        tables.read_with_descriptors(spark, str(tmp_path / "rows.csv"), str(tmp_path / "d.tsv"), "id")


def test_json_safe_at_any_depth(spark):
    kind = "a double, s struct<x: double, l: array<map<string, double>>>, t string"
    df = spark.createDataFrame([(math.nan, (math.inf, [{"k": -math.inf, "g": 1.5}, None]), "NaN"), (2.0, None, None)], kind)
    got = [json.loads(r["json"]) for r in tables.to_safe_json(df, omit_nulls=False).collect()]
    assert got[0] == {"a": None, "s": {"x": None, "l": [{"k": None, "g": 1.5}, None]}, "t": "NaN"} and got[1] == {"a": 2.0, "s": None, "t": None}


def _document(test, cv=None, binary=False, **details):
    m = "BA" if binary else "MAE"
    return json.dumps({"model_details": {"is_binary": binary, **details}, "model_statistics": {"test_stats": {f"{m}_Test": test}, "cv_stats": {f"{m}_CV_Training": cv}}})


def test_run_summary_sorts_by_task(spark, tmp_path):
    def runs(**documents):
        at = tmp_path / uuid.uuid4().hex
        for name, text in documents.items():
            (at / name).mkdir(parents=True)
            (at / name / "results.json").write_text(text)
        return tables.read_runs(spark, f"{at}/*/results*.json", summaries.RUN_SCHEMA)

    numbers = runs(a=_document(0.5, 0.7, embedding=["x"] * 60), b=_document(0.2, embedding_len=9), c=_document(None), d="{broken", e=_document(0.5))
    got = summaries.run_summary(numbers).collect()
    assert [(r["run"], r["metric"], r["test"], r["n_variables"]) for r in got] == [("b", "MAE", 0.2, 9), ("a", "MAE", 0.5, 60), ("e", "MAE", 0.5, None), ("c", "MAE", None, None)]
    assert got[1]["training_cv"] == 0.7 and got[1]["embedding"].endswith("...") and len(got[1]["embedding"]) == 103
    classes = runs(a=_document(0.6, binary=True), b=_document(0.9, binary=True))
    assert [r["run"] for r in summaries.run_summary(classes).collect()] == ["b", "a"]
    assert [r["run"] for r in summaries.run_summary(classes, ascending=True).collect()] == ["a", "b"]
    mixed = runs(a=_document(0.6, binary=True), b=_document(0.9))
    assert "Sort" not in summaries.run_summary(mixed)._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError, match="sort by"):
        summaries.run_summary(mixed, by="Test")


def test_bins_by_property_and_unit():
    of = summaries.bin_edges
    assert of("Density", "g/cm3", 0, 9)[:2] == [0.5, 0.75] and len(of("Density", "", 0, 9)) == 15
    assert of("Melting Point", "°C", -112.5, 249)[:2] == [-150, -100] and of("Melting Point", "°C", -112.5, 249)[-1] == 250
    assert of("Surface Tension", "dyn/cm", 12.2, 71)[:3] == [0, 10, 20] and of("Surface Tension", "dyn/cm", 12.2, 71)[-1] == 110
    assert of("LogKow", "Log10", -1.5, 3.2) == [x / 2 for x in range(-6, 11)] and of("x", "log10-mg/L", 0, 20) == [float(x) for x in range(-1, 21)]
    assert of("Toxic", "Binary 0/1", 0, 1) == [-0.5, 0.5, 1.5] and of("x", "m", 3, 3) == [3.0, 4.0] and of("x", "m", 1, 3) == [1.0, 2.0, 3.0]


def test_histogram_of_edges_as_numpy_has_it(spark):
    x = [0.5, 0.75, 3.99, 4.0, 4.01, 0.49, 2.0, 2.0]
    df = spark.createDataFrame([(v,) for v in x] + [(None,), (math.nan,)], "x double")
    edges = summaries.bin_edges("Density", "g/cm3", 0, 4)
    got = {r["bin"]: r["n"] for r in summaries.histogram_of(df, "x", edges).collect()}
    want, _ = np.histogram(x, edges)
    assert [got.get(i, 0) for i in range(len(edges) - 1)] == want.tolist()
    assert summaries.histogram_by_rule(df.limit(0), "x", "any", "m").count() == 0


def test_reports_of_rows_with_nothing_else(spark):
    none = lambda kind: spark.createDataFrame([], kind)
    results = spark.createDataFrame([(1, 2.0, None), (2, 5.0, "bad")], "id long, pred double, error string")
    got = summaries.prediction_reports(results, none("id long, name string"), none("id long, exp double, set string"), none("id long, method string, conclusion string, reason string"), none("id long, set string, rank int, other long"), F.struct(F.lit("m").alias("name")), ("a", "b"))
    docs = {r["id"]: json.loads(r["report"]) for r in got.collect()}
    assert docs[1]["modelResults"]["predictionValueUnitsModel"] == 2.0 and docs[1]["modelResults"]["adEstimates"] == []
    assert docs[2]["modelResults"]["predictionValueUnitsModel"] is None and docs[2]["modelResults"]["predictionError"] == "bad"
    assert docs[1]["chemicalIdentifiers"] is None and docs[1]["neighborResultsTraining"] is None


def test_parts_of_a_split_must_not_be_empty(spark):
    points = spark.createDataFrame([(1, 1, "a", 0.5), (2, 1, "b", 0.6), (3, 2, "c", 0.7)], "point_id int, dataset_id int, structure string, property double")
    datasets = spark.createDataFrame([(1, "one"), (2, "two")], "dataset_id int, name string")
    splits = spark.createDataFrame([(1, 5, 0), (2, 5, 1), (3, 5, 0), (1, 6, 1)], "point_id int, splitting_id int, split_num int")
    names = spark.createDataFrame([(5, "s"), (6, "t")], "splitting_id int, name string")
    own = lambda d, s, v=None: relational.members_of_split(points, datasets, splits, names, d, s, v)
    training, test = relational.both_parts(own("one", "s"))
    assert [tuple(r) for r in training.collect()] == [(1, 1, "a", 0.5)] and [r["structure"] for r in test.collect()] == ["b"]
    assert [r[0] for r in relational.test_structures(own("one", "t")).collect()] == ["a"]
    for members, said in ((own("two", "s"), "no test"), (own("one", "t"), "no training"), (own("no", "s"), "no training and no test"), (own("one", "s", points.filter("structure = 'a'")), "no test")):
        with pytest.raises(ValueError, match=said):
            relational.both_parts(members)
    with pytest.raises(ValueError):
        relational.test_structures(own("two", "s"))


def test_ranks_do_not_depend_on_buckets(spark):
    df = spark.range(500).withColumn("s", F.col("id") % 3)
    ranks = [sorted(tuple(r) for r in split.ranked(df, 42, ["s"], n).select("id", "rank").collect()) for n in (1, 16, 1 << 16)]
    assert ranks[0] == ranks[1] == ranks[2]


def test_fold_predictions_read_only_their_folds(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 2))
    rows = [(i, float(a + 2 * b), [float(a), float(b)], i % 4 if i < 190 else None) for i, (a, b) in enumerate(x)]
    df = spark.createDataFrame(rows, "id long, property double, features array<double>, fold int")
    out = models.fold_predictions(df, "reg")
    got = out.collect()
    assert len(got) == 190 and all(r["cv_fold"] == r["id"] % 4 and abs(r["exp"] - r["pred"]) < 1e-6 for r in got)
    assert "PartitionFilters: [isnotnull(fold" in out._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError, match="fold"):
        models.fold_predictions(df.limit(0), "reg")


def test_rounds_that_run_out_are_said(spark):
    with pytest.warns(UserWarning, match="still moves"):
        robust.spatial_median(np.random.default_rng(1).normal(size=(50, 3)), rounds=1)
    df = spark.createDataFrame([(i, float(i % 5), [float(i % 5), float(i % 7), float(i % 11), float(i % 3)]) for i in range(60)], "id long, property double, features array<double>")
    with pytest.warns(UserWarning, match="still change"):
        select.by_importance(df, fraction=0.99, least=1, most=1, runs=1, rounds=1, numTrees=3)
