"""Tables that are changed in place, parameter columns, report columns, and names that had no test."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from descry.operators import columns, domain, models, records, relational, select, split
from descry.functions import scalars
from descry.sources import partitions, tables

TABLE = "id long, kind string, value double"


@pytest.fixture
def stored(spark, tmp_path):
    path = str(tmp_path / "table")
    rows = [(i, [None, "a b", "c=d", "e/f"][i % 4], float(i)) for i in range(40)]
    spark.createDataFrame(rows, TABLE).write.partitionBy("kind").parquet(path)
    return path, {i: (k, v) for i, k, v in rows}


def content(spark, path):
    return {r["id"]: (r["kind"], r["value"]) for r in spark.read.parquet(path).collect()}


def files(path):
    return set(glob.glob(f"{path}/*/*.parquet"))


def test_upsert_rewrites_what_it_touches(spark, stored):
    path, rows = stored
    before = files(path)
    new = [(4, None, 1.0, 1), (4, None, 2.0, 2), (8, "c=d", 3.0, 1), (100, "new", 4.0, 1)]
    df = spark.createDataFrame(new, TABLE + ", seq int")
    assert partitions.upsert(spark, path, df, ["id"], ["kind"], "seq") == 3
    expected = rows | {4: (None, 2.0), 8: ("c=d", 3.0), 100: ("new", 4.0)}
    assert content(spark, path) == expected
    assert {f for f in before if "a%20b" in f or "a b" in f or "e%2Ff" in f} <= files(path)
    plain = tables.insert_or_update(spark.createDataFrame([(i, k, v) for i, (k, v) in rows.items()], TABLE), df, ["id"], "seq")
    assert {r["id"]: (r["kind"], r["value"]) for r in plain.collect()} == expected
    partitions.upsert(spark, path, df, ["id"], ["kind"], "seq")
    assert content(spark, path) == expected
    with pytest.raises(ValueError, match="without id"):
        partitions.upsert(spark, path, spark.createDataFrame([(None, "x", 1.0, 1)], TABLE + ", seq int"), ["id"], ["kind"], "seq")


def test_rows_that_leave_a_partition_empty(spark, stored):
    path, rows = stored
    moved = spark.createDataFrame([(i, "a b", -1.0, 0) for i in range(2, 40, 4)], TABLE + ", seq int")
    assert partitions.upsert(spark, path, moved, ["id"], ["kind"], "seq") == 2
    assert content(spark, path) == rows | {i: ("a b", -1.0) for i in range(2, 40, 4)}
    assert len([d for d in os.listdir(path) if d.startswith("kind=")]) == 3


def test_inserts_and_deletes(spark, stored):
    path, rows = stored
    before = files(path)
    df = spark.createDataFrame([(1, "a b", -5.0), (200, "a b", 1.0), (200, "a b", 1.0)], TABLE)
    assert partitions.insert(spark, path, df, ["id"], ["kind"]) == 1 and partitions.insert(spark, path, df, ["id"], ["kind"]) == 0
    assert content(spark, path) == rows | {200: ("a b", 1.0)} and before <= files(path)
    doomed = spark.createDataFrame([(i,) for i in [*range(0, 40, 4), 5, 999]] + [(None,)], "id long")
    assert partitions.delete(spark, path, doomed, ["id"], ["kind"]) == 2
    assert content(spark, path) == {i: v for i, v in rows.items() if i % 4 and i != 5} | {200: ("a b", 1.0)}
    assert partitions.delete(spark, path, doomed, ["id"], ["kind"]) == 0 and not any("DEFAULT" in d for d in os.listdir(path))


def test_parameter_columns_of_all_three_ways(spark):
    rows = [("r1", "pH", 7.0, "x", 2), ("r1", "pH", 6.0, "y", 1), ("r1", "Soil Type", 1.0, None, 3), ("r2", "pH", 5.0, "z", 1), ("r2", "pH_1", 9.0, "w", 2), ("r1", "pH_1", 8.0, "v", 4), ("r3", None, 1.0, "u", 1)]
    df = spark.createDataFrame(rows, "rec string, name string, value double, note string, seq int")
    own = lambda **k: {r["rec"]: r.asDict() for r in records.parameter_pivot(df, "rec", "name", **k).collect()}
    first = own(fields=["value"], order="seq", duplicates="first")
    assert set(first) == {"r1", "r2", "r3"} and all(v is None for k, v in first["r3"].items() if k != "rec")
    label = next(k for k in first["r1"] if k.lower().startswith("soil"))
    ph = next(k for k in first["r1"] if k.lower() == "ph")
    assert first["r1"][ph] == 6.0 and first["r2"][ph] == 5.0 and first["r1"][label] == 1.0
    suffixed = own(fields=["value", "note"], order="seq")
    assert suffixed["r1"][f"{ph}_2_value"] == 7.0 and suffixed["r1"][f"{ph}_2_note"] == "x" and suffixed["r2"][f"{ph}_value"] == 5.0
    assert suffixed["r2"][f"{ph}_1_value"] == 9.0 and suffixed["r1"][f"{ph}_1_value"] in (6.0, 8.0)
    lists = own(fields=["value", "note"], order="seq", duplicates="list", prefix="p ")
    assert lists["r1"][f"p {ph}_value"] == [6.0, 7.0] and lists["r1"][f"p {ph}_note"] == ["y", "x"] and lists["r2"][f"p {label}_value"] is None
    with pytest.raises(ValueError, match="more than 1"):
        records.parameter_pivot(df, "rec", "name", ["value"], "seq", most_columns=1)
    assert records.parameter_pivot(df.filter("rec = 'r3'"), "rec", "name", ["value"], "seq").columns == ["rec"]


def test_report_columns(spark):
    df = spark.createDataFrame([(2, 1.0, 5.0, True, False), (1, None, 6.0, None, True)], "id int, ppm double, mg_per_l double, AD_leverage boolean, AD_density boolean")
    assert records.domain_columns(df, ["leverage"]).columns == ["id", "ppm", "mg_per_l", "AD_leverage"]
    assert records.target_by_unit(df, "mg/L", {"ppm": "ppm", "mg/L": "mg_per_l"}).columns == ["id", "property", "AD_leverage", "AD_density"]
    with pytest.raises(ValueError, match="no target in g"):
        records.target_by_unit(df, "g", {"ppm": "ppm"})
    assert records.titled(df, [("mg_per_l", None), ("nowhere", "x"), ("id", "ID")]).columns == ["mg per l", "ID"]
    assert [r["id"] for r in records.in_order(df, "ppm", "value").collect()] == [2, 1] and records.in_order(df, "value") is df


def test_statistics_descriptions_and_models(spark):
    stats = spark.createDataFrame([("m", "R2", 0.8765), ("m", "RMSE", 1.234), ("n", "R2", 0.5)], "model string, name string, value double")
    assert {r["model"]: (r["R2"], r["RMSE"]) for r in records.statistics_row(stats, "model", ["R2", "RMSE"]).collect()} == {"m": (0.88, 1.23), "n": (0.5, None)}
    fields = spark.createDataFrame([("b", "second"), ("a", "first"), ("z", "other")], "name string, description string")
    assert [r["description"] for r in records.field_descriptions(fields, spark.createDataFrame([(1, 2)], "a int, b int")).collect()] == ["first", "second"]
    named = spark.createDataFrame([(1, True, 7), (2, False, 7), (3, True, None)], "id int, is_public boolean, data_id int")
    got = records.available_models(named, (spark.createDataFrame([(7, "set")], "data_id int, data string"), "data_id")).collect()
    assert {(r["id"], r["data"]) for r in got} == {(1, "set"), (3, None)}


def test_group_contribution_without_sparse_fragments(spark):
    rows = [(i, [float(i % 2), float(i % 3), 1.0 if i == 0 else 0.0, float(i)]) for i in range(12)]
    df = spark.createDataFrame(rows, "id int, features array<double>")
    names = spark.createDataFrame(list(enumerate(["f1", "f2", "f3", "logp"])), "idx int, name string")
    out, left = columns.group_contribution(df, names, "f1", "f3", ["logp"], 3, 1e6)
    assert [r["name"] for r in left.orderBy("idx").collect()] == ["f1", "f2", "logp"]
    assert {r["id"]: r["features"] for r in out.collect()} == {i: [float(i % 2), float(i % 3), float(i)] for i in range(1, 12)}


def test_prepare_drops_text_columns(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0, 3.0]), (2, [2.0, None, 5.0])], "id int, features array<double>")
    names = spark.createDataFrame(list(enumerate(["a", "t", "c"])), "idx int, name string")
    out, left = columns.prepare(df, names, texts=["t"])
    assert [r["name"] for r in left.collect()] == ["a", "c"] and {tuple(r["features"]) for r in out.collect()} == {(1.0, 3.0), (2.0, 5.0)}


def test_both_domains_make_a_strength(spark):
    rows = [(i, float(i), [float(i % 7), float((i * i) % 11)]) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, property double, features array<double>")
    far = spark.createDataFrame([(900, 0.0, [500.0, 500.0])], "id long, property double, features array<double>")
    got = {(r["set"], r["id"]): r["strength"] for r in domain.local_and_leverage(df, df.limit(5).unionByName(far)).collect()}
    assert got["test", 900] == "WEAK" and len(got) == 66 and {"STRONG"} <= set(got.values()) <= {"STRONG", "MODERATE", "WEAK"}


def test_forest_on_clustered_features(spark):
    rows = [(i, float(i % 9), [float(i % 9), float(i % 9) * 2 + 1, float((i * 7) % 13)]) for i in range(90)]
    df = split.k_folds(spark.createDataFrame(rows, "id long, property double, features array<double>"), 3)
    kept = select.ward_forest(df, 0.1, tries=1)
    assert kept[0] == 0 and 1 not in kept


def test_logistic_penalty_follows_the_rows(spark):
    rows = [(i, float(i % 4 > 1), [float(i % 4), float(i % 3)]) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, property double, features array<double>")
    assert models.fit(df, "reg", binary=True).stages[-1].getRegParam() == 1 / 40
    assert models.fit(df, "reg", binary=True, C=4.0).stages[-1].getRegParam() == 1 / 160
    assert models.fit(df, "reg", binary=True, regParam=0.5).stages[-1].getRegParam() == 0.5


def test_new_keys_are_worked_on_once(spark):
    done, rows = spark.createDataFrame([(1,)], "id int"), spark.createDataFrame([(1, 1.0), (2, 2.0), (2, 2.0)], "id int, v double")
    assert [tuple(r) for r in tables.process_new(done, rows, "id", lambda d: d.withColumn("v", F.col("v") * 10)).collect()] == [(2, 20.0)]


def test_reasons_for_fragments_and_first_choices(spark):
    df = spark.createDataFrame([(1, True, True, None, "b"), (2, False, True, "a", "b"), (3, True, False, None, None), (4, None, True, "a", None)], "id int, inside boolean, known boolean, x string, y string")
    got = {r["id"]: (r["reason"], r["first"]) for r in df.select("id", scalars.fragment_reason(F.col("inside"), F.col("known")).alias("reason"), relational.fallback(F.col("x"), F.col("y")).alias("first")).collect()}
    assert got[1] == ("Fragments in test chemical are within the training set ranges", "b") and "NOT within" in got[2][0] and got[2][1] == "a"
    assert "NOT included in the model" in got[3][0] and got[3][1] is None and got[4] == (None, "a")
