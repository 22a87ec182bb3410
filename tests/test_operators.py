import pytest
from pyspark.sql import functions as F

from descry.functions import scalars, units
from descry.operators import columns, domain, knn, linalg, order, relational, split, stats
from descry.sources import tables


def rows_of(spark, features, first=0):
    return spark.createDataFrame([(first + i, float(i % 2), [float(x) for x in f]) for i, f in enumerate(features)], "id long, property double, features array<double>")


def test_clean_load(spark):
    df = spark.createDataFrame([(str(i), v) for i, v in enumerate(["inf", "nan", None, "", "{}", "1"])], "a string, b string")
    assert [r["features"] for r in tables.instances(df, "a", None, ["b"]).orderBy("id").collect()] == [[None]] * 5 + [[1.0]]


def test_width_check_names_the_row(spark):
    df = spark.createDataFrame([("x7", "1\t2")], "id string, v string")
    with pytest.raises(Exception, match="x7: expected 3 values, got 2"):
        tables.from_tsv_rows(df, "id", "v", "a\tb\tc")[0].collect()


def test_delimited_and_upserts(spark, tmp_path):
    (tmp_path / "x.tsv").write_text("ID\tv\na\tnull\nb\tInf\n")
    df = tables.read_delimited(spark, str(tmp_path / "x.tsv"))
    assert df.count() == 2 and df.filter("v is null").count() == 1
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string").withColumn("seq", F.lit(0))
    new = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 1)], "k int, v string, seq int")
    assert sorted((r["k"], r["v"]) for r in tables.insert_or_update(old, new, ["k"], "seq").collect()) == [(1, "a"), (2, "d"), (3, "e")]
    assert sorted(r["k"] for r in tables.insert_new(old, new, ["k"]).collect()) == [1, 2, 3]
    stay, first, n = tables.delete_where(old, new, ["k"])
    assert [r["k"] for r in stay.collect()] == [1] and n.first()[0] == 1 and first.count() == 1


def test_order_statistic(spark):
    df = lambda n: spark.range(n).select(F.col("id").cast("double").alias("v"))
    assert order.split_value(df(20), "v", 0.95) == 19 and order.split_value(df(100), "v", 0.95) == 95
    assert order.split_value(df(20), "v", 1 - 0.95) == 1 and order.split_value(df(0), "v", 0.5) is None


def test_continuous(spark):
    df = spark.createDataFrame([(1.0, 1.1), (2.0, 1.9), (3.0, 3.2), (4.0, 3.8)], "exp double, pred double")
    r = stats.continuous(df, mean=2.0).first()
    assert (round(r["MAE"], 6), round(r["RMSE"], 6), round(r["PearsonRSQ"], 6), round(r["Q2"], 6), r["Coverage"]) == (0.15, 0.158114, 0.981778, 0.983333, 1)
    none = stats.continuous(df.withColumn("pred", F.lit(None).cast("double")), mean=2.0).first()
    assert none["MAE"] is None and none["Coverage"] == 0


def test_binary(spark):
    df = spark.createDataFrame([(1.0, 0.9), (1.0, 0.4), (0.0, 0.5), (0.0, 0.1), (None, 0.7), (1.0, None)], "exp double, pred double")
    r = stats.binary(df).first()
    assert (r["n"], r["n_predicted"], r["Coverage"], r["Concordance"], r["SN"], r["SP"], r["BA"]) == (5, 4, 0.8, 0.5, 0.5, 0.5, 0.5)


def test_null_flags(spark):
    df = spark.createDataFrame([(True, True), (True, False), (False, False), (True, None)], "a boolean, b boolean").withColumn("exp", F.lit(1.0)).withColumn("pred", F.lit(1.0))
    r = stats.inside_outside(stats.consensus(df, ["a", "b"]), "inside").first()
    assert (r["n_inside"], r["n_outside"], r["Coverage"]) == (1, 3, 0.25)


def test_leverage_and_conditioning(spark):
    df = rows_of(spark, [(1, 0), (2, 0), (0, 1), (1, 1)])
    import numpy as np

    inverse = np.linalg.inv(linalg.gram(df)[2])
    assert np.allclose(np.diag(inverse), [0.181818, 0.545455], atol=1e-6)
    got = [r["leverage"] for r in linalg.leverages(df, inverse).orderBy("id").collect()]
    assert np.allclose(got, [0.181818, 0.727273, 0.545455, 0.545455], atol=1e-6)


def test_screens(spark):
    df = rows_of(spark, [(1, 2, 5, 0), (2, 4, 5, 0), (3, 6, 5, 1), (5, 10, 5, 0)])
    names = spark.createDataFrame(list(enumerate(["XLOGP", "Col1", "Col2", "n_acnt"])), "idx int, name string")
    kept = lambda **k: [r["name"] for r in columns.prepare(df, names, **k)[1].orderBy("idx").collect()]
    assert kept() == ["XLOGP", "Col1", "n_acnt"]
    assert kept(remove_logp=True, remove_acnt=True) == ["Col1"] and kept(remove_corr=0.95, remove_acnt=True) == ["XLOGP"]
    left, dropped = columns.sparse(df, 2)
    assert dropped == [3] and left.count() == 3


def test_neighbours_in_blocks(spark):
    df = rows_of(spark, [((i * 37) % 11, (i * 17) % 7) for i in range(60)])
    a = sorted(map(tuple, knn.neighbours(df, df, 3).collect()))
    b = sorted(map(tuple, knn.neighbours(df, df, 3, sent_bytes=0, block_rows=9).collect()))
    assert [x[:2] + x[3:] for x in a] == [x[:2] + x[3:] for x in b] and all(x[0] != x[1] for x in a)


def test_local_index(spark):
    df = spark.createDataFrame([([0.05, 0.2, 0.5, 1.0, 2.0],)], "d array<double>")
    assert round(df.select(domain.local_index(F.col("d")).alias("v")).first()["v"], 6) == 0.831657


def test_fragment_range(spark):
    train = rows_of(spark, [(0,), (2,), (3,)])
    test = rows_of(spark, [(0,), (1,), (2,), (4,)])
    names = spark.createDataFrame([(0, "F")], "idx int, name string")
    got = {r["id"]: r["inside"] for r in domain.fragment_range(train, test, names).collect()}
    assert got == {1: False, 2: True, 3: False}


def test_folds(spark):
    df = spark.createDataFrame([(i, int(i >= 12)) for i in range(19)], "id long, property int")
    sizes = split.stratified_folds(df, 5, ["property"]).groupBy("property", "fold").count().collect()
    for p in (0, 1):
        n = [r["count"] for r in sizes if r["property"] == p]
        assert max(n) - min(n) <= 1 and len(n) == 5
    few = split.stratified_folds(df.filter("id < 15"), 5, ["property"])
    assert sorted(r["count"] for r in few.groupBy("fold").count().collect()) == [3] * 5
    aside = split.set_aside_folds(spark.range(30).toDF("id"), spark.range(10).toDF("id"), 5)
    assert {(r["is_member"], r["count"]) for r in aside.groupBy("fold", "is_member").count().collect()} == {(True, 2), (False, 4)}
    scores = spark.createDataFrame([(1, 1.0), (2, 1.4), (3, 1.2), (4, 1.2)], "fold int, score double")
    assert order.closest_fold(scores, 1.25) == 3


def test_join_checks(spark):
    a = spark.createDataFrame([(1,), (2,)], "k int")
    with pytest.raises(ValueError, match="not unique"):
        relational.join_many_to_one(a, a.union(a).withColumn("v", F.lit(1)), "k")
    with pytest.raises(ValueError, match="folds"):
        relational.check_folds(a.toDF("id"), spark.createDataFrame([(1, 0), (1, 1)], "id int, fold int"))


def test_units_and_rounding(spark):
    rules = spark.createDataFrame([("s", "-log10(M)", "mg/L", "neg_log_m_to_mgl"), ("s", "g/L", "-log10(M)", "gl_to_neg_log_m")], "property string, from_unit string, to_unit string, kind string")
    rows = spark.createDataFrame([(1, "s", "-log10(M)", "mg/L", 3.0, 78.11), (2, "s", "g/L", "-log10(M)", 1.0, 100.0), (3, "s", "g/L", "-log10(M)", 0.0, 100.0), (4, "s", "g/L", "-log10(M)", 1.0, None)], "id int, property string, from_unit string, to_unit string, value double, mol_weight double")
    got = {r["id"]: (r["converted"] and round(r["converted"], 6), r["reason"]) for r in units.convert(rows, rules).collect()}
    assert got[1] == (78.11, None) and got[2] == (2.0, None) and got[3][0] is None and got[3][1] and got[4] == (None, "no molecular weight")
    r = spark.createDataFrame([(0.5,), (1.5,), (2.5,)], "x double").select(scalars.half_even(F.col("x")).alias("e"), scalars.half_up(F.col("x")).alias("u")).collect()
    assert [x["e"] for x in r] == [0, 2, 2] and [x["u"] for x in r] == [1, 2, 3]
