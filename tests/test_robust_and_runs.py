"""Robust fits, kernel features, controls, measures by name and whole runs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from descry.operators import domain, models, records, robust, select, split
from descry.plans.run import model_run

SCHEMA = "id long, property double, features array<double>"


@pytest.fixture(scope="module")
def spoiled(spark):
    """y = 1 + 2 a - 3 b exactly for 200 rows, and 40 rows far off it."""
    rng = np.random.default_rng(1)
    x = rng.normal(0, 1, (240, 2))
    y = 1 + 2 * x[:, 0] - 3 * x[:, 1]
    y[200:] += rng.uniform(50, 90, 40)
    return spark.createDataFrame([(i, float(v), a.tolist()) for i, (v, a) in enumerate(zip(y, x, strict=True))], SCHEMA).repartition(3).cache()


def test_consensus_leaves_outliers_out(spark, spoiled):
    dirty = spoiled.unionByName(spark.createDataFrame([(900, None, [1.0, 2.0]), (901, 3.0, None), (902, 3.0, [None, 1.0])], SCHEMA))
    assert np.allclose(robust.consensus(dirty, trials=40), [1, 2, -3], atol=1e-9)
    assert np.array_equal(robust.sampled_fits(robust._complete(spoiled), 5, 7), robust.sampled_fits(robust._complete(spoiled.repartition(5)), 5, 7))
    with pytest.raises(ValueError, match="as many rows"):
        robust.consensus(spoiled.limit(2))
    pred = models.predict(models.fit(spoiled, "ransac", trials=40), spoiled.filter("id < 200"))
    assert pred.filter("abs(exp - pred) > 1e-9").count() == 0


def test_theil_sen_is_the_median_of_fits(spoiled):
    few = spoiled.filter("id < 220")
    fits = robust.sampled_fits(robust._complete(few), 300, 42)
    got = robust.theil_sen(few, subsets=300)
    total = lambda b: np.linalg.norm(fits - b, axis=1).sum()
    rng = np.random.default_rng(0)
    assert all(total(got) <= total(got + rng.normal(0, s, 3)) + 1e-9 for s in (1e-3, 0.1, 1) for _ in range(30))
    assert np.allclose(got, [1, 2, -3], atol=0.01)
    assert np.allclose(robust.spatial_median(np.array([[2.0, 3.0]] * 3)), [2, 3])


def test_kernel_learns_what_a_line_cannot(spark):
    rng = np.random.default_rng(2)
    x = rng.uniform(-2, 2, (400, 2))
    rows = [(i, float(np.sin(2 * a) * b), [float(a), float(b)]) for i, (a, b) in enumerate(x)]
    df = split.k_folds(spark.createDataFrame(rows, SCHEMA), 2).cache()
    r2 = {c: models.fold_predictions(df, c).agg(F.regr_r2("pred", "exp")).first()[0] for c in ("reg", "rbf")}
    assert r2["reg"] < 0.3 and r2["rbf"] > 0.8
    best, scores = models.grid_search(df, "rbf", {"width": [0.001, 1.0]})
    assert best == {"width": 1.0} and len(scores) == 2
    signs = df.withColumn("property", (F.col("property") > 0).cast("double"))
    right = {c: models.predict(models.fit(signs, c, binary=True), signs, binary=True).agg(F.avg(((F.col("pred") > 0.5) == (F.col("exp") > 0)).cast("int"))).first()[0] for c in ("reg", "rbf")}
    assert right["rbf"] > 0.85 > 0.65 > right["reg"]
    # The features' products approach the kernel.
    scaled = models.PopulationScaler().fit(models._vectors(df)).transform(models._vectors(df))
    k = np.array([r["k"].toArray() for r in robust.FourierFeatures(width=1.0, size=4000).transform(scaled.limit(20)).collect()])
    z = np.array([r["z"].toArray() for r in scaled.limit(20).collect()])
    assert np.abs(k @ k.T - np.exp(-0.5 * ((z[:, None] - z[None]) ** 2).sum(-1))).max() < 0.1


def test_permuted_targets_teach_nothing(spoiled):
    sound = spoiled.filter("id < 200")
    out = models.y_randomised(sound.filter("id < 150"), sound.filter("id >= 150"), "reg", seeds=(1, 2)).collect()
    assert {(r["seed"], r["set"]) for r in out} == {(s, n) for s in (1, 2) for n in ("training", "validation")}
    assert all(r["r2"] < 1 for r in out) and min(r["r2"] for r in out) < 0.5


def test_fitness_of_ones_own(spoiled):
    df = split.k_folds(spoiled.filter("id < 200"), 4)
    assert sorted(select.forward(df, 2)) == [0, 1]
    assert select.forward(df, 2, lambda mean, std, n: mean - n) in ([0], [1])


def test_measures_by_name(spark, spoiled):
    train, test = spoiled.filter("id >= 40"), spoiled.filter("id < 40")
    own = lambda name, **k: {(r["id"], r["set"]): r["value"] for r in domain.evaluate(name, train, test, **k)[0].collect()}
    assert own("knn_euclidean_all", idx=[0]) == own("knn_euclidean") != own("knn_euclidean", idx=[0])
    whole = lambda d: d.select("id", F.transform("features", lambda x: F.floor(F.abs(x) * 2).cast("double")).alias("features"))
    names = spark.createDataFrame([(0, "a")], "idx int, name string")
    flags, cutoff = domain.evaluate("fragment_counts", whole(train), whole(test), [0], names)
    assert cutoff is None and {f["fragment"] for r in flags.collect() for f in r["fragment_table"]} == {"a"}
    with pytest.raises(ValueError, match="no such measure"):
        domain.evaluate("guess", train, test)
    with pytest.raises(ValueError, match="names"):
        domain.evaluate("fragment_counts", train, test)


def test_neighbours_of_a_list(spoiled):
    out = domain.neighbours_listed(spoiled.filter("id >= 40"), spoiled.filter("id < 3"), 4).collect()
    labels = {r["id"]: r["property"] for r in spoiled.collect()}
    assert len(out) == 2 * 3 * 4 and all(r["label"] == labels[r["neighbour_id"]] for r in out)


def test_header_groups(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], "`Flag Reason` int, Notes int, Depth int, Own int")
    of = lambda d=None: [(r["column"], r["header_group"]) for r in records.header_groups(df, d).orderBy("place").collect()]
    assert of() == [("Flag Reason", "Quality Control"), ("Notes", "Experimental Details"), ("Depth", "Other"), ("Own", "Other")]
    assert of(["Depth"])[1:3] == [("Notes", "Experimental Details"), ("Depth", "Experimental Details")]


def test_whole_run(spoiled):
    sound = spoiled.filter("id < 200")
    train, test, external = sound.filter("id < 120"), sound.filter("id between 120 and 159"), sound.filter("id >= 110 and id not between 120 and 159")
    out, stat = model_run(train, test, external, "reg", method="forward", selection={"most": 2})
    out = out.cache()
    assert {r["set"]: r["count"] for r in out.groupBy("set").count().collect()} == {"Training": 120, "CV": 120, "Test": 40, "External": 40}
    assert out.filter("(inside is null) <> (set in ('Training', 'CV'))").count() == 0 and out.filter("abs(exp - pred) > 1e-6").count() == 0
    rows = {(r["set"], r["rows"]): r for r in stat.collect()}
    assert rows["Test", "all"]["n"] == 40 == sum(rows["Test", x]["n"] for x in ("inside", "outside") if ("Test", x) in rows)
    assert rows["External", "all"]["Q2"] == pytest.approx(1)
    classes = [d.withColumn("property", (F.col("property") > 1).cast("double")) for d in (train, test, external)]
    _, stat = model_run(*classes, "reg", folds=3, binary=True, measure="leverage", features=[0, 1])
    assert stat.filter("set = 'Test' and rows = 'all' and BA > 0.9").count() == 1
