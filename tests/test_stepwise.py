"""Features added, dropped, voted for and exchanged."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from descry.operators import importance, models, select, split, stepwise
from descry.operators.linalg import grams_of

ROWS = "id long, property double, features array<double>, fold int"


def data(n=180, p=7, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, p)) * np.arange(1, p + 1) + 10
    x[:, 4] = x[:, 0] + 0.3 * rng.normal(size=n)
    y = 3 * x[:, 0] - 2 * x[:, 2] + 0.5 * x[:, 5] + rng.normal(size=n)
    return x, y, np.arange(n) % 5


@pytest.fixture(scope="module")
def rows(spark):
    x, y, fold = data()
    own = [(i, float(y[i]), x[i].tolist(), int(fold[i])) for i in range(len(y))]
    return spark.createDataFrame([*own, (900, 1.0, None, 0), (901, 1.0, [1.0, None, *[0.0] * 5], 1), (902, None, x[0].tolist(), 2)], ROWS).repartition(3).cache()


def squared(at, x, y, fold):
    out = []
    for k in range(5):
        a = np.column_stack([np.ones(len(y)), x[:, at]])
        b = np.linalg.lstsq(a[fold != k], y[fold != k], rcond=None)[0]
        out.append(float(((y - a @ b)[fold == k] ** 2).mean()))
    return np.array(out)


def test_up_and_down_dates_are_new_fits(rows):
    x, y, fold = data()
    folds = stepwise.standardised(grams_of(rows))
    fits = stepwise._fits(folds)
    here: list[int] = []
    for move in (3, 0, 5, -3, 2, 1, 6, -0.5, -5, 4):
        j = 0 if move == -0.5 else abs(move)
        if move >= 0:
            assert all(f.add(j) for f in fits)
            here.append(j)
        else:
            for f in fits:
                f.drop(j)
            here.remove(j)
        assert np.allclose([f.error() for f in fits], squared(here, x, y, fold))
        with_each = np.mean([f.with_each() for f in fits], axis=0)
        assert np.allclose([with_each[j] for j in range(7) if j not in here], [squared([*here, j], x, y, fold).mean() for j in range(7) if j not in here])
        without = np.mean([f.without_each() for f in fits], axis=0)
        assert np.allclose(without, [squared([i for i in here if i != j], x, y, fold).mean() for j in here])


def greedy(x, y, fold, backward):
    at, out = (list(range(7)), {}) if backward else ([], {})
    while len(at) > 1 if backward else len(at) < 7:
        tries = [[i for i in at if i != j] for j in at] if backward else [[*at, j] for j in range(7) if j not in at]
        at = min(tries, key=lambda s: squared(s, x, y, fold).mean())
        out[len(at)] = list(at)
    return out


@pytest.mark.parametrize("direction", ["forward", "backward"])
def test_stepwise_takes_the_size_of_least_objective(rows, direction):
    x, y, fold = data()
    chosen, tried = stepwise.stepwise(rows, 1, None, 1, direction, penalty=0.01)
    subsets = greedy(x, y, fold, direction == "backward")
    base = np.sqrt(squared(list(range(7)), x, y, fold).mean())
    assert [s.size for s in tried] == list(range(1, 8))
    for s in tried[:-1]:
        assert set(s.features) == set(subsets[s.size])
        rmse = np.sqrt(squared(s.features, x, y, fold))
        assert s.objective == pytest.approx(rmse.mean() / base + rmse.std() / base + 0.01 * s.size)
    assert set(chosen) == {0, 2, 5} and chosen == min(tried, key=lambda s: s.objective).features
    short = stepwise.stepwise(rows, 2, 5, 2, direction)[1]
    assert [s.size for s in short] == [2, 4]


def test_penalty_from_noise_and_dependent_features(rows, spark):
    x, y, fold = data()
    rmse = np.sqrt(squared(list(range(7)), x, y, fold))
    base = np.sqrt((rmse**2).mean())
    c = max(1e-3, 0.7 * rmse.std() / base * np.sqrt(np.log(8) / 180))
    _, tried = stepwise.stepwise(rows, 3, 3, penalty=None)
    assert tried[0].objective == pytest.approx(tried[0].error + tried[0].deviation + 3 * c)
    twice = rows.withColumn("features", F.concat("features", F.array(F.get("features", F.lit(0)), F.lit(1.0))))
    for direction in ("forward", "backward"):
        chosen, tried = stepwise.stepwise(twice, 1, 9, direction=direction, penalty=0.01)
        assert set(chosen) == {0, 2, 5} and all(7 not in s.features or 0 not in s.features for s in tried) and all(8 not in s.features for s in tried)
    assert stepwise.stepwise(rows.limit(0)) == ([], [])
    for bad in ({"direction": "up"}, {"step": 0}, {"least": 3, "most": 2}):
        with pytest.raises(ValueError):
            stepwise.stepwise(rows, **bad)


def test_recursive_elimination_ends_at_the_features_that_matter(rows):
    kept = stepwise.eliminated(rows)
    assert {0, 2, 5} <= set(kept) and stepwise.eliminated(rows, kept) == kept
    assert stepwise.eliminated(rows, [1, 3]) in ([1], [3], [1, 3]) and stepwise.eliminated(rows.limit(0)) == []
    assert select.select_features("elimination", rows, [0, 2, 5]) == [0, 2, 5]
    assert select.select_features("stepwise", rows) == stepwise.stepwise(rows)[0]


def test_lasso_then_elimination(rows):
    whole = rows.filter("property is not null and features is not null and not exists(features, x -> x is null)")
    kept = select.select_features("lasso_elimination", whole, 0.05)
    assert {2, 5} <= set(kept) <= {0, 1, 2, 3, 4, 5, 6}


def test_evolution_in_stages(rows):
    chosen, votes = select.evolve_in_stages(rows, runs=3, generations=4, population=12, most_first=4, most=3)
    assert set(chosen) <= {0, 2, 4, 5} and 2 in chosen and len(chosen) <= 3
    assert all(1 <= n <= 3 for n in votes.values()) and set(chosen) <= set(votes) and votes[2] == 3
    assert select.evolve_in_stages(rows.limit(0), 2, 2, 6) == ([], {})
    each = select.populations(rows, 3, 2, 10, most=2)
    assert len(each) == 3 and all(1 <= len(s) <= 2 for s in each) and select.populations(rows, 3, 2, 10, most=2) == each
    assert all(set(s) <= {1, 2, 3} for s in select.populations(rows, 2, 2, 10, among=[3, 1, 2]))


MODELS = [("reg", {}), ("las", {"regParam": 0.1}), ("rf", {"numTrees": 7, "maxDepth": 5}), ("gbt", {"maxIter": 6, "maxDepth": 3}), ("rbf", {"width": 0.5}), ("theil_sen", {"subsets": 40})]


@pytest.mark.parametrize(("code", "params"), MODELS)
def test_importance_is_that_of_exchanged_rows(rows, code, params):
    """Against a prediction of every row with every column exchanged, by the model itself."""
    whole = rows.filter("property is not null and features is not null and not exists(features, x -> x is null)")
    model = models.fit(whole, code, **params)
    x = np.array([r["features"] for r in whole.orderBy("id").collect()])
    mine = importance.scorer(model).scores(x)
    theirs = [r["pred"] for r in models.predict(model, whole).orderBy("id").collect()]
    assert np.allclose(mine, theirs, atol=1e-9)
    got = {r["idx"]: r["importance"] for r in importance.permutation_importance(rows, model, 2).collect()}
    own = split.ranked(whole.select("id", "property", "features"), 42)
    error = {}
    for r in range(2):
        other = split.ranked(whole.select("id", "features"), 43 + r).select("rank", F.col("features").alias("other"))
        both = own.join(other, "rank").select("id", "property", "features", "other", F.explode(F.sequence(F.lit(-1), F.lit(6))).alias("idx"))
        mixed = F.transform("features", lambda v, i: F.when(i == F.col("idx"), F.get("other", i)).otherwise(v))
        scored = models.predict(model, both.select(F.col("idx").alias("id"), "property", mixed.alias("features")))
        for e in scored.groupBy("id").agg(F.avg((F.col("exp") - F.col("pred")) ** 2).alias("e")).collect():
            error.setdefault(e["id"], []).append(e["e"])
    # Rows that are not whole take part in the order, and so in the partners, only where they have a target.
    if rows.filter("property is not null").count() == whole.count():
        assert got == pytest.approx({j: np.mean(error[j]) - np.mean(error[-1]) for j in range(7)})
    clean = {r["idx"]: r["importance"] for r in importance.permutation_importance(whole, model, 2).collect()}
    assert set(got) == set(clean) == set(range(7))
    assert clean == pytest.approx({j: np.mean(error[j]) - np.mean(error[-1]) for j in range(7)}, abs=1e-8)


def test_importance_needs_a_known_model(rows):
    with pytest.raises(ValueError, match="no scorer"):
        importance.scorer(models.fit(rows.filter("features is not null and fold < 1 and id < 900").withColumn("property", (F.col("property") > 0).cast("double")), "reg", binary=True))
    model = models.fit(rows.filter("id < 900"), "reg")
    assert importance.permutation_importance(rows.limit(0), model, 1).collect() == []
