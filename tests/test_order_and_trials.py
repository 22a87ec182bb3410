"""Places in order beyond one task, and trials in batches."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from descry.operators import order, robust


@pytest.mark.parametrize("kind", ["spread", "few", "hot", "copies"])
def test_places_in_the_same_passes(spark, kind):
    rng = np.random.default_rng(4)
    x = {"spread": rng.normal(size=6000), "few": rng.integers(0, 5, 6000).astype(float), "hot": np.where(rng.random(6000) < 0.5, 1.0, rng.normal(size=6000)), "copies": np.full(6000, 2.5)}[kind]
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)] * 20, "v double").repartition(4)
    places = [0, 17, 1500, 2999, 3000, 4499, 5983, 5999, 1500]
    assert order.values_at(df, "v", places, 6000, most=300) == np.sort(x)[places].tolist()
    assert order.values_at(df, "v", places, 6000) == np.sort(x)[places].tolist()
    at = [0.0, 0.1, 0.333, 0.5, 0.9, 1.0]
    assert order.quantiles(df, "v", at, most=300) == pytest.approx(np.quantile(x, at).tolist())
    assert order.split_value(df, "v", 0.95, most=300) == np.sort(x)[5700]


def test_all_places_take_few_jobs(spark):
    df = spark.range(20_000).select(F.col("id").cast("double").alias("v"))
    group = "places"
    spark.sparkContext.setJobGroup(group, "places")
    try:
        assert order.values_at(df, "v", list(range(0, 20_000, 1000)), 20_000, most=500) == [float(i) for i in range(0, 20_000, 1000)]
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)) < 20
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_trials_end_when_enough_are_made(spark, monkeypatch):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 2))
    y = 2 * x[:, 0] - x[:, 1] + 5 + 0.01 * rng.normal(size=200)
    y[:40] += 50
    df = spark.createDataFrame([(i, float(y[i]), x[i].tolist()) for i in range(200)] + [(900, 1.0, [float("nan"), 1.0])], "id long, property double, features array<double>")
    asked = []
    fits = robust.Trials.fits
    monkeypatch.setattr(robust.Trials, "fits", lambda self, first, trials: asked.append((first, trials)) or fits(self, first, trials))
    early = robust.consensus(df, threshold=0.1, batch=6)
    assert np.allclose(early, [5, 2, -1], atol=0.02) and sum(n for _, n in asked) < 30
    asked.clear()
    assert np.allclose(robust.consensus(df, threshold=0.1, probability=None, trials=20, batch=8), early, atol=1e-9) and asked == [(0, 8), (8, 8), (16, 4)]
    assert robust.enough_trials(10, 10, 3, 0.99) == 0 and robust.enough_trials(0, 10, 3, 0.99) == np.inf
    assert robust.enough_trials(160, 200, 3, 0.99) == pytest.approx(np.log(0.01) / np.log(1 - 0.8**3))
    drawn = robust.Trials(robust._complete(df), 7)
    whole = drawn.fits(0, 6)
    assert np.allclose(robust.Trials(robust._complete(df), 7).fits(2, 3), whole[2:5])
