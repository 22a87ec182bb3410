"""Projection and groups of whole sets."""

import numpy as np
import pytest

from descry.operators import overview

SCHEMA = "id long, features array<double>, cluster string"


def _rows(spark, x, start=0):
    return spark.createDataFrame([(start + i, v, "own") for i, v in enumerate(x)], SCHEMA)


def test_projection_is_that_of_the_training_rows(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (60, 5)) * [5, 3, 1, 0.5, 0.1] + 7
    test = rng.normal(0, 1, (10, 5)) + 7
    train = _rows(spark, [*x.tolist(), None, [1.0, None, 2.0, 3.0, 4.0]])
    got = overview.projection(train, _rows(spark, test.tolist(), 100)).collect()
    assert sorted(r["id"] for r in got) == [*range(60), *range(100, 110)]
    _, _, vt = np.linalg.svd(x - x.mean(0), full_matrices=False)
    loads = vt[:2].T
    loads = loads * np.sign(loads[np.abs(loads).argmax(0), [0, 1]])
    want = (np.concatenate([x, test]) - x.mean(0)) @ loads
    for r in got:
        assert r["is_test"] == (r["id"] >= 100)
        assert np.allclose(r["components"], want[r["id"] if r["id"] < 60 else r["id"] - 40], atol=1e-8)
    with pytest.raises(ValueError):
        overview.projection(_rows(spark, [None]), train)


def test_row_groups_keep_like_rows_together(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(at, 0.1, (20, 3)) for at in (-10, 0, 10, 30)])
    x = np.concatenate([x, x[:1]])
    got = {r["id"]: r["cluster"] for r in overview.row_groups(_rows(spark, [*x.tolist(), None]), k=4).collect()}
    assert len(got) == 81 and got[80] == got[0]
    groups = [{got[i] for i in range(a, a + 20)} for a in (0, 20, 40, 60)]
    assert all(len(g) == 1 for g in groups) and len(set.union(*groups)) == 4
    assert overview.row_groups(_rows(spark, [None])).count() == 0
