"""Average linkage over neighbours against plain average linkage."""

import numpy as np
import pytest

from descry.operators import overview

ROWS = "id long, features array<double>"


def plain(x, at_most):
    groups = [[i] for i in range(len(x))]
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    while len(groups) > 1:
        apart = [(round(float(d[np.ix_(a, b)].mean()), 9), min(a), min(b), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j]
        best = min(apart)
        if best[0] > at_most:
            break
        groups[best[3]] += groups[best[4]]
        del groups[best[4]]
    return {i: min(g) for g in groups for i in g}


@pytest.mark.parametrize(("at_most", "seed"), [(1.5, 1), (6.0, 2)])
def test_groups_are_those_of_average_linkage(spark, at_most, seed):
    rng = np.random.default_rng(seed)
    x = np.repeat(rng.normal(0, 6, (5, 2)), 8, 0) + rng.normal(0, 0.7, (40, 2))
    x[1] = x[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(90, None), (91, [1.0, float("nan")])]
    df = spark.createDataFrame(rows, ROWS).repartition(3)
    got = {r["id"]: r["cluster"] for r in overview.linked_groups(df, at_most, k=60).collect()}
    assert got == plain(x, at_most)


def test_groups_over_few_neighbours(spark):
    x = [(i, [float(c * 100 + i % 7), float(i % 5)]) for c in range(3) for i in range(c * 30, c * 30 + 30)] + [(500, [9e5, 0.0])]
    got = {r["id"]: r["cluster"] for r in overview.linked_groups(spark.createDataFrame(x, ROWS), 40.0, k=6).collect()}
    assert got[500] == 500 and all(got[i] // 30 == i // 30 for i in range(90))
    assert overview.linked_groups(spark.createDataFrame([], ROWS), 1.0).collect() == []
