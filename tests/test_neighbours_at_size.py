"""Bounds of products against plain distances, rows sent to blocks that nothing rules out, and values that are found once."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from descry.operators import domain, knn, metric_index

ROWS = "id long, property double, features array<double>"


def frame(spark, x, first=0):
    return spark.createDataFrame([(first + i, float(i % 3), v.tolist()) for i, v in enumerate(x)], ROWS).repartition(3)


def cloud(kind, n=700, width=6):
    rng = np.random.default_rng(7)
    x = rng.normal(0, 1, (n, width))
    if kind == "far":
        return x + 1e6
    if kind == "two far groups":
        return x + np.where(np.arange(n) % 2, 1e7, -1e7)[:, None]
    if kind == "large":
        return x * 1e30
    if kind == "copies":
        return np.round(x)[rng.integers(0, 40, n)] * (np.arange(n) % 9 > 0)[:, None]
    return x


@pytest.mark.parametrize("cosine", [False, True])
@pytest.mark.parametrize("kind", ["near", "far", "two far groups", "large", "copies"])
def test_bounded_pairs_are_those_of_all_distances(kind, cosine):
    x = cloud(kind)
    ids = np.random.default_rng(1).permutation(len(x))
    ids, x = np.sort(ids), x[np.argsort(ids)]
    for k in (1, 5):
        r, c, d = knn._nearest(ids[::3], x[::3], ids, x, k, cosine)
        for i in range(0, len(ids[::3]), 11):
            all_d = knn._distances(x[::3][i : i + 1], x, cosine)[0]
            best = sorted((round(float(v), 9), j) for j, v in enumerate(all_d) if j != 3 * i)[:k]
            if cosine:
                assert np.allclose(d[r == i], [v for v, _ in best], atol=2e-9)
            else:
                assert c[r == i].tolist() == [j for _, j in best]


def test_rows_that_nothing_rules_out_go_to_groups_and_not_to_blocks(spark, monkeypatch):
    """Counted: before, each row went to each block; and no batch is larger than its bytes."""
    monkeypatch.setattr(metric_index, "FEW_ROWS", 40)
    x = np.random.default_rng(2).normal(0, 1, (1200, 30))
    index = metric_index.build(frame(spark, x), 30)
    groups = len(set(index.group.tolist()))
    assert len(index.block) >= 40 and groups <= 7 and index.splits * groups >= 4
    asked = index.asked(metric_index.points(frame(spark, x)).withColumn("reach", F.lit(None).cast("double")), 3, at_home=False)
    assert 1200 < asked.count() <= 1200 * groups


def test_values_are_found_once(spark, monkeypatch):
    """Rows that come out of the neighbour search: k for each row of both sets, whatever reads the values."""
    seen = spark.sparkContext.accumulator(0)
    plain = knn.neighbours

    def counted(train, query, k, metric="euclidean", **more):
        near = plain(train, query, k, metric, **more)

        def run(batches):
            for b in batches:
                seen.add(b.num_rows)
                yield b

        return near.mapInArrow(run, near.schema)

    monkeypatch.setattr(domain, "neighbours", counted)
    x = np.random.default_rng(3).normal(0, 1, (50, 3))
    for measure, k in ((domain.local_similarity, 5), (domain.knn_distance, 3)):
        before = seen.value
        # A test row may have a training row's id: it is another row.
        flags, _ = measure(frame(spark, x[:40]), frame(spark, x[40:], 35))
        assert len(flags.collect()) == 50 and seen.value - before == 50 * k


def test_kernels_far_from_the_origin_and_with_an_id_of_minus_one():
    x = cloud("two far groups", 300, 4)
    ids = np.arange(-1, 299)
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    for left_out in (None, (ids, np.zeros(300, bool)), (ids, np.ones(300, bool))):
        e = -d / 2
        if left_out is not None and left_out[1][0]:
            e[np.arange(300), np.arange(300)] = -np.inf
        got = domain._log_kernels(x, metric_index.Pieces(ids, x, kind="f8", met=70), 1.0, left_out)
        assert np.allclose(got, np.log(np.exp(e - e.max(1, keepdims=True)).sum(1)) + e.max(1), atol=1e-9)


def test_a_density_does_not_depend_on_what_comes_along():
    x = np.random.default_rng(5).normal(0, 1, (5000, 64))
    pieces = metric_index.Pieces(np.arange(5000), x, kind="f8")
    whole = domain._log_kernels(x[:300], pieces, 1.0)
    order = np.random.default_rng(6).permutation(300)
    assert np.array_equal(domain._log_kernels(x[:300][order], pieces, 1.0), whole[order])
    assert np.array_equal(domain._log_kernels(x[77:78], pieces, 1.0), whole[77:78])
