"""Rows that are not whole, and exact neighbours and densities through the index."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from descry.operators import domain, knn, linalg, metric_index, models

ROWS = "id long, property double, features array<double>"


def frame(spark, rows):
    return spark.createDataFrame([(i, float(i % 3), None if x is None else [None if v is None else float(v) for v in x]) for i, x in rows], ROWS).repartition(3)


FOUR = [(1, [1, 2, 3, 4]), (2, [4, None, 2, 1]), (3, [2, 2, 5, 0]), (4, [1, 0, 1, 7])]


@pytest.mark.parametrize("more", [[], [(5, None)], [(6, [float("nan"), 1, 1, 1])], [(7, [1, float("inf"), 1, 1]), (8, None)]])
def test_sums_of_products_leave_out_rows_that_are_not_whole(spark, more):
    n, s, g = linalg.gram(frame(spark, FOUR + more))
    x = np.array([r for _, r in FOUR if None not in r], float)
    assert n == 3 and np.allclose(s, x.sum(0)) and np.allclose(g, x.T @ x)
    got = {r["id"]: r["leverage"] for r in linalg.leverages(frame(spark, FOUR + more), np.eye(4)).collect()}
    assert got == {i: sum(v * v for v in r) for i, r in FOUR if None not in r}


def test_rows_of_different_lengths_are_an_error():
    assert linalg.complete_rows(pa.array([[1.0], None, []], pa.list_(pa.float64())).slice(0, 2))[0].tolist() == [0]
    with pytest.raises(ValueError, match="features"):
        linalg.complete_rows(pa.array([[1.0, 2.0], [1.0]]))
    assert linalg.complete_rows(pa.chunked_array([], pa.list_(pa.float64())))[0].tolist() == []


def test_folds_and_least_squares_with_missing_features(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 3))
    rows = [(i, float(v @ [1, -2, 3] + 4), v.tolist(), i % 3) for i, v in enumerate(x)]
    rows += [(100, 9.0, [1.0, None, 2.0], 0), (101, 9.0, None, 1), (102, 9.0, [1.0, 1.0, 1.0], None)]
    df = spark.createDataFrame(rows, ROWS + ", fold int")
    got = linalg.fold_grams(df, "fold")
    assert sorted(got) == [0, 1, 2] and all(got[k][0] == 20 and np.allclose(got[k][2], x[k::3].T @ x[k::3]) for k in got)
    fitted = models.least_squares(df.filter("fold is not null"), ["a", "b", "c"])
    assert [r["estimate"] for r in fitted.collect()] == pytest.approx([4, 1, -2, 3])


def scattered(seed, n=700, width=5, clusters=9):
    """Clustered rows with many copies of one, rows of equal distance, of zeros, and some that are not whole."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 10, (clusters, width))
    x = centres[rng.integers(clusters, size=n)] + rng.normal(0, 1, (n, width))
    x[: n // 3] = x[0]
    x[n // 3 : n // 3 + 30] = np.round(x[n // 3 : n // 3 + 30])
    x[n - 5 : n - 2] = 0
    rows = [(int(i), v.tolist()) for i, v in zip(rng.permutation(n), x, strict=True)]
    return [*rows, (n + 1, None), (n + 2, [1.0] * (width - 1) + [None]), (n + 3, [float("nan")] * width)]


def ordered(df):
    return sorted((r["id"], r["rank"], r["neighbour_id"], round(r["distance"], 7)) for r in df.collect())


@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
@pytest.mark.parametrize("k", [1, 6])
def test_indexed_neighbours_are_those_of_all_pairs(spark, metric, k, monkeypatch):
    monkeypatch.setattr(metric_index, "FEW_ROWS", 40)
    rows = scattered(1)
    train, query = frame(spark, rows[:600] + rows[-3:]), frame(spark, rows[500:] + [(9000, [0.0] * 5), (9001, [50.0] * 5)])
    plain = ordered(knn.neighbours(train, query, k, metric))
    assert ordered(knn.neighbours(train, query, k, metric, sent_bytes=0, block_rows=50)) == plain
    whole = {i: np.array(v) for i, v in rows[:600]}
    assert {q for q, *_ in plain} == {i for i, v in rows[500:700]} | {9000, 9001}
    if metric == "euclidean":
        ask = dict(rows[500:700])
        for q in list(ask)[::17]:
            best = sorted((round(float(np.linalg.norm(v - ask[q])), 9), i) for i, v in whole.items() if i != q)[:k]
            assert [p[2] for p in plain if p[0] == q] == [i for _, i in best]


def test_index_of_few_rows_and_of_none(spark):
    rows = frame(spark, [(1, [0.0, 1.0]), (2, [1.0, 1.0])])
    assert ordered(knn.neighbours(rows, rows, 3, sent_bytes=0)) == [(1, 1, 2, 1.0), (2, 1, 1, 1.0)]
    none = frame(spark, [(1, None)])
    assert knn.neighbours(none, rows, 3, sent_bytes=-1).collect() == [] == knn.neighbours(rows, none, 3, sent_bytes=0).collect()


def test_index_skips_most_blocks_of_clustered_rows(spark, monkeypatch):
    """Counted: rows sent to blocks, of all pairs of a row and a block; the copies fill blocks of their own, no block is too large."""
    monkeypatch.setattr(metric_index, "FEW_ROWS", 20)
    rows = frame(spark, scattered(2, n=1200, clusters=30)[:1200])
    index = metric_index.build(rows, 25)
    assert index.count.sum() == 1200 and index.count.max() <= 100 and len(index.block) >= 48
    asked = index.asked(metric_index.points(rows).withColumn("reach", F.lit(3.0)), 3, at_home=False)
    assert asked.count() < 0.35 * 1200 * len(index.block)
    assert index.asked(metric_index.points(rows).withColumn("reach", F.lit(None).cast("double")), 3, at_home=True).groupBy("id").count().filter("count <> 1").count() == 0


@pytest.mark.parametrize("left_out", [False, True])
def test_density_is_the_sum_over_all_training_rows(spark, left_out, monkeypatch):
    monkeypatch.setattr(metric_index, "FEW_ROWS", 40)
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (300, 3)) * [1, 2, 5]
    train = frame(spark, [(i, v.tolist()) for i, v in enumerate(x[:240])] + [(900, None)])
    test = frame(spark, [(1000 + i, v.tolist()) for i, v in enumerate(x[240:])])
    z = (x - x[:240].mean(0)) / x[:240].std(0)
    e = -((z[:, None] - z[None, :240]) ** 2).sum(-1) / 2
    if left_out:
        e[np.arange(240), np.arange(240)] = -np.inf
    plain = np.log(np.exp(e).sum(1))
    for sent in (domain.SENT_BYTES, 0):
        flags, cutoff = domain.density(train, test, leave_out=left_out, sent_bytes=sent, block_rows=30)
        got = {(r["set"], r["id"]): (r["value"], r["inside"]) for r in flags.collect()}
        assert len(got) == 300 and cutoff == pytest.approx(np.sort(plain[:240])[12])
        for i, v in enumerate(plain):
            value, inside = got["train" if i < 240 else "test", i if i < 240 else 760 + i]
            assert value == pytest.approx(v, abs=1e-9) and inside == (round(value, 9) > round(cutoff, 9))
