"""Rounds of one task and rounds by joins; many rounds in little time."""

import time

import numpy as np
import pytest

from descry.operators import overview

ROWS = "id long, features array<double>"


def rounds(pairs, at_most):
    """The rounds as they are described, over all pairs each time."""
    pairs, group = {p: (t, n) for p, (t, n) in pairs.items()}, {}
    while True:
        best = {}
        for (a, b), (t, n) in pairs.items():
            d = round(t / n, 9)
            if d <= at_most:
                best[a] = min(best.get(a, (d, b)), (d, b))
                best[b] = min(best.get(b, (d, a)), (d, a))
        joins = {b: a for a, (_, b) in best.items() if a < b and best[b][1] == a}
        if not joins:
            return group
        group |= joins
        merged = {}
        for (a, b), (t, n) in pairs.items():
            a, b = sorted((joins.get(a, a), joins.get(b, b)))
            if a != b:
                old = merged.get((a, b), (0.0, 0))
                merged[a, b] = old[0] + t, old[1] + n
        pairs = merged


def end(group, i):
    while i in group:
        i = group[i]
    return i


@pytest.mark.parametrize("wide", [0, 64])
def test_one_tasks_rounds_are_the_rounds(monkeypatch, wide):
    monkeypatch.setattr(overview, "WIDE", wide)
    for seed in range(30):
        rng = np.random.default_rng(seed)
        a, b = np.sort(rng.integers(0, 60, (2, 300)) * 3, axis=0)
        keep = a < b
        # Few different distances, so that many tie.
        pairs = {(int(x), int(y)): (float(d), 1) for x, y, d in zip(a[keep], b[keep], np.round(rng.random(keep.sum()), 1 + seed % 3), strict=True)}
        arrays = [np.array(c) for c in zip(*((x, y, t, n) for (x, y), (t, n) in pairs.items()), strict=True)]
        old, new = overview._joined(*arrays, 0.5)
        whole = rounds(pairs, 0.5)
        assert dict(zip(old.tolist(), new.tolist(), strict=True)) == {i: end(whole, i) for i in whole}


def test_joins_and_one_task_give_the_same_groups(spark):
    rng = np.random.default_rng(4)
    x = np.repeat(rng.normal(0, 4, (6, 2)), 10, 0) + rng.normal(0, 1, (60, 2))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], ROWS)
    got = [{r["id"]: r["cluster"] for r in overview.linked_groups(df, 1.5, k=5, in_task=n).collect()} for n in (0, 1 << 20)]
    assert got[0] == got[1] and 6 < len(set(got[0].values())) < 60


def test_a_chain_of_many_rounds_takes_little_time(spark):
    """Each row is nearest to the one before it, so a round joins one pair: 39 rounds."""
    x = np.cumsum(1.05 ** np.arange(40))
    df = spark.createDataFrame([(i, [float(v)]) for i, v in enumerate(x)], ROWS)
    began = time.time()
    assert {r["cluster"] for r in overview.linked_groups(df, 1e9, k=39).collect()} == {0}
    assert time.time() - began < 30
