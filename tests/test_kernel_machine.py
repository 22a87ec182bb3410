"""The machines' optimum, its bound, and their use by code."""

import numpy as np
import pytest

from descry.operators import kernel_machine, models, split

ROWS = "id long, property double, features array<double>"


def rings(n=240, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 2))
    return x, ((x**2).sum(1) > 1.4).astype(float)


@pytest.fixture(scope="module")
def rows(spark):
    x, y = rings()
    return spark.createDataFrame([(i, float(y[i]), x[i].tolist()) for i in range(len(y))], ROWS).repartition(3).cache()


def slowly(z, y, c, binary, epsilon=0.1, steps=20000):
    """The least primal value met by plain subgradient steps."""
    w, best = np.zeros(z.shape[1]), np.inf
    for t in range(steps):
        out = z @ w
        if binary:
            loss, g = np.maximum(0, 1 - y * out), -((y * out < 1) * y)
        else:
            loss, g = np.maximum(0, np.abs(y - out) - epsilon), -np.sign(y - out) * (np.abs(y - out) > epsilon)
        best = min(best, w @ w / 2 + c * loss.mean())
        w = w - (w + c * (g @ z) / len(y)) / (t + 1)
    return best


@pytest.mark.parametrize("binary", [True, False])
def test_values_enclose_the_optimum(spark, binary):
    x, y = rings(120, 3)
    y = y if binary else np.sin(x[:, 0]) + 0.1 * x[:, 1]
    df = spark.createDataFrame([(float(a), b.tolist()) for a, b in zip(y, x, strict=True)] + [(None, [0.0, 0.0]), (1.0, None), (1.0, [1.0, None])], "property double, z array<double>").repartition(2)
    machines = kernel_machine.train(df, binary, [0.5, 1.0], [1.0, 5.0], gap=0.05, most=150)
    assert [(m.width, m.c) for m in machines] == [(0.5, 1.0), (0.5, 5.0), (1.0, 1.0), (1.0, 5.0)]
    for m in machines:
        z = kernel_machine.lifted(x, m.width, 42)
        target = np.where(y > 0.5, 1.0, -1.0) if binary else y
        out = z @ m.weights
        loss = np.maximum(0, 1 - target * out) if binary else np.maximum(0, np.abs(target - out) - 0.1)
        assert m.primal == pytest.approx(m.weights @ m.weights / 2 + m.c * loss.mean())
        best = slowly(z, target, m.c, binary)
        assert m.dual <= best * (1 + 1e-9) and m.primal >= m.dual
        assert m.gap <= 0.05 or m.passes == 150
        assert m.primal <= best * 1.08


def test_machines_by_code(rows, spark):
    model = models.fit(rows, "svm", binary=True, width=2.0, c=50.0, most=60)
    p = models.predict(model, rows, binary=True).collect()
    assert all(0 <= r["pred"] <= 1 for r in p) and np.mean([(r["pred"] > 0.5) == (r["exp"] > 0.5) for r in p]) > 0.93
    x, _ = rings()
    wave = spark.createDataFrame([(i, float(40 + 5 * np.sin(2 * v[0])), v.tolist()) for i, v in enumerate(x)], ROWS)
    out = np.array([(r["exp"], r["pred"]) for r in models.predict(models.fit(wave, "svm", width=1.0, c=50.0, most=60), wave).collect()])
    assert np.corrcoef(out.T)[0, 1] > 0.9
    with pytest.raises(ValueError, match="no whole rows"):
        kernel_machine.train(wave.limit(0).selectExpr("property", "features as z"), False)


def test_grid_of_machines_in_the_same_passes(rows):
    best, scores = models.grid_search(split.k_folds(rows, 3), "svm", {"c": [0.01, 50.0], "width": [1.0]}, binary=True)
    assert best == {"c": 50.0, "width": 1.0} and len(scores) == 2 and dict((c["c"], s) for c, s in scores)[50.0] > 0.85
