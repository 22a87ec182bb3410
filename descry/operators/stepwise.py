"""Features added or dropped one at a time, from the folds' sums of products: rows are read once."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from descry.operators.linalg import Grams, grams_of

#: A feature whose part that others don't explain is below this share of it can't be told from them.
DEPENDENT = 1e-10


def standardised(grams: Grams) -> list[tuple[int, np.ndarray]]:
    """Each fold's rows and sums of products of [1, x, y], with x centred and divided by its deviation over all folds, and y centred."""
    total = sum(g for _, _, g in grams.values())
    n = total[0, 0]
    mean, spread = total[0] / n, np.sqrt(np.maximum(np.diag(total) / n - (total[0] / n) ** 2, 0))
    mean[0], spread[0], spread[-1] = 0.0, 1.0, 1.0
    t = np.diag(1 / np.where(spread > 0, spread, 1.0)) @ (np.eye(len(mean)) - np.outer(mean, np.eye(len(mean))[0]))
    return [(k, t @ g @ t.T) for _, (k, _, g) in sorted(grams.items())]


class Fit:
    """Least squares of y on 1 and a changing set of features, judged on rows apart.

    rest, apart: sums of products of [1, x, y] of the rows that are fitted and of the n that are
    judged. The inverse over the set is brought up to date as features come (bordering) and go
    (a rank-one step), so no step solves a system anew.
    """

    def __init__(self, rest: np.ndarray, apart: np.ndarray, n: int):
        self.r, self.g, self.n = rest, apart, n
        self.at, self.inverse = [0], np.array([[1 / rest[0, 0]]])
        self._around: np.ndarray | None = None

    def coefficients(self) -> np.ndarray:
        return self.inverse @ self.r[self.at, -1]

    def error(self) -> float:
        """Mean squared error of the rows apart."""
        b, g = self.coefficients(), self.g[np.ix_(self.at, self.at)]
        return float(self.g[-1, -1] - 2 * b @ self.g[self.at, -1] + b @ g @ b) / self.n

    def with_each(self) -> np.ndarray:
        """The error after each feature is added; infinite for those in the set or dependent on it."""
        s, b = self.at, self.coefficients()
        d = self.inverse @ self.r[s]
        own = np.diag(self.r) - (self.r[s] * d).sum(0)
        ok = own > DEPENDENT * np.maximum(np.diag(self.r), 1e-300)
        step = np.where(ok, (self.r[:, -1] - self.r[:, s] @ b) / np.where(ok, own, 1.0), 0.0)
        left = self.g[:, -1] - self.g[:, s] @ b
        turn = left - d.T @ left[s]
        bend = np.diag(self.g) - 2 * (d * self.g[s]).sum(0) + (d * (self.g[np.ix_(s, s)] @ d)).sum(0)
        out = self.error() + (step**2 * bend - 2 * step * turn) / self.n
        out[~ok] = np.inf
        out[s] = np.inf
        return out[1:-1]

    def without_each(self) -> np.ndarray:
        """The error after each feature of the set is dropped, in the set's order."""
        s, b = self.at, self.coefficients()
        if self._around is None:
            self._around = self.inverse @ self.g[np.ix_(s, s)] @ self.inverse
        step = b / np.diag(self.inverse)
        turn = self.inverse @ (self.g[s, -1] - self.g[np.ix_(s, s)] @ b)
        return (self.error() + (step**2 * np.diag(self._around) + 2 * step * turn) / self.n)[1:]

    def add(self, feature: int) -> bool:
        """Whether the feature (from 0) can be told from the set; if so, it is in now."""
        j = feature + 1
        c = self.inverse @ self.r[self.at, j]
        own = self.r[j, j] - self.r[j, self.at] @ c
        if not own > DEPENDENT * max(self.r[j, j], 1e-300):
            return False
        self.inverse = np.block([[self.inverse + np.outer(c, c) / own, -c[:, None] / own], [-c[None, :] / own, np.array([[1 / own]])]])
        self.at, self._around = [*self.at, j], None
        return True

    def drop(self, feature: int) -> None:
        i = self.at.index(feature + 1)
        p, q = self.inverse[:, i], self.inverse[i, i]
        if self._around is not None:
            h = self.g[np.ix_(self.at, self.at)] @ p
            w = self.inverse @ h
            self._around = self._around - (np.outer(w, p) + np.outer(p, w)) / q + (p @ h / q**2) * np.outer(p, p)
        inverse = self.inverse - np.outer(p, p) / q
        left = [k for k in range(len(self.at)) if k != i]
        self.inverse = inverse[np.ix_(left, left)]
        if self._around is not None:
            self._around = self._around[np.ix_(left, left)]
        self.at = [self.at[k] for k in left]


def _fits(folds: list[tuple[int, np.ndarray]]) -> list[Fit]:
    total = sum(g for _, g in folds)
    return [Fit(total - g, g, n) for n, g in folds]


def independent(fits: list[Fit], features: Sequence[int]) -> list[int]:
    """Adds those of the features that every fold can tell from the ones before."""
    kept = []
    for j in features:
        done = [f for f in fits if f.add(j)]
        if len(done) == len(fits):
            kept.append(j)
        else:
            for f in done:
                f.drop(j)
    return kept


def path(folds: list[tuple[int, np.ndarray]], most: int, backward: bool = False) -> dict[int, tuple[list[int], np.ndarray]]:
    """For each number of features its greedy subset, and the folds' mean squared errors: forward up to `most`, or from all that can be told apart down."""
    fits, p, out = _fits(folds), folds[0][1].shape[0] - 2, {}
    chosen = independent(fits, range(p)) if backward else []
    while chosen if backward else len(chosen) < min(most, p):
        if backward:
            if len(chosen) <= most or len(chosen) == p:
                out[len(chosen)] = list(chosen), np.array([f.error() for f in fits])
            if len(chosen) == 1:
                break
            worst = int(np.mean([f.without_each() for f in fits], axis=0).argmin())
            for f in fits:
                f.drop(chosen[worst])
            del chosen[worst]
        else:
            mean = np.mean([f.with_each() for f in fits], axis=0)
            if not np.isfinite(mean.min()):
                break
            chosen.append(int(mean.argmin()))
            for f in fits:
                f.add(chosen[-1])
            out[len(chosen)] = list(chosen), np.array([f.error() for f in fits])
    return out


@dataclass
class Step:
    """A number of features with its subset, the folds' mean error and deviation as shares of the error of all features, and the objective."""

    size: int
    features: list[int]
    error: float
    deviation: float
    objective: float


def stepwise(df: DataFrame, least: int = 2, most: int | None = 20, step: int = 1, direction: str = "forward", penalty: float | None = 0.002, alpha: float = 0.7) -> tuple[list[int], list[Step]]:
    """The subset of least objective over sizes least, least + step, ... most, and all sizes tried.

    objective = mean RMSE / base + deviation of the RMSE / base + penalty * size over the folds of df
    (property, features, fold), where base is the root of the mean squared error of all features.
    Subsets are greedy by the folds' mean squared error: features are added to none (forward) or
    dropped from all (backward); equal ones by position. most: None tries up to all features, which
    are one of the sizes if they are no more than most. penalty: None takes it from the noise of the
    folds' errors, alpha * deviation / base * sqrt(log(1 + features) / rows), 0.001 at least.

    Rows that are not whole and rows without a target are left out; features that can't be told from
    others don't enter (or, backward, don't start). An empty table gives no subset.
    """
    if direction not in ("forward", "backward"):
        raise ValueError(f"no such direction: {direction}")
    if step < 1 or (most is not None and least > most):
        raise ValueError("sizes need a step of at least one, and no more at least than at most")
    grams = grams_of(df)
    if not grams:
        return [], []
    folds = standardised(grams)
    p = folds[0][1].shape[0] - 2
    everything = _fits(folds)
    whole = independent(everything, range(p))
    errors = np.array([f.error() for f in everything])
    base = max(math.sqrt(max(errors.mean(), 0.0)), 1e-12)
    if penalty is None:
        noise = float(np.sqrt(np.maximum(errors, 0)).std()) / base
        penalty = max(1e-3, alpha * noise * math.sqrt(max(math.log(1 + p) / sum(n for n, _ in folds), 1e-6)))
    top = p if most is None else min(most, p)
    subsets = path(folds, top, direction == "backward")
    if top == p:
        subsets[p] = whole, errors
    sizes = [*range(max(1, least), top + 1, step)]
    if most is None or most >= p:
        sizes = [k for k in sizes if k < p] + [p]
    tried = []
    for k in sizes:
        if k in subsets:
            features, squared = subsets[k]
            rmse = np.sqrt(np.maximum(squared, 0))
            error, deviation = float(rmse.mean()) / base, float(rmse.std()) / base
            tried.append(Step(k, list(features), error, deviation, error + deviation + penalty * k))
    best = min(tried, key=lambda s: (s.objective, s.size), default=None)
    return (best.features if best else []), tried


def eliminated(df: DataFrame, start: Sequence[int] | None = None, drop: int = 1) -> list[int]:
    """Recursive elimination by cross-validation, repeated until the number of features stays.

    In each fold the features of smallest standardised coefficient are dropped, `drop` at a time, and
    each number of features is judged on the rows apart; the number of least mean squared error (the
    smaller of equals) is kept, and the same elimination over all rows says which. start: positions to
    begin with, all unless given. Rows that are not whole are left out; an empty table keeps nothing.
    """
    grams = grams_of(df)
    if not grams:
        return []
    folds = standardised(grams)
    total = sum(g for _, g in folds)
    kept = list(range(len(total) - 2)) if start is None else sorted(start)

    def order(fit: Fit, features: list[int]) -> list[tuple[list[int], float]]:
        left, out = independent([fit], features), []
        while left:
            out.append((list(left), fit.error()))
            size = np.abs(fit.coefficients()[1:])
            for j in [left[i] for i in np.lexsort((-np.arange(len(left)), size))[: min(drop, len(left) - 1) or 1]]:
                fit.drop(j)
                left.remove(j)
        return out

    while kept:
        errors: dict[int, list[float]] = {}
        for n, g in folds:
            for left, error in order(Fit(total - g, g, n), kept):
                errors.setdefault(len(left), []).append(error)
        mean = {k: float(np.mean(v)) for k, v in errors.items() if len(v) == len(folds)}
        if not mean:
            return []
        size = min(mean, key=lambda k: (mean[k], k))
        now = next(left for left, _ in order(Fit(total, total, 1), kept) if len(left) <= size)
        if len(now) == len(kept):
            break
        kept = now
    return kept
