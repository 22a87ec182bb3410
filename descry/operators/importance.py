"""Permutation importance: a fitted model, sent to the tasks, scores each batch with one column at a time exchanged."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.regression import GBTRegressionModel, LinearRegressionModel, RandomForestRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from descry.operators.linalg import complete_rows
from descry.operators.models import Scaled
from descry.operators.robust import FourierFeatures, Line
from descry.operators.split import ranked

class Linear:
    """Weights and intercept on features as they come."""

    def __init__(self, weights: np.ndarray, intercept: float):
        self.weights, self.intercept = weights, intercept

    def scores(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weights + self.intercept

    def exchanged(self, x: np.ndarray, other: np.ndarray, scores: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        for j in range(x.shape[1]):
            yield j, scores + self.weights[j] * (other[:, j] - x[:, j])


@dataclass
class Tree:
    """Nodes as arrays; feature -1 is a leaf."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        at, rows = np.zeros(len(x), np.int64), np.arange(len(x))
        while (inner := self.feature[at] >= 0).any():
            f = self.feature[at]
            at = np.where(inner, np.where(x[rows, np.maximum(f, 0)] <= self.threshold[at], self.left[at], self.right[at]), at)
        return self.value[at]


def tree(text: str) -> Tree:
    """A tree from its printed form, whose numbers are whole doubles."""
    nodes: list[list] = []
    lines = iter([x.strip() for x in text.splitlines() if re.match(r"\s*(If|Else|Predict)", x)])

    def node() -> int:
        line, at = next(lines), len(nodes)
        nodes.append([-1, 0.0, 0, 0, 0.0])
        if line.startswith("Predict"):
            nodes[at][4] = float(line.split(":")[1])
            return at
        found = re.fullmatch(r"If \(feature (\d+) <= (\S+)\)", line)
        if not found:
            raise ValueError(f"a split that is no threshold: {line}")
        left = node()
        next(lines)  # Else
        nodes[at] = [int(found[1]), float(found[2]), left, node(), 0.0]
        return at

    node()
    f, t, a, b, v = zip(*nodes, strict=True)
    return Tree(np.array(f), np.array(t), np.array(a), np.array(b), np.array(v))


class Trees:
    """A weighted sum of trees; for an exchanged column only the trees that ask for it are walked again."""

    def __init__(self, trees: list[Tree], weights: np.ndarray):
        self.trees, self.weights = trees, weights
        self.of: dict[int, list[int]] = {}
        for i, t in enumerate(trees):
            for f in np.unique(t.feature[t.feature >= 0]).tolist():
                self.of.setdefault(f, []).append(i)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return sum(w * t.scores(x) for w, t in zip(self.weights, self.trees, strict=True))

    def exchanged(self, x: np.ndarray, other: np.ndarray, scores: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        each = [t.scores(x) for t in self.trees]
        for j in range(x.shape[1]):
            now = scores
            if j in self.of:
                changed = x.copy()
                changed[:, j] = other[:, j]
                now = scores + sum(self.weights[i] * (self.trees[i].scores(changed) - each[i]) for i in self.of[j])
            yield j, now


class Lifted:
    """A linear model on a kernel's random features."""

    def __init__(self, scaled: Scaled, lift: FourierFeatures, linear: Linear):
        self.mean, self.spread, self.linear = np.array(scaled.mean), np.array(scaled.spread), linear
        self.size, self.seed, self.width = lift.size, lift.seed, lift.getOrDefault(lift.width)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return self.linear.scores(FourierFeatures.lifted((x - self.mean) / self.spread, self.size, self.seed, self.width))

    def exchanged(self, x: np.ndarray, other: np.ndarray, scores: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        for j in range(x.shape[1]):
            changed = x.copy()
            changed[:, j] = other[:, j]
            yield j, self.scores(changed)


def scorer(model) -> Linear | Trees | Lifted:
    """A fitted regressor in the form that tasks score with; a model of another kind is an error."""
    stages = model.stages if isinstance(model, PipelineModel) else [model]
    last = stages[-1]
    if isinstance(last, Line):
        return Linear(np.array(last.b[1:]), float(last.b[0]))
    if isinstance(last, RandomForestRegressionModel):
        return Trees([tree(t.toDebugString) for t in last.trees], np.full(len(last.trees), 1 / len(last.trees)))
    if isinstance(last, GBTRegressionModel):
        return Trees([tree(t.toDebugString) for t in last.trees], np.array(last.treeWeights))
    if isinstance(last, LinearRegressionModel):
        own = Linear(last.coefficients.toArray(), last.intercept)
        if len(stages) == 3 and isinstance(stages[1], FourierFeatures):
            return Lifted(stages[0], stages[1], own)
        if len(stages) == 2 and isinstance(stages[0], Scaled):
            w = own.weights / np.array(stages[0].spread)
            return Linear(w, own.intercept - float(w @ np.array(stages[0].mean)))
        if len(stages) == 1:
            return own
    raise ValueError(f"no scorer for {type(last).__name__}")


def permutation_importance(df: DataFrame, model, repeats: int = 5, seed: int = 42) -> DataFrame:
    """(idx, importance): how much the mean squared error grows when a feature takes another row's values, over all rows and repeats.

    df: (id, property, features). In each repeat all rows get a partner by a hash order of their own,
    one join of as many rows as df has; a task then exchanges one column after the other inside a
    batch, and sends one sum of squared errors for each. Rows without a target, and pairs that are not
    whole, are left out; an empty table gives no rows.
    """
    sent = df.sparkSession.sparkContext.broadcast(scorer(model))
    rows = ranked(df.select("id", "property", "features").filter("property is not null"), seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        sums: dict[tuple[int, int], list] = {}
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                part = batch.slice(a, 4096)
                kept, x = complete_rows(part.column(2))
                part = part.take(pa.array(kept))
                also, other = complete_rows(part.column(3))
                if not len(also):
                    continue
                repeat, y, x = part.column(0).to_numpy()[also], part.column(1).to_numpy()[also], x[also]
                scores = own.scores(x)
                for j, now in [(-1, scores), *own.exchanged(x, other, scores)]:
                    for r in np.unique(repeat).tolist():
                        at = repeat == r
                        held = sums.setdefault((r, j), [0, 0.0])
                        held[0] += int(at.sum())
                        held[1] += float(((y - now)[at] ** 2).sum())
        if sums:
            r, j = zip(*sums, strict=True)
            n, e = zip(*sums.values(), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(r, pa.int32()), pa.array(j, pa.int32()), pa.array(n, pa.int64()), pa.array(e)], names=["repeat", "idx", "n", "e"])

    each = None
    for r in range(repeats):
        other = ranked(df.filter("property is not null").select("id", "features"), seed + 1 + r).select("rank", F.col("features").alias("other"))
        own = rows.join(other, "rank").select(F.lit(r).alias("repeat"), F.col("property").cast("double"), "features", "other")
        each = own if each is None else each.unionByName(own)
    error = each.mapInArrow(run, "repeat int, idx int, n long, e double").groupBy("repeat", "idx").agg((F.sum("e") / F.sum("n")).alias("e"))
    base = error.filter("idx < 0").select("repeat", F.col("e").alias("base"))
    return error.filter("idx >= 0").join(base, "repeat").groupBy("idx").agg(F.avg(F.col("e") - F.col("base")).alias("importance"))
