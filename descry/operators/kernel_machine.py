"""Support vector machines on a Gaussian kernel's random features, one pass over the rows a step.

Hinge and epsilon-insensitive losses have a dual whose variables lie in a box. A Frank-Wolfe step on it
asks for the corner that the present weights point to: each row's dual is C where its loss is active,
else 0, so only two sums over the rows are needed, sum(dual * target * z) and what the duals are worth.
Their running averages are the weights and the dual value; no row keeps a state, the best step length
has a closed form, and primal minus dual value bounds the distance to the optimum.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from descry.operators.linalg import complete_rows
from descry.operators.metric_index import written
from descry.operators.robust import FourierFeatures

#: Random features, and the share of the primal value at which the gap between primal and dual is closed.
FEATURES, GAP = 256, 0.02


@dataclass
class Machine:
    """One combination: weights (the last for a constant), primal and dual value, passes made."""

    width: float
    c: float
    weights: np.ndarray
    primal: float
    dual: float
    passes: int

    @property
    def gap(self) -> float:
        return (self.primal - self.dual) / max(abs(self.primal), 1e-300)


def lifted(x: np.ndarray, width: float, seed: int) -> np.ndarray:
    """Random features and a constant, which stands for the intercept and is penalised with the rest."""
    return np.hstack([FourierFeatures.lifted(x, FEATURES, seed, width), np.ones((len(x), 1))])


def train(rows: DataFrame, binary: bool, widths: Sequence[float] = (1.0,), cs: Sequence[float] = (1.0,), epsilon: float = 0.1, gap: float = GAP, most: int = 300, seed: int = 42) -> list[Machine]:
    """A machine for each width and C, all of them in the same passes over rows (property, z: array of scaled features).

    C weighs the mean loss of the rows. binary: targets above 0.5 are the one class, the others the
    other; else the loss is what a target is off by beyond epsilon. Passes end when every machine's gap
    is at most `gap` of its primal value, or after `most` of them: the gap says how far a machine came.
    Rows that are not whole, or without a target, are left out; no rows at all are an error.
    """
    own = written(rows.filter("property is not null").select(F.col("property").cast("double").alias("property"), "z"))
    grid = [(w, c) for w in widths for c in cs]
    size = FEATURES + 1
    w = np.zeros((len(grid), size))
    worth = np.zeros(len(grid))
    done: list[Machine | None] = [None] * len(grid)

    def step(now: np.ndarray, open_: list[int]) -> tuple[int, dict[int, np.ndarray]]:
        """Rows, and by machine: sum of losses, worth of the corner's duals, and the corner's weights, for C = 1."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, sums = 0, {g: np.zeros(size + 2) for g in open_}
            for b in batches:
                for at in range(0, b.num_rows, 4096):
                    part = b.slice(at, 4096)
                    kept, x = complete_rows(part.column(1))
                    if not len(kept):
                        continue
                    y = part.column(0).to_numpy()[kept]
                    y = np.where(y > 0.5, 1.0, -1.0) if binary else y
                    n += len(y)
                    for width in dict.fromkeys(grid[g][0] for g in open_):
                        z = lifted(x, width, seed)
                        for g in (g for g in open_ if grid[g][0] == width):
                            out = z @ now[g]
                            if binary:
                                loss, dual = np.maximum(0, 1 - y * out), (y * out < 1) * y
                                gain = np.abs(dual).sum()
                            else:
                                off = y - out
                                loss, dual = np.maximum(0, np.abs(off) - epsilon), np.sign(off) * (np.abs(off) > epsilon)
                                gain = dual @ y - epsilon * np.abs(dual).sum()
                            sums[g] += np.concatenate([[loss.sum(), gain], dual @ z])
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([n] * len(sums), pa.int64()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))], names=["g", "n", "v"])

        parts = own.mapInArrow(run, "g int, n long, v array<double>").select("g", "n", F.posexplode("v").alias("i", "v"))
        got = parts.groupBy("g", "i").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect()
        out, n = {g: np.zeros(size + 2) for g in open_}, 0
        for r in got:
            out[r["g"]][r["i"]], n = r["v"], r["n"]
        return n, out

    for passes in range(1, most + 1):
        open_ = [g for g in range(len(grid)) if done[g] is None]
        if not open_:
            break
        n, sums = step(w, open_)
        if not n:
            raise ValueError("no whole rows with a target")
        for g in open_:
            c = grid[g][1] / n
            loss, gain, corner = c * sums[g][0], c * sums[g][1], c * sums[g][2:]
            half = w[g] @ w[g] / 2
            machine = Machine(*grid[g], w[g].copy(), half + loss, worth[g] - half, passes)
            if machine.gap <= gap or passes == most:
                done[g] = machine
                continue
            turn = corner - w[g]
            length = float(np.clip(((gain - worth[g]) - w[g] @ turn) / max(turn @ turn, 1e-300), 0, 1))
            w[g], worth[g] = w[g] + length * turn, worth[g] + length * (gain - worth[g])
    return [m for m in done if m is not None]


class KernelMachine(Estimator):
    """`train` for one combination as an estimator on scaled vectors z; targets of numbers are centred and scaled."""

    def __init__(self, binary: bool, c: float = 10.0, width: float = 1.0, epsilon: float = 0.1, gap: float = GAP, most: int = 300, seed: int = 42):
        super().__init__()
        self.binary, self.c, self.width, self.epsilon, self.gap, self.most, self.seed = binary, c, width, epsilon, gap, most, seed

    def _fit(self, dataset: DataFrame) -> KernelFit:
        return self.fit_all(dataset, [self.width], [self.c])[self.width, self.c]

    def fit_all(self, dataset: DataFrame, widths: Sequence[float], cs: Sequence[float]) -> dict[tuple[float, float], KernelFit]:
        """A fit for each of the widths with each C, trained in the same passes."""
        rows = dataset.select(F.col("property").cast("double").alias("property"), vector_to_array("z").alias("z"))
        middle, spread = 0.0, 1.0
        if not self.binary:
            r = rows.agg(F.avg("property").alias("m"), F.stddev_pop("property").alias("s")).first()
            middle, spread = r["m"] or 0.0, r["s"] or 1.0
        scaled = rows.withColumn("property", (F.col("property") - middle) / spread)
        found = train(scaled, self.binary, list(dict.fromkeys(widths)), list(dict.fromkeys(cs)), self.epsilon, self.gap, self.most, self.seed)
        return {(m.width, m.c): KernelFit(m, self.binary, middle, spread, self.seed) for m in found}


class KernelFit(Model):
    """Adds `prediction`, and for classes `probability`: a logistic function of twice the margin, which orders rows as the margin does."""

    def __init__(self, machine: Machine, binary: bool, middle: float, spread: float, seed: int):
        super().__init__()
        self.machine, self.binary, self.middle, self.spread, self.seed = machine, binary, middle, spread, seed

    def _transform(self, dataset: DataFrame) -> DataFrame:
        weights, width, seed = self.machine.weights, self.machine.width, self.seed

        @F.pandas_udf("double")
        def margin(z: pd.Series) -> pd.Series:
            return pd.Series(lifted(np.stack(z.to_list()), width, seed) @ weights) if len(z) else pd.Series([], dtype="f8")

        out = dataset.withColumn("prediction", margin(vector_to_array("z")))
        if not self.binary:
            return out.withColumn("prediction", F.col("prediction") * self.spread + self.middle)
        p = 1 / (1 + F.exp(-2 * F.col("prediction")))
        return out.withColumn("probability", array_to_vector(F.array(1 - p, p))).withColumn("prediction", (F.col("prediction") > 0).cast("double"))
