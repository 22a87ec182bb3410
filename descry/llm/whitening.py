"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation of their centred rows.

Each step needs X v and X'u, both made where the rows are: a task multiplies its centred blocks by a
vector of the width, and the product back by the blocks' transpose. A left vector u is as long as the
table and is never kept: it is X y for a vector y of the width that the driver holds, so tasks make it
anew, and the inner products that its reorthogonalisation needs come along in the same pass. The
bidiagonal matrix is as wide as the vectors; its singular values are the deviations.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from descry.llm._shared import written

#: Rows of a block.
BLOCK_ROWS = 4096
#: A direction whose share of the largest is below this is taken for none.
NONE = 1e-12
#: Sums of a few units travel as whole numbers of this negative power of two.
BITS = 100


def usable(vectors: DataFrame, vector_col: str) -> DataFrame:
    """Rows whose vector is there and holds neither nulls nor NaN or infinite entries."""
    off = lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == F.lit(float("inf")))
    return vectors.filter(F.col(vector_col).isNotNull() & ~F.coalesce(F.exists(vector_col, off), F.lit(True)))


def whole(vector: Column, factor: int, width: int) -> Column:
    """floor(factor * c) of each entry as a long, filled up with zeros to the width; an error if one doesn't fit a long."""
    fits = lambda c: F.when(F.abs(c) < 2.0**63, F.floor(c).cast("long")).otherwise(F.raise_error(F.lit("an entry does not fit a long")).cast("long"))
    own = F.transform(vector, lambda c: fits(c.cast("double") * factor))
    return F.concat(own, F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size(vector)))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of equally long lists of longs, without nulls."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


class Rows:
    """The fit list: each distinct row once, in written blocks, with its count, sums and sum of centred squares."""

    def __init__(self, x: DataFrame, width: int):
        """x: (x array<long>) of one width."""
        self.width = width

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, rows = [], 0
            for b in batches:
                held.append(matrix(b.column(0), width))
                rows += b.num_rows
                if rows >= BLOCK_ROWS:
                    yield packed(np.concatenate(held))
                    held, rows = [], 0
            if rows:
                yield packed(np.concatenate(held))

        def packed(rows: np.ndarray) -> pa.RecordBatch:
            own = [rows[i : i + BLOCK_ROWS].astype("<i8").tobytes() for i in range(0, len(rows), BLOCK_ROWS)]
            return pa.RecordBatch.from_arrays([pa.array(own, pa.binary())], names=["rows"])

        def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for raw in b.column(0).to_pylist():
                    x = np.frombuffer(raw, "<i8").reshape(-1, width)
                    n, top = len(x), max(abs(int(x.max())), abs(int(x.min())))
                    x = x if n * top * top < 2**63 else x.astype(object)
                    sums = [map(str, m.sum(0).tolist()) for m in (x, x * x)]
                    yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array([n] * width), *(pa.array(list(v)) for v in sums)], names=["i", "n", "s", "q"])

        self.blocks = written(x.distinct().mapInArrow(pack, "rows binary"), "fit-blocks") if width else None
        self.n, self.sums, squares = 0, [0] * width, [0] * width
        if width:
            whole_sum = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
            for r in self.blocks.mapInArrow(totals, "i int, n long, s string, q string").groupBy("i").agg(F.sum("n").alias("n"), whole_sum("s"), whole_sum("q")).collect():
                self.n, self.sums[r["i"]], squares[r["i"]] = r["n"], int(r["s"]), int(r["q"])
        self.mean = np.array([s / self.n for s in self.sums]) if self.n else np.zeros(width)
        #: Sum of the squares of all centred entries, from exact integers.
        self.total = sum(self.n * q - s * s for q, s in zip(squares, self.sums, strict=True)) / self.n if self.n else 0.0

    def sum(self, of: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
        """The sum over all blocks of of(centred rows), `size` numbers whose sums are a few units at most.

        A task sends one row for each number, a whole number of 2**-BITS, so sums are alike in any order of blocks and tasks.
        """
        width, mean = self.width, self.mean

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = [0] * size
            for b in batches:
                for raw in b.column(0).to_pylist():
                    got = np.asarray(of(np.frombuffer(raw, "<i8").reshape(-1, width) - mean), "f8").ravel()
                    held = [a + int(v) for a, v in zip(held, np.ldexp(got, BITS).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array(map(str, held), pa.string())], names=["i", "v"])

        out = np.zeros(size)
        for r in self.blocks.mapInArrow(run, "i int, v string").groupBy("i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect():
            out[r["i"]] = math.ldexp(int(r["v"]), -BITS)
        return out


@dataclass
class Whitening:
    """components: one a column; values: eigenvalues of the covariance; trace: its trace."""

    components: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float


def orthogonal(v: np.ndarray, to: list[np.ndarray]) -> np.ndarray:
    """v without its parts along the unit vectors `to`, twice, so that rounding leaves none."""
    if to:
        q = np.array(to)
        for _ in range(2):
            v = v - q.T @ (q @ v)
    return v


def bidiagonalise(rows: Rows) -> tuple[np.ndarray, np.ndarray]:
    """(V, B): centred X = U B V' with orthonormal U (never kept) and V.

    As many steps as the rows' width, so no direction is left out, however close or equal some
    deviations are. Where a step ends in nothing, a new direction is taken that is orthogonal to all before.
    """
    size, scale = rows.width, np.sqrt(rows.total)
    rng = np.random.default_rng(0)

    def anew(to: list[np.ndarray]) -> np.ndarray:
        v = orthogonal(rng.standard_normal(size), to)
        return v / np.linalg.norm(v)

    right: list[np.ndarray] = []
    made: list[np.ndarray] = []  # y of each u = X y
    back: list[np.ndarray] = []  # X'u of each u
    b = np.zeros((size, size))
    v, beta = anew([]), 0.0
    for k in range(size):
        right.append(v)
        y = v - beta * made[-1] if beta else v
        length, own = np.linalg.norm(y), np.array(made).T if made else np.zeros((size, 0))

        def products(x: np.ndarray, y: np.ndarray = y / length, own: np.ndarray = own) -> np.ndarray:
            w = x @ y / scale
            return np.concatenate([x.T @ w / scale, [w @ w], (x @ own).T @ w])

        got = rows.sum(products, size + 1 + own.shape[1])
        xw, ww, c = got[:size] * length * rows.total, got[size] * length**2 * rows.total, got[size + 1 :] * length * scale
        alpha = np.sqrt(max(ww - c @ c, 0.0))  # the length of w without its parts along all u so far
        beta = 0.0
        if alpha > NONE * scale:
            b[k, k] = alpha
            if made:
                y, xw = y - own @ c, xw - np.array(back).T @ c
            made.append(y / alpha)
            back.append(xw / alpha)
            rest = orthogonal(back[-1] - alpha * v, right)
            beta = np.linalg.norm(rest)
        if k + 1 == size:
            break
        if beta > NONE * scale:
            b[k, k + 1] = beta
            v = rest / beta
        else:
            v, beta = anew(right), 0.0
    return np.array(right).T, b


def fit(rows: Rows, components: int) -> Whitening:
    """The first components (those without deviation left out) and how far the whitened rows' covariance is from one."""
    if not rows.total:
        return Whitening(np.zeros((rows.width, 0)), np.zeros(0), 0.0, 0.0)
    v, b = bidiagonalise(rows)
    _, sigma, q = np.linalg.svd(b)
    keep, n = min(components, int((sigma > NONE * sigma[0]).sum())), rows.n
    found, values = (v @ q.T)[:, :keep], sigma[:keep] ** 2 / n
    scaled = found / np.sqrt(values)
    got = rows.sum(lambda x: np.concatenate([((w := x @ scaled).T @ w).ravel() / n, w.sum(0) / n]), keep * keep + keep)
    mean = got[keep * keep :]
    off = got[: keep * keep].reshape(keep, keep) - np.outer(mean, mean) - np.eye(keep)
    return Whitening(found, values, rows.total / n, float(np.abs(off).max()))


def whiten(vectors: DataFrame, components: int = 4, factor: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error): each usable row and component.

    Rows whose vector is null or holds a null or a value that isn't finite are dropped; shorter vectors
    are filled up with zeros to the longest, an empty one wholly. Entries are floor(factor * c) as longs.
    The fit takes each distinct vector once, so copies weigh nothing; the result has every row, repeated
    ones too. Components without deviation have no rows (so equal vectors alone give none), as has an
    empty table. deviation is exact; if one doesn't fit a long, that is an error. Null ids stay; extra
    columns are ignored.
    """
    docs = usable(vectors, vector_col)
    width = docs.agg(F.coalesce(F.max(F.size(vector_col)), F.lit(0))).first()[0]
    own = docs.select(F.col(id_col).alias("vec_id"), whole(F.col(vector_col), factor, width).alias("x"))
    rows = Rows(own.select("x"), width)
    got = fit(rows, components)
    n, sums, mean = rows.n, rows.sums, rows.mean
    weights = got.components / np.sqrt(got.values)
    shares = (got.values / got.trace).tolist() if got.trace else []
    error, keep = got.identity_error, len(shares)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = np.array(sums, object)
        for batch in batches:
            if not batch.num_rows or not keep:
                continue
            x = matrix(batch.column(1), width)
            top = (int(max(abs(int(x.max())), abs(int(x.min())))) * n + max(map(abs, sums))) ** 2 * width
            d = n * (x if top < 2**63 else x.astype(object)) - (s.astype(np.int64) if top < 2**63 else s)
            deviation = pa.array([int(v) for v in (d * d).sum(1)], pa.int64())
            w = (x - mean) @ weights
            for k in range(keep):
                m = len(x)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(np.full(m, k + 1, np.int32)), pa.array(np.full(m, n)), deviation, pa.array(w[:, k]), pa.array(np.full(m, shares[k])), pa.array(np.full(m, error))],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    kinds = [("vec_id", own.schema["vec_id"].dataType), ("component", T.IntegerType()), ("n", T.LongType()), ("deviation", T.LongType()), ("whitened", T.DoubleType()), ("explained", T.DoubleType()), ("identity_error", T.DoubleType())]
    return own.mapInArrow(run, T.StructType([T.StructField(a, b) for a, b in kinds]))
