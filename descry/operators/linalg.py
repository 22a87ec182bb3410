"""Sums of products over partitions; small matrices on the driver (p up to a few thousand)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def complete_rows(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, matrix) of the rows of an Arrow list column that are whole.

    A row that is null, or holds a null, NaN or infinite value, is left out. Whole rows of different
    lengths are an error.
    """
    col = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    there = np.flatnonzero(col.is_valid().to_numpy(zero_copy_only=False))
    if not len(there):
        return there, np.zeros((0, 0))
    own = col if len(there) == len(col) else col.take(pa.array(there))
    size = pc.list_value_length(own).to_numpy(zero_copy_only=False)
    if (size != size[0]).any():
        raise ValueError(f"rows of {size.min()} and of {size.max()} features")
    x = own.flatten().to_numpy(zero_copy_only=False).astype("f8").reshape(len(there), size[0])
    whole = np.isfinite(x).all(1)
    return (there, x) if whole.all() else (there[whole], x[whole])


def _partials(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, list] = {}
    for batch in batches:
        kept, x = complete_rows(batch.column(1))
        keys = batch.column(0).take(pa.array(kept)).to_numpy(zero_copy_only=False) if len(kept) else np.zeros(0)
        for k in np.unique(keys[~np.isnan(keys)]).astype(int).tolist():
            own = x[keys == k]
            n, s, g = held.get(k, (0, 0.0, 0.0))
            held[k] = [n + len(own), s + own.sum(0), g + own.T @ own]
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([v[0] for v in held.values()], pa.int64()), pa.array([v[1].tolist() for v in held.values()]), pa.array([v[2].ravel().tolist() for v in held.values()])], names=["fold", "n", "s", "g"])


def fold_grams(df: DataFrame, fold: str) -> dict[int, tuple[int, np.ndarray, np.ndarray]]:
    """Count, sum and X'X of `features` for each fold in one pass; a partition sends one small row for each fold, summed before the driver.

    Rows that are not whole (a null, NaN or infinite feature, or no features) and rows without a fold are left out.
    """
    parts = df.select(F.col(fold).cast("int").alias("fold"), "features").mapInArrow(_partials, "fold int, n long, s array<double>, g array<double>")
    total = lambda c: F.aggregate(F.collect_list(c), F.array().cast("array<double>"), lambda a, b: F.when(F.size(a) == 0, b).otherwise(F.zip_with(a, b, lambda x, y: x + y)))
    # Two levels, so that no group holds more than the square root of the partitions' rows.
    level = parts.withColumn("r", F.pmod(F.monotonically_increasing_id(), F.lit(64))).groupBy("fold", "r").agg(F.sum("n").alias("n"), total("s").alias("s"), total("g").alias("g"))
    out = level.groupBy("fold").agg(F.sum("n").alias("n"), total("s").alias("s"), total("g").alias("g")).collect()
    return {r["fold"]: (r["n"], np.array(r["s"]), np.array(r["g"]).reshape(len(r["s"]), -1)) for r in out}


def gram(df: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """Count, sum and X'X of `features`."""
    got = fold_grams(df.withColumn("__fold", F.lit(0)), "__fold")
    return got.get(0, (0, np.zeros(0), np.zeros((0, 0))))


def with_target(df: DataFrame, intercept: bool = True) -> DataFrame:
    """Features [1, x, y]: their sums of products hold X'X, X'y and y'y."""
    parts = [F.array(F.lit(1.0)), "features", F.array("property")] if intercept else ["features", F.array("property")]
    return df.withColumn("features", F.concat(*parts))


#: By fold: count, sums and sums of products.
Grams = dict[int, tuple[int, np.ndarray, np.ndarray]]


def grams_of(df: DataFrame) -> Grams:
    """Each fold's sums of products of [1, x, y], from rows (property, features, fold)."""
    return fold_grams(with_target(df.filter("property is not null")), "fold")


def leverages(df: DataFrame, inverse: np.ndarray) -> DataFrame:
    """(id, leverage) with leverage = x' (X'X)^-1 x of each whole row; the small matrix is sent and multiplied in Arrow batches."""
    sent = df.sparkSession.sparkContext.broadcast(inverse)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, x = complete_rows(batch.column(1))
            if len(kept):
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(kept)), pa.array(np.einsum("ij,ij->i", x @ sent.value, x))], names=["id", "leverage"])

    return df.select("id", "features").mapInArrow(run, T.StructType([T.StructField("id", df.schema["id"].dataType), T.StructField("leverage", T.DoubleType())]))
