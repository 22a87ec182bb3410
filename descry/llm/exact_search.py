"""Exact top-k inner products in buckets of vectors of like length.

Vectors are dealt by range of their length. A query q with a k-th best product t so far needs only
vectors of length t / |q| or more, so it goes to a beginning of the buckets in falling order of length.
Inside, a bucket is met in tiles that are sorted by length: t / (|q| * longest) is the tile's local
cosine threshold. Where it is high, only vectors whose share of the query's leading coordinates can
reach that cosine are candidates (coordinate pruning); else those that are long enough (length
pruning). Candidates are verified by their exact integer product.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from descry.llm._shared import shuffle_partitions, written
from descry.llm.whitening import matrix, usable, whole

#: Bytes of vectors in a bucket, as they are held in a task.
BUCKET_BYTES = 64 << 20
#: Rows below which a table is not cut into more buckets.
FEW_ROWS = 1024
#: Bytes of the longest vectors, which give each query its first threshold.
SEED_BYTES = 1 << 20
#: Rows of a tile, and queries met with it at once.
TILE, QUERIES = 2048, 256
#: Local cosine threshold from which coordinates are tried, how many of them, and the share of a tile that they must leave at most.
COSINE, FOCUS, SHARE = 0.6, 4, 0.125
#: Room for rounding in cosines and lengths, which only choose candidates.
SLACK = 1e-9


def product_type(largest_square: int) -> np.dtype:
    """The fastest type in which products of vectors of such squared lengths are exact: all partial sums are below it."""
    return np.dtype("f4") if largest_square < 2**24 else np.dtype("f8") if largest_square < 2**53 else np.dtype("i8")


class Tile:
    """Vectors of one tile in falling order of length, and their cosines with each axis, sorted on demand."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, length: np.ndarray):
        self.x, self.ids, self.length = x, ids, length
        self._axes: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self._unit: np.ndarray | None = None

    def unit(self) -> np.ndarray:
        if self._unit is None:
            self._unit = self.x / np.maximum(self.length, 1e-300)[:, None]
        return self._unit

    def axis(self, f: int) -> tuple[np.ndarray, np.ndarray]:
        if f not in self._axes:
            own = self.unit()[:, f]
            by = np.argsort(own)
            self._axes[f] = by, own[by]
        return self._axes[f]

    def by_coordinates(self, q: np.ndarray, cosine: float) -> np.ndarray | None:
        """Rows whose angles with the query's leading axes allow the cosine; None if too many are left.

        A vector within the angle a of q is within a of q's own angle with each axis.
        """
        angle = np.arccos(min(1.0, cosine - SLACK))
        best: np.ndarray | None = None
        for f in np.argsort(-np.abs(q))[:FOCUS].tolist():
            own = np.arccos(np.clip(q[f], -1.0, 1.0))
            low, high = np.cos(min(np.pi, own + angle)) - SLACK, np.cos(max(0.0, own - angle)) + SLACK
            by, value = self.axis(f)
            a, b = np.searchsorted(value, low, "left"), np.searchsorted(value, high, "right")
            if best is None or b - a < len(best):
                best = by[a:b]
        if best is None or len(best) > SHARE * len(self.x):
            return None
        return best[self.unit()[best] @ q >= cosine - 2 * SLACK]


class Best:
    """The k best (product, id) of each query, ties to smaller ids and null ids (held as the largest) last."""

    def __init__(self, n: int, k: int, threshold: np.ndarray):
        self.k, self.threshold = k, threshold
        self.q, self.s, self.i = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.n = n

    def add(self, q: np.ndarray, s: np.ndarray, i: np.ndarray) -> None:
        if not len(q):
            return
        q, s, i = np.concatenate([self.q, q]), np.concatenate([self.s, s]), np.concatenate([self.i, i])
        by = np.lexsort((i, -s, q))
        q, s, i = q[by], s[by], i[by]
        first = np.searchsorted(q, q)
        keep = np.arange(len(q)) - first < self.k
        self.q, self.s, self.i = q[keep], s[keep], i[keep]
        full = np.flatnonzero(np.bincount(self.q, minlength=self.n) == self.k)
        last = np.searchsorted(self.q, full, "right") - 1
        s = self.s[last]
        # As a float it must not be more than the product itself.
        self.threshold[full] = np.maximum(self.threshold[full], np.where(np.abs(s) < 2**53, s, np.nextafter(s.astype("f8"), -np.inf)))


def meet(tiles: list[Tile], queries: np.ndarray, threshold: np.ndarray, k: int, kind: np.dtype) -> Best:
    """The k best rows of the tiles (falling lengths) for each query; threshold: what its k-th best reaches for certain."""
    best = Best(len(queries), k, threshold.astype("f8").copy())
    length = np.sqrt((queries.astype("f8") ** 2).sum(1))
    unit = queries / np.maximum(length, 1e-300)[:, None]
    own = queries.astype(kind)
    for tile in tiles:
        longest = float(tile.length[0]) if len(tile.length) else 0.0
        reach = length * longest
        open_ = np.flatnonzero(reach * (1 + SLACK) + SLACK >= best.threshold)
        cosine = best.threshold[open_] / np.maximum(reach[open_], 1e-300)
        rest, hits = [], []
        for q, c in zip(open_.tolist(), cosine.tolist(), strict=True):
            at = tile.by_coordinates(unit[q], c) if c >= COSINE else None
            if at is None:
                rest.append(q)
            elif len(at):
                s = (tile.x[at].astype(kind) @ own[q]).astype(np.int64)
                ok = s >= best.threshold[q]
                hits.append((np.full(int(ok.sum()), q), s[ok], tile.ids[at][ok]))
        if rest:
            r = np.array(rest)
            # The shortest vector that any of these queries can use ends the part of the tile that is multiplied.
            least = np.min(best.threshold[r] / np.maximum(length[r], 1e-300)) * (1 - SLACK) - SLACK
            n = int(np.searchsorted(-tile.length, -least, "right"))
            s = own[r] @ tile.x[:n].astype(kind, copy=False).T
            a, b = np.nonzero(s >= best.threshold[r][:, None])
            hits.append((r[a], s[a, b].astype(np.int64), tile.ids[b]))
        if hits:
            best.add(*(np.concatenate(h) for h in zip(*hits, strict=True)))
    return best


def tiles_of(x: np.ndarray, ids: np.ndarray, kind: np.dtype) -> list[Tile]:
    length = np.sqrt((x.astype("f8") ** 2).sum(1))
    by = np.argsort(-length, kind="stable")
    x, ids, length = x[by].astype(kind), ids[by], length[by]
    return [Tile(x[a : a + TILE], ids[a : a + TILE], length[a : a + TILE]) for a in range(0, len(x), TILE)]


def search(vectors: DataFrame, k: int = 20, every: int = 20, factor: int = 64, id_col: str = "vec_id", vector_col: str = "embedding", bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by `every`, the k other rows of largest inner product.

    Entries are floor(factor * c) as longs; rows whose vector is null or holds a null or a value that
    isn't finite take no part, and shorter vectors are filled up with zeros to the longest. Ties go to the
    smaller id, null ids come last and ask nothing. A row is not its own hit, but other rows of its id
    are. Equal vectors have equal products, so of each vector the k + 1 rows of smallest id are enough,
    and equal queries are met once. Fewer than k other rows give that many hits; an empty table none.
    An entry or product that doesn't fit a long is an error. Extra columns are ignored.
    """
    spark = vectors.sparkSession
    docs = usable(vectors, vector_col)
    width = docs.agg(F.coalesce(F.max(F.size(vector_col)), F.lit(0))).first()[0]
    rows = docs.select(F.col(id_col).cast("long").alias("id"), whole(F.col(vector_col), factor, width).alias("x"))
    # Tasks keep k + 1 rows of a vector before they are shuffled, so one that fills a third of the table is no hot key.
    place = F.row_number().over(W.partitionBy("x").orderBy(F.col("id").asc_nulls_last()))
    square = F.aggregate("x", F.lit(0).cast("decimal(38,0)"), lambda a, c: (a + c.cast("decimal(19,0)") * c.cast("decimal(19,0)")).cast("decimal(38,0)"))
    kept = written(rows.withColumn("place", place).filter(F.col("place") <= k + 1).select("id", "x", square.alias("square")), "vectors")
    asked = rows.filter(F.col("id") % every == 0)
    queries = written(asked.select("x").distinct().select("x", F.monotonically_increasing_id().alias("q")), "queries")
    seen = kept.agg(F.count(F.lit(1)).alias("n"), F.max("square").alias("largest")).first()
    n, largest = seen["n"], int(seen["largest"] or 0)
    if largest >= 2**63:
        raise ValueError("products of these vectors do not fit a long")
    kind = product_type(largest)
    most = shuffle_partitions(spark)
    buckets = max(1, min(most, -(-n // FEW_ROWS)), -(-n * (width + 2) * 8 // bucket_bytes))

    dealt = kept.select("id", "x", F.sqrt(F.col("square").cast("double")).alias("length"))
    dealt = written(dealt.repartitionByRange(buckets, F.desc("length"), F.xxhash64("x"), F.col("id")).withColumn("bucket", F.spark_partition_id()), "buckets")
    #: One number for each bucket_bytes of vectors.
    reach = sorted(((r["bucket"], r["longest"]) for r in dealt.groupBy("bucket").agg(F.max("length").alias("longest")).collect()), key=lambda r: -r[1])
    longest, number = np.array([r[1] for r in reach]), np.array([r[0] for r in reach], np.int32)
    seeds = dealt.orderBy(F.desc("length"), "id").limit(max(k + 1, SEED_BYTES // (8 * max(1, width)))).select("x").collect()
    seed = tiles_of(np.array([r["x"] for r in seeds], np.int64).reshape(len(seeds), width), np.zeros(len(seeds), np.int64), kind)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each query's first threshold, and a row for each bucket that can reach it."""
        for batch in batches:
            for a in range(0, batch.num_rows, QUERIES):
                part = batch.slice(a, QUERIES)
                x = matrix(part.column(0), width)
                least = meet(seed, x, np.full(len(x), -np.inf), k + 1, kind).threshold
                length = np.sqrt((x.astype("f8") ** 2).sum(1))
                i, to = np.nonzero((length * (1 + SLACK))[:, None] * longest + SLACK >= least[:, None])
                taken = pa.array(i)
                yield pa.RecordBatch.from_arrays([pa.array(number[to]), pa.array(np.ones(len(i), np.int32)), part.column(1).take(taken), part.column(0).take(taken), pa.array(least[i])], names=["bucket", "asks", "id", "x", "least"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A bucket's vectors come first, then its queries, a part of them at a time."""
        now, held, tiles = None, [], None
        waiting: list[tuple[int, np.ndarray, float]] = []

        def ready() -> Iterator[pa.RecordBatch]:
            if waiting:
                q = np.array([w[0] for w in waiting])
                best = meet(tiles or [], np.array([w[1] for w in waiting]), np.array([w[2] for w in waiting]), k + 1, kind)
                waiting.clear()
                ids = pa.array(best.i, mask=best.i == np.iinfo(np.int64).max)
                yield pa.RecordBatch.from_arrays([pa.array(q[best.q]), pa.array(best.s), ids], names=["q", "score", "id"])

        for batch in batches:
            bucket = batch.column(0).to_numpy()
            asks = batch.column(1).to_numpy()
            x = matrix(batch.column(3), width)
            ids = batch.column(2).fill_null(np.iinfo(np.int64).max).to_numpy()
            least = batch.column(4).to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.diff(bucket, prepend=bucket[:1] - 1) | np.diff(asks, prepend=asks[:1]))
            for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(bucket)], strict=True):
                if bucket[a] != now:
                    yield from ready()
                    now, held, tiles = bucket[a], [], None
                if not asks[a]:
                    held.append((x[a:b].copy(), ids[a:b].copy()))
                    continue
                if tiles is None:
                    tiles = tiles_of(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), kind) if held else []
                    held = []
                for i in range(a, b):
                    waiting.append((int(ids[i]), x[i].copy(), float(least[i])))
                    if len(waiting) == QUERIES:
                        yield from ready()
        yield from ready()

    out = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("asks", T.IntegerType()), T.StructField("id", T.LongType()), T.StructField("x", T.ArrayType(T.LongType())), T.StructField("least", T.DoubleType())])
    sent = queries.select("x", "q").mapInArrow(ask, out)
    both = dealt.select("bucket", F.lit(0).alias("asks"), "id", "x", F.lit(0.0).alias("least")).unionByName(sent)
    found = both.repartition("bucket").sortWithinPartitions("bucket", "asks").mapInArrow(answer, "q long, score long, id long")
    order = W.partitionBy("q").orderBy(F.desc("score"), F.col("id").asc_nulls_last())
    ranked = found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k + 1)
    lists = written(ranked.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("place", "id", "score"))).alias("hits")).join(queries, "q").select("x", "hits"), "hits")

    # The row itself is one of its vector's rows: of its id, with its own square as product.
    own = F.aggregate("x", F.lit(0).cast("long"), lambda a, c: a + c * c)
    itself = F.coalesce(F.array_min(F.transform(F.filter("hits", lambda h: (h["id"] == F.col("query_id")) & (h["score"] == own)), lambda h: h["place"])), F.lit(k + 1))
    others = F.slice(F.filter("hits", lambda h: h["place"] != itself), 1, k)
    joined = asked.select(F.col("id").alias("query_id"), "x").join(lists, "x").select("query_id", F.posexplode(others).alias("at", "hit"))
    return joined.select("query_id", (F.col("at") + 1).alias("rank"), F.col("hit.id").alias("vec_id"), F.col("hit.score").alias("score"))
