"""Exact nearest neighbours in blocks: products that rule pairs out and exact distances of the others inside tasks, partial top-k, one merge."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from descry.operators import metric_index
from descry.operators.linalg import complete_rows
from descry.operators.metric_index import TIE, Pieces
from descry.operators.order import top_k

#: Bytes of training rows up to which they are sent to every task.
SENT_BYTES = 64 << 20
#: Training rows of a block beyond that.
BLOCK_ROWS = 1 << 16
NEAR = "id long, tag string, neighbour_id long, distance double"

#: A length whose square single precision holds; pairs left for each neighbour wanted, from which on the k-th least score is looked for.
LARGE, MANY = 1e15, 8
#: Query rows that meet a piece of training rows at once, pairs that are bounded at once, and pairs whose distances are taken at once.
ASKING, TILE, PAIRS = 256, 1 << 18, 1 << 15


def _distances(q: np.ndarray, t: np.ndarray, cosine: bool) -> np.ndarray:
    """Of all pairs, plainly."""
    if cosine:
        return 1 - unit(q) @ unit(t).T
    diff = q[:, None, :] - t[None, :, :]
    return np.sqrt(np.einsum("abc,abc->ab", diff, diff))


def unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)


def nearest(q_id: np.ndarray, q: np.ndarray, own: Pieces, k: int, cosine: bool, limit: np.ndarray | None = None, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, training row, distance) of the k nearest, ties by id, a row never its own neighbour; for cosines all rows are unit vectors.

    A product in single precision bounds each distance from below; only pairs whose bound is within the
    k-th distance so far get an exact distance. Distances are compared to nine digits. limit: a
    distance for each row beyond which nothing is asked for. wanted: by row and block, what to meet.
    """
    n = len(q)
    limit = np.full(n, np.inf) if limit is None else np.where(np.isnan(limit), np.inf, limit + TIE)
    best, dist = np.full((n, k), -1, np.int64), np.full((n, k), np.inf)
    rough = (q.shape[1] + 16) * 2.0**-23 if n else 0.0
    length = np.sqrt((q * q).sum(1))
    scores, within = (np.empty(ASKING * max((p[1] - p[0] for p in own.parts), default=0), kind) for kind in ("f4", bool))
    for s, e, block, centre, t, widest in own.parts:
        rows = np.arange(n) if wanted is None else np.flatnonzero(wanted[:, block])
        for a in range(0, len(rows), ASKING):
            at = rows[a : a + ASKING]
            with np.errstate(over="ignore", invalid="ignore"):
                x = q[at] if cosine else q[at] - centre
                size = (x * x).sum(1)
                away = np.sqrt(size)
                spare = rough * (away + widest) ** 2 + 1e-14 * (length[at] + np.sqrt((centre * centre).sum())) * (away + widest)
            if away.max() + widest < LARGE:
                score, low = scores[: len(at) * (e - s)].reshape(len(at), -1), within[: len(at) * (e - s)].reshape(len(at), -1)
                np.matmul(np.hstack([-2 * x, np.ones((len(at), 1))]).astype("f4"), t.T, out=score)
                hit = _within(score, _score(limit[at], size, cosine) + spare, low)
                if len(hit) > MANY * (k + 1) * len(at) and e - s > k:
                    # The k nearest and the row itself are no farther than the k + 1 least scores say.
                    kth = np.partition(score, k, axis=1)[:, k] + spare
                    near = np.minimum(limit[at], TIE + (1 + kth / 2 if cosine else np.sqrt(np.maximum(kth + size, 0))))
                    hit = _within(score, _score(near, size, cosine) + spare, low)
            else:
                # Single precision would not hold the squares.
                hit = np.arange(len(at) * (e - s))
            r, c = np.divmod(hit, e - s)
            r, c = at[r], c + s
            other = q_id[r] != own.ids[c]
            r, c = r[other], c[other]
            if not len(r):
                continue
            d = np.concatenate([_exact(q[r[i : i + PAIRS]], own.x[c[i : i + PAIRS]], cosine) for i in range(0, len(r), PAIRS)])
            ok = np.isfinite(d) & (d <= limit[r])
            r, c, d = r[ok], c[ok], d[ok]
            touched = np.unique(r)
            old_d, old = dist[touched].ravel(), best[touched].ravel()
            known = old >= 0
            r = np.concatenate([np.repeat(touched, k)[known], r])
            c, d = np.concatenate([old[known], c]), np.concatenate([old_d[known], d])
            by = np.lexsort((own.ids[c], np.round(d, 9), r))
            r, c, d = r[by], c[by], d[by]
            rank = np.arange(len(r)) - np.searchsorted(r, r)
            kept = rank < k
            best[r[kept], rank[kept]], dist[r[kept], rank[kept]] = c[kept], d[kept]
            full = touched[best[touched, k - 1] >= 0]
            limit[full] = np.minimum(limit[full], dist[full, k - 1] + TIE)
    r, j = np.nonzero(best >= 0)
    return r, best[r, j], dist[r, j]


def _score(distance: np.ndarray, size: np.ndarray, cosine: bool) -> np.ndarray:
    """A distance as the score that a product gives: without the row's own square, of cosines -2 times them."""
    return 2 * (distance - 1) if cosine else distance * distance - size


def _within(score: np.ndarray, bound: np.ndarray, out: np.ndarray) -> np.ndarray:
    """Where scores are at most their row's bound, which is rounded up."""
    with np.errstate(over="ignore"):
        np.less_equal(score, np.nextafter(bound.astype("f4"), np.float32(np.inf))[:, None], out=out)
    return np.flatnonzero(out)


def _nearest(q_id: np.ndarray, q: np.ndarray, t_id: np.ndarray, t: np.ndarray, k: int, cosine: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """nearest, of rows as they are."""
    return nearest(q_id, unit(q) if cosine else q, Pieces(t_id, unit(t) if cosine else t, centred=not cosine, met=max(1, TILE // ASKING)), k, cosine)


def _exact(q: np.ndarray, t: np.ndarray, cosine: bool) -> np.ndarray:
    if cosine:
        return 1 - np.einsum("ij,ij->i", q, t)
    diff = q - t
    return np.sqrt(np.einsum("ij,ij->i", diff, diff))


def neighbours(train: DataFrame, query: DataFrame, k: int, metric: str = "euclidean", sent_bytes: int = SENT_BYTES, block_rows: int = BLOCK_ROWS, tag: str | None = None) -> DataFrame:
    """(id, neighbour_id, distance, rank) of the k nearest training rows of each query row, itself excluded by id.

    Both need (id long, features array<double>). Rows without features, or with one that is missing
    or not finite, are no neighbours and have none. Training rows up to sent_bytes (measured) go to
    every task; more are met through an index of pivots and rings, which skips the blocks that are
    too far to matter. tag: a string column of the query rows that stands beside id, where several
    rows have one id.
    """
    cosine = metric == "cosine"
    size = train.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.size("features")), F.lit(0)).alias("p")).first()
    rows = query.select("id", (F.col(tag) if tag else F.lit("")).alias("tag"), "features")
    if size["n"] * (size["p"] + 1) * 8 > sent_bytes:
        near = indexed(train, rows, k, cosine, block_rows)
    else:
        all_rows = train.select("id", "features").orderBy("id").toArrow()
        kept, x = complete_rows(all_rows.column("features"))
        sent = train.sparkSession.sparkContext.broadcast((all_rows.column("id").to_numpy()[kept], unit(x) if cosine and len(x) else x))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t_id, t = sent.value
            pieces = None
            for b in batches:
                own, x = complete_rows(b.column(2))
                if len(own) and len(t_id):
                    pieces = pieces or Pieces(t_id, t, centred=not cosine, met=TILE // ASKING)
                    q_id = b.column(0).to_numpy(zero_copy_only=False)[own]
                    yield _found(q_id, b.column(1).take(pa.array(own)), pieces, *nearest(q_id, unit(x) if cosine else x, pieces, k, cosine))

        near = rows.mapInArrow(run, NEAR)
    out = top_k(near, ["id", "tag"], k, F.round("distance", 9), F.col("neighbour_id"))
    return out.withColumnRenamed("tag", tag) if tag else out.drop("tag")


def _found(q_id: np.ndarray, tag: pa.Array, own: Pieces, r: np.ndarray, c: np.ndarray, d: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(q_id[r]), tag.take(pa.array(r)), pa.array(own.ids[c]), pa.array(d)], names=["id", "tag", "neighbour_id", "distance"])


def indexed(train: DataFrame, query: DataFrame, k: int, cosine: bool, block_rows: int) -> DataFrame:
    """(id, tag, neighbour_id, distance) of candidates that hold the k nearest: each query row (id, tag, features) first meets the block it is in, and then those that its k-th distance there does not rule out."""
    index = metric_index.build(train, block_rows, cosine)
    if index is None:
        return query.sparkSession.createDataFrame([], NEAR)

    def ready(ids: np.ndarray, x: np.ndarray, block: np.ndarray) -> Pieces:
        return Pieces(ids, x, block, centred=not cosine, met=TILE // ASKING)

    def work(group: int, own: Pieces, q_id: np.ndarray, tag: pa.Array, q: np.ndarray, limit: np.ndarray, wanted: np.ndarray) -> pa.RecordBatch:
        return _found(q_id, tag, own, *nearest(q_id, q, own, k, cosine, limit, wanted))

    rows = metric_index.points(query, cosine, is_query=True)
    first = metric_index.written(index.meet(rows.withColumn("reach", F.lit(None).cast("double")), index.nearest(k, at_home=True), NEAR, ready, work))
    reached = first.groupBy("id", "tag").agg(F.when(F.count(F.lit(1)) >= k, F.max("distance")).alias("reach"))
    more = index.meet(rows.join(reached, ["id", "tag"], "left").select("id", "tag", "features", "reach"), index.nearest(k, at_home=False), NEAR, ready, work)
    return first.unionByName(more)


def knn_predict(train: DataFrame, query: DataFrame, k: int = 5) -> DataFrame:
    """(id, pred): mean target of the k nearest, weighted by 1/distance; rows at distance 0 take all the weight."""
    near = neighbours(train, query, k).join(train.select(F.col("id").alias("neighbour_id"), "property"), "neighbour_id")
    zero = F.col("distance") == 0
    sums = near.groupBy("id").agg(F.avg(F.when(zero, F.col("property"))).alias("at_zero"), F.sum(F.when(~zero, F.col("property") / F.col("distance"))).alias("s"), F.sum(F.when(~zero, 1 / F.col("distance"))).alias("w"))
    return sums.select("id", F.coalesce("at_zero", F.try_divide("s", "w")).alias("pred"))
