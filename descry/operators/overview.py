"""Overviews of whole sets: a projection of train and test rows, and groups of like rows."""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import BisectingKMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from descry.operators.knn import neighbours
from descry.operators.metric_index import points, written


def _vectors(df: DataFrame) -> DataFrame:
    """(id, v) of the rows with features, none of which is missing."""
    return df.filter("features is not null and not exists(features, x -> x is null)").select("id", array_to_vector("features").alias("v"))


def projection(train: DataFrame, test: DataFrame, k: int = 2) -> DataFrame:
    """(id, is_test, components): rows of both sets on the first k principal components of the training rows, centred on their means.

    A component's sign is that of its largest loading. Rows without features, or with a missing one,
    are left out; repeated rows stay; fewer than two training rows are an error.
    """
    fitted = _vectors(train)
    if fitted.limit(2).count() < 2:
        raise ValueError("a projection needs two training rows with features")
    mean = fitted.agg(Summarizer.mean(F.col("v")).alias("mean")).first()["mean"].toArray()
    model = PCA(k=k, inputCol="v", outputCol="c").fit(fitted)
    loadings = model.pc.toArray()
    signs = np.where(loadings[np.abs(loadings).argmax(0), np.arange(k)] < 0, -1.0, 1.0)
    centre = mean @ loadings
    both = fitted.withColumn("is_test", F.lit(False)).unionByName(_vectors(test).withColumn("is_test", F.lit(True)))
    at = vector_to_array("c")
    parts = [(at[i] - F.lit(float(centre[i]))) * F.lit(float(signs[i])) for i in range(k)]
    return model.transform(both).select("id", "is_test", F.array(*parts).alias("components"))


def row_groups(df: DataFrame, k: int = 8, seed: int = 1) -> DataFrame:
    """(id, cluster): groups of like rows by bisecting k-means, at most k.

    Stands for affinity propagation and agglomerative clustering, which compare all pairs; it is
    another algorithm, so its groups differ from theirs. Rows without features, or with a missing
    one, are left out; equal rows are in one group; an empty table gives no rows.
    """
    rows = _vectors(df)
    if rows.isEmpty():
        return rows.select("id", F.lit(0).alias("cluster"))
    model = BisectingKMeans(k=k, seed=seed, featuresCol="v", predictionCol="cluster").fit(rows)
    return model.transform(rows).select("id", "cluster")


#: Pairs of groups that one task may hold (about 250 bytes each), and pairs of a group from which on they stand in a heap.
IN_TASK, WIDE = 1 << 20, 64
#: Room for rounding in an average.
ROOM = 1e-8


def linked_groups(df: DataFrame, at_most: float, k: int = 10, metric: str = "euclidean", in_task: int = IN_TASK) -> DataFrame:
    """(id, cluster): agglomerative groups by average linkage over each row's k nearest, cluster named by its least id.

    Two groups are as far apart as their known pairs are on average (a pair is known if one row is
    among the other's k nearest; with k of all rows it is plain average linkage). In a round all groups
    that are each other's nearest, at most at_most apart, are joined: no third group is nearer to one of
    them, so the order of such joins doesn't matter and a round makes many. Distances are compared to
    nine digits, ties go to the lesser id. Rounds end when no pair is near enough.

    A group without a pair that is near enough never gets one, as averages of greater distances are
    greater; its pairs are left out. As soon as at most in_task pairs are left, the rest of the rounds
    is one task's, whose rounds cost what they change; more go through joins.

    Rows that are not whole are left out; equal rows are at distance 0; an empty table gives no rows.
    """
    rows = points(df).select("id")
    near = neighbours(df, df, k, metric).select(F.least("id", "neighbour_id").alias("a"), F.greatest("id", "neighbour_id").alias("b"), "distance").distinct()
    edges = written(near.groupBy("a", "b").agg(F.min("distance").alias("total"), F.lit(1).cast("long").alias("n")))
    groups = written(rows.select("id", F.col("id").alias("cluster")))
    moved = lambda d, c, joins: d.join(joins, d[c] == joins["old"], "left").withColumn(c, F.coalesce("new", c)).drop("old", "new")
    apart = F.round(F.col("total") / F.col("n"), 9)
    if edges.count() > in_task:
        close = edges.filter(apart <= at_most + ROOM)
        ends = close.select("a").union(close.select("b")).distinct()
        edges = written(edges.join(ends, "a", "left_semi").join(ends.withColumnRenamed("a", "b"), "b", "left_semi").select("a", "b", "total", "n"))
    while edges.count() > in_task:
        apart_now = edges.select("a", "b", apart.alias("d")).filter(F.col("d") <= at_most)
        both = apart_now.unionByName(apart_now.select(F.col("b").alias("a"), F.col("a").alias("b"), "d"))
        best = both.groupBy("a").agg(F.min(F.struct("d", "b")).alias("m")).select("a", F.col("m.b").alias("b"))
        # A group's nearest one names it in turn; the larger goes into the smaller.
        joins = written(best.join(best.select(F.col("b").alias("a"), F.col("a").alias("b")), ["a", "b"]).filter("a < b").select(F.col("b").alias("old"), F.col("a").alias("new")))
        if joins.isEmpty():
            return groups
        groups = written(moved(groups, "cluster", joins))
        ends = moved(moved(edges, "a", joins), "b", joins).filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "total", "n")
        edges = written(ends.groupBy("a", "b").agg(F.sum("total").alias("total"), F.sum("n").alias("n")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if held := [[c.to_numpy() for c in b.columns] for b in batches if b.num_rows]:
            old, new = _joined(*map(np.concatenate, zip(*held, strict=True)), at_most)
            yield pa.RecordBatch.from_arrays([pa.array(old), pa.array(new)], names=["old", "new"])

    joins = written(edges.select("a", "b", "total", "n").coalesce(1).mapInArrow(run, "old long, new long"))
    return written(moved(groups, "cluster", joins))


def _joined(a: np.ndarray, b: np.ndarray, total: np.ndarray, n: np.ndarray, at_most: float) -> tuple[np.ndarray, np.ndarray]:
    """(old, new): which groups went into which by the rounds of linked_groups, over pairs a < b with their sum of distances and number.

    After a round only the groups beside joined ones look for their nearest anew.
    """
    close = total / n <= at_most + ROOM
    ids = np.unique(np.concatenate([a[close], b[close]]))
    alive = np.isin(a, ids) & np.isin(b, ids)
    near: list[dict[int, tuple[float, int]]] = [{} for _ in ids]
    for u, v, t, c in zip(np.searchsorted(ids, a[alive]).tolist(), np.searchsorted(ids, b[alive]).tolist(), total[alive].tolist(), n[alive].tolist(), strict=True):
        near[u][v] = near[v][u] = (t, c)
    heaps: dict[int, list[tuple[float, int]]] = {}
    distance = lambda w: round(w[0] / w[1], 9)

    def nearest(u: int) -> int:
        """The group nearest to u, -1 if none is near enough."""
        own = near[u]
        if u not in heaps:
            if len(own) <= WIDE:
                d, v = min(((distance(w), v) for v, w in own.items()), default=(np.inf, -1))
                return v if d <= at_most else -1
            heaps[u] = [(distance(w), v) for v, w in own.items()]
            heapify(heaps[u])
        heap = heaps[u]
        # What was joined or is at another distance by now is thrown away when it comes up.
        while heap and (heap[0][1] not in own or distance(own[heap[0][1]]) != heap[0][0]):
            heappop(heap)
        return heap[0][1] if heap and heap[0][0] <= at_most else -1

    best, group, changed = [nearest(u) for u in range(len(ids))], np.arange(len(ids)), set(range(len(ids)))
    while joins := sorted({(min(u, best[u]), max(u, best[u])) for u in changed if best[u] >= 0 and best[best[u]] == u}):
        changed = set()
        for new, old in joins:
            own, gone = near[new], near[old]
            del own[old], gone[new]
            for v, w in gone.items():
                other = near[v]
                del other[old]
                if v in own:
                    w = own[v][0] + w[0], own[v][1] + w[1]
                own[v] = other[new] = w
                for x, y in ((new, v), (v, new)):
                    if x in heaps:
                        heappush(heaps[x], (distance(w), y))
            changed.update(gone, (new,))
            near[old], group[old] = {}, new
            heaps.pop(old, None)
        changed.difference_update(old for _, old in joins)
        for u in changed:
            best[u] = nearest(u)
    # A group goes into a lesser one, so that one's end is known first.
    for u in np.flatnonzero(group != np.arange(len(ids))).tolist():
        group[u] = group[group[u]]
    old = np.flatnonzero(group != np.arange(len(ids)))
    return ids[old], ids[group[old]]
