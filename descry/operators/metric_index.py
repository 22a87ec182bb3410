"""An index of training rows for distances: pivots, and rings of rows around each.

Each row belongs to its nearest pivot, and a pivot's rows are cut into rings by their distance to it.
What a query row can find in a ring is bounded by the triangle inequality, from its own distance to the
pivot and the ring's two radii. A third of all rows at one point are rings of equal radii, none larger
than a block.

Where rows lie so that little is ruled out, a query row needs most blocks; so neighbouring blocks form
groups that a task can hold, and a query row goes to a group once, whatever number of its blocks it
needs. The task bounds them again and meets only those. A group stands several times, each time for a
part of the query rows, so that there are tasks enough.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from descry.operators.linalg import complete_rows
from descry.sources.tables import shared_dir

#: Rows below which a table isn't cut into more blocks, rings for each pivot, and pivots at most.
FEW_ROWS, RINGS, MOST_PIVOTS = 1024, 4, 256
#: Relative room for rounding in distances between rows and pivots.
SLACK = 1e-7
#: Distances are compared to nine digits, so equal ones may differ by this.
TIE = 2e-9
POINT = "id long, features array<double>"
#: Bytes of a group's rows, tasks for each core that its copies make, bytes of rows in a batch, and bounds held at once.
GROUP_BYTES, TASKS_OF_CORE, BATCH_BYTES, BOUNDS = 32 << 20, 8, 4 << 20, 1 << 18
#: Training rows that are met at once.
MET = 1024
SENT = "tile long, asks int, block long, id long, tag string, features array<double>, most double"
SENT_NAMES = ["tile", "asks", "block", "id", "tag", "features", "most"]

#: Of (x, reach): which blocks each row needs, and the limit by which a task finds them again.
Choose = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]
#: Of (least, largest distance, blocks, limit, home): which of these blocks each row needs.
Again = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder, read again: computed once, and its lineage ends there."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def points(df: DataFrame, cosine: bool = False, is_query: bool = False) -> DataFrame:
    """(id, features) of the whole rows, with their tag if they have one; for cosines as unit vectors, whose distances follow them.

    A row of zeros has the cosine distance 1 to all others, so it gets an axis of its own: one for
    training rows, another for query rows.
    """

    more = ["tag"] if "tag" in df.columns else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept, x = complete_rows(b.column(1))
            if len(kept):
                if cosine:
                    length = np.linalg.norm(x, axis=1, keepdims=True)
                    zero = length[:, 0] == 0
                    x = np.hstack([x / np.where(length == 0, 1.0, length), np.zeros((len(x), 2))])
                    x[zero, -1 if is_query else -2] = 1.0
                at = pa.array(kept)
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), _lists(x), *[b.column(2).take(at) for _ in more]], names=["id", "features", *more])

    return df.select(F.col("id").cast("long").alias("id"), "features", *more).mapInArrow(run, POINT + ", tag string" * len(more))


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))


def _away(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (pivots * pivots).sum(1) - 2 * x @ pivots.T, 0))


class Pieces:
    """Rows in pieces of `met` at most, each around its own mean (or around zero), for products with query rows.

    block: of each row the place of its block among those of a group, ascending; none: all are of one block.
    After its last feature stands a row's square, or zero around zero; in double precision a one before it.
    """

    def __init__(self, ids: np.ndarray, x: np.ndarray, block: np.ndarray | None = None, centred: bool = True, kind: str = "f4", met: int = MET) -> None:
        self.ids, self.x, self.parts = ids, x, []
        edges = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(x)] if block is not None and len(x) else [0, len(x)]
        for s, e in zip(edges, edges[1:], strict=False):
            for a in range(s, e, met):
                b = min(a + met, e)
                centre = x[a:b].mean(0) if centred else np.zeros(x.shape[1])
                own = x[a:b] - centre
                with np.errstate(over="ignore", invalid="ignore"):
                    square = (own * own).sum(1)
                    held = np.hstack([own, *([] if kind == "f4" else [np.ones((b - a, 1))]), square[:, None] * centred]).astype(kind)
                    self.parts.append((a, b, 0 if block is None else int(block[a]), centre, held, float(np.sqrt(square.max()))))


@dataclass
class Index:
    """rows: (block, id, features), written; of each block its number, pivot, radii, count and group. Each group stands `splits` times."""

    rows: DataFrame | None
    pivots: np.ndarray
    block: np.ndarray
    pivot: np.ndarray
    near: np.ndarray
    far: np.ndarray
    count: np.ndarray
    cosine: bool
    group: np.ndarray
    splits: int

    def bounds(self, x: np.ndarray, own: slice | np.ndarray = slice(None)) -> tuple[np.ndarray, np.ndarray]:
        """The least and the largest distance that rows x can have to a row of each block, or of those given."""
        d = _away(x, self.pivots)
        # Squares near each other lose digits, so the room is that of the square root of rounding.
        room = SLACK * (1 + np.sqrt((x * x).sum(1))[:, None] + np.sqrt((self.pivots * self.pivots).sum(1)).max())
        d = d[:, self.pivot[own]]
        return np.maximum(np.maximum(d - self.far[own], self.near[own] - d) - room, 0), d + self.far[own] + room

    def compared(self, distance: np.ndarray) -> np.ndarray:
        """Distances between unit vectors as cosine distances, if those are compared."""
        return distance**2 / 2 if self.cosine else distance

    def nearest(self, k: int, at_home: bool) -> tuple[Choose, Again]:
        """The blocks that rows have to meet for their k nearest.

        at_home: the block a row is in, or nearest to. Otherwise the others that hold a row within
        reach (the k-th distance so far, NaN if there are fewer), and within the distance that k
        rows and the row itself have for certain by the blocks' counts.
        """
        plain = replace(self, rows=None)  # a DataFrame can't go to the tasks

        def choose(x: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            low, high = plain.bounds(x)
            home = np.lexsort((high, low), axis=1)[:, 0]
            by = np.argsort(high, axis=1)
            enough = np.cumsum(plain.count[by], axis=1) > k
            at = np.where(enough.any(1), enough.argmax(1), -1)
            certain = np.where(at < 0, np.inf, plain.compared(np.take_along_axis(high, np.take_along_axis(by, at[:, None], 1), 1)[:, 0]))
            limit = np.fmin(certain, reach)
            return again(low, high, np.arange(len(plain.block)), limit, home), limit, home

        def again(low: np.ndarray, high: np.ndarray, own: np.ndarray, limit: np.ndarray, home: np.ndarray) -> np.ndarray:
            at = own == home[:, None]
            return at if at_home else ~at & (plain.compared(low) <= (limit + TIE)[:, None])

        return choose, again

    def asked(self, rows: DataFrame, k: int, at_home: bool) -> DataFrame:
        """(tile, id, tag, features, most): the groups that rows (id, features, reach) go to for their k nearest."""
        return self.sent(rows.select("id", F.lit("").alias("tag"), "features", "reach"), self.nearest(k, at_home)[0]).select("tile", "id", "tag", "features", "most")

    def sent(self, rows: DataFrame, choose: Choose) -> DataFrame:
        """SENT for rows (id, tag, features, reach) and the groups that hold blocks chosen for each; block: the row's home."""
        step = max(1, BOUNDS // len(self.block))
        starts, splits = np.flatnonzero(np.diff(self.group, prepend=-1)), self.splits

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for a in range(0, b.num_rows, step):
                    part = b.slice(a, step)
                    kept, x = complete_rows(part.column(2))
                    if not len(kept):
                        continue
                    own = part.take(pa.array(kept))
                    wanted, limit, home = choose(x, own.column(3).to_numpy(zero_copy_only=False).astype("f8"))
                    r, c = np.nonzero(np.logical_or.reduceat(wanted, starts, axis=1))
                    tile = c * splits + own.column(4).to_numpy()[r]
                    # A row's copies may be many, so their batches are cut by their bytes.
                    most = max(1, BATCH_BYTES // (8 * (x.shape[1] + 8)))
                    for s in range(0, len(r), most):
                        i = r[s : s + most]
                        at = pa.array(i)
                        yield pa.RecordBatch.from_arrays([pa.array(tile[s : s + most]), pa.array(np.ones(len(i), np.int32)), pa.array(home[i].astype(np.int64)), own.column(0).take(at), own.column(1).take(at), own.column(2).take(at), pa.array(limit[i])], names=SENT_NAMES)

        return rows.select("id", "tag", "features", "reach", F.pmod(F.xxhash64("id"), F.lit(splits)).alias("split")).mapInArrow(run, SENT)

    def copies(self) -> DataFrame:
        """SENT for the training rows, each group as often as it stands; block: its place among all blocks."""
        number, group, splits = self.block, self.group, self.splits

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                at = np.searchsorted(number, b.column(0).to_numpy())
                for s in range(splits):
                    yield pa.RecordBatch.from_arrays([pa.array(group[at] * splits + s), pa.array(np.zeros(len(at), np.int32)), pa.array(at), b.column(1), pa.array([""] * len(at)), b.column(2), pa.array(np.zeros(len(at)))], names=SENT_NAMES)

        return self.rows.mapInArrow(run, SENT)

    def meet(self, rows: DataFrame, chosen: tuple[Choose, Again], schema: str, ready: Callable[[np.ndarray, np.ndarray, np.ndarray], Pieces], work: Callable[..., pa.RecordBatch]) -> DataFrame:
        """work(group, ready(its ids, its rows, their blocks' places), the ids, tags and rows that ask, their limits, which blocks each needs).

        A group's rows come first, by block and id, and those that ask stream by.
        """
        choose, again = chosen
        plain = replace(self, rows=None)
        both = self.copies().unionByName(self.sent(rows, choose))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, held, own, blocks = None, [], None, None
            for b in batches:
                if not b.num_rows:
                    continue
                tile, asks, block, ids = (b.column(i).to_numpy() for i in range(4))
                _, x = complete_rows(b.column(5))
                cuts = np.flatnonzero(np.diff(tile, prepend=tile[0] - 1) | np.diff(asks, prepend=asks[0]))
                for s, e in zip(cuts.tolist(), [*cuts[1:].tolist(), len(tile)], strict=True):
                    if tile[s] != now:
                        now, held, own = tile[s], [], None
                    if not asks[s]:
                        held.append((block[s:e].copy(), ids[s:e].copy(), x[s:e].copy()))
                        continue
                    if own is None:
                        t_block, t_id, t = (np.concatenate(h) for h in zip(*held, strict=True))
                        held, by = [], np.lexsort((t_id, t_block))
                        blocks = np.flatnonzero(plain.group == now // plain.splits)
                        own = ready(t_id[by], t[by], np.searchsorted(blocks, t_block[by]))
                        del t_block, t_id, t
                    limit, q = b.column(6).to_numpy()[s:e], x[s:e]
                    wanted = np.zeros((e - s, len(blocks)), bool)
                    step = max(1, BOUNDS // len(blocks))
                    for a in range(0, e - s, step):
                        part = slice(a, a + step)
                        wanted[part] = again(*plain.bounds(q[part], blocks), blocks, limit[part], block[s:e][part])
                    yield work(int(now // plain.splits), own, ids[s:e], b.column(4).slice(s, e - s), q, limit, wanted)

        # Tiles dealt to more partitions than there are tiles seldom meet in one.
        tasks = max(2 * (int(self.group[-1]) + 1) * self.splits, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        return both.repartition(tasks, "tile").sortWithinPartitions("tile", "asks").mapInArrow(run, schema)


def build(train: DataFrame, block_rows: int, cosine: bool = False) -> Index | None:
    """The index of train (id, features); None if it has no whole row.

    Pivots are the rows of least hash, a number that follows the number of blocks, MOST_PIVOTS at
    most; the blocks' radii are on the driver, one line for each block_rows rows and pivot.
    """
    rows = points(train, cosine)
    n = rows.count()
    if not n:
        return None
    blocks = max(-(-n // block_rows), min(2 * int(train.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // FEW_ROWS)))
    first = rows.orderBy(F.xxhash64("id"), "id").limit(max(1, min(MOST_PIVOTS, blocks // RINGS))).toArrow()
    pivots = complete_rows(first.column("features"))[1]

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                d = _away(complete_rows(b.column(1))[1], pivots)
                at = d.argmin(1)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(at.astype(np.int32)), pa.array(d[np.arange(len(d)), at])], names=["id", "features", "pivot", "away"])

    located = rows.mapInArrow(locate, POINT + ", pivot int, away double")
    number = F.spark_partition_id().cast("long") * len(pivots) + F.col("pivot")
    dealt = written(located.repartitionByRange(blocks, "pivot", "away", "id").withColumn("block", number))
    lines = dealt.groupBy("block", "pivot").agg(F.min("away").alias("near"), F.max("away").alias("far"), F.count(F.lit(1)).alias("n")).orderBy("block").collect()
    column = lambda name, kind: np.array([r[name] for r in lines], kind)
    count, tasks = column("n", np.int64), TASKS_OF_CORE * train.sparkSession.sparkContext.defaultParallelism
    # Groups as large as a task can hold, or fewer rows where those would make fewer groups than copies.
    wide = min(GROUP_BYTES // (8 * (pivots.shape[1] + 1)), -(-n // math.ceil(math.sqrt(tasks))))
    group, held = np.zeros(len(lines), np.int64), 0
    for i, c in enumerate(count.tolist()):
        group[i] = group[i - 1] + (held + c > wide) if i else 0
        held = c if i and group[i] > group[i - 1] else held + c
    splits = max(1, min(-(-tasks // (int(group[-1]) + 1)), -(-n // FEW_ROWS)))
    return Index(dealt.select("block", "id", "features"), pivots, column("block", np.int64), column("pivot", np.int64), column("near", "f8"), column("far", "f8"), count, cosine, group, splits)
