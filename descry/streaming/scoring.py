"""Scoring as rows arrive: each key once, with stored answers for what was asked before.

Both jobs write Parquet tables and keep their place in a checkpoint, so a run that was cut off
goes on where it stopped. A batch that is run again finds its own rows stored and adds nothing.
Table, answers and checkpoint belong in folders that driver and executors share.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

Work = Callable[[DataFrame], DataFrame]


def stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table at path, empty while nothing was written."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def score_new(stream: DataFrame, work: Work, key: str, sink: str, sink_schema: str, checkpoint: str) -> StreamingQuery:
    """Scores rows whose key the sink has not yet, each key once, and appends them.

    work: rows to scored rows, with the key among its columns. Of the sink only the key is read.
    A null key is scored whenever it comes: it names no row.
    """

    def batch(rows: DataFrame, batch_id: int) -> None:
        done = stored(rows.sparkSession, sink, sink_schema).select(key)
        named = rows.filter(F.col(key).isNotNull()).dropDuplicates([key])
        fresh = named.unionByName(rows.filter(F.col(key).isNull())).join(done, key, "left_anti")
        work(fresh).write.mode("append").parquet(sink)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def answer_requests(stream: DataFrame, work: Work, keys: Sequence[str], cache: str, cache_schema: str, answers: str, checkpoint: str) -> StreamingQuery:
    """Answers requests from a cache of results by `keys` (id and model, say) and scores only what it lacks.

    The misses of a batch are scored once and stored before the batch is answered from the cache,
    each request with `hit`: whether its result was stored before this batch. A batch's answers
    are one folder, written anew if the batch runs again. A request with a null key has no result.
    """
    keys = list(keys)

    def batch(rows: DataFrame, batch_id: int) -> None:
        spark = rows.sparkSession
        wanted = rows.select(*keys).dropna().distinct()
        missing = wanted.join(stored(spark, cache, cache_schema).select(*keys), keys, "left_anti")
        work(rows.join(missing, keys, "left_semi").dropDuplicates(keys)).withColumn("batch", F.lit(batch_id)).write.mode("append").parquet(cache)
        known = latest(stored(spark, cache, cache_schema + ", batch long"), keys)
        out = rows.select(*keys).join(known, keys, "left").withColumn("hit", F.col("batch") < batch_id).drop("batch")
        out.write.mode("overwrite").parquet(f"{answers}/batch={batch_id}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(cache: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The last stored result of each key."""
    rest = [c for c in cache.columns if c not in keys]
    best = cache.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("__r"))
    return best.select(*keys, "__r.*")
