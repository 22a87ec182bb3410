"""Upserts and deletes in a partitioned table, which rewrite only the partitions that they touch."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from descry.sources.tables import shared_dir


def _same(a: DataFrame, b: DataFrame, names: Sequence[str]) -> Column:
    """Equal partition values, a missing one equal to a missing one."""
    return reduce(lambda x, y: x & y, (a[n].eqNullSafe(b[n]) for n in names))


def _checked(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    if not rows.filter(reduce(lambda a, b: a | b, (F.col(k).isNull() for k in keys))).isEmpty():
        raise ValueError(f"a row without {' or '.join(keys)}")
    return rows


def _staged(df: DataFrame) -> DataFrame:
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _folders(existing: DataFrame, touched: DataFrame, partition: Sequence[str]) -> DataFrame:
    """The partitions among `touched` that the table has, each with its folder."""
    files = existing.select(*partition, F.regexp_replace(F.col("_metadata.file_path"), "/[^/]*$", "").alias("folder")).distinct()
    return files.join(touched, _same(files, touched, partition), "left_semi")


def _replace(spark: SparkSession, path: str, content: DataFrame, folders: DataFrame, partition: Sequence[str]) -> int:
    """Puts content, which is staged, in place of the partitions it has, and removes the folders of those that it left empty; how many of both."""
    content.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition).parquet(path)
    now = content.select(*partition).distinct()
    n = now.count()
    for r in folders.join(now, _same(folders, now, partition), "left_anti").toLocalIterator():
        gone = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(r["folder"]))  # file paths come escaped
        if not gone.getFileSystem(spark._jsc.hadoopConfiguration()).delete(gone, True):
            raise OSError(f"could not remove {r['folder']}")
        n += 1
    return n


def insert(spark: SparkSession, path: str, rows: DataFrame, keys: Sequence[str], partition: Sequence[str]) -> int:
    """Appends the rows whose key the table lacks, one each; how many. Nothing is rewritten, and a second run appends nothing."""
    existing = spark.read.parquet(path)
    fresh = _staged(_checked(rows, keys).dropDuplicates(list(keys)).join(existing.select(*keys), list(keys), "left_anti").select(*existing.columns))
    fresh.write.mode("append").partitionBy(*partition).parquet(path)
    return fresh.count()


def upsert(spark: SparkSession, path: str, rows: DataFrame, keys: Sequence[str], partition: Sequence[str], order: str) -> int:
    """Takes the new row for a key that the table has and adds the others, of several with one key that of the greatest `order`; how many partitions were rewritten.

    Touched are the partitions where a key was and where its row goes, so a row may change its
    partition. Their new content is written to the shared folder first: what is read isn't what is
    overwritten, and a run that is broken off can be run again and ends the same. Partitions are
    exchanged one by one, so a reader may meet some before and some after. The columns of rows are
    those of the table and `order`, which may be one of them; a row without a key is an error. The
    table must exist and may not be empty.
    """
    existing = spark.read.parquet(path)
    latest = _staged(_checked(rows, keys).groupBy(*keys).agg(F.max_by(F.struct(*existing.columns), order).alias("r")).select("r.*"))
    held = existing.join(latest.select(*keys), list(keys), "left_semi").select(*partition)
    touched = _staged(held.unionByName(latest.select(*partition)).distinct())
    folders = _staged(_folders(existing, touched, partition))
    stays = existing.join(touched, _same(existing, touched, partition), "left_semi").join(latest.select(*keys), list(keys), "left_anti")
    return _replace(spark, path, _staged(stays.select(*existing.columns).unionByName(latest)), folders, partition)


def delete(spark: SparkSession, path: str, doomed: DataFrame, keys: Sequence[str], partition: Sequence[str]) -> int:
    """Removes the rows whose key is in doomed; how many partitions were rewritten or removed. A key that the table lacks, or a missing one, removes nothing."""
    existing = spark.read.parquet(path)
    gone = doomed.select(*keys).distinct()
    touched = _staged(existing.join(gone, list(keys), "left_semi").select(*partition).distinct())
    folders = _staged(_folders(existing, touched, partition))
    stays = existing.join(touched, _same(existing, touched, partition), "left_semi").join(gone, list(keys), "left_anti")
    return _replace(spark, path, _staged(stays.select(*existing.columns)), folders, partition)
