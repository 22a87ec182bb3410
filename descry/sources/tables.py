"""Readers and writers. Text is read as strings and cleaned once: NaN and infinities become null."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from descry.functions.scalars import clean_double


def read_delimited(spark: SparkSession, path: str, sep: str | None = None) -> DataFrame:
    """Delimited text (plain or gzip) with a header, all columns strings, `null` as null.

    The separator is a tab for .tsv and .txt and a comma for .csv unless given.
    """
    if sep is None:
        sep = "," if path.removesuffix(".gz").endswith(".csv") else "\t"
    return spark.read.option("sep", sep).option("header", True).option("nullValue", "null").option("inferSchema", False).csv(path)


def sniff_separator(spark: SparkSession, path: str) -> str:
    """A tab if the header has one, else a comma; reads one line."""
    first = spark.read.text(path).first()
    return "\t" if first and "\t" in first[0] else ","


def instances(df: DataFrame, id_col: str, target: str | None, features: Sequence[str]) -> DataFrame:
    """(id, property, features): typed once, non-numbers and sentinels such as {} null; rows whose value is Error are dropped."""
    rows = df.filter(F.coalesce(F.col(features[0]).cast("string") != "Error", F.lit(True))) if features else df
    prop = clean_double(F.col(target).cast("string")) if target else F.lit(None).cast("double")
    return rows.select(F.col(id_col).cast("string").alias("id"), prop.alias("property"), F.array(*[clean_double(F.col(f"`{c}`").cast("string")) for c in features]).alias("features"))


def from_tsv_rows(rows: DataFrame, id_col: str, values_col: str, header: str) -> tuple[DataFrame, list[str]]:
    """Rows whose values are one tab-separated string, under a tab-separated header; a row of another width is an error that names it."""
    names = header.split("\t")
    parts = F.split(F.col(values_col), "\t", -1)
    complaint = F.concat(F.lit("row "), F.col(id_col).cast("string"), F.lit(f": expected {len(names)} values, got "), F.size(parts).cast("string"))
    checked = F.when(F.size(parts) == len(names), parts).otherwise(F.raise_error(complaint).cast("array<string>"))
    return rows.withColumn("features", F.transform(checked, clean_double)).drop(values_col), names


def from_service_reply(rows: DataFrame, json_col: str) -> DataFrame:
    """Replies {headers, chemicals: [{id, descriptors}]} as (headers, id, features)."""
    kind = "struct<headers:array<string>,chemicals:array<struct<id:string,descriptors:array<string>>>>"
    reply = rows.select(F.from_json(json_col, kind).alias("r"))
    each = reply.select("r.headers", F.explode("r.chemicals").alias("c"))
    return each.select("headers", F.col("c.id").alias("id"), F.transform("c.descriptors", clean_double).alias("features"))


def read_ndjson(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON object a line; lines that are none are passed over."""
    parsed = spark.read.text(path).select(F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("r"), "value")
    good = F.try_parse_json(F.col("value")).isNotNull() & F.col("r").isNotNull()
    return parsed.filter(good).select("r.*")


def read_runs(spark: SparkSession, pattern: str, schema: str | None = None) -> DataFrame:
    """One row for each results file (a JSON document) under a glob; `run` is the name of its folder. Broken files are passed over."""
    reader = spark.read.option("multiLine", True).option("mode", "DROPMALFORMED")
    df = (reader.schema(schema) if schema else reader).json(pattern)
    return df.withColumn("run", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2))


def read_jdbc(spark: SparkSession, url: str, table: str, partition: str | None = None, parts: int = 8, predicates: Sequence[str] | None = None, **options: str) -> DataFrame:
    """A database table; filters on it are pushed down.

    partition: a column of numbers or times by whose range the table is read in `parts` connections;
    its ends are asked of the database first. Rows that lack it are read by the first of them.
    predicates: conditions that part the table instead, one connection each. Without either, one.
    """
    if predicates is not None:
        return spark.read.jdbc(url, table, predicates=list(predicates), properties=dict(options))

    def reader(**more: str) -> DataFrame:
        return spark.read.format("jdbc").options(url=url, **options, **more).load()

    if partition is None:
        return reader(dbtable=table)
    ends = reader(query=f"select min({partition}) as lo, max({partition}) as hi from {table}").first()
    if ends[0] is None:
        return reader(dbtable=table)
    return reader(dbtable=table, partitionColumn=partition, lowerBound=str(ends[0]), upperBound=str(ends[1]), numPartitions=str(parts))


def append_jdbc(df: DataFrame, url: str, table: str, batch: int = 1000, connections: int = 8, **options: str) -> None:
    """Appends to a database table, `batch` rows a statement over at most `connections` connections.

    Each partition is one transaction; a partition that is run again after a lost executor may have
    been committed before, so append to a staging table, or one whose key makes repeats an error.
    """
    own = df if df.rdd.getNumPartitions() <= connections else df.coalesce(connections)
    own.write.format("jdbc").mode("append").options(url=url, dbtable=table, batchsize=str(batch), **options).save()


def read_with_descriptors(spark: SparkSession, rows_path: str, descriptors_path: str, key: str) -> DataFrame:
    """A file of rows with the descriptors of another file by key; a row without any is left out, a key that the second file holds twice is an error."""
    rows, values = read_delimited(spark, rows_path), read_delimited(spark, descriptors_path)
    if (twice := values.groupBy(key).count().filter("count > 1").first()) is not None:
        raise ValueError(f"{key} {twice[key]!r} has more than one row of descriptors")
    clash = [c for c in values.columns if c != key and c in rows.columns]
    return rows.join(values.drop(*clash), key)


def query(spark: SparkSession, sql: str, **args: object) -> DataFrame:
    """SQL with bound parameters (:name)."""
    return spark.sql(sql, args=args)


def write_by(df: DataFrame, path: str, *partition: str, kind: str = "parquet", mode: str = "append") -> None:
    """Appends to a folder with one subfolder for each value of the partition columns."""
    df.write.mode(mode).format(kind).partitionBy(*partition).save(path)


def insert_new(existing: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Upsert that leaves existing keys: existing rows, and the new rows whose key is new (one each)."""
    fresh = rows.dropDuplicates(list(keys)).join(existing.select(*keys), list(keys), "left_anti")
    return existing.unionByName(fresh.select(*existing.columns))


def insert_or_update(existing: DataFrame, rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Upsert that takes the new row for an existing key; of several new ones the latest by `order`."""
    latest = rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))).filter("__n = 1").drop("__n")
    return existing.join(latest.select(*keys), list(keys), "left_anti").unionByName(latest.select(*existing.columns))


def changed_values(existing: DataFrame, rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, old, new) of the keys whose value an update would change."""
    new = rows.select(*keys, F.col(value).alias("new"))
    return existing.select(*keys, F.col(value).alias("old")).join(new, list(keys)).filter(~F.col("old").eqNullSafe(F.col("new")))


def delete_where(table: DataFrame, doomed: DataFrame, keys: Sequence[str], preview: int = 5) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(what stays, first rows to go by key, their count): a dry run until the first is written."""
    gone = table.join(doomed.select(*keys).distinct(), list(keys), "left_semi")
    return table.join(doomed.select(*keys), list(keys), "left_anti"), gone.orderBy(*keys).limit(preview), gone.agg(F.count(F.lit(1)).alias("n_deleted"))


def to_json_rows(df: DataFrame, omit_nulls: bool = True) -> DataFrame:
    """One JSON text a row; missing values left out or written as null."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": str(omit_nulls).lower()}).alias("json"))


def json_safe(value: Column, kind: T.DataType) -> Column:
    """The value with NaN and infinities as null, at any depth of arrays, maps and structs."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: json_safe(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(value, lambda _, x: json_safe(x, kind.valueType))
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), F.struct(*[json_safe(value[f.name], f.dataType).alias(f.name) for f in kind]))
    return value


def to_safe_json(df: DataFrame, omit_nulls: bool = True) -> DataFrame:
    """`to_json_rows` of rows whose numbers JSON can hold."""
    return to_json_rows(df.select(*[json_safe(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema]), omit_nulls)


def process_new(done: DataFrame, rows: DataFrame, key: str, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """work over the rows whose key isn't in `done`, each key once."""
    return work(rows.dropDuplicates([key]).join(done.select(key), key, "left_anti"))


def is_meaningful(df: DataFrame, column: str) -> Column:
    """Not null, not a blank text, not an empty container, not a container of nulls."""
    kind, c = df.schema[column].dataType, F.col(column)
    if isinstance(kind, T.StringType):
        return c.isNotNull() & (F.trim(c) != "")
    if isinstance(kind, T.ArrayType):
        return F.coalesce(F.exists(c, lambda x: x.isNotNull()), F.lit(False))
    if isinstance(kind, T.MapType):
        return F.coalesce(F.exists(F.map_values(c), lambda x: x.isNotNull()), F.lit(False))
    return c.isNotNull()


def drop_meaningless(df: DataFrame) -> DataFrame:
    """Without the columns that have no meaningful value; one pass over the data."""
    found = df.agg(*[F.coalesce(F.bool_or(is_meaningful(df, c)), F.lit(False)).alias(c) for c in df.columns]).first()
    return df.select(*[c for c in df.columns if found[c]])


def shared_dir(spark: SparkSession) -> str:
    """A new folder's path where all executors can read and write: under spark.checkpoint.dir, in local mode under a folder of our own."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = tempfile.mkdtemp(prefix="spark-descry-", dir="/tmp")
    return f"{at.rstrip('/')}/{uuid.uuid4().hex}"
