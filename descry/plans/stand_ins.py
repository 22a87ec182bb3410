"""The test tables in the roles that the operators need."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as instances: (id, property, features)."""
    e = table(spark, sf_dir, "embeddings").filter("embedding is not null")
    return e.select(F.col("vec_id").alias("id"), F.col("label").cast("double").alias("property"), F.col("embedding").cast("array<double>").alias("features"))


def train_test(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A fifth of the instances by id is the test set."""
    rows = instances(spark, sf_dir)
    return rows.filter("id % 5 <> 0"), rows.filter("id % 5 = 0")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as predictions: price against a fixed line in quantity; some are missing, flags by tax and discount."""
    rows = table(spark, sf_dir, "lineitem")
    pred = F.when(F.col("l_tax") < 0.075, 1500 * F.col("l_quantity") + 20000 * F.col("l_discount"))
    return rows.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), F.col("l_extendedprice").alias("exp"), pred.alias("pred"), F.col("l_returnflag").alias("grp"), (F.col("l_tax") <= 0.04).alias("flag_a"), F.when(F.col("l_discount") < 0.09, F.col("l_discount") <= 0.05).alias("flag_b"))


#: The same in SQL.
PREDICTIONS_SQL = """select l_orderkey as id, l_linenumber as line, l_extendedprice as exp,
 case when l_tax < 0.075 then 1500 * l_quantity + 20000 * l_discount end as pred, l_returnflag as grp,
 l_tax <= 0.04 as flag_a, case when l_discount < 0.09 then l_discount <= 0.05 end as flag_b from lineitem"""


def class_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality as the experiment, not toxic as the prediction; some are missing; (id, exp, pred, source)."""
    labels, docs = table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents").select("doc_id", "source")
    return labels.join(docs, "doc_id").select(F.col("doc_id").alias("id"), F.col("quality").cast("double").alias("exp"), F.when(F.col("doc_id") % 7 != 0, 1.0 - F.col("toxic")).alias("pred"), "source")


CLASS_SQL = "select doc_id as id, cast(quality as double) as exp, case when doc_id % 7 <> 0 then 1.0 - toxic end as pred, source from labels join documents using (doc_id)"


def fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of each event type for each user: (id, features) in alphabetical order of the types."""
    kinds = ("click", "error", "purchase", "signup", "view")
    e = table(spark, sf_dir, "events")
    counts = e.groupBy(F.col("user_id").alias("id")).agg(*[F.count_if(F.col("event_type") == k).cast("double").alias(k) for k in kinds])
    return counts.select("id", F.array(*kinds).alias("features"))


def fragment_names(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(("click", "error", "purchase", "signup", "view"))), "idx int, name string")
