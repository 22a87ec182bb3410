"""The corpus pipeline: quality rules, line dedup, SimHash near-dedup, decontamination, byte-level BPE.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns a
DataFrame; run() writes each stage's rows and reads them again as the next stage's docs. A row
without a doc_id is judged by its text like any other. Columns beyond those of documents stay as
they are, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from descry.llm import byte_bpe, decontaminate, line_dedup, quality_rules, simhash
from descry.llm._shared import text_hash, written


def numbered(docs: DataFrame, *more: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame], list[str]]:
    """docs with its columns named c0, c1 ..., so that none clashes with what an operator adds; back to docs' columns; the names of doc_id, text and more."""
    own = [f"c{i}" for i in range(len(docs.columns))]
    at = dict(zip(docs.columns, own, strict=True))
    return docs.toDF(*own), lambda df: df.select(*own).toDF(*docs.columns), [at[c] for c in ("doc_id", "text", *more)]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    own, back, (_, text) = numbered(docs)
    return back(quality_rules.judge(own, text_col=text).filter("kept"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that ten documents or more share; n_chars follows the text."""
    own, back, (doc_id, text, *n_chars) = numbered(docs, *[c for c in docs.columns if c == "n_chars"])
    out = line_dedup.dedup_lines(own, min_docs=10, min_chars=1, keep_first=False, id_col=doc_id, text_col=text)
    new = {text: F.col("kept_text")} | {c: F.char_length("kept_text").cast(own.schema[c].dataType) for c in n_chars}
    return back(out.withColumns(new))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates one document, once: that of the least doc_id (none: last), then of the least text hash."""
    own, back, (doc_id, text) = numbered(docs)
    return back(simhash.keep_one(own, doc_id, text))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark does not contaminate."""
    own, back, (doc_id, text) = numbered(docs)
    judged = decontaminate.decontaminate(own, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col=doc_id, text_col=text)
    bad = written(judged.filter("contaminated").select(F.col(doc_id).alias("bad_id"), F.col("text_hash").alias("bad_text")).distinct(), "contaminated")
    return back(own.join(bad, F.col(doc_id).eqNullSafe(F.col("bad_id")) & (text_hash(F.col(text)) == F.col("bad_text")), "left_anti"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, digests of the ids and of the decoded bytes."""
    return byte_bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, digest=True)


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("simhash_near_dedup", near_duplicates), ("decontamination", benchmark), ("byte_bpe", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL has no byte-pair merges; the stages are tested against plain versions instead.
ORACLE_SQL = None
