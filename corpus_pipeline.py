"""The corpus pipeline: quality rules, near-duplicates, benchmark decontamination, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next stage's
docs.  All but the last return the columns of docs.  Near-duplicates are texts with a similarity of 0.8 or more (op10 has 0.85); one row of each group stays.  Rows with a null doc_id pass the duplicate stage unlinked; null and
empty texts fail the quality rules.  An empty table gives no rows; further columns, whatever their names, stay until the last stage, which returns pieces.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polyquill.llm import decontam, linecrf, minhash, packing, pii, quality_rules
from polyquill.llm.shared import remove_folder, shared_folder


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    crf = linecrf.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    found, called = quality_rules.judged(docs, crf)
    return found.where(F.col(called["kept"])).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.one_of_each(docs, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found, (marks, *_) = decontam.hits(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.where(F.col(marks).isNull()).select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found, _, spans = pii.with_spans(docs, pii.train(spark))
    clean = found.withColumn("text", pii.redacted(F.col("text"), F.col(spans)))
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.length(F.coalesce("text", F.lit(""))).cast(docs.schema["n_chars"].dataType))
    return clean.select(*docs.columns)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.report(docs)


STAGES = [("quality_rules", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("personal_data", personal_data), ("packing", sequences)]

#: Viterbi decoding, similarity components and the packing search have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over sf_dir's documents; what lies between stages goes to shared storage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder, before = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}", None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:  # what the last stage read is needed no more
            remove_folder(spark, f"{folder}/{before}")
        before = name
    return docs
