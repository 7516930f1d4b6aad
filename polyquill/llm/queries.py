"""The registered queries opN_<name> over the driver's tables, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_elias_fano_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lmscore import score

    return score(_table(spark, sf_dir, "documents"))


def op2_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_crf import report

    return report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .linecrf import train
    from .quality_rules import COUNTS, judge

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return judge(docs, train(docs, _table(spark, sf_dir, "labels"))).select("doc_id", *COUNTS, "base_failed", "kept", "content_share")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import report

    return report(_table(spark, sf_dir, "documents"))


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontam import report

    return report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("items")


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


def op3_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mainhtml import report

    return report(_table(spark, sf_dir, "pages"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import report

    return report(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import report

    return report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chunks import report

    return report(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .conversations import report

    return report(_table(spark, sf_dir, "conversations"))


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import report

    return report(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .collocations import report

    return report(_table(spark, sf_dir, "documents").select("lang", "text"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_elias_fano_lm, op2_quality_crf, op3_html_main_text, op4_best_fit_packing, op5_toxicity, op6_pii, op7_substring_dedup, op8_benchmark_decontamination, op9_quality_rules, op10_minhash, op11_conversation_repair, op12_license_scan, op13_collocations, pipeline]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    from .oracles import SQL

    return dict(SQL)
