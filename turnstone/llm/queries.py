"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import chat, decontam, fim, jaccard, line_dedup, lm_score, packing, pii, quality, runs, simhash, toxicity, url_filter
from .common import table


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(pii.detect(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.report(chat.format_conversations(chat.with_probe(table(spark, sf_dir, "conversations"))))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm_score.score(table(spark, sf_dir, "documents"))
    return scored.select("doc_id", "n_words", F.round("sum_log", 6).alias("sum_log"), F.round("mean_log", 6).alias("mean_log"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(quality.judge(table(spark, sf_dir, "documents")))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(line_dedup.drop_frequent_lines(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), url_filter.rules_table(spark))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.report(simhash.near_duplicates(table(spark, sf_dir, "documents")))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.report(runs.collapse(runs.periodic(table(spark, sf_dir, "documents"))))


def op12_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.report(fim.transform(table(spark, sf_dir, "documents").select("doc_id", "text")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_decontamination, op2_pii, op3_chat_format, op4_packing, op5_lm_score, op6_quality_rules, op7_toxicity, op8_line_dedup, op9_url_filter, op10_simhash, op11_periodic_runs, op12_ngram_jaccard, op13_fill_in_middle)
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {"op1_decontamination": decontam.ORACLE, "op6_quality_rules": quality.oracle(), "op3_chat_format": chat.ORACLE, "op5_lm_score": lm_score.ORACLE, "op8_line_dedup": line_dedup.ORACLE, "op9_url_filter": url_filter.ORACLE, "op12_ngram_jaccard": jaccard.ORACLE, "op13_fill_in_middle": fim.ORACLE}
