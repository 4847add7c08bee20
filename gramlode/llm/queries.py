"""Queries of the subpackage and their SQL, for the entry module."""

from __future__ import annotations

from importlib.util import find_spec

from pyspark.sql import DataFrame, SparkSession

from . import decontamination, html_text, jaccard, katz, line_dedup, oracles, pieces, pii, quality, substring_dedup, warc
from .common import session, table


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip(table(spark, sf_dir, "documents"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.judge(table(spark, sf_dir, "documents"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read_back(warc.archive(table(spark, sf_dir, "pages"))).drop("record_id", "warc_date", "target_uri")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.rules(table(spark, sf_dir, "documents")).drop("text", "cleaned")


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents")).drop("class_id")


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score(table(spark, sf_dir, "documents"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup(table(spark, sf_dir, "documents")).drop("kept_text")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.judge(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.drop("text", "hit_spans")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(session(spark), sf_dir)


QUERIES = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_html_extraction": op2_html_extraction,
    "op3_line_dedup": op3_line_dedup,
    "op4_pii": op4_pii,
    "op5_warc": op5_warc,
    "op6_quality_rules": op6_quality_rules,
    "op7_ngram_jaccard": op7_ngram_jaccard,
    "op8_lm_scoring": op8_lm_scoring,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_decontamination": op10_decontamination,
}

if find_spec("corpus_pipeline"):
    QUERIES["pipeline"] = pipeline

ORACLE_SQL = oracles.ORACLE_SQL
