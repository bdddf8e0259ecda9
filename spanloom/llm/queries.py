"""The queries of this subpackage and their DuckDB SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm import decontaminate, near_dedup, quality, secrets, url_filter, warc
from spanloom.llm.common import table
from spanloom.llm.main_text import extract_main_text
from spanloom.llm.neighbours import nearest
from spanloom.llm.packing import pack_documents
from spanloom.llm.passages import repeated_passages, told_by_both


def op1_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.build_derivatives(warc.responses_from_pages(table(spark, sf_dir, "pages")), ("page_id",))


def quality_scores(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted for ``docs``, learned from the labelled documents that aren't held out."""
    marks = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label")).where(~quality.held_out())
    scored = quality.score(docs, quality.train(table(spark, sf_dir, "documents"), marks))
    return scored.select("doc_id", F.coalesce(quality.held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op2_subword_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(spark, table(spark, sf_dir, "documents"), sf_dir)


def op3_multipart_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.find_secrets(table(spark, sf_dir, "documents")))


def op9_token_indexed_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def op4_qgram_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return told_by_both(repeated_passages(table(spark, sf_dir, "documents")))


def op6_text_tag_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))


def op7_additive_quantisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc_derivatives": op1_warc_derivatives,
    "op2_subword_quality": op2_subword_quality,
    "op3_multipart_secrets": op3_multipart_secrets,
    "op4_qgram_decontamination": op4_qgram_decontamination,
    "op5_compact_windows": op5_compact_windows,
    "op6_text_tag_ratio": op6_text_tag_ratio,
    "op7_additive_quantisation": op7_additive_quantisation,
    "op9_token_indexed_urls": op9_token_indexed_urls,
    "op8_minhash_near_dedup": op8_minhash_near_dedup,
    "op10_best_fit_packing": op10_best_fit_packing,
}
ORACLE_SQL: dict[str, str] = {
    "op3_multipart_secrets": secrets.oracle_sql(),
    "op8_minhash_near_dedup": near_dedup.oracle_sql(),
    "op9_token_indexed_urls": url_filter.oracle_sql(),
}
