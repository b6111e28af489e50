"""The registered queries of this subpackage: name -> (spark, sf_dir) -> DataFrame, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontamination, language, near_duplicates, personal_data, quality, secret_scan, sql, substrings, token_counts, urls


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _over(function: Callable[..., DataFrame], *tables: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: function(*(_table(spark, sf_dir, t) for t in tables))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": _over(token_counts.token_report, "documents"),
    "op2_secret_scan": _over(secret_scan.secret_report, "documents"),
    "op3_language_id": _over(language.language_report, "documents"),
    "op4_decontamination": _over(decontamination.find_leaks, "documents", "benchmark"),
    "op5_substring_dedup": _over(substrings.repeats_report, "documents"),
    "op6_personal_data": _over(personal_data.personal_data_report, "documents"),
    "op7_url_filter": _over(urls.judge_urls, "pages", "labels"),
    "op8_near_duplicates": _over(near_duplicates.near_duplicates, "documents"),
    "op9_quality_rules": _over(quality.quality_report, "documents"),
    "op10_byte_bpe": _over(bpe.bpe_digests, "documents"),
}

ORACLE_SQL: dict[str, str] = {
    "op5_substring_dedup": sql.SUBSTRINGS,
    "op7_url_filter": urls.SQL,
    "op8_near_duplicates": sql.NEAR_DUPLICATES,
    "op9_quality_rules": sql.QUALITY,
}
