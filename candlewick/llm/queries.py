"""The queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audit, bpe, fingerprints, html, licenses, minhash, mixing, quality, recompression, spelling, sql, suffixes, urls, vectors


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = quality.text_statistics(table(spark, sf_dir, "documents"), ["doc_id", "lang", "source"])
    judged = quality.robust_outliers(stats)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.col("distance"))


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(table(spark, sf_dir, "documents"))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"))


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.repeat_digests(table(spark, sf_dir, "documents"))


def op10_recompression_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recompression.repeat_digests(table(spark, sf_dir, "documents"))


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judged(table(spark, sf_dir, "pages"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extracted(table(spark, sf_dir, "pages"))


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scanned(table(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audited(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variant_groups(table(spark, sf_dir, "documents"))


def op13_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprinted(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {"op13_document_fingerprints": op13_document_fingerprints, "op11_spelling_variants": op11_spelling_variants, "op12_filter_audit": op12_filter_audit, "op2_license_scan": op2_license_scan, "op5_embedding_near_dedup": op5_embedding_near_dedup, "op4_url_filters": op4_url_filters, "op7_html_extraction": op7_html_extraction, "op10_recompression_dedup": op10_recompression_dedup, "op1_suffix_array_dedup": op1_suffix_array_dedup, "op3_source_mixing": op3_source_mixing, "op6_bpe_encoding": op6_bpe_encoding, "op8_minhash_near_dedup": op8_minhash_near_dedup, "op9_quality_rules": op9_quality_rules}


def oracle_sql() -> dict[str, str]:
    return dict(sql.ORACLE)
