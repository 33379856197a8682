"""The queries of the training-data operators: thin calls with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mosslight.llm import language_id, license_scan, line_dedup, media, mixing, packing, quality_classifier, quality_rules, simhash, warc


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(_read(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.col("host").alias("source"), "host_docs", "host_failures", F.round("host_rate", 6).alias("host_rate"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_read(spark, sf_dir, "documents"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_classifier.classify(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))
    return judged.select("doc_id", F.col("host").alias("source"), F.col("path").alias("lang"), *[F.round(c, 6).alias(c) for c in ("host_rate", "path_rate", "quality", "toxicity")], "kept")


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    described = media.describe(media.store(_read(spark, sf_dir, "documents")))
    return described.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", F.concat(F.col("width"), F.lit("x"), F.col("height"), F.lit(":"), F.col("thumbnail_hash")).alias("feature"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    model = language_id.train(language_id.sample(docs, ~held_out))
    return language_id.identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", F.round("score", 6).alias("score"), "accepted")


def op6_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan(_read(spark, sf_dir, "documents"))
    return found.withColumn("score", F.round("score", 6))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(_read(spark, sf_dir, "pages"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.md5(F.col("text").cast("binary")).alias("text_md5"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(mixing.size_table(_read(spark, sf_dir, "documents")))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "rate", "copies")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"))


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_simhash": op2_simhash,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_media_columns": op4_media_columns,
    "op5_language_id": op5_language_id,
    "op6_license_scans": op6_license_scans,
    "op7_mixing": op7_mixing,
    "op8_warc": op8_warc,
    "op9_line_dedup": op9_line_dedup,
    "op10_packing": op10_packing,
}
