"""The corpus pipeline: quality rules, line deduplication, near-deduplication, mixing, packing.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows of ``docs``. All but the last
return the columns of ``docs``; a row that the mix takes twice comes twice. ``run`` writes
every stage's result as Parquet to the shared work folder, reads it again for the next and then
deletes what that has consumed.

Nulls, empty and long texts, repeated rows and empty tables are handled as the operators say.
Line deduplication may leave a text empty; the row stays, and near-deduplication then joins
it with the other empty ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mosslight.llm import line_dedup, mixing, packing, quality_rules, simhash
from mosslight.staging import release, stage, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the host-level quality rules reject go."""
    return quality_rules.filter_documents(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines in later occurrences of repeated three-line windows go; ``n_chars`` follows the text."""
    out = line_dedup.dedup_lines(docs).select(*[F.col(f"`{c}`") for c in docs.columns])
    if "n_chars" not in docs.columns:
        return out
    kind = docs.schema["n_chars"].dataType
    return out.withColumn("n_chars", F.coalesce(F.length("text").cast(kind), F.col("n_chars")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component stays: that with the smallest id."""
    return simhash.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in sequences."""
    return packing.pack(docs)


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("simhash_dedup", near_duplicates), ("mixing", mix), ("packing", pack)]

#: The stages hash, tokenise and balance; SQL can't express them. tests/llm has the brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage has consumed is deleted once its result is written."""
    docs, mark = spark.read.parquet(f"{sf_dir}/documents.parquet"), written()
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), name)
        release(spark, mark)
    return docs
