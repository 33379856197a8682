"""What a caller gets: hits, points, recent chunks and payloads."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosslight import schema as S
from mosslight.functions.text import citation, snippet

_REF = re.compile(r"c[0-9a-f]{16}")


def hits(page: DataFrame, chunks: DataFrame, documents: DataFrame, full: bool = False) -> DataFrame:
    """The page with citations, snippets and document facts; bodies are joined here, to the page only."""
    doc = documents.select("path", "repo", "title", "doc_type", "decided_on", "superseded_by", "tags")
    rows = page.join(chunks.select("ref", "heading_path", "body"), "ref").join(doc, "path")
    shown = [F.col("body")] if full else []
    return rows.select(
        "query_id", "position", "ref", citation(F.col("path"), F.col("heading_path")).alias("citation"), "repo", "path", "title", "doc_type", "heading_path", "decided_on", "superseded_by", "tags",
        "is_superseded", (F.col("superseded_by").isNotNull() & ~F.col("is_superseded")).alias("supersedence_unresolved"),
        F.round("boosted", 6).alias("score"), snippet(F.col("body")).alias("snippet"), *shown,
    )


def get_chunks(refs: DataFrame, chunks: DataFrame, documents: DataFrame, edges: DataFrame) -> DataFrame:
    """Hits with full bodies for the refs asked for; unknown ones give no row."""
    replaced = edges.where(F.col("relation") == S.SUPERSEDED_BY).select(F.col("src_path").alias("path")).distinct().withColumn("is_superseded", F.lit(True))
    found = chunks.select("ref", "path").join(refs.select("ref").distinct(), "ref").join(replaced, "path", "left")
    page = found.select(F.col("ref").alias("query_id"), F.lit(1).alias("position"), "ref", "path", F.coalesce("is_superseded", F.lit(False)).alias("is_superseded"), F.lit(0.0).alias("boosted"))
    return hits(page, chunks, documents, full=True)


def check_ref(ref: str) -> str:
    """A chunk reference as given; numbers and anything else that isn't one raise."""
    if not _REF.fullmatch(ref):
        raise ValueError(f"{ref!r} is not a chunk reference (c and 16 hexadecimal digits)")
    return ref


def recent(chunks: DataFrame, documents: DataFrame, limit: int = S.DEFAULT_LIMIT) -> DataFrame:
    """Chunks of the most recently modified documents, all chunks of a document alike."""
    rows = chunks.join(documents.select("path", "repo", "title", "doc_type", "mtime"), "path")
    return rows.orderBy(F.desc("mtime"), "path", "chunk_seq").limit(limit)


def payload(rows: DataFrame, name: str = "payload") -> DataFrame:
    """Each row as a JSON object."""
    return rows.select(F.to_json(F.struct("*")).alias(name))
