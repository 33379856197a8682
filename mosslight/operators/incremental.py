"""Differences between what is stored and what is there now, and their effect on derived tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosslight.functions.text import classify


class EmptyCorpus(ValueError):
    """The new corpus has none of the stored documents."""


def diff(stored: DataFrame, current: DataFrame) -> DataFrame:
    """``path, status, touched, mtime, content_hash``: added, changed, unchanged, removed or kept_unreadable.

    Both sides have ``path, mtime, content_hash``; ``current`` may have ``status``: a ``rejected``
    row counts as not there, an ``unreadable`` one keeps what is stored. One full outer join on
    the path, before anything is parsed.
    """
    status = F.col("status") if "status" in current.columns else F.lit("ok")
    now = current.select(F.col("path"), F.col("mtime").alias("new_mtime"), F.col("content_hash").alias("new_hash"), status.alias("state")).where("state <> 'rejected'")
    old = stored.select(F.col("path"), F.col("mtime").alias("old_mtime"), F.col("content_hash").alias("old_hash"), F.lit(True).alias("was"))
    both = old.join(now, "path", "full_outer")
    kind = (
        F.when(F.col("state").isNull(), "removed")
        .when((F.col("state") == "unreadable") & F.col("was"), "kept_unreadable")
        .when(F.col("state") == "unreadable", None)
        .when(F.col("was").isNull(), "added")
        .when(F.col("old_hash").eqNullSafe(F.col("new_hash")), "unchanged")
        .otherwise("changed")
    )
    moved = (kind == "unchanged") & (F.col("old_mtime") != F.col("new_mtime"))
    return both.select("path", kind.alias("status"), F.coalesce(moved, F.lit(False)).alias("touched"), F.coalesce("new_mtime", "old_mtime").alias("mtime"), F.coalesce("new_hash", "old_hash").alias("content_hash")).where("status is not null")


def counts(changes: DataFrame) -> DataFrame:
    """One row: documents by status, and how many only have a new modification time."""
    n = lambda s: F.count(F.when(F.col("status") == s, 1)).alias(s)
    return changes.agg(n("added"), n("changed"), n("unchanged"), n("removed"), n("kept_unreadable"), F.count(F.when(F.col("touched"), 1)).alias("mtime_refreshed"))


def stale_paths(changes: DataFrame) -> DataFrame:
    """Paths whose derived rows go: changed and removed documents."""
    return changes.where(F.col("status").isin("changed", "removed")).select("path")


def fresh_paths(changes: DataFrame) -> DataFrame:
    """Paths to be parsed: added and changed documents."""
    return changes.where(F.col("status").isin("added", "changed")).select("path")


def replace(table: DataFrame, changes: DataFrame, new_rows: DataFrame, path_col: str = "path") -> DataFrame:
    """``table`` without the rows of stale documents, and the new ones."""
    stale = stale_paths(changes).withColumnRenamed("path", path_col)
    return table.join(stale, path_col, "left_anti").unionByName(new_rows, allowMissingColumns=True)


def guard(stored: DataFrame, current: DataFrame, allow_empty: bool = False) -> None:
    """Refuse to replace a stored corpus by one with which it shares no path."""
    if allow_empty or stored.select("path").isEmpty():
        return
    if stored.join(current.select("path"), "path", "left_semi").select("path").isEmpty():
        raise EmptyCorpus("none of the stored documents is in the new corpus; pass allow_empty to remove them all")


def reclassify(documents: DataFrame, knowledge: str | None) -> DataFrame:
    """``documents`` with types for another knowledge repo, and ``reclassified`` where that differs."""
    kind = classify(F.col("repo"), F.col("path"), knowledge)
    return documents.withColumn("reclassified", kind != F.col("doc_type")).withColumn("doc_type", kind)


def upsert(meta: DataFrame, new: DataFrame) -> DataFrame:
    """Key-value rows with those of ``new`` in place of older ones."""
    return meta.join(new.select("key"), "key", "left_anti").unionByName(new)
