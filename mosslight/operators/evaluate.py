"""Judged queries: recall, reciprocal rank and the contribution of each channel."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosslight import schema as S

#: Channel combinations that are compared.
ARMS = {"lexical": ("lexical",), "lexical+graph": ("lexical", "graph"), "lexical+vector": ("lexical", "vector"), "full": S.CHANNELS}


class UnknownPaths(ValueError):
    """Judgements name documents that aren't in the index."""


def unknown_judgements(judgements: DataFrame, documents: DataFrame) -> DataFrame:
    """``query_id, path`` of judged documents that don't exist."""
    judged = judgements.select("query_id", F.explode("relevant").alias("path"))
    return judged.join(documents.select("path"), "path", "left_anti").select("query_id", "path")


def validate(judgements: DataFrame, documents: DataFrame, shown: int = 50) -> None:
    lost = [f"{r['query_id']} -> {r['path']}" for r in unknown_judgements(judgements, documents).orderBy("query_id", "path").limit(shown).collect()]
    if lost:
        raise UnknownPaths("judged documents that aren't in the index: " + ", ".join(lost))


def scores(judgements: DataFrame, results: DataFrame, k: int = S.DEFAULT_LIMIT) -> DataFrame:
    """``query_id, recall, rr, found, missed`` from results (``query_id, path, position``).

    A document may hold several positions; it counts once for recall and by its first for rank.
    """
    judged = judgements.select("query_id", F.explode(F.array_distinct("relevant")).alias("path"))
    first = results.where(F.col("position") <= k).groupBy("query_id", "path").agg(F.min("position").alias("position"))
    met = judged.join(first, ["query_id", "path"], "left")
    sorted_paths = lambda present: F.array_sort(F.collect_list(F.when(F.col("position").isNotNull() == present, F.col("path"))))
    return met.groupBy("query_id").agg(
        (F.count("position") / F.count(F.lit(1))).alias("recall"),
        F.coalesce(1 / F.min("position"), F.lit(0.0)).alias("rr"),
        sorted_paths(True).alias("found"),
        sorted_paths(False).alias("missed"),
    )


def arm_summary(arm: str, per_query: DataFrame | None, reason: str | None = None) -> DataFrame | tuple:
    """One row: arm, available, reason, mean recall and mean reciprocal rank; an unavailable arm has nulls and no zero score."""
    if per_query is None:
        return arm, False, reason, None, None
    return per_query.agg(F.avg("recall").alias("recall"), F.avg("rr").alias("mrr")).select(F.lit(arm).alias("arm"), F.lit(True).alias("available"), F.lit(None).cast("string").alias("reason"), "recall", "mrr")


def deltas(arms: DataFrame) -> DataFrame:
    """``recall_delta, mrr_delta`` of the full arm over lexical and vector; null if either is unavailable."""
    pick = lambda arm, c: F.max(F.when((F.col("arm") == arm) & F.col("available"), F.col(c)))
    return arms.agg(*[(pick("full", c) - pick("lexical+vector", c)).alias(f"{c}_delta") for c in ("recall", "mrr")])
