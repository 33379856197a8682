"""Rank fusion, boosts, one chunk a document, and the top of the page."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mosslight import schema as S
from mosslight.functions.text import recency


def rrf(lists: dict[str, tuple[DataFrame, Column | float]], k: int = S.RRF_K) -> DataFrame:
    """``query_id, ref, score``: the sum over channels of weight / (k + rank).

    ``lists`` maps a channel to its ranking (``query_id, ref, rank``) and its weight, a number or
    a column of the ranking.
    """
    parts = []
    for name, (ranking, weight) in lists.items():
        w = weight if isinstance(weight, Column) else F.lit(float(weight))
        parts.append(ranking.select("query_id", "ref", F.lit(name).alias("channel"), (w / (k + F.col("rank"))).alias("part")))
    if not parts:
        raise ValueError("no channel to fuse")
    return reduce(DataFrame.unionByName, parts).groupBy("query_id", "ref").agg(F.sum("part").alias("score"))


def base_ranking(lists: list[DataFrame], digits: int = 12) -> DataFrame:
    """``query_id, ref, score, base_rank``: unweighted fusion of lexical and vector rankings, ties by ref."""
    fused = rrf({str(i): (x, 1.0) for i, x in enumerate(lists)})
    by = Window.partitionBy("query_id").orderBy(F.round("score", digits).desc(), "ref")
    return fused.withColumn("base_rank", F.row_number().over(by))


def facts(documents: DataFrame, edges: DataFrame, as_of: Column) -> DataFrame:
    """``path, recency, is_superseded`` of every document: all that its boost depends on."""
    replaced = edges.where(F.col("relation") == S.SUPERSEDED_BY).select(F.col("src_path").alias("path")).distinct().withColumn("is_superseded", F.lit(True))
    rows = documents.select("path", "decided_on", "mtime").join(replaced, "path", "left")
    return rows.select("path", recency(F.col("decided_on"), F.col("mtime"), as_of).alias("recency"), F.coalesce("is_superseded", F.lit(False)).alias("is_superseded"))


def boost(score: Column) -> Column:
    """A score under the ``facts`` beside it."""
    return score * (1 + S.RECENCY_WEIGHT * F.col("recency")) * F.when(F.col("is_superseded"), S.SUPERSEDED_FACTOR).otherwise(1.0)


def boosted(fused: DataFrame, chunks: DataFrame, documents: DataFrame, edges: DataFrame, as_of: Column) -> DataFrame:
    """``fused`` (``query_id, ref, score``) with ``path, recency, is_superseded, boosted``.

    Newer documents gain up to a quarter; a document that a ``superseded_by`` edge leaves keeps
    three tenths. Only ids, dates and paths take part; bodies join after the cut.
    """
    rows = fused.join(chunks.select("ref", "path"), "ref").join(facts(documents, edges, as_of), "path")
    return rows.select("query_id", "ref", "path", "score", "recency", "is_superseded", boost(F.col("score")).alias("boosted"))


def page(scored: DataFrame, limit: int = S.DEFAULT_LIMIT, digits: int = 12) -> DataFrame:
    """The best chunk of each document, then the ``limit`` best documents, with ``position``; ties by ref."""
    order = (F.round("boosted", digits).desc(), "ref")
    one = scored.withColumn("nth", F.row_number().over(Window.partitionBy("query_id", "path").orderBy(*order))).where("nth = 1").drop("nth")
    return one.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("position") <= limit)


def modes(queries: DataFrame, lists: dict[str, DataFrame], requested: tuple[str, ...] = S.CHANNELS) -> DataFrame:
    """``query_id, channels_used, mode``: the requested channels that found something, or ``none``."""
    out = queries.select("query_id")
    for name in requested:
        if name in lists:
            out = out.join(lists[name].select("query_id").distinct().withColumn(name, F.lit(name)), "query_id", "left")
        else:
            out = out.withColumn(name, F.lit(None).cast("string"))
    used = F.filter(F.array(*[F.col(c) for c in S.CHANNELS if c in requested]), lambda x: x.isNotNull())
    return out.select("query_id", used.alias("channels_used"), F.coalesce(F.nullif(F.array_join(used, "+"), F.lit("")), F.lit("none")).alias("mode"))
