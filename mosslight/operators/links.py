"""Links: extraction from texts, resolution to documents, and what became of each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosslight import schema as S
from mosslight.functions.text import body_links, clean_scalar, decision_number, is_work_log, normalize_target, resolution_keys, resolve_relative
from mosslight.staging import stage


def extract(docs: DataFrame) -> DataFrame:
    """``src_path, target, relation``, distinct, from ``path, link_text, superseded_by``."""
    found = docs.select(F.col("path").alias("src_path"), F.explode(body_links(F.col("link_text"))).alias("target"), F.lit(S.LINKS_TO).alias("relation"))
    replaced = docs.select(F.col("path").alias("src_path"), clean_scalar(F.col("superseded_by")).alias("target"), F.lit(S.SUPERSEDED_BY).alias("relation")).where("target is not null")
    return found.unionByName(replaced).distinct()


def keys(docs: DataFrame) -> DataFrame:
    """``repo, path, key``: a row for each key a document can be addressed by."""
    return docs.select("repo", "path", F.explode(resolution_keys(F.col("repo"), F.col("path"), F.col("title"))).alias("key"))


def _bucket(table: DataFrame, by: list[str], name: str) -> DataFrame:
    """For each key how many documents have it, and one of them; a common key stays one row."""
    return table.groupBy(*by).agg(F.count(F.lit(1)).alias(f"{name}_n"), F.min("path").alias(f"{name}_path"))


def resolve(targets: DataFrame, docs: DataFrame) -> DataFrame:
    """``targets`` with ``dst_path`` and ``outcome``: edge, unresolved, ambiguous, self or work_log.

    A number means the repo's own record before any other; a relative path means one file or
    none; a name must have a single document, in its repo or anywhere. All lookups are joins
    with tables of one row a key, so a key that very many documents share costs no more.
    """
    names = keys(docs)
    numbers = docs.select("repo", "path", decision_number(F.col("path")).alias("key")).where("key is not null")
    paths = docs.groupBy(F.lower(F.trim("path")).alias("exact_key")).agg(F.max("path").alias("exact_path"))
    repo_of = docs.select(F.col("path").alias("src_path"), F.col("repo").alias("src_repo"))

    number = F.col("target").rlike(r"^\d{4}$")
    relative = F.lower(resolve_relative(F.col("src_path"), F.col("target")))
    rows = targets.join(repo_of, "src_path", "left").withColumns({"is_number": F.coalesce(number, F.lit(False)), "relative": F.when(~number, relative)})
    rows = stage(rows, "targets")

    def look(rows: DataFrame, table: DataFrame, name: str, in_repo: bool) -> DataFrame:
        bucket = _bucket(table, ["repo", "key"] if in_repo else ["key"], name).withColumnsRenamed({"repo": f"{name}_repo", "key": f"{name}_key"})
        on = F.col("key") == F.col(f"{name}_key")
        return rows.join(bucket, (on & (F.col("src_repo") == F.col(f"{name}_repo"))) if in_repo else on, "left")

    parts = []  # numbers, names and paths apart, so that each row is looked up by a key that it has
    kinds = ((F.col("is_number"), F.col("target"), numbers), (~F.col("is_number") & F.col("relative").isNull(), normalize_target(F.col("target")), names))
    for is_kind, key, table in kinds:
        mine = rows.where(is_kind).withColumn("key", key)
        parts.append(look(look(mine, table, "own", True), table, "all", False).drop("key", "own_repo", "own_key", "all_key"))
    parts.append(rows.where(~F.col("is_number") & F.col("relative").isNotNull()).join(paths, F.col("relative") == F.col("exact_key"), "left").drop("exact_key"))
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2], allowMissingColumns=True)

    one = lambda name: F.when(F.col(f"{name}_n") == 1, F.col(f"{name}_path"))
    by_number = F.when(F.col("own_n").isNotNull(), one("own")).otherwise(one("all"))
    by_name = F.coalesce(one("own"), one("all"))
    is_path = F.col("relative").isNotNull()
    dst = F.when(F.col("is_number"), by_number).when(is_path, F.col("exact_path")).otherwise(by_name)
    unclear = ~is_path & (F.greatest(F.coalesce("own_n", F.lit(0)), F.coalesce("all_n", F.lit(0))) > 1)
    logged = F.col("is_number") & (F.col("relation") != S.SUPERSEDED_BY) & is_work_log(F.col("src_path"))
    outcome = F.when(logged, "work_log").when(dst == F.col("src_path"), "self").when(dst.isNotNull(), "edge").when(unclear, "ambiguous").otherwise("unresolved")
    return rows.select("src_path", "target", "relation", F.when(outcome == "edge", dst).alias("dst_path"), outcome.alias("outcome"))


def edges(resolved: DataFrame) -> DataFrame:
    """``src_path, dst_path, relation``, distinct."""
    return resolved.where("outcome = 'edge'").select("src_path", "dst_path", "relation").distinct()


def outcomes(resolved: DataFrame) -> DataFrame:
    """One row: edges, unresolved, unlinkable, from_work_logs and the sources of supersedences that lead nowhere."""
    n = lambda *kinds: F.count(F.when(F.col("outcome").isin(*kinds), 1))
    lost = (F.col("relation") == S.SUPERSEDED_BY) & F.col("outcome").isin("self", "ambiguous", "unresolved")
    return resolved.agg(
        F.count_distinct(F.when(F.col("outcome") == "edge", F.struct("src_path", "dst_path", "relation"))).alias("edges"),
        n("unresolved").alias("unresolved"),
        n("self", "ambiguous").alias("unlinkable"),
        n("work_log").alias("from_work_logs"),
        F.count_distinct(F.when(lost, F.col("src_path"))).alias("n_dangling"),
    )


def dangling_supersedences(resolved: DataFrame) -> DataFrame:
    """Sources of ``superseded_by`` that produced no edge."""
    lost = (F.col("relation") == S.SUPERSEDED_BY) & F.col("outcome").isin("self", "ambiguous", "unresolved")
    return resolved.where(lost).select(F.col("src_path").alias("path")).distinct()
