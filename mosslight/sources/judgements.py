"""Judged queries from YAML."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


class JudgementError(ValueError):
    """The file isn't a list of judged queries."""


def load(spark: SparkSession, text: str) -> DataFrame:
    """``query_id, query, relevant`` from a mapping with ``queries``, each with an id, a query and relevant paths."""
    import yaml

    try:
        raw = yaml.safe_load(text)
    except yaml.YAMLError as e:
        raise JudgementError(f"not YAML: {e}") from e
    items = raw.get("queries") if isinstance(raw, dict) else None
    if not isinstance(items, list) or not items:
        raise JudgementError("'queries' must be a list with at least one entry")
    rows, seen = [], set()
    for i, x in enumerate(items):
        if not isinstance(x, dict):
            raise JudgementError(f"entry {i} isn't a mapping")
        for name in ("id", "query"):
            if not isinstance(x.get(name), str) or not x[name].strip():
                raise JudgementError(f"entry {i} has no {name}")
        if not isinstance(x.get("relevant"), list) or not x["relevant"] or not all(isinstance(p, str) and p for p in x["relevant"]):
            raise JudgementError(f"{x['id']}: 'relevant' must be a list of paths")
        if x["id"] in seen:
            raise JudgementError(f"the id {x['id']!r} occurs twice")
        seen.add(x["id"])
        rows.append((x["id"], x["query"], sorted(set(x["relevant"]))))
    return spark.createDataFrame(rows, "query_id string, query string, relevant array<string>")
