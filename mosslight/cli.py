"""Command line: search, get, recent, reindex, eval, allocate and status over an index folder."""

from __future__ import annotations

import argparse
import json
import sys
import time

from pyspark.sql import functions as F

from mosslight import schema as S
from mosslight.functions.embedding import CharacterEmbedder, HttpEmbedder
from mosslight.operators import evaluate, records, response
from mosslight.plans import index
from mosslight.plans.search import search, with_context
from mosslight.settings import Settings
from mosslight.sources import discovery, judgements
from mosslight.staging import stage


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="mosslight", description=__doc__)
    own = Settings.from_env()
    p.add_argument("--index", default=own.index, help="folder of the index")
    p.add_argument("--embed-dim", type=int, default=0, help="width of the built-in character embedder; 0: no vectors")
    p.add_argument("--embed-model", default=own.embed_model, help="model of a local HTTP service, in place of the built-in embedder")
    p.add_argument("--embed-host", default=own.embed_host or "http://127.0.0.1:11434")
    sub = p.add_subparsers(dest="command", required=True)
    s = sub.add_parser("search")
    s.add_argument("query", nargs="+", help="one or more queries, searched as one batch")
    s.add_argument("--limit", type=_positive, default=S.DEFAULT_LIMIT)
    s.add_argument("--channels", default=",".join(S.CHANNELS))
    s.add_argument("--full", action="store_true")
    s.add_argument("--context", action="store_true")
    g = sub.add_parser("get")
    g.add_argument("ref")
    r = sub.add_parser("recent")
    r.add_argument("--limit", type=_positive, default=S.DEFAULT_LIMIT)
    x = sub.add_parser("reindex")
    x.add_argument("--workspace", default=own.workspace)
    x.add_argument("--root", action="append", default=own.roots or None)
    x.add_argument("--knowledge", default=own.knowledge)
    x.add_argument("--exclude", action="append", default=own.excludes or None)
    x.add_argument("--full", action="store_true")
    x.add_argument("--allow-empty", action="store_true")
    e = sub.add_parser("eval")
    e.add_argument("judgements", help="YAML file")
    e.add_argument("-k", type=_positive, default=S.DEFAULT_LIMIT)
    e.add_argument("--per-query", action="store_true", help="scores and missed documents of every query")
    a = sub.add_parser("allocate")
    a.add_argument("slug")
    c = sub.add_parser("create")
    c.add_argument("folder", help="folder of the records and their INDEX.md")
    c.add_argument("slug")
    c.add_argument("title")
    c.add_argument("--repo", action="append", default=[])
    c.add_argument("--tag", action="append", default=[])
    sub.add_parser("status").add_argument("--knowledge", default=own.knowledge)
    return p


def _positive(text: str) -> int:
    if (n := int(text)) < 1:
        raise argparse.ArgumentTypeError("must be at least 1")
    return n


def run(argv: list[str], spark) -> object:  # noqa: ANN001
    """The command's result as what JSON can say."""
    a = parser().parse_args(argv)
    embedder = HttpEmbedder(a.embed_model, a.embed_host) if a.embed_model else CharacterEmbedder(a.embed_dim) if a.embed_dim else None
    rows = lambda df: [r.asDict(recursive=True) for r in df.collect()]
    if a.command == "reindex":
        found = discovery.discover(spark, a.workspace, a.root, a.knowledge, a.exclude)
        stats = index.reindex(spark, a.index, discovery.read_files(found), a.knowledge, embedder, a.full, a.allow_empty)
        return {**stats.__dict__, "touched": stats.touched, "fully_embedded": stats.fully_embedded}
    if a.command == "create":
        return {"path": str(records.create(a.folder, a.slug, a.title, time.strftime("%Y-%m-%d"), tuple(a.repo), tuple(a.tag)))}
    if a.command == "status":
        return index.status(spark, a.index, a.knowledge, embedder)
    corpus, _ = index.open_corpus(spark, a.index)
    if a.command == "search":
        queries = spark.createDataFrame([(str(i), q) for i, q in enumerate(a.query)], S.QUERIES)
        result = search(corpus, queries, tuple(a.channels.split(",")), a.limit, embedder=embedder, full=a.full)
        hits = with_context(result, corpus) if a.context else result.hits
        return {"responses": rows(result.responses.orderBy("query_id")), "hits": rows(hits.orderBy("query_id", "position"))}
    if a.command == "get":
        refs = spark.createDataFrame([(response.check_ref(a.ref),)], "ref string")
        return rows(response.get_chunks(refs, corpus.chunks, corpus.documents, corpus.edges))
    if a.command == "recent":
        return rows(response.recent(corpus.chunks, corpus.documents, a.limit))
    if a.command == "allocate":
        from mosslight.functions.text import decision_number

        have = corpus.documents.select(decision_number(F.col("path")).alias("number"), F.regexp_extract("path", r"decisions/\d{4}-([^/]+)\.md$", 1).alias("slug")).where("number is not null")
        return {"number": records.allocate(a.slug, have, have)}
    with open(a.judgements, encoding="utf-8") as f:
        judged = judgements.load(spark, f.read())
    evaluate.validate(judged, corpus.documents)
    arms, by_query = [], {}
    for name, channels in evaluate.ARMS.items():
        result = search(corpus, judged.select("query_id", "query"), channels, a.k, embedder=embedder)
        if result.degraded:
            arms.append({"arm": name, "available": False, "reason": result.degraded, "recall": None, "mrr": None})
            continue
        scored = stage(evaluate.scores(judged, result.hits, a.k), "scores")
        arms += rows(evaluate.arm_summary(name, scored))
        if a.per_query:
            by_query[name] = rows(scored.select("query_id", F.round("recall", 4).alias("recall"), F.round("rr", 4).alias("rr"), "missed").orderBy("query_id"))
    known = {x["arm"]: x for x in arms if x["available"]}
    both = known.get("full"), known.get("lexical+vector")
    delta = {c: round(both[0][c] - both[1][c], 4) for c in ("recall", "mrr")} if all(both) else None
    for x in known.values():
        x.update({c: round(x[c], 4) for c in ("recall", "mrr")})
    return {"k": a.k, "queries": judged.count(), "arms": arms, "graph_delta": delta, **({"per_query": by_query} if a.per_query else {})}


def main() -> int:
    from mosslight.session import local_session
    from mosslight.staging import clear

    spark = local_session()
    try:
        print(json.dumps(run(sys.argv[1:], spark), indent=1, default=str, ensure_ascii=False))
    except (ValueError, RuntimeError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    finally:
        clear(spark)
    return 0


if __name__ == "__main__":
    sys.exit(main())
