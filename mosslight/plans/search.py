"""Batch search: all queries at once through the channels, fusion, boosts and the page."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mosslight import schema as S
from mosslight.functions.embedding import Embedder, EmbeddingError, embed
from mosslight.operators import fusion, graph, lexical, response, vectors
from mosslight.staging import stage


@dataclass
class Corpus:
    """The tables of one snapshot. ``vectors`` (with each chunk's ``path`` and ``chunk_seq``) may be None; ``model`` and ``dim`` say what made them."""

    documents: DataFrame
    chunks: DataFrame
    lexical: lexical.LexicalIndex
    edges: DataFrame
    vectors: DataFrame | None = None
    model: str | None = None
    dim: int | None = None

    @property
    def supersedences(self) -> DataFrame:
        """The ``superseded_by`` edges, all that boosts and states read; a corpus may have them apart from ``edges``."""
        return self.edges.where(F.col("relation") == S.SUPERSEDED_BY)


@dataclass
class SearchResult:
    """``hits`` with a row for each position, ``responses`` with a row for each query, and the channels' rankings.

    The page is made when ``hits`` is first asked for; rankings and responses don't wait for it.
    """

    find: Callable[[], DataFrame]
    responses: DataFrame
    lists: dict[str, DataFrame] = field(default_factory=dict)
    degraded: str | None = None

    @cached_property
    def hits(self) -> DataFrame:
        return self.find()


def check_channels(channels: tuple[str, ...]) -> tuple[str, ...]:
    if unknown := [c for c in channels if c not in S.CHANNELS]:
        raise ValueError(f"unknown channels {unknown}; there are {', '.join(S.CHANNELS)}")
    return tuple(c for c in S.CHANNELS if c in channels)


def _vector_list(corpus: Corpus, queries: DataFrame, embedder: Embedder | None, query_vectors: DataFrame | None, pool: int) -> tuple[DataFrame | None, str | None]:
    """The channel's ranking, or why there is none."""
    known = corpus.vectors is not None and not corpus.vectors.isEmpty()
    model = embedder.model if embedder else corpus.model
    width = embedder.dim if embedder else corpus.dim
    why = vectors.degradation(True, True, "some", corpus.vectors is not None, int(known), corpus.model, model, width, corpus.dim)
    if why:
        return None, why
    if query_vectors is None:
        if embedder is None:
            return None, "no embedder for the queries"
        try:
            if not embedder.probe():
                return None, "the embedder can't be reached"
            query_vectors = stage(embed(queries.where(F.trim("query") != ""), embedder, "query_id", "query"), "query_vectors")
        except (EmbeddingError, OSError) as e:
            return None, f"embedding the queries failed: {e}"
    # ties go by document order, as in the lexical channel; the index keeps it beside each vector, so no vector is shuffled
    place = F.concat_ws("\x01", "path", F.lpad(F.col("chunk_seq").cast("string"), 9, "0"), "ref").alias("place")
    near = vectors.knn(corpus.vectors.select(place, "embedding"), query_vectors, pool, key="place")
    return near.select("query_id", F.substring_index("place", "\x01", -1).alias("ref"), "distance", "rank"), None


def search(
    corpus: Corpus,
    queries: DataFrame,
    channels: tuple[str, ...] = S.CHANNELS,
    limit: int = S.DEFAULT_LIMIT,
    as_of: Column | None = None,
    embedder: Embedder | None = None,
    query_vectors: DataFrame | None = None,
    pool: int = S.POOL,
    full: bool = False,
    known: dict[str, DataFrame] | None = None,
) -> SearchResult:
    """Search for every row of ``queries`` (``query_id, query``); ``known`` has rankings that an earlier search of the same batch gave.

    Rankings carry ids only and are cut to ``pool`` before they are fused; they are small work
    tables, so each channel runs once though seeds, fusion and modes all read it. Bodies and
    context are joined to the page.
    """
    wanted = check_channels(channels)
    as_of = F.current_date() if as_of is None else as_of
    lists: dict[str, DataFrame] = {c: x for c, x in (known or {}).items() if c in wanted and c != "graph"}
    degraded = None
    if "lexical" in wanted and "lexical" not in lists:
        lists["lexical"] = stage(lexical.bm25_topk(corpus.lexical, queries, corpus.chunks, pool).select("query_id", "ref", "rank"), "lexical")
    if "vector" in wanted and "vector" not in lists:
        found, degraded = _vector_list(corpus, queries, embedder, query_vectors, pool)
        if found is not None:
            lists["vector"] = stage(found.select("query_id", "ref", "rank"), "vector")
    lists = {c: lists[c] for c in wanted if c in lists}
    weights: dict[str, Column | float] = {"lexical": 1.0, "graph": S.GRAPH_WEIGHT}
    covered = None
    if "vector" in lists:
        covered = vectors.coverage(corpus.chunks, corpus.vectors).first()["coverage"]
        weights["vector"] = 1.0 if covered is None else float(covered)
    if "graph" in wanted and lists:
        base = stage(fusion.base_ranking(list(lists.values())), "base")
        seeds = stage(graph.seed_documents(base, corpus.chunks), "seeds")
        ranks = graph.pagerank(graph.adjacency(corpus.edges), seeds, top=pool)
        lists["graph"] = stage(graph.votes(ranks, base, corpus.chunks, pool), "graph")
    responses = fusion.modes(queries, lists, wanted)
    used = F.array_contains("channels_used", "vector")
    responses = responses.withColumn("vector_coverage", F.when(used, F.lit(covered).cast("double"))).withColumn("degraded", F.lit(degraded).cast("string"))
    if lists:
        fused = fusion.rrf({name: (ranking, weights[name]) for name, ranking in lists.items()})
    else:
        fused = queries.select("query_id", F.lit("").alias("ref"), F.lit(0.0).alias("score")).where(F.lit(False))

    def find() -> DataFrame:
        scored = fusion.boosted(stage(fused, "fused"), corpus.chunks, corpus.documents, corpus.supersedences, as_of)
        page = stage(fusion.page(scored, limit), "page")
        return response.hits(page, corpus.chunks, corpus.documents, full)

    return SearchResult(find, responses, lists, degraded)


def search_one(corpus: Corpus, query: str, **options) -> SearchResult:  # noqa: ANN003
    """A batch of one query."""
    return search(corpus, corpus.documents.sparkSession.createDataFrame([("0", query)], S.QUERIES), **options)


def with_context(result: SearchResult, corpus: Corpus, cap: int = S.CONTEXT_ITEMS) -> DataFrame:
    """Hits with ``assembled``: the references around each hit's document."""
    items = graph.context(corpus.edges, result.hits.select("path").distinct(), corpus.documents, cap)
    return result.hits.join(graph.assembled(items), "path", "left")
