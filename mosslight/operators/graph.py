"""The graph channel: adjacency, Personalized PageRank, chunk votes and document context."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from mosslight import schema as S
from mosslight.operators.vectors import load_files
from mosslight.staging import stage

#: Bytes of arrays up to which a task may hold the whole graph; beyond it ranks are joined and aggregated.
LOCAL_BYTES = 1 << 30
EDGE_BYTES, NODE_BYTES = 16, 80
#: Rows up to which a table of paths may be sent to all tasks, by way of the driver. Work tables are compressed, so the planner takes large ones for small.
SENT_ROWS = 1 << 14
#: Edges whose shares are moved at once, so that they stay in the cache.
EDGE_BLOCK = 1 << 15


def adjacency(edges: DataFrame) -> DataFrame:
    """``src, dst, weight``: links forward with weight 1, backward with 0.5 unless a link goes that way too."""
    forward = edges.select(F.col("src_path").alias("src"), F.col("dst_path").alias("dst"), F.lit(1.0).alias("w"))
    backward = edges.select(F.col("dst_path").alias("src"), F.col("src_path").alias("dst"), F.lit(S.REVERSE_WEIGHT).alias("w"))
    return forward.unionByName(backward).groupBy("src", "dst").agg(F.max("w").alias("weight"))


def normalized(adj: DataFrame) -> DataFrame:
    """``src, dst, share``: weights of a node's edges as shares. A hub's total is aggregated and joined back."""
    totals = adj.groupBy("src").agg(F.sum("weight").alias("total"))
    return adj.join(totals, "src").select("src", "dst", (F.col("weight") / F.col("total")).alias("share"))


def restart(seeds: DataFrame, adj: DataFrame) -> DataFrame:
    """``query_id, node, p``: an even share for each seed (``query_id, path``) that is in the graph."""
    nodes = adj.select(F.explode(F.array("src", "dst")).alias("path")).distinct()
    present = seeds.select("query_id", "path").distinct().join(nodes, "path")
    n = present.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    return present.join(n, "query_id").select("query_id", F.col("path").alias("node"), (1 / F.col("n")).alias("p"))


def _step(rank: DataFrame, share: DataFrame, start: DataFrame, damping: float, loose: DataFrame | None = None) -> DataFrame:
    """One iteration of ``query_id, node, rank``; mass at nodes without edges (``loose``) returns to the query's seeds."""
    moved = rank.join(share, F.col("node") == F.col("src")).select("query_id", F.col("dst").alias("node"), (damping * F.col("rank") * F.col("share")).alias("m"))
    parts = moved.unionByName(start.select("query_id", "node", ((1 - damping) * F.col("p")).alias("m")))
    if loose is not None:
        lost = rank.join(loose, "node").groupBy("query_id").agg(F.sum("rank").alias("lost"))
        parts = parts.unionByName(start.join(lost, "query_id").select("query_id", "node", (damping * F.col("lost") * F.col("p")).alias("m")))
    return parts.groupBy("query_id", "node").agg(F.sum("m").alias("rank"))


def pagerank_fixed(adj: DataFrame, seeds: DataFrame, iterations: int, damping: float = S.DAMPING, cut_every: int = 5, local_bytes: int = LOCAL_BYTES) -> DataFrame:
    """``query_id, node, rank`` after a number of iterations.

    For graphs in which each edge has its reverse, so that no mass is lost at a node without
    edges. A graph that fits a task is worked off there, query by query, as in ``pagerank``. Ranks
    in tables are written out every few iterations, which keeps the plan short and a lost executor cheap.
    """
    adj = stage(adj, "adjacency")
    nodes = numbered_nodes(adj)
    if _fits(adj, nodes, local_bytes):
        return _pagerank_local(adj, nodes, seeds, damping, 0.0, iterations, None, 12)
    share, start = stage(normalized(adj), "shares"), stage(restart(seeds, adj), "restart")
    rank = start.withColumnRenamed("p", "rank")
    for i in range(1, iterations + 1):
        rank = _step(rank, share, start, damping)
        if i % cut_every == 0 and i < iterations:
            rank = stage(rank, "rank")
    return rank


def power_iteration(adj: dict, seeds: list, damping: float = S.DAMPING, tolerance: float = S.TOLERANCE, iterations: int = S.MAX_ITERATIONS) -> dict:
    """Ranks on a small graph ``{node: {node: weight}}``; a node without edges returns its mass to the seeds."""
    nodes = sorted(adj)
    at = {n: i for i, n in enumerate(nodes)}
    mine = sorted({s for s in seeds if s in at})
    if not mine:
        return {}
    flat = [(at[a], at[b], w) for a in nodes for b, w in adj[a].items() if b in at]
    src, dst, w = (np.array(x) for x in zip(*flat, strict=True)) if flat else (np.empty(0, int), np.empty(0, int), np.empty(0))
    p = np.zeros(len(nodes))
    p[[at[s] for s in mine]] = 1 / len(mine)
    total = np.bincount(src, weights=w, minlength=len(nodes))
    return dict(zip(nodes, Walk(src, dst, w / total[src], len(nodes)).rank(p, damping, tolerance, iterations).tolist(), strict=True))


class Walk:
    """A graph as arrays in the order of edges' ends; power iteration for one query at a time, a block of edges after the other."""

    def __init__(self, src: np.ndarray, dst: np.ndarray, share: np.ndarray, n: int):
        if (dst[1:] < dst[:-1]).any():
            order = np.lexsort((src, dst))
            src, dst, share = src[order], dst[order], share[order]
        self._n, self._src, self._share = n, src, share
        bare = np.ones(n, bool)
        bare[src] = False
        self._loose = np.flatnonzero(bare)
        first = np.flatnonzero(np.concatenate([np.ones(min(1, len(dst)), bool), dst[1:] != dst[:-1]]))
        ends, cuts = dst[first], np.unique(np.searchsorted(first, np.arange(0, len(dst), EDGE_BLOCK)))
        bounds = [*first[cuts[cuts < len(first)]].tolist(), len(dst)]
        self._blocks = []
        for a, z in zip(bounds, bounds[1:], strict=False):
            i, j = np.searchsorted(first, (a, z))
            self._blocks.append((a, z, ends[i:j], first[i:j] - a))

    def rank(self, p: np.ndarray, damping: float, tolerance: float, iterations: int) -> np.ndarray:
        """Ranks from the restart vector ``p``, until they move by less than ``tolerance`` in sum."""
        now = p
        for _ in range(iterations):
            new = np.zeros(self._n)
            for a, z, ends, first in self._blocks:
                moved = now[self._src[a:z].astype(np.intp)]
                moved *= self._share[a:z]
                new[ends] = np.add.reduceat(moved, first)
            new += now[self._loose].sum() * p
            new *= damping
            new += (1 - damping) * p
            gap, now = np.abs(new - now).sum(), new
            if gap < tolerance:
                break
        return now


def numbered_nodes(adj: DataFrame) -> DataFrame:
    """``node, id``, a stored table: nodes numbered in their order, range by range."""
    nodes = stage(adj.select(F.explode(F.array("src", "dst")).alias("node")).distinct(), "nodes")
    ranges = nodes.repartitionByRange("node").sortWithinPartitions("node")
    ranges = stage(ranges.select("node", F.spark_partition_id().alias("range"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("nth")), "ranges")
    before = F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    starts = ranges.groupBy("range").agg(F.count(F.lit(1)).alias("n")).select("range", F.coalesce(before, F.lit(0)).alias("start"))
    return stage(ranges.join(starts, "range").select("node", (F.col("start") + F.col("nth")).alias("id")), "numbered")


def _best(ranks: DataFrame, top: int | None, digits: int) -> DataFrame:
    if top is None:
        return ranks
    by = Window.partitionBy("query_id").orderBy(F.round("rank", digits).desc(), "node")
    return ranks.withColumn("nth", F.row_number().over(by)).where(F.col("nth") <= top).drop("nth")


def pagerank(
    adj: DataFrame, seeds: DataFrame, damping: float = S.DAMPING, tolerance: float = S.TOLERANCE, iterations: int = S.MAX_ITERATIONS, top: int | None = None, digits: int = 12, local_bytes: int = LOCAL_BYTES
) -> DataFrame:
    """``query_id, node, rank`` (positive ranks) for every query, to convergence; with ``top``, each query's best nodes only.

    A query is done once its ranks move by less than ``tolerance`` in sum, and keeps them from
    then on. The bytes of the graph's arrays decide how it is worked off, not what comes out: one
    that fits is read by every task as numbers and the queries are dealt out; a larger one is
    iterated as tables, all queries at once. Best nodes are by rank rounded to ``digits``, then by name.
    """
    adj = stage(adj, "adjacency")
    nodes = numbered_nodes(adj)
    if not _fits(adj, nodes, local_bytes):
        return _best(_pagerank_tables(adj, seeds, damping, tolerance, iterations).where("rank > 0"), top, digits)
    return _pagerank_local(adj, nodes, seeds, damping, tolerance, iterations, top, digits)


def _fits(adj: DataFrame, nodes: DataFrame, local_bytes: int) -> bool:
    return EDGE_BYTES * adj.count() + NODE_BYTES * nodes.count() <= local_bytes


def _pagerank_tables(adj: DataFrame, seeds: DataFrame, damping: float, tolerance: float, iterations: int) -> DataFrame:
    share, start = stage(normalized(adj), "shares"), stage(restart(seeds, adj), "restart")
    loose = stage(adj.select(F.col("dst").alias("node")).distinct().join(adj.select(F.col("src").alias("node")).distinct(), "node", "left_anti"), "loose")
    loose = None if loose.isEmpty() else loose
    rank, done = start.withColumnRenamed("p", "rank"), []
    for _ in range(iterations):
        new = stage(_step(rank, share, start, damping, loose), "rank")
        both = rank.select("query_id", "node", (-F.col("rank")).alias("r")).unionByName(new.select("query_id", "node", F.col("rank").alias("r")))
        gaps = both.groupBy("query_id", "node").agg(F.abs(F.sum("r")).alias("gap")).groupBy("query_id").agg(F.sum("gap").alias("gap"))
        settled = stage(gaps.where(F.col("gap") < tolerance).select("query_id"), "settled")
        rank = new
        if not settled.isEmpty():
            done.append(stage(new.join(settled, "query_id", "left_semi"), "done"))
            rank, start = stage(new.join(settled, "query_id", "left_anti"), "rank"), stage(start.join(settled, "query_id", "left_anti"), "restart")
            if start.isEmpty():
                break
    return reduce(DataFrame.unionByName, done, rank)


def _pagerank_local(adj: DataFrame, nodes: DataFrame, seeds: DataFrame, damping: float, tolerance: float, iterations: int, top: int | None, digits: int) -> DataFrame:
    """Tasks read the graph's arrays, of a checked size, and the nodes' names from work tables, none of it through the driver."""
    spark, n = adj.sparkSession, nodes.count()
    ends = normalized(adj).join(nodes.select(F.col("node").alias("src"), F.col("id").alias("a")), "src").join(nodes.select(F.col("node").alias("dst"), F.col("id").alias("b")), "dst")
    edges = stage(ends.select(F.col("a").cast("int"), F.col("b").cast("int"), "share").repartitionByRange("b").sortWithinPartitions("b", "a"), "numbered_edges")
    edge_files, node_files = edges.inputFiles(), nodes.inputFiles()
    present = seeds.select("query_id", F.col("path").alias("node")).distinct().join(nodes, "node")
    per_query = present.groupBy("query_id").agg(F.sort_array(F.collect_list("id")).alias("seeds"))
    per_query = per_query.repartition(4 * spark.sparkContext.defaultParallelism, "query_id")  # few rows of much work: not to be merged by size
    kind, id_type = seeds.schema["query_id"].dataType.simpleString(), to_arrow_type(seeds.schema["query_id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk = None
        for b in batches:
            for query_id, mine in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if walk is None:
                    walk = Walk(*(load_files(edge_files, [c]).column(c).to_numpy() for c in ("a", "b", "share")), n)
                    named = load_files(node_files)
                    names = named.column("node").take(pa.array(np.argsort(named.column("id").to_numpy()))).combine_chunks()
                    del named
                p = np.zeros(n)
                p[mine] = 1 / len(mine)
                rank = walk.rank(p, damping, tolerance, iterations)
                at = np.flatnonzero(rank > 0)
                if top is not None:
                    rounded = np.round(rank[at], digits)
                    if len(at) > top:
                        few = rounded >= np.partition(rounded, len(at) - top)[len(at) - top]
                        at, rounded = at[few], rounded[few]
                    at = at[np.lexsort((at, -rounded))[:top]]
                for i in range(0, len(at), 1 << 16):
                    some = at[i : i + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array([query_id] * len(some), id_type), names.take(pa.array(some)), pa.array(rank[some])], names=["query_id", "node", "rank"])

    return per_query.mapInArrow(run, f"query_id {kind}, node string, rank double")


def seed_documents(base: DataFrame, chunks: DataFrame) -> DataFrame:
    """``query_id, path``: the documents behind the first chunks of the base ranking (``query_id, ref, base_rank``)."""
    return base.where(F.col("base_rank") <= S.SEED_CHUNKS).join(chunks.select("ref", "path"), "ref").select("query_id", "path").distinct()


def votes(ranks: DataFrame, base: DataFrame, chunks: DataFrame, limit: int = S.POOL, digits: int = 12) -> DataFrame:
    """``query_id, ref, rank``: chunks of documents by rank, a few of each; candidates of the base ranking first.

    Only the ``limit`` best documents of a query can give votes, so the others are dropped
    before chunks are joined.
    """
    by_rank = Window.partitionBy("query_id").orderBy(F.round("rank", digits).desc(), "node")
    docs = ranks.withColumn("doc_rank", F.row_number().over(by_rank)).where(F.col("doc_rank") <= limit).select("query_id", F.col("node").alias("path"), "doc_rank")
    rows = docs.join(chunks.select("ref", "path", "chunk_seq"), "path").join(base.select("query_id", "ref", "base_rank"), ["query_id", "ref"], "left")
    in_doc = Window.partitionBy("query_id", "path").orderBy(F.col("base_rank").asc_nulls_last(), "chunk_seq")
    few = rows.withColumn("nth", F.row_number().over(in_doc)).where(F.col("nth") <= S.CHUNKS_PER_DOC)
    over = Window.partitionBy("query_id").orderBy("doc_rank", "nth")
    return few.withColumn("rank", F.row_number().over(over)).where(F.col("rank") <= limit).select("query_id", "ref", "rank")


def supersedence_chain(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """``path, other, relation, hop, pos``: what supersedes each start, then what it supersedes, however far.

    A frontier that walks the edges hop by hop; a document that was seen from the same start
    isn't visited again, so cycles end. What was seen is written out every ten hops, so plans
    stay short. Forward hops come first. Where both sides have many rows, they are dealt out by key, so that
    no hop sends a table of the corpus's size through the driver.
    """
    links = stage(edges.where(F.col("relation") == S.SUPERSEDED_BY).select("src_path", "dst_path").distinct(), "supersedences")
    dealt = lambda rows, *n: rows.hint("merge") if min(n) > SENT_ROWS else rows
    n_links, tied = links.count(), links.select(F.explode(F.array("src_path", "dst_path")).alias("path")).distinct()
    paths = starts.select("path").distinct().join(dealt(tied, n_links), "path", "left_semi")  # others have no chain
    seen = stage(paths.select("path", F.col("path").alias("other"), F.lit(None).cast("string").alias("relation"), F.lit(0).alias("hop")), "seen")
    n_seen = seen.count()
    for src, dst, relation in (("src_path", "dst_path", S.SUPERSEDED_BY), ("dst_path", "src_path", S.SUPERSEDES)):
        front = seen.where("hop = 0").select("path", F.col("other").alias("at"))
        n_front = front.count()
        for hop in count(1):
            step = front.join(dealt(links, n_links, n_front), F.col("at") == F.col(src)).select("path", F.col(dst).alias("other")).distinct()
            fresh = stage(step.join(dealt(seen.select("path", "other"), n_seen), ["path", "other"], "left_anti").withColumns({"relation": F.lit(relation), "hop": F.lit(hop)}), "hop")
            n_front = fresh.count()
            if not n_front:
                break
            n_seen += n_front
            seen = seen.unionByName(fresh) if hop % 10 else stage(seen.unionByName(fresh), "seen")
            front = fresh.select("path", F.col("other").alias("at"))
    forward = F.when(F.col("relation") == S.SUPERSEDED_BY, 0).otherwise(1)
    by = Window.partitionBy("path").orderBy(forward, "hop", "other")
    return seen.where("hop > 0").withColumn("pos", F.row_number().over(by))


def neighbours(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """``path, other, relation``: linked documents of each start, those it links to before those that link to it."""
    links = edges.where(F.col("relation") == S.LINKS_TO)
    paths = starts.select("path").distinct()
    out = links.join(paths, F.col("src_path") == F.col("path")).select("path", F.col("dst_path").alias("other"), F.lit(S.LINKS_TO).alias("relation"))
    into = links.join(paths, F.col("dst_path") == F.col("path")).select("path", F.col("src_path").alias("other"), F.lit(S.LINKED_FROM).alias("relation"))
    return out.unionByName(into).where("path <> other").groupBy("path", "other").agg(F.max("relation").alias("relation"))


def context(edges: DataFrame, starts: DataFrame, documents: DataFrame, cap: int = S.CONTEXT_ITEMS) -> DataFrame:
    """``path, pos, other, title, repo, relation``: up to ``cap`` references around each start, supersedences first.

    The cap counts before titles are looked up.
    """
    chain = supersedence_chain(edges, starts).select("path", "other", "relation", F.lit(0).alias("tier"), "pos")
    near = neighbours(edges, starts).join(chain.select("path", "other").hint("merge"), ["path", "other"], "left_anti")
    near = near.select("path", "other", "relation", F.when(F.col("relation") == S.LINKS_TO, 1).otherwise(2).alias("tier"), F.lit(0).alias("pos"))
    by = Window.partitionBy("path").orderBy("tier", "pos", "other")
    capped = chain.unionByName(near).withColumn("pos", F.row_number().over(by)).where(F.col("pos") <= cap)
    info = documents.select(F.col("path").alias("other"), "title", "repo").hint("merge")
    return capped.join(info, "other").select("path", "pos", "other", "title", "repo", "relation")


def assembled(items: DataFrame) -> DataFrame:
    """``path, assembled``: the context of each start as an array in order."""
    entry = F.struct("pos", "title", "repo", F.col("other").alias("path"), "relation")
    ordered = F.transform(F.array_sort(F.collect_list(entry)), lambda x: x.dropFields("pos"))
    return items.groupBy(F.col("path").alias("start")).agg(ordered.alias("assembled")).withColumnRenamed("start", "path")
