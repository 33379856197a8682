"""The vector channel: exact nearest neighbours for a batch of queries, coverage and upkeep."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from heapq import merge, nsmallest
from itertools import islice
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mosslight import schema as S
from mosslight.staging import stage

#: Query vectors a task holds at a time; a larger batch of queries is worked off in groups, one scan of the vectors each.
QUERY_GROUP = 16_384
#: Query vectors in one matrix product.
BLOCK = 64
#: A bound of the rounding error of the quick product, as a share of the squared lengths, in which candidates are measured exactly.
ROUGH = 1e-12


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def knn(vectors: DataFrame, queries: DataFrame, k: int = S.POOL, metric: str = "l2", key: str = "ref", digits: int = 9, group: int = QUERY_GROUP) -> DataFrame:
    """``query_id, key, distance, rank``: for each query the k nearest of all vectors, exactly; ties by ``key``.

    The stated queries' vectors are written to a work table in groups of a bounded size, and each
    task reads a group from there, so none pass through the driver. Every batch of vectors meets
    the group in matrix products, and a task keeps a running k best for each query: what is
    shuffled is k rows a query and task. ``vectors`` has ``key`` and ``embedding``; ``queries`` has
    ``query_id`` and ``embedding``; rows without an embedding are left out, and under the cosine
    metric those of length zero.
    """
    if metric not in ("l2", "cosine"):
        raise ValueError(f"unknown metric {metric!r}")
    kind = vectors.schema[key].dataType.simpleString()
    id_kind = queries.schema["query_id"].dataType.simpleString()
    asked = stage(queries.where("embedding is not null").select("query_id", "embedding"), "query_vectors")
    groups = max(1, -(-asked.count() // group))
    dealt, parts = F.pmod(F.xxhash64("query_id"), F.lit(groups)), []
    for g in sorted(r[0] for r in asked.select(dealt.alias("g")).distinct().collect()):
        mine = asked if groups == 1 else stage(asked.where(dealt == g), "query_group")
        parts.append(vectors.select(F.col(key), "embedding").mapInArrow(_nearest(mine.inputFiles(), k, metric, key, digits), f"query_id {id_kind}, `{key}` {kind}, distance double"))
    if not parts:
        return vectors.sparkSession.createDataFrame([], f"query_id {id_kind}, `{key}` {kind}, distance double, rank int")
    by = Window.partitionBy("query_id").orderBy(F.round("distance", digits), key)
    return reduce(DataFrame.unionByName, parts).withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def load_files(files: list[str], columns: list[str] | None = None) -> pa.Table:
    """The rows of Parquet files in the folder that the cluster shares, in the order of their names."""
    def one(uri: str) -> pa.Table:
        if uri.startswith(("file:", "/")):
            return pq.read_table("/" + unquote(uri.removeprefix("file:")).lstrip("/"), partitioning=None, columns=columns)
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(uri)
        return pq.read_table(path, filesystem=system, partitioning=None, columns=columns)

    return pa.concat_tables([one(f) for f in sorted(files)])


def _matrix(column: pa.Array, dim: int | None) -> np.ndarray:
    """Arrays of one width as rows of a matrix; another width than ``dim`` raises."""
    widths = np.unique(np.asarray(column.value_lengths()))
    if len(widths) > 1 or dim is not None and (widths != dim).any():
        raise ValueError(f"vectors of width {widths.tolist()} against queries of width {dim}")
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1)


def _exact(q: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    """Distances of one query, from differences and not from the expanded square."""
    if metric == "l2":
        return np.sqrt(((x - q) ** 2).sum(axis=1))
    return 1 - (x * q).sum(axis=1) / (np.linalg.norm(q) * np.linalg.norm(x, axis=1))


class _Best:
    """The k best of every query so far: rounded distance, key and distance, in order."""

    def __init__(self, n: int, k: int, digits: int):
        self._k, self._digits = k, digits
        self.rows: list[list[tuple]] = [[] for _ in range(n)]
        self.worst = np.full(n, np.inf)

    def offer(self, i: int, distances: np.ndarray, keys: list) -> None:
        rounded = np.round(distances, self._digits)
        if len(rounded) > self._k:
            limit = np.partition(rounded, self._k - 1)[self._k - 1]
            few = np.flatnonzero(rounded <= limit)
        else:
            few = np.arange(len(rounded))
        new = nsmallest(self._k, ((rounded[j], keys[j], distances[j]) for j in few.tolist()), key=lambda r: r[:2])
        self.rows[i] = list(islice(merge(self.rows[i], new, key=lambda r: r[:2]), self._k))
        if len(self.rows[i]) == self._k:
            self.worst[i] = self.rows[i][-1][0] + 10.0**-self._digits


def _nearest(files: list[str], k: int, metric: str, key: str, digits: int):  # noqa: ANN202
    """A task's own k nearest for each query of the files.

    A quick product orders a batch's vectors up to a bound of its rounding error; all within that
    bound of the k-th, and no farther than the k best so far, are measured exactly.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = (b.filter(b.column(1).is_valid()) for b in batches)
        found, key_type = None, None
        for b in batches:
            if not b.num_rows:
                continue
            if found is None:
                table = load_files(files).combine_chunks()
                q = _matrix(table.column("embedding").combine_chunks(), None)
                found, key_type, q2 = _Best(len(q), k, digits), b.schema.field(0).type, (q * q).sum(1)
            x = _matrix(b.column(1), q.shape[1])
            keys, x2 = b.column(0).to_pylist(), (x * x).sum(1)
            for a in range(0, len(q), BLOCK):
                dots = q[a : a + BLOCK] @ x.T
                if metric == "l2":
                    rough = np.maximum(0, x2 + q2[a : a + BLOCK, None] - 2 * dots)
                    slack = ROUGH * (x2.max() + q2[a : a + BLOCK])
                    far = found.worst[a : a + BLOCK] ** 2
                else:
                    with np.errstate(divide="ignore", invalid="ignore"):
                        rough = np.nan_to_num(1 - dots / np.sqrt(x2 * q2[a : a + BLOCK, None]), nan=np.inf)
                    slack, far = np.full(len(dots), ROUGH * q.shape[1]), found.worst[a : a + BLOCK]
                if x.shape[0] > k:  # rounded distances tie within a unit of the last digit
                    kth = np.partition(rough, k - 1, axis=1)[:, k - 1]
                    kth = (np.sqrt(kth + slack) + 10.0**-digits) ** 2 if metric == "l2" else kth + 10.0**-digits
                    far = np.minimum(far, kth)
                for i, near in enumerate(rough <= (far + 2 * slack)[:, None]):
                    at = np.flatnonzero(near & np.isfinite(rough[i]))
                    if len(at):
                        found.offer(a + i, _exact(q[a + i], x[at], metric), [keys[j] for j in at.tolist()])
        if found is None:
            return
        ids = table.column("query_id").combine_chunks()
        for a in range(0, len(q), 4096):
            rows = [(a + i, *r[1:]) for i, x in enumerate(found.rows[a : a + 4096]) for r in x]
            who, which, distance = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(who)), pa.array(which, key_type), pa.array(distance, pa.float64())], names=["query_id", key, "distance"])

    return run


def coverage(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """``n_chunks, n_vectors, coverage``: at most 1, null without chunks."""
    n = chunks.agg(F.count(F.lit(1)).alias("n_chunks")).join(F.broadcast(vectors.agg(F.count(F.lit(1)).alias("n_vectors"))))
    return n.withColumn("coverage", F.when(F.col("n_chunks") > 0, F.least(F.lit(1.0), F.col("n_vectors") / F.col("n_chunks"))))


def missing(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Chunks that have no vector yet."""
    return chunks.join(vectors.select("ref"), "ref", "left_anti")


def orphans(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Vectors whose chunk is gone."""
    return vectors.join(chunks.select("ref"), "ref", "left_anti")


def degradation(requested: bool, supported: bool, query: str, has_table: bool, n_vectors: int, stored_model: str | None, model: str | None, width: int | None, dim: int | None) -> str | None:
    """Why the vector channel cannot run, checked in this order; None if it can or isn't wanted."""
    if not requested:
        return None
    if not supported:
        return "vector search is not supported here"
    if not query.strip():
        return None
    if not has_table:
        return "the index has no vectors table"
    if not n_vectors:
        return "the index has no vectors yet"
    if stored_model and model and stored_model != model:
        return f"vectors are from {stored_model}, queries from {model}"
    if width is not None and dim is not None and width != dim:
        return f"vectors are {dim} wide, the query's is {width}"
    return None
