"""The index on storage: immutable snapshots, a pointer, a manifest and incremental runs.

A run writes a new snapshot folder and then moves the pointer, so readers that resolved the
pointer before keep a consistent set of tables, and a failed run leaves the live one as it was.
Locations are local or shared folders; the tables in them are Parquet and go through Spark.
"""

from __future__ import annotations

import fcntl
import json
import os
import time
import uuid
from contextlib import contextmanager
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mosslight import schema as S
from mosslight.functions import embedding
from mosslight.functions.markdown import parse_documents
from mosslight.functions.text import chunk_ref, classify, decode_lenient, fingerprint
from mosslight.operators import incremental, lexical, links, vectors
from mosslight.plans.search import Corpus
from mosslight.staging import stage

POINTER, LOCK = "CURRENT", "LOCK"
TABLES = ("documents", "chunks", "link_targets", "doc_links", "postings", "lengths", "frequencies", "stats", "vectors")


class IndexLocked(RuntimeError):
    """Another run is writing."""


class IndexTooNew(RuntimeError):
    """A newer version of the engine wrote this index."""


class NoIndex(RuntimeError):
    """Nothing has been indexed here."""


@dataclass
class Manifest:
    snapshot: str
    schema_version: int = S.SCHEMA_VERSION
    extractor_version: int = S.EXTRACTOR_VERSION
    knowledge_repo: str | None = None
    embed_model: str | None = None
    embed_dim: int | None = None
    embed_status: str = "disabled"
    last_reindex_at: str = ""
    stemmed: bool = False


@dataclass
class RunStats:
    added: int = 0
    changed: int = 0
    unchanged: int = 0
    removed: int = 0
    kept_unreadable: int = 0
    mtime_refreshed: int = 0
    rejected: int = 0
    reclassified: int = 0
    chunks: int = 0
    vectors: int = 0
    embedded: int = 0
    edges: int = 0
    unresolved: int = 0
    unlinkable: int = 0
    from_work_logs: int = 0
    dangling_supersedences: list[str] = field(default_factory=list)
    rebuilt: bool = False

    @property
    def touched(self) -> int:
        return self.added + self.changed + self.removed

    @property
    def fully_embedded(self) -> bool:
        return self.vectors >= self.chunks


@contextmanager
def writer_lock(root: str):  # noqa: ANN201
    """Held for a run; a second writer is refused at once and not made to wait.

    The lock is the operating system's on an open file, so it ends with its process, however that
    ends. The file stays: one that is deleted could be locked by two.
    """
    os.makedirs(root, exist_ok=True)
    path = os.path.join(root, LOCK)
    with open(path, "a", encoding="utf-8") as f:
        try:
            fcntl.flock(f, fcntl.LOCK_EX | fcntl.LOCK_NB)
        except BlockingIOError:
            raise IndexLocked(f"another run holds {path}") from None
        yield


def read_manifest(root: str) -> Manifest | None:
    """The live manifest; None if there is none or it can't be read as one."""
    try:
        with open(os.path.join(root, POINTER), encoding="utf-8") as f:
            raw = json.load(f)
        known = {k: v for k, v in raw.items() if k in Manifest.__dataclass_fields__}
        found = Manifest(**known)
    except (OSError, ValueError, TypeError):
        return None
    if found.schema_version > S.SCHEMA_VERSION:
        raise IndexTooNew(f"the index has schema version {found.schema_version}; this engine reads up to {S.SCHEMA_VERSION}")
    return found


def write_manifest(root: str, manifest: Manifest) -> None:
    temporary = os.path.join(root, f".{POINTER}.{uuid.uuid4().hex}")
    with open(temporary, "w", encoding="utf-8") as f:
        json.dump(asdict(manifest), f, indent=1)
    os.replace(temporary, os.path.join(root, POINTER))


def open_corpus(spark: SparkSession, root: str) -> tuple[Corpus, Manifest]:
    """The tables of the live snapshot, resolved once."""
    manifest = read_manifest(root)
    if manifest is None:
        raise NoIndex(f"there is no index at {root}")
    if manifest.schema_version < S.SCHEMA_VERSION:
        raise NoIndex(f"the index at {root} is of an older version; reindex first")
    t = {name: spark.read.parquet(os.path.join(root, manifest.snapshot, name)) for name in TABLES}
    index = lexical.LexicalIndex(t["postings"], t["lengths"], t["frequencies"], t["stats"], manifest.stemmed)
    return Corpus(t["documents"], t["chunks"], index, t["doc_links"], t["vectors"], manifest.embed_model, manifest.embed_dim), manifest


def number_chunks(parsed: DataFrame) -> DataFrame:
    """``ref, path, chunk_seq, heading_path, body`` from parsed documents.

    A reference counts earlier chunks of the same heading in the same document, so it outlasts
    edits of the body.
    """
    rows = parsed.select("path", F.posexplode("chunks").alias("chunk_seq", "c")).select("path", "chunk_seq", "c.heading_path", "c.body")
    return with_refs(rows)


def with_refs(rows: DataFrame) -> DataFrame:
    ordinal = F.row_number().over(Window.partitionBy("path", "heading_path").orderBy("chunk_seq")) - 1
    return numbered(rows.withColumn("nth", ordinal))


def numbered(rows: DataFrame) -> DataFrame:
    """Chunks with references; ``nth`` counts those of the same path and heading before a row."""
    return rows.withColumn("ref", chunk_ref(F.col("path"), F.col("heading_path"), F.col("nth"))).select("ref", "path", F.col("chunk_seq").cast("int").alias("chunk_seq"), "heading_path", "body")


def _current_vectors(old: Corpus, chunks: DataFrame, changes: DataFrame) -> DataFrame:
    """Stored vectors that still hold: of chunks that exist, in documents that haven't changed.

    A reference outlasts an edit of the text, so it alone doesn't say that a vector holds.
    """
    stale = old.chunks.select("ref", "path").join(incremental.stale_paths(changes), "path", "left_semi")
    return old.vectors.join(chunks.select("ref"), "ref", "left_semi").join(stale.select("ref"), "ref", "left_anti")


def lexical_upkeep(old: Corpus | None, chunks: DataFrame, new_chunks: DataFrame, changes: DataFrame, stemmed: bool) -> lexical.LexicalIndex:
    """The inverted index of ``chunks``; only new chunks are tokenised, postings of unchanged documents are carried over."""
    if old is None:
        return lexical.build(chunks, stemmed)
    fresh = lexical.build(new_chunks, stemmed)
    stale = stage(old.chunks.select("ref", "path").join(incremental.stale_paths(changes), "path", "left_semi").select("ref"), "stale_refs")
    kept = lambda table: table.join(stale, "ref", "left_anti")
    if old.lexical.bags is not None:
        return lexical.from_bags(kept(old.lexical.bags).unionByName(fresh.bags), stemmed)
    return lexical.from_tables(kept(old.lexical.postings).unionByName(fresh.postings), kept(old.lexical.lengths).unionByName(fresh.lengths), stemmed)


def must_rebuild(manifest: Manifest | None, full: bool, stemmed: bool, embedder: embedding.Embedder | None) -> bool:
    if full or manifest is None or manifest.schema_version != S.SCHEMA_VERSION or manifest.extractor_version != S.EXTRACTOR_VERSION or manifest.stemmed != stemmed:
        return True
    return embedder is not None and manifest.embed_model is not None and (manifest.embed_model, manifest.embed_dim) != (embedder.model, embedder.dim) and embedder.probe()


def reindex(spark: SparkSession, root: str, files: DataFrame, knowledge: str | None = None, embedder: embedding.Embedder | None = None, full: bool = False, allow_empty: bool = False, stemmed: bool = True, max_bytes: int = S.MAX_DOCUMENT_BYTES) -> RunStats:
    """Bring the index at ``root`` up to date with ``files`` (``repo, path, mtime, size, is_symlink, content``).

    Only added and changed documents are parsed. Links are resolved anew for all, as a new
    document can make an old link unambiguous or ambiguous. The empty-corpus guard and the lock
    come before anything is written.
    """
    with writer_lock(root):
        manifest = read_manifest(root)
        rebuild = must_rebuild(manifest, full, stemmed, embedder)
        hashed = stage(files.select("repo", "path", "mtime", F.when((F.col("size") > max_bytes) | F.col("is_symlink"), "rejected").when(F.col("content").isNull(), "unreadable").otherwise("ok").alias("status"), fingerprint(F.col("content")).alias("content_hash")), "scan")
        old = None
        if manifest is not None and manifest.schema_version == S.SCHEMA_VERSION:
            old, _ = open_corpus(spark, root)
            incremental.guard(old.documents, hashed.where("status <> 'rejected'"), allow_empty)
        keep = old is not None and not rebuild
        empty = spark.createDataFrame([], S.DOCUMENTS)
        changes = stage(incremental.diff(old.documents if keep else empty, hashed), "changes")

        fresh = files.join(incremental.fresh_paths(changes), "path", "left_semi")
        texts = fresh.select("path", decode_lenient(F.col("content")).alias("text"))
        parsed = stage(parse_documents(texts), "parsed")
        facts = hashed.where("status = 'ok'").select("path", "repo", "mtime", "content_hash")
        new_docs = parsed.join(facts, "path").select("repo", "path", "title", classify(F.col("repo"), F.col("path"), knowledge).alias("doc_type"), "mtime", "content_hash", "decided_on", "superseded_by", "tags")
        new_chunks = stage(number_chunks(parsed), "new_chunks")
        new_targets = links.extract(parsed)

        def merged(table: DataFrame | None, new: DataFrame, path_col: str = "path") -> DataFrame:
            return incremental.replace(table, changes, new, path_col) if keep else new

        times = changes.where("touched").select("path", F.col("mtime").alias("new_mtime"))
        documents = merged(old.documents if keep else None, new_docs).join(times, "path", "left").withColumn("mtime", F.coalesce("new_mtime", "mtime")).drop("new_mtime")
        judged = incremental.reclassify(documents, knowledge)
        snapshot = f"snapshot-{uuid.uuid4().hex}"
        base = os.path.join(root, snapshot)

        def save(name: str, df: DataFrame) -> DataFrame:
            df.write.parquet(os.path.join(base, name))
            return spark.read.schema(df.schema).parquet(os.path.join(base, name))

        counted = stage(judged, "documents")
        documents = save("documents", counted.drop("reclassified").select(*[c.split()[0] for c in S.DOCUMENTS.split(", ")]))
        chunks = save("chunks", merged(old.chunks if keep else None, new_chunks))
        old_targets = spark.read.parquet(os.path.join(root, manifest.snapshot, "link_targets")) if keep else None
        targets = save("link_targets", merged(old_targets, new_targets, "src_path"))
        resolved = stage(links.resolve(targets, documents), "resolved")
        save("doc_links", links.edges(resolved))

        index = lexical_upkeep(old if keep else None, chunks, new_chunks, changes, stemmed)
        postings = save("postings", index.postings.repartitionByRange("term").sortWithinPartitions("term"))
        index = lexical.from_tables(postings, save("lengths", index.lengths), stemmed)
        save("frequencies", index.frequencies)
        save("stats", index.stats)

        embedded, status = 0, "disabled"
        kept = _current_vectors(old, chunks, changes) if keep and old.vectors is not None and (embedder is None or manifest.embed_model == embedder.model) else spark.createDataFrame([], S.VECTORS)
        if embedder is not None:
            status = "ready" if embedder.probe() else "unavailable"
            if status == "ready":
                todo = vectors.missing(chunks, kept)
                fresh_vectors = stage(embedding.embed(embedding.chunk_text(todo), embedder, strict=False, also=("path", "chunk_seq")), "embedded")
                embedded = fresh_vectors.count()
                kept = kept.unionByName(fresh_vectors)
        saved = save("vectors", kept)

        n, out = incremental.counts(changes).first(), links.outcomes(resolved).first()
        stats = RunStats(
            **{k: n[k] for k in ("added", "changed", "unchanged", "removed", "kept_unreadable", "mtime_refreshed")},
            rejected=hashed.where("status = 'rejected'").count(),
            reclassified=counted.join(changes.where("status = 'unchanged'"), "path", "left_semi").where("reclassified").count(),
            chunks=chunks.count(),
            vectors=saved.count(),
            embedded=embedded,
            **{k: out[k] for k in ("edges", "unresolved", "unlinkable", "from_work_logs")},
            dangling_supersedences=[r[0] for r in links.dangling_supersedences(resolved).orderBy("path").limit(100).collect()],
            rebuilt=rebuild,
        )
        reached = status == "ready"
        write_manifest(
            root,
            Manifest(
                snapshot=snapshot,
                knowledge_repo=knowledge or "",
                embed_model=embedder.model if reached else (manifest.embed_model if keep else None),
                embed_dim=embedder.dim if reached else (manifest.embed_dim if keep else None),
                embed_status=status,
                last_reindex_at=time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime()),
                stemmed=stemmed,
            ),
        )
        return stats


def status(spark: SparkSession, root: str, knowledge: str | None = None, embedder: embedding.Embedder | None = None) -> dict:
    """Counts, coverage and reasons why the index should be brought up to date."""
    corpus, manifest = open_corpus(spark, root)
    row = vectors.coverage(corpus.chunks, corpus.vectors).first()
    reasons = []
    if embedder is not None and manifest.embed_model and manifest.embed_model != embedder.model:
        reasons.append(f"vectors are from {manifest.embed_model}, queries from {embedder.model}")
    if embedder is not None and manifest.embed_dim and embedder.probe() and embedder.dim != manifest.embed_dim:
        reasons.append(f"vectors are {manifest.embed_dim} wide, those of {embedder.model} are {embedder.dim}")
    if row["coverage"] is not None and row["coverage"] < 1 and manifest.embed_status != "disabled":
        reasons.append("some chunks have no vector")
    if (manifest.knowledge_repo or None) != (knowledge or None):
        reasons.append("the knowledge repo has changed")
    by_type = {r[0]: r[1] for r in corpus.documents.groupBy("doc_type").count().collect()}
    return {**asdict(manifest), "documents": sum(by_type.values()), "doc_types": by_type, "chunks": row["n_chunks"], "vectors": row["n_vectors"], "vector_coverage": row["coverage"], "edges": corpus.edges.count(), "stale": reasons}
