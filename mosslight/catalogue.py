"""All queries of the retrieval engine by name, and the SQL of those that SQL can express.

Each query applies one operator to whole tables. Doubles are rounded to six digits on both
sides, and rankings are compared by position.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mosslight import schema as S
from mosslight.functions import embedding, markdown, text
from mosslight.operators import evaluate, fusion, graph, incremental, lexical, links, records, response, vectors
from mosslight.plans import views
from mosslight.plans.index import lexical_upkeep
from mosslight.plans.oracle_views import ITERATIONS, fused, sql
from mosslight.plans.search import Corpus, search, with_context
from mosslight.sources.discovery import in_scope
from mosslight.staging import generation, modified, stage

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(oracle: str | None = None):  # noqa: ANN201
    """Register a function under its own name."""

    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE_SQL[f.__name__] = oracle
        return f

    return add


def six(*names: str) -> dict[str, F.Column]:
    return {n: F.round(n, 6) for n in names}


# Scans, discovery, classification


@query("SELECT doc_id, CAST(strlen(text) AS VARCHAR) || ':' || sha256(text) AS fingerprint FROM documents")
def scan_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return views.table(spark, d, "documents").select("doc_id", text.fingerprint(F.encode("text", "UTF-8")).alias("fingerprint"))


@query(sql("SELECT repo, path FROM doc_kinds WHERE regexp_matches(inside, '^(docs|decisions)/') OR regexp_matches(inside, '^tasks/[^/]+$')", "doc_kinds"))
def discover_scope(spark: SparkSession, d: str) -> DataFrame:
    docs = views.corpus_docs(spark, d)
    inside = F.substr("path", F.length("repo") + 2)
    return docs.where(in_scope(inside, True)).select("repo", "path")


@query(sql("SELECT path FROM corpus_docs WHERE NOT list_contains(string_split(path, '/'), 'tasks') AND NOT regexp_matches(path, '^src1[^/]*/docs/.*5\\.md$')", "corpus_docs"))
def discover_exclude(spark: SparkSession, d: str) -> DataFrame:
    return views.corpus_docs(spark, d).where(~text.excluded(F.col("path"), ["tasks", "src1*/docs/*5.md"])).select("path")


@query("SELECT doc_id, strlen(text) AS size FROM documents WHERE strlen(text) <= 4000")
def reject_oversize(spark: SparkSession, d: str) -> DataFrame:
    size = F.octet_length("text").cast("long")
    return views.table(spark, d, "documents").where(size <= 4000).select("doc_id", size.alias("size"))


@query(sql("SELECT path, doc_type FROM doc_kinds", "doc_kinds"))
def classify_doc_type(spark: SparkSession, d: str) -> DataFrame:
    return views.documents(spark, d).select("path", "doc_type")


@query(sql("SELECT path, regexp_matches(path, '(^|/)tasks/') AS work_log, nullif(regexp_extract(path, '(?:^|/)decisions/(\\d{4})-[^/]+\\.md$', 1), '') AS number FROM corpus_docs", "corpus_docs"))
def path_facts(spark: SparkSession, d: str) -> DataFrame:
    return views.corpus_docs(spark, d).select("path", text.is_work_log(F.col("path")).alias("work_log"), text.decision_number(F.col("path")).alias("number"))


# Incremental maintenance. The old and the new state of the corpus are both made from the whole table: ids decide which
# documents came, went, changed or were only touched between the two.


def _snapshots(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = views.corpus_docs(spark, d).select("doc_id", "path", "mtime", F.sha2(F.encode("text", "UTF-8"), 256).alias("content_hash"))
    n = F.col("doc_id")
    old = docs.where(n % 11 != 0).select("path", "mtime", "content_hash")
    new = docs.where(n % 13 != 0).select("path", (F.col("mtime") + F.when(n % 4 == 0, 60).otherwise(0)).alias("mtime"), F.when(n % 7 == 0, F.concat(F.lit("x"), "content_hash")).otherwise(F.col("content_hash")).alias("content_hash"))
    return old, new


_DIFF = """SELECT coalesce(o.path, n.path) AS path, CASE WHEN n.path IS NULL THEN 'removed' WHEN o.path IS NULL THEN 'added' WHEN o.h = n.h THEN 'unchanged' ELSE 'changed' END AS status,
 coalesce(o.h = n.h AND o.mtime <> n.mtime, false) AS touched FROM (SELECT path, mtime, sha256(text) AS h FROM corpus_docs WHERE doc_id % 11 <> 0) o
 FULL JOIN (SELECT path, mtime + CASE WHEN doc_id % 4 = 0 THEN 60 ELSE 0 END AS mtime, CASE WHEN doc_id % 7 = 0 THEN 'x' ELSE '' END || sha256(text) AS h FROM corpus_docs WHERE doc_id % 13 <> 0) n ON o.path = n.path"""


@query(sql(_DIFF, "corpus_docs"))
def incremental_diff(spark: SparkSession, d: str) -> DataFrame:
    return incremental.diff(*_snapshots(spark, d)).select("path", "status", "touched")


@query(sql(f"SELECT count(*) FILTER (status = 'added') AS added, count(*) FILTER (status = 'changed') AS changed, count(*) FILTER (status = 'unchanged') AS unchanged, count(*) FILTER (status = 'removed') AS removed, count(*) FILTER (status = 'kept_unreadable') AS kept_unreadable, count(*) FILTER (touched) AS mtime_refreshed FROM ({_DIFF})", "corpus_docs"))
def diff_stats(spark: SparkSession, d: str) -> DataFrame:
    return incremental.counts(incremental.diff(*_snapshots(spark, d)))


@query(sql("SELECT c.ref, c.path FROM chunks c WHERE c.doc_id % 13 <> 0 AND c.doc_id % 11 <> 0 AND c.doc_id % 7 <> 0", "chunks"))
def change_cascade(spark: SparkSession, d: str) -> DataFrame:
    """Chunks that a run keeps: those of documents that were there and are neither changed nor removed."""
    old, new = _snapshots(spark, d)
    stored = views.chunks(spark, d).join(old.select("path"), "path", "left_semi")
    return incremental.replace(stored, incremental.diff(old, new), stored.where(F.lit(False))).select("ref", "path")


@query(sql("SELECT count(*) > 0 AND count(*) FILTER (doc_id % 13 <> 0) = 0 AS refused FROM corpus_docs WHERE doc_id % 11 <> 0", "corpus_docs"))
def empty_guard(spark: SparkSession, d: str) -> DataFrame:
    old, new = _snapshots(spark, d)
    shared = old.join(new.select("path"), "path", "left_semi")
    n = old.agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(shared.agg(F.count(F.lit(1)).alias("shared"))))
    return n.select(((F.col("n") > 0) & (F.col("shared") == 0)).alias("refused"))


@query(sql("SELECT count(*) FILTER (repo = 'src3' AND doc_type = 'decision') + count(*) FILTER (repo = 'src13' AND starts_with(inside, 'decisions/')) AS reclassified FROM doc_kinds", "doc_kinds"))
def reclassify_count(spark: SparkSession, d: str) -> DataFrame:
    changed = incremental.reclassify(views.documents(spark, d), "src13")
    return changed.agg(F.count(F.when(F.col("reclassified"), 1)).alias("reclassified"))


@query(sql("SELECT 'k' || CAST(doc_id AS VARCHAR) AS key, CASE WHEN doc_id % 2 = 0 THEN 'new' ELSE 'old' END AS value FROM corpus_docs WHERE doc_id % 3 = 0 OR doc_id % 2 = 0", "corpus_docs"))
def meta_upsert(spark: SparkSession, d: str) -> DataFrame:
    rows = views.corpus_docs(spark, d).select("doc_id", F.concat(F.lit("k"), F.col("doc_id").cast("string")).alias("key"))
    old = rows.where("doc_id % 3 = 0").select("key", F.lit("old").alias("value"))
    return incremental.upsert(old, rows.where("doc_id % 2 = 0").select("key", F.lit("new").alias("value")))


# Chunks


@query(sql("SELECT ref, path, chunk_seq, heading_path FROM chunks", "chunks"))
def chunk_refs(spark: SparkSession, d: str) -> DataFrame:
    return views.chunks(spark, d).select("ref", "path", "chunk_seq", "heading_path")


@query(
    sql(
        r"""SELECT path, CAST(section AS BIGINT) AS section, CASE section WHEN 0 THEN title WHEN 1 THEN title || ' > Links' ELSE title || ' > Links > Body' END AS heading_path, md5(trim(body, chr(10) || ' ' || chr(9))) AS body_md5 FROM (
 SELECT path, title, unnest([0, 1, 2]) AS section, unnest(['# ' || title, regexp_extract(t, '(?s)(## Links.*?)\n### Body', 1), substr(t, position(chr(10) || '### Body' IN t) + 1)]) AS body
 FROM (SELECT path, title, regexp_replace(link_text, '(?s)```.*?```', '', 'g') AS t FROM md_docs)) WHERE trim(body, chr(10) || ' ' || chr(9)) <> ''""",
        "md_docs",
    )
)
def sections_breadcrumb(spark: SparkSession, d: str) -> DataFrame:
    docs = views.md_docs(spark, d).select("path", "title", F.regexp_replace("link_text", "(?s)```.*?```", "").alias("text"))
    return markdown.sections_sql(docs).select("path", F.col("section").cast("long").alias("section"), "heading_path", F.md5(F.encode("body", "UTF-8")).alias("body_md5"))


@query(
    sql(
        r"""SELECT path, row_number() OVER (PARTITION BY path ORDER BY grp) - 1 AS seq, heading_path, md5(body) AS body_md5 FROM (
 SELECT path, grp, string_agg(body, chr(10) || chr(10) ORDER BY section) AS body, arg_min(heading, CASE WHEN is_head THEN section ELSE 1000 + section END) AS heading_path FROM (
  SELECT *, greatest(1, sum(CAST(is_head AS INT)) OVER (PARTITION BY path ORDER BY section)) AS grp FROM (
   SELECT *, section = first_head OR section > first_head AND length(body) >= 200 AS is_head FROM (
    SELECT *, min(CASE WHEN reached >= 200 THEN section END) OVER (PARTITION BY path) AS first_head FROM (
     SELECT *, sum(length(body) + 2) OVER (PARTITION BY path ORDER BY section) - 2 AS reached FROM (
      SELECT path, section, CASE section WHEN 0 THEN title WHEN 1 THEN title || ' > Links' ELSE title || ' > Links > Body' END AS heading, trim(body, chr(10) || ' ' || chr(9)) AS body FROM (
       SELECT path, title, unnest([0, 1, 2]) AS section, unnest(['# ' || title, regexp_extract(link_text, '(?s)(## Links.*?)\n### Body', 1), substr(link_text, position(chr(10) || '### Body' IN link_text) + 1)]) AS body FROM md_docs)))))) GROUP BY path, grp)""",
        "md_docs",
    )
)
def sections_merged(spark: SparkSession, d: str) -> DataFrame:
    made = markdown.merged_sections(views.md_docs(spark, d).select("path", "title", F.col("link_text").alias("text")))
    return made.select("path", "seq", "heading_path", F.md5(F.encode("body", "UTF-8")).alias("body_md5"))


@query()
def parse_markdown(spark: SparkSession, d: str) -> DataFrame:
    parsed = markdown.parse_documents(views.md_docs(spark, d).select("path", F.col("link_text").alias("text")))
    return parsed.select("path", "title", F.posexplode("chunks").alias("seq", "c")).select("path", "title", "seq", "c.heading_path", F.length("c.body").alias("chars"), text.approx_tokens(F.col("c.body")).alias("tokens"))


@query(sql(r"SELECT ref, CASE WHEN length(s) <= 240 THEN s ELSE rtrim(substr(s, 1, 239)) || '…' END AS snippet, path || '#' || heading_path AS citation FROM (SELECT ref, path, heading_path, trim(regexp_replace(body, '\s+', ' ', 'g')) AS s FROM chunks)", "chunks"))
def snippets(spark: SparkSession, d: str) -> DataFrame:
    return views.chunks(spark, d).select("ref", text.snippet(F.col("body")).alias("snippet"), text.citation(F.col("path"), F.col("heading_path")).alias("citation"))


@query(sql("SELECT ref, md5(heading_path || chr(10) || chr(10) || body) AS text_md5, CAST(ceil(length(body) / 4.0) AS BIGINT) AS tokens FROM chunks", "chunks"))
def embedding_texts(spark: SparkSession, d: str) -> DataFrame:
    """What is embedded of every chunk, and its length in tokens, roughly."""
    c = views.chunks(spark, d)
    made = embedding.chunk_text(c).select("ref", F.md5(F.encode("text", "UTF-8")).alias("text_md5"))
    return made.join(c.select("ref", text.approx_tokens(F.col("body")).alias("tokens")), "ref")


@query("SELECT doc_id, md5(text || chr(65533) || 'x') AS text_md5 FROM documents")
def lenient_decoding(spark: SparkSession, d: str) -> DataFrame:
    """Texts with a stray byte in them, decoded."""
    bad = F.concat(F.encode("text", "UTF-8"), F.lit(bytearray(b"\xffx")))
    return views.table(spark, d, "documents").select("doc_id", F.md5(F.encode(text.decode_lenient(bad), "UTF-8")).alias("text_md5"))


@query("SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN NULL WHEN 1 THEN NULL WHEN 2 THEN NULL WHEN 3 THEN 'null ' || source WHEN 4 THEN source ELSE '0' END AS value FROM documents")
def clean_scalars(spark: SparkSession, d: str) -> DataFrame:
    """Words that stand for nothing become null, whatever their case and the blanks around them."""
    n = F.col("doc_id") % 6
    raw = F.when(n == 0, " NULL ").when(n == 1, " ~").when(n == 2, "None").when(n == 3, F.concat(F.lit(" null "), "source")).when(n == 4, F.concat("source", F.lit("  "))).otherwise("0")
    return views.table(spark, d, "documents").select("doc_id", text.clean_scalar(raw).alias("value"))


# Links


def _links_of(spark: SparkSession, d: str, f) -> DataFrame:  # noqa: ANN001
    docs = views.md_docs(spark, d).select("path", text.strip_code(F.col("link_text")).alias("t"))
    return docs.select("path", F.explode(f(F.col("t"))).alias("target")).groupBy("path", "target").agg(F.count(F.lit(1)).alias("n"))


def _links_sql(kind: str) -> str:
    return sql(f"SELECT path, target, count(*) AS n FROM found_links WHERE kind = '{kind}' GROUP BY ALL", "found_links")


@query(_links_sql("wikilink"))
def links_wikilink(spark: SparkSession, d: str) -> DataFrame:
    return _links_of(spark, d, text.wikilinks)


@query(_links_sql("markdown"))
def links_markdown(spark: SparkSession, d: str) -> DataFrame:
    return _links_of(spark, d, text.markdown_links)


@query(_links_sql("bare"))
def links_bare_path(spark: SparkSession, d: str) -> DataFrame:
    return _links_of(spark, d, text.bare_paths)


@query(_links_sql("citation"))
def links_citation(spark: SparkSession, d: str) -> DataFrame:
    return _links_of(spark, d, text.citations)


@query(sql("SELECT * FROM link_targets", "link_targets"))
def extract_links(spark: SparkSession, d: str) -> DataFrame:
    return views.link_targets(spark, d)


@query(sql("SELECT * FROM doc_keys", "doc_keys"))
def resolution_keys(spark: SparkSession, d: str) -> DataFrame:
    return links.keys(views.corpus_docs(spark, d))


@query(sql("SELECT path, repo || '/docs/' || lpad(CAST(doc_id + 20 AS VARCHAR), 8, '0') || '.md' AS resolved FROM md_docs", "md_docs"))
def relative_paths(spark: SparkSession, d: str) -> DataFrame:
    target = F.concat(F.lit("./.././docs/x/../"), F.lpad((F.col("doc_id") + 20).cast("string"), 8, "0"), F.lit(".md"))
    return views.md_docs(spark, d).select("path", text.resolve_relative(F.col("path"), target).alias("resolved"))


@query(sql("SELECT * FROM resolved", "resolved"))
def resolve_links(spark: SparkSession, d: str) -> DataFrame:
    return views.resolved_links(spark, d)


@query(sql("SELECT count(DISTINCT (src_path, dst_path, relation)) FILTER (outcome = 'edge') AS edges, count(*) FILTER (outcome = 'unresolved') AS unresolved, count(*) FILTER (outcome IN ('self', 'ambiguous')) AS unlinkable, count(*) FILTER (outcome = 'work_log') AS from_work_logs, count(DISTINCT src_path) FILTER (relation = 'superseded_by' AND outcome IN ('self', 'ambiguous', 'unresolved')) AS n_dangling FROM resolved", "resolved"))
def link_outcomes(spark: SparkSession, d: str) -> DataFrame:
    return links.outcomes(views.resolved_links(spark, d))


@query(sql("SELECT DISTINCT src_path AS path FROM resolved WHERE relation = 'superseded_by' AND outcome IN ('self', 'ambiguous', 'unresolved')", "resolved"))
def dangling_supersedence(spark: SparkSession, d: str) -> DataFrame:
    return links.dangling_supersedences(views.resolved_links(spark, d))


@query(sql("SELECT * FROM edges", "edges"))
def link_edges(spark: SparkSession, d: str) -> DataFrame:
    return views.doc_links(spark, d)


# Lexical channel


@query(sql("SELECT ref, count(*) AS n_tokens, count(DISTINCT term) AS n_terms FROM chunk_terms GROUP BY ref", "chunk_terms"))
def tokenize(spark: SparkSession, d: str) -> DataFrame:
    rows = views.chunks(spark, d)
    words = text.tokens(F.concat_ws(" ", "body", "heading_path"))
    return rows.select("ref", F.size(words).cast("long").alias("n_tokens"), F.size(F.array_distinct(words)).cast("long").alias("n_terms"))


@query(sql("SELECT * FROM frequencies", "frequencies"))
def doc_freq(spark: SparkSession, d: str) -> DataFrame:
    return lexical.frequencies(views.lines(spark, d))


@query(sql("SELECT n_docs, round(avgdl, 6) AS avgdl FROM stats", "stats"))
def corpus_stats(spark: SparkSession, d: str) -> DataFrame:
    return lexical.build(views.chunks(spark, d)).stats.withColumns(six("avgdl"))


def _index(spark: SparkSession, d: str, stemmed: bool = False) -> tuple[lexical.LexicalIndex, DataFrame]:
    chunks = stage(views.chunks(spark, d), "chunks")
    return lexical.from_bags(stage(lexical.build(chunks, stemmed).bags, "bags"), stemmed), chunks


@query(sql("SELECT query_id, ref, round(score, 6) AS score, rank FROM lexical", "lexical"))
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    c = corpus(spark, d)
    return lexical.bm25_topk(c.lexical, views.queries(spark, d), c.chunks).select("query_id", "ref", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(sql("SELECT query_id, ref, round(2 * score, 6) AS score FROM bm25", "bm25"))
def bm25_duplicate_terms(spark: SparkSession, d: str) -> DataFrame:
    """Every query twice over: each term counts twice."""
    twice = views.queries(spark, d).select("query_id", F.concat_ws(" ", "query", "query").alias("query"))
    return lexical.bm25(corpus(spark, d).lexical, twice).withColumns(six("score"))


@query(sql("SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS n FROM postings JOIN (SELECT ref, doc_id FROM chunks) USING (ref) WHERE doc_id % 13 <> 0 GROUP BY term", "postings", "chunks"))
def index_upkeep(spark: SparkSession, d: str) -> DataFrame:
    """Postings of unchanged documents carried over, those of changed and new ones made anew, those of removed ones gone."""
    old, new = _snapshots(spark, d)
    chunks, changes = stage(views.chunks(spark, d), "chunks"), stage(incremental.diff(old, new), "changes")
    of = lambda docs: chunks.join(docs.select("path"), "path", "left_semi")
    before = Corpus(old, of(old), lexical.build(of(old)), chunks)
    now = lexical_upkeep(before, of(new), of(incremental.fresh_paths(changes)), changes, False)
    return now.postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("n"))


@query()
def porter_bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    index, chunks = _index(spark, d, stemmed=True)
    return lexical.bm25_topk(index, views.queries(spark, d), chunks).select("query_id", "ref", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


# Vector channel: every vector against the queries whose id is divisible by 100


def _distance_sql(d: str) -> str:
    return f"""SELECT query_id, ref, round(distance, 6) + 0.0::DOUBLE AS distance, rank FROM (SELECT query_id, ref, distance, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 9) + 0.0::DOUBLE, ref) AS rank FROM (
 SELECT q.vec_id AS query_id, v.vec_id AS ref, {d} AS distance FROM embeddings v, (SELECT * FROM embeddings WHERE vec_id % 100 = 0) q)) WHERE rank <= 50"""


_A, _B = "CAST(v.embedding AS DOUBLE[])", "CAST(q.embedding AS DOUBLE[])"


def _knn(spark: SparkSession, d: str, metric: str) -> DataFrame:
    e = views.table(spark, d, "embeddings")
    wanted = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return vectors.knn(e.select(F.col("vec_id").alias("ref"), "embedding"), wanted, metric=metric).select("query_id", "ref", (F.round("distance", 6) + F.lit(0.0)).alias("distance"), F.col("rank").cast("long").alias("rank"))


@query(_distance_sql(f"sqrt(list_sum(list_transform(list_zip({_A}, {_B}), lambda x: (x[1] - x[2]) * (x[1] - x[2]))))"))
def knn_l2_topk(spark: SparkSession, d: str) -> DataFrame:
    return _knn(spark, d, "l2")


@query(_distance_sql(f"1 - list_sum(list_transform(list_zip({_A}, {_B}), lambda x: x[1] * x[2])) / (sqrt(list_sum(list_transform({_A}, lambda x: x * x))) * sqrt(list_sum(list_transform({_B}, lambda x: x * x))))"))
def knn_cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    return _knn(spark, d, "cosine")


@query(sql("SELECT n_chunks, n_vectors, round(coverage, 6) AS coverage FROM coverage", "coverage"))
def vector_coverage(spark: SparkSession, d: str) -> DataFrame:
    return vectors.coverage(views.chunks(spark, d), views.vectors(spark, d)).withColumns(six("coverage"))


@query(sql("SELECT ref FROM chunks WHERE ref NOT IN (SELECT ref FROM vectors)", "chunks", "vectors"))
def missing_vectors(spark: SparkSession, d: str) -> DataFrame:
    return vectors.missing(views.chunks(spark, d), views.vectors(spark, d)).select("ref")


@query(sql("SELECT vec_id FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 3 <> 0)"))
def orphan_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of documents that are gone, a third of all in this state of the corpus."""
    e = views.table(spark, d, "embeddings").select(F.col("vec_id").alias("ref"), "embedding")
    left = views.table(spark, d, "documents").where("doc_id % 3 <> 0").select(F.col("doc_id").alias("ref"))
    return vectors.orphans(left, e).select(F.col("ref").alias("vec_id"))


@query(
    """SELECT item_id, dim, round(CAST(CAST(v / sqrt(sum(v * v) OVER (PARTITION BY item_id)) AS FLOAT) AS DOUBLE), 6) AS value FROM (
 SELECT item_id, (i + unicode(ch)) % 16 AS dim, count(*)::DOUBLE AS v FROM (SELECT item_id, unnest(string_split(text, '')) AS ch, generate_subscripts(string_split(text, ''), 1) - 1 AS i FROM benchmark) GROUP BY ALL)"""
)
def stub_embed(spark: SparkSession, d: str) -> DataFrame:
    made = embedding.embed(views.table(spark, d, "benchmark"), embedding.CharacterEmbedder(16), "item_id", "text")
    return made.select("item_id", F.posexplode("embedding").alias("dim", "value")).where("value <> 0").select("item_id", F.col("dim").cast("long").alias("dim"), F.round(F.col("value").cast("double"), 6).alias("value"))


# Graph channel


@query(sql("SELECT src, dst, weight FROM adjacency", "adjacency"))
def adjacency(spark: SparkSession, d: str) -> DataFrame:
    return graph.adjacency(views.doc_links(spark, d))


@query(sql("SELECT src, dst, round(share, 6) AS share FROM shares", "shares"))
def adjacency_normalized(spark: SparkSession, d: str) -> DataFrame:
    return graph.normalized(graph.adjacency(views.doc_links(spark, d))).withColumns(six("share"))


_CORPORA: dict = {}


def corpus(spark: SparkSession, d: str) -> Corpus:
    """The engine's tables of ``d``, built once a session and kept as work tables until these are cleared or ``d`` changes."""
    stamps = tuple(modified(spark, f"{d}/{name}.parquet") for name in ("documents", "embeddings"))
    key = (spark.sparkContext.applicationId, d, generation(), stamps)
    if key not in _CORPORA or any(modified(spark, path) is None for path in _CORPORA[key].files()):
        _CORPORA.clear()
        _CORPORA[key] = _Tables(spark, d)
    return _CORPORA[key]


class _Tables:
    """A ``Corpus`` whose tables are made when they are first asked for."""

    model, dim = "given", 64

    def __init__(self, spark: SparkSession, d: str):
        self._of = spark, d

    def files(self) -> list[str]:
        """A file of each table that was made."""
        made = (t.bags if isinstance(t, lexical.LexicalIndex) else t for t in vars(self).values() if not isinstance(t, tuple))
        return [t.inputFiles()[0] for t in made]

    @cached_property
    def chunks(self) -> DataFrame:
        return stage(views.chunks(*self._of), "chunks")

    @cached_property
    def lexical(self) -> lexical.LexicalIndex:
        return lexical.from_bags(stage(lexical.build(self.chunks).bags, "bags"), False)

    @cached_property
    def edges(self) -> DataFrame:
        return stage(views.doc_links(*self._of), "edges")

    @cached_property
    def supersedences(self) -> DataFrame:
        if "edges" in vars(self):
            return self.edges.where(F.col("relation") == S.SUPERSEDED_BY)
        return stage(views.supersedences(*self._of), "supersedences")

    @cached_property
    def documents(self) -> DataFrame:
        return stage(views.documents(*self._of), "documents")

    @cached_property
    def vectors(self) -> DataFrame:
        return stage(views.vectors(*self._of, self.chunks), "vectors")


def _base(spark: SparkSession, d: str, c: Corpus) -> DataFrame:
    lists = search(c, views.queries(spark, d), ("lexical", "vector"), query_vectors=views.query_vectors(spark, d)).lists
    return stage(fusion.base_ranking([lists["lexical"], lists["vector"]]), "base")


@query(sql("SELECT query_id, node, round(rank, 6) AS rank FROM ranks", "ranks"))
def ppr_fixed_iter(spark: SparkSession, d: str) -> DataFrame:
    c = corpus(spark, d)
    seeds = graph.seed_documents(_base(spark, d, c), c.chunks)
    return graph.pagerank_fixed(graph.adjacency(c.edges), seeds, ITERATIONS).withColumns(six("rank"))


@query(sql("SELECT query_id, node, round(rank, 6) AS rank FROM ranks_full WHERE rank > 0", "ranks_full"))
def ppr_converged(spark: SparkSession, d: str) -> DataFrame:
    c = corpus(spark, d)
    seeds = graph.seed_documents(_base(spark, d, c), c.chunks)
    return graph.pagerank(graph.adjacency(c.edges), seeds).withColumns(six("rank"))


@query(sql("SELECT query_id, ref, rank FROM votes", "votes"))
def ppr_chunk_votes(spark: SparkSession, d: str) -> DataFrame:
    c = corpus(spark, d)
    base = _base(spark, d, c)
    ranks = graph.pagerank_fixed(graph.adjacency(c.edges), graph.seed_documents(base, c.chunks), ITERATIONS)
    return graph.votes(ranks, base, c.chunks).withColumn("rank", F.col("rank").cast("long"))


@query(sql("SELECT path, other, relation, CAST(hop AS BIGINT) AS hop, pos FROM chain", "chain"))
def supersedence_chain(spark: SparkSession, d: str) -> DataFrame:
    found = graph.supersedence_chain(views.supersedences(spark, d), views.corpus_docs(spark, d))
    return found.select("path", "other", "relation", F.col("hop").cast("long").alias("hop"), F.col("pos").cast("long").alias("pos"))


@query(sql("SELECT * FROM near", "near"))
def neighbours(spark: SparkSession, d: str) -> DataFrame:
    return graph.neighbours(views.doc_links(spark, d), views.corpus_docs(spark, d))


@query(sql("SELECT * FROM context", "context"))
def assembled_context(spark: SparkSession, d: str) -> DataFrame:
    c = views.corpus_docs(spark, d)
    return graph.context(stage(views.doc_links(spark, d), "edges"), c, c).withColumn("pos", F.col("pos").cast("long"))


# Fusion, boosts, pages


@query(sql("SELECT query_id, ref, round(score, 6) AS score, base_rank FROM base", "base"))
def rrf_two(spark: SparkSession, d: str) -> DataFrame:
    return _base(spark, d, corpus(spark, d)).select("query_id", "ref", F.round("score", 6).alias("score"), F.col("base_rank").cast("long").alias("base_rank"))


@query(sql("SELECT query_id, ref, round(sum(part), 6) AS score FROM (SELECT query_id, ref, 1.0::DOUBLE / (60 + rank) AS part FROM lexical UNION ALL SELECT query_id, ref, (SELECT coverage FROM coverage) / (60 + rank) FROM vector) GROUP BY ALL", "lexical", "vector", "coverage"))
def rrf_weighted(spark: SparkSession, d: str) -> DataFrame:
    c = corpus(spark, d)
    lists = search(c, views.queries(spark, d), ("lexical", "vector"), query_vectors=views.query_vectors(spark, d)).lists
    weight = vectors.coverage(c.chunks, c.vectors).first()["coverage"]
    return fusion.rrf({"lexical": (lists["lexical"], 1.0), "vector": (lists["vector"], weight)}).withColumns(six("score"))


@query(sql("SELECT path, round(recency, 6) AS recency FROM dated", "dated"))
def recency_factor(spark: SparkSession, d: str) -> DataFrame:
    docs = views.corpus_docs(spark, d)
    return docs.select("path", F.round(text.recency(F.col("decided_on"), F.col("mtime"), F.lit(views.AS_OF).cast("date")), 6).alias("recency"))


@query(sql("SELECT query_id, ref, round(score * (1 + 0.25::DOUBLE * recency) * CASE WHEN is_superseded THEN 0.3::DOUBLE ELSE 1.0::DOUBLE END, 6) AS boosted, is_superseded FROM bm25 JOIN lengths USING (ref) JOIN dated USING (path)", "bm25", "dated"))
def boosted_scores(spark: SparkSession, d: str) -> DataFrame:
    c = corpus(spark, d)
    facts = fusion.facts(c.documents, c.supersedences, F.lit(views.AS_OF).cast("date"))
    boosts = facts.select("path", fusion.boost(F.lit(1.0)).alias("factor"), "is_superseded")
    scored = lexical.bm25_of_chunks(c.lexical, views.queries(spark, d), of_path=boosts).select("ref", "factor", "is_superseded", F.explode("hits").alias("x"))
    return scored.select("x.query_id", "ref", F.round(F.col("x.score") * F.col("factor"), 6).alias("boosted"), "is_superseded")


def _search(spark: SparkSession, d: str, *channels: str):  # noqa: ANN202
    c = corpus(spark, d)
    return c, search(c, views.queries(spark, d), channels, as_of=F.lit(views.AS_OF).cast("date"), query_vectors=views.query_vectors(spark, d))


def _hits(hits: DataFrame) -> DataFrame:
    return hits.select("query_id", F.col("position").cast("long").alias("position"), "ref", "path", "is_superseded", F.round("score", 6).alias("score"))


def _hits_sql(*parts: tuple[str, str]) -> str:
    return sql(f"SELECT query_id, position, ref, path, is_superseded, round(boosted, 6) AS score FROM ({fused(*parts)}) WHERE position <= 10", *(p[0] for p in parts), "chunks", "dated", "coverage")


_COVERAGE = "(SELECT coverage FROM coverage)"


@query(_hits_sql(("lexical", "1.0::DOUBLE")))
def search_lexical(spark: SparkSession, d: str) -> DataFrame:
    return _hits(_search(spark, d, "lexical")[1].hits)


@query(_hits_sql(("vector", _COVERAGE)))
def search_vector(spark: SparkSession, d: str) -> DataFrame:
    return _hits(_search(spark, d, "vector")[1].hits)


@query(_hits_sql(("lexical", "1.0::DOUBLE"), ("vector", _COVERAGE)))
def search_lexical_vector(spark: SparkSession, d: str) -> DataFrame:
    return _hits(_search(spark, d, "lexical", "vector")[1].hits)


@query(_hits_sql(("lexical", "1.0::DOUBLE"), ("vector", _COVERAGE), ("votes_full", "0.5::DOUBLE")))
def search_full(spark: SparkSession, d: str) -> DataFrame:
    return _hits(_search(spark, d, "lexical", "vector", "graph")[1].hits)


@query(_hits_sql(("lexical", "1.0::DOUBLE"), ("vector", _COVERAGE), ("votes", "0.5::DOUBLE")))
def search_full_fixed_iter(spark: SparkSession, d: str) -> DataFrame:
    """The full search with a fixed number of PageRank iterations."""
    c = corpus(spark, d)
    lists = search(c, views.queries(spark, d), ("lexical", "vector"), query_vectors=views.query_vectors(spark, d)).lists
    base = stage(fusion.base_ranking([lists["lexical"], lists["vector"]]), "base")
    ranks = graph.pagerank_fixed(graph.adjacency(c.edges), graph.seed_documents(base, c.chunks), ITERATIONS)
    weight = vectors.coverage(c.chunks, c.vectors).first()["coverage"]
    all_three = fusion.rrf({"lexical": (lists["lexical"], 1.0), "vector": (lists["vector"], weight), "graph": (graph.votes(ranks, base, c.chunks), 0.5)})
    page = fusion.page(fusion.boosted(all_three, c.chunks, c.documents, c.supersedences, F.lit(views.AS_OF).cast("date")))
    return _hits(response.hits(page, c.chunks, c.documents))


@query(
    sql(
        """SELECT query_id, CASE WHEN l AND v THEN 'lexical+vector' WHEN l THEN 'lexical' WHEN v THEN 'vector' ELSE 'none' END AS mode FROM (
 SELECT item_id AS query_id, item_id IN (SELECT query_id FROM lexical) AS l, item_id IN (SELECT query_id FROM vector) AS v FROM benchmark)""",
        "lexical",
        "vector",
    )
)
def search_mode(spark: SparkSession, d: str) -> DataFrame:
    return _search(spark, d, "lexical", "vector")[1].responses.select("query_id", "mode")


@query(
    sql(
        f"""SELECT p.query_id, p.position, p.ref, p.path, c.assembled FROM ({fused(("lexical", "1.0::DOUBLE"), ("vector", _COVERAGE))}) p
 LEFT JOIN (SELECT path, CAST(to_json(list(struct_pack(title := title, repo := repo, path := other, relation := relation) ORDER BY pos)) AS VARCHAR) AS assembled FROM context GROUP BY path) c USING (path) WHERE position <= 10""",
        "lexical", "vector", "chunks", "dated", "coverage", "context",
    )
)
def search_with_context(spark: SparkSession, d: str) -> DataFrame:
    c, result = _search(spark, d, "lexical", "vector")
    return with_context(result, c).select("query_id", F.col("position").cast("long").alias("position"), "ref", "path", F.to_json("assembled").alias("assembled"))


@query(
    sql(
        """SELECT item_id AS query_id, CASE WHEN l AND v THEN 'lexical+vector' WHEN l THEN 'lexical' WHEN v THEN 'vector' ELSE 'none' END AS mode, CASE WHEN v THEN round((SELECT coverage FROM coverage), 6) END AS vector_coverage FROM (
 SELECT item_id, item_id IN (SELECT query_id FROM lexical) AS l, item_id % 2 = 0 AND item_id IN (SELECT query_id FROM vector) AS v FROM benchmark)""",
        "lexical", "vector", "coverage",
    )
)
def search_responses(spark: SparkSession, d: str) -> DataFrame:
    """Responses where only every other query has a vector."""
    half = views.query_vectors(spark, d).where("query_id % 2 = 0")
    found = search(corpus(spark, d), views.queries(spark, d), ("lexical", "vector"), as_of=F.lit(views.AS_OF).cast("date"), query_vectors=half).responses
    return found.select("query_id", "mode", F.round("vector_coverage", 6).alias("vector_coverage"))


# Responses


@query(sql("SELECT path, path IN (SELECT src_path FROM edges WHERE relation = 'superseded_by') AS is_superseded, superseded_by IS NOT NULL AND path NOT IN (SELECT src_path FROM edges WHERE relation = 'superseded_by') AS supersedence_unresolved FROM corpus_docs", "corpus_docs", "edges"))
def supersedence_states(spark: SparkSession, d: str) -> DataFrame:
    """Current, superseded, or superseded by something that isn't there: of every document, as its hits say it."""
    c = corpus(spark, d)
    first = c.chunks.groupBy("path").agg(F.min_by("ref", "chunk_seq").alias("ref"))
    found = response.get_chunks(first.select("ref"), c.chunks, c.documents, c.supersedences)
    return found.select("path", "is_superseded", "supersedence_unresolved")


@query(
    sql(
        f"""SELECT p.query_id, p.position, p.path || '#' || c.heading_path AS citation, CASE WHEN length(s) <= 240 THEN s ELSE rtrim(substr(s, 1, 239)) || '…' END AS snippet, k.doc_type, k.superseded_by IS NOT NULL AND NOT p.is_superseded AS supersedence_unresolved, round(p.boosted, 6) AS score
 FROM ({fused(("lexical", "1.0::DOUBLE"))}) p JOIN (SELECT ref, heading_path, trim(regexp_replace(body, '\\s+', ' ', 'g')) AS s FROM chunks) c USING (ref) JOIN doc_kinds k ON k.path = p.path WHERE position <= 10""",
        "lexical", "chunks", "dated", "doc_kinds",
    )
)
def hit_payloads(spark: SparkSession, d: str) -> DataFrame:
    """Hits as JSON objects, and what a reader finds in them."""
    packed = response.payload(_search(spark, d, "lexical")[1].hits)
    return packed.select(F.from_json("payload", "query_id long, position long, citation string, snippet string, doc_type string, supersedence_unresolved boolean, score double").alias("x")).select("x.*")


@query(sql("SELECT c.ref, c.path || '#' || c.heading_path AS citation, d.repo, c.body, d.path IN (SELECT src_path FROM edges WHERE relation = 'superseded_by') AS is_superseded FROM chunks c JOIN corpus_docs d ON d.path = c.path", "chunks", "corpus_docs", "edges"))
def get_chunk(spark: SparkSession, d: str) -> DataFrame:
    """Lookups by reference, of all references there are."""
    chunks = stage(views.chunks(spark, d), "chunks")
    found = response.get_chunks(chunks.select("ref"), chunks, views.documents(spark, d), views.supersedences(spark, d))
    return found.select("ref", "citation", "repo", "body", "is_superseded")


@query(sql("SELECT ref, path, CAST(chunk_seq AS BIGINT) AS chunk_seq FROM chunks JOIN (SELECT path, mtime FROM corpus_docs) USING (path) ORDER BY mtime DESC, path, chunk_seq LIMIT 10", "chunks", "corpus_docs"))
def recent_chunks(spark: SparkSession, d: str) -> DataFrame:
    return response.recent(views.chunks(spark, d), views.documents(spark, d)).select("ref", "path", F.col("chunk_seq").cast("long").alias("chunk_seq"))


@query(sql("SELECT path, doc_type, title FROM doc_kinds", "doc_kinds"))
def hit_payload_json(spark: SparkSession, d: str) -> DataFrame:
    """Rows to JSON and back, field by field."""
    packed = response.payload(views.documents(spark, d).select("path", "doc_type", "title"))
    return packed.select(F.from_json("payload", "path string, doc_type string, title string").alias("x")).select("x.*")


# Evaluation, status, allocation


_PARTS = {
    "lexical": (("lexical", "1.0::DOUBLE"),),
    "lexical+graph": (("lexical", "1.0::DOUBLE"), ("votes_plain", "0.5::DOUBLE")),
    "lexical+vector": (("lexical", "1.0::DOUBLE"), ("vector", _COVERAGE)),
    "full": (("lexical", "1.0::DOUBLE"), ("vector", _COVERAGE), ("votes_full", "0.5::DOUBLE")),
}


def _scores_sql(arm: str) -> str:
    """Recall and reciprocal rank of every judged query in one arm."""
    top = f"SELECT query_id, path, min(position) AS position FROM ({fused(*_PARTS[arm])}) WHERE position <= 10 GROUP BY ALL"
    return f"SELECT j.query_id, count(t.position)::DOUBLE / count(*) AS recall, coalesce(1.0::DOUBLE / min(t.position), 0) AS rr FROM judged j LEFT JOIN ({top}) t USING (query_id, path) GROUP BY j.query_id"


_NEEDED = ("lexical", "vector", "votes_plain", "votes_full", "chunks", "dated", "coverage", "judged")
_ARMS = " UNION ALL ".join(f"SELECT '{arm}' AS arm, true AS available, CAST(NULL AS VARCHAR) AS reason, avg(recall) AS recall, avg(rr) AS mrr FROM ({_scores_sql(arm)})" for arm in evaluate.ARMS)


@query(sql(f"SELECT query_id, round(recall, 6) AS recall, round(rr, 6) AS rr FROM ({_scores_sql('lexical')})", "lexical", "chunks", "dated", "judged"))
def eval_recall_mrr(spark: SparkSession, d: str) -> DataFrame:
    _, result = _search(spark, d, "lexical")
    return evaluate.scores(views.judgements(spark, d), result.hits).select("query_id", F.round("recall", 6).alias("recall"), F.round("rr", 6).alias("rr"))


def _arms(spark: SparkSession, d: str) -> DataFrame:
    c = corpus(spark, d)
    judged = stage(views.judgements(spark, d), "judged")
    wanted = stage(views.queries(spark, d).join(judged.select("query_id"), "query_id", "left_semi"), "queries")
    rows, lists = None, {}  # the arms share the rankings of a channel, but for the graph's, whose seeds differ
    for name, channels in evaluate.ARMS.items():
        result = search(c, wanted, channels, as_of=F.lit(views.AS_OF).cast("date"), query_vectors=views.query_vectors(spark, d).join(wanted.select("query_id"), "query_id", "left_semi"), known=lists)
        lists |= result.lists
        if result.degraded:
            row = spark.createDataFrame([evaluate.arm_summary(name, None, result.degraded)], "arm string, available boolean, reason string, recall double, mrr double")
        else:
            row = evaluate.arm_summary(name, evaluate.scores(judged, result.hits))
        rows = row if rows is None else rows.unionByName(row)
    return rows


@query(sql(f"SELECT arm, available, reason, round(recall, 4) AS recall, round(mrr, 4) AS mrr FROM ({_ARMS})", *_NEEDED))
def eval_ablation(spark: SparkSession, d: str) -> DataFrame:
    return _arms(spark, d).withColumns({c: F.round(c, 4) for c in ("recall", "mrr")})


@query(sql(f"SELECT round(f.recall - v.recall, 4) AS recall_delta, round(f.mrr - v.mrr, 4) AS mrr_delta FROM (SELECT * FROM ({_ARMS}) WHERE arm = 'full') f, (SELECT * FROM ({_ARMS}) WHERE arm = 'lexical+vector') v", *_NEEDED))
def graph_delta(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.deltas(_arms(spark, d)).withColumns({c: F.round(c, 4) for c in ("recall_delta", "mrr_delta")})


@query(sql("SELECT query_id, path FROM (SELECT query_id, CASE WHEN query_id % 2 = 0 THEN path ELSE path || '.gone' END AS path FROM judged) WHERE path NOT IN (SELECT path FROM corpus_docs)", "judged", "corpus_docs"))
def judgement_validation(spark: SparkSession, d: str) -> DataFrame:
    changed = F.transform("relevant", lambda p: F.when(F.col("query_id") % 2 == 0, p).otherwise(F.concat(p, F.lit(".gone"))))
    return evaluate.unknown_judgements(views.judgements(spark, d).withColumn("relevant", changed), views.corpus_docs(spark, d))


@query(sql("SELECT (SELECT count(*) FROM corpus_docs) AS documents, n_chunks AS chunks, n_vectors AS vectors, (SELECT count(*) FROM edges) AS edges FROM coverage", "coverage", "edges"))
def status_counts(spark: SparkSession, d: str) -> DataFrame:
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    covered = vectors.coverage(views.chunks(spark, d), views.vectors(spark, d))
    return n(views.corpus_docs(spark, d), "documents").join(F.broadcast(covered)).join(F.broadcast(n(views.doc_links(spark, d), "edges"))).select("documents", F.col("n_chunks").alias("chunks"), F.col("n_vectors").alias("vectors"), "edges")


@query(sql("SELECT lpad(CAST(max(CAST(key AS INT)) + 1 AS VARCHAR), 4, '0') AS number FROM doc_numbers", "doc_numbers"))
def allocate_number(spark: SparkSession, d: str) -> DataFrame:
    docs = views.corpus_docs(spark, d).select("repo", text.decision_number(F.col("path")).alias("number")).where("number is not null")
    return records.next_number(docs.where("repo <> 'src3'"), docs.where("repo = 'src3'"), docs)
