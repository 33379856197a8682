"""DuckDB SQL for the derived tables and the channels, as named common table expressions."""

from __future__ import annotations

_PATH = """CASE WHEN doc_id % 10 = 3 THEN source || '/decisions/' || lpad(CAST(doc_id % 10000 AS VARCHAR), 4, '0') || '-rec-' || lpad(CAST(doc_id AS VARCHAR), 8, '0') || '.md'
  WHEN doc_id % 10 = 7 THEN source || '/tasks/' || lpad(CAST(doc_id AS VARCHAR), 8, '0') || '.md'
  ELSE source || '/docs/' || lpad(CAST(doc_id AS VARCHAR), 8, '0') || '.md' END"""

#: name: (names it needs, SQL)
VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "corpus_docs": (
        (),
        f"""SELECT doc_id, source AS repo, {_PATH} AS path,
  CASE WHEN doc_id % 50 = 49 THEN 'Shared Title' ELSE 'Doc ' || CAST(doc_id AS VARCHAR) END AS title,
  CAST(1704067200 + doc_id * 3600 AS DOUBLE) AS mtime,
  CASE WHEN doc_id % 3 = 0 THEN strftime(DATE '2024-01-01' + CAST(doc_id % 400 AS INT), '%Y-%m-%d') END AS decided_on,
  CASE WHEN doc_id % 45 = 0 THEN 'gone-' || CAST(doc_id AS VARCHAR) WHEN doc_id % 20 IN (4, 5, 14, 15, 16, 17) THEN lpad(CAST(doc_id + 1 AS VARCHAR), 8, '0')
    WHEN doc_id % 20 IN (6, 8) THEN lpad(CAST(doc_id - 2 AS VARCHAR), 8, '0') WHEN doc_id % 15 = 0 THEN lpad(CAST(doc_id + 1 AS VARCHAR), 8, '0') END AS superseded_by, text FROM documents""",
    ),
    "doc_kinds": (
        ("corpus_docs",),
        """SELECT *, CASE WHEN name = 'SKILL.md' THEN 'skill'
  WHEN repo = 'src3' AND starts_with(inside, 'decisions/') THEN 'decision' WHEN repo = 'src3' AND starts_with(inside, 'context/') THEN 'context'
  WHEN repo = 'src3' AND starts_with(inside, 'architecture/') THEN 'architecture' WHEN repo = 'src3' AND starts_with(inside, 'gaps/') THEN 'gap'
  WHEN name = 'AGENTS.md' THEN 'agents' WHEN name = 'CLAUDE.md' THEN 'claude' WHEN name = 'README.md' THEN 'readme'
  WHEN regexp_matches(inside, '(^|/)tasks/') THEN 'task' ELSE 'doc' END AS doc_type
FROM (SELECT *, substr(path, length(repo) + 2) AS inside, string_split(path, '/')[-1] AS name FROM corpus_docs)""",
    ),
    "line_rows": (
        ("corpus_docs",),
        "SELECT doc_id, path, unnest(string_split(text, chr(10))) AS body, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS chunk_seq FROM corpus_docs",
    ),
    "chunks": (
        ("line_rows",),
        """SELECT 'c' || substr(sha256(path || chr(0) || heading_path || chr(0) || CAST(ord AS VARCHAR)), 1, 16) AS ref, path, CAST(chunk_seq AS INT) AS chunk_seq, heading_path, body, doc_id
FROM (SELECT *, row_number() OVER (PARTITION BY path, heading_path ORDER BY chunk_seq) - 1 AS ord
  FROM (SELECT *, 'Doc ' || CAST(doc_id AS VARCHAR) || ' > Part ' || CAST(chunk_seq // 4 AS VARCHAR) AS heading_path FROM line_rows WHERE trim(body) <> ''))""",
    ),
    "md_docs": (
        ("corpus_docs",),
        """SELECT doc_id, repo, path, title, superseded_by, concat_ws(chr(10), '# ' || title, '## Links',
  'see [[' || lpad(CAST(doc_id * 7 % 1000 AS VARCHAR), 8, '0') || ']] and [[ ' || lpad(CAST(doc_id + 1 AS VARCHAR), 8, '0') || '|alias]] then [x](../docs/' || lpad(CAST(doc_id + 20 AS VARCHAR), 8, '0') || '.md#top)',
  'Decisions: ' || lpad(CAST(doc_id % 50 * 10 + 3 AS VARCHAR), 4, '0') || ' (why it matters), 0013, and ' || lpad(CAST(doc_id % 7 * 10 + 3 AS VARCHAR), 4, '0'),
  'described in ' || repo || '/docs/' || lpad(CAST(doc_id + 40 AS VARCHAR), 8, '0') || '.md fully',
  CASE WHEN doc_id % 25 = 0 THEN 'itself [[' || regexp_replace(string_split(path, '/')[-1], '\\.md$', '') || ']]' END,
  CASE WHEN doc_id % 30 = 1 THEN 'shared [[Shared Title]]' END,
  'code `[[not-a-link]]` and [spec](https://example.invalid/docs/notes.md)', '```text' || chr(10) || '[[fenced]] decision 0003' || chr(10) || '```', '### Body', text) AS link_text FROM corpus_docs""",
    ),
    "plain": (
        ("md_docs",),
        "SELECT *, regexp_replace(regexp_replace(link_text, '(?s)```.*?```', '', 'g'), '`[^`\\n]*`', ' ', 'g') AS t FROM md_docs",
    ),
    "found_links": (
        ("plain",),
        r"""SELECT path, 'wikilink' AS kind, trim(x) AS target FROM (SELECT path, unnest(regexp_extract_all(t, '\[\[([^\]\[|#]+)(?:[|#][^\]\[]*)?\]\]', 1)) AS x FROM plain)
UNION ALL SELECT path, 'markdown', trim(x) FROM (SELECT path, unnest(regexp_extract_all(t, '\[[^\]]*\]\(([^)\s]+?\.md)(?:#[^)\s]*)?\)', 1)) AS x FROM plain)
UNION ALL SELECT path, 'bare', x FROM (SELECT path, unnest(regexp_extract_all(t, '(?:^|[^\w./-])((?:[A-Za-z0-9._-]+/)+[A-Za-z0-9._-]+\.md)\b', 1)) AS x FROM plain)
UNION ALL SELECT path, 'citation', unnest(regexp_extract_all(x, '\d{4}')) FROM (SELECT path, unnest(regexp_extract_all(t, '(?i)\b(?:ADRs?|decisions?)\b\s*:?\s*(\d{4}\b(?:\s*(?:\([^()]*\))?\s*(?:,\s*and|,|and|/|&)\s*\d{4}\b)*)', 1)) AS x FROM plain)""",
    ),
    "link_targets": (
        ("found_links", "md_docs"),
        r"""SELECT DISTINCT path AS src_path, target, 'links_to' AS relation FROM found_links WHERE target <> '' AND (kind = 'citation' OR NOT regexp_matches(target, '^(?:[A-Za-z][A-Za-z0-9+.-]*:|//)'))
UNION SELECT path, superseded_by, 'superseded_by' FROM md_docs WHERE superseded_by IS NOT NULL""",
    ),
    "doc_keys": (
        ("corpus_docs",),
        """SELECT DISTINCT repo, path, lower(trim(key)) AS key FROM (
  SELECT repo, path, unnest([path, substr(path, length(repo) + 2), string_split(path, '/')[-1], regexp_replace(string_split(path, '/')[-1], '\\.md$', ''), title]) AS key FROM corpus_docs)""",
    ),
    "doc_numbers": (
        ("corpus_docs",),
        r"SELECT repo, path, regexp_extract(path, '(?:^|/)decisions/(\d{4})-[^/]+\.(?i:md)$', 1) AS key FROM corpus_docs WHERE regexp_matches(path, '(?:^|/)decisions/(\d{4})-[^/]+\.(?i:md)$')",
    ),
    "target_rows": (
        ("link_targets", "corpus_docs"),
        r"""SELECT l.*, d.repo AS src_repo, regexp_full_match(target, '\d{4}') AS is_number,
  CASE WHEN starts_with(target, '../docs/') THEN lower(d.repo || substr(target, 3)) END AS relative, lower(target) AS name FROM link_targets l JOIN corpus_docs d ON d.path = l.src_path""",
    ),
    "resolved": (
        ("target_rows", "doc_keys", "doc_numbers"),
        r"""SELECT src_path, target, relation, CASE WHEN outcome = 'edge' THEN dst END AS dst_path, outcome FROM (
 SELECT *, CASE WHEN is_number AND relation <> 'superseded_by' AND regexp_matches(src_path, '(^|/)tasks/') THEN 'work_log' WHEN dst = src_path THEN 'self' WHEN dst IS NOT NULL THEN 'edge' WHEN unclear THEN 'ambiguous' ELSE 'unresolved' END AS outcome FROM (
  SELECT t.*,
   CASE WHEN is_number THEN CASE WHEN no.n IS NOT NULL THEN CASE WHEN no.n = 1 THEN no.p END ELSE CASE WHEN na.n = 1 THEN na.p END END
        WHEN relative IS NOT NULL THEN e.path ELSE coalesce(CASE WHEN ko.n = 1 THEN ko.p END, CASE WHEN ka.n = 1 THEN ka.p END) END AS dst,
   CASE WHEN is_number THEN greatest(coalesce(no.n, 0), coalesce(na.n, 0)) > 1 WHEN relative IS NOT NULL THEN false ELSE greatest(coalesce(ko.n, 0), coalesce(ka.n, 0)) > 1 END AS unclear
  FROM target_rows t
  LEFT JOIN (SELECT repo, key, count(*) AS n, min(path) AS p FROM doc_numbers GROUP BY ALL) no ON t.is_number AND no.repo = t.src_repo AND no.key = t.target
  LEFT JOIN (SELECT key, count(*) AS n, min(path) AS p FROM doc_numbers GROUP BY ALL) na ON t.is_number AND na.key = t.target
  LEFT JOIN (SELECT repo, key, count(*) AS n, min(path) AS p FROM doc_keys GROUP BY ALL) ko ON ko.repo = t.src_repo AND ko.key = t.name
  LEFT JOIN (SELECT key, count(*) AS n, min(path) AS p FROM doc_keys GROUP BY ALL) ka ON ka.key = t.name
  LEFT JOIN (SELECT path FROM corpus_docs) e ON lower(e.path) = t.relative))""",
    ),
    "edges": (("resolved",), "SELECT DISTINCT src_path, dst_path, relation FROM resolved WHERE outcome = 'edge'"),
    "adjacency": (
        ("edges",),
        "SELECT src, dst, max(w) AS weight FROM (SELECT src_path AS src, dst_path AS dst, 1.0::DOUBLE AS w FROM edges UNION ALL SELECT dst_path, src_path, 0.5::DOUBLE FROM edges) GROUP BY src, dst",
    ),
    "shares": (("adjacency",), "SELECT src, dst, weight / sum(weight) OVER (PARTITION BY src) AS share FROM adjacency"),
    "queries": ((), "SELECT item_id AS query_id, text AS query FROM benchmark"),
    "query_words": (("queries",), r"SELECT query_id, w AS term, count(*) AS qtf FROM (SELECT query_id, unnest(regexp_extract_all(lower(query), '[\p{L}\p{N}\p{Co}]+')) AS w FROM queries) GROUP BY ALL"),
    "chunk_terms": (("chunks",), r"SELECT ref, path, chunk_seq, unnest(regexp_extract_all(lower(body || ' ' || heading_path), '[\p{L}\p{N}\p{Co}]+')) AS term FROM chunks"),
    "lengths": (("chunks",), r"SELECT ref, path, chunk_seq, CAST(len(regexp_extract_all(lower(body || ' ' || heading_path), '[\p{L}\p{N}\p{Co}]+')) AS BIGINT) AS dl FROM chunks"),
    "postings": (("chunk_terms",), "SELECT term, ref, count(*) AS tf FROM chunk_terms GROUP BY ALL"),
    "frequencies": (("postings",), "SELECT term, count(*) AS df FROM postings GROUP BY ALL"),
    "stats": (("lengths",), "SELECT count(*) AS n_docs, avg(dl) AS avgdl FROM lengths"),
    "bm25": (
        ("query_words", "postings", "frequencies", "stats"),
        """SELECT query_id, ref, sum(qtf * (CASE WHEN ln((n_docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) <= 0 THEN 1e-6::DOUBLE ELSE ln((n_docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) END)
  * (tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * dl / avgdl)))) AS score
FROM query_words JOIN postings USING (term) JOIN frequencies USING (term) JOIN lengths USING (ref), stats GROUP BY query_id, ref""",
    ),
    "lexical": (
        ("bm25",),
        "SELECT query_id, ref, score, rank FROM (SELECT query_id, ref, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, path, chunk_seq) AS rank FROM bm25 JOIN lengths USING (ref)) WHERE rank <= 50",
    ),
    "vectors": (
        ("chunks",),
        "SELECT ref, path, embedding FROM (SELECT ref, path, doc_id, row_number() OVER (PARTITION BY path ORDER BY chunk_seq) AS n FROM chunks) JOIN embeddings ON vec_id = doc_id WHERE n = 1",
    ),
    "query_vectors": ((), "SELECT item_id AS query_id, embedding FROM benchmark JOIN embeddings ON vec_id = item_id"),
    "vector": (
        ("vectors", "query_vectors"),
        """SELECT query_id, ref, distance, rank FROM (SELECT query_id, ref, distance, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 9), path) AS rank
 FROM (SELECT q.query_id, v.ref, v.path, sqrt(list_sum(list_transform(list_zip(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), lambda x: (x[1] - x[2]) * (x[1] - x[2])))) AS distance FROM vectors v, query_vectors q)) WHERE rank <= 50""",
    ),
    "coverage": (("vectors", "chunks"), "SELECT (SELECT count(*) FROM chunks) AS n_chunks, (SELECT count(*) FROM vectors) AS n_vectors, CASE WHEN (SELECT count(*) FROM chunks) > 0 THEN least(1.0::DOUBLE, (SELECT count(*) FROM vectors)::DOUBLE / (SELECT count(*) FROM chunks)) END AS coverage"),
    "base": (
        ("lexical", "vector"),
        "SELECT query_id, ref, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, ref) AS base_rank FROM (SELECT query_id, ref, sum(1.0::DOUBLE / (60 + rank)) AS score FROM (SELECT query_id, ref, rank FROM lexical UNION ALL SELECT query_id, ref, rank FROM vector) GROUP BY ALL)",
    ),
    "graph_nodes": (("adjacency",), "SELECT DISTINCT src AS path FROM adjacency"),
    "seeds": (("base", "chunks", "graph_nodes"), "SELECT query_id, path AS node, 1.0::DOUBLE / count(*) OVER (PARTITION BY query_id) AS p FROM (SELECT DISTINCT query_id, path FROM base JOIN chunks USING (ref) WHERE base_rank <= 10) JOIN graph_nodes USING (path)"),
    "dated": (
        ("corpus_docs", "edges"),
        """SELECT path, pow(2.0::DOUBLE, -greatest(0, date_diff('day', coalesce(TRY_CAST(decided_on AS DATE), CAST(to_timestamp(mtime) AT TIME ZONE 'UTC' AS DATE)), DATE '2026-01-01'))::DOUBLE / 180.0::DOUBLE) AS recency,
 path IN (SELECT src_path FROM edges WHERE relation = 'superseded_by') AS is_superseded FROM corpus_docs""",
    ),
    "judged": (("corpus_docs",), "SELECT item_id AS query_id, path FROM benchmark JOIN corpus_docs ON contains(corpus_docs.text, benchmark.text)"),
    "sup": (("edges",), "SELECT src_path AS src, dst_path AS dst FROM edges WHERE relation = 'superseded_by'"),
    "walk_forward": (
        ("sup",),
        """SELECT src AS path, dst AS other, 1 AS hop, [src, dst] AS trail FROM sup
 UNION ALL SELECT w.path, s.dst, w.hop + 1, list_append(w.trail, s.dst) FROM walk_forward w JOIN sup s ON s.src = w.other WHERE NOT list_contains(w.trail, s.dst)""",
    ),
    "forward": (("walk_forward",), "SELECT path, other, min(hop) AS hop FROM walk_forward GROUP BY ALL"),
    "walk_back": (
        ("sup", "forward"),
        """SELECT dst AS path, src AS other, 1 AS hop, [dst, src] AS trail FROM sup WHERE NOT EXISTS (SELECT 1 FROM forward f WHERE f.path = sup.dst AND f.other = sup.src)
 UNION ALL SELECT w.path, s.src, w.hop + 1, list_append(w.trail, s.src) FROM walk_back w JOIN sup s ON s.dst = w.other LEFT JOIN forward f ON f.path = w.path AND f.other = s.src WHERE f.path IS NULL AND NOT list_contains(w.trail, s.src)""",
    ),
    "chain": (
        ("forward", "walk_back"),
        """SELECT path, other, relation, hop, row_number() OVER (PARTITION BY path ORDER BY relation, hop, other) AS pos FROM (
 SELECT path, other, 'superseded_by' AS relation, hop FROM forward UNION ALL SELECT path, other, 'supersedes', min(hop) FROM walk_back GROUP BY path, other)""",
    ),
    "near": (
        ("edges",),
        """SELECT path, other, max(relation) AS relation FROM (SELECT src_path AS path, dst_path AS other, 'links_to' AS relation FROM edges WHERE relation = 'links_to'
 UNION ALL SELECT dst_path, src_path, 'linked_from' FROM edges WHERE relation = 'links_to') WHERE path <> other GROUP BY ALL""",
    ),
    "context": (
        ("chain", "near", "corpus_docs"),
        """SELECT a.path, a.n AS pos, a.other, d.title, d.repo, a.relation FROM (SELECT path, other, relation, row_number() OVER (PARTITION BY path ORDER BY tier, pos, other) AS n FROM (
 SELECT path, other, relation, 0 AS tier, pos FROM chain
 UNION ALL SELECT path, other, relation, CASE relation WHEN 'links_to' THEN 1 ELSE 2 END, 0 FROM near WHERE (path, other) NOT IN (SELECT (path, other) FROM chain))) a JOIN corpus_docs d ON d.path = a.other WHERE n <= 8""",
    ),
}

ITERATIONS = 12


for _i in range(1, ITERATIONS + 1):
    _before = "SELECT query_id, node, p AS rank FROM seeds" if _i == 1 else f"SELECT * FROM rank_{_i - 1}"
    VIEWS[f"rank_{_i}"] = (
        ("seeds", "shares") if _i == 1 else (f"rank_{_i - 1}",),
        f"""SELECT query_id, node, sum(m) AS rank FROM (SELECT r.query_id, s.dst AS node, 0.85::DOUBLE * r.rank * s.share AS m FROM ({_before}) r JOIN shares s ON s.src = r.node
  UNION ALL SELECT query_id, node, 0.15::DOUBLE * p FROM seeds) GROUP BY query_id, node""",
    )
VIEWS["ranks"] = ((f"rank_{ITERATIONS}",), f"SELECT * FROM rank_{ITERATIONS}")


def _votes(ranks: str, base: str) -> tuple[tuple[str, ...], str]:
    return (ranks, base, "chunks"), _VOTES.replace("FROM ranks", f"FROM {ranks}").replace("JOIN base b", f"JOIN {base} b")


def _converged(name: str, base: str) -> None:
    """Views of the graph channel over a base ranking: seeds, all iterations, each query's settled ranks, and votes, suffixed with ``name``."""
    VIEWS[f"seeds_{name}"] = ((base, "chunks", "graph_nodes"), VIEWS["seeds"][1].replace("FROM base", f"FROM {base}"))
    VIEWS[f"walk_{name}"] = (
        (f"seeds_{name}", "shares"),
        f"""SELECT query_id, node, p AS rank, 0 AS i FROM seeds_{name}
 UNION ALL SELECT query_id, node, sum(m), max(i) + 1 FROM (SELECT w.query_id, s.dst AS node, 0.85::DOUBLE * w.rank * s.share AS m, w.i FROM walk_{name} w JOIN shares s ON s.src = w.node
  UNION ALL SELECT query_id, node, 0.15::DOUBLE * p, (SELECT max(i) FROM walk_{name}) FROM seeds_{name}) WHERE i < 100 GROUP BY query_id, node""",
    )
    VIEWS[f"steps_{name}"] = ((f"walk_{name}",), f"SELECT * FROM walk_{name}")
    VIEWS[f"gaps_{name}"] = (
        (f"steps_{name}",),
        f"""SELECT query_id, i, sum(abs(gap)) AS gap FROM (SELECT query_id, node, i, sum(r) AS gap FROM (SELECT query_id, node, i, rank AS r FROM steps_{name}
 UNION ALL SELECT query_id, node, i + 1, -rank FROM steps_{name}) GROUP BY ALL) WHERE i BETWEEN 1 AND 100 GROUP BY ALL""",
    )
    VIEWS[f"settled_{name}"] = ((f"gaps_{name}",), f"SELECT query_id, coalesce(min(i) FILTER (gap < 1e-8), 100) AS i FROM gaps_{name} GROUP BY query_id")
    VIEWS[f"ranks_{name}"] = ((f"steps_{name}", f"settled_{name}"), f"SELECT query_id, node, rank FROM steps_{name} JOIN settled_{name} USING (query_id, i)")
    VIEWS[f"votes_{name}"] = _votes(f"ranks_{name}", base)


_VOTES = (
    """SELECT query_id, ref, rank FROM (SELECT query_id, ref, row_number() OVER (PARTITION BY query_id ORDER BY doc_rank, nth) AS rank FROM (
 SELECT d.query_id, c.ref, d.doc_rank, row_number() OVER (PARTITION BY d.query_id, c.path ORDER BY b.base_rank ASC NULLS LAST, c.chunk_seq) AS nth FROM (
  SELECT * FROM (SELECT query_id, node AS path, row_number() OVER (PARTITION BY query_id ORDER BY round(rank, 12) DESC, node) AS doc_rank FROM ranks) WHERE doc_rank <= 50) d
 JOIN chunks c USING (path) LEFT JOIN base b ON b.query_id = d.query_id AND b.ref = c.ref) WHERE nth <= 3) WHERE rank <= 50"""
)
VIEWS["votes"] = _votes("ranks", "base")
VIEWS["base_lexical"] = (("lexical",), "SELECT query_id, ref, 1.0::DOUBLE / (60 + rank) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(1.0::DOUBLE / (60 + rank), 12) DESC, ref) AS base_rank FROM lexical")
_converged("full", "base")
_converged("plain", "base_lexical")


def fused(*parts: tuple[str, str]) -> str:
    """Weighted fusion of rankings, boosts, one chunk a document and the first ten, as a table expression named page."""
    union = " UNION ALL ".join(f"SELECT query_id, ref, {w} / (60 + rank) AS part FROM {name}" for name, w in parts)
    return f"""SELECT query_id, ref, path, is_superseded, boosted, row_number() OVER (PARTITION BY query_id ORDER BY round(boosted, 12) DESC, ref) AS position FROM (
 SELECT *, row_number() OVER (PARTITION BY query_id, path ORDER BY round(boosted, 12) DESC, ref) AS nth FROM (
  SELECT f.query_id, f.ref, c.path, d.is_superseded, f.score * (1 + 0.25::DOUBLE * d.recency) * CASE WHEN d.is_superseded THEN 0.3::DOUBLE ELSE 1.0::DOUBLE END AS boosted
  FROM (SELECT query_id, ref, sum(part) AS score FROM ({union}) GROUP BY ALL) f JOIN chunks c USING (ref) JOIN dated d ON d.path = c.path)) WHERE nth = 1"""


def sql(body: str, *names: str) -> str:
    """``body`` after the CTEs it names and all that these need."""
    order: list[str] = []

    def need(name: str) -> None:
        if name not in order:
            for n in VIEWS[name][0]:
                need(n)
            order.append(name)

    for n in names:
        need(n)
    ctes = ",\n".join(f"{n} AS {'' if n.startswith('walk_') else 'MATERIALIZED '}({VIEWS[n][1]})" for n in order)
    return f"WITH RECURSIVE {ctes}\n{body}" if order else body
