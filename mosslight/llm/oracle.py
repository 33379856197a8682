"""DuckDB SQL of the training-data queries that SQL can express over whole tables."""

from __future__ import annotations

from mosslight.llm.license_scan import PHRASES, SHARE, TEMPLATES, postings
from mosslight.llm.quality_rules import Limits

_SEP = r"[^\x20\x09-\x0D]+"
_L = Limits()

_QUALITY = f"""
WITH words AS MATERIALIZED (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_SEP}') AS w FROM documents),
tokens AS MATERIALIZED (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM words),
windows AS (SELECT doc_id, i, word || ' ' || lead(word) OVER d || ' ' || lead(word, 2) OVER d AS win FROM tokens WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM windows WHERE win IS NOT NULL) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM again) GROUP BY doc_id),
line_rows AS (SELECT doc_id, line FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents) WHERE regexp_matches(line, '{_SEP}')),
lines AS (SELECT doc_id, count(*) AS n, count(*) - count(DISTINCT line) AS d FROM line_rows GROUP BY doc_id),
stats AS MATERIALIZED (
 SELECT t.doc_id, t.source, CAST(len(w.w) AS BIGINT) AS n_words, CAST(length(array_to_string(w.w, '')) AS BIGINT) AS word_chars,
  CAST(length(coalesce(t.text, '')) - length(regexp_replace(coalesce(t.text, ''), '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  coalesce(l.n, 0) AS n_lines, coalesce(l.d, 0) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words
 FROM documents t JOIN words w USING (doc_id) LEFT JOIN lines l USING (doc_id) LEFT JOIN covered c USING (doc_id)),
judged AS MATERIALIZED (SELECT *, n_words < {_L.min_words} OR 100 * n_repeat_words > {_L.repeat} * n_words AS base_failed,
  100 * n_symbols > {_L.symbols} * word_chars OR 100 * n_dup_lines > {_L.dup_lines} * n_lines OR word_chars < {_L.min_mean_word} * n_words OR word_chars > {_L.max_mean_word} * n_words AS failed,
  100 * n_symbols > {_L.strict_symbols} * word_chars OR 100 * n_dup_lines > {_L.strict_dup_lines} * n_lines OR 100 * n_repeat_words > {_L.strict_repeat} * n_words AS borderline FROM stats),
hosts AS MATERIALIZED (SELECT source, count(*) AS n, count(*) FILTER (base_failed OR failed) AS k FROM judged GROUP BY source),
sums AS (SELECT sum(n)::DOUBLE AS n, sum(k)::DOUBLE AS k, count(*)::DOUBLE AS h, sum((n * n)::DOUBLE) AS nn, sum(k::DOUBLE * k / n) AS kk FROM hosts),
fit AS (SELECT p, (kk - n * p * p - p * (1 - p) * (h - 1)) AS excess, p * (1 - p) * (n - nn / n - (h - 1)) AS room FROM (SELECT *, k / n AS p FROM sums)),
prior AS (SELECT p * w AS alpha, (1 - p) * w AS beta FROM (SELECT p, CASE WHEN room > 0 AND excess / room > 0 THEN least(10000.0::DOUBLE, greatest(2.0::DOUBLE, room / excess - 1)) ELSE 10000.0::DOUBLE END AS w FROM fit)),
rates AS (SELECT source, n AS host_docs, k AS host_failures, (k + alpha) / (n + (alpha + beta)) AS rate FROM hosts, prior)
SELECT j.doc_id, j.n_words, j.word_chars, j.n_symbols, j.n_dup_lines, j.n_repeat_words, j.base_failed, NOT base_failed AND NOT failed AND NOT (rate >= {_L.suspect_rate} AND borderline) AS kept,
 j.source, r.host_docs, r.host_failures, round(r.rate, 6) AS host_rate FROM judged j JOIN rates r ON r.source IS NOT DISTINCT FROM j.source
"""

_LINES = """
WITH numbered AS MATERIALIZED (SELECT doc_id, pos, trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS line, raw FROM (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)),
filled AS MATERIALIZED (SELECT doc_id, pos, line, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k FROM numbered WHERE line <> ''),
windows AS MATERIALIZED (SELECT * FROM (SELECT doc_id, k, line AS a, lead(line) OVER d AS b, lead(line, 2) OVER d AS c FROM filled WINDOW d AS (PARTITION BY doc_id ORDER BY k)) WHERE c IS NOT NULL),
later AS (SELECT doc_id, k FROM (SELECT doc_id, k, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, k) AS nth FROM windows) WHERE nth > 1),
gone AS MATERIALIZED (SELECT DISTINCT doc_id, unnest([k, k + 1, k + 2]) AS k FROM later),
gone_at AS MATERIALIZED (SELECT doc_id, pos FROM gone JOIN filled USING (doc_id, k)),
kept AS (SELECT n.doc_id, string_agg(n.raw, chr(10) ORDER BY n.pos) AS text FROM numbered n LEFT JOIN gone_at g ON g.doc_id = n.doc_id AND g.pos = n.pos WHERE g.pos IS NULL GROUP BY n.doc_id)
SELECT d.doc_id, coalesce(f.n, 0) AS n_lines, coalesce(g.n, 0) AS n_removed, CASE WHEN d.text IS NOT NULL THEN md5(coalesce(kept.text, '')) END AS text_md5 FROM documents d
LEFT JOIN (SELECT doc_id, count(*) AS n FROM filled GROUP BY doc_id) f USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id) g USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


def _license_sql() -> str:
    table = postings()
    size = {t: sum(p[1] == t for p in table) for t in range(len(TEMPLATES))}
    keys = {t: sum(p[1] == t and p[3] for p in table) for t in range(len(TEMPLATES))}
    entries = ", ".join(f"('{w}', {t}, {o}, {str(k).lower()}, {size[t]}, {keys[t]}, '{TEMPLATES[t].label}')" for w, t, o, k in table)
    vocabulary = ", ".join(f"'{w}'" for w in sorted({p[0] for p in table} | {"cc", "general", "rights"}))
    phrases = " UNION ALL ".join(
        "SELECT t0.doc_id, t0.i AS pos, '" + label + "' AS label FROM tokens t0 " + " ".join(f"JOIN tokens t{j} ON t{j}.doc_id = t0.doc_id AND t{j}.i = t0.i + {j} AND t{j}.word = '{w}'" for j, w in enumerate(p.split()) if j) + f" WHERE t0.word = '{p.split()[0]}'"
        for p, label in PHRASES.items()
    )
    return rf"""
WITH words AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
tokens AS MATERIALIZED (SELECT doc_id, word, i - 1 AS i FROM (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM words)),
places AS MATERIALIZED ({phrases}),
base AS (SELECT doc_id, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, list(DISTINCT label) AS labels FROM places GROUP BY doc_id),
postings(word, template, off, is_key, size, keys, label) AS (VALUES {entries}),
found AS MATERIALIZED (SELECT doc_id, word, i FROM tokens WHERE word IN ({vocabulary})),
met AS (SELECT doc_id, template, start, size, keys, label, count(*) AS n, count(*) FILTER (is_key) AS n_keys
 FROM (SELECT f.doc_id, f.i - p.off AS start, p.* FROM found f JOIN postings p USING (word)) GROUP BY ALL),
verified AS (SELECT doc_id, list(DISTINCT label) AS labels, max(n::DOUBLE / size) AS share FROM met WHERE n_keys = keys AND n::DOUBLE / size >= {SHARE} GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(array_to_string(list_sort(b.labels), ','), '') AS base_labels,
 coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(v.labels, [])))), ','), '') AS labels,
 round(greatest(coalesce(share, 0), CASE WHEN n_base > 0 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END), 6) AS score FROM words w LEFT JOIN base b USING (doc_id) LEFT JOIN verified v USING (doc_id)
"""


_PAGES = """
WITH hashed AS MATERIALIZED (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
bits AS (SELECT page_id, string_agg(substr('0000000100100011010001010110011110001001101010111100110111101111', 4 * (position(substr(hex, CAST(i AS INT), 1) IN '0123456789abcdef') - 1) + 1, 4), '' ORDER BY i) AS b FROM hashed, range(1, 41) r(i) GROUP BY page_id),
digests AS (SELECT page_id, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(16 * CAST(substr(b, CAST(5 * j + 1 AS INT), 1) AS INT) + 8 * CAST(substr(b, CAST(5 * j + 2 AS INT), 1) AS INT) + 4 * CAST(substr(b, CAST(5 * j + 3 AS INT), 1) AS INT) + 2 * CAST(substr(b, CAST(5 * j + 4 AS INT), 1) AS INT) + CAST(substr(b, CAST(5 * j + 5 AS INT), 1) AS INT) + 1 AS INT), 1), '' ORDER BY j) AS payload_digest FROM bits, range(0, 32) r(j) GROUP BY page_id),
firsts AS (SELECT hex, min(page_id) AS first_id FROM hashed GROUP BY hex)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first_id THEN first_id END AS refers_to FROM hashed JOIN firsts USING (hex) JOIN digests USING (page_id)
"""

ORACLE_SQL: dict[str, str] = {"op1_quality_rules": _QUALITY, "op6_license_scans": _license_sql(), "op8_warc": _PAGES, "op9_line_dedup": _LINES}
