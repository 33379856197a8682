"""Schemas and constants of the retrieval engine."""

from __future__ import annotations

#: Fixed values that results depend on.
RRF_K = 60
GRAPH_WEIGHT = 0.5
POOL = 50
RECENCY_WEIGHT, HALF_LIFE_DAYS = 0.25, 180.0
SUPERSEDED_FACTOR = 0.3
SNIPPET_CHARS = 240
DEFAULT_LIMIT = 10
DAMPING, TOLERANCE, MAX_ITERATIONS = 0.85, 1e-8, 100
REVERSE_WEIGHT = 0.5
SEED_CHUNKS, SEED_DOCS = 10, 10
CHUNKS_PER_DOC, CONTEXT_ITEMS = 3, 8
MAX_CHUNK_CHARS, MIN_CHUNK_CHARS, OVERLAP_CHARS, MIN_OVERLAP_CHARS = 3200, 200, 480, 80
WORD_WINDOW = 200
MAX_DOCUMENT_BYTES = 8 * 1024 * 1024
BM25_K1, BM25_B, IDF_FLOOR = 1.2, 0.75, 1e-6
EMBED_DIM, EMBED_BATCH = 768, 32
SCHEMA_VERSION, EXTRACTOR_VERSION = 4, 2
BREADCRUMB = " > "

LINKS_TO, SUPERSEDED_BY, SUPERSEDES, LINKED_FROM = "links_to", "superseded_by", "supersedes", "linked_from"
CHANNELS = ("lexical", "vector", "graph")

DOCUMENTS = "repo string, path string, title string, doc_type string, mtime double, content_hash string, decided_on string, superseded_by string, tags string"
CHUNKS = "ref string, path string, chunk_seq int, heading_path string, body string"
VECTORS = "ref string, path string, chunk_seq int, embedding array<float>"
LINK_TARGETS = "src_path string, target string, relation string"
DOC_LINKS = "src_path string, dst_path string, relation string"
QUERIES = "query_id string, query string"
