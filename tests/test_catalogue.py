import pytest

from mosslight import catalogue
from tests.compare import DATA, check

#: The quick ones; the search queries run the same operators end to end and are compared by the driver.
QUICK = [
    "scan_fingerprint", "discover_scope", "discover_exclude", "reject_oversize", "classify_doc_type", "path_facts", "incremental_diff", "diff_stats", "change_cascade",
    "empty_guard", "reclassify_count", "meta_upsert", "chunk_refs", "sections_breadcrumb", "snippets", "links_wikilink", "links_markdown", "links_bare_path", "links_citation",
    "extract_links", "resolution_keys", "relative_paths", "resolve_links", "link_outcomes", "dangling_supersedence", "tokenize", "doc_freq", "corpus_stats", "bm25_topk",
    "knn_l2_topk", "knn_cosine_topk", "missing_vectors", "orphan_vectors", "stub_embed", "adjacency_normalized", "assembled_context", "recency_factor", "search_lexical_vector",
    "sections_merged", "embedding_texts", "lenient_decoding", "clean_scalars", "index_upkeep", "supersedence_chain", "supersedence_states", "hit_payloads", "search_responses", "search_full", "search_with_context", "eval_recall_mrr",
    "get_chunk", "hit_payload_json", "judgement_validation", "allocate_number",
]


@pytest.mark.skipif(not DATA.exists(), reason="the benchmark tables aren't here")
@pytest.mark.parametrize("name", QUICK)
def test_query_equals_its_sql(spark, name):
    check(spark, catalogue.QUERIES[name], catalogue.ORACLE_SQL[name])


def test_names():
    assert set(catalogue.ORACLE_SQL) <= set(catalogue.QUERIES)
    assert set(QUICK) <= set(catalogue.ORACLE_SQL)
