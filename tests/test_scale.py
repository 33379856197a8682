"""What grows with the corpus: which steps read texts, what is shuffled, what passes through the driver."""

import pytest
from pyspark.sql import functions as F

from mosslight import catalogue
from mosslight import schema as S
from mosslight.operators import fusion, graph, lexical, links
from mosslight.plans import views
from mosslight.plans.index import with_refs
from mosslight.plans.search import Corpus, search
from mosslight.staging import clear
from tests.compare import DATA, check
from tests.test_channels import CHUNK, corpus

needs_data = pytest.mark.skipif(not DATA.exists(), reason="the benchmark tables aren't here")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@needs_data
@pytest.mark.parametrize("name", ["search_lexical", "search_vector", "search_mode", "boosted_scores", "supersedence_states", "supersedence_chain", "get_chunk"])
def test_supersedence_needs_no_links_of_the_texts(spark, monkeypatch, name):
    clear(spark)
    monkeypatch.setattr(links, "body_links", lambda text: F.array(F.when(F.length(text) >= 0, F.raise_error(F.lit("links of a text"))).cast("string")))
    check(spark, catalogue.QUERIES[name], catalogue.ORACLE_SQL[name])


@needs_data
def test_supersedences_are_those_of_all_links(spark):
    want = views.doc_links(spark, str(DATA)).where(F.col("relation") == S.SUPERSEDED_BY)
    assert sorted(views.supersedences(spark, str(DATA)).collect()) == sorted(want.collect()) != []


def test_responses_dont_wait_for_the_page(spark, monkeypatch):
    rows = corpus()
    chunks = spark.createDataFrame(rows, CHUNK)
    queries = spark.createDataFrame([(0, "happy"), (1, "zzz")], "query_id int, query string")
    monkeypatch.setattr(fusion, "page", lambda *a: pytest.fail("a page that nobody asked for"))
    found = search(Corpus(None, chunks, lexical.build(chunks), None), queries, ("lexical",))
    assert sorted((r.query_id, r.mode) for r in found.responses.collect()) == [(0, "lexical"), (1, "none")]


def test_boosts_join_bags_and_not_scores(spark):
    chunks = spark.createDataFrame(corpus(), CHUNK)
    queries = spark.createDataFrame([(0, "happy sky"), (1, "ponies"), (2, "zzz")], "query_id int, query string")
    index = lexical.build(chunks)
    of_path = chunks.select("path", (F.crc32("path") % 7).cast("double").alias("factor")).distinct()
    for group in (2, 100):
        got = lexical.bm25_of_chunks(index, queries, group, of_path)
        assert got.columns == ["ref", "factor", "hits"]
        top = plan(got).split("MapInArrow")[0]
        assert "Exchange" not in top and "Join" not in top
        scored = {(r.query_id, r.ref): r.score for r in got.select("ref", F.explode("hits").alias("x")).select("ref", "x.*").collect()}
        assert scored == {(r.query_id, r.ref): r.score for r in lexical.bm25(index, queries).collect()}
        factors = dict(chunks.join(of_path, "path").select("ref", "factor").collect())
        assert all(r.factor == factors[r.ref] for r in got.collect())


def test_chains_of_many_rows_arent_sent_through_the_driver(spark, monkeypatch):
    n, staged = 60, []
    edges = spark.createDataFrame([(f"p{i:02}", f"p{i + 1:02}", S.SUPERSEDED_BY) for i in range(n) if i % 4 != 3] + [("p03", "p00", S.SUPERSEDED_BY), ("p07", "p09", S.LINKS_TO)], S.DOC_LINKS)
    docs = spark.createDataFrame([(f"p{i:02}", f"t{i}", "r") for i in range(n + 5)], "path string, title string, repo string")
    want = sorted(map(tuple, graph.context(edges, docs, docs).collect()))
    monkeypatch.setattr(graph, "SENT_ROWS", 0)
    keep = graph.stage
    monkeypatch.setattr(graph, "stage", lambda df, label: staged.append((label, plan(df))) or keep(df, label))
    assert sorted(map(tuple, graph.context(edges, docs, docs).collect())) == want
    hops = [p for label, p in staged if label in ("hop", "seen")]
    assert len(hops) >= 8 and not any("Broadcast" in p for p in hops)
    starts = [r.path for r in docs.collect()]
    got = {(r.path, r.other): (r.relation, r.hop) for r in graph.supersedence_chain(edges, docs).collect()}
    assert {p for p, _ in got} <= set(starts) and got["p00", "p03"] == (S.SUPERSEDED_BY, 3) and got["p05", "p04"] == (S.SUPERSEDES, 1)


@needs_data
def test_chunks_and_frequencies_shuffle_no_texts(spark):
    assert "Exchange" not in plan(views.chunks(spark, str(DATA)))
    counted = plan(catalogue.QUERIES["doc_freq"](spark, str(DATA)))
    assert "Window" not in counted and counted.count("Exchange") == 1 and "partial_sum" in counted.split("Exchange")[1]


@pytest.mark.parametrize("repeated", [False, True])
def test_chunks_are_numbered_as_across_rows(spark, tmp_path, repeated):
    texts = ["a\n\n b\n\nc\n\t\nd\ne\nf\n\n", "", None, "  \nx y", "one", "z\n" * 9]
    rows = [(i, t, "en", f"src{i % 2}", 1) for i, t in enumerate(texts)] + [(None, "q\nr", "en", "src1", 1), (9, "q\nr", "en", None, 1)]
    spark.createDataFrame(rows + rows[:1] * repeated, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    d = str(tmp_path)
    made = views.chunks(spark, d)
    assert sorted(made.collect(), key=repr) == sorted(with_refs(views.lines(spark, d)).select(made.columns).collect(), key=repr)
    refs = [r.ref for r in made.where("path is not null").collect()]
    assert len(refs) == len(set(refs)) == 18 + 7 * repeated
    built = lexical.build(made)
    assert sorted(lexical.frequencies(views.lines(spark, d)).collect()) == sorted(built.frequencies.collect())
    assert sorted(lexical.frequencies(made, True).collect()) == sorted(lexical.build(made, True).frequencies.collect())
