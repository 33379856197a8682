import json
import random
import sqlite3
import threading
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import numpy as np
import pytest
from pyspark.sql import functions as F

from mosslight import schema as S
from mosslight.functions.embedding import CharacterEmbedder, EmbeddingError, HttpEmbedder, checked, embed
from mosslight.functions.porter import stem
from mosslight.functions.text import folded_tokens, tokens
from mosslight.operators import evaluate, fusion, graph, lexical, links, records, vectors
from mosslight.plans.search import check_channels

CHUNK = "ref string, path string, chunk_seq int, heading_path string, body string"


def corpus(n=80, seed=4):
    rng = random.Random(seed)
    words = "running runs runner relational possibly ponies caresses été naïve foo_bar don't X9 the the the hopping falling generalization oscillators happy sky Straße".split()
    return [(f"c{i:03d}", f"p/{i // 3:03d}.md", i % 3, rng.choice(words) + " Head", " ".join(rng.choice(words) for _ in range(rng.randint(0, 40)))) for i in range(n)]


def fts_scores(rows, query):
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table f using fts5(body, heading, tokenize='porter unicode61')")
    db.executemany("insert into f(rowid, body, heading) values (?,?,?)", [(i, r[4], r[3]) for i, r in enumerate(rows)])
    words = "".join(c if c.isalnum() else " " for c in query).split()
    return {rows[i][0]: -s for i, s in db.execute("select rowid, bm25(f) from f where f match ? order by bm25(f)", (" OR ".join(f'"{w}"' for w in words),))}


def test_bm25_equals_an_independent_full_text_index(spark):
    rows = corpus()
    chunks = spark.createDataFrame(rows, CHUNK)
    asked = ["running ponies", "été possible", "the the generalization", "naive foo", "nothing here", "straße sky"]
    queries = spark.createDataFrame([(str(i), q) for i, q in enumerate(asked)], "query_id string, query string")
    got = {}
    for r in lexical.bm25(lexical.build(chunks, stemmed=True), queries).collect():
        got.setdefault(r.query_id, {})[r.ref] = r.score
    for i, q in enumerate(asked):
        want = fts_scores(rows, q)
        assert got.get(str(i), {}).keys() == want.keys()
        assert all(got[str(i)][k] == pytest.approx(v, rel=1e-9, abs=1e-12) for k, v in want.items())


def test_stemmer_equals_an_independent_one():
    words = """caresses ponies ties caress cats feed agreed plastered bled motoring sing conflated troubled sized hopping tanned falling hissing
    fizzed failing filing happy sky relational conditional rational valenci hesitanci digitizer conformabli radicalli differentli vileli analogousli
    vietnamization predication operator feudalism decisiveness hopefulness callousness formaliti sensitiviti sensibiliti triplicate formative formalize
    electriciti electrical hopeful goodness revival allowance inference airliner gyroscopic adjustable defensible irritant replacement adjustment dependent
    adoption homologou communism activate angulariti homologous effective bowdlerize probate rate cease controll roll possibly geology as is a yes by say
    yyy oed ing eing abilities engineering matting mating meeting stating siezing skies dying oozed""".split()
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table f using fts5(b, tokenize='porter unicode61')")
    db.executemany("insert into f(rowid, b) values (?,?)", list(enumerate(words)))
    db.execute("create virtual table v using fts5vocab(f, 'instance')")
    want = {words[i]: t for t, i in db.execute("select term, doc from v")}
    assert {w: stem(w) for w in words} == want
    assert stem("x" * 61 + "ings") == "x" * 61 + "ings"


def test_topk_order_and_pool(spark):
    rows = [(f"c{i:02d}", f"p{i % 2}", i, "h", "same words") for i in range(9)] + [("z", "p9", 0, "h", "other")]
    chunks = spark.createDataFrame(rows, CHUNK)
    top = lexical.bm25_topk(lexical.build(chunks), spark.createDataFrame([(1, "same")], "query_id int, query string"), chunks, 4)
    assert [r.ref for r in top.orderBy("rank").collect()] == ["c00", "c02", "c04", "c06"]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scores_and_rankings_arise_without_a_shuffle_of_postings_or_scores(spark, tmp_path):
    rows = corpus(300, 7)
    rows += [(f"d{i:03d}", f"q/{i % 7}.md", i, "Copy", "happy sky happy ponies") for i in range(130)]  # ties beyond the cut
    spark.createDataFrame(rows, CHUNK).repartition(5).write.parquet(str(tmp_path / "chunks"))
    chunks = spark.read.parquet(str(tmp_path / "chunks"))
    asked = ["happy ponies happy", "the relational", "été naïve x9", "nothing here", "the", ""]
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id int, query string")
    for stemmed in (False, True):
        index = lexical.build(chunks, stemmed)
        bare = lexical.LexicalIndex(index.postings, index.lengths, index.frequencies, index.stats, stemmed)
        assert "Exchange" not in plan(index.postings) and "Exchange" not in plan(lexical.bm25(index, queries))
        scored = {(r.query_id, r.ref): r.score for r in lexical.bm25(index, queries).collect()}
        assert scored == pytest.approx({(r.query_id, r.ref): r.score for r in lexical.bm25(bare, queries).collect()}, abs=1e-12)
        want = {(r.query_id, r.ref, r.rank) for r in lexical.ranked(lexical.bm25(index, queries), chunks, 20).collect()}
        for of in (index, bare):
            for group in (2, 100):
                assert {(r.query_id, r.ref, r.rank) for r in lexical.bm25_topk(of, queries, chunks, 20, group=group).collect()} == want


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_knn_is_exact(spark, metric):
    rng = np.random.default_rng(0)
    x, q = rng.normal(size=(400, 8)).astype(np.float32), rng.normal(size=(7, 8)).astype(np.float32)
    x[20] = x[21] = q[0]
    x[100:200] = q[1] + np.float32(0.01)
    x[200:260] = x[200] + rng.normal(size=(60, 8)).astype(np.float32) * np.float32(1e-7)
    zero = [("zero", [0.0] * 8)] if metric == "cosine" else []
    df = spark.createDataFrame([(f"r{i:03d}", v.tolist()) for i, v in enumerate(x)] + [("none", None), *zero], "ref string, embedding array<float>").repartition(3)
    qs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)] + [(99, None)], "query_id int, embedding array<float>")
    for group in (3, 100):
        got = {}
        for r in vectors.knn(df, qs, 10, metric, group=group).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append(r.ref)
        assert sorted(got) == list(range(7))
        for i, v in enumerate(q.astype(float)):
            d = np.linalg.norm(x - v, axis=1) if metric == "l2" else 1 - (x.astype(float) * v).sum(1) / np.linalg.norm(x.astype(float), axis=1) / np.linalg.norm(v)
            assert got[i] == [f"r{j:03d}" for j in sorted(range(400), key=lambda j: (round(float(d[j]), 9), j))[:10]]
    assert vectors.knn(df, qs.where("query_id < 0"), 3).count() == 0
    expression = vectors.l2 if metric == "l2" else vectors.cosine_distance
    assert df.where("ref = 'r020'").select(expression(F.col("embedding"), F.array(*map(F.lit, q[0].tolist())))).first()[0] == pytest.approx(0, abs=1e-6)


def test_knn_of_many_queries_needs_no_driver_memory_for_them(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 4)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "ref int, embedding array<float>")
    got = vectors.knn(df, df.selectExpr("ref as query_id", "embedding").crossJoin(spark.range(10).selectExpr("id as again")).selectExpr("query_id * 10L + again as query_id", "embedding"), 1)
    assert {(r.query_id, r.ref, r.distance) for r in got.collect()} == {(i, i // 10, 0.0) for i in range(3000)}
    with pytest.raises(Exception, match="width"):
        vectors.knn(df, spark.createDataFrame([(1, [1.0])], "query_id int, embedding array<float>"), 1).collect()


def test_degradation_order():
    base = {"requested": True, "supported": True, "query": "q", "has_table": True, "n_vectors": 1, "stored_model": "a", "model": "a", "width": 3, "dim": 3}
    d = lambda **x: vectors.degradation(**{**base, **x})
    assert d() is None and d(requested=False, supported=False) is None
    assert "not supported" in d(supported=False, query="")
    assert d(query=" ") is None and "table" in d(has_table=False, n_vectors=0) and "no vectors yet" in d(n_vectors=0, stored_model="b")
    assert "from b" in d(stored_model="b", width=9) and d(stored_model=None) is None and "wide" in d(width=9)


def test_character_embedder(spark):
    e = CharacterEmbedder(7)
    v = np.zeros(7)
    for i, ch in enumerate("héllo wörld"):
        v[(i + ord(ch)) % 7] += 1
    df = spark.createDataFrame([("a", "héllo wörld"), ("b", ""), ("c", None)], "ref string, text string")
    got = {r.ref: r.embedding for r in embed(df, e).collect()}
    assert got["a"] == pytest.approx(v / np.linalg.norm(v), rel=1e-6) and got["b"] == got["c"] == [0.0] * 7
    for bad in ([[1.0] * 7], [[1.0] * 6, [1.0] * 7], [[1.0] * 7, [float("nan")] * 7]):
        with pytest.raises(EmbeddingError):
            checked(bad, 2, 7)


def test_rrf(spark):
    rng = random.Random(5)
    lists = {name: (rng.sample([f"c{i}" for i in range(12)], n), w) for name, n, w in (("one", 9, 1.0), ("two", 5, 0.4), ("three", 7, 2.5))}
    ranking = lambda refs: spark.createDataFrame([(q, r, i + 1) for q in (1, 2) for i, r in enumerate(refs[:: q])], "query_id int, ref string, rank int")
    want = {}
    for q in (1, 2):
        for refs, w in lists.values():
            for i, r in enumerate(refs[::q]):
                want[q, r] = want.get((q, r), 0) + w / (S.RRF_K + i + 1)
    got = {(r.query_id, r.ref): r.score for r in fusion.rrf({n: (ranking(x), w) for n, (x, w) in lists.items()}).collect()}
    assert got == pytest.approx(want)
    with pytest.raises(ValueError, match="no channel"):
        fusion.rrf({})
    with pytest.raises(ValueError, match="unknown channels"):
        check_channels(("lexical", "magic"))


def test_page_takes_one_chunk_a_document_before_the_limit(spark):
    rows = [(0, "a1", "a", 0.9), (0, "a2", "a", 0.8), (0, "b2", "b", 0.7), (0, "b1", "b", 0.7), (0, "c1", "c", 0.1)]
    page = fusion.page(spark.createDataFrame(rows, "query_id int, ref string, path string, boosted double"), 2)
    assert [(r.ref, r.position) for r in page.orderBy("position").collect()] == [("a1", 1), ("b1", 2)]


def test_power_iteration():
    ring = graph.power_iteration({"n": {"e": 2.0}, "e": {"s": 1.0}, "s": {"w": 9.0}, "w": {"n": 1.0}}, ["s", "s", "nowhere"])
    assert ring["s"] > ring["w"] > ring["n"] > ring["e"] and sum(ring.values()) == pytest.approx(1)
    star = graph.power_iteration({"hub": {}, "a": {"hub": 1.0, "b": 3.0}, "b": {"hub": 1.0}}, ["a"])
    assert star["hub"] + star["a"] + star["b"] == pytest.approx(1) and star["b"] > 0.75 * star["a"] * 0.85 * 0.99
    for adj, seeds in (({}, ["a"]), ({"a": {}}, ["b"]), ({"a": {}}, [])):
        assert graph.power_iteration(adj, seeds) == {}


def plain_pagerank(adj, seeds, damping=0.85, tolerance=1e-8, iterations=100):
    nodes, present = sorted(adj), sorted({s for s in seeds if s in adj})
    p = {n: (1 / len(present) if n in present else 0.0) for n in nodes}
    rank = dict(p)
    for _ in range(iterations):
        loose = damping * sum(rank[n] for n in nodes if not adj[n])
        new = {n: (1 - damping + loose) * p[n] for n in nodes}
        for n in nodes:
            for m, w in adj[n].items():
                new[m] += damping * rank[n] * w / sum(adj[n].values())
        gap, rank = sum(abs(new[n] - rank[n]) for n in nodes), new
        if gap < tolerance:
            break
    return rank


def test_pagerank_of_tables(spark):
    rng = random.Random(1)
    edges = [(f"n{rng.randrange(30):02d}", f"n{rng.randrange(30):02d}", rng.choice([S.LINKS_TO, S.SUPERSEDED_BY])) for _ in range(60)]
    edges = [e for e in set(edges) if e[0] != e[1]]
    adj = {}
    for a, b, _ in edges:
        adj.setdefault(a, {})[b] = 1.0
        adj.setdefault(b, {}).setdefault(a, 0.5)
    for a, b, _ in edges:
        adj[a][b] = 1.0
    table = graph.adjacency(spark.createDataFrame(edges, S.DOC_LINKS))
    assert {(r.src, r.dst): r.weight for r in table.collect()} == {(a, b): w for a, x in adj.items() for b, w in x.items()}
    some = sorted(adj)
    seeds = {0: [some[0]], 1: [some[3], some[5], "absent"], 2: ["absent"]}
    df = spark.createDataFrame([(q, s) for q, x in seeds.items() for s in x], "query_id int, path string")
    adj["end"] = {}
    adj[some[0]]["end"] = 0.7
    hanging = table.unionByName(spark.createDataFrame([(some[0], "end", 0.7)], table.schema))
    quick = {"damping": 0.3, "tolerance": 1e-3}
    for ranks, options in ((graph.pagerank(hanging, df), {}), (graph.pagerank(hanging, df, **quick), quick), (graph.pagerank(hanging, df, **quick, local_bytes=0), quick)):
        got = {}
        for r in ranks.collect():
            got.setdefault(r.query_id, {})[r.node] = r.rank
        assert sorted(got) == [0, 1]
        for q in got:
            assert all(got[q].get(n, 0) == pytest.approx(v, abs=1e-12) for n, v in plain_pagerank(adj, seeds[q], **options).items())
    plain = {q: plain_pagerank(adj, seeds[q], **quick) for q in (0, 1)}
    want = {(q, n) for q, x in plain.items() for n in sorted(x, key=lambda n: (-round(x[n], 12), n))[:5]}
    for size in (0, graph.LOCAL_BYTES):
        assert {(r.query_id, r.node) for r in graph.pagerank(hanging, df, **quick, top=5, local_bytes=size).collect()} == want
    fixed = {(r.query_id, r.node): r.rank for r in graph.pagerank_fixed(table, df, 12).collect()}
    del adj["end"], adj[some[0]]["end"]
    assert all(fixed.get((1, n), 0) == pytest.approx(v, abs=1e-12) for n, v in plain_pagerank(adj, seeds[1], tolerance=0, iterations=12).items())


def test_walk_by_blocks_and_fixed_iterations_in_both_forms(spark, monkeypatch):
    rng = random.Random(8)
    monkeypatch.setattr(graph, "EDGE_BLOCK", 3)
    for m in (0, 1, 2, 40):
        adj = {f"n{i}": {} for i in range(12)}
        for _ in range(m):
            adj[f"n{rng.randrange(9)}"][f"n{rng.choice([0, rng.randrange(12)])}"] = rng.choice([0.5, 1.0])
        got = graph.power_iteration(adj, ["n0", "n3"])
        assert got == pytest.approx(plain_pagerank(adj, ["n0", "n3"]), abs=1e-12)
    table = graph.adjacency(spark.createDataFrame([(f"n{rng.randrange(40)}", f"n{40 + i % 9}", S.LINKS_TO) for i in range(60)], S.DOC_LINKS))
    seeds = spark.createDataFrame([(1, "n40"), (1, "n41"), (2, "n44"), (3, "absent")], "query_id int, path string")
    local, tables = ({(r.query_id, r.node): r.rank for r in graph.pagerank_fixed(table, seeds, 3, local_bytes=size).collect()} for size in (graph.LOCAL_BYTES, 0))
    assert local == pytest.approx(tables, abs=1e-15) and {q for q, _ in local} == {1, 2}


def test_latin_texts_have_the_same_tokens_on_both_ways(spark):
    every = " ".join(f"a{chr(c)}b {chr(c)}" for c in range(1, 0x250))
    texts = [every, every[:600], "ASCII only_x 9", "Straße İstanbul", "Ωmega ٣ \u4e2d\ue000 x\u0301y", "", "ŁÓDŹ ª º ² ¼"]
    chunks = spark.createDataFrame([(f"c{i}", "p", i, "h", t) for i, t in enumerate(texts)], CHUNK)
    for stemmed, split in ((False, tokens), (True, folded_tokens)):
        want = {r.ref: r.words for r in chunks.select("ref", split(F.concat_ws(" ", "body", "heading_path")).alias("words")).collect()}
        for r in lexical.build(chunks, stemmed).bags.collect():
            counted = Counter(stem(w) if stemmed else w for w in want[r.ref])
            assert dict(zip(r.terms, r.tfs, strict=True)) == counted and r.dl == len(want[r.ref])


def test_votes_prefer_candidates_then_document_order(spark):
    chunks = spark.createDataFrame([(f"{d}{i}", d, i, "h", "b") for d in "xyz" for i in range(5)], CHUNK)
    ranks = spark.createDataFrame([(0, "y", 0.5), (0, "x", 0.3), (0, "z", 0.3)], "query_id int, node string, rank double")
    base = spark.createDataFrame([(0, "y4", 1), (0, "x1", 2)], "query_id int, ref string, base_rank int")
    got = [r.ref for r in graph.votes(ranks, base, chunks, 7).orderBy("rank").collect()]
    assert got == ["y4", "y0", "y1", "x1", "x0", "x2", "z0"]


def test_context(spark):
    e = [("a", "b", S.SUPERSEDED_BY), ("b", "c", S.SUPERSEDED_BY), ("c", "a", S.SUPERSEDED_BY), ("z", "a", S.SUPERSEDED_BY), ("a", "m", S.LINKS_TO), ("n", "a", S.LINKS_TO), ("m", "a", S.LINKS_TO), ("a", "b", S.LINKS_TO)]
    edges = spark.createDataFrame(e, S.DOC_LINKS)
    docs = spark.createDataFrame([(p, p.upper(), "r") for p in "abcmnz"], "path string, title string, repo string")
    items = graph.context(edges, docs.where("path = 'a'"), docs)
    assert [(r.other, r.relation) for r in items.orderBy("pos").collect()] == [("b", S.SUPERSEDED_BY), ("c", S.SUPERSEDED_BY), ("z", S.SUPERSEDES), ("m", S.LINKS_TO), ("n", S.LINKED_FROM)]
    assert graph.context(edges, docs.where("path = 'a'"), docs, 2).count() == 2
    one = graph.assembled(items).first()
    assert [x.path for x in one.assembled] == ["b", "c", "z", "m", "n"] and one.assembled[0].title == "B"


def test_supersedence_chain_has_no_limit_of_hops(spark):
    hops = 53
    edges = spark.createDataFrame([(f"p{i:02}", f"p{i + 1:02}", S.SUPERSEDED_BY) for i in range(hops)], S.DOC_LINKS)
    got = graph.supersedence_chain(edges, spark.createDataFrame([("p00",)], "path string")).orderBy("pos").collect()
    assert [(r.other, r.hop, r.pos) for r in got] == [(f"p{i:02}", i, i) for i in range(1, hops + 1)]


def test_resolution(spark):
    docs = [("a", "a/decisions/0006-x.md", "X"), ("b", "b/decisions/0006-y.md", "Y"), ("b", "b/docs/one.md", "Same"), ("a", "a/docs/two.md", "Same"), ("a", "a/docs/src.md", "Src"), ("c", "c/tasks/log.md", "Log"), ("c", "c/docs/cite.md", "Cite"), ("d", "d/decisions/0007-p.md", "P"), ("d", "d/decisions/0007-q.md", "Q"), ("d", "d/docs/in.md", "In")]
    targets = {
        ("a/docs/src.md", "0006", S.LINKS_TO): ("edge", "a/decisions/0006-x.md"),
        ("c/docs/cite.md", "0006", S.LINKS_TO): ("ambiguous", None),
        ("d/docs/in.md", "0007", S.LINKS_TO): ("ambiguous", None),
        ("c/docs/cite.md", "0009", S.LINKS_TO): ("unresolved", None),
        ("c/tasks/log.md", "0006", S.LINKS_TO): ("work_log", None),
        ("c/tasks/log.md", "0007", S.SUPERSEDED_BY): ("ambiguous", None),
        ("a/docs/src.md", "same", S.LINKS_TO): ("edge", "a/docs/two.md"),
        ("c/docs/cite.md", "Same", S.LINKS_TO): ("ambiguous", None),
        ("a/docs/src.md", "./two.md", S.LINKS_TO): ("edge", "a/docs/two.md"),
        ("a/docs/src.md", "./one.md", S.LINKS_TO): ("unresolved", None),
        ("a/docs/src.md", "ONE", S.LINKS_TO): ("edge", "b/docs/one.md"),
        ("a/docs/src.md", "docs/two.md", S.LINKS_TO): ("edge", "a/docs/two.md"),
        ("a/docs/src.md", "src", S.SUPERSEDED_BY): ("self", None),
        ("a/docs/src.md", "../../../x.md", S.LINKS_TO): ("unresolved", None),
    }
    got = links.resolve(spark.createDataFrame(list(targets), S.LINK_TARGETS), spark.createDataFrame(docs, "repo string, path string, title string"))
    assert {(r.src_path, r.target, r.relation): (r.outcome, r.dst_path) for r in got.collect()} == targets
    n = links.outcomes(got).first()
    assert (n.edges, n.unresolved, n.unlinkable, n.from_work_logs, n.n_dangling) == (3, 3, 5, 1, 2)


def test_scores(spark):
    rng, rows, judged, want = random.Random(6), [], [], {}
    for q in range(8):
        ranked = [rng.choice("abcdefgh") for _ in range(rng.randint(0, 9))]
        relevant = rng.sample("abcdefghxy", rng.randint(1, 4))
        rows += [(q, p, i + 1) for i, p in enumerate(ranked)]
        judged.append((q, [*relevant, relevant[0]]))
        top = ranked[:5]
        hit = [p for p in relevant if p in top]
        want[q] = (len(hit) / len(relevant), max((1 / (top.index(p) + 1) for p in hit), default=0.0), sorted(hit), sorted(set(relevant) - set(hit)))
    got = evaluate.scores(spark.createDataFrame(judged, "query_id int, relevant array<string>"), spark.createDataFrame(rows, "query_id int, path string, position int"), 5)
    assert {r.query_id: (pytest.approx(r.recall), pytest.approx(r.rr), r.found, r.missed) for r in got.collect()} == want


def test_records(spark):
    numbers = lambda *x: spark.createDataFrame([(n,) for n in x], "number string")
    have = spark.createDataFrame([("taken",)], "slug string")
    assert records.allocate("new-one", have, numbers("0006", "0011"), numbers("0010")) == "0012"
    assert records.allocate("new-one", have, numbers()) == "0001"
    for slug, source in (("Bad Slug", numbers()), ("taken", numbers()), ("x", numbers("9999"))):
        with pytest.raises(records.AllocationError):
            records.allocate(slug, have, source)


def test_created_records(tmp_path):
    (tmp_path / "INDEX.md").write_text("# Claims\n- 0003  old-one")
    (tmp_path / "0003-old-one.md").write_text("x")
    made = records.create(tmp_path, "dry-dock", "A dry dock", "2026-01-02", ("pier",), ("steel", "v2.0"), taken=(5,))
    text = made.read_text()
    assert made.name == "0006-dry-dock.md" and "# 0006: A dry dock" in text and "repos: [pier]\ntags: [steel, v2.0]" in text and "superseded_by: null" in text
    assert (tmp_path / "INDEX.md").read_text() == "# Claims\n- 0003  old-one\n- 0006  dry-dock\n"
    (tmp_path / "0009-lost.md").write_text("x")
    for slug, options, why in (("dry-dock", {}, "exists"), ("lost", {}, "interrupted"), ("Bad", {}, "slug"), ("ok", {"tags": ("a: b",)}, "list"), ("ok", {"taken": (9999,)}, "taken")):
        with pytest.raises(records.AllocationError, match=why):
            records.create(tmp_path, slug, "t", "2026-01-02", **options)
    (tmp_path / "INDEX.md").write_text("- 0010  other\n- 0011  twice\n")
    real, calls = records._claims, []
    records._claims = lambda index: real(index) + (["0012"] if calls.append(1) or len(calls) > 1 else [])
    try:
        with pytest.raises(records.AllocationError, match="twice"):
            records.create(tmp_path, "late", "t", "2026-01-02")
    finally:
        records._claims = real
    assert not (tmp_path / "0012-late.md").exists()
    with pytest.raises(records.AllocationError, match="missing"):
        records.create(tmp_path / "..", "ok", "t", "2026-01-02")


def test_http_embedder(spark):
    answers = {"mode": "good"}

    class Service(BaseHTTPRequestHandler):
        def do_POST(self):
            asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            vectors = [[float(len(t)), 1.0, 0.0] for t in asked["input"]]
            vectors = {"short": vectors[1:], "empty": [[] for _ in vectors], "words": [["x"] * 3 for _ in vectors], "wide": [[1.0] * 4 for _ in vectors], "odd": 7}.get(answers["mode"], vectors)
            self.send_response(404 if answers["mode"] == "lost" or asked["model"] != "m" else 200)
            self.end_headers()
            self.wfile.write(json.dumps({"embeddings": vectors}).encode() if answers["mode"] != "text" else b"hello")

        def log_message(self, *args):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    host = f"http://127.0.0.1:{server.server_port}"
    try:
        e = HttpEmbedder("m", host)
        assert e.probe() and e.dim == 3 and e.embed([]) == []
        df = spark.createDataFrame([(f"r{i}", "x" * i, i) for i in range(70)], "ref string, text string, chunk_seq int")
        got = {r.ref: (r.chunk_seq, r.embedding) for r in embed(df, e, also=("chunk_seq",)).collect()}
        assert got == {f"r{i}": (i, [float(i), 1.0, 0.0]) for i in range(70)}
        for mode in ("short", "empty", "words", "wide", "odd", "text", "lost"):
            answers["mode"] = mode
            with pytest.raises(EmbeddingError):
                e.embed(["a", "b"])
        answers["mode"] = "good"
        assert not HttpEmbedder("other", host).probe() and not HttpEmbedder("m", "http://127.0.0.1:1").probe()
    finally:
        server.shutdown()
    for bad in ("http://10.0.0.1:80", "ftp://localhost", "localhost:80"):
        with pytest.raises(ValueError, match="this machine"):
            HttpEmbedder("m", bad)
