import json
import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from mosslight import cli, schema
from mosslight.functions.embedding import CharacterEmbedder
from mosslight.operators import incremental, response
from mosslight.plans import index
from mosslight.plans.search import search
from mosslight.settings import Settings
from mosslight.sources import discovery, judgements
from mosslight.streaming.reindex import stream_changes


def write(base, files):
    for name, body in files.items():
        path = base / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(body, encoding="utf-8")


@pytest.fixture
def workspace(tmp_path):
    """Three registered repositories, one of them absent, among folders that don't belong."""
    top = tmp_path / "ws"
    taken = ["pier/CLAUDE.md", "pier/GOVERNANCE.md", "pier/specs/crane.md", "pier/docs/log/may tides #1 (é).md", "pier/apps/web/decisions/0007-x.md", "pier/tasks/paint.md", "specs/top.md", "tasks/mine.md", "README.md", ".claude/skills/knots/SKILL.md", "atlas/docs/a.md"]
    left = ["pier/log.md", "pier/tasks/old/paint.md", "pier/docs/build/made.md", "pier/.venv/docs/x.md", "pier/docs/log.MD", "shed/docs/a.md", ".claude/skills/knots/more.md", ".claude/skills/SKILL.md", "worktrees/pier/AGENTS.md"]
    write(top, {f: f"# {f}\n" for f in [*taken, *left, "atlas/maps/deep/b.md"]})
    write(top, {".corpus-repos.tsv": "pier\thttps://example.invalid/pier\tmain\n \natlas\nferry\n"})
    return top, sorted(taken)


def test_discovery(spark, workspace):
    top, want = workspace
    paths = lambda **x: [r.path for r in discovery.discover(spark, str(top), **x).collect()]
    assert paths() == want
    assert paths(knowledge="atlas") == sorted([*want, "atlas/maps/deep/b.md"])
    assert paths(excludes=["log", "pier/*paint*"]) == sorted(set(want) - {"pier/docs/log/may tides #1 (é).md", "pier/tasks/paint.md"})
    repos = {r.path: r.repo for r in discovery.discover(spark, str(top)).collect()}
    assert {repos[p] for p in ("README.md", "specs/top.md")} == {"workspace"} and repos[".claude/skills/knots/SKILL.md"] == ".claude" and repos["pier/specs/crane.md"] == "pier"


def test_registry_and_roots(spark, workspace, tmp_path, monkeypatch):
    top, _ = workspace
    for bad in ("..", "docks/pier", "docks\\pier", "/pier"):
        write(top, {".corpus-repos.tsv": f"atlas\n{bad}\turl\n"})
        with pytest.raises(discovery.RegistryInvalid):
            discovery.read_registry(top)
    with pytest.raises(discovery.RegistryMissing):
        discovery.read_registry(tmp_path)
    write(top, {"mine.tsv": "atlas\natlas\n"})
    monkeypatch.setenv("MOSSLIGHT_REGISTRY", "mine.tsv")
    assert discovery.read_registry(top) == ["atlas", "atlas"]
    monkeypatch.setenv("MOSSLIGHT_REGISTRY", "none.tsv")
    with pytest.raises(discovery.RegistryMissing):
        discovery.read_registry(top)
    found = discovery.discover(spark, roots=[str(top / "pier"), str(tmp_path / "gone")])
    assert "pier/specs/crane.md" in [r.path for r in found.collect()]
    write(tmp_path, {"other/pier/docs/x.md": "x"})
    with pytest.raises(discovery.RootsCollide):
        discovery.discover(spark, roots=[str(top / "pier"), str(tmp_path / "other/pier")])
    with pytest.raises(discovery.RootsUnusable):
        discovery.discover(spark, roots=[str(tmp_path / "gone")])


def test_reading_guards_each_file(spark, workspace):
    top, _ = workspace
    os.symlink(top / "pier/CLAUDE.md", top / "pier/docs/link.md")
    write(top, {"pier/docs/big.md": "y" * 999, "pier/docs/x[1]{a}*?.md": "glob"})
    found = discovery.discover(spark, str(top)).collect()
    (top / "pier/specs/crane.md").unlink()
    (top / "pier/tasks/paint.md").unlink()
    (top / "pier/tasks/paint.md").mkdir()
    rows = {r.path: r for r in discovery.read_files(spark.createDataFrame(found), 900).collect()}
    assert len(rows) == len(found)
    assert rows["pier/docs/link.md"].is_symlink and rows["pier/docs/link.md"].content is None
    assert rows["pier/docs/big.md"].content is None and rows["pier/docs/big.md"].size == 999
    assert bytes(rows["pier/docs/x[1]{a}*?.md"].content) == b"glob"
    assert bytes(rows["pier/docs/log/may tides #1 (é).md"].content) == "# pier/docs/log/may tides #1 (é).md\n".encode()
    assert rows["pier/specs/crane.md"].content is None and rows["pier/specs/crane.md"].size is None and not rows["pier/specs/crane.md"].is_symlink
    assert rows["pier/tasks/paint.md"].content is None and rows["pier/tasks/paint.md"].size is not None


DOCS = {
    "docs/ferry.md": "---\nsuperseded_by: bridge\ntags: [boats, fares]\n---\n# Ferry\nfares by the tide, see [[tolls]]",
    "docs/bridge.md": "---\ndecided_on: 2025-05-05\n---\n# Bridge\nno more tide to wait for",
    "docs/tolls.md": "# Tolls\nprices of every crossing",
    "docs/harbour.md": "# Harbour\nall quays at one glance",
    **{f"docs/{n}-quay.md": f"# The {n} quay\ntide at the {n} quay; the map is [[harbour]]" for n in ("north", "south", "east")},
}


def files(spark, root):
    return discovery.read_files(discovery.discover(spark, roots=[str(root)]))


def test_runs(spark, tmp_path):
    root, home = tmp_path / "r", str(tmp_path / "index")
    write(root, DOCS)
    with pytest.raises(index.NoIndex):
        index.open_corpus(spark, home)
    first = index.reindex(spark, home, files(spark, root), embedder=CharacterEmbedder(16))
    assert (first.added, first.rebuilt, first.edges, first.fully_embedded, first.touched) == (7, True, 5, True, 7)
    corpus, manifest = index.open_corpus(spark, home)
    assert {(r.src_path, r.dst_path, r.relation) for r in corpus.edges.collect()} >= {("r/docs/ferry.md", "r/docs/bridge.md", "superseded_by"), ("r/docs/ferry.md", "r/docs/tolls.md", "links_to")}
    assert manifest.embed_model == "characters" and {r.tags for r in corpus.documents.collect()} == {None, "boats,fares"}

    again = index.reindex(spark, home, files(spark, root), embedder=CharacterEmbedder(16))
    assert (again.unchanged, again.touched, again.embedded, again.rebuilt) == (7, 0, 0, False)

    write(root, {"docs/harbour.md": "# Harbour\nchanged", "docs/new.md": "# New\nwords"})
    (root / "docs/tolls.md").unlink()
    os.utime(root / "docs/bridge.md", (1, 1))
    third = index.reindex(spark, home, files(spark, root), embedder=CharacterEmbedder(16))
    assert (third.added, third.changed, third.removed, third.mtime_refreshed, third.embedded, third.unresolved) == (1, 1, 1, 1, 2, 1)
    corpus, _ = index.open_corpus(spark, home)
    assert corpus.documents.count() == corpus.chunks.count() == corpus.vectors.count() == 7
    assert corpus.documents.where("path = 'r/docs/bridge.md'").first().mtime == 1.0

    queries = spark.createDataFrame([("q", "tide"), ("none", "!?")], schema.QUERIES)
    result = search(corpus, queries, embedder=CharacterEmbedder(16))
    paths = [r.path for r in result.hits.where("query_id = 'q'").orderBy("position").collect()]
    assert "r/docs/harbour.md" in paths and len(paths) == len(set(paths))
    ferry = result.hits.where("query_id = 'q' and path = 'r/docs/ferry.md'").first()
    assert ferry.is_superseded and not ferry.supersedence_unresolved
    lexical_only = search(corpus, queries, ("lexical",))
    assert {r.query_id: r.mode for r in lexical_only.responses.collect()} == {"q": "lexical", "none": "none"}
    assert search(corpus, queries, ("lexical", "vector"), embedder=CharacterEmbedder(16, "other")).degraded

    other = index.reindex(spark, home, files(spark, root), knowledge="r", embedder=CharacterEmbedder(16, "other"))
    assert other.rebuilt and other.added == 7
    assert "the knowledge repo has changed" in index.status(spark, home)["stale"]


def test_guards(spark, tmp_path):
    root, home = tmp_path / "r", str(tmp_path / "index")
    write(root, {"docs/a.md": "a"})
    index.reindex(spark, home, files(spark, root))
    before = index.read_manifest(home)
    write(tmp_path / "s", {"docs/b.md": "b"})
    with pytest.raises(incremental.EmptyCorpus):
        index.reindex(spark, home, files(spark, tmp_path / "s"))
    assert index.read_manifest(home) == before
    with index.writer_lock(home), pytest.raises(index.IndexLocked):
        index.reindex(spark, home, files(spark, root))
    assert index.reindex(spark, home, files(spark, tmp_path / "s"), allow_empty=True).removed == 1
    newer = json.loads((tmp_path / "index" / index.POINTER).read_text()) | {"schema_version": 99}
    (tmp_path / "index" / index.POINTER).write_text(json.dumps(newer))
    with pytest.raises(index.IndexTooNew):
        index.open_corpus(spark, home)


def test_a_lock_ends_with_its_process(tmp_path):
    home = str(tmp_path)
    code = f"import os, sys; sys.path.insert(0, {os.getcwd()!r}); from mosslight.plans.index import writer_lock\nwith writer_lock({home!r}):\n    print('held', flush=True)\n    sys.stdin.read()"
    holder = subprocess.Popen([sys.executable, "-c", code], stdin=subprocess.PIPE, stdout=subprocess.PIPE)
    try:
        assert holder.stdout.readline() == b"held\n"
        with pytest.raises(index.IndexLocked), index.writer_lock(home):
            pass
    finally:
        holder.kill()
        holder.communicate()
    with index.writer_lock(home), pytest.raises(index.IndexLocked), index.writer_lock(home):
        pass


def test_unreadable_files_keep_what_is_stored(spark, tmp_path):
    root, home = tmp_path / "r", str(tmp_path / "index")
    write(root, {"docs/a.md": "alpha words", "docs/b.md": "beta words", "docs/c.md": "gamma words"})
    index.reindex(spark, home, files(spark, root))
    found = discovery.discover(spark, roots=[str(root)]).collect()
    (root / "docs/b.md").unlink()
    (root / "docs/b.md").mkdir()
    write(root, {"docs/c.md": "gamma changed"})
    stats = index.reindex(spark, home, discovery.read_files(spark.createDataFrame(found)))
    assert (stats.kept_unreadable, stats.removed, stats.changed, stats.unchanged, stats.rejected) == (1, 0, 1, 1, 0)
    corpus, _ = index.open_corpus(spark, home)
    assert {r.body for r in corpus.chunks.collect()} == {"alpha words", "beta words", "gamma changed"}


class Failing(CharacterEmbedder):
    """Fails for batches that hold a certain word."""

    def embed(self, texts):
        if any("bad" in t for t in texts):
            raise OSError("no answer")
        return super().embed(texts)


def test_embedding_keeps_partial_progress(spark, tmp_path):
    root, home = tmp_path / "r", str(tmp_path / "index")
    write(root, {"docs/a.md": "good", "docs/b.md": "bad"})
    first = index.reindex(spark, home, files(spark, root).repartition(2, "path"), embedder=Failing(16))
    assert first.vectors < first.chunks and not first.fully_embedded
    second = index.reindex(spark, home, files(spark, root), embedder=CharacterEmbedder(16))
    assert second.fully_embedded and second.embedded == first.chunks - first.vectors and not second.rebuilt
    assert index.reindex(spark, home, files(spark, root), embedder=CharacterEmbedder(8)).rebuilt


def test_settings():
    env = {"MOSSLIGHT_ROOTS": os.pathsep.join(["/a", "/b", ""]), "MOSSLIGHT_KNOWLEDGE": "", "MOSSLIGHT_INDEX": "/i"}
    assert Settings.from_env(env) == Settings("/i", None, ["/a", "/b"], None, [])
    assert Settings.from_env({"MOSSLIGHT_EMBED_MODEL": "m"}).embed_model == "m"


def test_carried_postings_equal_a_rebuild(spark, tmp_path):
    root, homes = tmp_path / "r", (str(tmp_path / "one"), str(tmp_path / "two"))
    write(root, {"docs/a.md": "alpha beta", "docs/b.md": "beta gamma", "docs/c.md": "gone words"})
    index.reindex(spark, homes[0], files(spark, root))
    write(root, {"docs/b.md": "beta beta delta", "docs/d.md": "alpha"})
    (root / "docs/c.md").unlink()
    assert index.reindex(spark, homes[0], files(spark, root)).rebuilt is False
    index.reindex(spark, homes[1], files(spark, root))
    for name in ("postings", "lengths", "frequencies", "stats", "chunks"):
        tables = [spark.read.parquet(os.path.join(h, index.read_manifest(h).snapshot, name)) for h in homes]
        rows = [sorted(map(str, t.select(sorted(t.columns)).collect())) for t in tables]
        assert rows[0] == rows[1], name


def test_diff_states(spark):
    cols = "path string, mtime double, content_hash string"
    old = spark.createDataFrame([("keep", 1.0, "h"), ("gone", 1.0, "h"), ("edit", 1.0, "h"), ("link", 1.0, "h"), ("lost", 1.0, "h")], cols)
    new = spark.createDataFrame([("keep", 2.0, "h", "ok"), ("edit", 1.0, "i", "ok"), ("link", 1.0, "h", "rejected"), ("lost", 1.0, None, "unreadable"), ("odd", 1.0, None, "unreadable"), ("new", 1.0, "h", "ok")], cols + ", status string")
    got = {r.path: (r.status, r.touched) for r in incremental.diff(old, new).collect()}
    assert got == {"keep": ("unchanged", True), "gone": ("removed", False), "edit": ("changed", False), "link": ("removed", False), "lost": ("kept_unreadable", False), "new": ("added", False)}


def test_command_line(spark, tmp_path):
    root, home = tmp_path / "r", str(tmp_path / "index")
    write(root, {**DOCS, "decisions/0004-old.md": "# Old"})
    run = lambda *a: cli.run(["--index", home, "--embed-dim", "16", *a], spark)
    assert run("reindex", "--root", str(root))["added"] == 8
    found = run("search", "tide fares", "crossing", "--limit", "3", "--context")
    assert len(found["responses"]) == 2 and found["hits"][0]["position"] == 1
    ref = found["hits"][0]["ref"]
    assert run("get", ref)[0]["ref"] == ref and run("get", "c" + "0" * 16) == []
    with pytest.raises(ValueError, match="not a chunk reference"):
        run("get", "12")
    assert len(run("recent", "--limit", "2")) == 2
    assert run("allocate", "next-one") == {"number": "0005"}
    assert run("status")["documents"] == 8
    judged = tmp_path / "q.yaml"
    judged.write_text("queries:\n- {id: a, query: crossing, relevant: [r/docs/tolls.md]}\n")
    report = run("eval", str(judged), "--per-query")
    arms = {x["arm"]: x for x in report["arms"]}
    assert report["per_query"]["lexical"] == [{"query_id": "a", "recall": 1.0, "rr": 1.0, "missed": []}] and set(report["per_query"]) == set(arms)
    assert report["graph_delta"] == {c: round(arms["full"][c] - arms["lexical+vector"][c], 4) for c in ("recall", "mrr")}
    assert arms["lexical"]["recall"] == 1.0 and len(arms) == 4
    assert not {x["arm"]: x for x in cli.run(["--index", home, "eval", str(judged)], spark)["arms"]}["full"]["available"]
    judged.write_text("queries:\n- {id: a, query: crossing, relevant: [gone.md]}\n")
    with pytest.raises(ValueError, match="gone.md"):
        run("eval", str(judged))


@pytest.mark.parametrize("raw", ["- 1", "queries: []", "queries: [1]", "queries: [{id: a, relevant: [x]}]", "queries: [{id: a, query: q, relevant: []}]", "queries: [{id: a, query: q, relevant: [x]}, {id: a, query: q, relevant: [x]}]", "queries: ["])
def test_bad_judgements(spark, raw):
    with pytest.raises(judgements.JudgementError):
        judgements.load(spark, raw)


def test_recent_has_all_chunks_of_a_document(spark):
    docs = spark.createDataFrame([("r", f"p{i}", "T", "doc", float(i)) for i in range(3)], "repo string, path string, title string, doc_type string, mtime double")
    chunks = spark.createDataFrame([(f"c{i}{j}", f"p{i}", j, "h", "b") for i in range(3) for j in range(2)], schema.CHUNKS)
    assert [r.ref for r in response.recent(chunks, docs, 3).collect()] == ["c20", "c21", "c10"]


def test_stream(spark, tmp_path):
    write(tmp_path / "in", {"a.md": "one", "b.md": "two"})
    seen, stored = [], {"rows": []}
    cols = "path string, mtime double, content_hash string"

    def apply(changes, contents, number):
        rows = changes.collect()
        seen.append((sorted((r.path.rsplit("/", 1)[-1], r.status) for r in rows), contents.count()))
        stored["rows"] += [(r.path, r.mtime, r.content_hash) for r in rows]

    for _ in range(2):
        stream_changes(spark, str(tmp_path / "in"), lambda: spark.createDataFrame(stored["rows"], cols).groupBy("path").agg(F.max("mtime").alias("mtime"), F.last("content_hash").alias("content_hash")), apply, str(tmp_path / "ck")).awaitTermination(60)
        write(tmp_path / "in", {"c.md": "three"})
    assert seen == [([("a.md", "added"), ("b.md", "added")], 2), ([("c.md", "added")], 1)]
