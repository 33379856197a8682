import hashlib
import random

import pytest
from pyspark.sql import functions as F

from mosslight.functions import text


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("repo", "path", "kind"),
    [
        ("atlas", "atlas/decisions/0412-ferry-timetable.md", "decision"),
        ("atlas", "decisions/drafts/ideas.md", "decision"),
        ("atlas", "gaps/lighthouse.md", "gap"),
        ("atlas", "atlas/context/harbour/tides.md", "context"),
        ("atlas", "atlas/architecture/cranes.md", "architecture"),
        ("atlas", "atlas/docs/decisions/quay.md", "doc"),
        ("orchard", "orchard/gaps/lighthouse.md", "doc"),
        ("orchard", "orchard/presses/CLAUDE.md", "claude"),
        ("orchard", "AGENTS.md", "agents"),
        ("orchard", "orchard/docs/cellar/README.md", "readme"),
        ("orchard", "orchard/docs/tasks/harvest.md", "task"),
        ("atlas", "atlas/gaps/tasks/SKILL.md", "skill"),
    ],
)
def test_classify(spark, repo, path, kind):
    assert one(spark, text.classify(F.col("repo"), F.col("path"), "atlas"), repo=repo, path=path) == kind


def test_decision_number(spark):
    numbered = {"decisions/1234-Über-alles.md": "1234", "x/y/decisions/0000-a.Md": "0000", "decisions/9999---.md": "9999"}
    plain = ["olddecisions/1234-a.md", "decisions/1234-a/b.md", "decisions/12345-a.md", "decisions/123-a.md", "decisions/1234_a.md", "decisions/1234-a.txt", "1234-a.md", "decisions/1234-.md"]
    df = spark.createDataFrame([(p,) for p in [*numbered, *plain]], "p string")
    assert {r.p: r.n for r in df.select("p", text.decision_number(F.col("p")).alias("n")).collect()} == {**numbered, **dict.fromkeys(plain)}


def test_work_log(spark):
    logged = {"tasks/a/b.md": True, "m/tasks/a.md": True, "tasks": False, "multitasks/a.md": False, "m/tasks.md": False, "": False}
    df = spark.createDataFrame([(p,) for p in logged], "p string")
    assert {r.p: r.w for r in df.select("p", text.is_work_log(F.col("p")).alias("w")).collect()} == logged


def walked(source, target):
    """What a relative target names, step by step; None if it isn't relative or climbs out."""
    if not target.startswith(("./", "../")):
        return None
    at = source.split("/")[:-1]
    for step in target.split("/"):
        if step == ".." and not at:
            return None
        if step == "..":
            at.pop()
        elif step not in ("", "."):
            at.append(step)
    return "/".join(at)


def test_relative(spark):
    rng, sources = random.Random(0), ["pier/log/may.md", "pier/june.md", "july.md", "a/b/c/d/e.md"]
    pairs = [(s, "".join(rng.choice(["../", "./", "deck/", "mast/", "/"]) for _ in range(rng.randint(0, 5))) + "sail.md") for s in sources for _ in range(25)]
    pairs += [("pier/log/may.md", "..//../july.md"), ("pier/june.md", ".hidden/x.md"), ("pier/june.md", "...md")]
    got = spark.createDataFrame(pairs, "s string, t string").select("s", "t", text.resolve_relative(F.col("s"), F.col("t")).alias("x")).collect()
    assert len({r.x for r in got}) > 12 and all(r.x == walked(r.s, r.t) for r in got)


@pytest.mark.parametrize(
    ("body", "targets"),
    [
        ("the [[ Tide Tables ]], [[Tide Tables#May|in May]] and [[quay", ["Tide Tables"]),
        ("[[a|b#c]] [[d#e|f]] [[]] [[#g]] [[h]i]]", ["a", "d"]),
        ("![map](img/map.md) [m](map.md#north) [w](map.md north) [p](map.mdx)", ["img/map.md", "map.md"]),
        ("[[x] [y](in.md) [z] (out.md)", ["in.md"]),
        ("pier/log.md, (pier/log.md) and ./pier/mast.md; not pier.md", ["pier/log.md", "./pier/mast.md"]),
        ("épier/log.md pier/log.mdé pier/log.md_ pier/.md a//b.md a/b.md//c.md x/y.md.z", ["a/b.md", "x/y.md"]),
        ("``` \n[[a]]\n``` \n[[b]]\n    ```\n[[c]]", ["b", "c"]),
        ("~~~\n[[a]]\n```\nq/r.md\n~~~~\n[[s]]", ["s"]),
        ("`` [[a]] ` [[b]] `` [[c]] ` [[d]]\n[[e]] `", ["c", "d", "e"]),
        ("[x](ftp://h/a.md) [y](mailto:b.md) [z](//h/c.md) <http://h/d/e.md>", []),
        ("Decision: 1234/5678 & 9012 , and 3456", ["1234", "5678", "9012", "3456"]),
        ("adrs 1111 (was 2222; see 3333),4444 and 5555 (6666) 7777", ["1111", "2222", "3333", "4444", "5555"]),
        ("ADR 12345, decision 123, decisions: (1234), decisive 1234, myadr 1234, decision-1234", []),
        ("decision\u00a01234", ["1234"]),
        ("[[1234]] decision 1234 [q](p/q.md) p/q.md", ["1234", "p/q.md"]),
    ],
)
def test_body_links(spark, body, targets):
    assert one(spark, text.body_links(F.col("b")), b=body) == targets


def test_links_of_very_long_texts(spark):
    """Lists, paths and spans of a million characters; each would need a stack frame an item in a recursive matcher."""
    numbers = [f"{i % 10_000:04d}" for i in range(100_000)]
    steps = "a/" * 500_000
    bodies = {
        1: "decisions " + ", ".join(numbers),
        2: "adr " + " (why) and ".join(numbers[:60_000]),
        3: steps + "end.md",
        4: steps + "end.txt",
        5: "x.md/" * 200_000 + "tail",
        6: "`" + "a" * 1_000_000,
        7: "``" + " `b` " * 200_000 + "`` [[kept]]",
        8: "[" * 1_000_000 + "[x](y.md)",
        9: "[[" + "w" * 1_000_000 + "]]",
        10: "```\n" + "[[in]]\n" * 150_000,
        11: "b/" * 300_000 + "/c.md " + "word " * 100_000,
    }
    wanted = {
        1: list(dict.fromkeys(numbers)), 2: list(dict.fromkeys(numbers[:60_000])), 3: [steps + "end.md"], 4: [], 5: ["x.md/" * 199_999 + "x.md"],
        6: [], 7: ["kept"], 8: ["y.md"], 9: ["w" * 1_000_000], 10: [], 11: [],
    }
    df = spark.createDataFrame(list(bodies.items()), "i int, b string").repartition(4)
    got = {r.i: r.x for r in df.select("i", text.body_links(F.col("b")).alias("x")).collect()}
    assert all(got[i] == wanted[i] for i in bodies)


def test_chunk_ref(spark):
    want = "c" + hashlib.sha256("a/é.md\0A > B\0003".encode()).hexdigest()[:16]
    assert one(spark, text.chunk_ref(F.col("p"), F.col("h"), F.lit(3)), p="a/é.md", h="A > B") == want


@pytest.mark.parametrize(("raw", "want"), [("././/x.md", "x.md"), ("  ./A B ", "a b"), ("//Abs", "abs"), ("../up.md", "../up.md")])
def test_normalize(spark, raw, want):
    assert one(spark, text.normalize_target(F.col("t")), t=raw) == want


def test_keys(spark):
    keys = text.resolution_keys(F.col("r"), F.col("p"), F.col("t"))
    assert one(spark, keys, r="Pier", p="Pier/Log/May Tides.md", t=" Tides of May ") == ["pier/log/may tides.md", "log/may tides.md", "may tides.md", "may tides", "tides of may"]
    assert one(spark, keys, r="workspace", p="LOG.md", t="log") == ["log.md", "log"]


@pytest.mark.parametrize(("path", "out"), [("pier/old/log.md", True), ("quay/sheds/a.md", True), ("quay/sheds/b/c.md", True), ("quay/shed/a.md", False), ("older/log.md", False), ("pier/x.tmp.md", True)])
def test_excluded(spark, path, out):
    assert one(spark, text.excluded(F.col("p"), ["old", "quay/sheds/*", "*.tmp.md"]), p=path) is out


def test_recency_and_snippet(spark):
    age = text.recency(F.col("d"), F.lit(1704067200.0), F.lit("2024-07-01").cast("date"))
    assert one(spark, age, d="2024-07-01T10:00") == 1.0
    assert one(spark, age, d="20240103") == pytest.approx(0.5)
    assert one(spark, age, d="2030-01-01") == 1.0
    assert one(spark, age, d="soon") == pytest.approx(2 ** (-182 / 180))
    cut = one(spark, text.snippet(F.col("b")), b=" a \n\t b " * 100)
    assert len(cut) <= 240 and cut.endswith("…") and "  " not in cut
    assert one(spark, text.snippet(F.col("b")), b=" x\ny ") == "x y"


def test_lenient_decoding(spark):
    df = spark.createDataFrame([(bytearray(b"a\xffb\xc3"),)], "c binary")
    assert df.select(text.decode_lenient(F.col("c"))).first()[0] == b"a\xffb\xc3".decode(errors="replace")


def test_link_patterns_read_only_lines_that_can_hold_them(spark, monkeypatch):
    whole = r"(?s)^(.*)$"
    for name in ("PATH_RUN", "BARE_PATH", "INLINE_CODE"):
        monkeypatch.setattr(text, name, whole)
    assert one(spark, text.bare_paths(F.col("t")), t="long prose\nsee a/b.md now\nmore") == ["see a/b.md now"]
    assert one(spark, text.strip_code(F.col("t")), t="long prose\nsome `code`\nmore\n") == "long prose\n \nmore\n"


def test_link_patterns_line_by_line_find_what_they_find_in_the_whole(spark):
    parts = ["a/b.md", ".md", "`x/y.md`", "``", "`", "\n", "\r\n", " ", " ", "decision 0006", "xADR\n0007", "ADRs:\n0001 (why),\n0002", "é/c.md", "x.mdé", "//h/d.md", "word", "~~~\n", "```\n", "İDR 0009", "DECIſION 0010"]
    rows = [("".join(parts[(i * k + i // 7 + k) % len(parts)] for k in range(1, 14)),) for i in range(400)] + [(None,), ("",), ("\n",), ("a/b.md",), ("\na/b.md\n",)]
    df, old = spark.createDataFrame(rows, "t string"), text.CITATION.replace("(?=[AD])", "")
    stripped = F.regexp_replace(F.regexp_replace("t", text.FENCED, ""), text.INLINE_CODE, " ")
    runs = F.filter(F.regexp_extract_all("t", F.lit(text.PATH_RUN), F.lit(1)), lambda r: F.contains(r, F.lit(".md")))
    paths = F.filter(F.transform(runs, lambda r: F.regexp_extract(F.substring_index(r, "//", 1), text.BARE_PATH, 1)), lambda x: x != "")
    cited = F.flatten(F.transform(F.regexp_extract_all("t", F.lit(old), F.lit(1)), lambda r: F.regexp_extract_all(r, F.lit(r"(\d{4})"), F.lit(1))))
    t = F.col("t")
    got = df.select(stripped.alias("a"), text.strip_code(t).alias("b"), paths.alias("c"), text.bare_paths(t).alias("d"), cited.alias("e"), text.citations(t).alias("f")).collect()
    assert all(r.a == r.b and r.c == r.d and r.e == r.f for r in got)
    assert sum(bool(r.d) for r in got) > 50 and sum(bool(r.f) for r in got) > 50 and sum(r.b != x[0] for r, x in zip(got, rows, strict=True)) > 50
