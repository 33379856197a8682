import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from mosslight.llm import language_id, mixing, quality_classifier
from tests.llm import brute

SYLLABLES = {"xx": "ka to mi ru sen hal".split(), "yy": "éa ou ñi ßer thö zul".split(), "zz": "bra gno pli stu vex qua".split()}


def prose(lang, n, rng):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


def test_language_id_on_held_out_documents(spark):
    rng = random.Random(0)
    rows = [(i, prose(lang, rng.randint(5, 120), rng), lang) for i in range(240) for lang in [rng.choice(list(SYLLABLES))]]
    rows += [(1000, None, "xx"), (1001, "12 -- 3", "yy"), (1002, "", None), (None, prose("zz", 40, rng), None), (1003, "KA TO " + prose("xx", 200_000, rng), None), (5, rows[5][1], rows[5][2])]
    df = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, lang string, score double")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    model = language_id.train(language_id.sample(df, ~held, per_lang=60))
    got = language_id.identify(df, model).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert [(by[i].lang_pred, by[i].score, by[i].accepted) for i in (1000, 1001, 1002)] == [("und", 0.0, False)] * 3
    assert by[None].lang_pred == "zz" and by[1003].lang_pred == "xx"
    judged = [(lang, by[i].lang_pred) for i, _, lang in rows[:240]]
    assert sum(a == b for a, b in judged) >= 0.97 * len(judged) and all(0 <= r.score <= 1 for r in got)
    assert {r.lang_pred for r in language_id.identify(df, None).collect()} == {"und"}
    assert language_id.sample(df.where(F.lit(False)), ~held) == []
    assert language_id.identify(df.where(F.lit(False)), model).count() == 0
    for r in got:
        text = next(t for i, t, _ in rows if i == r.doc_id)
        if text and len(text) < 2000 and r.lang_pred != "und":
            z = np.array([(x + b) / model.temperature for x, b in zip(plain_average(text, model.scores.astype(float)), model.bias, strict=True)])
            p = np.exp(z - z.max())
            assert abs(r.score - p.max() / p.sum()) < 1e-5 and r.lang_pred == model.langs[int(p.argmax())]


def plain_average(text, scores):
    """The mean row over the buckets of all 2-, 3- and 4-byte windows, hashed one at a time."""
    raw, total, n = b"   " + text.lower().encode() + b"   ", np.zeros(scores.shape[1]), 0
    padded, full = raw + b"   ", 0xFFFFFFFF
    for i in range(len(raw)):
        h = padded[i] * 2654435761 & full
        for order in (2, 3, 4):
            h = (h ^ padded[i + order - 1]) * 2246822519 & full
            h ^= h >> 15
            total, n = total + scores[h % language_id.BUCKETS], n + 1
    return total / n


def test_language_sample_has_a_floor_and_reads_whole_texts(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(i, f"text {i} of many", "big") for i in range(600)] + [(1000 + i, f"rare {i}", f"l{i % 8}") for i in range(40)] + [(2000, "tail " + "ab " * 60_000, "long"), (2000, "tie", "long"), (None, "no id", "long")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 as n", "2 as rate", "3 as draw", "4 as counted")
    got = language_id.sample(df, F.lit(True), most=50, floor=4)
    by = {}
    for x in got:
        by.setdefault(x.lang, []).append(x)
    assert {k: len(v) for k, v in by.items()} == {"big": 5, "long": 3, **{f"l{i}": 5 for i in range(8)}}
    whole = max(by["long"], key=lambda x: x.counts.sum())
    assert whole.counts.sum() == 3 * (len(rows[-3][1]) + 6)
    text = prose("yy", 80, rng)
    one = language_id.Sample.of("yy", text)
    monkeypatch.setattr(language_id, "WINDOW", 50)
    two = language_id.Sample.of("yy", text)
    assert (one.found == two.found).all() and (one.counts == two.counts).all()


def test_average_does_not_depend_on_the_batch(monkeypatch):
    rng = np.random.default_rng(0)
    scores, texts = rng.normal(size=(language_id.BUCKETS, 3)), ["a", "", "wörds and more", "x" * 500, "tail"]
    alone = np.concatenate([language_id.averages([t], scores) for t in texts])
    assert np.allclose(language_id.averages(texts, scores), alone)
    monkeypatch.setattr(language_id, "WINDOW", 50)
    assert np.allclose(language_id.averages(texts, scores), alone)


def test_quality_classifier(spark):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(400):
        junk, toxic = i % 5 == 0, i % 7 == 0
        words = [w + ("%%%" if junk else "") for w in prose("xx", rng.randint(30, 120), rng).split()]
        for w in ("nasty", "awful", "vile") if toxic else ():
            words.insert(rng.randrange(len(words)), w)
        rows.append((i, " ".join(words), f"h{i % 4}", "p"))
        if i % 2:
            labels.append((i, int(not junk), int(toxic)))
    rows += [(1000, None, None, None), (1001, "", "h0", None), (None, prose("xx", 50, rng), "h1", "p"), (3, rows[3][1], "h3", "p")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    marked = spark.createDataFrame([*labels, (1000, 0, None)], "doc_id long, quality int, toxic int")
    got = quality_classifier.classify(docs, marked).collect()
    assert len(got) == len(rows) and all(0 <= r.quality <= 1 and 0 <= r.toxicity <= 1 for r in got)
    by = {r.doc_id: r for r in got}
    even = [i for i in range(0, 400, 2)]
    assert sum(by[i].kept == (i % 5 != 0 and i % 7 != 0) for i in even) >= 0.95 * len(even)
    clash = docs.selectExpr("*", "1 as host", "2 as path", "3 as quality", "4 as half", "5 as `a.b`")
    assert sorted(map(str, quality_classifier.classify(clash, marked).collect())) == sorted(map(str, got))
    neutral = quality_classifier.classify(docs, marked.where(F.lit(False))).collect()
    assert len(neutral) == len(rows) and len({round(r.quality, 6) for r in neutral}) <= 8
    assert quality_classifier.classify(docs.where(F.lit(False)), marked).count() == 0


def plain_posteriors(rows, base):
    """(host rate, path rate, posterior) of (host, path, ratio) rows, summed over lists."""
    odds = math.log(base / (1 - base))
    own = [1 / (1 + math.exp(-(r + odds))) for _, _, r in rows]
    hosts, paths = {}, {}
    for (h, p, _), x in zip(rows, own, strict=True):
        hosts.setdefault(h, []).append(x)
        paths.setdefault((h, p), []).append(x)
    n, k = len(rows), sum(own)
    a, b = quality_classifier.beta_prior(n, k, len(hosts), float(sum(len(v) ** 2 for v in hosts.values())), sum(sum(v) ** 2 / len(v) for v in hosts.values()))
    spread = noise = room = 0.0
    for (h, _), v in paths.items():
        rate, part = sum(hosts[h]) / len(hosts[h]), 1 - len(v) / len(hosts[h])
        spread += len(v) * (sum(v) / len(v) - rate) ** 2
        noise += rate * (1 - rate) * part
        room += rate * (1 - rate) * (len(v) - 1) * part
    rho = (spread - noise) / room if room else 0.0
    w = min(10_000.0, max(2.0, 1 / rho - 1)) if rho > 0 else 10_000.0
    out = []
    for (h, p, r), x in zip(rows, own, strict=True):
        host, path = hosts[h], paths[h, p]
        whole = (sum(host) + a) / (len(host) + a + b)
        others = (sum(host) - x + a) / (len(host) - 1 + a + b)
        rest = (sum(path) - x + w * others) / (len(path) - 1 + w)
        out.append((whole, (sum(path) + w * whole) / (len(path) + w), 1 / (1 + math.exp(-(r + math.log(rest / (1 - rest)))))))
    return out


def test_posteriors_against_lists(spark):
    rng = random.Random(2)
    rows = [(h, p, rng.gauss(mean, 1)) for h, p, n, mean in (("a", "x", 30, 2), ("a", "y", 20, -3), ("b", "x", 1, 4), (None, None, 7, 0), ("c", None, 15, -1), ("c", "z", 40, 1)) for _ in range(n)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id int, host string, path string, quality double")
    for base in (0.3, 0.85):
        got = sorted(quality_classifier.combine(df, {"quality": base}).collect(), key=lambda r: r.doc_id)
        for r, want in zip(got, plain_posteriors(rows, base), strict=True):
            assert (r.quality_host, r.quality_path, r.quality_post) == pytest.approx(want, rel=1e-9)


def test_learned_weights_against_counts(spark):
    texts = ["good fine words here"] * 20 + ["bad foul words here"] * 30 + ["odd " + "x" * 70_000] * 4
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, "none")], "doc_id long, text string")
    marks = spark.createDataFrame([(i, int(i < 20)) for i in range(54)] + [(3, 1), (None, 1), (99, 0)], "doc_id long, quality int")
    sample = quality_classifier.labelled(docs, marks, ["quality"])
    assert sample.count() == 54 and quality_classifier.labelled(docs, marks, ["quality"], most=10).count() <= 10
    weights = quality_classifier.learn(sample, ["quality"])["quality", "all"]
    assert weights["good"] == pytest.approx(math.log(20.5 / 21) - math.log(0.5 / 35)) and weights["bad"] < 0 and "words" not in weights
    assert "x" * 70_000 in {t for r in sample.collect() for t in r.found}


def test_mixing(spark):
    rng = random.Random(3)
    rows = []
    for s, n in (("b", 3000), ("a", 40), ("é", 300), (None, 200), ("c", 150), ("Z", 60)):
        rows += [(len(rows) + i, " ".join(["w"] * int(rng.paretovariate(1.2) * 8)), s) for i in range(n)]
    rows += [(50_000, None, "b"), (50_001, "", "empty"), (7, rows[7][1], "b"), (None, "w w w", "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = mixing.mix(mixing.size_table(df)).collect()
    assert len(got) == len(rows)
    by_source = {}
    for _, t, s in rows:
        by_source.setdefault(s, []).append(len((t or "").split()))
    want = brute.targets(by_source)
    source_of = {}
    for i, t, s in rows:
        source_of[i] = s
    taken = dict.fromkeys(want, 0)
    for r in got:
        s = source_of[r.doc_id]
        assert brute.near(r.target, want[s]) and r.source_size == sum(by_source[s])
        assert r.taken == r.copies * r.size and 0 <= r.copies <= 2
        taken[s] += r.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= 0.01 * t + 20
    key = lambda r: (str(r.doc_id), r.size, r.copies, r.taken)
    assert sorted(map(key, mixing.mix(mixing.size_table(df.repartition(7))).collect())) == sorted(map(key, got))
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns and sum(len((r.text or "").split()) for r in out.collect()) == sum(taken.values())
    assert mixing.mix(mixing.size_table(df.where(F.lit(False)))).count() == mixing.mixed_documents(df.where(F.lit(False))).count() == 0


def bisected(sizes, target):
    """The tilt that makes the expected words of a source meet its target, found without derivatives."""
    mean, low, high = sum(sizes) / len(sizes), -60.0, 60.0
    words = lambda t: sum(s * 2 / (1 + math.exp(min(700.0, -(math.log(3) + t * s / mean)))) for s in sizes)
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if words(mid) < target else (low, mid)
    return (low + high) / 2


def test_mixing_rates_equal_an_independent_solution(spark):
    rng = random.Random(4)
    sizes = {s: [int(rng.paretovariate(1.5) * 10) for _ in range(n)] for s, n in (("a", 300), ("b", 500), ("c", 900))}
    docs = [(i, "w " * n, s) for s, x in sizes.items() for i, n in enumerate(x)]
    got = mixing.mix(mixing.size_table(spark.createDataFrame(docs, "doc_id long, text string, source string"))).collect()
    want = brute.targets(sizes)
    assert any(t < 2 * sum(sizes[s]) for s, t in want.items())
    rates = {(r.source_size, r.doc_id): r.rate for r in got}
    for s, x in sizes.items():
        t, mean = want[s], sum(x) / len(x)
        tilt = bisected(x, t) if t < 2 * sum(x) else math.inf
        for i, n in enumerate(x):
            rate = 2 / (1 + math.exp(min(700.0, -(math.log(3) + tilt * n / mean))))
            assert abs(rates[sum(x), i] - rate) < 1e-5


def test_mixing_of_equal_ids_long_texts_and_clashing_columns(spark):
    rows = [(7, "a b c", "s", i) for i in range(9)] + [(7, "d e f", "s", 100 + i) for i in range(8)] + [(None, "x " * 400_000, None, 0), (8, "", "s", 1), (8, None, "s", 1)]
    cols = "doc_id long, text string, source string, place_row int"
    df = spark.createDataFrame(rows, cols).selectExpr("*", "'n' as n", "0 as size", "1 as target", "2 as `a.b`")
    got = mixing.mix(mixing.size_table(df)).collect()
    assert len(got) == len(rows) and {r.size for r in got} == {0, 3, 400_000}
    runs = [mixing.mixed_documents(df.repartition(k)) for k in (1, 3)]
    assert runs[0].columns == df.columns
    texts = [sorted((r.doc_id or 0, r.text[:9]) for r in run.collect()) for run in runs]
    assert texts[0] == texts[1] and sum(len(r.text.split()) for r in runs[0].collect()) == sum(r.taken for r in got)
