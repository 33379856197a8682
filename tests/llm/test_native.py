import random

from pyspark.sql import functions as F

from mosslight.llm import license_scan, line_dedup, quality_rules
from tests.llm import brute

ODD = [None, "", " \n\t ", "one", "a b c", "a b c a b c", "x x x x x", "é|é & <b> " * 30, "same line\nother\nsame line\n \n \nsame line", "w\x0bv\x0cu\r\nz  y", "word " * 30_000, "q" * 200_000]


def texts(n, seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(40)]
    return ["\n".join(" ".join(rng.choice(vocab) for _ in range(rng.randint(0, 12))) for _ in range(rng.randint(1, 12))) for _ in range(n)]


def test_rule_statistics(spark):
    rows = list(enumerate(ODD + texts(60, 1)))
    df = spark.createDataFrame([(i, t, None, 5) for i, t in rows], "doc_id long, text string, source string, n_words int")
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality_rules.rule_statistics(df).collect()}
    assert got == {i: brute.rule_row(t) for i, t in rows}


def test_host_verdicts_and_kept(spark):
    good = " ".join(f"word{i}" for i in range(80))
    meh = good + " |" * 8
    junk = " ".join(f"w{i} |||" for i in range(80))
    rows = [(i, junk, "bad") for i in range(300)] + [(1000, good, "bad"), (1001, meh, "bad")] + [(2000 + i, good, f"h{i % 5}") for i in range(300)] + [(3000, meh, "h0"), (3001, meh, None), (3001, meh, None), (None, good, "h1"), (3002, None, "h2")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("kept", F.lit("mine"))
    judged = quality_rules.judge(df).collect()
    assert len(judged) == len(rows)
    suspect = {r.host for r in judged if r.host_suspect}
    assert suspect == {"bad"}
    kept = {r.doc_id for r in judged if r.kept}
    assert {1000, 3000, 3001, None} <= kept and not kept & ({1001, 3002} | set(range(300)))
    out = quality_rules.filter_documents(df)
    assert out.columns == df.columns and out.count() == sum(r.kept for r in judged) and {r.doc_id for r in out.collect()} == kept
    none = df.where(F.lit(False))
    assert quality_rules.judge(none).count() == quality_rules.filter_documents(none).count() == 0


def test_beta_prior():
    assert quality_rules.beta_prior(0, 0, 0, 0.0, 0.0) == (1.0, 1.0)
    a, b = quality_rules.beta_prior(100, 10, 1, 10_000.0, 1.0)
    assert a / (a + b) == 0.1 and a + b == 10_000
    n = [50] * 20
    k = [2] * 10 + [40] * 10
    a, b = quality_rules.beta_prior(1000, sum(k), 20, sum(x * x for x in n), sum(y * y / x for x, y in zip(n, k, strict=True)))
    assert 2 <= a + b < 5


def test_line_dedup(spark):
    rng = random.Random(2)
    passage = ["first shared line", "  second shared line", "third shared line\t", "fourth"]
    docs = []
    for i, t in enumerate(texts(40, 3)):
        lines = t.split("\n")
        if i % 3 == 0:
            at = rng.randint(0, len(lines))
            lines[at:at] = passage[: rng.randint(2, 4)] + [""] + passage[-1:]
        docs.append((i, "\n".join(lines)))
    docs += [(100, "a\na\na\na\na"), (101, None), (102, ""), (103, "\n".join(passage)), (104, "\n".join(passage)), (104, "\n".join(passage)), (None, "\n".join(passage)), (105, "x\n\n \ny\nz"), (106, "y\nx\ny\nz")]
    docs += [(200, "\n".join(f"l{i}" for i in range(60_000))), (201, "\n".join(f"l{i}" for i in range(59_000, 60_000)))]
    df = spark.createDataFrame([(i, t, "s", 3, 4) for i, t in docs], "doc_id long, text string, source string, covered int, place_row int")
    got = line_dedup.dedup_lines(df)
    assert got.columns == [*df.columns, "n_lines", "n_removed"]
    key = lambda r: (str(r[0]), str(r[1]))
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=key) == sorted(zip([i for i, _ in docs], brute.dedup_lines(docs), strict=True), key=key)
    everything = {x.strip() for _, t in docs if t for x in t.split("\n")}
    assert {x.strip() for r in got.collect() if r.text for x in r.text.split("\n")} | {""} == everything | {""}
    assert line_dedup.dedup_lines(df.where(F.lit(False))).count() == 0


def test_license_scan(spark):
    rows = {
        1: "Released under the MIT License.",
        2: "foo Licensed under the Apache License, Version 2.0. bar " * 2,
        3: "Licensed under CC BY-NC 4.0.",
        4: "This work is licensed under the GNU General Public License, version 3.",
        5: "ALL  rights\nreserved; cc-by cc by cc. by",
        6: "mit dem license general public",
        7: None,
        8: "",
        9: "Kelvin K cc by É cc éby",
        10: "rights reserved all rights",
        11: "x " * 20_000 + "all rights reserved",
        12: "license mit the under released",
        13: "Copyright (c) 2020 Someone. All rights reserved.",
    }
    df = spark.createDataFrame([(i, t, 7) for i, t in rows.items()] + [(1, rows[1], 7)], "doc_id long, text string, n_words int")
    got = {r.doc_id: r for r in license_scan.scan(df).collect()}
    assert license_scan.scan(df).count() == len(rows) + 1
    labels = {1: "mit", 2: "apache-2.0", 3: "cc-by,cc-by-nc", 4: "gpl,gpl-3.0", 5: "cc-by,reserved", 9: "cc-by", 11: "reserved", 13: "copyright,reserved"}
    assert {i: r.labels for i, r in got.items()} == {i: labels.get(i, "") for i in rows}
    assert (got[5].n_base, got[5].first_word, got[5].last_word, got[5].base_labels) == (4, 0, 7, "cc-by,reserved")
    assert (got[9].n_words, got[9].n_base, got[9].first_word) == (7, 1, 2) and (got[11].first_word, got[7].n_words, got[7].first_word) == (20_000, 0, None)
    assert all(0 <= r.score <= 1 and (r.score > 0) == (r.labels != "") for r in got.values())
    assert license_scan.scan(df.where(F.lit(False))).count() == 0


def test_license_scan_of_several_notices(spark):
    gpl, apache = "licensed under the GNU General Public License, version 3", "licensed under the Apache License, Version 2.0"
    rows = {
        1: f"{apache} or licensed under the MIT license",
        2: f"{gpl} or licensed under the MIT license",
        3: f"{gpl}. {apache}. licensed under CC BY-NC 4.0.",
        4: "0 1 2 3 4 cc0 sa nc isc mozilla. Released under the MIT License.",
    }
    rest = [(10 + i, "license released licensed mit") for i in range(30)]
    got = {r.doc_id: r.labels for r in license_scan.scan(spark.createDataFrame([*rows.items(), *rest], "doc_id long, text string")).collect()}
    assert {i: got[i] for i in rows} == {1: "apache-2.0,mit", 2: "gpl,gpl-3.0,mit", 3: "apache-2.0,cc-by,cc-by-nc,gpl,gpl-3.0", 4: "mit"}
    assert not any(got[i] for i, _ in rest)
    plain = license_scan.scan(spark.createDataFrame([(1, rows[1])], "doc_id long, text string"), templates=(license_scan.Template("any", "apache ? version 2", ()),))
    assert plain.first().labels == "any"


def test_license_scan_tells_long_names_apart(spark):
    notice = "licensed under the GNU {} Public License, version 3"
    body = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software)"
    rows = {
        1: notice.format("Affero General"),
        2: notice.format("Lesser General"),
        3: notice.format("General"),
        4: notice.format("Affero General") + " or " + notice.format("General"),
        5: "/* " + body.replace(" ", "\n * ") + " */",
        6: "under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License",
        7: "AGPL: " + notice.format("Affero General") + "; redistribution and use in source and binary forms; subject to the terms of the Mozilla Public License; CC0 1.0 Universal Public Domain Dedication; licensed under the ISC license; licensed under the MIT license; licensed under the Apache License, Version 2.0",
        8: "word " * 30_000 + body + " word" * 30_000,
    }
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows.items()], "doc_id long, text string, row_id string, found string")
    got = {r.doc_id: r.labels for r in license_scan.scan(df).collect()}
    assert got == {1: "agpl,gpl", 2: "gpl,lgpl", 3: "gpl,gpl-3.0", 4: "agpl,gpl,gpl-3.0", 5: "mit", 6: "agpl,gpl", 7: "agpl,apache-2.0,bsd,cc0,gpl,isc,mit,mpl-2.0", 8: "mit"}


def test_license_template_from_a_text(spark):
    text = "The quick licence permits any fox to jump over the lazy dog without fee. The fox must keep this notice."
    made = license_scan.template("fox", text, {"the": 9, "fox": 3, "any": 8, "to": 7}, keys=3, most_common=8)
    assert made.words.startswith("? quick licence permits any fox") and len(made.key) == 3 and "the" not in made.key
    df = spark.createDataFrame([(1, "x " + text), (2, text.replace("lazy", "busy")), (3, text.replace("quick", "slow").replace(made.key[0], "zzz"))], "doc_id long, text string")
    assert {r.doc_id: r.labels for r in license_scan.scan(df, templates=(made,)).collect()} == {1: "fox", 2: "fox", 3: ""}
