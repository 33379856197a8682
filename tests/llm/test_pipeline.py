import random

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from tests.llm import brute
from tests.llm.test_simhash import brute_components, brute_fingerprint

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rng = random.Random(9)
    vocab = [f"word{i}" for i in range(3000)]
    line = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    docs = ["\n".join(line(rng.randint(6, 20)) for _ in range(rng.randint(6, 14))) for _ in range(60)]
    docs += [docs[3], docs[4] + " tail", docs[5], "short", None, "", " ".join(["| spam"] * 80), docs[6] + "\n" + docs[7]]
    docs += [line(300), docs[-1]]
    return [(i, t, "xx", f"s{i % 3}", len(t or "")) for i, t in enumerate(docs)] + [(200, docs[8], None, None, None), (200, docs[8], None, None, None)]


def test_stages_against_plain_python(spark, tmp_path):
    rows = corpus()
    docs = spark.createDataFrame(rows, COLUMNS)
    path = str(tmp_path / "documents.parquet")
    docs.write.parquet(path)
    docs, seen = spark.read.parquet(path), []
    for name, f in corpus_pipeline.STAGES:
        f(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        seen.append(out.collect())
        if name != "packing":
            assert out.columns == docs.columns
        docs = out
    quality, lines, near, mixed, packed = seen

    key = lambda r: (r[0], str(r[1]))
    stats = [brute.rule_row(t) for _, t, *_ in rows]
    good = [r for r, (n, chars, marks, _, rep) in zip(rows, stats, strict=True) if n >= 50 and 2 * rep <= n and 20 * marks <= chars]
    assert sorted(map(tuple, quality), key=key) == sorted(good, key=key)

    texts = brute.dedup_lines([(r[0], r[1]) for r in good])
    assert sorted(((r.doc_id, r.text) for r in lines), key=key) == sorted(((r[0], t) for r, t in zip(good, texts, strict=True)), key=key)
    assert all(r.n_chars == len(r.text) for r in lines)

    fps = {r.doc_id: brute_fingerprint(r.text) for r in lines}
    label = brute_components(set(fps.values()))
    first = {}
    for i, fp in fps.items():
        first[label[fp]] = min(i, first.get(label[fp], i))
    assert sorted(r.doc_id for r in near) == sorted(first.values())

    count = {r.doc_id: sum(m.doc_id == r.doc_id for m in mixed) for r in near}
    assert set(count.values()) <= {0, 1, 2} and {m.doc_id for m in mixed} <= set(count)
    by_source = {}
    for r in near:
        by_source.setdefault(r.source, []).append(len(r.text.split()))
    size_of = {r.doc_id: len(r.text.split()) for r in near}
    for s, t in brute.targets(by_source).items():
        assert abs(sum(size_of[m.doc_id] for m in mixed if m.source == s) - t) <= max(0.1 * t, 100)

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tokens = {m.doc_id: len(tok.encode(m.text, add_special_tokens=False).ids) + 1 for m in mixed}
    assert sum(r.length for r in packed) == sum(tokens[m.doc_id] for m in mixed)
    ends = {}
    for r in packed:
        ends.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all(np.cumsum([0, *(n for _, n in sorted(v))])[:-1].tolist() == [o for o, _ in sorted(v)] and sum(n for _, n in v) <= 4096 for v in ends.values())


def test_run_and_empty(spark, tmp_path):
    spark.createDataFrame(corpus(), COLUMNS).write.parquet(str(tmp_path / "a/documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "a")).count() > 50
    spark.createDataFrame([], COLUMNS).write.parquet(str(tmp_path / "b/documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "b")).count() == 0


def test_registered():
    names = set(__spark_entry__.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))
    assert set(__spark_entry__.oracle_sql()) <= names and F is not None
