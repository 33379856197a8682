import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from mosslight.llm import packing
from mosslight.llm.word_tokens import WordTokens, word_tokens

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", " \n ", "Don't 're'll ÀÉ's don't. |x 12a3", "é İstanbul K ½ ǅ <|endoftext|>x", "\x1c a\x85b​c", "ß. ẞ ÿ µ ª × ÷x", "</w> w</w>"]


def own_ids(text):
    return Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids


def test_cached_ids_equal_the_tokenizers():
    tokens = WordTokens(PATH, cache_words=40)
    for texts in (ODD, ODD[::-1], ["one two three " * 30, "four five; one"]):
        plain = Tokenizer.from_file(PATH)
        plain.encode_special_tokens = True
        want = [np.array(plain.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]
        assert tokens.encode(texts) == want


def test_ids_equal_those_of_the_tokenizer_as_loaded(spark):
    texts = [*ODD, "end <|endoftext|> next", "<|startoftext|><|endoftext|>", "a<|ENDOFTEXT|>b", "x <| y |> endoftext", "end next"]
    want = [np.array(own_ids(t), dtype="<u4").tobytes() for t in texts]
    assert word_tokens(PATH).encode(texts) == want
    got = {r.doc_id: r for r in packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).where("start = 0").collect()}
    ids = [np.array([*own_ids(t), 2], dtype="<u4") for t in texts]
    assert {i: (r.doc_tokens, r.ids_crc32) for i, r in got.items()} == {i: (len(x), zlib.crc32(x[: got[i].length].tobytes())) for i, x in enumerate(ids)}


def test_assignment_fills_sequences():
    rng = np.random.default_rng(0)
    lengths = np.r_[rng.integers(1, 5000, 400), [4096, 8192, 1, 1, 20_000]]
    parts, tail = packing.assign(lengths)
    assert sum(n for _, _, n in tail) == lengths.sum() % 4096
    by_doc, by_seq = {}, {}
    for d, s, n, q, o in parts:
        by_doc.setdefault(d, []).append((s, n))
        by_seq.setdefault(q, []).append((o, n))
    for d, s, n in tail:
        by_doc.setdefault(d, []).append((s, n))
    for table, most in ((by_doc, None), (by_seq, 4096)):
        for k, v in table.items():
            at = 0
            for a, n in sorted(v):
                assert a == at and n > 0
                at += n
            assert at == lengths[k] if most is None else at <= most
    assert len(by_seq) == lengths.sum() // 4096 and sorted(by_seq) == list(range(len(by_seq)))
    assert len(parts) < 1.5 * (len(lengths) + (lengths // 4096).sum())


def test_whole_pieces_keep_their_order_and_room():
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 900, 400)
    place = packing.assign_whole(lengths)
    by_seq = {}
    for n, (q, o) in zip(lengths.tolist(), place, strict=True):
        by_seq.setdefault(q, []).append((o, n))
    for v in by_seq.values():
        assert np.cumsum([0, *(n for _, n in sorted(v))])[:-1].tolist() == [o for o, _ in sorted(v)] and sum(n for _, n in v) <= 4096
    assert len(by_seq) <= -(-lengths.sum() // 4096) + 1 and packing.assign_whole(np.array([], dtype=int)) == []


def test_many_small_partitions_pad_little(spark):
    rng = np.random.default_rng(2)
    rows = [(i, "word " * int(rng.integers(20, 1500)), "z") for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard string")
    got = packing.pack(df.repartition(24)).collect()
    by_seq, by_doc = {}, {}
    for r in got:
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
        by_doc.setdefault(r.doc_id, []).append((r.start, r.length, r.doc_tokens))
    for v in by_seq.values():
        assert np.cumsum([0, *(n for _, n in sorted(v))])[:-1].tolist() == [o for o, _ in sorted(v)] and sum(n for _, n in v) <= 4096
    for v in by_doc.values():
        assert np.cumsum([0, *(n for _, n, _ in sorted(v))]).tolist() == [*(s for s, _, _ in sorted(v)), v[0][2]]
    total = sum(r.length for r in got)
    assert len(by_doc) == 600 and total == sum(len(t.split()) + 1 for _, t, _ in rows) and len(by_seq) * 4096 < 1.03 * total


def test_a_tokenizer_of_another_split_encodes_whole_texts(tmp_path):
    import json

    spec = json.loads(open(PATH, encoding="utf-8").read())
    spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] = r"[\p{L}]+|[\p{N}]+|[^\s\p{L}\p{N}]+"
    (tmp_path / "t.json").write_text(json.dumps(spec), encoding="utf-8")
    texts = ["it's 12 of 345 words", "don't"]
    want = [np.array(Tokenizer.from_file(str(tmp_path / "t.json")).encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]
    assert word_tokens(str(tmp_path / "t.json")).encode(texts) == want != word_tokens(PATH).encode(texts)


def test_rows(spark):
    rows = [(1, "hello world", 9), (2, None, 9), (2, None, 9), (None, "no id", 9), (3, "long text here " * 6000, 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, start long")
    got = packing.pack(df, shard_tokens=8000).collect()
    pieces = {}
    for r in got:
        pieces.setdefault(r.doc_id, []).append(r)
    for i, text, _ in rows:
        ids = np.array([*own_ids(text or ""), 2], dtype="<u4")
        for r in pieces[i]:
            assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    assert sum(r.length for r in pieces[3]) == len(own_ids(rows[4][1])) + 1 and len(pieces[2]) == 2
    assert packing.pack(df.where(F.lit(False))).count() == 0
