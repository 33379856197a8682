"""Invariants over generated inputs."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from mosslight.llm import jpeg, mixing, packing, warc
from mosslight.llm.simhash import fingerprint


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=700), min_size=1, max_size=6))
def test_any_bytes_survive_the_picture(raws):
    padded = [x + bytes(-len(x) % 64) for x in raws]
    assert [jpeg.payload(p) for p in jpeg.decode(jpeg.encode(padded))] == padded


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 300), min_size=1, max_size=60), st.sampled_from([16, 64]))
def test_packing_covers_each_token_once_in_the_fewest_sequences(lengths, capacity):
    parts, tail = packing.assign(np.array(lengths), capacity)
    tokens = sorted((d, s + i) for d, s, n, *_ in [*parts, *tail] for i in range(n))
    assert tokens == [(d, i) for d, n in enumerate(lengths) for i in range(n)]
    places = [(q, o + i) for _, _, n, q, o in parts for i in range(n)]
    assert sorted(places) == [(q, o) for q in range(sum(lengths) // capacity) for o in range(capacity)]
    assert sum(n for _, _, n in tail) == sum(lengths) % capacity


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 900), st.floats(0, 2), st.integers(1, 5)), min_size=1, max_size=80))
def test_copies_stay_next_to_rates_and_near_the_words_owed(rows):
    import pandas as pd

    df = pd.DataFrame([(i, s, r, n) for i, (s, r, n) in enumerate(rows)], columns=["doc_id", "size", "rate", "n"])
    out = mixing.copies_in_shard(df)
    filled = out["size"] > 0
    assert (out["low"] == np.minimum(2, np.floor(out["rate"])) * filled).all() and (out["more"] <= out["n"] * filled * (out["low"] < 2)).all() and (out["more"] >= 0).all()
    taken = (out["size"] * (out["low"] * out["n"] + out["more"])).sum()
    assert abs(taken - (out["size"] * out["rate"] * out["n"]).sum()) <= max(s for s, _, _ in rows) + 1e-6


@given(st.text(max_size=80), st.binary(max_size=300), st.one_of(st.none(), st.integers(-5, 1 << 60)))
def test_records_read_back(url, payload, page_id):
    r = warc.parse_record(warc.record(page_id, url.encode("utf-8", "ignore").decode(), payload, None, "a#0"))
    assert r["payload"] == payload and r["length"] == len(payload) and r["WARC-Payload-Digest"] == "sha1:" + warc.digest(payload)
    assert isinstance(warc.url_key(url), str)


@given(st.text(alphabet="aB é\n\t", max_size=80))
def test_fingerprints_ignore_ascii_case_and_spacing(text):
    upper = "".join(c.upper() if c.isascii() else c for c in text)
    assert fingerprint(text) == fingerprint(upper) == fingerprint(" ".join(text.split(" ")))
