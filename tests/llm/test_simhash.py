import random

import xxhash
from pyspark.sql import functions as F

from mosslight.llm import simhash
from mosslight.llm.components import components


def brute_fingerprint(text):
    raw = (text or "").encode()
    words = bytes(c + 32 if 65 <= c <= 90 else c for c in raw).split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    parent = {x: x for x in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    fps = sorted(parent)
    for i, x in enumerate(fps):
        for y in fps[:i]:
            if (x ^ y).bit_count() <= 3:
                a, b = find(x), find(y)
                parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in fps}


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_fingerprint():
    for text in (None, "", " \n", "one", "Two Words", "A b c", "É É é x y z " * 7, "a b c d e f g h"):
        assert simhash.fingerprint(text) % (1 << 64) == brute_fingerprint(text)


def test_components_of_clusters_and_crowded_keys(spark):
    rng = random.Random(3)
    fps = {0, (1 << 64) - 1}
    for _ in range(40):
        x = rng.getrandbits(64)
        for _ in range(25):
            y = x
            for _ in range(rng.randint(0, 5)):
                y ^= 1 << rng.randrange(64)
            fps.add(y)
    tail = rng.getrandbits(32) << 32
    fps |= {tail | rng.getrandbits(32) for _ in range(300)} | {tail | rng.getrandbits(7) for _ in range(60)}
    near = tail | 0x5A5A0000 | rng.getrandbits(4)
    fps |= {near ^ (rng.getrandbits(8) << 8 * rng.randrange(2)) for _ in range(120)} | {near ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(60)}
    want = brute_components(fps)
    df = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    for crowded in (4, 100_000):
        roots = {r["node"]: r["root"] for r in components(simhash.links(df, crowded)).collect()}
        label = {x: roots.get(signed(x), signed(x)) for x in fps}
        assert len(set(label.values())) == len(set(want.values()))
        assert len({(label[x], want[x]) for x in fps}) == len(set(want.values()))


def test_near_duplicates_and_keep_one(spark):
    long = " ".join(f"w{i}" for i in range(900))
    rows = [(5, long, "x"), (3, long + " tail", "x"), (3, long + " tail", "x"), (9, None, None), (8, "", "y"), (None, long, "y"), (1, "quite another text of its own here", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = simhash.near_duplicates(df)
    want = brute_components({brute_fingerprint(t) for _, t, _ in rows})
    by = {}
    for i, t, _ in rows:
        by.setdefault(want[brute_fingerprint(t)], []).append(i)
    first = {k: min((i for i in v if i is not None), default=None) for k, v in by.items()}
    assert sorted((r.doc_id or -1, r.fingerprint, r.component_id) for r in got.collect()) == sorted((i or -1, f"{brute_fingerprint(t):016x}", first[want[brute_fingerprint(t)]]) for i, t, _ in rows)
    assert sorted(r.doc_id for r in simhash.keep_one(df).collect()) == sorted(first.values())
    assert simhash.keep_one(df).columns == df.columns
    assert simhash.near_duplicates(df.where(F.lit(False))).count() == 0


def test_a_run_over_many_batches_is_linked_once_whole():
    import pyarrow as pa

    fps = [0, 1, 3, 1 << 40, (1 << 40) | 5, 1 << 63]
    rows = [(7, 0, x, 0) for x in sorted(map(signed, fps))] + [(8, 0, signed(1 << 50), 0), (8, 1, signed(3 << 50), 0)]
    batch = lambda part: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int32()), strict=True)], names=["key", "run", "fp", "sought"])
    pairs = lambda size: {(a, b) for out in simhash._link(batch(rows[i : i + size]) for i in range(0, len(rows), size)) for a, b in zip(*out.to_pydict().values(), strict=True)}
    assert pairs(1) == pairs(3) == pairs(100) != set()


def test_very_long_texts_and_clashing_columns(spark):
    long = " ".join(f"w{i % 5000}" for i in range(150_000))
    assert simhash.fingerprint(long) % (1 << 64) == brute_fingerprint(long)
    rows = [(i, t, i, "k") for i, t in enumerate([long, long, "other words here", None])]
    df = spark.createDataFrame(rows, "doc_id long, text string, place_row int, row string").selectExpr("*", "1 as `a.b`", "2 as first", "3 as fp")
    out = simhash.keep_one(df)
    assert out.columns == df.columns and sorted(r.doc_id for r in out.collect()) == [0, 2, 3]
    assert simhash.near_duplicates(df).count() == 4
