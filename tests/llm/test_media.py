import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from mosslight.llm import jpeg, media

#: A code of several lengths for the test: counts by length, then symbols (run * 16 + size).
DC = bytes([0, 2, 3, 0, *[0] * 12, 0, 1, 2, 3, 8])
AC = bytes([0, 1, 2, 2, 4, *[0] * 11, 0x00, 0x01, 0x02, 0xF0, 0x11, 0x03, 0x21, 0x08, 0x5A])


def codes(table):
    out, code, at = {}, 0, 16
    for n in range(1, 17):
        for _ in range(table[n - 1]):
            out[table[at]], code, at = f"{code:0{n}b}", code + 1, at + 1
        code <<= 1
    return out


def put(v):
    n = abs(v).bit_length()
    return n, f"{v if v > 0 else v + (1 << n) - 1:0{n}b}" if n else ""


def scalar_scan(mcus, restart, comps):
    """Entropy-coded bytes of MCUs: lists of (component, block of 64)."""
    dc, ac, out, bits, pred = codes(DC), codes(AC), b"", "", [0] * comps

    def flush(bits):
        bits += "1" * (-len(bits) % 8)
        raw = bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8))
        return raw.replace(b"\xff", b"\xff\x00")

    for i, mcu in enumerate(mcus):
        if restart and i and i % restart == 0:
            out, bits, pred = out + flush(bits) + bytes([0xFF, 0xD0 + (i // restart - 1) % 8]), "", [0] * comps
        for c, block in mcu:
            n, b = put(block[0] - pred[c])
            bits, pred[c], run = bits + dc[n] + b, block[0], 0
            last = max([k for k in range(1, 64) if block[k]], default=0)
            for k in range(1, last + 1):
                if not block[k]:
                    run += 1
                    continue
                while run > 15:
                    bits, run = bits + ac[0xF0], run - 16
                n, b = put(block[k])
                bits, run = bits + ac[run << 4 | n] + b, 0
            if last < 63:
                bits += ac[0]
    return out + flush(bits)


def block(rng, dc):
    b = [0] * 64
    b[0], k = dc, 1
    while k < 64 and rng.random() < 0.8:
        run, size = rng.choice([(0, 1), (0, 2), (1, 1), (0, 3), (2, 1), (0, 8), (5, 10), (17, 1)])
        run = 16 + 1 if run == 17 else run
        if k + run < 64:
            b[k + run] = rng.choice([-1, 1]) * rng.randint(1 << (size - 1), (1 << size) - 1)
        k += run + 1
    return b


@pytest.mark.parametrize("restart", [0, 1, 3])
def test_decoder_on_subsampled_colour(restart):
    rng = random.Random(restart)
    files, wanted = [], []
    for width, height in ((40, 33), (16, 16), (40, 33)):
        rows, cols = -(-height // 16), -(-width // 16)
        luma, walk, mcus = np.zeros((2 * rows, 2 * cols, 64), int), 0, []
        for r in range(rows):
            for c in range(cols):
                mcu = []
                for v in range(2):
                    for h in range(2):
                        walk = rng.choice([walk, walk + 1, walk - 2, walk + 5, 0]) if abs(walk) < 2 else 0
                        luma[2 * r + v, 2 * c + h] = block(rng, walk)
                        mcu.append((0, luma[2 * r + v, 2 * c + h].tolist()))
                mcu += [(1, block(rng, 1)), (2, block(rng, -1))]
                mcus.append(mcu)
        try:
            scan = scalar_scan(mcus, restart, 3)
        except KeyError:  # a DC step that the small table doesn't have
            pytest.fail("the test's walk left its table")
        seg = jpeg._segment
        sof = b"\x08" + height.to_bytes(2, "big") + width.to_bytes(2, "big") + b"\3" + b"\1\x22\0\2\x11\0\3\x11\0"
        files.append(b"\xff\xd8" + seg(0xDB, b"\0" + bytes(range(2, 66))) + seg(0xC0, sof) + seg(0xC4, b"\0" + DC + b"\x10" + AC) + (seg(0xDD, restart.to_bytes(2, "big")) if restart else b"") + seg(0xDA, b"\3\1\0\2\0\3\0\0\x3f\0") + scan + b"\xff\xd9")
        wanted.append(luma)
    for p, luma in zip(jpeg.decode(files), wanted, strict=True):
        assert (p.blocks[0] == luma).all()
        assert (p.luminance() == np.clip(np.rint(luma[:, :, 0] * 2 / 8 + 128), 0, 255)).all()


def test_pictures_from_elsewhere(spark):
    good = jpeg.encode([bytes(range(64)) * 3])[0]
    progressive = good.replace(b"\xff\xc0", b"\xff\xc2", 1)
    foreign = good.replace(b"payload=192", b"holiday 192", 1)
    cases = {1: good, 2: None, 3: foreign, 4: progressive, 5: good[:90], 6: good[:-40], 7: b"GIF89a", 8: b"", 9: b"\xff\xd8\xff", 10: good, 11: good.replace(b"payload=192", b"payload=999", 1)}
    df = spark.createDataFrame([(i, 192, bytearray(m) if m is not None else None, "x") for i, m in cases.items()], "doc_id long, n_bytes long, media binary, error string").coalesce(1)
    got = {r.doc_id: r for r in media.describe(df).collect()}
    assert [i for i in cases if got[i].payload_sha256] == [1, 10] and got[1].payload_bytes == 192
    assert [i for i in cases if got[i].error] == [4, 5, 6, 7, 8, 9] and "baseline" in got[4].error
    assert got[2].media_bytes is None and got[2].error is None and got[4].media_sha256 == hashlib.sha256(progressive).hexdigest()
    assert [(got[i].width, got[i].thumbnail_hash) for i in (3, 11)] == [(got[1].width, got[1].thumbnail_hash)] * 2 and got[4].width is None


def test_round_trip_of_all_bytes():
    rng = np.random.default_rng(1)
    payloads = [bytes(64), b"\xff" * 640, bytes(range(256)), rng.integers(0, 256, 64 * 137, dtype=np.uint8).tobytes()]
    files = jpeg.encode(payloads)
    assert [jpeg.payload(p) for p in jpeg.decode(files)] == payloads
    assert files[3] == jpeg.encode(payloads[3:])[0]
    with pytest.raises(ValueError, match=r"SOI|baseline|marker"):
        jpeg.parse(b"GIF89a")


def test_rows(spark):
    texts = ["", None, "a", "é" * 40, "x" * 64, "word " * 50_000, "a"]
    df = spark.createDataFrame([(i if i != 4 else None, t, "m") for i, t in enumerate(texts)], "doc_id long, text string, media string")
    got = {r.payload_sha256: r for r in media.describe(media.store(df)).collect()}
    assert media.describe(media.store(df)).count() == len(texts)
    for t in texts:
        raw = (t or "").encode()
        padded = raw + bytes(-len(raw) % 64 if raw else 64)
        r = got[hashlib.sha256(padded).hexdigest()]
        assert (r.n_bytes, r.payload_bytes, r.tail_crc32) == (len(raw), len(padded), zlib.crc32(padded[-64:]))
        assert r.media_sha256 == hashlib.sha256(jpeg.encode([padded])[0]).hexdigest()
    assert media.describe(media.store(df.where(F.lit(False)))).count() == 0


def test_thumbnail_hash_depends_on_every_pixel():
    flat = np.full((64, 90), 100, dtype=np.uint8)
    base, seen = media.thumbnail_hash(flat), set()
    for y, x in ((0, 13), (3, 15), (63, 89), (37, 41), (33, 12)):
        other = flat.copy()
        other[y, x] += 1
        seen.add(media.thumbnail_hash(other))
        other[y, x] -= 2
        seen.add(media.thumbnail_hash(other))
    assert base == "0" * 16 and len(seen - {base}) > 5
    for h, w in ((1, 1), (8, 9), (5, 200), (200, 3)):
        thumb = np.random.default_rng(h).integers(0, 256, (h, w), dtype=np.uint8)
        rows, cols = ([thumb[i * h // 8 : max((i + 1) * h // 8, i * h // 8 + 1)] for i in range(8)], [(j * w // 9, max((j + 1) * w // 9, j * w // 9 + 1)) for j in range(9)])
        small = np.array([[r[:, a:z].mean() for a, z in cols] for r in rows])
        assert media.thumbnail_hash(thumb) == np.packbits(small[:, 1:] > small[:, :-1]).tobytes().hex()
