import base64
import hashlib
import random
import zlib

from pyspark.sql import functions as F

from mosslight.llm import warc


def test_url_key():
    for url, key in (
        ("http://www.Example.com:80/A/b?y=2&x=1#f", "com,example)/A/b?x=1&y=2"),
        ("https://m.a.org", "org,a,m)/"),
        ("http://a.org:8080/x", "org,a:8080)/x"),
        (None, ""),
        ("http://[bad", "http://[bad"),
    ):
        assert warc.url_key(url) == key


def test_record_round_trip():
    for revisit in (False, True):
        r = warc.parse_record(zlib.decompress(warc.gzip_member(warc.record(7, "http://a/\r\nX: y", "é\r\n\r\nz".encode(), (3, "http://b/") if revisit else None, "a#1")), wbits=31))
        assert r["length"] == 7 and r["Page-ID"] == "7" and "X" not in r and r.get("WARC-Refers-To-Target-URI") == ("http://b/" if revisit else None)
        assert r["payload"] == (b"" if revisit else "é\r\n\r\nz".encode())


def test_pages_with_shared_payloads_and_urls(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice(["http://hot.example/", f"http://h{i % 7}.example/{i}", None]), rng.choice(["same", "", None, f"page {i}"]), "k") for i in range(400)]
    rows += [(3, "http://twice/", "same", "k")] * 2 + [(None, "http://none/", "same", "k"), (None, None, "alone", "k")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, key string").repartition(5)
    first = {}
    for i, _, html, _ in rows:
        first.setdefault(html or "", []).append(i)
    first = {k: min((i for i in v if i is not None), default=None) for k, v in first.items()}

    def expected(i, html):
        raw, one = (html or "").encode(), first[html or ""]
        revisit = one is not None and i != one
        return str((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response", one if revisit else None))

    got = sorted(str(tuple(r)) for r in warc.archive_pages(df).collect())
    assert got == sorted(expected(i, html) for i, _, html, _ in rows)
    assert warc.archive_pages(df.where(F.lit(False))).count() == 0


def test_archives_hold_each_record_once_under_an_id_of_its_own(spark, tmp_path):
    rows = [(3, "http://a/", "same"), (3, "http://a/", "same"), (5, "http://b/", "same"), (6, "http://c/", "x" * 3_000_000), (7, "http://c/", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'k' as key", "1 as digest", "2 as task", "3 as first_id").repartition(2)
    assert warc.archive_pages(df, str(tmp_path)).count() == len(rows)
    found, held = [], []
    for path in tmp_path.glob("part-*.warc.gz"):
        data = path.read_bytes()
        while data:
            d = zlib.decompressobj(wbits=31)
            found.append(warc.parse_record(d.decompress(data)))
            data = d.unused_data
    assert len({r["WARC-Record-ID"] for r in found}) == len(found) == len(rows) and not list(tmp_path.glob(".*"))
    revisit = [r for r in found if r["WARC-Type"] == "revisit"]
    assert [(r["Page-ID"], r["Refers-To-Page-ID"], r["WARC-Refers-To-Target-URI"]) for r in revisit] == [("5", "3", "http://a/")]
    store = warc.Store(str(tmp_path))
    try:
        with store.writing("broken") as f:
            f.write(b"part")
            raise OSError("lost")
    except OSError as e:
        held.append(str(e))
    assert held == ["lost"] and not list(tmp_path.glob("*broken*"))
