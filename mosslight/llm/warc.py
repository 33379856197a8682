"""WARC archives with a two-level capture index.

Writing: each task of the scan writes one archive of compressed records. Of pages with equal
payloads the one with the smallest id is a response; the others are revisits without payload
that name it. The captures' index lines are sorted by reversed-host URL key over the cluster;
each range of keys becomes a file of compressed blocks of ``LINES`` lines and, as second
level, a sparse directory with the first key, offset and length of every block.

Reading: lookups are dealt out by the same ranges. A task loads the directory of its range,
binary-searches it, reads that block's bytes, finds the capture, and reads the record's bytes
out of its archive. What comes back is taken from the record alone.

Every attempt of a task writes files of its own names and returns rows that point to them; a
file is renamed to its name when whole. So a repeated or speculative attempt never touches
what another has returned, whatever order its rows came in; files of attempts that lost are
not referred to. Paths are URIs: local or shared folders are used through the operating
system, others through pyarrow.fs.

Record ids are unique, also of rows that repeat a page: they name the archive, which has a name
of its own for each attempt, and the record's number in it. A page's id is a field of its own,
``Page-ID``, and a revisit names the response's page and URL. ``WARC-Date`` is a constant, as
the pages have no date. Archives are written record by record.

Edge cases: null html is an empty payload; a very long payload is one record, held whole by
itself; a null URL has the empty key; a null id sorts after all ids; of pages tied in payload the
smallest id is the response, and rows that repeat id and payload are captures of their own and
of equal type; an empty table gives an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import os
import re
import uuid
import zlib
from collections.abc import Iterator
from contextlib import contextmanager, suppress
from itertools import chain
from typing import BinaryIO
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosslight.staging import stage, work_dir

LINES, LEVEL, NO_ID = 300, 3, -(1 << 63)
_HOST = re.compile(r"^www\d*\.")
CAPTURE = "key string, page_id long, archive string, offset long, length long"


def url_key(url: str | None) -> str:
    """Reversed host, path and sorted query: ``http://www.a.com:80/B?y&x#f`` is ``com,a)/B?x&y``."""
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip())
        host = (parts.hostname or "").rstrip(".")
        port = parts.port
    except ValueError:
        return url.strip()
    host = ",".join(reversed(_HOST.sub("", host).split(".")))
    if port and (parts.scheme, port) not in (("http", 80), ("https", 443)):
        host += f":{port}"
    query = "&".join(sorted(parts.query.split("&"))) if parts.query else ""
    return f"{host}){parts.path or '/'}" + (f"?{query}" if query else "")


class Store:
    """Whole-file writes and range reads below one folder."""

    def __init__(self, uri: str):
        self._local = uri.removeprefix("file://") if uri.startswith(("file:", "/")) else None
        if self._local is not None and uri.startswith("file:"):
            self._local = "/" + uri.removeprefix("file:").lstrip("/")
        self._uri, self._open = uri, {}
        if self._local is None:
            from pyarrow import fs

            self._fs, self._root = fs.FileSystem.from_uri(uri)

    @contextmanager
    def writing(self, name: str) -> Iterator[BinaryIO]:
        """A file to write to, which has its name once it is whole; after a failure it is gone."""
        local = self._local is not None
        root = self._local if local else self._root
        temporary = f"{root}/.{name}.{uuid.uuid4().hex}"
        if local:
            os.makedirs(root, exist_ok=True)
        else:
            self._fs.create_dir(root, recursive=True)
        try:
            with open(temporary, "wb") if local else self._fs.open_output_stream(temporary) as f:
                yield f
            if local:
                os.replace(temporary, f"{root}/{name}")
            else:
                self._fs.move(temporary, f"{root}/{name}")
        except BaseException:
            with suppress(OSError):
                os.unlink(temporary) if local else self._fs.delete_file(temporary)
            raise

    def write(self, name: str, data: list[bytes]) -> None:
        with self.writing(name) as f:
            for x in data:
                f.write(x)

    def read(self, name: str, offset: int = 0, length: int | None = None) -> bytes:
        f = self._open.get(name)
        if f is None:
            if len(self._open) >= 64:
                self._open.pop(next(iter(self._open))).close()
            f = self._open[name] = open(f"{self._local}/{name}", "rb") if self._local is not None else self._fs.open_input_file(f"{self._root}/{name}")
        f.seek(offset)
        return f.read() if length is None else f.read(length)

    def close(self) -> None:
        for f in self._open.values():
            f.close()
        self._open.clear()


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, first: tuple[int | None, str | None] | None, name: str) -> bytes:
    """One record: a response with the payload, or a revisit of page and URL ``first`` whose HTTP header keeps the payload's length.

    ``name`` tells the record from all others.
    """
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    body = http if first else http + payload
    address = lambda x: re.sub(r"[\x00-\x20]+", " ", x or "")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if first else 'response'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>",
        "WARC-Date: 2026-01-01T00:00:00Z",
        f"WARC-Target-URI: {address(url)}",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Page-ID: {'' if page_id is None else page_id}",
    ]
    if first:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To-Target-URI: {address(first[1])}", "WARC-Refers-To-Date: 2026-01-01T00:00:00Z", f"Refers-To-Page-ID: {first[0]}"]
    head.append(f"Content-Length: {len(body)}")
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + body + b"\r\n\r\n"


def gzip_member(data: bytes, level: int = LEVEL) -> bytes:
    c = zlib.compressobj(level, wbits=31)
    return c.compress(data) + c.flush()


def parse_record(data: bytes) -> dict[str, object]:
    """Header fields of a decompressed record, ``body``, and the HTTP ``payload`` and its ``length``."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields: dict[str, object] = dict(x.split(": ", 1) for x in lines if ": " in x)  # an empty value keeps its blank
    body = rest[: int(fields["Content-Length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    length = int(re.search(rb"(?i)\r\ncontent-length: (\d+)", http)[1])
    return fields | {"body": body, "payload": payload, "length": length}


def revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0) -> DataFrame:
    """``revisit_digest, first_id, first_url``: for payloads of ``least`` bytes that several ids share, the smallest id and its URL.

    Ids are combined before the shuffle, so a payload that a third of all pages share costs a
    row for each task.
    """
    payload = F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8")
    hashed = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.sha1(payload).alias("digest"), F.octet_length(payload).alias("n")).where(F.col("n") >= least)
    same = hashed.groupBy("digest").agg(F.min(F.struct(F.col("id").isNull(), "id", "url")).alias("first"), F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.count(F.lit(1)).alias("n"), F.count("id").alias("n_ids"))
    return same.where((F.col("first_id") != F.col("last_id")) | (F.col("n_ids") > 0) & (F.col("n_ids") < F.col("n"))).select(F.col("digest").alias("revisit_digest"), "first_id", F.col("first.url").alias("first_url"))


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0) -> DataFrame:
    """Write one archive for each partition of ``pages``; return the captures (a stored table)."""
    shared = stage(revisits(pages, id_col, url_col, html_col, least), "revisits")
    keyed = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"), F.sha1(F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8")).alias("digest"))
    if shared.isEmpty():
        typed = keyed.select("page_id", "url", "html", F.lit(None).cast("long").alias("first_id"), F.lit(None).cast("string").alias("first_url"))
    else:
        typed = keyed.join(shared, F.col("digest") == F.col("revisit_digest"), "left").select("page_id", "url", "html", "first_id", "first_url")

    kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = (b for b in batches if b.num_rows)
        first_batch = next(batches, None)
        if first_batch is None:
            return
        name, at, n = f"part-{first_batch.column(5)[0].as_py():06d}-{uuid.uuid4().hex}.warc.gz", 0, 0
        with Store(folder).writing(name) as f:
            for b in chain([first_batch], batches):
                rows = []
                for i in range(b.num_rows):
                    page_id, url, html, first, first_url = (b.column(c)[i].as_py() for c in range(5))
                    revisit = (first, first_url) if first is not None and page_id != first else None
                    member = gzip_member(record(page_id, url, html.encode("utf-8", "surrogatepass"), revisit, f"{name}#{n}"))
                    f.write(member)
                    rows.append((re.sub(r"[\t\n]", "%20", url_key(url)), page_id, name, at, len(member)))
                    at, n = at + len(member), n + 1
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["key", "page_id", "archive", "offset", "length"])

    return stage(typed.withColumn("task", F.spark_partition_id()).mapInArrow(run, CAPTURE), "captures")


def _place(key: str, page_id: str | int | None) -> tuple[str, int]:
    return key, NO_ID if page_id is None or page_id == "" else int(page_id)


def write_index(captures: DataFrame, folder: str, lines: int = LINES) -> DataFrame:
    """Sort the captures by key and id and write index files; return their directories, a row for each block (a stored table).

    Ranges are cut between ids too, so a URL that a third of all captures share fills several files.
    """
    schema = "part int, first_key string, first_id long, file string, offset long, length long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, rows, at, held, name, task = [], [], 0, [], None, 0

        def close() -> None:
            nonlocal at
            block = gzip_member("\n".join(x for _, _, x in held).encode("utf-8", "surrogatepass"), 6)
            rows.append((task, *_place(*held[0][:2]), name, at, len(block)))
            blocks.append(block)
            at += len(block)
            held.clear()

        for b in batches:
            for key, page_id, archive, offset, length, task in zip(*(c.to_pylist() for c in b.columns), strict=True):
                name = name or f"index-{task:06d}-{uuid.uuid4().hex}.gz"
                held.append((key, page_id, f"{key}\t{'' if page_id is None else page_id}\t{archive}\t{offset}\t{length}"))
                if len(held) >= lines:
                    close()
        if held:
            close()
        if rows:
            store = Store(folder)
            store.write(name, blocks)
            store.write(name.replace(".gz", ".directory"), ["".join(f"{r[1]}\t{r[2]}\t{r[4]}\t{r[5]}\n" for r in rows).encode("utf-8", "surrogatepass")])
            kinds = (pa.int32(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in schema.split(", ")])

    ordered = captures.repartitionByRange("key", "page_id").sortWithinPartitions("key", "page_id", "archive", "offset")
    return stage(ordered.withColumn("task", F.spark_partition_id()).mapInArrow(run, schema), "directory")


class Lookup:
    """Captures in one index file, by binary search in its directory and one block read."""

    def __init__(self, store: Store, name: str):
        self._store, self._name = store, name
        raw = store.read(name.replace(".gz", ".directory")).decode("utf-8", "surrogatepass")
        rows = [x.split("\t") for x in raw.split("\n")[:-1]]
        self._first, self._at = [_place(k, i) for k, i, _, _ in rows], [(int(o), int(n)) for _, _, o, n in rows]
        self._held, self._lines = -1, []

    def _block(self, i: int) -> list[list[str]]:
        if i != self._held:
            text = zlib.decompress(self._store.read(self._name, *self._at[i]), wbits=31).decode("utf-8", "surrogatepass")
            self._held, self._lines = i, [x.split("\t") for x in text.split("\n")]
        return self._lines

    def captures(self, key: str, page_id: int | None) -> Iterator[tuple[str, int, int]]:
        """(archive, offset, length) of every capture of the page under ``key``."""
        want = _place(key, page_id)
        i = max(0, bisect.bisect_left(self._first, want) - 1)
        while i < len(self._first) and self._first[i] <= want:
            lines = self._block(i)
            for j in range(bisect.bisect_left(lines, want, key=lambda x: _place(x[0], x[1])), len(lines)):
                if _place(lines[j][0], lines[j][1]) != want:
                    break
                yield lines[j][2], int(lines[j][3]), int(lines[j][4])
            i += 1


def read_back(directory: DataFrame, folder: str, wanted: DataFrame) -> DataFrame:
    """What the records of the pages in ``wanted`` (``key``, ``page_id``) say; the payload is checked against its digest.

    The driver and every task get the first key of each index file: a row for each partition
    of the index, whose number the session's settings fix. Lookups are then dealt out evenly in
    the order of files and keys.
    """
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    low = F.min(F.struct("first_key", "first_id")).alias("low")
    files = sorted((r["low"]["first_key"], r["low"]["first_id"], r["file"]) for r in directory.groupBy("file").agg(low).collect())

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, names = [f[:2] for f in files], [f[2] for f in files]
        for b in batches:
            file = [names[max(0, bisect.bisect_right(starts, _place(*x)) - 1)] for x in zip(*(c.to_pylist() for c in b.columns), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(file, pa.string()), *b.columns], names=["file", "key", "page_id"])

    def records(store: Store, found: Iterator[tuple[str, int, int]]) -> Iterator[tuple]:
        for archive, offset, length in found:
            r = parse_record(zlib.decompress(store.read(archive, offset, length), wbits=31))
            refers = r.get("Refers-To-Page-ID")
            own = digest(r["payload"]) if refers is None else r["WARC-Payload-Digest"].removeprefix("sha1:")
            if refers is None and (own != r["WARC-Payload-Digest"].removeprefix("sha1:") or len(r["payload"]) != r["length"]):
                raise ValueError(f"record at {archive}:{offset} is damaged")
            number = r["Page-ID"].strip()
            yield int(number) if number else None, r["length"], own, r["WARC-Type"], int(refers) if refers else None

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in schema.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, name, lookup, rows = Store(folder), None, None, []
        for b in batches:
            for file, key, page_id in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if file != name:
                    name, lookup = file, Lookup(store, file)
                rows += records(store, lookup.captures(key, page_id))
                if len(rows) >= 4096:
                    yield batch(rows)
                    rows = []
        if rows:
            yield batch(rows)
        store.close()

    routed = wanted.select("key", "page_id").distinct().mapInArrow(route, "file string, key string, page_id long")
    tasks = int(wanted.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # lookups are small rows but costly ones: not to be merged by size
    return routed.repartitionByRange(tasks, "file", "key", "page_id").sortWithinPartitions("file", "key", "page_id").mapInArrow(run, schema)


def archive_pages(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0) -> DataFrame:
    """Write ``pages`` to archives and their index under ``folder``, and read every record back through the index."""
    folder = folder or f"{work_dir(pages.sparkSession)}/warc"
    captures = write_archives(pages, folder, id_col, url_col, html_col, least)
    return read_back(write_index(captures, folder), folder, captures)
