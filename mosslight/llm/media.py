"""Media columns: whole texts stored as baseline JPEG files, read back and described.

Edge cases: a null text is empty and stored as one block of zeros; a very long text is one
picture, files being coded some megabytes at a time, so memory follows the longest text and not
the batch; rows are stored each for itself and equal texts alike; an empty table gives an empty
result; other columns, whatever their names, are ignored. Pictures that aren't from ``store``
are described without payload columns. A null picture has null columns and no error; one that
is no baseline file or is cut short has its size and digest, null columns and an ``error``.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosslight.llm import jpeg

CHUNK = 2_000_000


def _chunks(values: list[bytes]) -> Iterator[tuple[int, int]]:
    a = held = 0
    for i, v in enumerate(values):
        held += len(v)
        if held >= CHUNK:
            yield a, i + 1
            a, held = i + 1, 0
    if a < len(values):
        yield a, len(values)


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, media``: each whole text as a JPEG file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = [(t or "").encode("utf-8", "surrogatepass") for t in b.column(1).to_pylist()]
            for a, z in _chunks(raw):
                padded = [x + bytes(-len(x) % jpeg.BLOCK if x else jpeg.BLOCK) for x in raw[a:z]]
                yield pa.RecordBatch.from_arrays([b.column(0)[a:z], pa.array([len(x) for x in raw[a:z]], pa.int64()), pa.array(jpeg.encode(padded), pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def thumbnail_hash(thumb: np.ndarray) -> str:
    """64 bits: whether brightness rises from each to the next of nine columns, in eight rows.

    Rows and columns are means over equal parts of the whole thumbnail; one of fewer pixels than
    parts repeats its pixels.
    """
    parts = lambda size, n: (np.arange(n) * size // n, np.maximum(np.arange(1, n + 1) * size // n, np.arange(n) * size // n + 1))
    (top, below), (left, right) = parts(thumb.shape[0], 8), parts(thumb.shape[1], 9)
    sums = np.pad(thumb.astype(np.int64).cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    area = sums[below[:, None], right] - sums[below[:, None], left] - sums[top[:, None], right] + sums[top[:, None], left]
    small = area / ((below - top)[:, None] * (right - left))
    return np.packbits(small[:, 1:] > small[:, :-1]).tobytes().hex()


def _read(files: list[bytes | None]) -> list[tuple[jpeg.Picture | None, str | None]]:
    """Each file's picture or what is wrong with it; one bad file costs its neighbours a second reading."""
    given = [i for i, f in enumerate(files) if f is not None]
    out: list[tuple[jpeg.Picture | None, str | None]] = [(None, None)] * len(files)
    try:
        for i, p in zip(given, jpeg.decode([files[i] for i in given]), strict=True):
            out[i] = p, None
    except ValueError as e:
        if len(given) == 1:
            out[given[0]] = None, str(e)
        else:
            half = given[len(given) // 2]
            out = [*_read(files[:half]), *_read(files[half:])]
    return out


def describe(stored: DataFrame) -> DataFrame:
    """Features of the files in ``media``, from the decoded bytes: digests, dimensions, thumbnail, its hash, and what is wrong."""
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, width int, height int, thumbnail binary, thumbnail_hash string, error string"
    each = lambda f, xs: [None if x is None else f(x) for x in xs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            media = b.column(2).to_pylist()
            for a, z in _chunks([x or b"" for x in media]):
                found = _read(media[a:z])
                pictures = [p for p, _ in found]
                payloads = each(jpeg.payload, pictures)
                thumbs = each(lambda p: p.luminance(), pictures)
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0)[a:z],
                        b.column(1)[a:z],
                        pa.array(each(len, payloads), pa.int64()),
                        pa.array(each(lambda x: hashlib.sha256(x).hexdigest(), payloads), pa.string()),
                        pa.array(each(lambda x: zlib.crc32(x[-jpeg.BLOCK :]), payloads), pa.int64()),
                        pa.array(each(len, media[a:z]), pa.int64()),
                        pa.array(each(lambda x: hashlib.sha256(x).hexdigest(), media[a:z]), pa.string()),
                        pa.array(each(lambda p: p.width, pictures), pa.int32()),
                        pa.array(each(lambda p: p.height, pictures), pa.int32()),
                        pa.array(each(lambda t: t.tobytes(), thumbs), pa.binary()),
                        pa.array(each(thumbnail_hash, thumbs), pa.string()),
                        pa.array([e for _, e in found], pa.string()),
                    ],
                    names=[x.split()[0] for x in schema.split(", ")],
                )

    return stored.select(F.col("doc_id").cast("long"), F.col("n_bytes").cast("long"), F.col("media").cast("binary")).mapInArrow(run, schema)
