"""Embedders: the protocol, and a deterministic offline one."""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from collections.abc import Iterator
from typing import Protocol
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosslight import schema as S


#: The names of this machine's own address.
LOOPBACK = ("localhost", "127.0.0.1", "::1")


class Embedder(Protocol):
    """Turns texts into vectors of one width. ``probe`` tells whether it can be reached."""

    model: str
    dim: int

    def probe(self) -> bool: ...

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class EmbeddingError(ValueError):
    """A backend's answer has the wrong shape."""


class CharacterEmbedder:
    """``v[(i + code point) mod dim] += 1`` for each character, scaled to unit length."""

    def __init__(self, dim: int = S.EMBED_DIM, model: str = "characters"):
        self.dim, self.model = dim, model

    def probe(self) -> bool:
        return True

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            at = (np.arange(len(t)) + np.fromiter(map(ord, t), dtype=np.int64, count=len(t))) % self.dim
            v = np.bincount(at, minlength=self.dim).astype(np.float64)
            out.append((v / (np.linalg.norm(v) or 1.0)).tolist())
        return out


class HttpEmbedder:
    """A model behind a local HTTP service that takes ``{"model", "input"}`` and answers ``{"embeddings"}``.

    Only this machine's own address is allowed and no proxy is used, so texts never leave it; on a
    cluster every executor needs a service of its own. The width is learned from the first answer.
    """

    def __init__(self, model: str, host: str = "http://127.0.0.1:11434", path: str = "/api/embed", timeout: float = 120.0, probe_timeout: float = 10.0):
        parts = urlsplit(host)
        if parts.scheme not in ("http", "https") or parts.hostname not in LOOPBACK:
            raise ValueError(f"{host!r} isn't an http address of this machine")
        self.model, self._url, self._timeout, self._probe_timeout, self._dim = model, host.rstrip("/") + path, timeout, probe_timeout, 0

    @property
    def dim(self) -> int:
        if not self._dim:
            self._ask(["width"], self._probe_timeout)
        return self._dim

    def probe(self) -> bool:
        try:
            self._ask(["ready"], self._probe_timeout)
        except (EmbeddingError, OSError):
            return False
        return True

    def embed(self, texts: list[str]) -> list[list[float]]:
        return self._ask(texts, self._timeout) if texts else []

    def _ask(self, texts: list[str], timeout: float) -> list[list[float]]:
        body = json.dumps({"model": self.model, "input": texts}).encode()
        request = urllib.request.Request(self._url, body, {"Content-Type": "application/json"})
        try:
            with urllib.request.build_opener(urllib.request.ProxyHandler({})).open(request, timeout=timeout) as answer:
                found = json.load(answer)["embeddings"]
        except urllib.error.HTTPError as e:
            raise EmbeddingError(f"{self._url} answered {e.code} for model {self.model}") from e
        except (ValueError, KeyError, TypeError) as e:
            raise EmbeddingError(f"{self._url} gave no embeddings") from e
        if not isinstance(found, list) or not all(isinstance(v, list) and v and all(type(x) in (int, float) for x in v) for v in found):
            raise EmbeddingError(f"{self._url} gave something other than lists of numbers")
        self._dim = self._dim or len(found[0]) if found else self._dim
        return checked(found, len(texts), self._dim).tolist()


def checked(vectors: list[list[float]], n: int, dim: int) -> np.ndarray:
    """The answer as a matrix; raises if its count or width is off or a value isn't a finite number."""
    if len(vectors) != n:
        raise EmbeddingError(f"{n} texts gave {len(vectors)} vectors")
    if any(len(v) != dim for v in vectors):
        raise EmbeddingError(f"a vector's width isn't {dim}")
    out = np.array(vectors, dtype=np.float32).reshape(n, dim)
    if not np.isfinite(out).all():
        raise EmbeddingError("a vector has values that aren't finite numbers")
    return out


def embed(rows: DataFrame, embedder: Embedder, key: str = "ref", text: str = "text", batch: int = S.EMBED_BATCH, strict: bool = True, also: tuple[str, ...] = ()) -> DataFrame:
    """``key``, the columns ``also``, and ``embedding`` for every row, some texts in a call.

    A failed call raises; with ``strict`` off its rows are left out and what else was embedded
    is kept, so that a later run embeds only what is missing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column(b.num_columns - 1).to_pylist()]
            parts, kept = [], []
            for a in range(0, len(texts), batch):
                try:
                    parts.append(checked(embedder.embed(texts[a : a + batch]), len(texts[a : a + batch]), embedder.dim))
                    kept += range(a, min(a + batch, len(texts)))
                except (EmbeddingError, OSError):
                    if strict:
                        raise
            flat = np.concatenate(parts).ravel() if parts else np.empty(0, np.float32)
            offsets = np.arange(0, len(flat) + 1, embedder.dim, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(kept, pa.int64())) for c in b.columns[:-1]), pa.ListArray.from_arrays(offsets, pa.array(flat, pa.float32()))], names=[key, *also, "embedding"])

    kinds = "".join(f"`{c}` {rows.schema[c].dataType.simpleString()}, " for c in (key, *also))
    return rows.select(key, *also, text).mapInArrow(run, kinds + "embedding array<float>")


def chunk_text(chunks: DataFrame) -> DataFrame:
    """``ref, path, chunk_seq, text`` as chunks are embedded: heading path, blank line, body."""
    return chunks.select("ref", "path", "chunk_seq", F.concat_ws("\n\n", "heading_path", "body").alias("text"))
