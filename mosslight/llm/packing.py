"""Cost-balanced packing of documents into token sequences of a fixed length.

A piece of L tokens costs ``L + L * L / capacity`` (linear plus quadratic attention cost).
Full-length pieces are sequences of their own. The remainders are assigned in descending
order, each to the sequence with the lowest cost among those with room for it; what fits
nowhere whole is cut over the roomiest sequences. A shard has as many sequences as its tokens
fill; what is left, less than one sequence, is its tail.

Shards are formed inside the tasks that read the documents: texts aren't shuffled, nothing is
kept on the driver, memory is bounded by ``SHARD_TOKENS`` and the longest document. The pieces
of the tails, without their tokens, are then dealt out some ``TAILS`` shards to a task and packed
whole in the same way, so that many small partitions pad little more than few large ones.
Both passes are written once, so a lost executor doesn't change what others have packed.

Edge cases: a null text is empty and consists of the end token; a very long text is tokenised
and cut whole; pieces of equal length go by the order of their documents, tails' pieces by id;
rows are packed each for itself, repeated or not; an id may be null; an empty table gives an
empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosslight.llm.word_tokens import word_tokens
from mosslight.staging import stage

CAPACITY, END_ID, SHARD_TOKENS, TAILS, TOKENIZER = 4096, 2, 4_000_000, 500, "word_bpe_49k.json"

#: Sequences of tails are numbered from here; a task's number takes 29 bits.
TAIL_SEQUENCES = 1 << 62
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, cost double"


def assign(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int]], list[tuple[int, int, int]]]:
    """(document, start, length, sequence, offset) for each piece, and (document, start, length) of the tail's.

    Documents by number, tokens gapless in both. All sequences are full.
    """
    full = lengths // capacity
    pieces = [(int(d), int(k) * capacity, capacity) for d in np.flatnonzero(full) for k in range(full[d])]
    out, tail = [(d, s, n, q, 0) for q, (d, s, n) in enumerate(pieces)], []
    rest = lengths - full * capacity
    order = np.lexsort((np.arange(len(rest)), -rest))
    order = order[: int((rest > 0).sum())]
    first, count = len(out), int(rest.sum()) // capacity
    used, cost = np.zeros(count, dtype=np.int64), np.zeros(count)

    def put(d: int, start: int, n: int, q: int) -> None:
        out.append((d, start, n, first + q, int(used[q])))
        used[q] += n
        cost[q] += n + n * n / capacity

    for d in order.tolist():
        n, start = int(rest[d]), int(full[d]) * capacity
        q = int(np.argmin(np.where(used + n <= capacity, cost, np.inf))) if count else 0
        if count and used[q] + n <= capacity:
            put(d, start, n, q)
            continue
        while n and count and used[q := int(np.argmin(used))] < capacity:
            part = min(n, capacity - int(used[q]))
            put(d, start, part, q)
            n, start = n - part, start + part
        if n:
            tail.append((d, start, n))
    return out, tail


def assign_whole(lengths: np.ndarray, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(sequence, offset) for each piece, none cut: in descending order to the lowest cost with room, else to a new sequence."""
    count = -(-int(lengths.sum()) // capacity)
    used, cost, place = [0] * count, [0.0] * count, [(0, 0)] * len(lengths)
    for i in np.lexsort((np.arange(len(lengths)), -lengths)).tolist():
        n = int(lengths[i])
        q = min((q for q in range(len(used)) if used[q] + n <= capacity), key=lambda q: (cost[q], q), default=len(used))
        if q == len(used):
            used.append(0)
            cost.append(0.0)
        place[i] = (q, used[q])
        used[q] += n
        cost[q] += n + n * n / capacity
    return place


def _shard(ids: list[bytes], doc_ids: list[int | None], lengths: list[int], base: int, capacity: int) -> pa.RecordBatch:
    parts, tail = assign(np.array(lengths, dtype=np.int64), capacity)
    place = [(base + q, o) for _, _, _, q, o in parts] + [(None, None)] * len(tail)
    pieces = [p[:3] for p in parts] + tail
    crc = [zlib.crc32(memoryview(ids[d])[4 * s : 4 * (s + n)]) for d, s, n in pieces]
    return pa.RecordBatch.from_arrays(
        [
            pa.array([doc_ids[d] for d, _, _ in pieces], pa.int64()),
            pa.array([s for _, s, _ in pieces], pa.int64()),
            pa.array([n for _, _, n in pieces], pa.int64()),
            pa.array(crc, pa.int64()),
            pa.array([lengths[d] for d, _, _ in pieces], pa.int64()),
            pa.array([q for q, _ in place], pa.int64()),
            pa.array([o for _, o in place], pa.int64()),
            pa.array([n + n * n / capacity for _, _, n in pieces], pa.float64()),
            pa.array([base] * len(pieces), pa.int64()),
        ],
        names=[*(x.split()[0] for x in SCHEMA.split(", ")), "shard"],
    )


def _tails(rows: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """The tails' pieces of one deal with their sequences and offsets."""
    rows = rows.sort_values(["length", "doc_id", "start", "ids_crc32", "shard"], ascending=[False, True, True, True, True], kind="stable")
    place = assign_whole(rows["length"].to_numpy(), capacity)
    deal = int(rows["deal"].iloc[0])
    return rows.assign(sequence_id=[TAIL_SEQUENCES | deal << 24 | q for q, _ in place], offset=[o for _, o in place]).drop(columns=["shard", "deal"])


def pack(docs: DataFrame, tokenizer_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """A row for each piece. ``sequence_id`` is the task's number times 2**33 plus a count within the task; tails' are numbered by deal."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_tokens(tokenizer_path or _default_tokenizer())
        end = int(end_id).to_bytes(4, "little")
        ids, doc_ids, lengths, held, base = [], [], [], 0, None
        for batch in batches:
            if base is None and batch.num_rows:
                base = batch.column(2)[0].as_py() << 33
            texts = batch.column(1).to_pylist()
            for a in range(0, len(texts), 256):
                for doc_id, b in zip(batch.column(0)[a : a + 256].to_pylist(), words.encode(texts[a : a + 256]), strict=True):
                    ids.append(b + end)
                    doc_ids.append(doc_id)
                    lengths.append(len(b) // 4 + 1)
                    held += lengths[-1]
                    if held >= shard_tokens:
                        yield (out := _shard(ids, doc_ids, lengths, base, capacity))
                        base += 1 + max((q - base for q in out.column(5).to_pylist() if q is not None), default=0)
                        ids, doc_ids, lengths, held = [], [], [], 0
        if ids:
            yield _shard(ids, doc_ids, lengths, base, capacity)

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.spark_partition_id().cast("long").alias("task"))
    pieces = stage(texts.mapInArrow(run, SCHEMA + ", shard long"), "pieces")
    left = pieces.where("sequence_id is null")
    deals = -(-left.agg(F.count_distinct("shard")).first()[0] // TAILS)
    dealt = left.withColumn("deal", F.pmod(F.xxhash64("shard"), F.lit(max(1, deals))))
    packed = dealt.groupBy("deal").applyInPandas(lambda rows: _tails(rows, capacity), SCHEMA)
    return pieces.where("sequence_id is not null").drop("shard").unionByName(packed)


def _default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)
