"""Near-duplicate detection by 64-bit SimHash and pigeonring filtering.

Fingerprints lie on a ring of four 16-bit segments. If two differ in three bits or fewer,
some segment starts a chain of which every prefix of l segments differs in no more than
3 * l / 4 bits: none in the first, at most one in the first two, two in the first three.
So a fingerprint is filed under the 32 bits of each segment and its successor, and sought
under those keys with one bit of the successor cleared; whichever of a pair has the bit set
finds the other. What meets under a key passes the third prefix, then the whole distance.

Equal fingerprints are one node. A key's rows arrive sorted and are linked by a spanning
forest, so the links written grow with the fingerprints and not with their pairs. Keys with
very many fingerprints are first dealt out by the bytes of their other 32 bits, of which
one at least is equal in any pair, and if need be by a second byte, which differs in one bit at most. Components are joined in tables, never on the driver.

Edge cases: a null text has no words and fingerprint zero, linked like any other; a very long
text is fingerprinted whole, 65,536 shingles at a time; ties between rows of one component go to
the smallest id, and of equal ids to the first in place; a null id belongs to its component and
never names one; repeated rows are each returned; an empty table gives an empty result; further
columns, whatever their names, are ignored by ``near_duplicates`` and kept by ``keep_one``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mosslight.llm.components import components
from mosslight.staging import placed, stage

SHINGLE, SEED, BITS, CROWDED, SMALL_RUN = 3, 42, 3, 4096, 16


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The SimHash of the whole text's word shingles, repeats included, as a signed 64-bit integer."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) < shingle:
        hashes = np.array([digest(b" ".join(words), seed)], dtype=np.uint64)
    else:
        line, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words]) - 1
        starts = [0, *(ends[:-1] + 1).tolist()]
        hashes = np.array([digest(line[a:b], seed) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=False)], dtype=np.uint64)
    counts = np.zeros(64, dtype=np.int64)
    for a in range(0, len(hashes), 1 << 16):
        part = hashes[a : a + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(rows: DataFrame, text_col: str = "text", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """``rows`` with ``fp`` in place of ``text_col``."""
    kept = [c for c in rows.columns if c != text_col]
    schema = ", ".join([*(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept), "fp long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = pa.array((fingerprint(t, shingle, seed) for t in b.column(len(kept)).to_pylist()), pa.int64(), size=b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], fp], names=[*kept, "fp"])

    return rows.select(*kept, text_col).mapInArrow(run, schema)


def _segment(i: int) -> Column:
    return F.shiftrightunsigned("fp", 16 * (i % 4)).bitwiseAND(F.lit(0xFFFF))


def filed_and_sought(distinct: DataFrame) -> DataFrame:
    """``key, fp, sought`` (0 or 1): under each chain's 32 bits, and under those with one bit of the second segment cleared."""
    rows = []
    for i in range(4):
        base, after = F.lit(i << 32).bitwiseOR(F.shiftleft(_segment(i), 16)), _segment(i + 1)
        rows.append(F.struct(base.bitwiseOR(after).alias("key"), F.lit(0).alias("sought")))
        for bit in range(16):
            rows.append(F.when(after.bitwiseAND(F.lit(1 << bit)) != 0, F.struct(base.bitwiseOR(after.bitwiseXOR(F.lit(1 << bit))).alias("key"), F.lit(1).alias("sought"))))
    return distinct.select("fp", F.explode(F.array(*rows)).alias("x")).where("x is not null").select("x.key", "fp", "x.sought")


def _near(x: np.ndarray, y: np.ndarray, first: np.ndarray | int) -> np.ndarray:
    """Whether the chain that starts at segment ``first`` holds: its three segments within two bits, then all within three."""
    diff = x ^ y
    gap = np.uint64(16) * ((np.asarray(first, dtype=np.uint64) + np.uint64(3)) % np.uint64(4))
    chain = diff & ~(np.uint64(0xFFFF) << gap)
    return (np.bitwise_count(chain) <= BITS * 3 // 4) & (np.bitwise_count(diff) <= BITS)


def _forest(fps: np.ndarray, first: int) -> list[tuple[int, int]]:
    """Links that span the components of one crowded key: every fingerprint is reached once."""
    fps, out = np.unique(fps), []
    left = fps
    while len(left) > 1:
        frontier, left = [left[0]], left[1:]
        while frontier and len(left):
            x = frontier.pop()
            near = _near(left, x, first)
            for y in left[near].tolist():
                out.append((int(x), y))
                frontier.append(np.uint64(y))
            left = left[~near]
    return out


def _linked(keys: np.ndarray, sub: np.ndarray, fps: np.ndarray, sought: np.ndarray) -> Iterator[tuple[int, int]]:
    """Links among whole runs of equal (key, sub)."""
    cuts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]) | (sub[1:] != sub[:-1])])
    length = np.diff(np.r_[cuts, len(keys)])
    crowded = length > SMALL_RUN
    for a, n in zip(cuts[crowded].tolist(), length[crowded].tolist(), strict=True):
        yield from _forest(fps[a : a + n], int(keys[a]) >> 32)
    run = np.repeat(np.arange(len(cuts)), length)
    few = ~np.repeat(crowded, length)
    run, keys, fps, sought = run[few], keys[few], fps[few], sought[few]
    for d in range(1, SMALL_RUN):
        at = np.flatnonzero(run[d:] == run[:-d]) if len(run) > d else np.empty(0, int)
        if not len(at):
            return
        at = at[(sought[at] & sought[at + d]) == 0]  # both sought in one way: some other chain or byte finds them
        x, y = fps[at], fps[at + d]
        near = _near(x, y, keys[at] >> 32) & (x != y)
        yield from zip(x[near].tolist(), y[near].tolist(), strict=True)


def _link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[list[np.ndarray]] = []  # the batches' parts of a run that may go on; joined once, when it ends

    def out() -> pa.RecordBatch:
        cols = [np.concatenate(x) for x in zip(*held, strict=True)]
        held.clear()
        pairs = np.array(sorted(set(_linked(*cols))), dtype=np.uint64).reshape(-1, 2).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    for b in batches:
        cols = [b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy().astype(np.int64).view(np.uint64), b.column(3).to_numpy()]
        if not len(cols[0]):
            continue
        if held and (held[-1][0][-1] != cols[0][0] or held[-1][1][-1] != cols[1][0]):
            yield out()
        cuts = np.flatnonzero((cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1])) + 1
        if len(cuts):
            held.append([x[: cuts[-1]] for x in cols])
            yield out()
        held.append([x[cuts[-1] if len(cuts) else 0 :] for x in cols])
    if held:
        yield out()


def _byte(j: int) -> Column:
    """Byte ``j`` of the 32 bits that follow the key's two segments, for the chain that the key starts."""
    of = lambda i: F.shiftrightunsigned("fp", 8 * ((2 * i + 4 + j) % 8)).bitwiseAND(F.lit(0xFF))
    return F.element_at(F.array(*[of(i) for i in range(4)]), F.shiftrightunsigned("key", 32).cast("int") + 1).cast("long")


def _by_one_byte() -> Column:
    """Places of a crowded key's row by each of its four other bytes: with three bits to differ in, one byte is equal."""
    return F.array(*[F.struct(F.lit(j + 1).cast("long").alias("sub"), _byte(j).alias("byte"), F.lit(False).alias("again")) for j in range(4)])


def _by_two_bytes() -> Column:
    """Places of a row of a crowded (key, byte) by each of the three bytes left, of which one differs in one bit at most.

    Filed under the byte itself, and sought under it with one bit cleared, as in the keys.
    """
    places = []
    for first in range(4):
        at = F.col("sub") == first + 1
        for j in range(4):
            if j == first:
                continue
            base = F.lit((first + 1) << 4 | (j + 1)).cast("long")
            byte = F.col("byte") * 256 + _byte(j)
            places.append(F.when(at, F.struct(base.alias("sub"), byte.alias("byte"), F.lit(False).alias("again"))))
            places += [F.when(at & (_byte(j).bitwiseAND(F.lit(1 << bit)) != 0), F.struct(base.alias("sub"), (byte - (1 << bit)).alias("byte"), F.lit(True).alias("again"))) for bit in range(8)]
    return F.filter(F.array(*places), lambda x: x.isNotNull())


def links(distinct: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """``a, b``: true links that span every component of the fingerprints in ``distinct``.

    Rows of a key with very many fingerprints are dealt out by one of its other bytes, and where
    that is still very many by two: then 16 bits at most are free, which bounds what a task holds.
    """
    tasks = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = filed_and_sought(distinct.repartition(tasks)).withColumns({"sub": F.lit(0).cast("long"), "byte": F.lit(0).cast("long")})  # a small table that becomes 36 times as many rows
    for places in (_by_one_byte(), _by_two_bytes()):
        filed = rows.where("sought = 0").groupBy("key", "sub", "byte").count().where(F.col("count") > crowded)
        many = stage(filed.select(F.col("key").alias("k"), F.col("sub").alias("s"), F.col("byte").alias("y"), F.lit(True).alias("many")), "crowded")
        if many.isEmpty():
            break
        same = (F.col("key") == F.col("k")) & (F.col("sub") == F.col("s")) & (F.col("byte") == F.col("y"))
        here = F.array(F.struct("sub", "byte", F.lit(False).alias("again")))
        dealt = rows.join(many, same, "left").select("key", "fp", "sought", F.explode(F.when(F.col("many").isNull(), here).otherwise(places)).alias("x"))
        rows = dealt.select("key", "fp", F.col("sought").bitwiseOR(F.when(F.col("x.again"), 2).otherwise(0)).alias("sought"), "x.sub", "x.byte")
    run = F.shiftleft("sub", 16).bitwiseOR(F.col("byte")).alias("run")
    by_key = rows.select("key", run, "fp", "sought").repartition("key", "run").sortWithinPartitions("key", "run", "fp")
    return by_key.mapInArrow(_link, "a long, b long")


def classes(rows: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """``fp, first``: for each fingerprint of the stored table ``rows`` (``fp``, ``place``) the smallest place of its component."""
    distinct = stage(rows.groupBy("fp").agg(F.min("place").alias("place")), "distinct")
    roots = stage(components(links(distinct.select("fp"), crowded)), "roots")
    members = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    placed = members.join(distinct, F.col("node") == F.col("fp")).select("fp", "root", "place")
    first = placed.groupBy("root").agg(F.min("place").alias("first"))
    linked = stage(placed.select("fp", "root").join(first, "root").select(F.col("fp").alias("node"), "first"), "linked")
    return distinct.join(linked, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("first", "place").alias("first"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, seed: int = SEED, crowded: int = CROWDED) -> DataFrame:
    """``id_col, fingerprint, component_id``, a row for each row of ``docs``."""
    rows = stage(fingerprints(docs.select(F.col(id_col), F.col(text_col).alias("text")), "text", shingle, seed), "fingerprints")
    found = classes(rows.select("fp", F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id")).alias("place")), crowded).withColumnRenamed("fp", "class_fp")
    joined = rows.join(found, F.col("fp") == F.col("class_fp"))
    return joined.select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("first.id").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """The rows of ``docs``, one for each component: that with the smallest id, and of rows with that id the one first in place.

    Texts are shuffled once, by a join that sorts and can spill, whatever the size of either side.
    """
    numbered = placed(docs)
    small = numbered.select("place_file", "place_row", F.col(f"row.`{id_col}`").alias("id"), F.col(f"row.`{text_col}`").alias("text"))
    rows = stage(fingerprints(small, "text", shingle, seed), "fingerprints")
    found = classes(rows.select("fp", F.struct(F.col("id").isNull().alias("none"), "id", "place_file", "place_row").alias("place")))
    kept = stage(found.select("first.place_file", "first.place_row").distinct(), "kept")
    return numbered.join(kept.hint("merge"), ["place_file", "place_row"]).select("row.*")
