"""Language identification by averaged hashed subword embeddings and a linear softmax.

A text's subwords are all 2-, 3- and 4-byte windows of its lower-case UTF-8 form, hashed to
``BUCKETS``. Their embeddings are averaged over the whole text and a linear softmax gives the
languages. The model is trained by stochastic gradient descent in numpy on the driver, from
a bounded sample: at most ``PER_LANG`` documents of each language and about ``MOST`` of all, but
never fewer than ``FLOOR`` of a language that has them. A sampled document is learned from whole,
however long, as counts of its buckets, and by ``SNIPPETS`` short windows from anywhere in it;
both are made on the executors. For prediction, embedding and softmax weights are multiplied
out to one score for each bucket and language, a table that all tasks get.

Scores are calibrated with a temperature fitted on sampled documents that training didn't
see. A prediction is accepted if its score reaches the threshold above which ``PRECISION``
of those documents were right; rejected ones still carry their most likely language.

Edge cases: a null text or one without a letter is ``und`` with score 0; so is every text if
there is nothing to learn from; a very long text is predicted from all of its windows, some
at a time; of languages with equal scores the first by code point is predicted; repeated rows
are predicted alike; an empty table gives an empty result; only id, text and (for the sample)
language are looked at, whatever other columns are named.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mosslight.staging import stage

BUCKETS, WIDTH, ORDERS = 1 << 16, 16, (2, 3, 4)
PER_LANG, MOST, FLOOR, EPOCHS, SNIPPETS, PRECISION = 500, 4000, 20, 4, 3, 0.995
WINDOW = 1 << 20
_LETTER = re.compile(r"[^\W\d_]")
_PAD = b"   "


@dataclass
class Model:
    langs: list[str]
    scores: np.ndarray
    bias: np.ndarray
    temperature: float
    threshold: float


def buckets(raw: np.ndarray) -> list[np.ndarray]:
    """For each order, the bucket of the window that begins at each byte but the last three."""
    x, n = raw.astype(np.uint32), len(raw) - 3
    h = x[:n] * np.uint32(2654435761)
    out = []
    for order in range(2, 5):
        h = (h ^ x[order - 1 : n + order - 1]) * np.uint32(2246822519)
        h ^= h >> np.uint32(15)
        out.append(h & np.uint32(BUCKETS - 1))
    return out


def averages(texts: list[str], scores: np.ndarray) -> np.ndarray:
    """The mean row of ``scores`` over all subwords of each whole text; memory follows ``WINDOW``."""
    total, count = np.zeros((len(texts), scores.shape[1])), np.zeros(len(texts))
    held: list[tuple[int, bytes, int]] = []  # text, its bytes, how many of the windows that begin in them count

    def flush() -> None:
        owner, parts, used = (list(x) for x in zip(*held, strict=True))
        starts = np.cumsum([0, *map(len, parts[:-1])])
        cuts = np.ravel(np.column_stack([starts, starts + used]))
        cuts = cuts[: len(cuts) - (cuts[-1] == sum(map(len, parts)))]
        for h in buckets(np.frombuffer(b"".join(parts) + _PAD, dtype=np.uint8)):
            np.add.at(total, owner, np.add.reduceat(scores[h], cuts, axis=0, dtype=np.float64)[::2])
        np.add.at(count, owner, len(ORDERS) * np.array(used))
        held.clear()

    size = 0
    for i, t in enumerate(texts):
        raw = _PAD + t.lower().encode("utf-8", "surrogatepass") + _PAD
        for a in range(0, len(raw), WINDOW):
            part = raw[a : a + WINDOW + 3]
            held.append((i, part, min(WINDOW, len(part))))
            size += len(part)
            if size >= WINDOW:
                flush()
                size = 0
    if held:
        flush()
    return total / np.maximum(count, 1)[:, None]


@dataclass
class Sample:
    """A document to learn from: its language, the buckets of its whole text with their counts, and short windows of it."""

    lang: str
    found: np.ndarray
    counts: np.ndarray
    windows: list[bytes]

    @classmethod
    def of(cls, lang: str, text: str) -> Sample:
        """Windows are drawn by a generator seeded with the text: two of 15 and 60 bytes to calibrate with, then those to learn from."""
        raw = _PAD + text.lower().encode("utf-8", "surrogatepass") + _PAD
        total = np.zeros(BUCKETS, dtype=np.int64)
        for a in range(0, len(raw), WINDOW):
            part = raw[a : a + WINDOW + 3]
            for h in buckets(np.frombuffer(part if a + WINDOW + 3 <= len(raw) else part + _PAD[: a + WINDOW + 3 - len(raw)], dtype=np.uint8)):
                total += np.bincount(h, minlength=BUCKETS)
        rng = np.random.default_rng(zlib.crc32(raw))
        sizes = [15, 60, *(int(n) for n in rng.integers(12, 240, SNIPPETS))]
        starts = [int(rng.integers(0, max(1, len(raw) - n))) for n in sizes]
        found = np.flatnonzero(total)
        return cls(lang, found, total[found], [raw[a : a + max(n, 8)] for a, n in zip(starts, sizes, strict=True)])


def _counted(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(np.concatenate(buckets(np.frombuffer(raw, dtype=np.uint8))), return_counts=True)


def train(samples: list[Sample], seed: int = 7) -> Model | None:
    """Fit on the samples; every tenth is kept for calibration."""
    langs = sorted({x.lang for x in samples})
    if not langs:
        return None
    rng, label = np.random.default_rng(seed), {x: i for i, x in enumerate(langs)}
    fit = [x for i, x in enumerate(samples) if i % 10] or samples
    check = samples[::10]
    emb, w, b = rng.normal(0, 0.05, (BUCKETS, WIDTH)), np.zeros((WIDTH, len(langs))), np.zeros(len(langs))
    w += rng.normal(0, 0.05, w.shape)
    units = []
    for x in fit:
        for h, n in [(x.found, x.counts), *(_counted(raw) for raw in x.windows[2:])]:
            units.append((h, n / n.sum(), label[x.lang]))
    steps, done = EPOCHS * len(units), 0
    for _ in range(EPOCHS):
        for u in rng.permutation(len(units)).tolist():
            h, share, y = units[u]
            rate = 0.5 * (1 - done / steps)
            done += 1
            mean = share @ emb[h]
            z = mean @ w + b
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            back = w @ p
            w -= rate * np.outer(mean, p)
            b -= rate * p
            emb[h] -= (8 * rate / len(h)) * back
    model = Model(langs, (emb @ w).astype(np.float32), b, 1.0, 0.0)
    seen = [(h, n / n.sum(), x.lang) for x in check for h, n in [(x.found, x.counts), *(_counted(raw) for raw in x.windows[:2])]]
    z = np.array([share @ model.scores[h].astype(np.float64) for h, share, _ in seen]) + b
    y = np.array([label[lang] for *_, lang in seen])
    doubt = 1 / (len(y) + 2)  # as if one more had been wrong: a clean sample is no proof of certainty

    def loss(t: float) -> float:
        s = z / t - (z / t).max(axis=1, keepdims=True)
        log_p = s - np.log(np.exp(s).sum(axis=1, keepdims=True))
        return -float(((1 - doubt) * log_p[np.arange(len(y)), y] + doubt * log_p.mean(axis=1)).mean())

    model.temperature = min((float(t) for t in np.geomspace(0.002, 5, 80)), key=loss)
    best, right = softmax(z / model.temperature).max(axis=1), z.argmax(axis=1) == y
    order = np.argsort(-best, kind="stable")
    good = np.cumsum(right[order]) / np.arange(1, len(order) + 1) >= PRECISION
    model.threshold = float(best[order][np.flatnonzero(good)[-1]]) if good.any() else 1.0
    return model


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def sample(docs: DataFrame, may_learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = PER_LANG, most: int = MOST, floor: int = FLOOR) -> list[Sample]:
    """The documents to learn from, chosen by a hash of the id.

    The languages' counts, joined to their documents, decide how many are drawn; half as many
    again are, and the surplus goes. So the sample doesn't grow with the corpus, and a rare
    language isn't lost among many.
    """
    text = F.col(text_col).cast("string")
    usable = docs.where(may_learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.xxhash64(id_col).alias("draw"), text.alias("text"))
    counts = stage(usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "languages")
    n_langs = counts.count()
    if not n_langs:
        return []
    wanted = max(floor, min(per_lang, most // n_langs))
    rates = counts.select(F.col("lang").alias("counted"), F.least(F.lit(1.0), F.lit(1.5 * wanted + 10) / F.col("n")).alias("rate"))
    near = F.pmod("draw", F.lit(1 << 40)) < F.col("rate") * F.lit(float(1 << 40))
    by = Window.partitionBy("lang").orderBy(F.pmod("draw", F.lit(1 << 40)), "draw", F.xxhash64("text"), "text")
    drawn = usable.join(rates, F.col("lang") == F.col("counted")).where(near).withColumn("nth", F.row_number().over(by)).where(F.col("nth") <= wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lang, nth, value in zip(*(c.to_pylist() for c in b.columns), strict=True):
                x = Sample.of(lang, value)
                kinds = (pa.string(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.binary()))
                row = (lang, nth, x.found.astype("<i4").tobytes(), x.counts.astype("<i8").tobytes(), x.windows)
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], names=["lang", "nth", "found", "counts", "windows"])

    rows = drawn.select("lang", "nth", "text").mapInArrow(run, "lang string, nth int, found binary, counts binary, windows array<binary>").collect()
    return [Sample(r["lang"], np.frombuffer(r["found"], "<i4"), np.frombuffer(r["counts"], "<i8"), list(r["windows"])) for r in sorted(rows, key=lambda r: (r["nth"], r["lang"]))]


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, lang_pred, score, accepted`` for every whole text."""
    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, lang_pred string, score double, accepted boolean"
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            texts = b.column(1).to_pylist()
            known = [i for i, t in enumerate(texts) if m is not None and t is not None and _LETTER.search(t)]
            lang, score = ["und"] * len(texts), np.zeros(len(texts))
            if known:
                p = softmax((averages([texts[i] for i in known], m.scores) + m.bias) / m.temperature)
                score[known] = p.max(axis=1)
                for i, k in zip(known, p.argmax(axis=1).tolist(), strict=True):
                    lang[i] = m.langs[k]
            ok = np.zeros(len(texts), dtype=bool)
            ok[known] = score[known] >= m.threshold if known else False
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang), pa.array(score), pa.array(ok)], names=[id_col, "lang_pred", "score", "accepted"])

    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, schema)
