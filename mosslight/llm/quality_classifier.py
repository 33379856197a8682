"""Quality by hierarchical empirical Bayes: document evidence, host and path posteriors.

Document evidence is a naive Bayes log-odds over a text's distinct words, frequent word
beginnings and binned text statistics, learned from a bounded sample of labelled documents
(``SAMPLE`` at most, those of the smallest hash of the id, each text whole) and calibrated on
halves that the weights were not learned from. One such model judges quality, another toxicity.
Tokens are made and counted on the executors; the driver gets the ``LEXICON`` strongest and
three numbers for each labelled document.

The probabilities of all documents are then summed by path and by host. A host's rate shrinks
toward the global rate and a path's toward its host's, with beta priors whose weights are
fitted to how much host rates vary around the global one, and path rates around their host's,
beyond noise. A document's posterior odds are its own likelihood ratio times the odds of its
path without that document, so no evidence counts twice.

Edge cases: a null text has no words and is judged by its statistics; a very long text is
judged whole; null hosts and paths are hosts and paths of their own; without labels of both
kinds the evidence is neutral; repeated rows count once each as documents, while of rows that
share a labelled id the smallest text and the smallest label are learned from; tokens tie by
their text; an empty table gives an empty result; further columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mosslight.llm.quality_rules import beta_prior
from mosslight.staging import stage

SAMPLE, MIN_DOCS, LEXICON, STRICT = 4000, 3, 20_000, 2.5
_MARKS = "#*$%&|<>"


def tokens(text: str | None) -> set[str]:
    """Distinct lower-case words without marks around them, frequent word beginnings, and the bins of the text's statistics.

    A beginning of four or six letters counts if it starts a twentieth of the distinct words, so
    long texts don't have more of them than short ones.
    """
    text = text or ""
    words = text.split()
    out = {w.strip(".,;:!?") for w in set(text.lower().split())}
    n, chars = len(words), max(1, len(text))
    begun = Counter([w[:4] for w in out if len(w) > 4] + [w[:6] for w in out if len(w) > 6])
    starts = {"\b" + p for p, c in begun.items() if c > 1 and 20 * c >= len(out)}
    marks = sum(map(text.count, _MARKS))
    upper = sum(map(str.isupper, words))
    lines = [x for x in text.split("\n") if x.strip()]
    bins = {
        "words": int(math.log2(n + 1)),
        "length": int(2 * (chars - n) / max(1, n)),
        "marks": int(math.log2(1 + 256 * marks / chars)),
        "upper": int(4 * upper / max(1, n)),
        "variety": int(8 * len(out) / max(1, n)),
        "lines": int(4 * len(set(lines)) / max(1, len(lines))),
        "shout": int(math.log2(1 + 256 * text.count("!") / chars)),
    }
    return out | starts | {f"\t{k}{v}" for k, v in bins.items()}


@dataclass
class Evidence:
    """Weights of informative tokens; the calibration's slopes and intercept; share of positives."""

    weights: dict[str, float] = field(default_factory=dict)
    slopes: tuple[float, float, float] = (0.0, 0.0, 0.0)
    base: float = 0.5

    def raw(self, found: Iterable[str]) -> tuple[float, float]:
        """Evidence of the words, scaled so that long texts aren't surer for their length, and of the statistics."""
        w = self.weights
        words = sorted(w[x] for x in found if x in w and x[0] != "\t")
        stats = sorted(w[x] for x in found if x in w and x[0] == "\t")
        return sum(words) / math.sqrt(1 + len(words)), sum(stats)

    def log_ratio(self, found: set[str]) -> float:
        """Calibrated log-odds less those of the base rate."""
        if not self.weights:
            return 0.0
        return sum(a * x for a, x in zip(self.slopes, (*self.raw(found), 1.0), strict=True)) - _logit(self.base)


def _logit(p: float) -> float:
    p = min(1 - 1e-9, max(1e-9, p))
    return math.log(p / (1 - p))


def labelled(docs: DataFrame, labels: DataFrame, columns: list[str], id_col: str = "doc_id", text_col: str = "text", most: int = SAMPLE) -> DataFrame:
    """``half, found`` and the label ``columns`` of at most ``most`` labelled documents, a stored table; ``found`` are a text's tokens."""
    drawn = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("label_id")).agg(*[F.min(F.col(c).cast("int")).alias(c) for c in columns])
    drawn = stage(drawn.orderBy(F.xxhash64("label_id"), "label_id").limit(most), "drawn")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    one = texts.join(F.broadcast(drawn), F.col("id") == F.col("label_id")).groupBy("label_id", *columns).agg(F.min("text").alias("text"))
    half = F.pmod(F.shiftright(F.xxhash64("label_id"), 8), F.lit(2)).cast("int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = pa.array(([x for x in sorted(tokens(t)) if x] for t in b.column(b.num_columns - 1).to_pylist()), pa.list_(pa.string()), size=b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], found], names=["half", *columns, "found"])

    schema = "half int, " + "".join(f"{c} int, " for c in columns) + "found array<string>"
    return stage(one.select(half.alias("half"), *columns, "text").mapInArrow(run, schema), "labelled")


#: Which halves of the labelled documents weights are learned from.
VARIANTS = {"all": (0, 1), "first": (0,), "second": (1,)}


def learn(sample: DataFrame, columns: list[str]) -> dict[tuple[str, str], dict[str, float]]:
    """Weights by (label, variant): log ratios of token frequencies; a token counts if chance alone would seldom give its share."""
    cells = [(c, h, y) for c in columns for h in (0, 1) for y in (0, 1)]
    name = lambda c, h, y: f"n_{c}_{h}_{y}"
    counted = [F.count(F.when((F.col("half") == h) & ((F.col(c) > 0).cast("int") == y), 1)).alias(name(c, h, y)) for c, h, y in cells]
    totals = sample.agg(*counted).first()
    words = stage(sample.select("half", *columns, F.explode("found").alias("token")).groupBy("token").agg(*counted), "tokens")
    parts = []
    for c in columns:
        for v, halves in VARIANTS.items():
            ones, zeros = (sum((F.col(name(c, h, y)) for h in halves), F.lit(0)) for y in (1, 0))
            n1, n0 = (sum(totals[name(c, h, y)] for h in halves) for y in (1, 0))
            score = F.ln((ones + 0.5) / (n1 + 1)) - F.ln((zeros + 0.5) / (n0 + 1))
            spread = F.abs(score) / F.sqrt(1 / (ones + 0.5) + 1 / (zeros + 0.5))
            strong = words.where(ones + zeros >= MIN_DOCS).select(F.lit(c).alias("label"), F.lit(v).alias("variant"), "token", score.alias("score"), spread.alias("spread")).where(F.col("spread") > STRICT)
            parts.append(strong.orderBy(F.desc("spread"), "token").limit(LEXICON))
    out: dict[tuple[str, str], dict[str, float]] = {(c, v): {} for c in columns for v in VARIANTS}
    for r in reduce(DataFrame.unionByName, parts).collect():
        out[r["label"], r["variant"]][r["token"]] = r["score"]
    return out


def raw_evidence(sample: DataFrame, columns: list[str], weights: dict[tuple[str, str], dict[str, float]]) -> dict[str, list[tuple[int, float, float]]]:
    """(label, words' evidence, statistics' evidence) of every labelled document, by weights of the half that it isn't in."""
    shared = sample.sparkSession.sparkContext.broadcast({k: Evidence(w) for k, w in weights.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models, other = shared.value, ("second", "first")
        for b in batches:
            rows = []
            for r in b.to_pylist():
                rows += [(c, int(r[c] > 0), *models[c, other[r["half"]]].raw(r["found"])) for c in columns if r[c] is not None]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.string(), pa.int32(), pa.float64(), pa.float64()), strict=True)], names=["label", "y", "words", "stats"])

    out: dict[str, list[tuple[int, float, float]]] = {c: [] for c in columns}
    for r in sample.mapInArrow(run, "label string, y int, words double, stats double").collect():
        out[r["label"]].append((r["y"], r["words"], r["stats"]))
    return {c: sorted(x) for c, x in out.items()}


def fit(sample: DataFrame, columns: list[str]) -> dict[str, Evidence]:
    """A calibrated model for each label; neutral without enough documents of both kinds.

    The logistic calibration uses, for either half, weights learned from the other.
    """
    weights = learn(sample, columns)
    feats = raw_evidence(sample, columns, weights)
    return {c: calibrated(weights[c, "all"], feats[c]) for c in columns}


def calibrated(weights: dict[str, float], feats: list[tuple[int, float, float]]) -> Evidence:
    ones = sum(y for y, _, _ in feats)
    out = Evidence(base=(ones + 1) / (len(feats) + 2))
    if not 2 * MIN_DOCS <= ones <= len(feats) - 2 * MIN_DOCS:
        return out
    x, y = np.array([(*f[1:], 1.0) for f in feats]), np.array([f[0] for f in feats], dtype=float)
    t = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    start = np.array([0.1, 0.1, _logit(out.base)])
    ab, ridge = start.copy(), np.diag([1e-2, 1e-2, 0.0])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ ab, -30, 30)))
        hess = (x * (p * (1 - p))[:, None]).T @ x + ridge + 1e-6 * np.eye(3)
        ab = ab - np.clip(np.linalg.solve(hess, x.T @ (p - t) + ridge @ (ab - start)), -1, 1)
    out.weights = weights
    out.slopes = (*(max(0.0, float(a)) for a in ab[:2]), float(ab[2]))
    return out


def evidence(docs: DataFrame, models: dict[str, Evidence], id_col: str, host_col: str, path_col: str, text_col: str = "text") -> DataFrame:
    """``doc_id, host, path`` and a calibrated log likelihood ratio for each model."""
    shared = docs.sparkSession.sparkContext.broadcast(models)
    schema = f"doc_id {docs.schema[id_col].dataType.simpleString()}, host string, path string, " + ", ".join(f"{k} double" for k in models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            ratios = [[] for _ in m]
            for t in b.column(3).to_pylist():
                found = tokens(t)
                for out, e in zip(ratios, m.values(), strict=True):
                    out.append(e.log_ratio(found))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), *(pa.array(x, pa.float64()) for x in ratios)], names=["doc_id", "host", "path", *m])

    return docs.select(F.col(id_col), F.col(host_col).cast("string"), F.col(path_col).cast("string"), F.col(text_col).cast("string")).mapInArrow(run, schema)


def _sites(rows: DataFrame, keys: list[str], p: Column) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(p).alias("k"))


def residual_weight(paths: DataFrame, weakest: float = 2.0, strongest: float = 10_000.0) -> float:
    """The weight of a path's prior, by moments of path rates around their host's rate (``n, k, host_n, host_k``)."""
    p = F.col("host_k") / F.col("host_n")
    v, apart = p * (1 - p), 1 - F.col("n") / F.col("host_n")
    s = paths.agg(F.sum(F.col("n") * F.pow(F.col("k") / F.col("n") - p, 2)).alias("spread"), F.sum(v * apart).alias("noise"), F.sum(v * (F.col("n") - 1) * apart).alias("room")).first()
    rho = (s["spread"] - s["noise"]) / s["room"] if s["room"] else 0.0
    return min(strongest, max(weakest, 1 / rho - 1)) if rho > 0 else strongest


def posteriors(rows: DataFrame, name: str, base: float) -> DataFrame:
    """``host, path, n, k, host_n, host_k, host_rate, path_rate, alpha, beta, weight``: rates of ``name`` for every path, shrunk level by level.

    Paths and hosts come from one aggregation of the documents; eight sums reach the driver.
    """
    paths = stage(_sites(rows, ["host", "path"], probability(name, base)), "paths")
    hosts = stage(paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("k").alias("host_k")), "hosts")
    n, k = F.col("host_n"), F.col("host_k")
    s = hosts.agg(F.sum(n).alias("n"), F.sum(k).alias("k"), F.count(F.lit(1)).alias("h"), F.sum(n.cast("double") * n).alias("nn"), F.sum(k * k / n).alias("kk")).first()
    a, b = beta_prior(s["n"] or 0, s["k"] or 0.0, s["h"], s["nn"] or 0.0, s["kk"] or 0.0)
    joined = stage(paths.join(hosts.withColumnRenamed("host", "host_key"), F.col("host").eqNullSafe(F.col("host_key"))).drop("host_key"), "sites")
    w = residual_weight(joined)
    host_rate = (k + F.lit(a)) / (n + F.lit(a + b))
    path_rate = (F.col("k") + F.lit(w) * host_rate) / (F.col("n") + F.lit(w))
    return joined.select("host", "path", "n", "k", "host_n", "host_k", host_rate.alias("host_rate"), path_rate.alias("path_rate"), F.lit(a).alias("alpha"), F.lit(b).alias("beta"), F.lit(w).alias("weight"))


def probability(name: str, base: float) -> Column:
    """Of a document by its own evidence and the base rate alone."""
    return 1 / (1 + F.exp(-(F.col(name) + F.lit(_logit(base)))))


def posterior(ratio: Column, own: Column, site: Column) -> Column:
    """A document's probability: its likelihood ratio times the odds of its path's rate, both levels without the document's ``own`` share."""
    host = (F.greatest(F.lit(0.0), site["host_k"] - own) + site["alpha"]) / (site["host_n"] - 1 + site["alpha"] + site["beta"])
    path = (F.greatest(F.lit(0.0), site["k"] - own) + site["weight"] * host) / (site["n"] - 1 + site["weight"])
    return 1 / (1 + F.exp(-(ratio + F.ln(path / (1 - path)))))


def combine(rows: DataFrame, bases: dict[str, float]) -> DataFrame:
    """``rows`` (a stored table of ``doc_id, host, path`` and a log likelihood ratio for each of ``bases``) with ``<name>_host, <name>_path, <name>_post``."""
    out = rows
    for name, base in bases.items():
        found = posteriors(rows, name, base)
        site = found.select(F.col("host").alias("h"), F.col("path").alias("p"), F.struct(*[c for c in found.columns if c not in ("host", "path")]).alias("site"))
        joined = out.join(site, F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("p")))
        post = posterior(F.col(name), probability(name, base), F.col("site"))
        out = joined.withColumns({f"{name}_host": F.col("site.host_rate"), f"{name}_path": F.col("site.path_rate"), f"{name}_post": post}).drop("h", "p", "site")
    return out


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang") -> DataFrame:
    """``doc_id, host, path, host_rate, path_rate, quality, toxicity, kept`` for every document."""
    models = fit(labelled(docs, labels, ["quality", "toxic"], id_col, text_col), ["quality", "toxic"])
    rows = stage(evidence(docs, models, id_col, host_col, path_col, text_col), "evidence")
    out = combine(rows, {name: m.base for name, m in models.items()})
    judged = out.select("doc_id", "host", "path", F.col("quality_host").alias("host_rate"), F.col("quality_path").alias("path_rate"), F.col("quality_post").alias("quality"), F.col("toxic_post").alias("toxicity"))
    return judged.withColumn("kept", (F.col("quality") >= 0.5) & (F.col("toxicity") < 0.5))
