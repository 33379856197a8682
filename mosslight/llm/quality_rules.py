"""Quality rules with host-level verdicts, in native expressions only.

Every document gets rule statistics from its whole text. Rule failures are aggregated by
host, the host rates are shrunk with an empirical beta prior, and the verdict on the host
is joined back: on a suspect host the stricter limits apply.

Edge cases: a null or blank text has no words and fails the base rules; a very long text is
judged whole, its windows as one array of hashes in its row; a rate that ties with the limit is
suspect; a null host is a host of its own; repeated rows count once each; an empty table gives an
empty result; further columns, whatever their names, are ignored by ``rule_statistics`` and kept
by ``filter_documents``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mosslight.functions.lets import let
from mosslight.staging import stage

#: What separates words, as characters and as patterns, and the symbols that are counted.
BLANKS = " \t\n\x0b\x0c\r"
BLANK, SEPARATOR = r"[\x20\x09-\x0D]", r"[\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"


@dataclass(frozen=True)
class Limits:
    """Per cent of a document that may show a defect: everywhere, and on a suspect host."""

    min_words: int = 50
    repeat: int = 50
    symbols: int = 5
    dup_lines: int = 40
    strict_repeat: int = 30
    strict_symbols: int = 1
    strict_dup_lines: int = 20
    min_mean_word: float = 2.0
    max_mean_word: float = 12.0
    suspect_rate: float = 0.5


STATISTICS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]


def _repeat_words(words: Column) -> Column:
    """Words inside a three-word window that occurs twice or more; windows are compared as 64-bit hashes."""

    def covered(hashes: Column) -> Column:
        ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def merge(s: Column) -> Column:
            same = lambda x, j: F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))
            starts = F.sort_array(F.transform(F.filter(s, lambda x, j: same(x, j + 1) | F.when(j > 0, same(x, j - 1)).otherwise(False)), lambda x: x["i"]))
            grow = lambda a, x: F.struct((a["n"] + x + 3 - F.greatest(x, a["upto"])).alias("n"), (x + 3).alias("upto"))
            return F.aggregate(starts, F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto")), grow, lambda a: a["n"])

        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(ordered, merge))

    windows = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(F.size(words) < 4, F.lit(0)).otherwise(let(windows, covered))


def rule_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """``id_col``, ``host`` and the statistics of every whole text, in one scan without a shuffle."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    trimmed = F.btrim(text, F.lit(BLANKS))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    by_words = let(F.split(trimmed, SEPARATOR), lambda w: F.struct(F.size(w).alias("n"), _repeat_words(w).alias("r")))
    by_lines = let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("d")))
    blank = trimmed == ""
    return (
        docs.select(
            F.col(id_col),
            F.col(host_col).alias("host"),
            F.when(~blank, by_words).alias("w"),
            by_lines.alias("l"),
            (F.length(text) - F.regexp_count(text, F.lit(BLANK))).cast("long").alias("word_chars"),
            F.regexp_count(text, F.lit(SYMBOL)).cast("long").alias("n_symbols"),
        )
        .select(
            id_col,
            "host",
            F.coalesce(F.col("w.n"), F.lit(0)).cast("long").alias("n_words"),
            "word_chars",
            "n_symbols",
            F.col("l.n").cast("long").alias("n_lines"),
            F.col("l.d").cast("long").alias("n_dup_lines"),
            F.coalesce(F.col("w.r"), F.lit(0)).cast("long").alias("n_repeat_words"),
        )
    )


def _rules(limits: Limits) -> dict[str, Column]:
    n, c = F.col("n_words"), F.col("word_chars")
    over = lambda part, whole, share: 100 * F.col(part) > share * F.col(whole)
    return {
        "base_failed": (n < limits.min_words) | over("n_repeat_words", "n_words", limits.repeat),
        "failed": over("n_symbols", "word_chars", limits.symbols) | over("n_dup_lines", "n_lines", limits.dup_lines) | (c < limits.min_mean_word * n) | (c > limits.max_mean_word * n),
        "borderline": over("n_symbols", "word_chars", limits.strict_symbols) | over("n_dup_lines", "n_lines", limits.strict_dup_lines) | over("n_repeat_words", "n_words", limits.strict_repeat),
    }


def host_verdicts(judged: DataFrame, limits: Limits) -> DataFrame:
    """``host, host_docs, host_failures, host_rate, host_suspect``, a row for each host.

    The prior is a beta distribution fitted by moments over the hosts: its mean is the
    failure rate of all documents, its weight follows from how much more the host rates
    vary than binomial noise. Only the five sums of that fit reach the driver.
    """
    hosts = stage(judged.groupBy("host").agg(F.count(F.lit(1)).alias("host_docs"), F.sum((F.col("base_failed") | F.col("failed")).cast("long")).alias("host_failures")), "hosts")
    n, k = F.col("host_docs"), F.col("host_failures")
    fit = hosts.agg(F.sum(n).alias("n"), F.sum(k).alias("k"), F.count(F.lit(1)).alias("h"), F.sum((n * n).cast("double")).alias("nn"), F.sum(k.cast("double") * k / n).alias("kk")).first()
    alpha, beta = beta_prior(fit["n"] or 0, fit["k"] or 0, fit["h"], fit["nn"] or 0.0, fit["kk"] or 0.0)
    rate = (k + F.lit(alpha)) / (n + F.lit(alpha + beta))
    return hosts.withColumn("host_rate", rate).withColumn("host_suspect", rate >= limits.suspect_rate)


def beta_prior(n: int, k: int, hosts: int, nn: float, kk: float, weakest: float = 2.0, strongest: float = 10_000.0) -> tuple[float, float]:
    """Alpha and beta by moments from the sums over hosts of n, k, 1, n*n and k*k/n."""
    if not n:
        return weakest / 2, weakest / 2
    p = k / n
    noise = p * (1 - p)
    room = noise * (n - nn / n - (hosts - 1))
    rho = (kk - n * p * p - noise * (hosts - 1)) / room if room > 0 else 0.0
    weight = min(strongest, max(weakest, 1 / rho - 1)) if rho > 0 else strongest
    return p * weight, (1 - p) * weight


def judge(docs: DataFrame, limits: Limits = Limits(), id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """Statistics, ``base_failed``, the host's columns and ``kept`` for every document.

    A document is kept unless it fails the base rules, fails a rule of its own, or comes
    from a suspect host and is borderline. A clean document on a suspect host stays.
    The statistics are a work table, so texts are read once. The join with the hosts is
    left to the planner: it broadcasts them under its own size limit and splits skewed
    hosts beyond that.
    """
    judged = stage(rule_statistics(docs, id_col, text_col, host_col).withColumns(_rules(limits)), "rules")
    hosts = host_verdicts(judged, limits).withColumnRenamed("host", "host_key")
    joined = judged.join(hosts, F.col("host").eqNullSafe(F.col("host_key")), "left").drop("host_key")
    kept = ~F.col("base_failed") & ~F.col("failed") & ~(F.coalesce(F.col("host_suspect"), F.lit(False)) & F.col("borderline"))
    return joined.withColumn("kept", kept)


def filter_documents(docs: DataFrame, limits: Limits = Limits(), text_col: str = "text", host_col: str = "source") -> DataFrame:
    """The documents that ``judge`` keeps, with all their columns.

    Rows and verdicts are staged together, so texts are judged once and never shuffled.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text_col).alias("text"), F.col(host_col).alias("source"))
    rules = _rules(limits)
    judged = stage(rule_statistics(rows, "row").withColumns(rules).select("row", "host", *rules), "rules")
    suspect = host_verdicts(judged, limits).where("host_suspect").select(F.col("host").alias("suspect_host"), F.lit(True).alias("suspect"))
    passed = judged.where(~F.col("base_failed") & ~F.col("failed"))
    joined = passed.join(suspect, F.col("host").eqNullSafe(F.col("suspect_host")), "left")
    return joined.where(F.col("suspect").isNull() | ~F.col("borderline")).select("row.*")
