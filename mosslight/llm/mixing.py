"""Mixing sources to target weights by entropy balancing.

Targets: sources by code point (null last) weigh 5, 2, 1, repeating, and share 150 % of all
words; a source's target stops at twice its size and the excess is shared again by weight.

Rates: among all rates between 0 and 2 that meet every source's token constraint, those with
the least (Fermi-Dirac) entropy relative to the corpus-wide rate are
``rate = 2 * sigmoid(log-odds of the base rate + theta[source] * size / mean size)``: the
odds of a document are tilted exponentially by its tokens. ``theta`` solves a convex dual,
one Newton iteration for all sources at once by a grouped aggregation over the histogram of
(source, size); a bracket guards every step.

Copies: rows equal in source, id and size are one group, so a row that is repeated very often
costs a row. Within shards of a source, groups go from long to short, and each gets the whole
numbers next to its rate that keep the words taken closest to the words owed so far. What is
left over at a shard's end is about the size of its shortest document. Shards and order follow
from source, id and size alone, so neither reruns nor another split of the input change the mix.

Edge cases: a null text has size 0 and is never taken; a null source is a source; repeated
rows are rows of their own, and of rows equal in source, id and size those that take a copy more
are the first by a hash of the text; very long texts only count their words, in the scan; an
empty table gives an empty result; an id may be null; further columns, whatever their names, are
ignored by ``mix`` and kept by ``mixed_documents``.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mosslight.staging import placed, stage

#: Fixed values of the mix.
WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2
WORD = r"[^\x20\x09-\x0D]+"
SHARD_DOCS, STEPS, TOLERANCE = 1000, 40, 1e-7


def targets(groups: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """``sid, source, n_docs, source_size, target``, a row for each source of ``groups`` (``source, size, n``).

    Sources are ranked by sorting their aggregated table in ranges: a rank is the row's number in
    its range and the rows of the ranges before. Sharing the excess again takes one aggregation a
    round; only sums reach the driver.
    """
    by_source = stage(groups.groupBy("source").agg(F.sum("n").alias("n_docs"), F.sum(F.col("n") * F.col("size")).alias("source_size")), "by_source")
    ranges = by_source.repartitionByRange(F.col("source").asc_nulls_last()).sortWithinPartitions(F.col("source").asc_nulls_last())
    ranges = stage(ranges.select("*", F.spark_partition_id().alias("range"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("nth")), "ranges")
    before = F.sum("in_range").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    starts = ranges.groupBy("range").agg(F.count(F.lit(1)).alias("in_range")).select("range", F.coalesce(before, F.lit(0)).alias("start"))
    sid = (F.col("start") + F.col("nth")).cast("long")
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (F.col("sid") % len(weights)).cast("int") + 1)
    table = stage(ranges.join(starts, "range").select("source", "n_docs", "source_size", sid.alias("sid")).withColumn("weight", weight), "sources")

    size, w = F.col("source_size"), F.col("weight")
    total = table.agg(F.sum(size)).first()[0] or 0
    capped, left = 0, table.agg(F.sum(w)).first()[0] or 0
    while True:
        level = (share * total - capped) / left if left else 0.0
        above = F.lit(level) * w >= most * size
        now = table.agg(F.sum(F.when(above, most * size).otherwise(0)).alias("capped"), F.sum(F.when(above, 0).otherwise(w)).alias("left")).first()
        if (now["capped"] or 0, now["left"] or 0) == (capped, left):
            break
        capped, left = now["capped"] or 0, now["left"] or 0
        if not left:
            break
    target = F.least(F.lit(level) * w, (most * size).cast("double")) if left else (most * size).cast("double")
    return table.select("sid", "source", "n_docs", "source_size", target.alias("target"))


def _rate(theta: Column, size: Column, mean: Column, base: float, most: int) -> Column:
    return most / (1 + F.exp(-(F.lit(base) + theta * size / mean)))


def solve(histogram: DataFrame, table: DataFrame, share: float = SHARE, most: int = MOST) -> DataFrame:
    """``table`` with ``theta`` and ``mean``: bracketed Newton on every source's dual at once."""
    base = math.log(share / (most - share))
    open_ = table.where((F.col("target") > 0) & (F.col("target") < most * F.col("source_size")))
    state = open_.select("sid", F.col("target").alias("owed"), (F.col("source_size") / F.col("n_docs")).alias("mean"), F.lit(0.0).alias("theta"), F.lit(-1e9).alias("low"), F.lit(1e9).alias("high"))
    for _ in range(STEPS):
        joined = histogram.join(state, "sid")
        rate = _rate(F.col("theta"), F.col("size"), F.col("mean"), base, most)
        moments = joined.groupBy("sid", "owed", "mean", "theta", "low", "high").agg(
            F.sum(F.col("n") * F.col("size") * rate).alias("got"),
            F.sum(F.col("n") * F.col("size") * F.col("size") / F.col("mean") * rate * (1 - rate / most)).alias("slope"),
        )
        off = F.col("got") - F.col("owed")
        low, high = F.when(off <= 0, F.col("theta")).otherwise(F.col("low")), F.when(off >= 0, F.col("theta")).otherwise(F.col("high"))
        newton = F.col("theta") - F.greatest(F.lit(-3.0), F.least(F.lit(3.0), off / F.greatest(F.col("slope"), F.lit(1e-300))))
        inside = moments.withColumns({"low": low, "high": high, "next": newton, "error": F.abs(off) / F.col("owed")})
        step = F.when(F.col("error") == 0, F.col("theta")).when((F.col("next") > F.col("low")) & (F.col("next") < F.col("high")), F.col("next")).otherwise((F.col("low") + F.col("high")) / 2)
        solved = stage(inside.select("sid", "owed", "mean", F.when(F.col("error") > TOLERANCE, step).otherwise(F.col("theta")).alias("theta"), "low", "high", "error"), "theta")
        worst = solved.agg(F.max("error")).first()[0]
        state = solved.drop("error")
        if worst is None or worst <= TOLERANCE:
            break
    return table.join(state.select("sid", "mean", F.round("theta", 9).alias("theta")), "sid", "left")


def copies_in_shard(rows: pd.DataFrame, most: int = MOST) -> pd.DataFrame:
    """``low`` and ``more`` for the groups of one shard: of ``n`` rows, ``more`` take ``low + 1`` copies and the others ``low``.

    Error diffusion from long to short documents, whole groups at a time.
    """
    rows = rows.sort_values(["size", "doc_id"], ascending=[False, True], kind="stable")
    debt, low, more = 0.0, np.zeros(len(rows), dtype=np.int64), np.zeros(len(rows), dtype=np.int64)
    for i, (size, rate, n) in enumerate(zip(rows["size"].tolist(), rows["rate"].tolist(), rows["n"].tolist(), strict=True)):
        if size:
            low[i] = min(math.floor(rate), most)
            owed = rate * size * n + debt - float(low[i] * size * n)
            more[i] = min(n, max(0, math.ceil(owed / size - 0.5))) if low[i] < most else 0
            debt = owed - float(more[i] * size)
    return rows.assign(low=low, more=more)


def group_copies(sized: DataFrame, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """``source, doc_id, size, n, source_size, target, rate, low, more``: a row for each group of ``sized``.

    A hot source is dealt out in shards of about ``shard_docs`` documents by a hash of id and size.
    """
    groups = stage(sized.groupBy("source", "doc_id", "size").agg(F.count(F.lit(1)).alias("n")), "groups")
    table = targets(groups)
    keyed = lambda df, by: df.join(by.withColumnRenamed("source", "source_key"), F.col("source").eqNullSafe(F.col("source_key"))).drop("source_key")
    histogram = stage(keyed(groups.groupBy("source", "size").agg(F.sum("n").alias("n")), table.select("sid", "source")).select("sid", "size", "n"), "histogram")
    solved = solve(histogram, table)
    base = math.log(SHARE / (MOST - SHARE))
    rate = F.when(F.col("theta").isNull(), F.when(F.col("target") > 0, F.lit(float(MOST))).otherwise(0.0)).otherwise(_rate(F.col("theta"), F.col("size"), F.col("mean"), base, MOST))
    shard = F.pmod(F.xxhash64("doc_id", "size"), F.ceil(F.col("n_docs") / shard_docs))
    rows = keyed(groups, solved).select("source", "doc_id", "size", "n", "source_size", "target", rate.alias("rate"), "sid", shard.alias("shard"))
    schema = "source string, doc_id long, size long, n long, source_size long, target double, rate double, sid long, shard long, low long, more long"
    return rows.groupBy("sid", "shard").applyInPandas(lambda rows: copies_in_shard(rows), schema).drop("sid", "shard")


def mix(sized: DataFrame, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """``doc_id, size, source_size, target, rate, copies, taken``, a row for each row of ``sized`` (``doc_id, source, size``)."""
    many = 10_000  # rows of a group at a time, so that no array grows with it
    blocks = group_copies(sized, shard_docs).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(many).cast("long"))))
    rows = blocks.withColumn("nth", F.explode(F.sequence("block", F.least(F.col("n"), F.col("block") + many) - 1)))
    copies = F.col("low") + (F.col("nth") < F.col("more")).cast("long")
    return rows.select("doc_id", "size", "source_size", "target", "rate", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def _sized(rows: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    text = F.col(f"row.`{text_col}`")
    size = F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
    return rows.select("place_file", "place_row", F.col(f"row.`{id_col}`").cast("long").alias("doc_id"), F.col(f"row.`{source_col}`").cast("string").alias("source"), size.alias("size"), F.xxhash64(text).alias("text_hash"))


def size_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The table that ``mix`` takes, without texts."""
    return _sized(placed(docs), id_col, text_col, source_col)


def row_copies(sized: DataFrame) -> DataFrame:
    """``place_file, place_row, copies`` of the rows that are taken.

    Rows are numbered only in groups of several rows that don't all take as many copies.
    """
    found = group_copies(sized).select(F.col("source").alias("source_key"), F.col("doc_id").alias("id_key"), F.col("size").alias("size_key"), "n", "low", "more")
    same = F.col("source").eqNullSafe(F.col("source_key")) & F.col("doc_id").eqNullSafe(F.col("id_key")) & (F.col("size") == F.col("size_key"))
    rows = stage(sized.join(found, same), "row_groups")
    mixed = (F.col("more") > 0) & (F.col("more") < F.col("n"))
    nth = F.row_number().over(Window.partitionBy("source", "doc_id", "size").orderBy("text_hash", "place_file", "place_row"))
    alike = rows.where(~mixed).select("place_file", "place_row", (F.col("low") + (F.col("more") > 0).cast("long")).alias("copies"))
    told_apart = rows.where(mixed).withColumn("nth", nth).select("place_file", "place_row", (F.col("low") + (F.col("nth") <= F.col("more")).cast("long")).alias("copies"))
    return alike.unionByName(told_apart).where("copies > 0")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of ``docs``, each as many times as the mix takes it (0, 1 or 2).

    Texts are shuffled once, by a join that sorts and can spill, whatever the size of either side.
    """
    rows = placed(docs)
    taken = stage(row_copies(stage(_sized(rows, id_col, text_col, source_col), "sizes")), "taken")
    repeated = rows.join(taken.hint("merge"), ["place_file", "place_row"]).select("row", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))))
    return repeated.select("row.*")
