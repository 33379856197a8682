"""Line deduplication by overlapping three-line windows, in native expressions only.

Lines with a word are trimmed and numbered within their document. Every three consecutive
ones form a window, hashed to 128 bits. Windows that occur twice or more anywhere are found
by a grouped aggregation; all occurrences but the first, in the order of id, text and position,
cover their three lines, and covered lines go. Each removed line equals an earlier line of
the corpus that a chain of first occurrences ends at, so one copy of every line stays.

Edge cases: a null text stays null; blank lines stay and don't interrupt a window; documents
of fewer than three lines with words have no window and stay whole; a very long text is one
array of lines in its row; rows are told apart by their place in the input's files, so of rows
equal in id and text one is first and the others lose what repeats; a null id sorts before all
ids; an empty table gives an empty result; all columns of the input are returned, and ``n_lines``
and ``n_removed`` only where the input has none of that name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mosslight.functions.lets import let
from mosslight.staging import placed, stage

#: Fixed value: what is trimmed off a line.
BLANKS = " \t\n\x0b\x0c\r"
WINDOW = 3


def _lines(text: Column) -> Column:
    """Position in the text and trimmed line, for lines with a word."""
    numbered = F.transform(F.split(text, "\n"), lambda x, i: F.struct(i.alias("at"), F.btrim(x, F.lit(BLANKS)).alias("line")))
    return F.filter(numbered, lambda x: x["line"] != "")


def windows(rows: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``place, at, h1, h2``: a row for each window of the ``placed`` rows; ``at`` numbers its first line among those with words."""

    def hashed(x: Column) -> Column:
        line = lambda i: F.get(x, i)["line"]
        window = lambda i: F.struct(i.cast("long").alias("at"), F.xxhash64(line(i), line(i + 1), line(i + 2)).alias("h1"), F.xxhash64(F.lit(WINDOW), line(i), line(i + 1), line(i + 2)).alias("h2"))
        return F.when(F.size(x) >= WINDOW, F.transform(F.sequence(F.lit(0), F.size(x) - WINDOW), window))

    text, id_ = F.col(f"row.`{text_col}`"), F.col(f"row.`{id_col}`")
    place = F.struct(id_.alias("id"), F.xxhash64(id_, text).alias("key"), "place_file", "place_row").alias("place")
    return rows.select(place, F.explode(let(_lines(text), hashed)).alias("w")).select("place", "w.*")


def covered_lines(found: DataFrame) -> DataFrame:
    """``place_file, place_row, covered``: the numbers of the lines that later occurrences of repeated windows cover.

    The aggregation combines before its shuffle, so a window that a third of all documents
    share costs one row for each task; the join back splits skewed windows.
    """
    where = F.struct("place", "at")
    repeated = found.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min(where).alias("first")).where("n > 1").drop("n")
    later = found.join(repeated, ["h1", "h2"]).where(where > F.col("first"))
    merged = F.array_distinct(F.flatten(F.transform(F.collect_set("at"), lambda a: F.sequence(a, a + (WINDOW - 1)))))
    return later.groupBy("place.place_file", "place.place_row").agg(merged.alias("covered"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with the covered lines taken out of ``text_col``, and ``n_lines`` and ``n_removed``.

    Only hashes are staged, and texts are shuffled once, by a join that sorts and can spill. That
    join is fixed: a broadcast that holds while few lines are covered would give way to a shuffle
    of all texts as the corpus grows.
    """
    rows = placed(docs)
    found = stage(windows(rows, id_col, text_col), "windows")
    covered = stage(covered_lines(found), "covered")

    text = F.col(f"row.`{text_col}`")
    joined = rows.join(covered.hint("merge"), ["place_file", "place_row"], "left")
    gone = let(_lines(text), lambda x: F.transform("covered", lambda k: F.get(x, k.cast("int"))["at"]))
    stay = lambda lines: F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone), lambda i: F.get(lines, i))
    rebuilt = F.when(F.col("covered").isNull(), text).otherwise(F.array_join(let(F.split(text, "\n"), stay), "\n"))
    n_lines = F.when(text.isNull(), F.lit(0)).otherwise(F.size(_lines(text))).cast("long")
    n_removed = F.when(F.col("covered").isNull(), F.lit(0)).otherwise(F.size("covered")).cast("long")
    out = joined.select("row", rebuilt.alias("rebuilt"), n_lines.alias("n_lines"), n_removed.alias("n_removed"))
    return out.select(*[F.col("rebuilt").alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns], *[c for c in ("n_lines", "n_removed") if c not in docs.columns])
