"""License scans with a positional index over rare licence words, in native expressions only.

One pass over the texts finds the exact base phrases and every occurrence of a licence word
with its position. The document frequencies of those words over the whole corpus give their
IDF. Each template is looked up by its mandatory key word of the highest IDF, wherever that
stands; hits that agree on where the template starts are intersected, and a template counts
once its mandatory key words stand at their places relative to that start. Since the word that
is looked up is itself mandatory, no template that could be verified is missed, whatever other
licence words the file holds.

Key words are chosen so that a notice of a longer name isn't taken for a shorter one: ``gnu``
must stand right before ``general`` for the GPL, so Affero and Lesser notices aren't its.

Edge cases: a null or empty text has no words and no labels; a very long text is scanned whole,
its words as one array of the row; templates that start at the same place are verified each for
itself, and of several hits the best share counts; repeated rows are scanned each by itself; an
empty table gives an empty result; columns other than id and text are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mosslight.functions.lets import let
from mosslight.staging import stage

#: Upper and lower case, and what separates words.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Base phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


@dataclass(frozen=True)
class Template:
    """A licence notice or a passage of a licence's body. ``key`` words are mandatory; ``?`` stands for a word that isn't looked at."""

    label: str
    words: str
    key: tuple[str, ...]


#: Notices in common use, then passages of licence bodies. Frequent words of the language are left out as ``?``.
TEMPLATES = (
    Template("mit", "released ? ? mit license", ("mit", "license")),
    Template("mit", "licensed ? ? mit license", ("mit", "license")),
    Template("apache-2.0", "licensed ? ? apache license version 2 0", ("apache", "license")),
    Template("gpl-3.0", "licensed ? ? gnu general public license version 3", ("gnu", "general", "public", "license", "3")),
    Template("gpl-2.0", "licensed ? ? gnu general public license version 2", ("gnu", "general", "public", "license", "2")),
    Template("lgpl", "licensed ? ? gnu lesser general public license version 3", ("lesser", "general", "public", "license")),
    Template("agpl", "licensed ? ? gnu affero general public license version 3", ("affero", "general", "public", "license")),
    Template("cc-by-nc", "licensed ? cc ? nc 4 0", ("cc", "nc")),
    Template("cc-by-sa", "licensed ? cc ? sa 4 0", ("cc", "sa")),
    Template("cc-by-4.0", "licensed ? cc ? 4 0", ("cc", "4", "0")),
    Template("cc0", "cc0 1 0 universal public domain dedication", ("cc0",)),
    Template("bsd", "redistribution ? use ? source ? binary forms", ("redistribution", "binary", "forms")),
    Template("mpl-2.0", "subject ? ? terms ? ? mozilla public license", ("mozilla", "public", "license")),
    Template("isc", "licensed ? ? isc license", ("isc", "license")),
    Template("copyright", "copyright ? ? ? ? rights reserved", ("copyright", "rights", "reserved")),
    Template("mit", "permission ? hereby granted free ? charge ? any person obtaining ? copy ? ? software ? associated documentation files", ("hereby", "granted", "obtaining", "software", "documentation")),
    Template("isc", "permission ? use copy modify ? ? distribute ? software ? any purpose ? ? without fee ? hereby granted", ("modify", "distribute", "purpose", "fee", "hereby")),
    Template("bsd", "redistributions ? source code must retain ? above copyright notice ? list ? conditions ? ? following disclaimer", ("redistributions", "source", "retain", "conditions", "disclaimer")),
    Template("apache-2.0", "unless required ? applicable law ? agreed ? ? writing software distributed under ? license ? distributed ? ? as ? basis", ("applicable", "writing", "distributed", "license", "basis")),
    Template("gpl-3.0", "terms ? ? gnu general public license as published ? ? free software foundation either version 3", ("gnu", "general", "published", "foundation", "3")),
    Template("gpl-2.0", "terms ? ? gnu general public license as published ? ? free software foundation either version 2", ("gnu", "general", "published", "foundation", "2")),
    Template("lgpl", "terms ? ? gnu lesser general public license as published ? ? free software foundation", ("gnu", "lesser", "published", "foundation")),
    Template("agpl", "terms ? ? gnu affero general public license as published ? ? free software foundation", ("gnu", "affero", "published", "foundation")),
    Template("unlicense", "free ? unencumbered software released ? ? public domain", ("unencumbered", "public", "domain")),
)

#: The share of a template's words that must be in place.
SHARE = 0.6


def template(label: str, text: str, rank: Mapping[str, int], keys: int = 5, most_common: int | None = None) -> Template:
    """A template from a licence's own text, however long.

    Its ``keys`` rarest distinct words by ``rank`` (0 is the rarest; an unknown word is rarer) are mandatory. Words of a
    rank over ``most_common`` aren't looked at.
    """
    words = [w for w in re.split(SEPARATOR, "".join(c.lower() if c.isascii() else c for c in text)) if w]
    shown = [w if most_common is None or rank.get(w, -1) <= most_common else "?" for w in words]
    rarest = sorted({w for w in shown if w != "?"}, key=lambda w: (rank.get(w, -1), w))[:keys]
    return Template(label, " ".join(shown), tuple(rarest))


def postings(templates: tuple[Template, ...] = TEMPLATES) -> list[tuple[str, int, int, bool]]:
    """(word, template number, offset, is mandatory) for every word of every template; of a key word that recurs the first place is mandatory."""
    out = []
    for t, x in enumerate(templates):
        left = set(x.key)
        for o, w in enumerate(x.words.split()):
            if w != "?":
                out.append((w, t, o, w in left))
                left.discard(w)
    return out


def scan_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """``id_col, n_words, places`` (start and label of base phrases) and ``found`` (position and licence word)."""
    vocabulary = sorted({p[0] for p in postings(templates)} | {"cc", "general", "rights"})
    text = F.translate(F.coalesce(F.col(text_col), F.lit("")), UPPER, LOWER)
    spaced = F.btrim(F.regexp_replace(text, SEPARATOR, " "))

    def scan(w: Column) -> Column:
        at = F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda i: F.get(w, i).isin(vocabulary))

        def phrases(found: Column) -> Column:
            is_ = lambda i, word: F.coalesce(F.get(w, i) == word, F.lit(False))
            near = lambda i: F.when(is_(i, "cc") & is_(i + 1, "by"), F.struct(i.alias("at"), F.lit("cc-by").alias("label"))).when(is_(i, "general") & is_(i + 1, "public") & is_(i + 2, "license"), F.struct(i.alias("at"), F.lit("gpl").alias("label"))).when((i > 0) & is_(i, "rights") & F.when(i > 0, is_(i - 1, "all")).otherwise(False) & is_(i + 1, "reserved"), F.struct((i - 1).alias("at"), F.lit("reserved").alias("label")))
            return F.struct(
                F.size(w).alias("n"),
                F.filter(F.transform(found, near), lambda x: x.isNotNull()).alias("places"),
                F.transform(found, lambda i: F.struct(i.alias("at"), F.get(w, i).alias("word"))).alias("found"),
            )

        return let(at, phrases)

    return (
        docs.select(F.col(id_col), spaced.alias("spaced"))
        .select(id_col, F.when(F.col("spaced") != "", let(F.split("spaced", " "), scan)).alias("s"))
        .select(id_col, F.coalesce(F.col("s.n"), F.lit(0)).cast("long").alias("n_words"), "s.places", "s.found")
    )


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """``id_col, n_words, n_base, first_word, last_word, base_labels, labels, score``, a row for each row of ``docs``.

    ``score`` is the largest share of a verified template's words that stand in place, and
    0.5 at least where a base phrase stands. The frequencies that the driver gets are a row
    for each word of the templates, however large the corpus.
    """
    words = stage(scan_words(docs, id_col, text_col, templates).withColumn("row_id", F.monotonically_increasing_id()), "words")
    table = postings(templates)
    frequency = words.where(F.size("found") > 0).select(F.explode(F.array_distinct(F.transform("found", lambda x: x["word"]))).alias("word")).groupBy("word").count()
    rank = {w: i for i, (w, _) in enumerate(sorted(((r["word"], r["count"]) for r in frequency.collect()), key=lambda x: (x[1], x[0])))}
    hits = template_hits(words, table, rank, templates)
    joined = words.join(hits, "row_id", "left")
    base = F.array_sort(F.array_distinct(F.transform("places", lambda x: x["label"])))
    places = F.transform("places", lambda x: x["at"].cast("long"))
    none = F.array().cast("array<string>")
    return joined.select(
        id_col,
        "n_words",
        F.when(F.col("places").isNull(), F.lit(0)).otherwise(F.size("places")).cast("long").alias("n_base"),
        F.array_min(places).alias("first_word"),
        F.array_max(places).alias("last_word"),
        F.coalesce(F.array_join(base, ","), F.lit("")).alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(F.coalesce(base, none), F.coalesce(F.col("method_labels"), none)))), ",").alias("labels"),
        F.greatest(F.coalesce(F.col("share"), F.lit(0.0)), F.when(F.size("places") > 0, F.lit(0.5)).otherwise(F.lit(0.0))).alias("score"),
    )


def template_hits(words: DataFrame, table: list[tuple[str, int, int, bool]], rank: dict[str, int], templates: tuple[Template, ...]) -> DataFrame:
    """``row_id, method_labels, share`` of the rows in which a template is verified.

    Only rows with licence words take part. Their positions are joined with the postings, which
    are a constant of some hundred entries; only starts at which the template's rarest key word
    stands (any word, for a template without key words) go on, and are grouped by row, template
    and start: groups are as small as a template.
    """
    spark = words.sparkSession
    size = {t: sum(p[1] == t for p in table) for t in range(len(templates))}
    keys = {t: sum(p[1] == t and p[3] for p in table) for t in range(len(templates))}
    rarest = {t: min(((rank.get(w, -1), o) for w, u, o, k in table if u == t and k), default=None) for t in range(len(templates))}
    entries = [(w, t, o, k, size[t], keys[t], templates[t].label, rarest[t] is None or rarest[t][1] == o) for w, t, o, k in table]
    index = F.broadcast(spark.createDataFrame(entries, "word string, template int, offset int, is_key boolean, size int, keys int, label string, is_rarest boolean"))
    at = words.where(F.size("found") > 0).select("row_id", F.explode("found").alias("x")).select("row_id", F.col("x.at").alias("at"), F.col("x.word").alias("word"))
    looked = at.join(index, "word").withColumn("start", F.col("at") - F.col("offset"))
    starts = looked.where("is_rarest").select("row_id", "template", "start")
    met = (
        looked.join(starts, ["row_id", "template", "start"], "left_semi")
        .groupBy("row_id", "template", "start", "size", "keys", "label")
        .agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("is_key"), 1)).alias("n_keys"))
    )
    share = F.col("n") / F.col("size")
    verified = met.where((F.col("n_keys") == F.col("keys")) & (share >= SHARE))
    return verified.groupBy("row_id").agg(F.collect_set("label").alias("method_labels"), F.max(share).alias("share"))
