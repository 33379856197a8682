"""Column expressions for identity, classification, links, snippets and dates."""

from __future__ import annotations

import fnmatch

from pyspark.sql import Column
from pyspark.sql import functions as F

from mosslight import schema as S
from mosslight.functions.lets import let

#: The patterns that links and decision numbers are read with.
DECISION_PATH = r"(?:^|/)decisions/(\d{4})-[^/]+\.(?i:md)$"
WORK_LOG = r"(^|/)tasks/"
FENCED = r"(?m)^[^\S\n]{0,3}(```|~~~)[^\n]*$(?s:.*?)(?:^[^\S\n]{0,3}\1[^\n]*$|\z)"
INLINE_CODE = r"(`+).*?\1"
WIKILINK = r"\[\[([^\]\[|#]+)(?:[|#][^\]\[]*)?\]\]"
MARKDOWN_LINK = r"\[[^\[\]]*\]\(([^)\s]+?\.md)(?:#[^)\s]*)?\)"
#: No group here repeats but possessively: the JVM matches other repeated groups by recursion, a frame each.
PATH_RUN = r"(?<![\w./\p{L}\p{N}-])([A-Za-z0-9._-][A-Za-z0-9._/-]*[\p{L}\p{N}]?)"
BARE_PATH = r"^([A-Za-z0-9._-][A-Za-z0-9._/-]*/[A-Za-z0-9._-]+\.md)(?![\w\p{L}\p{N}])"
#: The first letter is looked for before the word's edge, which is dear to find.
CITATION = r"(?iU)(?=[AD])\b(?:ADRs?|decisions?)\b\s*:?\s*(\d{4}\b(?:\s*(?:\([^()]*\))?\s*(?:,\s*and|,|and|/|&)\s*\d{4}\b)*+)"
URL_LIKE = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:|//)"
NULL_WORDS = ("", "null", "none", "~")
TOKEN = r"([\p{L}\p{N}\p{Co}]+)"


def chunk_ref(path: Column, heading_path: Column, ordinal: Column) -> Column:
    """``c`` and 16 hex digits of the SHA-256 of path, heading path and ordinal, separated by zero bytes."""
    zero = F.lit(bytearray(b"\x00"))
    raw = F.concat(F.encode(path, "UTF-8"), zero, F.encode(heading_path, "UTF-8"), zero, F.encode(ordinal.cast("string"), "UTF-8"))
    return F.concat(F.lit("c"), F.substring(F.sha2(raw, 256), 1, 16))


def fingerprint(content: Column) -> Column:
    """Size and SHA-256 of the raw bytes."""
    return F.concat(F.octet_length(content).cast("string"), F.lit(":"), F.sha2(content, 256))


def decode_lenient(content: Column) -> Column:
    """UTF-8 with replacement characters for malformed bytes."""
    return F.make_valid_utf8(content.cast("string"))


def classify(repo: Column, path: Column, knowledge: str | None) -> Column:
    """Document type from the path inside the repo; directory types hold in the knowledge repo only."""
    inside = F.when(F.startswith(path, F.concat(repo, F.lit("/"))), F.substr(path, F.length(repo) + 2)).otherwise(path)
    name = F.element_at(F.split(inside, "/"), -1)
    kinds = [("decisions/", "decision"), ("context/", "context"), ("architecture/", "architecture"), ("gaps/", "gap")]
    out = F.when(name == "SKILL.md", "skill")
    for prefix, kind in kinds if knowledge is not None else []:
        out = out.when((repo == knowledge) & inside.startswith(prefix), kind)
    for file, kind in (("AGENTS.md", "agents"), ("CLAUDE.md", "claude"), ("README.md", "readme")):
        out = out.when(name == file, kind)
    return out.when(inside.rlike(WORK_LOG), "task").otherwise("doc")


def is_work_log(path: Column) -> Column:
    return path.rlike(WORK_LOG)


def decision_number(path: Column) -> Column:
    """The four digits of a decision record's file name, or null."""
    return F.nullif(F.regexp_extract(path, DECISION_PATH, 1), F.lit(""))


def excluded(path: Column, patterns: list[str]) -> Column:
    """Whether a pattern without a slash matches a path segment, or one with a slash the whole path."""
    out = F.lit(False)
    for p in patterns:
        regex = "(?s)^" + fnmatch.translate(p).removeprefix("(?s:").removesuffix(r")\Z").removesuffix(r")\z") + "$"
        out = out | (path.rlike(regex) if "/" in p else F.exists(F.split(path, "/"), _matches(regex)))
    return out


def _matches(regex: str):  # noqa: ANN202
    return lambda x: x.rlike(regex)


def clean_scalar(value: Column) -> Column:
    """Trimmed, with words that stand for nothing as null."""
    trimmed = F.trim(value)
    return F.when(~F.lower(trimmed).isin(*NULL_WORDS), trimmed)


def snippet(body: Column, chars: int = S.SNIPPET_CHARS) -> Column:
    """White space collapsed; a longer text is cut, with an ellipsis for its last character."""
    flat = F.trim(F.regexp_replace(body, r"\s+", " "))
    return F.when(F.length(flat) <= chars, flat).otherwise(F.concat(F.rtrim(F.substring(flat, 1, chars - 1)), F.lit("…")))


def citation(path: Column, heading_path: Column) -> Column:
    return F.concat(path, F.lit("#"), heading_path)


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits, diacritics kept."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(1))


def folded_tokens(text: Column) -> Column:
    """Tokens as an index with removed diacritics has them: decomposed Latin letters lose their marks."""
    plain = F.translate(F.lower(text), _ACCENTED, _PLAIN)
    return F.regexp_extract_all(F.regexp_replace(plain, r"\p{M}", ""), F.lit(TOKEN), F.lit(1))


def fold_table() -> tuple[str, str]:
    import unicodedata

    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))) for c in range(0xC0, 0x250)]
    kept = [(c, d[0]) for c, d in pairs if len(d) > 1 and all(unicodedata.combining(x) for x in d[1:]) and c == c.lower()]
    return "".join(c for c, _ in kept), "".join(d for _, d in kept)


_ACCENTED, _PLAIN = fold_table()


def strip_code(text: Column) -> Column:
    """Fenced blocks emptied and inline code spans blanked."""
    lines = F.split(F.regexp_replace(text, FENCED, ""), "\n")  # a span stays within its line
    return F.array_join(F.transform(lines, lambda x: F.when(F.contains(x, F.lit("`")), F.regexp_replace(x, INLINE_CODE, " ")).otherwise(x)), "\n")


def wikilinks(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(WIKILINK), F.lit(1)), lambda x: F.trim(x))


def markdown_links(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(MARKDOWN_LINK), F.lit(1))


def bare_paths(text: Column) -> Column:
    """Of each run of path characters, the longest beginning that is a path of a Markdown file in a folder, without empty steps."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.contains(x, F.lit(".md")))  # no run goes beyond its line
    runs = F.filter(F.regexp_extract_all(F.array_join(lines, "\n"), F.lit(PATH_RUN), F.lit(1)), lambda r: F.contains(r, F.lit(".md")))
    return F.filter(F.transform(runs, lambda r: F.regexp_extract(F.substring_index(r, "//", 1), BARE_PATH, 1)), lambda x: x != "")


def citations(text: Column) -> Column:
    """Four-digit numbers that prose cites as decisions, lists with annotations included."""
    runs = F.regexp_extract_all(text, F.lit(CITATION), F.lit(1))
    return F.flatten(F.transform(runs, lambda r: F.regexp_extract_all(r, F.lit(r"(\d{4})"), F.lit(1))))


def clean_targets(targets: Column) -> Column:
    return F.filter(F.transform(targets, lambda x: F.trim(x)), lambda x: (x != "") & ~x.rlike(URL_LIKE))


def body_links(text: Column) -> Column:
    """Distinct targets of a text: wikilinks, Markdown links, bare paths, cited numbers, each in order of appearance."""
    return let(strip_code(text), lambda t: F.array_distinct(F.concat(clean_targets(F.concat(wikilinks(t), markdown_links(t), bare_paths(t))), citations(t))))


def normalize_target(target: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(F.trim(target), r"^(\./)+", ""), "^/+", ""))


def resolve_relative(source: Column, target: Column) -> Column:
    """The path that a ``./`` or ``../`` target names, or null for other targets and for escapes."""
    folder = F.regexp_replace(source, "/?[^/]*$", "")
    steps = F.filter(F.split(F.concat_ws("/", folder, target), "/"), lambda x: ~x.isin("", "."))
    start = F.struct(F.array().cast("array<string>").alias("p"), F.lit(False).alias("bad"))

    def step(acc: Column, x: Column) -> Column:
        up = x == ".."
        return F.struct(
            F.when(up, F.slice(acc["p"], F.lit(1), F.greatest(F.size(acc["p"]) - 1, F.lit(0)))).otherwise(F.array_append(acc["p"], x)).alias("p"),
            (acc["bad"] | (up & (F.size(acc["p"]) == 0))).alias("bad"),
        )

    walked = F.aggregate(steps, start, step, lambda a: F.when(~a["bad"], F.array_join(a["p"], "/")))
    return F.when(target.rlike(r"^\.\.?/"), walked)


def resolution_keys(repo: Column, path: Column, title: Column) -> Column:
    """Lower-case keys that a document can be addressed by."""
    name = F.element_at(F.split(path, "/"), -1)
    inside = F.when(F.startswith(path, F.concat(repo, F.lit("/"))), F.substr(path, F.length(repo) + 2))
    stem = F.when(name.endswith(".md"), F.substr(name, F.lit(1), F.length(name) - 3))
    keys = F.transform(F.array(path, inside, name, stem, title), lambda k: F.lower(F.trim(k)))
    return F.array_distinct(F.filter(keys, lambda k: k.isNotNull() & (k != "")))


def reference_date(decided_on: Column, mtime: Column) -> Column:
    """The decided date if its first ten characters parse, else the UTC date of the modification time."""
    head = F.substring(decided_on, 1, 10)
    parsed = F.coalesce(
        F.when(head.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(head, "yyyy-MM-dd")),
        F.when(head.rlike(r"^\d{8}$"), F.try_to_date(head, "yyyyMMdd")),
    )
    return F.coalesce(parsed, F.date_add(F.lit("1970-01-01").cast("date"), F.floor(mtime / 86400).cast("int")))


def recency(decided_on: Column, mtime: Column, as_of: Column, half_life: float = S.HALF_LIFE_DAYS) -> Column:
    """Halves with every half-life of age; the future counts as today."""
    age = F.greatest(F.lit(0), F.datediff(as_of, reference_date(decided_on, mtime)))
    return F.pow(F.lit(2.0), -age / F.lit(half_life))


def query_terms(text: Column) -> Column:
    """A query's terms as they are looked up: every run of letters and digits, repeats kept."""
    return tokens(text)


def approx_tokens(text: Column) -> Column:
    return F.ceil(F.length(text) / 4)
