"""The Porter stemmer, over the distinct vocabulary.

An index stems each distinct token once and joins the stems back, so the per-word work in
Python follows the vocabulary and not the corpus. Tokens over 64 bytes are left alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Suffix rules of the published algorithm, tried in this order; the longest that fits decides.
STEP_2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "logi": "log", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _shape(stem: str) -> str:
    """Consonants as c, vowels as v; y is a vowel after a consonant."""
    out = ""
    for ch in stem:
        out += "v" if ch in "aeiou" or ch == "y" and out.endswith("c") else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _shape(stem)))


def _short(stem: str) -> bool:
    """Consonant, vowel, consonant at the end, the last not w, x or y."""
    return _shape(stem).endswith("cvc") and stem[-1] not in "wxy"


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _longest(word: str, suffixes) -> str | None:  # noqa: ANN001
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


def stem(word: str) -> str:
    if len(word) < 3 or len(word.encode()) > 64:
        return word
    if word.endswith(("sses", "ies")):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        if _measure(word[:-3]) > 0:
            word = word[:-1]
    elif (cut := _longest(word, ("ed", "ing"))) and "v" in _shape(word[: -len(cut)]):
        word = word[: -len(cut)]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif _double(word) and word[-1] not in "lsz":
            word = word[:-1]
        elif _measure(word) == 1 and _short(word):
            word += "e"
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    for rules in (STEP_2, STEP_3):
        if (cut := _longest(word, rules)) and _measure(word[: -len(cut)]) > 0:
            word = word[: -len(cut)] + rules[cut]
    if (cut := _longest(word, STEP_4)) and _measure(word[: -len(cut)]) > 1 and (cut != "ion" or word[: -len(cut)].endswith(("s", "t"))):
        word = word[: -len(cut)]
    if word.endswith("e"):
        rest = word[:-1]
        if _measure(rest) > 1 or _measure(rest) == 1 and not _short(rest):
            word = rest
    if _measure(word) > 1 and _double(word) and word.endswith("l"):
        word = word[:-1]
    return word


def stems(vocabulary: DataFrame) -> DataFrame:
    """``term, stem`` for the distinct ``term`` of ``vocabulary``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = b.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([stem(w) for w in words], pa.string())], names=["term", "stem"])

    return vocabulary.select("term").mapInArrow(run, "term string, stem string")
