"""Token ids of whole texts with a bounded cache of words.

The vocabulary's tokenizer first splits a text into words, digits and runs of marks, and
encodes each of these by itself. Most of them recur; a cache of their ids is several times
as fast as encoding every text anew. That split is repeated here for texts of ASCII and
Latin-1 letters, which normalisation leaves alone; any other text is encoded whole, and so
is a text that holds a special token literally, where the tokenizer gives that its own id.
A tokenizer that splits or normalises in any other way encodes all texts whole.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

import numpy as np

#: The tokenizer's split, written for lower-case text of the characters below.
_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-z0-9ß-öø-ÿ]+")
#: How a tokenizer file states that split, its normalisation and its word ends.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_NORMALISERS = [("NFC", None, None), ("Replace", r"\s+", " "), ("Lowercase", None, None)]
#: Latin-1 bytes of the characters that are split here.
_PLAIN = bytes([9, 10, 13, *range(0x20, 0x7F), *range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100)])
_CALL = 1000


def _splits_as_here(spec: dict) -> bool:
    """Whether a tokenizer file states the split, normalisation and word ends that ``_PARTS`` repeats."""
    parts = lambda x, name: x.get(name, []) if x and x.get("type") == "Sequence" else []
    regex = lambda x: (x.get("pattern") or {}).get("Regex")
    normalisers = [(x["type"], regex(x), x.get("content")) for x in parts(spec.get("normalizer"), "normalizers")]
    split, *rest = parts(spec.get("pre_tokenizer"), "pretokenizers") or [{}]
    plain = [x for x in rest if x.get("type") != "ByteLevel" or x.get("add_prefix_space") or x.get("use_regex")]
    alone = split.get("type") == "Split" and regex(split) == _SPLIT and split.get("behavior") == "Removed" and split.get("invert") is True
    return alone and not plain and len(rest) == 1 and normalisers == _NORMALISERS and (spec.get("model") or {}).get("end_of_word_suffix") == "</w>" and not spec.get("post_processor")


class WordTokens:
    """``encode`` gives the ids of each text as little-endian unsigned 32-bit integers.

    ``special_as_text`` encodes special tokens in texts like any other characters; without
    it the ids are those of the tokenizer as loaded.
    """

    def __init__(self, path: str, cache_words: int = 800_000, special_as_text: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            self._by_words = _splits_as_here(json.load(f))
        self._tokenizer.encode_special_tokens = special_as_text
        self._special = () if special_as_text else tuple(t.content for t in self._tokenizer.get_added_tokens_decoder().values())
        self._limit, self._cache = cache_words, {}
        vocab = self._tokenizer.get_vocab()
        self._ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self._ends[[i for w, i in vocab.items() if w.endswith("</w>")]] = True

    def _learn(self, parts: list[str]) -> None:
        """Encode new parts, many in a call; each ends with the one piece that ends a word."""
        calls = [parts[a : a + _CALL] for a in range(0, len(parts), _CALL)]
        for call, found in zip(calls, self._tokenizer.encode_batch_fast([" ".join(c) for c in calls], add_special_tokens=False), strict=True):
            ids = np.array(found.ids, dtype="<u4")
            cuts = (4 * (np.flatnonzero(self._ends[ids]) + 1)).tolist()
            raw, a = ids.tobytes(), 0
            for part, b in zip(call, cuts, strict=True):
                self._cache[part], a = raw[a:b], b

    def _split(self, text: str) -> list[str] | None:
        """The parts that are encoded each by itself; None for a text that must be encoded whole."""
        try:
            other = not self._by_words or text.encode("latin-1").translate(None, _PLAIN)
        except UnicodeEncodeError:
            return None
        return None if other or any(s in text for s in self._special) else _PARTS.findall(text.lower())

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text; a batch should be some hundred texts, as its new words are learned together."""
        split = [self._split(t) for t in texts]
        get = self._cache.get
        found = [None if x is None else list(map(get, x)) for x in split]
        missing = [i for i, x in enumerate(found) if x is not None and None in x]
        if missing:
            fresh = {part for i in missing for part, ids in zip(split[i], found[i], strict=True) if ids is None}
            if len(self._cache) + len(fresh) > self._limit:
                self._cache.clear()
                fresh = set().union(*(split[i] for i in missing))
            self._learn(sorted(fresh))
            for i in missing:
                found[i] = map(get, split[i])
        return [self._whole(t) if x is None else b"".join(x) for t, x in zip(texts, found, strict=True)]

    def _whole(self, text: str) -> bytes:
        return np.array(self._tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


@lru_cache(maxsize=2)
def word_tokens(path: str) -> WordTokens:
    """The process's own instance, so that a worker's tasks share what it has learned."""
    return WordTokens(path, special_as_text=False)
