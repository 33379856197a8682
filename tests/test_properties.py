"""Invariants over generated inputs."""

from hypothesis import given, settings
from hypothesis import strategies as st

from mosslight import schema as S
from mosslight.functions import markdown as M
from mosslight.functions.porter import stem

lines = st.text(alphabet="ab #`~-\t", max_size=60)


@given(st.text(alphabet="ab \t", max_size=400), st.integers(1, 60), st.integers(0, 30))
def test_cut_lines_are_partitions(line, limit, window):
    parts = M.cut_line(line, limit, min(window, limit))
    assert "".join(parts) == line and all(0 < len(p) <= limit for p in parts[:-1]) and len(parts[-1]) <= limit


@given(st.text(alphabet="ab \n", max_size=900), st.integers(0, 600))
def test_overlaps_are_proper_suffixes_at_word_starts(text, budget):
    tail = M.overlap(text, budget)
    assert text.endswith(tail)
    if tail:
        assert S.MIN_OVERLAP_CHARS <= len(tail) <= budget and len(tail) < len(text)
        assert text[len(text) - len(tail) - 1].isspace() and not tail[0].isspace()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(lines, st.sampled_from(["# A", "## B", "### C", "```", "~~~", "x" * 300, "y " * 2500])), max_size=25))
def test_chunks_keep_every_word_and_the_ceiling(rows):
    text = "\n".join(rows)
    got = M.parse(text, "T")
    if not text.startswith("---"):
        assert set(text.split()) <= {w for c in got["chunks"] for w in c["body"].split()}
    assert all(c["body"].strip() and len(c["body"]) <= S.MAX_CHUNK_CHARS for c in got["chunks"])


@given(st.text(alphabet="abcdefghijklmnopqrstuvwxyzé", max_size=20))
def test_stems_are_no_longer_than_words(word):
    assert len(stem(word)) <= len(word) + 1
