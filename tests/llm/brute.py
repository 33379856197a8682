"""Plain-Python versions of the operators, written from their contracts."""

import math
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rule_row(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    count = Counter(windows)
    covered = {j for i, x in enumerate(windows) if count[x] > 1 for j in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def dedup_lines(docs):
    """Texts of (id, text) rows after the removal of later occurrences of three-line windows."""
    seen, gone = {}, defaultdict(set)
    filled = []
    for i, text in docs:
        lines = [] if text is None else [(at, x.strip(" \t\n\x0b\x0c\r")) for at, x in enumerate(text.split("\n"))]
        filled.append([(at, x) for at, x in lines if x])
    order = sorted(range(len(docs)), key=lambda r: (docs[r][0] is not None, docs[r][0] or 0, r))
    for r in order:
        for k in range(len(filled[r]) - 2):
            win = tuple(x for _, x in filled[r][k : k + 3])
            if win in seen:
                gone[r] |= {filled[r][j][0] for j in range(k, k + 3)}
            seen.setdefault(win, (r, k))
    return [None if t is None else "\n".join(x for at, x in enumerate(t.split("\n")) if at not in gone[r]) for r, (_, t) in enumerate(docs)]


def targets(sizes_by_source):
    """Target words of each source."""
    order = sorted((s for s in sizes_by_source if s is not None)) + [s for s in sizes_by_source if s is None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    size = {s: sum(v) for s, v in sizes_by_source.items()}
    total, capped = 1.5 * sum(size.values()), set()
    while True:
        left = total - sum(2 * size[s] for s in capped)
        open_weight = sum(weight[s] for s in order if s not in capped)
        out = {s: 2.0 * size[s] if s in capped else left * weight[s] / open_weight for s in order}
        over = {s for s in order if s not in capped and out[s] > 2 * size[s]}
        if not over:
            return out
        capped |= over


def near(x, y):
    return math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9)
