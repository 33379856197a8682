"""Numbers of decision records."""

from __future__ import annotations

import fcntl
import re
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SLUG = re.compile(r"[a-z0-9]+(?:-[a-z0-9]+)*")
LAST_NUMBER = 9999
#: The file that claims are listed in, its lines, and what a plain item of a list looks like.
INDEX = "INDEX.md"
_CLAIM = re.compile(r"-\s+(\d{4})\s+(\S+)")
_RECORD = re.compile(r"(\d{4})-(.+)\.md")
_ITEM = re.compile(r"[A-Za-z0-9][A-Za-z0-9._-]*")


class AllocationError(ValueError):
    """No number can be given."""


def next_number(*sources: DataFrame) -> DataFrame:
    """One row: the number after the largest ``number`` of all sources, four digits wide."""
    union = sources[0].select("number")
    for s in sources[1:]:
        union = union.unionByName(s.select("number"))
    following = F.coalesce(F.max(F.col("number").cast("int")), F.lit(0)) + 1
    return union.agg(following.alias("n")).select(F.format_string("%04d", "n").alias("number"))


def allocate(slug: str, existing: DataFrame, *sources: DataFrame) -> str:
    """A number for ``slug``; ``existing`` has the ``slug`` of records that are there."""
    if not _SLUG.fullmatch(slug):
        raise AllocationError(f"{slug!r} is not a slug of lower-case words and hyphens")
    if not existing.where(F.col("slug") == slug).isEmpty():
        raise AllocationError(f"a record with the slug {slug!r} exists")
    number = next_number(*sources).first()[0]
    if len(number) > 4 or int(number) > LAST_NUMBER:
        raise AllocationError("all four-digit numbers are taken")
    return number


def _claims(index: Path) -> list[str]:
    return [m[1] for line in index.read_text(encoding="utf-8").splitlines() if (m := _CLAIM.match(line))]


def create(folder: str | Path, slug: str, title: str, today: str, repos: tuple[str, ...] = (), tags: tuple[str, ...] = (), taken: tuple[int, ...] = ()) -> Path:
    """A new record in ``folder`` under the next number, and its claim at the end of the index; or nothing, with an error.

    Numbers of files, of claims and ``taken`` ones (of other copies of the folder) count. Runs on
    one machine wait for each other; a claim that is there twice all the same, by a merge, say,
    takes the record back.
    """
    folder, index = Path(folder), Path(folder, INDEX)
    if not _SLUG.fullmatch(slug):
        raise AllocationError(f"{slug!r} is not a slug of lower-case words and hyphens")
    if odd := [x for x in (*repos, *tags) if not _ITEM.fullmatch(x)]:
        raise AllocationError(f"{odd} can't stand in a list as they are")
    if not index.is_file():
        raise AllocationError(f"{index} is missing, so the claim would conflict with none")
    with index.open("r+b") as f:
        fcntl.flock(f, fcntl.LOCK_EX)
        claimed, records = _claims(index), [m for p in folder.iterdir() if (m := _RECORD.fullmatch(p.name))]
        for m in records:
            if m[2] == slug:
                raise AllocationError(f"{m[0]} exists" + ("" if m[1] in claimed else f" but isn't in {INDEX}, as after an interrupted run; add its line there"))
        number = 1 + max((0, *taken, *map(int, claimed), *(int(m[1]) for m in records)))
        if number > LAST_NUMBER:
            raise AllocationError("all four-digit numbers are taken")
        record = folder / f"{number:04d}-{slug}.md"
        head = {"name": slug, "decided_on": today, "superseded_by": "null", "repos": f"[{', '.join(repos)}]", "tags": f"[{', '.join(tags)}]"}
        lines = ["---", *(f"{k}: {v}" for k, v in head.items()), "---", "", f"# {number:04d}: {title}", "", *(f"## {x}\n" for x in ("Decision", "Why", "Consequences"))]
        with record.open("x", encoding="utf-8") as out:
            out.write("\n".join(lines))
        try:
            before = f.read()
            f.write((b"" if before.endswith(b"\n") or not before else b"\n") + f"- {number:04d}  {slug}\n".encode())
            f.flush()
            if _claims(index).count(f"{number:04d}") > 1:
                raise AllocationError(f"{number:04d} is claimed twice in {INDEX}")
        except BaseException:
            record.unlink(missing_ok=True)
            raise
    return record
