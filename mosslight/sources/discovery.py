"""Which Markdown files make up a corpus, and a table of them.

Folders are listed on the driver, as a registry and symbolic links to folders are judged while
walking; files are looked at and read by tasks, each under a guard of its own, so one that
can't be read is a row that says so.
"""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mosslight import schema as S
from mosslight.functions.text import excluded
from mosslight.settings import Settings

#: Folders that are never entered, folders of prose, files at a repository's root, registry names.
SKIPPED = (".worktrees", "worktrees", "node_modules", ".git", "var", ".venv", ".pytest_cache", ".ruff_cache", ".mypy_cache", "__pycache__", "dist", "build")
PROSE = ("docs", "decisions", "specs")
ROOT_FILES = ("AGENTS.md", "CLAUDE.md", "README.md", "GOVERNANCE.md")
REGISTRIES = (".corpus-repos.tsv",)
#: Bytes of contents in one batch.
READ_BYTES = 32 << 20
WORKSPACE, SKILLS = "workspace", ".claude"


class RegistryMissing(ValueError):
    """There is no registry of repositories."""


class RegistryInvalid(ValueError):
    """A registry row names something outside of the workspace."""


class RootsCollide(ValueError):
    """Two roots have the same name."""


class RootsUnusable(ValueError):
    """None of the roots is a folder."""


def read_registry(workspace: str | Path, names: tuple[str, ...] | None = None) -> list[str]:
    """First column of the first registry that exists; blank lines skipped, repeats kept.

    A name from the settings takes the place of the usual ones; nothing else is looked for then.
    """
    own = Settings.from_env().registry
    names = names or ((own,) if own else REGISTRIES)
    found = next((p for n in names if (p := Path(workspace, n)).is_file()), None)
    if found is None:
        raise RegistryMissing(f"no registry ({' or '.join(names)}) in {workspace}")
    repos = [r for line in found.read_text(encoding="utf-8").splitlines() if (r := line.strip().split("\t")[0].strip())]
    for r in repos:
        if "/" in r or "\\" in r or ".." in r or os.path.isabs(r):
            raise RegistryInvalid(f"{r!r} in {found.name} isn't the name of a folder in the workspace")
    return repos


def walk(base: Path) -> Iterator[Path]:
    """Markdown files below ``base``; links to folders aren't followed."""
    for folder, inner, files in os.walk(base):
        inner[:] = [d for d in inner if d not in SKIPPED]
        yield from (Path(folder, f) for f in files if f.endswith(".md"))


def in_scope(inside: Column, deep: bool) -> Column:
    """Whether a path inside a repository belongs to its prose: root files, prose folders, and files right in ``tasks``."""
    parts = F.split(inside, "/")
    parents = F.slice(parts, F.lit(1), F.size(parts) - 1)
    prose = F.array(*map(F.lit, PROSE))
    here = F.arrays_overlap(parents, prose) if deep else F.coalesce(F.get(parents, F.lit(0)).isin(*PROSE), F.lit(False))
    skipped = F.arrays_overlap(parents, F.array(*map(F.lit, SKIPPED)))
    return inside.endswith(".md") & (inside.isin(*ROOT_FILES) | (here & ~skipped) | inside.rlike(r"^tasks/[^/]+$"))


def _listed(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, "repo string, root string, inside string, path string, abs_path string, whole boolean, deep boolean")


def _selected(listed: DataFrame, excludes: list[str]) -> DataFrame:
    """``repo, path, abs_path`` in path order; of several claims on a file the last counts."""
    rows = listed.where((F.col("whole") | in_scope(F.col("inside"), True) & F.col("deep") | in_scope(F.col("inside"), False) & ~F.col("deep")) & ~excluded(F.col("path"), excludes))
    last = rows.groupBy("abs_path").agg(F.max_by(F.struct("repo", "path"), F.col("claim")).alias("x"))
    return last.select("x.repo", "x.path", "abs_path").orderBy("path")


def discover_registry(spark: SparkSession, workspace: str, knowledge: str | None = None, excludes: list[str] | None = None) -> DataFrame:
    """The workspace's own files, every registered repository, the whole knowledge repository, and skills."""
    top, rows = Path(workspace), []

    def claim(base: Path, repo: str, whole: bool, deep: bool, files: Iterator[Path]) -> None:
        for f in files:
            rows.append((repo, str(base), f.relative_to(base).as_posix(), f.relative_to(top).as_posix(), str(f), whole, deep))

    registered = read_registry(top)
    shallow = [f for n in ROOT_FILES if (f := top / n).is_file()] + [f for d in (*PROSE, "tasks") for f in walk(top / d)]
    claim(top, WORKSPACE, False, False, iter(shallow))
    for repo in registered:
        if (top / repo).is_dir() and repo not in SKIPPED:
            claim(top / repo, repo, repo == knowledge, True, walk(top / repo))
    claim(top, SKILLS, True, False, (f for f in sorted(top.glob(".claude/skills/*/SKILL.md")) if f.is_file()))
    listed = _listed(spark, rows).coalesce(1).withColumn("claim", F.monotonically_increasing_id())
    return _selected(listed, excludes or [])


def discover_roots(spark: SparkSession, roots: list[str], knowledge: str | None = None, excludes: list[str] | None = None) -> DataFrame:
    """Each root as a repository named for its folder; missing roots are passed over."""
    real = [r for x in roots if (r := Path(x).resolve()).is_dir()]
    if not real:
        raise RootsUnusable(f"none of {roots} is a folder")
    by_name: dict[str, Path] = {}
    for r in real:
        if by_name.setdefault(r.name, r) != r:
            raise RootsCollide(f"{by_name[r.name]} and {r} would both be cited as {r.name!r}")
    rows = [(n, str(r), f.relative_to(r).as_posix(), f"{n}/{f.relative_to(r).as_posix()}", str(f), n == knowledge, True) for n, r in by_name.items() for f in walk(r)]
    return _selected(_listed(spark, rows).coalesce(1).withColumn("claim", F.monotonically_increasing_id()), excludes or [])


def discover(spark: SparkSession, workspace: str | None = None, roots: list[str] | None = None, knowledge: str | None = None, excludes: list[str] | None = None) -> DataFrame:
    """Explicit roots take the place of the registry; they are never added to it."""
    return discover_roots(spark, roots, knowledge, excludes) if roots else discover_registry(spark, workspace or ".", knowledge, excludes)


def read_files(found: DataFrame, max_bytes: int = S.MAX_DOCUMENT_BYTES) -> DataFrame:
    """``repo, path, mtime, size, is_symlink, content``; links and oversized files come without content, and so do unreadable ones.

    Tasks look at and read the files that were dealt to them. Sizes are judged by ``lstat`` before
    anything is read; a file that can't be looked at has no size either. A batch holds some
    megabytes or one file.
    """
    names = ["repo", "path", "mtime", "size", "is_symlink", "content"]
    kinds = (pa.string(), pa.string(), pa.float64(), pa.int64(), pa.bool_(), pa.binary())

    def look(repo: str, path: str, where: str) -> tuple:
        try:
            st = os.lstat(where)
        except OSError:
            return repo, path, None, None, False, None
        link, content = stat.S_ISLNK(st.st_mode), None
        if not link and st.st_size <= max_bytes:
            try:
                with open(where, "rb") as f:
                    content = f.read()
            except OSError:
                pass
        return repo, path, float(st.st_mtime), st.st_size, link, content

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        flush = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                held.append(look(*row))
                size += len(held[-1][-1] or b"")
                if size >= READ_BYTES:
                    yield flush(held)
                    held, size = [], 0
        if held:
            yield flush(held)

    tasks = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return found.select("repo", "path", "abs_path").repartition(tasks, "abs_path").mapInArrow(run, "repo string, path string, mtime double, size long, is_symlink boolean, content binary")
