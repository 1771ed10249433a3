"""Git history as tables. Commands run on the driver, whose disk holds the
repository; what they print becomes DataFrames."""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.functions.text import language
from docweave.operators.changes import changed_files, parse_name_status


def _git(root: str, *args: str) -> str | None:
    done = subprocess.run(["git", "-C", root, *args], capture_output=True, check=False)
    return done.stdout.decode("utf-8", "replace") if done.returncode == 0 else None


def current_revision(root: str) -> str | None:
    """HEAD's hash; None outside a repository or without commits."""
    found = _git(root, "rev-parse", "--verify", "-q", "HEAD")
    return found.strip() if found else None


def resolve_revision(root: str, ref: str) -> str:
    found = _git(root, "rev-parse", "--verify", ref)
    if not found:
        raise ValueError(f"unknown revision {ref!r}")
    return found.strip()


def read_at(root: str, revision: str | None, path: str) -> str | None:
    """A file's text at a revision, or in the working tree for None."""
    if revision is not None:
        return _git(root, "show", f"{revision}:{path}")
    try:
        with open(f"{root}/{path}", encoding="utf-8", errors="replace") as f:
            return f.read()
    except OSError:
        return None


def changes_between(spark: SparkSession, root: str, base: str, target: str | None = None) -> DataFrame:
    """File changes from ``base`` to ``target``; to the working tree with its
    untracked files where that is None."""
    printed = _git(root, "diff", "--name-status", "-M", base, *([target] if target else [])) or ""
    lines = spark.createDataFrame([(x,) for x in printed.split("\n") if x], "line string")
    untracked = None
    if target is None:
        names = (_git(root, "ls-files", "--others", "--exclude-standard") or "").split("\n")
        untracked = spark.createDataFrame([(x,) for x in names if x], "path string")
    return changed_files(parse_name_status(lines), untracked)


def contents(spark: SparkSession, root: str, base: str, target: str | None, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(before, after): rows (path_pair, path, content) of changed code files."""
    code = changes.filter(language(F.col("path")).isin("typescript", "javascript")).collect()
    before = [(r.path, r.previous_path or r.path, read_at(root, base, r.previous_path or r.path)) for r in code if r.status != "added"]
    after = [(r.path, r.path, read_at(root, target, r.path)) for r in code if r.status != "deleted"]
    schema = "path_pair string, path string, content string"
    return tuple(spark.createDataFrame([r for r in rows if r[2] is not None], schema) for rows in (before, after))
