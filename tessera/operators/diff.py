"""Snapshot differences: what changed since the checkpoint, from content hashes or from git."""

from __future__ import annotations

import os
import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.config import DATA_DIR


def manifest(files: DataFrame) -> DataFrame:
    """rel_path, mtime, size, md5 of a files table with content."""
    return files.select("rel_path", "mtime", "size", F.md5("content").alias("md5"))


def changes(current: DataFrame, old: DataFrame, keys: list[str] = ["rel_path"]) -> DataFrame:  # noqa: B006
    """keys, change ('new', 'modified', 'deleted') by md5; unchanged keys give no row. Both sides have one row per key.

    One full outer join answers all three questions.
    """
    both = current.select(*keys, F.col("md5").alias("_now"), F.lit(True).alias("_c")).join(old.select(*keys, F.col("md5").alias("_was"), F.lit(True).alias("_o")), keys, "full_outer")
    change = F.when(F.col("_o").isNull(), "new").when(F.col("_c").isNull(), "deleted").when(~F.col("_now").eqNullSafe(F.col("_was")), "modified")
    return both.select(*keys, change.alias("change")).where("change IS NOT NULL")


def report(diff: DataFrame, by: list[str] = []) -> DataFrame:  # noqa: B006
    """by..., has_changes, changed_files, deleted_files (counts)."""
    changed = F.count_if(F.col("change") != "deleted")
    gone = F.count_if(F.col("change") == "deleted")
    g = diff.groupBy(*by) if by else diff
    return g.agg((F.count(F.lit(1)) > 0).alias("has_changes"), changed.alias("changed_files"), gone.alias("deleted_files"))


def freshness(indexed: DataFrame, diff: DataFrame, by: list[str]) -> DataFrame:
    """by..., is_indexed, has_changes, changed_files, deleted_files, recommendation for every key of either side."""
    have = indexed.select(*by).distinct().withColumn("is_indexed", F.lit(True))
    out = have.join(report(diff, by), by, "full_outer")
    is_in, has = F.coalesce("is_indexed", F.lit(False)), F.coalesce("has_changes", F.lit(False))
    advice = F.when(~is_in, "ingestion needed").when(has, "consider re-indexing").otherwise("ready to search")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select(*by, is_in.alias("is_indexed"), has.alias("has_changes"), zero("changed_files"), zero("deleted_files"), advice.alias("recommendation"))


SKIPPED = ("node_modules", "__pycache__", ".git", "venv", ".venv")


def skipped(path: str) -> bool:
    parts = path.split("/")
    return DATA_DIR in parts or any(p in SKIPPED for p in parts)


def git(directory: str, *args: str, timeout: int = 30) -> str | None:
    try:
        r = subprocess.run(["git", *args], cwd=directory, capture_output=True, text=True, timeout=timeout)
    except (OSError, subprocess.SubprocessError):
        return None
    return r.stdout if r.returncode == 0 else None


def head(directory: str) -> str | None:
    out = git(directory, "rev-parse", "HEAD", timeout=10)
    return out.strip() if out else None


def git_changes(spark: SparkSession, directory: str, commit: str | None) -> DataFrame:
    """rel_path, change from `git diff` against the checkpoint and `git status`. Renames give a deletion and a new file.

    The listing comes from one git process on the driver and is as long as the change set of a working copy.
    """
    rows: dict[str, str] = {}
    if commit:
        for line in (git(directory, "diff", "--name-status", "-M", commit, "HEAD") or "").splitlines():
            kind, *paths = line.split("\t")
            if kind.startswith("R"):
                rows[paths[0]], rows[paths[1]] = "deleted", "new"
            elif paths:
                rows[paths[-1]] = {"A": "new", "D": "deleted"}.get(kind[:1], "modified")
    for line in (git(directory, "status", "--porcelain", "-uall") or "").splitlines():
        code, path = line[:2], line[3:].strip('"')
        if " -> " in path:
            old, path = path.split(" -> ", 1)
            rows[old] = "deleted"
        rows[path] = "deleted" if "D" in code else "new" if code in ("??", "A ") else "modified"
    return spark.createDataFrame([(p, c) for p, c in rows.items() if not skipped(p)], "rel_path string, change string")


def uses_git(directory: str) -> bool:
    return os.path.isdir(os.path.join(directory, ".git"))
