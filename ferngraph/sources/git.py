"""Version control as DataFrames: git runs on the driver, its text is parsed by Spark."""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferngraph.operators.change import parse_diff
from ferngraph.operators.signals import WINDOW_DAYS


def run(root: str, *args: str) -> str:
    """git's output, or '' where it fails."""
    p = subprocess.run(["git", "-C", root, *args], capture_output=True, text=True, errors="replace")
    return p.stdout if p.returncode == 0 else ""


def _rows(spark: SparkSession, lines: list[str]) -> DataFrame:
    return spark.createDataFrame([(x,) for x in lines], "value string")


def listed_files(spark: SparkSession, root: str) -> DataFrame:
    """(path): tracked files and untracked ones that aren't ignored."""
    out = run(root, "ls-files", "-z", "--cached", "--others", "--exclude-standard")
    return _rows(spark, [x for x in out.split("\0") if x]).select(F.col("value").alias("path")).distinct()


def log_text(root: str, days: int = WINDOW_DAYS) -> str:
    """The log of the ``days`` days before the head's author date, without merges."""
    head = run(root, "log", "-1", "--format=%at").strip()
    since = int(head) - days * 86400 if head else 0
    return run(root, "log", "--no-merges", f"--since=@{since}", "--name-only", "--format=%x01%H%x00%aI") if head else ""


def parse_log(blocks: DataFrame, column: str = "value") -> DataFrame:
    """(hash, ts, files) of log blocks: ``hash NUL date``, then one path per line."""
    lines = F.split(F.col(column), "\n")
    head = F.split(lines[0], "\0")
    files = F.filter(F.transform(F.slice(lines, 2, 1 << 20), lambda x: F.trim(x)), lambda x: x != "")
    return blocks.where(F.col(column) != "").select(head[0].alias("hash"), F.to_timestamp(head[1]).alias("ts"), F.array_distinct(files).alias("files"))


def commits(spark: SparkSession, root: str, days: int = WINDOW_DAYS) -> DataFrame:
    return parse_log(_rows(spark, [b for b in log_text(root, days).split("\x01") if b.strip()]))


def diff(spark: SparkSession, root: str, base: str, head: str = "HEAD") -> DataFrame:
    """(path, status) between two commits, or of the working tree where that is empty."""
    out = run(root, "diff", "--name-status", "--no-renames", f"{base}..{head}")
    return parse_diff(_rows(spark, (out or run(root, "diff", "--name-status", "--no-renames", base)).splitlines()))


def working_tree_changes(spark: SparkSession, root: str, since: str) -> DataFrame:
    """(path): changed since a commit, unstaged, or untracked."""
    names = [run(root, "diff", "--name-only", f"{since}..HEAD"), run(root, "diff", "--name-only"), run(root, "ls-files", "--others", "--exclude-standard")]
    return _rows(spark, [x for n in names for x in n.splitlines()]).select(F.col("value").alias("path")).distinct()


def head(root: str) -> str:
    return run(root, "rev-parse", "HEAD").strip()


def branch(root: str) -> str:
    return run(root, "rev-parse", "--abbrev-ref", "HEAD").strip()


def merge_base(root: str, a: str, b: str = "HEAD") -> str:
    return run(root, "merge-base", a, b).strip()


def default_branch(root: str) -> str:
    name = run(root, "symbolic-ref", "--short", "refs/remotes/origin/HEAD").strip()
    return name or next((b for b in ("main", "master") if run(root, "rev-parse", "--verify", "--quiet", b)), "")
