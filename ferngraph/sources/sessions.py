"""Session transcripts (JSON lines) as edit and context events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ferngraph.functions import paths as P

LINE = "type string, timestamp string, message struct<content: array<struct<type: string, name: string, tool_use_id: string, input: map<string,string>, content: string>>>"
EDIT_TOOLS = ("Edit", "Write", "MultiEdit")


def listing(spark: SparkSession, folder: str, since: str | None = None, limit: int = 0) -> DataFrame:
    """(file, modified) of the sessions of a folder, newest first."""
    x = spark.read.format("binaryFile").option("pathGlobFilter", "*.jsonl").load(folder).select(F.col("path").alias("file"), F.col("modificationTime").alias("modified"))
    x = x if since is None else x.where(F.col("modified") >= F.lit(since).cast("timestamp"))
    x = x.orderBy(F.desc("modified"), "file")
    return x.limit(limit) if limit > 0 else x


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(session, line...) of all transcripts of a path; broken lines are dropped."""
    raw = spark.read.text(path).select(F.input_file_name().alias("session"), F.from_json("value", LINE).alias("l"))
    return raw.where("l.type IS NOT NULL").select("session", "l.*")


def _items(x: DataFrame) -> DataFrame:
    return x.select("session", F.to_timestamp("timestamp").alias("ts"), F.explode("message.content").alias("c"))


def _file(c: Column) -> Column:
    return F.coalesce(c["input"]["file_path"], c["input"]["path"])


def edits(x: DataFrame, repo: str) -> DataFrame:
    """(session, ts, file): supported files of the repository that a tool edited."""
    y = _items(x).where((F.col("c.type") == "tool_use") & F.col("c.name").isin(*EDIT_TOOLS)).select("session", "ts", _file(F.col("c")).alias("f"))
    return y.where(P.within(F.col("f"), repo) & P.is_supported(F.col("f"))).select("session", "ts", P.relative(F.col("f"), repo).alias("file"))


def contexts(x: DataFrame, repo: str, words: tuple[str, ...], marker: str) -> DataFrame:
    """(session, ts, file): uses of the tool whose name has all ``words``, and results that
    begin a line with ``marker`` and a path."""
    c = F.col("c")
    tool = (c["type"] == "tool_use") & F.forall(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(c["name"], w))
    used = _items(x).where(tool).select("session", "ts", _file(c).alias("f"))
    told = _items(x).where((c["type"] == "tool_result") & F.contains(c["content"], F.lit(marker)))
    told = told.select("session", "ts", F.regexp_extract(c["content"], f"(?m)^{marker}\\s*(\\S+)", 1).alias("f")).where("f <> ''")
    return used.unionByName(told).where("f IS NOT NULL").select("session", "ts", P.relative(F.col("f"), repo).alias("file"))
