"""Analytics over append-only logs: runs, risks, usage, feedback, sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ferngraph.functions import paths as P

LEVELS = ("high", "medium", "low")
MIN_SCORES = 10


def level_order(level: Column) -> Column:
    return F.when(level == "high", 1).when(level == "medium", 2).when(level == "low", 3).otherwise(4)


def blast_distribution(runs: DataFrame, since: Column | None = None) -> DataFrame:
    """(level, n, percent), high first."""
    x = runs if since is None else runs.where(F.col("created_at") >= since)
    g = x.groupBy(F.col("blast_level").alias("level")).agg(F.count("*").alias("n"))
    return g.withColumn("percent", F.lit(100.0) * F.col("n") / F.sum("n").over(W.partitionBy())).orderBy(level_order(F.col("level")), "level")


def hotspot_evolution(hotspots: DataFrame, runs: DataFrame, limit: int, since: Column | None = None) -> DataFrame:
    r = runs.select(F.col("id").alias("run_id"), "created_at")
    r = r if since is None else r.where(F.col("created_at") >= since)
    g = hotspots.join(r, "run_id").groupBy("file_path").agg(F.count("*").alias("n"), F.max("created_at").alias("last_seen"))
    return g.orderBy(F.desc("n"), "file_path").limit(limit)


def trend(runs: DataFrame, limit: int, branch: str | None = None) -> DataFrame:
    x = runs if branch is None else runs.where(F.col("branch") == branch)
    return x.orderBy(F.desc("created_at"), F.desc("id")).limit(limit)


def file_risk_history(risks: DataFrame, runs: DataFrame, path: str, limit: int) -> DataFrame:
    x = risks.where(F.col("file_path") == path).join(runs.select(F.col("id").alias("run_id"), "created_at"), "run_id")
    return x.orderBy(F.desc("created_at"), F.desc("run_id")).limit(limit)


def usage_summary(usage: DataFrame) -> DataFrame:
    """One row; averages skip nulls, files count with repeats."""
    change = F.col("tool") == "analyze_change"
    level = lambda v: F.count(F.when(F.col("blast_level") == v, 1)).alias(f"n_{v}")
    return usage.agg(
        F.count("*").alias("n"),
        F.coalesce(F.sum("file_count"), F.lit(0)).cast("long").alias("files_analyzed"),
        F.avg("duration_ms").alias("avg_duration"),
        F.avg("confidence").alias("avg_confidence"),
        F.count(F.when(change, 1)).alias("n_changes"),
        F.coalesce(F.sum(F.when(~change, F.col("must_read_count"))), F.lit(0)).cast("long").alias("must_read"),
        F.avg(F.when(~change, F.col("response_tokens"))).alias("avg_tokens"),
        *[level(v) for v in LEVELS],
    )


def period(ts: Column, unit: str) -> Column:
    """day yyyy-MM-dd, month yyyy-MM, or week yyyy-Www with Monday weeks from 00."""
    if unit == "day":
        return F.date_format(ts, "yyyy-MM-dd")
    if unit == "month":
        return F.date_format(ts, "yyyy-MM")
    week = F.floor((F.dayofyear(ts) - 1 + 7 - F.weekday(ts)) / 7)
    return F.concat(F.date_format(ts, "yyyy"), F.lit("-W"), F.lpad(week.cast("string"), 2, "0"))


def usage_by_period(usage: DataFrame, unit: str) -> DataFrame:
    change = F.col("tool") == "analyze_change"
    return usage.groupBy(period(F.col("created_at"), unit).alias("period")).agg(
        F.count("*").alias("n"), F.sum("file_count").cast("long").alias("files"), F.sum(F.when(change, 1).otherwise(0)).cast("long").alias("changes")
    )


def top_files(usage: DataFrame, limit: int) -> DataFrame:
    """Files by number of uses; exact, no limit before the explode."""
    g = usage.select(F.explode("files_analyzed").alias("file_path")).groupBy("file_path").agg(F.count("*").alias("n"))
    return g.orderBy(F.desc("n"), "file_path").limit(limit)


def files_with_usage(usage: DataFrame) -> DataFrame:
    return usage.select(F.explode("files_analyzed").alias("file_path")).distinct()


def latest_usage(feedback: DataFrame, usage: DataFrame) -> DataFrame:
    """(feedback id, usage_id): the latest usage row that lists the file; change rows are
    taken only where no other row lists it."""
    f = feedback.select(F.col("id").alias("feedback_id"), "file_path")
    u = usage.select(F.col("id").alias("usage_id"), "created_at", (F.col("tool") == "analyze_change").alias("is_change"), F.explode(F.array_distinct("files_analyzed")).alias("file_path"))
    # the latest of each file first, so that no feedback meets every use of its file
    best = u.groupBy("file_path").agg(F.min_by("usage_id", F.struct("is_change", -F.unix_micros(F.col("created_at").cast("timestamp")), -F.col("usage_id"))).alias("usage_id"))
    return f.join(best, "file_path", "left").select("feedback_id", "file_path", "usage_id")


def accuracy(feedback: DataFrame, usage: DataFrame) -> DataFrame:
    """One row: precision, recall and likely-modify accuracy in percent, average usefulness."""
    n = lambda c: F.coalesce(F.sum(F.coalesce(F.size(F.col(c)), F.lit(0))), F.lit(0)).cast("long")
    s = feedback.agg(F.count("*").alias("n"), F.avg("usefulness").alias("avg_usefulness"), n("useful_files").alias("useful"), n("unnecessary_files").alias("unnecessary"), n("missing_files").alias("missing"), n("modified_files").alias("modified"))
    rated = usage.join(feedback.select(F.col("usage_id").alias("id")).distinct(), "id", "left_semi").agg(F.coalesce(F.sum("likely_modify_count"), F.lit(0)).cast("long").alias("likely"))
    share = lambda a, b: F.when(b > 0, F.lit(100.0) * a / b).otherwise(F.lit(0.0))
    u = F.col("useful")
    return s.crossJoin(rated).select(
        "n", "avg_usefulness", share(u, u + F.col("unnecessary")).alias("precision"), share(u, u + F.col("missing")).alias("recall"), share(F.col("modified"), F.col("likely")).alias("likely_modify_accuracy")
    )


def lowest_rated(feedback: DataFrame, limit: int) -> DataFrame:
    return feedback.orderBy("usefulness", F.desc("created_at"), "id").limit(limit)


def percentile(scores: DataFrame, queries: DataFrame, version: int) -> DataFrame:
    """(query_id, percentile): share of stored scores below, 0 with fewer than MIN_SCORES.

    Scores are whole numbers of 0..100, so the history is a histogram of that many rows."""
    hist = scores.where(F.col("score_version") == version).groupBy("risk_score").agg(F.count("*").alias("n"))
    # every whole score has its own row
    grid = queries.sparkSession.range(0, 102).select(F.col("id").cast("int").alias("score"))
    total = hist.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("all"))
    below = grid.join(F.broadcast(hist.where(F.col("risk_score").between(0, 100))), F.col("risk_score") < F.col("score"), "left").groupBy("score").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("below")).crossJoin(total)
    q = queries.select("query_id", F.greatest(F.lit(0), F.least(F.lit(101), F.col("risk_score"))).cast("int").alias("score"))
    return q.join(F.broadcast(below), "score").select("query_id", F.when(F.col("all") >= MIN_SCORES, F.expr("below * 100 div `all`")).otherwise(F.lit(0)).cast("long").alias("percentile"))


def dominant_level(runs: DataFrame, by: str) -> DataFrame:
    """The commonest blast level of each group; the more severe of equals."""
    g = runs.groupBy(by, "blast_level").agg(F.count("*").alias("n"))
    return g.groupBy(by).agg(F.max_by("blast_level", F.struct("n", -level_order(F.col("blast_level")))).alias("level"))


def discover(edits: DataFrame, contexts: DataFrame) -> DataFrame:
    """(file, edits, contexts, covered, missed) of edited files."""
    e = edits.groupBy("file").agg(F.count("*").alias("edits"))
    c = contexts.groupBy("file").agg(F.count("*").alias("contexts"))
    x = e.join(c, "file", "left").withColumn("contexts", F.coalesce("contexts", F.lit(0)))
    return x.select("file", "edits", "contexts", (F.col("contexts") > 0).alias("covered"), (F.col("contexts") < F.col("edits")).alias("missed"))


def coverage(found: DataFrame) -> DataFrame:
    return found.agg(F.count("*").alias("files"), F.count(F.when(F.col("covered"), 1)).alias("covered"), (F.lit(100.0) * F.count(F.when(F.col("covered"), 1)) / F.greatest(F.count("*"), F.lit(1))).alias("coverage"))


def missed_files(found: DataFrame, limit: int, with_tests: bool = False) -> DataFrame:
    x = found.where("missed")
    x = x if with_tests else x.where(~P.is_test(F.col("file")))
    return x.orderBy(F.desc("edits"), "file").limit(limit)


def session_stats(edits: DataFrame, contexts: DataFrame) -> DataFrame:
    """Per session with edits: distinct edited files, those with context, and the share."""
    e = edits.select("session", "file").distinct()
    c = contexts.select("session", "file", F.lit(1).alias("hit")).distinct()
    g = e.join(c, ["session", "file"], "left").groupBy("session").agg(F.count("*").alias("edited"), F.count("hit").alias("covered"))
    return g.withColumn("adoption", F.lit(100.0) * F.col("covered") / F.col("edited"))


def record_run(run: DataFrame, risks: DataFrame, hotspots: DataFrame, folder: str) -> None:
    """Append a run, its file risks (one per run and file) and its hotspots."""
    run.write.mode("append").parquet(f"{folder}/analysis_runs")
    risks.dropDuplicates(["run_id", "file_path"]).write.mode("append").parquet(f"{folder}/file_risks")
    hotspots.dropDuplicates(["run_id", "file_path"]).write.mode("append").parquet(f"{folder}/hotspot_history")


def usage_entry(outputs: DataFrame) -> DataFrame:
    """Usage rows of analysis outputs (JSON struct ``output``): tokens are bytes div 4."""
    return outputs.withColumn("response_tokens", F.floor(F.octet_length(F.to_json("output")) / 4))


def valid_feedback(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("usefulness").between(1, 5))
