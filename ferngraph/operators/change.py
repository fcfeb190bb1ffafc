"""Change risk: scores, tiers, coupling, gaps and summaries of changed files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferngraph.functions import paths as P

TIERS = ("SAFE", "REVIEW", "TEST", "CRITICAL")


def decode_status(letter: Column) -> Column:
    return F.when(letter == "A", "added").when(letter == "D", "deleted").when(letter.startswith("R"), "renamed").otherwise("modified")


def parse_diff(lines: DataFrame, column: str = "value") -> DataFrame:
    """(path, status) of name-status lines; of a rename the last path counts."""
    parts = F.split(F.trim(F.col(column)), "\t")
    return lines.where(F.size(parts) > 1).select(F.element_at(parts, -1).alias("path"), decode_status(parts[0]).alias("status"))


def base_score(status: Column, path: Column) -> Column:
    return F.when(status == "added", F.when(P.is_test(path), 10).otherwise(20)).when(status == "modified", 30).when(status.isin("deleted", "renamed"), 5).otherwise(30)


def structural(importers: Column, max_indegree: Column, co_change: Column, fragility: Column, mutual: Column, cycles: Column) -> Column:
    near = F.when(max_indegree > 0, F.least(F.lit(1.0), importers / max_indegree)).otherwise(F.lit(0.0))
    return near * 3.0 + F.least(F.lit(10.0), co_change * 2.0) + F.greatest(fragility, F.lit(0.0)) * 15.0 + mutual * 5.0 + cycles * 10.0


def coverage(path: Column, has_direct: Column, has_dependency: Column) -> Column:
    return F.when(P.is_test(path), 0.7).when(has_direct, 0.7).when(has_dependency, 0.85).otherwise(1.2)


def clamp(score: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(100), F.floor(score + 0.5))).cast("int")


def tier(score: Column) -> Column:
    return F.when(score <= 20, "SAFE").when(score <= 50, "REVIEW").when(score <= 75, "TEST").otherwise("CRITICAL")


def risk(changed: DataFrame) -> DataFrame:
    """Adds risk_score and risk_tier to (path, status, indexed, importers, max_indegree,
    co_change, fragility, mutual, cycles, has_direct, has_dependency)."""
    base = base_score(F.col("status"), F.col("path"))
    plain = F.when(P.is_supported(F.col("path")), base).otherwise(F.greatest(F.lit(5), F.floor(base / 3)))
    more = F.when(F.col("status") == "modified", structural(*[F.col(c) for c in ("importers", "max_indegree", "co_change", "fragility", "mutual", "cycles")])).otherwise(F.lit(0.0))
    full = clamp((base + more) * coverage(F.col("path"), F.col("has_direct"), F.col("has_dependency")))
    score = F.when(F.col("indexed"), full).otherwise(plain.cast("int"))
    return changed.withColumn("risk_score", score).withColumn("risk_tier", tier(F.col("risk_score")))


def changed_co_change(changed: DataFrame, pairs: DataFrame) -> DataFrame:
    """(path, co_change): co-changes of each changed file with the other changed files."""
    c = changed.select("path").distinct()
    a, b = c.withColumnRenamed("path", "file_a"), c.withColumnRenamed("path", "file_b")
    both = pairs.join(a, "file_a", "left_semi").join(b, "file_b", "left_semi")
    return both.select(F.explode(F.array("file_a", "file_b")).alias("path"), "frequency").groupBy("path").agg(F.sum("frequency").alias("co_change"))


def has_named_test(changed: DataFrame, files: DataFrame) -> DataFrame:
    """(path, has_named_test): Python test_<stem>.py anywhere, Go *_test.go of the directory that contains the stem."""
    py = changed.where(F.col("path").endswith(".py")).select("path", F.concat(F.lit("test_"), P.stem(F.col("path")), F.lit(".py")).alias("b"))
    hit = py.join(files.select(P.basename(F.col("path")).alias("b")).distinct(), "b", "left_semi").select("path")
    go = changed.where(F.col("path").endswith(".go")).select("path", P.dirname(F.col("path")).alias("d"), P.stem(F.col("path")).alias("s"))
    tests = files.where(F.col("path").endswith("_test.go")).select(P.dirname(F.col("path")).alias("d"), P.basename(F.col("path")).alias("t"))
    more = go.join(tests, "d").where(F.contains("t", "s")).select("path").distinct()
    return changed.select("path").distinct().join(hit.unionByName(more).distinct().withColumn("has_named_test", F.lit(True)), "path", "left").fillna(False, ["has_named_test"])


def coupling(changed: DataFrame, edges: DataFrame) -> DataFrame:
    """(file_a, file_b, direction) of changed files that import one another, file_a < file_b."""
    c = changed.select("path").distinct()
    e = edges.select("src_file", "dst_file").where("src_file <> dst_file").distinct()
    e = e.join(c.withColumnRenamed("path", "src_file"), "src_file", "left_semi").join(c.withColumnRenamed("path", "dst_file"), "dst_file", "left_semi")
    g = e.groupBy(F.least("src_file", "dst_file").alias("file_a"), F.greatest("src_file", "dst_file").alias("file_b")).agg(F.count("*").alias("n"), F.max(F.col("src_file") < F.col("dst_file")).alias("forward"))
    return g.select("file_a", "file_b", F.when(F.col("n") == 2, "mutual").when(F.col("forward"), "a_imports_b").otherwise("b_imports_a").alias("direction"))


def test_gaps(changed: DataFrame, tests: DataFrame) -> DataFrame:
    """Changed files no direct test stands for: tests (path, file, direct) of each changed file;
    a test whose name has the file's stem, or for Go one of its directory, covers it."""
    t = tests.where("direct").select("path", F.col("file").alias("test"))
    x = changed.where(~P.is_test(F.col("path"))).select("path").distinct()
    ok = F.contains(P.basename(F.col("test")), P.stem(F.col("path"))) | (F.col("path").endswith(".go") & (P.dirname(F.col("test")) == P.dirname(F.col("path"))))
    return x.join(t.where(ok).select("path").distinct(), "path", "left_anti").orderBy("path")


def hidden_coupling(changed: DataFrame, pairs: DataFrame, near: DataFrame, files: DataFrame, least: int = 3, limit: int = 5) -> DataFrame:
    """(path, partner, frequency): frequent co-change partners outside the neighbourhood
    (subject, path) that are indexed, the first ``limit`` of each file."""
    from pyspark.sql import Window as W

    from ferngraph.operators.signals import symmetric

    s = symmetric(pairs).where(F.col("frequency") >= least).join(changed.select("path").distinct(), "path", "left_semi")
    s = s.join(near.select(F.col("subject").alias("path"), F.col("path").alias("partner")), ["path", "partner"], "left_anti")
    s = s.join(files.select(F.col("path").alias("partner")), "partner", "left_semi")
    w = W.partitionBy("path").orderBy(F.desc("frequency"), "partner")
    return s.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).select("path", "partner", "frequency", "rank")


def triage(scored: DataFrame) -> DataFrame:
    """(risk_tier, n, files): files of each tier, sorted, as one comma list."""
    return scored.groupBy("risk_tier").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list("path")), ",").alias("files"))


def summary(changed: DataFrame) -> DataFrame:
    n = lambda c, name: F.count(F.when(c, 1)).alias(name)
    st = F.col("status")
    return changed.agg(
        F.count("*").alias("total"), *[n(st == s, s) for s in ("added", "modified", "deleted", "renamed")],
        n(F.col("indexed"), "indexed"), n(P.is_test(F.col("path")), "tests"), n(F.col("blast_level") == "high", "high_risk"),
    )


def aggregate_risk(scored: DataFrame) -> DataFrame:
    """One row: highest score, share of files with direct tests, and a summary text."""
    code = ~P.is_test(F.col("path"))
    g = scored.agg(F.coalesce(F.max("risk_score"), F.lit(0)).alias("score"), F.count(F.when(code, 1)).alias("n"), F.count(F.when(code & F.col("has_direct"), 1)).alias("tested"), F.count(F.when(F.col("risk_tier").isin("TEST", "CRITICAL"), 1)).alias("risky"), F.min(F.col("status") == "added").alias("all_added"))
    share = F.when(F.col("n") > 0, P.floor2(F.col("tested") / F.col("n"))).otherwise(F.lit(0.0))
    text = F.when(F.col("all_added"), "only new files").otherwise(F.concat_ws("; ", F.format_string("%d of %d files tested", "tested", "n"), F.when(F.col("risky") > 0, F.format_string("%d need tests or review", "risky"))))
    return g.select("score", share.alias("tested_share"), "risky", text.alias("text"))


def narrative(path: Column, status: Column, score: Column, tier_: Column, factors: Column) -> Column:
    text = F.concat_ws(". ", F.format_string("%s is %s, risk %d (%s)", P.basename(path), status, score, tier_), F.when(F.size(factors) > 0, F.array_join(factors, ", ")))
    return F.left(text, F.lit(200))


def top_risk_names(scored: DataFrame, limit: int = 3) -> DataFrame:
    """(risk_tier, names): the riskiest names and how many more."""
    ranked = F.transform(F.sort_array(F.collect_list(F.struct((-F.col("risk_score")).alias("r"), "path"))), lambda s: P.basename(s["path"]))
    g = scored.groupBy("risk_tier").agg(ranked.alias("f"))
    more = F.size("f") - limit
    return g.select("risk_tier", F.concat(F.array_join(F.slice("f", 1, limit), ", "), F.when(more > 0, F.format_string(" +%d more", more)).otherwise("")).alias("names"))


def suggestions(scored: DataFrame, tests: DataFrame) -> DataFrame:
    """(path, suggestion) for risky files: the direct tests to run, or that one is missing."""
    t = tests.where("direct").groupBy("path").agg(F.min("file").alias("test"))
    x = scored.where(F.col("risk_tier").isin("TEST", "CRITICAL") & ~P.is_test(F.col("path"))).join(t, "path", "left")
    return x.select("path", F.when(F.col("test").isNotNull(), F.concat(F.lit("run "), "test")).otherwise(F.concat(F.lit("add a test for "), P.basename(F.col("path")))).alias("suggestion"))


def exit_code(n_critical: int, n_test: int, blast_level: str, fail_on: str) -> int:
    """2 for a high level, 1 for a medium one, as far as ``fail_on`` asks; 1 for critical files."""
    if fail_on == "critical":
        return int(n_critical > 0)
    if blast_level == "high" and fail_on in ("high", "medium"):
        return 2
    return int(fail_on == "medium" and blast_level == "medium")
