"""Change report: risk, texts, coupling, gaps and summary of a set of changed files in one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferngraph.functions import paths as P
from ferngraph.operators import change, neighbourhood, ranking
from ferngraph.session import written


def scored(changed: DataFrame, files: DataFrame, edges: DataFrame, signals: DataFrame, pairs: DataFrame, cycles: DataFrame) -> DataFrame:
    """Changed files (path, status, indexed) with all that their risk depends on, risk_score and
    risk_tier.  ``cycles``: (subject, cycles)."""
    near = neighbourhood.direct(changed.select(F.col("path").alias("subject")), edges)
    around = near.groupBy(F.col("subject").alias("path")).agg(
        F.count(F.when(F.col("is_importer"), 1)).alias("importers"),
        F.count(F.when(F.col("is_importer") & F.col("is_import"), 1)).alias("mutual"),
        F.max(P.is_test(F.col("path")) & F.col("is_importer")).alias("has_dependency"),
    )
    x = changed.join(signals.withColumnRenamed("file_path", "path"), "path").join(around, "path", "left")
    x = x.join(change.changed_co_change(changed, pairs), "path", "left")
    x = x.join(change.has_named_test(changed, files).withColumnRenamed("has_named_test", "has_direct"), "path", "left")
    x = x.join(cycles.withColumnRenamed("subject", "path"), "path", "left")
    x = x.fillna(0, ["importers", "mutual", "co_change", "cycles"]).fillna(False, ["has_dependency", "has_direct"])
    x = x.crossJoin(F.broadcast(signals.agg(F.max("indegree").alias("max_indegree"))))
    return change.risk(x.withColumn("fragility", ranking.fragility(F.col("indegree"), F.col("outdegree"))))


def factors() -> Column:
    """What raised the risk of a scored file, in words."""
    n = lambda c, text: F.when(F.col(c) > 0, F.concat(F.col(c).cast("string"), F.lit(text)))
    return F.array_compact(F.array(n("importers", " importers"), n("cycles", " cycles"), n("mutual", " mutual imports"), F.when(~F.col("has_direct"), "no test of its own")))


def told(risks: DataFrame) -> DataFrame:
    """Adds the narrative of each scored file."""
    return risks.withColumn("narrative", change.narrative(F.col("path"), F.col("status"), F.col("risk_score"), F.col("risk_tier"), factors()))


def test_imports(edges: DataFrame) -> DataFrame:
    """(path, file, direct): test files that import a path."""
    tests = edges.where(P.is_test(F.col("src_file")))
    return tests.select(F.col("dst_file").alias("path"), F.col("src_file").alias("file"), F.lit(True).alias("direct"))


def report(changed: DataFrame, files: DataFrame, edges: DataFrame, signals: DataFrame, pairs: DataFrame, cycles: DataFrame, blast: DataFrame | None = None) -> dict[str, DataFrame]:
    """The whole report as relations: files, triage, aggregate, coupling, gaps, hidden, summary,
    suggestions and top.  ``blast``: (path, blast_level), low where absent."""
    risks = written(told(scored(changed, files, edges, signals, pairs, cycles)), "risks")
    near = neighbourhood.collect(changed.select(F.col("path").alias("subject")), edges).select("subject", "path")
    level = changed.join(blast, "path", "left") if blast is not None else changed.withColumn("blast_level", F.lit(None).cast("string"))
    tests = test_imports(edges)
    return {
        "files": risks.orderBy(F.desc("risk_score"), "path"),
        "triage": change.triage(risks),
        "aggregate": change.aggregate_risk(risks),
        "coupling": change.coupling(changed, edges),
        "gaps": change.test_gaps(changed, tests),
        "hidden": change.hidden_coupling(changed, pairs, near, files),
        "summary": change.summary(level.fillna("low", ["blast_level"])),
        "suggestions": change.suggestions(risks, tests),
        "top": change.top_risk_names(risks),
    }
