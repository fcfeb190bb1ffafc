"""Archetypes, rubric grades and golden comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferngraph.functions import paths as P

# Archetype, its keywords and what ranks its matches, in order of detection.
ARCHETYPES = (
    ("Service", "service controller handler repository store provider dao", "outdegree"),
    ("Model", "model schema types entity dto interface record", "indegree"),
    ("Middleware", "middleware plugin interceptor hook filter guard pipe decorator", "sum"),
    ("High fan-in", "", "high_fan_in"),
    ("Page", "page route endpoint api view screen", "outdegree_entry"),
    ("Auth", "auth security session token permission", "sum"),
    ("Leaf", "util helper component widget formatter converter adapter", "leaf"),
    ("Config", "config constants settings env options", "indegree"),
    ("Barrel", "", "barrel"),
    ("Test", "", "test"),
    ("Migration", "migration migrate seed fixture", "outdegree"),
    ("Validation", "serializer validator transformer mapper converter", "sum"),
    ("Error", "error exception fault", "indegree"),
    ("CLI", "cmd command cli", "outdegree"),
    ("Event", "event listener subscriber consumer producer emitter", "sum"),
    ("Interface", "interface abstract trait protocol contract", "indegree"),
    ("Orchestrator", "", "orchestrator"),
    ("Hotspot", "", "hotspot"),
)
BARREL_ORDER = ("index.ts", "index.js", "__init__.py", "mod.rs", "lib.rs")
# Weights of the sections must_read, likely_modify, tests, related, blast.
WEIGHTS = (0.40, 0.20, 0.15, 0.15, 0.10)


def _candidates(signals: DataFrame, keywords: str, kind: str) -> DataFrame:
    path, i, o = F.col("file_path"), F.col("indegree"), F.col("outdegree")
    words = keywords.split()
    total = i + o
    scores = {"outdegree": o, "indegree": i, "sum": total, "outdegree_entry": o + F.when(F.col("is_entrypoint"), 100).otherwise(0), "high_fan_in": i, "orchestrator": total, "hotspot": F.col("churn"), "test": F.lit(0)}
    plain = ~P.is_test(path)
    if kind == "leaf":
        order = F.coalesce(*[F.when(F.contains(F.lower(path), F.lit(w)), F.lit(-k)) for k, w in enumerate(words)])
        return signals.where(plain & (i <= 1) & (o <= 2) & order.isNotNull()).select("file_path", order.cast("double").alias("score"))
    if kind == "barrel":
        b = P.basename(path)
        order = F.coalesce(*[F.when(b == n, F.lit(-k)) for k, n in enumerate(BARREL_ORDER)])
        return signals.where(order.isNotNull()).select("file_path", order.cast("double").alias("score"))
    keep = {"test": P.is_test(path), "high_fan_in": plain & (i > 0), "orchestrator": plain & (i >= 5) & (o >= 5), "hotspot": F.col("churn") > 0}.get(kind)
    if keep is None:
        keep = plain & F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(F.lower(path), w))
    return signals.where(keep).select("file_path", scores[kind].cast("double").alias("score"))


def archetypes(signals: DataFrame) -> list[tuple[str, str]]:
    """(archetype, file): each detector in turn claims its best file not claimed before.
    ``signals`` has churn as well.  The claims are a chain of 18 top-1 queries over one
    scan: each detector's first 18 files are enough, whatever the earlier ones claimed."""
    per = [_candidates(signals, words, kind).orderBy(F.desc("score"), "file_path").limit(len(ARCHETYPES)).withColumn("k", F.lit(k)) for k, (_, words, kind) in enumerate(ARCHETYPES)]
    every = per[0]
    for p in per[1:]:
        every = every.unionByName(p)
    best: dict[int, list] = {}
    for r in every.collect():
        best.setdefault(r["k"], []).append((-r["score"], r["file_path"]))
    out, used = [], set()
    for k, (name, _, _) in enumerate(ARCHETYPES):
        free = [f for _, f in sorted(best.get(k, [])) if f not in used]
        if free:
            used.add(free[0])
            out.append((name, free[0]))
    return out


def letter(score: Column) -> Column:
    return F.when(score >= 3.5, "A").when(score >= 2.5, "B").when(score >= 1.5, "C").otherwise("D")


def grade(files: DataFrame) -> DataFrame:
    """Adds the section grades, overall and letter to one row per analysed file with
    confidence, symbol_rate, direction_rate, inverted, n_must; n_likely, single_tier,
    signal_types; n_tests, n_direct, test_reason; n_related, informative; blast_level, blast_detail."""
    c = F.col
    off = lambda cond, v: F.when(cond, F.lit(v)).otherwise(F.lit(0.0))
    clip = lambda x: F.greatest(F.lit(1.0), F.least(F.lit(4.0), x))
    must = clip(4.0 - F.when(c("confidence") < 0.8, 1.0).when(c("confidence") < 0.95, 0.5).otherwise(0.0) - off(c("symbol_rate") < 0.3, 0.5) - off(c("direction_rate") < 0.5, 0.5) - off((c("n_must") >= 3) & c("inverted"), 0.5))
    likely = F.when(c("n_likely") == 0, 3.0).otherwise(clip(4.0 - off((c("n_likely") >= 3) & c("single_tier"), 0.5) - off((c("n_likely") >= 3) & (c("signal_types") < 2), 0.5)))
    tests = F.when(c("n_tests") == 0, F.when(c("test_reason") == "is_test", 4.0).when(c("test_reason") == "no_tests_nearby", 3.0).otherwise(2.0)).otherwise(clip(4.0 - off(c("n_direct") == 0, 1.0) - off((c("n_tests") >= 2) & (c("n_direct") == 0), 0.5)))
    related = F.when(c("n_related") == 0, 2.5).otherwise(clip(4.0 - off((c("n_related") >= 3) & ~c("informative"), 0.5)))
    level = c("blast_level")
    blast = F.when(level.isNull(), 1.0).otherwise(clip(4.0 - off(~level.isin("high", "medium", "low"), 2.0) - off(c("blast_detail") == "", 1.0) - off((level == "high") & (c("n_likely") < 3), 0.5) - off((level == "low") & (c("n_likely") > 10), 0.5)))
    x = files.withColumns({"g_must_read": must, "g_likely_modify": likely, "g_tests": tests, "g_related": related, "g_blast": blast})
    overall = sum((F.col(g) * w for g, w in zip(("g_must_read", "g_likely_modify", "g_tests", "g_related", "g_blast"), WEIGHTS, strict=True)), F.lit(0.0))
    return x.withColumn("overall", overall).withColumn("letter", letter(F.col("overall")))


def section_averages(graded: DataFrame) -> DataFrame:
    return graded.agg(*[F.avg(f"g_{s}").alias(s) for s in ("must_read", "likely_modify", "tests", "related", "blast")], F.avg("overall").alias("overall"))


def tier_counts(likely: DataFrame) -> DataFrame:
    """(subject, high, medium, low, signal_types) of likely_modify rows with ``signals``."""
    n = lambda t: F.count(F.when(F.col("confidence") == t, 1)).alias(t)
    kinds = F.size(F.array_distinct(F.flatten(F.collect_set(F.transform("signals", lambda s: F.split(s, ":")[0])))))
    return likely.groupBy("subject").agg(n("high"), n("medium"), n("low"), kinds.alias("signal_types"))


def recall(expected: Column, actual: Column) -> Column:
    return F.when(F.size(expected) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(expected, actual)) / F.size(F.array_distinct(expected)))


def precision(expected: Column, actual: Column) -> Column:
    return F.when(F.size(actual) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(expected, actual)) / F.size(F.array_distinct(actual)))


def compare(fixtures: DataFrame, results: DataFrame) -> DataFrame:
    """Golden comparison of arrays by subject: rates, violations and whether all thresholds hold."""
    r = results.select("subject", *[F.col(c).alias(f"got_{c}") for c in ("must_read", "likely_modify", "related", "tests", "external", "stable")])
    x = fixtures.join(r, "subject")
    e = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>"))
    near = F.array_union("got_related", "got_likely_modify")
    every = F.array_union(F.array_union("got_must_read", near), F.col("got_tests"))
    pairs = F.zip_with(e("must_read_ordered"), F.slice(e("must_read_ordered"), 2, 1 << 20), lambda a, b: F.array_position("got_must_read", a) > F.array_position("got_must_read", b))
    x = x.select(
        "subject",
        recall(e("must_read"), F.col("got_must_read")).alias("must_read_recall"),
        precision(e("must_read"), F.col("got_must_read")).alias("must_read_precision"),
        recall(e("related"), near).alias("related_recall"),
        recall(e("tests"), F.col("got_tests")).alias("tests_recall"),
        recall(e("external"), F.col("got_external")).alias("external_recall"),
        (F.size(F.array_intersect(e("must_read_forbidden"), "got_must_read")) + F.size(F.array_intersect(e("related_forbidden"), near))).alias("forbidden"),
        F.size(F.array_intersect(e("ignore_must_contain"), every)).alias("not_ignored"),
        F.size(F.array_except(e("expect_stable"), "got_stable")).alias("not_stable"),
        F.size(F.filter(pairs, lambda b: b)).alias("disordered"),
    )
    ok = (F.col("must_read_recall") >= 0.95) & (F.col("must_read_precision") >= 0.8) & (F.col("related_recall") >= 0.8) & (F.col("tests_recall") >= 0.8) & (F.col("external_recall") >= 1.0)
    return x.withColumn("passed", ok & (F.col("forbidden") + F.col("not_ignored") + F.col("not_stable") + F.col("disordered") == 0))
