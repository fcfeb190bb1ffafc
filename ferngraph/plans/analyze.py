"""Analysis plan: every subject's sections, signals and blast radius in one job."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferngraph.functions import names
from ferngraph.functions import paths as P
from ferngraph.operators import change, neighbourhood, ranking
from ferngraph.plans.index import Index
from ferngraph.session import ship, written

SIBLING_LANGUAGES = ("go", "java", "rust", "csharp")


def candidates(subjects: DataFrame, ix: Index) -> DataFrame:
    """The neighbourhood with the package rules: same-package siblings (Go, Java, Rust, C#) come
    at distance 1, tests guessed by name at distance 2 (Go's own directory: 1); a sibling stays
    only with evidence."""
    near = neighbourhood.collect(subjects, ix.edges)
    own = subjects.where(P.language(F.col("subject")).isin(*SIBLING_LANGUAGES))
    same = neighbourhood.siblings(own, ix.files, None).select("subject", "path", F.lit(True).alias("same_package"), "prefix_match", (F.col("package_size") <= 20).alias("small_package"))

    @F.udf("array<string>")
    def guesses(path):
        return names.test_names(path)

    guess = subjects.select("subject", F.explode(guesses("subject")).alias("name"))
    tests = guess.join(ix.files.select("path", P.basename(F.col("path")).alias("name")), "name").where("path <> subject").where(P.is_test(F.col("path"))).select("subject", "path").distinct()
    go = F.col("path").endswith(".go") & (P.dirname(F.col("path")) == P.dirname(F.col("subject")))
    tests = tests.withColumn("distance", F.when(go, 1).otherwise(2))
    no = {c: F.lit(False) for c in ("is_import", "is_importer", "is_transitive", *ranking.PACKAGE_FLAGS)}
    every = near.withColumns({c: F.lit(False) for c in ranking.PACKAGE_FLAGS})
    every = every.unionByName(same.withColumns({"distance": F.lit(1), **{c: no[c] for c in ("is_import", "is_importer", "is_transitive")}}))
    every = every.unionByName(tests.withColumns(no))
    flags = ("is_import", "is_importer", "is_transitive", *ranking.PACKAGE_FLAGS)
    x = every.groupBy("subject", "path").agg(F.min("distance").alias("distance"), *[F.max(c).alias(c) for c in flags])
    x = ranking.enrich(x, ix.signals, ix.churn, ix.pairs)
    keep = ~F.col("same_package") | neighbourhood.has_evidence(F.col("is_import"), F.col("is_importer"), F.col("co_change"), F.col("prefix_match"))
    return x.where(keep)


def select_tests(sections: DataFrame, caps: ranking.Caps, fallback: int = 2) -> DataFrame:
    """The tests of each subject: direct ones by name and place, then at most two others with
    history or near a must_read file; without direct ones, up to ``fallback`` of the subject's
    own directory."""

    @F.udf("boolean")
    def direct(subject, path):
        return names.is_direct_test(subject, path)

    must = sections.where("section = 'must_read'").groupBy("subject").agg(F.collect_set(P.dirname(F.col("path"))).alias("dirs"), F.collect_set(F.substring_index(P.basename(F.col("path")), ".", 1)).alias("stems"))
    t = sections.where("section = 'tests'").join(must, "subject", "left").withColumn("direct", direct("subject", "path"))
    folder = F.regexp_replace(P.dirname(F.col("path")), "/(__tests__|tests)$", "")
    stem = F.regexp_replace(F.substring_index(P.basename(F.col("path")), ".", 1), "^test_|_test$", "")
    linked = (F.col("co_change") > 0) | F.array_contains("dirs", folder) | F.array_contains("stems", stem)
    from pyspark.sql import Window as W

    t = t.withColumns({"has": F.max("direct").over(W.partitionBy("subject")), "linked": F.coalesce(linked, F.lit(False)), "same": P.dirname(F.col("path")) == P.dirname(F.col("subject"))})
    t = t.where(F.col("direct") | (F.col("has") & F.col("linked")) | (~F.col("has") & F.col("same")))
    w = W.partitionBy("subject", "direct").orderBy(F.desc("score"), "path")
    t = t.withColumn("k", F.row_number().over(w)).where(F.col("direct") | (F.col("k") <= fallback))
    w = W.partitionBy("subject").orderBy(F.desc("direct"), F.desc("score"), "path")
    return t.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= caps.tests)


def in_order(sections: DataFrame, ix: Index) -> DataFrame:
    """(subject, path, rank): must_read files after what they import.  A subject's list is
    capped, so one small Python call each."""
    m = sections.where("section = 'must_read'").select("subject", "path", "score", "outdegree", "rank")
    inner = neighbourhood.induced(m, ix.edges).groupBy("subject").agg(F.collect_set(F.struct("src_file", "dst_file")).alias("edges"))
    lists = m.groupBy("subject").agg(F.sort_array(F.collect_list(F.struct("rank", "path", "score", "outdegree"))).alias("nodes")).join(inner, "subject", "left")
    ship(m.sparkSession)

    def run(batches):
        for b in batches:
            out = []
            for s, nodes, edges in zip(b["subject"], b["nodes"], b["edges"], strict=True):
                order = names.topological([(n["path"], n["score"], n["outdegree"]) for n in nodes], [(e["src_file"], e["dst_file"]) for e in (edges if edges is not None else [])])
                out += [(s, p, k + 1) for k, p in enumerate(order)]
            yield pd.DataFrame(out, columns=["subject", "path", "rank"])

    return lists.mapInPandas(run, "subject string, path string, rank long")


def analyze(subjects: DataFrame, ix: Index, caps: ranking.Caps = ranking.Caps(), ignore: list[str] | None = None, generated: list[str] | None = None) -> dict[str, DataFrame]:  # noqa: B008
    """``sections`` (long form), ``tests``, ``must_read`` in reading order, ``cycles``,
    ``hidden`` coupling and ``summary`` (one row per subject)."""
    top = ix.signals.agg(F.coalesce(F.max("indegree"), F.lit(0)).alias("max_indegree"))
    near = written(candidates(subjects, ix), "candidates")
    found = ranking.sections(ranking.score(near, top), caps, ignore, generated)
    stable = top.select(ranking.stable_threshold(F.col("max_indegree")).alias("_stable"))
    found = found.crossJoin(F.broadcast(stable))
    found = found.withColumns({"direction": ranking.direction(), "signals": ranking.signal_strings(F.col("_stable")), "stable": F.col("indegree") >= F.col("_stable"), "group": P.group_key(F.col("path"))})
    found = found.withColumn("role", P.role(F.col("path"), F.col("indegree"), F.col("outdegree"), F.col("is_entrypoint"), F.col("is_utility"), F.col("stable"))).drop("_stable")
    loops = written(neighbourhood.cycles(subjects, ix.edges), "cycles")
    on_loop = neighbourhood.participants(loops).withColumn("circular", F.lit(True))
    found = found.join(on_loop, ["subject", "path"], "left").fillna(False, ["circular"])
    # files on a cycle with the subject count as more likely
    found = found.withColumns({"signals": F.when(F.col("circular"), F.array_append("signals", F.lit("circular"))).otherwise(F.col("signals")), "confidence": F.when(F.col("circular") & (F.col("confidence") == "low"), "medium").otherwise(F.col("confidence"))})
    found = written(found, "sections")
    tests = written(select_tests(found, caps), "tests")
    like = found.where("section = 'likely_modify'").groupBy("subject").agg(F.max("total").alias("total_likely"), F.count("*").alias("n_likely"), F.count(F.when((F.col("confidence") == "low") & (F.col("distance") >= 2), 1)).alias("low_far"))
    rel = found.where("section = 'related'").groupBy("subject").agg(F.count("*").alias("n_related"), F.max("total").alias("total_related"))
    nt = tests.groupBy("subject").agg(F.count("*").alias("n_tests"), F.max("direct").alias("has_direct"))
    importers = neighbourhood.direct(subjects, ix.edges).groupBy("subject").agg(F.count(F.when(F.col("is_importer") & ~F.col("is_import"), 1)).alias("importers"), F.count(F.when(F.col("is_importer") & F.col("is_import"), 1)).alias("mutual"))
    nc = loops.groupBy("subject").agg(F.count("*").alias("n_cycles"))
    from ferngraph.operators.signals import confidence_note, resolution

    rate = resolution(ix.edges, ix.unresolved).withColumnRenamed("path", "subject")
    s = subjects.select("subject").distinct()
    for part in (like, rel, nt, importers, nc, rate, ix.signals.withColumnRenamed("file_path", "subject")):
        s = s.join(part, "subject", "left")
    s = s.fillna(0, ["total_likely", "n_likely", "low_far", "n_related", "total_related", "n_tests", "importers", "mutual", "n_cycles", "resolved", "not_found", "indegree", "outdegree"]).fillna(1.0, ["confidence"]).fillna(False, ["has_direct"])
    fragility = ranking.fragility(F.col("indegree"), F.col("outdegree"))
    level = ranking.blast(F.col("total_likely"), F.col("low_far"), F.col("importers"), P.is_test(F.col("subject")), caps.likely_modify, F.col("n_cycles"))
    s = s.withColumns({"fragility": fragility, "blast_level": level, "confidence_note": confidence_note(F.col("resolved"), F.col("not_found"))})
    detail = F.concat(
        F.format_string("%d of %d likely_modify, %d of %d related, %d tests", "n_likely", "total_likely", "n_related", "total_related", "n_tests"),
        F.when(F.col("fragility") >= 0.7, F.format_string(", fragility %.2f", "fragility")).otherwise(""),
        F.when(F.col("n_cycles") > 0, F.format_string(", %d circular dep(s)", "n_cycles")).otherwise(""),
    )
    s = s.withColumn("blast_detail", detail)
    note = lambda n, total, cap: F.when(F.col(total) > cap, F.format_string("showing %d of %d", n, total))
    s = s.withColumns({"likely_note": note("n_likely", "total_likely", caps.likely_modify), "related_note": F.when(F.col("total_related") >= caps.related, F.format_string("showing %d of %d", "n_related", "total_related"))})
    out = {"sections": found, "tests": tests, "must_read": in_order(found, ix), "cycles": loops, "summary": s}
    if ix.pairs is not None:
        out["hidden"] = change.hidden_coupling(subjects.select(F.col("subject").alias("path")), ix.pairs, near.select("subject", "path"), ix.files)
    return out


def merge_subjects(sections: DataFrame, order: DataFrame, caps: ranking.Caps) -> DataFrame:
    """One list per section over several subjects (subject, ord): by first appearance, capped."""
    from pyspark.sql import Window as W

    x = sections.join(F.broadcast(order), "subject").groupBy("section", "path").agg(F.min(F.struct("ord", "rank")).alias("at"))
    x = x.join(order.select(F.col("subject").alias("path")), "path", "left_anti")
    cap = F.when(F.col("section") == "must_read", caps.must_read).when(F.col("section") == "likely_modify", caps.likely_modify).when(F.col("section") == "related", caps.related).otherwise(caps.tests)
    w = W.partitionBy("section").orderBy("at", "path")
    return x.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= cap).select("section", "rank", "path")


def documents(result: dict[str, DataFrame]) -> DataFrame:
    """(subject, json): one JSON document per subject, sections grouped by package."""
    entry = F.struct("rank", "path", "confidence", "signals", "direction", "role", "stable")
    g = result["sections"].where("section <> 'tests'").groupBy("subject", "section", "group").agg(F.sort_array(F.collect_list(entry)).alias("entries"))
    g = g.groupBy("subject", "section").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("group", "entries")))).alias("groups"))
    g = g.groupBy("subject").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("section", F.to_json("groups").alias("groups"))))).alias("sections"))
    s = result["summary"]
    return s.join(g, "subject", "left").select("subject", F.to_json(F.struct("subject", "confidence", "confidence_note", "blast_level", "blast_detail", "fragility", "sections")).alias("json"))
