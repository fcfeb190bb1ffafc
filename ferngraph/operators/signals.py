"""Structural and history signals of files: degrees, churn, co-change, edge merging."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ferngraph.functions import paths as P
from ferngraph.session import sorted_join

MAX_COMMIT_FILES = 100
WINDOW_DAYS = 90


def degree_signals(files: DataFrame, edges: DataFrame, entrypoints: list[str] | None = None) -> DataFrame:
    """(file_path, indegree, outdegree, is_entrypoint, is_utility) of every file.

    Only source files count as importers; targets count from all.  Both counts aggregate
    distinct pairs map-side before their one shuffle each.
    """
    pairs = edges.select("src_file", "dst_file").distinct()
    ind = pairs.where(~P.is_non_source(F.col("src_file"))).groupBy(F.col("dst_file").alias("file_path")).agg(F.count("*").alias("indegree"))
    out = pairs.groupBy(F.col("src_file").alias("file_path")).agg(F.count("*").alias("outdegree"))
    x = files.select(F.col("path").alias("file_path")).join(sorted_join(ind), "file_path", "left").join(sorted_join(out), "file_path", "left")
    i, o = F.coalesce("indegree", F.lit(0)), F.coalesce("outdegree", F.lit(0))
    entry = (i == 0) & ~P.is_init(F.col("file_path"))
    if entrypoints:
        entry = entry | F.col("file_path").isin(*entrypoints)
    return x.select("file_path", i.cast("long").alias("indegree"), o.cast("long").alias("outdegree"), entry.alias("is_entrypoint"), ((o >= 5) & (i <= 2)).alias("is_utility"))


def merge_edges(rows: DataFrame, order: str = "line_number") -> DataFrame:
    """One row per (src_file, dst_file, specifier): its first line and the distinct names by
    first appearance.  ``rows`` has name (one per row)."""
    first = rows.groupBy("src_file", "dst_file", "specifier", "name").agg(F.min(order).alias("at"))
    names = F.transform(F.sort_array(F.collect_list(F.struct("at", "name"))), lambda s: s["name"])
    return first.groupBy("src_file", "dst_file", "specifier").agg(F.min("at").alias("line_number"), F.array_compact(names).alias("imported_names"))


def first_unresolved(rows: DataFrame) -> DataFrame:
    """One row per (src_file, specifier): the first by line, then reason."""
    best = F.min(F.struct("line_number", "reason")).alias("b")
    return rows.groupBy("src_file", "specifier").agg(best).select("src_file", "specifier", "b.reason", "b.line_number")


def in_window(commits: DataFrame, ts: str = "ts", days: int = WINDOW_DAYS) -> DataFrame:
    """The commits of the last ``days`` days before the newest one."""
    head = commits.agg(F.max(ts).alias("_head"))
    return commits.join(F.broadcast(head), F.col(ts) >= F.col("_head") - F.expr(f"INTERVAL {int(days)} DAYS")).drop("_head")


def commit_files(commits: DataFrame, max_files: int = MAX_COMMIT_FILES) -> DataFrame:
    """(hash, file) of the commits of at most ``max_files`` files, from (hash, ts, files)."""
    return commits.where(F.size("files") <= max_files).select("hash", F.explode(F.array_distinct("files")).alias("file"))


def churn(pairs: DataFrame) -> DataFrame:
    """(file_path, value): commits per file."""
    return pairs.groupBy(F.col("file").alias("file_path")).agg(F.count("*").alias("value"))


def co_change(pairs: DataFrame) -> DataFrame:
    """(file_a, file_b, frequency), file_a < file_b.  Pairs are made within one commit's
    array, which MAX_COMMIT_FILES bounds, so the join is a map-side expansion."""
    files = pairs.groupBy("hash").agg(F.sort_array(F.collect_set("file")).alias("f"))
    made = files.select(F.posexplode("f").alias("i", "file_a"), "f").select("file_a", F.explode(F.expr("slice(f, i + 2, size(f))")).alias("file_b"))
    return made.groupBy("file_a", "file_b").agg(F.count("*").alias("frequency"))


def symmetric(pairs: DataFrame) -> DataFrame:
    """(path, partner, frequency) from either side of the pairs."""
    return pairs.select(F.col("file_a").alias("path"), F.col("file_b").alias("partner"), "frequency").unionByName(
        pairs.select(F.col("file_b").alias("path"), F.col("file_a").alias("partner"), "frequency")
    )


def top_partners(pairs: DataFrame, limit: int) -> DataFrame:
    w = W.partitionBy("path").orderBy(F.desc("frequency"), "partner")
    return symmetric(pairs).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def top_files(signals: DataFrame, by: list, limit: int, default: int = 10) -> DataFrame:
    """The first ``limit`` (default where it isn't positive) by ``by``, then path."""
    return signals.orderBy(*by, "file_path").limit(limit if limit > 0 else default)


def foundations(signals: DataFrame, limit: int = 10) -> DataFrame:
    return top_files(signals, [F.desc("indegree")], limit)


def entrypoints(signals: DataFrame) -> DataFrame:
    return signals.where("is_entrypoint").orderBy("file_path")


def orchestrators(signals: DataFrame, exclude: DataFrame, limit: int = 10, least: int = 1) -> DataFrame:
    """Files of the highest total degree that both import and are imported, without ``exclude``."""
    x = signals.join(exclude, "file_path", "left_anti").where((F.col("indegree") >= least) & (F.col("outdegree") >= least))
    return top_files(x.withColumn("degree", F.col("indegree") + F.col("outdegree")), [F.desc("degree")], limit)


def package_importers(edges: DataFrame) -> DataFrame:
    """(dir, importers): distinct files outside a directory that import files directly in it."""
    e = edges.select("src_file", P.dirname(F.col("dst_file")).alias("dir"))
    return e.where(P.dirname(F.col("src_file")) != F.col("dir")).distinct().groupBy("dir").agg(F.count("*").alias("importers"))


def resolution(edges: DataFrame, unresolved: DataFrame) -> DataFrame:
    """(path, resolved, not_found, confidence): misses are not_found or own-crate specifiers."""
    ok = edges.groupBy(F.col("src_file").alias("path")).agg(F.count("*").alias("resolved"))
    miss = (F.col("reason") == "not_found") | F.col("specifier").rlike("^(crate|super|self)::")
    bad = unresolved.where(miss).groupBy(F.col("src_file").alias("path")).agg(F.count("*").alias("not_found"))
    x = ok.join(bad, "path", "full").select("path", F.coalesce("resolved", F.lit(0)).alias("resolved"), F.coalesce("not_found", F.lit(0)).alias("not_found"))
    total = F.col("resolved") + F.col("not_found")
    return x.withColumn("confidence", F.when(total > 0, P.floor2(F.col("resolved") / total)).otherwise(F.lit(1.0)))


def confidence_note(resolved, not_found):
    text = F.format_string("%d of %d internal imports unresolved — must_read may be incomplete", not_found, resolved + not_found)
    return F.when(not_found > 0, text)


def symbol_map(edges: DataFrame, by: str = "src_file") -> DataFrame:
    """(path, neighbour, names): sorted distinct imported names without the wildcard."""
    other = "dst_file" if by == "src_file" else "src_file"
    names = F.filter(F.array_sort(F.array_distinct(F.flatten(F.collect_list("imported_names")))), lambda n: n != "*")
    return edges.groupBy(F.col(by).alias("path"), F.col(other).alias("neighbour")).agg(names.alias("names"))


def search_symbol(edges: DataFrame, files: DataFrame, symbol: str, limit: int = 50) -> DataFrame:
    """Files that define an imported symbol."""
    hit = edges.select("dst_file", F.explode("imported_names").alias("n")).where(F.col("n") == symbol).select(F.col("dst_file").alias("path")).distinct()
    return files.join(hit, "path", "left_semi").orderBy("path").limit(limit if limit > 0 else 50)


def exists(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """(path, found) of each wanted path."""
    known = files.select("path").distinct().withColumn("_f", F.lit(True))
    return wanted.select("path").join(known, "path", "left").select("path", F.coalesce("_f", F.lit(False)).alias("found"))


def unresolved_of(unresolved: DataFrame, paths: DataFrame) -> DataFrame:
    """(path, specifier, reason...) of the given files."""
    return unresolved.withColumnRenamed("src_file", "path").join(paths.select("path").distinct(), "path", "left_semi")


def search_path(files: DataFrame, query: str, limit: int = 50) -> DataFrame:
    """Case-insensitive substring search; wildcards of the query have no meaning."""
    return files.where(F.contains(F.lower("path"), F.lit(query.lower()))).orderBy("path").limit(limit if limit > 0 else 50)


def directory_structure(files: DataFrame) -> DataFrame:
    """Files by top-level directory and language with subtotals, in one pass (cube)."""
    x = files.select(F.when(F.instr("path", "/") > 0, F.substring_index("path", "/", 1)).otherwise(".").alias("dir"), "language")
    return x.cube("dir", "language").agg(F.count("*").alias("n"), F.grouping_id().alias("level"))
