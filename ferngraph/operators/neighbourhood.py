"""Bounded neighbourhoods of many subjects at once, and cycles through them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ferngraph.functions import paths as P
from ferngraph.session import written

SIBLINGS = 10


def adjacency(edges: DataFrame) -> DataFrame:
    """(node, path, is_import, is_importer): both directions of the distinct edges."""
    e = edges.select("src_file", "dst_file").distinct()
    both = e.select(F.col("src_file").alias("node"), F.col("dst_file").alias("path"), F.lit(True).alias("is_import"), F.lit(False).alias("is_importer")).unionByName(
        e.select(F.col("dst_file").alias("node"), F.col("src_file").alias("path"), F.lit(False).alias("is_import"), F.lit(True).alias("is_importer"))
    )
    return both.groupBy("node", "path").agg(F.max("is_import").alias("is_import"), F.max("is_importer").alias("is_importer"))


def direct(subjects: DataFrame, edges: DataFrame) -> DataFrame:
    """(subject, path, is_import, is_importer) of the direct neighbours, without the subject."""
    u = adjacency(edges)
    return subjects.select("subject").distinct().join(u, F.col("subject") == F.col("node")).where("path <> subject").select("subject", "path", "is_import", "is_importer")


def expand(frontier: DataFrame, edges: DataFrame, exclude: DataFrame, forward: bool = True) -> DataFrame:
    """(subject, path) of the frontier's imports (or importers) that ``exclude`` lacks."""
    a, b = ("src_file", "dst_file") if forward else ("dst_file", "src_file")
    e = edges.select(F.col(a).alias("_from"), F.col(b).alias("_to")).distinct()
    x = frontier.join(e, F.col("path") == F.col("_from")).select("subject", F.col("_to").alias("path")).distinct()
    return x.join(exclude, ["subject", "path"], "left_anti")


def collect(subjects: DataFrame, edges: DataFrame) -> DataFrame:
    """(subject, path, distance, is_import, is_importer, is_transitive): two hops in both
    directions, importers of importing barrels (transitive), and tests that import a near
    file.  A subject is part of its own neighbourhood at distance 0."""
    flags = lambda df, d, t=False: df.withColumns({c: F.lit(False) for c in ("is_import", "is_importer") if c not in df.columns}).withColumns({"distance": F.lit(d), "is_transitive": F.lit(t)})
    zero = subjects.select("subject", F.col("subject").alias("path")).distinct()
    one = direct(subjects, edges)
    near = zero.unionByName(one.select("subject", "path"))
    u = adjacency(edges).select("node", F.col("path").alias("_to"))
    two = near.join(u, F.col("path") == F.col("node")).select("subject", F.col("_to").alias("path")).distinct().join(near, ["subject", "path"], "left_anti")
    barrels = one.where("is_importer").where(P.is_barrel(F.col("path"))).select("subject", "path")
    pierced = expand(barrels, edges, near, forward=False)
    plain = near.where(~P.is_test(F.col("path")))
    tests = expand(plain, edges, near, forward=False).where(P.is_test(F.col("path")))
    every = flags(zero, 0).unionByName(flags(one, 1)).unionByName(flags(two, 2)).unionByName(flags(pierced, 2, True)).unionByName(flags(tests, 2))
    return every.groupBy("subject", "path").agg(F.min("distance").alias("distance"), *[F.max(c).alias(c) for c in ("is_import", "is_importer", "is_transitive")])


def induced(members: DataFrame, edges: DataFrame) -> DataFrame:
    """(subject, src_file, dst_file): edges with both ends in a subject's set (subject, path)."""
    a = members.select("subject", F.col("path").alias("src_file"))
    b = members.select("subject", F.col("path").alias("dst_file"))
    return edges.select("src_file", "dst_file").distinct().join(a, "src_file").join(b, ["subject", "dst_file"]).select("subject", "src_file", "dst_file")


def siblings(subjects: DataFrame, files: DataFrame, known: DataFrame | None = None, limit: int = SIBLINGS) -> DataFrame:
    """(subject, path, prefix_match, package_size): files of the subject's directory and
    extension, not tests, at most ``limit``: those that share its first name part come first;
    in packages of more than 20 files only those."""
    s = subjects.select("subject", P.dirname(F.col("subject")).alias("_dir"), P.extension(F.col("subject")).alias("_ext"), F.split(P.stem(F.col("subject")), "_")[0].alias("_first"))
    f = files.select("path", P.dirname(F.col("path")).alias("_dir"), P.extension(F.col("path")).alias("_ext")).where(~P.is_test(F.col("path")))
    size = f.groupBy("_dir", "_ext").agg(F.count("*").alias("package_size"))
    x = s.join(f, ["_dir", "_ext"]).where("path <> subject").join(size, ["_dir", "_ext"])
    match = F.split(P.stem(F.col("path")), "_")[0] == F.col("_first")
    x = x.select("subject", "path", match.alias("prefix_match"), "package_size").where("package_size <= 20 OR prefix_match")
    if known is not None:
        x = x.join(known, ["subject", "path"], "left_anti")
    w = W.partitionBy("subject").orderBy(F.desc("prefix_match"), "path")
    return x.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def has_evidence(is_import, is_importer, co_change, prefix_match):
    """Whether a same-package file stays: an edge, two co-changes or a name in common."""
    return is_import | is_importer | (co_change >= 2) | prefix_match


def tests_in_dir(dirs: DataFrame, files: DataFrame, suffix: str, recursive: bool = False) -> DataFrame:
    """(dir, path) of files below (or directly in) each dir that end with ``suffix``."""
    f = files.select("path").where(F.col("path").endswith(suffix))
    if not recursive:
        return dirs.join(f.withColumn("dir", P.dirname(F.col("path"))), "dir").select("dir", "path")
    # every ancestor is a key, so the prefix join is an equi-join
    parts = F.split("path", "/")
    ups = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    deep = f.where(F.instr("path", "/") > 0).select("path", F.explode(ups).alias("dir"))
    return dirs.join(deep, "dir").select("dir", "path")


def files_by_name(names: DataFrame, files: DataFrame) -> DataFrame:
    """(name, path): files of the given base names anywhere."""
    return names.join(files.select("path", P.basename(F.col("path")).alias("name")), "name").select("name", "path")


def cycles(subjects: DataFrame, edges: DataFrame, depth: int = 6, limit: int = 5) -> DataFrame:
    """(subject, cycle): the first ``limit`` simple cycles through each subject of at most
    ``depth`` files, by path order.  Each round prunes paths to nodes from which the subject
    can still be reached in time, so hubs off every cycle are not expanded."""
    # each round's frontier is a table of its own: later rounds read it several times
    e = written(edges.select("src_file", "dst_file").where("src_file <> dst_file").distinct(), "edges")
    step = written(subjects.select("subject", F.col("subject").alias("node"), F.lit(0).alias("left")).distinct(), "reach")
    reach = step
    for k in range(1, depth):
        step = step.join(e, F.col("node") == F.col("dst_file")).select("subject", F.col("src_file").alias("node")).distinct().join(reach, ["subject", "node"], "left_anti")
        step = written(step.withColumn("left", F.lit(k)), "reach")
        reach = reach.unionByName(step)
    live = subjects.select("subject", F.array("subject").alias("path"), F.col("subject").alias("node")).distinct()
    found = None
    for k in range(1, depth + 1):
        grown = live.join(e, F.col("node") == F.col("src_file")).select("subject", "path", F.col("dst_file").alias("node"))
        closed = grown.where("node = subject").select("subject", F.concat("path", F.array("node")).alias("cycle"))
        found = closed if found is None else found.unionByName(closed)
        if k < depth:
            open_ = grown.where(~F.array_contains("path", F.col("node"))).join(reach.where(F.col("left") <= depth - k), ["subject", "node"])
            live = open_.select("subject", F.concat("path", F.array("node")).alias("path"), "node")
    w = W.partitionBy("subject").orderBy("cycle")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def participants(found: DataFrame) -> DataFrame:
    return found.select("subject", F.explode("cycle").alias("path")).distinct()
