"""Source trees as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferngraph.functions import paths as P


def _empty_files(spark: SparkSession, base: str) -> list[str]:
    """Files of length 0, which Spark's file sources leave out; listed by the file system's own API."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(base)
    it = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(path, True)
    out = []
    while it.hasNext():
        f = it.next()
        if f.getLen() == 0:
            out.append(f.getPath().toUri().getPath())
    return out


def scan(spark: SparkSession, root: str, ignore: list[str] | None = None) -> DataFrame:
    """(path, language, content_hash, size_bytes, last_modified, content) of supported files.
    Path filters come before the content is read."""
    base = root.rstrip("/")
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
    none = [(p, bytearray()) for p in _empty_files(spark, base)]
    empty = spark.createDataFrame(none, "path string, content binary").select("path", F.lit(0).cast("timestamp").alias("modificationTime"), F.lit(0).cast("long").alias("length"), "content")
    raw = raw.select("path", "modificationTime", "length", "content").unionByName(empty)
    plain = F.regexp_replace(F.col("path"), "^[a-z]+:/+", "/")
    start = base.split("://", 1)[-1].rstrip("/")
    start = start if start.startswith("/") else "/" + start
    x = raw.withColumn("path", F.substring(plain, len(start) + 2, 1 << 30))
    x = x.where(P.is_supported(F.col("path")) & ~P.is_skipped(F.col("path")) & ~P.has_prefix(F.col("path"), ignore or []))
    return x.select("path", P.language(F.col("path")).alias("language"), F.sha2("content", 256).alias("content_hash"), F.col("length").alias("size_bytes"), F.unix_seconds("modificationTime").alias("last_modified"), "content")


def scan_paths(tree: DataFrame, wanted: DataFrame) -> DataFrame:
    return tree.join(wanted.select("path").distinct(), "path", "left_semi")


def contents(tree: DataFrame) -> DataFrame:
    """(path, text)."""
    return tree.select("path", F.decode("content", "UTF-8").alias("text"))


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, change): added, modified or removed between two listings, by content hash."""
    o, n = old.select("path", F.col("content_hash").alias("o")), new.select("path", F.col("content_hash").alias("n"))
    kind = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").when(F.col("o") != F.col("n"), "modified")
    return o.join(n, "path", "full").select("path", kind.alias("change")).where("change IS NOT NULL")


def fixtures(spark: SparkSession, folder: str) -> DataFrame:
    """Golden expectation records, one JSON object per file."""
    arrays = "must_read must_read_forbidden must_read_ordered related related_forbidden tests ignore_must_contain external expect_stable"
    schema = "subject string, " + ", ".join(f"{a} array<string>" for a in arrays.split())
    return spark.read.schema(schema).json(folder, multiLine=True)
