"""Session helpers shared by every part of the package."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructField, StructType

_PACKAGE = os.path.dirname(os.path.abspath(__file__))


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that Python
    workers can import it wherever they run."""
    sc = spark.sparkContext
    name = f"ferngraph-{sc.applicationId}.zip"
    if any(os.path.basename(f) == name for f in sc.listFiles):
        return
    path = os.path.join(tempfile.mkdtemp(), name)
    with zipfile.ZipFile(path, "w") as z:
        for d, _, files in os.walk(_PACKAGE):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(d, f)
                    z.write(full, os.path.join("ferngraph", os.path.relpath(full, _PACKAGE)))
    sc.addPyFile(path)


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder below spark.checkpoint.dir, which driver and executors share.

    Only on one machine (tests), where that setting is absent, is a folder of our own used.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.conf.get("spark.master", "local")
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "ferngraph-shared")
    return f"{base.rstrip('/')}/ferngraph-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sorted_join(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that is never sent to the driver and broadcast.  Files of like
    paths are many times smaller than their rows, so Spark takes large tables for small ones."""
    return df.hint("merge")


def extended(df: DataFrame, skip: int, ddl: str) -> StructType:
    """The schema of ``df`` without its first ``skip`` columns, and the columns of ``ddl``."""
    own = [StructField(f.name, f.dataType, True) for f in df.schema.fields[skip:]]
    return StructType([*own, *StructType.fromDDL(ddl).fields])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
