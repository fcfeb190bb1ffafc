"""The engine's tables as parquet folders with fixed schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

VERSION = 1
# Fixed schemas.
SCHEMAS = {
    "meta": "key string, value string",
    "files": "path string, content_hash string, last_modified long, language string, size_bytes long",
    "edges": "src_file string, dst_file string, edge_type string, specifier string, resolution_method string, line_number long, imported_names array<string>",
    "signals": "file_path string, indegree long, outdegree long, is_entrypoint boolean, is_utility boolean",
    "unresolved": "src_file string, specifier string, reason string, line_number long",
    "package_roots": "path string, detection_method string, language string",
    "git_signals": "file_path string, signal_type string, value double, window_days int, computed_at timestamp",
    "co_change_pairs": "file_a string, file_b string, frequency long, window_days int, computed_at timestamp",
    "analysis_runs": "id long, created_at timestamp, ref_range string, commit_sha string, branch string, total_files long, blast_level string, blast_detail string, fragility double, high_risk long, test_gaps long, coupling long, hotspots long, report_json string",
    "file_risks": "id long, run_id long, file_path string, status string, blast_level string",
    "hotspot_history": "id long, run_id long, file_path string",
    "usage_log": "id long, created_at timestamp, source string, tool string, files_analyzed array<string>, file_count long, must_read_count long, likely_modify_count long, test_count long, blast_level string, confidence double, response_tokens long, duration_ms long, mode string, token_budget long",
    "feedback": "id long, created_at timestamp, usage_id long, file_path string, usefulness int, useful_files array<string>, unnecessary_files array<string>, missing_files array<string>, modified_files array<string>, notes string",
    "risk_scores": "id long, created_at timestamp, file_path string, risk_score int, score_version int, ref_range string",
}


class Store:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def read(self, name: str) -> DataFrame:
        """A table; an empty one where nothing was written yet."""
        try:
            return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.folder}/{name}")
        except AnalysisException:
            return self.spark.createDataFrame([], SCHEMAS[name])

    def _fit(self, name: str, df: DataFrame) -> DataFrame:
        want = self.spark.createDataFrame([], SCHEMAS[name]).schema
        return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in want])

    def replace(self, name: str, df: DataFrame) -> None:
        """Overwrite a table; the rows are written aside first, for they may come from it."""
        from ferngraph.session import written

        self._fit(name, written(self._fit(name, df), name)).write.mode("overwrite").parquet(f"{self.folder}/{name}")

    def append(self, name: str, df: DataFrame) -> None:
        self._fit(name, df).write.mode("append").parquet(f"{self.folder}/{name}")

    def upsert(self, name: str, df: DataFrame, keys: list[str]) -> None:
        self.replace(name, self.read(name).join(df.select(*keys), keys, "left_anti").unionByName(self._fit(name, df)))

    def delete(self, paths: DataFrame) -> None:
        """Drop files (path) and all their edges, unresolved imports and signals."""
        drop = {"files": ["path"], "edges": ["src_file", "dst_file"], "unresolved": ["src_file"], "signals": ["file_path"]}
        for name, columns in drop.items():
            x = self.read(name)
            for c in columns:
                x = x.join(paths.select(F.col("path").alias(c)), c, "left_anti")
            self.replace(name, x)

    def clear(self, *names: str) -> None:
        for n in names or SCHEMAS:
            self.spark.createDataFrame([], SCHEMAS[n]).write.mode("overwrite").parquet(f"{self.folder}/{n}")

    def meta(self) -> dict[str, str]:
        return {r["key"]: r["value"] for r in self.read("meta").collect()}

    def set_meta(self, **values: str) -> None:
        self.upsert("meta", self.spark.createDataFrame(list(values.items()), SCHEMAS["meta"]), ["key"])

    def migrate(self) -> bool:
        """Whether the version was old, so that all tables were cleared for a full rebuild."""
        if self.meta().get("schema_version") == str(VERSION):
            return False
        self.clear()
        self.set_meta(schema_version=str(VERSION))
        return True
