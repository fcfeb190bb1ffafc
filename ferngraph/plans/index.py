"""Index plan: source tree and history to the engine's relations."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferngraph.functions import extract, resolve
from ferngraph.operators import signals
from ferngraph.session import sorted_join, written
from ferngraph.sources import tree


@dataclass
class Index:
    files: DataFrame
    edges: DataFrame
    unresolved: DataFrame
    signals: DataFrame
    churn: DataFrame | None = None
    pairs: DataFrame | None = None
    facts: DataFrame | None = None


def build(files: DataFrame, contents: DataFrame, config: resolve.Config, commits: DataFrame | None = None, entrypoints: list[str] | None = None, all_paths: DataFrame | None = None) -> Index:
    """All relations, as tables of the shared folder, from files (path, ...), contents (path, text) and commits (hash, ts, files).
    Churn is kept for indexed files only, pairs for all."""
    return _from_facts(written(extract.facts(contents), "facts"), files, config, commits, entrypoints, all_paths)


def refresh(old: Index, files: DataFrame, contents: DataFrame, config: resolve.Config, commits: DataFrame | None = None, entrypoints: list[str] | None = None, all_paths: DataFrame | None = None) -> Index:
    """The index after a change.  Only files whose content_hash is new are read again; what all
    facts mean is settled anew, as files that came or went may change it."""
    changed = written(tree.changes(old.files, files), "changes")
    again = contents.join(sorted_join(changed.where("change <> 'removed'")), "path", "left_semi")
    facts = old.facts.join(sorted_join(changed), "path", "left_anti").unionByName(extract.facts(again))
    return _from_facts(written(facts, "facts"), files, config, commits, entrypoints, all_paths)


def _from_facts(facts: DataFrame, files: DataFrame, config: resolve.Config, commits: DataFrame | None, entrypoints: list[str] | None, all_paths: DataFrame | None) -> Index:
    rows, lost = resolve.resolve(facts, files, config, all_paths)
    rows = written(rows, "import_rows")
    method = rows.groupBy("src_file", "dst_file", "specifier").agg(F.min("resolution_method").alias("resolution_method"))
    edges = signals.merge_edges(rows).join(sorted_join(method), ["src_file", "dst_file", "specifier"]).withColumn("edge_type", F.lit("import"))
    edges, unresolved = written(edges, "edges"), written(signals.first_unresolved(lost), "unresolved")
    churn = pairs = None
    if commits is not None:
        touched = written(signals.commit_files(signals.in_window(commits)), "touched")
        churn = signals.churn(touched).join(sorted_join(files.select(F.col("path").alias("file_path"))), "file_path", "left_semi")
        churn, pairs = written(churn, "churn"), written(signals.co_change(touched), "pairs")
    return Index(files, edges, unresolved, written(signals.degree_signals(files, edges, entrypoints), "signals"), churn, pairs, facts)
