"""Secret scans over an incremental ledger of blobs.

Every version of a text is addressed by the sha256 of its content.  The ledger holds
the (blob, rule, rule version) triples that were scanned before; a scan takes each
distinct blob once, with just the rules it has not met in their present version, and
joins all findings back to every path that holds the blob.

Defined results: a null text is the empty blob; repeated rows keep their number;
a failing match (too short) is dropped but still uses up its characters.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferngraph.session import ship


@dataclass(frozen=True)
class Rule:
    """A regex whose leftmost matches count if ``group`` has ``least`` characters."""

    name: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1
    fold_case: bool = False


# The base rules, in the order that breaks ties.
BASE = (
    Rule("assign", 1, r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, True),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", 1, r"[0-9a-f]{16,}", 0, 16),
)
EXTRA = (
    Rule("pem", 1, r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----[^-]*-----END [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("jwt", 1, r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]++\.[A-Za-z0-9_-]++\.[A-Za-z0-9_-]+", 0, 40),
)
RULES = BASE + EXTRA
LEDGER = "blob string, rule string, version int"
FINDINGS = "blob string, rule string, version int, start long, end long"


def find(text: str, rule: Rule, compiled: dict = {}) -> list[tuple[int, int]]:  # noqa: B006
    p = compiled.get(rule)
    if p is None:
        p = compiled[rule] = re.compile(rule.pattern, re.ASCII | (re.I if rule.fold_case else 0))
    return [m.span() for m in p.finditer(text) if m.end(rule.group) - m.start(rule.group) >= rule.least]


def _scan(rules: tuple[Rule, ...]):
    by_name = {r.name: r for r in rules}

    def run(batches):
        for b in batches:
            blobs, texts, todo = b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()
            out: list[tuple] = []
            for blob, text, names in zip(blobs, texts, todo, strict=True):
                for name in names:
                    r = by_name[name]
                    # start -1 tells that the pair was scanned
                    out.append((blob, name, r.version, -1, -1))
                    out += [(blob, name, r.version, s, e) for s, e in find(text, r)]
            cols = list(zip(*out, strict=True)) if out else [[]] * 5
            types = (pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["blob", "rule", "version", "start", "end"])

    return run


def blobs_of(versions: DataFrame, text: str = "text") -> DataFrame:
    """(blob, content): each distinct content once.  Copies meet map-side first, so a text
    that a third of all rows hold is moved once per task at most."""
    t = F.coalesce(F.col(text), F.lit(""))
    return versions.select(F.sha2(t, 256).alias("blob"), t.alias("content")).groupBy("blob").agg(F.first("content").alias("content"))


def scan(blobs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Scan what ``ledger`` (blob, rule, version) lacks.  Returns findings, with one row of
    start -1 for each pair scanned: ``new_ledger`` and ``spans`` split them."""
    ship(blobs.sparkSession)
    todo = F.array(*[F.lit(r.name) for r in rules])
    if ledger is None:
        want = blobs.select("blob", "content", todo.alias("todo"))
    else:
        present = F.struct("rule", "version").isin([F.struct(F.lit(r.name).alias("rule"), F.lit(r.version).alias("version")) for r in rules])
        seen = ledger.where(present).groupBy("blob").agg(F.collect_set("rule").alias("seen"))
        left = F.array_except(todo, F.coalesce("seen", F.array().cast("array<string>")))
        want = blobs.join(seen, "blob", "left").select("blob", "content", left.alias("todo")).where(F.size("todo") > 0)
    return want.mapInArrow(_scan(rules), FINDINGS)


def new_ledger(found: DataFrame) -> DataFrame:
    return found.where("start = -1").select("blob", "rule", "version")


def spans(found: DataFrame) -> DataFrame:
    return found.where("start >= 0")


def empty_ledger(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], LEDGER)


def by_path(versions: DataFrame, path: str, found: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(path, blob, spans): every path with the spans of its blob, by start, then by rule order."""
    rank = F.create_map(*[F.lit(x) for i, r in enumerate(rules) for x in (r.name, i)])
    grouped = spans(found).groupBy("blob").agg(F.sort_array(F.collect_list(F.struct("start", rank[F.col("rule")].alias("rank"), "end", "rule"))).alias("spans"))
    blob = F.sha2(F.coalesce(F.col(text), F.lit("")), 256)
    return versions.select(path, blob.alias("blob")).join(grouped, "blob", "left")
