"""Every query against its SQL twin in DuckDB."""

import glob
import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from ferngraph import code_queries  # noqa: F401
from ferngraph import queries as engine
from ferngraph.operators import ranking, signals


@pytest.fixture(scope="module")
def con(data):
    c = duckdb.connect()
    for f in glob.glob(f"{data}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(engine.SQL))
def test_query(spark, data, con, name):
    df = engine.QUERIES[name](spark, data)
    cols = sorted(df.columns)
    got = sorted(tuple(repr(r[c]) for c in cols) for r in df.collect())
    res = con.execute(engine.SQL[name])
    at = [x[0] for x in res.description]
    assert sorted(at) == cols
    want = sorted(tuple(repr(r[at.index(c)]) for c in cols) for r in res.fetchall())
    assert got == want


def test_partitions_do_not_matter(spark, data):
    first = sorted(map(tuple, engine.QUERIES["rnk_sections"](spark, data).collect()), key=repr)
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        again = sorted(map(tuple, engine.QUERIES["rnk_sections"](spark, data).collect()), key=repr)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert first == again


def test_pairs_of_a_hub_are_not_moved(spark, data):
    """The pairs are made where the windows of their subject want them."""
    for name in ("rnk_score", "rnk_sections", "agg_tier_counts"):
        plan = engine.QUERIES[name](spark, data)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning(subject") == 1, name


def test_large_graphs_are_joined_by_pairs(spark):
    rows = [("a.py", "p/__init__.py"), ("p/__init__.py", "p/b.py"), ("c.py", "p/b.py"), ("c.py", "a.py"), ("test_a.py", "a.py"), ("a.py", "a.py"), ("gone.py", "c.py")]
    edges = spark.createDataFrame(rows, "src_file string, dst_file string")
    files = spark.createDataFrame([(p,) for p in ("a.py", "p/__init__.py", "p/b.py", "c.py", "test_a.py", "alone.py")], "path string")
    churn = spark.createDataFrame([("a.py", 4), ("c.py", 1)], "file_path string, value long")
    pairs = spark.createDataFrame([("a.py", "c.py", 3), ("a.py", "alone.py", 2)], "file_a string, file_b string, frequency long")
    given = (files.select(F.col("path").alias("subject")), edges, signals.degree_signals(files, edges))
    for c in (churn, churn.where("false")):
        a, b = ranking.enriched(*given, c, pairs), ranking.enriched(*given, c, pairs, sent=0)
        assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.select(a.columns).collect())) and a.count() > 20


def hubs(spark, seed):
    """Subjects, edges, signals, churn and pairs of a graph with hubs, barrels, tests and copies of names."""
    rnd = random.Random(seed)
    forms = ("a/s{}.py", "a/s{}.py", "b/s{}.py", "b/tests/test_s{}.py", "a/p{}/__init__.py", "docs/s{}.py", "docs/tests/test_s{}.py", "a/tests/p{}/__init__.py")
    names = [rnd.choice(forms).format(k) for k in range(70)] + ["a/hub.py", "a/core/__init__.py", "a/tests/core/__init__.py"]
    edges = {(rnd.choice(names), rnd.choice(names)) for _ in range(60)} | {("gone.py", names[0])}
    edges |= {(n, h) for h in names[-3:] for n in names if rnd.random() < 0.5} | {(h, n) for h in names[-3:] for n in names if rnd.random() < 0.1}
    edges = spark.createDataFrame(sorted(edges), "src_file string, dst_file string")
    files = spark.createDataFrame([(n,) for n in names], "path string")
    churn = spark.createDataFrame([(n, rnd.randrange(1, 9)) for n in names if rnd.random() < 0.6], "file_path string, value long")
    two = [sorted(rnd.sample(names, 2)) for _ in range(150)]
    pairs = spark.createDataFrame([(a, b, rnd.randrange(1, 7)) for a, b in sorted({(a, b) for a, b in two})], "file_a string, file_b string, frequency long")
    return files.select(F.col("path").alias("subject")), edges, signals.degree_signals(files, edges), churn, pairs


def test_shown_files_are_those_of_all_pairs(spark):
    given = hubs(spark, 1)
    top = given[2].agg(F.max("indegree").alias("max_indegree"))
    cols = ("subject", "section", "rank", "path", "confidence")
    for history in (given[3], given[3].where("false")):
        g = (*given[:3], history, given[4])
        every = ranking.score(ranking.enriched(*g, sent=0), top)
        shown = ranking.Shown(*g)
        for caps in (ranking.Caps(2, 3, 5, 2), ranking.Caps()):
            want = ranking.sections(every, caps)
            assert sorted(map(repr, shown.sections(caps).collect())) == sorted(map(repr, want.select(*cols).collect()))
            likely = want.where("section = 'likely_modify'")
            assert sorted(map(repr, shown.likely(caps).select(likely.columns).collect())) == sorted(map(repr, likely.collect()))


def test_shown_pairs_do_not_grow_with_a_hub(spark, monkeypatch):
    """Of 200 importers of a hub, no two are paired for sections that don't show them."""
    monkeypatch.setattr(ranking, "enriched", None)
    files = spark.createDataFrame([(f"a/s{k}.py",) for k in range(200)] + [("a/hub.py",)], "path string")
    edges = files.where("path <> 'a/hub.py'").select(F.col("path").alias("src_file"), F.lit("a/hub.py").alias("dst_file"))
    history = spark.createDataFrame([("a/s1.py", 1)], "file_path string, value long"), spark.createDataFrame([("a/s1.py", "a/s2.py", 3)], "file_a string, file_b string, frequency long")
    shown = ranking.Shown(files.select(F.col("path").alias("subject")), edges, signals.degree_signals(files, edges), *history)
    assert shown.near.count() == 402
    assert shown.sections().where("section = 'related' AND subject = 'a/s7.py'").count() == 10
    assert [tuple(r) for r in shown.likely().where("subject = 'a/s1.py'").select("path", "confidence").collect()] == [("a/s2.py", "medium")]
