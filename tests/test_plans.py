import os
import subprocess

import pytest
from pyspark.sql import functions as F

from ferngraph.functions import resolve
from ferngraph.operators import quality, ranking
from ferngraph.plans import analyze, index, render
from ferngraph.sources import git, manifests, store, tree
from ferngraph.streaming import usage

FILES = {
    "shop/__init__.py": "",
    "shop/models.py": "from .base import Base\n",
    "shop/base.py": "import os\n",
    "shop/service.py": "from shop.models import Order\nfrom shop import base\n",
    "shop/api.py": "from .service import Service\nimport requests\nfrom . import missing_name\n",
    "tests/test_service.py": "from shop.service import Service\n",
    "pyproject.toml": "",
    "web/a.ts": "import { b } from './b';\n",
    "web/b.ts": "import { a } from './a';\n",
}


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    root = str(tmp_path_factory.mktemp("repo"))
    for f, text in FILES.items():
        os.makedirs(os.path.dirname(os.path.join(root, f)) or root, exist_ok=True)
        with open(os.path.join(root, f), "w") as h:
            h.write(text)
    for a in (["init", "-q"], ["add", "-A"], ["-c", "user.name=t", "-c", "user.email=t@t", "commit", "-qm", "x", "--date=2024-01-01T00:00:00Z"]):
        subprocess.run(["git", "-C", root, *a], check=True)
    return root


@pytest.fixture(scope="module")
def ix(spark, repo):
    t = tree.scan(spark, repo)
    files = t.select("path", "language", "content_hash")
    config = manifests.config(repo, list(FILES))
    return index.build(files, tree.contents(t), config, git.commits(spark, repo))


def test_index(ix):
    edges = {(r.src_file, r.dst_file) for r in ix.edges.collect()}
    assert edges == {
        ("shop/models.py", "shop/base.py"), ("shop/service.py", "shop/models.py"), ("shop/service.py", "shop/base.py"), ("shop/api.py", "shop/service.py"),
        ("shop/api.py", "shop/__init__.py"), ("tests/test_service.py", "shop/service.py"), ("web/a.ts", "web/b.ts"), ("web/b.ts", "web/a.ts"),
    }
    lost = {(r.specifier, r.reason) for r in ix.unresolved.collect()}
    assert lost == {("os", "stdlib"), ("requests", "external")}
    s = {r.file_path: r for r in ix.signals.collect()}
    assert s["shop/base.py"].indegree == 2 and s["shop/service.py"].indegree == 1 and s["shop/api.py"].is_entrypoint


def test_analyze(ix):
    subjects = ix.files.select(F.col("path").alias("subject"))
    out = analyze.analyze(subjects, ix)
    rows = out["sections"].collect()
    must = {r.path for r in rows if r.subject == "shop/service.py" and r.section == "must_read"}
    assert must == {"shop/models.py", "shop/base.py", "shop/api.py"}
    tests = [(r.path, r.direct) for r in out["tests"].where("subject = 'shop/service.py'").collect()]
    assert tests == [("tests/test_service.py", True)]
    order = [r.path for r in out["must_read"].where("subject = 'shop/service.py'").orderBy("rank").collect()]
    assert order.index("shop/base.py") < order.index("shop/models.py")
    assert {r.subject for r in out["cycles"].collect()} == {"web/a.ts", "web/b.ts"}
    s = {r.subject: r for r in out["summary"].collect()}
    assert s["web/a.ts"].blast_level == "medium" and s["shop/api.py"].confidence == 1.0
    assert len(analyze.documents(out).collect()) == len(s)
    # sections of one subject don't share a file between likely_modify and related
    likely = {(r.subject, r.path) for r in rows if r.section == "likely_modify"}
    assert not likely & {(r.subject, r.path) for r in rows if r.section == "related"}
    merged = analyze.merge_subjects(out["sections"], ix.files.sparkSession.createDataFrame([("shop/api.py", 0), ("shop/models.py", 1)], "subject string, ord int"), ranking.Caps())
    assert ("must_read", "shop/service.py") in {(r.section, r.path) for r in merged.collect()}


def test_git(spark, repo):
    assert {r.path for r in git.listed_files(spark, repo).collect()} == set(FILES)
    c = git.commits(spark, repo).collect()
    assert len(c) == 1 and set(c[0].files) == set(FILES)
    assert git.parse_log(spark.createDataFrame([("h\0002024-01-01T00:00:00Z\n\na\nb\n",)], "value string")).first().files == ["a", "b"]
    assert git.head(repo) and git.branch(repo)


def test_store(spark, tmp_path):
    s = store.Store(spark, str(tmp_path))
    assert s.migrate() and not s.migrate()
    s.upsert("files", spark.createDataFrame([("a", "h1"), ("b", "h1")], "path string, content_hash string"), ["path"])
    s.upsert("files", spark.createDataFrame([("a", "h2")], "path string, content_hash string"), ["path"])
    assert {(r.path, r.content_hash) for r in s.read("files").collect()} == {("a", "h2"), ("b", "h1")}
    s.append("edges", spark.createDataFrame([("a", "b", "x")], "src_file string, dst_file string, specifier string"))
    s.delete(spark.createDataFrame([("b",)], "path string"))
    assert s.read("edges").count() == 0 and s.read("files").count() == 1


def test_representatives(spark):
    files = spark.createDataFrame([("p/p.go",), ("p/a.go",), ("q/z_linux.go",), ("q/y.go",), ("q/a_test.go",), ("q/doc.go",)], "path string")
    assert {(r.dir, r.path) for r in resolve.representatives(files).collect()} == {("p", "p/p.go"), ("q", "q/y.go")}


def test_caps():
    c = ranking.Caps.resolve(mode="plan")
    assert (c.must_read, c.likely_modify, c.tests, c.related) == (15, 5, 3, 15)
    assert ranking.Caps.resolve(must_read=2).must_read == 2
    assert ranking.Caps.resolve(token_budget=100).must_read == 3
    assert ranking.Caps.resolve(token_budget=100_000).must_read == 30


def test_quality(spark):
    s = spark.createDataFrame([("a/user_service.py", 1, 9, False, False, 2.0), ("a/model.py", 7, 0, False, False, 5.0), ("tests/test_a.py", 0, 1, True, False, 1.0)], "file_path string, indegree long, outdegree long, is_entrypoint boolean, is_utility boolean, churn double")
    got = dict(quality.archetypes(s))
    assert got["Service"] == "a/user_service.py" and got["Model"] == "a/model.py" and got["Test"] == "tests/test_a.py"
    fx = spark.createDataFrame([("s", ["a", "b"], ["z"], ["a", "b"])], "subject string, must_read array<string>, must_read_forbidden array<string>, must_read_ordered array<string>")
    for c in ("related", "tests", "external", "related_forbidden", "ignore_must_contain", "expect_stable"):
        fx = fx.withColumn(c, F.array().cast("array<string>"))
    res = spark.createDataFrame([("s", ["a", "b"], [], [], [], [], [])], "subject string, must_read array<string>, likely_modify array<string>, related array<string>, tests array<string>, external array<string>, stable array<string>")
    assert quality.compare(fx, res).first().passed
    bad = res.withColumn("must_read", F.array(F.lit("b"), F.lit("a"), F.lit("z")))
    r = quality.compare(fx, bad).first()
    assert not r.passed and r.disordered == 1 and r.forbidden == 1


def test_render():
    assert render.shortest_unique(["a/x.py", "b/x.py", "c.py"]) == {"a/x.py": "a/x.py", "b/x.py": "b/x.py", "c.py": "c.py"}
    text = render.compact("s.py", {"must_read": [{"path": "a/x.py"}]}, {"blast_level": "low", "blast_detail": "d"})
    assert text == "s.py [low] d\nmust_read: x.py"
    assert render.to_csv([{"a": 1, "b": 2}]) == "a,b\n1,2\n"


def test_stream(spark, tmp_path):
    src = str(tmp_path / "in")
    rows = [("2024-01-01 10:00:00", "x", 2), ("2024-01-01 11:00:00", "x", 3), ("2024-01-09 10:00:00", "y", 1)]
    spark.createDataFrame(rows, "t string, tool string, file_count long").select(F.to_timestamp("t").alias("created_at"), "tool", "file_count").write.parquet(src)
    stream = spark.readStream.schema("created_at timestamp, tool string, file_count long").parquet(src)
    q = usage.start(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    got = [(r.tool, r.n, r.files) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert got in ([("x", 2, 5)], [])
