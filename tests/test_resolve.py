from ferngraph.functions import extract, names
from ferngraph.functions import resolve as R
from ferngraph.operators import signals
from ferngraph.plans import index
from ferngraph.session import written
from ferngraph.sources import manifests as M


def first(spec, files, path, lang, c=None, names_=(), kind="absolute"):
    got, why = R.RESOLVERS[lang](path, spec, list(names_), kind, c or R.Config())
    return next((x for x in got if x in files), why)


def test_python_order():
    files = {"src/p/__init__.py", "src/p/sub.py", "src/p/deep/__init__.py", "t.py"}
    c = R.Config(python_roots=["src", "."])
    assert first("p", files, "t.py", "python", c, ["sub"]) == "src/p/sub.py"
    assert first("p", files, "t.py", "python", c, ["Thing"]) == "src/p/__init__.py"
    assert first("..sub", files, "src/p/deep/__init__.py", "python", c, ["X"]) == "src/p/sub.py"
    assert first(".", files, "src/p/sub.py", "python", c, ["deep"]) == "src/p/deep/__init__.py"
    assert first("os.path", files, "t.py", "python", c) == "stdlib"
    assert first("numpy", files, "t.py", "python", c) == "external"
    assert first("..x", files, "t.py", "python", c) == "relative import escapes repository"


def test_typescript_order():
    files = {"src/a.ts", "src/lib/index.ts", "packages/core/src/index.ts", "packages/core/src/util.ts"}
    c = R.Config(tsconfigs=[{"dir": ".", "base": ".", "paths": {"@app/*": ["src/*"]}, "base_url": True}], packages={"@x/core": {"dir": "packages/core", "exports": {".": "dist/index.js"}, "entries": []}})
    assert first("./a", files, "src/b.ts", "typescript", c) == "src/a.ts"
    assert first("./lib", files, "src/b.ts", "typescript", c) == "src/lib/index.ts"
    assert first("./a.js", files, "src/b.ts", "typescript", c) == "src/a.ts"
    assert first("@app/lib", files, "src/b.ts", "typescript", c) == "src/lib/index.ts"
    assert first("@x/core", files, "src/b.ts", "typescript", c) == "packages/core/src/index.ts"
    assert first("@x/core/util", files, "src/b.ts", "typescript", c) == "packages/core/src/util.ts"
    assert first("react", files, "src/b.ts", "typescript", c) == "external"


def test_others():
    assert R.go("a.go", "x.y/m/p", [], "absolute", R.Config(go_modules=[("x.y/m", "")])) == (["dir:p"], "not_found")
    assert R.go("a.go", "fmt", [], "absolute", R.Config())[1] == "stdlib"
    assert first("a.b.C.inner", {"src/a/b/C.java"}, "X.java", "java", None, [], "static") == "src/a/b/C.java"
    assert first("crate::m::n::T", {"src/m/n.rs", "src/m/mod.rs"}, "src/x/y.rs", "rust") == "src/m/n.rs"
    assert first("super::z", {"src/x/z.rs"}, "src/x/y.rs", "rust") == "src/x/z.rs"
    assert first("mod:k", {"src/k/mod.rs"}, "src/lib.rs", "rust") == "src/k/mod.rs"
    assert first("my_crate::t", {"c/src/t.rs"}, "d/src/lib.rs", "rust", R.Config(crates={"my_crate": "c/src"})) == "c/src/t.rs"
    assert R.csharp("A/X.cs", "App.Core.Y", [], "absolute", R.Config(csharp_projects=[("App", "app")]))[0][:2] == ["app/Core/Y.cs", "dir:app/Core/Y"]
    assert R.csharp("A/X.cs", "System.Text", [], "absolute", R.Config())[1] == "stdlib"
    assert R.fnv1a("") == 2166136261 and R.fnv1a("a") == 0xE40C292C


def test_manifests():
    s = M.settings("version: 1\nentrypoints:\n  - main.py\nignore: [gen, ./out/]\n")
    assert s.entrypoints == ["main.py"] and s.ignore == ["gen/", "out/"]
    try:
        M.settings("unknown: 1")
        raise AssertionError
    except ValueError:
        pass
    assert M.jsonc('{"a": "//x", /* c */ "b": [1,],}') == {"a": "//x", "b": [1]}
    text = {"go.mod": "module x.y/m\nreplace x.y/q => ./q\n", "tsconfig.json": '{"extends": "./base", "compilerOptions": {"paths": {"@/*": ["src/*"]}}}', "base.json": '{"compilerOptions": {"baseUrl": "."}}', "Cargo.toml": '[package]\nname = "my-crate"\n[dependencies]\nserde = "1"\n'}
    assert M.go_modules(set(text), text.get) == [("x.y/m", ""), ("x.y/q", "q")]
    assert M.tsconfigs(set(text), text.get)[0]["base_url"]
    assert M.crates(set(text), text.get) == ({"my_crate": "src"}, {"serde"})
    assert M.python_roots({"pyproject.toml", "src/a.py", "sub/setup.py"}) == ["src", "sub", "."]
    assert M.profile(["a/go.mod"]) == "go"


def test_names():
    assert names.camel("HTTPServerTest2") == ["HTTP", "Server", "Test2"]
    assert names.is_direct_test("src/auth.py", "tests/test_auth.py")
    assert not names.is_direct_test("src/auth.py", "tests/test_login.py")
    assert names.is_direct_test("src/main/java/a/Foo.java", "src/test/java/a/FooTest.java")
    assert names.share_class_prefix("a/UserService.java", "a/UserServiceImpl.java") and not names.share_class_prefix("UserA.java", "UserB.java")
    assert names.topological([("a", 1, 0), ("b", 5, 0), ("c", 3, 1)], [("b", "a"), ("a", "c")]) == ["c", "a", "b"]
    assert names.topological([("a", 1, 2), ("b", 5, 1)], [("b", "a"), ("a", "b")]) == ["b", "a"]


def test_no_table_is_broadcast(spark):
    """Small files may hold many rows, so no join of the index sends a table to the driver."""
    files = written(spark.createDataFrame([("a/x.py",), ("a/y.py",)], "path string"))
    facts = written(spark.createDataFrame([("a/x.py", ".y", "relative", 1, ["z"])], extract.FACTS))
    edges, lost = R.resolve(facts, files, R.Config())
    assert [tuple(r) for r in edges.select("src_file", "dst_file").collect()] == [("a/x.py", "a/y.py")]
    for df in (edges, lost, signals.degree_signals(files, edges)):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def test_no_table_is_broadcast_in_a_refresh(spark, monkeypatch):
    files = written(spark.createDataFrame([("a/x.py", "1", "from .y import z"), ("a/y.py", "2", "z = 1")], "path string, content_hash string, text string"))
    old = index.build(files.where("path = 'a/x.py'"), files.where("path = 'a/x.py'"), R.Config())
    plans = []
    monkeypatch.setattr(index, "written", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or written(df, name))
    e = index.refresh(old, files, files, R.Config()).edges
    assert [tuple(r) for r in e.select("src_file", "dst_file").collect()] == [("a/x.py", "a/y.py")]
    assert len(plans) == 6 and not any("Broadcast" in p for p in plans)


def package(spark, n):
    """(path, content_hash, text) of a Java and a C# package of ``n`` files, and a test of the first."""
    java = [(f"src/p/C{k:02}.java", str(k), f"package p;\nclass C{k:02} {{}}\n") for k in range(n)]
    cs = [(f"app/N/D{k:02}.cs", str(k), f"namespace N;\npublic class D{k:02} {{\n}}\n") for k in range(n)]
    return spark.createDataFrame([*java, *cs, ("src/p/C00Test.java", "t", "package p;\nclass C00Test {}\n")], "path string, content_hash string, text string")


def among(n):
    """The edges of ``package``: each file to all others, tests to all that aren't."""
    java, cs = [f"src/p/C{k:02}.java" for k in range(n)], [f"app/N/D{k:02}.cs" for k in range(n)]
    return {(a, b) for x in (java, cs) for a in x for b in x if a != b} | {("src/p/C00Test.java", b) for b in java}


def test_packages_of_any_size(spark):
    t = package(spark, 13)
    got = [(r.src_file, r.dst_file) for r in index.build(t.drop("text"), t, R.Config()).edges.collect()]
    assert len(got) == len(set(got)) and set(got) == among(13)


def test_packages_of_any_size_in_a_refresh(spark):
    """Files of a package that come later are linked with all that were there."""
    t = package(spark, 13)
    few = t.where("path < 'app/N/D07.cs'")
    e = index.refresh(index.build(few.drop("text"), few, R.Config()), t.drop("text"), t, R.Config()).edges
    assert {(r.src_file, r.dst_file) for r in e.collect()} == among(13)
