"""From import facts to files: ordered candidates, then one priority equi-join.

A resolver names, without looking at any file, the paths that a fact may mean in order of
priority; directories stand for their representative file.  Spark joins the candidates to
all known paths and takes the first that exists.
"""

from __future__ import annotations

import posixpath
import re
from collections.abc import Iterable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferngraph.functions import extract
from ferngraph.functions import paths as P
from ferngraph.session import sorted_join, written

JS = (".ts", ".tsx", ".mts", ".cts", ".js", ".jsx", ".mjs", ".cjs")


@dataclass
class Config:
    """What the manifests of a repository say; small, parsed on the driver."""

    python_roots: list[str] = field(default_factory=lambda: ["."])
    go_modules: list[tuple[str, str]] = field(default_factory=list)  # (module path, directory)
    tsconfigs: list[dict] = field(default_factory=list)  # dir, base, paths {pattern: [targets]}
    packages: dict[str, dict] = field(default_factory=dict)  # name -> dir, entries [..], exports {subpath: target}
    java_roots: list[str] = field(default_factory=lambda: ["src/main/java", "src/test/java", "src", "."])
    crates: dict[str, str] = field(default_factory=dict)  # crate name -> directory of its source
    rust_dependencies: set[str] = field(default_factory=set)
    csharp_projects: list[tuple[str, str]] = field(default_factory=list)  # (root namespace, directory)


def join(*parts: str) -> str:
    """Normalised path below the root; '' if it leaves the root."""
    p = posixpath.normpath(posixpath.join(*[x for x in parts if x] or ["."]))
    return "" if p.startswith("..") else p


def _module(base: str) -> list[str]:
    return [f"{base}.py", f"{base}/__init__.py"]


def python(path: str, spec: str, names: list[str], kind: str, c: Config) -> tuple[list[str], str]:
    if spec.startswith("."):
        up = len(spec) - len(spec.lstrip("."))
        base, rest = posixpath.dirname(path), spec.lstrip(".").replace(".", "/")
        for _ in range(up - 1):
            base = posixpath.dirname(base) if base else None
            if not base:
                return [], "relative import escapes repository"
        out = [x for n in names if n != "*" for x in _module(join(base, rest, n))]
        return [*out, *(_module(join(base, rest)) if rest else [join(base, "__init__.py")])], "not_found"
    if extract.is_stdlib("python", spec):
        return [], "stdlib"
    out = []
    for root in c.python_roots:
        base = join(root, spec.replace(".", "/"))
        out += [x for n in names if n != "*" for x in _module(f"{base}/{n}")] + _module(base)
    return out, "external"


def _js(base: str) -> list[str]:
    stem, ext = posixpath.splitext(base)
    if ext in (".ts", ".tsx", ".mts", ".cts"):
        return [base]
    index = [f"{base}/index{e}" for e in JS]
    if ext in JS:
        return [*[stem + e for e in JS], base, *index]
    return [*[base + e for e in JS], *index]


def _source_first(target: str) -> list[str]:
    """Built output by its source first."""
    src = re.sub(r"(^|/)(dist|build)/", r"\1src/", target)
    src = re.sub(r"\.d\.ts$|\.[cm]?js$", ".ts", src)
    return [*_js(src), *_js(target)] if src != target else _js(target)


def typescript(path: str, spec: str, names: list[str], kind: str, c: Config) -> tuple[list[str], str]:
    here = posixpath.dirname(path)
    if spec.startswith("."):
        base = join(here, spec)
        return (_js(base), "not_found") if base else ([], "escapes_repository")
    out: list[str] = []
    near = [t for t in c.tsconfigs if t["dir"] in ("", ".") or path.startswith(t["dir"] + "/")]
    if near:
        t = max(near, key=lambda t: len(t["dir"]) if t["dir"] != "." else 0)
        for pattern in sorted(t.get("paths", {}), key=lambda p: (-len(p), p)):
            head, star, tail = pattern.partition("*")
            if star and spec.startswith(head) and spec.endswith(tail) and len(spec) >= len(head) + len(tail):
                fill = spec[len(head) : len(spec) - len(tail)]
                out += [x for target in t["paths"][pattern] for x in _js(join(t["base"], target.replace("*", fill)))]
            elif pattern == spec:
                out += [x for target in t["paths"][pattern] for x in _js(join(t["base"], target))]
        if t.get("base_url"):
            out += _js(join(t["base"], spec))
    parts = spec.split("/")
    name = "/".join(parts[:2]) if spec.startswith("@") else parts[0]
    sub = spec[len(name) :].lstrip("/")
    if name in c.packages:
        p = c.packages[name]
        target = p.get("exports", {}).get("./" + sub if sub else ".")
        if target:
            out += _source_first(join(p["dir"], target))
        if sub:
            out += [*_js(join(p["dir"], "src", sub)), *_js(join(p["dir"], sub))]
        else:
            out += [x for e in p.get("entries", []) for x in _source_first(join(p["dir"], e))]
            out += [*_js(join(p["dir"], "src/index")), *_js(join(p["dir"], "index"))]
        return out, "workspace_entry_not_found"
    return out, "external"


def go(path: str, spec: str, names: list[str], kind: str, c: Config) -> tuple[list[str], str]:
    fits = [(m, d) for m, d in c.go_modules if spec.startswith(m)]
    if extract.is_stdlib("go", spec):
        return [], "stdlib"
    for m, d in sorted(fits, key=lambda x: -len(x[0])):
        return ["dir:" + join(d, spec[len(m) :].lstrip("/"))], "not_found"
    return [], "external"


def java(path: str, spec: str, names: list[str], kind: str, c: Config) -> tuple[list[str], str]:
    if kind == "same_package":
        return ["siblings:" + posixpath.dirname(path)], "no_siblings"
    if extract.is_stdlib("java", spec):
        return [], "stdlib"
    out = []
    parts = spec.removesuffix(".*").split(".")
    if spec.endswith(".*") and not parts[-1][:1].isupper():
        return ["dir:" + join(r, "/".join(parts)) for r in c.java_roots], "third_party"
    # a static member or a lower-case last part is no type, and up to two parts may be inner types
    tries = [parts[:k] for k in range(len(parts), max(len(parts) - 3, 0), -1) if parts[:k]]
    if kind == "static" or not parts[-1][:1].isupper():
        tries = tries[1:] + tries[:1]
    for t in tries:
        out += [join(r, "/".join(t) + ".java") for r in c.java_roots]
    return out, "third_party"


def _rust_files(base: str) -> list[str]:
    return [f"{base}.rs", f"{base}/mod.rs"]


def _rust_walk(base: str, parts: list[str]) -> list[str]:
    """Longest module path first, down to the module itself."""
    return [x for k in range(len(parts), 0, -1) for x in _rust_files(join(base, *parts[:k]))]


def rust(path: str, spec: str, names: list[str], kind: str, c: Config) -> tuple[list[str], str]:
    here, file = posixpath.split(path)
    stem = file.removesuffix(".rs")
    own = here if stem in ("mod", "lib", "main") else join(here, stem)
    if spec.startswith("mod:"):
        return _rust_files(join(own, spec[4:])) + _rust_files(join(here, spec[4:])), "not_found"
    name = spec.removeprefix("extern:").split("::")[0]
    if spec.startswith("extern:") or extract.is_stdlib("rust", spec):
        lib = c.crates.get(name)
        return ([join(lib, "lib.rs"), join(lib, "main.rs")], "extern_crate") if lib is not None and spec.startswith("extern:") else ([], "extern_crate" if spec.startswith("extern:") else "stdlib")
    parts = spec.removesuffix("::*").split("::")
    if parts[0] in ("crate", "super", "self"):
        root = own
        if parts[0] == "crate":
            root = here
            while root and posixpath.basename(root) not in ("src", "tests"):
                root = posixpath.dirname(root)
        while parts and parts[0] in ("crate", "super", "self"):
            root = posixpath.dirname(root) if parts[0] == "super" else root
            parts = parts[1:]
        entry = [join(root, "lib.rs"), join(root, "main.rs"), join(root, "mod.rs"), *([root + ".rs"] if root else [])]
        return [*_rust_walk(root, parts), *entry], "not_found"
    if name in c.crates:
        base = c.crates[name]
        return [*_rust_walk(base, parts[1:]), join(base, "lib.rs"), join(base, "main.rs")], "not_found"
    if name in c.rust_dependencies:
        return [], "dependency"
    return _rust_walk(own, parts), "third_party"


def csharp(path: str, spec: str, names: list[str], kind: str, c: Config) -> tuple[list[str], str]:
    if kind == "same_namespace":
        return ["siblings:" + posixpath.dirname(path)], "no_siblings"
    out: list[str] = []
    for space, folder in sorted(c.csharp_projects, key=lambda x: (-len(x[0]), x[1])):
        if spec == space or spec.startswith(space + "."):
            rest = spec[len(space) :].strip(".").replace(".", "/")
            out += [join(folder, rest + ".cs")] if rest else []
            out += ["dir:" + join(folder, rest)]
    if not out and extract.is_stdlib("csharp", spec):
        return [], "stdlib"
    whole = spec.replace(".", "/")
    return [*out, whole + ".cs", "dir:" + whole], "third_party"


RESOLVERS = {"python": python, "typescript": typescript, "javascript": typescript, "go": go, "java": java, "rust": rust, "csharp": csharp}


def fnv1a(text: str) -> int:
    """FNV-1a, 32 bits."""
    h = 2166136261
    for b in text.encode():
        h = (h ^ b) * 16777619 & 0xFFFFFFFF
    return h


def candidates(facts: DataFrame, config: Config) -> DataFrame:
    """(fact columns..., candidates array, miss): what each fact may mean, best first."""

    def run(batches: Iterable[pd.DataFrame]):
        for b in batches:
            got = [
                RESOLVERS[lang](p, s, list(n) if n is not None else [], k, config) if lang in RESOLVERS else ([], "no_resolver")
                for p, s, n, k, lang in zip(b["path"], b["specifier"], b["imported_names"], b["import_type"], b["language"], strict=True)
            ]
            yield b.assign(candidates=[[x for x in dict.fromkeys(c) if x] for c, _ in got], miss=[m for _, m in got])

    x = facts.withColumn("language", P.language(F.col("path")))
    return x.mapInPandas(run, extract.FACTS + ", language string, candidates array<string>, miss string")


def representatives(files: DataFrame) -> DataFrame:
    """(dir, language, path): the file that stands for a package directory: the one named
    like it, then plain names, then platform variants; tests and doc.go never."""
    p = F.col("path")
    folder = P.dirname(p)
    platform = P.stem(p).rlike("_(linux|windows|darwin|freebsd|netbsd|openbsd|amd64|arm64|arm|386|js|wasm|unix)$")
    x = files.where(~P.is_test(p) & (P.basename(p) != "doc.go")).select(p, folder.alias("dir"), P.language(p).alias("language"), F.when(P.stem(p) == P.basename(folder), 0).when(platform, 2).otherwise(1).alias("tier"))
    return x.groupBy("dir", "language").agg(F.min_by("path", F.struct("tier", "path")).alias("path"))


def resolve(facts: DataFrame, files: DataFrame, config: Config, all_paths: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(edges (src_file, dst_file, specifier, resolution_method, line_number, name),
    unresolved (src_file, specifier, reason, line_number)).  ``all_paths`` may hold paths
    that are not indexed; a hit there is unresolved too."""
    known = (all_paths if all_paths is not None else files).select("path").distinct()
    # read four times
    x = written(candidates(facts, config).withColumn("fact", F.xxhash64("path", "specifier", "import_type", "line", F.to_json("imported_names"))), "meanings")
    long = x.select("fact", "path", "language", F.posexplode("candidates").alias("pos", "cand"))
    plain = long.where(~F.col("cand").rlike("^(dir|siblings):")).join(sorted_join(known.withColumnRenamed("path", "cand")), "cand").select("fact", "pos", F.col("cand").alias("dst"))
    rep = representatives(known).select(F.concat(F.lit("dir:"), "dir").alias("cand"), "language", F.col("path").alias("dst"))
    folder = long.where(F.col("cand").startswith("dir:")).join(sorted_join(rep), ["cand", "language"]).select("fact", "pos", "dst")
    hit = plain.unionByName(folder).groupBy("fact").agg(F.min_by("dst", "pos").alias("dst"))
    # synthetic facts: every other file of the directory, however many there are
    near = known.where(~P.is_test(F.col("path"))).select(F.concat(F.lit("siblings:"), P.dirname(F.col("path"))).alias("cand"), F.col("path").alias("dst"), P.language(F.col("path")).alias("language"))
    same = long.where(F.col("cand").startswith("siblings:")).join(sorted_join(near), ["cand", "language"]).where("dst <> path").select("fact", "dst")
    found = x.join(sorted_join(hit.unionByName(same)), "fact", "left").join(sorted_join(files.select(F.col("path").alias("dst"), F.lit(True).alias("indexed"))), "dst", "left")
    method = F.when(F.col("import_type").isin("same_package", "same_namespace"), F.col("import_type")).otherwise(F.col("language"))
    edges = found.where("indexed").select(F.col("path").alias("src_file"), F.col("dst").alias("dst_file"), "specifier", method.alias("resolution_method"), F.col("line").cast("long").alias("line_number"), F.explode_outer("imported_names").alias("name"))
    reason = F.when(F.col("dst").isNotNull(), F.lit("resolved file not indexed")).otherwise(F.col("miss"))
    lost = found.where("indexed IS NULL").select(F.col("path").alias("src_file"), "specifier", reason.alias("reason"), F.col("line").cast("long").alias("line_number"))
    return edges, lost
