"""Build manifests and repository settings, read on the driver into small configs."""

from __future__ import annotations

import json
import os
import posixpath
import re
import tomllib
from dataclasses import dataclass, field

from ferngraph.functions.resolve import Config, join

SETTINGS = ("version", "entrypoints", "ignore", "generated")


@dataclass
class Settings:
    version: int = 1
    entrypoints: list[str] = field(default_factory=list)
    ignore: list[str] = field(default_factory=list)
    generated: list[str] = field(default_factory=list)


def settings(text: str) -> Settings:
    """Repository settings (a small YAML of scalars and string lists).  Unknown keys are errors;
    ignore and generated become prefixes that end with a slash."""
    out: dict = {}
    key = None
    for raw in text.splitlines():
        line = raw.split("#", 1)[0].rstrip()
        if not line.strip():
            continue
        item = re.match(r"\s*-\s+(.*)$", line)
        if item and key:
            out[key].append(item[1].strip().strip("'\""))
            continue
        m = re.match(r"(\w+):\s*(.*)$", line)
        if not m or m[1] not in SETTINGS:
            raise ValueError(f"unknown setting: {line.strip()}")
        key = m[1]
        inner = re.match(r"\[(.*)\]$", m[2])
        out[key] = int(m[2]) if key == "version" and m[2] else [x.strip().strip("'\"") for x in inner[1].split(",") if x.strip()] if inner else []
    s = Settings(**out)
    if s.version != 1:
        raise ValueError(f"unknown version: {s.version}")
    folder = lambda p: p.replace("\\", "/").removeprefix("./").rstrip("/") + "/"
    s.ignore, s.generated = [folder(p) for p in s.ignore], [folder(p) for p in s.generated]
    return s


def jsonc(text: str) -> dict:
    """JSON with comments and trailing commas."""
    text = re.sub(r'("(?:\\.|[^"\\])*")|//[^\n]*|/\*(?:.|\n)*?\*/', lambda m: m[1] or "", text)
    text = re.sub(r'("(?:\\.|[^"\\])*")|,(\s*[}\]])', lambda m: m[1] or m[2], text)
    return json.loads(text)


def python_roots(files: set[str]) -> list[str]:
    marks = ("pyproject.toml", "setup.py", "setup.cfg")
    out: list[str] = []
    if any(m in files for m in marks):
        out += ["src"] if any(f.startswith("src/") for f in files) else []
    for top in sorted({f.split("/")[0] for f in files if "/" in f}):
        if any(f"{top}/{m}" in files for m in marks[:2]):
            out += [top, *([f"{top}/src"] if any(f.startswith(f"{top}/src/") for f in files) else [])]
    return list(dict.fromkeys([*out, "."]))


def go_modules(files: set[str], read) -> list[tuple[str, str]]:
    out = []
    dirs = [""]
    if "go.work" in files:
        dirs = [x.strip() for x in re.findall(r"^\s*(?:use\s+)?(\.[\w./-]*)\s*$", read("go.work"), re.M)]
    for d in dirs:
        f = join(d, "go.mod")
        if f in files:
            text = read(f)
            m = re.search(r"^module\s+(\S+)", text, re.M)
            if m:
                out.append((m[1], join(d) if d else ""))
            out += [(a, join(d, b)) for a, b in re.findall(r"^(?:replace\s+|\s+)(\S+)(?:\s+v\S+)?\s+=>\s+(\.\S*)", text, re.M)]
    return out


def tsconfigs(files: set[str], read) -> list[dict]:
    def load(f: str, seen: frozenset = frozenset()) -> dict:
        if f in seen or f not in files:
            return {}
        try:
            own = jsonc(read(f))
        except ValueError:
            return {}
        d = posixpath.dirname(f)
        up: dict = {}
        for e in [own["extends"]] if isinstance(own.get("extends"), str) else own.get("extends", []):
            if e.startswith("."):
                up |= load(join(d, e if e.endswith(".json") else e + ".json"), seen | {f})
        o = own.get("compilerOptions", {})
        if "baseUrl" in o:
            up |= {"base_url": True, "base": join(d, o["baseUrl"])}
        if "paths" in o:
            up |= {"paths": o["paths"]}
            up.setdefault("base", d)
        return up

    out = []
    for f in sorted(files):
        if posixpath.basename(f) == "tsconfig.json":
            c = load(f)
            if c:
                out.append({"dir": posixpath.dirname(f) or ".", "base": c.get("base", ""), "paths": c.get("paths", {}), "base_url": c.get("base_url", False)})
    return out


def packages(files: set[str], read) -> dict[str, dict]:
    globs: list[str] = []
    if "pnpm-workspace.yaml" in files:
        globs = re.findall(r"^\s*-\s*['\"]?([^'\"\n#]+?)['\"]?\s*$", read("pnpm-workspace.yaml"), re.M)
    elif "package.json" in files:
        w = json.loads(read("package.json")).get("workspaces", [])
        globs = w.get("packages", []) if isinstance(w, dict) else w
    out: dict[str, dict] = {}
    fits = [re.compile(re.escape(g.rstrip("/")).replace(r"\*\*", ".*").replace(r"\*", "[^/]*") + "$") for g in globs if not g.startswith("!")]
    for f in sorted(files):
        d = posixpath.dirname(f)
        if posixpath.basename(f) == "package.json" and any(p.match(d) for p in fits):
            p = json.loads(read(f))
            e = p.get("exports", {})
            if isinstance(e, str) or (isinstance(e, dict) and not any(k.startswith(".") for k in e)):
                e = {".": e}
            pick = lambda v: v if isinstance(v, str) else next((pick(v[k]) for k in ("source", "types", "import", "default", "require") if k in v), "") if isinstance(v, dict) else ""
            if "name" in p:
                out[p["name"]] = {"dir": d, "exports": {k: pick(v) for k, v in e.items()}, "entries": [p[k] for k in ("types", "module", "main") if isinstance(p.get(k), str)]}
    return out


def crates(files: set[str], read) -> tuple[dict[str, str], set[str]]:
    """(crate -> source directory, names of dependencies) of all Cargo.toml files."""
    own: dict[str, str] = {}
    deps: set[str] = set()
    for f in sorted(files):
        if posixpath.basename(f) == "Cargo.toml":
            try:
                t = tomllib.loads(read(f))
            except tomllib.TOMLDecodeError:
                continue
            if "name" in t.get("package", {}):
                own[t["package"]["name"].replace("-", "_")] = join(posixpath.dirname(f), "src")
            for k in ("dependencies", "dev-dependencies", "build-dependencies"):
                deps |= {x.replace("-", "_") for x in t.get(k, {})}
    return own, deps - set(own)


def config(root: str, files: list[str]) -> Config:
    """The resolvers' config of a tree; ``files`` are its paths, manifests included."""
    known = set(files)

    def read(f: str) -> str:
        with open(os.path.join(root, f), errors="replace") as h:
            return h.read()

    own, deps = crates(known, read)
    java = sorted({m[0] for f in known if (m := re.match(r"(?:[^/]+/){0,3}src/(?:main|test)/java(?=/)", f))})
    projects = [(posixpath.basename(f).rsplit(".", 1)[0], posixpath.dirname(f)) for f in sorted(known) if f.endswith((".csproj", ".shproj"))]
    return Config(python_roots(known), go_modules(known, read), tsconfigs(known, read), packages(known, read), [*java, "src", "."], own, deps, projects)


def profile(files: list[str]) -> str:
    """What kind of repository the marker files tell of."""
    known = {posixpath.basename(f) for f in files}
    marks = (("monorepo", {"pnpm-workspace.yaml", "lerna.json", "nx.json", "turbo.json", "go.work"}), ("rust", {"Cargo.toml"}), ("go", {"go.mod"}), ("python", {"pyproject.toml", "setup.py", "setup.cfg"}), ("java", {"pom.xml", "build.gradle", "build.gradle.kts"}), ("typescript", {"tsconfig.json"}), ("javascript", {"package.json"}))
    kinds = [k for k, m in marks if known & m]
    return "csharp" if not kinds and any(f.endswith((".csproj", ".sln")) for f in files) else kinds[0] if kinds else "unknown"
