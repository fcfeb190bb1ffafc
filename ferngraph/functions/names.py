"""Name affinity: stems, prefixes and mirrors of source and test files (plain functions)."""

from __future__ import annotations

import posixpath
import re

_PLATFORM = re.compile(r"_(linux|windows|darwin|freebsd|netbsd|openbsd|amd64|arm64|arm|386|js|wasm|unix)$")


def stem(path: str) -> str:
    return posixpath.basename(path).rsplit(".", 1)[0]


def camel(name: str) -> list[str]:
    """``HTTPServerTest2`` -> HTTP, Server, Test2."""
    return re.findall(r"[A-Z]+(?![a-z])\d*|[A-Z]?[a-z0-9]+", name)


def share_underscore_prefix(a: str, b: str) -> bool:
    x, y = stem(a).split("_"), stem(b).split("_")
    return x[0] == y[0] and (len(x) > 1 or len(y) > 1)


def share_class_prefix(a: str, b: str) -> bool:
    """At least two leading words in common, or all words of the shorter name."""
    x, y = camel(stem(a)), camel(stem(b))
    n = 0
    while n < min(len(x), len(y)) and x[n] == y[n]:
        n += 1
    return n >= 2 or 0 < n == min(len(x), len(y))


def shares_prefix(a: str, b: str) -> bool:
    return share_class_prefix(a, b) if a.endswith((".java", ".cs")) else share_underscore_prefix(a, b)


def subject_stem(path: str) -> str:
    """The stem tests are named after: without platform suffixes and leading underscores; a
    package's is its directory's."""
    s = stem(path)
    if s in ("__init__", "index", "mod", "lib"):
        s = posixpath.basename(posixpath.dirname(path)) or s
    if path.endswith(".go"):
        while _PLATFORM.search(s):
            s = _PLATFORM.sub("", s)
    return s.strip("_")


def test_stem(path: str) -> str:
    """What a test file is about, by its name."""
    s = stem(path)
    s = re.sub(r"\.(test|spec)$", "", s)
    s = re.sub(r"^test_|_test$|_tests$", "", s)
    if path.endswith((".java", ".cs")):
        s = re.sub(r"(Tests?|Spec)$|^Test(?=[A-Z])", "", s)
    return s.strip("_")


def mirrors(path: str) -> list[str]:
    """Directories where tests of a file's directory live, nearest first."""
    d = posixpath.dirname(path)
    out = [d, posixpath.join(d, "tests"), posixpath.join(d, "__tests__"), posixpath.join(posixpath.dirname(d), "tests")]
    if "src/main/java" in d:
        out.append(d.replace("src/main/java", "src/test/java"))
    if path.endswith(".cs") and "/" in d:
        top, _, rest = d.partition("/")
        out += [f"{top}{s}/{rest}" for s in (".Tests", ".Test")] + [f"tests/{top}{s}/{rest}" for s in (".Tests", ".Test")]
    if path.endswith(".rs") and "src" in d.split("/"):
        out.append(posixpath.join(*d.split("/")[: d.split("/").index("src")], "tests") if d.split("/").index("src") else "tests")
    return list(dict.fromkeys(out))


def is_direct_test(subject: str, test: str) -> bool:
    """A test of the subject by name, near it or in a mirror of its place."""
    s, t = subject_stem(subject), test_stem(test)
    d = posixpath.dirname(test)
    if s and t == s:
        return True
    named = bool(s) and len(s) > 2 and re.search(rf"(^|_){re.escape(s)}(_|$)", t) is not None
    return named and any(d == m or d.startswith(m + "/") for m in mirrors(subject))


def test_names(path: str) -> list[str]:
    """Base names a test of the file may have."""
    s = subject_stem(path)
    if path.endswith(".py"):
        parent = posixpath.basename(posixpath.dirname(path)).strip("_")
        return list(dict.fromkeys([f"test_{s}.py", f"{s}_test.py", *([f"test_{parent}_{s}.py"] if parent else [])]))
    if path.endswith(".go"):
        return [f"{s}_test.go"]
    if path.endswith(".java"):
        return [f"{s}Test.java", f"{s}Tests.java", f"Test{s}.java"]
    if path.endswith(".cs"):
        words = camel(s)
        tails = ["".join(words[k:]) for k in range(len(words))]
        return [f"{t}{x}.cs" for t in tails for x in ("Tests", "Test", "Spec")]
    if path.endswith(".rs"):
        return [f"{s}.rs", f"{s}_test.rs", f"test_{s}.rs"]
    ext = path.rsplit(".", 1)[-1]
    return [f"{s}.{k}.{ext}" for k in ("test", "spec")]


def topological(nodes: list[tuple[str, float, int]], edges: list[tuple[str, str]]) -> list[str]:
    """Files before those that import them.  ``nodes``: (path, score, outdegree) in their order.
    Of free ones the highest score, then the lowest outdegree, then the order decides; files on
    cycles come last, by outdegree, score and order."""
    place = {p: k for k, (p, _, _) in enumerate(nodes)}
    needs = {p: {d for s, d in edges if s == p and d in place and d != p} for p in place}
    out: list[str] = []
    left = dict(place)
    while left:
        free = [nodes[k] for p, k in left.items() if not needs[p] & left.keys()]
        if not free:
            rest = sorted((nodes[k] for k in left.values()), key=lambda n: (n[2], -n[1], place[n[0]]))
            return out + [p for p, _, _ in rest]
        best = min(free, key=lambda n: (-n[1], n[2], place[n[0]]))[0]
        out.append(best)
        del left[best]
    return out
