"""Import facts and signatures from source text.

Each language is one pass: comments and strings that can't matter are blanked (line ends
stay, so line numbers hold), then whole statements are matched, over several lines where
the language allows it.  A fact is (specifier, import_type, line, names).
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferngraph.functions import paths as P

Fact = tuple[str, str, int, list[str]]
FACTS = "path string, specifier string, import_type string, line int, imported_names array<string>"


def _blank(pattern: str, text: str) -> str:
    """Replace matches of group-less ``pattern`` by their line ends."""
    return re.sub(pattern, lambda m: "\n" * m[0].count("\n") + " ", text)


def _line(text: str, at: int) -> int:
    return text.count("\n", 0, at) + 1


def _names(text: str, alias: str = r"\s+as\s+") -> list[str]:
    return [n for n in (re.split(alias, p.strip())[0].strip() for p in text.split(",")) if n]


def python(text: str) -> Iterator[Fact]:
    # quoted strings are read first, so that a # in them opens no comment
    parts = re.compile(r"('''|\"\"\")(?:.|\n)*?(?:\1|\Z)|'(?:\\.|[^'\\\n])*'|\"(?:\\.|[^\"\\\n])*\"|#[^\n]*|\\\n")
    lines: list[int] = []

    def clear(m):
        if m[0] == "\\\n":
            lines.append(m.start())
            return " \r"
        return "\n" * m[0].count("\n") + ("''" if m[0][0] in "'\"" else "")

    clean = parts.sub(clear, text)
    where = lambda at: clean.count("\n", 0, at) + clean.count("\r", 0, at) + 1
    statement = re.compile(r"^[ \t]*(?:from[ \t\r]+(\.*[\w.]*)[ \t\r]+import[ \t\r]*(?:\(([^)]*)\)|([^\n;(]+))|import[ \t\r]+([^\n;]+))", re.M)
    for m in statement.finditer(clean):
        line = where(m.start() + len(m[0]) - len(m[0].lstrip()))
        if m[4] is not None:
            for name in _names(m[4]):
                yield name, "absolute", line, [name.rpartition(".")[2]] if "." in name else []
            continue
        kind = "relative" if m[1].startswith(".") else "absolute"
        names = _names(m[2] if m[2] is not None else m[3])
        for name in names or [""]:
            yield m[1], kind, line, [name] if name else []


_TS_FROM = re.compile(r"""(?:^|[;\n])[ \t]*(import|export)\s+(?:type\s+)?((?:[\w$]+\s*,\s*)?(?:\{[^}]*\}|\*(?:\s+as\s+[\w$]+)?|[\w$]+))\s+from\s*['"`]([^'"`\n]+)['"`]""")
_TS_BARE = re.compile(r"""(?:^|[;\n])[ \t]*import\s*['"`]([^'"`\n]+)['"`]""")
_TS_CALL = re.compile(r"""(?:(?:\{([^}]*)\}|([\w$]+))\s*=\s*(?:await\s+)?)?\b(?:require|import)\s*\(\s*['"`]([^'"`\n]+)['"`]\s*\)""")


def typescript(text: str) -> Iterator[Fact]:
    keep = re.compile(r"'(?:\\.|[^'\\\n])*'|\"(?:\\.|[^\"\\\n])*\"|/\*(?:.|\n)*?(?:\*/|\Z)|//[^\n]*")
    clean = keep.sub(lambda m: m[0] if m[0][0] in "'\"" else "\n" * m[0].count("\n"), text)
    found: list[tuple[int, Fact]] = []
    for m in _TS_FROM.finditer(clean):
        names: list[str] = []
        clause = m[2]
        if "{" in clause:
            names += _names(clause[: clause.index("{")].rstrip(" ,\n\t"))
            names += [re.sub(r"^type\s+", "", n) for n in _names(clause[clause.index("{") + 1 : clause.index("}")])]
        elif "*" in clause:
            names += [*_names(clause[: clause.index("*")].rstrip(" ,\n\t")), "*"]
        else:
            names.append(clause.strip())
        found.append((m.start(1), (m[3], "", 0, names)))
    found += [(m.start(1), (m[1], "", 0, [])) for m in _TS_BARE.finditer(clean)]
    for m in _TS_CALL.finditer(clean):
        names = [re.split(r"\s*:\s*", n)[0] for n in _names(m[1])] if m[1] is not None else []
        found.append((m.start(3), (m[3], "", 0, names)))
    for at, (spec, _, _, names) in sorted(found, key=lambda x: x[0]):
        yield spec, "relative" if spec.startswith(".") else "absolute", _line(clean, at), names


def go(text: str) -> Iterator[Fact]:
    clean = _blank(r"/\*(?:.|\n)*?(?:\*/|\Z)|(?<!:)//[^\n]*", text)
    stop = re.search(r"^(?:func|type|var|const)\b", clean, re.M)
    clean = clean[: stop.start()] if stop else clean
    one = re.compile(r'(?:([\w.]+)[ \t]+)?"([^"\n]+)"')
    for m in re.finditer(r'^[ \t]*import\b\s*(?:\(([^)]*)\)|((?:[\w.]+[ \t]+)?"[^"\n]+"))', clean, re.M):
        body, at = (m[1], m.start(1)) if m[1] is not None else (m[2], m.start(2))
        for x in one.finditer(body):
            if x[2] != "C":
                yield x[2], "absolute", _line(clean, at + x.start()), [x[1] or x[2].rpartition("/")[2]]


def java(text: str) -> Iterator[Fact]:
    clean = _blank(r"/\*(?:.|\n)*?(?:\*/|\Z)|//[^\n]*", text)
    stop = re.search(r"^[ \t]*(?:@\w+\s+)*(?:(?:public|protected|private|abstract|final|static|sealed|strictfp)\s+)*(?:class|interface|enum|record|@interface)\s+\w", clean, re.M)
    clean = clean[: stop.start()] if stop else clean
    for m in re.finditer(r"^[ \t]*import\s+(static\s+)?([\w.]+(?:\.\*)?)\s*;", clean, re.M):
        yield m[2], "static" if m[1] else "absolute", _line(clean, m.start(2)), [m[2].rpartition(".")[2]]
    package = re.search(r"^[ \t]*package\s+([\w.]+)\s*;", clean, re.M)
    if package:
        yield package[1] + ".*", "same_package", 0, []


def _use_tree(tree: str, prefix: str = "") -> Iterator[tuple[str, str]]:
    """(path, name) leaves of a use tree."""
    depth, start, parts = 0, 0, []
    for k, c in enumerate(tree):
        depth += (c == "{") - (c == "}")
        if c == "," and depth == 0:
            parts.append(tree[start:k])
            start = k + 1
    for part in [*parts, tree[start:]]:
        part = part.strip()
        if not part:
            continue
        if "{" in part:
            head = part[: part.index("{")].strip().removesuffix("::")
            yield from _use_tree(part[part.index("{") + 1 : part.rindex("}")], "::".join(x for x in (prefix, head) if x))
            continue
        path = re.split(r"\s+as\s+", part)[0].strip()
        if path == "self":
            yield prefix, prefix.rpartition("::")[2]
        else:
            full = "::".join(x for x in (prefix, path) if x)
            yield full, full.rpartition("::")[2]


def rust(text: str) -> Iterator[Fact]:
    clean = _blank(r"/\*(?:.|\n)*?(?:\*/|\Z)|//[^\n]*", text)
    item = re.compile(r"^[ \t]*(?:#\[[^\]]*\]\s*)*(?:pub(?:\([^)]*\))?\s+)?(?:use\s+([^;]+);|mod\s+(\w+)\s*;|extern\s+crate\s+(\w+)[^;]*;)", re.M)
    for m in item.finditer(clean):
        line = _line(clean, max(m.start(1), m.start(2), m.start(3)))
        if m[2]:
            yield f"mod:{m[2]}", "module", line, [m[2]]
        elif m[3]:
            yield f"extern:{m[3]}", "absolute", line, [m[3]]
        else:
            for path, name in _use_tree(re.sub(r"\s+", " ", m[1]).removeprefix("::")):
                kind = "relative" if re.match(r"(crate|super|self)(::|$)", path) else "absolute"
                yield path, kind, line, [name]


def csharp(text: str) -> Iterator[Fact]:
    clean = _blank(r"/\*(?:.|\n)*?(?:\*/|\Z)|//[^\n]*", text)
    space = re.search(r"^[ \t]*namespace\s+([\w.]+)", clean, re.M)
    stop = re.search(r"^[ \t]*(?:\[[^\]]*\]\s*)*(?:(?:public|internal|private|protected|abstract|sealed|static|partial|readonly|unsafe|file)\s+)*(?:class|interface|struct|enum|record|delegate)\s+\w", clean, re.M)
    head = clean[: stop.start()] if stop else clean
    for m in re.finditer(r"^[ \t]*(?:global\s+)?using\s+(static\s+)?(?:(\w+)\s*=\s*)?([\w.]+)\s*;", head, re.M):
        kind = "static" if m[1] else "alias" if m[2] else "absolute"
        yield m[3], kind, _line(head, m.start(3)), [m[2] or m[3].rpartition(".")[2]]
    if space:
        yield space[1] + ".*", "same_namespace", 0, []


EXTRACTORS = {"python": python, "typescript": typescript, "javascript": typescript, "go": go, "java": java, "rust": rust, "csharp": csharp}
# Prefixes and names of standard libraries.
JAVA_STD = ("java.", "javax.", "jdk.", "sun.", "com.sun.", "org.w3c.dom.", "org.xml.sax.", "org.ietf.jgss.")
RUST_STD = ("std::", "core::", "alloc::")
CSHARP_STD = ("System", "Microsoft", "Windows")


def python_stdlib() -> frozenset[str]:
    import sys

    return sys.stdlib_module_names


def is_stdlib(language: str, specifier: str) -> bool:
    if language == "python":
        return specifier.split(".")[0] in python_stdlib()
    if language == "java":
        return specifier.startswith(JAVA_STD)
    if language == "rust":
        return specifier.startswith(RUST_STD) or specifier in {p[:-2] for p in RUST_STD}
    if language == "csharp":
        return specifier.split(".")[0] in CSHARP_STD
    if language == "go":
        return "." not in specifier.split("/")[0]
    return False


def has_inline_tests(text):
    """Rust's inline test module, as a Column."""
    return F.contains(text, F.lit("#[cfg(test)]"))


def facts(contents: DataFrame) -> DataFrame:
    """FACTS of contents (path, text): Arrow batches in, facts out, no shuffle.  A file that
    can't be read gives none."""
    from ferngraph.session import ship

    ship(contents.sparkSession)

    def run(batches: Iterable[pd.DataFrame]):
        for b in batches:
            out = []
            for path, language, text in zip(b["path"], b["language"], b["text"], strict=True):
                out += [(path, *f) for f in EXTRACTORS[language](text)]
            yield pd.DataFrame(out, columns=["path", "specifier", "import_type", "line", "imported_names"])

    known = contents.select("path", P.language(F.col("path")).alias("language"), "text").where("language IS NOT NULL AND text IS NOT NULL")
    return known.mapInPandas(run, FACTS)


# Definitions: what starts one, by language, with the name in place of %s.
_DEFINITION = {
    "python": r"^[ \t]*(?:(?:async[ \t]+)?def|class)[ \t]+%s\b[^\n]*|^%s[ \t]*(?::[^=\n]+)?=[^\n]*",
    "typescript": r"^[ \t]*(?:export[ \t]+)?(?:default[ \t]+)?(?:declare[ \t]+)?(?:abstract[ \t]+|async[ \t]+|const[ \t]+)*(?:function[ \t]*\*?|class|interface|type|enum|const|let|var)[ \t]+%s\b[^\n]*",
    "go": r"^(?:func[ \t]+(?:\([^)\n]*\)[ \t]*)?|type[ \t]+|var[ \t]+|const[ \t]+)%s\b[^\n]*",
    "java": r"^[ \t]*(?:[\w@<>\[\], ]+[ \t])?(?:class|interface|enum|record)[ \t]+%s\b[^\n]*|^[ \t]*(?:public|protected|private)[^\n;=]*[ \t]%s[ \t]*\([^\n]*",
    "rust": r"^[ \t]*(?:pub(?:\([^)]*\))?[ \t]+)?(?:async[ \t]+|unsafe[ \t]+|const[ \t]+)*(?:fn|struct|enum|trait|type|mod|const|static|macro_rules!)[ \t]+%s\b[^\n]*",
    "csharp": r"^[ \t]*(?:[\w\[\]<>, ]+[ \t])?(?:class|interface|struct|enum|record|delegate)[ \t]+%s\b[^\n]*|^[ \t]*(?:public|internal|protected|private)[^\n;=]*[ \t]%s[ \t]*\([^\n]*",
}
_DEFINITION["javascript"] = _DEFINITION["typescript"]


def definitions(language: str, text: str, names: Iterable[str]) -> list[str]:
    """Signature lines of the names, in their order, without the body's brace."""
    limit = 150 if language in ("typescript", "javascript") else 120
    out = []
    for name in names:
        p = _DEFINITION[language]
        m = re.search(p.replace("%s", re.escape(name)), text, re.M)
        if m:
            s = re.sub(r"[ \t]*[{:]?[ \t]*$", "", m[0].strip())
            out.append(s if len(s) <= limit else s[:limit] + "...")
    return out


def signatures(language, text, names):
    """Signature lines as a Column, by an Arrow UDF over (language, text, names)."""

    @F.pandas_udf("array<string>")
    def run(language: pd.Series, text: pd.Series, names: pd.Series) -> pd.Series:
        return pd.Series([definitions(a, b or "", c if c is not None else []) if a in _DEFINITION else [] for a, b, c in zip(language, text, names, strict=True)])

    return run(language, text, names)
