"""Path predicates and labels as Column expressions (no Python per row)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extension -> language.
LANGUAGES = {
    "py": "python", "ts": "typescript", "tsx": "typescript", "mts": "typescript", "cts": "typescript",
    "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript",
    "go": "go", "java": "java", "rs": "rust", "cs": "csharp",
}
# Directories that are never scanned, besides hidden ones.
IGNORED_DIRS = ("__pycache__", "node_modules", "venv", "env", "dist", "build")
# Barrel file names.
BARRELS = ("index.ts", "index.tsx", "index.js", "index.jsx", "index.mts", "index.mjs", "index.cts", "index.cjs", "__init__.py")


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    """The directory, ``.`` at the root."""
    cut = F.length(path) - F.length(basename(path)) - 1
    return F.when(cut > 0, F.substring(path, F.lit(1), cut)).otherwise(F.lit("."))


def extension(path: Column) -> Column:
    b = basename(path)
    return F.when(F.instr(b, ".") > 0, F.substring_index(b, ".", -1)).otherwise(F.lit(""))


def stem(path: Column) -> Column:
    """The file name without its last extension."""
    b = basename(path)
    return F.when(F.instr(b, ".") > 1, F.regexp_replace(b, r"\.[^.]*$", "")).otherwise(b)


def language(path: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])[extension(path)]


def is_supported(path: Column) -> Column:
    return extension(path).isin(*LANGUAGES)


def is_skipped(path: Column) -> Column:
    """Some directory of the path is hidden, in IGNORED_DIRS or an egg-info."""
    parts = F.split(path, "/")
    bad = lambda p: (p.startswith(".") & (p != ".")) | p.isin(*IGNORED_DIRS) | p.endswith(".egg-info")
    return F.exists(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), bad)


def is_test(path: Column) -> Column:
    b, s = basename(path), stem(path)
    java = b.endswith(".java") & (s.endswith("Test") | s.endswith("Tests") | s.startswith("Test"))
    csharp = b.endswith(".cs") & (s.endswith("Test") | s.endswith("Tests") | s.endswith("Spec") | s.startswith("Test"))
    script = b.rlike(r"\.(test|spec)\.(ts|tsx|js|jsx)$")
    folder = path.rlike(r"(^|/)(tests|__tests__)/") | path.rlike(r"(^|/)src/test/")
    project = F.exists(F.split(path, "/"), lambda p: p.endswith(".Tests") | p.endswith(".Test"))
    return b.startswith("test_") | b.contains("_test.") | script | java | csharp | (b == "tests.rs") | folder | project


def is_ignorable(path: Column) -> Column:
    return path.rlike(r"(^|/)(docs|docs_src|examples)/") | (basename(path) == "conftest.py")


def is_non_source(path: Column) -> Column:
    return is_test(path) | is_ignorable(path)


def is_init(path: Column) -> Column:
    return basename(path) == "__init__.py"


def is_barrel(path: Column) -> Column:
    return basename(path).isin(*BARRELS)


def has_prefix(path: Column, prefixes: list[str]) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | path.startswith(p)
    return out


def group_key(path: Column) -> Column:
    """``packages/x`` and ``apps/x`` by two parts, else the first directory, ``.`` at the root."""
    parts = F.split(path, "/")
    return (
        F.when(F.size(parts) < 2, F.lit("."))
        .when(parts[0].isin("packages", "apps") & (F.size(parts) > 2), F.concat_ws("/", parts[0], parts[1]))
        .otherwise(parts[0])
    )


def role(path: Column, indegree: Column, outdegree: Column, entrypoint: Column, utility: Column, stable: Column) -> Column:
    """test, barrel, foundation, orchestrator, entrypoint, utility or nothing, in this priority."""
    return (
        F.when(is_test(path), "test")
        .when(is_barrel(path), "barrel")
        .when(stable & (outdegree <= 2), "foundation")
        .when((outdegree >= 5) & (indegree >= 5), "orchestrator")
        .when(entrypoint, "entrypoint")
        .when(utility, "utility")
        .otherwise("")
    )


def within(path: Column, root: str) -> Column:
    return path.startswith(root.rstrip("/") + "/")


def relative(path: Column, root: str) -> Column:
    return F.when(within(path, root), F.substring(path, len(root.rstrip("/")) + 2, 1 << 30)).otherwise(path)


def floor2(x: Column) -> Column:
    """Round half up to two digits on binary doubles, alike in every engine."""
    return F.floor(x * 100 + 0.5) / 100
