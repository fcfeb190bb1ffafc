"""Extraction, resolution and path queries, each with its SQL twin.

They run over the tree of ``samples``; a twin states what its statements must give."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferngraph import samples
from ferngraph.functions import extract, resolve
from ferngraph.functions import paths as P
from ferngraph.operators import change, neighbourhood, signals
from ferngraph.plans import index
from ferngraph.queries import _base, _dir, query
from ferngraph.session import table, written
from ferngraph.sources import tree as source

_FACT = ("path", "specifier", "import_type", "line", "names")
_EDGE = ("src_file", "dst_file", "specifier", "resolution_method", "line_number", "name")
_LOST = ("src_file", "specifier", "reason", "line_number")


def twin(tuples: list[tuple], names: tuple[str, ...]) -> str:
    return samples.rows(tuples, names).replace("{supplier}", "supplier")


def tree(spark, d, language: str | None = None) -> DataFrame:
    """(path, text) of the sample tree, or of one language's part of it."""
    found = spark.sql(samples.TREE, supplier=table(spark, d, "supplier"))
    return found if language is None else found.where(P.language(F.col("path")).isin(*([language, "javascript"] if language == "typescript" else [language])))


def _extraction(language: str):
    def f(r, spark, d):
        x = extract.facts(tree(spark, d, language))
        return x.select("path", "specifier", "import_type", F.col("line").cast("long").alias("line"), F.array_join("imported_names", ",").alias("names"))

    f.__name__ = f"ext_{language}"
    return query(twin(samples.of_language(samples.FACTS, language), _FACT))(f)


def _resolved(spark, d, language: str) -> tuple[DataFrame, DataFrame]:
    files = tree(spark, d, language)
    return resolve.resolve(extract.facts(files), files.select("path"), samples.CONFIG)


def _resolution(language: str):
    def edges(r, spark, d):
        return _resolved(spark, d, language)[0].select(*_EDGE)

    def lost(r, spark, d):
        return _resolved(spark, d, language)[1].select(*_LOST)

    edges.__name__, lost.__name__ = f"res_{language}", f"res_{language}_unresolved"
    query(twin(samples.of_language(samples.EDGES, language), _EDGE))(edges)
    query(twin(samples.of_language(samples.UNRESOLVED, language), _LOST))(lost)


for _language in ("python", "typescript", "go", "java", "rust", "csharp"):
    _extraction(_language)
    _resolution(_language)


def _listed(spark, d) -> DataFrame:
    """The tree as a listing with its texts."""
    return tree(spark, d).select("path", P.language(F.col("path")).alias("language"), F.sha2("text", 256).alias("content_hash"), "text")


def _index(spark, d) -> index.Index:
    t = _listed(spark, d)
    return index.build(t.drop("text"), t.select("path", "text"), samples.CONFIG)


@query(f"SELECT src_file, dst_file, specifier, min(line_number) AS line_number, coalesce(string_agg(name, ',' ORDER BY name), '') AS names FROM ({twin(samples.EDGES, _EDGE)}) GROUP BY 1, 2, 3")
def idx_edges(r, spark, d):
    """The whole index run: listing, extraction, resolution, merged edges."""
    e = _index(spark, d).edges
    return e.select("src_file", "dst_file", "specifier", "line_number", F.array_join(F.sort_array(F.filter("imported_names", lambda n: n.isNotNull())), ",").alias("names"))


@query(f"SELECT src_file, specifier, min(reason) AS reason FROM ({twin(samples.UNRESOLVED, _LOST)}) GROUP BY 1, 2")
def idx_unresolved(r, spark, d):
    return _index(spark, d).unresolved.select("src_file", "specifier", "reason")


@query(f"SELECT path, specifier, reason FROM (SELECT src_file AS path, specifier, reason FROM ({twin(samples.UNRESOLVED, _LOST)})) WHERE path LIKE '%/app.py'")
def flt_unresolved(r, spark, d):
    x = _resolved(spark, d, "python")[1]
    return signals.unresolved_of(x, x.select(F.col("src_file").alias("path")).where(F.col("path").endswith("/app.py")).distinct()).select("path", "specifier", "reason")


@query(twin(samples.DEFINITIONS, ("path", "name", "signature")))
def ext_definitions(r, spark, d):
    """Signature lines of the names that other files import, and of each project's own."""
    t = tree(spark, d)
    pairs = [F.when(F.col("path").rlike("^" + p.replace("~", "[0-9]+").replace(".", "[.]") + "$"), F.lit(n)) for p, n, _ in samples.DEFINITIONS]
    x = t.select("path", "text", F.array_compact(F.array(*pairs)).alias("names")).where(F.size("names") > 0)
    x = x.select("path", "names", extract.signatures(P.language(F.col("path")), F.col("text"), F.col("names")).alias("s"))
    return x.select("path", F.explode(F.arrays_zip("names", "s")).alias("z")).select("path", F.col("z.names").alias("name"), F.col("z.s").alias("signature"))


@query(f"SELECT path, contains(text, '#[cfg(test)]') AS inline FROM ({samples.TREE.replace('{supplier}', 'supplier')}) WHERE path LIKE '%.rs'")
def ext_inline_tests(r, spark, d):
    return tree(spark, d, "rust").select("path", extract.has_inline_tests(F.col("text")).alias("inline"))


@query("SELECT p AS path, p IN (SELECT path FROM files) AS found FROM (SELECT path AS p FROM files UNION ALL SELECT path || 'x' FROM files)")
def flt_exists(r, spark, d):
    f = r("files").select("path")
    return signals.exists(f.unionByName(f.select(F.concat("path", F.lit("x")).alias("path"))), f)


@query(f"SELECT d.dir, path FROM (SELECT DISTINCT {_dir('path')} AS dir FROM files) d JOIN files ON {_dir('path')} = d.dir AND starts_with({_base('path')}, 'test_')")
def flt_tests_in_dir(r, spark, d):
    f = r("files").where(P.is_test(F.col("path")))
    return neighbourhood.tests_in_dir(r("files").select(P.dirname(F.col("path")).alias("dir")).distinct(), f, ".py")


@query("SELECT path, starts_with(path, 'docs/') OR starts_with(path, 'src/mod3/') AS ignored FROM files")
def flt_config_prefix(r, spark, d):
    return r("files").select("path", P.has_prefix(F.col("path"), ["docs/", "src/mod3/"]).alias("ignored"))


@query("SELECT path, starts_with(path, 'src/') AS inside, CASE WHEN starts_with(path, 'src/') THEN path[5:] ELSE path END AS relative FROM files")
def flt_relative(r, spark, d):
    p = F.col("path")
    return r("files").select("path", P.within(p, "src").alias("inside"), P.relative(p, "src").alias("relative"))


@query("SELECT path FROM named WHERE regexp_matches(path, '[.](py|ts|go|rs|cs)$')")
def flt_supported(r, spark, d):
    return r("named").where(P.is_supported(F.col("path"))).select("path")


@query(f"SELECT path, regexp_matches({_base('path')}, '_test[.]|[.]test[.]|^test_') AS is_test FROM named")
def flt_test_names(r, spark, d):
    return r("named").select("path", P.is_test(F.col("path")).alias("is_test"))


@query("""SELECT 'src/f' || o_orderkey || '.py' AS path, CASE o_orderkey % 4 WHEN 0 THEN 'added' WHEN 1 THEN 'modified' WHEN 2 THEN 'deleted' ELSE 'renamed' END AS status FROM orders""")
def src_diff(r, spark, d):
    """Name-status lines, one of each kind of change."""
    letter = F.element_at(F.array(F.lit("A"), F.lit("M"), F.lit("D"), F.lit("R087")), (F.col("o_orderkey") % 4 + 1).cast("int"))
    path = F.concat(F.lit("src/f"), F.col("o_orderkey").cast("string"), F.lit(".py"))
    old = F.when(letter == "R087", F.concat(F.lit("\tsrc/old"), F.col("o_orderkey").cast("string"))).otherwise("")
    return change.parse_diff(table(spark, d, "orders").select(F.concat(letter, old, F.lit("\t"), path).alias("value")))


@query(
    """SELECT path, before IS NULL AS added, after IS NULL AS deleted FROM (SELECT path, max(h) FILTER (v = 1) AS before, max(h) FILTER (v = 2) AS after FROM (
SELECT path, 1 AS v, language AS h FROM files WHERE path NOT LIKE '%3.py' UNION ALL SELECT path, 2, CASE WHEN path LIKE '%1.py' THEN 'changed' ELSE language END FROM files WHERE path NOT LIKE '%7.py') GROUP BY 1)
WHERE before IS DISTINCT FROM after"""
)
def src_changes(r, spark, d):
    """Files added, altered or gone between two states of a tree, by their hashes."""
    f = r("files")
    before = f.where(~F.col("path").endswith("3.py")).select("path", F.col("language").alias("content_hash"))
    after = f.where(~F.col("path").endswith("7.py")).select("path", F.when(F.col("path").endswith("1.py"), "changed").otherwise(F.col("language")).alias("content_hash"))
    x = source.changes(before, after)
    return x.select("path", (F.col("change") == "added").alias("added"), (F.col("change") == "removed").alias("deleted"))


@query(twin([(*e[:3], e[5] or "") for e in samples.EDGES], ("src_file", "dst_file", "specifier", "name")))
def idx_refresh(r, spark, d):
    """An index of a tree without its app files, brought up to date when they come."""
    t = written(_listed(spark, d), "tree")
    old = index.build(t.where(~F.col("path").rlike("/[Aa]pp[.]")), t.where(~F.col("path").rlike("/[Aa]pp[.]")), samples.CONFIG)
    e = index.refresh(old, t, t, samples.CONFIG).edges
    return e.select("src_file", "dst_file", "specifier", F.explode_outer("imported_names").alias("name")).na.fill("", ["name"])
