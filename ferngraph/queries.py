"""The engine's operators as registered queries, each with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferngraph.adapters import relation, with_views
from ferngraph.functions import paths as P
from ferngraph.operators import change, neighbourhood, quality, ranking, signals, telemetry
from ferngraph.plans import report
from ferngraph.session import table, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(lambda name: relation(spark, sf_dir, name), spark, sf_dir)
            return df.select(*[F.col(c).cast("long").alias(c) if t in ("int", "smallint", "tinyint") else F.col(c) for c, t in df.dtypes])

        run.__name__ = f.__name__
        QUERIES[f.__name__] = run
        if sql:
            SQL[f.__name__] = with_views(sql)
        return f

    return add


# SQL forms of the path predicates.
def _base(c):
    return f"regexp_extract({c}, '[^/]*$')"


def _dir(c):
    return f"CASE WHEN strpos({c}, '/') > 0 THEN regexp_replace({c}, '/[^/]*$', '') ELSE '.' END"


def _test(c):
    return f"(regexp_matches({_base(c)}, '^test_') OR contains({_base(c)}, '_test.') OR regexp_matches({c}, '(^|/)(tests|__tests__)/') OR regexp_matches({c}, '(^|/)src/test/'))"


def _ignorable(c):
    return f"(regexp_matches({c}, '(^|/)(docs|docs_src|examples)/') OR {_base(c)} = 'conftest.py')"


DEGREE = f"""ind AS (SELECT dst_file AS p, count(DISTINCT src_file) AS n FROM edges WHERE NOT {_test('src_file')} AND NOT {_ignorable('src_file')} GROUP BY 1),
outd AS (SELECT src_file AS p, count(DISTINCT dst_file) AS n FROM edges GROUP BY 1),
sig AS (SELECT path AS file_path, coalesce(i.n, 0) AS indegree, coalesce(o.n, 0) AS outdegree,
  coalesce(i.n, 0) = 0 AND {_base('path')} <> '__init__.py' AS is_entrypoint, coalesce(o.n, 0) >= 5 AND coalesce(i.n, 0) <= 2 AS is_utility
  FROM files LEFT JOIN ind i ON i.p = path LEFT JOIN outd o ON o.p = path)"""
WINDOWED = """win AS (SELECT * FROM commit_files WHERE ts >= (SELECT max(ts) FROM commit_files) - INTERVAL 90 DAY),
small AS (SELECT hash FROM win GROUP BY 1 HAVING count(*) <= 100), cf AS (SELECT hash, file FROM win SEMI JOIN small USING (hash)),
churn AS (SELECT file AS file_path, count(*) AS value FROM cf GROUP BY 1),
pairs AS (SELECT a.file AS file_a, b.file AS file_b, count(*) AS frequency FROM cf a JOIN cf b ON a.hash = b.hash AND a.file < b.file GROUP BY 1, 2),
sym AS (SELECT file_a AS path, file_b AS partner, frequency FROM pairs UNION ALL SELECT file_b, file_a, frequency FROM pairs)"""


CYCLES = """ce AS (SELECT DISTINCT src_file, dst_file FROM edges WHERE src_file <> dst_file), cw AS (SELECT src_file AS subject, [src_file] AS path, dst_file AS node, 1 AS k FROM ce
UNION ALL SELECT cw.subject, list_append(cw.path, cw.node), ce.dst_file, k + 1 FROM cw JOIN ce ON ce.src_file = cw.node WHERE k < 6 AND cw.node <> cw.subject AND NOT list_contains(cw.path, cw.node)),
cyc AS (SELECT * FROM (SELECT subject, list_append(path, node) AS cycle, row_number() OVER (PARTITION BY subject ORDER BY list_append(path, node)) AS rank FROM cw WHERE node = subject) WHERE rank <= 5)"""


def _cycles(r) -> DataFrame:
    return neighbourhood.cycles(r("files").select(F.col("path").alias("subject")), r("edges"))


def _cycle_counts(r) -> DataFrame:
    return _cycles(r).groupBy("subject").agg(F.count("*").alias("cycles"))


def _signals(r) -> DataFrame:
    return signals.degree_signals(r("files"), r("edges"))


def _history(r, rows: DataFrame | None = None) -> DataFrame:
    """(hash, file) of the window, without the largest commits."""
    commits = (r("commit_files") if rows is None else rows).groupBy("hash", "ts").agg(F.collect_set("file").alias("files"))
    return signals.commit_files(signals.in_window(commits))


def _recent(r) -> DataFrame:
    """The commit files that the window may hold.  The newest run bounds the newest commit, so
    only later rows are joined; if the window begins before them, it is all rows."""
    rows, span = r("commit_files"), timedelta(days=signals.WINDOW_DAYS)
    newest = r("runs").agg(F.max("created_at")).first()[0]
    if newest is None:
        return rows
    # two days more than the window could need, as zones may shift what the driver reads
    late = written(rows.where(F.col("ts") >= F.lit(newest - 2 * span - timedelta(days=2))), "recent")
    head = late.agg(F.max("ts")).first()[0]
    return rows if head is None or head < newest - span else late


@query(f"WITH {DEGREE} SELECT * FROM sig")
def agg_degree(r, spark, d):
    return _signals(r)


@query(f"WITH {DEGREE} SELECT file_path, indegree, outdegree FROM sig ORDER BY indegree DESC, file_path LIMIT 10")
def srt_foundations(r, spark, d):
    return signals.foundations(_signals(r)).select("file_path", "indegree", "outdegree")


@query(f"WITH {DEGREE} SELECT file_path FROM sig WHERE is_entrypoint")
def srt_entrypoints(r, spark, d):
    return signals.entrypoints(_signals(r)).select("file_path")


@query(
    f"""WITH {DEGREE}, f AS (SELECT file_path FROM sig ORDER BY indegree DESC, file_path LIMIT 5)
SELECT file_path, indegree + outdegree AS degree FROM sig WHERE file_path NOT IN (SELECT file_path FROM f) AND indegree >= 1 AND outdegree >= 1
ORDER BY degree DESC, file_path LIMIT 10"""
)
def srt_orchestrators(r, spark, d):
    s = _signals(r)
    return signals.orchestrators(s, signals.foundations(s, 5).select("file_path")).select("file_path", "degree")


@query(
    """SELECT src_file, dst_file, specifier, min(line_number) AS line_number, string_agg(name, ',' ORDER BY seen, name) AS names FROM
(SELECT src_file, dst_file, specifier, name, min(line_number) AS seen, min(line_number) AS line_number FROM edge_rows GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3"""
)
def agg_merge_edges(r, spark, d):
    return signals.merge_edges(r("edge_rows")).select("src_file", "dst_file", "specifier", "line_number", F.array_join("imported_names", ",").alias("names"))


@query(
    """SELECT src_file, specifier, min(line_number) AS line_number, arg_min(name, struct_pack(a := line_number, b := name)) AS reason FROM edge_rows GROUP BY 1, 2"""
)
def snk_first_unresolved(r, spark, d):
    return signals.first_unresolved(r("edge_rows").withColumnRenamed("name", "reason"))


@query(f"WITH {WINDOWED} SELECT file_path, value FROM churn")
def agg_churn(r, spark, d):
    return signals.churn(_history(r))


@query(f"WITH {WINDOWED} SELECT file_a, file_b, frequency FROM pairs")
def agg_cochange(r, spark, d):
    return signals.co_change(_history(r))


@query(
    f"WITH {WINDOWED} SELECT path, partner, frequency, rank FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY frequency DESC, partner) AS rank FROM sym) WHERE rank <= 3"
)
def srt_partners(r, spark, d):
    return signals.top_partners(signals.co_change(_history(r)), 3)


@query(f"WITH {WINDOWED} SELECT file_path, value FROM churn SEMI JOIN (SELECT path AS file_path FROM files) USING (file_path) ORDER BY value DESC, file_path LIMIT 1")
def srt_highest_churn(r, spark, d):
    return signals.churn(_history(r)).join(r("files").select(F.col("path").alias("file_path")), "file_path", "left_semi").orderBy(F.desc("value"), "file_path").limit(1)


@query(
    f"""WITH {DEGREE}, {WINDOWED} SELECT (SELECT count(*) FROM files) AS files, (SELECT count(*) FROM edges) AS edges, (SELECT coalesce(max(indegree), 0) FROM sig) AS max_indegree,
(SELECT count(*) FROM sig WHERE is_entrypoint) AS entrypoints, (SELECT count(*) FROM sig WHERE is_utility) AS utilities,
(SELECT count(*) FROM churn) AS churn_rows, (SELECT coalesce(max(value), 0) FROM churn) AS max_churn, (SELECT count(*) FROM pairs) AS pairs"""
)
def agg_scalars(r, spark, d):
    n = F.count("*")
    flag = lambda c: F.count(F.when(F.col(c), 1))
    s = _signals(r).agg(n.alias("files"), F.coalesce(F.max("indegree"), F.lit(0)).alias("max_indegree"), flag("is_entrypoint").alias("entrypoints"), flag("is_utility").alias("utilities"))
    h = _history(r)
    c = signals.churn(h).agg(n.alias("churn_rows"), F.coalesce(F.max("value"), F.lit(0)).alias("max_churn"))
    return s.crossJoin(r("edges").agg(n.alias("edges"))).crossJoin(c).crossJoin(signals.co_change(h).agg(n.alias("pairs")))


NEAR = """adj AS (SELECT node, path, bool_or(imp) AS is_import, bool_or(NOT imp) AS is_importer FROM (SELECT src_file AS node, dst_file AS path, true AS imp FROM edges
UNION ALL SELECT dst_file, src_file, false FROM edges) GROUP BY 1, 2)"""


@query(f"WITH {NEAR} SELECT node AS subject, path, is_import, is_importer FROM adj WHERE node <> path")
def joi_direct(r, spark, d):
    return neighbourhood.direct(r("files").select(F.col("path").alias("subject")), r("edges"))


HOPS = f"""{NEAR}, z AS (SELECT path AS subject, path FROM files), d1 AS (SELECT z.subject, a.path, a.is_import, a.is_importer FROM z JOIN adj a ON a.node = z.subject WHERE a.path <> z.subject),
near AS (SELECT subject, path FROM z UNION SELECT subject, path FROM d1),
d2 AS (SELECT DISTINCT n.subject, a.path FROM near n JOIN adj a ON a.node = n.path ANTI JOIN near x ON x.subject = n.subject AND x.path = a.path),
bar AS (SELECT DISTINCT d1.subject, e.src_file AS path FROM d1 JOIN edges e ON e.dst_file = d1.path ANTI JOIN near x ON x.subject = d1.subject AND x.path = e.src_file WHERE d1.is_importer AND {_base('d1.path')} = '__init__.py'),
tst AS (SELECT DISTINCT n.subject, e.src_file AS path FROM near n JOIN edges e ON e.dst_file = n.path ANTI JOIN near x ON x.subject = n.subject AND x.path = e.src_file WHERE NOT {_test('n.path')} AND {_test('e.src_file')}),
cand AS (SELECT subject, path, min(d) AS distance, bool_or(is_import) AS is_import, bool_or(is_importer) AS is_importer, bool_or(t) AS is_transitive FROM (
SELECT subject, path, 0 AS d, false AS is_import, false AS is_importer, false AS t FROM z UNION ALL SELECT subject, path, 1, is_import, is_importer, false FROM d1
UNION ALL SELECT subject, path, 2, false, false, false FROM d2 UNION ALL SELECT subject, path, 2, false, false, true FROM bar UNION ALL SELECT subject, path, 2, false, false, false FROM tst) GROUP BY 1, 2)"""


@query(f"WITH {HOPS} SELECT subject, path, CAST(distance AS BIGINT) AS distance, is_import, is_importer, is_transitive FROM cand")
def gra_neighbourhood(r, spark, d):
    return neighbourhood.collect(r("files").select(F.col("path").alias("subject")), r("edges"))


@query(f"WITH {NEAR} SELECT s.node AS subject, e.src_file, e.dst_file FROM edges e JOIN adj s ON s.path = e.src_file AND s.node <> s.path JOIN adj t ON t.path = e.dst_file AND t.node = s.node AND t.node <> t.path")
def joi_induced(r, spark, d):
    near = neighbourhood.direct(r("files").select(F.col("path").alias("subject")), r("edges"))
    return neighbourhood.induced(near, r("edges"))


SCORED = f"""{HOPS}, {DEGREE}, {WINDOWED}, en AS (SELECT c.*, coalesce(s.indegree, 0) AS indegree, coalesce(s.outdegree, 0) AS outdegree, coalesce(s.is_entrypoint, false) AS is_entrypoint,
coalesce(ch.value, 0) / (SELECT CAST(max(value) AS DOUBLE) FROM churn) AS churn, coalesce(p.frequency, 0) AS co_change
FROM cand c LEFT JOIN sig s ON s.file_path = c.path LEFT JOIN churn ch ON ch.file_path = c.path LEFT JOIN sym p ON p.path = c.subject AND p.partner = c.path),
mx AS (SELECT max(indegree) AS mi FROM sig),
b AS (SELECT en.*, max(co_change) OVER (PARTITION BY subject) AS mc, CASE WHEN mi > 0 THEN 4.0::DOUBLE * indegree / mi ELSE 0 END + CASE WHEN distance = 1 THEN 3.0::DOUBLE ELSE 0 END
+ CASE WHEN is_entrypoint THEN 1.0::DOUBLE ELSE 0 END + CASE WHEN indegree >= 3 THEN 1.5::DOUBLE ELSE 0 END + CASE WHEN distance = 1 THEN 2.0::DOUBLE ELSE 0 END + CASE WHEN is_transitive THEN 1.0::DOUBLE ELSE 0 END AS base FROM en, mx),
scored AS (SELECT *, CASE WHEN distance = 0 THEN 100.0::DOUBLE ELSE base + least(CASE WHEN mc > 0 THEN 2.0::DOUBLE * co_change / mc ELSE 0 END + churn, (CASE WHEN distance = 2 THEN 1.5::DOUBLE ELSE 0.5::DOUBLE END) * base) END AS score FROM b)"""


def _measured(r) -> tuple[DataFrame, ...]:
    """Subjects, edges, signals, churn and pairs.  They are read several times each, so they are tables."""
    edges = written(r("edges"), "edges")
    s = written(signals.degree_signals(r("files"), edges), "signals")
    h = written(_history(r, _recent(r)), "history")
    subjects = r("files").select(F.col("path").alias("subject"))
    return subjects, edges, s, written(signals.churn(h), "churn"), written(signals.co_change(h), "pairs")


def _scored(r) -> DataFrame:
    """Scored candidates of every file."""
    given = _measured(r)
    return ranking.score(ranking.enriched(*given), given[2].agg(F.max("indegree").alias("max_indegree")))


@query(f"WITH {SCORED} SELECT subject, path, CAST(floor(score * 1000000 + 0.5) AS BIGINT) AS score, co_change FROM scored")
def rnk_score(r, spark, d):
    return _scored(r).select("subject", "path", F.floor(F.col("score") * 1000000 + 0.5).alias("score"), "co_change")


SECTIONS = f"""{SCORED}, k AS (SELECT *, CASE WHEN {_test('path')} AND NOT {_test('subject')} THEN 'test' WHEN {_ignorable('path')} THEN NULL WHEN distance <= 1 AND is_import THEN 'forward'
WHEN distance <= 1 THEN 'reverse' WHEN {_base('path')} = '__init__.py' AND {_base('subject')} <> '__init__.py' THEN NULL ELSE 'two_hop' END AS kind,
CASE WHEN ({_test('path')} AND NOT {_test('subject')}) OR {_ignorable('path')} THEN NULL
WHEN co_change >= 3 OR (is_import AND indegree <= 2) OR (is_importer AND co_change >= 2) THEN CASE WHEN co_change >= 5 OR (is_import AND indegree <= 2 AND co_change >= 1) OR (is_importer AND co_change >= 3) THEN 'high' ELSE 'medium' END
WHEN co_change = 2 OR (is_importer AND co_change = 1) OR (is_import AND indegree > 2 AND indegree <= 4 AND co_change >= 1) OR (is_importer AND distance = 1 AND co_change = 0)
THEN CASE WHEN ({_dir('path')} = {_dir('subject')} AND is_importer AND co_change = 0) OR (is_import AND is_importer) THEN 'medium' ELSE 'low' END END AS confidence
FROM scored WHERE path <> subject),
q AS (SELECT *, CASE kind WHEN 'forward' THEN 1 WHEN 'reverse' THEN CASE WHEN count(*) FILTER (kind = 'reverse') OVER (PARTITION BY subject) >= 50 THEN 4 ELSE 3 END WHEN 'two_hop' THEN 5 END AS queue,
CASE confidence WHEN 'high' THEN 0 WHEN 'medium' THEN 1 WHEN 'low' THEN 2 END AS crank FROM k),
n AS (SELECT *, row_number() OVER (PARTITION BY subject, queue <= 3 ORDER BY queue, score DESC, indegree DESC, path) AS qn,
row_number() OVER (PARTITION BY subject, kind ORDER BY (co_change = 0)::INT, score DESC, indegree DESC, path) AS hn,
row_number() OVER (PARTITION BY subject, crank IS NOT NULL ORDER BY crank, score DESC, path) AS ln,
row_number() OVER (PARTITION BY subject, coalesce(kind, '') = 'test' ORDER BY score DESC, indegree DESC, path) AS tn FROM q),
f AS (SELECT *, coalesce(queue <= 3 AND qn <= 10, false) AS must, crank IS NOT NULL AND ln <= 15 AS lm FROM n),
g AS (SELECT *, coalesce((queue <= 4 AND NOT must) OR (queue = 5 AND hn <= 10), false) AND NOT lm AS rel FROM f),
h AS (SELECT *, row_number() OVER (PARTITION BY subject, rel ORDER BY score DESC, path) AS rn FROM g)"""


@query(
    f"""WITH {SECTIONS} SELECT subject, 'must_read' AS section, qn AS rank, path, NULL::VARCHAR AS confidence FROM h WHERE must
UNION ALL SELECT subject, 'likely_modify', ln, path, confidence FROM h WHERE lm UNION ALL SELECT subject, 'related', rn, path, NULL FROM h WHERE rel AND rn <= 10
UNION ALL SELECT subject, 'tests', tn, path, NULL FROM h WHERE kind = 'test'"""
)
def rnk_sections(r, spark, d):
    return ranking.Shown(*_measured(r)).sections()


@query(
    f"""WITH RECURSIVE {SECTIONS}, {CYCLES}, t AS (SELECT subject, count(crank) AS n_likely, count(*) FILTER (confidence = 'low' AND distance >= 2) AS low_far, count(*) FILTER (kind = 'reverse') AS importers FROM h GROUP BY 1)
SELECT t.subject, n_likely, low_far, importers, CASE WHEN {_test('t.subject')} THEN CASE WHEN t.subject IN (SELECT subject FROM cyc) THEN 'medium' ELSE 'low' END WHEN n_likely - low_far >= 15 OR importers >= 50 THEN 'high' WHEN n_likely >= 5 OR importers >= 5 OR t.subject IN (SELECT subject FROM cyc) THEN 'medium' ELSE 'low' END AS level,
CASE WHEN indegree + outdegree > 0 THEN floor(outdegree::DOUBLE / (indegree + outdegree) * 100 + 0.5) / 100 ELSE 0 END AS fragility
FROM t JOIN sig ON sig.file_path = t.subject"""
)
def agg_blast(r, spark, d):
    x = _scored(r).where("path <> subject").withColumns({c: F.lit(False) for c in ranking.PACKAGE_FLAGS})
    path, subject = F.col("path"), F.col("subject")
    off = (P.is_test(path) & ~P.is_test(subject)) | P.is_ignorable(path)
    x = x.withColumn("confidence", F.when(~off, ranking.confidence()))
    g = x.groupBy("subject").agg(
        F.count("confidence").alias("n_likely"),
        F.count(F.when((F.col("confidence") == "low") & (F.col("distance") >= 2), 1)).alias("low_far"),
        F.count(F.when(~off & (F.col("distance") == 1) & ~F.col("is_import"), 1)).alias("importers"),
    )
    s = _signals(r).withColumnRenamed("file_path", "subject")
    level = ranking.blast(F.col("n_likely"), F.col("low_far"), F.col("importers"), P.is_test(F.col("subject")), ranking.Caps().likely_modify, F.coalesce("cycles", F.lit(0)))
    return g.join(s, "subject").join(_cycle_counts(r), "subject", "left").select("subject", "n_likely", "low_far", "importers", level.alias("level"), ranking.fragility(F.col("indegree"), F.col("outdegree")).alias("fragility"))


@query(
    f"""WITH {SCORED}, th AS (SELECT greatest(5, max(indegree) // 2) AS t FROM sig)
SELECT subject, string_agg(path, ',' ORDER BY path) AS hotspots FROM scored, th WHERE path <> subject AND churn >= 0.5 AND indegree >= t GROUP BY 1"""
)
def flt_hotspots(r, spark, d):
    x = _scored(r)
    top = _signals(r).agg(ranking.stable_threshold(F.max("indegree")).alias("t"))
    x = x.crossJoin(F.broadcast(top)).where("path <> subject AND churn >= 0.5 AND indegree >= t")
    return x.groupBy("subject").agg(F.array_join(F.sort_array(F.collect_list("path")), ",").alias("hotspots"))


@query(
    f"""WITH {HOPS}, {WINDOWED}, o AS (SELECT s.path, s.partner, s.frequency FROM sym s ANTI JOIN cand c ON c.subject = s.path AND c.path = s.partner SEMI JOIN files f ON f.path = s.partner WHERE s.frequency >= 3)
SELECT path, partner, frequency, rank FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY frequency DESC, partner) AS rank FROM o) WHERE rank <= 5 AND path IN (SELECT path FROM files)"""
)
def joi_hidden_coupling(r, spark, d):
    subjects = r("files").select(F.col("path").alias("subject"))
    near = neighbourhood.collect(subjects, r("edges")).select("subject", "path")
    return change.hidden_coupling(r("files"), signals.co_change(_history(r)), near, r("files"))


@query(f"WITH RECURSIVE {CYCLES} SELECT subject, array_to_string(cycle, '>') AS cycle, rank FROM cyc")
def gra_cycles(r, spark, d):
    return _cycles(r).select("subject", F.array_join("cycle", ">").alias("cycle"), "rank")


@query(
    f"""SELECT path, {_base('path')} AS base, {_dir('path')} AS dir, {_test('path')} AS is_test, {_ignorable('path')} AS is_ignorable, {_base('path')} = '__init__.py' AS is_barrel,
CASE WHEN strpos(path, '/') = 0 THEN '.' ELSE regexp_extract(path, '^[^/]*') END AS group_key FROM files"""
)
def flt_classify(r, spark, d):
    p = F.col("path")
    return r("files").select(p, P.basename(p).alias("base"), P.dirname(p).alias("dir"), P.is_test(p).alias("is_test"), P.is_ignorable(p).alias("is_ignorable"), P.is_barrel(p).alias("is_barrel"), P.group_key(p).alias("group_key"))


@query(
    f"""WITH {DEGREE}, th AS (SELECT greatest(5, max(indegree) // 2) AS t FROM sig) SELECT file_path, indegree >= t AS stable, CASE WHEN {_test('file_path')} THEN 'test'
WHEN {_base('file_path')} = '__init__.py' THEN 'barrel' WHEN indegree >= t AND outdegree <= 2 THEN 'foundation' WHEN indegree >= 5 AND outdegree >= 5 THEN 'orchestrator' WHEN is_entrypoint THEN 'entrypoint'
WHEN is_utility THEN 'utility' ELSE '' END AS role FROM sig, th"""
)
def prj_role(r, spark, d):
    s = _signals(r)
    x = s.crossJoin(F.broadcast(s.agg(ranking.stable_threshold(F.max("indegree")).alias("t"))))
    c = F.col
    stable = c("indegree") >= c("t")
    return x.select("file_path", stable.alias("stable"), P.role(c("file_path"), c("indegree"), c("outdegree"), c("is_entrypoint"), c("is_utility"), stable).alias("role"))


@query(f"WITH {NEAR} SELECT node AS subject, path, CASE WHEN is_import AND is_importer THEN 'mutual' WHEN is_import THEN 'imports' ELSE 'imported_by' END AS direction FROM adj WHERE node <> path")
def prj_direction(r, spark, d):
    x = neighbourhood.direct(r("files").select(F.col("path").alias("subject")), r("edges")).withColumn("same_package", F.lit(False))
    return x.select("subject", "path", ranking.direction().alias("direction"))


@query("SELECT path FROM files WHERE contains(lower(path), 'mod3/s') ORDER BY path LIMIT 50")
def flt_path_search(r, spark, d):
    return signals.search_path(r("files"), "MOD3/s").select("path")


@query("SELECT path FROM files SEMI JOIN (SELECT DISTINCT dst_file AS path FROM edge_rows WHERE name = 'R') USING (path) ORDER BY path LIMIT 20")
def joi_symbol_search(r, spark, d):
    return signals.search_symbol(signals.merge_edges(r("edge_rows")), r("files"), "R", 20).select("path")


@query("SELECT src_file AS path, dst_file AS neighbour, string_agg(DISTINCT name, ',' ORDER BY name) AS names FROM edge_rows GROUP BY 1, 2")
def agg_symbol_map(r, spark, d):
    return signals.symbol_map(signals.merge_edges(r("edge_rows"))).select("path", "neighbour", F.array_join("names", ",").alias("names"))


@query(
    """SELECT dir, language, count(*) AS n, CAST(2 * grouping(dir) + grouping(language) AS BIGINT) AS level FROM
(SELECT CASE WHEN strpos(path, '/') > 0 THEN regexp_extract(path, '^[^/]*') ELSE '.' END AS dir, language FROM files) GROUP BY CUBE (dir, language)"""
)
def agg_directory(r, spark, d):
    return signals.directory_structure(r("files"))


@query(f"SELECT {_dir('dst_file')} AS dir, count(DISTINCT src_file) AS importers FROM edges WHERE {_dir('dst_file')} <> {_dir('src_file')} GROUP BY 1")
def agg_package_importers(r, spark, d):
    return signals.package_importers(r("edges"))


_UNRES = "SELECT src_file, specifier, CASE name WHEN 'R' THEN 'not_found' WHEN 'A' THEN 'external' ELSE 'stdlib' END AS reason FROM edge_rows"


def _unresolved(r) -> DataFrame:
    reason = F.when(F.col("name") == "R", "not_found").when(F.col("name") == "A", "external").otherwise("stdlib")
    return r("edge_rows").select("src_file", "specifier", reason.alias("reason"))


@query(f"SELECT reason, count(*) AS n FROM ({_UNRES}) GROUP BY 1")
def agg_unresolved(r, spark, d):
    return _unresolved(r).groupBy("reason").agg(F.count("*").alias("n"))


@query(
    f"""WITH ok AS (SELECT src_file AS path, count(*) AS resolved FROM edges GROUP BY 1), bad AS (SELECT src_file AS path, count(*) AS not_found FROM ({_UNRES}) WHERE reason = 'not_found' GROUP BY 1)
SELECT coalesce(ok.path, bad.path) AS path, coalesce(resolved, 0) AS resolved, coalesce(not_found, 0) AS not_found,
floor(coalesce(resolved, 0)::DOUBLE / (coalesce(resolved, 0) + coalesce(not_found, 0)) * 100 + 0.5) / 100 AS confidence FROM ok FULL JOIN bad ON ok.path = bad.path"""
)
def agg_resolution(r, spark, d):
    return signals.resolution(r("edges"), _unresolved(r))


@query(
    f"""WITH f AS (SELECT path, {_dir('path')} AS dir, regexp_extract({_base('path')}, '^[^_.]*') AS head FROM files WHERE NOT {_test('path')}), s AS (SELECT path, {_dir('path')} AS dir, regexp_extract({_base('path')}, '^[^_.]*') AS head FROM files),
z AS (SELECT dir, count(*) AS n FROM f GROUP BY 1)
SELECT subject, path, prefix_match, package_size, rank FROM (SELECT s.path AS subject, f.path, s.head = f.head AS prefix_match, z.n AS package_size,
row_number() OVER (PARTITION BY s.path ORDER BY (s.head = f.head) DESC, f.path) AS rank FROM s JOIN f ON f.dir = s.dir AND f.path <> s.path JOIN z ON z.dir = s.dir WHERE z.n <= 20 OR s.head = f.head) WHERE rank <= 10"""
)
def flt_siblings(r, spark, d):
    return neighbourhood.siblings(r("files").select(F.col("path").alias("subject")), r("files"))


@query(
    f"""WITH d AS (SELECT DISTINCT regexp_replace({_dir('path')}, '/tests$', '') AS dir FROM files) SELECT d.dir, path FROM d JOIN files ON starts_with(path, d.dir || '/') AND ends_with(path, '.py') AND {_test('path')}"""
)
def flt_tests_under_dir(r, spark, d):
    dirs = r("files").select(F.regexp_replace(P.dirname(F.col("path")), "/tests$", "").alias("dir")).distinct()
    return neighbourhood.tests_in_dir(dirs, r("files").where(P.is_test(F.col("path"))), ".py", recursive=True)


@query(
    f"""WITH k AS (SELECT path, 'test_s' || 13 * CAST(regexp_extract({_base('path')}, '[0-9]+') AS BIGINT) || '.py' AS name FROM files WHERE regexp_matches({_base('path')}, '^s[0-9]+[.]py$'))
SELECT k.path AS path, t.path AS test FROM k JOIN files t ON {_base('t.path')} = k.name"""
)
def flt_tests_by_name(r, spark, d):
    number = F.regexp_extract(P.basename(F.col("path")), r"^s([0-9]+)\.py$", 1)
    names = r("files").where(number != "").select(F.col("path").alias("src"), F.concat(F.lit("test_s"), (number.cast("long") * 13).cast("string"), F.lit(".py")).alias("name"))
    found = neighbourhood.files_by_name(names.select("name").distinct(), r("files"))
    return names.join(found, "name").select(F.col("src").alias("path"), F.col("path").alias("test"))


# --- change -----------------------------------------------------------------------
@query(
    """SELECT least(src_file, dst_file) AS file_a, greatest(src_file, dst_file) AS file_b, CASE WHEN count(*) = 2 THEN 'mutual' WHEN bool_or(src_file < dst_file) THEN 'a_imports_b' ELSE 'b_imports_a' END AS direction
FROM edges WHERE src_file <> dst_file AND src_file IN (SELECT path FROM changed) AND dst_file IN (SELECT path FROM changed) GROUP BY 1, 2"""
)
def agg_coupling(r, spark, d):
    return change.coupling(r("changed"), r("edges"))


RISK = f"""{NEAR}, {CYCLES}, cn AS (SELECT subject AS path, count(*) AS cycles FROM cyc GROUP BY 1), {DEGREE}, {WINDOWED}, cc AS (SELECT s.path, CAST(sum(frequency) AS BIGINT) AS co_change FROM sym s WHERE s.path IN (SELECT path FROM changed) AND s.partner IN (SELECT path FROM changed) GROUP BY 1),
nb AS (SELECT node AS path, count(*) FILTER (is_importer) AS importers, count(*) FILTER (is_import AND is_importer) AS mutual, bool_or({_test('path')} AND is_importer) AS dep FROM adj WHERE node <> path GROUP BY 1),
nt AS (SELECT DISTINCT f.path FROM changed f JOIN files t ON {_base('t.path')} = 'test_' || regexp_replace({_base('f.path')}, '\\.py$', '') || '.py'),
x AS (SELECT c.path, status, indexed, coalesce(importers, 0) AS importers, coalesce(mutual, 0) AS mutual, coalesce(dep, false) AS dep, nt.path IS NOT NULL AS direct, coalesce(co_change, 0) AS co_change, coalesce(cycles, 0) AS cycles,
CASE WHEN indegree + outdegree > 0 THEN floor(outdegree::DOUBLE / (indegree + outdegree) * 100 + 0.5) / 100 ELSE 0 END AS fragility, (SELECT max(indegree) FROM sig) AS mi,
CASE status WHEN 'added' THEN CASE WHEN {_test('c.path')} THEN 10 ELSE 20 END WHEN 'modified' THEN 30 ELSE 5 END AS base
FROM changed c JOIN sig ON sig.file_path = c.path LEFT JOIN nb ON nb.path = c.path LEFT JOIN cc ON cc.path = c.path LEFT JOIN nt ON nt.path = c.path LEFT JOIN cn ON cn.path = c.path),
y AS (SELECT *, CASE WHEN NOT indexed THEN base ELSE greatest(0, least(100, floor((base + CASE WHEN status = 'modified' THEN CASE WHEN mi > 0 THEN least(1.0::DOUBLE, importers::DOUBLE / mi) ELSE 0 END * 3.0::DOUBLE
+ least(10.0::DOUBLE, co_change * 2.0::DOUBLE) + fragility * 15.0::DOUBLE + mutual * 5.0::DOUBLE + cycles * 10.0::DOUBLE ELSE 0 END) * CASE WHEN {_test('path')} THEN 0.7::DOUBLE WHEN direct THEN 0.7::DOUBLE WHEN dep THEN 0.85::DOUBLE ELSE 1.2::DOUBLE END + 0.5))) END AS s FROM x),
risk AS (SELECT path, status, indexed, direct, CAST(s AS BIGINT) AS risk_score, CASE WHEN s <= 20 THEN 'SAFE' WHEN s <= 50 THEN 'REVIEW' WHEN s <= 75 THEN 'TEST' ELSE 'CRITICAL' END AS risk_tier FROM y)"""


def _risk(r) -> DataFrame:
    signal = written(_signals(r), "signals")
    return report.scored(r("changed"), r("files"), r("edges"), signal, signals.co_change(_history(r)), _cycle_counts(r))


@query(f"WITH RECURSIVE {RISK} SELECT path, status, risk_score, risk_tier FROM risk")
def chg_risk(r, spark, d):
    return _risk(r).select("path", "status", "risk_score", "risk_tier")


@query(
    f"""WITH RECURSIVE {RISK}, w AS (SELECT y.*, risk_score, risk_tier, concat_ws(', ', CASE WHEN importers > 0 THEN importers || ' importers' END, CASE WHEN cycles > 0 THEN cycles || ' cycles' END,
CASE WHEN mutual > 0 THEN mutual || ' mutual imports' END, CASE WHEN NOT y.direct THEN 'no test of its own' END) AS f FROM y JOIN risk USING (path))
SELECT path, left({_base('path')} || ' is ' || status || ', risk ' || risk_score || ' (' || risk_tier || ')' || CASE WHEN f <> '' THEN '. ' || f ELSE '' END, 200) AS narrative FROM w"""
)
def chg_narrative(r, spark, d):
    return report.told(_risk(r)).select("path", "narrative")


@query(
    f"""WITH RECURSIVE {RISK}, t AS (SELECT dst_file AS path, min(src_file) AS test FROM edges WHERE {_test('src_file')} GROUP BY 1)
SELECT r.path, CASE WHEN t.test IS NOT NULL THEN 'run ' || t.test ELSE 'add a test for ' || {_base('r.path')} END AS suggestion FROM risk r LEFT JOIN t ON t.path = r.path
WHERE risk_tier IN ('TEST', 'CRITICAL') AND NOT {_test('r.path')}"""
)
def chg_suggestions(r, spark, d):
    return change.suggestions(_risk(r), report.test_imports(r("edges")))


@query(f"WITH RECURSIVE {RISK} SELECT 'files' AS part, count(*) AS n FROM risk UNION ALL SELECT 'triage', count(DISTINCT risk_tier) FROM risk UNION ALL SELECT 'aggregate', 1 UNION ALL SELECT 'summary', 1 UNION ALL SELECT 'top', count(DISTINCT risk_tier) FROM risk")
def chg_report(r, spark, d):
    """The report as one plan; its relations have queries of their own, here they are counted."""
    edges = written(r("edges"), "edges")
    parts = report.report(r("changed"), r("files"), edges, written(_signals(r), "signals"), written(signals.co_change(_history(r)), "pairs"), _cycle_counts(r))
    out = None
    for name in ("files", "triage", "aggregate", "summary", "top"):
        n = parts[name].agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n")
        out = n if out is None else out.unionByName(n)
    return out


@query(f"WITH RECURSIVE {RISK} SELECT risk_tier, count(*) AS n, string_agg(path, ',' ORDER BY path) AS files FROM risk GROUP BY 1")
def agg_triage(r, spark, d):
    return change.triage(_risk(r))


@query(
    f"""WITH RECURSIVE {RISK} SELECT max(risk_score) AS score, floor(count(*) FILTER (direct AND NOT {_test('path')})::DOUBLE / count(*) FILTER (NOT {_test('path')}) * 100 + 0.5) / 100 AS tested_share,
count(*) FILTER (risk_tier IN ('TEST', 'CRITICAL')) AS risky FROM risk"""
)
def agg_aggregate_risk(r, spark, d):
    return change.aggregate_risk(_risk(r)).drop("text")


@query(
    f"""WITH RECURSIVE {RISK}, o AS (SELECT risk_tier, {_base('path')} AS b, row_number() OVER (PARTITION BY risk_tier ORDER BY risk_score DESC, path) AS k, count(*) OVER (PARTITION BY risk_tier) AS n FROM risk)
SELECT risk_tier, string_agg(b, ', ' ORDER BY k) FILTER (k <= 3) || CASE WHEN max(n) > 3 THEN ' +' || (max(n) - 3) || ' more' ELSE '' END AS names FROM o GROUP BY 1"""
)
def srt_top_risk_names(r, spark, d):
    return change.top_risk_names(_risk(r))


@query(
    f"""SELECT count(*) AS total, count(*) FILTER (status = 'added') AS added, count(*) FILTER (status = 'modified') AS modified, count(*) FILTER (status = 'deleted') AS deleted, count(*) FILTER (status = 'renamed') AS renamed,
count(*) FILTER (indexed) AS indexed, count(*) FILTER ({_test('path')}) AS tests, 0::BIGINT AS high_risk FROM changed"""
)
def agg_change_summary(r, spark, d):
    return change.summary(r("changed").withColumn("blast_level", F.lit("low")))


@query(
    f"""WITH t AS (SELECT e.dst_file AS path, e.src_file AS test FROM edges e WHERE {_test('e.src_file')})
SELECT path FROM changed c WHERE NOT {_test('path')} AND NOT EXISTS (SELECT 1 FROM t WHERE t.path = c.path AND contains({_base('t.test')}, regexp_replace({_base('c.path')}, '\\.py$', '')))"""
)
def agg_test_gaps(r, spark, d):
    tests = r("edges").where(P.is_test(F.col("src_file"))).select(F.col("dst_file").alias("path"), F.col("src_file").alias("file"), F.lit(True).alias("direct"))
    return change.test_gaps(r("changed"), tests)


# --- telemetry --------------------------------------------------------------------
@query("SELECT blast_level AS level, count(*) AS n, 100.0::DOUBLE * count(*) / sum(count(*)) OVER () AS percent FROM runs GROUP BY 1")
def agg_blast_distribution(r, spark, d):
    return telemetry.blast_distribution(r("runs"))


@query("SELECT file_path, count(*) AS n, max(created_at) AS last_seen FROM hotspots JOIN runs ON runs.id = run_id GROUP BY 1 ORDER BY n DESC, file_path LIMIT 20")
def agg_hotspot_evolution(r, spark, d):
    return telemetry.hotspot_evolution(r("hotspots"), r("runs"), 20)


@query("SELECT id, created_at, blast_level FROM runs WHERE branch = '1-URGENT' ORDER BY created_at DESC, id DESC LIMIT 25")
def srt_trend(r, spark, d):
    return telemetry.trend(r("runs"), 25, "1-URGENT").select("id", "created_at", "blast_level")


@query("SELECT run_id, created_at FROM hotspots JOIN runs ON runs.id = run_id WHERE file_path = 'src/mod1/s8.py' ORDER BY created_at DESC, run_id DESC LIMIT 15")
def srt_file_risk(r, spark, d):
    return telemetry.file_risk_history(r("hotspots"), r("runs"), "src/mod1/s8.py", 15).select("run_id", "created_at")


@query(
    """SELECT count(*) AS n, CAST(sum(file_count) AS BIGINT) AS files_analyzed, floor(avg(duration_ms) * 1000 + 0.5) / 1000 AS avg_duration, floor(avg(confidence) * 1000000 + 0.5) / 1000000 AS avg_confidence,
count(*) FILTER (tool = 'analyze_change') AS n_changes, CAST(sum(must_read_count) FILTER (tool <> 'analyze_change') AS BIGINT) AS must_read, floor(avg(response_tokens) FILTER (tool <> 'analyze_change') * 1000 + 0.5) / 1000 AS avg_tokens,
count(*) FILTER (blast_level = 'high') AS n_high, count(*) FILTER (blast_level = 'medium') AS n_medium, count(*) FILTER (blast_level = 'low') AS n_low FROM usage_log"""
)
def agg_usage_summary(r, spark, d):
    cut = lambda c, k: (F.floor(F.col(c) * k + 0.5) / k).alias(c)
    x = telemetry.usage_summary(r("usage_log"))
    return x.select(*[cut(c, 1000) if c in ("avg_duration", "avg_tokens") else cut(c, 1000000) if c == "avg_confidence" else F.col(c) for c in x.columns])


def _period(name: str, unit: str, fmt: str):
    sql = f"SELECT strftime(created_at, '{fmt}') AS period, count(*) AS n, CAST(sum(file_count) AS BIGINT) AS files, count(*) FILTER (tool = 'analyze_change') AS changes FROM usage_log GROUP BY 1"

    def f(r, spark, d):
        return telemetry.usage_by_period(r("usage_log"), unit)

    f.__name__ = name
    query(sql)(f)


for _unit, _fmt in (("day", "%Y-%m-%d"), ("week", "%Y-W%W"), ("month", "%Y-%m")):
    _period(f"agg_usage_by_{_unit}", _unit, _fmt)


def _usage_files(r) -> DataFrame:
    return r("usage_log").withColumn("files_analyzed", F.array(*[F.concat(F.lit("f"), ((F.col("file_key") * k) % 150).cast("string")) for k in (1, 2, 3)]))


_UF = "(SELECT id, created_at, tool, unnest(['f' || (file_key % 150), 'f' || (file_key * 2 % 150), 'f' || (file_key * 3 % 150)]) AS file_path FROM usage_log)"


@query(f"SELECT file_path, count(*) AS n FROM {_UF} GROUP BY 1 ORDER BY n DESC, file_path LIMIT 20")
def agg_top_files(r, spark, d):
    return telemetry.top_files(_usage_files(r), 20)


@query(f"SELECT DISTINCT file_path FROM {_UF}")
def agg_files_with_usage(r, spark, d):
    return telemetry.files_with_usage(_usage_files(r))


@query(
    f"""SELECT fb.id AS feedback_id, 'f' || file_key AS file_path, u.usage_id FROM feedback fb LEFT JOIN (SELECT file_path, id AS usage_id FROM (SELECT *, row_number() OVER (PARTITION BY file_path
ORDER BY (tool = 'analyze_change')::INT, created_at DESC, id DESC) AS k FROM {_UF}) WHERE k = 1) u ON u.file_path = 'f' || file_key"""
)
def joi_latest_usage(r, spark, d):
    return telemetry.latest_usage(r("feedback").select("id", F.concat(F.lit("f"), "file_key").alias("file_path")), _usage_files(r))


@query(
    """SELECT count(*) AS n, avg(usefulness) AS avg_usefulness, 100.0::DOUBLE * sum(useful) / (sum(useful) + sum(unnecessary)) AS precision, 100.0::DOUBLE * sum(useful) / (sum(useful) + sum(missing)) AS recall,
100.0::DOUBLE * sum(modified) / (SELECT sum(likely_modify_count) FROM usage_log SEMI JOIN (SELECT DISTINCT id FROM feedback) USING (id)) AS likely_modify_accuracy FROM feedback"""
)
def agg_accuracy(r, spark, d):
    many = lambda c: F.array_repeat(F.lit("x"), F.col(c).cast("int")).alias(f"{c}_files")
    fb = r("feedback").select("id", F.col("id").alias("usage_id"), "usefulness", *[many(c) for c in ("useful", "unnecessary", "missing", "modified")])
    return telemetry.accuracy(fb, r("usage_log"))


@query("SELECT id, usefulness, n_chars FROM feedback ORDER BY usefulness, n_chars DESC, id LIMIT 10")
def srt_lowest_rated(r, spark, d):
    return telemetry.lowest_rated(r("feedback").withColumn("created_at", F.col("n_chars")), 10).select("id", "usefulness", "n_chars")


@query(
    """WITH s AS (SELECT risk_score FROM risk_scores WHERE score_version = 1), h AS (SELECT risk_score, count(*) AS n FROM s GROUP BY 1), q AS (SELECT id AS query_id, risk_score FROM risk_scores WHERE score_version = 2)
SELECT query_id, CASE WHEN (SELECT count(*) FROM s) >= 10 THEN CAST(100 * coalesce((SELECT sum(n) FROM h WHERE h.risk_score < q.risk_score), 0) // (SELECT count(*) FROM s) AS BIGINT) ELSE 0 END AS percentile FROM q"""
)
def agg_percentile(r, spark, d):
    s = r("risk_scores")
    return telemetry.percentile(s, s.where("score_version = 2").select(F.col("id").alias("query_id"), "risk_score"), 1)


@query(
    """SELECT branch, arg_max(blast_level, n * 10 - CASE blast_level WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END) AS level FROM (SELECT branch, blast_level, count(*) AS n FROM runs GROUP BY 1, 2) GROUP BY 1"""
)
def agg_dominant_level(r, spark, d):
    return telemetry.dominant_level(r("runs"), "branch")


_SESS = "s AS (SELECT conv_id AS session, role, 'f' || (length(text) % 40) AS file FROM conversations)"


def _sessions(spark, d):
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("session"), "role", F.concat(F.lit("f"), (F.length("text") % 40).cast("string")).alias("file"))
    return c.where("role = 'user'"), c.where("role = 'assistant'")


@query(
    f"""WITH {_SESS}, e AS (SELECT file, count(*) AS edits FROM s WHERE role = 'user' GROUP BY 1), c AS (SELECT file, count(*) AS n FROM s WHERE role = 'assistant' GROUP BY 1)
SELECT e.file, edits, coalesce(n, 0) AS contexts, coalesce(n, 0) > 0 AS covered, coalesce(n, 0) < edits AS missed FROM e LEFT JOIN c ON c.file = e.file"""
)
def agg_discover(r, spark, d):
    return telemetry.discover(*_sessions(spark, d))


@query(
    f"""WITH {_SESS}, e AS (SELECT DISTINCT session, file FROM s WHERE role = 'user'), c AS (SELECT DISTINCT session, file FROM s WHERE role = 'assistant')
SELECT session, count(*) AS edited, count(c.file) AS covered, 100.0::DOUBLE * count(c.file) / count(*) AS adoption FROM e LEFT JOIN c USING (session, file) GROUP BY 1"""
)
def agg_session_stats(r, spark, d):
    return telemetry.session_stats(*_sessions(spark, d))


@query(
    f"""WITH {_SESS}, e AS (SELECT file, count(*) AS edits FROM s WHERE role = 'user' GROUP BY 1), c AS (SELECT file, count(*) AS n FROM s WHERE role = 'assistant' GROUP BY 1)
SELECT e.file, edits FROM e LEFT JOIN c ON c.file = e.file WHERE coalesce(n, 0) < edits ORDER BY edits DESC, e.file LIMIT 10"""
)
def srt_missed_files(r, spark, d):
    return telemetry.missed_files(telemetry.discover(*_sessions(spark, d)), 10).select("file", "edits")


@query(
    f"""WITH {SECTIONS} SELECT subject, count(*) FILTER (confidence = 'high') AS high, count(*) FILTER (confidence = 'medium') AS medium, count(*) FILTER (confidence = 'low') AS low FROM h WHERE lm GROUP BY 1"""
)
def agg_tier_counts(r, spark, d):
    x = ranking.Shown(*_measured(r)).likely().withColumns({c: F.lit(False) for c in ranking.PACKAGE_FLAGS})
    return quality.tier_counts(x.withColumn("signals", ranking.signal_strings(F.lit(5)))).select("subject", "high", "medium", "low")


GRADES = """g AS (SELECT *, greatest(1.0::DOUBLE, least(4.0::DOUBLE, 4.0::DOUBLE - CASE WHEN confidence < 0.8::DOUBLE THEN 1.0 WHEN confidence < 0.95::DOUBLE THEN 0.5 ELSE 0.0 END - CASE WHEN symbol_rate < 0.3::DOUBLE THEN 0.5 ELSE 0.0 END
- CASE WHEN direction_rate < 0.5::DOUBLE THEN 0.5 ELSE 0.0 END - CASE WHEN n_must >= 3 AND inverted THEN 0.5 ELSE 0.0 END)) AS a,
CASE WHEN n_likely = 0 THEN 3.0::DOUBLE ELSE 4.0::DOUBLE - CASE WHEN n_likely >= 3 AND single_tier THEN 0.5 ELSE 0.0 END - CASE WHEN n_likely >= 3 AND signal_types < 2 THEN 0.5 ELSE 0.0 END END AS b,
CASE WHEN n_tests = 0 THEN CASE test_reason WHEN 'is_test' THEN 4.0::DOUBLE WHEN 'no_tests_nearby' THEN 3.0::DOUBLE ELSE 2.0::DOUBLE END ELSE 4.0::DOUBLE - CASE WHEN n_direct = 0 THEN 1.0 ELSE 0.0 END - CASE WHEN n_tests >= 2 AND n_direct = 0 THEN 0.5 ELSE 0.0 END END AS c,
CASE WHEN n_related = 0 THEN 2.5::DOUBLE ELSE 4.0::DOUBLE - CASE WHEN n_related >= 3 AND NOT informative THEN 0.5 ELSE 0.0 END END AS d,
CASE WHEN blast_level IS NULL THEN 1.0::DOUBLE ELSE greatest(1.0::DOUBLE, 4.0::DOUBLE - CASE WHEN blast_level NOT IN ('high', 'medium', 'low') THEN 2.0 ELSE 0.0 END - CASE WHEN blast_detail = '' THEN 1.0 ELSE 0.0 END
- CASE WHEN blast_level = 'high' AND n_likely < 3 THEN 0.5 ELSE 0.0 END - CASE WHEN blast_level = 'low' AND n_likely > 10 THEN 0.5 ELSE 0.0 END) END AS e FROM graded),
o AS (SELECT *, floor((a * 0.40::DOUBLE + b * 0.20::DOUBLE + c * 0.15::DOUBLE + d * 0.15::DOUBLE + e * 0.10::DOUBLE) * 10000 + 0.5) / 10000 AS overall FROM g)"""


@query(f"WITH {GRADES} SELECT id, a AS g_must_read, b AS g_likely_modify, c AS g_tests, d AS g_related, e AS g_blast, overall, CASE WHEN overall >= 3.5 THEN 'A' WHEN overall >= 2.5 THEN 'B' WHEN overall >= 1.5 THEN 'C' ELSE 'D' END AS letter FROM o")
def grd_rubric(r, spark, d):
    x = quality.grade(r("graded")).withColumn("overall", F.floor(F.col("overall") * 10000 + 0.5) / 10000)
    return x.select("id", "g_must_read", "g_likely_modify", "g_tests", "g_related", "g_blast", "overall", quality.letter(F.col("overall")).alias("letter"))


@query(f"WITH {GRADES} SELECT {', '.join(f'floor(avg({k}) * 1000000 + 0.5) / 1000000 AS {n}' for k, n in zip('abcde', ('must_read', 'likely_modify', 'tests', 'related', 'blast'), strict=True))} FROM g")
def agg_section_averages(r, spark, d):
    x = quality.section_averages(quality.grade(r("graded"))).drop("overall")
    return x.select(*[(F.floor(F.col(c) * 1000000 + 0.5) / 1000000).alias(c) for c in x.columns])


@query(
    """WITH l AS (SELECT c_custkey AS k, list_distinct(['f' || c_custkey % 3, 'f' || c_custkey % 5]) AS want, list_distinct(['f' || c_custkey % 3, 'f' || c_custkey % 4]) AS got FROM customer)
SELECT CAST(k AS VARCHAR) AS subject, len(list_intersect(want, got))::DOUBLE / len(want) AS must_read_recall, len(list_intersect(want, got))::DOUBLE / len(got) AS must_read_precision,
len(list_intersect(want, got))::DOUBLE / len(want) >= 0.95 AND len(list_intersect(want, got))::DOUBLE / len(got) >= 0.8 AND NOT list_contains(got, 'f2') AS passed FROM l"""
)
def val_compare(r, spark, d):
    k = F.col("c_custkey")
    name = lambda n: F.concat(F.lit("f"), (k % n).cast("string"))
    none = F.array().cast("array<string>")
    c = table(spark, d, "customer").withColumn("subject", k.cast("string"))
    want = c.select("subject", F.array(name(3), name(5)).alias("must_read"), F.array(F.lit("f2")).alias("must_read_forbidden"), *[none.alias(x) for x in ("must_read_ordered", "related", "related_forbidden", "tests", "ignore_must_contain", "external", "expect_stable")])
    got = c.select("subject", F.array_distinct(F.array(name(3), name(4))).alias("must_read"), *[none.alias(x) for x in ("likely_modify", "related", "tests", "external", "stable")])
    return quality.compare(want, got).select("subject", "must_read_recall", "must_read_precision", "passed")


@query(
    """SELECT path, CASE WHEN ends_with(path, '.py') THEN 'python' WHEN ends_with(path, '.ts') THEN 'typescript' WHEN ends_with(path, '.go') THEN 'go' WHEN ends_with(path, '.rs') THEN 'rust' WHEN ends_with(path, '.cs') THEN 'csharp' END AS language,
regexp_matches(path, '^(node_modules/|x[.]egg-info/)') OR contains(path, '/.cache/') AS skipped, ends_with(path, '.test.ts') AS is_test,
CASE WHEN strpos(path, '/') = 0 THEN '.' WHEN starts_with(path, 'packages/') THEN regexp_extract(path, '^packages/[^/]*') ELSE regexp_extract(path, '^[^/]*') END AS group_key FROM named"""
)
def src_walk(r, spark, d):
    p = F.col("path")
    return r("named").select(p, P.language(p).alias("language"), P.is_skipped(p).alias("skipped"), P.is_test(p).alias("is_test"), P.group_key(p).alias("group_key"))


@query(f"WITH {WINDOWED} SELECT path, partner, frequency FROM sym")
def set_symmetric(r, spark, d):
    return signals.symmetric(signals.co_change(_history(r)))


@query("SELECT DISTINCT src_file, dst_file FROM edges SEMI JOIN (SELECT path AS src_file FROM changed) USING (src_file)")
def joi_forward_batch(r, spark, d):
    return r("edges").join(r("changed").select(F.col("path").alias("src_file")), "src_file", "left_semi").distinct()


@query("SELECT date_trunc('day', created_at) AS start, tool, count(*) AS n, CAST(sum(file_count) AS BIGINT) AS files FROM usage_log GROUP BY 1, 2")
def str_usage_rollup(r, spark, d):
    from ferngraph.streaming.usage import rollup

    x = rollup(r("usage_log").withColumn("created_at", F.col("created_at").cast("timestamp")))
    return x.withColumn("start", F.col("start").cast("timestamp_ntz"))


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: the sections of every file, from one neighbourhood search."""
    return QUERIES["rnk_sections"](spark, sf_dir)
