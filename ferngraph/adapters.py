"""Engine relations over the star schema, as one SQL text for every engine.

Suppliers stand for files, order lines for imports, orders for commits, events for usage,
and so on.  Every relation reads its whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ferngraph.session import sorted_join, table


def path_of(k: str) -> str:
    return (
        f"CASE WHEN {k} % 13 = 0 THEN 'src/mod' || ({k} % 7) || '/tests/test_s' || {k} || '.py' WHEN {k} % 17 = 0 THEN 'src/mod' || ({k} % 7) || '/p' || {k} || '/__init__.py'"
        f" WHEN {k} % 19 = 0 THEN 'docs/s' || {k} || '.py' ELSE 'src/mod' || ({k} % 7) || '/s' || {k} || '.py' END"
    )


#: Every order line is an import statement: of one of three other files, or of one of five hubs.
_IMPORTS = (
    "(SELECT *, CASE WHEN l_linenumber % 4 = 3 THEN l_suppkey % 5 ELSE (l_suppkey * 3 + l_linenumber % 4 * 7 + 1) % (SELECT count(*) FROM {supplier}) END AS to_key"
    " FROM {lineitem}) a WHERE to_key <> l_suppkey"
)
VIEWS = {
    "files": f"SELECT {path_of('s_suppkey')} AS path, CASE WHEN s_nationkey % 2 = 0 THEN 'python' ELSE 'typescript' END AS language FROM {{supplier}}",
    "edge_rows": f"SELECT {path_of('l_suppkey')} AS src_file, {path_of('to_key')} AS dst_file, l_returnflag || l_linestatus AS specifier,"
    f" CAST(l_linenumber AS BIGINT) AS line_number, l_returnflag AS name FROM {_IMPORTS}",
    "edges": f"SELECT DISTINCT {path_of('l_suppkey')} AS src_file, {path_of('to_key')} AS dst_file FROM {_IMPORTS}",
    "commit_files": f"SELECT DISTINCT o.o_orderkey AS hash, o.o_orderdate AS ts, {path_of('l.l_suppkey')} AS file FROM {{orders}} o JOIN {{lineitem}} l ON l.l_orderkey = o.o_orderkey",
    "runs": "SELECT o_orderkey AS id, o_orderdate AS created_at, o_orderpriority AS branch,"
    " CASE o_orderstatus WHEN 'F' THEN 'high' WHEN 'O' THEN 'medium' ELSE 'low' END AS blast_level FROM {orders}",
    "hotspots": f"SELECT DISTINCT l_orderkey AS run_id, {path_of('l_suppkey')} AS file_path FROM {{lineitem}}",
    "usage_log": "SELECT event_id AS id, ts AS created_at, CASE WHEN event_type = 'purchase' THEN 'analyze_change' ELSE event_type END AS tool,"
    " user_id AS file_key, user_id % 7 AS file_count, user_id % 11 AS must_read_count, user_id % 5 AS likely_modify_count, user_id % 13 * 100 AS response_tokens,"
    " CASE WHEN user_id % 3 = 0 THEN 'high' WHEN user_id % 3 = 1 THEN 'medium' ELSE 'low' END AS blast_level, value AS duration_ms,"
    " CASE WHEN user_id % 4 = 0 THEN NULL ELSE CAST(user_id % 4 AS DOUBLE) / 4 END AS confidence FROM {events}",
    "feedback": "SELECT l.doc_id AS id, l.doc_id % 150 AS file_key, CAST(1 + l.doc_id % 5 AS BIGINT) AS usefulness, CAST(l.quality AS BIGINT) AS useful,"
    " CAST(l.toxic AS BIGINT) AS unnecessary, l.doc_id % 3 AS missing, l.doc_id % 2 AS modified, d.n_chars FROM {labels} l JOIN {documents} d ON d.doc_id = l.doc_id",
    "risk_scores": "SELECT o_orderkey AS id, CAST(floor(o_totalprice) AS BIGINT) % 101 AS risk_score, CAST(1 + o_orderkey % 2 AS BIGINT) AS score_version FROM {orders}",
    "changed": f"SELECT {path_of('s_suppkey')} AS path, CASE s_nationkey % 4 WHEN 0 THEN 'added' WHEN 1 THEN 'modified' WHEN 2 THEN 'deleted' ELSE 'modified' END AS status,"
    " s_suppkey % 10 <> 0 AS indexed FROM {supplier}",
    "graded": "SELECT c_custkey AS id, CAST(c_custkey % 11 AS DOUBLE) / 10 AS confidence, CAST(c_custkey % 7 AS DOUBLE) / 7 AS symbol_rate, CAST(c_custkey % 5 AS DOUBLE) / 5 AS direction_rate,"
    " c_custkey % 2 = 0 AS inverted, c_custkey % 6 AS n_must, c_custkey % 13 AS n_likely, c_custkey % 3 = 0 AS single_tier, c_custkey % 4 AS signal_types, c_custkey % 4 AS n_tests, c_custkey % 2 AS n_direct,"
    " CASE c_custkey % 3 WHEN 0 THEN 'is_test' WHEN 1 THEN 'no_tests_nearby' ELSE 'other' END AS test_reason, c_custkey % 5 AS n_related, c_custkey % 2 = 1 AS informative,"
    " CASE c_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'high' WHEN 2 THEN 'medium' WHEN 3 THEN 'low' ELSE 'odd' END AS blast_level, CASE WHEN c_custkey % 7 = 0 THEN '' ELSE 'x' END AS blast_detail FROM {customer}",
    "named": "SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 0 THEN 'src/' WHEN 1 THEN 'node_modules/' WHEN 2 THEN 'a/.cache/' WHEN 3 THEN 'x.egg-info/' WHEN 4 THEN 'packages/p' || p_partkey % 3 || '/' ELSE '' END || 'f' || p_partkey ||"
    " CASE p_partkey % 8 WHEN 0 THEN '.py' WHEN 1 THEN '.ts' WHEN 2 THEN '.go' WHEN 3 THEN '.md' WHEN 4 THEN '.rs' WHEN 5 THEN '.cs' WHEN 6 THEN '.test.ts' ELSE '' END AS path FROM {part}",
}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "labels", "conversations")


def relation(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = VIEWS[name]
    # orders grow with order lines, whatever their file's size says
    tables = {t: table(spark, sf_dir, t) for t in TABLES if f"{{{t}}}" in text}
    return spark.sql(text, **{t: sorted_join(df) if t == "orders" else df for t, df in tables.items()})


def with_views(query: str) -> str:
    """The query behind WITH clauses of all relations it names, for an engine where tables are views."""
    used = [n for n in VIEWS if n in query]
    views = [f"{n} AS ({VIEWS[n].format(**{t: t for t in TABLES})})" for n in used]
    text = query.lstrip()
    word = "WITH RECURSIVE" if text.startswith("WITH RECURSIVE") else "WITH"
    if text.startswith("WITH "):
        return f"{word} {', '.join([*views, text[len(word) + 1 :]])}"
    return f"{word} {', '.join(views)} {text}" if views else text
