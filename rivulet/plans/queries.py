"""The registered queries: each operator over the driver's tables, with SQL that gives the same rows.

Code is made from rows by expressions that Spark and DuckDB read alike, so both sides analyse the same texts.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constructs, formats
from ..functions import text as t
from ..operators import readers, relational

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "benchmark", "labels", "conversations")

#: A statement for each part, in four shapes.
STATEMENTS = """SELECT p_partkey AS id, CASE p_partkey % 4
 WHEN 0 THEN concat('INSERT INTO gold.t', p_partkey % 50, ' SELECT a.c', p_partkey % 7, ', SUM(b.v', p_partkey % 5, ') AS total', p_partkey % 3, ' FROM silver.s', p_partkey % 20, ' a JOIN silver.r', p_partkey % 11, ' b ON a.id = b.id', p_partkey % 4, ' WHERE a.d', p_partkey % 6, ' >= 10 GROUP BY a.c', p_partkey % 7)
 WHEN 1 THEN concat('CREATE OR REPLACE TABLE gold.x', p_partkey % 13, ' AS WITH q', p_partkey % 3, ' AS (SELECT k', p_partkey % 9, ' FROM bronze.b', p_partkey % 17, ') SELECT q', p_partkey % 3, '.k', p_partkey % 9, ', COUNT(q', p_partkey % 3, '.k', p_partkey % 9, ') AS n FROM q', p_partkey % 3)
 WHEN 2 THEN concat('MERGE INTO gold.m', p_partkey % 8, ' USING silver.u', p_partkey % 6, ' ON m', p_partkey % 8, '.id = u', p_partkey % 6, '.id -- note', p_partkey)
 ELSE concat('SELECT /* c', p_partkey, ' */ e.x', p_partkey % 5, ' AS y', p_partkey % 3, ', DATE_ADD(e.d, 1) AS z FROM raw.e', p_partkey % 10, ' e WHERE e.x', p_partkey % 5, ' IN (1, 2); VACUUM raw.e', p_partkey % 10) END AS sql
FROM part"""
#: Flow facts from order lines, with blanks, dependencies and report types.
FACTS = """SELECT concat('f', l_orderkey % 997) AS file_path,
 CASE WHEN l_orderkey % 5 = 0 THEN 'PowerBI' WHEN l_orderkey % 5 = 1 THEN 'PySpark' ELSE 'SQL' END AS file_type, concat('job', l_orderkey % 97) AS job_name,
 CASE WHEN l_suppkey % 7 = 0 THEN '' ELSE 'silver' END AS source_database,
 CASE WHEN l_partkey % 11 = 0 THEN '' ELSE concat('t', l_suppkey % CASE WHEN l_orderkey % 5 = 0 THEN 30 ELSE 40 END) END AS source_table, concat('c', l_partkey % 23) AS source_column,
 'gold' AS target_database, CASE WHEN l_partkey % 29 = 0 THEN '' ELSE concat('t', 20 + l_partkey % 60) END AS target_table,
 CASE WHEN l_linenumber = 7 THEN '—' ELSE concat('c', l_partkey % 17) END AS target_column,
 CASE l_linenumber % 5 WHEN 0 THEN 'SELECT' WHEN 1 THEN 'AGGREGATE' WHEN 2 THEN 'JOIN' WHEN 3 THEN 'FILTER' ELSE 'JOIN_KEY' END AS sql_operation,
 l_orderkey * 10 + l_linenumber AS pos
FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey FROM lineitem GROUP BY l_orderkey, l_linenumber)"""
_S = f"WITH s AS ({STATEMENTS}) "
_F = f"WITH f AS ({FACTS}) "
_REPORTS = "('Qlik', 'Looker', 'PowerBI', 'Tableau', 'SSRS')"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _views(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """SQL over the tables it names. Names are put in as paths, so that nothing is left registered in the session."""
    return spark.sql(re.sub(rf"\b(FROM|JOIN)\s+({'|'.join(TABLES)})\b", rf"\1 parquet.`{sf_dir}/\2.parquet`", sql))


def _add(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str | None) -> None:
    QUERIES[name] = query
    if sql:  # DuckDB writes lambdas in Python's way
        ORACLE[name] = re.sub(r"\((\w), (\w)\) -> ", r"lambda \1, \2: ", re.sub(r"(?<![\w)])(\w) -> ", r"lambda \1: ", sql))


def _same(name: str, spark_sql: str, duck_sql: str | None = None) -> None:
    """A query whose operators Spark executes as they are written."""
    _add(name, lambda spark, sf: _views(spark, sf, spark_sql), duck_sql or spark_sql)


def _on_statements(name: str, f: Callable[[Column], Column], duck: str) -> None:
    """An expression over every statement; ``duck`` is the expression's SQL over ``sql``."""
    _add(name, lambda spark, sf: _views(spark, sf, STATEMENTS).select("id", f(F.col("sql")).alias("v")), f"{_S}SELECT id, {duck} AS v FROM s")


# --- texts of statements
_JOIN = partial(F.array_join, delimiter=",")
_NAME = r"[A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)*"
_last = "list_transform({}, x -> split_part(x, '.', -1))"


def _ordered(expr: str) -> str:
    """DuckDB: the list's different values in order of appearance, comma-joined."""
    return f"array_to_string(list_filter({expr}, (x, i) -> list_position({expr}, x) = i), ',')"


_on_statements("strip_comments", t.strip_comments, r"regexp_replace(regexp_replace(sql, '/\*(?s:.)*?\*/', ' ', 'g'), '--[^\n]*', ' ', 'g')")
_on_statements("job_type", t.job_type, r"CASE WHEN regexp_matches(sql, '(?i)\bGROUP\s+BY\b|\b(SUM|COUNT|AVG|MAX|MIN)\s*\(') THEN 'aggregation' ELSE 'curated' END")
_on_statements("kpi_aliases", lambda c: _JOIN(t.kpi_aliases(c)), _ordered(r"regexp_extract_all(sql, '(?i)\b(?:SUM|COUNT|AVG|MAX|MIN)\s*\([^()]*\)\s+AS\s+([A-Za-z_][A-Za-z0-9_]*)', 1)"))
_on_statements("cte_names", lambda c: _JOIN(t.cte_names(c)), _ordered(r"list_transform(regexp_extract_all(sql, '(?i)\bWITH\s+(?:RECURSIVE\s+)?([A-Za-z_][A-Za-z0-9_]*)\s*AS\s*\(', 1), x -> lower(x))"))
_on_statements("target_tables", lambda c: _JOIN(t.target_tables(c)), _ordered(_last.format(rf"(regexp_extract_all(sql, '(?i)\bINSERT\s+(?:INTO|OVERWRITE)\s+(?:TABLE\s+)?({_NAME})', 1) || regexp_extract_all(sql, '(?i)\bCREATE\s+(?:OR\s+REPLACE\s+)?(?:TABLE|VIEW)\s+(?:IF\s+NOT\s+EXISTS\s+)?({_NAME})\s+AS\b', 1) || regexp_extract_all(sql, '(?i)\bMERGE\s+INTO\s+({_NAME})', 1))")))
_src = _last.format(rf"(regexp_extract_all(sql, '(?i)\bFROM\s+({_NAME})', 1) || regexp_extract_all(sql, '(?i)\bJOIN\s+({_NAME})', 1))")
_on_statements("source_tables", lambda c: _JOIN(t.source_tables(c)), _ordered(rf"list_filter({_src}, x -> NOT regexp_matches(x, '^q\d$'))"))
_keys = r"flatten(list_transform(regexp_extract_all(sql, '(?i)\bON\s+([A-Za-z_][A-Za-z0-9_.]*\s*=\s*[A-Za-z_][A-Za-z0-9_.]*)', 1), p -> [split_part(trim(split_part(p, '=', 1)), '.', -1), split_part(trim(split_part(p, '=', 2)), '.', -1)]))"
_on_statements("join_keys", lambda c: _JOIN(t.join_keys(c)), _ordered(_keys))
_on_statements("filter_columns", lambda c: _JOIN(t.filter_columns(c)), _ordered(_last.format(r"regexp_extract_all(regexp_extract(sql, '(?i)\bWHERE\b((?s:.)*?)(?:GROUP\s+BY\b|;|$)', 1), '(?i)([A-Za-z_][A-Za-z0-9_.]*)\s*(?:=|<|>|!|\bIN\b|\bLIKE\b)', 1)")))
_on_statements("stmt_split", lambda c: F.array_join(t.statements(c), "|"), "array_to_string(list_filter(list_transform(string_split(sql, ';'), x -> trim(x)), x -> x <> ''), '|')")
_add("depth_split", lambda spark, sf: _views(spark, sf, "SELECT id, concat('a', id % 3, ', f(b', id % 5, ', g(c, d)), (x, y) AS z', id % 7, ',last') AS v FROM (SELECT p_partkey AS id FROM part)").select("id", F.array_join(t.depth_split(F.col("v")), "|").alias("v")),
     "SELECT p_partkey AS id, concat('a', p_partkey % 3, '|f(b', p_partkey % 5, ', g(c, d))|(x, y) AS z', p_partkey % 7, '|last') AS v FROM part")
_add("qualified_split", lambda spark, sf: _views(spark, sf, "SELECT c_custkey, concat('`p', c_custkey % 3, CASE WHEN c_custkey % 2 = 0 THEN '.gold.' ELSE '' END, 't', c_custkey % 9, '`') AS n FROM customer").select("c_custkey", t.database_of(F.col("n")).alias("db"), t.table_of(F.col("n")).alias("tbl")),
     "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN concat('p', c_custkey % 3, '.gold') ELSE '' END AS db, CASE WHEN c_custkey % 2 = 0 THEN concat('t', c_custkey % 9) ELSE concat('p', c_custkey % 3, 't', c_custkey % 9) END AS tbl FROM customer")
_add("bare_column", lambda spark, sf: _views(spark, sf, "SELECT c_custkey, concat('a.b', c_custkey % 9, CASE c_custkey % 4 WHEN 0 THEN ' DESC' WHEN 1 THEN ' asc NULLS LAST' WHEN 2 THEN '),' ELSE '' END) AS v FROM customer").select("c_custkey", t.bare_column(F.col("v")).alias("v")),
     "SELECT c_custkey, concat('b', c_custkey % 9) AS v FROM customer")
_JUNK = "CASE id % 9 WHEN 0 THEN '' WHEN 1 THEN '12' WHEN 2 THEN '1_0' WHEN 3 THEN 'nan' WHEN 4 THEN '1d' WHEN 5 THEN ' 1e5 ' WHEN 6 THEN 'c1' WHEN 7 THEN '-.5' ELSE 'x y' END"
_add("junk_column", lambda spark, sf: _views(spark, sf, f"SELECT id, {_JUNK} AS v FROM (SELECT c_custkey AS id FROM customer)").select("id", t.is_junk(F.col("v")).alias("junk")),
     "SELECT c_custkey AS id, c_custkey % 9 NOT IN (4, 6, 8) AS junk FROM customer")
_PROJECTION = "CASE id % 6 WHEN 0 THEN '*' WHEN 1 THEN 'ROW_NUMBER() OVER (ORDER BY a) AS r' WHEN 2 THEN 'SUM(x) OVER (PARTITION BY y) AS s' WHEN 3 THEN 'a.b AS c' WHEN 4 THEN 'count(distinct q)' ELSE 'a.b' END"
_add("projection_op", lambda spark, sf: _views(spark, sf, f"SELECT id, {_PROJECTION} AS v FROM (SELECT c_custkey AS id FROM customer)").select("id", t.projection_op(F.col("v")).alias("op")),
     "SELECT c_custkey AS id, CASE c_custkey % 6 WHEN 1 THEN 'WINDOW' WHEN 2 THEN 'AGGREGATE' WHEN 3 THEN 'ALIAS' WHEN 4 THEN 'AGGREGATE' ELSE 'SELECT' END AS op FROM customer")
_META = "concat('-- DOMAIN: d', s_nationkey, chr(10), '-- @SCHEDULE: ', s_suppkey, ' 2 * * *', chr(10), CASE WHEN s_suppkey % 2 = 0 THEN concat('--OWNER: o', s_suppkey) ELSE 'SELECT 1' END)"
_add("metadata_vars", lambda spark, sf: _views(spark, sf, f"SELECT s_suppkey, {_META} AS v FROM supplier").select("s_suppkey", F.coalesce(t.metadata(F.col("v"), "DOMAIN"), F.lit("unknown")).alias("domain"), F.coalesce(t.metadata(F.col("v"), "SUBJECT_AREA"), F.lit("unknown")).alias("subject_area"), t.metadata(F.col("v"), "SCHEDULE").alias("schedule"), t.metadata(F.col("v"), "OWNER").alias("owner")),
     "SELECT s_suppkey, concat('d', s_nationkey) AS domain, 'unknown' AS subject_area, concat(s_suppkey, ' 2 * * *') AS schedule, CASE WHEN s_suppkey % 2 = 0 THEN concat('o', s_suppkey) END AS owner FROM supplier")

# --- constructs
_CODE = "concat('SELECT ', CASE id % 5 WHEN 0 THEN 'LAG(x) OVER (ORDER BY y), filter_id' WHEN 1 THEN 'EXPLODE(a)' WHEN 2 THEN 'transform (a, f)' WHEN 3 THEN 'date_add(d, 1) -- VACUUM' ELSE '1' END, CASE id % 3 WHEN 0 THEN '; OPTIMIZE t' WHEN 1 THEN ' /* PIVOT */' ELSE ' LATERAL  VIEW v' END)"
_FOUND = "list_filter([CASE WHEN id % 3 = 2 THEN 'LATERAL VIEW' END, CASE WHEN id % 5 = 3 AND TRUE THEN 'DATE_ADD' END, CASE WHEN id % 5 = 0 THEN 'LAG' END, CASE WHEN id % 5 = 1 THEN 'EXPLODE' END, CASE WHEN id % 5 = 2 THEN 'TRANSFORM' END, CASE WHEN id % 3 = 0 AND id % 5 <> 3 THEN 'OPTIMIZE' END], x -> x IS NOT NULL)"


def _constructs(spark: SparkSession, sf: str) -> DataFrame:
    code = _views(spark, sf, f"SELECT id, {_CODE} AS sql FROM (SELECT p_partkey AS id FROM part)")
    found = code.select("id", constructs.found(F.col("sql")).alias("found"))
    return found.select("id", F.array_join("found", ";").alias("constructs_found"), F.size("found").cast("long").alias("construct_count"), constructs.complexity(F.col("found")).alias("complexity"), constructs.has_any(F.col("found"), constructs.DELTA).alias("has_delta_ops"))


_add("constructs_sql", _constructs, f"""WITH c AS (SELECT id, CASE WHEN id % 5 = 3 AND id % 3 = 2 THEN ['DATE_ADD'] ELSE {_FOUND} END AS found FROM (SELECT p_partkey AS id FROM part))
SELECT id, array_to_string(found, ';') AS constructs_found, len(found) AS construct_count,
 CASE WHEN list_contains(found, 'OPTIMIZE') THEN 'manual' WHEN len(list_intersect(found, ['LATERAL VIEW', 'EXPLODE', 'TRANSFORM'])) > 0 THEN 'rewrite' ELSE 'direct' END AS complexity,
 list_contains(found, 'OPTIMIZE') AS has_delta_ops FROM c""")  # fmt: skip

_ALL = list(constructs.SEVERITY)


def _each_construct(spark: SparkSession, sf: str) -> DataFrame:
    names = F.array(*(F.lit(n + ("(x)" if n in constructs.NEED_PAREN else "")) for n in _ALL))
    code = _views(spark, sf, "SELECT p_partkey AS id FROM part").select("id", F.concat(F.lit("SELECT 1 ; "), F.element_at(names, (F.col("id") % len(_ALL) + 1).cast("int")), F.lit(" y")).alias("sql"))
    return code.select("id", F.array_contains(constructs.found(F.col("sql")), F.element_at(F.array(*map(F.lit, _ALL)), (F.col("id") % len(_ALL) + 1).cast("int"))).alias("seen"))


_add("constructs_each", _each_construct, "SELECT p_partkey AS id, TRUE AS seen FROM part")

# --- what a file is
_EXT = "CASE s_suppkey % 8 WHEN 0 THEN 'a.SQL' WHEN 1 THEN 'dir.x/b.ipynb' WHEN 2 THEN 'c.pbit' WHEN 3 THEN 'noext' WHEN 4 THEN 'd.env' WHEN 5 THEN 'e.tf' WHEN 6 THEN '.sql' ELSE 'f.xyz' END"
_add("ext_family", lambda spark, sf: _views(spark, sf, f"SELECT s_suppkey, {_EXT} AS n FROM supplier").select("s_suppkey", formats.suffix(F.col("n")).alias("suffix"), formats.family(F.col("n"), F.lit("SELECT 1")).alias("family"), formats.type_label(formats.family(F.col("n"), F.lit("SELECT 1"))).alias("label"), formats.stem(F.col("n")).alias("stem")),
     "SELECT s_suppkey, ['.sql', '.ipynb', '.pbit', '', '.env', '.tf', '', '.xyz'][s_suppkey % 8 + 1] AS suffix, ['sql', 'notebook', 'powerbi_binary', 'sql', 'properties', 'terraform', 'sql', 'sql'][s_suppkey % 8 + 1] AS family, ['SQL', 'PySpark', 'PowerBI', 'SQL', 'PROPERTIES', 'Terraform', 'SQL', 'SQL'][s_suppkey % 8 + 1] AS label, ['a', 'b', 'c', 'noext', 'd', 'e', '.sql', 'f'][s_suppkey % 8 + 1] AS stem FROM supplier")
_SNIFFED = """CASE WHEN h[1] IN ('{', '[') THEN 'json:json' WHEN h[1] = '<' THEN 'xml:xml' WHEN regexp_matches(h, '(?im)^(SELECT|INSERT|UPDATE|DELETE|CREATE|WITH|MERGE)\\b') THEN 'sql:sql'
 WHEN regexp_matches(h, '(import pyspark|from pyspark|spark\\.table\\()') THEN 'python:python' WHEN regexp_matches(h, '^(---|\\w+\\s*:)') THEN 'yaml:yaml' ELSE 'text:unknown' END""".replace("\\\\", "\\")
_MIXED = "SELECT doc_id AS id, concat('d', doc_id) AS n, text AS v FROM documents UNION ALL SELECT page_id, concat('p', page_id), html FROM pages UNION ALL SELECT event_id, concat('e', event_id), props FROM events UNION ALL SELECT p_partkey, concat('s', p_partkey), concat('select ', p_name) FROM part"
_add("format_sniff", lambda spark, sf: _views(spark, sf, _MIXED).select("n", formats.sniff(F.coalesce("v", F.lit(""))).alias("kind")),
     f"WITH m AS ({_MIXED}) SELECT n, {_SNIFFED} AS kind FROM (SELECT n, regexp_replace(left(coalesce(v, ''), 512), '^\\s+|\\s+$', '', 'g') AS h FROM m)".replace("\\\\", "\\"))

# --- content
_NORM = r"lower(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '/\*(?s:.)*?\*/', ' ', 'g'), '--[^\n]*', ' ', 'g'), '//[^\n]*', ' ', 'g'), '[ \t\n\r\f]+', ' ', 'g')))"


def _duplicates(spark: SparkSession, sf: str) -> DataFrame:
    docs = _views(spark, sf, "SELECT doc_id, concat('doc', doc_id) AS name, coalesce(text, '') AS text FROM documents")
    return relational.keep_first_content(docs, "text", "name", "doc_id")[1]


_add("dup_content_hash", _duplicates, f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), h AS (SELECT doc_id, length(text) AS n, sha256({_NORM}) AS h FROM d),
m AS (SELECT *, min(doc_id) OVER (PARTITION BY h) AS first FROM h)
SELECT concat('doc', doc_id) AS removed_file, concat('doc', first) AS duplicate_of, 'Identical query content (normalised SHA-256 match)' AS reason, n AS size_bytes FROM m WHERE doc_id <> first""")
_add("json_strings", lambda spark, sf: _views(spark, sf, "SELECT event_id, try_parse_json(props) AS j FROM events").select("event_id", F.explode(F.expr("map_entries(try_variant_get(j, '$', 'map<string,string>'))")).alias("e")).select("event_id", F.col("e.key").alias("k"), F.col("e.value").alias("v")),
     "SELECT event_id, k, json_extract_string(props, '$.\"' || k || '\"') AS v FROM events, unnest(json_keys(props)) AS u(k)")


def _notebooks(spark: SparkSession, sf: str) -> DataFrame:
    cells = "concat('{\"cells\":[{\"cell_type\":\"code\",\"source\":[\"x = ', n_nationkey, '\"]},{\"cell_type\":\"markdown\",\"source\":\"# t\"},{\"cell_type\":\"code\",\"source\":\"%%sql\\\\nSELECT ', n_nationkey, '\"}]}')"
    rows = _views(spark, sf, f"SELECT n_nationkey AS file_pos, concat('n', n_nationkey, '.ipynb') AS file_name, concat('/n', n_nationkey) AS path, cast({cells} AS binary) AS content FROM nation")
    return readers.explode_chunks(rows).select("file_name", F.col("chunk_pos").cast("long").alias("chunk_pos"), "dialect", "content")


_add("notebook_cells", _notebooks, "SELECT concat('n', n_nationkey, '.ipynb') AS file_name, CAST(0 AS BIGINT) AS chunk_pos, 'python' AS dialect, concat('x = ', n_nationkey) AS content FROM nation UNION ALL SELECT concat('n', n_nationkey, '.ipynb'), 1, 'sql', concat('SELECT ', n_nationkey) FROM nation")

# --- flow of statements
_COLUMNS = "source_database, source_table, source_column, target_database, target_table, target_column, sql_operation"


def _statement_flow(spark: SparkSession, sf: str) -> DataFrame:
    return readers.statement_facts(_views(spark, sf, STATEMENTS), "sql", "id").where("primary").drop("primary")


_add("column_flow", _statement_flow, """WITH p AS (SELECT p_partkey AS id FROM part)
SELECT id, 'silver' AS source_database, concat('s', id % 20) AS source_table, concat('c', id % 7) AS source_column, 'gold' AS target_database, concat('t', id % 50) AS target_table, concat('c', id % 7) AS target_column, 'SELECT' AS sql_operation FROM p WHERE id % 4 = 0
UNION ALL SELECT id, 'silver', concat('r', id % 11), concat('v', id % 5), 'gold', concat('t', id % 50), concat('total', id % 3), 'AGGREGATE' FROM p WHERE id % 4 = 0
UNION ALL SELECT id, 'bronze', concat('b', id % 17), concat('k', id % 9), 'gold', concat('x', id % 13), concat('k', id % 9), 'SELECT' FROM p WHERE id % 4 = 1
UNION ALL SELECT id, 'bronze', concat('b', id % 17), concat('k', id % 9), 'gold', concat('x', id % 13), 'n', 'AGGREGATE' FROM p WHERE id % 4 = 1
UNION ALL SELECT id, 'silver', concat('u', id % 6), 'id', 'gold', concat('m', id % 8), 'id', 'JOIN' FROM p WHERE id % 4 = 2
UNION ALL SELECT id, 'gold', concat('m', id % 8), 'id', 'gold', concat('m', id % 8), 'id', 'JOIN' FROM p WHERE id % 4 = 2
UNION ALL SELECT id, 'raw', concat('e', id % 10), concat('x', id % 5), '', '', concat('y', id % 3), 'ALIAS' FROM p WHERE id % 4 = 3
UNION ALL SELECT id, 'raw', concat('e', id % 10), 'd', '', '', 'z', 'ALIAS' FROM p WHERE id % 4 = 3""")




def _files(spark: SparkSession, sf: str, sql: str) -> DataFrame:
    """Rows (id, name, code) as files."""
    return _views(spark, sf, sql).select(F.concat(F.lit("/"), "name").alias("path"), F.col("name").alias("file_name"), F.col("code").cast("binary").alias("content"), F.col("id").cast("long").alias("file_pos"))


_PYTHON = """SELECT c_custkey AS id, concat('j', c_custkey, '.py') AS name, concat('DOMAIN = "d', c_nationkey, '"\\na = spark.table("raw.s', c_custkey % 20, '")\\nb = spark.read.table("raw.r', c_custkey % 7, '")\\nx = a.join(b, a.k', c_custkey % 3, ' == b.id).select("c', c_custkey % 5, '", F.col("v").alias("w', c_custkey % 4, '"))\\nx.write.mode("append").saveAsTable("gold.t', c_custkey % 9, '")\\ny = a.groupBy("g").agg(F.sum("q', c_custkey % 6, '").alias("total"))\\ny.repartition(4).write.format("orc").saveAsTable("gold.u', c_custkey % 8, '")') AS code FROM customer""".replace("\\\\n", "\\n")
_P = "WITH p AS (SELECT c_custkey AS id, c_nationkey AS n FROM customer) "


def _facts_of(spark: SparkSession, sf: str, sql: str, dependencies: bool = False) -> DataFrame:
    return readers.column_facts(_files(spark, sf, sql), dependencies).where("primary").drop("primary", "pos", "file_path")


_HEAD = "SELECT 'PySpark' AS file_type, concat('j', id) AS job_name, 'raw' AS source_database, {} FROM p"
_add("pyspark_flow", lambda spark, sf: _facts_of(spark, sf, _PYTHON, True), _P + " UNION ALL ".join(_HEAD.format(x) for x in (
    "concat('s', id % 20) AS source_table, concat('k', id % 3) AS source_column, 'gold' AS target_database, concat('t', id % 9) AS target_table, concat('k', id % 3) AS target_column, 'JOIN' AS sql_operation",
    "concat('r', id % 7), 'id', 'gold', concat('t', id % 9), 'id', 'JOIN'",
    "concat('s', id % 20), concat('c', id % 5), 'gold', concat('t', id % 9), concat('c', id % 5), 'SELECT'",
    "concat('s', id % 20), 'v', 'gold', concat('t', id % 9), concat('w', id % 4), 'ALIAS'",
    "concat('s', id % 20), concat('q', id % 6), 'gold', concat('u', id % 8), 'total', 'AGGREGATE'")))
_lists = lambda df, *names: df.select(*(F.array_join(c, ";").alias(c) if c in names else F.col(c) for c in df.columns))
_add("table_flow_per_write", lambda spark, sf: _lists(readers.table_facts(_files(spark, sf, _PYTHON)), "source_tables", "target_tables", "key_columns", "kpis").drop("file_path", "schedule", "owner"),
     _P + """SELECT concat('j', id) AS job_name, 'curated' AS job_type, concat('d', n) AS domain, 'unknown' AS subject_area, 'join -> select' AS transformation_logic, concat('s', id % 20, ';r', id % 7) AS source_tables, concat('t', id % 9) AS target_tables, concat('k', id % 3, ';id') AS key_columns, '' AS kpis FROM p
UNION ALL SELECT concat('j', id), 'aggregation', concat('d', n), 'unknown', 'join -> select -> groupBy -> agg', concat('s', id % 20, ';r', id % 7), concat('u', id % 8), concat('k', id % 3, ';id;g'), 'total' FROM p""")  # fmt: skip
_add("constructs_pyspark", lambda spark, sf: _lists(readers.construct_facts(_files(spark, sf, _PYTHON)), "source_tables", "target_tables", "constructs_found").select("job_name", "file_type", "source_tables", "target_tables", "constructs_found", F.col("construct_count").cast("long").alias("construct_count"), "complexity", "has_udf", "has_delta_ops"),
     _P + "SELECT concat('j', id) AS job_name, 'PySpark' AS file_type, concat('s', id % 20, ';r', id % 7) AS source_tables, concat('t', id % 9, ';u', id % 8) AS target_tables, 'repartition;format(orc)' AS constructs_found, CAST(2 AS BIGINT) AS construct_count, 'rewrite' AS complexity, FALSE AS has_udf, FALSE AS has_delta_ops FROM p")
_PBIT = """SELECT n_nationkey AS id, concat('rep', n_nationkey, '.pbit') AS name, concat('{"dataSources":[{"type":"sql","queries":[{"name":"q","query":"SELECT a', n_nationkey, ' FROM gold.s', n_regionkey, ' WHERE a', n_nationkey, ' > 1"}]}],"dataModel":{"tables":[{"name":"T', n_nationkey, '","source":"gold.m', n_regionkey, '","columns":[{"name":"x"},{"name":"y"}]}]},"measures":[{"table":"T","name":"M","expression":"SUM(T[x])"}]}') AS code FROM nation"""
_N = "WITH p AS (SELECT n_nationkey AS id, n_regionkey AS r FROM nation) "
_add("pbit_columns", lambda spark, sf: relational.with_report_targets(readers.column_facts(_files(spark, sf, _PBIT)).where("primary")).drop("primary", "pos", "file_path"),
     _N + " UNION ALL ".join(f"SELECT 'PowerBI' AS file_type, concat('rep', id) AS job_name, 'gold' AS source_database, {x} FROM p" for x in (
         "concat('m', r) AS source_table, 'x' AS source_column, 'report' AS target_database, concat('rep', id) AS target_table, 'x' AS target_column, 'SELECT' AS sql_operation",
         "concat('m', r), 'y', 'report', concat('rep', id), 'y', 'SELECT'", "concat('s', r), concat('a', id), 'report', concat('rep', id), concat('a', id), 'SELECT, FILTER'")))
_LOOK = """SELECT n_nationkey AS id, concat('l', n_nationkey, '.lkml') AS name, concat('view: v', n_nationkey, ' { sql_table_name: ops.f', n_regionkey, ' ;; dimension: id { primary_key: yes sql: $', '{TABLE}.id ;; } measure: n { type: sum sql: $', '{TABLE}.w ;; } }') AS code FROM nation"""
_QLIK = """SELECT 100 + n_nationkey AS id, concat('q', n_nationkey, '.qvs') AS name, concat('L', n_nationkey, ':', chr(10), 'SQL SELECT a, SUM(b) AS t FROM scm.f', n_regionkey, ' GROUP BY a;') AS code FROM nation"""
_add("report_tables", lambda spark, sf: _lists(readers.report_facts(_files(spark, sf, f"{_PBIT} UNION ALL {_LOOK} UNION ALL {_QLIK}")), "sql_names", "tables", "columns", "operations").drop("file_path", "domain", "subject_area"),
     _N + """SELECT concat('rep', id) AS report_name, 'PowerBI' AS tool_name, 'q' AS sql_names, concat('s', r) AS tables, concat('a', id, ';x;y') AS columns, 'SELECT;FILTER;AGGREGATE' AS operations FROM p
UNION ALL SELECT concat('l', id), 'Looker', concat('v', id), concat('f', r), 'id;w', 'SELECT;AGGREGATE' FROM p
UNION ALL SELECT concat('q', id), 'Qlik', '', concat('f', r), 'a;b', 'SELECT;AGGREGATE' FROM p""")  # fmt: skip
_add("diagnostics", lambda spark, sf: readers.diagnostics(_files(spark, sf, "SELECT n_nationkey AS id, concat('f', n_nationkey, '.py') AS name, CASE WHEN n_nationkey % 2 = 0 THEN 'def (' ELSE 'DOMAIN = \"x\"' END AS code FROM nation")).select("file_path", "level", F.substring_index("message", ":", 2).alias("message")),
     "SELECT concat('/f', n_nationkey, '.py') AS file_path, 'error' AS level, 'python: SyntaxError' AS message FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT concat('/f', n_nationkey, '.py'), 'warning', 'missing DOMAIN metadata' FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT concat('/f', n_nationkey, '.py'), 'warning', 'missing SUBJECT_AREA metadata' FROM nation")
_DEPS = """SELECT s_suppkey AS id, concat('WITH q AS (SELECT a.x, b.y FROM d.a', s_suppkey % 5, ' a JOIN d.b b ON a.k = b.k WHERE a.z > 1) INSERT INTO g.t', s_suppkey % 3, ' SELECT q.x FROM q WHERE q.x < 5') AS sql FROM supplier"""
_add("dependencies", lambda spark, sf: readers.statement_facts(_views(spark, sf, _DEPS), "sql", "id", True).where("primary").drop("primary"),
     " UNION ALL ".join(f"SELECT s_suppkey AS id, 'd' AS source_database, {x}, 'g' AS target_database, concat('t', s_suppkey % 3) AS target_table, {y} FROM supplier" for x, y in (
         ("concat('a', s_suppkey % 5) AS source_table, 'z' AS source_column", "'—' AS target_column, 'FILTER_DEPENDENCY' AS sql_operation"), ("concat('a', s_suppkey % 5), 'k'", "'—', 'JOIN_KEY'"), ("'b', 'k'", "'—', 'JOIN_KEY'"), ("concat('a', s_suppkey % 5), 'x'", "'x', 'SELECT, FILTER'"))))
_add("sql_in_python", lambda spark, sf: _views(spark, sf, "SELECT s_suppkey AS id, concat('x = spark.sql(\"SELECT a', s_suppkey, ' FROM t\")', chr(10), 'y = spark.sql(v)') AS v FROM supplier").select("id", F.array_join(t.sql_strings(F.col("v")), "|").alias("v")),
     "SELECT s_suppkey AS id, concat('SELECT a', s_suppkey, ' FROM t') AS v FROM supplier")
_CHUNKS = """SELECT s_suppkey AS id, concat('c', s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN '.sh' WHEN 1 THEN '.yaml' WHEN 2 THEN '.tf' WHEN 3 THEN '.json' ELSE '.xml' END) AS name, CASE s_suppkey % 5
 WHEN 0 THEN concat('psql -c \"SELECT a FROM t', s_suppkey, ' WHERE 1 = 1\"') WHEN 1 THEN concat('m:', chr(10), '  sql: |', chr(10), '    SELECT a FROM t', s_suppkey, ' WHERE 1 = 1', chr(10)) WHEN 2 THEN concat('query = \"SELECT a FROM t', s_suppkey, ' WHERE 1 = 1\"')
 WHEN 3 THEN concat('{\"q\": [{\"s\": \"SELECT a FROM t', s_suppkey, ' WHERE 1 = 1\"}]}') ELSE concat('<a><sqlText>SELECT a FROM t', s_suppkey, ' WHERE 1 = 1</sqlText></a>') END AS code FROM supplier"""
_add("chunk_formats", lambda spark, sf: readers.explode_chunks(_files(spark, sf, _CHUNKS)).select("file_name", "dialect", F.trim("content").alias("content")),
     "SELECT concat('c', s_suppkey, ['.sh', '.yaml', '.tf', '.json', '.xml'][s_suppkey % 5 + 1]) AS file_name, 'sql' AS dialect, concat('SELECT a FROM t', s_suppkey, ' WHERE 1 = 1') AS content FROM supplier")

# --- relations between facts
def _on_facts(name: str, f: Callable[[DataFrame], DataFrame], sql: str) -> None:
    _add(name, lambda spark, sf: f(_views(spark, sf, FACTS)), _F + sql)


_RANK = "CASE sql_operation WHEN 'SELECT' THEN 0 WHEN 'AGGREGATE' THEN 1 WHEN 'WINDOW' THEN 2 WHEN 'ALIAS' THEN 3 WHEN 'JOIN' THEN 4 WHEN 'FILTER' THEN 5 WHEN 'UNKNOWN' THEN 6 ELSE 7 END"
_ID = ", ".join(relational.IDENTITY)
_on_facts("op_merge", relational.merge_operations, f"""SELECT {_ID}, string_agg(sql_operation, ', ' ORDER BY k, p) AS sql_operation FROM (
 SELECT {_ID}, sql_operation, {_RANK} AS k, CASE WHEN {_RANK} = 7 THEN min(pos) ELSE 0 END AS p FROM f GROUP BY {_ID}, sql_operation) GROUP BY {_ID}""")  # fmt: skip
_on_facts("prefer_sourced", lambda f: relational.prefer_sourced(f).select(*relational.IDENTITY, "sql_operation"), f"""SELECT DISTINCT {_ID}, sql_operation FROM (
 SELECT *, bool_or(source_table <> '') OVER (PARTITION BY source_column, target_table, target_column, sql_operation) AS any_ FROM f) WHERE source_table <> '' OR NOT any_""")  # fmt: skip
_list = "coalesce(string_agg(DISTINCT {0}, ', ' ORDER BY {0}) FILTER (WHERE {0} <> ''), '')"
_on_facts("table_rollup", relational.table_rollup, f"""SELECT coalesce(arg_max(source_database, pos) FILTER (WHERE source_database <> ''), '') AS source_database, source_table,
 coalesce(arg_max(target_database, pos) FILTER (WHERE target_database <> ''), '') AS target_database, target_table, count(*) FILTER (WHERE target_column <> '—') AS column_count,
 {_list.format('sql_operation')} AS operations, {_list.format('job_name')} AS job_names, {_list.format('file_type')} AS file_types FROM f WHERE source_table <> '' OR target_table <> '' GROUP BY source_table, target_table""")  # fmt: skip
_full = "CASE WHEN {0}_table = '' THEN '' WHEN {0}_database = '' THEN {0}_table ELSE concat({0}_database, '.', {0}_table) END"
_first = "SELECT file_path, file_type, job_name, {1} AS v, min(pos) AS p FROM f WHERE {1} <> '' GROUP BY ALL"
_on_facts("job_summary", relational.job_summary, f""", k AS (SELECT DISTINCT file_path, file_type, job_name FROM f),
 a AS (SELECT file_path, file_type, job_name, string_agg(v, ';' ORDER BY p) AS v FROM ({_first.format(0, _full.format('source'))}) GROUP BY ALL),
 b AS (SELECT file_path, file_type, job_name, string_agg(v, ';' ORDER BY p) AS v FROM ({_first.format(0, _full.format('target'))}) GROUP BY ALL),
 c AS (SELECT file_path, file_type, job_name, string_agg(v, ', ' ORDER BY p) AS v FROM ({_first.format(0, 'sql_operation')}) GROUP BY ALL)
SELECT k.*, coalesce(a.v, '') AS source_tables, coalesce(b.v, '') AS target_tables, coalesce(c.v, '') AS operations_summary FROM k
 LEFT JOIN a USING (file_path, file_type, job_name) LEFT JOIN b USING (file_path, file_type, job_name) LEFT JOIN c USING (file_path, file_type, job_name)""")  # fmt: skip
_on_facts("circular_tables", relational.circular, f"""SELECT table_name, 'source and target' AS appears_as, concat('Table ''', table_name, ''' is read and written by pipelines') AS warning FROM (
 SELECT lower(source_table) AS table_name FROM f WHERE file_type NOT IN {_REPORTS} AND source_table <> '' INTERSECT SELECT lower(target_table) FROM f WHERE file_type NOT IN {_REPORTS} AND target_table <> ''
 EXCEPT SELECT lower(source_table) FROM f WHERE file_type IN {_REPORTS})""")  # fmt: skip
_E2E = f"""SELECT DISTINCT a.source_table, a.source_column, a.target_table, a.target_column, b.target_table AS report_table, b.target_column AS report_column
FROM f a JOIN f b ON lower(trim(a.target_table)) = lower(trim(b.source_table)) AND lower(trim(a.target_column)) = lower(trim(b.source_column))
WHERE a.file_type NOT IN {_REPORTS} AND a.target_table <> '' AND b.file_type IN {_REPORTS} AND b.source_table <> ''"""
_on_facts("e2e_columns", relational.end_to_end_columns, _E2E)


def _e2e_tables(spark: SparkSession, sf: str) -> DataFrame:
    reports = _views(spark, sf, "SELECT concat('report', n_nationkey) AS report_name, concat('gold.T', 20 + n_nationkey, ';x.t', 30 + n_regionkey) AS tables FROM nation")
    rows = _views(spark, sf, FACTS).select("source_table", "source_column", "target_table", "target_column").distinct()
    return relational.end_to_end_tables(rows, reports)


_add("e2e_tables", _e2e_tables, _F + """, r AS (SELECT concat('report', n_nationkey) AS report_name, concat('t', 20 + n_nationkey) AS t FROM nation UNION SELECT concat('report', n_nationkey), concat('t', 30 + n_regionkey) FROM nation),
 l AS (SELECT DISTINCT source_table, source_column, target_table, target_column FROM f)
SELECT l.*, coalesce(report_name, '— no match found') AS report_name FROM l LEFT JOIN r ON r.t = l.target_table""")
_on_facts("mode_impute", relational.impute_sources, """, n AS (SELECT job_name, target_table, source_table, count(*) AS n, min(pos) AS p FROM f WHERE source_table <> '' GROUP BY ALL),
 b AS (SELECT job_name, target_table, source_table AS best FROM (SELECT *, row_number() OVER (PARTITION BY job_name, target_table ORDER BY n DESC, p) AS k FROM n) WHERE k = 1)
SELECT DISTINCT job_name, CASE WHEN source_table = '' AND sql_operation = 'AGGREGATE' THEN coalesce(best, '') ELSE source_table END AS source_table, source_column, target_table, target_column, sql_operation FROM f LEFT JOIN b USING (job_name, target_table)""")
_on_facts("report_targets", lambda f: relational.with_report_targets(f).groupBy("file_type", "target_database", "target_table").agg(F.count("*").alias("n")),
          f"SELECT file_type, CASE WHEN target_table = '' THEN 'report' ELSE target_database END AS target_database, CASE WHEN target_table = '' THEN job_name ELSE target_table END AS target_table, count(*) AS n FROM f WHERE target_table <> '' OR file_type IN {_REPORTS} GROUP BY ALL")
_on_facts("running_sources", lambda f: relational.running_distinct(f.where("source_table <> ''"), "file_path", "pos", "source_table").select("file_path", "pos", F.array_join("so_far", ";").alias("so_far")),
          """, w AS (SELECT file_path, pos, list(source_table) OVER (PARTITION BY file_path ORDER BY pos) AS l FROM f WHERE source_table <> '')
SELECT file_path, pos, array_to_string(list_filter(l, (x, i) -> list_position(l, x) = i), ';') AS so_far FROM w""")  # fmt: skip
_E2E_SUM = ORACLE["e2e_tables"]
_add("e2e_summary", lambda spark, sf: relational.summary(_e2e_tables(spark, sf)), f"""WITH e AS ({_E2E_SUM}) SELECT unnest(['rows', 'matched', 'unmatched', 'reports', 'tables']) AS metric,
 unnest([count(*), count(*) FILTER (WHERE report_name <> '— no match found'), count(*) FILTER (WHERE report_name = '— no match found'), count(DISTINCT report_name) FILTER (WHERE report_name <> '— no match found'), count(DISTINCT target_table)]) AS value FROM e""")  # fmt: skip

# --- shapes of statements beyond the plain ones: all rows of the facts, and which of them the ten-column view shows
_T5, _P7 = "concat('t', s_suppkey % 5)", "s_suppkey % 7"
_HEAD5 = "concat('INSERT INTO g.t', s_suppkey % 5, "
_SHAPES = {
    "union_flow": f"""CASE s_suppkey % 3 WHEN 0 THEN {_HEAD5}' SELECT a AS x FROM d.p', {_P7}, ' UNION ALL SELECT b FROM d.u', s_suppkey % 4)
 WHEN 1 THEN {_HEAD5}' SELECT q.x FROM (SELECT a AS x FROM d.p', {_P7}, ' UNION SELECT SUM(c) FROM e.r', s_suppkey % 2, ') q')
 ELSE {_HEAD5}' SELECT a AS x FROM d.m EXCEPT SELECT a FROM d.n', s_suppkey % 4) END""",
    "multi_source": f"{_HEAD5}' SELECT a.x + b.y AS z, COALESCE(a.p, b.q) AS w FROM d.a', {_P7}, ' a JOIN d.b b ON a.i = b.j')",
    "window_case_flow": f"{_HEAD5}' SELECT ROW_NUMBER() OVER (PARTITION BY a.k ORDER BY a.d) AS rn, CASE WHEN a.s > 1 THEN a.v ELSE a.w END AS c, SUM(a.v) AS total FROM d.a', {_P7}, ' a')",
    "subquery_scope": f"{_HEAD5}' SELECT (SELECT MAX(v.n) FROM d.v v WHERE v.g = r.g) AS k, r.x FROM d.r', {_P7}, ' r WHERE r.y IN (SELECT z FROM d.z)')",
    "self_join_flow": f"{_HEAD5}' SELECT a.x, b.x AS bx, c.y FROM d.e', {_P7}, ' a JOIN d.e', {_P7}, ' b ON a.boss = b.id, d.f c')",
}
#: (which statements, source database, table, column, target column, operation, shown)
_SHAPE_ROWS = {
    "union_flow": [
        ("s_suppkey % 3 = 0", "d", f"concat('p', {_P7})", "a", "x", "ALIAS", True), ("s_suppkey % 3 = 0", "d", "concat('u', s_suppkey % 4)", "b", "x", "SELECT", True),
        ("s_suppkey % 3 = 1", "d", f"concat('p', {_P7})", "a", "x", "ALIAS", True), ("s_suppkey % 3 = 1", "e", "concat('r', s_suppkey % 2)", "c", "x", "AGGREGATE", True),
        ("s_suppkey % 3 = 2", "d", "'m'", "a", "x", "ALIAS", True), ("s_suppkey % 3 = 2", "d", "concat('n', s_suppkey % 4)", "a", "x", "SELECT", True)],
    "multi_source": [("TRUE", "d", f"concat('a', {_P7})", "x", "z", "ALIAS", False), ("TRUE", "d", "'b'", "y", "z", "ALIAS", False), ("TRUE", "", "''", "expr", "z", "ALIAS", True),
                     ("TRUE", "d", f"concat('a', {_P7})", "p", "w", "ALIAS", True), ("TRUE", "d", "'b'", "q", "w", "ALIAS", False)],
    "window_case_flow": [("TRUE", "d", f"concat('a', {_P7})", *x) for x in (("k", "rn", "WINDOW", True), ("s", "c", "ALIAS", True), ("v", "c", "ALIAS", False), ("w", "c", "ALIAS", False), ("v", "total", "AGGREGATE", True))],
    "subquery_scope": [("TRUE", "d", "'v'", "n", "k", "AGGREGATE", True), ("TRUE", "d", f"concat('r', {_P7})", "x", "x", "SELECT", True)],
    "self_join_flow": [("TRUE", "d", f"concat('e', {_P7})", "x", "x", "SELECT", True), ("TRUE", "d", f"concat('e', {_P7})", "x", "bx", "ALIAS", True), ("TRUE", "d", "'f'", "y", "y", "SELECT", True)],
}


def _shape(name: str) -> None:
    statements = f"SELECT s_suppkey AS id, {_SHAPES[name]} AS sql FROM supplier"
    rows = " UNION ALL ".join(f"SELECT s_suppkey AS id, '{db}' AS source_database, {table} AS source_table, '{column}' AS source_column, 'g' AS target_database, {_T5} AS target_table, '{out}' AS target_column, '{op}' AS sql_operation, {shown} AS shown FROM supplier WHERE {where}"
                              for where, db, table, column, out, op, shown in _SHAPE_ROWS[name])
    _add(name, lambda spark, sf: readers.statement_facts(_views(spark, sf, statements), "sql", "id").withColumnRenamed("primary", "shown"), rows)


for _name in _SHAPES:
    _shape(_name)

# --- parts of reports, and of scripts in other languages
_QVS = """SELECT s_suppkey AS id, concat('q', s_suppkey, '.qvs') AS name, concat('Stock', s_suppkey % 3, ':', chr(10), 'LOAD item, qty FROM [lib://Files/moves', s_suppkey % 4, '.qvd] (qvd);', chr(10), 'Sums:', chr(10), 'LOAD item, Sum(qty) AS total RESIDENT Stock', s_suppkey % 3, ' GROUP BY item;', chr(10), 'STORE Sums INTO [lib://Out/sums', s_suppkey % 5, '.qvd] (qvd);') AS code FROM supplier"""
_parts = lambda df: _lists(df, "source_tables", "target_tables", "key_columns", "kpis").select("job_name", "job_type", "transformation_logic", "source_tables", "target_tables", "key_columns", "kpis")
_add("qlik_parts", lambda spark, sf: _parts(readers.table_facts(_files(spark, sf, _QVS))),
     """SELECT concat('q', s_suppkey) AS job_name, 'curated' AS job_type, concat('LOAD Stock', s_suppkey % 3) AS transformation_logic, concat('moves', s_suppkey % 4) AS source_tables, concat('Stock', s_suppkey % 3) AS target_tables, '' AS key_columns, '' AS kpis FROM supplier
UNION ALL SELECT concat('q', s_suppkey), 'aggregation', 'LOAD Sums', concat('Stock', s_suppkey % 3), 'Sums', 'item', 'total (SUM)' FROM supplier
UNION ALL SELECT concat('q', s_suppkey), 'curated', 'STORE Sums: store Sums', 'Sums', concat('sums', s_suppkey % 5), '', '' FROM supplier""")  # fmt: skip
_LKML = """SELECT s_suppkey AS id, concat('l', s_suppkey, '.lkml') AS name, concat('view: v { sql_table_name: ops.f', s_suppkey % 3, ' ;; dimension: id { primary_key: yes sql: $', '{TABLE}.id ;; } measure: n { type: sum sql: $', '{TABLE}.w ;; } } explore: e', s_suppkey % 4, ' { from: v join: u { relationship: one_to_one sql_on: $', '{v.id} = $', '{u.k} ;; } } dashboard: d { element: t { type: table explore: e', s_suppkey % 4, ' fields: [v.id, v.n] } }') AS code FROM supplier"""
_add("lookml_parts", lambda spark, sf: _parts(readers.table_facts(_files(spark, sf, _LKML))),
     """SELECT concat('l', s_suppkey) AS job_name, 'aggregation' AS job_type, 'view v: view v' AS transformation_logic, concat('f', s_suppkey % 3) AS source_tables, 'v' AS target_tables, 'id' AS key_columns, 'v.n (sum)' AS kpis FROM supplier
UNION ALL SELECT concat('l', s_suppkey), 'curated', concat('explore e', s_suppkey % 4, ': explore e', s_suppkey % 4, ', join u (one_to_one)'), 'v;u', concat('e', s_suppkey % 4), 'id;k', '' FROM supplier
UNION ALL SELECT concat('l', s_suppkey), 'curated', 'dashboard d: dashboard d: 1 tiles, tile t (table): v.id, v.n', concat('e', s_suppkey % 4), 'd', '', '' FROM supplier""")  # fmt: skip
_PARTS = """SELECT s_suppkey AS id, concat('b', s_suppkey, '.pbit') AS name, concat('{"dataSources":[{"name":"ds","type":"sql","queries":[{"name":"q","query":"SELECT a FROM gold.s', s_suppkey % 3, '"}]}],"transformations":[{"name":"M', s_suppkey % 4, '","mExpression":"let Source = Sql.Database(\\\\"srv\\\\", \\\\"db', s_suppkey % 5, '\\\\"), T = Source{[Schema=\\\\"dbo\\\\",Item=\\\\"orders\\\\"]}[Data], G = Table.Group(T, {\\\\"k\\\\"}, {}) in G"}],"dataModel":{"relationships":[{"from":"A","to":"B","fromColumn":"x","toColumn":"y"}]},"pages":[{"name":"p","visuals":[{"type":"bar","axis":"A[x]","values":["B.total"]}]}]}') AS code FROM supplier"""
_add("powerbi_parts", lambda spark, sf: _parts(readers.table_facts(_files(spark, sf, _PARTS))),
     """SELECT concat('b', s_suppkey) AS job_name, 'curated' AS job_type, 'data source ds' AS transformation_logic, concat('s', s_suppkey % 3) AS source_tables, '' AS target_tables, '' AS key_columns, '' AS kpis FROM supplier
UNION ALL SELECT concat('b', s_suppkey), 'curated', concat('transformation M', s_suppkey % 4, ': database db', s_suppkey % 5, ', M: Group'), 'orders', concat('M', s_suppkey % 4), '', '' FROM supplier
UNION ALL SELECT concat('b', s_suppkey), 'curated', 'relationship A - B: relationship A - B', '', '', 'x;y', '' FROM supplier
UNION ALL SELECT concat('b', s_suppkey), 'curated', 'page p: visual bar on p; axis: A[x]; values: B.total', '', '', '', '' FROM supplier""")  # fmt: skip
_OTHER = """SELECT s_suppkey AS id, concat('o', s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN '.r' WHEN 1 THEN '.scala' WHEN 2 THEN '.rmd' ELSE '.sh' END) AS name, CASE s_suppkey % 4
 WHEN 0 THEN concat('x <- dbGetQuery(con, "INSERT INTO g.t SELECT a FROM d.t', s_suppkey % 9, '")') WHEN 1 THEN concat('val d = spark.sql(\"\"\"INSERT INTO g.t SELECT a FROM d.t', s_suppkey % 9, '\"\"\")')
 WHEN 2 THEN concat('text', chr(10), '```{sql x}', chr(10), 'INSERT INTO g.t SELECT a FROM d.t', s_suppkey % 9, chr(10), '```', chr(10)) ELSE concat('bq query << EOF', chr(10), 'INSERT INTO g.t SELECT a FROM d.t', s_suppkey % 9, chr(10), 'EOF') END AS code FROM supplier"""
_add("other_languages", lambda spark, sf: readers.column_facts(_files(spark, sf, _OTHER)).select("job_name", "source_database", "source_table", "source_column", "target_table", "target_column", "sql_operation"),
     "SELECT concat('o', s_suppkey) AS job_name, 'd' AS source_database, concat('t', s_suppkey % 9) AS source_table, 'a' AS source_column, 't' AS target_table, 'a' AS target_column, 'SELECT' AS sql_operation FROM supplier")


# --- constructs that the analysed code uses, executed
_same("x_lateral_explode", "SELECT p_partkey, w FROM part LATERAL VIEW explode(split(p_name, ' ')) v AS w", "SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w FROM part")
_same("x_posexplode", "SELECT p_partkey, pos, w FROM part LATERAL VIEW posexplode(split(p_type, ' ')) v AS pos, w", "SELECT p_partkey, CAST(i - 1 AS INTEGER) AS pos, string_split(p_type, ' ')[i] AS w FROM part, unnest(range(1, len(string_split(p_type, ' ')) + 1)) AS u(i)")
_same("x_stack", "SELECT n_name, k, v FROM nation LATERAL VIEW stack(2, 'key', n_nationkey, 'region', n_regionkey) s AS k, v", "SELECT n_name, 'key' AS k, n_nationkey AS v FROM nation UNION ALL SELECT n_name, 'region', n_regionkey FROM nation")
_same("x_inline", "SELECT n_name, a, b FROM nation LATERAL VIEW inline(array(struct(n_nationkey AS a, n_name AS b), struct(n_regionkey AS a, 'r' AS b))) s AS a, b", "SELECT n_name, n_nationkey AS a, n_name AS b FROM nation UNION ALL SELECT n_name, n_regionkey, 'r' FROM nation")
_same("x_pivot", "SELECT * FROM (SELECT l_returnflag, l_linestatus FROM lineitem) PIVOT (count(*) FOR l_linestatus IN ('O' AS open_n, 'F' AS final_n))", "SELECT l_returnflag, nullif(count(*) FILTER (WHERE l_linestatus = 'O'), 0) AS open_n, nullif(count(*) FILTER (WHERE l_linestatus = 'F'), 0) AS final_n FROM lineitem GROUP BY 1")
_same("x_unpivot", "SELECT n_name, k, v FROM (SELECT n_name, n_nationkey, n_regionkey FROM nation) UNPIVOT (v FOR k IN (n_nationkey, n_regionkey))", "SELECT n_name, 'n_nationkey' AS k, n_nationkey AS v FROM nation UNION ALL SELECT n_name, 'n_regionkey', n_regionkey FROM nation")
_same("x_higher_order", "SELECT p_partkey, array_join(transform(filter(split(p_name, ' '), w -> length(w) > 3), w -> upper(w)), '|') AS long_words, aggregate(split(p_name, ' '), 0, (s, w) -> s + length(w)) AS letters FROM part", "SELECT p_partkey, array_to_string(list_transform(list_filter(string_split(p_name, ' '), w -> length(w) > 3), w -> upper(w)), '|') AS long_words, CAST(list_sum(list_transform(string_split(p_name, ' '), w -> length(w))) AS INTEGER) AS letters FROM part")
_same("x_map_struct", "SELECT n_nationkey, element_at(map('a', n_name, 'b', cast(n_regionkey AS string)), 'b') AS b, named_struct('x', n_name).x AS x, array(n_nationkey, n_regionkey)[1] AS r FROM nation", "SELECT n_nationkey, CAST(n_regionkey AS VARCHAR) AS b, n_name AS x, n_regionkey AS r FROM nation")
_RANKED = "SELECT o_orderkey, CAST(row_number() OVER w AS bigint) AS rn, CAST(rank() OVER w AS bigint) AS rk, CAST(dense_rank() OVER w AS bigint) AS dr, CAST(ntile(4) OVER w AS bigint) AS nt, lag(o_orderkey) OVER w AS prev, lead(o_orderkey, 2) OVER w AS nxt FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)"
_same("x_window_ranks", _RANKED)
_same("x_first_last_value", "SELECT o_orderkey, first_value(o_orderkey) OVER w AS f, last_value(o_orderkey) OVER w AS l, nth_value(o_orderkey, 2) OVER w AS n2, CAST(round(percent_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), 6) AS double) AS pr FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)")
_same("x_qualify", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS rn FROM orders) WHERE rn = 1", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) = 1")
_same("x_collect", "SELECT n_regionkey, array_join(sort_array(collect_list(n_name)), ',') AS names, size(collect_set(n_regionkey)) AS n FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names, 1 AS n FROM nation GROUP BY n_regionkey")
_same("x_distinct_any", "SELECT c_nationkey, count(DISTINCT c_mktsegment) AS segments, any_value(c_nationkey) AS one, approx_count_distinct(c_nationkey) AS about FROM customer GROUP BY c_nationkey", "SELECT c_nationkey, count(DISTINCT c_mktsegment) AS segments, c_nationkey AS one, CAST(1 AS BIGINT) AS about FROM customer GROUP BY c_nationkey")
_same("x_dates", "SELECT o_orderkey, date_add(o_orderdate, 7) AS plus, date_sub(o_orderdate, 3) AS minus, datediff(o_orderdate, DATE '1992-01-01') AS days, CAST(date_trunc('MONTH', o_orderdate) AS date) AS month, current_date() >= DATE '2020-01-01' AS now_ok FROM orders",
      "SELECT o_orderkey, CAST(o_orderdate AS DATE) + 7 AS plus, CAST(o_orderdate AS DATE) - 3 AS minus, CAST(CAST(o_orderdate AS DATE) - DATE '1992-01-01' AS INTEGER) AS days, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, TRUE AS now_ok FROM orders")
_same("x_try_cast", "SELECT p_partkey, try_cast(p_type AS int) AS bad, try_cast(cast(p_size AS string) AS int) AS good FROM part", "SELECT p_partkey, TRY_CAST(p_type AS INTEGER) AS bad, p_size AS good FROM part")
_same("x_aggregates", "SELECT l_returnflag, CAST(sum(CAST(l_quantity AS bigint)) AS bigint) AS s, count(*) AS n, CAST(min(l_quantity) AS bigint) AS lo, CAST(max(l_quantity) AS bigint) AS hi, round(avg(l_quantity), 4) AS mean, round(stddev(l_quantity), 4) AS sd, round(variance(l_quantity), 3) AS var FROM lineitem GROUP BY l_returnflag")
_same("x_joins", "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
_same("x_semi_anti", "SELECT 'with' AS k, count(*) AS n FROM customer LEFT SEMI JOIN orders ON c_custkey = o_custkey UNION ALL SELECT 'without', count(*) FROM customer LEFT ANTI JOIN orders ON c_custkey = o_custkey", "SELECT 'with' AS k, count(*) AS n FROM customer SEMI JOIN orders ON c_custkey = o_custkey UNION ALL SELECT 'without', count(*) FROM customer ANTI JOIN orders ON c_custkey = o_custkey")
_same("x_set_operations", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier EXCEPT SELECT n_nationkey FROM nation WHERE n_regionkey = 0")
_same("x_top_k", "SELECT o_custkey, o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
_same("x_merge", """SELECT coalesce(s.s_suppkey, c.c_custkey) AS id, CASE WHEN s.s_suppkey IS NULL THEN 'insert' WHEN c.c_custkey IS NULL THEN 'keep' ELSE 'update' END AS action, coalesce(c.c_name, s.s_name) AS name
FROM supplier s FULL OUTER JOIN customer c ON s.s_suppkey = c.c_custkey""")
