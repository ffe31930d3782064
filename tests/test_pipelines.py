"""Files to tables: detection, chunks, Python and report readers, whole jobs, sinks."""

import json
import zipfile

from pyspark.sql import functions as F

from rivulet.functions import bi, chunks, formats, pyscope
from rivulet.operators import readers
from rivulet.plans import pipelines, sinks
from rivulet.sources import files

SQL = b"-- DOMAIN: retail\n-- OWNER: me\nINSERT INTO gold.sums SELECT o.cust, SUM(o.amount) AS total FROM silver.orders o GROUP BY o.cust; CREATE TABLE gold.top AS SELECT cust FROM gold.sums WHERE cust > 1"
PY = b'''
DOMAIN = "hr"
DOMAIN = "later"
a = spark.table("raw.people")
b = spark.read.table("raw.depts")
c = a.join(b, a.dept == b.id).select(F.col("name"), F.col("pay").alias("salary"))
c.write.mode("overwrite").saveAsTable("silver.staff")
spark.sql("INSERT INTO silver.copy SELECT x FROM raw.other")
class A:
    def f(self):
        self.spark.sql("INSERT INTO silver.inner SELECT y FROM raw.deep")
        other.sql("INSERT INTO no.no SELECT z FROM no.way")
'''
PBIT = json.dumps({"metadata": {"DOMAIN": "bi"}, "dataSources": [{"type": "sql", "queries": [{"name": "q", "query": "SELECT cust, total FROM gold.sums WHERE total > 0"}]}],
                   "dataModel": {"tables": [{"name": "T", "source": "gold.sums", "columns": [{"name": "cust"}]}], "relationships": [{"from": "T", "to": "U", "fromColumn": "cust", "toColumn": "id"}]},
                   "measures": [{"table": "T", "name": "All", "expression": "SUM(T[total])"}]}).encode()
LKML = b"""# DOMAIN: net
view: v {
  sql_table_name: ops.facts ;;
  dimension: id { primary_key: yes sql: ${TABLE}.id ;; }
  measure: n { type: count sql: ${TABLE}.id ;; }
}
view: d { derived_table: { sql: SELECT k, MAX(w) AS m FROM ops.deep GROUP BY k ;; } dimension: k { sql: ${TABLE}.kk ;; } }
explore: v { join: d { relationship: one_to_one sql_on: ${v.id} = ${d.k} ;; } }
"""
QVS = b"""// DOMAIN: scm
// SQL SELECT a FROM not.there;
Stock:
SQL SELECT s.item, s.qty FROM scm.stock s WHERE s.qty > 0;
Sums:
LOAD item, Sum(qty) AS total RESIDENT Stock GROUP BY item;
LOAD x FROM [lib://Files/moves.qvd] (qvd);
STORE Sums INTO [lib://Out/sums.qvd];
"""


def test_chunks():
    get = lambda n, b: [(c.dialect, c.content.strip()) for c in chunks.extract(n, b)[0]]
    assert [d for d, _ in get("a.sql", SQL)] == ["sql", "sql"]
    assert get("a.sh", b"bq query << 'X'\nSELECT 'a' FROM t\nX\npsql -c \"INSERT INTO t SELECT 'q' FROM u\"") == [("sql", "SELECT 'a' FROM t"), ("sql", "INSERT INTO t SELECT 'q' FROM u")]
    assert get("a.yaml", b"x:\n  sql: |\n    SELECT a\n    FROM b\n  query: \"SELECT long enough FROM c\"\n") == [("sql", "SELECT a\nFROM b"), ("sql", "SELECT long enough FROM c")]
    assert get("a.xml", b"<r><sqlReaderQuery><![CDATA[SELECT a FROM b WHERE x < 1]]></sqlReaderQuery><n>no</n></r>") == [("sql", "SELECT a FROM b WHERE x < 1")]
    assert get("a.tf", b"query = <<-SQL\nSELECT 1 FROM t\n  SQL\n") == [("sql", "SELECT 1 FROM t")]
    assert get("a.json", b'{"a": [{"q": "SELECT x FROM y"}, "plain"]}') == [("sql", "SELECT x FROM y")]
    assert [d for d, _ in get("a.scala", b'val d = spark.sql("""SELECT a FROM b""")')] == ["scala", "sql"]
    assert get("a.r", b"dbGetQuery(con, \"SELECT 'v' FROM t\")")[1] == ("sql", "SELECT 'v' FROM t")
    assert [d for d, _ in get("a.rmd", b"text\n```{sql x}\nSELECT 1\n```\n```{r}\nx\n```\n")] == ["sql", "r"]
    nb = json.dumps({"cells": [{"cell_type": "code", "source": ["x = 1"]}, {"cell_type": "code", "source": "%%sql\nSELECT 1"}, {"cell_type": "markdown", "source": "SELECT"}]}).encode()
    assert get("a.ipynb", nb) == [("python", "x = 1"), ("sql", "SELECT 1")]
    assert chunks.extract("a.json", b"\xff\xfe\x00")[1] == "" and chunks.extract("a.sql", None) == ([], "")


def test_zip_models(tmp_path):
    p = tmp_path / "r.pbit"
    with zipfile.ZipFile(p, "w") as z:
        z.writestr("DataModelSchema", PBIT.decode().encode("utf-16"))
    assert bi.powerbi(p.read_bytes()).sources == ["sums"]


def test_python_flow():
    found, problem = pyscope.pyspark_mappings(PY.decode(), True)
    assert problem == ""
    got = {(m.source_table, m.source_column, m.target_table, m.target_column, m.sql_operation) for m in found}
    assert {("people", "name", "staff", "name", "SELECT"), ("people", "pay", "staff", "salary", "ALIAS"), ("people", "dept", "staff", "dept", "JOIN"), ("depts", "id", "staff", "id", "JOIN"), ("other", "x", "copy", "x", "SELECT"), ("deep", "y", "inner", "y", "SELECT")} <= got
    assert not any("way" in x for x in got)
    assert pyscope.metadata(PY.decode()) == {"DOMAIN": "hr"}
    assert pyscope.pyspark_mappings("def (")[1].startswith("python: SyntaxError")
    assert [w.target for w in pyscope.writes(PY.decode())[0]] == ["staff"]


def test_python_constructs():
    code = '@udf("int")\ndef f(x): return x\ndf.repartition(2).write.format("delta").saveAsTable("t")\nF.coalesce(a, b)\n"{}".format("csv")\nF.broadcast(d)\nw = Window.partitionBy("a")'
    assert pyscope.constructs(code)[0] == ["udf", "repartition", "format(delta)", "broadcast", "Window", "partitionBy"]


def test_reports():
    p, l, q = bi.powerbi(PBIT), bi.lookml(LKML.decode()), bi.qlik(QVS.decode())
    assert p.sources == ["sums"] and p.kpis == ["T.All"] and p.job_type == "aggregation" and "cust" in p.keys
    assert l.sources == ["facts", "deep"] and l.kpis == ["v.n (count)"] and l.keys[0] == "id" and "kk" in l.columns
    assert q.sources == ["stock", "moves"] and q.kpis == ["total (SUM)"] and q.targets == ["Stock", "Sums", "sums"] and "item" in q.keys


def all_files(spark):
    return files.upload(spark, {"a.sql": SQL, "copy.sql": b"-- other comment\n" + SQL.upper(), "b.py": PY, "r.pbit": PBIT, "v.lkml": LKML, "q.qvs": QVS, "bad.py": b"def (", "none.sql": b""})


def test_unified(spark, tmp_path):
    u = pipelines.unified(all_files(spark))
    assert [(r.removed_file, r.duplicate_of) for r in u.duplicates.collect()] == [("copy.sql", "a.sql")]
    e2e = {(r.source_table, r.source_column, r.target_column, r.report_table) for r in u.end_to_end.collect()}
    assert ("orders", "amount", "total", "r") in e2e and ("orders", "cust", "cust", "r") in e2e
    roll = {(r.source_table, r.target_table): r for r in u.table_flow.collect()}
    assert roll["orders", "sums"].column_count == 2 and roll["orders", "sums"].operations == "AGGREGATE, SELECT"
    assert u.circular.count() == 0  # a report reads the table that pipelines both write and read
    summary = {r.file_path: r for r in u.job_summary.collect()}
    assert summary["a.sql"].source_tables == "silver.orders;gold.sums" and summary["a.sql"].target_tables == "gold.sums;gold.top"
    path = str(tmp_path / "out.xlsx")
    sinks.write_workbook(u.sheets(), path)
    sheets = files.read_workbook(path)
    assert list(sheets) == list(u.sheets()) and len(sheets["Table Flow"]) == len(roll)
    u.close()
    assert sinks.versioned(str(tmp_path / "x.csv")).endswith("x_v1.csv")
    sinks.write_csv(u.duplicates, str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).count() == 1


def test_circular_without_report(spark):
    u = pipelines.unified(files.upload(spark, {"a.sql": SQL}))
    assert [r.table_name for r in u.circular.collect()] == ["sums"]
    u.close()


def test_table_level_migration_reporting(spark):
    rows, problems = pipelines.table_flow(all_files(spark))
    got = {(r.file_path, tuple(r.target_tables)): r for r in rows.collect()}
    r = got["a.sql", ("sums",)]
    assert (r.domain, r.owner, r.schedule, r.job_type, list(r.source_tables), list(r.kpis)) == ("retail", "me", None, "aggregation", ["orders"], ["total"])
    assert ("bad.py", "error") in {(x.file_path, x.level) for x in problems.collect()}
    m = {r.file_path: r for r in pipelines.migration(files.upload(spark, {"m.sql": b"-- VACUUM\nMERGE INTO t USING u ON t.i = u.i WHEN MATCHED THEN UPDATE SET a = u.a", "p.py": b"x = udf(f)"})).collect()}
    assert (m["m.sql"].constructs_found, m["m.sql"].complexity, m["m.sql"].has_delta_ops, m["m.sql"].has_udf) == (["MERGE INTO"], "manual", True, False)
    assert (m["p.py"].constructs_found, m["p.py"].complexity, m["p.py"].has_udf) == (["udf"], "manual", True)
    assert {r.tool_name for r in pipelines.reporting(all_files(spark)).collect()} == {"PowerBI", "Looker", "Qlik"}


def test_end_to_end_tables(spark):
    rows = spark.createDataFrame([("j", "", "a", "g.t", "x", "AGGREGATE", 2), ("j", "s", "b", "g.t", "y", "SELECT", 1), ("j", "s", "b", "lone", "y", "SELECT", 3)], "job_name string, source_table string, source_column string, target_table string, target_column string, sql_operation string, pos long")
    reports = spark.createDataFrame([("rep", "gold.T;other")], "report_name string, tables string")
    joined, five = pipelines.end_to_end(rows, reports)
    got = {(r.source_table, r.target_column, r.report_name) for r in joined.collect()}
    assert got == {("s", "x", "rep"), ("s", "y", "rep"), ("s", "y", "— no match found")}
    assert {r.metric: r.value for r in five.collect()} == {"rows": 3, "matched": 2, "unmatched": 1, "reports": 1, "tables": 2}


def test_scan(spark, tmp_path):
    (tmp_path / "in dir" / "skip").mkdir(parents=True)
    for name in ("b.sql", "a.SQL.txt", "c.py"):
        (tmp_path / "in dir" / name).write_bytes(b"SELECT 1")
    (tmp_path / "in dir" / "skip" / "d.sql").write_bytes(b"SELECT 2")
    found = files.scan(spark, str(tmp_path), ["*.sql", "*.py"], ["skip/"]).orderBy("file_pos").collect()
    assert [r.file_name for r in found] == ["b.sql", "c.py"] and len({r.file_pos for r in found}) == 2
    assert readers.column_facts(files.scan(spark, str(tmp_path))).count() >= 0


def test_git(spark, tmp_path):
    import subprocess

    repo = tmp_path / "repo"
    repo.mkdir()
    (repo / "x.sql").write_bytes(SQL)
    (repo / "y.txt").write_bytes(b"no")
    run = lambda *a: subprocess.run(["git", "-C", str(repo), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    run("init", "-b", "main")
    run("add", ".")
    run("commit", "-m", "x")
    assert [r.file_name for r in files.from_git(spark, f"file://{repo}").collect()] == ["x.sql"]
    assert files.display_url("https://u:p@h/x.git") == "https://h/x.git"


def test_detection_agrees(spark):
    texts = ["{}", " [1]", "<x/>", "x\nselect 1", "from pyspark import x", "---\na: 1", "key : v", "plain", ""]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, v string")
    got = [r.k for r in df.orderBy("i").select(formats.sniff(F.col("v")).alias("k")).collect()]
    assert got == [":".join(formats.detect("noext", x)) for x in texts]
    assert got == ["json:json", "json:json", "xml:xml", "sql:sql", "python:python", "yaml:yaml", "yaml:yaml", "text:unknown", "text:unknown"]


def test_command_line(spark, tmp_path):
    from rivulet.__main__ import main

    (tmp_path / "code").mkdir()
    (tmp_path / "code" / "a.sql").write_bytes(SQL)
    (tmp_path / "code" / "r.pbit").write_bytes(PBIT)
    for job in ("unified", "columns", "tables", "migration", "reports", "e2e"):
        assert main([job, str(tmp_path / "code"), str(tmp_path / job)]) == 0
    assert spark.read.parquet(str(tmp_path / "unified" / "column_flow")).count() == 6
    (tmp_path / "code" / "bad.py").write_bytes(b"def (")
    assert main(["columns", str(tmp_path / "code"), str(tmp_path / "again.xlsx"), "--format", "xlsx"]) == 1
    assert set(files.read_workbook(str(tmp_path / "again.xlsx"))) == {"Column Flow", "Job Summary"}


def test_statements_are_kept_whole(spark):
    """The transformation logic is the statement as written, whatever its length."""
    sql = "INSERT INTO gold.wide\nSELECT " + ",\n  ".join(f"o.column_{k} AS c{k}" for k in range(200)) + "\nFROM silver.orders o"
    rows = [("/c/a.sql", "a.sql", bytearray(sql.encode()), 0)]
    got = readers.table_facts(spark.createDataFrame(rows, "path string, file_name string, content binary, file_pos long")).collect()
    assert [r.transformation_logic for r in got] == [sql]
