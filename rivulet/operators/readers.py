"""From files to fact tables: Arrow functions around the parsers, pruned before they are called."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .. import schemas
from ..functions import bi, chunks, constructs, formats, pyscope, sqlscope
from ..functions.formats import FAMILIES, LABELS, detect
from ..shipping import ship

#: Rows handed to a parser at a time, which bounds what is held besides one file.
ROWS = 64


def _mapped(df: DataFrame, f, schema: str) -> DataFrame:
    """``f`` (a tuple of values → rows) over every row; parsers' rows in small batches."""
    ship(df.sparkSession)
    spark_schema = StructType.fromDDL(schema)
    arrow = to_arrow_schema(spark_schema)

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, ROWS):
                part = b.slice(i, ROWS)
                rows = [r for values in zip(*(c.to_pylist() for c in part.columns), strict=True) for r in f(*values)]
                cols = list(zip(*rows, strict=True)) if rows else [[] for _ in arrow]
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(cols, arrow, strict=True)], schema=arrow)

    return df.mapInArrow(run, spark_schema)


def explode_chunks(files: DataFrame) -> DataFrame:
    """One row for each piece of code in each file."""

    def f(path, name, content, pos):
        found, _ = chunks.extract(name, content)
        return [(path, name, pos, k, c.content, c.dialect, c.label) for k, c in enumerate(found)]

    return _mapped(files.select("path", "file_name", "content", "file_pos"), f, schemas.CHUNKS)


def diagnostics(files: DataFrame) -> DataFrame:
    """Files that could not be read; sources, targets and metadata that are missing."""

    def f(path, name, content, pos):
        problem = chunks.extract(name, content)[1]
        out = [(path, "error", problem)] if problem else []
        for c in units(name, content):
            if c.dialect == "python":
                out += [(path, "error", d)] if (d := pyscope.pyspark_mappings(c.content)[1]) else []
        for k, r in enumerate(_table_rows(path, name, content)):
            out += [(path, "warning", f"{what} table of part {k} is not known") for what, tables in (("source", r[8]), ("target", r[9])) if not tables]
        known = file_metadata(name, content)
        return out + [(path, "warning", f"missing {k} metadata") for k in ("DOMAIN", "SUBJECT_AREA") if k not in known]

    return _mapped(files.select("path", "file_name", "content", "file_pos"), f, "file_path string, level string, message string")


def file_metadata(name: str, content: bytes | None) -> dict[str, str]:
    """The four metadata values of one file, as its kind writes them."""
    text = chunks.decode(content or b"")
    kind, _ = detect(name, text)
    if kind == "python":
        return pyscope.metadata(text)
    if kind == "notebook":
        return pyscope.metadata("\n".join(c.content for c in chunks.from_notebook(text) if c.dialect == "python"))
    if (r := bi.read_report(name, content)) is not None:
        return r.metadata
    mark = {"sql": "--", "shell": "#", "yaml": "#", "terraform": "#", "r": "#", "scala": "//", "java": "//"}.get(kind)
    return {k: v for k in pyscope.METADATA if (v := bi._meta(text, k, mark))} if mark else {}


def units(name: str, content: bytes | None) -> list[chunks.Chunk]:
    """A file's pieces as programs: the Python cells of a notebook are one, without magics, so that names carry over."""
    found, _ = chunks.extract(name, content)
    cells = [c for c in found if c.dialect == "python"]
    if len(cells) < 2:
        return found
    code = "\n".join(re.sub(r"(?m)^\s*[%!].*$", "", c.content) for c in cells)
    return [chunks.Chunk(code, "python", "notebook"), *(c for c in found if c.dialect != "python")]


def _stem(name: str) -> str:
    base = name.rpartition("/")[2]
    return base.rpartition(".")[0] or base


def mappings_of(content: str, dialect: str, job: str, dependencies: bool) -> list[sqlscope.Mapping]:
    if dialect == "sql":
        return sqlscope.column_mappings(content, dependencies)
    if dialect == "python":
        return pyscope.pyspark_mappings(content, dependencies)[0]
    if dialect == "powerbi":
        return bi.powerbi_mappings(content, job)
    if dialect == "lookml":
        return bi.lookml_mappings(content)
    if dialect == "qlik":
        return bi.qlik_mappings(content, job)
    return sqlscope.column_mappings(content, dependencies) if dialect == "unknown" and chunks.STARTS_SQL.match(content) else []


def column_facts(files: DataFrame, dependencies: bool = False) -> DataFrame:
    """The fact table: every file's mappings, merged within the file, with ordinals. Rows without a target stay."""

    def f(path, name, content, pos):
        label = LABELS.get(detect(name, chunks.decode((content or b"")[:4096]))[0], "Unknown")
        job, rows = _stem(name), []
        for c in units(name, content):
            rows += mappings_of(c.content, c.dialect, job, dependencies)
        return [(path, label, job, *m, (pos << 32) + k) for k, m in enumerate(sqlscope.merged(rows))]

    ddl = ", ".join(f"{x.name} {x.dataType.simpleString()}" for x in schemas.FACTS.fields)
    return _mapped(files.select("path", "file_name", "content", "file_pos"), f, ddl)


def statement_facts(rows: DataFrame, text: str, key: str, dependencies: bool = False) -> DataFrame:
    """Mappings of a table of SQL texts: the key, the seven columns, ``primary``."""

    def f(k, sql):
        return [(k, *m) for m in sqlscope.column_mappings(sql or "", dependencies)]

    ddl = f"{key} {rows.schema[key].dataType.simpleString()}, " + ", ".join(f"{n} string" for n in schemas.COLUMN_MAPPING.names) + ", primary boolean"
    return _mapped(rows.select(key, text), f, ddl)


def _table_rows(path: str, name: str, content: bytes | None) -> list[tuple]:
    meta = file_metadata(name, content)
    head = lambda kind: (path, _stem(name), kind, meta.get("DOMAIN", "unknown"), meta.get("SUBJECT_AREA", "unknown"), meta.get("SCHEDULE"), meta.get("OWNER"))
    if (r := bi.read_report(name, content)) is not None:
        parts = [(*head(p.job_type), f"{p.kind} {p.name}: {bi.shortened(p.logic, 5)}" if p.logic else f"{p.kind} {p.name}", p.sources, p.targets, p.keys, p.kpis) for p in r.parts]
        return parts or [(*head(r.job_type), bi.shortened(r.logic, 5), r.sources, r.targets, r.keys, r.kpis)]
    out = []
    for c in units(name, content):
        if c.dialect == "python":
            for w in pyscope.writes(c.content)[0]:
                logic = " -> ".join(w.logic) or " | ".join(w.sql)
                out.append((*head("aggregation" if {"groupBy", "agg"} & set(w.logic) else "curated"), logic, w.sources, [w.target] if w.target else [], w.keys, w.kpis))
        for sql in sqlscope.split_statements(c.content) if c.dialect == "sql" else pyscope.sql_statements(c.content) if c.dialect == "python" else []:
            if facts := statement_summary(sql):
                kind, sources, targets, keys, kpis = facts
                out.append((*head(kind), sql.strip(), sources, targets, keys, kpis))
    return out


def table_facts(files: DataFrame) -> DataFrame:
    """Table-level flow: a row for each SQL statement, each write of a script, each part of a report."""
    return _mapped(files.select("path", "file_name", "content", "file_pos"), lambda path, name, content, pos: _table_rows(path, name, content), schemas.TABLE_FACTS)


def statement_summary(sql: str) -> tuple[str, list[str], list[str], list[str], list[str]] | None:
    """Job type, sources, targets, keys and measures of one statement."""
    s = sqlscope.read_statement(sql)
    if s is None or s.query is None and not s.target[1]:
        return None
    sources, keys, kpis, aggregated = [], [], [], False
    scopes = [*sqlscope._all_inner(s.query, set()), s.query] if s.query is not None else []
    for q in scopes:
        sources += [r.table for r in q.relations if r.query is None]
        keys += [x.rpartition(".")[2] for x in q.join_names] + [n for n, _ in q.filters]
        aggregated |= any(o.op == "AGGREGATE" for o in q.outputs)
        kpis += [o.name for o in q.outputs if o.op == "AGGREGATE"]
    once = lambda xs: list(dict.fromkeys(x for x in xs if x))
    return ("aggregation" if aggregated or "GROUP BY" in " ".join(sql.upper().split()) else "curated"), once(sources), once([s.target[1]]), once(keys), once(kpis)


def construct_facts(files: DataFrame) -> DataFrame:
    """Platform constructs of each SQL or Python file. SQL is matched by native expressions, Python by its syntax tree."""
    kind = formats.family(F.col("file_name"), F.make_valid_utf8(F.col("content").cast("string")))
    wanted = files.withColumn("family", kind).where(F.col("family").isin("sql", "python", "notebook"))

    def f(path, name, content, pos, family):
        meta = file_metadata(name, content)
        text = chunks.decode(content or b"")
        if family == "sql":
            facts = [x for s in sqlscope.split_statements(text) if (x := statement_summary(s))]
            found, problem = [], ""
            sources, targets = ([t for x in facts for t in x[k]] for k in (1, 2))
        else:
            code = text if family == "python" else "\n".join(c.content for c in units(name, content) if c.dialect == "python")
            found, sources, targets, problem = pyscope.constructs(code)
            text = "\n".join(pyscope.sql_strings(code))
        once = lambda xs: list(dict.fromkeys(xs))
        return [(path, _stem(name), "SQL" if family == "sql" else "PySpark", meta.get("DOMAIN", "unknown"), meta.get("SUBJECT_AREA", "unknown"), once(sources), once(targets), found, text if family == "sql" else "", problem)]

    parsed = _mapped(wanted.select("path", "file_name", "content", "file_pos", "family"), f,
                     "file_path string, job_name string, file_type string, domain string, subject_area string, source_tables array<string>, target_tables array<string>, py array<string>, sql string, diagnosis string")
    all_severities = constructs.SEVERITY | pyscope.CONSTRUCTS
    found = F.when(F.col("file_type") == "SQL", constructs.found(F.col("sql"))).otherwise(F.col("py"))
    out = parsed.withColumn("constructs_found", found)
    return out.select("file_path", "job_name", "file_type", "domain", "subject_area", "source_tables", "target_tables", "constructs_found",
                      F.size("constructs_found").alias("construct_count"), constructs.complexity(F.col("constructs_found"), all_severities).alias("complexity"),
                      constructs.has_any(F.col("constructs_found"), constructs.UDF_PYTHON).alias("has_udf"),
                      constructs.has_any(F.col("constructs_found"), (*constructs.DELTA, *constructs.DELTA_PYTHON)).alias("has_delta_ops"), "diagnosis")


def report_facts(files: DataFrame) -> DataFrame:
    """A row for each report definition."""

    def f(path, name, content, pos):
        r = bi.read_report(name, content)
        return [(path, _stem(name), r.tool, r.metadata.get("DOMAIN", "unknown"), r.metadata.get("SUBJECT_AREA", "unknown"), r.sql_names, r.sources, r.columns, r.operations)] if r else []

    wanted = files.where(formats.suffix(F.col("file_name")).isin(".pbit", ".pbix", ".lkml", ".lookml", ".qvs"))
    return _mapped(wanted.select("path", "file_name", "content", "file_pos"), f, schemas.REPORTING)


__all__ = ["FAMILIES", "column_facts", "construct_facts", "diagnostics", "explode_chunks", "report_facts", "statement_facts", "table_facts"]
