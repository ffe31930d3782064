"""Relational operators over flow facts, as DataFrame expressions only.

Rows carry an ordinal ``pos`` wherever "first seen" decides, as order means nothing after a shuffle. Text is never null:
unknown is the empty string. Joins are left to Catalyst (broadcast where a side is known to be small, sort-merge with
skew handling where not); groups are aggregated before they are shuffled.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sqlscope import NO_COLUMN, OP_ORDER

IDENTITY = ["source_database", "source_table", "source_column", "target_database", "target_table", "target_column"]
#: What the report tools call themselves, and what stands for "no match" in joined rows.
REPORT_TYPES = ("Qlik", "Looker", "PowerBI", "Tableau", "SSRS")
NO_MATCH = "— no match found"


def bare(c: Column) -> Column:
    """A table's name without its database, in lower case and trimmed."""
    return F.lower(F.trim(F.substring_index(c, ".", -1)))


def op_rank(op: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for k, name in enumerate(OP_ORDER) for x in (name, k))), op), F.lit(len(OP_ORDER)))


def prefer_sourced(rows: DataFrame) -> DataFrame:
    """Of rows with the same source column, target and operation, the unresolved ones go if any is resolved; then distinct.

    Resolved keys are summed up and joined back, so a key with very many rows is no window of one task.
    """
    key = ["source_column", "target_table", "target_column", "sql_operation"]
    resolved = rows.groupBy(*key).agg(F.max(F.col("source_table") != "").alias("__any"))
    kept = rows.join(resolved, key).where((F.col("source_table") != "") | ~F.col("__any")).select(*rows.columns)
    return kept.dropDuplicates([*IDENTITY, "sql_operation"])


def merge_operations(rows: DataFrame, keys: list[str] = IDENTITY) -> DataFrame:
    """One row for each identity; its different operations joined by ", " in order of priority, others last as they came."""
    first = rows.groupBy(*keys, "sql_operation").agg(F.min("pos").alias("pos"))
    entry = F.struct(op_rank(F.col("sql_operation")).alias("k"), F.when(op_rank(F.col("sql_operation")) == len(OP_ORDER), F.col("pos")).otherwise(F.lit(0)).alias("p"), F.col("sql_operation").alias("op"))
    return first.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["op"]), ", ").alias("sql_operation"))


def keep_first_content(files: DataFrame, text: str, name: str, order: str, held: list[DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """(files kept, files removed with the name of the first): equal after ``normalised``, the least ``order`` first.

    Texts are hashed once, into a small cached table (given to ``held`` for its release); the least of each hash is found by
    an aggregate over it. What goes is taken out by an anti-join on the ordinal, so that texts are shuffled only if the
    removed files are too many to broadcast.
    """
    slim = files.select(order, name, content_hash(F.col(text)).alias("hash"), F.length(text).cast("long").alias("size_bytes")).persist(StorageLevel.MEMORY_AND_DISK)
    if held is not None:
        held.append(slim)
    first = slim.groupBy("hash").agg(F.min(F.struct(order, name)).alias("first"), F.count("*").alias("n")).where("n > 1")
    gone = slim.join(first, "hash").where(F.col(order) != F.col(f"first.{order}"))
    removed = gone.select(F.col(name).alias("removed_file"), F.col(f"first.{name}").alias("duplicate_of"), F.lit("Identical query content (normalised SHA-256 match)").alias("reason"), "size_bytes")
    return files.join(gone.select(order), order, "left_anti"), removed


def table_level(facts: DataFrame) -> DataFrame:
    """All sources of all expressions, without the rows that only stand for them in the ten-column view."""
    return facts.where((F.col("source_table") != "") | (F.col("source_column") != "expr"))


def normalised(c: Column) -> Column:
    """Without block, ``--`` and ``//`` comments, white space as one space, trimmed, in lower case."""
    c = F.regexp_replace(c, r"(?s)/\*.*?\*/", " ")
    c = F.regexp_replace(c, r"--[^\n]*", " ")
    c = F.regexp_replace(c, r"//[^\n]*", " ")
    return F.lower(F.trim(F.regexp_replace(c, r"[ \t\n\r\f]+", " ")))


def content_hash(c: Column) -> Column:
    return F.sha2(normalised(c), 256)


def _joined(name: str) -> Column:
    return F.array_join(F.array_sort(F.collect_set(F.when(F.col(name) != "", F.col(name)))), ", ")


def table_rollup(facts: DataFrame) -> DataFrame:
    """(source table, target table): columns that are not dependencies, operations, jobs and file types."""
    keyed = facts.where((F.col("source_table") != "") | (F.col("target_table") != ""))
    last = lambda c: F.coalesce(F.max_by(F.col(c), F.when(F.col(c) != "", F.col("pos"))), F.lit("")).alias(c)
    out = keyed.groupBy("source_table", "target_table").agg(
        last("source_database"), last("target_database"), F.count_if(F.col("target_column") != NO_COLUMN).alias("column_count"),
        _joined("sql_operation").alias("operations"), _joined("job_name").alias("job_names"), _joined("file_type").alias("file_types"))
    return out.select("source_database", "source_table", "target_database", "target_table", "column_count", "operations", "job_names", "file_types")


def job_summary(facts: DataFrame) -> DataFrame:
    """For each file its sources, targets (``;``) and operations (``, ``), each once in order of appearance."""

    def ordered(value: Column, sep: str) -> Column:
        found = F.array_sort(F.collect_list(F.when(value != "", F.struct(F.col("pos").alias("p"), value.alias("v")))))
        return F.array_join(F.array_distinct(F.transform(found, lambda x: x["v"])), sep)

    def full(side: str) -> Column:
        t, d = F.col(f"{side}_table"), F.col(f"{side}_database")
        return F.when(t == "", "").when(d == "", t).otherwise(F.concat_ws(".", d, t))

    # What a file repeats is summed up first, so that lists hold different values only.
    one = lambda what, v: F.struct(F.lit(what).alias("what"), v.alias("v"))
    values = F.concat(F.array(one("s", full("source")), one("t", full("target"))), F.transform(F.split("sql_operation", ", "), lambda v: one("o", v)))
    parts = facts.select("file_path", "file_type", "job_name", "pos", F.explode(values).alias("x")).select("file_path", "file_type", "job_name", "x.what", "x.v", "pos")
    first = parts.groupBy("file_path", "file_type", "job_name", "what", "v").agg(F.min("pos").alias("pos"))
    pick = lambda what: F.when(F.col("what") == what, F.col("v")).otherwise("")
    return first.groupBy("file_path", "file_type", "job_name").agg(
        ordered(pick("s"), ";").alias("source_tables"), ordered(pick("t"), ";").alias("target_tables"), ordered(pick("o"), ", ").alias("operations_summary"))


def circular(facts: DataFrame) -> DataFrame:
    """Tables that pipelines both read and write and that no report reads."""
    report = F.col("file_type").isin(*REPORT_TYPES)
    names = lambda side, where: facts.where(where & (F.trim(F.col(side)) != "")).select(F.lower(F.trim(F.col(side))).alias("table_name")).distinct()
    found = names("source_table", ~report).intersect(names("target_table", ~report)).subtract(names("source_table", report))
    return found.select("table_name", F.lit("source and target").alias("appears_as"), F.concat(F.lit("Table '"), "table_name", F.lit("' is read and written by pipelines")).alias("warning"))


def end_to_end_columns(facts: DataFrame) -> DataFrame:
    """Pipelines' target columns joined to the reports' source columns, each different pair once."""
    report = F.col("file_type").isin(*REPORT_TYPES)
    etl = facts.where(~report & (F.trim("target_table") != ""))
    bi = facts.where(report & (F.trim("source_table") != ""))
    key = lambda t, c: [F.lower(F.trim(F.col(t))).alias("__t"), F.lower(F.trim(F.col(c))).alias("__c")]
    # Both sides are reduced to different rows before they meet.
    left = etl.select(*key("target_table", "target_column"), "source_table", "source_column", "target_table", "target_column").distinct()
    right = bi.select(*key("source_table", "source_column"), F.col("target_table").alias("report_table"), F.col("target_column").alias("report_column")).distinct()
    return left.join(right, ["__t", "__c"]).select("source_table", "source_column", "target_table", "target_column", "report_table", "report_column").distinct()


def end_to_end_tables(flow: DataFrame, reports: DataFrame, tables: str = "tables") -> DataFrame:
    """Flow rows with the reports that read their target (by bare name); rows that none reads are marked."""
    read = reports.select(F.explode(F.split(tables, "[;,\n]")).alias("t"), "report_name").select(bare(F.col("t")).alias("__t"), "report_name").where("__t <> ''").distinct()
    keyed = flow.withColumn("__t", bare(F.col("target_table")))
    return keyed.join(read, "__t", "left").withColumn("report_name", F.coalesce("report_name", F.lit(NO_MATCH))).drop("__t")


def impute_sources(rows: DataFrame) -> DataFrame:
    """Blank sources of aggregates become the most frequent source of their job and target (ties: first seen); then distinct."""
    seen = rows.where(F.trim("source_table") != "").groupBy("job_name", "target_table", "source_table").agg(F.count("*").alias("n"), F.min("pos").alias("p"))
    best = seen.groupBy("job_name", "target_table").agg(F.max_by("source_table", F.struct(F.col("n"), -F.col("p"))).alias("__best"))
    blank = (F.trim("source_table") == "") & (F.col("sql_operation") == "AGGREGATE")
    out = rows.join(best, ["job_name", "target_table"], "left").withColumn("source_table", F.when(blank, F.coalesce("__best", F.lit(""))).otherwise(F.col("source_table")))
    return out.select("job_name", "source_table", "source_column", "target_table", "target_column", "sql_operation").distinct()


def with_report_targets(facts: DataFrame) -> DataFrame:
    """Rows without a target belong to the report they come from, or go if their file is no report."""
    report, blank = F.col("file_type").isin(*REPORT_TYPES), F.col("target_table") == ""
    out = facts.where(~blank | report)
    return out.withColumn("target_database", F.when(blank, "report").otherwise(F.col("target_database"))).withColumn("target_table", F.when(blank, F.col("job_name")).otherwise(F.col("target_table")))


def running_distinct(rows: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """For each row the different values of its group up to it, in order.

    A group's different values, each with the place where it first stands, are one short sorted list; a row takes those of
    them that begin by its own place. No window, and nothing as long as a group is ever gathered.
    """
    first = rows.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.min(order).alias("p"))
    known = first.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("p", F.col(value).alias("v")))).alias("known"))
    joined = rows.join(known.withColumnRenamed(group, "of"), F.col(group).eqNullSafe(F.col("of")), "left")
    so_far = F.transform(F.filter("known", lambda x: x["p"] <= F.col(order)), lambda x: x["v"])
    return joined.select(*rows.columns, F.coalesce(so_far, F.array()).alias("so_far"))


def summary(e2e: DataFrame) -> DataFrame:
    """Five figures about joined rows."""
    hit = F.col("report_name") != NO_MATCH
    one = e2e.agg(F.count("*").alias("a"), F.count_if(hit).alias("b"), F.count_if(~hit).alias("c"), F.count_distinct(F.when(hit, F.col("report_name"))).alias("d"), F.count_distinct("target_table").alias("e"))
    return one.selectExpr("stack(5, 'rows', a, 'matched', b, 'unmatched', c, 'reports', d, 'tables', e) AS (metric, value)")


def description(c_type: Column, sources: Column, targets: Column, ops: Column) -> Column:
    """A sentence about a job, from a template."""
    named = lambda c, other: F.when(c == "", other).otherwise(F.replace(c, F.lit(";"), F.lit(", ")))
    return F.concat(c_type, F.lit(" job that reads "), named(sources, "no known table"), F.lit(" and writes "), named(targets, "no known table"), F.when(ops == "", "").otherwise(F.concat(F.lit(" using "), ops)), F.lit("."))
