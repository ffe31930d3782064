"""What users ask for: whole jobs from files to result tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as sql_text
from ..operators import readers, relational


@dataclass
class Unified:
    """The six tables of a mixed collection of files; ``close`` frees what is cached. Tables are told from all sources, the column table
    shows the flagged ones."""

    table_flow: DataFrame
    column_flow: DataFrame
    job_summary: DataFrame
    circular: DataFrame
    duplicates: DataFrame
    end_to_end: DataFrame
    facts: DataFrame
    held: list[DataFrame]

    def sheets(self) -> dict[str, DataFrame]:
        return {"Table Flow": self.table_flow, "Column Flow": self.column_flow, "Job Summary": self.job_summary,
                "Circular Dependencies": self.circular, "Duplicates": self.duplicates, "E2E Flow": self.end_to_end}

    def close(self) -> None:
        for x in (self.facts, *self.held):
            x.unpersist()


def unified(files: DataFrame, dependencies: bool = False) -> Unified:
    """Duplicates go first, by hashes; then each file is parsed once, and all six tables come from one cached fact table."""
    readable, held = files.withColumn("__text", F.make_valid_utf8(F.col("content").cast("string"))), []
    kept, removed = relational.keep_first_content(readable, "__text", "file_name", "file_pos", held)
    facts = relational.with_report_targets(readers.column_facts(kept.drop("__text"), dependencies)).persist(StorageLevel.MEMORY_AND_DISK)
    whole = relational.table_level(facts)
    summary = relational.job_summary(whole).withColumn(
        "job_description", relational.description(F.col("file_type"), F.col("source_tables"), F.col("target_tables"), F.col("operations_summary")))
    columns = [c for c in facts.columns if c not in ("primary", "pos")]
    return Unified(relational.table_rollup(whole).orderBy("target_table", "source_table"), facts.where("primary").orderBy("pos").select(*columns), summary,
                   relational.circular(whole), removed, relational.end_to_end_columns(whole), facts, held)


def column_flow(files: DataFrame, dependencies: bool = False) -> tuple[DataFrame, DataFrame]:
    """(column flow with all sources, those of the ten-column view flagged ``primary``; job summary) of pipeline files."""
    facts = relational.with_report_targets(readers.column_facts(files, dependencies)).persist(StorageLevel.MEMORY_AND_DISK)
    return facts, relational.job_summary(relational.table_level(facts))


def table_flow(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(table-level rows, diagnostics)."""
    return readers.table_facts(files), readers.diagnostics(files)


def migration(files: DataFrame) -> DataFrame:
    return readers.construct_facts(files)


def reporting(files: DataFrame) -> DataFrame:
    return readers.report_facts(files)


def end_to_end(flow_rows: DataFrame, reports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(joined rows, five figures): flow rows are trimmed and imputed before reports are joined to their targets."""
    trimmed = flow_rows.select(*(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(c) if c != "pos" else F.col(c) for c in flow_rows.columns))
    joined = relational.end_to_end_tables(relational.impute_sources(trimmed), reports)
    return joined, relational.summary(joined)


def safe(df: DataFrame) -> DataFrame:
    """Arrays joined, control characters stripped: what text sinks can take."""
    out = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if f.dataType.typeName() == "array":
            c = F.array_join(c, ";")
        elif f.dataType.typeName() == "boolean":
            c = F.when(c, "yes").otherwise("no")
        out.append((sql_text.safe_cell(c.cast("string")) if f.dataType.typeName() in ("string", "array") else c).alias(f.name))
    return df.select(*out)
