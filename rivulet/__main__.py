"""``python -m rivulet JOB ROOT OUT``: run a job over a folder and write its tables.

Jobs: unified, columns, tables, migration, reports, e2e. Ends with 1 if any file could not be read.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession

from .operators import readers, relational
from .plans import pipelines, sinks
from .sources import files


def tables(job: str, found: DataFrame, dependencies: bool) -> dict[str, DataFrame]:
    if job == "unified":
        return pipelines.unified(found, dependencies).sheets()
    if job == "columns":
        facts, summary = pipelines.column_flow(found, dependencies)
        return {"Column Flow": facts.where("primary").drop("primary", "pos"), "Job Summary": summary}
    if job == "tables":
        rows, problems = pipelines.table_flow(found)
        return {"Flow": rows, "Diagnostics": problems}
    if job == "migration":
        return {"Constructs": pipelines.migration(found)}
    if job == "reports":
        return {"Reports": pipelines.reporting(found)}
    facts, _ = pipelines.column_flow(found, dependencies)
    reports = pipelines.reporting(found).selectExpr("report_name", "array_join(tables, ';') AS tables")
    joined, five = pipelines.end_to_end(relational.table_level(facts).select("job_name", "source_table", "source_column", "target_table", "target_column", "sql_operation", "pos"), reports)
    return {"End-to-End Flow": joined, "Summary": five}


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="rivulet", description=__doc__)
    p.add_argument("job", choices=["unified", "columns", "tables", "migration", "reports", "e2e"])
    p.add_argument("root", nargs="?")
    p.add_argument("out", nargs="?")
    p.add_argument("--config", help="YAML settings in place of root, patterns and out")
    p.add_argument("--patterns", default="")
    p.add_argument("--exclude", default="")
    p.add_argument("--dependencies", action="store_true")
    p.add_argument("--format", choices=["parquet", "csv", "xlsx"], default="parquet")
    a = p.parse_args(args)
    c = files.Config.load(a.config) if a.config else files.Config()
    root, out = a.root or c.pipeline_dir, a.out or sinks.versioned(c.output_path)
    default = c.reporting_patterns if a.job == "reports" else [*c.file_patterns, *c.reporting_patterns]
    spark = SparkSession.builder.appName("rivulet").getOrCreate()
    found = files.scan(spark, root, a.patterns.split(",") if a.patterns else default, [*c.exclusions, *filter(None, a.exclude.split(","))])
    made = tables(a.job, found, a.dependencies)
    if a.format == "xlsx":
        sinks.write_workbook(made, out)
    elif a.format == "csv":
        for name, df in made.items():
            sinks.write_csv(df, f"{out}/{name.lower().replace(' ', '_')}")
    else:
        sinks.write_parquet(made, out)
    failed = readers.diagnostics(found).where("level = 'error'").count()
    print(f"{', '.join(made)} written to {out}; {failed} files failed")
    return int(failed > 0)


if __name__ == "__main__":
    sys.exit(main())
