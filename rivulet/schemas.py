"""Record types as Spark schemas. Text columns are never null: unknown is the empty string."""

from __future__ import annotations

from pyspark.sql import types as T


def _strings(names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType(), False) for n in names.split()])


COLUMN_MAPPING = _strings("source_database source_table source_column target_database target_table target_column sql_operation")
COLUMN_FLOW = T.StructType([*_strings("file_path file_type job_name").fields, *COLUMN_MAPPING.fields])
#: The fact table inside the engine: with ordinals (the file's, and 32 bits for the fact's place in it), and the flag of the
#: sources that the ten-column view shows.
FACTS = T.StructType([*COLUMN_FLOW.fields, T.StructField("primary", T.BooleanType(), False), T.StructField("pos", T.DecimalType(38, 0), False)])
JOB_SUMMARY = _strings("file_path file_type job_name source_tables target_tables operations_summary job_description")
TABLE_FLOW = T.StructType([*_strings("source_database source_table target_database target_table").fields, T.StructField("column_count", T.LongType(), False), *_strings("operations job_names file_types").fields])
FILES = T.StructType([T.StructField("path", T.StringType(), False), T.StructField("file_name", T.StringType(), False), T.StructField("content", T.BinaryType(), True), T.StructField("file_pos", T.LongType(), False)])
CHUNKS = "path string, file_name string, file_pos long, chunk_pos int, content string, dialect string, label string"
TABLE_FACTS = "file_path string, job_name string, job_type string, domain string, subject_area string, schedule string, owner string, transformation_logic string, source_tables array<string>, target_tables array<string>, key_columns array<string>, kpis array<string>"
ETL_CONSTRUCTS = "file_path string, job_name string, file_type string, domain string, subject_area string, source_tables array<string>, target_tables array<string>, constructs_found array<string>, construct_count int, complexity string, has_udf boolean, has_delta_ops boolean, diagnosis string"
REPORTING = "file_path string, report_name string, tool_name string, domain string, subject_area string, sql_names array<string>, tables array<string>, columns array<string>, operations array<string>"
