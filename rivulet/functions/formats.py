"""What a file is: family and dialect from its suffix, else from its first 512 bytes; and the label of its type."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: family → (dialect, suffixes)
FAMILIES: dict[str, tuple[str, str]] = {
    "sql": ("sql", ".sql .ddl .dml .hql .bql .tsql .pgsql .mysql .presto .trino .ql .proc .sp .fnc .trg .vw .pkg .pkb .pks"),
    "python": ("python", ".py .pyw .pyx"),
    "notebook": ("python", ".ipynb"),
    "rnotebook": ("r", ".rmd"),
    "qmd": ("python", ".qmd"),
    "scala": ("scala", ".scala .sc"),
    "java": ("java", ".java"),
    "r": ("r", ".r"),
    "shell": ("shell", ".sh .bash .zsh .ksh .csh"),
    "powerbi_binary": ("json", ".pbit"),
    "ssrs": ("xml", ".rdl"),
    "looker": ("lookml", ".lkml .lookml"),
    "qlik": ("qlik", ".qvs .qvd .qvw .qvf"),
    "tableau": ("xml", ".twb .tds"),
    "tableau_zip": ("binary", ".twbx .tdsx"),
    "yaml": ("yaml", ".yaml .yml"),
    "json": ("json", ".json"),
    "toml": ("toml", ".toml"),
    "ini": ("ini", ".ini .cfg"),
    "properties": ("ini", ".properties .env"),
    "terraform": ("hcl", ".tf .tfvars"),
    "xml": ("xml", ".xml"),
    "text": ("unknown", ".txt"),
    "data": ("data", ".csv .tsv"),
}
EXTENSIONS = {x: (family, dialect) for family, (dialect, suffixes) in FAMILIES.items() for x in suffixes.split()} | {".pbix": ("powerbi_binary", "binary")}
LABELS = {
    "sql": "SQL", "python": "PySpark", "notebook": "PySpark", "rnotebook": "R", "qmd": "Quarto", "scala": "Spark Scala", "java": "Spark Java",
    "r": "R", "shell": "Shell", "powerbi": "PowerBI", "powerbi_binary": "PowerBI", "ssrs": "SSRS", "xml": "XML", "looker": "Looker", "qlik": "Qlik",
    "tableau": "Tableau", "tableau_zip": "Tableau", "yaml": "YAML/dbt", "json": "JSON", "terraform": "Terraform", "text": "Text", "data": "Data",
    "ini": "Config", "toml": "Config", "hcl": "Terraform", "binary": "Binary", "unknown": "Unknown",
}
TOOLS = {".pbit": "PowerBI", ".lkml": "Looker", ".qvs": "Qlik"}
VERBS = "SELECT INSERT CREATE MERGE UPDATE DELETE WITH".split()
_SQL_LINE = r"(?im)^(SELECT|INSERT|UPDATE|DELETE|CREATE|WITH|MERGE)\b"
_PY_LINE = r"(import pyspark|from pyspark|spark\.table\()"
_YAML_LINE = r"^(---|\w+\s*:)"


def suffix(name: Column) -> Column:
    """The last dot and what follows in a file's name, in lower case; empty if there is none."""
    return F.lower(F.regexp_extract(F.substring_index(name, "/", -1), r"[^/](\.[^./]*)$", 1))


def stem(name: Column) -> Column:
    return F.regexp_extract(F.substring_index(name, "/", -1), r"^(.+?)(\.[^.]*)?$", 1)


def _lookup(pairs: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in pairs.items() for x in kv)), key)


def sniff(text: Column) -> Column:
    """``family:dialect`` of a text by its first 512 characters."""
    head = F.regexp_replace(F.substring(text, 1, 512), r"^\s+|\s+$", "")
    first = F.substring(head, 1, 1)
    return (F.when(first.isin("{", "["), "json:json").when(first == "<", "xml:xml").when(head.rlike(_SQL_LINE), "sql:sql")
            .when(head.rlike(_PY_LINE), "python:python").when(head.rlike(_YAML_LINE), "yaml:yaml").otherwise("text:unknown"))


def family(name: Column, text: Column) -> Column:
    return F.coalesce(_lookup({k: f for k, (f, _) in EXTENSIONS.items()}, suffix(name)), F.substring_index(sniff(text), ":", 1))


def dialect(name: Column, text: Column) -> Column:
    return F.coalesce(_lookup({k: d for k, (_, d) in EXTENSIONS.items()}, suffix(name)), F.substring_index(sniff(text), ":", -1))


def type_label(fam: Column) -> Column:
    return F.coalesce(_lookup(LABELS, fam), F.upper(fam))


def tool(name: Column) -> Column:
    return F.coalesce(_lookup(TOOLS, suffix(name)), F.lit(""))


def detect(name: str, text: str) -> tuple[str, str]:
    """The same for one file, inside Arrow functions."""
    m = re.search(r"[^/](\.[^./]*)$", name.rpartition("/")[2])
    if m and (found := EXTENSIONS.get(m[1].lower())):
        return found
    head = text[:512].strip()
    first = head[:1]
    if first in ("{", "["):
        return "json", "json"
    if first == "<":
        return "xml", "xml"
    for pattern, found in ((_SQL_LINE, ("sql", "sql")), (_PY_LINE, ("python", "python")), (_YAML_LINE, ("yaml", "yaml"))):
        if re.search(pattern, head):
            return found
    return "text", "unknown"
