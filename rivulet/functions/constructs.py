"""Platform-specific constructs of SQL text, their severity and flags, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text

# --- fixed values: construct → severity, in the order in which they are reported. Words are matched whole, in either case,
# with any white space between; those in NEED_PAREN only before an opening parenthesis.
SEVERITY = {
    "LATERAL VIEW": "rewrite", "MERGE INTO": "manual", "RESTORE TABLE": "manual", "USING DELTA": "manual", "CONVERT TO DELTA": "manual",
    "DATE_SUB": "direct", "DATE_ADD": "direct", "DATEDIFF": "direct", "CURRENT_DATE": "direct", "DATE_TRUNC": "direct",
    "COLLECT_LIST": "rewrite", "COLLECT_SET": "rewrite", "ANY_VALUE": "direct", "APPROX_COUNT_DISTINCT": "direct", "TRY_CAST": "direct",
    "ROW_NUMBER": "direct", "DENSE_RANK": "direct", "PERCENT_RANK": "direct", "NTILE": "direct", "LAG": "direct", "LEAD": "direct", "RANK": "direct",
    "QUALIFY": "manual", "EXPLODE": "rewrite", "POSEXPLODE": "rewrite", "STACK": "rewrite", "INLINE": "rewrite",
    "MAP": "rewrite", "ARRAY": "rewrite", "STRUCT": "rewrite", "TRANSFORM": "rewrite", "FILTER": "rewrite", "AGGREGATE": "rewrite",
    "PIVOT": "rewrite", "UNPIVOT": "rewrite", "VACUUM": "manual", "OPTIMIZE": "manual",
}
NEED_PAREN = ("MAP", "ARRAY", "STRUCT", "TRANSFORM", "FILTER", "AGGREGATE")
DELTA = ("MERGE INTO", "VACUUM", "OPTIMIZE", "RESTORE TABLE", "USING DELTA", "CONVERT TO DELTA")
DELTA_PYTHON = ("format(delta)", "DeltaTable", "merge")
UDF_PYTHON = ("udf", "pandas_udf", "udf.register")
RANK = {"direct": 1, "rewrite": 2, "manual": 3}


def pattern(name: str) -> str:
    words = r"\s+".join(name.split())
    return rf"(?i)\b{words}\s*\(" if name in NEED_PAREN else rf"(?i)\b{words}\b"


def found(c: Column) -> Column:
    """The constructs of a text without its comments."""
    clean = text.strip_comments(c)
    return F.filter(F.array(*(F.when(clean.rlike(pattern(n)), F.lit(n)) for n in SEVERITY)), lambda x: x.isNotNull())


def complexity(names: Column, severity: dict[str, str] = SEVERITY) -> Column:
    """The greatest severity; ``direct`` if there is no construct or only unknown ones."""
    rank = F.create_map(*(F.lit(x) for k, v in severity.items() for x in (k, RANK[v])))
    most = F.coalesce(F.array_max(F.transform(names, lambda x: F.coalesce(F.element_at(rank, x), F.lit(1)))), F.lit(1))
    return F.element_at(F.array(*map(F.lit, RANK)), most)


def has_any(names: Column, which: tuple[str, ...]) -> Column:
    return F.arrays_overlap(names, F.array(*map(F.lit, which)))
