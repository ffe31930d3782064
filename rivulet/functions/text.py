r"""SQL text as Column expressions: patterns over a statement, all on the JVM side.

These serve questions about very many statements where a scope-aware reading (``sqlscope``) is not needed. Patterns hold
to what both Java's and RE2's engines read alike wherever they can; ``\w`` is ASCII.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .sqlscope import AGGREGATES, WINDOWS

_NAME = r"[`\"]?[A-Za-z_][A-Za-z0-9_]*[`\"]?(?:\.[`\"]?[A-Za-z_][A-Za-z0-9_]*[`\"]?)*"
_END = r"(?:GROUP\s+BY|ORDER\s+BY|HAVING|QUALIFY|LIMIT)\b"
_KEYWORDS = ("select", "where", "on", "using", "group", "order", "having", "limit", "join", "inner", "left", "right", "full", "cross", "lateral", "values", "set", "union", "as")


def _all(c: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def _unquoted(c: Column) -> Column:
    return F.regexp_replace(c, '[`"]', "")


def strip_comments(c: Column) -> Column:
    """Block comments, then line comments, whatever they stand in."""
    return F.regexp_replace(F.regexp_replace(c, r"(?s)/\*.*?\*/", " "), r"--[^\n]*", " ")


def statements(c: Column) -> Column:
    """The trimmed parts between semicolons that are not empty (by the character alone)."""
    return F.filter(F.transform(F.split(c, ";"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")


def depth_split(c: Column) -> Column:
    """Trimmed parts between commas outside of parentheses.

    Parentheses are folded away from the inside out by their depth; a fold over characters would build a string for each.
    """
    chars = F.split(c, "")
    state = F.struct(F.lit(0).alias("d"), F.array(F.lit("")).alias("parts"))

    def step(s: Column, x: Column) -> Column:
        d = s["d"] + F.when(x == "(", 1).when(x == ")", -1).otherwise(0)
        cut = (x == ",") & (s["d"] == 0)
        last = F.concat(F.element_at(s["parts"], -1), x)
        parts = F.when(cut, F.concat(s["parts"], F.array(F.lit("")))).otherwise(F.concat(F.slice(s["parts"], 1, F.size(s["parts"]) - 1), F.array(last)))
        return F.struct(d.alias("d"), parts.alias("parts"))

    return F.transform(F.aggregate(chars, state, step)["parts"], lambda x: F.trim(x))


def table_of(name: Column) -> Column:
    return F.substring_index(F.trim(_unquoted(name)), ".", -1)


def database_of(name: Column) -> Column:
    return F.regexp_extract(F.trim(_unquoted(name)), r"^(.*)\.[^.]*$", 1)


def bare_column(c: Column) -> Column:
    """After the last dot, without sort words, closing marks and other non-word characters; ``*`` stays (it is a column)."""
    c = F.trim(F.substring_index(c, ".", -1))
    c = F.regexp_replace(c, r"(?i)\s+(ASC|DESC)\b.*$|\s+NULLS\s+.*$", "")
    return F.when(F.trim(c) == "*", "*").otherwise(F.regexp_replace(c, r"[^A-Za-z0-9_]", ""))


def is_junk(c: Column) -> Column:
    """Empty, or a number as Python's ``float`` reads one."""
    t = F.trim(c)
    return (t == "") | t.rlike(r"(?i)^[+-]?((\d+(_\d+)*)(\.(\d+(_\d+)*)?)?|\.\d+(_\d+)*)(e[+-]?\d+(_\d+)*)?$") | t.rlike(r"(?i)^[+-]?(nan|inf|infinity)$")


def cte_names(c: Column) -> Column:
    """Names before ``AS (`` that follow WITH or a closing parenthesis and comma, in lower case."""
    first = _all(c, r"(?i)\bWITH\s+(?:RECURSIVE\s+)?([A-Za-z_][A-Za-z0-9_]*)\s*(?:\([^)]*\)\s*)?AS\s*\(")
    more = _all(c, r"(?i)\)\s*,\s*([A-Za-z_][A-Za-z0-9_]*)\s*(?:\([^)]*\)\s*)?AS\s*\(")
    return F.array_distinct(F.transform(F.concat(first, more), F.lower))


def source_tables(c: Column) -> Column:
    """Tables after FROM, then after JOIN, without databases, CTEs and keywords, each once."""
    names = F.concat(_all(c, rf"(?i)\bFROM\s+({_NAME})"), _all(c, rf"(?i)\bJOIN\s+({_NAME})"))
    ctes = cte_names(c)
    return F.filter(F.array_distinct(F.transform(names, table_of)), lambda x: ~F.array_contains(ctes, F.lower(x)) & ~F.lower(x).isin(*_KEYWORDS))


def target_tables(c: Column) -> Column:
    """Targets of INSERT, of CREATE ... AS, then of MERGE, without databases, each once."""
    insert = _all(c, rf"(?i)\bINSERT\s+(?:INTO|OVERWRITE)\s+(?:TABLE\s+)?({_NAME})")
    create = _all(c, rf"(?i)\bCREATE\s+(?:OR\s+REPLACE\s+)?(?:TABLE|VIEW)\s+(?:IF\s+NOT\s+EXISTS\s+)?({_NAME})(?:\s+USING\s+[A-Za-z]+)?\s+AS\b")
    merge = _all(c, rf"(?i)\bMERGE\s+INTO\s+({_NAME})")
    return F.array_distinct(F.transform(F.concat(insert, create, merge), table_of))


def join_keys(c: Column) -> Column:
    """Bare names on both sides of the first equality after each ON, each once."""
    pattern = r"(?i)\bON\s+([A-Za-z_][A-Za-z0-9_.]*)\s*=\s*([A-Za-z_][A-Za-z0-9_.]*)"
    pairs = F.arrays_zip(_all(c, pattern, 1).alias("a"), _all(c, pattern, 2).alias("b"))
    return F.array_distinct(F.transform(F.flatten(F.transform(pairs, lambda p: F.array(p["a"], p["b"]))), lambda x: F.substring_index(x, ".", -1)))


def filter_columns(c: Column) -> Column:
    """Bare names before a comparison in the first WHERE, each once."""
    where = F.regexp_extract(c, rf"(?is)\bWHERE\b(.*?)(?:{_END}|;|$)", 1)
    return F.array_distinct(F.transform(_all(where, r"(?i)([A-Za-z_][A-Za-z0-9_.]*)\s*(?:=|<|>|!|\bNOT\s+IN\b|\bIN\b|\bLIKE\b)"), lambda x: F.substring_index(x, ".", -1)))


def kpi_aliases(c: Column) -> Column:
    """Aliases of SUM, COUNT, AVG, MAX and MIN over arguments without parentheses."""
    return F.array_distinct(_all(c, r"(?i)\b(?:SUM|COUNT|AVG|MAX|MIN)\s*\([^()]*\)\s+AS\s+([A-Za-z_][A-Za-z0-9_]*)"))


def job_type(c: Column) -> Column:
    return F.when(c.rlike(r"(?i)\bGROUP\s+BY\b|\b(SUM|COUNT|AVG|MAX|MIN)\s*\("), "aggregation").otherwise("curated")


def projection_op(c: Column) -> Column:
    """The operation of one projection: ``*``, window, aggregate, alias, or plain."""
    words = "|".join
    return (F.when(F.trim(c).rlike(r"(^|\.)\*$"), "SELECT")
            .when(c.rlike(rf"(?i)\b({words(WINDOWS)})\s*\(") & c.rlike(r"(?i)\bOVER\b"), "WINDOW")
            .when(c.rlike(rf"(?i)\b({words(AGGREGATES)})\s*\("), "AGGREGATE")
            .when(c.rlike(r"(?i)\s+AS\s+[A-Za-z_][A-Za-z0-9_]*\s*$"), "ALIAS").otherwise("SELECT"))


def metadata(c: Column, key: str, mark: str = "--") -> Column:
    """The value of ``-- KEY: value`` or ``-- @KEY: value`` (other marks for other languages); null if there is none."""
    found = F.regexp_extract(c, rf"(?im)^[ \t]*{mark}[ \t]*@?{key}[ \t]*:[ \t]*([^\n\r]*)", 1)
    return F.when(F.trim(found) != "", F.trim(found))


def sql_strings(c: Column) -> Column:
    """The literals of ``spark.sql``, in triple or plain quotes."""
    return F.concat(_all(c, r'(?s)spark\.sql\(\s*[a-z]?"""(.*?)"""'), _all(c, r'spark\.sql\(\s*"([^"\n]+)"'))


def safe_cell(c: Column) -> Column:
    """Without the control characters that spreadsheets refuse."""
    return F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")
