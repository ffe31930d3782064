"""Column flow and facts of PySpark code, by following DataFrame variables through the syntax tree.

Frames flow through assignments and method chains in source order, so a write takes the sources of its own chain. Code
that does not parse gives a diagnosis instead of rows.
"""

from __future__ import annotations

import ast
from dataclasses import dataclass, field
from typing import NamedTuple

from .sqlscope import AGGREGATES, Builder, Mapping, Query, Relation, column_mappings, merged, split_qualified, split_statements, tokenize

# --- fixed values: the methods that are told apart
TRANSFORMS = ("join", "filter", "where", "groupBy", "agg", "select", "withColumn", "drop", "distinct", "orderBy", "sort", "limit", "union", "intersect")
WRITES = ("saveAsTable", "insertInto", "writeTo")
METADATA = ("DOMAIN", "SUBJECT_AREA", "SCHEDULE", "OWNER")
#: Construct → severity.
CONSTRUCTS = {
    "pandas_udf": "manual", "udf": "manual", "udf.register": "manual", "broadcast": "direct", "format(parquet)": "direct",
    "format(csv)": "rewrite", "format(json)": "rewrite", "format(orc)": "rewrite", "format(delta)": "manual",
    "Window": "rewrite", "over": "rewrite", "DeltaTable": "manual", "merge": "manual", "repartition": "direct",
    "coalesce": "direct", "partitionBy": "rewrite", "bucketBy": "manual", "sortBy": "rewrite",
}


class Write(NamedTuple):
    target: str
    sources: list[str]
    keys: list[str]
    kpis: list[str]
    logic: list[str]
    sql: list[str]


@dataclass
class Frame:
    """What a DataFrame variable stands for: its table, what was taken from where, and the columns it renamed."""

    database: str = ""
    table: str = ""
    rows: list[tuple[str, str, str, str, str]] = field(default_factory=list)  # source db, table, column, output, operation
    origin: dict[str, tuple[str, str, str]] = field(default_factory=dict)

    def of(self, column: str) -> tuple[str, str, str]:
        return self.origin.get(column, (self.database, self.table, column))

    def copy(self) -> Frame:
        return Frame(self.database, self.table, list(self.rows), dict(self.origin))


def constant(node: ast.AST | None) -> str | None:
    return node.value if isinstance(node, ast.Constant) and isinstance(node.value, str) else None


def dotted(node: ast.AST) -> str:
    parts = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    return ".".join(reversed([*parts, node.id])) if isinstance(node, ast.Name) else ""


def is_spark(node: ast.AST) -> bool:
    """``spark`` itself, also as an attribute (``self.spark``)."""
    return (isinstance(node, ast.Name) and node.id == "spark") or (isinstance(node, ast.Attribute) and node.attr == "spark")


def table_read(node: ast.AST) -> str | None:
    """The table of ``spark.table(x)`` or ``spark.read.table(x)``."""
    if isinstance(node, ast.Call) and isinstance(node.func, ast.Attribute) and node.func.attr == "table" and node.args:
        base = node.func.value
        if is_spark(base) or (isinstance(base, ast.Attribute) and base.attr == "read" and is_spark(base.value)):
            return constant(node.args[0])
    return None


def sql_text(node: ast.AST) -> str | None:
    """The literal of ``spark.sql("...")``; text that is put together at run time is none."""
    if isinstance(node, ast.Call) and isinstance(node.func, ast.Attribute) and node.func.attr == "sql" and node.args and is_spark(node.func.value):
        return constant(node.args[0])
    return None


def column_name(node: ast.AST) -> str | None:
    """The column of ``"c"``, ``col("c")``, ``F.col("c")``, ``df.c`` or ``df["c"]``."""
    if (s := constant(node)) is not None:
        return s
    if isinstance(node, ast.Call) and dotted(node.func).rpartition(".")[2] in ("col", "column") and node.args:
        return constant(node.args[0])
    if isinstance(node, ast.Attribute) and isinstance(node.value, ast.Name) and node.value.id not in ("F", "functions"):
        return node.attr
    if isinstance(node, ast.Subscript):
        return constant(node.slice)
    return None


def unaliased(node: ast.AST) -> tuple[ast.AST, str | None]:
    if isinstance(node, ast.Call) and isinstance(node.func, ast.Attribute) and node.func.attr in ("alias", "name") and node.args:
        return node.func.value, constant(node.args[0])
    return node, None


class Flow(ast.NodeVisitor):
    """Walks a module in source order."""

    def __init__(self, dependencies: bool):
        self.dependencies = dependencies
        self.frames: dict[str, Frame] = {}
        self.mappings: list[Mapping] = []
        self.used: set[int] = set()

    def visit_Assign(self, node: ast.Assign) -> None:
        frame = self.frame(node.value)
        for t in node.targets:
            if isinstance(t, ast.Name) and frame is not None:
                self.frames[t.id] = frame
        if frame is None:
            self.generic_visit(node)

    def visit_Expr(self, node: ast.Expr) -> None:
        frame = self.frame(node.value)
        if frame is None:
            self.generic_visit(node)
        elif frame.rows and not self._written(node.value):
            self.emit(frame, "", "")

    def visit_Return(self, node: ast.Return) -> None:
        if node.value is not None and self.frame(node.value) is None:
            self.generic_visit(node)

    def visit_Call(self, node: ast.Call) -> None:
        if self.frame(node) is None:
            self.generic_visit(node)

    @staticmethod
    def _written(node: ast.AST) -> bool:
        while isinstance(node, (ast.Call, ast.Attribute)):
            if isinstance(node, ast.Call) and isinstance(node.func, ast.Attribute) and node.func.attr in WRITES:
                return True
            node = node.func if isinstance(node, ast.Call) else node.value
        return False

    def emit(self, frame: Frame, database: str, table: str) -> None:
        self.mappings += [Mapping(d, t, c, database, table, out, op) for d, t, c, out, op in frame.rows]

    def frame(self, node: ast.AST) -> Frame | None:
        if isinstance(node, ast.Name):
            return self.frames[node.id].copy() if node.id in self.frames else None
        if isinstance(node, ast.Attribute):
            return self.frame(node.value) if node.attr in ("write", "writeStream") else None
        if not isinstance(node, ast.Call) or not isinstance(node.func, ast.Attribute):
            return None
        if (name := table_read(node)) is not None:
            return Frame(*split_qualified(name))
        if (text := sql_text(node)) is not None:
            if id(node) not in self.used:
                self.used.add(id(node))
                self.mappings += [m for m in column_mappings(text, self.dependencies) if m.target_table]
            f = Frame()
            for m in column_mappings(text):
                if not m.target_table and m.primary:
                    f.rows.append((m.source_database, m.source_table, m.source_column, m.target_column, m.sql_operation))
                    f.origin[m.target_column] = m[:3]
                    f.database, f.table = f.database or m.source_database, f.table or m.source_table
            return f
        f = self.frame(node.func.value)
        if f is None:
            return None
        method = node.func.attr
        if method in WRITES:
            target = constant(node.args[0]) if node.args else None
            if target:
                self.emit(f, *split_qualified(target))
                f.rows = []
            return f
        args = [x for a in node.args for x in (a.elts if isinstance(a, (ast.List, ast.Tuple)) else [a])]
        if method == "select":
            origin = {}
            kept = {r[3]: r for r in f.rows}
            rows = [r for r in f.rows if r[4] in ("JOIN", "FILTER")]
            for a in args:
                inner, alias = unaliased(a)
                c = column_name(inner)
                if c is None:
                    if alias and (found := self.first_column(inner)):
                        op = "AGGREGATE" if self.aggregate(inner) else "UNKNOWN"
                        source = f.of(found) if op == "AGGREGATE" else (*f.of(found)[:2], "expr")
                        rows.append((*source, alias, op))
                        origin[alias] = f.of(found)
                    continue
                bare = c.rpartition(".")[2]
                source = f.of(bare)
                old = kept.get(bare)
                op = old[4] if old and old[4] not in ("JOIN", "FILTER") else "ALIAS" if alias and alias != bare else "SELECT"
                rows.append((*(old[:3] if old and old[4] not in ("JOIN", "FILTER") else source), alias or bare, op))
                origin[alias or bare] = source
            f.rows, f.origin = rows, f.origin | origin
        elif method == "withColumn" and len(node.args) > 1:
            name, c = constant(node.args[0]), column_name(node.args[1])
            if name:
                if c is not None and constant(node.args[1]) is None:
                    source, op = f.of(c), "ALIAS"
                else:
                    found = self.first_column(node.args[1])
                    source, op = (*(f.of(found)[:2] if found else (f.database, f.table)), "expr"), "UNKNOWN"
                f.rows.append((*source, name, op))
                f.origin[name] = source
        elif method == "withColumnRenamed" and len(node.args) > 1 and constant(node.args[0]) and constant(node.args[1]):
            old, new = constant(node.args[0]), constant(node.args[1])
            f.rows.append((*f.of(old), new, "ALIAS"))
            f.origin[new] = f.of(old)
        elif method == "agg":
            for a in args:
                inner, alias = unaliased(a)
                if self.aggregate(inner):
                    c = self.first_column(inner) or "*"
                    f.rows.append((*f.of(c), alias or c, "AGGREGATE"))
                    f.origin[alias or c] = f.of(c)
        elif method == "join" and node.args:
            other = self.frame(node.args[0]) or Frame()
            known = {**{k: v for k, v in other.origin.items()}, **f.origin}
            on = node.args[1] if len(node.args) > 1 else next((k.value for k in node.keywords if k.arg == "on"), None)
            if self.dependencies and on is not None:
                for side, c in self.join_columns(on):
                    owner = self.frames.get(side) if side else f
                    f.rows.append((*(owner or f).of(c), c, "JOIN"))
            f.origin = known
            f.rows += [r for r in other.rows if r not in f.rows]
        elif method in ("filter", "where") and node.args and self.dependencies:
            text = constant(node.args[0])
            for c in self.compared(text) if text else []:
                f.rows.append((*f.of(c), c, "FILTER"))
        return f

    @staticmethod
    def compared(text: str) -> list[str]:
        """Columns before a comparison in a filter's text."""
        return [c for c, _ in Builder().compared(tokenize(text), {}, Query(relations=[Relation("t", "", "t")]))]

    @staticmethod
    def aggregate(node: ast.AST) -> bool:
        return any(isinstance(n, ast.Call) and dotted(n.func).rpartition(".")[2].upper().replace("COUNTDISTINCT", "COUNT").replace("COUNT_DISTINCT", "COUNT").replace("SUM_DISTINCT", "SUM") in AGGREGATES for n in ast.walk(node))

    @staticmethod
    def first_column(node: ast.AST) -> str | None:
        """The first column below a call, by place in the source."""
        found = []
        for n in ast.walk(node):
            if isinstance(n, ast.Call):
                name = dotted(n.func).rpartition(".")[2]
                if name in ("col", "column") and n.args and constant(n.args[0]):
                    found.append((n.lineno, n.col_offset, constant(n.args[0])))
                elif name.upper() in AGGREGATES or name.lower() in ("countdistinct", "count_distinct"):
                    for a in n.args:
                        if constant(a):
                            found.append((a.lineno, a.col_offset, constant(a)))
            elif isinstance(n, ast.Attribute) and isinstance(n.value, ast.Name) and n.value.id not in ("F", "functions", "Window", "spark") and n.attr not in ("cast", "alias", "over", "desc", "asc"):
                found.append((n.lineno, n.col_offset, n.attr))
            elif isinstance(n, ast.Subscript) and constant(n.slice):
                found.append((n.lineno, n.col_offset, constant(n.slice)))
        return min(found)[2].rpartition(".")[2] if found else None

    def join_columns(self, on: ast.AST) -> list[tuple[str | None, str]]:
        """(variable or None, column) of each side of the join keys."""
        if constant(on):
            return [(None, constant(on))]
        if isinstance(on, (ast.List, ast.Tuple)):
            return [x for e in on.elts for x in self.join_columns(e)]
        out = []
        for n in ast.walk(on):
            if isinstance(n, ast.Compare) and isinstance(n.ops[0], ast.Eq):
                for side in (n.left, n.comparators[0]):
                    if isinstance(side, ast.Attribute) and isinstance(side.value, ast.Name):
                        out.append((side.value.id, side.attr))
                    elif c := column_name(side):
                        out.append((side.value.id if isinstance(side, ast.Subscript) and isinstance(side.value, ast.Name) else None, c.rpartition(".")[2]))
        return out


def pyspark_mappings(code: str, dependencies: bool = False) -> tuple[list[Mapping], str]:
    """Merged mappings and a diagnosis (empty if the code parses)."""
    try:
        tree = ast.parse(code)
    except (SyntaxError, ValueError) as e:
        return [], f"python: {e.__class__.__name__}: {e}"
    f = Flow(dependencies)
    f.visit(tree)
    return merged(f.mappings), ""


def sql_strings(code: str) -> list[str]:
    """Every literal that is put to ``spark.sql``, in source order."""
    try:
        tree = ast.parse(code)
    except (SyntaxError, ValueError):
        return []
    found = [(n.lineno, n.col_offset, s) for n in ast.walk(tree) if (s := sql_text(n)) is not None]
    return [s for *_, s in sorted(found)]


# --- facts by write (table level)


def _gather(node: ast.AST) -> Write:
    """Sources, keys, measures, methods and SQL of one statement, in source order; ``target`` is the first write's."""
    calls = sorted((n for n in ast.walk(node) if isinstance(n, ast.Call)), key=lambda n: (n.end_lineno, n.end_col_offset))
    sources, keys, kpis, logic, sql, target = [], [], [], [], [], ""
    for n in calls:
        if name := table_read(n):
            sources.append(split_qualified(name)[1])
        elif (s := sql_text(n)) is not None:
            sql.append(" ".join(s.split()))
        elif isinstance(n.func, ast.Attribute):
            m = n.func.attr
            if m in TRANSFORMS:
                logic.append(m)
            if m in WRITES and n.args and (t := constant(n.args[0])):
                target = target or split_qualified(t)[1]
            if m == "join" and len(n.args) > 1:
                for e in [n.args[1]] if not isinstance(n.args[1], (ast.List, ast.Tuple)) else n.args[1].elts:
                    if constant(e):
                        keys.append(constant(e))
                    for c in ast.walk(e):
                        if isinstance(c, ast.Compare):
                            keys += [x.attr for x in (c.left, *c.comparators) if isinstance(x, ast.Attribute)]
            if m == "groupBy":
                keys += [c for a in n.args if (c := column_name(a))]
            if m == "agg":
                kpis += [alias for a in n.args if (alias := unaliased(a)[1])]
    return Write(target, *(list(dict.fromkeys(x)) for x in (sources, keys, kpis)), logic, sql)


def writes(code: str) -> tuple[list[Write], str]:
    """A row for each write of the module, with everything that statements up to it have gathered; or a diagnosis."""
    try:
        tree = ast.parse(code)
    except (SyntaxError, ValueError) as e:
        return [], f"python: {e.__class__.__name__}: {e}"
    total, out = Write("", [], [], [], [], []), []
    for statement in tree.body:
        w = _gather(statement)
        total = Write("", *(list(dict.fromkeys([*a, *b])) for a, b in zip(total[1:4], w[1:4], strict=True)), total.logic + w.logic, total.sql + w.sql)
        if w.target:
            out.append(total._replace(target=w.target))
    if not out and any(total[1:]):
        out.append(total)
    return out, ""


def metadata(code: str) -> dict[str, str]:
    """Module-level string constants of the four metadata names; the first assignment counts."""
    try:
        tree = ast.parse(code)
    except (SyntaxError, ValueError):
        return {}
    found: dict[str, str] = {}
    for node in tree.body:
        targets = node.targets if isinstance(node, ast.Assign) else [node.target] if isinstance(node, ast.AnnAssign) else []
        for t in targets:
            if isinstance(t, ast.Name) and t.id in METADATA and (s := constant(node.value)) is not None:
                found.setdefault(t.id, s)
    return found


# --- constructs


def constructs(code: str) -> tuple[list[str], list[str], list[str], str]:
    """Constructs, source and target tables, each once in source order; and a diagnosis."""
    try:
        tree = ast.parse(code)
    except (SyntaxError, ValueError) as e:
        return [], [], [], f"python: {e.__class__.__name__}: {e}"
    found: list[tuple] = []
    sources, targets = [], []
    for n in ast.walk(tree):
        at = (getattr(n, "lineno", 0), getattr(n, "col_offset", 0), getattr(n, "end_lineno", 0), getattr(n, "end_col_offset", 0))  # calls of a chain begin together
        add = lambda c, at=at: found.append((*at, c))
        if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
            for d in n.decorator_list:
                name = dotted(d.func if isinstance(d, ast.Call) else d).rpartition(".")[2]
                if name in ("udf", "pandas_udf"):
                    add(name)
        elif isinstance(n, ast.Name) and n.id in ("Window", "DeltaTable"):
            add(n.id)
        elif isinstance(n, ast.Call):
            full = dotted(n.func)
            last = n.func.attr if isinstance(n.func, ast.Attribute) else full
            if name := table_read(n):
                sources.append((*at, split_qualified(name)[1]))
            if full.endswith("udf.register"):
                add("udf.register")
            elif last in ("pandas_udf", "udf"):
                add(last)
            if last == "broadcast":
                add("broadcast")
            if isinstance(n.func, ast.Attribute):
                on_functions = full.partition(".")[0] in ("F", "functions")
                if last == "format" and n.args and constant(n.func.value) is None and (kind := constant(n.args[0])) and f"format({kind.lower()})" in CONSTRUCTS:
                    add(f"format({kind.lower()})")
                elif last in ("over", "merge", "repartition", "partitionBy", "bucketBy", "sortBy") or (last == "coalesce" and not on_functions):
                    add(last)
                if last in WRITES and n.args and (t := constant(n.args[0])):
                    targets.append((*at, split_qualified(t)[1]))
    once = lambda xs: list(dict.fromkeys(x for *_, x in sorted(xs)))
    return once(found), once(sources), once(targets), ""


def sql_statements(code: str) -> list[str]:
    return [s for text in sql_strings(code) for s in split_statements(text)]
