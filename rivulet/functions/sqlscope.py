"""Column flow of SQL text: a tokenizer and a scope builder, in plain Python for use inside Arrow functions.

A statement is tokenized, cut into clauses at parenthesis depth zero and read into nested query scopes. A name is resolved
in its own scope only (then in the enclosing ones, for correlated subqueries), through CTEs and derived tables down to
real tables. Every projection knows all of its sources; the one that the ten-column view shows is flagged ``primary``.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from typing import NamedTuple

# --- fixed values: the vocabularies that flow operations are told apart by
AGGREGATES = ("SUM", "COUNT", "AVG", "MAX", "MIN", "STDDEV", "VARIANCE", "COLLECT_LIST", "COLLECT_SET", "APPROX_COUNT_DISTINCT", "ANY_VALUE")
WINDOWS = ("ROW_NUMBER", "RANK", "DENSE_RANK", "NTILE", "PERCENT_RANK", "LAG", "LEAD", "FIRST_VALUE", "LAST_VALUE", "NTH_VALUE")
OP_ORDER = ("SELECT", "AGGREGATE", "WINDOW", "ALIAS", "JOIN", "FILTER", "UNKNOWN")
NO_COLUMN = "—"
SKIPPED = re.compile(r"\s*(?:VACUUM|OPTIMIZE|RESTORE\s+TABLE|CONVERT\s+TO\s+DELTA)\b", re.I)


class Mapping(NamedTuple):
    source_database: str
    source_table: str
    source_column: str
    target_database: str
    target_table: str
    target_column: str
    sql_operation: str
    primary: bool = True


class Token(NamedTuple):
    kind: str  # name, quoted, string, number, op
    text: str
    up: str


class Source(NamedTuple):
    database: str
    table: str
    column: str
    op: str = "SELECT"
    #: Comes from a further branch of a set operation, where it is the one that is shown.
    branch: bool = False


_lexer = re.compile(
    r"""(?P<skip>\s+|--[^\n]*|/\*.*?(?:\*/|\Z))|(?P<string>'(?:[^'\\]|\\.|'')*(?:'|\Z))|(?P<quoted>`[^`]*`|"[^"]*")"""
    r"""|(?P<number>\d+(?:\.\d*)?(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?)|(?P<name>[^\W\d]\w*|[@$#]\w+)|(?P<op><=>|<>|<=|>=|!=|==|\|\||::|->|.)""",
    re.S | re.X,
)


def tokenize(sql: str) -> list[Token]:
    out = []
    for m in _lexer.finditer(sql):
        if m.lastgroup != "skip":
            text = m[0]
            out.append(Token(m.lastgroup, text, text.upper() if m.lastgroup == "name" else text))
    return out


def strip_comments(sql: str) -> str:
    """Comments outside of strings become a space."""
    return "".join(" " if m.lastgroup == "skip" and not m[0].isspace() else m[0] for m in _lexer.finditer(sql))


def split_statements(sql: str) -> list[str]:
    """Statements between semicolons outside of strings, comments and parentheses."""
    out, start, depth = [], 0, 0
    for m in _lexer.finditer(sql):
        if m.lastgroup == "op":
            depth += (m[0] == "(") - (m[0] == ")")
            if m[0] == ";" and depth <= 0:
                out.append(sql[start : m.start()])
                start, depth = m.end(), 0
    out.append(sql[start:])
    return [s.strip() for s in out if tokenize(s)]


def split_qualified(name: str) -> tuple[str, str]:
    """(database, table): all before the last dot, and the rest, without quotes."""
    clean = name.replace("`", "").replace('"', "").strip()
    database, _, table = clean.rpartition(".")
    return database, table


# --- token lists


def _depths(tokens: list[Token]) -> Iterator[tuple[int, Token, int]]:
    depth = 0
    for k, t in enumerate(tokens):
        if t.text in ")]":
            depth -= 1
        yield k, t, depth
        if t.text in "([":
            depth += 1


def _split(tokens: list[Token], sep: str) -> list[list[Token]]:
    parts, last = [], 0
    for k, t, d in _depths(tokens):
        if d == 0 and t.text == sep:
            parts.append(tokens[last:k])
            last = k + 1
    parts.append(tokens[last:])
    return parts


def _close(tokens: list[Token], at: int) -> int:
    """The place of the parenthesis that closes the one at ``at``, or the end."""
    depth = 0
    for k in range(at, len(tokens)):
        depth += (tokens[k].text == "(") - (tokens[k].text == ")")
        if depth == 0:
            return k
    return len(tokens)


def _name(tokens: list[Token], at: int) -> tuple[list[str], int]:
    """A dotted name from ``at`` on, and where it ends; no parts if there is none."""
    parts, k = [], at
    while k < len(tokens) and tokens[k].kind in ("name", "quoted"):
        parts.append(tokens[k].text.strip('`"'))
        if k + 2 < len(tokens) and tokens[k + 1].text == "." and tokens[k + 2].kind in ("name", "quoted"):
            k += 2
            continue
        k += 1
        break
    return parts, k


_CLAUSES = ("SELECT", "FROM", "WHERE", "GROUP", "HAVING", "QUALIFY", "WINDOW", "ORDER", "SORT", "CLUSTER", "DISTRIBUTE", "LIMIT", "OFFSET")
_SETS = ("UNION", "INTERSECT", "EXCEPT", "MINUS")
_JOINS = ("JOIN", "INNER", "LEFT", "RIGHT", "FULL", "CROSS", "NATURAL", "OUTER", "SEMI", "ANTI", "LATERAL", "ON", "USING")
_WORDS = frozenset(
    "SELECT DISTINCT ALL FROM WHERE GROUP BY HAVING ORDER LIMIT AS AND OR NOT NULL IS IN LIKE ILIKE RLIKE BETWEEN CASE WHEN THEN ELSE END OVER PARTITION ROWS RANGE UNBOUNDED PRECEDING FOLLOWING CURRENT ROW ASC DESC NULLS FIRST LAST TRUE FALSE INTERVAL DATE TIMESTAMP EXISTS ANY SOME CAST TRY_CAST ON USING JOIN INNER LEFT RIGHT FULL OUTER CROSS UNION FILTER WITHIN DAY DAYS MONTH MONTHS YEAR YEARS HOUR HOURS MINUTE SECOND WEEK ESCAPE COLLATE".split()
)
_TYPES = frozenset("STRING INT INTEGER BIGINT SMALLINT TINYINT DOUBLE FLOAT DECIMAL NUMERIC BOOLEAN VARCHAR CHAR BINARY REAL TEXT LONG".split())
_NOT_ALIAS = frozenset([*_CLAUSES, *_SETS, *_JOINS, "SET", "WHEN", "PIVOT", "UNPIVOT", "TABLESAMPLE", "VIEW"])


# --- scopes


@dataclass
class Output:
    name: str
    sources: list[Source]
    op: str
    primary: int = 0
    #: Arithmetic over two or more qualified columns: shown as ``expr``.
    untraced: bool = False


@dataclass
class Relation:
    alias: str
    database: str = ""
    table: str = ""
    query: Query | None = None

    def find(self, column: str) -> tuple[list[Source], int] | None:
        """The sources of a column, and which of them is the primary one; none if it has no such column."""
        if self.query is None:
            return [Source(self.database, self.table, column)], 0
        for o in self.query.outputs:
            if o.name.lower() == column.lower():
                return [s if s.branch else s._replace(op=o.op) for s in o.sources], o.primary
        for o in self.query.outputs:
            if o.name == "*" and o.sources:
                return [Source(s.database, s.table, column) for s in o.sources], 0
        return None


@dataclass
class Query:
    relations: list[Relation] = field(default_factory=list)
    outputs: list[Output] = field(default_factory=list)
    parent: Query | None = None
    joins: list[list[Source]] = field(default_factory=list)
    join_names: list[str] = field(default_factory=list)
    filters: list[tuple[str, list[Source]]] = field(default_factory=list)
    #: Scopes whose predicates count as dependencies.
    inner: list[Query] = field(default_factory=list)

    def resolve(self, parts: list[str]) -> tuple[list[Source], int]:
        column = parts[-1]
        if len(parts) > 1:
            prefix = [p.lower() for p in parts[:-1]]
            for r in self.relations:
                if prefix == [r.alias.lower()] or (r.query is None and (prefix[-1] == r.table.lower()) and (len(prefix) == 1 or ".".join(prefix[:-1]) == r.database.lower())):
                    return r.find(column) or ([Source("", "", column)], 0)
            if self.parent:
                return self.parent.resolve(parts)
            return [Source("", "", column)], 0
        known = [(r, f) for r in self.relations if r.query is not None and (f := r.find(column))]
        named = [f for r, f in known if any(o.name.lower() == column.lower() for o in r.query.outputs)]
        plain = [r for r in self.relations if r.query is None]
        if len(named) == 1 and not plain:
            return named[0]
        if len(self.relations) == 1:
            return self.relations[0].find(column) or ([Source("", "", column)], 0)
        if not self.relations and self.parent:
            return self.parent.resolve(parts)
        if len(plain) == 1 and not named and all(r.query.outputs for r in self.relations if r.query is not None):
            return plain[0].find(column)
        return [Source("", "", column)], 0


class Builder:
    """Reads the parts of a statement into scopes."""

    def ctes(self, tokens: list[Token], env: dict[str, Query], parent: Query | None) -> tuple[list[Token], dict[str, Query], list[Query]]:
        """The tokens after a WITH clause, the names that it adds, and their scopes."""
        if not tokens or tokens[0].up != "WITH":
            return tokens, env, []
        env, made, k = dict(env), [], 1
        if k < len(tokens) and tokens[k].up == "RECURSIVE":
            k += 1
        while k < len(tokens):
            parts, k = _name(tokens, k)
            columns: list[str] = []
            if k < len(tokens) and tokens[k].text == "(":
                end = _close(tokens, k)
                columns = [p[0].text.strip('`"') for p in _split(tokens[k + 1 : end], ",") if p]
                k = end + 1
            if k < len(tokens) and tokens[k].up == "AS":
                k += 1
            while k < len(tokens) and tokens[k].up in ("NOT", "MATERIALIZED"):
                k += 1
            if not parts or k >= len(tokens) or tokens[k].text != "(":
                break
            end = _close(tokens, k)
            own = Query()  # a name that a recursive member reads before it is known
            q = self.query(tokens[k + 1 : end], env | {parts[-1].lower(): own}, parent)
            for o, name in zip(q.outputs, columns, strict=False):
                o.name = name
            own.outputs = q.outputs
            env[parts[-1].lower()] = q
            made.append(q)
            k = end + 1
            if k < len(tokens) and tokens[k].text == ",":
                k += 1
                continue
            break
        return tokens[k:], env, made

    def query(self, tokens: list[Token], env: dict[str, Query], parent: Query | None = None) -> Query:
        tokens, env, made = self.ctes(tokens, env, parent)
        while tokens and tokens[0].text == "(" and _close(tokens, 0) == len(tokens) - 1:
            tokens = tokens[1:-1]
            tokens, env, more = self.ctes(tokens, env, parent)
            made += more
        branches, last = [], 0
        for k, t, d in _depths(tokens):
            if d == 0 and t.up in _SETS and t.kind == "name" and k > last:
                branches.append(tokens[last:k])
                last = k + 1
        branches.append(tokens[last:])
        first: Query | None = None
        for b in branches:
            while b and b[0].up in ("ALL", "DISTINCT"):
                b = b[1:]
            if b and b[0].text == "(":
                q = self.query(b[1 : _close(b, 0)], env, parent)
            else:
                q = self.select(b, env, parent)
            if first is None:
                first = q
            else:  # further branches of a set operation add sources to the same places
                for o, p in zip(first.outputs, q.outputs, strict=False):
                    known = {x[:3] for x in o.sources}
                    o.sources += [x._replace(op=p.op, branch=x.branch or k == p.primary) for k, x in enumerate(p.sources) if x[:3] not in known]
                first.inner.append(q)
        first.inner = [*made, *first.inner]
        return first

    def select(self, tokens: list[Token], env: dict[str, Query], parent: Query | None) -> Query:
        clauses: dict[str, list[Token]] = {}
        at, word = 0, ""
        for k, t, d in _depths(tokens):
            if d == 0 and t.kind == "name" and t.up in _CLAUSES and not (t.up in ("WINDOW", "LIMIT", "OFFSET", "SORT") and (k == 0 or tokens[k - 1].text in (",", ".") or word == "SELECT")):
                if word:
                    clauses.setdefault(word, tokens[at:k])
                at, word = k + 1, t.up
        if word:
            clauses.setdefault(word, tokens[at:])
        q = Query(parent=parent)
        self.relations(clauses.get("FROM", []), env, q)
        items = clauses.get("SELECT", [])
        while items and items[0].up in ("DISTINCT", "ALL"):
            items = items[1:]
        for item in _split(items, ","):
            q.outputs += self.outputs(item, env, q)
        for word in ("WHERE", "HAVING"):
            q.filters += self.compared(clauses.get(word, []), env, q)
        return q

    def relations(self, tokens: list[Token], env: dict[str, Query], q: Query) -> None:
        k = 0
        while k < len(tokens):
            t = tokens[k]
            if t.up in ("ON", "USING") and t.kind == "name":
                end = k + 1
                depth = 0
                while end < len(tokens) and not (depth == 0 and (tokens[end].text == "," or (tokens[end].kind == "name" and tokens[end].up in _JOINS and tokens[end].up not in ("ON", "USING")))):
                    depth += (tokens[end].text == "(") - (tokens[end].text == ")")
                    end += 1
                self.join_keys(tokens[k + 1 : end], t.up, env, q)
                k = end
            elif t.text == "," or (t.kind == "name" and t.up in _JOINS):
                if t.up == "LATERAL" and k + 1 < len(tokens) and tokens[k + 1].up == "VIEW":
                    k = self.lateral_view(tokens, k + 2, env, q)
                else:
                    k += 1
            elif t.text == "(":
                end = _close(tokens, k)
                body = tokens[k + 1 : end]
                alias, nxt = self.alias(tokens, end + 1)
                if body and body[0].up in ("SELECT", "WITH", "("):
                    inner = self.query(body, env, q)
                    q.relations.append(Relation(alias or "", query=inner))
                    q.inner.append(inner)
                else:
                    self.relations(body, env, q)
                k = max(nxt, k + 1)
            elif t.kind in ("name", "quoted"):
                parts, nxt = _name(tokens, k)
                if nxt < len(tokens) and tokens[nxt].text == "(":  # a table function
                    alias, nxt = self.alias(tokens, _close(tokens, nxt) + 1)
                    k = max(nxt, k + 1)
                    continue
                alias, nxt = self.alias(tokens, nxt)
                found = env.get(parts[0].lower()) if len(parts) == 1 else None
                if found is not None:
                    q.relations.append(Relation(alias or parts[-1], query=found))
                else:
                    q.relations.append(Relation(alias or parts[-1], ".".join(parts[:-1]), parts[-1]))
                k = max(nxt, k + 1)
            else:
                k += 1

    def lateral_view(self, tokens: list[Token], k: int, env: dict[str, Query], q: Query) -> int:
        """``LATERAL VIEW [OUTER] f(x) alias AS a, b``: a relation whose columns come from the function's arguments."""
        if k < len(tokens) and tokens[k].up == "OUTER":
            k += 1
        _, nxt = _name(tokens, k)
        end = _close(tokens, nxt) if nxt < len(tokens) else nxt
        sources = [s for parts in self.references(tokens[nxt + 1 : end]) for s in q.resolve(parts)[0]]
        parts, k = _name(tokens, end + 1)
        columns = []
        if k < len(tokens) and tokens[k].up == "AS":
            k += 1
            while k < len(tokens) and tokens[k].kind in ("name", "quoted") and tokens[k].up not in _NOT_ALIAS:
                columns.append(tokens[k].text.strip('`"'))
                k += 1
                if k < len(tokens) and tokens[k].text == "," and k + 1 < len(tokens) and tokens[k + 1].kind == "name":
                    k += 1
        made = Query(outputs=[Output(c, list(sources), "ALIAS") for c in columns or ["col"]])
        q.relations.append(Relation(parts[-1] if parts else "", query=made))
        return k

    @staticmethod
    def alias(tokens: list[Token], k: int) -> tuple[str, int]:
        if k < len(tokens) and tokens[k].up == "AS":
            k += 1
        if k < len(tokens) and (tokens[k].kind == "quoted" or (tokens[k].kind == "name" and tokens[k].up not in _NOT_ALIAS)):
            name = tokens[k].text.strip('`"')
            k += 1
            if k < len(tokens) and tokens[k].text == "(":
                k = _close(tokens, k) + 1
            return name, k
        return "", k

    def join_keys(self, tokens: list[Token], word: str, env: dict[str, Query], q: Query) -> None:
        if word == "USING":
            for p in _split(tokens[1:-1], ","):
                if p:
                    for r in q.relations[-2:]:
                        if f := r.find(p[0].text.strip('`"')):
                            q.joins.append(f[0])
                            q.join_names.append(p[0].text.strip('`"'))
            return
        for k, t in enumerate(tokens):
            if t.text in ("=", "==", "<=>"):
                left, start = [], k
                while start > 0 and (tokens[start - 1].kind in ("name", "quoted") or tokens[start - 1].text == "."):
                    start -= 1
                left, _ = _name(tokens, start)
                right, _ = _name(tokens, k + 1)
                for parts in (left, right):
                    if parts and parts[0].upper() not in _WORDS:
                        sources, p = q.resolve(parts)
                        q.joins.append([sources[p], *sources[:p], *sources[p + 1 :]])
                        q.join_names.append(parts[-1])
                return

    def compared(self, tokens: list[Token], env: dict[str, Query], q: Query) -> list[tuple[str, list[Source]]]:
        """Columns that stand before a comparison, IN or LIKE, in order, each once."""
        out: dict[tuple[str, ...], list[Source]] = {}
        k = 0
        while k < len(tokens):
            if tokens[k].text == "(" and k + 1 < len(tokens) and tokens[k + 1].up in ("SELECT", "WITH"):
                end = _close(tokens, k)
                q.inner.append(self.query(tokens[k + 1 : end], env, q))
                k = end + 1
                continue
            if tokens[k].kind in ("name", "quoted") and (k == 0 or tokens[k - 1].text != "."):
                parts, nxt = _name(tokens, k)
                follows = tokens[nxt : nxt + 2]
                after = follows[0].up if follows else ""
                if after == "NOT" and len(follows) > 1:
                    after = follows[1].up
                if after in ("=", "==", "<", ">", "<=", ">=", "<>", "!=", "<=>", "!", "IN", "LIKE") and parts and not (tokens[k].kind == "name" and tokens[k].up in _WORDS):
                    sources, p = q.resolve(parts)
                    out.setdefault(tuple(parts), [sources[p], *sources[:p], *sources[p + 1 :]])
                k = max(nxt, k + 1)
            else:
                k += 1
        return [(parts[-1], s) for parts, s in out.items()]

    def references(self, tokens: list[Token]) -> list[list[str]]:
        """Dotted names that are columns: no keywords, types after CAST's AS, or functions; subqueries left out."""
        out, k = [], 0
        while k < len(tokens):
            t = tokens[k]
            if t.text == "(" and k + 1 < len(tokens) and tokens[k + 1].up in ("SELECT", "WITH"):
                k = _close(tokens, k) + 1
            elif t.kind in ("name", "quoted"):
                parts, nxt = _name(tokens, k)
                call = nxt < len(tokens) and tokens[nxt].text == "("
                typed = k > 0 and (tokens[k - 1].text == "::" or (tokens[k - 1].up == "AS" and t.up in _TYPES))
                lambda_ = nxt < len(tokens) and tokens[nxt].text == "->"
                if not call and not typed and not lambda_ and not (t.kind == "name" and len(parts) == 1 and t.up in _WORDS):
                    out.append(parts)
                k = max(nxt, k + 1)
            else:
                k += 1
        return out

    def outputs(self, item: list[Token], env: dict[str, Query], q: Query) -> list[Output]:
        if not item:
            return []
        if item[-1].text == "*" and (len(item) == 1 or item[-2].text == "."):
            return self.star(item[:-2], q)
        name, body, aliased = "", item, False
        if len(item) > 2 and item[-2].up == "AS" and item[-1].kind in ("name", "quoted"):
            name, body, aliased = item[-1].text.strip('`"'), item[:-2], True
        elif len(item) > 1 and item[-1].kind in ("name", "quoted") and item[-1].up not in _WORDS and (item[-2].text in ")]" or item[-2].kind in ("name", "quoted", "string", "number")) and item[-2].text != "." and item[-2].up not in ("AS", "NOT"):
            name, body, aliased = item[-1].text.strip('`"'), item[:-1], True
        column, end = _name(body, 0)
        if column and end == len(body) and body[0].up not in ("NULL", "TRUE", "FALSE", "CURRENT_DATE", "CURRENT_TIMESTAMP"):
            sources, p = q.resolve(column)
            inherited = [s.op for s in sources]
            real = any(r.query is not None for r in q.relations) and inherited and inherited[p] != "SELECT"
            op = inherited[p] if real else ("ALIAS" if aliased and name.lower() != column[-1].lower() and not self.from_query(column, q) else "SELECT")
            return [Output(name or column[-1], [s if s.branch else s._replace(op=op) for s in sources], op, p)]
        body, subqueries = self.without_subqueries(body)
        heads = [(k, t.up) for k, t in enumerate(body) if t.kind == "name" and k + 1 < len(body) and body[k + 1].text == "("]
        if len(heads) == 1 and heads[0][0] == 0 and _close(body, 1) == 2 and len(body) == 3 and not subqueries:
            return []  # f() has no source
        calls = {w for _, w in heads}
        over = any(t.up == "OVER" for t in body)
        found: list[Source] = []
        primary = 0
        if over and calls & set(WINDOWS):
            op = "WINDOW"
            chosen = self.window_keys(body) or self.references(body)
        elif calls & set(AGGREGATES):
            op = "AGGREGATE"
            k = next(k for k, w in heads if w in AGGREGATES)
            argument = body[k + 2 : _close(body, k + 1)]
            if [t.text for t in argument if t.up != "DISTINCT"] == ["*"] or (len(argument) == 1 and argument[0].kind == "number" and body[k].up == "COUNT"):
                r = q.relations[0] if len(q.relations) == 1 else None
                base = self.base_table(r) if r else ("", "")
                return [Output(name or "*", [Source(*base, "*", op)], op)]
            chosen = self.references(argument)
            chosen += [p for p in self.references(body) if p not in chosen]
        else:
            op = "ALIAS" if aliased else "SELECT"
            chosen = self.references(body)
        first = None
        for parts in chosen:
            sources, p = q.resolve(parts)
            first = first or sources[p]
            found += [s for s in sources if s not in found]
            last = sources[p]
        for part in subqueries:
            inner = self.query(part, env, q)
            q.inner.append(inner)
            for o in inner.outputs:
                found += [s for s in o.sources if s not in found]
                first = first or (o.sources[o.primary] if o.sources else None)
                op = "AGGREGATE" if o.op == "AGGREGATE" and op in ("ALIAS", "SELECT") else op
        if not found:
            return []
        first = first or found[0]
        arithmetic = op in ("ALIAS", "SELECT") and any(t.text in "+-*/%" and t.kind == "op" for t in body) and body[0].up != "CASE"
        if arithmetic and chosen:
            first = last
        found = list(dict.fromkeys(s._replace(op=op) for s in found))
        primary = next(k for k, s in enumerate(found) if s[:3] == first[:3])
        return [Output(name or (chosen[0][-1] if chosen else first.column), found, op, primary, untraced=arithmetic and sum(len(p) > 1 for p in chosen) > 1)]

    @staticmethod
    def without_subqueries(tokens: list[Token]) -> tuple[list[Token], list[list[Token]]]:
        """An expression with its subqueries' parentheses left empty, and the subqueries."""
        out, parts, k = [], [], 0
        while k < len(tokens):
            out.append(tokens[k])
            if tokens[k].text == "(" and k + 1 < len(tokens) and tokens[k + 1].up in ("SELECT", "WITH"):
                end = _close(tokens, k)
                parts.append(tokens[k + 1 : end])
                k = end
            else:
                k += 1
        return out, parts

    @staticmethod
    def from_query(column: list[str], q: Query) -> bool:
        """Whether a column comes from a CTE or derived table, whose operation it then keeps."""
        if len(column) > 1:
            return any(r.query is not None and r.alias.lower() == column[-2].lower() for r in q.relations)
        return len(q.relations) == 1 and q.relations[0].query is not None

    @staticmethod
    def base_table(r: Relation) -> tuple[str, str]:
        """A relation's own table, or the first real table below it."""
        seen = 0
        while r.query is not None and r.query.relations and seen < 50:
            r, seen = r.query.relations[0], seen + 1
        return (r.database, r.table) if r.query is None else ("", "")

    def star(self, prefix: list[Token], q: Query) -> list[Output]:
        wanted = prefix[-1].text.strip('`"').lower() if prefix else None
        out = []
        for r in q.relations:
            if wanted and r.alias.lower() != wanted:
                continue
            if r.query is None:
                out.append(Output("*", [Source(r.database, r.table, "*")], "SELECT"))
            else:
                out += [Output(o.name, list(o.sources), o.op, o.primary) for o in r.query.outputs]
        return out

    def window_keys(self, body: list[Token]) -> list[list[str]]:
        """Columns of PARTITION BY, else of ORDER BY."""
        k = next(k for k, t in enumerate(body) if t.up == "OVER")
        if k + 1 >= len(body) or body[k + 1].text != "(":
            return []
        spec = body[k + 2 : _close(body, k + 1)]
        clauses: dict[str, list[Token]] = {}
        word, at = "", 0
        for i, t, d in _depths(spec):
            if d == 0 and t.up in ("PARTITION", "ORDER", "ROWS", "RANGE"):
                if word:
                    clauses[word] = spec[at:i]
                word, at = t.up, i + 1
        if word:
            clauses[word] = spec[at:]
        return self.references(clauses.get("PARTITION", [])) or self.references(clauses.get("ORDER", []))


# --- statements


@dataclass
class Statement:
    target: tuple[str, str] = ("", "")
    query: Query | None = None
    assigned: list[tuple[str, list[Source], int]] = field(default_factory=list)


def read_statement(sql: str) -> Statement | None:
    """Target and scope of one statement; None if there is nothing to read (maintenance commands)."""
    tokens = tokenize(sql)
    if not tokens or SKIPPED.match(" ".join(t.text for t in tokens[:4])):
        return None
    b = Builder()
    rest, env, made = b.ctes(tokens, {}, None)
    s = Statement()
    word = rest[0].up if rest else ""
    if word == "INSERT":
        k = 1
        while k < len(rest) and rest[k].up in ("INTO", "OVERWRITE", "TABLE"):
            k += 1
        parts, k = _name(rest, k)
        s.target = (".".join(parts[:-1]), parts[-1]) if parts else ("", "")
        columns: list[str] = []
        while k < len(rest) and rest[k].up not in ("SELECT", "WITH", "VALUES", "FROM"):
            if rest[k].text == "(":
                end = _close(rest, k)
                body = rest[k + 1 : end]
                if body and body[0].up in ("SELECT", "WITH"):
                    break
                if k and rest[k - 1].up != "PARTITION":
                    columns = [p[0].text.strip('`"') for p in _split(body, ",") if p]
                k = end + 1
            else:
                k += 1
        if k < len(rest) and rest[k].up != "VALUES":
            s.query = b.query(rest[k:], env)
            if columns and len(columns) == len(s.query.outputs):
                for o, c in zip(s.query.outputs, columns, strict=True):
                    o.name = c
    elif word in ("CREATE", "REPLACE"):
        k = 1
        while k < len(rest) and rest[k].up not in ("TABLE", "VIEW"):
            k += 1
        k += 1
        if [t.up for t in rest[k : k + 3]] == ["IF", "NOT", "EXISTS"]:
            k += 3
        parts, k = _name(rest, k)
        s.target = (".".join(parts[:-1]), parts[-1]) if parts else ("", "")
        depth = 0
        while k < len(rest) and not (depth == 0 and rest[k].up == "AS"):
            depth += (rest[k].text == "(") - (rest[k].text == ")")
            k += 1
        if k + 1 < len(rest):
            s.query = b.query(rest[k + 1 :], env)
    elif word == "MERGE":
        _merge(rest, env, b, s)
    elif word == "UPDATE":
        parts, k = _name(rest, 1)
        s.target = (".".join(parts[:-1]), parts[-1]) if parts else ("", "")
        q = s.query = Query()
        alias, k = b.alias(rest, k)
        q.relations.append(Relation(alias or (parts[-1] if parts else ""), *s.target))
        cuts = {t.up: i for i, t, d in _depths(rest) if d == 0 and t.up in ("SET", "FROM", "WHERE")}
        end = min([cuts[w] for w in ("FROM", "WHERE") if w in cuts] or [len(rest)])
        if "FROM" in cuts:
            b.relations(rest[cuts["FROM"] + 1 : cuts.get("WHERE", len(rest))], env, q)
        _assign(rest[cuts.get("SET", end) + 1 : end], b, q)
        q.filters += b.compared(rest[cuts["WHERE"] + 1 :], env, q) if "WHERE" in cuts else []
    elif word == "DELETE":
        parts, k = _name(rest, 2)
        s.target = (".".join(parts[:-1]), parts[-1]) if parts else ("", "")
        s.query = Query(relations=[Relation(parts[-1] if parts else "", *s.target)])
        where = next((i for i, t, d in _depths(rest) if d == 0 and t.up == "WHERE"), None)
        if where is not None:
            s.query.filters += b.compared(rest[where + 1 :], env, s.query)
    elif word in ("SELECT", "(", "FROM"):
        s.query = b.query(rest, env)
    if s.query is not None:
        s.query.inner = [*made, *s.query.inner]
    return s


def _assign(tokens: list[Token], b: Builder, q: Query) -> None:
    """``column = expression, ...`` as outputs."""
    for item in _split(tokens, ","):
        eq = next((k for k, t in enumerate(item) if t.text == "="), None)
        if not eq:
            continue
        for o in b.outputs(item[eq + 1 :], {}, q):
            o.name = item[eq - 1].text.strip('`"')
            q.outputs.append(o)


def _merge(rest: list[Token], env: dict[str, Query], b: Builder, s: Statement) -> None:
    at = {w: next((i for i, t, d in _depths(rest) if d == 0 and t.up == w), len(rest)) for w in ("INTO", "USING", "ON", "WHEN")}
    parts, k = _name(rest, at["INTO"] + 1)
    s.target = (".".join(parts[:-1]), parts[-1]) if parts else ("", "")
    q = s.query = Query()
    b.relations(rest[at["USING"] + 1 : at["ON"]], env, q)
    source = list(q.relations)
    alias, _ = b.alias(rest, k)
    q.relations.append(Relation(alias or (parts[-1] if parts else ""), *s.target))
    b.join_keys(rest[at["ON"] + 1 : at["WHEN"]], "ON", env, q)
    whens = [i for i, t, d in _depths(rest) if d == 0 and t.up == "WHEN"] + [len(rest)]
    for i, j in zip(whens, whens[1:], strict=False):
        part = rest[i:j]
        words = [t.up for t in part]
        if "SET" in words:
            body = part[words.index("SET") + 1 :]
            if [t.text for t in body] == ["*"]:
                q.outputs += b.star([], Query(relations=source))
            else:
                _assign(body, b, q)
        elif "VALUES" in words:
            k = words.index("INSERT") + 1
            names = [p[0].text.strip('`"') for p in _split(part[k + 1 : _close(part, k)], ",") if p] if part[k].text == "(" else []
            k = words.index("VALUES") + 1
            for name, item in zip(names, _split(part[k + 1 : _close(part, k)], ","), strict=False):
                for o in b.outputs(item, {}, q):
                    o.name = name
                    q.outputs.append(o)
        elif words[-2:] == ["INSERT", "*"]:
            q.outputs += b.star([], Query(relations=source))


def _all_inner(q: Query, seen: set[int]) -> Iterator[Query]:
    for x in q.inner:
        if id(x) not in seen:
            seen.add(id(x))
            yield from _all_inner(x, seen)
            yield x


def statement_rows(sql: str, dependencies: bool = False) -> list[Mapping]:
    """All mappings of one statement, unmerged, dependencies first."""
    s = read_statement(sql)
    if s is None or s.query is None:
        return []
    rows: list[Mapping] = []
    add = lambda src, column, op, primary=True: rows.append(Mapping(src.database, src.table, src.column, *s.target, column, op, primary))
    q = s.query
    if dependencies:
        for inner in _all_inner(q, set()):
            for _, sources in inner.filters:
                if sources[0].table:
                    add(sources[0], NO_COLUMN, "FILTER_DEPENDENCY")
            for sources in inner.joins:
                if sources[0].table:
                    add(sources[0], NO_COLUMN, "JOIN_KEY")
        rows = list(dict.fromkeys(rows))
    names = {o.name.lower() for o in q.outputs}
    for o in q.outputs:
        for k, src in enumerate(o.sources):
            if o.untraced:
                add(src, o.name, o.op, False)
            else:
                add(src, o.name, src.op if src.branch else o.op, k == o.primary or src.branch)
        if o.untraced:
            add(Source("", "", "expr"), o.name, o.op)
    for name, sources in zip(q.join_names, q.joins, strict=True):
        if not names or name.lower() in names:
            add(sources[0], name, "JOIN")
    for name, sources in q.filters:
        hits = [o for o in q.outputs if o.name.lower() == name.lower()]
        if hits:
            add(sources[0], hits[0].name, "FILTER")
    return rows


def merged(rows: Iterable[Mapping]) -> list[Mapping]:
    """Resolved sources win over unresolved ones of the same mapping; then one row for each identity, operations joined."""
    rows = list(rows)
    key = lambda r: (r.source_column, r.target_table, r.target_column, r.sql_operation, r.primary)
    sourced = {key(r) for r in rows if r.source_table}
    shown = {r[:6] for r in rows if r.primary}
    ops: dict[tuple, list[str]] = {}
    primary: dict[tuple, bool] = {}
    for r in rows:
        if not r.source_table and key(r) in sourced:
            continue
        if not r.primary and r[:6] in shown:
            continue
        found = ops.setdefault(r[:6], [])
        if r.sql_operation not in found:
            found.append(r.sql_operation)
        primary[r[:6]] = primary.get(r[:6], False) or r.primary
    rank = {op: k for k, op in enumerate(OP_ORDER)}
    return [Mapping(*k, ", ".join(sorted(v, key=lambda op: rank.get(op, len(rank)))), primary[k]) for k, v in ops.items()]


def column_mappings(sql: str, dependencies: bool = False) -> list[Mapping]:
    """The merged mappings of all statements of a text."""
    return merged(r for s in split_statements(sql) for r in statement_rows(s, dependencies))
