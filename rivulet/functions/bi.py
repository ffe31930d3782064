"""Power BI, LookML and Qlik: tables, columns, measures and logic of report definitions, for use inside Arrow functions."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from .chunks import decode, model_texts
from .sqlscope import Mapping, column_mappings, merged, split_qualified

# --- fixed values
DAX_AGGREGATES = "SUM COUNT AVERAGE AVG MAX MIN DISTINCTCOUNT".split()
LOOKML_MEASURES = "sum count average max min count_distinct sum_distinct".split()
QLIK_AGGREGATES = "SUM COUNT AVG MAX MIN FIRSTSORTEDVALUE ONLY".split()
MOST_NAMED = 3


@dataclass
class Report:
    tool: str
    sources: list[str] = field(default_factory=list)
    targets: list[str] = field(default_factory=list)
    keys: list[str] = field(default_factory=list)
    kpis: list[str] = field(default_factory=list)
    logic: list[str] = field(default_factory=list)
    columns: list[str] = field(default_factory=list)
    operations: list[str] = field(default_factory=list)
    sql_names: list[str] = field(default_factory=list)
    metadata: dict[str, str] = field(default_factory=dict)
    job_type: str = "curated"
    #: What a part is, and its name; a report's own are empty.
    kind: str = ""
    name: str = ""
    parts: list[Report] = field(default_factory=list)

    def part(self, kind: str, name: str) -> Report:
        """A new part, which ``done`` adds up."""
        self.parts.append(Report(self.tool, kind=kind, name=name))
        return self.parts[-1]

    def done(self) -> Report:
        for p in self.parts:
            p.done()
            for name in ("sources", "targets", "keys", "kpis", "columns", "operations", "sql_names", "logic"):
                getattr(self, name).extend(getattr(p, name))
            if p.job_type != "curated":
                self.job_type = p.job_type
        for name in ("sources", "targets", "keys", "kpis", "columns", "operations", "sql_names"):
            setattr(self, name, list(dict.fromkeys(x for x in getattr(self, name) if x)))
        return self


def shortened(items: list[str], most: int = MOST_NAMED) -> str:
    return ", ".join(items[:most]) + (f" … and {len(items) - most} more" if len(items) > most else "")


def _sql_facts(sql: str, r: Report) -> None:
    """Adds what a query reads to a report."""
    for m in column_mappings(sql):
        if m.source_table:
            r.sources.append(m.source_table)
        if m.source_column not in ("*", "expr"):
            r.columns.append(m.source_column)
        r.operations += m.sql_operation.split(", ")
        if "JOIN" in m.sql_operation:
            r.keys.append(m.source_column)


# --- Power BI


def _list(value, key: str) -> list:
    found = value.get(key) if isinstance(value, dict) else None
    return [x for x in found if isinstance(x, dict)] if isinstance(found, list) else []


def powerbi_tables(model: dict) -> list[dict]:
    for key in ("dataModel", "model"):
        if isinstance(model.get(key), dict):
            return _list(model[key], "tables")
    return _list(model, "tables")


def powerbi_mappings(text: str, report: str) -> list[Mapping]:
    """A SELECT row for each column of the data model."""
    try:
        model = json.loads(text)
    except ValueError:
        return []
    rows = []
    for t in powerbi_tables(model) if isinstance(model, dict) else []:
        db, table = split_qualified(str(t.get("source") or t.get("name") or ""))
        rows += [Mapping(db, table, str(c["name"]), "report", report, str(c["name"]), "SELECT") for c in _list(t, "columns") if c.get("name")]
    return merged(rows)


def powerbi(content: bytes) -> Report:
    r = Report("PowerBI")
    for text in model_texts(content):
        try:
            model = json.loads(text)
        except ValueError:
            continue
        if not isinstance(model, dict):
            continue
        r.metadata |= {k: str(v) for k, v in (model.get("metadata") or {}).items()} if isinstance(model.get("metadata"), dict) else {}
        for source in _list(model, "dataSources"):
            kind, p = str(source.get("type", "")).lower(), r.part("data source", str(source.get("name") or source.get("type") or ""))
            for q in _list(source, "queries"):
                sql = str(q.get("query", ""))
                p.sql_names.append(str(q.get("name", "")))
                if re.search(r"\bSELECT\b", sql, re.I):
                    _sql_facts(sql, p)
                else:
                    _power_query(sql, p)
            if kind == "excel" and source.get("path"):
                p.sources.append(str(source["path"]).rpartition("/")[2])
            if kind == "web" and source.get("baseUrl"):
                p.sources.append(str(source["baseUrl"]))
            if m := re.search(r"Database\s*=\s*([^;]+)", str(source.get("connectionString", ""))):
                p.logic.append(f"database {m[1].strip()}")
        for t in _list(model, "transformations"):
            p = r.part("transformation", str(t.get("name", "")))
            p.targets.append(p.name)
            _power_query(str(t.get("mExpression", "")), p)
        for t in powerbi_tables(model):
            p = r.part("table", str(t.get("name", "")))
            p.targets.append(p.name)
            p.columns += [str(c.get("name", "")) for c in _list(t, "columns")]
            for x in _list(t, "partitions"):
                code = x.get("source", {}).get("expression", "") if isinstance(x.get("source"), dict) else x.get("source", x.get("expression", ""))
                _power_query("\n".join(map(str, code)) if isinstance(code, list) else str(code), p)
            for m in _list(t, "measures"):
                _measure(p.name, m, p)
            for c in _list(t, "columns"):
                if c.get("expression"):  # a calculated column
                    text = " ".join(c["expression"]) if isinstance(c["expression"], list) else str(c["expression"])
                    p.logic.append(f"COLUMN {p.name}[{c.get('name', '')}] = {text}")
                    p.columns += re.findall(r"\[([^\]]+)\]", text)
        inner = model.get("dataModel") or model.get("model") or {}
        for x in _list(inner, "relationships"):
            ends = x.get("from", x.get("fromTable", "")), x.get("to", x.get("toTable", ""))
            p = r.part("relationship", f"{ends[0]} - {ends[1]}")
            p.keys += [str(x.get(k, "")) for k in ("fromColumn", "toColumn")]
            p.logic.append(f"relationship {p.name}")
            p.operations.append("JOIN")
        for m in _list(model, "measures"):
            _measure(str(m.get("table", "")), m, r.part("measure", str(m.get("name", ""))))
        for page in _list(model, "reportPages") or _list(model, "pages"):
            p = r.part("page", str(page.get("name", "")))
            for v in _list(page, "visuals"):
                shown = {k: v[k] if isinstance(v[k], list) else [v[k]] for k in ("axis", "values", "group", "legend", "fields") if v.get(k)}
                p.logic.append(f"visual {v.get('type', '')} on {p.name}" + "".join(f"; {k}: {', '.join(map(str, x))}" for k, x in shown.items()))
                p.columns += [y for x in shown.values() for z in map(str, x) for y in (re.findall(r"\[([^\]]+)\]", z) or [z.rpartition(".")[2]])]
    return r.done()


def _power_query(code: str, r: Report) -> None:
    """Databases, tables, other steps and table functions of a Power Query text."""
    r.logic += [f"database {db}" for db in re.findall(r'Sql\.Databases?\(\s*"[^"]*"\s*,\s*"([^"]*)"', code)]
    r.sources += re.findall(r'Item\s*=\s*"([^"]+)"', code)
    steps = set(re.findall(r'(?m)(?:^|,|\blet\b)\s*(#"[^"]+"|[A-Za-z_]\w*)\s*=', code))
    for read in re.findall(r'\bSource\s*=\s*(#"[^"]+"|[A-Za-z_]\w*)\s*(?:,|$|\n)', code):
        if read not in steps:  # another query of the report
            r.sources.append(read.strip('#"'))
    r.keys += re.findall(r'Table\.NestedJoin\([^,]+,\s*\{"([^"]+)"\}', code)
    r.logic += [f"M: {x}" for x in re.findall(r"Table\.(\w+)", code)]
    if "Table.NestedJoin" in code or "Table.Join" in code:
        r.operations.append("JOIN")
    if "Table.Group" in code:
        r.operations.append("AGGREGATE")


def _measure(table: str, m: dict, r: Report) -> None:
    expression = m.get("expression", "")
    expression = " ".join(expression) if isinstance(expression, list) else str(expression)
    r.kpis.append(f"{table}.{m.get('name', '')}".strip("."))
    r.logic.append(f"MEASURE {table}[{m.get('name', '')}] = {expression}")
    r.columns += re.findall(r"\[([^\]]+)\]", expression)
    if re.search(rf"\b(?:{'|'.join(DAX_AGGREGATES)})\s*\(", expression, re.I):
        r.job_type = "aggregation"
        r.operations.append("AGGREGATE")


# --- LookML


def lookml_blocks(text: str, kind: str) -> list[tuple[str, str]]:
    """(name, body) of each ``kind: name { ... }``, braces matched; comments out of strings are left out before."""
    out = []
    for m in re.finditer(rf"\b{kind}\s*:\s*\+?([\w.-]*)\s*\{{", text):
        depth, k = 1, m.end()
        while k < len(text) and depth:
            depth += (text[k] == "{") - (text[k] == "}")
            k += 1
        out.append((m[1], text[m.end() : k - 1]))
    return out


def _field(body: str, key: str) -> str:
    m = re.search(rf"\b{key}\s*:\s*(?:\"([^\"]*)\"|([^\s;{{}}]+))", body)
    return (m[1] or m[2] or "") if m else ""


def _sql_field(body: str, key: str) -> str:
    m = re.search(rf"\b{key}\s*:\s*(.*?);;", body, re.S)
    return m[1].strip() if m else ""


def lookml(text: str) -> Report:
    r = Report("Looker")
    r.metadata = {k: v for k in ("DOMAIN", "SUBJECT_AREA", "SCHEDULE", "OWNER") if (v := _meta(text, k, "#"))}
    clean = re.sub(r"(?m)#[^\n{}\"]*$", "", text)
    for name, body in lookml_blocks(clean, "view"):
        p = r.part("view", name)
        p.targets.append(name)
        p.sql_names.append(name)
        if t := _sql_field(body, "sql_table_name"):
            p.sources.append(split_qualified(t)[1])
        for _, derived in lookml_blocks(body, "derived_table"):
            for key in ("sql", "sql_trigger_value", "sql_trigger"):
                if sql := _sql_field(derived, key):
                    _sql_facts(re.sub(r"(?m)--[^\n]*$", "", sql), p)
        for _, derived in lookml_blocks(body, "sql_trigger"):
            _sql_facts(derived, p)
        for kind in ("dimension", "dimension_group"):
            for field_name, d in lookml_blocks(body, kind):
                p.columns.append(field_name)
                p.columns += re.findall(r"\$\{TABLE\}\.(\w+)", d)
                if _field(d, "primary_key").lower() == "yes":
                    p.keys.append(field_name)
                p.operations.append("SELECT")
        for field_name, d in lookml_blocks(body, "measure"):
            kind = _field(d, "type")
            p.kpis.append(f"{name}.{field_name} ({kind})")
            p.columns += re.findall(r"\$\{TABLE\}\.(\w+)", d)
            if kind in LOOKML_MEASURES:
                p.operations.append("AGGREGATE")
            p.job_type = "aggregation"
        p.logic.append(f"view {name}")
    for name, body in lookml_blocks(clean, "explore"):
        p = r.part("explore", name)
        p.logic.append(f"explore {name}")
        p.sql_names.append(name)
        p.targets.append(name)
        base = _field(body, "from") or _field(body, "view_name") or name
        p.sources += [base]
        for joined, j in lookml_blocks(body, "join"):
            p.sources.append(_field(j, "from") or joined)
            p.operations.append("JOIN")
            p.logic.append(f"join {joined} ({_field(j, 'relationship') or 'many_to_one'})")
            p.keys += re.findall(r"\$\{\w+\.(\w+)\}", _sql_field(j, "sql_on"))
    for name, body in lookml_blocks(clean, "dashboard"):
        tiles, p = lookml_blocks(body, "element"), r.part("dashboard", name)
        p.targets.append(name)
        p.logic.append(f"dashboard {name}: {len(tiles)} tiles")
        for tile, t in tiles:
            p.sources += [x for x in (_field(t, "explore"),) if x]
            shown = re.search(r"\bfields\s*:\s*\[([^\]]*)\]", t)
            names = [x.strip().strip('"') for x in shown[1].split(",")] if shown else []
            p.columns += [x.rpartition(".")[2] for x in names]
            p.logic.append(f"tile {tile} ({_field(t, 'type')})" + (f": {', '.join(names)}" if names else ""))
    views = {p.name for p in r.parts if p.kind == "view"}
    r.done()
    # The report as a whole reads tables; what its explores and tiles read are its own views and explores.
    own = views | {p.name for p in r.parts}
    r.sources = [x for x in r.sources if x not in own]
    r.targets = [x for x in r.targets if x in views]
    return r


def lookml_mappings(text: str) -> list[Mapping]:
    """Dimensions and measures of each view: a plain column, an aggregate, or another expression."""
    rows = []
    for name, body in lookml_blocks(re.sub(r"(?m)#[^\n{}\"]*$", "", text), "view"):
        db, table = split_qualified(_sql_field(body, "sql_table_name") or name)
        for kind in ("dimension", "dimension_group", "measure"):
            for out, d in lookml_blocks(body, kind):
                sql = _sql_field(d, "sql")
                columns = re.findall(r"\$\{TABLE\}\.(\w+)", sql) or re.findall(r"\$\{(\w+)\}", sql)
                op = "AGGREGATE" if kind == "measure" else "SELECT" if columns == [out] else "ALIAS"
                rows += [Mapping(db, table, c, "report", name, out, op, k == 0) for k, c in enumerate(columns or (["*"] if kind == "measure" else []))]
    return merged(rows)


# --- Qlik


def qlik_clean(text: str) -> str:
    """Without comments; ``//`` inside brackets (paths) and quotes stays."""
    return re.sub(r"(\[[^\]\n]*\]|'[^'\n]*'|\"[^\"\n]*\")|/\*.*?\*/|//[^\n]*|^\s*REM\b[^\n;]*;?", lambda m: m[1] or " ", text, flags=re.S | re.M)


def qlik(text: str) -> Report:
    r = Report("Qlik")
    r.metadata = {k: v for k in ("DOMAIN", "SUBJECT_AREA", "SCHEDULE", "OWNER") if (v := _meta(text, k, "//"))}
    clean = qlik_clean(text)
    labels = set(re.findall(r"^\s*\[?(\w+)\]?\s*:\s*(?:NOCONCATENATE\s+|MAPPING\s+)*(?:LOAD|SQL|SELECT|LEFT|INNER|JOIN)\b", clean, re.M | re.I))
    r.targets += sorted(labels, key=clean.find)
    label = r"(?:^\s*\[?(\w+)\]?\s*:\s*)?"
    for name, sql in re.findall(rf"{label}\bSQL\s+(SELECT\b.*?);", clean, re.S | re.I | re.M):
        p = r.part("SQL", name)
        p.targets += [name] * bool(name)
        _sql_facts(sql, p)
        _grouped(sql, p)
    for name, load in re.findall(rf"{label}(?:NOCONCATENATE\s+|MAPPING\s+)*\bLOAD\b(.*?);", clean, re.S | re.I | re.M):
        p = r.part("LOAD", name)
        p.targets += [name] * bool(name)
        if m := re.search(r"\bFROM\s+\[?([^\]\s;(]+)", load, re.I):
            p.sources.append(re.sub(r"\.\w+$", "", m[1].rpartition("/")[2]))
        if m := re.search(r"\bRESIDENT\s+\[?(\w+)", load, re.I):
            p.sources.append(m[1])
        columns = re.split(r"\b(?:FROM|RESIDENT|INLINE|AUTOGENERATE|WHERE|GROUP\s+BY)\b", load, maxsplit=1, flags=re.I)[0]
        for c in columns.split(","):
            if m := re.search(r"([\w.]+)\]?\s*$", c.strip()):
                p.columns.append(m[1])
        p.operations.append("SELECT")
        for function, alias in re.findall(rf"\b({'|'.join(QLIK_AGGREGATES)})\s*\([^()]*\)\s+AS\s+\[?(\w+)", load, re.I):
            p.kpis.append(f"{alias} ({function.upper()})")
        _grouped(load, p)
    for joined in re.findall(r"\b(?:LEFT|RIGHT|INNER|OUTER)?\s*JOIN\s*\(\s*\[?(\w+)", clean, re.I):
        p = r.part("JOIN", joined)
        p.operations.append("JOIN")
        p.logic.append(f"join into {joined}")
    for table, path in re.findall(r"\bSTORE\s+\[?(\w+)\]?\s+INTO\s+\[?([^\];\s(]+)", clean, re.I):
        p = r.part("STORE", table)
        p.sources.append(table)
        p.targets.append(re.sub(r"\.\w+$", "", path.rpartition("/")[2]))
        p.logic.append(f"store {table}")
    for function, alias in re.findall(rf"\b({'|'.join(QLIK_AGGREGATES)})\s*\([^()]*\)\s+AS\s+(\w+)", " ".join(re.findall(r"\bSQL\s+SELECT\b.*?;", clean, re.S | re.I)), re.I):
        r.kpis.append(f"{alias} ({function.upper()})")
    r.done()
    r.sources = [x for x in r.sources if x not in labels]  # tables of the script itself
    if re.search(r"\bGROUP\s+BY\b", clean, re.I) or r.kpis:
        r.job_type = "aggregation"
        r.operations += ["AGGREGATE"] * ("AGGREGATE" not in r.operations)
    for p in r.parts:
        p.job_type = "aggregation" if p.kpis or "AGGREGATE" in p.operations else p.job_type
    return r


def _grouped(sql: str, r: Report) -> None:
    if m := re.search(r"\bGROUP\s+BY\b(.*?)(?:;|\bORDER\b|\bHAVING\b|\Z)", sql, re.S | re.I):
        r.keys += [x.strip().rpartition(".")[2].strip("[] ") for x in m[1].split(",")]


def qlik_mappings(text: str, report: str) -> list[Mapping]:
    """The SQL blocks' columns, targets named after the table labels."""
    rows = []
    clean = qlik_clean(text)
    for label, sql in re.findall(r"(?:^\s*\[?(\w+)\]?\s*:\s*)?\bSQL\s+(SELECT\b.*?);", clean, re.S | re.I | re.M):
        rows += [m._replace(target_database="report", target_table=label or report) for m in column_mappings(sql)]
    return merged(rows)


def _meta(text: str, key: str, mark: str) -> str:
    m = re.search(rf"^[ \t]*{mark}[ \t]*@?{key}[ \t]*:[ \t]*([^\n\r]*)", text, re.M | re.I)
    return m[1].strip() if m else ""


def read_report(name: str, content: bytes | None) -> Report | None:
    """A report definition by its suffix; None for other files."""
    lower = name.lower()
    if lower.endswith((".pbit", ".pbix")):
        return powerbi(content or b"")
    if lower.endswith((".lkml", ".lookml")):
        return lookml(decode(content or b""))
    if lower.endswith(".qvs"):
        return qlik(decode(content or b""))
    return None
