"""Code embedded in files: (content, dialect, label) pieces of one file, for use inside Arrow functions."""

from __future__ import annotations

import html
import io
import json
import re
import zipfile
from typing import NamedTuple

from .formats import detect
from .sqlscope import split_statements

HAS_SQL = re.compile(r"\b(?:SELECT|INSERT|CREATE|MERGE|UPDATE|DELETE|WITH)\b", re.I)
STARTS_SQL = re.compile(r"\s*(?:--[^\n]*\n\s*|/\*.*?\*/\s*)*(?:SELECT|INSERT|CREATE|MERGE|UPDATE|DELETE|WITH)\b", re.I | re.S)


class Chunk(NamedTuple):
    content: str
    dialect: str
    label: str


def decode(content: bytes) -> str:
    """UTF-8 with replacement; UTF-16 where a byte-order mark or zero bytes say so (as in report models)."""
    if content[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return content.decode("utf-16", errors="replace")
    if content[1:2] == b"\0" and content[3:4] == b"\0":
        return content.decode("utf-16-le", errors="replace")
    return content.decode("utf-8-sig" if content[:3] == b"\xef\xbb\xbf" else "utf-8", errors="replace")


def from_sql(text: str, label: str = "sql") -> list[Chunk]:
    return [Chunk(s, "sql", f"{label}_stmt{k}") for k, s in enumerate(split_statements(text), 1)]


def _source(cell: dict) -> str:
    s = cell.get("source", "")
    return "".join(s) if isinstance(s, list) else str(s)


def from_notebook(text: str) -> list[Chunk]:
    """Code cells (SQL where a magic or comment says so), and raw cells with SQL; markdown is left out."""
    try:
        cells = json.loads(text)["cells"]
    except (ValueError, KeyError, TypeError):
        return [Chunk(text, "python", "notebook")]
    out = []
    for k, cell in enumerate(cells):
        body, kind = _source(cell), cell.get("cell_type")
        if not body.strip():
            continue
        if kind == "code":
            magic = re.match(r"\s*(?:%%sql[^\n]*\n|--\s*sql[^\n]*\n)", body, re.I)
            out.append(Chunk(body[magic.end() :], "sql", f"cell{k}") if magic else Chunk(body, "python", f"cell{k}"))
        elif kind == "raw" and re.search(r"\b(?:SELECT|INSERT|CREATE)\b", body, re.I):
            out.append(Chunk(body, "sql", f"cell{k}"))
    return out


def from_fences(text: str) -> list[Chunk]:
    found = re.findall(r"^```+\s*\{\s*(\w+)[^}]*\}[^\n]*\n(.*?)^```", text, re.S | re.M)
    return [Chunk(body, lang.lower(), f"chunk{k}") for k, (lang, body) in enumerate(found) if lang.lower() in ("sql", "r", "python")]


def from_jvm(text: str, dialect: str) -> list[Chunk]:
    found = re.findall(r'spark\s*\.\s*sql\(\s*(?:[sf]?"""(.*?)"""|[sf]?"((?:[^"\\\n]|\\.)+)")', text, re.S)
    return [Chunk(text, dialect, dialect), *(Chunk(a or b, "sql", f"{dialect}_sql{k}") for k, (a, b) in enumerate(found))]


def from_r(text: str) -> list[Chunk]:
    found = re.findall(r"\b(?:dbGetQuery|dbExecute|sqlQuery|dbSendQuery)\s*\(\s*[^,]+,\s*(?:\"((?:[^\"\\]|\\.)*)\"|'((?:[^'\\]|\\.)*)')", text, re.S)
    return [Chunk(text, "r", "r"), *(Chunk(a or b, "sql", f"r_sql{k}") for k, (a, b) in enumerate(found))]


def from_shell(text: str) -> list[Chunk]:
    out = [m[2] for m in re.finditer(r"<<-?\s*['\"]?(\w+)['\"]?[^\n]*\n(.*?)^\s*\1\s*$", text, re.S | re.M)]
    out += [m[2] for m in re.finditer(r"\b(?:bq\s+query|psql|mysql|sqlcmd)\b[^\n\"']*([\"'])((?:(?!\1).){20,}?)\1", text, re.S)]
    return [Chunk(s, "sql", f"shell_sql{k}") for k, s in enumerate(dict.fromkeys(x for x in out if HAS_SQL.search(x)))]


def from_yaml(text: str) -> list[Chunk]:
    """Block and quoted values of ``sql``, ``query`` and ``statement`` keys, each once."""
    out = []
    for m in re.finditer(r"^([ \t-]*)(?:sql|query|statement)\s*:\s*[|>][+-]?\d*[ \t]*\n((?:(?:\1[ \t]+[^\n]*|[ \t]*)(?:\n|\Z))+)", text, re.M | re.I):
        lines = m[2].rstrip().split("\n")
        indent = min((len(x) - len(x.lstrip()) for x in lines if x.strip()), default=0)
        out.append("\n".join(x[indent:] for x in lines))
    out += [a or b for a, b in re.findall(r"^[ \t-]*(?:sql|query|statement)\s*:\s*(?:\"((?:[^\"\\]|\\.){10,})\"|'((?:[^']|''){10,})')", text, re.M | re.I)]
    return [Chunk(s, "sql", f"yaml_sql{k}") for k, s in enumerate(dict.fromkeys(x for x in out if HAS_SQL.search(x)))]


def walk_json(value, path: str = "$"):
    """(path, string) of every string leaf."""
    todo = [(path, value)]
    while todo:
        at, v = todo.pop()
        if isinstance(v, str):
            yield at, v
        elif isinstance(v, dict):
            todo += [(f"{at}.{k}", x) for k, x in reversed(v.items())]
        elif isinstance(v, list):
            todo += [(f"{at}[{k}]", x) for k, x in reversed(list(enumerate(v)))]


def from_json(text: str) -> list[Chunk]:
    try:
        value = json.loads(text)
    except (ValueError, RecursionError):
        return [Chunk(text, "sql", "json")] if HAS_SQL.search(text) else []
    return [Chunk(s, "sql", path) for path, s in walk_json(value) if STARTS_SQL.match(s) or (HAS_SQL.search(s) and re.search(r"\bFROM\b|\bINTO\b|\bTABLE\b", s, re.I))]


def from_xml(text: str) -> list[Chunk]:
    """Texts of any element, and of Tableau's relations, that begin with SQL; CDATA and entities are undone."""
    out = []
    for m in re.finditer(r"<([\w:.-]+)(?:\s[^<>]*)?>((?:<!\[CDATA\[.*?\]\]>|[^<])+)</\1\s*>", text, re.S):
        body = re.sub(r"<!\[CDATA\[(.*?)\]\]>", lambda c: html.escape(c[1]), m[2], flags=re.S)
        s = html.unescape(body).strip()
        if STARTS_SQL.match(s):
            out.append((m[1], s))
    return [Chunk(s, "sql", f"{tag}_{k}") for k, (tag, s) in enumerate(dict.fromkeys(out))]


def _entries(content: bytes, wanted) -> list[tuple[str, bytes]]:
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            return [(n, z.read(n)) for n in z.namelist() if wanted(n.lower())]
    except (zipfile.BadZipFile, NotImplementedError, RuntimeError):
        return []


def from_tableau_zip(content: bytes) -> list[Chunk]:
    return [c for _, b in _entries(content, lambda n: n.endswith((".twb", ".tds"))) for c in from_xml(decode(b))]


def model_texts(content: bytes) -> list[str]:
    """JSON texts of a report: the zip's model and layout entries, or the file itself."""
    found = _entries(content, lambda n: "datamodel" in n or n.endswith((".json", "layout")))
    order = lambda n: (not n.lower().startswith("datamodel"), "layout" not in n.lower(), n)
    texts = [decode(b) for _, b in sorted(found, key=lambda x: order(x[0]))] or [decode(content)]
    return [t for t in texts if t.lstrip()[:1] in ("{", "[")]


def from_powerbi(content: bytes) -> list[Chunk]:
    out = []
    for t in model_texts(content):
        out += [Chunk(t, "powerbi", "powerbi_model"), *from_json(t)]
    return out


def from_terraform(text: str) -> list[Chunk]:
    out = [m[2] for m in re.finditer(r"\bquery\s*=\s*<<-?\s*(\w+)\s*\n(.*?)^\s*\1\s*$", text, re.S | re.M)]
    out += re.findall(r"\b(?:query|sql_query)\s*=\s*\"((?:[^\"\\]|\\.)+)\"", text)
    return [Chunk(s, "sql", f"hcl_sql{k}") for k, s in enumerate(x for x in out if HAS_SQL.search(x))]


def from_lookml(text: str) -> list[Chunk]:
    found = re.findall(r"\bsql\s*:\s*(.*?);;", text, re.S)
    return [Chunk(text, "lookml", "lookml"), *(Chunk(s, "sql", f"lookml_sql{k}") for k, s in enumerate(found) if re.search(r"\bSELECT\b", s, re.I) and re.search(r"\bFROM\b", s, re.I))]


def from_qlik(text: str) -> list[Chunk]:
    found = re.findall(r"\bSQL\s+(SELECT\b.*?);", re.sub(r"(?m)^\s*//[^\n]*", "", text), re.S | re.I)
    return [Chunk(text, "qlik", "qlik"), *(Chunk(s, "sql", f"qlik_sql{k}") for k, s in enumerate(found))]


def from_text(text: str) -> list[Chunk]:
    return from_sql(text, "text") if HAS_SQL.search(text) else [Chunk(text, "unknown", "text")]


def extract(name: str, content: bytes | None) -> tuple[list[Chunk], str]:
    """All pieces of one file, each (content, dialect) once, and a diagnosis (empty if there is none)."""
    content = content or b""
    text = decode(content)
    kind, dialect = detect(name, text)
    try:
        if kind == "sql":
            out = from_sql(text)
        elif kind == "python":
            out = [Chunk(text, "python", "python")]
        elif kind == "notebook":
            out = from_notebook(text)
        elif kind in ("rnotebook", "qmd"):
            out = from_fences(text)
        elif kind in ("scala", "java"):
            out = from_jvm(text, dialect)
        elif kind == "tableau_zip":
            out = from_tableau_zip(content)
        elif kind == "powerbi_binary":
            out = from_powerbi(content)
        elif kind in ("xml", "ssrs", "tableau"):
            out = from_xml(text)
        elif kind in ("data", "ini", "toml", "properties"):
            out = [Chunk(text[:2000], dialect, kind)]
        else:
            make = {"r": from_r, "shell": from_shell, "yaml": from_yaml, "json": from_json, "terraform": from_terraform, "looker": from_lookml, "qlik": from_qlik}.get(kind, from_text)
            out = make(text)
    except Exception as e:  # a broken file is a diagnosis, not an end to the job
        return [], f"{kind}: {e.__class__.__name__}: {e}"
    return list({(c.content, c.dialect): c for c in reversed(out)}.values())[::-1], ""
