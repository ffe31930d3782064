"""Collections of source files as DataFrames of (path, file_name, content, file_pos)."""

from __future__ import annotations

import fnmatch
import re
import shutil
import subprocess
import tempfile
import zipfile
from collections.abc import Iterable
from dataclasses import dataclass, field
from pathlib import Path
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import FILES

# --- fixed values: what is scanned unless patterns are given, and limits of the git source
DEFAULT_PATTERNS = ("*.sql", "*.py", "*.ipynb")
REPORT_PATTERNS = ("*.pbit", "*.lkml", "*.qvs")
CLONE_SECONDS, VERSION_SECONDS = 120, 10
#: Numbers of files that are broadcast: some 200 MB at most, with paths of 200 characters.
BROADCAST_FILES = 1_000_000


@dataclass
class Config:
    """A YAML file's settings, with defaults."""

    pipeline_dir: str = "."
    file_patterns: list[str] = field(default_factory=lambda: list(DEFAULT_PATTERNS))
    reporting_patterns: list[str] = field(default_factory=lambda: list(REPORT_PATTERNS))
    exclusions: list[str] = field(default_factory=list)
    output_path: str = "output/flow.csv"

    @classmethod
    def load(cls, path: str) -> Config:
        import yaml

        given = yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}
        return cls(**{k: v for k, v in given.items() if k in cls.__dataclass_fields__})


def glob_regex(patterns: Iterable[str]) -> str:
    """One regular expression for any of some file-name globs."""
    return "|".join(f"(?:{fnmatch.translate(p).replace(chr(92) + 'Z', '$').replace('(?s:', '(?:')})" for p in patterns) or "$^"


def scan(spark: SparkSession, root: str, patterns: Iterable[str] = DEFAULT_PATTERNS, exclusions: Iterable[str] = ()) -> DataFrame:
    """All files below ``root`` whose name fits a pattern and whose path has no excluded component, in order of path.

    Names are matched on the path column, which Spark has before it reads contents; order is a number, so that it outlives
    shuffles. Paths alone are numbered; up to ``BROADCAST_FILES`` numbers are broadcast to where contents are read.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    name = F.regexp_replace(F.substring_index("path", "/", -1), "%20", " ")
    found = found.select("path", name.alias("file_name"), "content").where(F.col("file_name").rlike(f"^({glob_regex(patterns)})"))
    excluded = [x.strip("/") for x in exclusions]
    if excluded:
        found = found.where(~F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, excluded))))
    ranked = numbered(found.select("path"), "path")
    small = ranked.limit(BROADCAST_FILES + 1).count() <= BROADCAST_FILES
    return found.join(F.broadcast(ranked) if small else ranked, "path").select("path", "file_name", "content", "file_pos")


def numbered(df: DataFrame, order: str) -> DataFrame:
    """With ``file_pos``, which grows with a column, by a range-partitioned sort; no task sees all rows.

    24 bits count the rows of a partition, so that a file's ordinal fits a long with 2 ** 39 partitions.
    """
    ranged = df.repartitionByRange(df.sparkSession.sparkContext.defaultParallelism, order).sortWithinPartitions(order)
    raw = F.monotonically_increasing_id()
    return ranged.withColumn("file_pos", F.shiftleft(F.shiftright(raw, 33), 24) + raw.bitwiseAND(F.lit((1 << 33) - 1)))


def upload(spark: SparkSession, files: dict[str, bytes]) -> DataFrame:
    """Files that a caller hands over."""
    return spark.createDataFrame([(n, n.rpartition("/")[2], b, k) for k, (n, b) in enumerate(files.items())], FILES)


def display_url(url: str) -> str:
    """Without credentials."""
    return re.sub(r"(https?://)[^@/]+@", r"\1", url)


def from_git(spark: SparkSession, url: str, branch: str = "main", path: str = "", suffixes: Iterable[str] = (".sql", ".py", ".ipynb")) -> DataFrame:
    """The files of one branch of a repository, cloned shallowly on the driver; ``path``: a file, a folder, a glob, or all."""
    subprocess.run(["git", "--version"], check=True, capture_output=True, timeout=VERSION_SECONDS)
    folder = tempfile.mkdtemp(prefix="rivulet-git-")
    try:
        subprocess.run(["git", "clone", "--quiet", "--depth", "1", "--branch", branch, "--single-branch", "--", url, folder], check=True, capture_output=True, timeout=CLONE_SECONDS)
        shown, wanted = f"{display_url(url).removesuffix('.git')}/blob/{branch}", path.strip("/")
        files = {}
        for p in sorted(Path(folder).rglob("*")):
            rel = p.relative_to(folder).as_posix()
            inside = not wanted or rel == wanted or rel.startswith(wanted + "/") or fnmatch.fnmatch(rel, wanted)
            if p.is_file() and ".git" not in p.parts and inside and p.suffix.lower() in set(suffixes):
                files[f"{shown}/{rel}"] = p.read_bytes()
        return upload(spark, files)
    finally:
        shutil.rmtree(folder, ignore_errors=True)


_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
_RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def read_workbook(content) -> dict[str, list[dict[str, str]]]:
    """All sheets of an xlsx file (a path, or an open file) as rows of trimmed text, found by relationship; blank headings are ``col_i``, sheets with fewer than two rows empty."""
    with zipfile.ZipFile(content) as z:
        names = set(z.namelist())
        shared = ["".join(t.text or "" for t in si.iter(f"{{{_NS['m']}}}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
        book = ElementTree.fromstring(z.read("xl/workbook.xml"))
        parts = {x.get("Id"): x.get("Target", "") for x in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        out = {}
        for sheet in book.find("m:sheets", _NS):
            target = parts.get(sheet.get(_RELATION), "")
            part = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
            if part not in names or "chartsheets" in part:
                out[sheet.get("name")] = []
                continue
            rows = []
            for row in ElementTree.fromstring(z.read(part)).iter(f"{{{_NS['m']}}}row"):
                cells: dict[int, str] = {}
                for c in row:
                    letters = re.match(r"[A-Z]+", c.get("r", "")) or re.match("A", "A")
                    at = 0
                    for x in letters[0]:
                        at = at * 26 + ord(x) - 64
                    text = "".join(t.text or "" for t in c.iter(f"{{{_NS['m']}}}t")) or next((v.text or "" for v in c.iter(f"{{{_NS['m']}}}v")), "")
                    cells[at] = (shared[int(text)] if c.get("t") == "s" and text else text).strip()
                rows.append(cells)
            if len(rows) < 2:
                out[sheet.get("name")] = []
                continue
            width = max(max(r, default=0) for r in rows)
            heads = [rows[0].get(i) or f"col_{i - 1}" for i in range(1, width + 1)]
            out[sheet.get("name")] = [{h: r.get(i, "") for i, h in enumerate(heads, 1)} for r in rows[1:]]
    return out


def workbook_rows(books: DataFrame) -> DataFrame:
    """Rows of all sheets of workbooks (path, content): ``path, sheet, row, cells map<string,string>``; a broken book has none."""
    from ..shipping import ship

    ship(books.sparkSession)

    def run(batches):
        import io

        import pyarrow as pa

        schema = pa.schema([("path", pa.string()), ("sheet", pa.string()), ("row", pa.int64()), ("cells", pa.map_(pa.string(), pa.string()))])
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    book = read_workbook(io.BytesIO(content or b""))
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
                    continue
                rows = [(path, sheet, k, list(r.items())) for sheet, found in book.items() for k, r in enumerate(found)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return books.select("path", "content").mapInArrow(run, "path string, sheet string, row long, cells map<string,string>")
