r"""Line-first cleaning of documents.

Every ``\n``-separated line with a word is judged alone: navigation, symbols, shouting, repetition, boilerplate, repeated
lines and want of punctuation make it fail. Failing lines go; a document that loses too large a share of its words goes
as a whole, and so does one that fails the base limits (too few words, or too many in repeated eight-word windows).

Null and empty texts have no word and are rejected. All counts run over the whole text. Rows are judged one by one, so
repeated rows and ties need no rule; an empty table gives an empty one; other columns pass through ``clean`` untouched.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import column_name, id_text, ngram_hashes, replace_column, ship, take_over, word_hashes

WINDOW, MIN_WORDS, MAX_REPEAT_PCT = 8, 20, 30
#: Least share of a document's words in lines that stay.
MIN_LEFT = 0.5
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
SYMBOLS = "#*$%&|<>"
#: A word, wherever words are counted.
_words = re.compile(r"[^\x20\x09-\x0D]+").findall
_boilerplate = re.compile(
    r"all rights reserved|\b(?:licen[sc]ed|released|distributed) under\b|\bcopyright (?:©|\(c\)|\d{4})|\bcookies?\b.*\b(?:accept|policy|consent)"
    r"|\bprivacy policy\b|\bterms (?:of (?:use|service)|and conditions)\b|\bsubscribe (?:now|to)\b|\bclick here\b|\bsign (?:in|up) (?:to|for|now)\b|\benable javascript\b|\blorem ipsum\b"
    r"|tous droits réservés|politique de confidentialité|\bcliquez ici\b|\babonnez-vous\b|alle rechte vorbehalten|datenschutzerklärung|\bhier klicken\b|\bjetzt abonnieren\b"
    r"|todos los derechos reservados|política de privacidad|\bhaga clic aquí\b|\bsuscríbase\b",
    re.I | re.A,
)
_sentence = re.compile(r"[.!?;:,。！？؟…]")


def line_fails(line: str) -> str | None:
    """The first rule that a line with at least one word fails."""
    words = _words(line)
    n = len(words)
    if n <= 25 and _boilerplate.search(line):
        return "boilerplate"
    if line.count("|") >= max(2, 0.15 * n):
        return "navigation"
    if sum(map(line.count, SYMBOLS)) > 0.6 * n and n >= 3:
        return "symbols"
    if line.count("!!") > 0.3 * n and n >= 3:
        return "shouting"
    if n >= 4 and sum(map(str.isupper, words)) > 0.6 * n:
        return "shouting"
    if n >= 10 and len(set(words)) < 0.35 * n and (sum(a == b for a, b in zip(words, words[1:], strict=False)) > 0.3 * n or len(set(words)) < 0.1 * n):
        return "repetition"
    if n > 15 and not _sentence.search(line):
        return "punctuation"
    return None


def repeat_words(raw: bytes, n: int = WINDOW) -> int:
    """Words in ``n``-word windows that occur twice or more; hashes find candidates, the words themselves decide."""
    start, end, h = word_hashes(raw)
    g = ngram_hashes(h, n)
    if len(g) < 2:
        return 0
    order = np.argsort(g, kind="stable")
    same = np.flatnonzero(g[order][1:] == g[order][:-1])
    if not len(same):
        return 0
    at = np.unique(np.concatenate([order[same], order[same + 1]]))
    # Words may be parted by any white space, so windows are compared as words.
    words = {k: raw[start[k] : end[k]] for k in np.unique(np.concatenate([at + j for j in range(n)])).tolist()}
    groups: dict[tuple, list[int]] = {}
    for k in at.tolist():
        groups.setdefault(tuple(words[k + j] for j in range(n)), []).append(k)
    edge = np.zeros(len(start) + 1, np.int64)
    for places in groups.values():
        if len(places) > 1:
            np.add.at(edge, places, 1)
            np.add.at(edge, np.array(places) + n, -1)
    return int((np.cumsum(edge) > 0).sum())


def judge(text: str) -> dict:
    """Counts, verdict and cleaned text of one document."""
    raw = text.encode()
    n_words = len(raw.split())
    seen: set[str] = set()
    left, lines, dup = 0, [], 0
    for line in text.split("\n"):
        words = line.encode().split()
        repeated = line in seen
        seen.add(line)
        if not words:
            lines.append(line)
            continue
        dup += repeated
        if repeated or line_fails(line):
            continue
        left += len(words)
        lines.append(line)
    n_repeat = repeat_words(raw)
    base_failed = n_words < MIN_WORDS or 100 * n_repeat > MAX_REPEAT_PCT * n_words
    return {"n_words": n_words, "word_chars": len(text) - sum(map(text.count, SPACE)), "n_symbols": sum(map(text.count, SYMBOLS)), "n_dup_lines": dup, "n_repeat_words": n_repeat,
            "base_failed": base_failed, "kept": not base_failed and left >= MIN_LEFT * n_words, "kept_words": left, "clean": "\n".join(lines)}


COLUMNS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, kept_words long"


def assess(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` with counts and verdict of every document."""
    ship(df.sparkSession)
    schema = f"doc_id long, {COLUMNS}"
    names = [x.split()[0] for x in COLUMNS.split(", ")]

    def run(batches):
        take_over("quality")
        for b in batches:
            for i in range(0, b.num_rows, 500):
                part = b.slice(i, 500)
                rows = [judge(x) for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array([r[k] for r in rows]) for k in names)], ["doc_id", *names])

    return id_text(df, id_col, text_col).mapInArrow(run, schema)


def clean(df: DataFrame, text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """The documents that stay, with their failing lines removed; all other columns as they are (``chars_col`` recounted)."""
    ship(df.sparkSession)
    text_col, chars_col = column_name(df, text_col), chars_col and column_name(df, chars_col)
    names = df.columns

    def run(batches):
        take_over("quality")
        for b in batches:
            for i in range(0, b.num_rows, 500):
                part = b.slice(i, 500)
                rows = [judge(x or "") for x in part.column(names.index(text_col)).to_pylist()]
                keep = [r["kept"] for r in rows]
                part = part.filter(pa.array(keep, pa.bool_()))
                texts = [r["clean"] for r in rows if r["kept"]]
                part = replace_column(part, text_col, pa.array(texts, pa.string()))
                if chars_col in names:
                    part = replace_column(part, chars_col, pa.array([len(x) for x in texts], pa.int64()))
                yield part

    return df.mapInArrow(run, df.schema)
