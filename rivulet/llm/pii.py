r"""Personal data in documents, with DataFrame expressions only.

Regular expressions propose spans; checksums (Luhn, mod 97) and ranges confirm them; words nearby raise the score. The
base kinds are email, ip, card and phone, and stay whatever their score. Added kinds stay from ``KEEP`` upwards: iban
(mod 97), national (needs a word nearby) and local_phone (needs a word nearby).

``regexp_extract_all`` gives the matches and ``split`` what lies between them, so running sums of their lengths give the
offsets (code points, ends exclusive). Null texts count as empty. Rows are scanned one by one, so repeated rows and ties
need no rule; an empty table gives an empty one; other columns play no part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text

BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "national", "local_phone")
KEEP = 0.6
NEAR = 40
#: A match can begin where the last one ended or after a character that it couldn't have begun with: the same matches,
#: without a try from each character of a long run. Possessive groups keep Java's matcher from recursing.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])",
    "national": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "local_phone": r"(?<![0-9A-Za-z+()-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[.-][0-9]{4}(?![0-9A-Za-z-])",
}
#: A quick test that a text without any match fails.
_HINT = {"email": "instr(text, '@') > 0", "phone": "instr(text, '+') > 0", "card": r"text rlike '[0-9](?:[\\x20-]?[0-9]){11}'", "ip": r"text rlike '[0-9]\\.[0-9]'", "iban": r"text rlike '[A-Z]{2}[0-9]{2}'",
         "national": r"text rlike '-[0-9]{2}-[0-9]{4}'", "local_phone": r"text rlike '[0-9]{3}[.-][0-9]{4}'"}
_DIGITS = "regexp_replace(m, '[^0-9]', '')"
_LUHN = """aggregate(sequence(1, length(d)), 0, (s, i) -> s + CASE WHEN i % 2 = 1 THEN cast(substring(d, length(d) + 1 - i, 1) AS int)
  WHEN cast(substring(d, length(d) + 1 - i, 1) AS int) > 4 THEN 2 * cast(substring(d, length(d) + 1 - i, 1) AS int) - 9
  ELSE 2 * cast(substring(d, length(d) + 1 - i, 1) AS int) END) % 10 = 0"""
_MOD97 = """aggregate(sequence(1, length(d)), 0, (r, i) -> CASE WHEN substring(d, i, 1) BETWEEN '0' AND '9' THEN (r * 10 + ascii(substring(d, i, 1)) - 48) % 97
  ELSE (r * 100 + ascii(substring(d, i, 1)) - 55) % 97 END) = 1"""
_with_digits = lambda digits, test: f"exists(array({digits}), d -> {test})"
_CHECK = {
    "email": "true",
    "ip": "forall(split(m, '[.]'), p -> length(trim(LEADING '0' FROM p)) <= 3 AND coalesce(try_cast(trim(LEADING '0' FROM p) AS int), 0) <= 255)",
    "card": _with_digits(_DIGITS, f"length(d) BETWEEN 12 AND 19 AND {_LUHN}"),
    "phone": _with_digits(_DIGITS, "length(d) BETWEEN 9 AND 15"),
    "iban": _with_digits("concat(substring(replace(m, ' ', ''), 5), substring(replace(m, ' ', ''), 1, 4))", f"length(d) BETWEEN 15 AND 34 AND {_MOD97}"),
    "national": "substring(m, 1, 3) NOT IN ('000', '666') AND substring(m, 1, 1) <> '9' AND substring(m, 5, 2) <> '00' AND substring(m, 8) <> '0000'",
    "local_phone": _with_digits(_DIGITS, "length(d) = 10"),
}
#: Score of a confirmed span, and words nearby that raise it by 0.3.
_SCORE = {
    "email": (0.7, r"e-?mail|contact|write|mailto|courriel|correo"),
    "ip": (0.5, r"\bip\b|address|host|server|adresse|direcci"),
    "card": (0.7, r"card|visa|master|amex|credit|debit|carte|karte|tarjeta"),
    "phone": (0.6, r"phone|tel|call|mobile|fax|telefon|appel"),
    "iban": (0.7, r"iban|bank|account|konto|compte|cuenta"),
    "national": (0.3, r"\bssn\b|social security|national id|taxpayer"),
    "local_phone": (0.3, r"phone|\btel\b|\bcall\b|mobile|\bfax\b"),
}


def _spans(kind: str) -> str:
    """SQL for ``array<struct<start, rank, end, kind, score>>`` of one kind, over the columns ``text`` and ``m_KIND``."""
    rank, (score, words) = (*BASE, *ADDED).index(kind), _SCORE[kind]
    pattern, words = PATTERNS[kind].replace("\\", "\\\\"), words.replace("\\", "\\\\")
    parts = f"zip_with(split(text, '{pattern}', -1), m_{kind}, (g, m) -> struct(length(g) AS g, coalesce(length(m), 0) AS n, m IS NOT NULL AND coalesce({_CHECK[kind]}, false) AS ok))"
    placed = f"""aggregate({parts}, struct(0 AS at, cast(array() AS array<struct<a:int,b:int>>) AS found),
      (s, x) -> struct(s.at + x.g + x.n AS at, CASE WHEN x.ok THEN concat(s.found, array(struct(s.at + x.g AS a, s.at + x.g + x.n AS b))) ELSE s.found END AS found)).found"""
    near = f"lower(concat(substring(text, greatest(1, f.a - {NEAR} + 1), least(f.a, {NEAR})), ' ', substring(text, f.b + 1, {NEAR}))) rlike '{words}'"
    return f"""CASE WHEN size(m_{kind}) > 0 THEN transform({placed},
      f -> struct(f.a AS start, {rank} AS rank, f.b AS end, '{kind}' AS kind, {score}D + CASE WHEN {near} THEN 0.3D ELSE 0D END AS score))
      ELSE cast(array() AS array<struct<start:int,rank:int,end:int,kind:string,score:double>>) END"""


def detect(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``base`` and ``pii``: arrays of (start, rank, end, kind, score), sorted; ``pii`` has the added kinds too."""
    rows = id_text(df, id_col, text_col)
    quoted = {k: p.replace("\\", "\\\\") for k, p in PATTERNS.items()}
    found = rows.selectExpr("doc_id", "text", *(f"CASE WHEN {_HINT[k]} THEN regexp_extract_all(text, '{p}', 0) ELSE cast(array() AS array<string>) END AS m_{k}" for k, p in quoted.items()))
    spans = found.selectExpr("doc_id", *(f"{_spans(k)} AS s_{k}" for k in PATTERNS))
    spans = spans.selectExpr("doc_id", f"array_sort(concat({', '.join('s_' + k for k in BASE)})) AS base",
                             f"filter(concat({', '.join('s_' + k for k in ADDED)}), s -> s.score >= {KEEP - 1e-9}D) AS added")
    return spans.selectExpr("doc_id", "base", "CASE WHEN size(added) = 0 THEN base ELSE array_sort(concat(base, added)) END AS pii")


def digest(found: DataFrame) -> DataFrame:
    written = lambda c: f"array_join(transform({c}, s -> concat(s.kind, ':', s.start, ':', s.end)), ',')"
    counts = [f"cast(size(filter(base, s -> s.kind = '{k}')) AS bigint) AS n_{k}" for k in BASE]
    return found.selectExpr("doc_id", *counts, f"sha2({written('base')}, 256) AS base_sha256", f"{written('pii')} AS spans", "coalesce(array_max(transform(pii, s -> s.score)), 0D) AS top_score")
