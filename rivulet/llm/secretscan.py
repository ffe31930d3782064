r"""Secrets in documents: plain rules, and automata learnt from labelled credentials.

The rules find assignments, access keys and long hexadecimal runs. Besides, for each labelled format a prefix tree is
built from its examples and its states are merged where their outgoing frequencies agree within a Hoeffding bound
(ALERGIA). From every place where a format's literal start stands (a format without one: from every part of a run of
credential characters) its automaton reads on, and the longest match whose likelihood reaches the level which the labelled
examples themselves reach is added as a span of kind ``format``, unless a rule's span holds it. The automaton alone decides
on lengths: fixed ones become chains of states, varying ones loops.

Likelihoods are of classes of characters (digits, a-f, g-z, A-F, G-Z, each mark by itself), except that up to ``PREFIX``
common first characters of a format stand for themselves. Null texts count as empty. Every text is scanned whole; offsets are code
points, ends exclusive. Rows are scanned one by one, so repeated rows need no rule; an empty table gives an empty one;
other columns pass through ``redact`` untouched.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import column_name, id_text, replace_column, ship, take_over

KINDS = ("assign", "access", "hex")
ADDED = "format"
_assign = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
_access = re.compile(r"AKIA[A-Z0-9]{16,}")
_hex = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
#: Runs of credential characters; a format without a literal start may begin at any of their parts.
_run = re.compile(r"[A-Za-z0-9_+/=.-]{20,}")
_part = re.compile(r"[A-Za-z0-9]+")
PREFIX = 8
#: Most labelled examples for each format that an automaton is fitted on.
MAX_EXAMPLES = 400


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place in ``KINDS``, end) of the rules' matches, sorted."""
    out = [(m.start(), 0, m.end()) for m in _assign.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _access.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in _hex.finditer(text)]
    return sorted(out)


def symbol(c: str) -> str:
    if not c.isascii():
        return c
    if c.isdigit():
        return "9"
    if "a" <= c <= "f":
        return "a"
    if "A" <= c <= "F":
        return "A"
    return "z" if c.islower() else "Z" if c.isupper() else c


_SIZE = {"9": 10, "a": 6, "A": 6, "z": 20, "Z": 20}


class Automaton:
    """A probabilistic deterministic automaton by ALERGIA; ``alpha`` is the bound's chance of a wrong refusal.

    Steps are the characters of the format's literal start, marks that every example has equally often (they separate
    parts), and ``x`` for all else; each state also counts the classes of the characters that its ``x`` stood for.
    """

    def __init__(self, examples: list[str], alpha: float = 0.05, slack: float = 0.35):
        self.prefix = _common_prefix(examples)[:PREFIX]
        rests = [x[len(self.prefix) :] for x in examples]
        self.marks = {c for c in set("".join(rests)) if not c.isalnum() and len({x.count(c) for x in rests}) == 1}
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        self.next: list[dict[str, int]] = [{}]
        self.count: list[dict[str, int]] = [defaultdict(int)]
        self.kinds: list[dict[str, int]] = [defaultdict(int)]
        self.ends: list[int] = [0]
        for x in examples:
            self._add(x)
        self._merge()
        self.examples = len(examples)
        seen: dict[str, int] = defaultdict(int)
        for kinds in self.kinds:
            for k, c in kinds.items():
                seen[k] += c
        self.share = {k: c / sum(seen.values()) for k, c in seen.items()}
        self.level = min(self.score(x) for x in examples) - slack

    def _step(self, c: str, i: int) -> str:
        return "=" + c if i < len(self.prefix) else c if c in self.marks else "x"

    def _add(self, x: str) -> None:
        q = 0
        for i, c in enumerate(x):
            a = self._step(c, i)
            self.count[q][a] += 1
            if a == "x":
                self.kinds[q][symbol(c)] += 1
            if a not in self.next[q]:
                self.next[q][a] = len(self.next)
                self.next.append({})
                self.count.append(defaultdict(int))
                self.kinds.append(defaultdict(int))
                self.ends.append(0)
            q = self.next[q][a]
        self.ends[q] += 1

    def _total(self, q: int) -> int:
        return self.ends[q] + sum(self.count[q].values())

    def _compatible(self, a: int, b: int) -> bool:
        todo, seen = [(a, b)], {(a, b)}
        while todo:
            a, b = todo.pop()
            n, m = self._total(a), self._total(b)
            if a == b or not n or not m or (most := self.bound * (n**-0.5 + m**-0.5)) >= 1:
                continue  # too few to differ, here and (as ``b`` is a tree) below
            if abs(self.ends[a] / n - self.ends[b] / m) > most:
                return False
            for f, g in ((self.count[a], self.count[b]), (self.kinds[a], self.kinds[b])):
                if any(abs(f.get(s, 0) / n - g.get(s, 0) / m) > most for s in {*f, *g}):
                    return False
            for s, t in self.next[b].items():
                if s in self.next[a] and (pair := (self.next[a][s], t)) not in seen:
                    seen.add(pair)
                    todo.append(pair)
        return True

    def _fold(self, red: int, blue: int) -> None:
        """Pour the tree below ``blue`` into ``red``."""
        todo = [(red, blue)]
        while todo:
            a, b = todo.pop()
            self.ends[a] += self.ends[b]
            for f, g in ((self.count[a], self.count[b]), (self.kinds[a], self.kinds[b])):
                for s, c in g.items():
                    f[s] += c
            for s, q in self.next[b].items():
                if s in self.next[a]:
                    todo.append((self.next[a][s], q))
                else:
                    self.next[a][s] = q

    def _merge(self) -> None:
        red = [0]
        while True:
            blue = [(q, s, t) for q in red for s, t in self.next[q].items() if t not in red]
            if not blue:
                break
            q, s, t = min(blue, key=lambda x: (-self._total(x[2]), x))
            into = None if s.startswith("=") else next((r for r in red if not any(k.startswith("=") for k in self.next[r]) and self._compatible(r, t)), None)
            if into is None:
                red.append(t)
            else:
                self.next[q][s] = into
                self._fold(into, t)
        place = {q: k for k, q in enumerate(red)}  # what was folded is left out
        self.next = [{s: place[t] for s, t in self.next[q].items()} for q in red]
        self.count = [dict(self.count[q]) for q in red]
        self.kinds = [dict(self.kinds[q]) for q in red]
        self.ends = [self.ends[q] for q in red]
        self.totals = [self._total(k) for k in range(len(red))]

    def _walk(self, text: str, at: int, dead: set[tuple[int, int]] | None = None):
        """(end, mean log-likelihood of a character) of every start of ``text[at:]`` that the automaton may end at.

        ``dead`` keeps places from which no end is reached, so that starts which run into each other cost one walk.
        """
        q, total, path, ended = 0, 0.0, [], False
        for i in range(at, len(text) + 1):
            if dead is not None:
                if (i, q) in dead:
                    break
                path.append((i, q))
            n = self.totals[q]
            if self.ends[q]:
                ended = True
                path.clear()
                yield i, (total + math.log(self.ends[q] / n)) / max(1, i - at)
            if i == len(text):
                break
            c = text[i]
            a = self._step(c, i - at)
            if a not in self.next[q]:
                break
            f = self.count[q][a] / n
            if a == "x":
                k = symbol(c)
                if k not in self.share:
                    break
                f *= (self.kinds[q].get(k, 0) + self.share[k]) / (self.count[q][a] + 1) / _SIZE.get(k, 1)
            total += math.log(f)
            q = self.next[q][a]
        if dead is not None and not ended:
            dead.update(path)

    def score(self, x: str) -> float:
        """Mean log-likelihood of a character, the end included; -9 where the automaton can't end there."""
        return next((v for i, v in self._walk(x, 0) if i == len(x)), -9.0)

    def accepts(self, x: str) -> bool:
        return self.score(x) >= self.level

    def longest(self, text: str, at: int, dead: set[tuple[int, int]]) -> int | None:
        """Where the longest accepted match from ``at`` ends; without a literal start it must end with a part."""
        found = [i for i, v in self._walk(text, at, dead) if v >= self.level and (self.prefix or not (i < len(text) and _part.match(text[i])))]
        return found[-1] if found else None


def _common_prefix(xs: list[str]) -> str:
    a, b = min(xs), max(xs)
    k = next((k for k, (c, d) in enumerate(zip(a, b, strict=False)) if c != d), min(len(a), len(b)))
    return re.match(r"[A-Za-z_-]*", a[:k])[0]


_LOW, _UP, _NUM = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"


def labelled_credentials(n: int = MAX_EXAMPLES, seed: int = 42) -> dict[str, list[str]]:
    """Labelled examples of publicly documented formats, drawn by rule with a fixed seed."""
    r = random.Random(seed)
    run = lambda alphabet, k: "".join(r.choice(alphabet) for _ in range(k))
    more = lambda least, mean: least + int(r.expovariate(1 / mean))
    url = _LOW + _UP + _NUM + "_-"
    rules = {
        "forge": lambda: "ghp_" + run(_LOW + _UP + _NUM, 36),
        "chat": lambda: f"xoxb-{run(_NUM, r.randint(10, 13))}-{run(_NUM, r.randint(10, 13))}-{run(_LOW + _UP + _NUM, 24)}",
        "payment": lambda: "sk_live_" + run(_LOW + _UP + _NUM, r.choice((24, 99))),
        "web": lambda: "AIza" + run(url, 35),
        "uuid": lambda: "-".join(run("0123456789abcdef", k) for k in (8, 4, 4, 4, 12)),
        "signed": lambda: ".".join(["eyJ" + run(_LOW + _UP + _NUM, more(17, 30)), "eyJ" + run(url, more(20, 150)), run(url, more(43, 80))]),
    }
    return {k: sorted({f() for _ in range(n)}) for k, f in rules.items()}


def learn(labelled: dict[str, list[str]]) -> dict[str, Automaton]:
    """An automaton for each label; of more than ``MAX_EXAMPLES`` those of least hash are used."""
    least = lambda xs: sorted(set(xs), key=lambda x: hashlib.sha256(x.encode()).digest())[:MAX_EXAMPLES]
    return {k: Automaton(least(xs)) for k, xs in sorted(labelled.items()) if xs}


def labelled_rows(rows: DataFrame, label_col: str = "label", text_col: str = "text") -> dict[str, list[str]]:
    """Labelled examples from a table: of each label the ``MAX_EXAMPLES`` different ones of least hash. Nulls are left out."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    found = rows.select(F.col(label_col).cast("string").alias("label"), F.col(text_col).alias("x")).where("label IS NOT NULL AND x <> ''").distinct()
    # A label's examples are cut down in groups first, so that no task sorts a label with very many.
    for part in (F.pmod(F.xxhash64("x"), F.lit(256)), F.lit(0)):
        w = Window.partitionBy("label", part).orderBy(F.sha2("x", 256))
        found = found.withColumn("n", F.row_number().over(w)).where(F.col("n") <= MAX_EXAMPLES).drop("n")
    out: dict[str, list[str]] = defaultdict(list)
    for r in found.toLocalIterator():
        out[r.label].append(r.x)
    return {k: sorted(v) for k, v in sorted(out.items())}


def _starts(text: str, prefix: str):
    """Where a format may begin: at its literal start, wherever that is; without one at each part of a run."""
    if prefix:
        at = text.find(prefix)
        while at >= 0:
            yield at
            at = text.find(prefix, at + 1)
    else:
        for m in _run.finditer(text):
            for p in _part.finditer(text, *m.span()):
                yield p.start()


def scan(text: str, automata: dict[str, Automaton]) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """The rules' spans, and all spans, as (start, place of the kind, end); ``format`` comes after ``KINDS``."""
    base = base_spans(text)
    found = []
    for x in automata.values():
        dead: set[tuple[int, int]] = set()
        upto = 0
        for a in _starts(text, x.prefix):
            if a >= upto and (b := x.longest(text, a, dead)) is not None:
                found.append((a, b))
                upto = b
    more, upto, k, held = [], 0, 0, 0
    for a, b in sorted(found, key=lambda f: (f[0], -f[1])):
        while k < len(base) and base[k][0] <= a:  # ``held``: how far the rules' spans that begin by here reach
            held = max(held, base[k][2])
            k += 1
        if b > upto and b > held:
            more.append((a, len(KINDS), b))
            upto = b
    return base, sorted(base + more)


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{(*KINDS, ADDED)[k]}:{a}:{b}" for a, k, b in spans)


def find(df: DataFrame, labelled: dict[str, list[str]] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, the number of spans of each kind, a digest of the rules' spans and all spans."""
    spark = df.sparkSession
    ship(spark)
    model = spark.sparkContext.broadcast(learn(labelled or labelled_credentials()))
    names = ["doc_id", "n_assign", "n_access", "n_hex", "n_format", "base_sha256", "spans"]

    def run(batches):
        take_over("secrets")
        automata = model.value
        for b in batches:
            found = [scan(x, automata) for x in b.column(1).to_pylist()]
            counts = [pa.array([sum(s[1] == k for s in spans) for _, spans in found], pa.int64()) for k in range(len(KINDS) + 1)]
            digests = pa.array([hashlib.sha256(written(base).encode()).hexdigest() for base, _ in found], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), *counts, digests, pa.array([written(x) for _, x in found], pa.string())], names)

    return id_text(df, id_col, text_col).mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, n_format long, base_sha256 string, spans string")


def redacted(text: str, spans: list[tuple[int, int, int]], mark: str = "[SECRET]") -> str:
    """The text with every run of overlapping spans replaced by ``mark``."""
    out, at = [], 0
    for a, _, b in spans:
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join(out) + text[at:]


def redact(df: DataFrame, labelled: dict[str, list[str]] | None = None, text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """All documents, secrets replaced; all other columns as they are (``chars_col`` recounted). Null texts stay null."""
    spark = df.sparkSession
    ship(spark)
    model = spark.sparkContext.broadcast(learn(labelled or labelled_credentials()))
    text_col, chars_col = column_name(df, text_col), chars_col and column_name(df, chars_col)
    names = df.columns

    def run(batches):
        take_over("secrets")
        automata = model.value
        for b in batches:
            texts = [x if x is None else redacted(x, scan(x, automata)[1]) for x in b.column(names.index(text_col)).to_pylist()]
            b = replace_column(b, text_col, pa.array(texts, pa.string()))
            if chars_col in names:
                b = replace_column(b, chars_col, pa.array([x if x is None else len(x) for x in texts], pa.int64()))
            yield b

    return df.mapInArrow(run, df.schema)
