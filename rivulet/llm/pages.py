r"""Main text of web pages by wrappers that are inferred for each host.

A page's token stream (tags, texts) is read into nested elements, tolerantly: comments, scripts and styles are skipped,
paragraphs, list items and the like end where the next one begins, stray end tags are ignored. A wrapper is a union-free
regular expression over such streams. It starts as one of a host's pages and is aligned with all others:
where elements agree they are one; where one side has more of the same, alone or as a group in turn, they become a
repeated group; what only one side has becomes optional; texts that differ become slots.

From the wrapper follow the elements that hold the articles (markup is a hint to them) and those that are links or the same
text on most pages. A page's text is that of the elements in the wrapper's places, less what the wrapper finds boring and less menus, forms, adverts, notices, sidebars, comments and the like. Blocks are trimmed, white space in them is one
space, and they are joined by one space in page order.

Pages of a host are grouped by ``template``, and a wrapper is fitted for each template on all its pages, copies aside; every
page is extracted from its whole html. Pages of one shape (the same expression but for texts and counts) are added up, in any
order and in each task already; what is aligned, in order of a hash, are the different shapes: first in ``SALT`` groups of a template's, then those
groups, so one task holds a wrapper or two and never a host's pages. Null and empty html give an empty
text, null urls a host of their own. Repeated rows give repeated rows. An empty table gives an empty one. Other columns
play no part.
"""

from __future__ import annotations

import functools
import html as entities
import json
import re
import sys

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, ship

#: The greatest size of all wrappers that is broadcast; groups in which a template's shapes are aligned; shapes that a task adds
#: up before it hands them on.
BROADCAST_BYTES = 64 << 20
SALT = 64
SHAPES = 5_000
#: Elements nested deeper stand beside each other, as in browsers.
DEPTH = 400

_lead = re.compile(r"<(?:(?P<comment>!--)|(?P<cdata>!\[CDATA\[)|(?P<other>[!?])|(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*))")
_stop = re.compile(r"[>\"']")
_attr = re.compile(r"(?<![a-zA-Z-])([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp".split())
BLOCK = frozenset("address article aside blockquote body caption dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup html li main nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
#: Elements that a new one ends.
_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main nav ol p pre section table ul".split())
ENDS = {"li": ("li", {"ul", "ol"}), "dt": ("dt dd", {"dl"}), "dd": ("dt dd", {"dl"}), "tr": ("tr td th", {"table"}), "td": ("td th", {"tr", "table"}), "th": ("td th", {"tr", "table"}), "option": ("option", {"select"})}
NEVER = frozenset("head script style noscript template svg iframe object nav footer aside form button select textarea input dialog canvas audio video".split())
ROOT = frozenset("article main".split())
_marks = frozenset(
    "ad ads advert advertisement adsbygoogle banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer masthead menu modal nav navbar navigation newsletter notice pagination paywall popup promo promoted related respond share sharing sidebar social sponsor sponsored subscribe toolbar widget".split()
)
_roles = frozenset("navigation banner contentinfo complementary search form alert dialog menu".split())


class Element:
    __slots__ = ("tag", "sign", "drop", "main", "kids")

    def __init__(self, tag: str, sign: str = "", drop: bool = False, main: bool = False):
        self.tag, self.sign, self.drop, self.main = tag, sign or tag, drop, main
        self.kids: list[Element | str] = []


@functools.lru_cache(20_000)
def _described(tag: str, attrs: str) -> tuple[str, bool, bool]:
    """Signature (tag, classes, id without digits), whether it is no part of an article, whether it is one."""
    a = {k.lower(): v or w or x for k, v, w, x in _attr.findall(attrs)} if "=" in attrs else {}
    names = [re.sub(r"\d+", "", x.lower()) for x in (*a.get("class", "").split(), *a.get("id", "").split())]
    parts = {p for x in names for p in (x, *re.split(r"[-_]+", x))}
    role = a.get("role", "").lower()
    drop = tag in NEVER or role in _roles or bool(parts & _marks) or "hidden" in attrs.lower().split() or re.search(r"display\s*:\s*none", a.get("style", "")) is not None
    main = not drop and (tag in ROOT or role in ("main", "article") or a.get("itemprop") == "articleBody")
    return ".".join([tag, *sorted(set(filter(None, names)))[:4]]), drop, main


class Markup:
    """Finds the markup of one text, in time linear in the text, unclosed quotes and tags included."""

    def __init__(self, text: str):
        self.text = text
        #: Of a quote that opens in a tag: where the tag ends, -1 if nowhere.
        self.ends: dict[int, int] = {}
        self.ahead = -1

    def _next(self, at: int) -> int:
        m = _stop.search(self.text, at)
        return m.start() if m else len(self.text)

    def tag_end(self, at: int) -> int:
        """Where the tag ends whose attributes begin here: at the first ``>`` outside of quotes, -1 if there is none."""
        text, path, end = self.text, [], -1
        if self.ahead < at:  # calls go forward, so the next mark is looked up once
            self.ahead = self._next(at)
        k = self.ahead
        while k < len(text):
            if text[k] == ">" or k in self.ends:
                end = self.ends.get(k, k)
                break
            path.append(k)
            close = text.find(text[k], k + 1)
            if close < 0:
                break
            k = self._next(close + 1)
        self.ends.update(dict.fromkeys(path, end))
        return end

    def next(self, at: int):
        """Begin and end of the first markup from here on, and what it is: (is an end tag, tag, attributes, character data)."""
        text = self.text
        look = at
        while m := _lead.search(text, look):
            if m["comment"] or m["cdata"]:
                mark = "-->" if m["comment"] else "]]>"
                close = text.find(mark, m.end())
                inner = text[m.end() : close if close >= 0 else len(text)]
                return m.start(), close + 3 if close >= 0 else len(text), (False, None, "", inner if m["cdata"] else None)
            if m["other"]:
                close = text.find(">", m.end())
                if close < 0:
                    return None
                return m.start(), close + 1, (False, None, "", None)
            end = self.tag_end(m.end())
            if end >= 0:
                return m.start(), end + 1, (bool(m["end"]), m["tag"].lower(), text[m.end() : end], None)
            look = m.end()
        return None


def parse(text: str) -> Element:
    """The page as nested elements; texts are left as they are written, character references included."""
    top = Element("#page")
    stack, at, n = [top], 0, len(text)
    markup = Markup(text)
    while at < n:
        found = markup.next(at)
        if found is None:
            stack[-1].kids.append(text[at:])
            break
        begin, stop, (closing, tag, attrs, data) = found
        if begin > at:
            stack[-1].kids.append(text[at:begin])
        at = stop
        if tag is None:
            if data:
                stack[-1].kids.append(entities.escape(data))
            continue
        if closing:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
                if stack[k].tag in ("article", "body", "table", "main") and tag in ("p", "b", "i", "a", "span", "em", "strong", "li"):
                    break
            continue
        if tag in _P and (open_ := [k for k in range(1, len(stack)) if stack[k].tag == "p"]):
            del stack[open_[0] :]
        elif tag in ENDS:
            names, limits = ENDS[tag]
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in limits:
                    break
                if stack[k].tag in names.split():
                    del stack[k:]
                    if tag not in ("tr",):
                        break
        e = Element(tag, *_described(tag, attrs))
        stack[-1].kids.append(e)
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}", re.I).search(text, at)
            if close and (stop := text.find(">", close.end())) < 0:
                close = None
            if tag in ("textarea", "title"):
                e.kids.append(text[at : close.start() if close else n])
            at = stop + 1 if close else n
        elif tag not in VOID and not attrs.rstrip().endswith("/") and len(stack) < DEPTH:
            stack.append(e)
    return top


# --- wrappers: [signature, pages, optional, repeated, characters, characters in links, the one text or None, children]

SIGN, PAGES, OPTIONAL, REPEATED, CHARS, LINKED, TEXT, KIDS = range(8)


def expression(e: Element, linked: bool = False) -> list:
    """The wrapper that fits this element alone."""
    kids, chars, in_links = [], 0, 0
    for x in e.kids:
        if isinstance(x, str):
            if words := " ".join(x.split()):
                kids.append(["#", 1, False, False, len(words), len(words) * linked, _told(words), []])
        elif x.tag not in ("script", "style"):
            kids.append(expression(x, linked or x.tag == "a"))
    for k in kids:
        chars += k[CHARS]
        in_links += k[LINKED]
    return [e.sign, 1, False, False, chars, in_links, None, repeats(kids)]


def _told(words: str) -> str:
    """A text as wrappers hold it: long ones by their beginning and a hash."""
    return words if len(words) <= 64 else f"{words[:40]}#{xxhash.xxh64_hexdigest(words)}"


def shape(node: list) -> str:
    """All of an expression but texts and counts."""
    return f"{node[SIGN]}{'?' * node[OPTIONAL]}{'+' * node[REPEATED]}<{' '.join(map(shape, node[KIDS]))}>"


def _added(a: list, b: list) -> list:
    """Two expressions of one shape as one; the order of such sums does not matter."""
    text = a[TEXT] if a[TEXT] == b[TEXT] else None
    kids = [_added(x, y) for x, y in zip(a[KIDS], b[KIDS], strict=True)]
    return [a[SIGN], a[PAGES] + b[PAGES], a[OPTIONAL], a[REPEATED], a[CHARS] + b[CHARS], a[LINKED] + b[LINKED], text, kids]


def _merge(a: list, b: list, pages: int) -> list:
    """One node for two of the same signature."""
    text = a[TEXT] if a[TEXT] == b[TEXT] else None
    return [a[SIGN], pages, a[OPTIONAL] or b[OPTIONAL], a[REPEATED] or b[REPEATED], a[CHARS] + b[CHARS], a[LINKED] + b[LINKED], text, aligned(a[KIDS], b[KIDS])]


def repeats(kids: list[list]) -> list[list]:
    """Neighbours of one signature, and groups of up to four that come again at once, as repeated groups."""
    out: list[list] = []
    for k in kids:
        if out and out[-1][SIGN] == k[SIGN]:
            optional = out[-1][OPTIONAL] and k[OPTIONAL]
            out[-1] = _merge(out[-1], k, max(out[-1][PAGES], k[PAGES]))
            out[-1][REPEATED], out[-1][OPTIONAL] = True, optional
        else:
            out.append(k)
    for size in (2, 3, 4):
        i, folded = 0, []
        while i < len(out):
            group, j = out[i : i + size], i + size
            while len(group) == size and [x[SIGN] for x in out[j : j + size]] == [x[SIGN] for x in group]:
                group = [_merge(a, b, max(a[PAGES], b[PAGES])) for a, b in zip(group, out[j : j + size], strict=True)]
                j += size
            if j > i + size:
                folded.append([f"({' '.join(x[SIGN] for x in group)})", max(x[PAGES] for x in group), False, True, sum(x[CHARS] for x in group), sum(x[LINKED] for x in group), None, group])
                i = j
            else:
                folded.append(out[i])
                i += 1
        out = folded
    return out


def aligned(a: list[list], b: list[list]) -> list[list]:
    """Two sequences as one: common nodes in order, all else optional."""
    from difflib import SequenceMatcher

    out = []
    for what, i, j, k, m in SequenceMatcher(None, [x[SIGN] for x in a], [x[SIGN] for x in b], autojunk=False).get_opcodes():
        if what == "equal":
            out += [_merge(x, y, x[PAGES] + y[PAGES]) for x, y in zip(a[i:j], b[k:m], strict=True)]
        else:
            out += [[*x[:OPTIONAL], True, *x[REPEATED:]] for x in (*a[i:j], *b[k:m])]
    return repeats(out)


def infer(pages: list[str]) -> dict:
    """The wrapper of some pages: the expression as text, the articles' place, and places of links and standing text."""
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 12 * DEPTH))  # a few calls for each level
    return model(*functools.reduce(together, (part(parse(p)) for p in pages)))


def part(page: Element) -> tuple[list, set[str]]:
    """What one page adds to a wrapper: its expression and the places that are marked up as articles."""
    return expression(page), {path for path, _ in _marked(page)}


def together(a: tuple[list, set[str]], b: tuple[list, set[str]], alike: bool = False) -> tuple[list, set[str]]:
    """What two parts add, whose expressions are of one shape if ``alike``."""
    whole = _added(a[0], b[0]) if alike else _merge(a[0], b[0], a[0][PAGES] + b[0][PAGES])
    return whole, a[1] | b[1]


def model(whole: list, hints: set[str]) -> dict:
    """The wrapper, told from the expression of all pages and the places of their articles."""
    pages = whole[PAGES]
    paths: dict[str, list] = {}

    def walk(node: list, path: str) -> None:
        for k in node[KIDS]:
            if k[SIGN].startswith("("):
                walk(k, path)
            elif k[SIGN] != "#":
                here = f"{path}/{k[SIGN]}"
                old = paths.setdefault(here, [0, 0, True])
                old[0] += k[CHARS]
                old[1] += k[LINKED]
                old[2] &= _standing(k) and 2 * k[PAGES] > pages
                walk(k, here)

    walk(whole, "")
    link = [p for p, (chars, linked, _) in paths.items() if chars and linked > 0.6 * chars and not p_like(p)]
    standing = [p for p, (chars, _, same) in paths.items() if chars and same and pages > 2 and not p_like(p)]
    boring = set(link) | set(standing)
    root, best = "", sum(c - n for p, (c, n, _) in paths.items() if p.count("/") == 1)
    while best:
        kids = [(c - n, p) for p, (c, n, _) in paths.items() if p.rpartition("/")[0] == root and p not in boring]
        top = max(kids, default=(0, ""))
        if top[0] < 0.7 * best or p_like(top[1]):
            break
        best, root = top
    return {"wrapper": written(whole), "root": root, "places": sorted(hints) or [root] * bool(root), "boring": sorted(boring)}


def p_like(path: str) -> bool:
    return path.rpartition("/")[2].partition(".")[0] in ("p", "h1", "h2", "h3", "li", "td", "tr", "blockquote", "pre", "span", "a", "b", "i", "em", "strong")


def _standing(node: list) -> bool:
    """Whether its texts were the same on all pages."""
    return not node[REPEATED] and all(k[TEXT] is not None if k[SIGN] == "#" else _standing(k) for k in node[KIDS])


def written(node: list) -> str:
    """The union-free expression as text: ``( )?`` optional, ``( )+`` repeated, ``#`` a slot."""
    inner = " ".join(map(written, node[KIDS]))
    if node[SIGN] == "#":
        s = "#" if node[TEXT] is None else json.dumps(node[TEXT][:40], ensure_ascii=False)
    else:
        s = inner if node[SIGN].startswith("(") else f"<{node[SIGN]}>{inner}</>"
    return f"({s}){'+' * node[REPEATED]}{'?' * node[OPTIONAL]}" if node[OPTIONAL] or node[REPEATED] else s


def main_text(text: str, wrapper: dict | None = None) -> str:
    """The article's text of one page."""
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 12 * DEPTH))
    page = parse(text)
    boring = frozenset(wrapper["boring"] if wrapper else ())
    places = frozenset(wrapper["places"] if wrapper else ())
    roots = [(path, e) for path, e in _marked(page) if not places or path in places] or _topmost(page, places) or _marked(page) or [("", page)]
    blocks: list[str] = []
    for path, r in roots:
        _collect(r, blocks, path, boring)
    out = " ".join(filter(None, (" ".join(entities.unescape(b).split()) for b in blocks)))
    if out or not boring:
        return out
    return main_text(text, {"places": wrapper["places"], "boring": []})  # all of it stands on the other pages too


def _marked(page: Element) -> list[tuple[str, Element]]:
    """Elements that are marked up as articles, or else as the page's main part, with their paths."""
    roots: list[tuple[str, Element]] = []

    def walk(e: Element, path: str) -> None:
        for k in e.kids:
            if isinstance(k, Element) and not k.drop:
                here = f"{path}/{k.sign}"
                if k.main:
                    roots.append((here, k))
                else:
                    walk(k, here)

    walk(page, "")
    return [x for path, r in roots if r.tag != "article" for x in _articles(r, path)] or roots


def _topmost(e: Element, places: frozenset[str], path: str = "") -> list[tuple[str, Element]]:
    out = []
    for k in e.kids if places else ():
        if isinstance(k, Element):
            here = f"{path}/{k.sign}"
            out += [(here, k)] if here in places else _topmost(k, places, here)
    return out


def _articles(e: Element, path: str) -> list[tuple[str, Element]]:
    """Article elements below an element that is the page's main part; all of its text counts if it has none."""
    out = []
    for k in e.kids:
        if isinstance(k, Element) and not k.drop:
            here = f"{path}/{k.sign}"
            out += [(here, k)] if k.tag == "article" else _articles(k, here)
    return out


def template(page: Element) -> int:
    """A hash of the page's structure: the different paths of its elements outside of running text."""
    paths: set[str] = set()
    todo = [("", page)]
    while todo:
        path, e = todo.pop()
        for k in e.kids:
            if isinstance(k, Element) and k.tag not in RAW and k.tag not in VOID:
                here = f"{path}/{k.sign}"
                if not p_like(here):
                    paths.add(here)
                    todo.append((here, k))
    return xxhash.xxh64_intdigest("\n".join(sorted(paths))) - (1 << 63)


def _collect(root: Element, blocks: list[str], path: str, boring: frozenset[str]) -> None:
    """Texts between the edges of block elements, without a recursion."""
    buffer: list[str] = []
    todo: list[tuple[Element | str | None, str]] = [(k, path) for k in reversed(root.kids)]
    while todo:
        x, at = todo.pop()
        if x is None:
            blocks.append("".join(buffer))
            buffer.clear()
        elif isinstance(x, str):
            buffer.append(x)
        elif x.tag == "br":
            buffer.append("\n")
        else:
            here = f"{at}/{x.sign}" if boring else ""
            if x.drop or (boring and here in boring):
                continue
            edge = x.tag in BLOCK
            if edge:
                todo.append((None, ""))
            todo += [(k, here) for k in reversed(x.kids)]
            if edge:
                todo.append((None, ""))
    blocks.append("".join(buffer))


# --- over the cluster


def _host(url_col: str):
    return F.coalesce(F.lower(F.regexp_extract(F.col(url_col), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


_PARTS = "host string, template long, salt long, shape long, part string"


def _packed(keys: list[tuple], parts: list[tuple[list, set[str]]]) -> pa.RecordBatch:
    columns = [list(x) for x in zip(*keys, strict=True)] or [[], [], [], []]
    written = [json.dumps([whole, sorted(hints)]) for whole, hints in parts]
    types = [pa.string(), pa.int64(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(columns, types, strict=True)), pa.array(written, pa.string())], ["host", "template", "salt", "shape", "part"])


def _aligned_by(rows: DataFrame, n: int) -> DataFrame:
    """One part for all those that agree on the first ``n`` of ``host, template, salt, shape``, in the order of the other columns.

    Rows of one shape are added up first; they must not be told apart by their order.
    """
    names = ["host", "template", "salt", "shape"]

    def run(batches):
        sys.setrecursionlimit(max(sys.getrecursionlimit(), 12 * DEPTH))
        key = whole = last = alike = None
        for b in batches:
            for *at, text in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True):
                got = json.loads(text)
                got = got[0], set(got[1])
                if at == last:
                    alike = together(alike, got, True)
                    continue
                if last is not None:
                    whole = together(whole, alike) if whole else alike
                if at[:n] != key:
                    if whole:
                        yield _packed([(*key, *[0] * (4 - n))], [whole])
                    key, whole = at[:n], None
                last, alike = at, got
        if last is not None:
            yield _packed([(*key, *[0] * (4 - n))], [together(whole, alike) if whole else alike])

    return rows.repartition(*names[:n]).sortWithinPartitions(*names).mapInArrow(run, _PARTS)


def wrappers(rows: DataFrame) -> DataFrame:
    """``host, template, wrapper`` (JSON) for every template of every host, from all its different pages.

    What stands on all pages of a host, whatever their templates, is boring in each of them too: of a rare template there may
    be too few pages to tell.
    """

    def add_up(batches):
        sys.setrecursionlimit(max(sys.getrecursionlimit(), 12 * DEPTH))
        held: dict[tuple, tuple] = {}
        for b in batches:
            for host, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                page = parse(text)
                got = part(page)
                look = xxhash.xxh64_intdigest(shape(got[0])) - (1 << 63)
                key = host, template(page), look % SALT, look
                held[key] = together(held[key], got, True) if key in held else got
                if len(held) >= SHAPES:
                    yield _packed(list(held), list(held.values()))
                    held.clear()
        yield _packed(list(held), list(held.values()))

    def fit(batches):
        sys.setrecursionlimit(max(sys.getrecursionlimit(), 12 * DEPTH))
        for b in batches:
            fitted = []
            for text in b.column(4).to_pylist():
                whole, hints = json.loads(text)
                fitted.append(json.dumps(model(whole, set(hints))))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fitted, pa.string())], ["host", "template", "wrapper"])

    def both(batches):
        for b in batches:
            out = []
            for own, host in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                own, host = json.loads(own), json.loads(host)
                places = set(own["places"])
                own["boring"] = sorted({*own["boring"], *(p for p in host["boring"] if not any(x == p or x.startswith(p + "/") for x in places))})
                out.append(json.dumps(own))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string())], ["host", "template", "wrapper"])

    # Copies of a page tell nothing new.
    parts = rows.select("host", "html").where("html <> ''").distinct().mapInArrow(add_up, _PARTS)
    parts = cut(_aligned_by(_aligned_by(parts, 3), 2), "parts")
    ddl = "host string, template long, wrapper string"
    whole = _aligned_by(parts, 1).mapInArrow(fit, ddl).select("host", F.col("wrapper").alias("whole"))
    return parts.mapInArrow(fit, ddl).join(whole, "host").select("host", "template", "wrapper", "whole").mapInArrow(both, ddl)


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` of every page."""
    ship(df.sparkSession)
    rows = df.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"), _host(url_col).alias("host"))

    def sign(batches):
        for b in batches:
            yield b.append_column("template", pa.array([template(parse(x)) for x in b.column(2).to_pylist()], pa.int64()))

    rows = rows.mapInArrow(sign, "page_id long, url string, html string, host string, template long")
    fitted = cut(wrappers(rows), "wrappers")
    size = fitted.agg(F.sum(F.length("wrapper") + F.length("host"))).head()[0] or 0
    if size <= BROADCAST_BYTES:
        found = rows.join(F.broadcast(fitted), ["host", "template"], "left")
    else:
        salted = fitted.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        found = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALT)).cast("int")).join(salted, ["host", "template", "salt"], "left")

    def run(batches):
        load = functools.lru_cache(4096)(json.loads)
        for b in batches:
            for i in range(0, b.num_rows, 500):
                part = b.slice(i, 500)
                texts = [main_text(h, load(w) if w else None) for h, w in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return found.select("page_id", "url", "html", "wrapper").mapInArrow(run, "page_id long, url string, text string, n_chars long")
