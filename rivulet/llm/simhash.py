r"""SimHash near-duplicates by a self-join of binary tries.

A fingerprint takes the words of a text (runs of non-white-space, A-Z in lower case), hashes every shingle of ``k``
words with XXH64 (seed 42; fewer words: the whole sequence; none: fingerprint zero) and sets the bits that over half of
the shingles have. Fingerprints link at ``budget`` or fewer differing bits; groups are connected components.

The join works on different fingerprints only. Their 64 bits are cut into ``blocks`` runs; two that differ in at most
``budget`` bits agree on some ``blocks - budget`` runs, so for each choice of runs the fingerprints are dealt by those
bits. What a task gets is a forest of tries whose first levels are those bits: it walks pairs of nodes downwards from
(root, root), adds up differing bits, leaves a pair once they exceed the budget, and compares leaves when few are left.
A pair of nodes whose leaves are all linked already is left too, so a group of n near-copies costs and gives about n
links, not n squared. No choice of runs misses a link, whatever the size: the choice only sets how many rows are dealt.

The stage ``keep_first`` takes the different five-word shingles of a text and four fingerprints, 256 bits. SimHash tells the
angle between two texts' sets of shingles, so its similarity is their cosine, |A and B| / sqrt(|A| |B|); two texts link at
``similarity`` 0.8 or more. (A share of common shingles, Jaccard, of 0.8 is a cosine of 0.88 or more and links too.) The
trie join proposes pairs whose 256 bits are near enough; every link is then confirmed on the shingles themselves. The bits
that a pair must share to meet are the same for inputs of all sizes (``PAIRED``), so whether two texts meet depends on them
alone, and a text is dealt the same number of times. Few of the choices go first: what they link, large groups of near-copies
above all, is one group already when the others propose pairs.

Null texts count as empty. Null ids are never a component's id unless a whole component has none, whose id is null.
Repeated rows each get their row. An empty table gives an empty one. Other columns play no part.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh, id_text, ship, take_over

SEED = 42
#: Pairs of leaves compared at a time.
PAIRS = 1 << 20
#: Rows (of two numbers) that go may be broadcast up to this many: 48 MB at most. Beyond it both sides are dealt by key.
BROADCAST_ROWS = 2_000_000


def shingle_hashes(raw: bytes, k: int, seed: int = SEED) -> np.ndarray:
    words = raw.lower().split()  # of bytes: A-Z only, ASCII white space only
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    n = max(1, len(words) - k + 1)
    h, last = xxhash.xxh64_intdigest, ends[min(k, len(words)) - 1 :].tolist()
    return np.array([h(joined[a:b], seed) for a, b in zip(starts[:n], last, strict=True)], np.uint64)


def bits_of(h: np.ndarray, block: int = 1 << 15) -> int:
    """The fingerprint of shingle hashes."""
    if not len(h):
        return 0
    total = np.zeros(64, np.int64)
    for i in range(0, len(h), block):
        total += np.unpackbits(h[i : i + block].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits((2 * total > len(h)).astype(np.uint8), bitorder="little").view(np.uint64)[0])


def fingerprints(df: DataFrame, k: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``h`` (a hash of the text) and ``f0``, the fingerprint."""
    ship(df.sparkSession)

    def run(batches):
        take_over("simhash")
        for b in batches:
            for i in range(0, b.num_rows, 500):
                part = b.slice(i, 500)
                prints = np.array([bits_of(shingle_hashes(x.encode(), k)) for x in part.column(1).to_pylist()], np.uint64)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(prints.view(np.int64))], ["doc_id", "h", "f0"])

    rows = id_text(df, id_col, text_col).withColumn("h", F.xxhash64("text"))
    return rows.mapInArrow(run, "doc_id long, h long, f0 long")


def sketches(df: DataFrame, k: int, prints: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``h``, ``own`` (a hash of the set of shingles) and ``f0, f1, ...``, fingerprints of that set."""
    ship(df.sparkSession)
    names = ["doc_id", "h", "own", *(f"f{s}" for s in range(prints))]

    def run(batches):
        take_over("simhash")
        for b in batches:
            for i in range(0, b.num_rows, 500):
                part = b.slice(i, 500)
                out = np.zeros((prints + 1, part.num_rows), np.uint64)
                for r, x in enumerate(part.column(1).to_pylist()):
                    h = np.unique(shingle_hashes(x.encode(), k))
                    out[0, r] = xxhash.xxh64_intdigest(h.tobytes(), SEED)
                    for s in range(prints):
                        out[s + 1, r] = bits_of(remix(h, s) if s else h)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), *(pa.array(x.view(np.int64)) for x in out)], names)

    rows = id_text(df, id_col, text_col).withColumn("h", F.xxhash64("text"))
    return rows.mapInArrow(run, ", ".join(f"{n} long" for n in names))


def remix(h: np.ndarray, seed: int) -> np.ndarray:
    from .common import mix

    return mix(h ^ mix(np.array([seed], np.uint64)))


# --- the trie join of one task


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


class Links:
    """Which of n leaves are linked: a forest, and labels that are brought up to date in bulk."""

    def __init__(self, n: int, label: np.ndarray | None = None):
        self.label = np.arange(n) if label is None else label
        self.kept: list[tuple[np.ndarray, np.ndarray]] = []
        self._renumber()

    def _renumber(self) -> None:
        self.changes = np.concatenate([[0], np.cumsum(self.label[1:] != self.label[:-1])]) if len(self.label) else np.zeros(0, np.int64)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        """Keeps those links that join two groups, in rounds: each group keeps one link to the group of least label."""
        grown = False
        while True:
            x, y = self.label[a], self.label[b]
            new = x != y
            if not new.any():
                break
            a, b, x, y = a[new], b[new], x[new], y[new]
            hi, lo = np.maximum(x, y), np.minimum(x, y)
            order = np.lexsort((lo, hi))
            first = order[np.concatenate([[True], hi[order][1:] != hi[order][:-1]])]
            parent = np.arange(len(self.label))
            parent[hi[first]] = lo[first]
            while not np.array_equal(up := parent[parent], parent):
                parent = up
            self.kept.append((a[first], b[first]))
            self.label = parent[self.label]
            grown = True
        if grown:
            self._renumber()

    def joined(self, lo_a: np.ndarray, hi_a: np.ndarray, lo_b: np.ndarray, hi_b: np.ndarray) -> np.ndarray:
        """For each pair of ranges of leaves if all leaves of both are in one group."""
        c = self.changes
        return (c[hi_a - 1] == c[lo_a]) & (c[hi_b - 1] == c[lo_b]) & (self.label[lo_a] == self.label[lo_b])


def trie_links(key: np.ndarray, bits: np.ndarray, budget: int, distance=None, steps: tuple[int, ...] = (), label: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A forest of links among leaves that agree on ``key`` and differ in ``budget`` or fewer of ``bits``.

    Rows are sorted by (key, bits). A node is a range of rows that agree on the key and the first bits. With
    ``distance(i, j)``, pairs of rows further apart than the last of ``steps`` don't link, and nearer pairs, by steps, link first.
    Rows of one ``label`` (numbers of rows) are linked from the start.
    """
    n = len(key)
    links = Links(n, label)
    if n < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)

    def link(i: np.ndarray, j: np.ndarray) -> None:
        ok = popcount(bits[i] ^ bits[j]) <= budget
        i, j = i[ok], j[ok]
        if distance is None or not len(i):
            links.add(i, j)
            return
        d = distance(i, j)
        for step in steps:
            links.add(i[d <= step], j[d <= step])

    i = np.flatnonzero(key[1:] == key[:-1])
    link(i, i + 1)  # neighbours: near-copies become few groups at once
    root = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    end = np.append(root[1:], n)
    root, end = root[end - root > 1], end[end - root > 1]
    todo = [(0, root, end, root, end, np.zeros(len(root), np.int64))]
    while todo:
        depth, la, ha, lb, hb, err = todo.pop()
        ok = ~links.joined(la, ha, lb, hb)
        la, ha, lb, hb, err = la[ok], ha[ok], lb[ok], hb[ok], err[ok]
        if not len(la):
            continue
        if len(la) > 1 << 15:  # depth first, in bounded blocks
            for p in range(0, len(la), 1 << 15):
                q = slice(p, p + (1 << 15))
                todo.append((depth, la[q], ha[q], lb[q], hb[q], err[q]))
            continue
        size = (ha - la) * (hb - lb)
        few = (size <= 256) | (depth >= 64)
        order = np.flatnonzero(few)
        at = 0
        while at < len(order):
            upto = at + max(1, int(np.searchsorted(np.cumsum(size[order[at:]]), PAIRS, "right")))
            s = order[at:upto]
            m = size[s]
            p = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
            w = np.repeat(hb[s] - lb[s], m)
            x, y = np.repeat(la[s], m) + p // w, np.repeat(lb[s], m) + p % w
            link(x[x < y], y[x < y])
            at = upto
        go = ~few
        if not go.any():
            continue
        la, ha, lb, hb, err = la[go], ha[go], lb[go], hb[go], err[go]
        bit = np.uint64(1 << (63 - depth))

        def middle(lo: np.ndarray, hi: np.ndarray, bit=bit) -> np.ndarray:
            """Where the bit turns from 0 to 1 in each range, by bisection of all ranges at once."""
            lo, hi = lo.copy(), hi.copy()
            while (open_ := lo < hi).any():
                mid = (lo + hi) // 2
                one = (bits[np.minimum(mid, n - 1)] & bit) != 0
                hi = np.where(open_ & one, mid, hi)
                lo = np.where(open_ & ~one, mid + 1, lo)
            return lo

        ma, mb, same = middle(la, ha), middle(lb, hb), la == lb
        parts = [(la, ma, lb, mb, err), (ma, ha, mb, hb, err), (la, ma, mb, hb, err + 1)]
        parts.append(tuple(v[~same] for v in (ma, ha, lb, mb, err + 1)))
        la, ha, lb, hb, err = (np.concatenate(v) for v in zip(*parts, strict=True))
        ok = (ha > la) & (hb > lb) & (err <= budget) & ~((la == lb) & (ha - la == 1))
        todo.append((depth + 1, la[ok], ha[ok], lb[ok], hb[ok], err[ok]))
    if not links.kept:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(v) for v in zip(*links.kept, strict=True))


# --- the join over the cluster


def choices(budget: int, rows: int, together: int = 11) -> list[tuple[tuple[int, int], ...]]:
    """For each choice of runs of bits, its (first bit, bits) from the top.

    The more runs must agree, the fewer random rows share a key (here about 2 ** ``together`` at most) and the more choices
    there are.
    """
    need = max(6, int(rows).bit_length() - together)
    for spare in range(1, 5):
        if 64 * spare / (budget + spare) >= need or spare == 4:
            return runs(budget, spare)
    raise AssertionError


def runs(budget: int, spare: int) -> list[tuple[tuple[int, int], ...]]:
    """Choices of ``spare`` of ``budget + spare`` runs of bits."""
    edges = [round(64 * k / (budget + spare)) for k in range(budget + spare + 1)]
    return list(combinations([(a, b - a) for a, b in zip(edges, edges[1:], strict=False)], spare))


def _first(key: np.ndarray, root: np.ndarray) -> np.ndarray:
    """For each row the number of the first row of the same key and root."""
    order = np.lexsort((root, key))  # stable, so a group's least row comes first
    k, r = key[order], root[order]
    new = np.concatenate([[True], (k[1:] != k[:-1]) | (r[1:] != r[:-1])])
    out = np.empty(len(key), np.int64)
    out[order] = order[np.flatnonzero(new)][np.cumsum(new) - 1]
    return out


def _bring_up(fp: np.ndarray, chosen: tuple[tuple[int, int], ...]) -> tuple[np.ndarray, np.ndarray]:
    """The chosen bits as a number, and the fingerprint without them (zeros in their place)."""
    key, mask = np.zeros(len(fp), np.uint64), 0
    for first, n in chosen:
        run = ((1 << n) - 1) << (64 - first - n)
        mask |= run
        key = (key << np.uint64(n)) | ((fp & np.uint64(run)) >> np.uint64(64 - first - n))
    return key, fp & np.uint64(~mask & (1 << 64) - 1)


def links(prints: DataFrame, plans: list[tuple[tuple[int, int], ...]], budget: int, own: int = 0, steps: tuple[int, ...] = ()) -> DataFrame:
    """``a, b`` (and ``d``, with ``steps``): links among classes that have the same components as all links within the budget.

    ``prints`` has ``class, f0, f1, ...``, a row for each class. Classes are dealt by each of the ``plans`` of fingerprint
    ``own`` and link if that differs in ``budget`` or fewer bits; with ``steps``, only if all fingerprints together differ in
    no more bits than its last (``d`` of them). Classes of one ``root``, if there is such a column, are linked already.
    """
    rooted = ["root"] * ("root" in prints.columns)
    prints = prints.select("class", *sorted((c for c in prints.columns if c[0] == "f" and c[1:].isdigit()), key=lambda c: int(c[1:])), *rooted)
    names, seeds = prints.columns, len(prints.columns) - 1 - len(rooted)
    schema = "a long, b long" + ", d int" * bool(steps)

    def deal(batches):
        for b in batches:
            fp = b.column(1 + own).to_numpy().view(np.uint64)
            for c, chosen in enumerate(plans):
                key, _ = _bring_up(fp, chosen)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(fp), c, np.int32)), pa.array(key.view(np.int64)), *b.columns], ["c", "key", *names])

    def join(batches):
        batches = list(batches)
        if not sum(b.num_rows for b in batches):
            return
        got = pa.Table.from_batches(batches)
        c, key = got.column(0).to_numpy(), got.column(1).to_numpy().view(np.uint64)
        named = got.column(2).to_numpy()
        prints = np.stack([got.column(3 + s).to_numpy().view(np.uint64) for s in range(seeds)])
        root = got.column(3 + seeds).to_numpy() if rooted else None
        del got, batches
        for one in np.unique(c):
            at = np.flatnonzero(c == one)
            rest = _bring_up(prints[own][at], plans[one])[1]
            order = np.lexsort((rest, key[at]))
            at, rest = at[order], rest[order]
            distance = lambda i, j, f=prints[:, at]: popcount(f[:, i] ^ f[:, j]).sum(0, dtype=np.int32)
            i, j = trie_links(key[at], rest, budget, distance if steps else None, steps, _first(key[at], root[at]) if rooted else None)
            if len(i):
                ends = [pa.array(named[at[i]]), pa.array(named[at[j]])]
                yield pa.RecordBatch.from_arrays([*ends, pa.array(distance(i, j))] if steps else ends, ["a", "b", "d"][: 2 + bool(steps)])

    dealt = prints.mapInArrow(deal, "c int, key long, " + ", ".join(f"{n} long" for n in names))
    return dealt.repartition("c", "key").mapInArrow(join, schema).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``fp, root`` for every end of an edge, by turns of large-star and small-star, each written to the shared folder.

    A star hands a node's neighbours its least one, so a node with very many neighbours is only ever summed up, never
    gathered.
    """
    edges = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")

    def least(pairs: DataFrame) -> DataFrame:
        return pairs.groupBy("a").agg(F.min("b").alias("m"))

    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = least(both).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = least(large)
        small = large.join(low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        after = cut(small, "edges")
        same = after.join(edges, ["a", "b"], "left_anti").isEmpty() and edges.join(after, ["a", "b"], "left_anti").isEmpty()
        edges = after
        if same:
            break
    return edges.select(F.col("a").alias("fp"), F.col("b").alias("root")).union(edges.select(F.col("b").alias("fp"), F.col("b").alias("root"))).distinct()


def groups(df: DataFrame, k: int, budget: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, h, fp, component_id`` for every row; equal fingerprints are one class."""
    prints = cut(fingerprints(df, k, id_col, text_col), "prints")
    classes = cut(prints.groupBy("f0").agg(F.min("doc_id").alias("least")).withColumn("class", F.col("f0")), "classes")
    found = components(links(classes, choices(budget, classes.count()), budget))
    rooted = classes.join(found, classes["class"] == found.fp, "left").select("f0", "least", F.coalesce("root", "class").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(ids, "root").select("f0", "component_id")
    return prints.join(named, "f0").select("doc_id", "h", F.col("f0").alias("fp"), "component_id")


#: Fingerprints of a sketch; bits in which one may differ; errors that a choice of runs is sure to bear (beyond them a pair
#: is found where its errors leave runs free); runs of 7 or 8 bits that must agree, so ``PRINTS`` times 36 choices.
PRINTS, REACH, SURE, PAIRED = 4, 16, 7, 2
#: The choices of the first fingerprint that go first: runs 0 and 1, 2 and 3, and so on.
EARLY = [a + b for a, b in zip(runs(SURE + PAIRED - 1, 1)[::2], runs(SURE + PAIRED - 1, 1)[1::2], strict=False)]
#: Of all bits those in which linked texts may differ: at a cosine of 0.8 0.205 are expected, with a deviation of 0.025.
APART = 0.27


def cosine(a: np.ndarray, b: np.ndarray) -> float:
    """The similarity of two sorted sets of hashes; empty sets are alike."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    return len(np.intersect1d(a, b, assume_unique=True)) / math.sqrt(len(a) * len(b))


def _confirmed(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs ``a, b`` of classes whose sets are similar enough."""

    def run(batches):
        for b in batches:
            a, z = b.column(2), b.column(3)
            sides = [(x.offsets.to_numpy(), x.values.to_numpy()) for x in (a, z)]
            ok = [cosine(*(values[edges[r] : edges[r + 1]] for edges, values in sides)) >= similarity - 1e-9 for r in range(b.num_rows)]
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    first = sets.select(F.col("class").alias("a"), F.col("hashes").alias("ha"))
    second = sets.select(F.col("class").alias("b"), F.col("hashes").alias("hb"))
    return pairs.select("a", "b").join(first, "a").join(second, "b").select("a", "b", "ha", "hb").mapInArrow(run, "a long, b long")


def _sets(df: DataFrame, wanted: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """``class, hashes`` of the texts named by ``wanted`` (class, doc_id, h)."""

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 200):
                part = b.slice(i, 200)
                sets = [np.unique(shingle_hashes(x.encode(), k)).view(np.int64) for x in part.column(1).to_pylist()]
                sets = [np.sort(x) for x in sets]
                edges = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in sets])]), pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(edges, pa.array(np.concatenate([*sets, np.zeros(0, np.int64)])))], ["class", "hashes"])

    texts = id_text(df, id_col, text_col).withColumn("h", F.xxhash64("text"))
    wanted = wanted.select("class", F.col("doc_id").alias("wanted_id"), F.col("h").alias("wanted_h"))
    side = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted
    found = texts.join(side, F.col("doc_id").eqNullSafe(F.col("wanted_id")) & (F.col("h") == F.col("wanted_h")))
    return found.select("class", "text").mapInArrow(run, "class long, hashes array<long>").dropDuplicates(["class"])


def similar(df: DataFrame, k: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``root, doc_id, h``: for each different set of shingles the root of its component and the first row that has it.

    First is the least id (null last), then the least hash of the text. Also ``class``.
    """
    names = [f"f{s}" for s in range(PRINTS)]
    prints = cut(sketches(df, k, PRINTS, id_col, text_col), "prints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "h")).alias("first")
    # Numbers are read back from storage, so they hold.
    classes = cut(prints.groupBy("own", *names).agg(first).withColumn("class", F.monotonically_increasing_id()), "classes")
    plans = runs(SURE, PAIRED)
    most = int(APART * 64 * PRINTS)
    steps = tuple(most * s // 8 for s in range(2, 9))
    own = classes.select("class", F.col("first.doc_id").alias("doc_id"), F.col("first.h").alias("h"))

    def ends(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.col("a").alias("class")).union(pairs.select(F.col("b").alias("class"))).distinct()

    def sets_of(wanted: DataFrame) -> DataFrame:
        return cut(_sets(df, own.join(wanted, "class", "left_semi"), k, id_col, text_col), "sets")

    early = cut(links(classes, EARLY, REACH, 0, steps), "early")
    sets = sets_of(ends(early))
    sure = cut(_confirmed(early, sets, similarity), "confirmed")
    label = cut(components(sure), "label")
    rooted = cut(classes.join(label, classes["class"] == label.fp, "left").select("class", *names, F.coalesce("root", "class").alias("root")), "rooted")
    parts = [cut(links(rooted, plans, REACH, s, steps), "links") for s in range(PRINTS)]
    near = cut(reduce(DataFrame.union, parts).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "near")
    sets = sets.union(sets_of(ends(near).join(sets.select("class"), "class", "left_anti")))
    label = components(sure.union(_confirmed(near, sets, similarity)))
    return own.join(label, own["class"] == label.fp, "left").select(F.coalesce("root", "class").alias("root"), "class", "doc_id", "h")


def keep_first(df: DataFrame, k: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of similar texts: of least id (null last), then of least hash of the text; of rows alike in both,
    any one."""
    found = similar(df, k, similarity, id_col, text_col)
    first = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "h")).alias("first"))
    d, h = fresh(df, "d"), fresh(df, "h")
    first = first.select(F.col("first.doc_id").alias("first_id"), F.col("first.h").alias("first_h"))
    rows = id_text(df, id_col, text_col).select(F.col("doc_id").alias(d), F.xxhash64("text").alias(h))
    rows = cut(rows.groupBy(d, h).count(), "rows")  # repeated rows are one here, so no key is hot
    gone = cut(rows.join(first, F.col(d).eqNullSafe(F.col("first_id")) & (F.col(h) == F.col("first_h")), "left_anti").select(d, h), "gone")
    again = rows.where("count > 1").select(d, h)
    key = F.col(id_col).cast("long").eqNullSafe(F.col(d)) & (F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))) == F.col(h))
    kept = df.join(F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone, key, "left_anti")
    if again.isEmpty():
        return kept
    columns, own = df.columns, F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    repeated = kept.join(again, key, "left_semi").withColumn(h, own).dropDuplicates([id_col, h]).select(*(F.col(f"`{c}`") for c in columns))
    return kept.join(again, key, "left_anti").union(repeated)
