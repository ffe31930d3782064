r"""Removal of passages that a document of smaller id has too, by sharded Aho-Corasick automata.

A window is ``N`` consecutive words (runs of non-white-space) of one document. Every word goes that is covered by a
window whose word sequence also starts in a document of smaller id; windows are judged on the input.

1. Anchors. Of the ``K``-word sequences in a window the one of least hash (the leftmost, if they tie) is its anchor. Like
   windows have like anchors, so a repeated window has an anchor that occurs in two documents. Anchors are about a fifth
   of the words; least and greatest document id for each are summed up before they are shuffled.
2. Fragments. Around every anchor that two documents share, the words of the windows anchored there are cut out (about
   seventeen words) and dealt by anchor. A bit table of fixed greatest size filters anchors before that; where it lets
   too many pass, more fragments travel, and results stay the same.
3. Automata. Each task takes the fragments of its anchors in order, confirms the windows that occur in two documents,
   compiles them into automata of word sequences, and streams the fragments of anchors that have any through those: each
   different fragment once.
4. What a fragment was found to hold is joined to the places where it occurs, and the covered words are removed.

Hashes only propose: windows are confirmed and matched as words, and a fragment is known by 128 bits.

Null texts have no word. Null ids are neither smaller nor greater than others, so their rows lose nothing. Rows that
share an id are one document for the rule, and each is cleaned by itself. Texts with fewer than ``N`` words lose nothing.
An empty table gives an empty one. Other columns play no part.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from itertools import count, groupby, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, id_text, ngram_hashes, ship, word_hashes

N, K = 13, 5
#: Greatest size of the bit table (32 MB), and of the covered places that may be broadcast.
FILTER_BITS = 1 << 28
BROADCAST_BYTES = 64 << 20
#: Bytes of text hashed at a time; a longer text is taken whole.
BLOCK = 1 << 20
#: Word sequences in one automaton: so few that it stays in a CPU's cache.
SHARD = 3_000


def blocks(texts: list[str]):
    """(first row, bytes of each row) of about ``BLOCK`` bytes."""
    first, rows, size = 0, [], 0
    for k, x in enumerate(texts):
        rows.append(x.encode())
        size += len(rows[-1]) + 1
        if size >= BLOCK:
            yield first, rows
            first, rows, size = k + 1, [], 0
    if rows:
        yield first, rows


def anchors(rows: list[bytes], n: int = N, k: int = K):
    """Anchors in some texts: hash, row, first word of the first window, words of all its windows; and words' edges.

    Word numbers go on from text to text: ``base[row]`` is the first of a row.
    """
    raw = b"\n".join(rows)
    start, end, h = word_hashes(raw)
    bounds = np.cumsum([len(r) + 1 for r in rows])
    row = np.searchsorted(bounds, start, "right")
    base = np.searchsorted(row, np.arange(len(rows)))
    none = np.zeros(0, np.int64)
    if len(h) < n:
        return raw, start, end, base, none.astype(np.uint64), none, none, none
    g = ngram_hashes(h, k)
    at = np.lib.stride_tricks.sliding_window_view(g, n - k + 1).argmin(axis=1) + np.arange(len(h) - n + 1)
    ok = row[: len(at)] == row[n - 1 :]
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | (ok[1:] != ok[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    keep = ok[first]
    first, last = first[keep], last[keep]
    return raw, start, end, base, g[at[first]], row[first], first, last - first + n


def fragment(raw: bytes, start: np.ndarray, end: np.ndarray, first: int, words: int) -> bytes:
    return b" ".join(raw[start[first] : end[first + words - 1]].split())


def _seen(table: np.ndarray | None, h: np.ndarray) -> np.ndarray:
    if table is None:
        return np.ones(len(h), bool)
    out = np.ones(len(h), bool)
    for half in (h, h >> np.uint64(32)):
        bit = half & np.uint64(len(table) * 8 - 1)
        out &= (table[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return out


def _bit_table(shared: DataFrame, n: int) -> np.ndarray | None:
    """Two bits for each shared anchor, by either half of it, in at most ``FILTER_BITS``; none if those would be too full to be of use."""
    bits = 1 << 16
    while bits < 32 * n and bits < FILTER_BITS:
        bits *= 2
    if n > bits:
        return None
    size = 1 << 16
    halves = F.array(F.col("anchor"), F.shiftrightunsigned("anchor", 32))
    bit = F.col("half").bitwiseAND(F.lit(bits - 1))

    def run(batches):
        tables: dict[int, np.ndarray] = {}
        for b in batches:
            chunk, bit = b.column(0).to_numpy(), b.column(1).to_numpy()
            for c in np.unique(chunk).tolist():
                t = tables.setdefault(c, np.zeros(size // 8, np.uint8))
                mine = bit[chunk == c]
                np.bitwise_or.at(t, mine >> 3, (1 << (mine & 7)).astype(np.uint8))
        for c, t in tables.items():
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.int64()), pa.array([t.tobytes()], pa.binary())], ["chunk", "t"])

    dealt = shared.select(F.explode(halves).alias("half")).select(F.shiftright(bit, 16).alias("chunk"), (bit % size).alias("bit")).repartition("chunk")
    table = np.zeros(bits // 8, np.uint8)
    for r in dealt.mapInArrow(run, "chunk long, t binary").toLocalIterator():  # each chunk once: at most FILTER_BITS together
        table[r.chunk * (size // 8) : (r.chunk + 1) * (size // 8)] = np.frombuffer(r.t, np.uint8)
    return table


def shared_anchors(docs: DataFrame) -> DataFrame:
    """Anchors that occur in two documents at least."""

    def run(batches):
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            for first, rows in blocks(b.column(1).to_pylist()):
                _, _, _, _, h, row, _, _ = anchors(rows)
                doc = ids[first + row]
                order = np.lexsort((doc, h))
                h, doc = h[order], doc[order]
                head = np.ones(len(h), bool)
                head[1:] = h[1:] != h[:-1]
                at = np.flatnonzero(head)
                if len(at):
                    last = np.append(at[1:], len(h)) - 1
                    yield pa.RecordBatch.from_arrays([pa.array(h[at].view(np.int64)), pa.array(doc[at].astype(np.int64)), pa.array(doc[last].astype(np.int64))], ["anchor", "lo", "hi"])

    found = docs.select("doc_id", "text").where("doc_id IS NOT NULL").mapInArrow(run, "anchor long, lo long, hi long")
    return found.groupBy("anchor").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo < hi").select("anchor")


def _fragments(docs: DataFrame, table) -> DataFrame:
    """Different fragments around shared anchors in each block of texts, with least and greatest id."""

    def run(batches):
        t = table.value
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            for first, rows in blocks(b.column(1).to_pylist()):
                raw, start, end, _, h, row, at, words = anchors(rows)
                found: dict[tuple[int, bytes], list[int]] = {}
                for k in np.flatnonzero(_seen(t, h)).tolist():
                    key = (int(h[k]), fragment(raw, start, end, at[k], int(words[k])))
                    doc = int(ids[first + row[k]])
                    if key in found:
                        old = found[key]
                        old[0], old[1] = min(old[0], doc), max(old[1], doc)
                    else:
                        found[key] = [doc, doc]
                if found:
                    hashes = np.array([k for k, _ in found], np.uint64).view(np.int64)
                    lo, hi = zip(*found.values(), strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(hashes), pa.array([f for _, f in found], pa.binary()), pa.array(lo, pa.int64()), pa.array(hi, pa.int64())], ["anchor", "frag", "lo", "hi"])

    return docs.select("doc_id", "text").where("doc_id IS NOT NULL").mapInArrow(run, "anchor long, frag binary, lo long, hi long")


def confirmed(frags: dict[bytes, list[int]], n: int = N) -> list[tuple[list[bytes], int]]:
    """Word sequences that occur in two documents, with the least id, from the fragments of one anchor."""
    if len(frags) == 1:
        ((frag, (lo, hi)),) = frags.items()
        return [(frag.split(), lo)] if lo < hi else []
    windows: dict[tuple[bytes, ...], list[int]] = {}
    for frag, (lo, hi) in frags.items():
        words = frag.split()
        for i in range(len(words) - n + 1):
            w = windows.setdefault(tuple(words[i : i + n]), [lo, hi])
            w[0], w[1] = min(w[0], lo), max(w[1], hi)
    return [(list(w), lo) for w, (lo, hi) in windows.items() if lo < hi]


def locate(frags: list[bytes], passages: list[tuple[list[bytes], int]], n: int = N) -> list[list[int | None] | None]:
    """For each fragment the least id that has each of its windows, found by one automaton over word numbers."""
    import ahocorasick

    number: defaultdict[bytes, int] = defaultdict(count(1).__next__)
    auto = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    for words, lo in passages:
        key = tuple(map(number.__getitem__, words))
        old = auto.get(key, None)
        auto.add_word(key, (len(key), lo if old is None else min(lo, old[1])))
    if not passages:
        return [None] * len(frags)
    auto.make_automaton()
    out: list[list[int | None] | None] = []
    for frag in frags:
        key = tuple(map(number.get, frag.split(), repeat(0)))
        least: list[int | None] = [None] * (len(key) - n + 1)
        hit = False
        for last, (size, lo) in auto.iter(key):
            hit = True
            for i in range(last - size + 1, last - n + 2):
                least[i] = lo if least[i] is None else min(lo, least[i])
        out.append(least if hit else None)
    return out


def shards(rows):
    """Fragments, their anchors and the passages of their automaton, from ``anchor, frag, lo, hi`` in order of anchor.

    All windows of a fragment have its anchor, so a fragment goes in only if its anchor has a confirmed window.
    """
    frags, keys, passages = [], [], []
    for anchor, group in groupby(rows, key=lambda r: r[0]):
        merged: dict[bytes, list[int]] = {}
        for _, f, lo, hi in group:
            old = merged.setdefault(f, [lo, hi])
            old[0], old[1] = min(old[0], lo), max(old[1], hi)
        if repeated := confirmed(merged):
            frags += merged
            keys += [anchor] * len(merged)
            passages += repeated
        if len(frags) + len(passages) >= SHARD:
            yield frags, keys, passages
            frags, keys, passages = [], [], []
    yield frags, keys, passages


def _holdings(fragments: DataFrame) -> DataFrame:
    """``anchor, fh, least``: what each fragment with a repeated window holds."""

    def rows(batches):
        for b in batches:
            yield from zip(*(c.to_pylist() for c in b.columns), strict=True)

    def run(batches):
        for frags, keys, passages in shards(rows(batches)):
            found = [(a, xxhash.xxh64_intdigest(f), x) for a, f, x in zip(keys, frags, locate(frags, passages), strict=True) if x]
            if found:
                a, fh, least = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(np.array(fh, np.uint64).view(np.int64)), pa.array(least, pa.list_(pa.int64()))], ["anchor", "fh", "least"])

    dealt = fragments.repartition("anchor").sortWithinPartitions("anchor")
    return dealt.mapInArrow(run, "anchor long, fh long, least array<long>")


def _places(docs: DataFrame, table) -> DataFrame:
    """Where fragments around shared anchors occur: ``doc_id, h, at`` (word of the text), ``anchor, fh``."""

    def run(batches):
        t = table.value
        for b in batches:
            for first, rows in blocks(b.column(1).to_pylist()):
                raw, start, end, base, h, row, at, words = anchors(rows)
                k = np.flatnonzero(_seen(t, h))
                if not len(k):
                    continue
                fh = np.array([xxhash.xxh64_intdigest(fragment(raw, start, end, at[i], int(words[i]))) for i in k.tolist()], np.uint64)
                take = pa.array(first + row[k])
                yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(2).take(take), pa.array((at[k] - base[row[k]]).astype(np.int32)), pa.array(h[k].view(np.int64)), pa.array(fh.view(np.int64))], ["doc_id", "h", "at", "anchor", "fh"])

    return docs.where("doc_id IS NOT NULL").mapInArrow(run, "doc_id long, h long, at int, anchor long, fh long")


def covered(docs: DataFrame) -> DataFrame:
    """``doc_id, h, cover``: begin and end (exclusive) of each run of words to remove, for texts that have any."""
    shared = cut(shared_anchors(docs), "anchors")
    table = docs.sparkSession.sparkContext.broadcast(_bit_table(shared, shared.count()))
    holdings = _holdings(_fragments(docs, table))
    places = _places(docs, table).join(holdings, ["anchor", "fh"])
    starts = places.select("doc_id", "h", F.expr("transform(filter(sequence(0, size(least) - 1), i -> least[i] < doc_id), i -> at + i)").alias("s")).where("size(s) > 0")
    starts = starts.groupBy("doc_id", "h").agg(F.flatten(F.collect_list("s")).alias("s"))  # at most one for each word of a text

    def run(batches):
        for b in batches:
            out = []
            for s in b.column(2).to_pylist():
                a = np.unique(s)
                gap = np.flatnonzero(a[1:] - a[:-1] > N)
                lo, hi = a[np.concatenate([[0], gap + 1])], a[np.append(gap, len(a) - 1)] + N
                out.append(np.stack([lo, hi], 1).ravel().tolist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.list_(pa.int32()))], ["doc_id", "h", "cover"])

    return starts.mapInArrow(run, "doc_id long, h long, cover array<int>")


def dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", texts: bool = False) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` of every row; with ``texts`` also ``kept``, the words that stay."""
    ship(df.sparkSession)
    docs = id_text(df, id_col, text_col).withColumn("h", F.xxhash64("text"))
    cover = cut(covered(docs), "covered")
    size = cover.agg(F.sum(16 + 4 * F.size("cover"))).head()[0] or 0
    found = docs.join(F.broadcast(cover) if size <= BROADCAST_BYTES else cover, ["doc_id", "h"], "left")

    def run(batches):
        for b in batches:
            rows = []
            for text, cover in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                words = text.encode().split()
                left, at = [], 0
                for a, e in zip(cover[::2], cover[1::2], strict=True) if cover else ():
                    left += words[at:a]
                    at = e
                left += words[at:]
                rows.append((len(words), len(words) - len(left), b" ".join(left)))
            n, gone, kept = zip(*rows, strict=True) if rows else ((), (), ())
            cols = [b.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string())]
            cols += [pa.array([x.decode() for x in kept], pa.string())] * texts
            yield pa.RecordBatch.from_arrays(cols, names)

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * texts
    names = [c.split()[0] for c in schema.split(", ")]
    return found.select("doc_id", "text", "cover").mapInArrow(run, schema)
