r"""Benchmark decontamination: a BM25 index of the test items, asked by every training passage.

Words are runs of letters and digits in lower case (all non-ASCII characters count as letters). A text is asked in
passages of ``2 * step`` words, one every ``step`` words, so that whatever spans ``step`` words lies whole in one of
them; ``step`` is a quarter more than the longest item of the index.

An item is contaminating where a passage holds ``SHARE`` or more of its different ``SHINGLE``-word sequences, and of its
question's sequences and its answer's words ``PART`` or more each (the last sentence is the answer; an item of one sentence
is both). So neither a question without its answer nor an answer without its question makes a document go. Such a passage lacks at most a known number of the item's words,
so the item's BM25 score is at least its full score less that of its heaviest words: this is the item's threshold, and
dividing weights by it makes the threshold one for all items. Retrieval therefore loses nothing that would be verified.

Retrieval is block-max WAND: cursors over posting lists in order of item, a pivot from the terms' greatest weights, and
the greatest weights in blocks of items to skip blocks. Two of its bounds are put to all passages in bulk first: a
passage whose terms' greatest weights sum to less than the threshold has no pivot, and one whose block weights do so for
each block would have each block skipped. What is retrieved is verified on the words.

The items are read to the driver a partition at a time, twice: for the benchmark's statistics (in how many items each word
is, the mean length), which all weights share, and in blocks of ``ITEMS``; each block is an index, and ``GROUP`` indexes are
one broadcast (some 4,000 items, tens of MB). ``PASS`` broadcasts are put to the documents in one scan; a benchmark of more
than some 30,000 items takes another. Null texts count as empty; empty items match nothing; null ids are kept as they are; repeated
rows give repeated rows. An empty table gives an empty one. Other columns pass through ``without`` untouched.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column_name, id_text, ship, take_over, word_hashes

SHINGLE, SHARE = 5, 0.8
K1, B = 1.2, 0.75
#: Items in one index, in one block of a posting list, and indexes in one broadcast.
ITEMS, BLOCK, GROUP = 512, 8, 8
#: Broadcasts in one scan of the documents.
PASS = 8
#: Least share of the question's sequences, and of the answer's words.
PART = 0.5
#: The threshold, less what sums in single precision may lack.
NEARLY = np.float32(0.999)
_SEPARATOR = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])
_sentences = re.compile(r"(?<=[.!?])\s+")


def words_of(text: str) -> list[bytes]:
    raw = text.lower().encode()
    start, end, _ = word_hashes(raw, _SEPARATOR)
    return [raw[a:b] for a, b in zip(start.tolist(), end.tolist(), strict=True)]


def shingles(words: list[bytes], k: int = SHINGLE) -> set[tuple[bytes, ...]]:
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def summed(items: Iterable[list[bytes]]) -> tuple[int, float, dict[bytes, int]]:
    """The number of items with a word, their mean length, and in how many of them each word is."""
    n, length, df = 0, 0, defaultdict(int)
    for words in items:
        if words:
            n += 1
            length += len(words)
            for w in set(words):
                df[w] += 1
    return n, length / max(1, n), df


class Index:
    """Posting lists of one block of items, weights divided by the items' thresholds.

    ``statistics``: the number of items, their mean length, and in how many each word is; the block's own if not given.
    """

    def __init__(self, items: list[tuple[int, str]], statistics: tuple[int, float, dict[bytes, int]] | None = None):
        self.items = []
        for item, text in items:
            parts = _sentences.split(text.strip())
            words = words_of(text)
            if words:
                question = words_of(" ".join(parts[:-1])) if len(parts) > 1 else words
                self.items.append((item, words, shingles(words), shingles(question), set(words_of(parts[-1]))))
        n = len(self.items)
        every, mean, df = statistics or summed(words for _, words, *_ in self.items)
        weights = []
        for _, words, all_shingles, *_ in self.items:
            tf: dict[bytes, int] = defaultdict(int)
            for w in words:
                tf[w] += 1
            own = {w: math.log(1 + (every - df[w] + 0.5) / (df[w] + 0.5)) * f * (K1 + 1) / (f + K1 * (1 - B + B * len(words) / mean)) for w, f in tf.items()}
            # A word that is missing takes all of its shingles with it, and each missing word at least one of its own.
            missing = math.floor((1 - SHARE) * len(all_shingles) + 1e-9) if len(words) >= SHINGLE else 0
            held: dict[bytes, int] = defaultdict(int)
            for x in all_shingles:
                for w in set(x):
                    held[w] += 1
            may_lack = sorted((x for w, x in own.items() if held[w] <= missing), reverse=True)[:missing]
            least = sum(own.values()) - sum(may_lack)
            weights.append({w: x / least for w, x in own.items()} if least > 0 else {})
        self.step = max(8, math.ceil(1.25 * max((len(w) for _, w, *_ in self.items), default=0)))
        vocabulary = sorted(set().union(*weights))
        hashes = np.array([word_hashes(w, _SEPARATOR)[2][0] for w in vocabulary], np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.terms = hashes[order], [vocabulary[k] for k in order]
        self.blocks = -(-n // BLOCK)
        place = {w: k for k, w in enumerate(self.terms)}
        self.postings: list[list[tuple[int, float]]] = [[] for _ in self.terms]
        self.block_max = np.zeros((len(self.terms) + 1, max(1, self.blocks)), np.float32)
        for i, own in enumerate(weights):
            for w, x in own.items():
                self.postings[place[w]].append((i, x))
                k = place[w]
                self.block_max[k, i // BLOCK] = max(self.block_max[k, i // BLOCK], np.float32(x) * np.float32(1.000001))
        self.term_max = self.block_max.max(axis=1)

    def ids(self, h: np.ndarray) -> np.ndarray:
        """The terms' numbers; the number past the last for other words."""
        if not len(self.hashes):
            return np.zeros(len(h), np.int32)
        k = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[k] == h, k, len(self.hashes)).astype(np.int32)

    def may_match(self, passages: np.ndarray) -> np.ndarray:
        """Which passages (rows of sorted term numbers) some block's bound lets through."""
        twice = passages[:, 1:] == passages[:, :-1]
        passages[:, 1:][twice] = len(self.terms)
        at = np.flatnonzero(self.term_max[passages].sum(axis=1) >= NEARLY)
        out = []
        for i in range(0, len(at), 256):
            part = at[i : i + 256]
            out.append(part[(self.block_max[passages[part]].sum(axis=1) >= NEARLY).any(axis=1)])
        return np.concatenate(out) if out else at

    def wand(self, terms: list[int], threshold: float = 1.0) -> list[tuple[int, float]]:
        """All items whose summed weights over ``terms`` reach the threshold, by block-max WAND."""
        threshold -= 1e-6
        lists = [(self.postings[t], self.term_max[t], self.block_max[t]) for t in terms]
        at = [0] * len(lists)
        live = [k for k in range(len(lists)) if lists[k][0]]
        found = []
        while live:
            live.sort(key=lambda k: lists[k][0][at[k]][0])
            bound, pivot = 0.0, None
            for p, k in enumerate(live):
                bound += lists[k][1]
                if bound >= threshold:
                    pivot = p
                    break
            if pivot is None:
                return found
            item = lists[live[pivot]][0][at[live[pivot]]][0]
            while pivot + 1 < len(live) and lists[live[pivot + 1]][0][at[live[pivot + 1]]][0] == item:
                pivot += 1
            block = item // BLOCK
            if sum(lists[k][2][block] for k in live[: pivot + 1]) < threshold:
                # No item up to the block's end can do, nor any before the next list's item.
                to = (block + 1) * BLOCK
                if pivot + 1 < len(live):
                    to = min(to, lists[live[pivot + 1]][0][at[live[pivot + 1]]][0])
                to = max(to, item + 1)
                for k in live[: pivot + 1]:
                    self._seek(lists[k][0], at, k, to)
            elif lists[live[0]][0][at[live[0]]][0] == item:
                score = 0.0
                for k in live[: pivot + 1]:
                    score += lists[k][0][at[k]][1]
                    at[k] += 1
                if score >= threshold:
                    found.append((item, score))
            else:
                for k in live[:pivot]:
                    self._seek(lists[k][0], at, k, item)
            live = [k for k in live if at[k] < len(lists[k][0])]
        return found

    @staticmethod
    def _seek(postings: list[tuple[int, float]], at: list[int], k: int, item: int) -> None:
        while at[k] < len(postings) and postings[at[k]][0] < item:
            at[k] += 1

    def verify(self, i: int, passage: set[tuple[bytes, ...]], words: set[bytes]) -> tuple[float, float, float]:
        """Shares of the item's, and of its question's, shingles and of its answer's words that the passage holds."""
        _, own, every, question, answer = self.items[i]
        if len(own) < SHINGLE:
            return (1.0, 1.0, 1.0) if set(own) <= words and every <= passage else (0.0, 0.0, 0.0)
        share = lambda x, y: len(x & y) / max(1, len(x))
        if min(map(len, question), default=0) >= SHINGLE:
            asked = share(question, passage)
        else:  # a short question: its words
            asked = share(set().union(*question), words) if question else 1.0
        return share(every, passage), asked, share(answer, words) if answer else 1.0

    def search(self, texts: list[str]):
        """(row, item's place, score, overlap, question's, answer's overlap), for each row and item the best passage."""
        rows = [x.lower().encode() for x in texts]
        raw = b"\n".join(rows)
        start, end, h = word_hashes(raw, _SEPARATOR)
        if not len(h) or not self.terms:
            return
        row = np.searchsorted(np.cumsum([len(r) + 1 for r in rows]), start, "right")
        first = np.searchsorted(row, np.arange(len(rows)))
        size = np.diff(np.append(first, len(h)))
        count = np.where(size > 0, np.maximum(1, -(-size // self.step) - 1), 0)
        owner = np.repeat(np.arange(len(rows)), count)
        begin = first[owner] + self.step * (np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count))
        stop = np.minimum(begin + 2 * self.step, (first + size)[owner])
        terms = np.append(self.ids(h), len(self.terms)).astype(np.int32)
        best: dict[tuple[int, int], tuple] = {}
        for p in range(0, len(begin), 4096):
            q = slice(p, p + 4096)
            place = begin[q, None] + np.arange(2 * self.step)
            passages = np.sort(np.where(place < stop[q, None], terms[np.minimum(place, len(h))], len(self.terms)), axis=1)
            for k in self.may_match(passages).tolist():
                held = passages[k]
                found = self.wand(held[held < len(self.terms)].tolist())
                if not found:
                    continue
                words = [raw[a:b] for a, b in zip(start[begin[p + k] : stop[p + k]].tolist(), end[begin[p + k] : stop[p + k]].tolist(), strict=True)]
                got = {n: shingles(words, n) for n in {min(SHINGLE, len(self.items[i][1])) for i, _ in found}}
                bag = set(words)
                for i, score in found:
                    overlap, question, answer = self.verify(i, got[min(SHINGLE, len(self.items[i][1]))], bag)
                    key = (int(owner[p + k]), i)
                    if overlap >= SHARE - 1e-9 and min(question, answer) >= PART - 1e-9 and (key not in best or best[key] < (overlap, score, question, answer)):
                        best[key] = (overlap, score, question, answer)
        for (r, i), (overlap, score, question, answer) in sorted(best.items()):
            yield r, i, score, overlap, question, answer


def _blocks(texts: list[str], chars: int = 1 << 20):
    start = size = 0
    for k, x in enumerate(texts):
        size += len(x) + 1
        if size >= chars:
            yield start, k + 1
            start, size = k + 1, 0
    if start < len(texts):
        yield start, len(texts)


def index_groups(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text"):
    """Lists of up to ``GROUP`` indexes of up to ``ITEMS`` items, which reach the driver a partition at a time."""
    group, block = [], []
    rows = benchmark.select(F.col(item_col).cast("long").alias("i"), F.col(text_col).alias("t")).where("t IS NOT NULL").distinct()
    statistics = summed(words_of(r.t) for r in rows.toLocalIterator())
    for r in rows.sort("i", "t").toLocalIterator():
        block.append((r.i, r.t))
        if len(block) == ITEMS:
            group.append(Index(block, statistics))
            block = []
            if len(group) == GROUP:
                yield group
                group = []
    if block:
        group.append(Index(block, statistics))
    if group:
        yield group


def passes(spark: SparkSession, benchmark: DataFrame):
    """Lists of up to ``PASS`` broadcast groups: what one scan of the documents is put to."""
    shared = []
    for group in index_groups(benchmark):
        shared.append(spark.sparkContext.broadcast(group))
        if len(shared) == PASS:
            yield shared
            shared = []
    if shared:
        yield shared


def _search_all(shared: list, texts: list[str]):
    for i, j in _blocks(texts):
        for index in (x for group in shared for x in group.value):
            for r, k, *found in index.search(texts[i:j]):
                yield i + r, index.items[k][0], *found


def find(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document and item that it holds: ``doc_id, item_id, score`` (1: the threshold), ``overlap,
    question_overlap, answer_overlap``."""
    spark = df.sparkSession
    ship(spark)
    names = ["item_id", "score", "overlap", "question_overlap", "answer_overlap"]
    schema = "doc_id long, item_id long, score double, overlap double, question_overlap double, answer_overlap double"
    docs = id_text(df, id_col, text_col)

    def search(shared):
        def run(batches):
            for b in batches:
                found = list(_search_all(shared, b.column(1).to_pylist()))
                if found:
                    rows, items, *rest = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), pa.array(items, pa.int64()), *(pa.array(x, pa.float64()) for x in rest)], ["doc_id", *names])

        return docs.mapInArrow(run, schema)

    parts = [search(shared) for shared in passes(spark, benchmark)]
    return reduce(DataFrame.union, parts) if parts else spark.createDataFrame([], schema)


def without(df: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents that hold no item, as they are."""
    spark, schema = df.sparkSession, df.schema
    ship(spark)
    place = df.columns.index(column_name(df, text_col))

    def free_of(df, shared):
        def run(batches):
            take_over("decontamination")
            for b in batches:
                keep = np.ones(b.num_rows, bool)
                keep[[r for r, *_ in _search_all(shared, [x or "" for x in b.column(place).to_pylist()])]] = False
                yield b.filter(pa.array(keep))

        return df.mapInArrow(run, schema)

    for shared in passes(spark, benchmark):
        df = free_of(df, shared)
    return df
