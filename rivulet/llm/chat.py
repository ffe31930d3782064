r"""Conversations as training text with loss masks aligned by offsets.

Each turn is rendered as ``<|turn|>ROLE<|text|>TEXT<|end|>``. In roles and texts ``\`` becomes ``\\`` and ``<|`` becomes
``<\|``, so no control string can stand inside them and the rendering can be reversed. A conversation is rendered whole
and encoded once with offsets; sorted spans of the assistants' texts are met with the tokens' spans by binary search.
The control strings are added tokens, so no token straddles a text's edge.

Rows are dealt by conversation and streamed in order of turn. A conversation over ``PIECE`` characters comes out as
several rows, cut between turns, which changes neither ids nor masks; memory holds one piece at a time.

Null roles and texts count as empty; null conversation ids form one conversation; null turns come first; ties are
ordered by role, then text; repeated rows are repeated turns. An empty table gives an empty one. Other columns play no part.
"""

from __future__ import annotations

import hashlib
import os
import re
from itertools import chain, groupby
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, take_over

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: Characters after which a conversation goes on in another row.
PIECE = 1_000_000
FORMATTED = "conv_id long, piece long, text string, input_ids array<int>, loss_mask array<boolean>"
_unescape = re.compile(r"\\([\\|])")
_turns = re.compile(r"<\|turn\|>(.*?)<\|text\|>(.*?)<\|end\|>", re.S)


def escape(s: str) -> str:
    return s.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(s: str) -> str:
    return _unescape.sub(r"\1", s)


def render(turns: list[tuple[str, str]], learn: str = "assistant") -> tuple[str, list[tuple[int, int]]]:
    """The text of (role, text) turns and the sorted spans of the texts to learn from."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{TURN}{escape(role)}{TEXT}", escape(text)
        if role == learn:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(parts), spans


def mask(offsets: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """For each token span (sorted by start) if it lies within one of the sorted spans."""
    if not len(offsets) or not spans:
        return np.zeros(len(offsets), bool)
    a = np.array(spans, np.int64)
    k = np.searchsorted(a[:, 0], offsets[:, 0], "right") - 1
    return (k >= 0) & (offsets[:, 1] <= a[k, 1]) & (offsets[:, 1] > offsets[:, 0])


class Formatter:
    def __init__(self, definition: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core a task
        from tokenizers import AddedToken, Tokenizer

        self.tok = Tokenizer.from_str(definition)
        self.tok.encode_special_tokens = True
        self.tok.add_tokens([AddedToken(x, normalized=False) for x in (TURN, TEXT, END)])
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # the bytes that byte-level vocabularies write as themselves
        rest = [b for b in range(256) if b not in set(plain)]
        char = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}
        added = self.tok.get_added_tokens_decoder()
        self._bytes = [b""] * (max(self.tok.get_vocab().values()) + 1)
        for token, i in self.tok.get_vocab().items():
            self._bytes[i] = token.encode() if i in added else bytes(map(char.__getitem__, token))

    def encode(self, turns: list[tuple[str, str]]) -> tuple[str, np.ndarray, np.ndarray]:
        text, spans = render(turns)
        e = self.tok.encode(text, add_special_tokens=False)
        offsets = np.fromiter(chain.from_iterable(e.offsets), np.int64, 2 * len(e)).reshape(-1, 2)
        return text, np.array(e.ids, np.int32), mask(offsets, spans)

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self._bytes.__getitem__, ids.tolist()))


_formatters: dict[int, Formatter] = {}


def _formatter(definition: str) -> Formatter:
    take_over("chat", _formatters.clear)
    key = hash(definition)
    if key not in _formatters:
        _formatters.clear()
        _formatters[key] = Formatter(definition)
    return _formatters[key]


def _rows(batches):
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns), strict=True)


def format_conversations(df: DataFrame, tokenizer_path: str, piece: int = PIECE) -> DataFrame:
    """Rows (conv_id, turn, role, text) → ``FORMATTED``, the pieces of a conversation one after another."""
    spark = df.sparkSession
    ship(spark)
    definition = spark.sparkContext.broadcast(Path(tokenizer_path).read_text(encoding="utf-8"))
    rows = df.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                     F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def pieces(turns):
        block, size = [], 0
        for _, _, role, text in turns:
            if block and size + len(text) > piece:
                yield block
                block, size = [], 0
            block.append((role, text))
            size += len(text)
        yield block

    def run(batches):
        f = _formatter(definition.value)
        done, size = [], 0
        for conv, turns in groupby(_rows(batches), key=lambda r: r[0]):
            for k, block in enumerate(pieces(turns)):
                done.append((conv, k, *f.encode(block)))
                size += len(done[-1][2])
                if size >= piece:
                    yield _batch(done)
                    done, size = [], 0
        if done:
            yield _batch(done)

    return rows.mapInArrow(run, FORMATTED)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    conv, k, text, ids, learn = zip(*rows, strict=True)
    edges = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in ids])]), pa.int32())
    lists = [pa.ListArray.from_arrays(edges, pa.array(np.concatenate(x))) for x in (ids, learn)]
    return pa.RecordBatch.from_arrays([pa.array(conv, pa.int64()), pa.array(k, pa.int64()), pa.array(text), *lists], ["conv_id", "piece", "text", "input_ids", "loss_mask"])


def read_back(formatted: DataFrame, tokenizer_path: str) -> DataFrame:
    """Digests of each conversation from its pieces, which must follow one another as ``format_conversations`` leaves them."""
    spark = formatted.sparkSession
    ship(spark)
    definition = spark.sparkContext.broadcast(Path(tokenizer_path).read_text(encoding="utf-8"))

    def one(conv, pieces, f):
        turns, loss, n, chars, total = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
        for _, text, ids, learn in pieces:
            total += len(text)
            for role, body in _turns.findall(text):
                turns.update(f"{unescape(role)}\n{unescape(body)}\n".encode())
                n += 1
            learnt = unescape(f.decode(ids[learn]).decode())
            loss.update(learnt.encode())
            chars += len(learnt)
        return conv, n, turns.hexdigest(), chars, loss.hexdigest(), total

    def rows(batches):
        for b in batches:
            ids, learn = b.column(3), b.column(4)
            edges, flat, bits = ids.offsets.to_numpy(), ids.values.to_numpy(), learn.values.to_numpy(zero_copy_only=False)
            starts = learn.offsets.to_numpy()
            for r, (conv, text) in enumerate(zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True)):
                yield conv, text, flat[edges[r] : edges[r + 1]], bits[starts[r] : starts[r + 1]]

    def run(batches):
        f, done = _formatter(definition.value), []
        for conv, pieces in groupby(rows(batches), key=lambda r: r[0]):
            done.append(one(conv, pieces, f))
            if len(done) == 1000:
                yield pa.RecordBatch.from_pylist([dict(zip(names, x, strict=True)) for x in done], schema=schema)
                done = []
        if done:
            yield pa.RecordBatch.from_pylist([dict(zip(names, x, strict=True)) for x in done], schema=schema)

    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    schema = pa.schema([(x, pa.string() if x.endswith("sha256") else pa.int64()) for x in names])
    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
