"""Token ids in Arrow IPC files of fixed-size-list batches.

All ids of the corpus, in ascending order of document id, form one sequence; it is cut into shards of whole documents
and each shard into rows of ``length`` ids. A shard has two files. ``*.arrow`` holds the columns ``ids``
(fixed_size_list<uint16 or uint32>), ``mask`` (fixed_size_list<bool>, false on the padding of the shard's last row) and
``ends`` (fixed_size_list<bool>, true on the id appended to a document); fixed widths and no compression make any row
addressable in a memory map without a copy. ``*.docs.arrow`` holds ``doc_id``, ``start`` (in the shard) and ``n_tokens``.

Files appear under their final names by a rename, and a retried task writes the same bytes, so a lost executor leaves
no half a shard. Null texts count as empty (the appended id alone); null document ids come first; rows that share an id
are ordered by a hash of the text, then by the text. An empty table gives no shard and no row. Other columns play no part.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_text, shared_dir, ship, take_over

#: Most words that a worker remembers, about: in two halves, the words of late and those seen before; what was not seen again
#: while a half filled up is forgotten.
CACHE = 1_200_000
#: Rows in a record batch of a shard.
BATCH_ROWS = 64


class Encoder:
    """The library's encoder, with its own flags, and a memory of words.

    A text is cut before every space that a non-space follows, unless it holds one of the vocabulary's added tokens: those
    may reach over spaces, so such a text goes to the library whole.
    """

    def __init__(self, definition: str, dtype: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core a task: the library's threads would only contend
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_str(definition)
        added = sorted(t.content for t in self.tok.get_added_tokens_decoder().values())
        self.whole = re.compile("|".join([r" \s", *map(re.escape, filter(None, added))])).search
        self.dtype = dtype
        self.words: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        #: Of each id whether its token begins with a space.
        self.begins = np.zeros(max(self.tok.get_vocab().values(), default=-1) + 1, bool)
        self.begins[[i for t, i in self.tok.get_vocab().items() if t.startswith("\u0120")]] = True

    def _encode_words(self, words: list[str]) -> list[bytes]:
        """The ids of each word with a space before it. They are encoded as one text, which a space cuts just as any other."""
        text = "".join([" " + p for p in words])
        if words and not self.whole(text):
            ids = np.array(self._ids([text])[0], self.dtype)
            edges = np.flatnonzero(self.begins[ids])
            if len(edges) == len(words) and edges[0] == 0:
                raw, width = ids.tobytes(), ids.itemsize
                edges = (edges * width).tolist()
                return [raw[a:b] for a, b in zip(edges, [*edges[1:], len(raw)], strict=True)]
        return self._encode([" " + p for p in words])

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(ids, self.dtype).tobytes() for ids in self._ids(texts)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian integers."""
        if len(self.words) > CACHE // 2:
            self.before, self.words = self.words, {}
        heads, rows, gaps, fresh, known = [], [], [], set(), self.words.get
        for x in texts:
            head, *tail = [x] if self.whole(x) or x.endswith(" ") else x.split(" ")
            ids = list(map(known, tail))
            if None in ids:
                at = [k for k, i in enumerate(ids) if i is None]
                words = [tail[k] for k in at]
                fresh.update(words)
                gaps.append((ids, at, words))
            heads.append(head)
            rows.append(ids)
        self._learn(fresh)
        for ids, at, words in gaps:
            for k, p in zip(at, words, strict=True):
                ids[k] = self.words[p]
        first = self._encode(heads)
        return [b"".join([h, *ids]) for h, ids in zip(first, rows, strict=True)]

    def _learn(self, words: set[str]) -> None:
        seen = words & self.before.keys()
        self.words.update((p, self.before[p]) for p in seen)
        new = list(words - seen)
        self.words.update(zip(new, self._encode_words(new), strict=True))


_encoders: dict[tuple[int, str], Encoder] = {}


def encoder(definition: str, dtype: str) -> Encoder:
    take_over("token files", _encoders.clear)
    key = (hash(definition), dtype)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(definition, dtype)
    return _encoders[key]


def _open(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder)


def _schema(length: int, dtype: str) -> pa.Schema:
    kind = pa.uint16() if dtype == "<u2" else pa.uint32()
    return pa.schema([("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length)), ("ends", pa.list_(pa.bool_(), length))])


class ShardWriter:
    """Collects ids until a batch of rows is full; holds one batch and one document's ids at a time."""

    def __init__(self, folder: str, shard: int, length: int, dtype: str):
        self.fs, base = _open(folder)
        self.final = f"{base}/part-{shard:05d}"
        self.draft = f"{base}/_draft-{shard:05d}-{uuid.uuid4().hex}"
        self.length, self.dtype = length, dtype
        self.schema = _schema(length, dtype)
        self.fs.create_dir(base, recursive=True)
        self.out = self.fs.open_output_stream(f"{self.draft}.arrow")
        self.file = pa.ipc.new_file(self.out, self.schema)
        self.ids = bytearray()
        self.ends: list[int] = []
        self.flushed = self.total = 0
        self.docs: list[tuple] = []

    def add(self, doc_id: int | None, ids: bytes, end_id: int) -> None:
        n = len(ids) // int(self.dtype[2]) + 1
        self.docs.append((doc_id, self.total, n))
        self.ids += ids + np.array([end_id], self.dtype).tobytes()
        self.total += n
        self.ends.append(self.total - 1)
        if self.total - self.flushed >= BATCH_ROWS * self.length:
            self._flush((self.total - self.flushed) // self.length)

    def _flush(self, rows: int) -> None:
        width, size = int(self.dtype[2]), rows * self.length
        have = min(size, self.total - self.flushed)
        flat = np.zeros(size, self.dtype)
        flat[:have] = np.frombuffer(bytes(self.ids[: have * width]), self.dtype)
        ends = np.zeros(size, bool)
        inside = np.array([e for e in self.ends if e < self.flushed + have], np.int64) - self.flushed
        ends[inside] = True
        self.ends = [e for e in self.ends if e >= self.flushed + have]
        mask = np.arange(size) < have
        arrays = [pa.FixedSizeListArray.from_arrays(pa.array(x), type=t) for x, t in zip((flat, mask, ends), self.schema.types, strict=True)]
        batch = pa.RecordBatch.from_arrays(arrays, schema=self.schema)
        for i in range(0, rows, BATCH_ROWS):
            self.file.write_batch(batch.slice(i, BATCH_ROWS))
        del self.ids[: have * width]
        self.flushed += have

    def close(self) -> int:
        if self.total > self.flushed:
            self._flush(-(-(self.total - self.flushed) // self.length))
        self.file.close()
        self.out.close()
        cols = list(zip(*self.docs, strict=True)) or [[], [], []]
        table = pa.table([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "start", "n_tokens"])
        with self.fs.open_output_stream(f"{self.draft}.docs.arrow") as out, pa.ipc.new_file(out, table.schema) as f:
            f.write_table(table)
        for kind in ("docs.arrow", "arrow"):
            self.fs.move(f"{self.draft}.{kind}", f"{self.final}.{kind}")
        return self.total


def write(df: DataFrame, tokenizer_path: str, folder: str | None = None, length: int = 2048, end_id: int = 0,
          id_col: str = "doc_id", text_col: str = "text", shards: int | None = None) -> tuple[str, list[tuple[int, int]]]:
    """Write the shards; the folder and (shard, number of ids) of each shard, in order.

    Documents are dealt by range of (id, hash of text), so shards are in order and one id with very many rows is split.
    """
    spark = df.sparkSession
    ship(spark)
    folder = folder or shared_dir(spark) + "-tokens"
    definition = spark.sparkContext.broadcast(Path(tokenizer_path).read_text(encoding="utf-8"))
    from tokenizers import Tokenizer

    dtype = "<u2" if max(Tokenizer.from_str(definition.value).get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"
    n = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = id_text(df, id_col, text_col).withColumn("h", F.xxhash64("text"))
    rows = rows.repartitionByRange(n, "doc_id", "h").sortWithinPartitions("doc_id", "h", "text")

    def run(batches):
        from pyspark import TaskContext

        e, shard, out = encoder(definition.value, dtype), TaskContext.get().partitionId(), None
        for b in batches:
            for i in range(0, b.num_rows, 200):
                part = b.slice(i, 200)
                out = out or ShardWriter(folder, shard, length, dtype)
                for doc, ids in zip(part.column(0).to_pylist(), e.encode(part.column(1).to_pylist()), strict=True):
                    out.add(doc, ids, end_id)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([out.close()], pa.int64())], ["shard", "n"])

    manifest = sorted((r.shard, r.n) for r in rows.mapInArrow(run, "shard long, n long").collect())  # a row for each shard
    return folder, manifest


def open_shard(folder: str, shard: int) -> tuple[pa.ipc.RecordBatchFileReader, pa.Table]:
    """A shard's batches (memory-mapped where the folder is local) and its documents."""
    fs, base = _open(folder)
    local = isinstance(fs, pafs.LocalFileSystem)
    name = f"{base}/part-{shard:05d}"
    source = (lambda p: pa.memory_map(p)) if local else fs.open_input_file
    return pa.ipc.open_file(source(f"{name}.arrow")), pa.ipc.open_file(source(f"{name}.docs.arrow")).read_all()


def sequence(reader: pa.ipc.RecordBatchFileReader, row: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row ``row`` of a shard: ids, without a copy, and the two masks."""
    batch, k = reader.get_batch(row // BATCH_ROWS), row % BATCH_ROWS
    return tuple(batch.column(c).slice(k, 1).flatten().to_numpy(zero_copy_only=c == 0) for c in range(3))


def read_documents(spark: SparkSession, folder: str, manifest: list[tuple[int, int]]) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of each document, read back from the files."""
    ship(spark)
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    base, places = 0, []
    for shard, n in manifest:
        places.append((shard, base))
        base += n
    if not places:
        return spark.createDataFrame([], schema)
    todo = spark.createDataFrame(spark.sparkContext.parallelize(places, len(places)), "shard long, base long")

    def run(batches):
        for b in batches:
            for shard, first in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                reader, docs = open_shard(folder, shard)
                starts, sizes = docs.column("start").to_numpy(), docs.column("n_tokens").to_numpy()
                crcs = np.zeros(len(docs), np.int64)
                at, d, crc = 0, 0, 0
                for k in range(reader.num_record_batches):
                    batch = reader.get_batch(k)
                    ids = batch.column(0).flatten().to_numpy()[batch.column(1).flatten().to_numpy(zero_copy_only=False)].astype("<u4")
                    i = 0
                    while i < len(ids):
                        stop = min(len(ids), int(starts[d] + sizes[d]) - at)
                        crc = zlib.crc32(ids[i:stop].tobytes(), crc)
                        i = stop
                        if at + i == starts[d] + sizes[d]:
                            crcs[d], d, crc = crc, d + 1, 0
                    at += len(ids)
                yield pa.RecordBatch.from_arrays([docs.column("doc_id").combine_chunks(), pa.array(starts + first), pa.array(sizes), pa.array(crcs)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return todo.mapInArrow(run, schema)
