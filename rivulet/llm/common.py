"""What the operators of this subpackage share: shared storage, columns, splitting words."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship

__all__ = ["column_name", "cut", "fresh", "id_text", "mix", "ngram_hashes", "replace_column", "shared_dir", "ship", "take_over", "word_hashes"]

_folders: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """A fresh name in this application's folder (``rivulet-APPLICATION``) below ``spark.checkpoint.dir``; where that is unset,
    below a temporary folder if driver and executors are one process, and an error on a cluster. Results may be read late, so nothing is deleted here: drop the application's folder
    when it has ended."""
    app = spark.sparkContext.applicationId
    if app not in _folders:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = base or "file://" + tempfile.mkdtemp(prefix="rivulet-checkpoint-")
        _folders[app] = base.rstrip("/")
    return f"{_folders[app]}/rivulet-{app}/{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: its plan ends there, and lost executors lose nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}-{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def id_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text (null: empty), so that other columns, whatever their names, play no part."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


_holders: dict[str, object] = {}
_owner = ""


def take_over(name: str, release=None) -> None:
    """Called by an operator's tasks: what other operators remember in this Python worker is released, as workers outlive
    stages; ``release`` does so for this one later."""
    global _owner, _powers
    if release is not None:
        _holders[name] = release
    if _owner == name:
        return
    for other, f in _holders.items():
        if other != name:
            f()
    _powers = np.ones(1, np.uint64), np.ones(1, np.uint64)
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # freed memory goes back to the system
        trim(0)
    _owner = name


def fresh(df: DataFrame, name: str) -> str:
    """A name that no column of ``df`` has, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def column_name(df: DataFrame, name: str) -> str:
    """The column's name as ``df`` spells it: found as Spark finds it, exactly if there is such a one, else in any case."""
    return name if name in df.columns else next((c for c in df.columns if c.lower() == name.lower()), name)


def replace_column(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    k = batch.schema.get_field_index(name)
    return batch.set_column(k, batch.schema.field(k), values.cast(batch.schema.field(k).type))


# --- words in bulk: every word of a batch of texts as one 64-bit hash, without a Python object per word

_R = np.uint64(0x9E3779B97F4A7C15 | 1)
_R_INV = np.uint64(pow(int(_R), -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_powers = np.ones(1, np.uint64), np.ones(1, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64))


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) <= n:
        size = max(1 << 16, 2 * n)
        with np.errstate(over="ignore"):
            up, down = np.full(size, _R), np.full(size, _R_INV)
            up[0] = down[0] = 1
            _powers = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
    return _powers


def word_hashes(raw: bytes, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end (bytes) and hash of each maximal run of non-space bytes in ``raw``.

    A prefix polynomial modulo 2**64 is shifted back by the inverse power, so equal words hash alike at any place.
    """
    b = np.frombuffer(raw, np.uint8)
    if not len(b):
        z = np.zeros(0, np.int64)
        return z, z, z.astype(np.uint64)
    word = ~space[b]
    edge = np.diff(word.view(np.int8), prepend=0, append=0)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = _pow(len(b))
    prefix = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_BYTE[b] * up[: len(b)], out=prefix[1:])
    return start, end, mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64))


def ngram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """A hash for every ``n`` consecutive words."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        out = out * np.uint64(0xD6E8FEB86659FD93) + h[k : len(h) - n + 1 + k]
    return mix(out)
