"""Byte-level BPE encoding and decoding with recursive queries in DuckDB, one database per Python worker.

Texts are cut at the pre-tokenizer's boundaries; each different piece becomes token-position rows that join the merge
table, and a recursive query contracts the leftmost pair of least rank in every piece until none is left. Decoding joins
id-position rows with the vocabulary and aggregates the bytes in order; documents are put together from their pieces by
ordered aggregation too. Pieces of all lengths go the same way.

A worker remembers the pieces it has seen (about ``CACHE`` of them, ``CACHE_ALONE`` in a round trip; then it forgets the rare ones), so that the recursive query runs
only over new pieces. Null texts count as empty: no ids, no bytes. Null ids give an empty byte string. Repeated rows give
repeated results; an empty table gives an empty one; other columns are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame

from .common import id_text, ship, take_over

#: Most different pieces that a worker remembers: beside a pipeline's other stages, and where nothing else needs its memory.
CACHE, CACHE_ALONE = 300_000, 1_000_000
#: Bytes of pieces in one recursive query, about; a longer piece is taken whole. The query holds the rows of one round, as
#: pieces without a pair leave it at once.
BLOCK = 250_000
#: So often the same pair must stand in a piece for all its places to be looked for in a round.
OFTEN = 4
#: Rows whose texts are Python strings at a time.
ROWS = 1_000

#: ``state`` has a row for each token of each piece: where it stands, where the next one stands, its id and the next one's (-1
#: at the end), ``rk``: twice the rank of the pair of both, one more if the pair is unsafe, null if there is none, and
#: ``often``: whether some pair may stand in the piece ``OFTEN`` times or more.
#: A round finds each piece's leftmost pair of least rank and contracts it, and with it, where the pair is safe and the piece
#: has pairs that often, its other occurrences; in a run of overlapping ones every other. The row of a contracted pair goes;
#: the next row takes its place. Rows of pieces without a pair are ``done``: they are what the query returns.
_CONTRACT_SQL = """
CREATE OR REPLACE TEMP TABLE after AS
WITH RECURSIVE t AS (
  SELECT pid, pos, npos, l, r, rk, often, false AS done FROM state
  UNION ALL
  (WITH b AS (
     SELECT pid, min(rk) AS m, (min((rk::BIGINT << 32) + pos) & 4294967295)::INT AS p, arg_min(npos, (rk::BIGINT << 32) + pos) AS dead
     FROM t WHERE rk IS NOT NULL GROUP BY pid),
   h AS (SELECT t.pid, t.pos, t.npos, m, p, dead FROM t JOIN b ON b.pid = t.pid AND m = rk WHERE often AND pos <> p AND m % 2 = 0),
   e AS (
     SELECT pos, npos, m // 2 AS tok FROM (
       SELECT *, (n - max(CASE WHEN first THEN n END) OVER (PARTITION BY pid ORDER BY pos)) % 2 = 0 AS hit FROM (
         SELECT *, row_number() OVER w AS n, coalesce(lag(npos) OVER w, -1) <> pos AS first
         FROM (SELECT pid, pos, npos, m, p FROM h UNION ALL SELECT DISTINCT pid, p, dead, m, p FROM h)
         WINDOW w AS (PARTITION BY pid ORDER BY pos)))
     WHERE hit AND pos <> p),
   n AS (
     SELECT t.pid, t.npos, t.often,
       CASE WHEN t.pos = dead THEN p ELSE coalesce(x.pos, t.pos) END AS pos,
       CASE WHEN t.pos = dead THEN m // 2 ELSE coalesce(x.tok, t.l) END AS l,
       CASE WHEN t.npos = p THEN m // 2 ELSE coalesce(y.tok, t.r) END AS r, m IS NULL AS done
     FROM t LEFT JOIN b USING (pid) LEFT JOIN e x ON x.npos = t.pos LEFT JOIN e y ON y.pos = t.npos LEFT JOIN e z ON z.pos = t.pos
     WHERE t.often AND NOT t.done AND t.pos IS DISTINCT FROM p AND z.pos IS NULL
     UNION ALL
     SELECT t.pid, t.npos, t.often, CASE WHEN t.pos = dead THEN p ELSE t.pos END,
       CASE WHEN t.pos = dead THEN m // 2 ELSE t.l END, CASE WHEN t.npos = p THEN m // 2 ELSE t.r END, m IS NULL
     FROM t LEFT JOIN b USING (pid) WHERE NOT t.often AND NOT t.done AND t.pos IS DISTINCT FROM p)
   SELECT n.pid, n.pos, n.npos, n.l, n.r, g.rk, n.often, n.done FROM n LEFT JOIN merges g ON g.k = (n.l::BIGINT << 32) + n.r)
)
SELECT pid, pos, npos, l, r, rk, often FROM t WHERE done
"""
#: What each piece has become, from its token rows in order: its ids, and the bytes that they decode to.
_UNITS_SQL = """
SELECT pid + {first}, list(l ORDER BY pos), decode(unhex(string_agg(v.hex, '' ORDER BY pos)))
FROM state JOIN vocab v ON v.id = l GROUP BY pid
"""
#: The bytes of ``seqs`` (k, ids) in order of token.
_DECODE_SQL = """
SELECT k, unhex(string_agg(v.hex, '' ORDER BY i)) AS bytes
FROM (SELECT k, unnest(ids) AS id, generate_subscripts(ids, 1) AS i FROM seqs) JOIN vocab v USING (id)
GROUP BY k ORDER BY k
"""


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge_rows(ranks: dict[bytes, int]) -> dict[str, np.ndarray]:
    """``k`` (left id, right id) of each pair that a merge may contract, and ``rk``: twice the id of both, one more if unsafe.

    A pair is unsafe if a token of lower rank begins or ends with the contracted one: only then can a contraction give a new
    pair that goes before the remaining occurrences.
    """
    opens: dict[bytes, int] = {}
    rows: dict[str, list] = {"k": [], "rk": []}
    for token, rank in ranks.items():
        for k in range(1, len(token)):
            for part in (token[:k], token[k:]):
                opens[part] = min(opens.get(part, rank), rank)
    for token, rank in ranks.items():
        for k in range(1, len(token)):
            left, right = ranks.get(token[:k]), ranks.get(token[k:])
            if left is not None and right is not None:
                rows["k"].append((left << 32) + right)
                rows["rk"].append(2 * rank + (opens.get(token, rank) < rank))
    return {"k": np.array(rows["k"], np.int64), "rk": np.array(rows["rk"], np.int32)}


class Codec:
    """Merge table, vocabulary and remembered pieces of one Python worker; ``history``: bytes of pieces in one recursive query, ``BLOCK`` if not given."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, history: int | None = None, merges: dict[str, np.ndarray] | None = None, cache: int | None = None):
        import duckdb
        import regex

        self.ranks, self.find, self.block = ranks, regex.compile(pattern).findall, history or BLOCK
        self.cache = cache
        # No folder for spills: what a query holds is bounded by the blocks that it is asked for.
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "700MB", "temp_directory": ""})
        self._table("merges", {k: pa.array(v) for k, v in (merges or merge_rows(ranks)).items()})
        self._table("vocab", {"id": pa.array(list(ranks.values()), pa.int32()), "hex": [b.hex() for b in ranks]})
        self.byte_ids = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        self._forget()

    def _table(self, name: str, columns: dict) -> None:
        self._with(pa.table(columns), "incoming", f"CREATE OR REPLACE TEMP TABLE {name} AS SELECT * FROM incoming")

    def _with(self, rows: pa.Table, name: str, sql: str):
        self.db.register(name, rows)
        try:
            found = self.db.sql(sql)
            return found.to_arrow_table() if found is not None else None
        finally:
            self.db.unregister(name)

    def _forget(self) -> None:
        self.codes: dict[str, int] = {}
        self.uses = np.zeros(0, np.int64)
        self.written: list[str] = []
        self.db.execute("CREATE OR REPLACE TEMP TABLE units (code INT, ids INT[], bytes VARCHAR)")

    def _forget_rare(self) -> None:
        """Keeps the pieces that came up more than once, the most used ones if those are too many: half of ``cache``."""
        keep = np.flatnonzero(self.uses > 1)
        if len(keep) > (most := (self.cache or CACHE) // 2):
            keep = np.sort(keep[np.argsort(-self.uses[keep], kind="stable")[:most]])
        names, written = list(self.codes), self.written
        self.codes = {names[k]: i for i, k in enumerate(keep.tolist())}
        self.written = [written[k] for k in keep.tolist()]
        self.uses = self.uses[keep]
        rows = pa.table({"old": pa.array(keep, pa.int32()), "new": np.arange(len(keep), dtype=np.int32)})
        self._with(rows, "kept", "CREATE OR REPLACE TEMP TABLE fewer AS SELECT new AS code, ids, bytes FROM units JOIN kept ON code = old")
        self.db.execute("DROP TABLE units")
        self.db.execute("ALTER TABLE fewer RENAME TO units")

    def contract(self, pieces: list[bytes]) -> None:
        """Leaves ``state`` as it is when no pair is left in any of the pieces, which are not empty."""
        size = np.array([len(p) for p in pieces])
        tok = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        nxt = np.append(tok[1:], -1).astype(np.int32)
        nxt[np.cumsum(size) - 1] = -1
        pos, pid = np.arange(len(tok), dtype=np.int32), np.repeat(np.arange(len(pieces), dtype=np.int32), size)
        # A pair can stand so often in a piece only if the two bytes where its halves meet do.
        pairs = np.sort(((pid[:-1].astype(np.int64) << 32) + tok[:-1].astype(np.int64) * 65536 + tok[1:])[nxt[:-1] >= 0])
        often = np.zeros(len(pieces), bool)
        often[pairs[OFTEN - 1 :][pairs[OFTEN - 1 :] == pairs[: 1 - OFTEN]] >> 32] = True
        start = pa.table({"pid": pid, "often": often[pid], "pos": pos, "npos": pos + np.int32(1), "l": tok, "r": nxt, "k": (tok.astype(np.int64) << 32) + nxt})
        self._with(start, "start", "CREATE OR REPLACE TEMP TABLE state AS SELECT s.* EXCLUDE (k), g.rk FROM start s LEFT JOIN merges g USING (k)")
        self.db.execute(_CONTRACT_SQL)
        self.db.execute("DROP TABLE state")
        self.db.execute("ALTER TABLE after RENAME TO state")

    def _learn(self, pieces: set[str]) -> None:
        """New pieces get codes, ids, and bytes, which are those ids decoded again."""
        whole, parts = [], []
        for p in pieces:
            b = p.encode()
            (whole if b in self.ranks else parts).append((p, b))
        if whole:
            ids = np.array([self.ranks[b] for _, b in whole], np.int32)
            none = pa.nulls(len(ids), pa.int32())
            rows = pa.table({"pid": np.arange(len(ids), dtype=np.int32), "pos": np.zeros(len(ids), np.int32), "npos": none, "l": ids, "r": none, "rk": none})
            self._with(rows, "start", "CREATE OR REPLACE TEMP TABLE state AS SELECT * FROM start")
            self._keep([p for p, _ in whole])
        parts.sort(key=lambda x: len(x[1]))
        while parts:
            block, size = [], 0
            while parts and size < self.block:
                block.append(parts.pop())
                size += len(block[-1][1])
            self.contract([b for _, b in block])
            self._keep([p for p, _ in block])

    def _keep(self, names: list[str]) -> None:
        first = len(self.codes)
        self.codes.update(zip(names, range(first, first + len(names)), strict=True))
        self.db.execute(f"INSERT INTO units {_UNITS_SQL.format(first=first)}")
        self.written += self.db.sql(f"SELECT array_to_string(ids, ' ') AS w FROM units WHERE code >= {first} ORDER BY code").to_arrow_table().column("w").to_pylist()

    def coded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The codes of all pieces of the texts, one text after another, and how many each text has."""
        if len(self.codes) > (self.cache or CACHE):
            self._forget_rare()
        pieces: list[str] = []
        ends = []
        for x in texts:
            pieces += self.find(x)
            ends.append(len(pieces))
        codes = np.fromiter(map(self.codes.get, pieces, repeat(-1)), np.int32, len(pieces))
        fresh = np.flatnonzero(codes < 0).tolist()
        if fresh:
            self._learn({pieces[k] for k in fresh})
            codes[fresh] = [self.codes[pieces[k]] for k in fresh]
        self.uses = np.bincount(codes, minlength=len(self.codes)) + np.pad(self.uses, (0, len(self.codes) - len(self.uses)))
        return codes, np.diff(ends, prepend=0)

    def documents(self, texts: list[str], columns: dict[str, str]) -> pa.Table:
        """``columns``, aggregates over each text's units ``u`` in order ``d.i``, of all texts that are not empty, by ``doc``."""
        codes, sizes = self.coded(texts)
        return self._documents(codes, sizes, columns)

    def _documents(self, codes: np.ndarray, sizes: np.ndarray, columns: dict[str, str]) -> pa.Table:
        rows = pa.table({"doc": np.repeat(np.arange(len(sizes), dtype=np.int32), sizes), "i": np.arange(len(codes), dtype=np.int32), "code": codes})
        wanted = ", ".join(f"{sql} AS {name}" for name, sql in columns.items())
        return self._with(rows, "d", f"SELECT doc, {wanted} FROM d JOIN units u USING (code) GROUP BY doc ORDER BY doc")

    def digests(self, codes: np.ndarray, sizes: np.ndarray) -> list[str]:
        """SHA-256 of each text's ids, in decimal, joined by a space."""
        out, at, written = [], 0, self.written.__getitem__
        for n in sizes.tolist():
            out.append(hashlib.sha256(" ".join(map(written, codes[at : at + n].tolist())).encode()).hexdigest())
            at += n
        return out

    def decode(self, ids: pa.Array) -> list[bytes]:
        """The bytes of each list of ids; empty for a null or empty list."""
        out = [b""] * len(ids)
        got = self._with(pa.table({"k": np.arange(len(ids)), "ids": ids}), "seqs", _DECODE_SQL)
        for k, b in zip(got.column("k").to_pylist(), got.column("bytes").to_pylist(), strict=True):
            out[k] = b
        return out


_codecs: dict[tuple, Codec] = {}


def _release() -> None:
    for c in _codecs.values():
        c.db.close()
    _codecs.clear()


def codec(shared, pattern: str, cache: int | None = None) -> Codec:
    """The worker's own codec for these broadcast ranks."""
    take_over("bpe", _release)
    key = (shared.value["key"], pattern, cache)
    if key not in _codecs:
        _release()
        _codecs[key] = Codec(shared.value["ranks"], pattern, merges=shared.value["merges"], cache=cache)
    return _codecs[key]


def share(spark, path: str):
    """The rank file's rows (a vocabulary, so of bounded size) and the merge table, made once, as a broadcast."""
    ship(spark)
    ranks = read_ranks(path)
    return spark.sparkContext.broadcast({"ranks": ranks, "merges": merge_rows(ranks), "key": hashlib.sha256(repr(sorted(ranks.items())[:1000]).encode() + str(len(ranks)).encode()).hexdigest()})


def blocks(texts: list[str], chars: int = 1_500_000) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about so many characters together; one text is never cut."""
    start = size = 0
    for k, x in enumerate(texts):
        if size and size + len(x) > chars:
            yield start, k
            start, size = k, 0
        size += len(x)
    if start < len(texts):
        yield start, len(texts)


#: What a document's units add up to, in order.
IDS = "flatten(list(u.ids ORDER BY d.i))"
N_TOKENS = "sum(len(u.ids))::BIGINT"
DECODED_SHA256 = "sha256(string_agg(u.bytes, '' ORDER BY d.i))"
_EMPTY = hashlib.sha256(b"").hexdigest()


def _run(df: DataFrame, path: str, pattern: str, id_col: str, text_col: str, columns: dict[str, str], types: dict[str, pa.DataType], ddl: str, cache: int | None = None) -> DataFrame:
    """``doc_id`` and columns of ``types``: those of ``columns``, and ``ids_sha256``."""
    shared = share(df.sparkSession, path)
    schema = pa.schema([("doc_id", pa.int64()), *types.items()])

    def run(batches):
        c = codec(shared, pattern, cache)
        for b, start in ((b, k) for b in batches for k in range(0, b.num_rows, ROWS)):
            docs, texts = b.column(0).slice(start, ROWS), b.column(1).slice(start, ROWS).to_pylist()
            for i, j in blocks(texts):
                codes, sizes = c.coded(texts[i:j])
                got = c._documents(codes, sizes, columns)
                at = np.full(j - i, -1, np.int64)
                at[got.column("doc").to_numpy()] = np.arange(len(got))
                take = pa.array(at, mask=at < 0)
                out = [docs.slice(i, j - i)]
                for name, kind in types.items():
                    if name == "ids_sha256":
                        out.append(pa.array(c.digests(codes, sizes), kind))
                        continue
                    x = got.column(name).combine_chunks().cast(kind).take(take)
                    out.append(_filled(x) if pa.types.is_list(kind) else pa.compute.fill_null(x, _EMPTY if pa.types.is_string(kind) else 0))
                yield pa.RecordBatch.from_arrays(out, schema=schema)

    return id_text(df, id_col, text_col).mapInArrow(run, ddl)


def _filled(x: pa.Array) -> pa.Array:
    """Nulls in an array of lists as empty lists."""
    sizes = pa.compute.fill_null(pa.compute.list_value_length(x), 0).to_numpy(zero_copy_only=False)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), x.flatten())


def encode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """``doc_id``, ``ids array<int>`` of every text; with ``decoded`` also ``decoded_sha256``, the digest of the ids decoded again."""
    columns, types, ddl = {"ids": IDS}, {"ids": pa.list_(pa.int32())}, "doc_id long, ids array<int>"
    if decoded:
        columns["decoded_sha256"], types["decoded_sha256"], ddl = DECODED_SHA256, pa.string(), ddl + ", decoded_sha256 string"
    return _run(df, path, pattern, id_col, text_col, columns, types, ddl)


def decode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id``, ``bytes binary`` of every list of ids; ids outside the vocabulary give no bytes."""
    shared = share(df.sparkSession, path)

    def run(batches):
        c = codec(shared, pattern)
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(c.decode(part.column(1)), pa.binary())], ["doc_id", "bytes"])

    return df.selectExpr(f"cast(`{id_col}` as long) doc_id", f"cast(`{ids_col}` as array<int>) ids").mapInArrow(run, "doc_id long, bytes binary")


def round_trip(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every text, decode the ids; ``doc_id, n_tokens, ids_sha256, decoded_sha256`` in one pass."""
    columns = {"n_tokens": N_TOKENS, "decoded_sha256": DECODED_SHA256}
    types = {"n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}
    return _run(df, path, pattern, id_col, text_col, columns, types, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", CACHE_ALONE)
