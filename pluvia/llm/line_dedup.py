"""Removal of lines that many documents hold, by probing a sharded minimal perfect hash.

1. Each line's key (the line without blanks at its ends, A-Z in lower case) has a 128-bit
   hash. Chunks of documents deal their distinct hashes into shards, each with the largest
   few doc_ids that hold it; a shard keeps as many of all of them. That settles exactly
   whether enough documents hold a key, whatever repeats, and which is the largest.
2. A shard's hashes get a minimal perfect hash: on each level a bit says that exactly one
   hash falls on a place; hashes that share a place go on to the next, smaller level. The
   number of bits before a hash's own is its slot in the shard's arrays of fingerprints,
   counts and largest doc_ids. Shards are rows of a table in the shared folder.
3. Documents probe: their hashes, packed by chunk and shard, meet the arrays of their shard
   and are looked up there; lines are joined with nothing. Only lines that go come back.

Two keys fall together with probability 2^-128 a pair; a key that isn't in the index passes
for one of it with probability 2^-64.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, quoted
from .substring_dedup import _chunks, _grouped

LONG, MANY = 40, 5
#: Bytes of text for each line that a shard is made for, and lines that it holds on average.
LINE, SHARD = 80, 250_000
#: Entries that a shard gathers before it reduces them to the largest doc_ids of each key.
HELD = 1 << 20
#: Places on a level for each hash that is left.
ROOM = 2
#: A row without a doc_id: all of them are one document, smaller than the others.
NOBODY = np.iinfo(np.int64).min
_ARRAYS, _ASK, _DIR = 0, 1, 2
_SENT = "kind int, shard int, chunk long, a binary, b binary, c binary"
_FIELDS = pa.schema([("kind", pa.int32()), ("shard", pa.int32()), ("chunk", pa.int64()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())])
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _place(h: np.ndarray, g: np.ndarray, level: int, size: int) -> np.ndarray:
    """Where hashes fall on a level of ``size`` places."""
    x = h + g * np.uint64(2 * level + 1)
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return ((x ^ (x >> np.uint64(31))) % np.uint64(size)).astype(np.int64)


class PerfectHash:
    """Different (h, g) to the numbers from 0 to their number; ``levels`` are boolean arrays."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels, self.ranks, n = levels, [], 0
        for bits in levels:
            rank = np.cumsum(bits) + (n - 1)
            self.ranks.append(rank)
            n += int(bits.sum())

    @classmethod
    def of(cls, h: np.ndarray, g: np.ndarray) -> PerfectHash:
        levels = []
        while len(h):
            size = -(-ROOM * len(h) // 8) * 8
            at = _place(h, g, len(levels), size)
            levels.append(np.bincount(at, minlength=size) == 1)
            rest = ~levels[-1][at]
            h, g = h[rest], g[rest]
        return cls(levels)

    def slots(self, h: np.ndarray, g: np.ndarray) -> np.ndarray:
        """A slot for each; those of hashes that it wasn't made for mean nothing, or are -1."""
        out, left = np.full(len(h), -1), np.arange(len(h))
        for level, (bits, rank) in enumerate(zip(self.levels, self.ranks, strict=True)):
            at = _place(h[left], g[left], level, len(bits))
            hit = bits[at]
            out[left[hit]] = rank[at[hit]]
            left = left[~hit]
        return out

    def pack(self) -> bytes:
        """The number of levels, their sizes, their bits."""
        head = np.array([len(self.levels), *map(len, self.levels)], "<u4")
        return head.tobytes() + b"".join(np.packbits(b).tobytes() for b in self.levels)

    @classmethod
    def unpack(cls, raw: bytes) -> PerfectHash:
        n = int(np.frombuffer(raw, "<u4", 1)[0])
        sizes, at, levels = np.frombuffer(raw, "<u4", n, 4).tolist(), 4 * (n + 1), []
        for size in sizes:
            levels.append(np.unpackbits(np.frombuffer(raw, np.uint8, size // 8, at)).astype(bool))
            at += size // 8
        return cls(levels)


def _heads(*keys: np.ndarray) -> np.ndarray:
    """Where sorted keys change, for each of them."""
    new = np.ones(len(keys[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return new


def _largest(h: np.ndarray, g: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each key the MANY largest different ids, from large to small; sorted by key."""
    order = np.lexsort((~ids, g, h))
    h, g, ids = h[order], g[order], ids[order]
    one = _heads(h, g, ids)
    h, g, ids = h[one], g[one], ids[one]
    head = np.flatnonzero(_heads(h, g))
    nth = np.arange(len(h)) - np.repeat(head, np.diff(np.append(head, len(h))))
    few = nth < MANY
    return h[few], g[few], ids[few]


def _keys(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each text's first line by number, and of the lines that are long enough: their numbers and two hashes of their keys."""
    first, at, digests, n, digest = [], [], bytearray(), 0, xxhash.xxh3_128_digest
    for text in texts:
        first.append(n)
        lines = (text or b"").split(b"\n")
        for i, line in enumerate(lines, n):
            if len(line) >= LONG:
                key = line.strip().lower()
                if len(key) >= LONG and (key.isascii() or len(key.decode("utf-8", "replace")) >= LONG):
                    at.append(i)
                    digests += digest(key)
        n += len(lines)
    both = np.frombuffer(bytes(digests), "<u8").reshape(-1, 2)
    return np.array(first, np.int64), np.array(at, np.int64), both[:, 0].copy(), both[:, 1].copy()


def _by_shard(h: np.ndarray, shards: int) -> Iterator[tuple[int, np.ndarray]]:
    shard = ((h >> np.uint64(32)) % np.uint64(shards)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    some, cuts = np.unique(shard[order], return_index=True)
    yield from zip(some.tolist(), np.split(order, cuts[1:]), strict=True) if len(h) else ()


def _held(shards: int) -> Callable:
    """Chunks of documents: for each shard its keys, and of each the largest ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _chunks(batches, 2):
            ids = t.column(0).to_numpy()
            first, at, h, g = _keys(t.column(2).to_pylist())
            h, g, ids = _largest(h, g, ids[np.searchsorted(first, at, "right") - 1])
            rows = [(s, h[o].tobytes(), g[o].tobytes(), ids[o].tobytes()) for s, o in _by_shard(h, shards)]
            cols = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int32(), *[pa.binary()] * 3), strict=True)], ["shard", "h", "g", "ids"])

    return run


def _built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by shard: the index of each."""
    now, parts, n = None, [], 0

    def reduced() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return _largest(*(np.concatenate(x) for x in zip(*parts, strict=True)))

    def made() -> pa.RecordBatch:
        h, g, ids = reduced()
        head = np.flatnonzero(_heads(h, g))
        counts, h, g, ids = np.diff(np.append(head, len(h))), h[head], g[head], ids[head]
        perfect = PerfectHash.of(h, g)
        slot = perfect.slots(h, g)
        prints, largest, number = np.empty(len(h), "<u8"), np.empty(len(h), "<i8"), np.empty(len(h), np.uint8)
        prints[slot], largest[slot], number[slot] = g, ids, counts
        return pa.RecordBatch.from_pydict({"kind": [_ARRAYS], "shard": [now], "chunk": [0], "a": [perfect.pack()], "b": [prints.tobytes()], "c": [number.tobytes() + largest.tobytes()]}, _FIELDS)

    for b in batches:
        for shard, *raw in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if shard != now:
                if parts:
                    yield made()
                now, parts, n = shard, [], 0
            parts.append(tuple(np.frombuffer(x, k) for x, k in zip(raw, ("<u8", "<u8", "<i8"), strict=True)))
            n += len(parts[-1][0])
            if n > HELD:
                parts = [reduced()]
                n = len(parts[0][0]) // 2  # so that a shard of many keys isn't reduced again at once
    if parts:
        yield made()


def _asked(shards: int) -> Callable:
    """Chunks of documents: their different hashes by shard, with the lines that have them, and a directory of the chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _chunks(batches, 2):
            ids, ths = t.column(0).to_numpy(), t.column(1).to_numpy()
            first, at, h, g = _keys(t.column(2).to_pylist())
            if not len(at):
                continue
            chunk = xxhash.xxh64_intdigest(ids.tobytes() + ths.tobytes()) - (1 << 63)
            rows = [(_DIR, int(chunk % shards), chunk, ids.tobytes(), ths.tobytes(), first.astype("<u4").tobytes())]
            for s, o in _by_shard(h, shards):
                o = o[np.lexsort((g[o], h[o]))]
                head = np.flatnonzero(_heads(h[o], g[o]))
                times = np.diff(np.append(head, len(o))).astype("<u4")
                rows.append((_ASK, s, chunk, h[o[head]].tobytes() + g[o[head]].tobytes(), times.tobytes(), at[o].astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _FIELDS, strict=True)], schema=_FIELDS)

    return run


def _probed(many: int) -> Callable:
    """Rows sorted by shard, its arrays first: of each chunk the lines whose key ``many`` documents hold, and the largest of those. Directories pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, perfect = None, None
        for b in batches:
            rows = []
            for kind, shard, chunk, x, y, z in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if kind == _DIR:
                    rows.append((kind, shard, chunk, x, y, z))
                elif kind == _ARRAYS:
                    now, perfect, prints = shard, PerfectHash.unpack(x), np.frombuffer(y, "<u8")
                    number, largest = np.frombuffer(z, np.uint8, len(prints)), np.frombuffer(z, "<i8", len(prints), len(prints))
                elif shard == now and len(prints):
                    h, g = np.frombuffer(x, "<u8").reshape(2, -1)
                    slot = perfect.slots(h, g)
                    hit = (slot >= 0) & (prints[slot] == g) & (number[slot] >= many)
                    times = np.frombuffer(y, "<u4")
                    lines = np.frombuffer(z, "<u4")[np.repeat(hit, times)]
                    if len(lines):
                        rows.append((kind, shard, chunk, lines.tobytes(), np.repeat(largest[slot[hit]], times[hit]).astype("<i8").tobytes(), None))
            cols = list(zip(*rows, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _FIELDS, strict=True)], schema=_FIELDS)

    return run


def _by_document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by chunk, its directory first: the lines of each document that go, by number."""

    def settle(directory: tuple, found: list[tuple]) -> Iterator[pa.RecordBatch]:
        ids, ths, first = (np.frombuffer(x, k) for x, k in zip(directory, ("<i8", "<i8", "<u4"), strict=True))
        at, largest = (np.concatenate([np.frombuffer(x[i], k) for x in found]) for i, k in ((0, "<u4"), (1, "<i8")))
        doc = np.searchsorted(first, at, "right") - 1
        gone = ids[doc] != largest
        at, doc = at[gone], doc[gone]
        order = np.argsort(at)
        at, doc = at[order], doc[order]
        some, cuts = np.unique(doc, return_index=True)
        places = [x.astype("<u4").tobytes() for x in np.split(at - first[doc], cuts[1:])] if len(at) else []
        yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(ths[some]), pa.array(places, pa.binary())], ["doc_id", "th", "at"])

    now, directory, found = None, None, []
    for b in batches:
        for kind, chunk, *rest in zip(*(b.column(k).to_pylist() for k in ("kind", "chunk", "a", "b", "c")), strict=True):
            if chunk != now:
                if found:
                    yield from settle(directory, found)
                now, directory, found = chunk, None, []
            if kind == _DIR:
                directory = rest
            else:
                found.append(rest)
    if found:
        yield from settle(directory, found)


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(int(NOBODY))).alias("doc_id"), _hash(text).alias("th"), text.cast("binary").alias("text"))


def _hash(text: Column) -> Column:
    return F.coalesce(F.xxhash64(text), F.lit(0))


def shards_for(docs: DataFrame, text_col: str = "text") -> int:
    size = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
    return 1 + size // (LINE * SHARD)


def index(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per shard that has lines, written to the shared folder: its minimal perfect hash (a), fingerprints (b), counts up to MANY and largest doc_ids (c).

    A shard holds about SHARD keys, and of each at most MANY doc_ids at a time, however
    many documents hold it.
    """
    rows = _source(docs, id_col, text_col).mapInArrow(_held(shards), "shard int, h binary, g binary, ids binary")
    rows = rows.repartition("shard").sortWithinPartitions("shard")
    return materialize(rows.mapInArrow(_built, _SENT), "line_index")


def common_lines(docs: DataFrame, many: int = MANY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, th, told), written to the shared folder: for each document that loses lines, their numbers from 0 as packed 32-bit integers. th is a hash of the text, a null doc_id NOBODY."""
    if not 1 <= many <= MANY:
        raise ValueError(f"many is from 1 to {MANY}")
    shards = shards_for(docs, text_col)
    arrays = index(docs, shards, id_col, text_col)
    asked = _source(docs, id_col, text_col).mapInArrow(_asked(shards), _SENT)
    found = arrays.union(asked).repartition("shard").sortWithinPartitions("shard", "kind").mapInArrow(_probed(many), _SENT)
    found = found.repartition("chunk").sortWithinPartitions("chunk", F.desc("kind")).mapInArrow(_by_document, "doc_id long, th long, at binary")
    return materialize(_grouped(found), "common_lines")


def _cut(text: bytes | None, told: bytes | None) -> tuple[int, int, bytes]:
    """The number of lines, how many go, and the rest."""
    lines = (text or b"").split(b"\n")
    if not told:
        return len(lines), 0, text or b""
    gone = set(np.frombuffer(told, "<u4").tolist())
    return len(lines), len(gone), b"\n".join([x for i, x in enumerate(lines) if i not in gone])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = [_cut(text, told) for text, told in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
        cols = [[n for n, _, _ in out], [g for _, g, _ in out], [hashlib.sha256(k).hexdigest() for _, _, k in out]]
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string()), strict=True))], ["doc_id", "n_lines", "n_dropped", "kept_sha256"])


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", many: int = MANY) -> DataFrame:
    """One row per document: doc_id, n_lines (before), n_dropped, kept_sha256 (of the lines that stay, joined by newlines, in UTF-8).

    Lines whose key has at least LONG code points and stands in at least ``many`` documents
    go from all of them but the one with the largest doc_id, which keeps all of its own.
    Documents are told apart by doc_id: rows that repeat one are one document to the count
    and lose the same lines. Rows without a doc_id together are one, smaller than all others.
    A null or empty text is one empty line. An empty table gives no rows; extra columns are
    ignored.
    """
    text = F.col(text_col).cast("string")
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(id_col).cast("long"), F.lit(int(NOBODY))).alias("doc_id"), _hash(text).alias("th"), text.cast("binary").alias("text"))
    # never by broadcast: what is told of documents grows with the table
    rows = own.join(common_lines(docs, many, id_col, text_col).hint("merge"), ["doc_id", "th"], "left").select("id", "text", "told")
    return rows.mapInArrow(_digests, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


def without_common_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", many: int = MANY) -> DataFrame:
    """``docs`` without those lines: all rows and columns stay, and so do texts that lose nothing, nulls too."""

    @F.pandas_udf("string")
    def cut(text: pd.Series, told: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else _cut(t.encode(), x)[2].decode() for t, x in zip(text, told, strict=True)], dtype=object)

    own = docs.select(F.struct(*quoted(docs)).alias("row"), F.coalesce(F.col(id_col).cast("long"), F.lit(int(NOBODY))).alias("doc_id"), _hash(F.col(text_col).cast("string")).alias("th"))
    rows = own.join(common_lines(docs, many, id_col, text_col).hint("merge"), ["doc_id", "th"], "left")
    text, some = F.col("row").getField(text_col), F.col("told").isNotNull()
    new = F.when(some, cut(F.when(some, text.cast("string")), F.col("told"))).otherwise(text)
    return rows.select(F.col("row").withField(text_col, new).alias("row")).select("row.*")


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (SELECT r, doc_id, t.i, ls[t.i] AS line, translate(regexp_replace(ls[t.i], '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM d, unnest(range(1, len(ls) + 1)) AS t(i)),
common AS (SELECT k, max(doc_id) AS m FROM lines WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
told AS (SELECT r, doc_id, i, line, coalesce(m <> doc_id, false) AS gone FROM lines LEFT JOIN common ON lines.k = common.k)
SELECT any_value(doc_id) AS doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (gone))::BIGINT AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM told GROUP BY r
"""
