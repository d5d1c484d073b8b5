"""Removal of word passages that earlier documents hold, found by difference-cover anchors.

With the difference cover {0, 1, 3} of 7, any two positions have an offset below 7
that takes both to a cover position. So two equal windows of 13 words always hold an
equal anchor of 7 words that starts at a cover position in either document. The work
is in three passes:

1. Anchors at cover positions are hashed and dealt into buckets; a bucket says which
   of them more than one document holds.
2. Windows around such anchors are the candidates. Their whole 13 words are hashed
   and dealt into buckets; a bucket says which have a copy in a document with a
   smaller doc_id.
3. The words that those windows cover go.

Anchors decide only which windows are looked at: a collision there costs time and
changes nothing. Windows are compared by 96-bit hashes of their words: of 10^12 windows
no two different ones fall together, but with a probability of 10^-5.

Rows in motion stand for chunks of documents, with packed arrays, so that an anchor
costs four bytes and its place, which is sent as the distance to the one before.
A chunk sends one entry for a hash that several of its documents
hold and settles the others itself, so a passage that a third of the documents share
costs a bucket one entry a chunk.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, quoted

WINDOW = 13
PERIOD = 7
COVER = (0, 1, 3)
ANCHOR = WINDOW - PERIOD + 1
CHUNK_BYTES = 4 << 20
CHUNK_DOCS = 4096
#: Entries that a bucket holds on average.
BUCKET = 300_000
#: Tables with fewer entries than so many full buckets have as many buckets of at least LEAST entries, for more tasks to share them.
SPREAD, LEAST = 512, 20_000

_SENT = "kind int, bucket int, chunk long, keys binary, at binary, docs binary"
_ASK, _TELL, _DIR = 0, 1, 2
_R = np.uint64(0x9E3779B97F4A7C15)
_RI = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_Q = np.uint64(0xD6E8FEB86659FD93)
_LOW = np.uint64(0xFFFFFFFF)
_BLOCK = 1 << 18


def _powers(base: np.uint64, n: int) -> np.ndarray:
    x = np.full(n, base, np.uint64)
    x[0] = 1
    return np.multiply.accumulate(x)


_UP, _DOWN = _powers(_R, _BLOCK), _powers(_RI, _BLOCK)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _Q
    return x ^ (x >> np.uint64(29))


class Words:
    """The words of some texts in one buffer; first: each text's first word, and their number."""

    def __init__(self, texts: list[bytes | None]):
        joined = [b" ".join(t.split()) if t else b"" for t in texts]
        counts = np.array([j.count(b" ") + 1 if j else 0 for j in joined], np.int64)
        self.buf = b" ".join(j for j in joined if j)
        self.first = np.concatenate([[0], np.cumsum(counts)])
        self.counts = counts
        self.bytes = np.frombuffer(self.buf, np.uint8)
        gaps = np.flatnonzero(self.bytes == 32)
        some = bool(self.buf)
        self.starts = np.concatenate([[0], gaps + 1])[: len(gaps) + some]
        self.ends = np.concatenate([gaps, [len(self.buf)]])[: len(gaps) + some]

    def hashes(self) -> np.ndarray:
        """A hash of each word, in blocks of bounded size; words longer than a block by xxHash."""
        out = np.empty(len(self.starts), np.uint64)
        i, n = 0, len(self.starts)
        while i < n:
            lo = self.starts[i]
            j = int(np.searchsorted(self.ends, lo + _BLOCK, "right"))
            if j <= i:
                out[i] = xxhash.xxh64_intdigest(self.buf[lo : self.ends[i]])
                i += 1
                continue
            part = self.bytes[lo : self.ends[j - 1]].astype(np.uint64) + np.uint64(1)
            part *= _UP[: len(part)]
            total = np.concatenate([[np.uint64(0)], np.cumsum(part, dtype=np.uint64)])
            s, e = self.starts[i:j] - lo, self.ends[i:j] - lo
            out[i:j] = _mix((total[e] - total[s]) * _DOWN[s])
            i = j
        return out


def _chunks(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[pa.Table]:
    held, size, rows = [], 0, 0
    for b in batches:
        lengths = pa.compute.fill_null(pa.compute.binary_length(b.column(text)), 0).to_numpy(zero_copy_only=False)
        at = 0
        for i, n in enumerate(lengths.tolist()):
            if rows and (size + n > CHUNK_BYTES or rows >= CHUNK_DOCS):
                held.append(b.slice(at, i - at))
                yield pa.Table.from_batches(held)
                held, size, rows, at = [], 0, 0, i
            size += n
            rows += 1
        held.append(b.slice(at))
    if rows:
        yield pa.Table.from_batches(held)


def _rows(kind, chunk, bucket=(), keys=(), at=(), docs=()) -> pa.RecordBatch:
    n = len(bucket)
    lists = [list(x) or [None] * n for x in (keys, at, docs)]
    arrays = [pa.array([kind] * n, pa.int32()), pa.array(bucket, pa.int32()), pa.array([chunk] * n, pa.int64())]
    return pa.RecordBatch.from_arrays(arrays + [pa.array(x, pa.binary()) for x in lists], ["kind", "bucket", "chunk", "keys", "at", "docs"])


def _heads(keys: list[np.ndarray]) -> np.ndarray:
    """Where a new key begins in sorted ``keys``, which one or two arrays make up."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _packed(at: np.ndarray) -> bytes:
    """Ascending places as distances, byte by byte: the high bytes are zero and cost nothing once compressed."""
    return np.diff(at, prepend=0).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").ravel(), dtype=np.uint32)


def _sent(ids: np.ndarray, ths: np.ndarray, w: Words, at: np.ndarray, keys: list[np.ndarray], buckets: int, exact: bool) -> Iterator[pa.RecordBatch]:
    """Questions to the buckets about the entries (word, key) of a chunk, what the chunk knows itself, and its directory."""
    chunk = xxhash.xxh64_intdigest(ids.tobytes() + ths.tobytes()) - (1 << 63)
    doc = np.searchsorted(w.first, at, "right") - 1
    order = np.lexsort((at, ids[doc], *keys))
    at, keys, doc = at[order], [k[order] for k in keys], doc[order]
    head = _heads(keys)
    run = np.repeat(np.arange(len(head)), np.diff(np.concatenate([head, [len(at)]])))
    first = ids[doc[head]][run] == ids[doc]  # of the document with the smallest doc_id
    if exact:
        tell, ask = at[~first], first
    else:
        several = np.zeros(len(head), bool)
        several[run[~first]] = True
        tell = at[several[run]]
        ask = ~several[run]
        ask[head] = True
    home = int(chunk % buckets)
    if len(tell):
        yield _rows(_TELL, chunk, [home], at=[tell.astype("<u4").tobytes()])
    at, doc, keys = at[ask], doc[ask], np.stack(keys, 1)[ask]
    bucket = ((keys[:, 0] >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((at, bucket))
    at, keys, doc, bucket = at[order], keys[order], doc[order], bucket[order]
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    spans = list(zip([0, *cuts.tolist()], [*cuts.tolist(), len(bucket)], strict=True)) if len(bucket) else []
    packed = keys.astype("<u8").view("<u4")[:, : 3 if exact else 1]
    dirs = []
    for a, b in spans if exact else ():
        d = np.unique(doc[a:b])
        dirs.append(zlib.compress(ids[d].tobytes() + w.first[d].astype("<u4").tobytes(), 1))
    if spans:
        yield _rows(_ASK, chunk, [int(bucket[a]) for a, _ in spans], [packed[a:b].tobytes() for a, b in spans], [_packed(at[a:b]) for a, b in spans], dirs)
    yield _rows(_DIR, chunk, [home], docs=[ids.tobytes() + ths.tobytes() + w.first[:-1].astype("<u4").tobytes()])


def _anchors(buckets: int) -> Callable:
    cover = np.isin(np.arange(PERIOD), COVER)

    def run(batches):
        for t in _chunks(batches, 2):
            ids, ths = t.column(0).to_numpy(), t.column(1).to_numpy()
            w = Words(t.column(2).to_pylist())
            pos = np.arange(len(w.starts)) - np.repeat(w.first[:-1], w.counts)
            n = np.repeat(w.counts, w.counts)
            at = np.flatnonzero(cover[pos % PERIOD] & (pos + ANCHOR <= n) & (n >= WINDOW))
            h, keys = w.hashes(), np.zeros(len(at), np.uint64)
            for j in range(ANCHOR):
                keys = keys * _Q + h[at + j]
            if len(at):
                yield from _sent(ids, ths, w, at, [_mix(keys)], buckets, False)

    return run


def _windows(buckets: int) -> Callable:
    def run(batches):
        for t in _chunks(batches, 2):
            ids, ths = t.column(0).to_numpy(), t.column(1).to_numpy()
            w, at = Words(t.column(2).to_pylist()), []
            for i, told in enumerate(t.column(3).to_pylist()):
                pos = np.frombuffer(told, "<u4").astype(np.int64)
                mark = np.zeros(w.counts[i] + PERIOD, bool)
                for d in range(PERIOD):
                    mark[np.maximum(pos - d, 0)] = True
                at.append(np.flatnonzero(mark[: max(0, w.counts[i] - WINDOW + 1)]) + w.first[i])
            at = np.concatenate(at)
            digest, buf = xxhash.xxh3_128_digest, w.buf
            pairs = zip(w.starts[at].tolist(), w.ends[at + WINDOW - 1].tolist(), strict=True)
            keys = np.frombuffer(b"".join(digest(buf[a:b]) for a, b in pairs), "<u8").reshape(-1, 2)
            if len(at):
                yield from _sent(ids, ths, w, at, [keys[:, 0], keys[:, 1] & _LOW], buckets, True)

    return run


def _answers(exact: bool) -> Callable:
    """What a bucket finds; rows come sorted by bucket. Told entries and directories pass."""

    def settle(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        if not rows:
            return
        raw = np.frombuffer(b"".join(k for _, k, _, _ in rows), "<u4").reshape(-1, 3 if exact else 1)
        keys = [np.ascontiguousarray(raw[:, :2]).view("<u8").ravel(), raw[:, 2]] if exact else [raw[:, 0]]
        places = [_unpacked(a) for _, _, a, _ in rows]
        at, size = np.concatenate(places), [len(a) for a in places]
        place = np.repeat(np.arange(len(rows)), size)
        if exact:
            who = []
            for a, (*_, d) in zip(places, rows, strict=True):
                raw = zlib.decompress(d)
                n = len(raw) // 12
                who.append(np.frombuffer(raw, "<i8", n)[np.searchsorted(np.frombuffer(raw, "<u4", n, 8 * n), a, "right") - 1])
            who = np.concatenate(who)
        else:
            who = np.array([c for c, *_ in rows], np.int64)[place]
        order = np.lexsort((who, *keys))
        keys, who = [k[order] for k in keys], who[order]
        head = _heads(keys)
        run = np.repeat(np.arange(len(head)), np.diff(np.concatenate([head, [len(who)]])))
        later = who != who[head][run]
        if not exact:
            later = np.isin(run, np.unique(run[later]))
        hit = order[later]
        hit = hit[np.argsort(place[hit], kind="stable")]
        cuts = np.flatnonzero(np.diff(place[hit])) + 1
        for part in np.split(hit, cuts) if len(hit) else ():
            yield _rows(_TELL, rows[place[part[0]]][0], [0], at=[at[part].astype("<u4").tobytes()])

    def run(batches):
        rows, now = [], None
        for b in batches:
            own = b.column(0).to_numpy() == _ASK
            if not own.all():
                yield b.filter(pa.array(~own))
            for bucket, chunk, k, a, d in zip(*(b.filter(pa.array(own)).column(i).to_pylist() for i in range(1, 6)), strict=True):
                if bucket != now:
                    yield from settle(rows)
                    rows, now = [], bucket
                rows.append((chunk, k, a, d))
        yield from settle(rows)

    return run


def _by_document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by chunk, its directory first: each document's told places."""

    def settle(raw, at):
        if raw is None or not at:
            return
        n = len(raw) // 20
        ids, ths, first = np.frombuffer(raw, "<i8", n), np.frombuffer(raw, "<i8", n, 8 * n), np.frombuffer(raw, "<u4", n, 16 * n)
        at = np.unique(np.concatenate([np.frombuffer(x, "<u4") for x in at]))
        doc = np.searchsorted(first, at, "right") - 1
        some, cuts = np.unique(doc, return_index=True)
        places = [x.tobytes() for x in np.split(at - first[doc], cuts[1:])]
        yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(ths[some]), pa.array(places, pa.binary())], ["doc_id", "th", "at"])

    now, raw, at = None, None, []
    for b in batches:
        for kind, chunk, a, d in zip(*(b.column(i).to_pylist() for i in (0, 2, 4, 5)), strict=True):
            if chunk != now:
                yield from settle(raw, at)
                now, raw, at = chunk, None, []
            if kind == _DIR:
                raw = d
            else:
                at.append(a)
    yield from settle(raw, at)


def _told(src: DataFrame, ask: Callable, buckets: int, exact: bool, name: str) -> DataFrame:
    """(doc_id, th, at): the places in each document of which a bucket or the chunk itself said yes."""
    out = src.mapInArrow(ask, _SENT).repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_answers(exact), _SENT)
    out = out.repartition("chunk").sortWithinPartitions("chunk", F.desc("kind")).mapInArrow(_by_document, "doc_id long, th long, at binary")
    return materialize(out, name)


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by document: one row for each, with all its places. They are merged as they come, so that a repeated row's lists pile up nowhere."""
    now, at = None, np.zeros(0, np.uint32)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        cols = zip(*rows, strict=True) if rows else ([], [], [])
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.binary()), strict=True)], ["doc_id", "th", "told"])

    for b in batches:
        out = []
        for doc, th, x in zip(*(c.to_pylist() for c in b.columns), strict=True):
            new = np.frombuffer(x, "<u4")
            if now == (doc, th):
                at = np.union1d(at, new)
                continue
            if now is not None:
                out.append((*now, at.tobytes()))
            now, at = (doc, th), new
        yield batch(out)
    if now is not None:
        yield batch([(*now, at.tobytes())])


def _grouped(told: DataFrame) -> DataFrame:
    """(doc_id, th, told): one row a document; there are several to merge only where chunks hold the same row again."""
    keys = ["doc_id", "th"]
    return told.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_merged, "doc_id long, th long, told binary")


def _buckets(entries: float) -> int:
    return 1 + int(max(entries // BUCKET, min(SPREAD, entries // LEAST)))


def _kept(text: bytes | None, told: bytes | None) -> tuple[int, int, bytes]:
    """The number of words, how many go, and the rest."""
    words = (text or b"").split()
    if not told:
        return len(words), 0, b" ".join(words)
    cover = np.zeros(len(words) + WINDOW, np.int64)
    at = np.frombuffer(told, "<u4").astype(np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + WINDOW, -1)
    stay = np.flatnonzero(np.cumsum(cover)[: len(words)] == 0).tolist()
    return len(words), len(words) - len(stay), b" ".join([words[i] for i in stay])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = [_kept(text, told) for text, told in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
        cols = [[n for n, _, _ in out], [g for _, g, _ in out], [hashlib.sha256(k).hexdigest() for _, _, k in out]]
        types = (pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], ["doc_id", "n_words", "n_removed", "kept_sha256"])


def _places(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, th, told): where the windows start of which an earlier document has a copy."""
    text = F.col(text_col).cast("string")
    src = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), _hash(text).alias("th"), text.cast("binary").alias("text"))
    size = src.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = _buckets(size / 15)
    told = _told(src, _anchors(buckets), buckets, False, "anchors")
    entries = told.agg(F.sum(F.octet_length("at"))).first()[0] or 0
    buckets = _buckets(entries / 2)
    told = _told(src.join(_grouped(told), ["doc_id", "th"]), _windows(buckets), buckets, True, "windows")
    return _grouped(told)


def _hash(text: Column) -> Column:
    return F.coalesce(F.xxhash64(text), F.lit(0))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256.

    Words are runs of characters other than space and U+0009..U+000D, unchanged. A
    word goes if a window of 13 consecutive words covers it whose sequence also
    starts in a document with a smaller doc_id. kept_sha256 is the digest of the
    kept words, joined by single spaces, in UTF-8.

    A null text has no words. A row without a doc_id loses nothing and takes
    nothing from others. Of rows that repeat a doc_id none counts as earlier.
    An empty table gives no rows; extra columns are ignored.
    """
    text = F.col(text_col).cast("string")
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), _hash(text).alias("th"), text.cast("binary").alias("text"))
    out = own.join(_places(docs, id_col, text_col), ["doc_id", "th"], "left").select("doc_id", "text", "told")
    return out.mapInArrow(_digests, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the repeated words gone: such a text becomes its kept words joined by single spaces; others stay as they are.

    Rows stay, also those of which nothing is left, and so do null texts and rows
    without a doc_id. An empty table gives no rows; columns keep their names and order.
    """

    @F.pandas_udf("string")
    def cut(text: pd.Series, told: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else _kept(t.encode(), x)[2].decode() for t, x in zip(text, told, strict=True)], dtype=object)

    own = docs.select(F.struct(*quoted(docs)).alias("row"), F.col(id_col).cast("long").alias("doc_id"), _hash(F.col(text_col).cast("string")).alias("th"))
    rows = own.join(_places(docs, id_col, text_col), ["doc_id", "th"], "left")
    text, some = F.col("row").getField(text_col), F.col("told").isNotNull()
    new = F.when(some, cut(F.when(some, text.cast("string")), F.col("told"))).otherwise(text)
    return rows.select(F.col("row").withField(text_col, new).alias("row")).select("row.*")


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
win AS (SELECT r, doc_id, t.i, array_to_string(w[t.i:t.i+12], ' ') AS s FROM d, unnest(range(1, len(w) - 11)) AS t(i)),
hit AS (SELECT r, i FROM (SELECT r, doc_id, i, min(doc_id) OVER (PARTITION BY s) AS m FROM win) WHERE m < doc_id),
gone AS (SELECT r, list(DISTINCT i + j) AS cut FROM hit, range(0, 13) AS u(j) GROUP BY r),
k AS (SELECT doc_id, w, coalesce(cut, []) AS c, list_filter(w, lambda x, i: NOT list_contains(coalesce(cut, []), i)) AS kept FROM d LEFT JOIN gone ON d.r = gone.r)
SELECT doc_id, len(w)::BIGINT AS n_words, len(c)::BIGINT AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k
"""
