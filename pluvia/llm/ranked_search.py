"""Ranked lexical search by sort-based accumulation.

Documents are read once for a block of items: each leaves its length and the block's terms
that it holds. What a term is worth follows from counts over all documents. Then, in slices
of documents, the items of every term that a document holds are laid side by side with the
document and what the term adds there; a radix sort of the packed (item, document) keys
brings equal pairs together, and one reduceat sums them. A task keeps an item's best
documents in a heap; what tasks keep is range-partitioned by item and rank.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_order, materialize

TOP = 50
#: (item, term) pairs that are searched together; a block has one item more than fits at most.
BLOCK = 300_000
#: Sums that are laid out at once, but for those of one document, and documents of a slice.
SLICE, DOCS = 1 << 21, 1 << 16
#: Terms are runs of digits, letters and all characters from U+0080 on; A-Z count as a-z.
_BLANK = bytes(c for c in range(0x80) if not chr(c).isalnum())
_PLAIN = bytes.maketrans(_BLANK + bytes(range(65, 91)), b" " * len(_BLANK) + bytes(range(97, 123)))


def terms(text: bytes | None) -> list[bytes]:
    """The terms of a text in UTF-8, in order. Bytes of characters beyond U+007F are over 0x7F, so bytes can be told apart."""
    return (text or b"").translate(_PLAIN).split()


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = [(i, t) for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for t in set(terms(text))]
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in out], pa.int64()), pa.array([t for _, t in out], pa.binary())], ["item_id", "term"])


class Block:
    """Some items: a number for each term, and of each term the items that have it."""

    def __init__(self, pairs: list[tuple[int | None, bytes]]):
        self.items = list(dict.fromkeys(i for i, _ in pairs))
        number = {i: n for n, i in enumerate(self.items)}
        self.terms = {t: n for n, t in enumerate(sorted({t for _, t in pairs}))}
        term = np.array([self.terms[t] for _, t in pairs])
        order = np.argsort(term, kind="stable")
        self.item = np.array([number[i] for i, _ in pairs])[order]
        self.many = np.bincount(term, minlength=len(self.terms))
        self.start = np.cumsum(self.many) - self.many


def blocks(items: DataFrame, id_col: str, text_col: str, size: int) -> Iterator[Block]:
    """The items in blocks of about ``size`` different (item, term) pairs, one at a time."""
    rows = items.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    rows = rows.mapInArrow(_pairs, "item_id long, term binary").distinct()
    rows = materialize(rows.repartitionByRange("item_id", "term").sortWithinPartitions("item_id", "term"), "item_terms")
    # range partitions were written in order; a sort of what is read keeps to that whatever the files' sizes
    held: list[tuple[int | None, bytes]] = []
    for r in rows.orderBy("item_id", "term").toLocalIterator():
        if len(held) >= size and r.item_id != held[-1][0]:
            yield Block(held)
            held = []
        held.append((r.item_id, bytes(r.term)))
    if held:
        yield Block(held)


def _matches(docs: DataFrame, block: Block) -> DataFrame:
    """(doc_id, n, terms, tf) of each document that has a term at all: how many, and the block's terms in it."""
    numbers = block.terms

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = terms(text)
                if words:
                    held = np.array([numbers[w] for w in words if w in numbers], np.int64)
                    at, tf = np.unique(held, return_counts=True)
                    out.append((doc, len(words), at.astype("<u4").tobytes(), tf.astype("<u4").tobytes()))
            cols = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["doc_id", "n", "terms", "tf"])

    return docs.mapInArrow(run, "doc_id long, n long, terms binary, tf binary")


def _document_counts(matches: DataFrame, many: int) -> np.ndarray:
    """How many documents hold each of the block's ``many`` terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(many, np.int64)
        for b in batches:
            total += np.bincount(np.frombuffer(b"".join(b.column(0).to_pylist()), "<u4"), minlength=many)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["term", "df"])

    out = np.zeros(many, np.int64)
    for r in matches.select("terms").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toLocalIterator():
        out[r.term] = r.df
    return out


def radix_order(keys: np.ndarray, low: int = 0) -> np.ndarray:
    """The order that sorts whole numbers, from bit ``low`` on, by sixteen bits at a time; what is equal stays in its order."""
    order, top = np.arange(len(keys)), int(keys.max(initial=0))
    while top >> low:
        digit = (keys[order] >> low & 0xFFFF).astype(np.uint16)
        order = order[np.argsort(digit, kind="stable")]  # numpy sorts 16-bit numbers by radix
        low += 16
    return order


def _scored(block: Block, worth: np.ndarray, n_docs: int, n_terms: int, top: int):
    item, many, start = block.item, block.many, block.start

    def sums(length: np.ndarray, term: np.ndarray, tf: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(item, document, score) of all pairs that a slice's terms join; ``doc`` is ascending and below DOCS."""
        m = 50 + 50 * length * n_docs // n_terms
        added = worth[term] * (1_000_000_000 * tf // (1000 * tf + 20 * m[doc]))
        some = added > 0
        term, doc, added = term[some], doc[some], added[some]
        each = many[term]
        ends = np.cumsum(each)
        if not len(ends):
            return (np.zeros(0, np.int64),) * 3
        lane = np.arange(ends[-1]) - np.repeat(ends - each, each)
        key = item[np.repeat(start[term], each) + lane] << 16 | np.repeat(doc, each)
        order = radix_order(key, 16)  # by item; documents are in order already
        key, added = key[order], np.repeat(added, each)[order]
        head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        return key[head] >> 16, key[head] & 0xFFFF, np.add.reduceat(added, head)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps: list[list] = [[] for _ in block.items]
        bar = np.zeros(len(heaps), np.int64)

        def keep(which, doc, score, ids: list) -> None:
            good = score >= bar[which]  # a bar is the least score of a full heap
            for i, d, s in zip(which[good].tolist(), doc[good].tolist(), score[good].tolist(), strict=True):
                heap, entry = heaps[i], (s, -(1 << 63) if ids[d] is None else -ids[d])
                if len(heap) < top:
                    heapq.heappush(heap, entry)
                elif entry > heap[0]:
                    heapq.heapreplace(heap, entry)
                if len(heap) == top:
                    bar[i] = heap[0][0]

        for b in batches:
            ids, length = b.column(0).to_pylist(), b.column(1).to_numpy()
            raw = [b.column(k).to_pylist() for k in (2, 3)]
            held = np.array([len(x) // 4 for x in raw[0]], np.int64)
            term, tf = (np.frombuffer(b"".join(x), "<u4").astype(np.int64) for x in raw)
            doc = np.repeat(np.arange(len(held)), held)
            work = np.cumsum(np.bincount(doc, many[term], len(held))) if len(held) else held
            ends, lo = np.cumsum(held), 0
            while lo < len(held):
                before = work[lo - 1] if lo else 0
                hi = min(max(lo + 1, int(np.searchsorted(work, before + SLICE, "right"))), lo + DOCS)
                here = slice(int(ends[lo - 1]) if lo else 0, int(ends[hi - 1]))
                keep(*sums(length[lo:hi], term[here], tf[here], doc[here] - lo), ids[lo:hi])
                lo = hi
        out = [(block.items[i], None if d == -(1 << 63) else -d, s) for i, heap in enumerate(heaps) for s, d in heap]
        cols = list(zip(*out, strict=True)) or [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["item_id", "doc_id", "score"])

    return run


def search(docs: DataFrame, items: DataFrame, top: int = TOP, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Each item's ``top`` documents with a score above 0: item_id, rank (from 1), doc_id, score.

    A term is a run of ASCII letters, digits and characters from U+0080 on, A-Z as a-z. Of
    N documents with terms, L terms in all, a term that df of them hold weighs
    floor(1000 ln((2N + 2) / (2df + 1))); a document of n terms that has it tf times scores
    that times 10^9 tf div (1000 tf + 20 (50 + 50 n N div L)), summed over the item's terms.
    The order is by score, then doc_id; documents without one come last of equal ones.

    Items are searched in blocks of bounded size; rows of one item_id are one item with the
    terms of all, those without an id too. A null or empty text has no terms: such an item
    has no rows, and such a document counts nowhere. Each row of ``docs`` is a document, so
    repeated rows rank side by side. Empty tables give no rows; extra columns are ignored.
    """
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    found = []
    for part in blocks(items, item_col, item_text_col, block):
        matches = materialize(_matches(src, part), "matches")
        n_docs, n_terms = matches.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not n_docs:
            break
        df = _document_counts(matches, len(part.terms))
        worth = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
        found.append(materialize(matches.mapInArrow(_scored(part, worth, n_docs, n_terms, top), "item_id long, doc_id long, score long"), "best"))
    if not found:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    ranked = in_order(reduce(DataFrame.union, found), ["item_id"], [F.desc("score"), F.asc_nulls_last("doc_id")], "ranked")
    return ranked.where(F.col("rank") < top).select("item_id", (F.col("rank") + 1).cast("int").alias("rank"), "doc_id", "score")


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce({_TERMS}, []) AS w FROM documents),
s AS (SELECT count(*)::BIGINT AS big_n, sum(len(w))::BIGINT AS big_l FROM d WHERE len(w) > 0),
q AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS t FROM benchmark),
tf AS (SELECT r, t, count(*)::BIGINT AS tf FROM (SELECT r, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY ALL),
w AS (SELECT t, floor(1000 * ln((2 * any_value(big_n) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, s GROUP BY t),
m AS (SELECT r, doc_id, 50 + (50 * len(w)::BIGINT * big_n) // big_l AS m FROM d, s),
scores AS (SELECT item_id, r, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
    FROM tf JOIN m USING (r) JOIN w USING (t) JOIN q USING (t) GROUP BY item_id, r),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM scores JOIN m USING (r) WHERE score > 0)
SELECT * FROM ranked WHERE rank <= 50
"""
