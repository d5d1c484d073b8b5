"""Best-fit packing of tokenized documents into sequences."""

from __future__ import annotations

import base64
import zlib
from collections.abc import Callable, Iterator
from functools import cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from .common import in_order, materialize

CAPACITY = 1024
EOS = 2
END_OF_TEXT = "<|endoftext|>"
END_OF_TEXT_ID = 50256
#: Chunks of text whose ids a worker remembers.
CACHE = 400_000
#: Bytes of text that are cut into chunks at once.
AT_ONCE = 16 << 20
#: Pieces of less than this part of a sequence are placed in runs of up to it.
RUN = 16
#: A gap goes into a sweep as up to so many parts (a power of two), each at least one and a half times the largest run that is left.
PARTS = 16
#: Bits of a run's number that hold the rank of its first piece; the others hold the size.
RANK = 50


def _white(data: np.ndarray) -> np.ndarray:
    return (data == 0x20) | ((data >= 0x09) & (data <= 0x0D))


def _solid(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the characters of UTF-8 ``data`` that end before the places ``at`` are, for sure, no white space."""
    last = data[at - 1]
    solid = last > 0x20
    # wide white space is U+0085, U+00A0, U+1680, U+2000 to U+205F and U+3000; what begins like it counts as such
    wide = np.flatnonzero(last >= 0x80)
    second, third = data[np.maximum(at[wide] - 2, 0)], data[np.maximum(at[wide] - 3, 0)]
    solid[wide] = ~((second == 0xC2) | ((third == 0xE1) & (second == 0x9A)) | ((third == 0xE2) & (second <= 0x81)) | ((third == 0xE3) & (second == 0x80)))
    return solid


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a large string or binary array without nulls, and where its values begin and the last one ends."""
    _, ends, data = texts.buffers()
    ends = np.frombuffer(ends, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    return np.frombuffer(data or b"", np.uint8)[ends[0] : ends[-1]], ends - ends[0]


class Encoder:
    """Ids as little-endian 32-bit integers, equal to those of byte_bpe_50k.json by ``tokenizers`` without special tokens added.

    The same vocabulary in tiktoken is faster. Texts are cut before white space that
    follows another character, where the tokenizer's pattern always splits, as its only
    matches with white space after the first character are white space throughout.
    """

    def __init__(self, path: str | None = None):
        import public_tokenizers as P
        import tiktoken

        with open(path or P.path("byte_bpe_50k.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        bpe = tiktoken.Encoding("byte_bpe_50k", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.widths = np.zeros(max(ranks.values()) + 1, np.int64)
        self.widths[list(ranks.values())] = [len(a) for a in ranks]
        self.plain = lambda text: np.asarray(bpe.encode_to_numpy(text, disallowed_special=()), "<u4")
        self.known: dict[str, bytes] = {}

    def __call__(self, text: str) -> bytes:
        """The ids of one text; those of short texts are remembered."""
        ids = self.known.get(text)
        if ids is None:
            end = np.array([END_OF_TEXT_ID], "<u4").tobytes()
            ids = end.join(self.plain(t).tobytes() for t in text.split(END_OF_TEXT))
            if len(text) < 64:
                if len(self.known) >= CACHE:
                    self.known.clear()
                self.known[text] = ids
        return ids

    def _distinct(self, chunks: pa.Array) -> pa.Array:
        """The ids of each of ``chunks`` (large binary, all different).

        Chunks from white space to a character that is none split from each other
        where they meet, so that one call encodes them all.
        """
        data, ends = _bytes_of(chunks)
        joint = _white(data[ends[:-1]]) & _solid(data, ends[1:])
        joint &= ~pc.match_substring(chunks, END_OF_TEXT.encode()).to_numpy(zero_copy_only=False)
        mask = pa.array(joint)
        text, cuts = _bytes_of(chunks.filter(mask))
        ids = self.plain(text.tobytes().decode())
        at = np.searchsorted(np.cumsum(self.widths[ids]), cuts, side="right") * 4
        one_call = pa.Array.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(at), pa.py_buffer(ids)])
        alone = pa.array([self(c.decode()) for c in chunks.filter(pc.invert(mask)).to_pylist()], pa.large_binary())
        order = np.where(joint, np.cumsum(joint) - 1, len(one_call) + np.cumsum(~joint) - 1)
        return pa.concat_arrays([one_call, alone]).take(pa.array(order))

    def many(self, texts: pa.Array) -> tuple[memoryview, list[int]]:
        """The ids of ``texts`` (null: none) one after another, and the places in bytes where each text's begin and the last ones end.

        Each different chunk of all texts is encoded once, and Arrow puts the ids in order.
        """
        data, ends = _bytes_of(pc.fill_null(texts.cast(pa.large_string()), ""))
        if not len(data):
            return memoryview(b""), [0] * len(ends)
        first = np.append(_white(data), True)
        first[0] = False
        at = np.flatnonzero(first)
        first[at] = _solid(data, at)
        first[ends] = True
        cuts = np.flatnonzero(first)
        chunks = pa.Array.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts), pa.py_buffer(data)]).dictionary_encode()
        ids, places = _bytes_of(self._distinct(chunks.dictionary).take(chunks.indices))
        return memoryview(ids), places[np.searchsorted(cuts, ends)].tolist()


@cache
def encoder(path: str | None = None) -> Encoder:
    """The encoder of a tiktoken file, by default the public byte_bpe_50k; a worker keeps it from task to task."""
    return Encoder(path)


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each document's ids and an end mark, cut only if longer than ``capacity``; the first piece takes what is left over.

    A null or empty text is the end mark alone. Null doc_ids and repeated rows stay, an empty table gives no pieces.
    """

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows of ``batches`` in order, with texts of about AT_ONCE bytes in each."""
        for b in batches:
            nth = np.cumsum(pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy(), dtype=np.int64) // AT_ONCE
            edges = [0, *(np.flatnonzero(np.diff(nth)) + 1).tolist(), b.num_rows]
            yield from (b.slice(a, z - a) for a, z in zip(edges, edges[1:], strict=False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(tokenizer), np.array([EOS], "<u4").tobytes()
        for b in parts(batches):
            rows: list[tuple] = []
            data, at = encode.many(b.column(1))
            for doc, left, right in zip(b.column(0).to_pylist(), at, at[1:], strict=False):
                ids = data[left:right].tobytes() + end
                n = len(ids) // 4
                cuts = [0, *range(n % capacity or capacity, n, capacity), n]
                rows += [(doc, i, a, z - a, zlib.crc32(ids[4 * a : 4 * z])) for i, (a, z) in enumerate(zip(cuts, cuts[1:], strict=False))]
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            types = (b.column(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one range in order, with ``part`` (the range), ``at`` (the place in it), ``level`` and ``total``.

    A gap takes the running count one step up and a piece one step down; the level
    is the upper end of the step, counted from the start of the range, and total is
    the count after it.
    """
    part, at, count = TaskContext.get().partitionId(), 0, 0
    for b in batches:
        step = 1 - 2 * b.column("kind").to_numpy().astype(np.int64)
        after = count + np.cumsum(step)
        n = len(step)
        cols = [*b.columns, pa.array(np.full(n, part, np.int32)), pa.array(np.arange(at, at + n)), pa.array(np.maximum(after, after - step)), pa.array(after)]
        yield pa.RecordBatch.from_arrays(cols, ["size", "kind", "id", "part", "at", "level", "total"])
        at, count = at + n, int(after[-1]) if n else count


def sweep(gaps: DataFrame, rest: DataFrame) -> DataFrame:
    """One successor sweep of pieces (id, size) over gaps (id, size): rows (kind, id, size, piece, taken), written to the shared folder.

    Gaps (kind 0) and pieces (kind 1) are range-sorted together from large to small,
    gaps before pieces of their size. Read in that order, a piece's successor is the
    smallest gap so far that no piece before it took. So gaps are opening and pieces
    closing brackets, and a piece gets the gap that it closes. Brackets match if they
    lie next to each other on one level of the running count; each range counts by
    itself, one number a range says where its count starts, and a level is crossed
    at most twice for each size, so no group of the second shuffle is large.

    A gap's row has the piece that it takes and that piece's size, or null; a
    piece's row has its gap as ``piece`` or null.
    """
    kinds = gaps.select("size", F.lit(0).alias("kind"), "id").union(rest.select("size", F.lit(1).alias("kind"), "id"))
    order = [F.desc("size"), F.asc("kind"), F.asc("id")]
    ranged = kinds.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_steps, "size int, kind int, id long, part int, at long, level long, total long")
    ranged = materialize(ranged, "ranged", free=False)
    ends = ranged.groupBy("part").agg(F.max_by("total", "at").alias("total")).withColumnRenamed("part", "of")
    before = Window.orderBy("of").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    starts = ends.select("of", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("start"))
    level = Window.partitionBy("level").orderBy("part", "at")
    rows = ranged.join(F.broadcast(starts), F.col("part") == F.col("of")).withColumn("level", F.col("level") + F.col("start"))
    rows = rows.select("kind", "id", "size", *[f("kind").over(level).alias(n) for n, f in (("next", F.lead), ("last", F.lag))], F.lead("id").over(level).alias("to"), F.lag("id").over(level).alias("by"), F.lead("size").over(level).alias("need"))
    opens, closes = (F.col("kind") == 0) & (F.col("next") == 1), (F.col("kind") == 1) & (F.col("last") == 0)
    return materialize(rows.select("kind", "id", "size", F.when(opens, F.col("to")).when(closes, F.col("by")).alias("piece"), F.when(opens, F.col("need")).alias("taken")), "swept", free=False)


def _halved(units: DataFrame) -> DataFrame:
    """Runs of several pieces as two of half as many."""
    few, at = F.expr(f"size div shiftright(id, {RANK})"), F.expr(f"shiftright(id, {RANK})")
    first = F.expr("cast(n div 2 as int)")
    parts = F.when(F.col("n") > 1, F.array(F.struct(F.col("id").alias("id"), (first * F.col("s")).alias("size")), F.struct((F.col("id") + first).alias("id"), ((F.col("n") - first) * F.col("s")).alias("size"))))
    one = F.array(F.struct(F.col("id").alias("id"), F.col("size").alias("size")))
    rows = units.select("id", "size", few.cast("int").alias("n"), at.cast("int").alias("s"))
    return rows.select(F.explode(F.coalesce(parts, one)).alias("u")).select("u.id", F.col("u.size").cast("int").alias("size"))


def place(sizes: DataFrame, capacity: int = CAPACITY) -> list[DataFrame]:
    """(id, sequence_id, offset) of the pieces (id long, size int) of up to half the capacity, as tables to be united; ids are unique and not negative.

    Bulk-synchronous best fit. Pieces over half the capacity open a sequence each,
    at offset 0, whose number is the piece's. The others are ranked within their size by a
    distributed prefix count, and pieces below ``capacity / RUN`` go as runs of one size: a
    run's number has its size and the rank of its first piece. Then rounds: a sweep gives
    each gap at most one run, the largest that has it for its successor, and the gaps
    shrink. Where no gap holds even the smallest run that is left, runs are halved.

    A gap that is several times the largest run goes into a sweep as several parts, so that
    it may take several runs at once; what they leave is one gap again.

    New sequences open for what the gaps that still hold a piece can't take by their sizes
    alone, and otherwise only once no gap holds any piece that is left. Gaps too small for
    any piece leave the game. Of a round only how many gaps and runs have each size reaches
    the driver. A gap takes a share of the capacity in each round, so that rounds grow
    neither with the number of documents nor with that of pieces in a sequence.
    """
    spark, half = sizes.sparkSession, capacity // 2
    big = sizes.where(F.col("size") > half)
    gaps, opened = big.where(F.col("size") < capacity).select("id", (F.lit(capacity) - F.col("size")).cast("int").alias("size")), 0
    ranked = in_order(sizes.where(F.col("size") <= half).select("size", "id"), ["size"], ["id"], "small_pieces")
    ranked = materialize(ranked.select("size", "id", "rank", "group_rows"), "ranked_pieces")
    run = F.greatest(F.lit(1), F.floor(F.lit(capacity // RUN) / F.col("size"))).cast("long")
    units = ranked.where(F.col("rank") % run == 0).select((F.shiftleft(F.col("size").cast("long"), RANK) + F.col("rank")).alias("id"), (F.col("size") * F.least(run, F.col("group_rows") - F.col("rank"))).cast("int").alias("size"))
    units = materialize(units, "runs")
    own = F.expr(f"cast(shiftright(id, {RANK}) as int)")

    def left() -> tuple[list[Row], list[Row]]:
        """How many gaps and runs there are of each size (and size of its pieces)."""
        runs = units.groupBy("size", own.alias("piece")).count()
        rooms = gaps.groupBy("size", F.lit(0).alias("piece")).count()
        rows = runs.union(rooms).collect()
        return [r for r in rows if r.piece], [r for r in rows if not r.piece]

    taken: list[DataFrame] = []
    runs, rooms = left()
    while runs:
        total, piece = sum(r.size * r["count"] for r in runs), min(r.piece for r in runs)
        room = sum(r.size * r["count"] for r in rooms if r.size >= piece)
        new = max(0, -(-(total - room) // capacity))
        if not new and min(r.size for r in runs) > max((r.size for r in rooms), default=0):
            if any(r.size > r.piece for r in runs):
                units = materialize(_halved(units), "halved", free=False)
                runs, rooms = left()
                continue
            new = -(-total // capacity)
        if new:
            fresh = spark.range(-opened - new, -opened).select("id", F.lit(capacity).alias("size"))
            gaps, opened = gaps.union(fresh), opened + new
        few = F.greatest(F.lit(1), F.least(F.lit(PARTS), F.floor(2 * F.col("size") / (3 * max(r.size for r in runs))))).cast("int")
        parts = gaps.where(F.col("size") >= piece).withColumn("few", few).select("id", "size", "few", F.explode(F.sequence(F.lit(0), F.col("few") - 1)).alias("nth"))
        part = F.expr("size div few") + F.when(F.col("nth") == 0, F.col("size") % F.col("few")).otherwise(0)
        swept = sweep(parts.select((F.col("id") * PARTS + F.col("nth")).alias("id"), part.cast("int").alias("size")), units)
        # what a gap's parts took lies side by side from where the gap began
        gap = Window.partitionBy("gap")
        before = gap.orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
        took = swept.where("kind = 0").withColumn("gap", F.shiftright("id", PARTS.bit_length() - 1)).withColumn("nth", F.col("id") - F.col("gap") * PARTS)
        took = took.select("gap", "nth", "piece", "taken", F.sum("size").over(gap).alias("room"), F.coalesce(F.sum("taken").over(gap), F.lit(0)).alias("all"), F.coalesce(F.sum("taken").over(before), F.lit(0)).alias("before"))
        taken.append(took.where("piece is not null").select(F.col("piece").alias("unit"), "taken", F.col("gap").alias("sequence_id"), (F.lit(capacity) - F.col("room") + F.col("before")).alias("offset")))
        gaps = took.where("nth = 0").select(F.col("gap").alias("id"), (F.col("room") - F.col("all")).cast("int").alias("size"))
        units = swept.where("kind = 1 and piece is null").select("id", "size")
        runs, rooms = left()
    if not taken:
        return []
    placed = reduce(DataFrame.union, taken).withColumn("s", F.expr(f"shiftright(unit, {RANK})"))
    each = placed.select("s", "unit", "sequence_id", "offset", F.explode(F.expr("sequence(0, cast(taken div s as int) - 1)")).alias("i"))
    each = each.select(F.col("s").cast("int").alias("size"), (F.col("unit") - F.shiftleft("s", RANK) + F.col("i")).alias("rank"), "sequence_id", (F.col("offset") + F.col("i") * F.col("s")).cast("int").alias("offset"))
    return [ranked.join(each, ["size", "rank"]).select("id", "sequence_id", "offset")]


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Documents are tokenized with an end mark (a null or empty text is the mark
    alone) and cut only if longer than ``capacity``; bulk-synchronous best fit
    (``place``) says where each piece lies.

    A null doc_id is kept as null; repeated rows are pieces of their own, and pieces
    of equal length are taken in any order. An empty table gives no rows; extra
    columns are ignored.
    """
    made = materialize(pieces(docs, id_col, text_col, capacity, tokenizer).withColumn("id", F.monotonically_increasing_id()), "pieces")
    placed = place(made.select("id", F.col("length").cast("int").alias("size")), capacity)
    facts = ["doc_id", "piece", "start", "length", "ids_crc32"]
    large = made.where(F.col("length") > capacity // 2).select(*facts, F.col("id").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    if not placed:
        return large
    placed = reduce(DataFrame.union, placed).withColumnRenamed("id", "of")
    small = made.where(F.col("length") <= capacity // 2).join(placed, F.col("id") == F.col("of"))
    return large.union(small.select(*facts, "sequence_id", F.col("offset").cast("long").alias("offset")))
