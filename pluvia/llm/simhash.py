"""SimHash near-duplicates by meet-in-the-middle ball hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import local_forest, materialize, popcount, quoted
from .components import connected_components

RADIUS = 4
SHINGLE = 4
SEED = 42
#: The 64 bits fall into three blocks. Of at most four differing bits the fullest
#: block holds two or more, so the other two blocks differ in at most two bits.
BLOCKS = ((0, 21), (21, 42), (42, 64))
#: Members of one bucket that are compared with each other; beyond, the bucket is
#: dealt out again by whole variants.
CROWD = 1024


def fingerprint(text: bytes | None, size: int = SHINGLE) -> int:
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined, n = b" ".join(words), max(1, len(words) - size + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-1]])[:n].tolist()
    stops = (ends[-n:] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)], "<u8")
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 15):
        part = h[i : i + (1 << 15)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, th, fp): the fingerprint of every whole text as a signed long, and a hash that tells texts apart.

    A null text has the fingerprint of an empty one, zero. Rows stay as they are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(2).cast(pa.binary())
            fp = np.fromiter((fingerprint(t.as_py()) for t in texts), np.uint64, len(texts)).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp)], ["doc_id", "th", "fp"])

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), _hash(F.col(text_col)).alias("th"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(run, "doc_id long, th long, fp long")


def _hash(text: Column) -> Column:
    return F.coalesce(F.xxhash64(text.cast("string")), F.lit(0))


def _mask(lo: int, hi: int) -> int:
    x = ((1 << hi) - 1) ^ ((1 << lo) - 1)
    return x - (1 << 64) if x >= 1 << 63 else x


def _signed(bit: int) -> int:
    return (1 << bit) - (1 << 64 if bit == 63 else 0)


def _ball(fps: DataFrame) -> DataFrame:
    """(block, key, fp): for each choice of two blocks, all variants within half of the two bits by which a pair differs there."""
    parts = []
    for i, (lo, hi) in enumerate(BLOCKS):
        flips = [0, *(_signed(b) for b in range(64) if not lo <= b < hi)]
        parts.append(F.struct(F.lit(i).alias("block"), F.lit(~_mask(lo, hi)).alias("keep"), F.array(*map(F.lit, flips)).alias("flips")))
    rows = fps.select("fp", F.explode(F.array(*parts)).alias("p"))
    rows = rows.select("fp", "p.block", F.col("fp").bitwiseAND(F.col("p.keep")).alias("base"), F.explode("p.flips").alias("flip"))
    return rows.select("block", F.col("base").bitwiseXOR(F.col("flip")).alias("key"), "fp")


def _links(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stars over the pairs of one bucket within the radius."""
    x, y = [], []
    for i in range(0, len(fp), 256):
        near = popcount(fp[i : i + 256, None] ^ fp[None, :]) <= RADIUS
        a, b = np.nonzero(near)
        a += i
        x.append(a[a < b])
        y.append(b[a < b])
    x, y = np.concatenate(x), np.concatenate(y)
    s = fp.view(np.int64)
    return local_forest(s[x], s[y])


def _meet(crowd: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by block and key. Out: links (kind 0: u, v) and the rows of crowded buckets (kind 1: fp, key)."""
        held = passed = None

        def out(kind, block, u, v):
            k = len(u)
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(k, kind, np.int32)), pa.array(np.full(k, block, np.int32) if np.isscalar(block) else block), pa.array(u), pa.array(v)],
                ["kind", "block", "u", "v"],
            )

        def done(block, key, fp):
            new = np.flatnonzero((np.diff(key) != 0) | (np.diff(block) != 0)) + 1
            heads = np.concatenate([[0], new, [len(key)]])
            size = np.diff(heads)
            two = heads[:-1][size == 2]
            a, b = fp[two], fp[two + 1]
            near = popcount(a.view(np.uint64) ^ b.view(np.uint64)) <= RADIUS
            us, vs = [a[near]], [b[near]]
            for k in np.flatnonzero(size > 2).tolist():
                i, j = heads[k], heads[k + 1]
                if j - i > crowd:
                    yield out(1, int(block[i]), fp[i:j], key[i:j])
                else:
                    x, y = _links(fp[i:j].view(np.uint64))
                    us.append(x)
                    vs.append(y)
            u, v = np.concatenate(us), np.concatenate(vs)
            if len(u):
                both = np.unique(np.stack([np.maximum(u, v), np.minimum(u, v)]), axis=1)
                yield out(0, 0, np.ascontiguousarray(both[0]), np.ascontiguousarray(both[1]))

        for b in batches:
            now = [b.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            if passed is not None:
                # a crowded bucket's rows pass as they come and are never gathered
                other = np.flatnonzero((now[0] != passed[0]) | (now[1] != passed[1]))
                k = other[0] if len(other) else len(now[1])
                if k:
                    yield out(1, passed[0], now[2][:k], now[1][:k])
                if not len(other):
                    continue
                now, passed = [x[k:] for x in now], None
            if held is not None:
                now = [np.concatenate(x) for x in zip(held, now, strict=True)]
            block, key, _ = now
            if not len(key):
                continue
            last = np.flatnonzero((key != key[-1]) | (block != block[-1]))
            cut = last[-1] + 1 if len(last) else 0
            if cut:
                yield from done(*(x[:cut] for x in now))
            held = [x[cut:] for x in now]
            if len(held[1]) > crowd:
                passed = (int(held[0][0]), held[1][0])
                yield out(1, passed[0], held[2], held[1])
                held = None
        if held is not None and len(held[1]):
            yield from done(*held)

    return run


def _crowded(rows: DataFrame) -> DataFrame:
    """Links within crowded buckets: each member emits the whole variants within half the radius that the bucket's key leaves it."""
    parts = []
    for i, (lo, hi) in enumerate(BLOCKS):
        one = [_signed(b) for b in range(lo, hi)]
        two = [x ^ y for n, x in enumerate(one) for y in one[:n]]
        mask = F.lit(_mask(lo, hi))
        away = F.bit_count((F.col("u").bitwiseAND(F.lit(~_mask(lo, hi)))).bitwiseXOR(F.col("v")))
        part = rows.where(f"block = {i}").withColumn("flip", F.explode(F.when(away == 0, F.array(*map(F.lit, [0, *one, *two]))).otherwise(F.array(*map(F.lit, [0, *one])))))
        whole = F.col("v").bitwiseOR(F.col("u").bitwiseAND(mask)).bitwiseXOR(F.col("flip"))
        parts.append(part.select(F.col("u").alias("fp"), whole.alias("meet")))
    rows = parts[0].union(parts[1]).union(parts[2])
    least = rows.groupBy("meet").agg(F.min("fp").alias("v"), F.max("fp").alias("most")).where("v < most").select(F.col("meet").alias("at"), "v")
    return rows.join(least, F.col("meet") == F.col("at")).where("fp > v").select(F.col("fp").alias("u"), "v").distinct()


def near_links(fps: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(u, v): links whose components are those of all pairs of distinct fingerprints within the radius.

    ``fps`` has one row, without nulls, for each fingerprint; none gives no links.
    """
    rows = _ball(fps).repartition("block", "key").sortWithinPartitions("block", "key", "fp")
    found = materialize(rows.mapInArrow(_meet(crowd), "kind int, block int, u long, v long"), "met")
    links = found.where("kind = 0").select("u", "v")
    return links.union(_crowded(found.where("kind = 1").select("block", "u", "v")))


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", crowd: int = CROWD) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id.

    Words are runs of characters other than space and U+0009..U+000D after A-Z went
    to lower case; a fingerprint's bit is 1 where over half of the XXH64 values
    (seed 42) of the 4-word shingles have it, repeats counted. Fewer words make one
    shingle; a null text or one without words has fingerprint zero, which links like
    any other. Fingerprints that differ in at most 4 bits are linked; component_id
    is the smallest doc_id that can be reached over links.

    Equal fingerprints are one node, so copies never make pairs. Every distinct
    fingerprint emits, for each two of the three blocks, all variants within half of
    the at most two bits by which a linked pair differs there: 131 rows and not the
    2081 of the whole ball. Fingerprints that meet are deduplicated and verified on
    all 64 bits; buckets of over ``crowd`` members are dealt out again by the whole
    variants of the full ball, where all that meet are linked and a star suffices.

    A null doc_id gives a row with null doc_id; it counts in links but is never the
    smallest. Repeated rows give repeated rows. An empty table gives no rows; extra
    columns are ignored.
    """
    own, placed = _placed(docs, id_col, text_col, crowd)
    out = own.join(placed.select(F.col("fp").alias("node"), "component_id"), F.col("fp") == F.col("node"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _placed(docs: DataFrame, id_col: str, text_col: str, crowd: int = CROWD) -> tuple[DataFrame, DataFrame]:
    """The rows' fingerprints (doc_id, th, fp), and each distinct fingerprint once with ``first``, its smallest doc_id, and component_id.

    Nodes are ordered by their smallest doc_id (those without any come last), so
    that the least node of a component says its id and none is gathered by it.
    """
    own = materialize(fingerprints(docs, id_col, text_col), "fingerprints")
    nodes = materialize(own.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    links = near_links(nodes.select("fp"), crowd).distinct()  # a pair meets in several buckets
    for end in ("u", "v"):
        node = F.struct(F.col("first").isNull().alias("none"), "first", "fp").alias(f"_{end}")
        links = links.join(nodes.select(F.col("fp").alias("_fp"), node), F.col(end) == F.col("_fp")).drop("_fp", end).withColumnRenamed(f"_{end}", end)
    roots = connected_components(links).select(F.col("node.fp").alias("of"), F.struct(F.col("root.first").alias("id")).alias("root"))
    placed = nodes.join(roots, F.col("fp") == F.col("of"), "left")
    least = F.when(F.col("root").isNull(), F.col("first")).otherwise(F.col("root.id"))
    return own, materialize(placed.select("fp", "first", least.alias("component_id"), F.col("root").isNull().alias("is_least")), "components")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component: one with the smallest doc_id and a text of that component.

    Rows without a doc_id are kept, as nothing tells which of them stays. Of rows
    that repeat a doc_id one stays at most, which is the least of its component. An
    empty table gives no rows; columns keep their names and order.
    """
    own, placed = _placed(docs, id_col, text_col)
    least = placed.where(F.col("is_least") & F.col("first").isNotNull()).select(F.col("fp").alias("_fp"), "first")
    stay = own.join(least, (F.col("fp") == F.col("_fp")) & (F.col("doc_id") == F.col("first"))).groupBy("doc_id").agg(F.min("th").alias("th"))
    rows = docs.select(F.struct(*quoted(docs)).alias("row"), F.col(id_col).cast("long").alias("_id"), _hash(F.col(text_col)).alias("_th"))
    # the hashes are compared in a way that is no key of the join, so that rows move once and are dealt by id alone, as the window wants
    kept = rows.join(stay, (F.col("_id") == F.col("doc_id")) & (F.col("_th").bitwiseXOR(F.col("th")) == 0), "left_semi")
    whole = F.xxhash64(F.col("row"))
    once = kept.withColumn("_n", F.row_number().over(Window.partitionBy("_id").orderBy(whole))).where("_n = 1")
    return once.select("row.*").unionByName(docs.where(F.col(id_col).isNull()))
