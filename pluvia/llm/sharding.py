"""Sharding by a consistent-hash ring with virtual nodes and bounded loads."""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_order, materialize

SHARDS = 40
VNODES = 128
_TOP = 1 << 64


def ring(shards: int, vnodes: int = VNODES) -> list[tuple[int, int]]:
    """The ring's points as (place, shard), clockwise. A shard's points don't depend on how many shards there are."""
    return sorted((xxhash.xxh64_intdigest(f"{s}/{v}".encode(), 11), s) for s in range(shards) for v in range(vnodes))


def plan(counts: dict[int, int], points: list[tuple[int, int]], capacity: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(arc, from, to, shard, slot): ranks [from, to) of an arc's keys go to a shard, from that slot on.

    Each key first goes to its arc's shard. Round by round a full shard keeps what
    came first and the rest moves one point clockwise, until all have a place. Only
    counts are moved, so this is as large as the ring and not as the data.
    """
    left = list(capacity)
    waiting = [(a, 0, n, a) for a, n in sorted(counts.items()) if n]
    out, slots = [], [0] * len(capacity)
    n = len(points)
    while waiting:
        nxt = []
        for arc, lo, hi, at in waiting:
            s = points[at % n][1]
            k = min(hi - lo, left[s])
            if k:
                out.append((arc, lo, lo + k, s, slots[s]))
                left[s] -= k
                slots[s] += k
            if lo + k < hi:
                nxt.append((arc, lo + k, hi, at + 1))
        waiting = nxt
    return out


def shard(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", vnodes: int = VNODES) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law ('rows'), shard, slot, grown_shard (null), moved.

    A document's key is a hash of its doc_id; the next of the ring's points clockwise
    names its shard. A shard takes at most its even share (floor or ceiling of the
    mean), so counts are at most one apart; keys beyond that continue clockwise to
    the next shard with room, ``moved`` says which. slot numbers each shard's rows
    from 0 without gaps. The law ``key`` can't hold together with bounded loads.

    Where keys land is decided on the counts of the ring's arcs (shards x vnodes
    numbers, all that reaches the driver); documents only look up their rank, which
    comes from a distributed sort, so an arc may hold any share of the rows.

    A null text has size 16 and checksum 0; a null doc_id hashes like a value. Rows
    with equal doc_ids are ranked by checksum and size; equal rows are
    interchangeable. An empty table gives no rows; extra columns are ignored.
    """
    spark = docs.sparkSession
    points = ring(shards, vnodes)
    edges = np.array([p - (1 << 63) for p, _ in points], np.int64)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.xxhash64(F.col(id_col).cast("string"), F.lit("ring")).alias("key"),
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )

    @F.pandas_udf("int")
    def arc_of(key: pd.Series) -> pd.Series:
        return pd.Series((np.searchsorted(edges, key.to_numpy(), "left") % len(edges)).astype(np.int32))

    # the number parts rows that are equal in all else, so that any number of them can be dealt over tasks
    rows = materialize(rows.withColumn("arc", arc_of("key")).withColumn("nth", F.monotonically_increasing_id()), "keys")
    counts = {r.arc: r.n for r in rows.groupBy("arc").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    capacity = [total // shards + (s < total % shards) for s in range(shards)]
    made = plan(counts, points, capacity) or [(0, 0, 0, 0, 0)]
    table = F.broadcast(spark.createDataFrame([(*r, r[3] != points[r[0] % len(points)][1]) for r in made], "at int, lo long, hi long, shard int, base long, moved boolean"))
    ranked = in_order(rows, ["arc"], ["key", "doc_id", "text_crc32", "size", "nth"], "ring_order")
    out = ranked.join(table, (F.col("arc") == F.col("at")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard",
        (F.col("base") + F.col("rank") - F.col("lo")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "moved",
    )
