"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_order, materialize, quoted, word_count

WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
SEED = 20
#: Sources whose sizes and targets may be broadcast; more are joined by source.
BROADCAST = 50_000


def _shared(sources: DataFrame, total: float, most: float) -> DataFrame:
    """``sources`` (of, source_size, weight) with ``target``: ``total`` shared by weight, none above ``most`` times its size, the excess reshared by weight.

    A source is full if its share by weight exceeds its bound. The share a unit of
    weight only grows as sources fill up, so each round sums the bounds of the full
    and the weights of the others, until none more is full. Sums reach the driver and
    sources don't.
    """
    bound, unit, before = F.col("source_size") * float(most), 0.0, None
    while True:
        full = F.col("weight") * F.lit(unit) > bound
        now = sources.agg(F.coalesce(F.sum(F.when(full, bound)), F.lit(0.0)).alias("full"), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0)).alias("weight"), F.count(F.when(full, 1)).alias("n")).first()
        if before == now.n or not now.weight:
            return sources.withColumn("target", F.when(full, bound).otherwise(F.lit(unit) * F.col("weight")))
        before, unit = now.n, (total - now.full) / now.weight


def targets(sizes: Sequence[int], weights: Sequence[float], most: float = MOST_COPIES) -> list[float]:
    """The same for a few sources in a list, to plan a mixture with: shares of ``sum(sizes)``."""
    total, open_, out = float(sum(sizes)), set(range(len(sizes))), [0.0] * len(sizes)
    while open_:
        weight = sum(weights[i] for i in open_)
        share = {i: total * weights[i] / weight for i in open_}
        full = [i for i in open_ if share[i] > most * sizes[i]]
        if not full:
            for i in open_:
                out[i] = share[i]
            break
        for i in full:
            out[i] = float(most * sizes[i])
            total -= out[i]
            open_.discard(i)
    return out


def _copies(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: Sequence[float], most: int, seed: int) -> DataFrame:
    """(doc_id, source, th, size, source_size, target, copies) of each row; th is a hash of its text."""
    text = F.col(text_col).cast("string")
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(text).alias("size"), F.coalesce(F.xxhash64(text), F.lit(0)).alias("th"),
        F.xxhash64(F.col(id_col).cast("string"), F.lit(seed)).alias("by"), F.monotonically_increasing_id().alias("nth"),
    )
    rows = materialize(rows, "sizes")
    found = rows.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("last", F.col("source").isNull())
    ranked = in_order(found.withColumn("all", F.lit(0)), ["all"], ["last", "source"], "source_order")
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), F.pmod("rank", F.lit(len(weights))).cast("int"))
    sources = materialize(ranked.select(F.col("source").alias("of"), "source_size", weight.alias("weight")), "sources")
    total, n = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.count("*")).first()
    sources = _shared(sources, float(total), most).drop("weight")
    if n <= BROADCAST:
        sources = F.broadcast(sources)
    # rows that are equal in all else are told apart by their place, so that a group of any size can be dealt over tasks
    ranked = in_order(rows, ["source"], ["size", "by", "doc_id", "th", "nth"], "mix_order").join(sources, F.col("source").eqNullSafe(F.col("of")))
    wide, start = "decimal(18,0)", F.pmod(F.xxhash64(F.coalesce("source", F.lit("")), F.lit(seed)), F.greatest("source_size", F.lit(1)))
    ranked = ranked.select("doc_id", "source", "th", "size", "source_size", "target", F.col("rank").cast(wide).alias("k"), F.round("target").cast(wide).alias("goal"), start.cast(wide).alias("start"), F.greatest("source_size", F.lit(1)).cast(wide).alias("whole"))
    copies = F.expr("((k + 1) * goal + start) div whole - (k * goal + start) div whole")
    return ranked.select("doc_id", "source", "th", "size", "source_size", "target", F.when(F.col("source_size") == 0, F.lit(0)).otherwise(copies).cast("long").alias("copies"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = WEIGHTS, most: int = MOST_COPIES, seed: int = SEED) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken.

    size is the number of words. Sources in code point order, null last, take the
    weights in turn; their targets share the sum of all sizes by weight, none above
    ``most`` times its source's size. Within a source each document expects
    target / source size copies; documents are put in order (by size, so that those
    taken hold their share of words, then by a hash), the expected copies are
    summed up from one random offset, and a copy is emitted for each integer
    boundary that a document crosses. So a source's words miss its target by less
    than its largest document. Sums are whole numbers over the source's size, so no
    document gets over ``most`` copies and reruns agree.

    A null text has size 0 and may be taken (0 words). A source without words has
    target 0. A null doc_id is a value like others; repeated rows are drawn one by
    one. An empty table gives no rows; extra columns are ignored. Sources may be any
    number and any share of the rows.
    """
    rows = _copies(docs, id_col, text_col, source_col, weights, most, seed)
    return rows.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = WEIGHTS, most: int = MOST_COPIES, seed: int = SEED) -> DataFrame:
    """``docs`` with each row as often as the mix takes it.

    Rows that are equal in id, source and text share the copies that they get
    together: each gets the whole part of its share and one of them the rest. Null
    ids, sources and texts are values like others. An empty table gives no rows;
    columns keep their names and order.
    """
    keys = ["_id", "_source", "_th"]

    def name(c: str) -> Column:
        return F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("null"))

    taken = _copies(docs, id_col, text_col, source_col, weights, most, seed)
    taken = taken.groupBy(name("doc_id").alias("_id"), name("source").alias("_source"), F.col("th").alias("_th")).agg(F.sum("copies").alias("_sum"), F.count("*").alias("_rows"))
    taken = materialize(taken.where("_sum > 0").select(*keys, F.expr("_sum div _rows").alias("_each"), F.expr("_sum % _rows").alias("_rest")), "taken")
    th = F.coalesce(F.xxhash64(F.col(text_col).cast("string")), F.lit(0))
    own = docs.select(F.struct(*quoted(docs)).alias("row"), name(id_col).alias("_id"), name(source_col).alias("_source"), th.alias("_th"))
    each = own.join(taken.where("_each > 0"), keys).select("row", F.col("_each").alias("_n"))
    out = each
    if taken.where("_rest > 0").limit(1).count():
        rest = own.join(taken.where("_rest > 0"), keys).groupBy(*keys, "_rest").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
        out = each.union(rest.select("row", F.col("_rest").alias("_n")))
    return out.select("row", F.explode(F.sequence(F.lit(1), F.col("_n").cast("int")))).select("row.*")
