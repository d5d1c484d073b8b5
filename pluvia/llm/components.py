"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _large(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
    return both.join(least, F.col("u") == F.col("k")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), "m")
    rest = edges.join(least, F.col("u") == F.col("k")).where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rest.union(least.select(F.col("k").alias("u"), F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """Rows (node, root): every node of ``edges`` that isn't the least of its component, and that least node.

    ``edges`` has two columns of one type, u and v, without nulls: longs, or structs
    of them, which order by their first field; loops and repeats do no harm. Neighbours are never gathered: a node's least neighbour is an aggregate
    with partial sums, and the links are rewritten through a join whose large
    partitions Spark can split. Each round is written to the shared folder. The
    rounds are logarithmic in the size of the longest component; they end when a
    round changes nothing.
    """
    edges = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = materialize(edges, "links")
    seen = None
    while True:
        # a star forest has one parent for each node, and no parent is a node's child
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == seen or not now[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = now
        edges = materialize(_small(_large(edges)), "stars")
