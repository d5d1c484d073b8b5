"""Helpers that several operators share."""

from __future__ import annotations

import gc
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words are the longest runs of characters other than space and U+0009..U+000D.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"


def scratch_root(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``.

    Only where that setting is missing and all tasks run on this machine, as in
    tests, a temporary folder takes its place; on a cluster that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="pluvia-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def materialize(df: DataFrame, name: str, free: bool = True) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    This cuts the lineage: a lost executor later costs a reread, not a
    recomputation. The folder goes when the driver's JVM ends. Shuffle files of
    finished stages are released once nothing refers to them; with ``free`` an explicit
    collection lets that happen now and not at some later full collection. Rounds
    that shuffle little do without it.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/pluvia-{uuid.uuid4().hex}/{name}"
    df.write.option("compression", "zstd").parquet(path)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path).getParent()
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    if free:
        gc.collect()
        spark._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def quoted(df: DataFrame) -> list[Column]:
    """All columns of ``df`` by names that may hold dots and backticks."""
    return [F.col(f"`{c.replace('`', '``')}`") for c in df.columns]


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, also where a lambda within uses it for every element."""
    return F.transform(F.array(value), body)[0]


def flat(text: Column, newline: bool = True) -> Column:
    """``text`` with plain spaces for the other blanks, newlines too unless told not to; empty for null.

    Literal replacement and splitting at one character are several times as fast as
    a regular expression over every word.
    """
    out = F.coalesce(text, F.lit(""))
    for blank in BLANKS[1:]:
        if blank != "\n" or newline:
            out = F.replace(out, F.lit(blank), F.lit(" "))
    return out


def word_list(text: Column) -> Column:
    """The words of ``text`` in order; none for null."""
    return F.array_remove(F.split(flat(text), " ", -1), "")


def word_count(text: Column) -> Column:
    """The number of words of ``text`` as a long; 0 for null."""
    return F.size(word_list(text)).cast("long")


def in_order(df: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """``df`` with ``rank``, the row's place from 0 within its group, and ``group_rows``.

    A distributed prefix count: the rows are range-sorted by group and order, each
    keeps its place within its partition, and one row per partition and group says
    how many came before. A group may be any share of the table, as the sort deals
    it over as many partitions as it needs. ``df`` should be narrow.
    """
    n = F.monotonically_increasing_id()
    rows = (
        df.repartitionByRange(*group, *order)
        .sortWithinPartitions(*group, *order)
        .withColumn("_at", n)
        .withColumn("_part", F.shiftright("_at", 33))
    )
    rows = materialize(rows, name)
    heads = rows.groupBy("_part", *group).agg(F.count("*").alias("_n"), F.min("_at").alias("_head"))
    before = Window.partitionBy(*group).orderBy("_part")
    heads = heads.withColumn(
        "_before", F.coalesce(F.sum("_n").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ).withColumn("group_rows", F.sum("_n").over(Window.partitionBy(*group)))
    heads = heads.select(F.col("_part").alias("_p"), *[F.col(g).alias(f"_g_{g}") for g in group], "_head", "_before", "group_rows")
    same = F.col("_part") == F.col("_p")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    out = rows.join(heads, same).withColumn("rank", F.col("_before") + F.col("_at") - F.col("_head"))
    return out.drop("_at", "_part", "_p", "_head", "_before", *[f"_g_{g}" for g in group])


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def local_forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The links a-b as stars: each value that isn't the least of its part, and that least one."""
    nodes, inv = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = inv[: len(a)], inv[len(a) :]
    label = np.arange(len(nodes))
    while True:
        new = label.copy()
        np.minimum.at(new, x, label[y])
        np.minimum.at(new, y, label[x])
        np.minimum.at(new, label, new.copy())
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]
