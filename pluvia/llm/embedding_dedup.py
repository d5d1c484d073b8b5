"""Near-duplicate vectors by spherical-cap filters."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import local_forest, materialize
from .components import connected_components

COSINE = 0.93
#: Directions of each set of the product code, and the score from which a vector belongs to a filter.
#: At 512 and 3.7 a vector exceeds it with about 28 of 262,144 filters.
CODE, CAP = 512, 3.7
#: Up to so many distinct vectors that code serves; it doubles each time their number has quadrupled, up to LARGEST.
CODE_FOR, LARGEST = 100_000, 8192
#: A vector with fewer filters above that score takes its best so many.
FEWEST = 24
#: Its best directions of either set also make filters with each other, as its best filters may all share one direction.
GRID = 5
#: Components that vectors are spread over at least, and up to which they are rotated.
WIDE, ROTATED = 64, 1024
SEED = 5
#: Vectors of one filter that are compared in one piece; larger filters are split into pairs of parts.
PART = 2048
#: Filters of up to so many vectors are compared together, so many pairs at once.
FEW, PAIRS = 32, 1 << 16
BROADCAST = 100_000


def code_for(n: int) -> tuple[int, float]:
    """(code, cap) for ``n`` vectors: about as many vectors a filter and filters a vector at every size."""
    code = CODE
    while code < LARGEST and n > CODE_FOR * (code // CODE) ** 2:
        code *= 2
    return code, CAP if code == CODE else NormalDist().inv_cdf(1 - (1 - NormalDist().cdf(CAP)) * (CODE / code) ** 2)


def directions(dim: int, code: int = CODE, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Two sets of random directions; a filter's direction is the sum of one of each.

    A random rotation, into WIDE components if there are fewer, spreads a vector's
    weight before it is split into halves, and each set is of one half. Above
    ROTATED components directions of all components are as good and need no rotation.
    """
    rng, wide = np.random.default_rng([seed, dim]), max(dim, WIDE)
    if dim > ROTATED:
        one, two = rng.standard_normal((2, code, dim)) * np.sqrt(0.5)
        return one, two
    turn, half = np.linalg.qr(rng.standard_normal((wide, wide)))[0][:, :dim], (wide + 1) // 2
    return rng.standard_normal((code, half)) @ turn[:half], rng.standard_normal((code, wide - half)) @ turn[half:]


def decode(x: np.ndarray, code: tuple[np.ndarray, np.ndarray], cap: float = CAP, fewest: int = FEWEST) -> list[np.ndarray]:
    """For each unit vector all filters whose direction it exceeds ``cap`` with, ascending, or its ``fewest`` best if those are more, and those of its GRID best directions of either set.

    The lower bar of a vector that exceeds few directions, and other directions than
    the one that its best filters may share, keep its chance to meet its neighbours.
    """
    one, two = code
    out = []
    first, second = x @ one.T, x @ two.T
    n, k = len(two), min(fewest, len(one))
    at, to = np.argsort(-first, axis=1), np.argsort(-second, axis=1)
    first, second = np.take_along_axis(first, at, 1), np.take_along_axis(second, to, 1)
    r, c = np.nonzero(np.outer(np.arange(1, k + 1), np.arange(1, k + 1)) <= k)
    bar = np.minimum(cap, np.partition(first[:, r] + second[:, c], -k, axis=1)[:, -k]) - 1e-12
    for i in range(0, len(x), 32):
        left, right, need = first[i : i + 32], second[i : i + 32], bar[i : i + 32, None]
        # only so many of either set reach the bar with the best of the other
        p, q = ((y + z[:, :1] >= need).sum(axis=1).max() for y, z in ((left, right), (right, left)))
        v, f, g = np.nonzero(left[:, :p, None] + right[:, None, :q] >= need[:, None])
        grid = at[i : i + 32, :GRID, None] * n + to[i : i + 32, None, :GRID]
        grid = np.arange(len(left))[:, None, None] << 32 | grid
        found = np.unique(np.concatenate([v << 32 | at[i + v, f] * n + to[i + v, g], grid.ravel()]))
        out += np.split(found.astype("<u4"), np.searchsorted(found >> 32, np.arange(1, len(left))))
    return out


def _unit(raw: list[bytes], single: bool) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), "<f4" if single else "<f8").reshape(len(raw), -1).astype(float)
    top = np.abs(x).max(axis=1, keepdims=True)
    x = x / top  # so that no square under- or overflows
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _pack(single: bool) -> Callable:
    kind = "<f4" if single else "<f8"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = []
            for v in b.column(2).to_pylist():
                x = None if not v or any(c is None for c in v) else np.array(v, kind)
                raw.append(None if x is None or not np.isfinite(x).all() or not x.any() else x.tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(raw, pa.binary())], ["vec_id", "label", "vec"])

    return run


def _encode(single: bool, code: int, cap: float) -> Callable:
    step = max(32, 1024 * CODE // code)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, tuple] = {}
        for b in batches:
            raw = b.column(1).to_pylist()
            lists: list = [None] * len(raw)
            sizes = np.array([len(r) for r in raw], np.int64)
            for size in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == size)
                dim = size // (4 if single else 8)
                if dim not in known:
                    known[dim] = directions(dim, code)
                for i in range(0, len(at), step):
                    part = at[i : i + step]
                    for j, x in zip(part, decode(_unit([raw[k] for k in part], single), known[dim], cap), strict=True):
                        lists[j] = x
            flat = [x.tobytes() for x in lists]
            cols = [b.column(0), b.column(1), b.column(2), pa.array(flat, pa.binary()), pa.array([x.astype(np.int64) for x in lists], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, ["node", "vec", "copies", "list", "filters"])

    return run


def _met(lists: list[bytes], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the vectors of each pair of rows a, b share a filter before this one."""
    flat, n = np.frombuffer(b"".join(lists), "<u4"), np.array([len(x) // 4 for x in lists], np.int64)
    start, out = np.cumsum(n) - n, np.zeros(len(a), bool)

    def spread(rows: np.ndarray) -> np.ndarray:
        k = n[rows]
        pair = np.repeat(np.arange(len(rows)), k)
        return pair.astype(np.uint64) << np.uint64(32) | flat[np.arange(len(pair)) + np.repeat(start[rows] - np.cumsum(k) + k, k)]

    for i in range(0, len(a), PAIRS):
        both = np.concatenate([spread(a[i : i + PAIRS]), spread(b[i : i + PAIRS])])
        both.sort(kind="stable")  # two ascending runs
        out[i + (both[1:][both[1:] == both[:-1]] >> np.uint64(32)).astype(np.int64)] = True
    return out


def _met_densely(lists: list[bytes]) -> np.ndarray:
    """The same for all pairs of many rows, as a matrix."""
    before = [np.frombuffer(x, "<u4") for x in lists]
    ids = np.unique(np.concatenate(before))
    inside = np.zeros((len(lists), len(ids)), np.float32)
    for i, b in enumerate(before):
        inside[i, np.searchsorted(ids, b)] = 1
    return inside @ inside.T > 0


def _compare(single: bool, cosine: float) -> Callable:
    """Rows sorted by filter and part. Out: (node, other's copies) summed, and links as stars (kind 1).

    Most filters hold few vectors, so those of equal size are compared together.
    """

    def linked(node, copies, a, b):
        if not len(a):
            return
        total = np.bincount(a, copies[b], len(node)) + np.bincount(b, copies[a], len(node))
        some = np.flatnonzero(total)
        u, v = local_forest(node[a], node[b])
        cols = [np.repeat(np.array([0, 1], np.int32), [len(some), len(u)]), np.concatenate([node[some], u]), np.concatenate([total[some].astype(np.int64), v])]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["kind", "node", "value"])

    def settle(t, heads):
        size = np.diff(np.append(heads, len(t)))
        dim, lo, hi, node, copies, part = (t.column(c).to_numpy() for c in ("dim", "lo", "hi", "node", "copies", "own_part"))
        raw, lists = t.column("vec").to_pylist(), t.column("before").to_pylist()
        pairs = []
        for s, d in sorted({x for x in zip(size.tolist(), dim[heads].tolist(), strict=True) if x[0] > 1}):
            at = heads[(size == s) & (dim[heads] == d)]
            step = max(1, PAIRS // (s * s)) if s <= FEW else 1
            for i in range(0, len(at), step):
                rows = at[i : i + step, None] + np.arange(s)
                x = _unit([raw[r] for r in rows.ravel()], single).reshape(*rows.shape, -1)
                near = np.triu(x @ x.transpose(0, 2, 1) >= cosine, 1)
                # of two parts only the pairs between them
                near &= (lo == hi)[rows[:, :1, None]] | (part[rows][:, :, None] != part[rows][:, None, :])
                if s > FEW and near.any():
                    near[0] &= ~_met_densely([lists[r] for r in rows[0]])
                k, a, b = np.nonzero(near)
                a, b = rows[k, a], rows[k, b]
                if s > FEW:
                    yield from linked(node, copies, a, b)
                else:
                    pairs.append((a, b))
        if pairs:
            a, b = (np.concatenate(x) for x in zip(*pairs, strict=True))
            new = ~_met(lists, a, b)
            yield from linked(node, copies, a[new], b[new])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            t = pa.Table.from_batches([b])
            t = (t if held is None else pa.concat_tables([held, t])).combine_chunks()
            if not len(t):
                continue
            new = np.zeros(len(t), bool)
            new[0] = True
            for c in ("label", "dim", "filter", "lo", "hi"):
                x = t.column(c).to_numpy()
                new[1:] |= x[1:] != x[:-1]
            heads = np.flatnonzero(new)
            held = t.slice(heads[-1])
            if len(heads) > 1:
                yield from settle(t.slice(0, heads[-1]), heads[:-1])
        if held is not None:
            yield from settle(held, np.zeros(1, np.int64))

    return run


def embedding_links(
    vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", cosine: float = COSINE, code: int | None = None, cap: float | None = None, part: int = PART
) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept (it is its component's smallest vec_id).

    Vectors with equal, non-null labels and dimensions are linked if their cosine in
    double precision is at least ``cosine``. Filters are caps around directions of a
    random product code; each vector is decoded to all filters whose direction it
    exceeds ``cap`` with (its FEWEST best at least, and its GRID), vectors meet in filters, and pairs are verified.
    ``code`` and ``cap`` follow from the number of vectors unless they are given. Equal
    vectors are one node with a number of copies, so copies make no pairs. A pair
    counts in the first filter that it shares, so links are counted and turned into
    stars where they are found and pairs are never sent on. Filters of over ``part``
    vectors are compared as pairs of parts, in tasks of their own.

    Vectors that are null, empty, zero, or hold null or non-finite components, those
    without a label and rows without a vec_id link with nothing (the last have a
    null component and aren't kept). Repeated rows count as vectors of their own and
    share a component. An empty table gives no rows; extra columns are ignored.
    """
    single = vectors.schema[vec_col].dataType.simpleString() == "array<float>"
    kind = "float" if single else "double"
    src = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vec_col).cast(f"array<{kind}>").alias("e"))
    src = src.mapInArrow(_pack(single), "vec_id long, label string, vec binary")
    own = materialize(src.withColumn("node", F.when(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vec").isNotNull(), F.xxhash64("label", "vec"))), "vectors")
    good = own.where("node is not null")
    firsts = materialize(good.groupBy("node").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies")), "nodes")
    if code is None or cap is None:
        code, cap = (mine if given is None else given for given, mine in zip((code, cap), code_for(firsts.count()), strict=True))
    nodes = good.groupBy("node", "label", "vec").agg(F.count("*").alias("copies"))
    labels = nodes.select(F.col("node").alias("of"), "label", F.octet_length("vec").alias("dim"))
    coded = nodes.select("node", "vec", "copies").mapInArrow(_encode(single, code, cap), "node long, vec binary, copies long, list binary, filters array<long>")
    coded = materialize(coded.join(labels, F.col("node") == F.col("of")).drop("of"), "coded")
    rows = coded.select("label", "dim", F.posexplode("filters").alias("nth", "filter"), "node", "vec", "copies", "list")
    rows = rows.withColumn("before", F.substring("list", F.lit(1), 4 * F.col("nth")))  # a vector's filters ascend
    large = rows.groupBy("label", "dim", "filter").agg(F.count("*").alias("n")).where(F.col("n") > part)
    large = materialize(large.select(F.col("label").alias("_l"), F.col("dim").alias("_d"), F.col("filter").alias("_f"), F.ceil(F.col("n") / part).cast("int").alias("parts")), "large_filters")
    if large.count() <= BROADCAST:
        large = F.broadcast(large)
    rows = rows.join(large, (F.col("label") == F.col("_l")) & (F.col("dim") == F.col("_d")) & (F.col("filter") == F.col("_f")), "left")
    rows = rows.withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("own_part", F.pmod(F.xxhash64("node", F.lit("part")), "parts").cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    keys = ["label", "dim", "filter", "lo", "hi"]
    rows = rows.select("label", "dim", "filter", F.least("own_part", "other").alias("lo"), F.greatest("own_part", "other").alias("hi"), "node", "vec", "copies", "before", "own_part")
    found = rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_compare(single, cosine), "kind int, node long, value long")
    found = materialize(found, "found")
    links = found.where("kind = 0").groupBy(F.col("node").alias("counted")).agg(F.sum("value").alias("others"))
    # nodes are ordered by their smallest vec_id, so that the least node of a component says its id
    edges = found.where("kind = 1").select(F.col("node").alias("u"), F.col("value").alias("v")).distinct()
    for end in ("u", "v"):
        node = F.struct("first", "node").alias(f"_{end}")
        edges = edges.join(firsts.select(F.col("node").alias("_node"), node), F.col(end) == F.col("_node")).drop("_node", end).withColumnRenamed(f"_{end}", end)
    roots = connected_components(edges).select(F.col("node.node").alias("child"), F.col("root.first").alias("least"))
    firsts = firsts.join(links, F.col("node") == F.col("counted"), "left").join(roots, F.col("node") == F.col("child"), "left")
    n_links = F.col("copies") - 1 + F.coalesce("others", F.lit(0))
    placed = materialize(firsts.select(F.col("node").alias("n"), n_links.cast("long").alias("n_links"), F.coalesce("least", "first").alias("component_id")), "components")
    out = good.select("vec_id", "node").join(placed, F.col("node") == F.col("n")).select("vec_id", "n_links", "component_id")
    # vectors that link with nothing have no node to be joined by
    out = out.union(own.where("node is null").select("vec_id", F.lit(0).cast("long"), "vec_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


ORACLE = """
WITH RECURSIVE e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS u, b.vec_id AS v FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.93),
r AS (SELECT u, v FROM l UNION SELECT r.u, l.v FROM r JOIN l ON r.v = l.u)
SELECT vec_id, (SELECT count(*) FROM l WHERE u = vec_id)::BIGINT AS n_links,
    least(vec_id, coalesce((SELECT min(v) FROM r WHERE u = vec_id), vec_id)) AS component_id,
    least(vec_id, coalesce((SELECT min(v) FROM r WHERE u = vec_id), vec_id)) = vec_id AS kept FROM embeddings
"""
