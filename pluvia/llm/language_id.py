"""Language identification by error-correcting output codes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Training takes this many labelled texts of each language at most, and so many in all (of more languages than that, the most frequent).
SAMPLE, ROWS = 300, 6000
#: Texts whose n-grams are laid out as a matrix at once.
BLOCK = 512
#: Languages up to which the best of several random codes is looked for.
SEARCHED = 1000
GRAMS = (1, 2, 3)
DIM = 1 << 15
UNKNOWN = "und"
#: Below this difference of the two best languages' scores a prediction is ambiguous.
MARGIN = 0.1
STEPS, RATE, RIDGE = 150, 4.0, 1e-4
#: Characters that are worked on at once.
SLICE = 1 << 20
_MUL = np.uint64(0x9E3779B97F4A7C15)


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """(languages, bits) of -1 and 1: the exhaustive code up to 5 languages, else the best of some random codes."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 5:
        bits = [[1 if i == 0 or (k >> (i - 1)) & 1 else -1 for i in range(n)] for k in range((1 << (n - 1)) - 1)]
        return np.array(bits, float).T
    rng, width = np.random.default_rng(seed), int(np.ceil(10 * np.log2(n)))
    if n > SEARCHED:  # two of that many random words are far apart, and all pairs would be too many to look at
        return rng.choice([-1.0, 1.0], (n, width))

    def spread(c):
        d = (width - c @ c.T) / 2
        return d[np.triu_indices(n, 1)].min()

    return max((rng.choice([-1.0, 1.0], (n, width)) for _ in range(50)), key=spread)


class Letters:
    """Texts as code points: letters in lower case, all else as one kind of gap. Built once a worker."""

    table: np.ndarray | None = None

    @classmethod
    def get(cls) -> np.ndarray:
        if cls.table is None:
            t = np.zeros(0x110000, np.uint32)
            for c in range(0x110000):
                ch = chr(c)
                if ch.isalpha():
                    low = ch.lower()
                    t[c] = ord(low) if len(low) == 1 else c
            cls.table = t
        return cls.table


def features(text: str) -> Iterator[np.ndarray]:
    """Hashed n-grams of letters and word gaps, in slices of bounded size that overlap by what an n-gram needs."""
    table = Letters.get()
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    for lo in range(0, max(1, len(raw)), SLICE):
        c = table[raw[max(0, lo - max(GRAMS) + 1) : lo + SLICE]].astype(np.uint64)
        first = lo == 0
        if first:
            c = np.concatenate([np.zeros(1, np.uint64), c])
        if lo + SLICE >= len(raw):
            c = np.concatenate([c, np.zeros(1, np.uint64)])
        skip = 0 if first else max(GRAMS) - 1
        out = []
        for n in GRAMS:
            if len(c) < n:
                continue
            h = np.full(len(c) - n + 1, n, np.uint64)
            some = np.zeros(len(h), bool)
            for j in range(n):
                part = c[j : j + len(h)]
                h = (h ^ part) * _MUL
                some |= part != 0
            h ^= h >> np.uint64(31)
            out.append((h % np.uint64(DIM)).astype(np.int64)[max(0, skip - n + 1) :][some[max(0, skip - n + 1) :]])
        yield np.concatenate(out) if out else np.zeros(0, np.int64)


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The text's n-grams and how often each is there."""
    found = [np.unique(x, return_counts=True) for x in features(text)]
    at, n = (np.concatenate(z) for z in zip(*found, strict=True))
    if len(found) > 1:
        at, inv = np.unique(at, return_inverse=True)
        n = np.bincount(inv, n)
    return at, n


Counts = tuple[np.ndarray, np.ndarray]


def fit(rows: list[Counts], labels: list[str]) -> dict:
    """One logistic classifier for each bit of the codewords, on square roots of n-gram rates.

    ``rows`` are n-grams and rates of texts. They stay sparse; BLOCK of them at a
    time are laid out as a matrix.
    """
    names = sorted(set(labels))
    code = codewords(len(names))
    if len(names) < 2:
        return {"names": names, "code": code[: len(names)], "w": np.zeros((DIM, 1), np.float32)}
    seen = np.zeros(DIM, np.int64)
    for at, _ in rows:
        seen[at] += 1
    used = np.flatnonzero(seen >= 2)
    place = np.full(DIM, -1)
    place[used] = np.arange(len(used))
    number = {v: i for i, v in enumerate(names)}
    label = np.array([number[v] for v in labels])
    y = code[label].astype(np.float32)
    weight = 1 / np.bincount(label)[label]
    weight = (weight / weight.sum()).astype(np.float32)[:, None]

    def block(i: int) -> np.ndarray:
        x = np.zeros((min(BLOCK, len(rows) - i), len(used)), np.float32)
        for k, (at, rate) in enumerate(rows[i : i + BLOCK]):
            some = place[at] >= 0
            x[k, place[at[some]]] = 4.0 * np.sqrt(rate[some])
        return x

    kept = {i: block(i) for i in range(0, min(len(rows), 4 * BLOCK), BLOCK)}
    w, speed = np.zeros((len(used), code.shape[1]), np.float32), 0
    for _ in range(STEPS):
        slope = RIDGE * w
        for i in range(0, len(rows), BLOCK):
            x = kept[i] if i in kept else block(i)
            z = y[i : i + BLOCK]
            slope += x.T @ (-z / (1 + np.exp(np.clip(z * (x @ w), -30, 30))) * weight[i : i + BLOCK])
        speed = 0.9 * speed - RATE * slope
        w = w + speed
    full = np.zeros((DIM, code.shape[1]), np.float32)
    full[used] = 4.0 * w
    return {"names": names, "code": code, "w": full}


def decode(f: np.ndarray, code: np.ndarray) -> np.ndarray:
    """The loss of each codeword for the classifiers' values ``f``; a bit's loss counts by how sure its classifier is."""
    sure = np.abs(np.tanh(f / 2)) + 1e-3
    one, other = (np.log1p(np.exp(np.clip(z, -30, 30))) * sure / sure.sum() for z in (-f, f))
    return (one + other).sum() / 2 + code @ ((one - other) / 2)


def predict(model: dict, text: str | None) -> tuple[str, float, bool]:
    """(language, score, ambiguous) by loss-weighted decoding of the whole text's bits."""
    if text is None or not model["names"]:
        return UNKNOWN, 0.0, True
    at, n = grams(text)
    total = n.sum()
    if not total:
        return UNKNOWN, 0.0, True
    counts = np.sqrt(n / total)
    f = counts @ model["w"][at].astype(float)
    code = model["code"]
    loss = decode(f, code)
    odds = np.exp(-4 * (loss - loss.min()))
    odds /= odds.sum()
    order = np.argsort(-odds, kind="stable")
    second = odds[order[1]] if len(order) > 1 else 0.0
    return model["names"][order[0]], float(odds[order[0]]), bool(odds[order[0]] - second < MARGIN)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text's n-grams and their rates, packed."""
    for b in batches:
        out = []
        for t in b.column(1).to_pylist():
            at, n = grams(t)
            out.append((at.astype("<u2").tobytes(), (n / max(1, n.sum())).astype("<f4").tobytes()))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([a for a, _ in out], pa.binary()), pa.array([r for _, r in out], pa.binary())], ["k", "grams", "rates"])


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, rows: int = ROWS) -> dict:
    """The model, from a bounded sample of labelled rows outside the held-out third.

    Of each language the ``sample`` rows with the smallest hashes of id and text are
    taken, fewer of each if they would be over ``rows`` in all; of more than ``rows``
    languages the most frequent are learned. Rows that repeat id and text count once.
    The sample is chosen on hashes alone; whole texts are then counted in tasks, and
    their sparse counts reach the driver one by one: at most ``rows`` times DIM
    numbers, usually some thousand a text. Reruns agree.
    """
    text, lang = F.col(text_col).cast("string"), F.col(lang_col).cast("string")
    known = docs.where(lang.isNotNull() & text.isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    known = known.select(lang.alias("lang"), F.xxhash64(F.col(id_col).cast("string")).alias("o"), F.xxhash64(text).alias("th"), text.alias("text"))
    keys = ["lang", "o", "th"]
    # rows of one id are told apart by their texts, or a language could hang on one number
    place = F.pmod(F.xxhash64("o", "th"), F.lit(1 << 30))
    ids = materialize(known.select(*keys).distinct().withColumn("place", place), "labelled")
    counts = ids.groupBy("lang").agg(F.count("*").alias("n"))
    some = materialize(counts.orderBy(F.desc("n"), "lang").limit(rows), "languages")
    learned = some.count()
    if not learned:
        return fit([], [])
    each = max(1, min(sample, rows // learned))
    # a share of each language that holds some times as many rows, so that ranking moves few of them, or all if it should hold too few
    share = (4 * each + 100) / F.col("n") * (1 << 30)
    held = ids.join(F.broadcast(some), "lang").where(F.col("place") < share).groupBy(F.col("lang").alias("of")).agg(F.count("*").alias("held"))
    enough = F.coalesce(F.col("held"), F.lit(0)) >= F.least(F.col("n"), F.lit(each))
    shares = materialize(some.join(F.broadcast(held), F.col("lang") == F.col("of"), "left").select("lang", F.when(enough, share).otherwise(float(1 << 30)).alias("share")), "shares")
    ids = ids.join(F.broadcast(shares), "lang").where(F.col("place") < F.col("share"))
    ids = ids.withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy("place", "o", "th"))).where(F.col("nth") <= each).select(*keys)
    chosen = known.join(F.broadcast(ids), keys).dropDuplicates(keys)
    found = sorted((r.lang, r.o, r.th, bytes(r.grams), bytes(r.rates)) for r in chosen.select(F.struct(*keys).alias("k"), "text").mapInArrow(_counted, "k struct<lang:string,o:long,th:long>, grams binary, rates binary").select("k.*", "grams", "rates").toLocalIterator())
    return fit([(np.frombuffer(g, "<u2").astype(np.int64), np.frombuffer(r, "<f4")) for *_, g, r in found], [r[0] for r in found])


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, ambiguous.

    Each language has a codeword; for each of its bits a logistic classifier on
    hashed letter n-grams predicts the bit of a whole text; decoding takes the
    language whose codeword has the least loss, a bit's loss weighted by how sure
    its classifier is. score (0 to 1) is that language's share of exp(-loss), and
    ``ambiguous`` tells that the second comes near. The model, bounded by DIM x bits
    numbers, goes to the workers with the function.

    Documents whose crc32(doc_id as text) mod 3 is 1 are held out of the training.
    A text that is null or without a letter is ``und`` with score 0; so is every
    text if no language was learned. A null doc_id isn't held out and isn't trained
    on. Repeated rows repeat, an empty table gives no rows, extra columns are ignored.
    """
    model = train(docs, id_col, text_col, lang_col, sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [predict(model, t.as_py()) for t in b.column(2)]
            cols = [b.column(0), b.column(1), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64()), pa.array([x[2] for x in found], pa.bool_())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "held_out", "lang_pred", "score", "ambiguous"])

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean")
