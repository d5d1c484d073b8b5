"""Quality rules: cross-document line frequency, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, flat, let, materialize, quoted

#: A line goes if over this share of its host's documents hold it, and at least so many.
SHARE, LEAST = 0.05, 10
#: A document is depleted if lines with more than this share of its word characters go.
DEPLETED = 0.5
MIN_WORDS, REPEAT_PERCENT, WINDOW = 10, 20, 5
#: Common lines of all hosts that may be broadcast; more are joined by host.
BROADCAST = 100_000


def _repeat_words(words: Column) -> Column:
    """Words in windows of five that are found twice or more in the text."""

    def covered(at: Column) -> Column:
        steps = F.zip_with(at, F.slice(at, 2, F.size(at)), lambda a, b: F.least(F.lit(WINDOW), F.coalesce(b - a, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0), lambda total, x: total + x)

    def twice(h: Column) -> Column:
        """Windows with equal hashes are neighbours once sorted; each carries its place along."""
        placed = F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))

        def again(keys: Column) -> Column:
            def one(p: Column, k: Column) -> Column:
                return F.coalesce(F.get(keys, k - 1)["h"] == p["h"], F.lit(False)) | F.coalesce(F.get(keys, k + 1)["h"] == p["h"], F.lit(False))

            return F.sort_array(F.transform(F.filter(keys, one), lambda p: p["i"]))

        return let(let(F.sort_array(placed), again), covered)

    def of(hashes: Column) -> Column:
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(twice(hashes))

    def windows(h: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(h) - WINDOW)
        return F.transform(starts, lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(WINDOW)]))

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) <= WINDOW, F.lit(0)).otherwise(let(hashes, lambda h: let(windows(h), of)))


def _line(x: Column) -> Column:
    """The hash ``h`` of a line without case and blanks, and its characters ``n`` in words."""
    return let(F.replace(F.lower(flat(x, newline=False)), F.lit(" "), F.lit("")), lambda y: F.struct(F.xxhash64(y).alias("h"), F.length(y).alias("n")))


def _without(text: Column, gone: Column) -> Column:
    """``text`` without the lines whose hashes ``gone`` holds; lines without a word stay."""
    stay = F.filter(F.split(text, "\n", -1), lambda x: ~(x.rlike(WORD) & F.array_contains(gone, _line(x).getField("h"))))
    return F.array_join(stay, "\n")


def _facts(docs: DataFrame, id_col: str, text_col: str, host_col: str, whole: bool, copies: bool = True) -> DataFrame:
    """A narrow row per document with its counts and its lines' hashes and lengths: the one pass over the texts."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.col(host_col).cast("string").alias("host"), *[F.struct(*quoted(docs)).alias("row")] * whole)
    words = let(
        F.split(flat(F.col("text")), " ", -1),
        lambda parts: let(
            F.array_remove(parts, ""),
            lambda w: F.struct(F.size(w).cast("long").alias("n_words"), (F.size(parts) - 1).alias("blanks"), _repeat_words(w).cast("long").alias("n_repeat_words")),
        ),
    )
    raw = F.filter(F.split(F.col("text"), "\n", -1), lambda x: x.rlike(WORD))
    lines = let(
        raw,
        lambda ls: F.struct(
            (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"),
            F.transform(ls, _line).alias("lines"),
        ),
    )
    rows = rows.select("*", words.alias("w"), lines.alias("l"))
    return rows.select(
        "doc_id",
        "host",
        (F.when(F.col("doc_id").isNotNull(), F.xxhash64(F.col("doc_id").cast("string"))).otherwise(F.xxhash64("text")) if copies else F.xxhash64("text")).alias("th"),
        "w.n_words",
        (F.length("text") - F.col("w.blanks")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.regexp_replace("text", r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        "l.n_dup_lines",
        "w.n_repeat_words",
        "l.lines",
        *["row"] * whole,
    )


def common_lines(facts: DataFrame, share: float = SHARE, least: int = LEAST) -> DataFrame:
    """(of, common): for each host that has any, the hashes of the lines above both limits.

    Documents are told apart by the facts' ``th``. A host has at most (mean number of
    lines of its documents / share) entries. A null host is a host of its own; lines
    without a word and null texts have no hashes; repeated rows count once. Of an
    empty table nothing is common.
    """
    # the null stands for the text itself
    hashes = F.concat(F.array(F.lit(None).cast("long")), F.array_distinct("lines.h"))
    held = facts.select("host", "th", F.explode(hashes).alias("h")).distinct().groupBy("host", "h").agg(F.count("*").alias("n"))
    held = materialize(held.where((F.col("n") >= least) | F.col("h").isNull()), "line_counts")
    texts = held.where("h is null").select(F.col("host").alias("of"), F.col("n").alias("texts"))
    above = held.where("h is not null").join(texts, F.col("host").eqNullSafe(F.col("of"))).where(F.col("n") > share * F.col("texts"))
    return materialize(above.groupBy("of").agg(F.collect_list("h").alias("common")), "common_lines")


def quality_rules(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", whole: bool = False, share: float = SHARE, least: int = LEAST, depleted: float = DEPLETED, copies: bool = True
) -> DataFrame:
    """One row per document, in any order: its counts, base_failed, kept and more.

    Columns: doc_id; n_words, word_chars (code points in words), n_symbols
    (characters of ``#*$%&|<>``), n_dup_lines (lines with a word, equal to an
    earlier line), n_repeat_words (words in 5-word windows found twice or more, the
    first included); base_failed (under 10 words, or over 20 % repeated words);
    n_common_lines and common_chars (lines of the document that its host repeats
    above the limits, and their characters in words); kept; with ``whole``
    also row, a struct of all columns of ``docs``, its text without those lines.

    The method: lines are normalised (lower case, without blanks) and hashed;
    distinct documents per host and line are counted, by doc_id and, of rows without one,
    by text (unless ``copies``, by text throughout, so that exact copies count once);
    lines held by more than ``share`` of a host's documents, and at least ``least``, are
    removed; a document of which they take over ``depleted`` of the characters in words
    isn't kept. All counts and the
    verdict are of the text as it came; the text without its common lines is in
    ``row`` only, its other lines and a text without common ones unchanged.

    A null text is empty (and fails). A null host is a host of its own. Every row is
    judged by itself, so repeated rows repeat. An empty table gives no rows, extra
    columns are ignored but for ``whole``.
    """
    facts = materialize(_facts(docs, id_col, text_col, host_col, whole, copies), "facts")
    common = common_lines(facts, share, least)
    if common.agg(F.coalesce(F.sum(F.size("common")), F.lit(0))).first()[0] <= BROADCAST:
        common = F.broadcast(common)
    rows = facts.join(common, F.col("host").eqNullSafe(F.col("of")), "left")
    # one pass over a host's common lines for each document, and then only those that it has
    rows = rows.withColumn("hits", F.when(F.col("common").isNotNull(), F.array_intersect(F.transform("lines", lambda x: x.getField("h")), F.col("common"))))
    gone = F.when(F.size("hits") > 0, F.filter("lines", lambda x: F.array_contains(F.col("hits"), x.getField("h"))))
    rows = rows.withColumn("gone", gone)
    rows = rows.withColumn("n_common_lines", F.when(F.col("gone").isNotNull(), F.size("gone")).otherwise(0).cast("long"))
    rows = rows.withColumn("common_chars", F.coalesce(F.aggregate("gone", F.lit(0).cast("long"), lambda total, x: total + x.getField("n")), F.lit(0)).cast("long"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    if whole:
        text = F.col("row").getField(text_col)
        clean = F.when(F.col("n_common_lines") > 0, _without(text.cast("string"), F.col("gone.h"))).otherwise(text)
        rows = rows.withColumn("row", F.col("row").withField(text_col, clean))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        (~failed & (F.col("common_chars") <= depleted * F.col("word_chars"))).alias("kept"),
        "n_common_lines", "common_chars",
        *["row"] * whole,
    )


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text, coalesce('i' || doc_id, 't' || text, '') AS who,
    list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
win AS (SELECT r, t.i, array_to_string(w[t.i:t.i+4], ' ') AS s FROM d, unnest(range(1, len(w) - 3)) AS t(i)),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, s) AS c FROM win) WHERE c > 1),
cov AS (SELECT r, count(DISTINCT again.i + j) AS n FROM again, range(0, 5) AS u(j) GROUP BY r),
lines AS (SELECT r, source, who, regexp_replace(lower(x), '[\x20\x09-\x0D]+', '', 'g') AS nl,
    length(regexp_replace(x, '[\x20\x09-\x0D]+', '', 'g')) AS c FROM d, unnest(l) AS t(x)),
hosts AS (SELECT source, count(DISTINCT who) AS texts FROM d GROUP BY source),
freq AS (SELECT l.source, nl FROM (SELECT source, nl, count(DISTINCT who) AS n FROM lines GROUP BY ALL) l
    JOIN hosts h ON l.source IS NOT DISTINCT FROM h.source WHERE n >= 10 AND n > 0.05 * texts),
gone AS (SELECT r, count(*) AS k, sum(c) AS c FROM lines JOIN freq ON lines.nl = freq.nl AND lines.source IS NOT DISTINCT FROM freq.source GROUP BY r),
m AS (SELECT d.r, doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
    coalesce(gone.k, 0)::BIGINT AS n_common_lines, coalesce(gone.c, 0)::BIGINT AS common_chars
    FROM d LEFT JOIN cov ON d.r = cov.r LEFT JOIN gone ON d.r = gone.r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
    NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND common_chars <= 0.5 * word_chars AS kept,
    n_common_lines, common_chars FROM m
"""
