import hashlib
import random

import duckdb
import numpy as np
import pytest
from pluvia.llm import line_dedup as L

SCHEMA = "doc_id long, text string, n_lines long, `a.b` string"


def brute(rows):
    where = {}

    def key(line):
        return "".join(c.lower() if c.isascii() else c for c in line.strip(" \t\n\x0b\x0c\r"))

    for doc, text, *_ in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 40:
                where.setdefault(key(line), set()).add(-(1 << 63) if doc is None else doc)
    out = []
    for doc, text, *_ in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(where.get(key(x), ())) < 5 or max(where[key(x)]) == doc]
        out.append((doc, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def rows_():
    rng = random.Random(3)
    lines = [f"{'é' if i % 3 == 0 else ''}This is line number {i} of some length, {'x' * rng.randint(0, 30)}" for i in range(60)] + ["", " ", "short", "é" * 39, "é" * 40, "x" * 39 + "  ", "y" * 40, "z" * 300_000]
    rows = []
    for d in range(120):
        own = [rng.choice([" {}", "{}\t", "{}\r"]).format(x) if rng.random() < 0.3 else x.upper() if rng.random() < 0.1 and x.isascii() else x for x in rng.choices(lines, k=rng.randint(0, 12))]
        rows.append((d * 7 % 120, "\n".join(own), d, "c"))
    rows += [(500, None, 0, None), (501, "", 0, None), (None, "\n".join(lines[:9]), 0, None), (None, "\n".join(lines[:20]), 0, None)]
    return rows + rows[:7] + [(rows[9][0], rows[10][1], 1, "other text, same id")]


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(L, "SHARD", 5)
    monkeypatch.setattr(L, "LINE", 2000)


def test_against_brute_force(spark, small):
    rows = rows_()
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    assert L.shards_for(df) > 10
    got = sorted(((r.doc_id, r["n_lines"], r.n_dropped, r.kept_sha256) for r in L.dedup_lines(df).collect()), key=str)
    assert got == brute(rows) and sum(r[2] for r in got) > 100


def test_texts_and_columns_stay(spark):
    rows = rows_()
    df = spark.createDataFrame(rows, SCHEMA)
    out = L.without_common_lines(df)
    assert out.columns == df.columns
    want = sorted((d, h) for d, _, _, h in brute([r for r in rows if r[0] is not None and r[1] is not None]))
    got = out.where("doc_id is not null and text is not null").collect()
    everything = {(d, h) for d, _, _, h in brute(rows)}
    assert len(got) == len(want) and all((r.doc_id, hashlib.sha256(r.text.encode()).hexdigest()) in everything for r in got)
    assert out.where("text is null").count() == 1 and out.count() == len(rows)


def test_sql_says_the_same(spark, tmp_path):
    rows = [r[:2] for r in rows_() if r[0] is not None]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/d/*.parquet'")
    want = sorted(map(tuple, con.execute(L.ORACLE).fetchall()), key=str)
    assert want == brute(rows)


def test_empty_table_and_nothing_common(spark):
    assert L.dedup_lines(spark.createDataFrame([], SCHEMA)).count() == 0
    df = spark.createDataFrame([(d, f"a line that only document {d} has, long enough to count\nshort", 0, None) for d in range(9)], SCHEMA)
    assert {r.n_dropped for r in L.dedup_lines(df).collect()} == {0}


def test_one_line_in_every_document(spark, small, monkeypatch):
    monkeypatch.setattr(L, "HELD", 10)
    line = "the same line stands in every one of the documents"
    df = spark.createDataFrame([(d, f"{line}\n{d}", 0, None) for d in range(2000)], SCHEMA).repartition(8)
    assert {r.doc_id: r.n_dropped for r in L.dedup_lines(df).collect()} == {d: int(d != 1999) for d in range(2000)}


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 50_000])
def test_perfect_hash_is_minimal_and_perfect(n):
    rng = np.random.default_rng(n)
    h, g = rng.integers(0, 1 << 63, (2, n)).astype(np.uint64)
    h[: n // 2] = h[n // 2 : 2 * (n // 2)]  # half of the keys differ in g only
    p = L.PerfectHash.unpack(L.PerfectHash.of(h, g).pack())
    assert sorted(p.slots(h, g).tolist()) == list(range(n))
    assert sum(map(len, p.levels)) <= 4 * n + 64
