import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pluvia.llm import ranked_search as S

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
DOCS, ITEMS = "doc_id long, text string, score long, `a.b` int", "item_id long, text string, rank int"


def words(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, top):
    held = [(d, Counter(words(t))) for d, t, *_ in docs]
    held = [(d, c, sum(c.values())) for d, c in held if c]
    n, total, df = len(held), sum(k for *_, k in held), Counter(t for _, c, _ in held for t in c)
    asked = {}
    for i, text, *_ in items:
        asked.setdefault(i, set()).update(words(text))
    out = []
    for i, ts in asked.items():
        scores = []
        for d, c, k in held:
            m = 100 - 50 + (50 * k * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 20 * m)) for t in ts if c[t])
            if s > 0:
                scores.append((-s, d is None, d or 0))
        out += [(i, r, None if none else d, -s) for r, (s, none, d) in enumerate(sorted(scores)[:top], 1)]
    return sorted(out, key=str)


def data(seed=1, n=300):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)] + ["É", "é", "日本", "A1", "a1", "naïve", "x" * 500]
    weights = [1 / (k + 1) for k in range(len(vocab))]
    docs = [(d, rng.choice([" ", "-", "\x00", "_"]).join(rng.choices(vocab, weights, k=rng.randint(0, 40))), 0, 1) for d in range(n)]
    docs += [(n, None, 0, 1), (n + 1, "", 0, 1), (n + 2, "...", 0, 1), (None, "w1 w2 w3", 0, 1), (None, "w1 w2 w3", 0, 1), *docs[:5], (n + 3, " ".join(vocab * 300), 0, 1)]
    items = [(i, " ".join(rng.choices(vocab, k=rng.randint(1, 12))), 0) for i in range(12)] + [(50, None, 0), (51, "nothing of this", 0), (0, "w7 w9", 0), (None, "W1, É!", 0)]
    return docs, items


def found(spark, docs, items, **options):
    out = S.search(spark.createDataFrame(docs, DOCS).repartition(5), spark.createDataFrame(items, ITEMS), **options)
    return sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in out.collect()), key=str)


def test_against_brute_force(spark):
    docs, items = data()
    assert found(spark, docs, items, top=20) == brute(docs, items, 20)


def test_blocks_and_slices_change_nothing(spark, monkeypatch):
    docs, items = data(2, 120)
    monkeypatch.setattr(S, "SLICE", 40)
    monkeypatch.setattr(S, "DOCS", 16)
    assert found(spark, docs, items, block=15) == brute(docs, items, S.TOP)


def test_ties_over_many_tasks(spark):
    docs = [(d, "same words here", 0, 1) for d in range(400, 0, -1)] + [(1000 + d, "other", 0, 1) for d in range(100)]
    got = found(spark, docs, [(1, "words", 0)])
    assert sorted(r[2] for r in got) == list(range(1, 51)) and got == brute(docs, [(1, "words", 0)], 50)


def test_sql_says_the_same(spark, tmp_path):
    docs, items = data(3)
    docs, items = [d[:2] for d in docs if d[0] is not None], [i[:2] for i in items if i[0] is not None]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "i"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/d/*.parquet'")
    con.execute(f"create view benchmark as select * from '{tmp_path}/i/*.parquet'")
    assert sorted(map(tuple, con.execute(S.ORACLE).fetchall()), key=str) == brute(docs, items, 50)


def test_empty_tables(spark):
    docs, items = data()
    assert found(spark, [], items) == [] and found(spark, docs, []) == [] and found(spark, [(1, None, 0, 1)], items) == []


@pytest.mark.parametrize("n", [0, 1, 5000])
def test_radix_order(n):
    keys = np.random.default_rng(n).integers(0, 1 << 40, n)
    assert np.array_equal(S.radix_order(keys), np.argsort(keys, kind="stable"))
