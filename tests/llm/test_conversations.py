import hashlib
import random
import zlib
from functools import cache

import pytest
from pluvia.llm import conversation_repair as R

EMPTY = hashlib.sha256(b"").hexdigest()
BLANKS = " \t\n\x0b\x0c\r"
SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    """{conv_id: row} by the statement of the problem: all edits by recursion, strings and all."""
    convs = {}
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        what, kept = zlib.crc32(key.encode()) % 20, convs.setdefault(conv, [])
        if what == 1:
            text = ""
        if what == 2:
            text = "".join(c for c in text if c not in ".!?")
        if what == 4:
            role = "user"
        kept += [(turn, role, text)] * {0: 0, 3: 2}.get(what, 1)
    out = {}
    for conv, turns in convs.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0))
        seen, faults = set(), []
        for _, role, text in turns:
            ends = text.rstrip(BLANKS)
            faults.append("blank" if not ends else "duplicate" if (role, text) in seen else "truncated" if ends[-1] not in ".!?" else "")
            seen.add((role, text))
        numbers = {t for t, _, _ in turns if t is not None}
        initials = [role[:1] for _, role, _ in turns]

        @cache
        def best(i, made, budget, turns=turns, faults=faults):
            """(cost, letters, roles) of the least completion; ``made`` is the state's last two initials."""
            found = []
            if i == len(turns) and made in ("", "a"):
                found.append((0, "", ()))

            def go(letter, cost, j, role, text, follows, left=3):
                if follows == "s" and made != "" or follows == "u" and made == "u" or follows == "a" and made != "u" or follows not in ("s", "u", "a"):
                    return
                c, s, r = best(j, follows, left)
                found.append((cost + c, letter + s, ((role, text), *r)))

            if budget:
                go("I", 3, i, "user", "", "u", budget - 1)
                go("I", 3, i, "assistant", "", "a", budget - 1)
            if i < len(turns):
                _, role, text = turns[i]
                c, s, r = best(i + 1, made, 3)
                found.append((4 + c, "D" + s, r))
                if faults[i] not in ("blank", "duplicate"):
                    more = 3 * (faults[i] == "truncated")
                    go("K", more, i + 1, role, text, role[:1])
                    go("R", 3 + more, i + 1, "user", text, "u")
                    go("R", 3 + more, i + 1, "assistant", text, "a")
            return min(found, default=(10**9, "", ()))

        for i in range(len(turns), 0, -1):  # from the end, so that recursion stays shallow
            for made in ("", "s", "u", "a"):
                best(i, made, 3)
        cost, audit, kept = best(0, "", 3)
        text = "\n".join(f"{r}:{t}" for r, t in kept)
        out[conv] = {
            "gaps": max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0, **{f: faults.count(f) for f in ("blank", "duplicate", "truncated")},
            "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False)), "cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256(text.encode()).hexdigest(),
        }
    return out


def check(spark, rows, parts=3):
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    got = {r.conv_id: {k: v for k, v in r.asDict().items() if k != "conv_id"} for r in R.repair(R.damage(df)).collect()}
    assert got == brute(rows)
    return got


def test_against_brute_force(spark):
    rng, rows = random.Random(5), []
    roles, texts = ["system", "user", "user", "assistant", "assistant", "tool", None, "", "uncle"], ["One. ", "Two!", "Three", "", " \t", None, "Four?\n", "é.", "Seven..."]
    for conv in range(250):
        turns = rng.sample(range(12), rng.randint(0, 7))
        rows += [(conv, t, rng.choice(roles), rng.choice(texts)) for t in turns]
    rows += [(None, t, rng.choice(roles), rng.choice(texts)) for t in range(6)] + [(900, None, "user", "Hm."), (901, None, "assistant", "A."), (901, 4, "user", "B.")]
    got = check(spark, rows)
    assert any("R" in r["audit"] for r in got.values()) and any("I" in r["audit"] for r in got.values())


def test_repeated_rows_are_duplicates_side_by_side(spark):
    rows = [(7, t, r, f"{r} {t}.") for t, r in enumerate(["system", "user", "assistant", "user", "assistant"] * 3)]
    check(spark, rows * 3)


def test_long_conversation_over_many_ranges(spark):
    rng = random.Random(2)
    rows = [(1, t, rng.choice(["user", "assistant", "system"]), f"{rng.randint(0, 150)}{rng.choice(['.', ''])}") for t in range(600)] + [(c, 0, "user", "Alone.") for c in range(2, 40)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        check(spark, rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_all_turns_dropped_and_empty_table(spark):
    gone = [(c, 0) for c in range(400) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    got = check(spark, [(c, t, "user", "x.") for c, t in gone])
    assert set(got) == {c for c, _ in gone} and all(r == {"gaps": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0, "audit": "", "repaired_sha256": EMPTY} for r in got.values())
    assert R.repair(R.damage(spark.createDataFrame([], SCHEMA))).count() == 0


def test_extra_columns_and_repaired_turns(spark):
    rows = [(1, t, r, f"{r} {t}.", 1, "x") for t, r in enumerate(["user", "user", "assistant", "tool"])]
    df = spark.createDataFrame(rows, SCHEMA + ", times long, `a.b` string")
    turns = df.select("conv_id", "turn", "role", "text", "times")
    found = R.plans(turns)
    assert found.first().audit == brute_audit(["user", "user", "assistant", "tool"])
    kept = R.repaired(turns, found).orderBy("place").collect()
    assert "".join(r.role[0] for r in kept) in ("uaua", "ua") and [r.place for r in kept] == list(range(len(kept)))
    assert R.repair(R.damage(df)).columns[:2] == ["conv_id", "gaps"]


def brute_audit(roles):
    return R.Automaton().solve(bytes("sua".find(r[0]) if r[0] in "sua" else 3 for r in roles))[1]


@pytest.mark.parametrize("turns, want", [(b"", (0, "")), (bytes([1, 2]), (0, "KK")), (bytes([0]), (4, "D")), (bytes([1]), (3, "KI")), (bytes([2]), (3, "IK")), (bytes([0, 2]), (3, "KIK")), (bytes([1 + 8, 1 + 12]), (8, "DD"))])
def test_small_cases(turns, want):
    assert R.Automaton().solve(turns) == want


def test_table_stays_small():
    a, rng = R.Automaton(), random.Random(1)
    for _ in range(300):
        a.solve(bytes(rng.randrange(R.TURNS) for _ in range(100)))
    assert len(a.vectors) < 200
