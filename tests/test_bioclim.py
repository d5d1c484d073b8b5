import math
import random

import pytest
from pluvia.functions import primitives as P
from pluvia.functions.months import MONTHS, SERIES, arrays_to_wide, check_wide, column, long_to_wide, months, wide_to_long, texts
from pluvia.operators.indicators import NAMES, bioclim
from pluvia.plans.session import tuned
from pluvia.streaming.stream import bioclim_stream
from pyspark.sql import functions as F

RAMP = dict(tas=[m + 1 for m in range(12)], tasmax=[m + 2 for m in range(12)], tasmin=list(range(12)), pr=[m + 1 for m in range(12)])
#: The expected values of the ramp.
RAMP_BIO = [6.5, 2, 200 / 13, 100 * math.sqrt(143 / 12), 13, 0, 13, 11, 2, 11, 2, 78, 12, 1, 100 * math.sqrt(143 / 12) / 6.5, 11, 2, 11, 2]
SCHEMA = "pixel_id long, " + ", ".join(f"{s} array<double>" for s in SERIES)


def flat(tas, tasmax, tasmin, pr):
    return dict(tas=[tas] * 12, tasmax=[tasmax] * 12, tasmin=[tasmin] * 12, pr=[pr] * 12)


def table(spark, pixels):
    rows = [(i, *[[None if v is None else float(v) for v in p[s]] for s in SERIES]) for i, p in enumerate(pixels)]
    return spark.createDataFrame(rows, SCHEMA)


def results(spark, pixels, **options):
    return [r.asDict() for r in bioclim(arrays_to_wide(table(tuned(spark), pixels)), **options).orderBy("pixel_id").collect()]


def by_hand(p):
    """One pixel in plain Python."""
    def whole(c):
        return all(v is not None for v in c)

    def quarter(c, pick):
        if not whole(c):
            return None
        q = [c[i] + c[(i + 1) % 12] + c[(i + 2) % 12] for i in range(12)]
        return q.index(pick(q))

    def qmean(c, i):
        w = None if i is None else [c[(i + k) % 12] for k in range(3)]
        return None if w is None or not whole(w) else sum(w) / 3

    def std(c):
        m = sum(c) / 12
        return math.sqrt(sum((v - m) ** 2 for v in c) / 12)

    tas, hi, lo, pr = (p[s] for s in SERIES)
    o = dict.fromkeys(NAMES)
    if whole(tas):
        o["bio01"], o["bio04"] = sum(tas) / 12, 100 * std(tas)
    if whole(hi) and whole(lo):
        o["bio02"], o["bio07"] = sum(a - b for a, b in zip(hi, lo)) / 12, max(hi) - min(lo)
        o["bio03"] = 100 * o["bio02"] / o["bio07"] if o["bio07"] else None
    o["bio05"], o["bio06"] = max(hi) if whole(hi) else None, min(lo) if whole(lo) else None
    if whole(pr):
        o["bio12"], o["bio13"], o["bio14"] = sum(pr), max(pr), min(pr)
        o["bio15"] = 100 * std(pr) / (sum(pr) / 12) if sum(pr) > 0 else None
    wet, dry, warm, cold = quarter(pr, max), quarter(pr, min), quarter(tas, max), quarter(tas, min)
    for i, (c, at) in enumerate([(tas, wet), (tas, dry), (tas, warm), (tas, cold)]):
        o[f"bio{8 + i:02d}"] = qmean(c, at)
    for i, at in enumerate([wet, dry, warm, cold]):
        o[f"bio{16 + i}"] = qmean(pr, at)
    return o


def same(got, want):
    for k in NAMES:
        if want[k] is None:
            assert got[k] is None, k
        else:
            assert got[k] == pytest.approx(want[k], rel=1e-4, abs=1e-6), k


def test_ramp_and_copies(spark):
    for r in results(spark, [RAMP] * 3):
        same(r, dict(zip(NAMES, RAMP_BIO)))


def test_missing_and_mixed(spark):
    none, ramp = results(spark, [flat(None, None, None, None), RAMP])
    assert all(none[k] is None for k in NAMES)
    assert ramp["bio01"] == 6.5


def test_one_gap(spark):
    p = {k: list(v) for k, v in RAMP.items()}
    p["tas"][5] = p["pr"][5] = None
    r = results(spark, [p])[0]
    assert all(r[f"bio{i:02d}"] is None for i in (8, 9, 10, 11, 15, 16, 17, 18, 19))
    assert r["bio05"] == 13


def test_gap_only_in_the_averaged_series(spark):
    p = {k: list(v) for k, v in RAMP.items()}
    p["tas"][5] = None
    r = results(spark, [p])[0]
    assert r["bio08"] == 11 and r["bio09"] == 2 and r["bio16"] == 11
    assert r["bio18"] is None and r["bio19"] is None and r["bio10"] is None
    assert all(v is None for k, v in results(spark, [p], nodata_policy="strict")[0].items() if k != "pixel_id")


def test_guards(spark):
    same_t, dry, zero, uniform = results(spark, [flat(10, 10, 10, 5), flat(1, 1, 0, 0), flat(0, 0, 0, 0), flat(15, 20, 10, 50)])
    assert same_t["bio07"] == 0 and same_t["bio03"] is None
    assert dry["bio15"] is None and dry["bio12"] == 0
    assert zero["bio03"] is None and zero["bio15"] is None and zero["bio01"] == zero["bio04"] == zero["bio12"] == 0
    assert uniform["bio04"] == uniform["bio15"] == 0 and uniform["bio03"] == 100 and uniform["bio12"] == 600 and uniform["bio08"] == 15 and uniform["bio16"] == 50
    assert results(spark, [flat(1, 1, 0, -1)])[0]["bio15"] is None


def test_wrap_negative_and_different_peaks(spark):
    wrap = flat(1, 1, 0, 1)
    wrap["pr"] = [100 if m in (0, 1, 11) else 1 for m in range(12)]
    neg = dict(tas=[m - 6 for m in range(12)], tasmax=[m - 5 for m in range(12)], tasmin=[m - 7 for m in range(12)], pr=[m + 1 for m in range(12)])
    peaks = dict(RAMP, pr=[30, 30, 30] + [1] * 9)
    w, n, p = results(spark, [wrap, neg, peaks])
    assert w["bio16"] == 100
    assert (n["bio01"], n["bio02"], n["bio05"], n["bio06"], n["bio07"]) == (-0.5, 2, 6, -7, 13) and n["bio03"] == pytest.approx(200 / 13)
    assert (p["bio08"], p["bio09"], p["bio18"], p["bio19"]) == (2, 5, 1, 30)


def test_random_pixels_against_plain_python(spark):
    rng = random.Random(3)
    pixels = []
    for i in range(300):
        p = {s: [rng.choice([0, 1, 2, -3, 7.5, rng.uniform(-20, 40)]) for _ in range(12)] for s in SERIES}
        for s in SERIES:
            if rng.random() < 0.2:
                p[s][rng.randrange(12)] = None
        pixels.append({s: [None if v is None else round(v * 8) / 8 for v in p[s]] for s in SERIES})
    for r, p in zip(results(spark, pixels), pixels):
        same(r, by_hand(p))
    for r, p in zip(results(spark, pixels, precision="float"), pixels):
        same(r, by_hand(p))


def test_primitives(spark):
    wide = arrays_to_wide(table(spark, [flat(5, 5, 5, 5), RAMP, dict(RAMP, tas=[1] * 5 + [None] + [1] * 6)]))
    t = months("tas")
    got = wide.select(P.row_mean(t), P.row_sum(t), P.row_max(t), P.row_min(t), P.row_std(t), P.rolling_quarter_argmax(t), P.rolling_quarter_argmin(t), P.quarter_mean(t, F.lit(11))).collect()
    assert tuple(got[0]) == (5, 60, 5, 5, 0, 0, 0, 5)
    assert tuple(got[1]) == pytest.approx((6.5, 78, 12, 1, math.sqrt(143 / 12), 9, 0, 5))
    assert tuple(got[2])[:7] == (None,) * 7 and got[2][7] == 1
    assert wide.select(P.quarter_mean(t, F.lit(None).cast("int"))).first()[0] is None
    assert [x for x in wide.where("pixel_id = 1").select(*P.elementwise_diff(months("tasmax"), months("tasmin"))).first()] == [2] * 12


def test_shapes(spark):
    short = spark.createDataFrame([(1, [1.0] * 11, [1.0] * 12, [1.0] * 12, [1.0] * 12)], SCHEMA)
    with pytest.raises(Exception, match="12 months"):
        arrays_to_wide(short).collect()
    with pytest.raises(ValueError, match="12 months"):
        check_wide(arrays_to_wide(table(spark, [RAMP])).drop("tas_03"))
    with pytest.raises(ValueError):
        bioclim(arrays_to_wide(table(spark, [RAMP])), ["bio20"])


def test_long_and_wide_and_nan(spark):
    wide = arrays_to_wide(table(spark, [RAMP, flat(float("nan"), 1, 0, 2)]))
    assert wide.where("pixel_id = 1").first().tas_01 is None
    back = long_to_wide(wide_to_long(wide)).select(wide.columns)
    assert sorted(back.collect()) == sorted(wide.collect()) or sorted(map(str, back.collect())) == sorted(map(str, wide.collect()))


def test_plan_reads_only_what_it_needs(spark, tmp_path):
    wide = arrays_to_wide(table(spark, [RAMP]))
    wide.write.parquet(str(tmp_path / "p"))
    df = bioclim(spark.read.parquet(str(tmp_path / "p")), ["bio12"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "pr_01" in plan and "tas_01" not in plan and "Exchange" not in plan


def test_stream(spark, tmp_path):
    src = table(spark, [RAMP, flat(15, 20, 10, 50)])
    src.write.parquet(str(tmp_path / "in"))
    stream = bioclim_stream(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), outputs=["bio01"])
    q = stream.writeStream.format("memory").queryName("pixels").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.bio01 for r in spark.table("pixels").collect()) == [6.5, 15]


def test_queries_match_their_sql(spark):
    import duckdb
    from pluvia.plans.queries import ORACLES, QUERIES

    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("lineitem", "orders", "events"):
        con.sql(f"create view {t} as select * from '{d}/{t}.parquet'")
    assert set(QUERIES) == set(ORACLES)
    for name in ("bioclim_all", "bioclim_strict_missing", "bioclim_events", "bioclim_one_gap", "decode_temperature", "validate_months", "read_window"):
        df = QUERIES[name](spark, d)
        want = con.sql(f"select {', '.join(df.columns)} from ({ORACLES[name]})").fetchall()
        assert sorted(map(str, map(tuple, df.collect()))) == sorted(map(str, want)), name


_ = (MONTHS, column)

def test_primitives_of_columns_and_of_texts_agree(spark):
    rows = [(i, *[float((i * 7 + m * m) % 11) if (i + m) % 9 else None for m in range(12)]) for i in range(30)]
    wide = spark.createDataFrame(rows, ["pixel_id", *[f"tas_{m + 1:02d}" for m in range(12)]])

    def cells(c, start):
        one = [P.row_sum, P.row_mean, P.row_max, P.row_min, P.row_std, P.rolling_quarter_argmax, P.rolling_quarter_argmin]
        return [*[f(c) for f in one], P.quarter_mean(c, start), *P.quarter_sums(c)]

    columns, sql = cells(months("tas"), F.lit(11)), cells(texts("tas"), "11")
    assert wide.select(*columns).collect() == wide.selectExpr(*sql).collect()
