import math
import random

import pytest
from pluvia.functions.longform import QUARTERS, STARTS, quarters_long
from pluvia.functions.months import MONTHS, SERIES, long_to_wide, months, tables_to_wide
from pluvia.functions.primitives import rolling_quarter_argmax, rolling_quarter_argmin
from pluvia.operators.indicators import bioclim
from pluvia.plans.sql import register_bioclim

SCHEMA = "pixel_id long, month int, tas double, tasmax double, tasmin double, pr double"


def final_plan(df):
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_long_form_equals_wide_form(spark):
    rng, rows = random.Random(4), []
    for p in range(120):
        gap = rng.choice([None, None, "tas", "pr", "row"])
        at = rng.randint(1, 12)
        for m in MONTHS:
            tas, pr = float(rng.randint(0, 3)), float(rng.randint(0, 3))  # many ties
            if m == at and gap == "row":
                continue
            rows.append((p, m, None if (m, gap) == (at, "tas") else math.nan if rng.random() < 0.01 else tas, 0.0, 0.0, None if (m, gap) == (at, "pr") else pr))
    rows += rows[:50] + [(3, 0, 99.0, 9.0, 9.0, 99.0), (3, 13, 99.0, 9.0, 9.0, 99.0), (500, 4, None, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    wide = long_to_wide(df)
    starts = [(rolling_quarter_argmax if how == "max" else rolling_quarter_argmin)(months(s)).alias(n) for n, (s, how) in STARTS.items()]
    want = {r.pixel_id: r.asDict() for r in bioclim(wide, list(QUARTERS)).join(wide.select("pixel_id", *starts), "pixel_id").collect()}
    got = quarters_long(df)
    assert {r.pixel_id: r.asDict() for r in got.collect()} == want
    assert any(r["wettest"] is None for r in want.values()) and any(r["bio08"] is None and r["wettest"] is not None for r in want.values())
    assert final_plan(got).count("Exchange hashpartitioning") == 1
    assert quarters_long(df.limit(0)).count() == 0


def test_tables_of_one_series_each(spark):
    rows = {s: [(p, m, float(10 * i + m + p)) for p in range(20) if p % 5 != i for m in MONTHS] for i, s in enumerate(SERIES)}
    rows["pr"] += [(1, 3, 500.0), (1, 3, None), (1, 14, 9.0), (None, 1, 1.0), (2, 4, math.nan)]
    tables = {s: spark.createDataFrame(r, "pixel_id int, month int, value double") for s, r in rows.items()}
    wide = tables_to_wide(tables)
    got = {r.pixel_id: r for r in wide.collect()}
    assert set(got) == set(range(20)) and got[1].pr_03 == 500.0 and got[0].tas_01 is None and got[3].pr_12 is None and got[0].pr_01 == 31.0
    out = {r.pixel_id: r for r in bioclim(wide).collect()}
    assert out[0].bio01 is None and out[0].bio12 is not None and out[3].bio12 is None and out[4].bio12 is not None
    assert final_plan(wide).count("Exchange hashpartitioning") == 1
    assert tables_to_wide({s: t.limit(0) for s, t in tables.items()}).count() == 0
    with pytest.raises(ValueError, match="pr"):
        tables_to_wide({s: t for s, t in tables.items() if s != "pr"})


def test_sql_function_reads_what_it_needs(spark, tmp_path):
    rows = [(p, m, float(m + p), 1.0, 0.0, float(m) if p != 2 or m != 5 else None) for p in range(4) for m in MONTHS] + [(9, m, None, None, None, 1.0) for m in MONTHS]
    long_to_wide(spark.createDataFrame(rows, SCHEMA)).write.parquet(str(tmp_path / "px"))
    register_bioclim(spark.read.parquet(str(tmp_path / "px")))
    df = spark.sql("SELECT pixel_id, bio12 FROM bioclim() ORDER BY pixel_id")
    assert [tuple(r) for r in df.collect()] == [(0, 78.0), (1, 78.0), (2, None), (3, 78.0), (9, 12.0)]
    plan = final_plan(df)
    schema = plan[plan.index("ReadSchema") :].split("\n")[0]
    assert "pr_01" in schema and "tas" not in schema and plan.count("FileScan") == 1
    strict = spark.sql("SELECT pixel_id, bio12 FROM bioclim('strict') WHERE bio12 IS NOT NULL")
    assert {r.pixel_id for r in strict.collect()} == {0, 1, 3}
    assert spark.sql("SELECT * FROM bioclim('other')").count() == 0 and len(spark.sql("SELECT * FROM bioclim()").columns) == 20
