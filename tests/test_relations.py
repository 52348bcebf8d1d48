"""Calendars in force, sheets and tidy columns on small tables; the queries on them are held against SQL in test_queries."""

from datetime import date

import pytest

from panelspark.operators import relations as rl


def test_dates_in_force(spark):
    d = lambda *days: spark.createDataFrame([(date(2024, 1, x),) for x in days], "date date")
    of = lambda df: {r["date"].day: r["since"].day if r["since"] else None for r in df.collect()}
    assert of(rl.in_force(d(1, 2, 5, 9, 9), d(2, 8))) == {1: None, 2: 2, 5: 2, 9: 8}
    assert of(rl.in_force(d(1, 2, 5, 9), d(2, 8), clamp=True)) == {1: 2, 2: 2, 5: 2, 9: 8}
    assert of(rl.in_force(d(1, 2, 8), d(2, 8), strict=True)) == {1: None, 2: None, 8: 2}
    assert of(rl.in_force(d(1), d(2).limit(0))) == {1: None}


def test_sheets_and_tidy_columns(spark):
    sheet = spark.createDataFrame([("x", "note", 1.5, 2), ("y", None, None, 3), ("x", "note", 1.5, 2)], "asset string, remark string, `2024-01` double, `2024-02` int")
    got = sorted(map(str, (tuple(r) for r in rl.sheet_rows(sheet).distinct().collect())))
    assert got == sorted(map(str, [("2024-01", "x", 1.5), ("2024-01", "y", None), ("2024-02", "x", 2.0), ("2024-02", "y", 3.0)]))
    with pytest.raises(ValueError):
        rl.sheet_rows(sheet.select("2024-01"))
    wide = spark.createDataFrame([(1, 0.5, 2.0, None, 9.0)], "i int, `a_1_ret` double, `a_1_vol_21` double, `b.c_ret` double, other double")
    rows = {tuple(r) for r in rl.tidy(wide, "i", ["ret", "21", "vol_21"]).collect()}
    assert rows == {(1, "a_1", "ret", 0.5), (1, "a_1", "vol_21", 2.0), (1, "b.c", "ret", None)}
    assert rl.tidy(wide.select("i", "other"), "i", ["ret"]).count() == 0


def test_boundaries_count_in_two_parts(spark):
    rows = [(date(2024, 1, i), 100.0, 5.0 if i in (3, 6) else 0.0, 0.1) for i in range(1, 9)]
    df = spark.createDataFrame(rows, "date date, equity double, flow double, ret double")
    got = {r["part"]: (r["first"].day, r["last"].day, round(r["ret"], 9)) for r in rl.shared_subperiods(df).collect()}
    assert got == {1: (1, 3, round(1.1**3 - 1, 9)), 2: (3, 6, round(1.1**4 - 1, 9)), 3: (6, 8, round(1.1**3 - 1, 9))}
    assert rl.shared_subperiods(df.limit(1)).count() == 0 == rl.shared_subperiods(df.limit(0)).count()
