import pytest

from panelspark.operators.parse_lines import failing_lines, load_rows

SCHEMA = "line_id long, file_name string, line_no int, line string, sep string, reason string, _good long"


def frame(spark, lines, header="date,Open,High,Low,Close", file="a.csv"):
    rows = [(0, file, 1, header, ";", "x", 1)] + [(i + 1, file, i + 2, x, ";", "x", 1) for i, x in enumerate(lines)]
    return spark.createDataFrame(rows, SCHEMA)


def reasons(spark, lines, **how):
    df = frame(spark, lines, **how)
    bad = {r["line_id"]: r["reason"] for r in failing_lines(df).collect()}
    good = {r["line_id"] for r in load_rows(df).collect()}
    assert not good & set(bad) and good | set(bad) == set(range(1, len(lines) + 1))
    return [bad.get(i + 1) for i in range(len(lines))]


def test_reasons(spark):
    cases = {
        "2022-01-18,12.81,12.77,12.79,12.82": None, "2022-01-18,12.81,12.77,12.79,12.82\r": None, "2022-01-18,,,, 1e-3 ": None, " 2022-01-18 ,1,1,1,+.84": None, "2022-01-18T09:30,1,1,1,-5": None, "2022-01-18 09:30:59,1,1,1,366.": None,
        '"2022-01-18","1","1","1","1.5"': None, '2022-01-18,"a, b","say ""x""",1,2': None, '"2022-01-18","","","","""1"""': "close",
        "2022-01-18,12.81": "columns", "": "columns", "   ": "columns", None: "columns", "\r": "columns", "2022-01-18,1,1,1,1,": "columns", "2022-01-18;1;1;1;1": "columns", "2022-01-18,1,1,1,113,49": "columns",
        '2022-01-18,1,1,1,"108.30" x': "quoting", '2"022-06-04,1,1,1,1': "quoting", '2022-01-18,1,1,1,"1': "quoting", '2022-01-18,1,1,1,1"': "quoting", '2022-01-18,1,1,"a"b",1': "quoting",
        "2022-02-30,1,1,1,1": "datetime", "2022-1-3,1,1,1,1": "datetime", "2022-01-18 24:00,1,1,1,1": "datetime", "2022-01-18  09:30,1,1,1,1": "datetime", "2022-01-18 9h30,1,1,1,1": "datetime", ",1,1,1,1": "datetime", "Date,Open,High,Low,Close": "datetime", "2022-01-18 10:00:61,1,1,1,x": "datetime", "2022/01/18,1,1,1,1": "datetime",
        "2022-01-18,1,1,1,": "close", "2022-01-18,1,1,1,NaN": "close", "2022-01-18,1,1,1,-Infinity": "close", "2022-01-18,1,1,1,1e": "close", "2022-01-18,1,1,1,..5": "close", "2022-01-18,1,1,1,٣٤.١": "close", "2022-01-18,1,1,1,1e999": "close", "2022-01-18,1,1,1,1 2": "close", "2022-01-18,1,1,1,1\r\r": "close",
    }
    assert dict(zip(cases, reasons(spark, list(cases)))) == cases


def test_headers_differ(spark):
    assert reasons(spark, ["x;2020-01-01;1;2", "2020-01-01;1;2;3"], header="﻿Note;DateTime;close;open\r") == [None, "datetime"]
    assert reasons(spark, ["1,2020-01-01"], header='"CLOSE" , date') == [None]
    assert reasons(spark, ["2020-01-01,1"], header="date,open") == ["close"]


def test_no_header_is_columns_and_very_long_lines(spark):
    df = spark.createDataFrame([(1, "x", 2, "2020-01-01,1", "", "", 0), (2, None, 3, "2020-01-01,1", "", "", 0)], SCHEMA)
    assert sorted((r["line_id"], r["reason"]) for r in failing_lines(df).collect()) == [(1, "columns"), (2, "columns")]
    long = '2022-01-18,1,1,"' + 'x""' * 20_000 + '",1'
    assert reasons(spark, [long, "y" * 1_000_000]) == [None, "columns"]


def test_values_repeats_and_empty(spark):
    df = frame(spark, ["2022-01-18T09:30,1,1,1,2.5", "2022-01-19,1,1,1,3", "bad"])
    rows = sorted((r["line_id"], str(r["datetime"]), r["close"]) for r in load_rows(df.unionByName(df)).collect())
    assert rows == [(1, "2022-01-18 09:30:00", 2.5), (2, "2022-01-19 00:00:00", 3.0)]
    assert failing_lines(df.unionByName(df)).count() == 1
    assert failing_lines(df.limit(0)).count() == 0 == load_rows(df.limit(0)).count()


@pytest.mark.parametrize("n", [3])
def test_many_files_join_by_shuffle(spark, n, monkeypatch):
    from panelspark.sources import tables

    monkeypatch.setattr(tables, "small", lambda df, rows: False)
    assert reasons(spark, ["2022-01-18,1,1,1,1", "x"] * n) == [None, "columns"] * n


def test_lines_without_offset_are_not_lost(spark):
    rows = [(0, "a", 1, "date,close", "", "", 0), (None, "a", 2, "2020-01-01,1", "", "", 0), (None, "a", 3, "2020-01-01,abc", "", "", 0), (None, "a", None, "x", "", "", 0), (None, "a", None, "2020-01-02,2", "", "", 0), (None, None, None, None, "", "", 0)]
    df = spark.createDataFrame(rows * 2, SCHEMA)
    assert sorted(map(str, ((r["line_no"], r["line"], r["reason"]) for r in failing_lines(df).collect()))) == ["(3, '2020-01-01,abc', 'close')", "(None, 'x', 'columns')", "(None, None, 'columns')"]
    assert sorted(r["close"] for r in load_rows(df).collect()) == [1.0, 2.0]
