from __future__ import annotations

import re
from datetime import date, datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from provena.functions import scalars as S
from provena.functions.stats import group_medians, with_first_seen_mode, with_robust_z, with_split_robust_z


def each(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["o"] for r in df.select("i", f(F.col("v")).alias("o")).orderBy("i").collect()]


TOKENS = ["(1,234.50)", "$12", "₹1,20,000", "12%", "1.2.3", "abc", "", ".,", "7", "0.5", "12,", "€5.00|", "1O05", "10.20.30.40", "1d"]


def test_tokens(spark):
    assert each(spark, TOKENS, S.clean) == [t.strip(".,;:()[]|") for t in TOKENS]
    number = re.compile(r"[$₹€£]?\d[\d,.]*%?")
    want = [bool(number.fullmatch(t.strip(".,;:()[]|"))) for t in TOKENS]
    assert each(spark, TOKENS, S.is_numeric) == want
    assert each(spark, TOKENS, S.is_money) == [n and any(c in t.strip(".,;:()[]|") for c in ",.") and len(t.strip(".,;:()[]|")) >= 4 for n, t in zip(want, TOKENS, strict=True)]
    assert each(spark, ["1,234.5", "$5", "1.2.3", "12%", "1d", "7", "1e5"], S.to_number) == [1234.5, None, None, None, None, 7.0, None]


FAMILIES = {
    None: "", "": "", "Times-Roman": "times", "ABCDEF+Helvetica-BoldOblique": "helvetica", "TimesNewRomanPS-BoldItalicMT": "timesnew", "TimesNewRomanPSMT": "timesnew", "ArialMT": "arial", "Arial,Bold": "arial", "Arial_Italic": "arial",
    "abcdef+Arial": "abcdef+arial", "ABCDE+Arial": "abcde+arial", "ABCDEFG+Arial": "abcdefg+arial", "Courier New": "courier new", "Calibri Light": "calibri", "Segoe-SemiBold": "segoe", "FuturaDemi-Medium": "futura", "Roman": "", "Bold": "",
    "BoldFace": "boldface", "Gotham-Black-": "gotham-black-", "Univers--Bold": "univers-", "Maps": "ma", "Ubuntu Regular": "ubuntu", "XYZABC+": "",
}


def test_font_families(spark):
    assert dict(zip(FAMILIES, each(spark, list(FAMILIES), S.font_family), strict=True)) == FAMILIES


def test_dates(spark):
    pdf = ["D:20240131", "D:2024", "D:20240230", "D:20240131093005+02'00'", "2024", None, "D:20241301", "D:2024013109"]
    assert each(spark, pdf, S.parse_pdf_date) == [datetime(2024, 1, 31), datetime(2024, 1, 1), None, datetime(2024, 1, 31, 9, 30, 5), None, None, None, datetime(2024, 1, 31, 9)]
    assert each(spark, ["31/12/99", "8/25/2024", "1.2.2024", "30-02-2024"], lambda c: S.parse_date("dmy", c)) == [date(2099, 12, 31), None, date(2024, 2, 1), None]
    assert each(spark, ["8/25/2024"], lambda c: S.parse_date("dmy", c, swapped=True)) == [date(2024, 8, 25)]
    assert each(spark, ["5 March, 2024", "31 jun 24"], lambda c: S.parse_date("dMy", c)) == [date(2024, 3, 5), None]
    assert each(spark, ["05/08/2024", "2024-08-05", "x05/08/2024", "2024-13-01"], S.token_date) == [date(2024, 8, 5), date(2024, 8, 5), None, None]


def test_number_formats(spark):
    assert each(spark, ["1O05", "lO0", "OOO", "12", "1S", "B1O2,5"], S.looks_alike) == [True, False, False, False, False, True]
    assert each(spark, ["1,234", "1,23,456", "12,34", "1,2345", "$1,234.50", "1234", "12,34,5"], S.bad_thousands) == [False, False, True, True, False, False, True]
    assert each(spark, ["1.50", "1.5%", "12", "a.b", "1.234"], S.decimals) == [2, 1, None, None, 3]
    assert each(spark, [0.125, 2.675, 1234567.891, -5.0], S.money_text, "double") == ["0.12", "2.67", "1,234,567.89", "-5.00"]
    values = [18.0, 2.5, 12.75, 1234.5678, 0.1, 999999.4, 123456.7, 1e6, 1234567.0]
    assert each(spark, values, S.short_number, "double") == [f"{v:g}" for v in values]
    assert each(spark, [0.5, 1.0, 59.0], S.risk_percent, "double") == ["50.00%", "100.00%", "59.00%"]
    assert each(spark, ["Adobe Photoshop", "writer", None], S.mentions_tool) == [True, False, False]


def test_boxes(spark):
    row = spark.createDataFrame([(1.9, 2.2, 5.6, 7.9, 2.5)], "a double, b double, c double, d double, s double")
    args = [F.col(c) for c in "abcds"]
    corners, extent = row.select(S.scaled_corners(*args), S.scaled_extent(*args)).first()
    assert corners == [4, 5, 14 - 4, 19 - 5] and extent == [4, 5, 9, 14]


def test_robust_z_is_numpys(spark):
    rng = np.random.default_rng(1)
    rows = [(g, i, float(v)) for g in range(5) for i, v in enumerate(rng.integers(0, 30 if g else 1, 21 + g))]
    got = {(r["g"], r["i"]): (r["median"], r["z"]) for r in with_robust_z(spark.createDataFrame(rows, "g int, i int, v double"), "v", ["g"]).collect()}
    for g in range(5):
        v = np.array([x for k, _, x in rows if k == g])
        med = np.median(v)
        z = 0.6745 * (v - med) / (np.median(np.abs(v - med)) or 1e-6)
        assert all(got[g, i] == pytest.approx((med, z[i])) for i in range(len(v)))


def test_first_seen_mode(spark):
    rows = [(1, 0, 5), (1, 1, 3), (1, 2, 3), (1, 3, 5), (2, 0, 9), (2, 1, 8), (2, 2, 8)]
    got = {r["g"]: r["common"] for r in with_first_seen_mode(spark.createDataFrame(rows, "g int, i int, v int"), "v", ["i"], ["g"]).collect()}
    assert got == {1: 5, 2: 8}


def _two_ways(spark, rows, keys="g"):
    df = spark.createDataFrame(rows, "g int, i int, v double")
    one = {(r["g"], r["i"]): r for r in with_robust_z(df, "v", [keys]).collect()}
    two = {(r["g"], r["i"]): r for r in with_split_robust_z(df, "v", [keys], heavy=20, few=4).collect()}
    assert one.keys() == two.keys() and len(one) == len(rows)
    for k, r in one.items():
        assert repr((r["median"], r["n"], r["z"])) == repr((two[k]["median"], two[k]["n"], two[k]["z"])), k


def test_split_groups_have_the_same_robust_z(spark):
    rng = np.random.default_rng(2)
    rows = [(1 if i % 3 else None, i, float(v)) for i, v in enumerate(rng.normal(0, 1e3, 4001))]  # two large groups, one of null keys
    rows += [(2, i, float(2.0 ** (-i % 1000))) for i in range(1200)]  # values that no even bins tell apart
    rows += [(3, i, float(v)) for i, v in enumerate(rng.integers(0, 3, 500))] + [(4, 0, 5.0), (4, 1, None), (5, 0, None)]
    rows += [(6, i, float(v)) for i, v in enumerate(rng.integers(-40, 40, 600))]
    _two_ways(spark, rows)


def test_medians_of_extreme_values(spark):
    inf, nan, most = float("inf"), float("nan"), 1.7976931348623157e308
    held = {
        1: [-inf] * 3 + [inf] * 3 + [float(x) for x in range(50)],
        2: [most, -most, 5e-324, -5e-324, 0.0, 1e-323] * 5 + [float(x) for x in range(-30, 30)],
        3: [nan] * 40 + [float(x) for x in range(30)],
        4: [inf] * 60 + [float(x) for x in range(30)],
    }
    df = spark.createDataFrame([(g, x) for g, xs in held.items() for x in xs], "g int, v double")
    one = {r["g"]: repr(r["m"]) for r in df.groupBy("g").agg(F.median("v").alias("m")).collect()}
    assert {r["g"]: repr(r["median"]) for r in group_medians(df, "v", ["g"], heavy=5, few=2).collect()} == one


def test_split_robust_z_of_nothing_and_of_one_group_without_keys(spark):
    none = spark.createDataFrame([], "g int, i int, v double")
    assert with_split_robust_z(none, "v", ["g"]).collect() == []
    df = spark.range(1000).select(F.col("id").cast("double").alias("v"))
    assert {(r["median"], r["n"]) for r in with_split_robust_z(df, "v", [], heavy=10, few=4).collect()} == {(499.5, 1000)}
