from __future__ import annotations

import hashlib
import random
import re
import tracemalloc

import pytest
from pyspark.sql import functions as F

from provena.llm import infill


def _plain(doc_id, text, unit=infill.LINE, seed=7, rate=100, spm=50):
    """The contract's words, with a list of all units."""
    text, digest = text or "", hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    units = re.findall(unit, text)
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle = "".join(units[:a]), "".join(units[a:b])
    suffix = text[len(prefix) + len(middle) :]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    if h4 % 100 < spm:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def _rows():
    rng = random.Random(4)
    bits = ["a", "é", "\n", "\n\n", "\r\n", "😀 word", " ", "<", "P>", "<<S", ">", "line of words\n", " ", "<P", "M"]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randint(0, 30)))) for i in range(400)]
    return rows + [(None, "x\ny\nz"), (None, None), (7, None), (8, ""), (9, "\n"), (9, "\n"), (10, "no feed"), (11, "<P> in it\n"), (12, "<\nP>"), (13, "long line " * 50_000 + "\n" + "short\n" * 100_000)]


@pytest.mark.parametrize("options", [{}, {"rate": 40, "spm": 0, "seed": 3}, {"unit": r"[\s\S]", "spm": 100}, {"unit": r"\S+|\s+", "seed": -1}])
def test_against_lists_of_units_and_back(spark, options):
    rows = _rows()
    df = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, form int").withColumnRenamed("form", "row")
    out = {r["row"]: r for r in infill.restore(infill.transform(df, **options)).collect()}
    assert len(out) == len(rows)
    for k, (i, t) in enumerate(rows):
        r = out[k]
        assert (r["units"], r["form"], r["prefix_chars"], r["middle_chars"], r["infilled"]) == _plain(i, t, **options), (i, t and t[:80])
        assert r["restored"] == (t or "") and r["text"] == t


def test_clashing_columns_empty_tables_and_marks(spark):
    df = spark.createDataFrame([(1, "a\nb\n", "mine", 5, "kept")], "doc_id long, text string, form string, units int, whole string")
    row = infill.transform(df).first()
    assert row["whole"] == "kept" and row["form"] in ("psm", "spm") and row["units"] == 2 and infill.transform(df).columns.count("form") == 1
    assert infill.restore(infill.transform(df.limit(0))).count() == 0
    for marks in [("aa", "b", "c"), ("<P>", "<P>", "c"), ("", "b", "c"), ("ab", "bc", "x"), ("abc", "b", "x")]:
        with pytest.raises(ValueError):
            infill.transform(df, marks=marks)
    custom = infill.restore(infill.transform(df, marks=("«", "»", "¦")), marks=("«", "»", "¦")).first()
    assert custom["restored"] == "a\nb\n" and "«" in custom["infilled"]


def test_no_list_of_units_is_held():
    text, unit = "ab\n" * 400_000, re.compile(infill.LINE)
    tracemalloc.start()
    n, left, right = infill._ranked_ends(text, unit, 123_456, 399_999)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (n, left, right) == (400_000, 3 * 123_456, 3 * 399_999) and peak < 100_000


def test_python_returns_numbers_only(spark):
    df = spark.createDataFrame([(1, "a\nb\n")], "doc_id long, text string")
    plan = infill.transform(df).select(F.sha2("infilled", 256))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "Exchange" not in plan
