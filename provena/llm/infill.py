"""Fill-in-the-middle: a text is cut at two random units and its parts are put out of order between marks.

The matcher goes over a text twice and holds no list of units. The first pass counts the
matches of the unit's pattern, the second advances a lazy iterator of matches to the two ranks
that are drawn. Only three numbers of a text come back from Python; the parts are put together,
and later taken apart again, by string functions in the JVM.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from provena.llm import batches

#: A line with its line feed, or what is left at the end.
LINE = r"[^\n]*\n|[^\n]+"
#: Marks before the prefix, the suffix and the middle.
MARKS = ("<P>", "<S>", "<M>")
SEED = 7


def _ranked_ends(text: str, unit: re.Pattern, first: int, second: int) -> tuple[int, int, int]:
    """Number n of units, and where the smaller and the larger of the draws modulo n + 1 end, in code points."""
    n = sum(1 for _ in unit.finditer(text))
    low, high = sorted((first % (n + 1), second % (n + 1)))
    lazy = unit.finditer(text)
    left = right = 0
    for m in islice(lazy, low):
        left = right = m.end()
    for m in islice(lazy, high - low):
        right = m.end()
    return n, left, right


def _check_marks(marks: tuple[str, str, str]) -> None:
    """Refuse marks of which one could begin inside another or inside itself: their first place would be in doubt."""
    if len(set(marks)) != 3 or any(not m for m in marks):
        raise ValueError("three different marks are needed")
    for x in marks:
        for y in marks:
            if any(x.endswith(y[:k]) for k in range(1, len(y))) or (x != y and x in y):
                raise ValueError(f"mark {y!r} could begin inside {x!r}")


def _draw(key: Column, k: int) -> Column:
    """The k-th (from 0) group of eight hexadecimal digits of a key, as a number."""
    return F.conv(F.substring(key, 8 * k + 1, 8), 16, 10).cast("long")


def transform(
    df: DataFrame, row_id: str = "doc_id", text: str = "text", unit: str = LINE, seed: int = SEED, rate: int = 100, spm: int = 50, marks: tuple[str, str, str] = MARKS
) -> DataFrame:
    """``df`` with ``units`` (long), ``form``, ``prefix_chars``, ``middle_chars`` (long) and ``infilled`` (string).

    Of all texts, ``rate`` per cent are put out of order, and ``spm`` per cent of these with the
    suffix first. Draws hang on the seed and the row's id alone. Texts that are empty or hold a
    mark, and those that are not drawn, are ``plain``: they stay as they are and their chars are
    null. A null text is an empty one; a null id draws like an empty one; rows that repeat are
    rows of their own and rows that share an id share its draws; an empty table gives none. A
    text costs its task its own size, however many units it has. Columns of ``df`` named like a
    new one are replaced; all others pass, whatever their names. Units should cover a text from
    left to right; what none covers at its end goes to the suffix.
    """
    _check_marks(marks)
    batches.bound(df.sparkSession)
    pattern = re.compile(unit)

    @F.pandas_udf("units long, prefix_end long, middle_end long")
    def ranked(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, first, second in parts:
            rows = [_ranked_ends(t, pattern, a, b) for t, a, b in zip(texts, first.tolist(), second.tolist(), strict=True)]
            yield pd.DataFrame(rows, columns=["units", "prefix_end", "middle_end"], dtype="int64")

    new = ["units", "form", "prefix_chars", "middle_chars", "infilled"]
    whole, key, found = batches.free_names(df, "whole", "drawn", "ranked")
    at = F.col(f"`{found}`")
    t, left, right, n = F.col(f"`{whole}`"), at["prefix_end"].cast("int"), at["middle_end"].cast("int"), at["units"]
    keep = [F.col(f"`{c}`") for c in df.columns if c not in new]
    draws = [_draw(F.col(f"`{key}`"), k) for k in range(4)]
    plain = (t == "") | F.contains(t, F.lit(marks[0])) | F.contains(t, F.lit(marks[1])) | F.contains(t, F.lit(marks[2])) | (draws[2] % 100 >= rate)
    form = F.when(plain, "plain").when(draws[3] % 100 < spm, "spm").otherwise("psm")
    prefix, middle, suffix = F.substr(t, F.lit(1), left), F.substr(t, left + 1, right - left), F.substr(t, right + 1)
    p, s, m = (F.lit(x) for x in marks)
    infilled = F.when(form == "psm", F.concat(p, prefix, s, suffix, m, middle)).when(form == "spm", F.concat(s, suffix, p, prefix, m, middle)).otherwise(t)
    chars = lambda x: F.when(form != "plain", x)
    return (
        df.withColumn(key, F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{row_id}`").cast("string"), F.lit(""))), 256))
        .withColumn(whole, F.coalesce(F.col(f"`{text}`"), F.lit("")))
        .withColumn(found, ranked(t, draws[0], draws[1]))
        .select(*keep, n.alias("units"), form.alias("form"), chars(at["prefix_end"]).alias("prefix_chars"), chars(at["middle_end"] - at["prefix_end"]).alias("middle_chars"), infilled.alias("infilled"))
    )


def restore(df: DataFrame, infilled: str = "infilled", form: str = "form", marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """``df`` with ``restored``: the text that ``infilled`` was made of, read off the marks alone.

    A null text is null, plain and empty ones stay as they are; a column ``restored`` is replaced.
    """
    _check_marks(marks)
    t, kind = F.col(f"`{infilled}`"), F.col(f"`{form}`")
    p, s, m = marks
    place = lambda mark: F.position(F.lit(mark), t)
    between = lambda mark, end: F.substr(t, place(mark) + len(mark), end - place(mark) - len(mark))
    rest = lambda mark: F.substr(t, place(mark) + len(mark))
    psm = F.concat(between(p, place(s)), rest(m), between(s, place(m)))
    spm = F.concat(between(p, place(m)), rest(m), between(s, place(p)))
    return df.withColumn("restored", F.when(kind == "psm", psm).when(kind == "spm", spm).otherwise(t))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document cut into lines and put out of order, with hashes of the result and of the text rebuilt from it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = restore(transform(docs))
    return out.select("doc_id", F.col("units").alias("n"), "form", "prefix_chars", "middle_chars", F.sha2("infilled", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


_SQL = """
with d as (
    select doc_id, coalesce(text, '') as t, sha256('7:' || coalesce(cast(doc_id as varchar), '')) as h from documents
), lines as (
    select *, cast(length(t) - length(replace(t, chr(10), '')) + case when t <> '' and right(t, 1) <> chr(10) then 1 else 0 end as bigint) as n,
        string_split(t, chr(10)) as parts,
        cast('0x' || substr(h, 1, 8) as bigint) as h1, cast('0x' || substr(h, 9, 8) as bigint) as h2,
        cast('0x' || substr(h, 17, 8) as bigint) as h3, cast('0x' || substr(h, 25, 8) as bigint) as h4
    from d
), drawn as (
    select *, least(h1 % (n + 1), h2 % (n + 1)) as lo, greatest(h1 % (n + 1), h2 % (n + 1)) as hi,
        case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 100 then 'plain' when h4 % 100 < 50 then 'spm' else 'psm' end as form
    from lines
), ends as (
    select *, case when lo = 0 then 0 when lo = n then length(t) else length(array_to_string(parts[1:lo], chr(10))) + 1 end as a,
        case when hi = 0 then 0 when hi = n then length(t) else length(array_to_string(parts[1:hi], chr(10))) + 1 end as b
    from drawn
), cut as (
    select *, substr(t, 1, a) as prefix, substr(t, a + 1, b - a) as middle, substr(t, b + 1) as suffix from ends
)
select doc_id, n, form,
    cast(case when form <> 'plain' then a end as bigint) as prefix_chars, cast(case when form <> 'plain' then b - a end as bigint) as middle_chars,
    sha256(case form when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle when 'spm' then '<S>' || suffix || '<P>' || prefix || '<M>' || middle else t end) as output_sha256,
    sha256(t) as restored_sha256
from cut
"""

QUERIES = {"op11_fill_in_middle": op11_fill_in_middle}
ORACLE_SQL: dict[str, str] = {"op11_fill_in_middle": _SQL}
