"""Views that give the test tables the shape of scanned invoices, PDF spans, metadata and tiles.

The views are SQL that Spark and DuckDB both read, but for how they unnest arrays; VIEWS has
them in order, each with the tables that it reads. Amounts, dates and fonts go wrong by fixed
arithmetic on keys, so every check has something to find and both engines the same.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("documents", "orders", "lineitem", "embeddings", "part")


def _str(x: str) -> str:
    return f"CAST({x} AS STRING)"


def _int(x: str) -> str:
    return f"CAST({x} AS BIGINT)"


def _two(x: str) -> str:
    return f"lpad({_str(x)}, 2, '0')"


def _money(c: str) -> str:
    c = f"({c})"
    return f"concat({_str(_int(f'floor({c} / 100)'))}, '.', {_two(f'{c} % 100')})"


def _commas(c: str) -> str:
    c = f"({c})"
    thousands = f"concat({_str(_int(f'floor({c} / 100000)'))}, ',', lpad({_str(_int(f'floor({c} / 100)') + ' % 1000')}, 3, '0'), '.', {_two(f'{c} % 100')})"
    return f"CASE WHEN {c} >= 100000 THEN {thousands} ELSE {_money(c)} END"


def _dmy(d: str) -> str:
    return f"concat({_two(f'day({d})')}, '/', {_two(f'month({d})')}, '/', {_str(f'year({d})')})"


def _iso(d: str) -> str:
    return f"concat({_str(f'year({d})')}, '-', {_two(f'month({d})')}, '-', {_two(f'day({d})')})"


_PAGE_LINES = [
    ("0", f"concat(CASE WHEN k % 29 = 0 THEN 'Issue Date ' ELSE 'Invoice Date: ' END, CASE WHEN k % 17 = 0 THEN {_iso('d')} ELSE {_dmy('d')} END)", "true"),
    ("1", f"concat('Due Date ', CASE WHEN k % 37 = 0 THEN '31/02/1996' WHEN k % 41 = 0 THEN '12 Mar 1985' WHEN k % 43 = 0 THEN '08/25/1997' ELSE {_dmy('due')} END)", "true"),
    ("2", "'Payment within 30 days of receipt'", "k % 3 <> 0"),
    ("3", "'Item Qty Price Amount'", "k % 10 <> 0"),
    ("90", f"concat(CASE WHEN k % 19 = 0 THEN 'Sub Total ' ELSE 'Subtotal ' END, {_commas('sub + CASE WHEN k % 11 = 0 THEN 100000 ELSE 0 END')})", "k % 7 <> 0"),
    ("91", f"concat('GST 18% ', {_money('tax + CASE WHEN k % 23 = 0 THEN 900 ELSE 0 END')})", "k % 8 <> 0"),
    ("92", "'Discount (50.00)'", "k % 4 = 0"),
    ("93", "'Total'", "k % 9 = 0"),
    ("94", f"concat(CASE WHEN k % 9 = 0 THEN 'due ' ELSE 'Total ' END, {_commas('total + CASE WHEN k % 5 = 0 THEN 10000 ELSE 0 END')})", "true"),
    ("95", "'Phone 555,1234 mob.'", "k % 6 = 0"),
]

_AMOUNT = f"""CASE WHEN (k + n) % 31 = 0 THEN concat('1,2', {_money('shown')})
  WHEN (k + n) % 19 = 0 THEN concat({_str(_int('floor(shown / 100)'))}, '.', {_str(_int('floor(shown % 100 / 10)'))})
  WHEN (k + n) % 2 = 0 THEN {_commas('shown')} ELSE {_money('shown')} END"""

_FONTS = "CASE {m} WHEN 0 THEN 'ABCDEF+Courier-Bold' WHEN 1 THEN 'Times-Roman' WHEN 2 THEN 'TimesNewRomanPS-BoldItalicMT' ELSE 'ABCDEF+Helvetica-Bold' END"


def _spans() -> str:
    """Four spans of each item, from one reading of the items."""
    parts = [
        ("concat('Item no. ', CAST(n AS STRING), CASE WHEN n % 2 = 0 THEN ' ' ELSE '' END)", "(k + n) % 13 = 0", "9.5", 10, 60),
        ("CAST(q AS STRING)", "(k + n) % 17 = 0", "9.5", 90, 20),
        (_money("shown"), "(k + n) % 23 = 0", "CASE WHEN (k + n) % 29 = 0 THEN 11.0 ELSE 9.5 END", 110, 50),
        ("CASE WHEN n = 1 THEN '   ' ELSE 'each unit' END", "(k + n) % 7 = 0", "9.5", 180, 40),
    ]
    by = lambda f: "CASE part " + " ".join(f"WHEN '{i}' THEN {f(p)}" for i, p in enumerate(parts)) + " END"
    odd = by(lambda p: p[1])
    font = _FONTS.replace("{m}", f"(CASE WHEN {odd} THEN (k + n) % 3 ELSE 9 END)")
    # Rows and columns are a little skewed on every fifth page.
    skew = "CASE WHEN k % 5 = 0 THEN (n * 3 + nth) % 4 ELSE 0 END"
    return f"""SELECT doc_id, page, block_no, line_no, span_no, text, font, CAST(size AS DOUBLE) AS size, x AS x0, y AS y0, x + width AS x1, y + 11 AS y1, CAST(200 AS DOUBLE) / CAST(72 AS DOUBLE) AS scale FROM (
  SELECT k AS doc_id, 1 AS page, 0 AS block_no, n AS line_no, CAST(part AS INT) AS span_no, {by(lambda p: p[0])} AS text, {font} AS font, {by(lambda p: p[2])} AS size,
    CAST({by(lambda p: str(p[3]))} + {skew} AS DOUBLE) + 0.5 AS x, CAST({by(lambda p: str(p[4]))} AS DOUBLE) + 0.25 AS width, CAST(n * 20 + 2 * ({skew}) AS DOUBLE) AS y
  FROM (SELECT k, n, q, shown, UNNEST:nth:part:line FROM (SELECT *, '0 1 2 3' AS line FROM {{items}}) a) b) s"""


def _page_lines() -> str:
    """The lines of a bill that are no items, from one reading of the bills."""
    by = lambda i: "CASE g " + " ".join(f"WHEN '{line[0]}' THEN {line[i]}" for line in _PAGE_LINES) + " END"
    numbers = " ".join(line[0] for line in _PAGE_LINES)
    return f"""SELECT k AS doc_id, 1 AS page, CAST(g AS INT) AS given_line, {by(1)} AS line
  FROM (SELECT k, d, due, sub, tax, total, UNNEST:nth:g:line FROM (SELECT *, '{numbers}' AS line FROM {{bills}}) a) b WHERE {by(2)}"""


#: name: (tables or views that it reads, SQL with these in braces)
VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "items": (
        ("lineitem",),
        """SELECT k, n, p, q, unit, unit * q AS amount, unit * q + CASE WHEN (k + n) % 13 = 0 THEN 5000 ELSE 0 END AS shown FROM (
          SELECT l_orderkey AS k, l_linenumber AS n, l_partkey AS p, CAST(l_quantity AS BIGINT) AS q, CAST(floor(round(l_extendedprice * 100) / l_quantity) AS BIGINT) AS unit
          FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice, l_quantity) AS r FROM {lineitem} WHERE l_quantity >= 1) b WHERE r = 1) a""",
    ),
    "bills": (
        ("orders", "items"),
        """SELECT k, d, d + CAST(k % 45 - 5 AS INT) AS due, sub, tax, sub + tax - CASE WHEN k % 4 = 0 THEN 5000 ELSE 0 END AS total FROM (
          SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS d, sub, CAST(floor(sub * 18 / 100) AS BIGINT) AS tax
          FROM {orders} o JOIN (SELECT k AS ik, CAST(sum(amount) AS BIGINT) AS sub FROM {items} GROUP BY k) s ON s.ik = o.o_orderkey) a""",
    ),
    "invoice_lines": (
        ("bills", "items"),
        f"""{_page_lines()}
  UNION ALL SELECT k AS doc_id, 1 AS page, CAST(10 + n AS INT) AS given_line, concat(CASE WHEN (k + n) % 47 = 0 THEN '1O05' ELSE concat('Part', {_str('p')}) END, ' ', {_str('q')}, ' ', {_money('unit')}, ' ', {_AMOUNT}) AS line FROM {{items}}""",
    ),
    "given_words": (("invoice_lines",), "SELECT doc_id, page, given_line, UNNEST:given_pos:text:line FROM {invoice_lines}"),
    "words": (
        ("given_words",),
        """SELECT doc_id, page, CAST(given_line * 100 + given_pos AS INT) AS word_no, text,
          CAST(CASE (doc_id * 7 + given_line * 3 + given_pos) % 20 WHEN 0 THEN -1 WHEN 1 THEN 30 WHEN 2 THEN 60 ELSE 91 END AS DOUBLE) AS conf,
          CAST(given_pos * 90 + 10 AS INT) AS x, CAST(given_line * 60 + 20 AS INT) AS y, CAST(length(text) * 8 AS INT) AS w,
          CAST(CASE WHEN (doc_id + given_line + given_pos) % 53 = 0 THEN 30 ELSE 16 END AS INT) AS h FROM {given_words}""",
    ),
    # Lines that overlap, baselines that wander, heights of two kinds, numbers in no order.
    "crowded_words": (
        ("words",),
        """SELECT doc_id, page, CAST(word_no * 7919 % 10007 AS INT) AS word_no, text, conf, x,
          CAST(CASE WHEN y > 5000 THEN y - 4800 ELSE y END / 5 AS INT) + CAST((doc_id * 5 + word_no * 3) % 8 AS INT) AS y, w, h FROM {words}""",
    ),
    "spans": (("items",), _spans()),
    "page_fonts": (("items",), "SELECT k AS doc_id, 1 AS page, concat('F', CAST(n AS STRING)) AS font_name FROM {items}"),
    "layer_words": (
        ("words",),
        """SELECT doc_id, page, word_no, CAST(x AS DOUBLE) / 2.5 AS x0, CAST(y AS DOUBLE) / 2.5 AS y0, CAST(x + w AS DOUBLE) / 2.5 AS x1, CAST(y + h AS DOUBLE) / 2.5 AS y1,
          CASE WHEN (doc_id + word_no) % 59 = 0 THEN concat('9', text) ELSE text END AS text, CAST(2.5 AS DOUBLE) AS scale FROM {words} WHERE (doc_id + word_no) % 61 <> 0""",
    ),
    "pdf_meta": (
        ("orders",),
        f"""SELECT k AS doc_id, CASE k % 6 WHEN 0 THEN 'Adobe Photoshop 25' WHEN 1 THEN '' WHEN 2 THEN CAST(NULL AS STRING) ELSE 'LibreOffice 7.5' END AS producer,
          CASE k % 8 WHEN 0 THEN 'iLovePDF' WHEN 1 THEN CAST(NULL AS STRING) ELSE 'Writer' END AS creator,
          CASE WHEN k % 5 = 0 THEN '' WHEN k % 31 = 0 THEN 'D:20231345' ELSE concat('D:', {_str('year(d)')}, {_two('month(d)')}, {_two('day(d)')}, '093000') END AS creation_date,
          CASE WHEN k % 7 = 0 THEN concat('D:', {_str('year(d)')}, {_two('month(d)')}, {_two('day(d)')}, '0931', {_two('k % 60')}) ELSE concat('D:', {_str('year(d)')}, {_two('month(d)')}, {_two('day(d)')}) END AS mod_date,
          CAST(1 + k % 3 AS INT) AS eof_count, k % 4 = 0 AS has_annot, k % 3 = 0 AS has_cover_annot FROM (SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS d FROM {{orders}}) a""",
    ),
    "exif_fields": (
        ("orders",),
        """SELECT k AS doc_id, CASE WHEN k % 2 = 0 THEN 'JPEG' ELSE 'PNG' END AS format, k % 5 <> 0 AS has_tags,
          CASE k % 7 WHEN 0 THEN 'GIMP 2.10' WHEN 1 THEN 'Camera 1.0' ELSE '' END AS software, CASE WHEN k % 3 = 0 THEN '2020:01:01 10:00:00' ELSE '' END AS taken_changed,
          CASE WHEN k % 6 = 0 THEN '2020:01:01 10:00:00' ELSE '2019:05:05 08:00:00' END AS original FROM (SELECT o_orderkey AS k FROM {orders}) a""",
    ),
    "ela_scores": (
        ("words",),
        "SELECT doc_id, page, word_no, text, conf, x, y, w, h, CASE WHEN (doc_id * 31 + word_no) % 97 = 0 THEN 80.5 ELSE CAST((doc_id * 31 + word_no * 17) % 100 AS DOUBLE) / 10.0 END AS ela FROM {words}",
    ),
    "cells": (("embeddings",), "SELECT vec_id AS image_id, UNNEST:i:cell:embedding FROM {embeddings}"),
    "tile_scores": (("cells",), "SELECT image_id, CAST(i % 8 * 168 AS INT) AS x, CAST(floor(i / 8) * 168 AS INT) AS y, CASE WHEN abs(CAST(cell AS DOUBLE)) * 3 > 1 THEN CAST(1 AS DOUBLE) ELSE abs(CAST(cell AS DOUBLE)) * 3 END AS score FROM {cells}"),
    "pixels": (("cells",), "SELECT CAST(0 AS INT) AS page, CAST(i AS INT) AS x, CAST(image_id AS INT) AS y, CAST(floor(abs(CAST(cell AS DOUBLE)) * 1000) AS BIGINT) AS v FROM {cells}"),
    "pixel_boxes": (
        ("orders",),
        "SELECT o_orderkey AS box_id, CAST(0 AS INT) AS page, CAST(o_orderkey * 7 % 70 - 5 AS INT) AS x, CAST(o_orderkey * 13 % 520 - 10 AS INT) AS y, CAST(o_orderkey % 23 AS INT) AS w, CAST(o_orderkey * 3 % 90 AS INT) AS h FROM {orders}",
    ),
    "image_sizes": (("orders",), "SELECT o_orderkey AS image_id, CAST(100 + o_orderkey * 37 % 1500 AS INT) AS width, CAST(100 + o_orderkey * 53 % 900 AS INT) AS height FROM {orders}"),
}

_UNNEST = re.compile(r"UNNEST:(\w+):(\w+):(\w+)")


def needed(names: list[str]) -> list[str]:
    """Views that these need, in order, themselves included."""
    out: list[str] = []

    def add(name: str) -> None:
        if name in VIEWS and name not in out:
            for x in VIEWS[name][0]:
                add(x)
            out.append(name)

    for n in names:
        add(n)
    return out


#: Items of a partition, so that a task sorts the words made of them in memory.
ITEMS = 100_000

_made: dict[tuple, DataFrame] = {}
_parts: dict[tuple, int] = {}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One view over the Parquet tables of a folder; analysed once for a session and folder."""
    key = (spark.sparkContext.applicationId, spark, sf_dir, name)
    if key not in _made:
        _made[key] = _view(spark, sf_dir, name)
    return _made[key]


def parts(spark: SparkSession, sf_dir: str) -> int:
    """Partitions that items are dealt over by their order: as many as Spark's shuffles have, more where a partition would hold over ITEMS of them."""
    key = (spark.sparkContext.applicationId, spark, sf_dir)
    if key not in _parts:
        items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
        _parts[key] = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-items // ITEMS))
    return _parts[key]


def _view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in VIEWS:
        table = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        # What is made of items is many times their size. Dealt here, by what all checks group by, it is never shuffled again.
        return table.repartition(parts(spark, sf_dir), "l_orderkey") if name == "lineitem" else table
    reads, sql = VIEWS[name]

    def unnest(m: re.Match) -> str:
        source = f"split({m[3]}, ' ')" if m[3] == "line" else m[3]
        return f"posexplode({source}) AS ({m[1]}, {m[2]})"

    given = {r: view(spark, sf_dir, r) for r in reads}
    if name == "invoice_lines":
        # The join in bills keeps items of known orders only. Taken apart here, these come from the same scan and shuffle.
        items = given["items"]
        given["items"] = items.where("k is not null").unionAll(items.where("k is null"))
    return spark.sql(_UNNEST.sub(unnest, sql), **given)


def duckdb_views(names: list[str]) -> str:
    """The same views as DuckDB common table expressions."""

    def unnest(m: re.Match) -> str:
        source = f"string_split({m[3]}, ' ')" if m[3] == "line" else m[3]
        return f"generate_subscripts({source}, 1) - 1 AS {m[1]}, unnest({source}) AS {m[2]}"

    return ",\n".join(f"{n} AS MATERIALIZED ({re.sub(r'[{](\w+)[}]', r'\1', _UNNEST.sub(unnest, VIEWS[n][1]))})" for n in needed(names))
