from __future__ import annotations

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__
from provena.operators import pixels
from provena.plans import analyze
from provena.plans.oracles import ORACLE_SQL
from provena.plans.queries import QUERIES
from provena.sources import files

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


def _plain(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    return sorted(tuple("" if pd.isna(v) else repr(float(v)) if isinstance(v, int | float | np.number) and not isinstance(v, bool | np.bool_) else str(v) for v in r) for r in df.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.sql(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) > 0 and _plain(got) == _plain(want)


@pytest.mark.parametrize("name", ["token_classify", "ela_outliers", "invoice_totals"])
def test_items_and_orders_that_do_not_meet(spark, tmp_path, name):
    """Items without an order or its number, orders without items, orders twice."""
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    con.execute(f"COPY (SELECT * REPLACE (CASE WHEN l_orderkey % 5 <> 0 THEN l_orderkey END AS l_orderkey) FROM '{SF}/lineitem.parquet') TO '{tmp_path}/lineitem.parquet'")
    con.execute(f"COPY (SELECT * REPLACE (CASE WHEN o_orderkey % 11 <> 0 THEN o_orderkey END AS o_orderkey) FROM '{SF}/orders.parquet' WHERE o_orderkey % 7 <> 0 UNION ALL SELECT * FROM '{SF}/orders.parquet' WHERE o_orderkey % 13 = 0) TO '{tmp_path}/orders.parquet'")
    for t in ("lineitem", "orders"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    got, want = QUERIES[name](spark, str(tmp_path)).toPandas(), con.sql(ORACLE_SQL[name]).df()
    assert len(got) > 0 and _plain(got) == _plain(want)


def test_every_query_is_registered():
    assert set(QUERIES) <= set(__spark_entry__.queries()) and set(ORACLE_SQL) <= set(__spark_entry__.oracle_sql())
    assert set(QUERIES) == set(ORACLE_SQL)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def _exif(tags: dict[int, str]) -> bytes:
    """A JPEG's head with an EXIF block of text tags."""
    body, at = b"II*\0\x08\0\0\0" + len(tags).to_bytes(2, "little"), 8 + 2 + 12 * len(tags) + 4
    data = b""
    for tag, text in sorted(tags.items()):
        value = text.encode() + b"\0"
        body += tag.to_bytes(2, "little") + (2).to_bytes(2, "little") + len(value).to_bytes(4, "little") + (at + len(data)).to_bytes(4, "little")
        data += value
    block = b"Exif\0\0" + body + b"\0\0\0\0" + data
    return b"\xff\xd8\xff\xe1" + (len(block) + 2).to_bytes(2, "big") + block + b"\xff\xda"


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("in")
    rng = np.random.default_rng(1)
    (d / "a.png").write_bytes(pixels.png(rng.integers(0, 255, (300, 500, 3), dtype=np.uint8)))
    (d / "b.PDF").write_bytes(b"%PDF-1.4 <</Producer (iLovePDF) /CreationDate (D:20240101) /ModDate (D:20240202)>>\n%%EOF\n/Type /Annot /Subtype /Square\n%%EOF\n")
    (d / "c.jpg").write_bytes(_exif({0x0131: "GIMP 2.10", 0x0132: "2024:01:01 00:00:00"}))
    (d / "d.jpeg").write_bytes(b"\xff\xd8\xff\xda")
    (d / "e.txt").write_bytes(b"no document")
    return str(d)


def test_documents_of_a_folder(spark, folder, tmp_path):
    got = {r["file"].rsplit("/", 1)[1]: r for r in analyze.analyze_documents(spark, folder, save_to=str(tmp_path / "out")).collect()}
    assert {k: (r["risk_score"], r["verdict"]) for k, r in got.items()} == {
        "a.png": (0, "NO STRONG SIGNS OF TAMPERING"), "b.PDF": (12, "LIKELY TAMPERED"), "c.jpg": (6, "SUSPICIOUS"), "d.jpeg": (1, "NO STRONG SIGNS OF TAMPERING"),
    }
    with pytest.raises(FileNotFoundError):
        analyze.analyze_documents(spark, str(tmp_path / "out"))


def test_a_failing_provider_is_a_row(spark, folder):
    def make():
        def read(ext, content):
            if ext == "png":
                raise ValueError("broken")
            return [{"page": 1, "font_name": ext}] * 2

        return read

    from provena.sources.schemas import PAGE_FONTS

    rows = files.provided(files.scan(spark, folder), make, PAGE_FONTS).collect()
    assert sorted((r["font_name"] or "", r["error"] or "") for r in rows) == [("", "ValueError: broken"), *[("jpeg", "")] * 2, *[("jpg", "")] * 2, *[("pdf", "")] * 2]


def test_reports_show_what_providers_failed_on(spark, folder):
    def make():
        def read(ext, content):
            if ext == "png":
                raise ValueError("broken")
            return []

        return read

    got = {r["file"].rsplit("/", 1)[1]: r["error"] for r in analyze.analyze_documents(spark, folder, {"page_fonts": make, "words": make}).collect()}
    assert got == {"a.png": "page_fonts: ValueError: broken; words: ValueError: broken", "b.PDF": None, "c.jpg": None, "d.jpeg": None}


def test_pictures_that_are_not_decoded_are_rows(spark, tmp_path):
    good = pixels.png(np.zeros((250, 250, 3), dtype=np.uint8))
    for name, data in {"a + b%20é.png": good, "cut.png": good[:60], "w.webp": b"RIFF\0\0\0\0WEBPVP8 ", "e.txt": b"x"}.items():
        (tmp_path / name).write_bytes(data)
    model = lambda: lambda tiles: [{"real": 0.0, "fake": 0.5} for _ in tiles]
    got = {r["filename"]: (r["total_tiles"] is not None, r["error"] is None) for r in analyze.analyze_photos(spark, str(tmp_path), model, ["real", "fake"]).collect()}
    assert len(got) == 3 and {k: v for k, v in got.items() if v == (False, False)}.keys() == {"cut.png", "w.webp"}
    assert sorted(got.values()) == [(False, False)] * 2 + [(True, True)]


def test_photos_of_a_folder(spark, folder):
    model = lambda: lambda tiles: [{"real": 0.0, "fake": float(t[0, 0].mean() / 255)} for t in tiles]
    r = analyze.analyze_photos(spark, folder, model, ["real", "fake"]).where("filename = 'a.png'").first()
    assert (r["width"], r["height"], r["total_tiles"], r["ai_label"], len(r["tile_scores"])) == (500, 300, 6, "fake", 6)
    assert [t["score"] for t in r["tile_scores"]] == sorted((t["score"] for t in r["tile_scores"]), reverse=True)
    with pytest.raises(ValueError):
        analyze.analyze_photos(spark, folder, model, ["real", "other"])


def test_errors_and_annotations_of_pixels(spark, folder):
    image = files.scan_images(spark, folder).where("width = 500").selectExpr("cast(1 as long) doc_id", "1 page", "width", "height", "nChannels", "data")
    words = spark.createDataFrame([(1, 1, 0, "a", 90.0, 0, 0, 10, 10), (1, 1, 1, "b", 90.0, 5, 5, 3, 10), (1, 1, 2, "c", 90.0, 900, 0, 10, 10)], "doc_id long, page int, word_no int, text string, conf double, x int, y int, w int, h int")
    got = pixels.word_errors(image, words, lambda: lambda p: p // 2).collect()
    assert [r["text"] for r in got] == ["a"] and got[0]["ela"] > 0
    boxes = spark.createDataFrame([(1, 1, 1, "red", "x.png", 10, 10, 30, 30), (1, 1, 2, "yellow", "x.png", -5, -5, 5, 5)], "doc_id long, page int, flag_seq int, marker string, annotated_file string, left int, top int, right int, bottom int")
    out = pixels.annotate(image, boxes).first()
    assert out["annotated_file"] == "x.png" and bytes(out["png"])[:8] == b"\x89PNG\r\n\x1a\n"
    flat = np.full((40, 40, 3), 100, np.uint8)
    drawn = pixels.highlight(flat, [(10, 10, 20, 20)], (255, 0, 0), 110)
    assert drawn[15, 15].tolist() == [167, 57, 57] and drawn[10, 10].tolist() == [100, 100, 100] and drawn[5, 5].tolist() == [100, 100, 100]


def test_arrivals(spark, folder, tmp_path):
    from provena.streaming.arrivals import arrivals, report_arrivals

    q = report_arrivals(arrivals(spark, folder), str(tmp_path / "sink"), str(tmp_path / "check"))
    q.awaitTermination(120)
    assert spark.read.json(str(tmp_path / "sink")).count() == 4


def test_a_tile_that_the_model_raises_on_costs_its_photo_only(spark, tmp_path):
    flat = np.full((300, 700, 3), 100, np.uint8)
    bad = flat.copy()
    bad[150:, 400:450] = 7
    for name, picture in {"good.png": flat, "bad.png": bad}.items():
        (tmp_path / name).write_bytes(pixels.png(picture))
    calls = []

    def predict(tiles):
        calls.append(len(tiles))
        if any((t == 7).any() for t in tiles):
            raise RuntimeError("no score")
        return [{"real": 0.5, "fake": 0.5} for _ in tiles]

    tiles = [np.full((4, 4, 3), 7 if k in (3, 9) else 1, np.uint8) for k in range(16)]
    assert [e for _, e in pixels._bisected(predict, tiles)] == [("RuntimeError: no score" if k in (3, 9) else None) for k in range(16)] and len(calls) < 20
    model = lambda: lambda tiles: [(_ for _ in ()).throw(RuntimeError("no score")) if (t == 7).any() else {"real": 0.5, "fake": 0.5} for t in tiles]
    kept = analyze.Kept()
    got = {r["filename"]: r for r in analyze.analyze_photos(spark, str(tmp_path), model, ["real", "fake"], kept=kept).collect()}
    kept.release()
    assert got["bad.png"]["error"] == "model: RuntimeError: no score" and got["bad.png"]["decision"] is None
    assert got["good.png"]["error"] is None and got["good.png"]["decision"] == "REVIEW" and len(got) == 2
