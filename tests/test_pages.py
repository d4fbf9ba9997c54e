"""Pages, their words and errors, report files and annotated pages, with providers that need no library."""

from __future__ import annotations

import json
import os
import sys
import tracemalloc
import zlib

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from provena.operators import pixels
from provena.plans import analyze
from provena.plans.report import Options
from provena.sources import files, pages, sinks

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers do not know the tests

#: What the fake recognizer sees on a picture, by its first byte.
LINES = {
    1: ["Invoice date: 15/08/2024", "Widget 2 100.00 200.00", "Subtotal 200.00", "Total 150.00"],
    2: ["Plain words only here"],
    3: [f"w{k}" for k in range(12)],
}


def _picture(kind: int) -> np.ndarray:
    out = np.full((400, 600, 3), 200, np.uint8)
    out[0, 0] = kind
    return out


def _make():
    """Fake files: ``PDF 1 2 boom`` has three pages, of which one can't be rendered; others have one."""

    def kinds(ext, content):
        text = content.decode("latin-1")
        if "unreadable" in text:
            raise ValueError("no pages")
        return text.split("%%EOF")[0].split()[1:] if ext == "pdf" else ["3"]

    def render(ext, content, first, last):
        for kind in kinds(ext, content)[first - 1 : last]:
            if kind == "boom":
                raise RuntimeError("torn page")
            yield _picture(int(kind))

    return pages.Pages(lambda ext, content: len(kinds(ext, content)), render)


def _recognize():
    def read(picture):
        rows = []
        for y, line in enumerate(LINES[int(picture[0, 0, 0])]):
            x = 20
            for word in line.split():
                rows.append({"text": word, "conf": 90.0, "x": x, "y": 40 + 30 * y, "w": 9 * len(word), "h": 16})
                x += 9 * len(word) + 8
        return rows

    return read


def _recompress():
    def again(picture):
        out = picture.copy()
        out[40:400:30, :, :] -= 1
        out[40 + 30 * 5 : 56 + 30 * 5] -= 90  # the sixth line comes out otherwise
        return out

    return again


READING = analyze.Reading(_make, _recognize, _recompress)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("pages")
    (d / "sub").mkdir()
    (d / "a.pdf").write_bytes(b"PDF 1 2 %%EOF /Producer (x) /CreationDate (D:20240101)")
    (d / "sub" / "a.pdf").write_bytes(b"PDF 2 boom 1 %%EOF /Producer (x) /CreationDate (D:20240101)")
    (d / "bad.pdf").write_bytes(b"unreadable /Producer (x) /CreationDate (D:20240101)")
    (d / "p.jpg").write_bytes(b"\xff\xd8\xff\xda")
    (d / "q.png").write_bytes(b"\x89PNG\r\n\x1a\n")
    return str(d)


def _by_name(rows, folder):
    return {r["file"].split(folder)[-1].lstrip("/"): r for r in rows}


def test_words_of_pages_reach_the_checks(spark, folder):
    got = _by_name(analyze.analyze_documents(spark, folder, as_of=F.lit("2030-01-01").cast("date"), reading=READING).collect(), folder)
    assert set(got) == {"a.pdf", "sub/a.pdf", "bad.pdf", "p.jpg", "q.png"}
    reasons = {k: [(f["page"], f["check"], f["field"]) for f in r["flags"]] for k, r in got.items()}
    assert any(p == 1 and c == "rule" for p, c, _ in reasons["a.pdf"]) and any(p == 3 and c == "rule" for p, c, _ in reasons["sub/a.pdf"])
    assert {k: r["error"] for k, r in got.items()} == {"a.pdf": None, "sub/a.pdf": "words: page 2: RuntimeError: torn page", "bad.pdf": "words: ValueError: no pages", "p.jpg": None, "q.png": None}
    assert [f["field"] for f in got["p.jpg"]["flags"] if f["check"] == "ela"] == ["w5"] and not [f for f in got["q.png"]["flags"] if f["check"] == "ela"]


def test_hidden_text_of_rendered_pages(spark, folder):
    def layer():
        return lambda ext, content: [{"page": 1, "word_no": 0, "x0": 300.0, "y0": 300.0, "x1": 340.0, "y1": 310.0, "text": "98765.00", "scale": 1.0}] if b"PDF 1 2" in content else []

    got = _by_name(analyze.analyze_documents(spark, folder, {"layer_words": layer}, reading=READING).collect(), folder)
    assert any(f["check"] == "layer" and f["field"] == "98765.00" for f in got["a.pdf"]["flags"])
    with pytest.raises(ValueError):
        analyze.analyze_documents(spark, folder, {"words": layer}, reading=READING)


def test_report_files_and_annotated_pages(spark, folder, tmp_path):
    out, kept = tmp_path / "out", analyze.Kept()
    got = _by_name(analyze.analyze_documents(spark, folder, reading=READING, save_to=str(out), kept=kept).collect(), folder)
    kept.release()
    assert not kept.frames
    names = sorted(os.path.relpath(os.path.join(d, n), out) for d, _, ns in os.walk(out) for n in ns if not n.startswith("."))
    assert {n for n in names if n.endswith(".json")} == {"a_tamper_report.json", "sub/a_tamper_report.json", "bad_tamper_report.json", "p_tamper_report.json", "q_tamper_report.json"}
    assert {"a_p1_annotated.png", "sub/a_p3_annotated.png", "p_annotated.png"} <= set(names) and not any("_staging" in n for n in names)
    report = json.loads((out / "sub" / "a_tamper_report.json").read_text())
    assert list(report) == ["file", "risk_score", "verdict", "flags", "annotated_files"] and report["annotated_files"] == ["sub/a_p3_annotated.png"]
    assert report["file"].endswith("sub/a.pdf") and report["risk_score"] == got["sub/a.pdf"]["risk_score"] and set(report["flags"][0]) == {"page", "field", "reason", "severity", "check", "bbox", "marker"}
    data = (out / "a_p1_annotated.png").read_bytes()
    at, raw = data.index(b"IDAT"), b""
    raw = zlib.decompress(data[at + 4 : at + 4 + int.from_bytes(data[at - 4 : at], "big")])
    drawn = np.frombuffer(raw, np.uint8).reshape(400 + pixels.BAR, 1801)[:, 1:].reshape(-1, 600, 3)
    box = next(f["bbox"] for f in got["a.pdf"]["flags"] if f["bbox"] and f["page"] == 1)
    assert drawn[pixels.BAR + box[1] + 2, box[0] + box[2] // 2].tolist() != [200, 200, 200] and drawn[-1, -1].tolist() == [200, 200, 200]
    assert (drawn[:52, 54:300] == 0).any() and drawn[20, 20].tolist() == [255, 150, 150]


def test_long_files_are_cut_into_ranges(spark, tmp_path):
    (tmp_path / "long.pdf").write_bytes(b"PDF " + b"2 " * 70)
    scanned = files.scan(spark, str(tmp_path))
    ranges = pages.page_ranges(scanned, _make, size=8, most=4)
    rows = ranges.orderBy("first").select("first", "last", "n_pages").collect()
    assert [tuple(r) for r in rows] == [(1, 18, 70), (19, 36, 70), (37, 54, 70), (55, 70, 70)]
    words = pages.page_words(ranges, _make, _recognize).groupBy("page").count().orderBy("page").collect()
    assert [tuple(r) for r in words] == [(p, 4) for p in range(1, 71)]
    assert pages.page_counts(ranges).count() == 70


def test_a_failed_write_leaves_no_file(spark, tmp_path):
    out = tmp_path / "out"
    good = spark.range(40).select(F.concat(F.lit("d"), (F.col("id") % 3).cast("string"), F.lit("/"), F.col("id").cast("string")).alias("name"), F.lit("text é").alias("content")).repartition(4)
    for bad in (good.unionByName(good.limit(1)), good.unionByName(good.limit(1).withColumn("name", F.lit("../x"))), good.withColumn("content", F.when(F.col("name") == "d1/1", F.raise_error(F.lit("torn"))).otherwise(F.col("content")))):
        with pytest.raises(Exception):  # noqa: B017, PT011
            sinks.write_files(bad, str(out))
        assert [n for _, _, ns in os.walk(out) for n in ns] == []
    sinks.write_files(good, str(out))
    sinks.write_files(good.limit(2), str(out))
    assert sorted(n for _, _, ns in os.walk(out) for n in ns) == sorted(map(str, range(40))) and (out / "d1" / "1").read_text() == "text é"
    assert sorted(os.listdir(out)) == ["d0", "d1", "d2"]


def test_box_means_are_those_of_the_pixels():
    rng = np.random.default_rng(3)
    a, b = (rng.integers(0, 256, (137, 90, 3), dtype=np.uint8) for _ in range(2))
    boxes = [(int(x), int(y), int(w), int(h)) for x, y, w, h in zip(*(rng.integers(-20, 150, 300) for _ in range(2)), *(rng.integers(0, 90, 300) for _ in range(2)), strict=True)]
    for band in (1, 16, 50, 512):
        for (x, y, w, h), m in zip(boxes, pixels.box_means(a, b, boxes, band), strict=True):
            part = np.abs(a.astype(int) - b)[max(0, y) : max(0, y + h), max(0, x) : max(0, x + w)]
            assert (m is None) == (part.size == 0) and (m is None or abs(m - part.mean()) < 1e-9)


def test_box_means_of_a_large_page_need_little_memory():
    a, b = np.zeros((5000, 10_000, 3), np.uint8), np.full((5000, 10_000, 3), 7, np.uint8)
    tracemalloc.start()
    got = pixels.box_means(a, b, [(0, 0, 10_000, 5000), (9_000, 4_990, 50, 50)])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == [7.0, 7.0] and peak < 300 << 20
