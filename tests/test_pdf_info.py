"""Information dictionaries of PDFs that are built here byte by byte."""

from __future__ import annotations

import zlib

import pytest

from provena.operators.metadata import check_pdf_metadata
from provena.sources import files
from provena.sources.pdf_info import Unreadable, information, value

WANTED = {"Producer": "Ünïcode (nested) maker", "Creator": "a\\b\n", "CreationDate": "D:20240101120000", "ModDate": "D:20240102120000"}
INFO = b"<< /Producer <FEFF00DC006E00EF0063006F006400650020\n0028006E006500730074006500640029 0020006D0061006B00650072> /Creator (a\\\\b\\n) /CreationDate (D:2024\\060101120000) /ModDate (D:20240102\\\n120000) /Trapped /False >>"


def _classic(info: bytes, trailer: bytes = b"", eol: bytes = b" \n") -> bytes:
    out, places = b"%PDF-1.4\n", []
    for n, body in ((1, b"<< /Type /Catalog >>"), (2, info)):
        places.append(len(out))
        out += b"%d 0 obj\n%s\nendobj\n" % (n, body)
    table = b"".join(b"%010d 00000 n%s" % (p, eol) for p in places)
    return out + b"xref\n0 3\n0000000000 65535 f%s%strailer\n<< /Size 3 /Root 1 0 R /Info 2 0 R %s >>\nstartxref\n%d\n%%%%EOF\n" % (eol, table, trailer, len(out))


def _updated(first: bytes, info: bytes) -> bytes:
    """An incremental save that replaces object 2."""
    at, old = len(first), int(first.rpartition(b"startxref\n")[2].split()[0])
    out = first + b"2 0 obj\n" + info + b"\nendobj\n"
    return out + b"xref\n2 1\n%010d 00000 n \ntrailer\n<< /Size 3 /Root 1 0 R /Prev %d >>\nstartxref\n%d\n%%%%EOF\n" % (at, old, len(out))


def _compressed(info: bytes, predictor: bool = False, extra: bytes = b"") -> bytes:
    """Object 2 in an object stream (3), places in a cross-reference stream (4)."""
    out = b"%PDF-1.5\n"
    one = len(out)
    out += b"1 0 obj\n<< /Type /Catalog >>\nendobj\n"
    head = b"1 0 2 22 "
    body = zlib.compress(head + b"<< /Other (object) >>".ljust(22) + info)
    three = len(out)
    out += b"3 0 obj\n<< /Type /ObjStm /N 2 /First %d /Length %d /Filter /FlateDecode >>\nstream\n" % (len(head), len(body)) + body + b"\nendstream\nendobj\n"
    four = len(out)
    cells = [(0, 0, 255), (1, one, 0), (2, 3, 1), (1, three, 0), (1, four, 0)]
    rows = [bytes([t]) + p.to_bytes(3, "big") + bytes([g]) for t, p, g in cells]
    parms = b""
    if predictor:
        above, coded = bytes(5), []
        for r in rows:
            coded.append(b"\2" + bytes((a - b) & 255 for a, b in zip(r, above, strict=True)))
            above = r
        rows, parms = coded, b"/DecodeParms << /Predictor 12 /Columns 5 >>"
    table = zlib.compress(b"".join(rows))
    out += b"4 0 obj\n<< /Type /XRef /Size 5 /W [1 3 1] /Root 1 0 R /Info 2 0 R /Filter /FlateDecode %s %s /Length %d >>\nstream\n" % (parms, extra, len(table)) + table
    return out + b"\nendstream\nendobj\nstartxref\n%d\n%%%%EOF\n" % four


@pytest.mark.parametrize("data", [_classic(INFO), _classic(INFO, eol=b"\r\n"), _updated(_classic(b"<< /Producer (old) >>"), INFO), _compressed(INFO), _compressed(INFO, predictor=True), _classic(INFO) + b"junk" * 9])
def test_dictionaries_of_all_kinds(data):
    assert information(data) == WANTED


def test_missing_encrypted_and_damaged(tmp_path):
    whole = _classic(INFO)
    assert information(whole.replace(b"/Info 2 0 R", b"            ")) == {}
    assert information(_classic(INFO, b"/Encrypt 9 0 R")) is None and information(_compressed(INFO, extra=b"/Encrypt 9 0 R")) is None
    assert information(b"") is None and information(b"startxref\n99999999\n") is None
    for k in range(0, len(whole), 3):
        assert information(whole[:k] + b"?" + whole[k + 1 :]) is None or True  # nothing raises
    compressed = _compressed(INFO)
    for k in range(0, len(compressed), 3):
        information(compressed[:k] + b"\xff" + compressed[k + 1 :])
    loop = whole.replace(b"/Size 3", b"/Prev %d" % whole.index(b"xref\n0"))
    assert information(loop) is None or information(loop) == WANTED
    with pytest.raises(Unreadable):
        value(b"[" * 100, 0)


def test_strings():
    assert value(rb"(a(b\)c)d\101\7\
e)", 0)[0] == b"a(b)c)dA\x07e" and value(b"<48 6 5 6C6c6>", 0)[0] == b"Hell`" and value(b"[1 0 R /N (x) -3 null]", 0)[0] == [(1, 0), "/N", b"x", -3, "null"]


def test_no_false_stripped_metadata(spark, tmp_path):
    for name, data in {"c.pdf": _compressed(INFO), "e.pdf": _classic(INFO, b"/Encrypt 9 0 R"), "n.pdf": _classic(INFO).replace(b"/Info 2 0 R", b"            "), "x.pdf": _updated(_classic(INFO), INFO)}.items():
        (tmp_path / name).write_bytes(data)
    scanned = files.scan(spark, str(tmp_path))
    meta = {r["file"][-5:]: r for r in files.pdf_meta(scanned).join(scanned.select("doc_id", "file"), "doc_id").collect()}
    assert meta["c.pdf"]["producer"] == WANTED["Producer"] and meta["e.pdf"]["info_read"] is None and meta["n.pdf"]["info_read"] is True
    found = {(r["file"][-5:], r["reason"]) for r in check_pdf_metadata(files.pdf_meta(scanned)).join(scanned.select("doc_id", "file"), "doc_id").collect()}
    assert {f for f, r in found if "stripped" in r} == {"n.pdf"} and ("x.pdf", "2 %%EOF markers: file was saved incrementally") in found
    assert {f for f, r in found if "well after creation" in r} == {"c.pdf", "x.pdf"}
