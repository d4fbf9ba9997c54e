from __future__ import annotations

import base64
import hashlib
import html
import random
import re
import time

import pytest

from provena.llm import html_text, scratch, warc


def _sha(b):
    return base64.b32encode(hashlib.sha1(b).digest()).decode()


def _round(spark, rows, segment=64):
    path = scratch.new_path(spark, "warc")
    warc.archive_pages(spark.createDataFrame(rows, "page_id long, url string, html string"), path, segment)
    return {(r["record_id"], r["type"]): r for r in warc.payloads(warc.reassemble(warc.read_archive(spark, path))).collect()}


def test_round_trip_with_segments_and_revisits(spark):
    long = "é" * 700 + "\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\n" + "x" * 50
    rows = [(5, "http://a/", long), (3, "http://b/", long), (7, None, None), (9, "u\r\nX: y", ""), (11, "http://c/", "\r\n\r\n"), (12, "http://d/", "0\r\n\r\n" * 30)]
    out = _round(spark, rows)
    assert not [r for r in out.values() if r["problem"]]
    data = long.encode()
    one = out["urn:page:3", "response"]
    assert (one["payload_bytes"], one["payload_digest"]) == (len(data), _sha(data))
    again = next(r for (i, t), r in out.items() if t == "revisit" and i.startswith("urn:page:5"))
    assert (again["refers_to"], again["payload_bytes"], again["payload_digest"]) == ("urn:page:3", len(data), _sha(data))
    assert out["urn:page:7", "response"]["payload_bytes"] == 0
    assert out["urn:page:11", "response"]["payload_digest"] == _sha(b"\r\n\r\n")
    assert len(out) == 6


def test_repeated_rows_and_null_ids(spark):
    out = _round(spark, [(1, "u", "same"), (1, "u", "same"), (None, "u", "same"), (2, "u", "other")])
    kinds = sorted(t for _, t in out)
    assert kinds == ["response", "response", "revisit", "revisit"]
    assert out["urn:page:1", "response"]["payload_bytes"] == 4


def test_long_payloads_under_one_id_and_under_none(spark):
    rows = [(i, u, c * 500) for i, u, c in [(1, "u", "a"), (1, "u", "b"), (1, "v", "b"), (1, "w", "b"), (None, "u", "c"), (None, "u", "d"), (2, "u", "d")]]
    path = scratch.new_path(spark, "warc")
    warc.archive_pages(spark.createDataFrame(rows, "page_id long, url string, html string"), path, 64)
    out = warc.payloads(warc.reassemble(warc.read_archive(spark, path))).collect()
    assert not [r for r in out if r["problem"]] and len({r["full_id"] for r in out}) == 7
    sha = {c: _sha(c.encode() * 500) for c in "abcd"}
    assert sorted((r["record_id"], r["payload_digest"], r["payload_bytes"]) for r in out if r["type"] == "response") == sorted([("urn:page:1", sha["a"], 500), ("urn:page:1", sha["b"], 500), ("urn:page:null", sha["c"], 500), ("urn:page:2", sha["d"], 500)])
    named = {r["full_id"]: r["payload_digest"] for r in out if r["type"] == "response"}
    assert all(named[r["full_refers_to"]] == r["payload_digest"] for r in out if r["type"] == "revisit")


def test_no_pages(spark):
    assert _round(spark, []) == {}


def test_chunked_framing():
    for n in (0, 1, 5, 17):
        body = bytes(range(n))
        assert warc.dechunked(warc.chunked(body, 4)) == body
    assert warc.dechunked(b"3;name=x\r\nabc\r\n0\r\nTrailer: 1\r\n\r\n") == b"abc"
    for bad in (b"", b"5\r\nabc\r\n0\r\n\r\n", b"zz\r\n"):
        with pytest.raises(ValueError):
            warc.dechunked(bad)


def test_damaged_segments_are_told(spark):
    rows = [
        ("r", "response", 1, None, None, None, "D", b"ab"), ("r:3", "continuation", 3, "r", 6, None, "D", b"ef"),
        ("s", "response", 1, None, None, None, "D", b"ab"), ("s:2", "continuation", 2, "s", 9, None, "D", b"cd"),
        ("t", "response", 1, None, None, None, "D", b"ab"), ("t:2", "continuation", 2, "t", 4, None, "D", b"cd"),
    ]
    out = {r["record_id"]: r for r in warc.reassemble(spark.createDataFrame(rows, warc.RECORD)).collect()}
    assert out["r"]["problem"] == "segments are missing or repeated" and out["r"]["block"] is None
    assert out["s"]["problem"] == "the total length differs"
    assert bytes(out["t"]["block"]) == b"abcd" and out["t"]["problem"] is None


def test_op2_against_plain_rule(spark):
    pages = sorted((r["page_id"], (r["html"] or "").encode()) for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect())
    first, want = {}, {}
    for i, data in pages:
        want[i] = (len(data), _sha(data), "revisit" if data in first else "response", first.get(data))
        first.setdefault(data, i)
    out = warc.op2_warc_segments(spark, "/root/testdata/sf0.01").collect()
    assert {r["page_id"]: (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in out} == want and len(out) == len(pages)


@pytest.mark.parametrize(
    "source, text",
    [
        (None, ""), ("", ""), ("plain  text", "plain text"), ("<p>a<p>b", "a\n\nb"), ("a<br>b", "a\nb"), ("<ul><li>a<li>b</ul>", "- a\n- b"),
        ("<ol start=3><li>a</li><li>b<ul><li>c</ul></ol>", "3. a\n4. b\n   - c"), ("<div style='display: none'>x</div>y", "y"),
        ("<p style='visibility:hidden'>x<b style='visibility:visible'>y</b></p>", "y"), ("<script>if (a<b) x</script>z", "z"), ("<head><title>t</title></head><body>b", "b"),
        ("<title>t</title>b", "b"), ("<pre>\n a\n  b </pre>", " a\n  b"), ("<dl><dt>T<dd>D</dl>", "T\n  D"), ("a &amp; b &lt;c&gt; &copy;", "a & b <c> ©"),
        ("1 < 2 <", "1 < 2 <"), ("<table><tr><th>Name<th>N<tr><td>x<td>10<tr><td>long name<td>2</table>", "Name       N\nx          10\nlong name  2"),
        ("<table><tr><td colspan=2>head</td></tr><tr><td>a</td><td>b</td></tr></table>", "head\na  b"), ("<b>un<i>closed", "unclosed"), ("</div></p>x", "x"),
        ("<!-- <p>no</p> -->yes", "yes"), ("<p hidden>x</p><p>y</p>", "y"), ("<h1>A</h1>b<h2>C</h2>", "A\n\nb\n\nC"),
    ],
)
def test_rendering(source, text):
    assert html_text.render(source) == text


@pytest.mark.parametrize(
    "source, text",
    [
        ("<table><form><tr><td>x</td></tr></form></table>y", "x\n\ny"), ("<table><tr><td>a</td><p>note</p></tr><tr><td>b</table>", "note\n\na\nb"), ("<table><div>d</div><tr><td>a</table>", "d\n\na"),
        ("<table><a href=x>l</a><tbody><tr><td>a</table>", "l\n\na"), ("<table><tr><div>d<td>a<td>b</table>", "d\n\na  b"), ("<table><tr><td>a<tr><caption>c</caption></table>", "c\na"),
        ("<table><colgroup><b>x</b><tr><td>a</table>", "x\n\na"), ("<table><tr><td>a<table><tr><td>b</table>c</table>", "a\n\nb\n\nc"), ("<table><tr><table><tr><td>b</table>", "b"),
        ("<table><tr><td>a</td><img alt=pic></tr></table>", "pic\n\na"), ("<ul><li>a<table><tr><td><ul><li>b</ul></table><li>c</ul>", "- a\n\n  - b\n- c"), ("<table><script>no</script><tr><td>a</table>", "a"),
        ("<svg><title>t</title><defs><text>no</text></defs><text>a</text><text>b</text><path d='M 1'/></svg>c", "a\nb\nc"), ("<svg><defs/><style/><text>a</text></svg>", "a"), ("<svg><defs><g><p>out", "out"),
        ("<math><semantics><mi>x</mi><mo>=</mo><mn>2</mn><annotation>no</annotation></semantics></math>", "x=2"), ("<p>a<br/>b", "a\nb"), ("<div/>a", "a"),
    ],
)
def test_text_astray_in_tables_and_words_of_drawings(source, text):
    assert html_text.render(source) == text


@pytest.mark.parametrize(
    "source, text",
    [
        ("<table><tr><td rowspan=2>A<td>B<tr><td>C</table>", "A  B\n   C"), ("<table><tr><td>a<td rowspan=0>b<td>c<tr><td>d<td>e<tr><td>f</table>", "a  b  c\nd     e\nf"),
        ("<table><tr><td colspan=60>x<td>y<tr>" + "<td>z" * 61 + "</table>", "x" + " " * 179 + "y\n" + "  ".join("z" * 61)), ("<table><tr><td colspan=5>x<td>y<tr><td>ab<td>c</table>", "x      y\nab  c"),
        ("<details>no<summary>s</summary><p>no</details>a", "s\na"), ("<details open>b<summary>s</summary><p>yes</details>", "b\ns\n\nyes"), ("<a href='x>y'>l</a>", "l"), ("a<b c='d>e", "a<b c='d>e"), ("a <b", "a <b"),
        ("<!-- a > b -->c<!DOCTYPE x>d<!-- e", "cd"), ("<table><tr><td>" + "w" * 200 + "<td>b<tr><td>c<td>d</table>", "w" * 200 + "  b\nc" + " " * 121 + "d"),
    ],
)
def test_spans_details_and_tags(source, text):
    assert html_text.render(source) == text


@pytest.mark.parametrize("bit", ["<a ", "<a href='", "<a href=\"'", "<a \">\" ", "<b>x</b>", "<td colspan=1000 rowspan=9>x", "<tr><td rowspan=65534>x", "<tr><td>x" + "y" * 300 + "<td>z", "</p>", "<li>", "<!--", "<td>a", "<i>", "a<", "<svg>", "&amp", "<p><table>"])
def test_time_and_size_grow_with_the_page(bit):
    def took(n):
        began = time.perf_counter()
        size = len(html_text.render(bit * n))
        return time.perf_counter() - began, size

    took(100)
    n = 240_000 // len(bit)
    (short, less), (long, more) = took(n // 4), took(n)
    assert long < 10 * max(short, 0.05) and more < 10 * max(less, 1000)


def _random_tree(rng, depth, words):
    """HTML of nested blocks, lists, tables and hidden parts, and whether each of its words shows."""
    out = []
    for _ in range(rng.randint(1, 4)):
        kind = rng.choice(["text", "div", "p", "ul", "table", "span", "hidden", "none", "script", "off"] if depth < 5 else ["text"])
        inner = lambda: _random_tree(rng, depth + 1, words)
        if kind == "text":
            words.append(f"w{len(words)}")
            out.append(f" {words[-1]} ")
        elif kind == "p":
            words.append(f"w{len(words)}")
            out.append(f"<p>{words[-1]}</p>")
        elif kind == "ul":
            out.append("<ul>" + "".join(f"<li>{inner()}" for _ in range(rng.randint(1, 3))) + "</ul>")
        elif kind == "table":
            out.append("<table>" + "".join("<tr>" + "".join(f"<td>{inner()}" for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(1, 3))) + "</table>")
        elif kind in ("div", "span"):
            out.append(f"<{kind}>{inner()}</{kind}>")
        else:
            hidden = {"hidden": "<div hidden>{}</div>", "none": "<div style='color:red; display : none'>{}</div>", "script": "<script>{}</script>", "off": "<p style='visibility:hidden'>{}</p>"}[kind]
            out.append(hidden.format(f" no{len(words)} <b>no</b> " if kind != "script" else "no < x"))
    return "".join(out)


@pytest.mark.parametrize("seed", range(60))
def test_each_visible_word_of_random_trees_shows_once(seed):
    words: list[str] = []
    source = _random_tree(random.Random(seed), 0, words)
    shown = [w for w in html_text.render(source).split() if w != "-"]
    assert sorted(shown) == sorted(words)
    if "<table>" not in source:
        assert shown == words


@pytest.mark.parametrize("seed", range(20))
def test_cells_of_random_tables_align(seed):
    rng = random.Random(seed)
    rows = [[f"r{r}c{c}" + "x" * rng.randint(0, 9) for c in range(rng.randint(1, 6))] for r in range(rng.randint(1, 6))]
    lines = html_text.render("<table>" + "".join("<tr>" + "".join(f"<td>{x}" for x in row) for row in rows) + "</table>").split("\n")
    for c in range(6):
        starts = {line.index(row[c]) for line, row in zip(lines, rows, strict=True) if c < len(row)}
        assert len(starts) <= 1
    assert [line.split() for line in lines] == rows


def test_rendering_of_deep_and_long_pages():
    assert html_text.render("<div>" * 5000 + "deep" + "</div>" * 5000) == "deep"
    assert len(html_text.render("<p>" + "word " * 200_000)) == 5 * 200_000 - 1


@pytest.mark.parametrize("tag", ["a name=x", "font", "b", "div", "span", "blockquote"])
def test_deep_elements_keep_their_rules(tag):
    deep = f"<{tag}>" * 3000
    inside = "<script>s()</script><style>t</style><p hidden>h</p><i style='display:none'>n<b>n</b></i><template>u</template>"
    tail = "<ol><li>one<li>two</ol><table><tr><td>a<td>b<tr><td>c<td>d</table><pre>p\n <b>q</b></pre>"
    lines = [x.strip() for x in html_text.render(deep + inside + tail).split("\n") if x]
    cells = ["a", "b", "c", "d"] if tag == "blockquote" else ["a  b", "c  d"]
    assert lines == ["1. one", "2. two", *cells, "p", "q"]


def test_deep_lists_and_tables_stay_small():
    out = html_text.render("<ul><li>x" * 5000)
    assert out.split() == ["-", "x"] * 5000 and len(out) < 5_000_000
    assert html_text.render("<table><tr><td>x" * 3000).split() == ["x"] * 3000
    assert html_text.render("<p><button>" + "<div>" * 50_000 + "x") == "x"


def test_every_visible_word_of_the_pages_is_kept(spark):
    for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect():
        body = re.sub(r"(?s)<(script|style|title)\b.*?</\1>|<!--.*?-->", " ", r["html"])
        words = html.unescape(re.sub(r"<[^>]*>", " ", re.sub(r"<(/?(?:b|a|i|span|em|strong)\b)[^>]*>", "", body))).split()
        assert [w for w in html_text.render(r["html"]).split() if w != "-"] == [w for w in words if w != "-"]


def test_extract_keeps_rows_and_columns(spark):
    df = spark.createDataFrame([(1, "<p>a", "old"), (1, "<p>a", "old"), (2, None, "old")], "page_id long, html string, visible_text string")
    out = html_text.extract(df)
    assert sorted(out.columns) == ["html", "page_id", "visible_text"]
    assert sorted(r["visible_text"] for r in out.collect()) == ["", "a", "a"]
    assert html_text.extract(df.limit(0)).count() == 0


def test_deep_lists_without_text_stay_small():
    import tracemalloc

    for page, end in (("<ul><li>" * 100_000 + "x", "- x"), ("<ul><li>" * 3000 + "</li></ul>" * 2999 + "<li>y", "- y"), ("<ul><li><blockquote>" * 60_000, "")):
        tracemalloc.start()
        text = html_text.render(page)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert text.endswith(end) and peak < 300 << 20, (peak, text[-40:])
