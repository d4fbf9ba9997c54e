"""Pages as pictures: a provider opens a file and renders it page by page; what is read of a page becomes rows.

A file is never held as a list of pictures: its pages come from an iterator, one at a time. A long
file is cut into ranges of pages, which are read by tasks of their own. A page that can't be
rendered or read is a row with its error; the pages after it are read all the same.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from provena.operators.pixels import annotated_png, box_means
from provena.sources.files import bounded, image_format, parsed_number
from provena.sources.schemas import DEFAULT, WORDS
from provena.sources.shipping import ship

#: Pages of a range, and most ranges of a file: each range carries the file's bytes once.
RANGE, MOST = 16, 16


@dataclass(frozen=True)
class Pages:
    """How pictures are had of a file: the number of its pages, and an iterator of the pages from a first to a last one.

    Both take the extension and the bytes; pictures are height x width x 3 bytes, red first.
    """

    count: Callable[[str, bytes], int]
    render: Callable[[str, bytes, int, int], Iterator[np.ndarray]]


def rendered(dpi: int = DEFAULT.pdf_dpi) -> Callable[[], Pages]:
    """A provider of pages with PyMuPDF for PDFs and Pillow for pictures, where these are installed on the workers."""

    def make() -> Pages:
        def opened(content: bytes):
            import fitz

            return fitz.open(stream=content, filetype="pdf")

        def count(ext: str, content: bytes) -> int:
            return opened(content).page_count if ext == "pdf" else 1

        def render(ext: str, content: bytes, first: int, last: int) -> Iterator[np.ndarray]:
            if ext == "pdf":
                doc = opened(content)
                for p in range(first - 1, last):
                    m = doc[p].get_pixmap(dpi=dpi, alpha=False)
                    yield np.frombuffer(m.samples, np.uint8).reshape(m.height, m.width, 3)
            else:
                import io

                from PIL import Image

                yield np.asarray(Image.open(io.BytesIO(content)).convert("RGB"))

        return Pages(count, render)

    return make


def recognizer(command: str | None = None) -> Callable:
    """A provider of a picture's words with pytesseract, where that is installed on the workers."""

    def make():
        import pytesseract
        from PIL import Image

        if command:
            pytesseract.pytesseract.tesseract_cmd = command

        def read(picture: np.ndarray) -> list[dict]:
            d = pytesseract.image_to_data(Image.fromarray(picture), output_type=pytesseract.Output.DICT)
            kept = [i for i, text in enumerate(d["text"]) if text.strip()]
            return [{"word_no": i, "text": d["text"][i].strip(), "conf": parsed_number(d["conf"][i])} | {k: int(d[name][i]) for k, name in (("x", "left"), ("y", "top"), ("w", "width"), ("h", "height"))} for i in kept]

        return read

    return make


def recompressor(quality: int = 90) -> Callable:
    """A provider of a picture saved as JPEG and read again with Pillow, where that is installed on the workers."""

    def make():
        import io

        from PIL import Image

        def again(picture: np.ndarray) -> np.ndarray:
            held = io.BytesIO()
            Image.fromarray(picture).save(held, "JPEG", quality=quality)
            return np.asarray(Image.open(held).convert("RGB"))

        return again

    return make


_RANGES = "doc_id long, ext string, content binary, first int, last int, n_pages int, error string"


def page_ranges(files: DataFrame, make: Callable[[], Pages], size: int = RANGE, most: int = MOST) -> DataFrame:
    """(doc_id, ext, content, first, last, n_pages, error): each file's pages in ranges, dealt out evenly.

    A file has at most ``most`` ranges, so that its bytes are copied no more often; longer files
    have longer ones. A file whose pages can't be counted is one row with an error and no pages.
    """
    ship(files.sparkSession)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pages = make()
        for part in parts:
            for i, ext, content in zip(part["doc_id"], part["ext"], part["content"], strict=True):
                try:
                    n, error = pages.count(ext, bytes(content)), None
                except Exception as e:  # noqa: BLE001
                    n, error = 0, f"{type(e).__name__}: {e}"
                step = max(size, -(-n // most))
                rows = [(i, ext, content, at, min(at + step - 1, n), n, None) for at in range(1, n + 1, step)]
                for row in rows or [(i, ext, None, None, None, n, error)]:
                    yield pd.DataFrame([row], columns=["doc_id", "ext", "content", "first", "last", "n_pages", "error"], dtype=object)

    return bounded(files.select("doc_id", "ext", "content")).mapInPandas(run, _RANGES).repartition("doc_id", "first")


def read_pages(ranges: DataFrame, make: Callable[[], Pages], reader: Callable[[], Callable[[dict, np.ndarray], list[dict]]], schema: T.StructType, columns: tuple[str, ...] = ()) -> DataFrame:
    """Rows that a reader makes of each page, with doc_id, page and ``error`` (null if none).

    ``reader`` runs once in each worker; it gives a callable from a page's facts (page, ext,
    content and the ``columns`` of its range) and picture to rows of ``schema``.
    """
    out = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("page", T.IntegerType()), *[f for f in schema.fields if f.name not in ("doc_id", "page")], T.StructField("error", T.StringType())])
    names = [f.name for f in out.fields]
    ship(ranges.sparkSession)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pages, read = make(), reader()
        said = lambda e: f"{type(e).__name__}: {e}"
        for part in parts:
            for r in part.to_dict("records"):
                if pd.isna(r["first"]):
                    rows = [{"doc_id": r["doc_id"], "error": r["error"]}] if r["error"] else []
                    if rows:
                        yield pd.DataFrame([[x.get(n) for n in names] for x in rows], columns=names, dtype=object)
                    continue
                content, at, last = bytes(r["content"]), int(r["first"]), int(r["last"])
                pictures = None
                while at <= last:
                    try:
                        pictures = pictures or pages.render(r["ext"], content, at, last)
                        picture = next(pictures)
                        rows = [{**x, "doc_id": r["doc_id"], "page": at, "error": None} for x in read({"page": at, "ext": r["ext"], "content": content} | {c: r[c] for c in columns}, picture)]
                    except StopIteration:
                        rows, pictures = [{"doc_id": r["doc_id"], "page": at, "error": "the page was not rendered"}], None
                    except Exception as e:  # noqa: BLE001
                        rows, pictures = [{"doc_id": r["doc_id"], "page": at, "error": said(e)}], None  # the iterator may have ended with it
                    at += 1
                    if rows:
                        yield pd.DataFrame([[x.get(n) for n in names] for x in rows], columns=names, dtype=object)

    return bounded(ranges).mapInPandas(run, out)


#: What a page's reading gives: its words and, for JPEG files, their errors after recompression.
PAGE_WORDS = T.StructType([*WORDS.fields, T.StructField("ela", T.DoubleType())])


def page_words(ranges: DataFrame, make: Callable[[], Pages], recognize: Callable[[], Callable[[np.ndarray], list[dict]]], recompress: Callable[[], Callable[[np.ndarray], np.ndarray]] | None = None) -> DataFrame:
    """The words relation of every page, with ``ela`` and ``error``.

    ``recompress`` is asked for JPEG files only, while the page's picture is at hand, so pictures
    and words need no join; ``ela`` is null for all others and for boxes under four pixels.
    """

    def reader():
        seen, again = recognize(), recompress() if recompress else None

        def read(page: dict, picture: np.ndarray) -> list[dict]:
            words = [{"word_no": n, **w} for n, w in enumerate(seen(picture))]
            if again and words and page["ext"] != "pdf" and image_format(page["content"]) == "JPEG":
                means = box_means(picture, again(picture), [(w["x"], w["y"], w["w"], w["h"]) for w in words])
                words = [{**w, "ela": m if w["w"] >= 4 and w["h"] >= 4 else None} for w, m in zip(words, means, strict=True)]
            return words

        return read

    return read_pages(ranges, make, reader, PAGE_WORDS)


def page_errors(read: DataFrame, name: str) -> DataFrame:
    """(doc_id, error) of the pages that failed."""
    where = F.when(F.col("page").isNotNull(), F.concat(F.lit("page "), F.col("page").cast("string"), F.lit(": "))).otherwise("")
    return read.where("error is not null").select("doc_id", F.concat(F.lit(f"{name}: "), where, "error").alias("error"))


def page_counts(ranges: DataFrame) -> DataFrame:
    """(doc_id, page) of every page."""
    return ranges.where("n_pages > 0 and first = 1").select("doc_id", F.explode(F.sequence(F.lit(1), "n_pages")).alias("page"))


def annotated_pages(files: DataFrame, make: Callable[[], Pages], boxes: DataFrame, size: int = RANGE) -> DataFrame:
    """(doc_id, page, name, content, error): the pages that have boxes, drawn, as PNG files. ``boxes``: as verdict.annotation_boxes gives them.

    Only files with boxes are opened again, and of these only the pages that have some. A page
    that fails is a row with its error and no content.
    """
    box = F.struct("flag_seq", "marker", "left", "top", "right", "bottom")
    by_page = boxes.groupBy("doc_id", "page", "annotated_file").agg(F.array_sort(F.collect_list(box)).alias("boxes"))
    wanted = by_page.select("doc_id", F.col("page").alias("first"), F.col("page").alias("last"), F.lit(None).cast("string").alias("error"), F.col("annotated_file").alias("name"), "boxes")
    ranges = files.select("doc_id", "ext", "content").join(wanted, "doc_id").repartition("doc_id", (F.col("first") / size).cast("int"))

    def reader():
        def draw(page: dict, picture: np.ndarray) -> list[dict]:
            return [{"name": page["name"], "content": annotated_png(picture, page["boxes"])}]

        return draw

    schema = T.StructType([T.StructField("name", T.StringType()), T.StructField("content", T.BinaryType())])
    return read_pages(ranges, make, reader, schema, ("name", "boxes"))
