"""Documents and photos as files: scans, what can be read of them without other libraries, and providers for the rest.

A file that can't be read becomes a row with ``error``; it never fails the job. Text recognition,
PDF text and image models are providers: callables that a worker makes once and then applies to
one file or tile at a time.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from provena.sources.pdf_info import information, text, value
from provena.sources.schemas import DEFAULT, EXIF, PDF_META
from provena.sources.shipping import ship

#: What uploads may be.
IMAGES = ("jpg", "jpeg", "png", "webp", "bmp", "tiff", "tif")
DOCUMENTS = (*IMAGES, "pdf")
#: EXIF tag numbers that the checks read.
EXIF_TAGS = {0x0131: "Software", 0x0132: "DateTime", 0x9003: "DateTimeOriginal"}


#: Bytes of an Arrow batch of file contents, unless the session sets its own bound; a longer file is a batch of its own.
BATCH_BYTES = 32 << 20


def bounded(df: DataFrame) -> DataFrame:
    """``df``, whose contents go to Python in batches bounded by bytes, not by rows alone."""
    spark, key = df.sparkSession, "spark.sql.execution.arrow.maxBytesPerBatch"
    if not getattr(spark, "_provena_bounded", False):
        spark.conf.set(key, str(BATCH_BYTES))
        spark._provena_bounded = True
    return df


def parsed_number(value) -> float:
    """A recognizer's confidence; -1 where it is no number."""
    try:
        return float(value)
    except (TypeError, ValueError):
        return -1.0


def extension(path: Column) -> Column:
    """Lower-case extension without its dot."""
    return F.lower(F.regexp_extract(path, r"\.([^./\\]*)$", 1))


def plain_path(path: Column) -> Column:
    """A path with one slash after its scheme, as sources differ in it."""
    return F.regexp_replace(path, r"^(\w+:)/+", "$1/")


def scan(spark: SparkSession, path: str, allowed: tuple[str, ...] = DOCUMENTS) -> DataFrame:
    """(doc_id, file, ext, length, content) of the allowed files below a path; doc_id is a hash of the path."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    df = df.withColumn("ext", extension(F.col("path"))).where(F.col("ext").isin(*allowed))
    return df.select(F.xxhash64("path").alias("doc_id"), F.col("path").alias("file"), "ext", "length", "content")


def scan_images(spark: SparkSession, path: str) -> DataFrame:
    """(image_id, image, width, height, mode, data) of pictures that the JVM decodes, rows from the top, BGR; broken ones are left out."""
    df = spark.read.format("image").option("dropInvalid", "true").option("ignoreCorruptFiles", "true").option("recursiveFileLookup", "true").load(path)
    return df.select(F.xxhash64("image.origin").alias("image_id"), F.col("image.origin").alias("image"), "image.width", "image.height", "image.nChannels", "image.mode", "image.data")


def upload_name(name: Column) -> Column:
    """Ten random hex digits, an underscore, and the name with nothing but letters, digits, dots, dashes and underscores."""
    return F.concat(F.substring(F.replace(F.uuid(), F.lit("-"), F.lit("")), 1, 10), F.lit("_"), F.regexp_replace(F.regexp_replace(name, r"[/\\\s]+", "_"), r"[^A-Za-z0-9_.-]", ""))


_PLAIN = {k: re.compile(rb"/" + k.encode() + rb"\s*\(((?:[^()\\]|\\.)*+)\)", re.S) for k in ("Producer", "Creator", "CreationDate", "ModDate")}


def pdf_facts(content: bytes) -> dict:
    """A PDF's row of the pdf_meta relation.

    ``info_read`` is true if the information dictionary was read, or found missing; null if it
    can't be read. Damaged files give the entries that they hold in plain sight; without any
    cross-reference these are taken for all.
    """
    info, known = (read := information(content)), b"startxref" not in content or read is not None
    if info is None and b"/Encrypt" not in content:
        info = {k: text(value(m[0], m[0].index(b"("))[0]) for k, p in _PLAIN.items() if (m := p.search(content))}
    entry = lambda k: (info or {}).get(k) or None
    return {
        "producer": entry("Producer"), "creator": entry("Creator"), "creation_date": entry("CreationDate"), "mod_date": entry("ModDate"),
        "eof_count": content.count(b"%%EOF"), "has_annot": re.search(rb"/Type\s*/Annot", content) is not None, "has_cover_annot": re.search(rb"/Subtype\s*/(?:Redact|FreeText|Square)", content) is not None,
        "info_read": True if known and info is not None else None,
    }


def pdf_meta(files: DataFrame) -> DataFrame:
    """The pdf_meta relation, with ``info_read``, from raw bytes: markers, annotations and the information dictionary."""
    ship(files.sparkSession)
    schema = T.StructType([*PDF_META.fields, T.StructField("info_read", T.BooleanType())])
    names = [f.name for f in schema.fields]

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [{"doc_id": i, **pdf_facts(bytes(c))} for i, c in zip(part["doc_id"], part["content"], strict=True)]
            yield pd.DataFrame([[r[n] for n in names] for r in rows], columns=names, dtype=object)

    return bounded(files.where("ext = 'pdf'").select("doc_id", "content")).mapInPandas(read, schema)


def image_format(content: bytes) -> str:
    """A picture's format by its first bytes; empty if unknown."""
    for head, name in ((b"\xff\xd8\xff", "JPEG"), (b"\x89PNG\r\n\x1a\n", "PNG"), (b"BM", "BMP"), (b"II*\0", "TIFF"), (b"MM\0*", "TIFF"), (b"GIF8", "GIF")):
        if content.startswith(head):
            return name
    return "WEBP" if content[:4] == b"RIFF" and content[8:12] == b"WEBP" else ""


def exif_tags(content: bytes) -> dict[str, str]:
    """Text tags of a JPEG's EXIF block, from its first directory and the one for photo data; damage ends the reading."""
    at, tags = 2, {}
    while at + 4 <= len(content) and content[at] == 0xFF and content[at + 1] != 0xDA:
        size = struct.unpack(">H", content[at + 2 : at + 4])[0]
        if content[at + 1] == 0xE1 and content[at + 4 : at + 10] == b"Exif\0\0":
            body = content[at + 10 : at + 2 + size]
            order = "<" if body[:2] == b"II" else ">"
            try:
                todo = [struct.unpack(order + "I", body[4:8])[0]]
                while todo:
                    start = todo.pop()
                    for i in range(struct.unpack(order + "H", body[start : start + 2])[0]):
                        tag, kind, n, value = struct.unpack(order + "HHI4s", body[start + 2 + 12 * i : start + 14 + 12 * i])
                        where = struct.unpack(order + "I", value)[0]
                        if tag == 0x8769 and where > start:
                            todo.append(where)
                        elif tag in EXIF_TAGS and kind == 2:
                            tags[EXIF_TAGS[tag]] = (value[:n] if n <= 4 else body[where : where + n]).rstrip(b"\0 ").decode("latin-1")
            except struct.error:
                pass
        at += 2 + size
    return tags


def exif(files: DataFrame) -> DataFrame:
    """The exif relation of picture files."""

    ship(files.sparkSession)

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [(i, image_format(bytes(c)), exif_tags(bytes(c)) or None) for i, c in zip(part["doc_id"], part["content"], strict=True)]
            yield pd.DataFrame(rows, columns=["doc_id", "format", "tags"])

    return bounded(files.where("ext <> 'pdf'").select("doc_id", "content")).mapInPandas(read, EXIF)


def provided(files: DataFrame, make: Callable[[], Callable[[str, bytes], list[dict]]], schema: T.StructType) -> DataFrame:
    """Rows that a provider makes of each file, with doc_id and ``error`` (null if none).

    ``make`` runs once in each worker and returns a callable of extension and content; a file for
    which it raises gives one row that holds the error only.
    """
    fields = T.StructType([*[f for f in schema.fields if f.name != "doc_id"], T.StructField("error", T.StringType())])
    out = T.StructType([T.StructField("doc_id", T.LongType()), *fields.fields])
    names = [f.name for f in out.fields]

    ship(files.sparkSession)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        work = make()
        for part in parts:
            for i, ext, content in zip(part["doc_id"], part["ext"], part["content"], strict=True):
                try:
                    rows = [{**r, "doc_id": i, "error": None} for r in work(ext, bytes(content))]
                except Exception as e:  # noqa: BLE001
                    rows = [{"doc_id": i, "error": f"{type(e).__name__}: {e}"}]
                if rows:
                    yield pd.DataFrame([[r.get(n) for n in names] for r in rows], columns=names, dtype=object)

    return bounded(files.select("doc_id", "ext", "content")).mapInPandas(run, out)


def parsed_confidence(text: Column) -> Column:
    """A recognizer's confidence; -1 where it is no number."""
    return F.coalesce(text.try_cast("double"), F.lit(-1.0))


def pdf_providers(dpi: int = DEFAULT.pdf_dpi) -> dict[str, Callable]:
    """Providers by relation that read PDFs with PyMuPDF, where that is installed on the workers."""
    scale = dpi / 72

    def opened(content: bytes):
        import fitz

        return fitz.open(stream=content, filetype="pdf")

    def spans():
        def read(ext: str, content: bytes) -> list[dict]:
            rows = []
            for p, page in enumerate(opened(content), 1):
                for b, block in enumerate(page.get_text("dict")["blocks"]):
                    for n, line in enumerate(block.get("lines", [])):
                        for s, span in enumerate(line["spans"]):
                            x0, y0, x1, y1 = span["bbox"]
                            rows.append({"page": p, "block_no": b, "line_no": n, "span_no": s, "text": span["text"], "font": span["font"], "size": float(span["size"]), "x0": x0, "y0": y0, "x1": x1, "y1": y1, "scale": scale})
            return rows

        return read

    def layer():
        def read(ext: str, content: bytes) -> list[dict]:
            return [{"page": p, "word_no": i, "x0": w[0], "y0": w[1], "x1": w[2], "y1": w[3], "text": w[4], "scale": scale} for p, page in enumerate(opened(content), 1) for i, w in enumerate(page.get_text("words"))]

        return read

    def fonts():
        def read(ext: str, content: bytes) -> list[dict]:
            return [{"page": p, "font_name": str(f[3])} for p, page in enumerate(opened(content), 1) for f in page.get_fonts()]

        return read

    return {"spans": spans, "layer_words": layer, "page_fonts": fonts}


def word_provider(command: str | None = None) -> Callable:
    """A provider of the words relation with pytesseract on single pictures, where that is installed on the workers."""

    def make():
        import io

        import pytesseract
        from PIL import Image

        if command:
            pytesseract.pytesseract.tesseract_cmd = command

        def read(ext: str, content: bytes) -> list[dict]:
            d = pytesseract.image_to_data(Image.open(io.BytesIO(content)), output_type=pytesseract.Output.DICT)
            rows = []
            for i, text in enumerate(d["text"]):
                if text.strip():
                    rows.append({"page": 1, "word_no": i, "text": text.strip(), "conf": parsed_number(d["conf"][i]), "x": int(d["left"][i]), "y": int(d["top"][i]), "w": int(d["width"][i]), "h": int(d["height"][i])})
            return rows

        return read

    return make
