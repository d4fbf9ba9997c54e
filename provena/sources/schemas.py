"""Relations that the checks read and the one that they write, and their thresholds."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

_WORD = [("text", T.StringType()), ("conf", T.DoubleType()), ("x", T.IntegerType()), ("y", T.IntegerType()), ("w", T.IntegerType()), ("h", T.IntegerType())]
_KEY = [("doc_id", T.LongType()), ("page", T.IntegerType())]


def _schema(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields])


WORDS = _schema(*_KEY, ("word_no", T.IntegerType()), *_WORD)
SPANS = _schema(
    *_KEY, ("block_no", T.IntegerType()), ("line_no", T.IntegerType()), ("span_no", T.IntegerType()), ("text", T.StringType()), ("font", T.StringType()),
    ("size", T.DoubleType()), ("x0", T.DoubleType()), ("y0", T.DoubleType()), ("x1", T.DoubleType()), ("y1", T.DoubleType()), ("scale", T.DoubleType()),
)
PAGE_FONTS = _schema(*_KEY, ("font_name", T.StringType()))
LAYER_WORDS = _schema(*_KEY, ("word_no", T.IntegerType()), ("x0", T.DoubleType()), ("y0", T.DoubleType()), ("x1", T.DoubleType()), ("y1", T.DoubleType()), ("text", T.StringType()), ("scale", T.DoubleType()))
PDF_META = _schema(
    ("doc_id", T.LongType()), ("producer", T.StringType()), ("creator", T.StringType()), ("creation_date", T.StringType()), ("mod_date", T.StringType()),
    ("eof_count", T.IntegerType()), ("has_annot", T.BooleanType()), ("has_cover_annot", T.BooleanType()),
)
EXIF = _schema(("doc_id", T.LongType()), ("format", T.StringType()), ("tags", T.MapType(T.StringType(), T.StringType())))
ELA_SCORES = _schema(*_KEY, ("word_no", T.IntegerType()), *_WORD, ("ela", T.DoubleType()))
TILE_SCORES = _schema(("image_id", T.LongType()), ("x", T.IntegerType()), ("y", T.IntegerType()), ("score", T.DoubleType()))
FLAGS = _schema(
    *_KEY, ("step", T.IntegerType()), ("k1", T.LongType()), ("k2", T.LongType()), ("k3", T.LongType()), ("field", T.StringType()), ("reason", T.StringType()),
    ("severity", T.StringType()), ("check", T.StringType()), ("bbox", T.ArrayType(T.IntegerType())), ("marker", T.StringType()),
)

#: The weight of each severity.
SEVERITY_WEIGHT = {"low": 1, "medium": 3, "high": 6}

#: Order in which the checks write their findings within a document and a page.
STEPS = {
    "metadata": 0, "split_font": 10, "rare_number_font": 11, "rare_text_font": 12, "font_context": 13, "font_count": 14, "hidden_text": 20, "overlay_text": 21,
    "ela": 25, "height": 30, "low_confidence": 31, "line_rules": 40, "decimals": 41, "mixed_dates": 42, "row_arithmetic": 50, "subtotal": 51, "tax": 52,
    "total": 53, "due_date": 60,
}


@dataclass(frozen=True)
class Thresholds:
    """Fixed values of the checks, in one place."""

    pdf_dpi: int = 200
    rare_share: float = 0.15
    size_gap: float = 0.5
    min_numeric_spans: int = 5
    min_page_chars: int = 40
    dominant_share: float = 0.5
    max_fonts: int = 6
    saved_after_s: int = 60
    layer_conf: float = 70.0
    low_conf: float = 40.0
    min_heights: int = 8
    height_z: float = 4.0
    height_deviation: float = 0.35
    min_ela_words: int = 8
    ela_z: float = 5.0
    ela_ratio: float = 2.5
    row_tolerance: float = 0.02
    sum_tolerance: float = 1.0
    terms_days: int = 2
    oldest_year: int = 1990
    min_decimals: int = 4
    score_tampered: int = 12
    line_overlap: float = 0.6


@dataclass(frozen=True)
class PhotoThresholds:
    """Fixed values of the photo checks."""

    tile: int = 224
    overlap: float = 0.25
    batch: int = 16
    suspicious: float = 0.80
    fake: float = 0.95
    manipulated: float = 0.75
    review: float = 0.50
    top_share: float = 0.10


DEFAULT, PHOTO = Thresholds(), PhotoThresholds()
