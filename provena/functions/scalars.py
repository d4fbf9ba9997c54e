"""Text, number, date and box functions, Column in and Column out; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Editing tools whose mention in metadata is a finding.
EDIT_TOOLS = [
    "photoshop", "gimp", "canva", "illustrator", "paint", "pixlr", "snapseed", "picsart", "lightroom", "foxit phantom", "pdfescape", "sejda", "smallpdf",
    "ilovepdf", "pdf-xchange", "nitro", "acrobat pro", "inkscape", "affinity",
]
#: Months, date patterns by kind, labels of summary lines and rows that are no items.
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
DATES = {
    "dmy": r"\b(\d{1,2})[/\-\.](\d{1,2})[/\-\.](\d{2,4})\b",
    "ymd": r"\b(\d{4})[/\-\.](\d{1,2})[/\-\.](\d{1,2})\b",
    "dMy": rf"(?i)\b(\d{{1,2}})\s+({'|'.join(MONTHS)})[a-z]*\.?,?\s+(\d{{2,4}})\b",
}
NUMBER = r"[$₹€£]?\d[\d,.]*%?"
KEYWORD = r"(?i)\A(?:grand|total|sub-?total|gst|cgst|sgst|igst|vat|tax|discount|net|balance)\z"
NO_ITEM = r"(?i)phone|tel\b|mob|gstin|cin\b|@|pin\b|invoice\s*(no|date)|due\s*date|\bdate\b"
TRIMMED = ".,;:()[]|"
#: What a name of a font ends with beside its family.
STYLE = "bold|italic|oblique|black|semibold|demi|medium|light|regular|roman|mt|ps"


def full(c: Column, pattern: str) -> Column:
    """Whether the whole string matches."""
    return c.rlike(rf"\A(?:{pattern})\z")


def clean(c: Column) -> Column:
    """Without the punctuation around a token."""
    return F.btrim(c, F.lit(TRIMMED))


def is_numeric(c: Column) -> Column:
    """A number after clean(): a currency sign at most, digits with commas and dots, a per cent sign at most."""
    return F.coalesce(full(clean(c), NUMBER), F.lit(False))


def is_money(c: Column) -> Column:
    """A number with a comma or dot, of four characters at least."""
    t = clean(c)
    return is_numeric(c) & (F.contains(t, F.lit(",")) | F.contains(t, F.lit("."))) & (F.length(t) >= 4)


def to_number(c: Column) -> Column:
    """A double after commas are dropped; null where that's no number (currency signs and per cent stay unread)."""
    plain = F.replace(c, F.lit(","), F.lit(""))
    return F.when(plain.rlike(r"\A[+-]?(\d+\.?\d*|\.\d+)\z"), plain.try_cast("double"))


def word_box() -> Column:
    return F.array("x", "y", "w", "h").cast("array<int>")


def union_box(x: Column, y: Column, w: Column, h: Column) -> Column:
    """The box around a group's boxes; an aggregate."""
    return F.array(F.min(x), F.min(y), F.max(x + w) - F.min(x), F.max(y + h) - F.min(y)).cast("array<int>")


def scaled_corners(x0: Column, y0: Column, x1: Column, y1: Column, scale: Column) -> Column:
    """A box whose corners are scaled and cut to integers first, and then made width and height."""
    a, b, c, d = ((v * scale).cast("int") for v in (x0, y0, x1, y1))
    return F.array(a, b, c - a, d - b)


def scaled_extent(x0: Column, y0: Column, x1: Column, y1: Column, scale: Column) -> Column:
    """A box whose width and height are scaled themselves."""
    return F.array(*[(v * scale).cast("int") for v in (x0, y0, x1 - x0, y1 - y0)])


def font_family(c: Column) -> Column:
    """Lower-case family: no subset prefix, no trailing weights and styles."""
    name = F.regexp_replace(F.coalesce(c, F.lit("")), r"^[A-Z]{6}\+", "")
    # What no style starts with is passed over at once.
    return F.lower(F.regexp_replace(name, rf"(?i)(?=[-_, biosdmlrp])(?:[-_, ]?(?:{STYLE}))+\z", ""))


def alnum_count(c: Column) -> Column:
    """Letters and digits: what is left without all others. regexp_count() would make an array of them."""
    return F.length(F.regexp_replace(c, r"[^\p{L}\p{N}]+", ""))


def mentions_tool(c: Column) -> Column:
    return F.coalesce(F.lower(c).rlike("|".join(t.replace("-", r"\-") for t in EDIT_TOOLS)), F.lit(False))


def _timestamp(y: Column, mo: Column, d: Column, h: Column | None = None, mi: Column | None = None, s: Column | None = None) -> Column:
    zero = F.lit(0)
    return F.try_make_timestamp(y, mo, d, h if h is not None else zero, mi if mi is not None else zero, s if s is not None else zero)


def parse_pdf_date(c: Column) -> Column:
    """A timestamp of D:YYYY[MM[DD[HH[MM[SS]]]]]; the zone is ignored, an invalid date is null."""
    pattern = r"^D:(\d{4})(\d{2})?(\d{2})?(\d{2})?(\d{2})?(\d{2})?"
    part = lambda i, other: F.coalesce(F.nullif(F.regexp_extract(c, pattern, i), F.lit("")).cast("int"), F.lit(other))
    year = F.nullif(F.regexp_extract(c, pattern, 1), F.lit("")).cast("int")
    second = part(6, 0)
    made = _timestamp(year, part(2, 1), part(3, 1), part(4, 0), part(5, 0), second)
    return F.when((year >= 1) & (second <= 59), made)


def parse_date(kind: str, text: Column, swapped: bool = False) -> Column:
    """A date of a text that the kind's pattern matches; null if the calendar has no such day.

    Years under 100 count from 2000. ``swapped``: a day-first date that fails is tried month-first.
    """
    group = lambda i: F.regexp_extract(text, DATES[kind], i)
    if kind == "ymd":
        y, m, d = group(1).try_cast("int"), group(2).try_cast("int"), group(3).try_cast("int")
    else:
        d, y = group(1).try_cast("int"), group(3).try_cast("int")
        m = group(2).try_cast("int") if kind == "dmy" else F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.substring(group(2), 1, 3))).cast("int")
        y = F.when(y < 100, y + 2000).otherwise(y)
    made = F.when(y >= 1, _timestamp(y, m, d))
    if swapped and kind == "dmy":
        made = F.coalesce(made, F.when(y >= 1, _timestamp(y, d, m)))
    return made.cast("date")


def token_date(c: Column, swapped: bool = False) -> Column:
    """The date that a whole token is, day first or year first; null if it is none."""
    pick = lambda kind: F.when(full(c, DATES[kind]), parse_date(kind, c, swapped))
    return F.when(full(c, DATES["dmy"]), pick("dmy")).otherwise(pick("ymd"))


def looks_alike(c: Column) -> Column:
    """Letters that look like digits among at least as many digits."""
    # Most tokens have no such letter or no digit: digits are counted in the few that have both.
    digits = F.length(F.regexp_replace(c, r"\D+", ""))
    return full(c, r"(?=[\d,.]*[OolISBZ])(?=[OolISBZ,.]*\d)[\dOolISBZ,.]{3,}") & (digits * 2 >= F.length(c))


def bad_thousands(c: Column, numeric: Column | None = None) -> Column:
    """A number with commas that stand neither every three digits nor in the Indian manner. ``numeric``: is_numeric(c), where a query has it."""
    core = F.rtrim(F.ltrim(c, F.lit("$₹€£")), F.lit("%"))
    good = full(core, r"\d{1,3}(,\d{3})+(\.\d+)?") | full(core, r"\d{1,2}(,\d{2})+,\d{3}(\.\d+)?")
    return F.contains(c, F.lit(",")) & (is_numeric(c) if numeric is None else numeric) & (F.length(c) >= 5) & ~good


def decimals(c: Column, numeric: Column | None = None) -> Column:
    """Decimal places of a numeric token with a dot, else null. ``numeric``: is_numeric(c), where a query has it."""
    last = F.substring_index(F.rtrim(c, F.lit("%")), ".", -1)
    return F.when((is_numeric(c) if numeric is None else numeric) & F.contains(c, F.lit(".")), F.length(last))


def money_text(c: Column) -> Column:
    """Two decimals and thousands separators."""
    return F.format_number(c, 2)


def short_number(c: Column) -> Column:
    """Six significant digits, no trailing zeros."""
    pattern = lambda n: F.call_function("format_number", c, F.lit("0." + "#" * n if n else "0"))
    size = F.abs(c)
    out = F.regexp_replace(F.format_string("%.5e", c), r"\.?0*e", "e")
    for limit, n in ((1e6, 0), (1e5, 1), (1e4, 2), (1e3, 3), (1e2, 4), (1e1, 5)):
        out = F.when(size < limit, pattern(n)).otherwise(out)
    return out


def whole(c: Column) -> Column:
    """No decimals, halves to even."""
    return F.call_function("format_number", c, F.lit("0"))


def tenth(c: Column) -> Column:
    """One decimal."""
    return F.call_function("format_number", c, F.lit("0.0"))


def long_date(c: Column) -> Column:
    return F.date_format(c, "dd MMM yyyy")


def percent(c: Column) -> Column:
    """A share as per cent with two decimals."""
    return F.concat(F.call_function("format_number", c * 100, F.lit("0.00")), F.lit("%"))


def risk_percent(c: Column) -> Column:
    """As percent() for values up to 1; larger ones are taken as per cent already."""
    return F.when(c <= 1, percent(c)).otherwise(F.concat(F.call_function("format_number", c, F.lit("0.00")), F.lit("%")))


def clean_double(c: Column) -> Column:
    """Six decimals, halves to even."""
    return F.bround(c, 6)


def clean_value(c: Column, kind: T.DataType) -> Column:
    """A value of any type for display: doubles with six decimals, missing text empty, within structs, arrays and maps too."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return clean_double(c)
    if isinstance(kind, T.StringType):
        return F.coalesce(c, F.lit(""))
    if isinstance(kind, T.StructType):
        return F.when(c.isNotNull(), F.struct(*[clean_value(c[f.name], f.dataType).alias(f.name) for f in kind.fields]))
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: clean_value(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(c, lambda _, v: clean_value(v, kind.valueType))
    return c


def clean_row(df: DataFrame) -> DataFrame:
    """``df`` with every column cleaned, by its schema."""
    return df.select(*[clean_value(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields])
