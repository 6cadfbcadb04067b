"""Functions on text: normal forms, escapes, names, display."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType


def normalize_text(text: Column) -> Column:
    """Line ends of all kinds become line feeds, and null characters go; offsets refer to the result."""
    return F.translate(F.regexp_replace(text, "\r\n", "\n"), "\r\u2028\u2029\x00", "\n\n\n")


def decode_utf8(content: Column) -> Column:
    """Strict: null if the bytes are no UTF-8; a byte order mark is dropped."""
    return F.when(F.is_valid_utf8(content.cast("string")), F.regexp_replace(F.decode(content, "UTF-8"), "^\ufeff", ""))


def is_blank(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"(?U)\s+", "")) == 0


def compact(text: Column) -> Column:
    """Without underscores and white space, in lower case."""
    return F.lower(F.regexp_replace(text, r"[_\s]+", ""))


def stated(value: Column, text: Column, is_date: Column | None = None) -> Column:
    """Whether the text states the value; of a date the year will do."""
    plain = F.contains(compact(text), compact(value))
    return plain if is_date is None else F.when(is_date, F.contains(text, F.substring(value, 1, 4))).otherwise(plain)


def relation_name(text: Column) -> Column:
    return F.replace(F.trim(text), F.lit(" "), F.lit("_"))


def without_day_zero(text: Column) -> Column:
    """00 Month YYYY is read as the first of the month."""
    return F.regexp_replace(text, r"\b00 ([A-Za-z]+ \d{4})", "01 $1")


def _words(text: Column) -> Column:
    return F.filter(F.split(text, "[^A-Za-z0-9]+"), lambda w: w != "")


def pascal_case(text: Column) -> Column:
    name = F.array_join(F.transform(_words(text), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))), "")
    return F.substring(F.when(name.rlike("^[0-9]"), F.concat(F.lit("X"), name)).otherwise(name), 1, 64)


def snake_case(text: Column) -> Column:
    name = F.lower(F.array_join(_words(text), "_"))
    return F.substring(F.when(name.rlike("^[0-9]"), F.concat(F.lit("x_"), name)).otherwise(name), 1, 64)


def file_stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)


MOJIBAKE = "Ã[\u0080-¿]|Â[\u0080-¿]|â€"


def has_mojibake(text: Column) -> Column:
    return text.rlike(MOJIBAKE)


def repair_encoding(text: Column) -> Column:
    """Undoes UTF-8 that was read as Latin-1, where that gives valid UTF-8."""
    latin = text.rlike(r"^[\x00-\xff]*$") & text.rlike("[\u0080-ÿ]")
    back = F.encode(F.when(latin, text), "ISO-8859-1")
    return F.coalesce(F.when(F.is_valid_utf8(back.cast("string")), F.decode(back, "UTF-8")), text)


def escape(text: Column) -> Column:
    """Backslash, line feed, carriage return and tab by letter, other control characters as backslash u and four digits."""
    out = text
    for raw, letter in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        out = F.replace(out, F.lit(raw), F.lit(letter))
    for code in [*range(0, 9), 11, 12, *range(14, 32), 127]:
        out = F.replace(out, F.lit(chr(code)), F.lit(f"\\u{code:04x}"))
    # the long chain runs only where there is something to do
    return F.when(text.rlike(r"[\x00-\x1f\x7f\\]"), out).otherwise(text)


_ESCAPE = re.compile(r"\\(?:u([0-9a-fA-F]{4})|(.))", re.S)
_LETTERS = {"n": "\n", "r": "\r", "t": "\t", "\\": "\\"}


def unescape_text(text: str) -> str:
    return _ESCAPE.sub(lambda m: chr(int(m[1], 16)) if m[1] else _LETTERS.get(m[2], m[0]), text)


@pandas_udf(StringType())
def unescape(text: pd.Series) -> pd.Series:
    """The inverse of escape; what is no escape stays."""
    return text.map(unescape_text, na_action="ignore")


def format_duration(ms: Column) -> Column:
    s = F.floor(ms / 1000)
    return (
        F.when(ms < 1000, F.format_string("%d ms", ms.cast("long")))
        .when(s < 60, F.format_string("%.1f s", ms / 1000))
        .when(s < 3600, F.format_string("%d m %02d s", F.floor(s / 60), s % 60))
        .when(s >= 3600, F.format_string("%d h %02d m", F.floor(s / 3600), F.floor(s / 60) % 60))
    )


def format_size(size: Column, units: tuple[str, ...] = ("KB", "MB", "GB")) -> Column:
    """In the largest of the units that keeps it at least 1; what is beyond the last one stays in it."""
    out = F.when(size.isNotNull(), F.format_string("%d B", size.cast("long")))
    for power, unit in enumerate(units, 1):
        out = F.when(size >= 1024**power, F.format_string(f"%.1f {unit}", size / 1024**power)).otherwise(out)
    return out


def format_count(n: Column, units: tuple[str, ...] = ("M", "B")) -> Column:
    """In full below a million, then in the largest of the units that keeps it at least 1; what is beyond the last one stays in it."""
    out = n.cast("long").cast("string")
    for power, unit in enumerate(units, 2):
        out = F.when(n >= 1000**power, F.format_string(f"%.1f{unit}", n / 1000**power)).otherwise(out)
    return out


def joined(values: Column) -> Column:
    return F.concat_ws(";", values)


def split_values(text: Column) -> Column:
    """The trimmed parts of a value of several, without empty ones."""
    return F.filter(F.transform(F.split(text, ";"), lambda x: F.trim(x)), lambda x: x != "")


def strip_code_fence(text: Column) -> Column:
    inner = F.regexp_extract(text, r"(?s)^\s*```[A-Za-z]*[ \t]*\n(.*?)\n?\s*```\s*$", 1)
    return F.when(text.rlike(r"(?s)^\s*```[A-Za-z]*[ \t]*\n.*```\s*$"), inner).otherwise(text)


def float_text(value: Column) -> Column:
    """The shortest text that reads back as the value, with exponents as Python writes them."""
    return _float_text(value)


@pandas_udf(StringType())
def _float_text(value: pd.Series) -> pd.Series:
    return value.map(lambda x: repr(float(x)), na_action="ignore")
