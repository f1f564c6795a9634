"""Text helpers with the JavaScript semantics the audited results depend on."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# JavaScript's String.prototype.trim strips all of these (Spark's trim only spaces).
JS_SPACE = r"[\s\u00A0\uFEFF\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"


def js_trim(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{JS_SPACE}+|{JS_SPACE}+\z", "")


def line_count(c: Column) -> Column:
    """Pieces after splitting on LF: empty text is 1 line, a trailing LF adds one."""
    return (F.octet_length(c) - F.octet_length(F.replace(c, F.lit("\n"), F.lit(""))) + 1).cast("int")


def utf16_length(c: Column) -> Column:
    """Length in UTF-16 code units (JavaScript's ``length``)."""
    return (F.octet_length(F.encode(c, "UTF-16BE")) / 2).cast("int")


def kib(bytes_col: Column) -> Column:
    """Size in KiB with one decimal, as text (half-up on exact ties)."""
    return F.format_string("%.1f", F.round(bytes_col / 1024.0, 1))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def dirname(path: Column) -> Column:
    """Directory part of a relative path; '' for a file at the root."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)
