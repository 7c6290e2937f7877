"""String rules with browser semantics, as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Whitespace and line terminators of the scripting standard, as a regex
# class that both Java and RE2 read.
WS = r"\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
EDGE_WS = rf"^[{WS}]+|[{WS}]+\z"
EMAIL = rf"^[^@{WS}]+@[^@{WS}]+\.[^@{WS}]+\z"
LINE_END = r"[\n\r\x{2028}\x{2029}]"
LEAST_LENGTH = 8


def text(c: Column) -> Column:
    """A null value is the empty text."""
    return F.coalesce(c, F.lit(""))


def js_trim(c: Column) -> Column:
    """Unicode whitespace and line terminators off both ends."""
    return F.regexp_replace(text(c), EDGE_WS, "")


def is_blank(c: Column) -> Column:
    return js_trim(c) == ""


def is_empty(c: Column) -> Column:
    return text(c) == ""


def u16_length(c: Column) -> Column:
    """Length in UTF-16 code units."""
    return (F.octet_length(F.encode(text(c), "UTF-16BE")) / 2).cast("int")


def is_email(c: Column) -> Column:
    """Something, an at sign, something, a dot, something; to be used on trimmed text."""
    return text(c).rlike(EMAIL)


def is_strong_password(c: Column) -> Column:
    """Eight units or more, an ASCII letter, an ASCII digit and no line end."""
    return (u16_length(c) >= LEAST_LENGTH) & text(c).rlike("[A-Za-z]") & text(c).rlike("[0-9]") & ~text(c).rlike(LINE_END)
