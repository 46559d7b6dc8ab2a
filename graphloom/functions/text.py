"""Scalar text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(c: Column) -> Column:
    """Without white space of any kind at either end (SQL's trim knows only U+0020)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def clean_text(c: Column, drop_spaces: bool = True) -> Column:
    """LF line ends, no numbered citations such as [1] or [1,2-4], no blanks, tabs or ideographic spaces."""
    c = F.regexp_replace(F.regexp_replace(c, r"\r\n?", "\n"), r"\[\d+(?:[-,，]\d+)*\]", "")
    return F.regexp_replace(c, r"[ \t　]+", "") if drop_spaces else c


def is_pure_number(c: Column) -> Column:
    return (c == "") | F.regexp_replace(c, r"[.%\-]", "").rlike(r"(?U)^\d+$")


def not_null(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def strip_chars(c: Column, chars: str) -> Column:
    """Without any of chars at either end."""
    return F.btrim(c, F.lit(chars)) if chars else c


def score_of(c: Column) -> Column:
    """Text to score; 1.0 where it isn't a number."""
    return F.coalesce(c.try_cast("double"), F.lit(1.0))
