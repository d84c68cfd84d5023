"""Column building blocks that several text operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = " \\t-\\r"          # the characters 0x20 and 0x09 to 0x0D inside a regular expression


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` with `value` computed once per row, however often `body` uses it."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """The runs of other than blank characters, in order; none for NULL."""
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\f\r"))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, f"[{BLANKS}]+"))
