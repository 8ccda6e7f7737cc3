"""Small helpers shared by the column functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it several times in ``body``.

    A one-element ``transform`` is the only way to name an intermediate value
    inside a single expression without a second projection.
    """
    return F.transform(F.array(value), body).getItem(0)


def characters(text: Column) -> Column:
    """Split a string into its code points."""
    return F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))


def code_point(number: Column) -> Column:
    """The character with the given code point, U+FFFD if there is none."""
    valid = number.between(1, 0xD7FF) | number.between(0xE000, 0x10FFFF)
    safe = F.when(valid, number).otherwise(F.lit(0xFFFD))
    return F.decode(F.unhex(F.lpad(F.hex(safe), 8, "0")), "UTF-32")


def text_of(body: Column) -> Column:
    """A body as text; bytes that are not UTF-8 become U+FFFD."""
    return F.make_valid_utf8(body.cast("string"))
