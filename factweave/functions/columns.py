"""Small column helpers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once per row, however often body uses it."""
    return F.element_at(F.transform(F.array(value), lambda v: body(v)), 1)


def pin(df: DataFrame, **cols: Column) -> DataFrame:
    """Adds columns that later steps read without computing them again.

    The optimizer copies an expression into every filter and lambda that reads it. Columns that come out of a
    generator stay plain attributes, so costly nested expressions run once per row.
    """
    keep = [c for c in df.columns if c not in cols]
    return df.select(*keep, F.inline(F.array(F.struct(*[e.alias(n) for n, e in cols.items()]))))


def shuffled(df: DataFrame) -> DataFrame:
    """The same rows, joined by sorting both sides.

    Spark takes rows that come out of a generator for as small as what went in, and would broadcast them through the driver.
    """
    return df.hint("merge")
