"""Ways to evaluate an expression once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, with ``value`` evaluated once inside the expression."""
    return F.transform(F.array(value), body)[0]


def once(df: DataFrame, **values: Column) -> DataFrame:
    """Add columns that later steps read as values instead of evaluating their formulas again.

    Plain columns are inlined into whatever uses them, and filters on them are pushed below them,
    formula and all; a generated row is where that stops.
    """
    row = F.struct(*[v.alias(k) for k, v in values.items()])
    return df.select("*", F.inline(F.array(row)))


def fixed(value: Column, decimals: int = 1) -> Column:
    """Text with a fixed number of decimals, rounded from the exact binary value."""
    return F.call_function("format_number", value, F.lit("0" + ("." + "0" * decimals if decimals else "")))
