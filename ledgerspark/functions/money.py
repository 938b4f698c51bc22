"""Exact money arithmetic: nothing is rounded on the way to a sum or a difference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerspark.fixed_values import MONEY, TOTAL

CENTS = T.DecimalType(20, 2)


def money(value: Column) -> Column:
    """Two-decimal amount, rounded: for values that are taken in, never for sums or comparisons."""
    return value.cast(MONEY)


def amount_scale(kind: T.DataType) -> int:
    """Decimals that sums of a column keep, 2 at least. Floats and texts are refused."""
    if isinstance(kind, T.DecimalType):
        return max(2, kind.scale)
    if isinstance(kind, (T.IntegralType, T.NullType)):
        return 2
    raise TypeError(f"amounts of type {kind.simpleString()} have no exact sum; cast them to a decimal first")


def total_type(kind: T.DataType) -> T.DecimalType:
    """Type of the sum of a column: two decimals, or as many as the column has."""
    scale = amount_scale(kind)
    return T.DecimalType(24, 2) if scale == 2 else T.DecimalType(38, scale)


def total_of(df: DataFrame, name: str) -> Column:
    """Exact sum of a column at the column's own scale; NULL over no rows."""
    kind = df.schema[name].dataType
    value = F.col(f"`{name}`")
    return F.sum(value.cast(CENTS) if amount_scale(kind) == 2 else value).cast(total_type(kind))


def total(value: Column) -> Column:
    """Sum as ``decimal(24,2)``; an amount with more decimals fails the query instead of being rounded."""
    cents = value.cast(MONEY)
    exact = F.when(value.isNull() | (value == cents), cents).otherwise(F.raise_error(F.lit("an amount has more than two decimals")))
    return F.sum(exact).cast(TOTAL)


def variance(minuend: Column, subtrahend: Column) -> Column:
    """Exact difference of two totals, at the wider of their scales."""
    return minuend - subtrahend
