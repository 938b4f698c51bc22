"""Ageing of open items."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerspark.fixed_values import AGE_BUCKETS
from ledgerspark.functions.money import total_type
from ledgerspark.functions.ageing import age_bucket, age_days


def age_summary(items: DataFrame, as_of: date, *, basis: str, amount: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Amount per ageing bucket, all seven buckets present, optionally per group.

    Seven conditional sums in one aggregation, then one row per bucket: no bucket table to join, and
    a group of any size is summed before the shuffle.
    """
    kind = total_type(items.schema[amount].dataType)
    aged = items.select(
        *by,
        age_bucket(age_days(F.col(basis).cast("date"), F.lit(as_of))).alias("_bucket"),
        F.col(amount).alias("_amount"),
    )
    sums = aged.groupBy(*by).agg(
        *[F.sum(F.when(F.col("_bucket") == b, F.col("_amount"))).alias(f"_{i}") for i, b in enumerate(AGE_BUCKETS)]
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(b).alias("age_bucket"),
                F.coalesce(F.col(f"_{i}").cast(kind), F.lit(0).cast(kind)).alias("amount"),
            )
            for i, b in enumerate(AGE_BUCKETS)
        ]
    )
    return sums.select(*by, F.inline(rows))


def ageing_violations(items: DataFrame, *, basis: str, amount: str) -> DataFrame:
    """Items that cannot be aged: no basis date or no amount."""
    return items.filter(F.col(basis).isNull() | F.col(amount).isNull())
