"""Open items of creditors or debtors: payments settle the oldest charges first, what is left over is an advance."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerspark.functions.ageing import age_bucket, age_days
from ledgerspark.functions.money import total_type
from ledgerspark.functions.text import column


def settle(rows: DataFrame, *, by: Sequence[str], day: str, charge: str = "debit", payment: str = "credit") -> DataFrame:
    """Per party and day: ``charge``, ``open`` (what payments have not settled of it) and ``paid`` (all payments of the party).

    A negative charge counts as a payment, a negative payment as a charge, so both are sums of amounts of one sign and
    ``sum(charge) - paid`` is the balance. Charges without a day are settled last. Parties that are NULL are one party.

    Charges of one day are settled alike, so they are summed first: before the shuffle, and to one row a day. The running
    sum of a party is thus bounded by the calendar, however many rows the party has. Amounts stay exact.
    """
    kind = max((total_type(rows.schema[c].dataType) for c in (charge, payment)), key=lambda t: t.scale)
    zero = F.lit(0).cast(kind)

    def part(positive: str, negative: str) -> Column:
        plus, minus = (F.coalesce(column(c).cast(kind), zero) for c in (positive, negative))
        return F.sum(F.greatest(plus, zero) + F.greatest(-minus, zero)).cast(kind)

    daily = rows.groupBy(*[column(c) for c in by], column(day).cast("date").alias("day")).agg(
        part(charge, payment).alias("charge"), part(payment, charge).alias("_paid")
    )
    party = W.partitionBy(*[column(c) for c in by])
    upto = party.orderBy(F.col("day").asc_nulls_last()).rowsBetween(W.unboundedPreceding, W.currentRow)
    return (
        daily.withColumns({"_upto": F.sum("charge").over(upto), "paid": F.sum("_paid").over(party).cast(kind)})
        .withColumn("open", F.greatest(zero, F.least(F.col("charge"), F.col("_upto") - F.col("paid"))).cast(kind))
        .select(*[column(c) for c in by], "day", "charge", "open", "paid")
    )


def open_items(settled: DataFrame, as_of: date, *, by: Sequence[str]) -> DataFrame:
    """Open amount per party and ageing bucket, where it is not 0; without a day there is no bucket."""
    aged = settled.withColumn("age_bucket", age_bucket(age_days(F.col("day"), F.lit(as_of))))
    kind = settled.schema["open"].dataType
    return aged.groupBy(*[column(c) for c in by], "age_bucket").agg(F.sum("open").cast(kind).alias("open")).filter("open <> 0")


def advances(settled: DataFrame, *, by: Sequence[str]) -> DataFrame:
    """Payments beyond all charges, per party; 0 where there are none."""
    kind = settled.schema["paid"].dataType
    left = F.greatest(F.max("paid") - F.sum("charge"), F.lit(0)).cast(kind)
    return settled.groupBy(*[column(c) for c in by]).agg(left.alias("advance"))


def outstanding_totals(rows: DataFrame, as_of: date, *, party: str, day: str, charge: str = "debit", payment: str = "credit") -> DataFrame:
    """Checks of a reconciliation: ``check_name, scope, value``.

    ``outstanding`` for the company, each vendor and each ageing bucket, ``advances`` for the company and each vendor. Scopes are named
    ``vendor:value``, ``vendor~`` for NULL, and ``age:bucket``.
    """
    settled = settle(rows, by=[party], day=day, charge=charge, payment=payment)
    kind = settled.schema["open"].dataType
    vendor = F.coalesce(F.concat(F.lit("vendor:"), column(party).cast("string")), F.lit("vendor~"))
    bucket = F.coalesce(F.concat(F.lit("age:"), age_bucket(age_days(F.col("day"), F.lit(as_of)))), F.lit("age~"))
    small = settled.groupBy(vendor.alias("vendor"), bucket.alias("age")).agg(F.sum("open").alias("open"))
    sums = small.groupingSets([[], [F.col("vendor")], [F.col("age")]], F.col("vendor"), F.col("age")).agg(F.sum("open").cast(kind).alias("value"))
    open_ = sums.select(F.lit("outstanding").alias("check_name"), F.coalesce("vendor", "age", F.lit("company")).alias("scope"), "value")
    paid = advances(settled, by=[party]).select(vendor.alias("vendor"), "advance")
    ahead = paid.groupingSets([[], [F.col("vendor")]], F.col("vendor")).agg(F.sum("advance").cast(kind).alias("value"))
    return open_.unionByName(ahead.select(F.lit("advances").alias("check_name"), F.coalesce("vendor", F.lit("company")).alias("scope"), "value"))
