"""April-to-March fiscal years."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fiscal_start_year(day: Column) -> Column:
    """Calendar year in which the fiscal year of ``day`` begins."""
    return F.year(F.add_months(day, -3))


def fiscal_year(day: Column) -> Column:
    """``FY25-26`` for any day from 2025-04-01 to 2026-03-31."""
    start = fiscal_start_year(day)
    return F.concat(
        F.lit("FY"), F.lpad((start % 100).cast("string"), 2, "0"),
        F.lit("-"), F.lpad(((start + 1) % 100).cast("string"), 2, "0"),
    )


def month_of(day: Column) -> Column:
    """First day of the month."""
    return F.trunc(day, "MM")
