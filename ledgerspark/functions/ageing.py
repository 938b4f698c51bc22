"""Age in days and ageing buckets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerspark.fixed_values import AGE_EDGES, NOT_DUE, OLDEST


def age_days(basis: Column, as_of: Column) -> Column:
    return F.datediff(as_of, basis)


def age_bucket(days: Column) -> Column:
    """Bucket label of an age in days; an unknown age has no bucket."""
    label = F.when(days.isNull(), F.lit(None).cast("string")).when(days < 0, NOT_DUE)
    for last_day, name in AGE_EDGES:
        label = label.when(days <= last_day, name)
    return label.otherwise(OLDEST)
