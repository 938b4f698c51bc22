"""Text helpers: cells, patterns, redaction."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerspark.fixed_values import MASK, MIN_SECRET_LENGTH, SECRET_ASSIGNMENT

BLANKS = " \t\n\r\f\v"


def column(name: str) -> Column:
    """Column by its exact name, also if the name holds dots, ``$`` or spaces."""
    return F.col(f"`{name.replace('`', '``')}`")


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def as_text(name: str) -> Column:
    return column(name).cast("string")


def normalise_cell(value: Column) -> Column:
    """Trimmed upper-case text; blank becomes NULL."""
    return F.nullif(F.upper(F.trim(value.cast("string"), F.lit(BLANKS))), F.lit(""))


def upper_like(value: Column, pattern: str) -> Column:
    """``upper(value) LIKE pattern``; ``_`` and ``%`` are wildcards."""
    return F.upper(value).like(pattern)


def any_of(conditions: Iterable[Column]) -> Column:
    """OR of the conditions, false if there is none; an unknown condition counts as false."""
    return reduce(lambda a, b: a | b, (F.coalesce(c, F.lit(False)) for c in conditions), F.lit(False))


def trim_char(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """Trim fixed-width character columns (all string columns by default) on load."""
    names = list(columns) if columns is not None else string_columns(df)
    return df.withColumns({c: F.trim(column(c)) for c in names}) if names else df


def redact_text(value: Column, secrets: Iterable[str] = ()) -> Column:
    """Mask the literal secrets, longest first, then the value of ``password=``, ``pwd=`` and ``uid=``."""
    usable = sorted({s for s in secrets if len(s) >= MIN_SECRET_LENGTH}, key=lambda s: (-len(s), s))
    for secret in usable:
        value = F.replace(value, F.lit(secret), F.lit(MASK))
    return F.regexp_replace(value, f"(?i){SECRET_ASSIGNMENT}", f"$1={MASK}")
