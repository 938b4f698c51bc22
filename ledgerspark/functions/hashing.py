"""Canonical text of a row and its SHA-256."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


TEXTUAL = (T.DecimalType, T.DateType, T.TimestampNTZType)


def _marked_value(name: str, kind: T.DataType) -> list[Column]:
    """Name with its mark (``=`` text, ``#`` whole number or flag, ``@`` instant, ``~`` NULL), then the value."""
    value = F.col(f"`{name}`")
    mark, text = "=", value.cast("string")
    if isinstance(kind, T.StringType):
        # No value can imitate a separator.
        text = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|"))
    elif isinstance(kind, (T.IntegralType, T.BooleanType)):
        mark = "#"
    elif isinstance(kind, T.TimestampType):
        mark, text = "@", F.unix_micros(value).cast("string")  # the instant, whatever the session's time zone
    elif isinstance(kind, (T.FloatType, T.DoubleType)):
        raise TypeError(f"column {name!r} is a float; cast it to a decimal before hashing")
    elif not isinstance(kind, TEXTUAL):
        raise TypeError(f"column {name!r} of type {kind.simpleString()} cannot be hashed")
    head = F.when(value.isNull(), F.lit(f"|{name}~")).otherwise(F.lit(f"|{name}{mark}"))
    return [head, F.coalesce(text, F.lit(""))]


def canonical_text(df: DataFrame, columns: Iterable[str]) -> Column:
    """``|name=value`` for each column in name order; NULL is ``|name~``."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    return F.concat(*[piece for c in sorted(columns) for piece in _marked_value(c, kinds[c])])


def row_hash(df: DataFrame, columns: Iterable[str]) -> Column:
    """SHA-256 of the canonical text: blind to column order, sensitive to every value."""
    return F.sha2(canonical_text(df, columns), 256)


def hash_bytes(value: Column) -> Column:
    """A hash as its 32 bytes, half of its text. Any other text keeps its own bytes behind a mark, so different texts stay different."""
    raw = F.unhex(value)
    return F.when((F.length(value) == 64) & (F.lower(F.hex(raw)) == value), raw).otherwise(F.encode(F.concat(F.lit("="), value), "UTF-8"))
