"""Row and column filters by content or name, and the view that may be shared."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerspark.fixed_values import FINANCE_LIKE, FINANCE_ROW, SENSITIVE_COLUMN
from ledgerspark.functions.text import any_of, as_text, column, redact_text, string_columns, upper_like
from ledgerspark.operators.profile import bounded_sample


def filter_any_like(df: DataFrame, patterns: Iterable[str] = FINANCE_LIKE) -> DataFrame:
    """Rows in which any character column matches any pattern, blind to case; a table without such columns stays whole."""
    names = string_columns(df)
    if not names:
        return df
    return df.filter(any_of(upper_like(column(c), p) for c in names for p in patterns))


def first_rows(df: DataFrame, row_cap: int, order_by: Sequence[str]) -> DataFrame:
    """The first ``row_cap`` rows and, on each, ``truncated``: whether there are more."""
    head = bounded_sample(df, row_cap + 1, order_by=order_by)  # so few rows that the windows below are bounded
    order = W.orderBy(*[column(c).asc_nulls_last() for c in order_by])
    numbered = head.withColumns({"_at": F.row_number().over(order), "truncated": F.count(F.lit(1)).over(W.partitionBy()) > row_cap})
    return numbered.filter(F.col("_at") <= row_cap).drop("_at")


def evidence_list(df: DataFrame, patterns: Iterable[str] = FINANCE_LIKE, *, row_index: str, row_cap: int | None = None) -> DataFrame:
    """The matching rows. Only a cap that is passed shortens them, to the first by ``row_index``, and ``truncated`` says so."""
    found = filter_any_like(df, patterns)
    return found if row_cap is None else first_rows(found, row_cap, (row_index,))


def filter_any_regex(df: DataFrame, pattern: str = FINANCE_ROW) -> DataFrame:
    """Rows in which any cell, as text, contains the pattern, blind to case."""
    return df.filter(any_of(as_text(c).rlike(f"(?i){pattern}") for c in df.columns))


def filter_any_contains(df: DataFrame, token: str, *, row_index: str) -> DataFrame:
    """Rows in which any cell contains the token, blind to case; ``row_index`` identifies them."""
    searched = (c for c in df.columns if c != row_index)
    return df.filter(any_of(F.upper(as_text(c)).contains(token.upper()) for c in searched))


def sensitive_columns(columns: Iterable[str], pattern: str = SENSITIVE_COLUMN) -> list[str]:
    """Names that must not leave."""
    return [c for c in columns if re.search(pattern, c, re.IGNORECASE)]


def _is_nested(kind: T.DataType) -> bool:
    return isinstance(kind, (T.StructType, T.ArrayType, T.MapType))


def _rebuilt(value: Column, kind: T.DataType, keep, leaf) -> Column:
    """``value`` with the struct fields that ``keep`` names, at every depth, and ``leaf`` applied to texts."""
    if isinstance(kind, T.StructType):
        fields = [_rebuilt(value.getField(f.name), f.dataType, keep, leaf).alias(f.name) for f in kind.fields if keep(f.name)]
        return F.when(value.isNotNull(), F.struct(*fields)) if fields else F.lit(None).cast("string")
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: _rebuilt(x, kind.elementType, keep, leaf))
    if isinstance(kind, T.MapType):  # keys may name fields too
        kept = F.map_filter(value, lambda k, _: keep(k)) if isinstance(kind.keyType, T.StringType) else value
        done = F.transform_values(kept, lambda _, v: _rebuilt(v, kind.valueType, keep, leaf))
        return F.transform_keys(done, lambda k, _: leaf(k)) if isinstance(kind.keyType, T.StringType) else done
    return leaf(value) if isinstance(kind, T.StringType) else value


def _kept_by(pattern: str):
    """Test of a field name, or of a map key that is a column."""
    return lambda name: ~name.rlike(f"(?i){pattern}") if isinstance(name, Column) else not re.search(pattern, name, re.IGNORECASE)


def drop_sensitive_columns(df: DataFrame, pattern: str = SENSITIVE_COLUMN) -> DataFrame:
    """``df`` without sensitive columns, and nested columns without sensitive fields and map keys at any depth."""
    dropped = set(sensitive_columns(df.columns, pattern))
    kept = [f for f in df.schema.fields if f.name not in dropped]
    clean = lambda f: _rebuilt(column(f.name), f.dataType, _kept_by(pattern), lambda x: x).alias(f.name)
    return df.select(*[clean(f) if _is_nested(f.dataType) else column(f.name) for f in kept])


def shareable_view(
    df: DataFrame,
    whitelist: Sequence[str],
    *,
    row_pattern: str = FINANCE_ROW,
    secrets: Iterable[str] = (),
    row_cap: int | None = None,
    order_by: Sequence[str] = (),
) -> DataFrame:
    """Only named columns of relevant rows leave, without sensitive columns and with secrets masked.

    Relevance is judged on all cells, those of dropped columns included. Nested columns are cleaned at every depth.
    A row cap that is passed keeps the first rows by ``order_by``, which it therefore needs, and adds ``truncated``.
    """
    if row_cap is not None and not order_by:
        raise ValueError("a row cap needs an order")
    rows = filter_any_regex(df, row_pattern)
    flag = []
    if row_cap is not None:
        rows, flag = first_rows(rows, row_cap, order_by), ["truncated"]
    named = drop_sensitive_columns(rows.select(*[column(c) for c in whitelist], *flag))
    secrets = list(secrets)
    leaf = lambda x: redact_text(x, secrets)
    masked = {f.name: _rebuilt(column(f.name), f.dataType, lambda _: True if isinstance(_, str) else F.lit(True), leaf) for f in named.schema.fields}
    return named.withColumns({f.name: masked[f.name] for f in named.schema.fields if _is_nested(f.dataType) or isinstance(f.dataType, T.StringType)})
