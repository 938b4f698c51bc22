"""Source-row identity: where a row physically came from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerspark import schemas
from ledgerspark.fixed_values import IDENTITY, IDENTITY_KEY, SCOPE, SCOPE_IN_ENTRY
from ledgerspark.functions.text import BLANKS
from ledgerspark.operators.coverage import BROADCAST_ROWS, resolve_as_of
from ledgerspark.operators.registry import UnresolvedSource, confirmed_only, is_confirmed, registry_key, require_physical

REQUIRED = tuple(c for c in IDENTITY if "discriminator" not in c)


def entry_scope(source_system: str) -> list[Column]:
    """The scope columns of registry entries. Without a discriminator its two columns are empty; all others stay NULL if missing."""
    unused = F.lit("")
    columns = {name: F.col(path) for name, path in SCOPE_IN_ENTRY}
    columns |= {name: F.coalesce(c, unused) for name, c in columns.items() if name not in REQUIRED}
    columns["source_system"] = F.lit(source_system)
    return [columns[name].alias(name) for name in SCOPE]


def scope_of(entry: Row, source_system: str) -> dict[str, str]:
    """The scope values of a confirmed registry entry; one that lacks an owner, object or copy is refused."""
    physical = require_physical(entry).asDict()
    one = SparkSession.active().createDataFrame(
        [(entry.copy_id, [physical.get(f) for f in schemas.PHYSICAL.names])], T.StructType().add("copy_id", "string").add("physical", schemas.PHYSICAL)
    )
    values = one.select(*entry_scope(source_system)).head().asDict()
    missing = [name for name, value in values.items() if value is None]
    if missing:
        raise UnresolvedSource(f"{entry.source_type} copy {entry.copy_id}: no {', '.join(missing)}")
    return values


def with_identity(rows: DataFrame, entry: Row, row_key: Column, source_system: str) -> DataFrame:
    """Add the identity of one source; the row key becomes text."""
    constants = {name: F.lit(value) for name, value in scope_of(entry, source_system).items()}
    return rows.withColumns({**constants, "source_row_key": row_key.cast("string")})


def with_identity_from_registry(
    rows: DataFrame, registry: DataFrame, row_key: Column, source_system: str, *, on: str = "source_registry_key", strict: bool = False
) -> DataFrame:
    """Add the identity of many sources at once.

    Every row stays: ``unresolved`` tells why one has no identity (``NO_SOURCE``: no registry key, ``NOT_CONFIRMED``: its entry has
    no confirmed physical object) and is NULL for the others. ``strict`` fails the job at the first such row instead.
    The join carries no hint: Spark broadcasts the registry when its size allows.
    """
    scopes = confirmed_only(registry).select(registry_key().alias(on), *entry_scope(source_system))
    out = rows.withColumn("source_row_key", row_key.cast("string")).join(scopes, on, "left")
    reason = F.when(F.col(on).isNull(), "NO_SOURCE").when(F.col("source_owner").isNull(), "NOT_CONFIRMED")
    if strict:
        reason = F.when(reason.isNotNull(), F.raise_error(F.concat(reason, F.lit(" for row "), F.coalesce("source_row_key", F.lit("NULL")))))
    return out.withColumn("unresolved", reason.cast("string"))


def with_identity_as_of(
    rows: DataFrame,
    registry: DataFrame,
    row_key: Column,
    source_system: str,
    *,
    type_col: str | Column,
    date_col: str | Column,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Add the identity of the source that covers each row's day; the registry is met once.

    Every row stays, whatever the state of the registry. ``unresolved`` tells why a row has no identity: ``NO_SOURCE`` covers
    it, ``SEVERAL_SOURCES`` do, or the one that does is ``NOT_CONFIRMED``; NULL for the others. The key is made after the match,
    so that a text made from columns of the row does not travel.
    """
    known = registry.withColumn("scope", F.when(is_confirmed(), F.struct(*entry_scope(source_system))))
    found = resolve_as_of(
        rows,
        known,
        type_col=type_col,
        date_col=date_col,
        broadcast_rows=broadcast_rows,
        strict=False,
        carry=("scope",),
    )
    scope = F.col("source_entry.scope")
    reason = (
        F.when(F.col("sources") == 0, "NO_SOURCE")
        .when(F.col("sources") > 1, "SEVERAL_SOURCES")
        .when(scope["source_owner"].isNull(), "NOT_CONFIRMED")
    )
    identity = {c: scope[c] for c in SCOPE} | {"unresolved": reason}
    out = found.withColumn("source_row_key", row_key.cast("string")).withColumns(identity).drop("source_entry", "sources")
    first = list(dict.fromkeys([*rows.columns, "source_row_key"]))
    return out.select(*first, *[c for c in out.columns if c not in first])


def scope_columns() -> Column:
    """The scope as one comparable struct."""
    return F.struct(*SCOPE)


def scope_id() -> Column:
    """Short text of the scope, used as partition directory (an empty discriminator cannot be one)."""
    return F.md5(F.to_json(scope_columns()))


def scope_id_of(scope: dict[str, str]) -> Column:
    """``scope_id`` of given scope values, a constant that prunes partitions."""
    return F.md5(F.to_json(F.struct(*[F.lit(scope[c]).alias(c) for c in SCOPE])))


def in_scope(scope: dict[str, str]) -> Column:
    condition = F.lit(True)
    for name in SCOPE:
        condition = condition & (F.col(name) == scope[name])
    return condition


def identity_violations(rows: DataFrame) -> DataFrame:
    """Rows whose identity is unusable, with the first reason."""
    def blank(name: str) -> Column:
        c = F.col(name)
        return c.isNull() | (F.trim(c, F.lit(BLANKS)) == "")

    first_blank = F.coalesce(*[F.when(blank(c), F.lit(f"BLANK:{c}")) for c in REQUIRED])
    column, value = F.col("source_discriminator_column"), F.col("source_discriminator_value")
    reason = F.coalesce(
        first_blank,
        F.when(column.isNull() | value.isNull(), F.lit("DISCRIMINATOR_NULL")),
        F.when((column == "") != (value == ""), F.lit("DISCRIMINATOR_HALF_SET")),
    )
    return rows.withColumn("violation", reason).filter(F.col("violation").isNotNull())


def batch_duplicates(rows: DataFrame) -> DataFrame:
    """Identities that occur more than once in a batch, with their number."""
    return rows.groupBy(*IDENTITY_KEY).agg(F.count(F.lit(1)).alias("copies")).filter(F.col("copies") > 1)


def stray_rows(rows: DataFrame, scope: dict[str, str]) -> DataFrame:
    """Rows of a full-refresh batch that lie outside its scope."""
    return rows.filter(~F.coalesce(in_scope(scope), F.lit(False)))
