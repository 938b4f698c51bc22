"""Coverage windows: overlaps, as-of resolution, gaps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerspark.fixed_values import RETIRED
from ledgerspark.session import fits_broadcast

BROADCAST_ROWS = 100_000
BROADCAST_PER_TYPE = 500
MANY_TYPES = 500  # so many types are taken to spread the rows, so that these may move by type


class OverlapError(ValueError):
    """Two live authoritative sources of one type cover the same day."""


def _windows(registry: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """Live authoritative windows that cover at least one day."""
    return registry.filter(
        F.col("authoritative") & (F.col("status") != RETIRED) & (F.col("date_from") <= F.col("date_to"))
    ).select(
        "source_type",
        F.concat_ws("|", "source_type", "logical_cube_name", "copy_id").alias("registry_key"),
        "copy_id",
        "date_from",
        "date_to",
        *carry,
    )


def overlapping_sources(registry: DataFrame) -> DataFrame:
    """Every live authoritative entry that shares a day with another one of its type, and one witness.

    Entries are first reduced to one row per (type, first day). The ordered pass over that table is
    bounded by the calendar, whatever the number of entries, and no pairs are formed.
    """
    live = _windows(registry)
    starts = live.groupBy("source_type", "date_from").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("registry_key").alias("first_key"),
        F.max("registry_key").alias("last_key"),
        F.max(F.struct("date_to", "registry_key")).alias("reach"),
    )
    by_day = W.partitionBy("source_type").orderBy("date_from")
    context = starts.select(
        "source_type",
        "date_from",
        "n",
        "first_key",
        "last_key",
        F.max("reach").over(by_day.rowsBetween(W.unboundedPreceding, -1)).alias("before"),
        F.lead(F.struct("date_from", F.col("first_key").alias("registry_key"))).over(by_day).alias("after"),
    )
    witness = (
        F.when(
            F.col("n") > 1,
            F.when(F.col("registry_key") == F.col("first_key"), F.col("last_key")).otherwise(F.col("first_key")),
        )
        .when(F.col("before.date_to") >= F.col("date_from"), F.col("before.registry_key"))
        .when(F.col("after.date_from") <= F.col("date_to"), F.col("after.registry_key"))
    )
    return (
        live.join(context, ["source_type", "date_from"])
        .select("source_type", "registry_key", "date_from", "date_to", witness.alias("overlaps_with"))
        .filter(F.col("overlaps_with").isNotNull())
    )


def _check(registry: DataFrame) -> None:
    example = overlapping_sources(registry).head(1)
    if example:
        raise OverlapError(f"double coverage: {example[0].asDict()}")


def coverage_timeline(registry: DataFrame, *, carry: Sequence[str] = ()) -> DataFrame:
    """Disjoint stretches of covered days: ``source_type, date_from, date_to, sources, source``.

    ``sources`` counts the live authoritative windows over a stretch; ``source`` is the one of them (its registry key, copy
    and the columns ``carry``), NULL where there are several. Windows may overlap and end as late as they like: only their
    ends are looked at. Both ends of all windows are summed by (type, day), then one ordered pass carries the number of open
    windows and the exclusive-or of their ids, which is the id of the only one. A type has no more ends than the calendar days.
    """
    live = _windows(registry, carry).withColumn("_id", F.xxhash64("source_type", "registry_key", "date_from", "date_to"))
    ends = live.select(
        "source_type",
        "_id",
        F.inline(F.array(
            F.struct(F.col("date_from").alias("_day"), F.lit(1).cast("bigint").alias("_step")),
            F.struct(F.date_add("date_to", 1).alias("_day"), F.lit(-1).cast("bigint").alias("_step")),
        )),
    )
    changes = ends.groupBy("source_type", "_day").agg(F.sum("_step").alias("_step"), F.bit_xor("_id").alias("_id"))
    by_day = W.partitionBy("source_type").orderBy("_day")
    stretches = changes.select(
        "source_type",
        F.col("_day").alias("date_from"),
        F.date_sub(F.lead("_day").over(by_day), 1).alias("date_to"),
        F.sum("_step").over(by_day).alias("sources"),
        F.bit_xor("_id").over(by_day).alias("_only"),
    ).filter("sources > 0")
    single = live.select(F.col("source_type").alias("_type"), "_id", F.struct("registry_key", "copy_id", *carry).alias("source"))
    found = stretches.join(
        single, (F.col("sources") == 1) & (F.col("source_type") == F.col("_type")) & (F.col("_only") == F.col("_id")), "left"
    )
    return found.select("source_type", "date_from", "date_to", "sources", "source")


def _match(rows: DataFrame, stretches: DataFrame, how: str, type_col: Column, date_col: Column, broadcast_rows: int) -> DataFrame:
    """Rows with the stretch of their type that covers their day, as column ``_stretch``."""
    keyed = rows.withColumns({"_row_type": type_col, "_row_day": date_col.cast("date")})
    stretch = F.struct("date_to", *[c for c in stretches.columns if c not in ("source_type", "date_from", "date_to")])
    marks = stretches.select(F.col("source_type").alias("_type"), F.col("date_from").alias("_day"), stretch.alias("_stretch"))
    most, types = stretches.groupBy("source_type").count().agg(F.coalesce(F.max("count"), F.lit(0)), F.count(F.lit(1))).head()
    small = most <= BROADCAST_PER_TYPE and fits_broadcast(stretches, broadcast_rows)
    if small or (most <= BROADCAST_PER_TYPE and types >= MANY_TYPES):
        # Few for each type, as a row tries all of its type. Too large to broadcast, they meet the rows by type: a row moves once.
        covered = (F.col("_row_type") == F.col("_type")) & F.col("_row_day").between(F.col("_day"), F.col("_stretch.date_to"))
        return keyed.join(F.broadcast(marks) if small else marks, covered, how)
    # Many of one type, or few types, one of which may hold nearly all rows. The days that occur are resolved, not the rows: distinct (type, day) pairs are sorted among the
    # starts of the stretches, and the last start is carried on. A type has no more of them than the calendar has days,
    # however many rows it holds. The rows then meet their day by equality, where AQE splits a day with very many rows.
    days = keyed.select(F.col("_row_type").alias("_type"), F.col("_row_day").alias("_day")).dropna().distinct()
    in_order = W.partitionBy("_type").orderBy("_day")
    both = marks.withColumn("_asked", F.lit(False)).unionByName(days.withColumn("_asked", F.lit(True)), allowMissingColumns=True)
    carried = both.withColumn("_stretch", F.last("_stretch", ignorenulls=True).over(in_order))
    resolved = carried.filter("_asked and _stretch.date_to >= _day").select("_type", "_day", "_stretch")
    same_day = (F.col("_row_type") == F.col("_type")) & (F.col("_row_day") == F.col("_day"))
    return keyed.join(resolved, same_day, how)


def resolve_as_of(
    rows: DataFrame,
    registry: DataFrame,
    *,
    type_col: str | Column,
    date_col: str | Column,
    broadcast_rows: int = BROADCAST_ROWS,
    strict: bool = True,
    carry: Sequence[str] = (),
) -> DataFrame:
    """Add the one authoritative source that covers each row; NULL where there is none.

    ``strict`` refuses a registry with double coverage. Without it every registry will do: ``sources`` tells how many cover
    the row, and the source is NULL if it is not exactly one. ``carry`` names columns of the registry that are added as the
    fields of ``source_entry``.
    """
    if strict:
        _check(registry)
    found = _match(rows, coverage_timeline(registry, carry=carry), "left", _column(type_col), _column(date_col), broadcast_rows)
    source = F.col("_stretch.source")
    added = [source["registry_key"].alias("source_registry_key"), source["copy_id"].alias("resolved_copy_id")]
    if not strict:
        added.append(F.coalesce("_stretch.sources", F.lit(0)).alias("sources"))
    if carry:
        added.append(F.struct(*[source[c].alias(c) for c in carry]).alias("source_entry"))
    return found.select(*rows.columns, *added)


def coverage_gaps(
    rows: DataFrame,
    registry: DataFrame,
    *,
    type_col: str | Column,
    date_col: str | Column,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Rows that no authoritative source covers. Double coverage is coverage here; ``overlapping_sources`` reports it."""
    stretches = coverage_timeline(registry).select("source_type", "date_from", "date_to")
    return _match(rows, stretches, "left_anti", _column(type_col), _column(date_col), broadcast_rows).select(*rows.columns)


def _column(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c
