"""The source registry: labels, filters, lookups, checks, overlay and additions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ledgerspark.fixed_values import (
    CONFIRMED,
    IDENTIFIER_PATTERN,
    RETIRED,
    SEPARATE_OBJECT,
    SHARED_DISCRIMINATOR,
)
from ledgerspark.operators.coverage import overlapping_sources


class RegistryError(ValueError):
    """The registry breaks one of its rules."""


class UnresolvedSource(RuntimeError):
    """The source has no confirmed physical object."""


# ---- labels ---------------------------------------------------------------------------------


def registry_key(prefix: str = "") -> Column:
    return F.concat_ws("|", *[F.col(prefix + c) for c in ("source_type", "logical_cube_name", "copy_id")])


def display_name(physical: str = "physical") -> Column:
    """``owner.object`` or ``owner.object#column=value``; for people, never a key."""
    p = F.col(physical)
    base = F.concat(p["owner"], F.lit("."), p["object_name"])
    return F.when(
        p["access_mode"] == SHARED_DISCRIMINATOR,
        F.concat(base, F.lit("#"), p["discriminator_column"], F.lit("="), p["discriminator_value"]),
    ).otherwise(base)


def registry_status(registry: DataFrame) -> DataFrame:
    """One readable row per entry."""
    def dash(c):
        return F.coalesce(c, F.lit("-"))

    return registry.select(
        "status",
        registry_key().alias("registry_key"),
        dash(F.col("financial_year")).alias("financial_year"),
        dash(F.when(F.col("physical").isNotNull(), display_name())).alias("physical"),
        dash(F.col("physical_hint")).alias("hint"),
        "authoritative",
    )


# ---- filters and lookups --------------------------------------------------------------------


def is_confirmed() -> Column:
    return (F.col("status") == CONFIRMED) & F.col("physical").isNotNull()


def confirmed_only(registry: DataFrame) -> DataFrame:
    """Entries that may be read: confirmed and with a physical object."""
    return registry.filter(is_confirmed())


def live_authoritative(registry: DataFrame) -> DataFrame:
    return registry.filter(F.col("authoritative") & (F.col("status") != RETIRED))


def find_entry(
    registry: DataFrame, source_type: str, copy_id: str | None = None, *, current_by_default: bool = False
) -> Row:
    """The one entry of a type (and copy). No hit and several hits are errors.

    With ``current_by_default`` a missing copy id means the current copy.
    """
    hits = registry.filter(F.col("source_type") == source_type)
    if copy_id is not None:
        hits = hits.filter(F.col("copy_id") == copy_id)
    elif current_by_default:
        hits = hits.filter("is_current")
    found = hits.limit(2).collect()
    if not found:
        raise LookupError(f"{source_type} is not registered with copy {copy_id}")
    if len(found) > 1:
        raise LookupError(f"{source_type}: several copies, for example {[r.copy_id for r in found]}; name one")
    return found[0]


def require_physical(entry: Row) -> Row:
    """The physical object of a confirmed entry; a hint is never used in its place."""
    if entry.status != CONFIRMED or entry.physical is None:
        raise UnresolvedSource(f"{entry.source_type} copy {entry.copy_id}: status {entry.status}, nothing to read")
    return entry.physical


def require_names(physical: Row, *, files: bool = False) -> None:
    """Refuse a physical object that breaks the rules of ``physical_violations`` before a name is used.

    ``files``: the object name may be a file name with dots, but no path.
    """
    name = r"^[A-Za-z][A-Za-z0-9_$#]*(\.[A-Za-z0-9_$#]+)*$" if files else IDENTIFIER_PATTERN
    column, value = physical.discriminator_column or "", physical.discriminator_value or ""
    mode = physical.access_mode or SEPARATE_OBJECT
    faults = [f for f, bad in {
        "owner": not re.match(IDENTIFIER_PATTERN, physical.owner or ""),
        "object name": not re.match(name, physical.object_name or ""),
        "access mode": mode not in (SEPARATE_OBJECT, SHARED_DISCRIMINATOR),
        "discriminator": bool(column or value) if mode == SEPARATE_OBJECT else not (value and re.match(IDENTIFIER_PATTERN, column)),
    }.items() if bad]
    if faults:
        raise RegistryError(f"malformed physical object: {', '.join(faults)}")


# ---- checks: rows that break a rule -----------------------------------------------------------


def physical_violations(registry: DataFrame) -> DataFrame:
    """Entries whose physical object is malformed, with the first rule broken."""
    p = F.col("physical")

    def bad_name(c: Column) -> Column:
        return ~F.coalesce(c.rlike(IDENTIFIER_PATTERN), F.lit(False))

    def is_set(c: Column) -> Column:
        return F.coalesce(c != "", F.lit(False))

    column, value = p["discriminator_column"], p["discriminator_value"]
    mode = F.coalesce(p["access_mode"], F.lit(""))
    broken = (
        F.when(bad_name(p["owner"]), "BAD_OWNER")
        .when(bad_name(p["object_name"]), "BAD_OBJECT_NAME")
        .when(~mode.isin(SEPARATE_OBJECT, SHARED_DISCRIMINATOR), "BAD_ACCESS_MODE")
        .when((mode == SHARED_DISCRIMINATOR) & ~(is_set(column) & is_set(value)), "DISCRIMINATOR_MISSING")
        .when((mode == SHARED_DISCRIMINATOR) & bad_name(column), "BAD_DISCRIMINATOR_COLUMN")
        .when((mode == SEPARATE_OBJECT) & (is_set(column) | is_set(value)), "DISCRIMINATOR_NOT_ALLOWED")
    )
    return (
        registry.filter(p.isNotNull())
        .select(registry_key().alias("registry_key"), broken.alias("violation"))
        .filter(F.col("violation").isNotNull())
    )


def registry_violations(registry: DataFrame) -> DataFrame:
    """Table rules: unique key, confirmed needs a physical object, dates in order."""
    p = F.col("physical")
    unresolved = (F.col("status") == CONFIRMED) & (p.isNull() | p["owner"].isNull() | p["object_name"].isNull())
    per_key = registry.groupBy(registry_key().alias("registry_key")).agg(
        F.count(F.lit(1)).alias("entries"),
        F.count_if(unresolved).alias("unresolved"),
        F.count_if(F.col("date_from") > F.col("date_to")).alias("reversed"),
    )
    found = F.array(
        F.struct(F.lit("DUPLICATE_KEY").alias("violation"), F.when(F.col("entries") > 1, F.col("entries")).alias("n")),
        F.struct(F.lit("CONFIRMED_WITHOUT_PHYSICAL").alias("violation"), F.col("unresolved").alias("n")),
        F.struct(F.lit("DATES_REVERSED").alias("violation"), F.col("reversed").alias("n")),
    )
    return per_key.select("registry_key", F.inline(found)).filter(F.col("n") > 0)


def duplicate_claims(registry: DataFrame) -> DataFrame:
    """Physical sources claimed by more than one registry key. NULL discriminators are equal."""
    p = F.col("physical")
    signature = ("owner", "object_name", "discriminator_column", "discriminator_value")
    claims = (
        registry.filter(p.isNotNull())
        .select(*[p[c].alias(c) for c in signature], registry_key().alias("registry_key"))
    )
    # Count and extremes instead of a list of claimants: the group may be of any size.
    return (
        claims.groupBy(*signature)
        .agg(
            F.count_distinct("registry_key").alias("claimants"),
            F.min("registry_key").alias("first_claimant"),
            F.max("registry_key").alias("last_claimant"),
        )
        .filter(F.col("claimants") > 1)
    )


def refuse(violations: DataFrame, message: str) -> None:
    """Strict form of any check: raise with one example if there is a violation."""
    example = violations.head(1)
    if example:
        raise RegistryError(f"{message}: {example[0].asDict()}")


# ---- composition --------------------------------------------------------------------------------


def apply_overlay(registry: DataFrame, overlay: DataFrame) -> DataFrame:
    """Confirmed facts win over the seed where they are present; unknown overlay keys are ignored.

    ``overlay``: one row per ``registry_key`` with ``status``, ``physical`` and ``last_refresh_at``.
    """
    won = overlay.select(
        F.col("registry_key").alias("_key"),
        *[F.col(c).alias(f"_{c}") for c in ("status", "physical", "last_refresh_at")],
    )
    kind = overlay.schema["physical"].dataType
    mode = F.coalesce(F.col("_physical.access_mode"), F.lit(SEPARATE_OBJECT))
    fields = [(mode if f == "access_mode" else F.col(f"_physical.{f}")).alias(f) for f in kind.names]
    won = won.withColumn("_physical", F.when(F.col("_physical").isNotNull(), F.struct(*fields)))
    joined = registry.join(won, registry_key() == F.col("_key"), "left")
    return joined.select(
        *[
            F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c) if f"_{c}" in won.columns else F.col(c)
            for c in registry.columns
        ]
    )


def combined_registry(
    seed: DataFrame, additions: DataFrame | None = None, overlay: DataFrame | None = None, *, validate: bool = True
) -> DataFrame:
    """Seed plus local additions, then the overlay; double coverage is refused."""
    registry = seed if additions is None else seed.unionByName(additions)
    if overlay is not None:
        registry = apply_overlay(registry, overlay)
    if validate:
        refuse(overlapping_sources(registry), "sources overlap")
    return registry


def refused_entries(registry: DataFrame, candidates: DataFrame) -> DataFrame:
    """Candidates whose window overlaps existing coverage or another candidate."""
    key = registry_key().alias("registry_key")
    both = registry.unionByName(candidates)
    return overlapping_sources(both).join(candidates.select(key).distinct(), "registry_key", "left_semi")


def add_entries_checked(registry: DataFrame, candidates: DataFrame) -> DataFrame:
    """Registry plus candidates, or an error that leaves the registry as it was."""
    refuse(refused_entries(registry, candidates), "entry refused, it overlaps existing coverage")
    return registry.unionByName(candidates)
