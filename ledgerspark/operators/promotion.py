"""Staging deduplication, promotion into facts and totals over live facts."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerspark.fixed_values import IDENTITY, IDENTITY_KEY, MONEY, OUTCOMES, SCOPE, TOTAL
from ledgerspark.functions.money import total_of, total_type
from ledgerspark.functions.hashing import row_hash
from ledgerspark.operators.identity import batch_duplicates, identity_violations, in_scope, stray_rows


class BatchRejected(ValueError):
    """The batch breaks a rule; no fact was changed."""


def as_batch(
    rows: DataFrame, *, payload: Iterable[str], batch_id: str, extracted_at: datetime, keep: Iterable[str] = ()
) -> DataFrame:
    """Identity and payload, hashed and stamped; ``keep`` names further columns to carry along."""
    payload = list(payload)
    return rows.select(
        *IDENTITY,
        *payload,
        *[c for c in keep if c not in payload and c not in IDENTITY],
        row_hash(rows, payload).alias("row_hash"),
        F.lit(batch_id).alias("extract_batch_id"),
        F.lit(extracted_at).cast("timestamp").alias("extracted_at"),
    )


def new_staging_rows(existing: DataFrame, batch: DataFrame, *, order_by: Iterable[str]) -> DataFrame:
    """Rows of ``batch`` that a snapshot table does not hold yet.

    Inside one call the first row of a repeated identity wins, by ``order_by``. The rank filter is
    applied before the shuffle too, so a key repeated very often does not gather in one task.
    """
    key = [*IDENTITY_KEY, "extract_batch_id"]
    first = W.partitionBy(*key).orderBy(*[F.col(c).asc_nulls_last() for c in order_by])
    once = batch.withColumn("_rank", F.row_number().over(first)).filter("_rank = 1").drop("_rank")
    return once.join(existing.select(*key), key, "left_anti")


def empty_facts(batch: DataFrame) -> DataFrame:
    """The facts before the first batch."""
    return batch.limit(0).withColumn("source_deleted_at", F.lit(None).cast("timestamp"))


def _reject_if_any(violations: DataFrame, message: str) -> None:
    example = violations.select(*IDENTITY).head(1)
    if example:
        raise BatchRejected(f"{message}: {example[0].asDict()}")


def require_known(facts: Iterable[str], batch: Iterable[str]) -> None:
    """Refuse batch columns that the facts lack."""
    known = set(facts)
    unknown = [c for c in batch if c not in known]
    if unknown:
        raise BatchRejected(f"the facts have no column for {', '.join(unknown)}")


def taken() -> Column:
    """True for merged rows that are the batch's, False for those that stay as they were stored, whatever their mark."""
    return F.coalesce(F.col("outcome").isin("inserted", "updated", "revived"), F.lit(False))


def check_identities(rows: DataFrame, scope: dict[str, str] | None = None) -> None:
    """Reject rows that cannot be traced to their source or lie outside the scope of a full refresh."""
    _reject_if_any(identity_violations(rows), "rows without a usable identity")
    if scope is not None:
        _reject_if_any(stray_rows(rows, scope), "a complete extract has rows of another scope")


def check_batch(batch: DataFrame, scope: dict[str, str] | None = None) -> None:
    """Reject a batch as a whole, before anything is written. Reads identity columns only."""
    check_identities(batch, scope)
    _reject_if_any(batch_duplicates(batch), REPEATED)


REPEATED = "an identity occurs more than once in the batch"


def promote(
    facts: DataFrame,
    batch: DataFrame,
    *,
    extracted_at: datetime,
    full_refresh_scope: dict[str, str] | None = None,
    small_batch: bool = False,
    keyed_alike: bool = False,
) -> DataFrame:
    """Facts after the batch, with an ``outcome`` per row (NULL: not concerned).

    A pure function of its inputs: no job runs here, and a rerun gives the same rows. A batch that repeats an identity fails
    the job that computes the result; the copies are counted in the order that the join needs anyway. With a scope, only the
    facts of that scope take part in the join; the others pass through without a shuffle. ``small_batch`` says that the
    batch is known to fit a broadcast: then no fact is shuffled at all. ``keyed_alike`` says that facts and batch are partitioned
    by the key into the same number of parts: they meet without a shuffle, and the result is partitioned so again for the next batch.
    """
    how = {"small_batch": small_batch, "keyed_alike": keyed_alike}
    if full_refresh_scope is None:
        merged = _merge(facts, batch, extracted_at, IDENTITY_KEY, complete=False, **how)
        return merged.select(*facts.columns, "outcome")
    merged = promote_scope(facts, batch, full_refresh_scope, extracted_at=extracted_at, **how)
    others = facts.filter(~in_scope(full_refresh_scope)).withColumn("outcome", F.lit(None).cast("string"))
    return merged.unionByName(others)


def promote_scope(
    facts: DataFrame, batch: DataFrame, scope: dict[str, str], *, extracted_at: datetime, small_batch: bool = False,
    keyed_alike: bool = False,
) -> DataFrame:
    """The facts of one scope after a complete extract of it.

    Inside a scope the row key alone identifies a row, so the scope columns are neither shuffled nor
    compared. A batch row outside the scope fails the job.
    """
    inside = in_scope(scope)
    stray = F.raise_error(F.concat(F.lit("row outside the scope of its batch: "), "source_row_key"))
    guarded = batch.withColumn(
        "source_row_key", F.when(F.coalesce(inside, F.lit(False)), F.col("source_row_key")).otherwise(stray)
    )
    merged = _merge(
        facts.filter(inside).drop(*SCOPE),
        guarded.drop(*SCOPE),
        extracted_at,
        ("source_row_key",),
        complete=True,
        small_batch=small_batch,
        keyed_alike=keyed_alike,
    )
    return merged.withColumns({c: F.lit(v) for c, v in scope.items()}).select(*facts.columns, "outcome")


def _marked_once(batch: DataFrame, key: tuple[str, ...], small_batch: bool) -> DataFrame:
    """The batch with a mark ``_in_batch``; to mark a second row of a key fails the job.

    Rows are numbered within their key: partitioned and sorted by the key as the join needs them, so nothing moves twice, and
    streamed, so a key with very many rows needs no memory. A small batch is numbered in one task.
    """
    numbered = F.row_number().over(W.partitionBy(*key).orderBy(*key))
    rows = (batch.repartition(1) if small_batch else batch).withColumn("_copy", numbered)
    repeated = F.raise_error(F.concat(F.lit(f"{REPEATED}: "), F.concat_ws("|", *key)))
    return rows.withColumn("_in_batch", F.when(F.col("_copy") == 1, True).otherwise(repeated)).drop("_copy")


def _meet(old: DataFrame, new: DataFrame, key: list[str], small_batch: bool) -> DataFrame:
    """Full outer join of facts and batch."""
    if not small_batch:
        return old.join(new, key, "full_outer")
    # The same rows without a shuffle of the facts: a broadcast cannot serve a full outer join, so the
    # new identities are those that a second pass over the keys of the facts does not find.
    met = old.join(F.broadcast(new), key, "left")
    known = old.select(*key).join(F.broadcast(new.select(*key)), key, "left_semi")
    return met.unionByName(new.join(F.broadcast(known), key, "left_anti"), allowMissingColumns=True)


def _meet_in_place(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """The same rows as a union that keeps the partitioning by key, which a full outer join gives up.

    Facts with what the batch has for them, then the batch rows that no fact has; the facts' keys are looked at twice. The filter
    asks for the mark of every fresh row, as nothing else does: without it a repeat among them would go unseen.
    """
    fresh = new.filter("_in_batch").join(old.select(*key), key, "left_anti")
    return old.join(new, key, "left").unionByName(fresh, allowMissingColumns=True)


def _merge(
    facts: DataFrame,
    batch: DataFrame,
    extracted_at: datetime,
    key: tuple[str, ...],
    *,
    complete: bool,
    small_batch: bool,
    keyed_alike: bool,
) -> DataFrame:
    """Facts joined with the batch on ``key``, and the five outcomes; a ``complete`` batch tombstones
    what it lacks.

    A changed row takes the whole payload of the batch: what the batch lacks becomes NULL. A batch column that the
    facts lack is refused.
    """
    require_known(facts.columns, batch.columns)
    carried = [c for c in facts.columns if c not in key]
    replaced = [c for c in carried if c in batch.columns]
    old = facts.select(*key, *[F.col(c).alias(f"_old_{c}") for c in carried], F.lit(True).alias("_in_facts"))
    new = _marked_once(batch.select(*key, *[F.col(c).alias(f"_new_{c}") for c in replaced]), key, small_batch)
    met = _meet_in_place(old, new, list(key)) if keyed_alike and not small_batch else _meet(old, new, list(key), small_batch)
    in_facts, in_batch = F.col("_in_facts").isNotNull(), F.col("_in_batch").isNotNull()
    deleted = F.col("_old_source_deleted_at").isNotNull()
    outcome = (
        F.when(~in_facts, "inserted")
        .when(in_batch & deleted, "revived")
        .when(in_batch & (F.col("_old_row_hash") == F.col("_new_row_hash")), "unchanged")
        .when(in_batch, "updated")
        .when(F.lit(complete) & ~deleted, "tombstoned")
    )
    takes_new = taken()
    final = {c: F.when(~takes_new, F.col(f"_old_{c}")) for c in carried}
    final |= {c: F.when(takes_new, F.col(f"_new_{c}")).otherwise(F.col(f"_old_{c}")) for c in replaced}
    final["source_deleted_at"] = (
        F.when(takes_new, F.lit(None).cast("timestamp"))
        .when(F.col("outcome") == "tombstoned", F.lit(extracted_at).cast("timestamp"))
        .otherwise(F.col("_old_source_deleted_at"))
    )
    return (
        met.withColumn("outcome", outcome)
        .select(*key, *[c.alias(name) for name, c in final.items()], "outcome")
    )


def facts_after(merged: DataFrame) -> DataFrame:
    return merged.drop("outcome")


def promotion_counts(merged: DataFrame) -> DataFrame:
    """Number of rows per outcome, zero included."""
    counted = merged.agg(*[F.count_if(F.col("outcome") == o).alias(o) for o in OUTCOMES])
    pairs = F.array(*[F.struct(F.lit(o).alias("outcome"), F.col(o).alias("n")) for o in OUTCOMES])
    return counted.select(F.inline(pairs))


def missing_from_refresh(facts: DataFrame, batch: DataFrame, scope: dict[str, str]) -> DataFrame:
    """Live facts of the scope that a complete extract no longer contains."""
    extracted = batch.filter(in_scope(scope)).select("source_row_key")
    return live_facts(facts.filter(in_scope(scope))).join(extracted, "source_row_key", "left_anti")


def live_facts(facts: DataFrame) -> DataFrame:
    return facts.filter(F.col("source_deleted_at").isNull())


def fact_total(facts: DataFrame, *columns: str) -> DataFrame:
    """Exact sum of each column over live facts; a column that is absent counts as 0."""
    present = set(facts.columns)
    kinds = {c: total_type(facts.schema[c].dataType) if c in present else TOTAL for c in columns}
    totals = live_facts(facts).agg(F.count(F.lit(1)), *[total_of(facts, c).alias(c) for c in columns if c in present])
    return totals.select(*[F.coalesce(F.col(c) if c in present else F.lit(None), F.lit(0)).cast(kinds[c]).alias(c) for c in columns])


def fact_violations(facts: DataFrame) -> DataFrame:
    """Facts that miss a mandatory value."""
    reason = F.coalesce(*[F.when(F.col(c).isNull(), F.lit(f"NULL:{c}")) for c in ("entry_date", "debit", "credit")])
    return facts.withColumn("violation", reason).filter(F.col("violation").isNotNull())


def with_default_amounts(rows: DataFrame, *columns: str) -> DataFrame:
    """Absent amounts become 0 at load."""
    return rows.withColumns({c: F.coalesce(F.col(c), F.lit(0)).cast(MONEY) for c in columns or ("debit", "credit")})
