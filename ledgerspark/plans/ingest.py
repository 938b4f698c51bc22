"""Ingest one extract: identify, stage, check, promote, publish."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable
from contextlib import ExitStack
from datetime import datetime
from functools import partial, reduce

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerspark import schemas
from ledgerspark.fixed_values import IDENTITY
from ledgerspark.functions.hashing import hash_bytes
from ledgerspark.operators.identity import scope_id, scope_id_of, scope_of, with_identity
from ledgerspark.operators.promotion import (
    REPEATED,
    BatchRejected,
    as_batch,
    check_identities,
    promote,
    promote_scope,
    promotion_counts,
    require_known,
    taken,
)
from ledgerspark.session import fits_broadcast, shuffles_removed, written_aside
from ledgerspark.sources.mart import STANDING, FactFiles, FactTable, stage_append
from ledgerspark.sources.places import MAX_BITMAPS, PLACE, at_places, place_bits, with_places

BROADCAST_BATCH_ROWS = 100_000
MAX_GENERATIONS = 8  # of one scope that a reader meets; a longer chain is written anew as one
MERGE_ROWS = 10_000_000  # of a batch whose keys are shuffled at a time, while slices are few
MAX_SLICES = 8
MAX_NAMED_SCOPES = 2000  # a scope is one source of the registry, so a batch rarely touches more


def fact_schema(rows: DataFrame, payload: Iterable[str]) -> T.StructType:
    """Fact schema of a ledger with these payload columns: typed payload, identity, control."""
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    standard = {name for name, _, _ in schemas.LEDGER_PAYLOAD}
    control = [f for f in schemas.FACT.fields if f.name not in standard]
    return T.StructType([*[T.StructField(c, kinds[c]) for c in payload], *control])


def concerned_facts(facts: DataFrame, batch: DataFrame, scope: dict[str, str] | None) -> DataFrame:
    """Facts of the scopes that a batch touches; the partitions of all others are not read."""
    if scope is not None:
        return facts.filter(F.col("scope_id") == scope_id_of(scope))
    touched = batch.select(scope_id().alias("scope_id")).distinct()
    ids = [r.scope_id for r in touched.limit(MAX_NAMED_SCOPES + 1).collect()]
    if len(ids) <= MAX_NAMED_SCOPES:
        return facts.filter(F.col("scope_id").isin(ids))
    return facts.join(touched, "scope_id", "left_semi")


def promote_into(
    batch: DataFrame,
    store: FactFiles | FactTable,
    *,
    extracted_at: datetime,
    full_refresh_scope: dict[str, str] | None = None,
    identified: bool = False,
    rows_at: Callable[[DataFrame], DataFrame] | None = None,
) -> dict[str, int]:
    """Promote a batch into the stored facts and return the counts per outcome.

    Only the scopes concerned are read and rewritten. The merged rows are written once, beside the current ones; they carry
    their outcome, so the counts come from what was written. Then the store switches to them. A repeated identity stops the
    job before the switch, as does any other death, and running it again reaches the same facts. ``identified`` says that
    ``check_identities`` has passed the batch. ``rows_at`` gives the rows of a batch with places that bitmaps of places list: then
    fact files are merged by place, and rows that stay are not written again.
    """
    spark = batch.sparkSession
    if not identified:
        check_identities(batch, full_refresh_scope)
    version = store.current(spark)
    small = fits_broadcast(batch, BROADCAST_BATCH_ROWS)
    merge = partial(promote, extracted_at=extracted_at, small_batch=small)
    if full_refresh_scope is not None:
        merge = partial(promote_scope, scope=full_refresh_scope, extracted_at=extracted_at, small_batch=small)
    spread = full_refresh_scope is not None and not small
    try:
        if rows_at is not None and isinstance(store, FactFiles):
            facts = concerned_facts(store.read(spark, version, placed=True), batch, full_refresh_scope)
            found = _written_by_place(facts, batch, store, merge, rows_at, spread=spread)
            if found is not None:
                generation, counts = found
                store.switch(spark, generation, based_on=version)
                return counts
        facts = concerned_facts(store.read(spark, version), batch, full_refresh_scope).drop("scope_id")
        generation = store.write_aside(merge(facts, batch.drop(*PLACE)), spread=spread)
    except PySparkException as error:
        if REPEATED in str(error):
            raise BatchRejected(REPEATED) from error
        raise
    counts = {r.outcome: r.n for r in promotion_counts(store.written(spark, generation, "outcome")).collect()}
    store.switch(spark, generation, based_on=version)
    return counts


def _written_by_place(
    facts: DataFrame,
    batch: DataFrame,
    store: FactFiles,
    merge: Callable[[DataFrame, DataFrame], DataFrame],
    rows_at: Callable[[DataFrame], DataFrame],
    *,
    spread: bool,
) -> tuple[str, dict[str, int]] | None:
    """The merge by key, hash and place: whole rows are not shuffled, and only those that the batch brings are written.

    The merged table says of each fact where it is, in the batch or in the store, and its outcome, so the counts come from it. A large
    batch is merged in slices of the keys, so that the shuffle of only one is on disk at a time. None if the
    bitmaps are too large to broadcast, or if one row of the batch meets several facts, which then are not one row at one place.
    """
    spark, kinds = batch.sparkSession, {f.name: f.dataType for f in store.schema.fields}
    require_known(kinds, batch.drop(*PLACE).columns)
    narrow = [*IDENTITY, hash_bytes(F.col("row_hash")).alias("row_hash")]
    mark = F.when(F.col("outcome") == "tombstoned", F.col("source_deleted_at")).otherwise(F.col("_mark"))
    by = ("scope_id", "_generation", "_mark")
    slices = min(MAX_SLICES, 1 + batch.count() // MERGE_ROWS)
    with ExitStack() as held:
        parts = []
        for n in range(slices):
            of_slice = F.pmod(F.xxhash64("source_row_key"), F.lit(slices)) == n
            old, incoming = (rows.filter(of_slice) if slices > 1 else rows for rows in (facts, batch))
            merged = merge(old.select(*narrow, "source_deleted_at", *STANDING), incoming.select(*narrow, *PLACE))
            moved = merged.select(scope_id().alias("scope_id"), "outcome", "_generation", *PLACE, mark.alias("_mark"))
            parts.append(held.enter_context(written_aside(moved, "merged")))
        moved = reduce(DataFrame.unionByName, parts)
        new = held.enter_context(written_aside(place_bits(moved.filter(taken())), "taken"))
        stays = held.enter_context(written_aside(place_bits(moved.filter(~taken()), by), "stays"))
        counts = {r.outcome: r.n for r in promotion_counts(moved).collect()}
        brought = counts["inserted"] + counts["updated"] + counts["revived"]
        bits, places = new.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.bitmap_count("_bits")), F.lit(0))).head()
        chain = [tuple(r) for r in stays.select("scope_id", "_generation").distinct().collect()]
        if max(bits, stays.count()) > MAX_BITMAPS or places != brought:
            return None
        missing = [c for c in kinds if c not in batch.columns]
        rows = rows_at(new).withColumns({c: F.lit(None) for c in missing}).select(*[F.col(c).cast(k).alias(c) for c, k in kinds.items()])
        longest = max(Counter(s for s, _ in chain).values(), default=0)
        standing = moved.count() - brought
        if longest >= MAX_GENERATIONS or store.rows_stored(spark, chain) > brought + 2 * standing:
            return store.write_aside(rows.unionByName(store.standing(spark, stays)) if chain else rows, spread=spread), counts
        generation = store.write_aside(rows, spread=spread)
        store.keep(generation, stays)
        return generation, counts


def ingest_extract(
    rows: DataFrame,
    entry: Row,
    *,
    source_system: str,
    row_key: Column,
    payload: Iterable[str],
    batch_id: str,
    extracted_at: datetime,
    order_by: Iterable[str],
    staging_path: str,
    store: FactFiles | FactTable,
    full_refresh: bool,
) -> dict[str, int]:
    """Stage and promote one extract of one confirmed source.

    The extract is written aside once: a source that goes on changing is read a single time, and the
    checks, staging and promotion all see the same rows. Staging keeps the first of repeated rows;
    promotion rejects an extract that has them.
    """
    payload, order_by = list(payload), list(order_by)

    def identified(table: DataFrame, key: Column) -> DataFrame:
        year = F.lit(entry.financial_year).cast("string")
        return with_identity(table, entry, key, source_system).withColumn("source_financial_year", year)

    def batch_of(placed: DataFrame) -> DataFrame:
        return as_batch(
            identified(placed, F.col("source_row_key")),
            payload=payload,
            batch_id=batch_id,
            extracted_at=extracted_at,
            keep=["source_financial_year", *order_by, *PLACE],
        )

    # What is the same in all rows, and the hash that follows from them, is added to the rows that are read back.
    extract = identified(rows, row_key).select(*dict.fromkeys(["source_row_key", *payload, *order_by]))
    with shuffles_removed(rows.sparkSession), written_aside(extract, "extract") as table:
        placed = with_places(table)
        batch = batch_of(placed)
        check_identities(batch)  # they come from one entry, so none can be of another scope
        staged = stage_append(batch, staging_path, payload=payload, order_by=order_by)
        counts = promote_into(
            batch,
            store,
            extracted_at=extracted_at,
            full_refresh_scope=scope_of(entry, source_system) if full_refresh else None,
            identified=True,
            rows_at=lambda bits: batch_of(at_places(placed, bits)),
        )
    return {"staged": staged, **counts}
