"""Row-key candidates of a ledger, tested on its data."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerspark.fixed_values import NO_KEY, STRONG_CANDIDATE, WEAK_CANDIDATE
from ledgerspark.functions.text import column


SKETCH_BITS = 12  # of the places of a sketch: the standard error of its count is below 2 %
MARGIN = 0.12  # six times that
NOT_COUNTED = -1  # surplus of a set that a sketch has ruled out


def _any_null(key: Sequence[str]) -> Column:
    condition = F.lit(False)
    for c in key:
        condition = condition | column(c).isNull()
    return condition


def _surplus_rows(df: DataFrame, sets: Sequence[frozenset[str]]) -> dict[frozenset[str], int]:
    """Exact number of rows that repeat a key free of NULL, for each set of columns; one scan, expanded once per set."""
    names = sorted({c for s in sets for c in s})
    masks = {sum(0 if c in s else 1 << (len(names) - 1 - i) for i, c in enumerate(names)): s for s in sets}
    per_key = (
        df.select(*[column(c) for c in names])
        .groupingSets([[column(c) for c in sorted(s)] for s in masks.values()], *[column(c) for c in names])
        .agg(F.grouping_id().cast("bigint").alias("_set"), F.count(F.lit(1)).alias("_n"))
    )
    null = F.lit(False)
    for mask, s in masks.items():
        null = null | ((F.col("_set") == mask) & _any_null(sorted(s)))
    found = {r["_set"]: r.surplus for r in per_key.filter(~null).groupBy("_set").agg(F.sum(F.col("_n") - 1).alias("surplus")).collect()}
    return {s: found.get(mask, 0) for mask, s in masks.items()}


def _pruned(df: DataFrame, sets: Sequence[frozenset[str]], columns: Sequence[str], count_repeats: bool) -> dict[frozenset[str], tuple]:
    """(rows, null rows, surplus rows, NULLs per column) of each set, with as few sets expanded as can be.

    One pass without a shuffle counts NULLs and estimates the distinct keys of every set by a sketch. A set whose keys repeat
    nowhere makes all of its supersets free of repeats, so small sets that look unique are counted first. A set that the
    sketch puts clearly below its rows has repeats: it is counted with the first ones, or not at all without ``count_repeats``.
    """
    order = list(sets)
    stats = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count_if(column(c).isNull()).alias(f"_null_{i}") for i, c in enumerate(columns)],
        *[F.count_if(_any_null(sorted(s))).alias(f"_nulls_{i}") for i, s in enumerate(order)],
        *[
            F.hll_sketch_estimate(F.hll_sketch_agg(F.when(~_any_null(sorted(s)), F.xxhash64(*[column(c) for c in sorted(s)])), SKETCH_BITS)).alias(f"_keys_{i}")
            for i, s in enumerate(order)
        ],
    ).head()
    null_rows = {s: stats[f"_nulls_{i}"] for i, s in enumerate(order)}
    filled = {s: stats.rows - null_rows[s] for s in order}
    unique_looking = {s: stats[f"_keys_{i}"] >= filled[s] * (1 - MARGIN) for i, s in enumerate(order)}
    surplus: dict[frozenset[str], int] = {s: 0 for s in order if filled[s] == 0}
    if not count_repeats:
        surplus |= {s: NOT_COUNTED for s in order if filled[s] and not unique_looking[s]}
    while waiting := [s for s in order if s not in surplus]:
        hopeful = [s for s in waiting if unique_looking[s]]
        surplus |= _surplus_rows(df, [s for s in waiting if not unique_looking[s] or not any(t < s for t in hopeful)])
        surplus |= {s: 0 for s in waiting if s not in surplus and any(t < s and filled[t] and surplus.get(t) == 0 for t in order)}
    nulls = tuple(stats[f"_null_{i}"] for i in range(len(columns)))
    return {s: (stats.rows, null_rows[s], surplus[s], *nulls) for s in order}


def _judged(df: DataFrame, sets: Mapping[int, Sequence[str]], columns: Sequence[str]) -> DataFrame:
    """Rows, null rows, surplus rows and NULLs per column for each set, from one scan expanded once per set."""
    per_key = (
        df.select(*[column(c) for c in columns])
        .groupingSets([[column(c) for c in key] for key in sets.values()], *[column(c) for c in columns])
        .agg(F.grouping_id().cast("bigint").alias("_set"), F.count(F.lit(1)).alias("_n"))
    )
    has_null = F.lit(False)
    for set_id, key in sets.items():
        has_null = has_null | ((F.col("_set") == set_id) & _any_null(key))
    return (
        per_key.withColumn("_null", has_null)
        .groupBy("_set")
        .agg(
            F.sum("_n").alias("rows"),
            F.coalesce(F.sum(F.when(F.col("_null"), F.col("_n"))), F.lit(0)).alias("null_rows"),
            F.coalesce(F.sum(F.when(~F.col("_null"), F.col("_n") - 1)), F.lit(0)).alias("surplus_rows"),
            *[
                F.coalesce(F.sum(F.when(column(c).isNull(), F.col("_n"))), F.lit(0)).alias(f"_null_{i}")
                for i, c in enumerate(columns)
            ],
        )
    )


def rank_keys(
    df: DataFrame,
    candidates: Mapping[str, Sequence[str]],
    *,
    discriminator_column: str | None = None,
    prune: bool = False,
    count_repeats: bool = True,
) -> DataFrame:
    """Label each candidate: STRONG is unique and free of NULL, WEAK is unique where it is free of
    NULL, anything else (no rows included) is no key. Evidence only: it picks nothing.

    Candidates with the same ordered column list merge and keep both names. One scan serves all of
    them: grouping sets count the rows per key, a second small aggregation judges each set.

    ``prune`` runs some small jobs at once instead, in which fewer sets are expanded and the result is the same (see ``_pruned``). Without
    ``count_repeats`` it also spares the sets that a sketch rules out; their ``surplus_rows`` is NULL.
    """
    if not candidates:
        raise ValueError("at least one candidate is needed")
    merged: dict[tuple[str, ...], list[str]] = {}
    for name, columns in candidates.items():
        merged.setdefault(tuple(columns), []).append(name)
    columns = sorted({c for key in merged for c in key})
    unknown = [c for c in columns if c not in df.columns]
    if unknown:
        raise ValueError(f"not columns of the table: {unknown}")

    def mask(key: Sequence[str]) -> int:
        return sum(0 if c in key else 1 << (len(columns) - 1 - i) for i, c in enumerate(columns))

    sets = {mask(key): tuple(sorted(set(key))) for key in merged}
    if prune or not count_repeats:
        found = _pruned(df, [frozenset(key) for key in sets.values()], columns, count_repeats)
        shape = ", ".join(f"{c} long" for c in ("_set", "rows", "null_rows", "surplus_rows", *[f"_null_{i}" for i in range(len(columns))]))
        judged = df.sparkSession.createDataFrame([(mask_, *found[frozenset(key)]) for mask_, key in sets.items()], shape)
    else:
        judged = _judged(df, sets, columns)
    listed = F.array(
        *[
            F.struct(
                F.lit(mask(key)).cast("bigint").alias("_set"),
                F.array(*[F.lit(c) for c in key]).alias("columns"),
                F.array(*[F.lit(n) for n in names]).alias("sources"),
            )
            for key, names in merged.items()
        ]
    )
    tested = df.sparkSession.range(1).select(F.inline(listed)).join(judged, "_set", "left")
    nullable = F.array_compact(
        F.array(
            *[
                F.when(F.array_contains("columns", c) & (F.col(f"_null_{i}") > 0), F.lit(c))
                for i, c in enumerate(columns)
            ]
        )
    )
    rows, null_rows, surplus = (F.coalesce(F.col(c), F.lit(0)) for c in ("rows", "null_rows", "surplus_rows"))
    unique = (rows > null_rows) & (surplus == 0)
    label = F.when(unique & (null_rows == 0), STRONG_CANDIDATE).when(unique, WEAK_CANDIDATE).otherwise(NO_KEY)
    order = F.when(F.col("recommendation") == STRONG_CANDIDATE, 0).when(F.col("recommendation") == WEAK_CANDIDATE, 1)
    reasons = F.array_compact(
        F.array(
            F.when(rows == 0, F.lit("no rows to test")),
            F.when(F.size("nullable_columns") > 0, F.concat(F.lit("NULL in: "), F.concat_ws(", ", "nullable_columns"))),
            F.when(surplus > 0, F.concat(surplus.cast("string"), F.lit(" rows repeat a key"))).when(surplus < 0, "rows repeat a key"),
        )
    )
    discriminated = F.array_contains("columns", discriminator_column) if discriminator_column else F.lit(None).cast("boolean")
    ranked = (
        tested.withColumn("nullable_columns", nullable)
        .select(
            "columns",
            "sources",
            rows.alias("rows"),
            null_rows.alias("null_rows"),
            F.when(surplus >= 0, surplus).alias("surplus_rows"),
            "nullable_columns",
            discriminated.alias("includes_discriminator"),
            label.alias("recommendation"),
            reasons.alias("reasons"),
        )
        .withColumn("_order", F.coalesce(order, F.lit(2)))
    )
    # One row per candidate from here on.
    best = F.expr("min(_order) over ()")
    overall = F.when(best == 0, STRONG_CANDIDATE).when(best == 1, WEAK_CANDIDATE).otherwise(NO_KEY)
    return (
        ranked.withColumn("overall", overall)
        .orderBy("_order", F.size("columns"), F.concat_ws(",", "columns"))
        .drop("_order")
    )
