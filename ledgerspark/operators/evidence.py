"""Does a row of an evidence list support a mapping claim?"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerspark.fixed_values import (
    MACHINE_VERIFIED,
    NOTE_COPY,
    NOTE_DISCRIMINATOR,
    NOTE_OBJECT,
    OPERATOR_CONFIRMED,
    REJECTED,
)
from ledgerspark.functions.text import column, normalise_cell


def cells(columns: Iterable[str]) -> Column:
    """Distinct normalised non-blank values of a row, whatever its columns."""
    return F.array_distinct(F.array_compact(F.array(*[normalise_cell(column(c)) for c in columns])))


def match_evidence(claims: DataFrame, evidence: DataFrame, *, row_index: str) -> DataFrame:
    """Judge every claim by the evidence row it cites.

    ``claims``: ``registry_key, copy_id, owner, object_name, discriminator_value`` (NULL: none) and
    ``evidence_row_index``. ``evidence``: any columns, plus the unique 0-based ``row_index``. The copy
    id, the object (bare or with owner) and the discriminator must be cells of the row.

    One equi-join on the cited index, so the work is linear in claims and rows.
    """
    rows = evidence.select(
        F.col(row_index).cast("bigint").alias("evidence_row_index"),
        cells(c for c in evidence.columns if c != row_index).alias("_cells"),
    )
    cited = claims.withColumn("evidence_row_index", F.col("evidence_row_index").cast("bigint"))
    joined = cited.join(rows, "evidence_row_index", "left")

    def present(token: Column) -> Column:
        return F.coalesce(F.array_contains(F.col("_cells"), token), F.lit(False))

    qualified = F.concat(F.col("owner"), F.lit("."), F.col("object_name"))
    value = F.col("discriminator_value")
    judged = joined.withColumns(
        {
            "has_copy": present(normalise_cell(F.col("copy_id"))),
            "has_object": present(F.upper("object_name")) | present(F.upper(qualified)),
            "has_discriminator": value.isNull() | present(normalise_cell(value)),
        }
    )
    copy, obj, disc = F.col("has_copy"), F.col("has_object"), F.col("has_discriminator")
    level = (
        F.when(F.col("_cells").isNull() | ~(copy | obj), REJECTED)
        .when(copy & obj & disc, MACHINE_VERIFIED)
        .otherwise(OPERATOR_CONFIRMED)
    )
    notes = F.array_compact(
        F.array(F.when(~copy, F.lit(NOTE_COPY)), F.when(~obj, F.lit(NOTE_OBJECT)), F.when(~disc, F.lit(NOTE_DISCRIMINATOR)))
    )
    return judged.select(
        *claims.columns,
        F.col("_cells").isNotNull().alias("row_exists"),
        "has_copy",
        "has_object",
        "has_discriminator",
        level.alias("verification"),
        notes.alias("notes"),
    )
