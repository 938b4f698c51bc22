"""Reconciliation of source, mart and KPI totals at zero tolerance."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerspark.fixed_values import TOTAL
from ledgerspark.functions.money import total_of, total_type, variance

ON = ["check_name", "scope"]


def recon_totals(
    rows: DataFrame, scopes: Mapping[str, Column], amounts: Sequence[str] = ("debit", "credit"), *, apart: Mapping[str, Column] | None = None
) -> DataFrame:
    """Totals and row count for the whole company and for each value of each scope, and of each scope in ``apart``.

    Scopes with very many values (vendors) belong in ``apart``: each is summed by itself, since together with the others they would
    leave nearly as many groups as rows.

    The ledger is first summed by all scopes together, which its map side does almost completely;
    the grouping sets then expand only that small table. Amounts keep their own scale. A scope is named
    ``name:value``, and ``name~`` where the value is NULL, which no value can imitate.
    """
    kind = max((total_type(rows.schema[a].dataType) for a in amounts), key=lambda t: t.scale)
    names = list(scopes)
    base = (
        rows.select(*[c.cast("string").alias(n) for n, c in scopes.items()], *amounts)
        .groupBy(*names)
        .agg(F.count(F.lit(1)).alias("rows"), *[total_of(rows, a).alias(a) for a in amounts])
    )
    measures = [*amounts, "rows"]
    totals = base.groupingSets([[], *[[F.col(n)] for n in names]], *[F.col(n) for n in names]).agg(
        *[(F.grouping(F.col(n)) == 0).alias(f"_by_{n}") for n in names],
        *[F.sum(m).cast(kind).alias(m) for m in measures],
    )
    scope = F.coalesce(
        *[F.when(F.col(f"_by_{n}"), F.coalesce(F.concat(F.lit(f"{n}:"), F.col(n)), F.lit(f"{n}~"))) for n in names],
        F.lit("company"),
    )
    per_measure = F.array(*[F.struct(F.lit(m).alias("check_name"), F.col(m).alias("value")) for m in measures])
    found = totals.select(scope.alias("scope"), F.inline(per_measure)).select("check_name", "scope", "value")
    for name, value in (apart or {}).items():
        found = found.unionByName(recon_totals(rows, {name: value}, amounts).filter("scope <> 'company'").select("check_name", "scope", F.col("value").cast(kind).alias("value")))
    return found


def _once(totals: DataFrame, value: str, what: str) -> DataFrame:
    """One value per check and scope; a repeat fails the job. The join needs this shuffle anyway."""
    repeated = F.raise_error(F.concat(F.lit(f"more than one {what} for "), F.concat_ws(" of ", *ON)))
    return totals.groupBy(*ON).agg(F.when(F.count(F.lit(1)) == 1, F.first(value)).otherwise(repeated).alias(what))


def recon_compare(
    source: DataFrame, mart: DataFrame, kpi: DataFrame | None = None, explanations: DataFrame | None = None
) -> DataFrame:
    """One result per check and scope. Source or mart counts as 0 where it lacks a total; a KPI is optional.

    Inputs hold ``check_name, scope, value``; explanations ``check_name, scope, explanation``. Each names a check and
    scope once at most. Values are compared at the wider of their scales.
    """
    zero = F.lit(0).cast(TOTAL)
    joined = _once(source, "value", "source").join(_once(mart, "value", "mart"), ON, "full_outer")
    if kpi is not None:
        joined = joined.join(_once(kpi, "value", "kpi"), ON, "full_outer")
    else:
        joined = joined.withColumn("kpi", F.lit(None).cast(TOTAL))
    if explanations is not None:
        joined = joined.join(_once(explanations, "explanation", "explanation"), ON, "left")
    else:
        joined = joined.withColumn("explanation", F.lit(""))
    amounts = joined.select(
        *ON,
        F.coalesce(F.col("source"), zero).alias("source"),
        F.coalesce(F.col("mart"), zero).alias("mart"),
        "kpi",
        F.coalesce(F.col("explanation"), F.lit("")).alias("explanation"),
    )
    judged = amounts.withColumns(
        {
            "variance_mart": variance(F.col("mart"), F.col("source")),
            "variance_kpi": F.coalesce(variance(F.col("kpi"), F.col("mart")), zero),
        }
    ).withColumn("passed", (F.col("variance_mart") == 0) & (F.col("variance_kpi") == 0))
    return judged.withColumn("accepted", F.col("passed") | (F.col("explanation") != ""))


def recon_gate(results: DataFrame) -> DataFrame:
    """True only if there are results and all of them pass; an explanation does not help."""
    return results.agg(
        F.count(F.lit(1)).alias("checks"),
        F.count_if(~F.col("passed")).alias("failed"),
        F.coalesce(F.bool_and("passed"), F.lit(False)).alias("gate_passed"),
    )


def recon_report(results: DataFrame) -> DataFrame:
    """Report columns: KPI as text with ``-`` for none, and PASS or FAIL."""
    return results.select(
        *ON,
        "source",
        "mart",
        F.coalesce(F.col("kpi").cast("string"), F.lit("-")).alias("kpi"),
        "variance_mart",
        "variance_kpi",
        F.when(F.col("passed"), "PASS").otherwise("FAIL").alias("status"),
        "explanation",
    )
