"""Reconcile a source ledger with the facts made from it."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerspark.functions.calendar import month_of
from ledgerspark.operators.promotion import live_facts
from ledgerspark.operators.recon import recon_compare, recon_gate, recon_totals
from ledgerspark.operators.settlement import outstanding_totals
from ledgerspark.session import written_aside
from ledgerspark.sources.mart import append_recon_run


def ledger_scopes() -> dict[str, Column]:
    """Site, month and account of a ledger row."""
    return {
        "site": F.col("site_code"),
        "month": month_of(F.col("entry_date")),
        "account": F.col("entry_glcode"),
    }


def vendor_scope() -> dict[str, Column]:
    """Vendors of a ledger, which are summed apart from the other scopes."""
    return {"vendor": F.col("entry_slcode")}


def reconcile(
    source: DataFrame,
    facts: DataFrame,
    kpi: DataFrame | None = None,
    explanations: DataFrame | None = None,
    *,
    vendors: bool = False,
    as_of: date | None = None,
) -> DataFrame:
    """Source totals against the totals of the live facts, per check and scope.

    ``vendors`` adds the totals of each vendor; ``as_of`` adds what is outstanding and paid in advance on that day.
    """

    def totals(rows: DataFrame) -> DataFrame:
        found = recon_totals(rows, ledger_scopes(), apart=vendor_scope() if vendors else None)
        if as_of is None:
            return found
        return found.unionByName(outstanding_totals(rows, as_of, party="entry_slcode", day="entry_date"))

    return recon_compare(totals(source), totals(live_facts(facts)), kpi, explanations)


def run_reconciliation(
    source: DataFrame, facts: DataFrame, path: str, run_at: datetime, kpi=None, explanations=None, **more
) -> bool:
    """Reconcile, append the results to the run table and return the gate. A run that is repeated with its time replaces itself."""
    with written_aside(reconcile(source, facts, kpi, explanations, **more), "recon") as results:
        append_recon_run(results, path, run_at)
        return recon_gate(results).head().gate_passed
