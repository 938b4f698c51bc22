"""Discover a source: profile it, group it, rank its keys."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame

from ledgerspark.operators.keys import rank_keys
from ledgerspark.operators.profile import Role, bounded_sample, profile_deep, profile_group, profile_light, resolve_roles

LEDGER_ROLES = (
    Role("date_col"),
    Role("debit_col"),
    Role("credit_col"),
    Role("site_col", counted=True),
    Role("gl_col", counted=True),
    Role("sl_col", needed=False, counted=True),
    Role("release_col", needed=False),
)


def discover_source(
    source: DataFrame,
    roles: Mapping[str, str | None],
    *,
    key_candidates: Mapping[str, Sequence[str]] | None = None,
    discriminator_column: str | None = None,
    deep: bool = False,
    sample_order_by: Sequence[str] = (),
) -> dict[str, DataFrame]:
    """The findings on one ledger, each as a DataFrame that is computed when it is used.

    Roles are resolved first, so a wrong column name costs no scan. The sample may hold transactions
    and must stay local; all other results are aggregates.
    """
    real = resolve_roles(source, roles, LEDGER_ROLES)
    amounts = {"debit_col": real["debit_col"], "credit_col": real["credit_col"]}
    found = {
        "light": profile_light(
            source,
            date_col=real["date_col"],
            distinct_cols=[real[r.name] for r in LEDGER_ROLES if r.counted and r.name in real],
            exact_count=True,
            **amounts,
        ),
        "sample": bounded_sample(source, order_by=sample_order_by),
    }
    if deep:
        found["deep"] = profile_deep(source)
    if "release_col" in real:
        found["release_groups"] = profile_group(source, real["release_col"], **amounts)
    if key_candidates:
        found["keys"] = rank_keys(source, key_candidates, discriminator_column=discriminator_column)
    return found
