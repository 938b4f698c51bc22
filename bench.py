"""Time the registered queries and print one JSON line.

BENCH_SF_DIR   data set (default /root/testdata/sf0.1)
BENCH_CPUS     local threads (default 8)
BENCH_QUERIES  comma-separated names, or "all" (default: the headline queries)
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from ledgerspark.plans.queries import REGISTERED  # noqa: E402
from ledgerspark.session import local_session  # noqa: E402


HEADLINE = (
    "age_summary", "age_by_supplier", "fiscal_year_totals", "profile_light_lineitem", "profile_deep_orders",
    "profile_group_party", "rank_keys_lineitem", "registry_overlaps", "duplicate_claims", "resolve_as_of",
    "resolve_as_of_many_sources", "coverage_gaps", "ledger_identities", "batch_duplicates", "row_hashes",
    "staging_append", "missing_from_refresh", "promote_facts", "fact_total", "recon_totals", "recon_report",
    "match_evidence", "filter_any_regex", "shareable_view", "redact_documents",
)


def seconds(spark, query, sf_dir: str) -> float:
    start = time.perf_counter()
    query(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    wanted = os.environ.get("BENCH_QUERIES", "")
    chosen = list(REGISTERED) if wanted == "all" else [n for n in wanted.split(",") if n] or list(HEADLINE)
    spark = local_session("ledgerspark-bench", os.environ.get("BENCH_CPUS", "8"))
    REGISTERED["fiscal_year_totals"](spark, sf_dir).collect()  # starts the JVM side, not timed
    timings = {name: seconds(spark, REGISTERED[name], sf_dir) for name in chosen}
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
