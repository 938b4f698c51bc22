"""Feed arriving extract files into staging and facts, one micro-batch per batch id."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql.streaming import StreamingQuery

from ledgerspark.plans.ingest import ingest_extract
from ledgerspark.sources.mart import FactFiles, FactTable


def ingest_stream(
    arriving: DataFrame,
    entry: Row,
    *,
    feed: str,
    source_system: str,
    row_key: Column,
    payload: Iterable[str],
    extracted_at: datetime,
    order_by: Iterable[str],
    staging_path: str,
    store: FactFiles | FactTable,
    checkpoint: str,
) -> StreamingQuery:
    """Start the feed for the files that are there now. A replayed micro-batch has the same id, stages
    nothing twice and promotes only unchanged rows, so a restart after a crash is harmless.

    Batches are incremental: a stream never holds a complete extract, so it tombstones nothing.
    """

    def ingest(rows: DataFrame, epoch: int) -> None:
        ingest_extract(
            rows,
            entry,
            source_system=source_system,
            row_key=row_key,
            payload=payload,
            batch_id=f"{feed}-{epoch}",
            extracted_at=extracted_at,
            order_by=order_by,
            staging_path=staging_path,
            store=store,
            full_refresh=False,
        )

    return (
        arriving.writeStream.foreachBatch(ingest)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
