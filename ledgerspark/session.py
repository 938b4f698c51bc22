"""Session settings and the shared folder that intermediate tables are written to."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_BYTES = 64 << 20
COMPACT = "zstd"  # codec of tables that stay or are large: half the size of snappy's where hashes and texts fill them
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(app: str = "ledgerspark", cpus: int | str = "*", memory: str = "8g") -> SparkSession:
    """A session for tests and the local bench. A cluster brings its own session."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")  # no stack capture per column
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder. Only a local master may fall back to a temporary one,
    because executors on other machines could not read it."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="ledgerspark-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def _write_aside(df: DataFrame, label: str, codec: str | None = None) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path), path


def durable(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and go on from the files.

    Cuts the lineage between batches, lets several consumers share one computation, and survives
    the loss of executors. Parquet keeps column pruning for the readers.
    """
    table, path = _write_aside(df, label)
    held = _held.get()
    if held is not None:
        held.append(path)
    return table


_held: ContextVar[list[str] | None] = ContextVar("tables to remove", default=None)


@contextmanager
def temporary_tables() -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Removes at its end every table that ``durable`` wrote inside it. Gives a function like ``durable`` whose tables stay: what
    is returned may read only those."""
    paths: list[str] = []
    token = _held.set(paths)
    try:
        yield lambda df, label: _write_aside(df, label)[0]
    finally:
        _held.reset(token)
        for path in paths:
            _remove(SparkSession.active(), path)


def _remove(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def written_aside(df: DataFrame, label: str) -> Iterator[DataFrame]:
    """``durable`` for the length of a job; its files are removed at the end."""
    table, path = _write_aside(df, label, COMPACT)
    try:
        yield table
    finally:
        _remove(df.sparkSession, path)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Queries run inside it remove their shuffle files as they end. Else these stay until the driver collects its garbage."""
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(SHUFFLE_CLEANUP) if before is None else spark.conf.set(SHUFFLE_CLEANUP, before)


def fits_broadcast(df: DataFrame, rows: int, size: int = BROADCAST_BYTES) -> bool:
    """True if ``df`` has no more than ``rows`` rows and, written as JSON, no more than ``size`` bytes.

    The count comes first: on files it reads no column, and only a short table is measured.
    """
    if df.count() > rows:
        return False
    text = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))
    return (df.agg(F.sum(F.octet_length(text))).head()[0] or 0) <= size
