"""Open a confirmed physical source as a DataFrame."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ledgerspark.fixed_values import SHARED_DISCRIMINATOR
from ledgerspark.functions.text import column, trim_char
from ledgerspark.operators.registry import require_names, require_physical

Opener = Callable[[SparkSession, Row], DataFrame]


def files_under(root: str, file_format: str = "parquet") -> Opener:
    """Objects are folders or files ``root/<object name>`` in one format."""
    return lambda spark, p: spark.read.format(file_format).load(f"{root.rstrip('/')}/{p.object_name}")


def quoted(name: str) -> str:
    """A name in back quotes; one inside is doubled."""
    return "`" + name.replace("`", "``") + "`"


def catalog_table() -> Opener:
    """Objects are tables ``owner.object_name`` of the Spark catalog."""
    return lambda spark, p: spark.table(f"{quoted(p.owner)}.{quoted(p.object_name)}")


def jdbc_options(
    url: str, physical: Row, *, partition_column: str | None = None, lower=None, upper=None, partitions: int = 1,
    single_task: bool = False, **extra: str,
) -> Mapping[str, str]:
    """Reader options of a database object, split into ranges of a partition column.

    Reading a whole table in one task must be asked for with ``single_task``.
    """
    require_names(physical)
    if partition_column is None and not single_task:
        raise ValueError("name a partition column with bounds, or ask for a single task")
    options = {"url": url, "dbtable": f"{physical.owner}.{physical.object_name}", "fetchsize": "10000", **extra}
    if partition_column is not None:
        if lower is None or upper is None:
            raise ValueError("a partitioned read needs both bounds")
        options |= {
            "partitionColumn": partition_column,
            "lowerBound": str(lower),
            "upperBound": str(upper),
            "numPartitions": str(partitions),
        }
    return options


def jdbc_object(url: str, **options) -> Opener:
    """Objects are tables or views of a database."""
    return lambda spark, p: spark.read.format("jdbc").options(**jdbc_options(url, p, **options)).load()


def discriminator_filter(df: DataFrame, name: str, value: str) -> DataFrame:
    """``name = value`` with the value as a literal, so the source filters and no text is spliced."""
    real = {c.upper(): c for c in df.columns}
    if name.upper() not in real:
        raise LookupError(f"discriminator column {name} not found")
    return df.filter(column(real[name.upper()]) == F.lit(value))


def upper_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.upper() for c in df.columns])


def read_source(spark: SparkSession, entry: Row, opener: Opener, *, trim: bool = False) -> DataFrame:
    """Rows of a registry entry with upper-case names. An unconfirmed entry raises before any read."""
    physical = require_physical(entry)
    require_names(physical, files=True)
    df = opener(spark, physical)
    if physical.access_mode == SHARED_DISCRIMINATOR:
        df = discriminator_filter(df, physical.discriminator_column, physical.discriminator_value)
    df = upper_names(df)
    return trim_char(df) if trim else df
