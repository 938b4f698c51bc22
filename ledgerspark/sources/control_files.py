"""Readers of the registry seed, its local additions, the overlay and evidence files."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerspark import schemas
from ledgerspark.fixed_values import UNVERIFIED
from ledgerspark.sources.folders import exists


def _conform(df: DataFrame) -> DataFrame:
    missing = {
        f.name: F.lit(None).cast(f.dataType) for f in schemas.REGISTRY.fields if f.name not in df.columns
    }
    return df.withColumns(missing).select(*schemas.REGISTRY.names)


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """CSV seed, columns found by name. Empty optional cells are NULL; a flag is set only by the exact
    text ``true``."""
    raw = spark.read.options(header=True, mode="FAILFAST").csv(path)
    if "physical_hint" not in raw.columns:
        raw = raw.withColumn("physical_hint", F.lit(None).cast("string"))

    def flag(name: str):
        return F.coalesce(F.col(name) == "true", F.lit(False))

    return _conform(
        raw.withColumns(
            {
                "financial_year": F.nullif("financial_year", F.lit("")),
                "physical_hint": F.nullif("physical_hint", F.lit("")),
                "date_from": F.to_date("date_from", "yyyy-MM-dd"),
                "date_to": F.to_date("date_to", "yyyy-MM-dd"),
                "is_current": flag("is_current"),
                "is_auto_refresh": flag("is_auto_refresh"),
                "authoritative": flag("authoritative"),
            }
        )
    )


def read_registry_additions(spark: SparkSession, path: str) -> DataFrame:
    """JSON list of added entries. Whatever the file says, they are unverified and authoritative."""
    if not exists(spark, path):
        return spark.createDataFrame([], schemas.REGISTRY)
    return _additions(spark.read.schema(schemas.ADDITIONS_JSON).options(multiLine=True, mode="FAILFAST").json(path))


def _additions(raw: DataFrame) -> DataFrame:
    return _conform(
        raw.withColumns(
            {
                "date_from": F.to_date("date_from", "yyyy-MM-dd"),
                "date_to": F.to_date("date_to", "yyyy-MM-dd"),
                "is_current": F.coalesce("is_current", F.lit(False)),
                "is_auto_refresh": F.coalesce("is_auto_refresh", F.lit(False)),
                "status": F.lit(UNVERIFIED),
                "authoritative": F.lit(True),
            }
        )
    )


def read_overlay(spark: SparkSession, path: str) -> DataFrame | None:
    """JSON object by registry key, one row per key; None if there is no file."""
    if not exists(spark, path):
        return None
    kind = f"map<string,{schemas.OVERLAY_VALUE.simpleString()}>"
    whole = spark.read.text(path, wholetext=True)
    parsed = F.from_json("value", kind, {"mode": "FAILFAST"})
    return whole.select(F.explode(parsed).alias("registry_key", "record")).select("registry_key", "record.*")


def read_evidence(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Rows of a captured evidence list with their 0-based index and the time of capture.

    The file is one JSON document ``{discovered_at, list: {rows: [...]}}``.
    """
    row = ",".join(f"`{c}`:string" for c in columns)
    kind = f"struct<discovered_at:string,list:struct<rows:array<struct<{row}>>>>"
    doc = spark.read.text(path, wholetext=True).select(F.from_json("value", kind).alias("doc"))
    if doc.filter(F.col("doc.list.rows").isNotNull()).isEmpty():
        raise ValueError("not an evidence document: list.rows is missing")
    return doc.select(
        F.col("doc.discovered_at").alias("discovered_at"), F.posexplode("doc.list.rows").alias("row_index", "row")
    ).select("row_index", "discovered_at", "row.*")


def read_evidence_lines(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Rows of evidence written as JSON lines (``write_evidence``): row_index, discovered_at, the columns as text, corrupt.

    Any number of tasks read the files. ``row_index`` counts the lines that are not blank over all files in the order of their
    names, from 0, and does not depend on how the files are split. A line that is no JSON object keeps its index, has no
    cells, and is given in ``corrupt``; NULL for the others.
    """
    lines = numbered_lines(spark, path)
    fields = ",".join(f"`{c}` string" for c in dict.fromkeys([*columns, "discovered_at", "_corrupt"]))
    parsed = lines.select("row_index", F.from_json("value", fields, {"columnNameOfCorruptRecord": "_corrupt"}).alias("row"))
    shown = [F.col("row")[c].alias(c) for c in columns]
    return parsed.select("row_index", F.col("row.discovered_at").alias("discovered_at"), *shown, F.col("row._corrupt").alias("corrupt"))


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files with the place of each: file, block (where its split begins), at (order inside the split)."""
    return spark.read.text(path, lineSep="\n").select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.col("_metadata.file_size").alias("size"),
        F.monotonically_increasing_id().alias("at"),  # only its order inside a split is used, and that is the order of the file
    )


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``row_index, value`` of all lines that are not blank, numbered from 0 by file name and place.

    Lines are numbered inside their split, and splits by a running sum of their counts, one row each.
    """
    lines = _lines(spark, path).filter("trim(value) <> ''")
    before = W.orderBy("file", "block").rowsBetween(W.unboundedPreceding, -1)
    counts = lines.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"))
    offsets = counts.select("file", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = F.row_number().over(W.partitionBy("file", "block").orderBy("at"))
    placed = lines.withColumn("_place", inside).join(offsets, ["file", "block"])
    return placed.select((F.col("offset") + F.col("_place") - 1).cast("bigint").alias("row_index"), "value")


WHOLE_BYTES = 256 << 20  # larger files are not held as one value


def artifact_digests(spark: SparkSession, path: str, *, whole_bytes: int = WHOLE_BYTES) -> DataFrame:
    """SHA-256 and length of every file under ``path``: path, artifact_sha256, length.

    Files up to ``whole_bytes`` are hashed as one value each. Larger ones are read in many tasks as raw pieces between line feeds, and
    each is hashed by one task that streams its pieces in order; a file of any length needs the memory of its longest piece.
    """
    files = spark.read.format("binaryFile").load(path)
    small = files.filter(F.col("length") <= whole_bytes).select("path", F.sha2("content", 256).alias("artifact_sha256"), "length")
    large = [r.path for r in files.filter(F.col("length") > whole_bytes).select("path").collect()]
    return small.unionByName(_streamed_digests(spark, large)) if large else small


BOM = b"\xef\xbb\xbf"  # a reader of lines leaves it out


def _streamed_digests(spark: SparkSession, paths: list[str]) -> DataFrame:
    lines = _lines(spark, paths).withColumn("value", F.col("value").cast("binary"))
    seen = lines.groupBy("file").agg((F.sum(F.octet_length("value").cast("bigint")) + F.count(F.lit(1)) - 1).alias("seen"))
    ordered = lines.join(F.broadcast(seen), "file").repartition("file").sortWithinPartitions("file", "block", "at")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, digest, left_out, size, done = None, None, 0, 0, []

        def close() -> None:
            if current is not None:
                digest.update(b"\n" if left_out in (1, 4) else b"")  # the last line feed
                done.append((current, digest.hexdigest(), size))

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("file", "value", "size", "seen")]
            for file, value, length, seen in zip(*columns):
                if file != current:
                    close()
                    current, size, left_out = file, length, length - seen
                    digest = hashlib.sha256(BOM if left_out >= 3 else b"")
                else:
                    digest.update(b"\n")
                digest.update(value)
        close()
        columns = [pa.array([d[i] for d in done], k) for i, k in enumerate((pa.string(), pa.string(), pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, ["path", "artifact_sha256", "length"])

    return ordered.select("file", "value", "size", "seen", "block", "at").mapInArrow(hashed, "path string, artifact_sha256 string, length long")


def read_additions_lines(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Added entries as JSON lines: the entries, unverified and authoritative, and the lines that are none.

    Violations: row_index, violation (``CORRUPT``, ``MISSING:column`` or ``BAD_DATE:column``), line. No line stops the others.
    """
    kind = T.StructType([*schemas.ADDITIONS_JSON.fields, T.StructField("_corrupt", T.StringType())])
    lines = numbered_lines(spark, path).select("row_index", "value", _parsed(kind).alias("record"))
    row = F.col("record")
    needed = ("source_type", "logical_cube_name", "copy_id", "date_from", "date_to")
    fault = F.coalesce(
        F.when(row["_corrupt"].isNotNull(), "CORRUPT"),
        *[F.when(row[c].isNull(), f"MISSING:{c}") for c in needed],
        *[F.when(F.try_to_date(row[c], "yyyy-MM-dd").isNull(), f"BAD_DATE:{c}") for c in ("date_from", "date_to")],
    )
    judged = lines.withColumn("violation", fault)
    fine = judged.filter("violation is null").select("record.*").drop("_corrupt")
    return _additions(fine), judged.filter("violation is not null").select("row_index", "violation", F.col("value").alias("line"))


def read_overlay_lines(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """An overlay as JSON lines, each a record with its ``registry_key``: the overlay, and the lines that are none.

    Violations as in ``read_additions_lines``, and ``REPEATED_KEY`` for every line of a key that has several.
    """
    kind = T.StructType([T.StructField("registry_key", T.StringType()), *schemas.OVERLAY_VALUE.fields, T.StructField("_corrupt", T.StringType())])
    lines = numbered_lines(spark, path).select("row_index", "value", _parsed(kind).alias("record"))
    row = F.col("record")
    fault = F.coalesce(F.when(row["_corrupt"].isNotNull(), "CORRUPT"), F.when(row["registry_key"].isNull(), "MISSING:registry_key"))
    judged = lines.withColumn("violation", fault).withColumn("_key", F.when(F.col("violation").isNull(), row["registry_key"]))
    # Only keys are grouped, and only those of several lines come back, so the lines themselves are not shuffled by key.
    repeated = judged.filter("_key is not null").groupBy("_key").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    judged = judged.join(repeated, "_key", "left").withColumn("violation", F.when(F.col("_n") > 1, "REPEATED_KEY").otherwise(F.col("violation")))
    overlay = judged.filter("violation is null").select("record.*").drop("_corrupt")
    return overlay, judged.filter("violation is not null").select("row_index", "violation", F.col("value").alias("line"))


def _parsed(kind: T.StructType) -> Column:
    return F.from_json("value", kind, {"columnNameOfCorruptRecord": "_corrupt"})
