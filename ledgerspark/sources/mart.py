"""Tables of the mart: staging snapshots, fact versions, reconciliation runs, captured evidence."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterable
from dataclasses import dataclass
from datetime import datetime
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerspark import schemas
from ledgerspark.fixed_values import IDENTITY, IDENTITY_KEY, TOTAL
from ledgerspark.operators.identity import scope_id
from ledgerspark.operators.promotion import new_staging_rows
from ledgerspark.session import COMPACT
from ledgerspark.sources.folders import age_seconds, exists, names_in, read_small, remove, rename_new, write_small
from ledgerspark.sources.places import MAX_BITMAPS, PLACE, at_places, with_places


MAX_NAMED_MARKS = 1000


def read_staging(spark: SparkSession, path: str) -> DataFrame:
    if not exists(spark, path):
        return spark.createDataFrame([], schemas.STAGING)
    return spark.read.schema(schemas.STAGING).parquet(path)


def _fresh(staged: DataFrame, before: int, batch: DataFrame, order_by: Iterable[str]) -> DataFrame | None:
    """``new_staging_rows``, or None if every row is staged. Whole rows are shuffled only where that can matter.

    Rows whose key has a hash of its own among the batch and what is staged are new as they are. The others, as hashes may also
    meet by chance, are compared by their keys.
    """
    key = [*IDENTITY_KEY, "extract_batch_id"]
    mark = F.xxhash64(*key)
    marks = batch.select(mark.alias("mark"))
    if before:
        if batch.select(*key).join(staged.select(*key), key, "left_anti").head() is None:
            return None
        marks = marks.union(staged.select(mark.alias("mark")))
    met = marks.groupBy("mark").count().filter("count > 1").limit(MAX_NAMED_MARKS + 1).collect()
    if not met:
        return batch
    if len(met) > MAX_NAMED_MARKS:
        return new_staging_rows(staged, batch, order_by=order_by)
    doubtful = mark.isin([r.mark for r in met])
    return batch.filter(~doubtful).unionByName(new_staging_rows(staged, batch.filter(doubtful), order_by=order_by))


def stage_append(batch: DataFrame, path: str, *, payload: Iterable[str], order_by: Iterable[str]) -> int:
    """Append the rows of one batch that are not staged yet and return their number.

    ``batch`` is an ``as_batch`` result plus the ``order_by`` columns, read more than once. Only the folder of the batch
    is read back, so a resubmission is checked without touching the history. A run that dies after
    writing some files is repaired by running it again.
    """
    spark = batch.sparkSession
    ids = [r[0] for r in batch.select("extract_batch_id").distinct().limit(2).collect()]
    if len(ids) > 1:
        raise ValueError("one batch at a time")
    if not ids:
        return 0
    staged = read_staging(spark, path).filter(F.col("extract_batch_id") == ids[0])
    before = staged.count()
    fresh = _fresh(staged, before, batch, list(order_by))
    if fresh is None:
        return 0
    record = F.to_json(F.struct(*sorted(payload)), {"ignoreNullFields": "false"})
    year = F.col("source_financial_year") if "source_financial_year" in batch.columns else F.lit(None).cast("string")
    (
        fresh.select(
            *IDENTITY,
            year.alias("source_financial_year"),
            "extract_batch_id",
            "extracted_at",
            "row_hash",
            record.alias("payload"),
        )
        .write.mode("append")
        .partitionBy("extract_batch_id")
        .parquet(path, compression=COMPACT)
    )
    return read_staging(spark, path).filter(F.col("extract_batch_id") == ids[0]).count() - before


def _with_scope_id(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField("scope_id", T.StringType())])


class ConcurrentChange(RuntimeError):
    """Another job has replaced one of the same scopes since the facts were read; nothing was changed."""


def _scopes_in(spark: SparkSession, folder: str) -> list[str]:
    return [n.removeprefix("scope_id=") for n in names_in(spark, folder) if n.startswith("scope_id=")]


class Pieces(NamedTuple):
    """The generations that hold rows of a scope: all of a generation's rows count, or of all but ``kept`` those that ``kept`` lists."""

    generations: tuple[str, ...]
    kept: str = ""
    bitmaps: int = 0

    @classmethod
    def of(cls, shown: str | list) -> Pieces:
        return cls((shown,)) if isinstance(shown, str) else cls(tuple(shown[0]), *shown[1:])

    def shown(self) -> str | list:
        return list(self) if self.kept else self.generations[0]

    def folders(self, scope: str, *, listed: bool) -> list[str]:
        """Those of which all rows count, or those of which a list says which ones do."""
        return [f"generation={g}/scope_id={scope}" for g in self.generations if listed == (self.kept not in ("", g))]


#: Where a fact stands in the files, and when it was tombstoned since it was written there.
STANDING = ("_generation", *PLACE, "_mark")
LISTED = "_generation string, _mark timestamp, _file string, _block long, _bits binary, scope_id string"


@dataclass(frozen=True)
class FactFiles:
    """Facts as Parquet files, and a manifest that says which files count.

    ``data/generation=<id>/scope_id=<id>`` holds what one job wrote for one scope and is never changed. ``manifest/<n>.json``
    names the generations of every scope; the highest number is the current version. A job may write the rows that are new or changed only:
    ``kept/generation=<id>/scope_id=<id>`` then lists, as bitmaps of places, the rows of earlier generations that still stand, and which of
    them were tombstoned since. A job writes its generation aside, then
    renames one small manifest into place: readers see all of its scopes or none, and a death before that leaves the
    facts as they were. A reader pins a version, so that writers do not disturb it. Two jobs that started from the same
    version both come through if they touched other scopes; else the later one fails with ``ConcurrentChange``.
    A manifest has one short line per scope, and a scope is one source of the registry.
    """

    path: str
    schema: T.StructType = schemas.FACT

    def _manifest(self, number: int) -> str:
        return f"{self.path}/manifest/{number:010d}.json"

    def versions(self, spark: SparkSession) -> list[int]:
        found = (n.removesuffix(".json") for n in names_in(spark, f"{self.path}/manifest") if n.endswith(".json"))
        return sorted(int(n) for n in found if n.isdigit())

    def current(self, spark: SparkSession) -> int:
        """Number of the current version, 0 before the first."""
        return max(self.versions(spark), default=0)

    def pointers(self, spark: SparkSession, version: int) -> dict[str, Pieces]:
        """Where the rows of each scope are in a version."""
        shown = json.loads(read_small(spark, self._manifest(version))) if version else {}
        return {s: Pieces.of(p) for s, p in shown.items()}

    def read(self, spark: SparkSession, version: int | None = None, *, placed: bool = False) -> DataFrame:
        """All facts of a version (the current one, if none is named) with their ``scope_id``, and on demand where they stand."""
        if version and version not in self.versions(spark):
            raise LookupError(f"no fact version {version}")
        pinned = sorted(self.pointers(spark, self.current(spark) if version is None else version).items())
        whole = [f for s, p in pinned for f in p.folders(s, listed=False)]
        listed = [f for s, p in pinned for f in p.folders(s, listed=True)]
        if not listed:
            return self._files(spark, whole, placed=placed)
        lists = [f"{self.path}/kept/generation={p.kept}/scope_id={s}" for s, p in pinned if p.kept]
        bits = spark.read.schema(LISTED).option("basePath", f"{self.path}/kept").parquet(*lists)
        rows = self._standing(spark, listed, bits, small=sum(p.bitmaps for _, p in pinned) <= 4 * MAX_BITMAPS)
        rows = rows if placed else rows.drop(*STANDING)
        return rows.unionByName(self._files(spark, whole, placed=placed)) if whole else rows

    def _files(self, spark: SparkSession, folders: list[str], *, placed: bool = False) -> DataFrame:
        full = _with_scope_id(self.schema)
        if not folders:
            none = spark.createDataFrame([], full)
            return none.selectExpr("*", *[f"cast(null as {k}) as {c}" for c, k in zip(STANDING, ("string", "string", "long", "timestamp"))]) if placed else none
        schema = T.StructType([*full.fields, T.StructField("generation", T.StringType())]) if placed else full
        reader = spark.read.schema(schema).option("basePath", f"{self.path}/data")
        files = reader.parquet(*[f"{self.path}/data/{f}" for f in folders])
        if not placed:
            return files.select(*full.names)
        placed_files = with_places(files).withColumns({"_generation": F.col("generation"), "_mark": F.lit(None).cast("timestamp")})
        return placed_files.select(*full.names, *STANDING)

    def _standing(self, spark: SparkSession, folders: list[str], bits: DataFrame, *, small: bool = True) -> DataFrame:
        """The listed rows of these folders. A mark tells that a row was tombstoned after it was written."""
        rows = self._files(spark, folders, placed=True).drop("_mark")
        found = at_places(rows, bits, ("scope_id", "_generation"), carry=("_mark",), small=small)
        return found.withColumn("source_deleted_at", F.coalesce("_mark", "source_deleted_at"))

    def standing(self, spark: SparkSession, bits: DataFrame) -> DataFrame:
        """The facts that bitmaps by scope, generation and mark list."""
        found = bits.select("scope_id", "_generation").distinct().collect()
        return self._standing(spark, [f"generation={r._generation}/scope_id={r.scope_id}" for r in found], bits).select(*self.schema.names)

    def rows_stored(self, spark: SparkSession, generations: Iterable[tuple[str, str]]) -> int:
        """Number of rows, whether they still stand or not, in generations of scopes."""
        return self._files(spark, [f"generation={g}/scope_id={s}" for s, g in generations]).count()

    def write_aside(self, facts: DataFrame, *, spread: bool = False) -> str:
        """Write facts, and any further columns, as a new generation that no manifest names yet.

        The rebalance keeps files near the advisory size: it splits a scope that holds much of the data and joins small ones.
        Facts of one scope that a shuffle by their keys has ``spread`` over the tasks need none.
        """
        generation = uuid.uuid4().hex
        named = facts.withColumn("scope_id", scope_id())
        (
            (named if spread else named.hint("rebalance", "scope_id"))
            .write.partitionBy("scope_id")
            .parquet(f"{self.path}/data/generation={generation}", compression=COMPACT)
        )
        return generation

    def keep(self, generation: str, bits: DataFrame) -> None:
        """List the rows of earlier generations that stand beside those of this one, as bitmaps by scope, generation and mark."""
        bits.write.partitionBy("scope_id").parquet(f"{self.path}/kept/generation={generation}", compression=COMPACT)

    def _pieces(self, spark: SparkSession, generation: str) -> dict[str, Pieces]:
        """Where the rows of each scope of a generation are, from its folders and its list."""
        pieces = {s: Pieces((generation,)) for s in _scopes_in(spark, f"{self.path}/data/generation={generation}")}
        listed = f"{self.path}/kept/generation={generation}"
        if _scopes_in(spark, listed):
            by_scope = spark.read.schema(LISTED).parquet(listed).groupBy("scope_id")
            for r in by_scope.agg(F.sort_array(F.collect_set("_generation")).alias("earlier"), F.count(F.lit(1)).alias("n")).collect():
                own = pieces[r.scope_id].generations if r.scope_id in pieces else ()
                pieces[r.scope_id] = Pieces((*own, *r.earlier), generation, r.n)
        return pieces

    def written(self, spark: SparkSession, generation: str, column: str) -> DataFrame:
        """One text column of a generation, also one that the facts do not have."""
        folder = f"{self.path}/data/generation={generation}"
        return spark.read.schema(f"`{column}` string").parquet(folder).select(column)

    def switch(self, spark: SparkSession, generation: str, *, based_on: int | None = None, whole: bool = False) -> int:
        """Make the scopes of a generation current by one rename, and return the number of the new version.

        ``based_on`` is the version that the facts were made from. ``whole`` drops every scope that the generation lacks.
        """
        scopes = self._pieces(spark, generation)
        start = self.current(spark) if based_on is None else based_on
        known = self.pointers(spark, start)
        while True:
            latest = self.current(spark)
            pointers = self.pointers(spark, latest)
            moved = [s for s in (pointers.keys() | known.keys() if whole else scopes) if pointers.get(s) != known.get(s)]
            if moved:
                raise ConcurrentChange(f"version {latest} has other rows than version {start} for scope {moved[0]}")
            aside = f"{self.path}/manifest/_{generation}-{latest}"
            new = {**({} if whole else pointers), **scopes}
            write_small(spark, aside, json.dumps({s: p.shown() for s, p in new.items()}, indent=0, sort_keys=True))
            if rename_new(spark, aside, self._manifest(latest + 1)):
                return latest + 1
            remove(spark, aside)  # another job was faster: look at what it did

    def replace_scopes(self, facts: DataFrame, *, based_on: int | None = None) -> int:
        """Replace the scopes that occur in ``facts`` and leave all others alone. ``facts`` may read from this store."""
        spark = facts.sparkSession
        start = self.current(spark) if based_on is None else based_on
        return self.switch(spark, self.write_aside(facts), based_on=start)

    def replace_all(self, facts: DataFrame) -> int:
        """A whole new version: scopes that ``facts`` lacks are gone from it."""
        spark = facts.sparkSession
        start = self.current(spark)
        return self.switch(spark, self.write_aside(facts), based_on=start, whole=True)

    def vacuum(self, spark: SparkSession, *, keep: int = 2, older_than: float = 86_400) -> list[str]:
        """Remove old manifests but the last ``keep``, and scopes that none of those names; returns what was removed.

        Generations changed within ``older_than`` seconds stay, as a running job may be about to switch to them.
        """
        versions = self.versions(spark)
        kept = versions[max(0, len(versions) - max(1, keep)) :]
        pinned = [(s, p) for v in kept for s, p in self.pointers(spark, v).items()]
        named = {("data", g, s) for s, p in pinned for g in p.generations} | {("kept", p.kept, s) for s, p in pinned}
        gone = [self._manifest(v) for v in versions if v not in kept]
        for top, folder in [(top, n) for top in ("data", "kept") for n in names_in(spark, f"{self.path}/{top}")]:
            at = f"{self.path}/{top}/{folder}"
            if age_seconds(spark, at) < older_than:
                continue
            generation = folder.removeprefix("generation=")
            scopes = _scopes_in(spark, at)
            unused = [s for s in scopes if (top, generation, s) not in named]
            gone += [at] if len(unused) == len(scopes) else [f"{at}/scope_id={s}" for s in unused]
        for path in gone:
            remove(spark, path)
        return gone


@dataclass(frozen=True)
class FactTable:
    """Facts as a catalog table, one partition per scope, bucketed and sorted by row key.

    Promotion within a scope joins on the row key, so the stored facts, by far the larger side, are
    read in place: only the batch is shuffled. Row keys are unique, so buckets stay even however much
    of the data one scope holds. Choose the number of buckets for the largest scope.

    A job writes a generation of bucketed files aside and then points the partition of each scope to it in the catalog: a
    scope has its old rows or its new ones, never a part of them. Many scopes are switched one after the other.
    """

    name: str
    path: str
    buckets: int
    schema: T.StructType = schemas.FACT

    def create(self, spark: SparkSession) -> None:
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in _with_scope_id(self.schema).fields)
        spark.sql(
            f"create table if not exists {self.name} ({columns}) using parquet partitioned by (scope_id) "
            f"clustered by (source_row_key) sorted by (source_row_key) into {self.buckets} buckets "
            f"location '{self.path}'"
        )

    def current(self, spark: SparkSession) -> None:
        """The catalog keeps no versions."""
        return None

    def read(self, spark: SparkSession, version: None = None) -> DataFrame:
        self.create(spark)
        return spark.table(self.name)

    def write_aside(self, facts: DataFrame, *, spread: bool = False) -> str:
        """Write facts, and any further columns, as bucketed files outside the table; one task writes one bucket."""
        spark, generation = facts.sparkSession, uuid.uuid4().hex
        self.create(spark)
        aside = f"{self.name}_{generation}"
        (
            facts.withColumn("scope_id", scope_id())
            .repartition(self.buckets, "source_row_key")
            .write.partitionBy("scope_id")
            .bucketBy(self.buckets, "source_row_key")
            .sortBy("source_row_key")
            .option("path", f"{self.path}-data/generation={generation}")
            .saveAsTable(aside)
        )
        spark.sql(f"drop table {aside}")  # an external table: its files stay
        return generation

    def written(self, spark: SparkSession, generation: str, column: str) -> DataFrame:
        """One text column of a generation, also one that the facts do not have."""
        return spark.read.schema(f"`{column}` string").parquet(f"{self.path}-data/generation={generation}").select(column)

    def switch(self, spark: SparkSession, generation: str, *, based_on: None = None) -> None:
        """Point the partitions of the scopes of a generation to it."""
        folder = f"{self.path}-data/generation={generation}"
        for scope in _scopes_in(spark, folder):
            where = f"partition (scope_id = '{scope}')"
            spark.sql(f"alter table {self.name} add if not exists {where} location '{folder}/scope_id={scope}'")
            spark.sql(f"alter table {self.name} {where} set location '{folder}/scope_id={scope}'")

    def replace_scopes(self, facts: DataFrame, *, based_on: None = None) -> None:
        """Replace the scopes that occur in ``facts`` and leave all others alone."""
        self.switch(facts.sparkSession, self.write_aside(facts))


def fact_versions(spark: SparkSession, base: str) -> list[int]:
    """Numbers of the versions under ``base``; what an unfinished job wrote is none."""
    return FactFiles(base).versions(spark)


def write_fact_version(facts: DataFrame, base: str) -> int:
    """Write a whole new version aside; it becomes current the moment its manifest is renamed into place."""
    return FactFiles(base, facts.schema).replace_all(facts)


def read_fact_version(spark: SparkSession, base: str, number: int | None = None, schema=schemas.FACT) -> DataFrame:
    """The current version, or the one asked for."""
    return FactFiles(base, schema).read(spark, number)


def append_recon_run(results: DataFrame, path: str, run_at: datetime, run_id: str | None = None) -> None:
    """Add reconciliation results to the run table in its fixed schema. A total that does not fit it exactly fails the job.

    A run is one folder, named by ``run_id`` (its time, if none is given). It is written aside and renamed into place as a whole, so a
    reader sees all of it or nothing. A run that is done again, after a failure or with other results, becomes the next attempt of
    the same run: readers go from the old one to the new one, and never see both or neither.
    """
    spark = results.sparkSession
    run_id = run_id or run_at.strftime("%Y%m%dT%H%M%S%f")
    if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9_.-]*", run_id):
        raise ValueError(f"not a run id: {run_id!r}")

    def exact(name: str) -> Column:
        value, stored = F.col(name), F.col(name).cast(TOTAL)
        return F.when(value.isNull() | (value == stored), stored).otherwise(F.raise_error(F.lit(f"{name} has more than two decimals")))

    aside = f"{path}/_writing-{uuid.uuid4().hex}"
    results.select(
        F.lit(run_at).cast("timestamp").alias("run_at"),
        "scope",
        "check_name",
        exact("source").alias("source_value"),
        exact("mart").alias("mart_value"),
        exact("kpi").alias("kpi_value"),
        "explanation",
        "passed",
    ).write.parquet(aside)
    number = _attempts(spark, path).get(run_id, 0) + 1
    while not rename_new(spark, aside, f"{path}/{run_id}@{number}"):
        number += 1  # the same run in another job
    for old in range(1, number):
        remove(spark, f"{path}/{run_id}@{old}")


def _attempts(spark: SparkSession, path: str) -> dict[str, int]:
    """Last attempt of each stored run; folders are named ``run@attempt``."""
    found: dict[str, int] = {}
    for name in names_in(spark, path):
        run_id, _, number = name.rpartition("@")
        if number.isdigit() and not name.startswith("_"):
            found[run_id] = max(found.get(run_id, 0), int(number))
    return found


def read_recon_runs(spark: SparkSession, path: str, run_id: str | None = None) -> DataFrame:
    """All runs, or one of them: the last attempt of each. What an unfinished job wrote is not read."""
    runs = {k: n for k, n in _attempts(spark, path).items() if run_id in (None, k)}
    if not runs:
        return spark.createDataFrame([], schemas.RECON_RUN)
    return spark.read.schema(schemas.RECON_RUN).parquet(*[f"{path}/{k}@{n}" for k, n in sorted(runs.items())])


def write_evidence(rows: DataFrame, path: str, *, order_by: Iterable[str] = (), discovered_at: datetime | None = None) -> None:
    """Captured rows or a profile as JSON lines, NULL fields kept.

    ``order_by`` sorts the rows over all files, so that ``read_evidence_lines`` gives them the index of their rank. ``discovered_at`` is
    written into each line.
    """
    if discovered_at is not None:
        rows = rows.withColumn("discovered_at", F.lit(discovered_at.isoformat()))
    order_by = list(order_by)
    (rows.orderBy(*order_by) if order_by else rows).write.option("ignoreNullFields", "false").json(path)
