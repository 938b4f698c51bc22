import random
from datetime import date, datetime
from decimal import Decimal as D

import pyarrow.parquet as pq
import pytest
from helpers import plan, rows
from pyspark.sql import Row
from pyspark.sql import functions as F

from ledgerspark.fixed_values import IDENTITY, SCOPE
from ledgerspark.operators import identity, promotion as P
from ledgerspark.operators.registry import UnresolvedSource
from ledgerspark.plans.queries import REGISTERED
from ledgerspark.plans import ingest as plan_of_ingest
from ledgerspark.plans.ingest import concerned_facts, fact_schema, ingest_extract, promote_into
from ledgerspark.sources import mart, places

T1, T2, T3 = datetime(2025, 1, 1), datetime(2025, 2, 1), datetime(2025, 3, 1)
A = ("SYS", "OWN", "T_A", "15", "", "")
B = ("SYS", "OWN", "T_B", "27", "", "")
S1 = ("SYS", "OWN", "T_ALL", "X", "NAME", "PART_A")
S2 = ("SYS", "OWN", "T_ALL", "X", "NAME", "PART_B")


def scope(values):
    return dict(zip(SCOPE, values))


def batch(spark, items, batch_id="b", at=T1):
    schema = ", ".join(f"{c} string" for c in IDENTITY) + ", debit decimal(20,2), credit decimal(20,2)"
    df = spark.createDataFrame([(*s, k, D(v), D(0)) for s, k, v in items], schema)
    return P.as_batch(df, payload=["debit", "credit"], batch_id=batch_id, extracted_at=at)


class Store:
    """Facts carried from batch to batch, checked the way the ingest plan checks them."""

    def __init__(self, spark, small=False):
        self.spark, self.facts, self.small = spark, None, small

    def promote(self, items, batch_id, at=T1, full=None):
        incoming = batch(self.spark, items, batch_id, at)
        self.facts = P.empty_facts(incoming) if self.facts is None else self.facts
        P.check_batch(incoming, scope(full) if full else None)
        merged = P.promote(self.facts, incoming, extracted_at=at, full_refresh_scope=scope(full) if full else None,
                           small_batch=self.small)
        counts = {r.outcome: r.n for r in P.promotion_counts(merged).collect() if r.n}
        schema = merged.drop("outcome").schema
        self.facts = self.spark.createDataFrame(P.facts_after(merged).collect(), schema)
        return counts

    def total(self, column="debit"):
        return P.fact_total(self.facts, column).head()[0]


def test_repeated_and_renumbered_batches_change_nothing(spark):
    s = Store(spark)
    items = [(A, str(i), "10") for i in range(5)]
    assert s.promote(items, "b1") == {"inserted": 5}
    assert s.promote(items, "b1") == {"unchanged": 5} and s.total() == D(50)
    assert s.promote(items, "b2") == {"unchanged": 5} and s.total() == D(50)
    assert {r.extract_batch_id for r in s.facts.collect()} == {"b1"}  # unchanged rows keep their batch


def test_changed_row_updates(spark):
    s = Store(spark)
    s.promote([(A, "1", "10")], "b1")
    assert s.promote([(A, "1", "12")], "b2") == {"updated": 1} and s.total() == D(12)
    assert s.facts.head().extract_batch_id == "b2"


def test_same_key_in_two_copies_is_two_facts(spark):
    s = Store(spark)
    assert s.promote([(A, "1", "100"), (B, "1", "100"), (S1, "1", "3"), (S2, "1", "3")], "b1") == {"inserted": 4}
    assert s.total() == D(206)


def test_tombstones_stay_in_scope(spark):
    s = Store(spark)
    s.promote([(B, "1", "5"), (B, "2", "5"), (A, "1", "7")], "b1")
    assert s.promote([(B, "1", "5")], "b2", T2, full=B) == {"unchanged": 1, "tombstoned": 1}
    assert s.total() == D(12)
    dead = s.facts.filter("source_deleted_at is not null").head()
    assert (dead.source_row_key, dead.source_deleted_at, dead.debit, dead.extract_batch_id) == ("2", T2, D(5), "b1")


def test_tombstone_scope_includes_discriminator(spark):
    s = Store(spark)
    s.promote([(S1, "1", "5"), (S2, "1", "5")], "b1")
    assert s.promote([], "b2", T2, full=S1) == {"tombstoned": 1} and s.total() == D(5)
    assert s.promote([], "b3", T3, full=S1) == {}  # already deleted: no outcome, mark kept
    assert s.facts.filter(F.col("source_deleted_at") == T2).count() == 1


def test_revival_counts_as_revived_same_or_changed(spark):
    s = Store(spark)
    s.promote([(B, "1", "5"), (B, "2", "5")], "b1")
    assert s.promote([], "b2", full=B) == {"tombstoned": 2} and s.total() == 0
    assert s.promote([(B, "1", "5"), (B, "2", "6")], "b3") == {"revived": 2} and s.total() == D(11)
    assert {r.extract_batch_id for r in s.facts.collect()} == {"b3"}


def test_incremental_batch_tombstones_nothing(spark):
    s = Store(spark)
    s.promote([(A, "1", "5"), (A, "2", "5")], "b1")
    assert s.promote([(A, "3", "1")], "b2") == {"inserted": 1} and s.total() == D(11)


def test_bad_batches_are_rejected_whole(spark):
    s = Store(spark)
    s.promote([(A, "1", "5")], "b1")
    before = rows(s.facts)
    with pytest.raises(P.BatchRejected, match="more than once"):
        s.promote([(A, "9", "1"), (A, "2", "1"), (A, "2", "1")], "b2")
    with pytest.raises(P.BatchRejected, match="another scope"):
        s.promote([(A, "9", "1"), (B, "1", "1")], "b2", full=B)
    with pytest.raises(P.BatchRejected, match="identity"):
        s.promote([(A, " ", "1")], "b2")
    assert rows(s.facts) == before


def test_stray_row_fails_the_promotion_itself(spark):
    incoming = batch(spark, [(A, "1", "1"), (B, "1", "1")])
    merged = P.promote(P.empty_facts(incoming), incoming, extracted_at=T1, full_refresh_scope=scope(B))
    with pytest.raises(Exception, match="outside the scope"):
        merged.collect()


def test_identity_violations(spark):
    schema = ", ".join(f"{c} string" for c in IDENTITY)
    bad = [("s", "o", "t", "c", None, None, "k"), ("s", "o", "t", "c", "COL", "", "k"), ("s", "o", "t", "c", "", "v", "k"),
           ("s", "o", "t", "c", "", "", "\t "), ("s", "o", None, "c", "", "", "k"), ("s", "o", "t", "c", "COL", "v", "ok"),
           ("s", "o", "t", "c", "", "", "ok")]
    df = spark.createDataFrame(bad, schema)
    assert sorted(r.violation for r in identity.identity_violations(df).collect()) == [
        "BLANK:source_object", "BLANK:source_row_key", "DISCRIMINATOR_HALF_SET", "DISCRIMINATOR_HALF_SET", "DISCRIMINATOR_NULL"]


def entry(copy="27", name="T_B", disc=(None, None), status="CONFIRMED", mode="SEPARATE_OBJECT"):
    physical = Row(owner="OWN", object_name=name, object_type="TABLE", access_mode=mode,
                   discriminator_column=disc[0], discriminator_value=disc[1])
    return Row(source_type="SITE", logical_cube_name="C", copy_id=copy, financial_year="FY24-25", status=status, physical=physical)


def test_with_identity(spark):
    df = spark.createDataFrame([(7,)], "id int")
    got = identity.with_identity(df, entry(), F.col("id"), "SYS").select(*IDENTITY).head()
    assert tuple(got) == ("SYS", "OWN", "T_B", "27", "", "", "7")
    shared = entry("X", "T_ALL", ("NAME", "PART_A"), mode="SHARED_DISCRIMINATOR")
    assert identity.scope_of(shared, "SYS") == scope(S1)
    with pytest.raises(UnresolvedSource):
        identity.with_identity(df, entry(status="UNVERIFIED"), F.col("id"), "SYS")


def test_scope_id_of_rows_and_of_constants_agree(spark):
    df = batch(spark, [(S1, "1", "1"), (A, "1", "1")])
    for values in (S1, A):
        same = df.filter(identity.in_scope(scope(values))).select(identity.scope_id() == identity.scope_id_of(scope(values)))
        assert same.head()[0]
    assert df.select(identity.scope_id()).distinct().count() == 2


def model(facts, items, batch_id, full):
    """The promotion rules over a dict, one row at a time."""
    counts = {}

    def count(o):
        counts[o] = counts.get(o, 0) + 1

    seen = set()
    for s, k, v in items:
        seen.add((s, k))
        cur = facts.get((s, k))
        if cur is None:
            facts[s, k] = [v, batch_id, False]
            count("inserted")
        elif cur[2]:
            facts[s, k] = [v, batch_id, False]
            count("revived")
        elif D(cur[0]) == D(v):
            count("unchanged")
        else:
            facts[s, k] = [v, batch_id, False]
            count("updated")
    if full:
        for (s, k), cur in facts.items():
            if s == full and (s, k) not in seen and not cur[2]:
                cur[2] = True
                count("tombstoned")
    return counts


@pytest.mark.parametrize("small", [False, True])
def test_random_batches_against_a_row_by_row_model(spark, small):
    rnd, store, facts = random.Random(11), Store(spark, small), {}
    for n in range(6):
        full = rnd.choice([None, A, S1])
        pool = [(s, str(k)) for s in (A, B, S1, S2) for k in range(8) if full in (None, s)]
        items = [(s, k, str(rnd.randrange(3))) for s, k in rnd.sample(pool, rnd.randrange(len(pool)))]
        expected = model(facts, items, f"b{n}", full)
        assert store.promote(items, f"b{n}", full=full) == expected
        assert sum(v for k, v in expected.items() if k != "tombstoned") == len(items)
        got = {(tuple(r[c] for c in SCOPE), r.source_row_key): [str(r.debit), r.extract_batch_id, r.source_deleted_at is not None]
               for r in store.facts.collect()}
        assert got == {k: [f"{v[0]}.00", v[1], v[2]] for k, v in facts.items()}


def test_missing_column_counts_as_zero_and_empty_total_is_zero(spark):
    incoming = batch(spark, [(A, "1", "5")])
    facts = P.facts_after(P.promote(P.empty_facts(incoming), incoming, extracted_at=T1))
    assert tuple(P.fact_total(facts, "debit", "tax").head()) == (D(5), D(0))
    assert tuple(P.fact_total(P.empty_facts(incoming), "debit", "tax").head()) == (D(0), D(0))


def test_payload_is_replaced_as_a_whole(spark):
    first = batch(spark, [(A, "1", "5")]).withColumn("note", F.lit("old"))
    facts = P.facts_after(P.promote(P.empty_facts(first), first, extracted_at=T1))
    changed = batch(spark, [(A, "1", "6")])
    assert P.facts_after(P.promote(facts, changed, extracted_at=T2)).head().note is None
    with pytest.raises(P.BatchRejected, match="colour"):
        P.promote(facts, changed.withColumn("colour", F.lit("red")), extracted_at=T2)
    with pytest.raises(Exception, match="more than once"):
        P.promote(facts, changed.union(changed), extracted_at=T2).collect()


def test_unresolved_sources_keep_their_rows(spark):
    from ledgerspark import schemas

    registry = spark.createDataFrame([], schemas.REGISTRY)
    rows = spark.createDataFrame([("S|C|1", 1), (None, 2)], "source_registry_key string, id int")
    got = identity.with_identity_from_registry(rows, registry, F.col("id"), "SYS")
    assert {(r.source_row_key, r.unresolved) for r in got.collect()} == {("1", "NOT_CONFIRMED"), ("2", "NO_SOURCE")}
    with pytest.raises(Exception, match="NOT_CONFIRMED|NO_SOURCE"):
        identity.with_identity_from_registry(rows, registry, F.col("id"), "SYS", strict=True).collect()


# ---- staging ----


def test_staging_appends_once_keeps_history_and_first_of_repeats(spark, tmp_path):
    path = str(tmp_path / "staging")

    def append(items, batch_id):
        df = batch(spark, items, batch_id).withColumn("seq", F.col("debit"))
        return mart.stage_append(df, path, payload=["debit", "credit"], order_by=["seq"])

    assert append([(A, "1", "2"), (A, "1", "1"), (A, "2", "5")], "b1") == 2
    assert append([(A, "1", "2"), (A, "1", "1"), (A, "2", "5")], "b1") == 0
    assert append([(A, "1", "9"), (A, "3", "4")], "b1") == 1
    assert append([(A, "1", "1")], "b2") == 1
    staged = mart.read_staging(spark, path)
    got = {(r.extract_batch_id, r.source_row_key): r.payload for r in staged.collect()}
    assert len(got) == staged.count() == 4
    assert got["b1", "1"] == '{"credit":0.00,"debit":1.00}'


def test_staging_shuffles_whole_rows_only_where_keys_meet(spark, tmp_path, monkeypatch):
    path, compared = str(tmp_path / "staging"), []

    def new_staging_rows(existing, rows, *, order_by):
        compared.append(sorted(r.source_row_key or "" for r in rows.collect()))
        return P.new_staging_rows(existing, rows, order_by=order_by)

    monkeypatch.setattr(mart, "new_staging_rows", new_staging_rows)

    def append(items, batch_id):
        return mart.stage_append(batch(spark, items, batch_id), path, payload=["debit"], order_by=["debit"])

    assert append([(A, str(i), "1") for i in range(20)], "b1") == 20 and compared == []
    assert append([(A, str(i), "1") for i in range(20)], "b1") == 0 and compared == []
    assert append([(A, "1", "1"), (B, "1", "1"), (A, "x", "7"), (A, "x", "6")], "b1") == 2 and compared == [["1", "x", "x"]]
    assert append([(A, None, "1"), (A, None, "2"), (A, "z", "1")], "b1") == 2  # a null key matches nothing that is staged ...
    assert append([(A, None, "1"), (A, "z", "1")], "b1") == 1
    monkeypatch.setattr(mart, "MAX_NAMED_MARKS", 1)
    assert append([(A, "z", "1"), (A, "w", "1"), (B, "1", "1"), (B, "2", "1"), (B, "2", "0")], "b1") == 2
    got = sorted((r.source_object, r.source_row_key, r.payload) for r in mart.read_staging(spark, path).filter("source_row_key in ('x', '2')").collect())
    assert got == [("T_A", "2", '{"debit":1.00}'), ("T_A", "x", '{"debit":6.00}'), ("T_B", "2", '{"debit":0.00}')]


def test_an_extract_leaves_no_shuffle_files_and_moves_its_facts_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("ledgerspark.plans.ingest.BROADCAST_BATCH_ROWS", 0)
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, seen = spark.conf.get(setting, None), []

    class Store(mart.FactFiles):
        def write_aside(self, facts, **how):
            seen.append((spark.conf.get(setting), how))
            return super().write_aside(facts, **how)

    extract = ledger(spark, [(i, str(i)) for i in range(1, 7)])
    store = Store(str(tmp_path / "facts"), fact_schema(extract, ["entry_date", "debit"]))
    for full in (True, False):
        ingest_extract(extract, entry(), source_system="SYS", row_key=F.col("id"), payload=["entry_date", "debit"], batch_id=f"b{full}", extracted_at=T1,
                       order_by=["source_row_key"], staging_path=str(tmp_path / "stg"), store=store, full_refresh=full)
    assert seen == [("true", {"spread": True}), ("true", {"spread": False})] and spark.conf.get(setting, None) == before
    facts = store.read(spark)
    files = [f for f in facts.inputFiles() if f.endswith(".parquet")]
    assert files and all(f.endswith(".zstd.parquet") for f in files)
    assert facts.count() == 6


def test_staging_reads_only_the_folder_of_its_batch(spark, tmp_path):
    path = str(tmp_path / "staging")
    mart.stage_append(batch(spark, [(A, "1", "2")], "b1"), path, payload=["debit"], order_by=["source_row_key"])
    text = plan(mart.read_staging(spark, path).filter("extract_batch_id = 'b1'"))
    assert "PartitionFilters: [isnotnull(extract_batch_id" in text and "= b1" in text


def test_repeats_are_dropped_before_the_shuffle(spark):
    df = batch(spark, [(A, "1", "2")]).withColumn("seq", F.col("debit"))
    text = plan(P.new_staging_rows(df.limit(0), df, order_by=["seq"]), "simple")
    assert "WindowGroupLimit" in text and "Partial" in text


# ---- stores and the whole ingest ----


def ledger(spark, values):
    return spark.createDataFrame([(i, date(2024, 5, 1), D(v)) for i, v in values], "id int, entry_date date, debit decimal(20,2)")


@pytest.mark.parametrize("kind", ["files", "table"])
def test_ingest_end_to_end(spark, tmp_path, kind):
    extract = ledger(spark, [(i, str(i)) for i in range(1, 7)])
    schema = fact_schema(extract, ["entry_date", "debit"])
    if kind == "files":
        store = mart.FactFiles(str(tmp_path / "facts"), schema)
    else:
        store = mart.FactTable("facts_e2e", str(tmp_path / "facts_t"), 4, schema)

    def run(df, batch_id, at, e=entry(), full=True):
        return ingest_extract(df, e, source_system="SYS", row_key=F.col("id"), payload=["entry_date", "debit"], batch_id=batch_id,
                              extracted_at=at, order_by=["source_row_key"], staging_path=str(tmp_path / "stg"), store=store,
                              full_refresh=full)

    def live():
        return P.fact_total(store.read(spark), "debit").head()[0]

    assert run(extract, "b1", T1)["inserted"] == 6 and live() == 21
    other = entry("15", "T_A")
    assert run(ledger(spark, [(1, "100")]), "o1", T1, other, full=False)["inserted"] == 1 and live() == 121
    again = run(extract, "b1", T1)
    assert again["staged"] == 0 and again["unchanged"] == 6 and live() == 121
    second = run(ledger(spark, [(1, "1"), (2, "20"), (7, "7")]), "b2", T2)
    assert second == {"staged": 3, "inserted": 1, "updated": 1, "unchanged": 1, "tombstoned": 4, "revived": 0}
    assert live() == 128 and store.read(spark).count() == 8
    assert run(ledger(spark, []), "b3", T3)["tombstoned"] == 3 and live() == 100
    with pytest.raises(P.BatchRejected):
        run(ledger(spark, [(1, "1"), (1, "2")]), "b4", T3)
    assert live() == 100
    assert mart.read_staging(spark, str(tmp_path / "stg")).filter("extract_batch_id = 'b2'").head().source_financial_year == "FY24-25"


def test_full_refresh_reads_only_its_partition(spark, tmp_path):
    store = mart.FactFiles(str(tmp_path / "facts"), fact_schema(batch(spark, []), ["debit", "credit"]))
    first = batch(spark, [(A, "1", "1"), (B, "1", "1")])
    promote_into(first, store, extracted_at=T1)
    facts = concerned_facts(store.read(spark), first, scope(B))
    assert len(facts.inputFiles()) >= 1
    text = plan(facts)
    assert "PartitionFilters: [isnotnull(scope_id" in text and "md5" not in text.split("PartitionFilters")[1].split("\n")[0]


def test_bucketed_facts_are_not_shuffled(spark, tmp_path):
    store = mart.FactTable("facts_plan", str(tmp_path / "t"), 8, fact_schema(batch(spark, []), ["debit", "credit"]))
    promote_into(batch(spark, [(B, str(i), "1") for i in range(50)]), store, extracted_at=T1, full_refresh_scope=scope(B))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        incoming = batch(spark, [(B, "1", "1")], "b2")
        facts = concerned_facts(store.read(spark), incoming, scope(B)).drop("scope_id")
        text = plan(P.promote_scope(facts, incoming, scope(B), extracted_at=T2), "simple")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert text.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" in text


def test_small_batch_shuffles_no_fact(spark, tmp_path):
    store = mart.FactFiles(str(tmp_path / "facts"), fact_schema(batch(spark, []), ["debit", "credit"]))
    promote_into(batch(spark, [(B, str(i), "1") for i in range(50)]), store, extracted_at=T1)
    incoming = batch(spark, [(B, "1", "1")], "b2")
    facts = concerned_facts(store.read(spark), incoming, None).drop("scope_id")
    text = plan(P.promote(facts, incoming, extracted_at=T2, small_batch=True), "simple")
    assert "Exchange hashpartitioning" not in text and text.count("BroadcastHashJoin") == 3


def test_a_scope_that_holds_everything_is_split_into_files(spark, tmp_path):
    payload = spark.range(0, 40000, 1, 8).select(
        *[F.lit(v).alias(c) for c, v in scope(B).items()], F.col("id").cast("string").alias("source_row_key"),
        F.lit(D(1)).cast("decimal(20,2)").alias("debit"), F.lit(D(0)).cast("decimal(20,2)").alias("credit"))
    one = P.as_batch(payload, payload=["debit", "credit"], batch_id="b1", extracted_at=T1)
    store = mart.FactFiles(str(tmp_path / "facts"), P.empty_facts(one).schema)
    size, floor = "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.coalescePartitions.minPartitionSize"
    spark.conf.set(size, "50k")
    spark.conf.set(floor, "20k")  # all sizes are scaled down: a rebalance splits by the tasks that feed it
    try:
        store.replace_scopes(P.facts_after(P.promote(P.empty_facts(one), one, extracted_at=T1)))
    finally:
        spark.conf.unset(size)
        spark.conf.unset(floor)
    stored = store.read(spark)
    assert len(stored.inputFiles()) > 2 and stored.count() == 40000


def test_fact_versions(spark, tmp_path):
    base = str(tmp_path / "v")
    incoming = batch(spark, [(A, "1", "1"), (S1, "1", "2")])
    facts = P.facts_after(P.promote(P.empty_facts(incoming), incoming, extracted_at=T1))
    schema = facts.schema
    assert mart.read_fact_version(spark, base, schema=schema).count() == 0
    assert mart.write_fact_version(facts, base) == 1
    assert mart.write_fact_version(facts.filter("source_object = 'T_A'"), base) == 2
    assert mart.read_fact_version(spark, base, schema=schema).count() == 1
    assert mart.read_fact_version(spark, base, 1, schema=schema).count() == 2
    (tmp_path / "v" / "v=3").mkdir()  # an unfinished version is not current
    assert mart.fact_versions(spark, base) == [1, 2]
    with pytest.raises(LookupError):
        mart.read_fact_version(spark, base, 3)
    discriminators = {r.source_discriminator_column for r in mart.read_fact_version(spark, base, 1, schema=schema).collect()}
    assert discriminators == {"", "NAME"}  # the sentinel survives the files


def fact_store(spark, tmp_path):
    return mart.FactFiles(str(tmp_path / "facts"), fact_schema(batch(spark, []), ["debit", "credit"]))


def test_a_death_between_writing_and_switching_leaves_the_old_scope(spark, tmp_path, monkeypatch):
    store = fact_store(spark, tmp_path)
    promote_into(batch(spark, [(A, "1", "1"), (B, "1", "5")], "b1"), store, extracted_at=T1)
    before = rows(store.read(spark))
    second = batch(spark, [(A, "1", "2"), (A, "2", "3")], "b2", T2)

    def die(self, *args, **more):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(mart.FactFiles, "switch", die)
        with pytest.raises(KeyboardInterrupt):
            promote_into(second, store, extracted_at=T2, full_refresh_scope=scope(A))
    assert rows(store.read(spark)) == before and store.versions(spark) == [1]
    assert promote_into(second, store, extracted_at=T2, full_refresh_scope=scope(A))["updated"] == 1  # run again
    assert P.fact_total(store.read(spark), "debit").head()[0] == D(10)
    assert rows(store.read(spark, 1)) == before  # who pinned the first version still reads it


def test_a_manifest_appears_whole_or_not_at_all(spark, tmp_path, monkeypatch):
    store = fact_store(spark, tmp_path)
    promote_into(batch(spark, [(A, "1", "1")], "b1"), store, extracted_at=T1)
    with monkeypatch.context() as m:
        m.setattr(mart, "rename_new", lambda *a: (_ for _ in ()).throw(OSError("disk")))
        with pytest.raises(OSError):
            promote_into(batch(spark, [(A, "1", "9"), (B, "1", "9")], "b2"), store, extracted_at=T2)
    assert store.current(spark) == 1 and P.fact_total(store.read(spark), "debit").head()[0] == D(1)


def test_jobs_on_other_scopes_both_come_through_and_on_the_same_scope_one(spark, tmp_path):
    store = fact_store(spark, tmp_path)
    promote_into(batch(spark, [(A, "1", "1"), (B, "1", "1")], "b1"), store, extracted_at=T1)
    facts = store.read(spark, 1).drop("scope_id")
    raised = facts.withColumn("debit", (F.col("debit") + 1).cast("decimal(20,2)"))
    first = store.write_aside(raised.filter("source_object = 'T_A'"))
    second = store.write_aside(raised.filter("source_object = 'T_B'"))
    third = store.write_aside(facts.filter("source_object = 'T_A'"))
    assert store.switch(spark, first, based_on=1) == 2 and store.switch(spark, second, based_on=1) == 3
    with pytest.raises(mart.ConcurrentChange):
        store.switch(spark, third, based_on=1)
    assert P.fact_total(store.read(spark), "debit").head()[0] == D(4) and store.current(spark) == 3


def test_vacuum_keeps_what_the_last_versions_name(spark, tmp_path):
    store = fact_store(spark, tmp_path)
    for n, items in enumerate([[(A, "1", "1"), (B, "1", "1")], [(A, "1", "2")], [(A, "1", "3")]]):
        promote_into(batch(spark, items, f"b{n}"), store, extracted_at=T1)
    store.write_aside(store.read(spark).drop("scope_id"))  # of a job that died
    assert store.vacuum(spark) == [store._manifest(1)]  # everything is younger than a day
    gone = store.vacuum(spark, keep=1, older_than=-1)
    assert len(gone) == 4  # a manifest, scope A of the first generation, the second, and the one of the dead job
    assert store.versions(spark) == [3] and P.fact_total(store.read(spark), "debit").head()[0] == D(4)


def test_repeats_are_found_in_the_merge_and_nothing_is_switched(spark, tmp_path):
    store = fact_store(spark, tmp_path)
    promote_into(batch(spark, [(A, "1", "1")], "b1"), store, extracted_at=T1)
    twice = batch(spark, [(A, "2", "1"), (A, "3", "1"), (A, "2", "7")], "b2")
    for full in (None, scope(A)):
        with pytest.raises(P.BatchRejected, match="more than once"):
            promote_into(twice, store, extracted_at=T2, full_refresh_scope=full)
    assert store.versions(spark) == [1] and store.read(spark).count() == 1


def test_one_shuffle_of_the_batch_counts_copies_and_joins(spark, tmp_path):
    big = spark.range(1000).select(*[F.lit(v).alias(c) for c, v in scope(B).items()], F.col("id").cast("string").alias("source_row_key"),
                                   F.col("id").cast("decimal(20,2)").alias("debit"), F.lit(D(0)).cast("decimal(20,2)").alias("credit"))
    incoming = P.as_batch(big, payload=["debit", "credit"], batch_id="b", extracted_at=T1)
    P.empty_facts(incoming).unionByName(incoming, allowMissingColumns=True).write.parquet(str(tmp_path / "f"))
    facts = spark.read.parquet(str(tmp_path / "f"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(P.promote_scope(facts, incoming, scope(B), extracted_at=T2), "simple")
        whole = plan(P.promote(facts, incoming, extracted_at=T2), "simple")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    for t in (text, whole):
        assert t.count("Exchange hashpartitioning") == 2 and t.count("Window [") == 1 and "SortMergeJoin" in t  # facts and batch
        assert t.count("Sort [") == 2


def test_an_entry_without_owner_has_no_scope(spark):
    e = entry()
    broken = Row(**{**e.asDict(), "physical": Row(**{**e.physical.asDict(), "owner": None})})
    with pytest.raises(UnresolvedSource, match="source_owner"):
        identity.scope_of(broken, "SYS")


def test_stream_feeds_the_same_plan(spark, tmp_path):
    from ledgerspark.streaming.feed import ingest_stream

    source = tmp_path / "in"
    extract = ledger(spark, [(1, "1"), (2, "2")])
    extract.coalesce(1).write.parquet(str(source / "d=1"))
    store = mart.FactFiles(str(tmp_path / "facts"), fact_schema(extract, ["entry_date", "debit"]))

    def feed():
        arriving = spark.readStream.schema(extract.schema).parquet(str(source / "*"))
        ingest_stream(arriving, entry(), feed="f", source_system="SYS", row_key=F.col("id"), payload=["entry_date", "debit"],
                      extracted_at=T1, order_by=["source_row_key"], staging_path=str(tmp_path / "stg"), store=store,
                      checkpoint=str(tmp_path / "cp")).awaitTermination(120)

    feed()
    assert P.fact_total(store.read(spark), "debit").head()[0] == 3
    ledger(spark, [(2, "5"), (3, "3")]).coalesce(1).write.parquet(str(source / "d=2"))
    feed()
    assert P.fact_total(store.read(spark), "debit").head()[0] == 9
    assert mart.read_staging(spark, str(tmp_path / "stg")).select("extract_batch_id").distinct().count() == 2


def test_temporary_tables_go_and_kept_ones_stay(spark):
    from ledgerspark import session

    with session.temporary_tables() as keep:
        first = session.durable(spark.range(3), "t")
        kept = keep(first.filter("id > 0"), "t")
        gone = first.inputFiles()
    assert kept.count() == 2 and session.durable(spark.range(1), "t").count() == 1
    with pytest.raises(Exception, match="(?i)not.*exist|not.*found"):
        spark.read.parquet(*gone).count()


def test_shared_folder_is_required_on_a_cluster(spark, monkeypatch):
    from ledgerspark import session

    class Context:
        master = "yarn"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(Session())


@pytest.mark.parametrize("broadcast", ["-1", "10485760"])
@pytest.mark.parametrize("full", [None, A])
def test_sides_partitioned_alike_give_the_rows_of_the_join(spark, full, broadcast):
    def keyed(df):
        return df.repartition(4, "source_row_key")

    def merged(facts, incoming, alike):
        return P.promote(keyed(facts), keyed(incoming), extracted_at=T2, full_refresh_scope=scope(full) if full else None, keyed_alike=alike)

    first = batch(spark, [(A, "1", "1"), (A, "1", "2"), (A, None, "3"), (A, "4", "4"), (A, "5", "5")], "b1")
    facts = P.empty_facts(first).unionByName(first, allowMissingColumns=True)  # a key that repeats, and one that is NULL
    second = batch(spark, [(A, "1", "1"), (A, None, "3"), (A, "4", "9"), (A, "6", "6")], "b2", T2)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        found = rows(merged(facts, second, True))
        assert found == rows(merged(facts, second, False)) and len(found) == 7
        third = batch(spark, [(A, "6", "6"), (A, "7", "7")], "b3", T3)
        chained = [P.promote(P.facts_after(merged(P.empty_facts(first), second, alike)), keyed(third), extracted_at=T3, keyed_alike=alike) for alike in (True, False)]
        assert rows(chained[0]) == rows(chained[1])
        twice = batch(spark, [(A, "8", "1"), (A, "8", "2")], "b2", T2)
        with pytest.raises(Exception, match="more than once"):
            merged(facts, twice, True).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_facts_do_not_move_between_the_batches(spark, small):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100000")  # the suppliers only
    try:
        for name in ("promote_facts", "fact_total"):
            text = plan(REGISTERED[name](spark, small), "simple")
            assert "Exchange hashpartitioning(concat_ws(" in text and "Exchange hashpartitioning(source_row_key" not in text
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_places_as_bitmaps(spark, tmp_path):
    spark.range(0, 150_000, 1, 2).write.parquet(str(tmp_path / "t"))  # two files, each of three bitmaps
    placed = places.with_places(spark.read.parquet(str(tmp_path / "t")))
    chosen = "id % 7 = 3 or id in (0, 63, 64, 32767, 32768, 74999, 75000, 149999)"
    bits = places.place_bits(placed.filter(chosen).withColumn("mark", F.col("id") % 2), ["mark"])
    for small in (True, False):
        found = places.at_places(placed, bits, carry=["mark"], small=small)
        assert sorted((r.id, r.mark) for r in found.select("id", "mark").collect()) == [
            (i, i % 2) for i in range(150_000) if i % 7 == 3 or i in (0, 63, 64, 32767, 32768, 74999, 75000, 149999)]
    assert places.at_places(placed, places.place_bits(placed.filter("false"))).count() == 0
    assert places.at_places(placed, places.place_bits(placed.unionByName(placed))).count() == 150_000


def stored_rows(store, tmp_path):
    """Rows in the files of each generation, oldest first."""
    folders = sorted((tmp_path / "facts" / "data").glob("generation=*"), key=lambda p: p.stat().st_mtime_ns)
    return [sum(pq.ParquetFile(f).metadata.num_rows for f in p.rglob("*.parquet")) for p in folders]


def test_rows_that_stay_are_not_written_again(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(plan_of_ingest, "BROADCAST_BATCH_ROWS", 0)
    monkeypatch.setattr(plan_of_ingest, "MERGE_ROWS", 8)  # so that each batch is merged in three slices
    shuffled, merge = [], P.promote_scope

    def promote_scope(facts, batch, *args, **more):
        shuffled.append({*facts.columns, *batch.columns})
        return merge(facts, batch, *args, **more)

    monkeypatch.setattr(plan_of_ingest, "promote_scope", promote_scope)
    first = ledger(spark, [(i, str(i)) for i in range(1, 21)])
    store = mart.FactFiles(str(tmp_path / "facts"), fact_schema(first, ["entry_date", "debit"]))

    def run(df, batch_id, at):
        return ingest_extract(df, entry(), source_system="SYS", row_key=F.col("id"), payload=["entry_date", "debit"], batch_id=batch_id,
                              extracted_at=at, order_by=["source_row_key"], staging_path=str(tmp_path / "stg"), store=store, full_refresh=True)

    def seen(version):
        facts = store.read(spark, version).collect()
        return {r.source_row_key: (int(r.debit), r.extract_batch_id, r.extracted_at, r.source_deleted_at) for r in facts}, len(facts)

    changed = ledger(spark, [(i, str(i if i != 5 else 50)) for i in range(1, 22) if i != 7])  # 5 changes, 7 goes, 21 comes
    back = ledger(spark, [(i, str(i if i != 5 else 50)) for i in range(1, 22)])
    assert run(first, "b1", T1) == {"staged": 20, "inserted": 20, "updated": 0, "unchanged": 0, "tombstoned": 0, "revived": 0}
    assert run(changed, "b2", T2) == {"staged": 20, "inserted": 1, "updated": 1, "unchanged": 18, "tombstoned": 1, "revived": 0}
    assert run(changed, "b2", T2) == {"staged": 0, "inserted": 0, "updated": 0, "unchanged": 20, "tombstoned": 0, "revived": 0}
    assert run(back, "b3", T3) == {"staged": 21, "inserted": 0, "updated": 0, "unchanged": 20, "tombstoned": 0, "revived": 1}
    assert stored_rows(store, tmp_path) == [20, 2, 0, 1]
    assert len(shuffled) == 12 and not any({"debit", "entry_date", "extract_batch_id"} & c for c in shuffled)
    one = {str(i): (i, "b1", T1, None) for i in range(1, 21)}
    two = {**one, "5": (50, "b2", T2, None), "7": (7, "b1", T1, T2), "21": (21, "b2", T2, None)}
    four = {**two, "7": (7, "b3", T3, None)}
    for version, expected in enumerate((one, two, two, four), 1):
        assert seen(version) == (expected, len(expected))
    assert {r.row_hash for r in store.read(spark, 4).collect()} == {r.row_hash for r in P.as_batch(  # the hash is made anew, and the same
        identity.with_identity(back, entry(), F.col("id"), "SYS"), payload=["entry_date", "debit"], batch_id="b", extracted_at=T1).collect()}
    assert store.vacuum(spark, keep=1, older_than=-1) and seen(4) == (four, 21)
    with pytest.raises(P.BatchRejected, match="no column for id"):
        ingest_extract(back, entry(), source_system="SYS", row_key=F.col("id"), payload=["entry_date", "debit"], batch_id="b4", extracted_at=T3,
                       order_by=["id"], staging_path=str(tmp_path / "stg"), store=store, full_refresh=True)


def test_extracts_of_many_sources_against_a_row_by_row_model(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(plan_of_ingest, "MAX_GENERATIONS", 3)
    rnd, facts, kept = random.Random(5), {}, []
    sources = {A: entry("15", "T_A"), B: entry(), S1: entry("X", "T_ALL", ("NAME", "PART_A"), mode="SHARED_DISCRIMINATOR")}
    store = mart.FactFiles(str(tmp_path / "facts"), fact_schema(ledger(spark, []), ["entry_date", "debit"]))
    for n in range(7):
        at, full = rnd.choice([A, A, A, B, S1]), rnd.random() < 0.6
        items = [(at, str(k), str(rnd.choice([1, 1, 1, 2]))) for k in rnd.sample(range(12), rnd.randrange(6, 12))]
        monkeypatch.setattr(plan_of_ingest, "BROADCAST_BATCH_ROWS", rnd.choice([0, 100]))
        expected = model(facts, items, f"b{n}", at if full else None)
        counts = ingest_extract(ledger(spark, [(int(k), v) for _, k, v in items]), sources[at], source_system="SYS", row_key=F.col("id"),
                                payload=["entry_date", "debit"], batch_id=f"b{n}", extracted_at=T1, order_by=["source_row_key"],
                                staging_path=str(tmp_path / "stg"), store=store, full_refresh=full)
        assert {k: v for k, v in counts.items() if v and k != "staged"} == expected and counts["staged"] == len(items)
        kept.append({k: (f"{v[0]}.00", *v[1:]) for k, v in facts.items()})
    pieces = [p for v in store.versions(spark) for p in store.pointers(spark, v).values()]
    assert max(len(p.generations) for p in pieces) in (2, 3) and any(p.kept for p in pieces)
    for version, expected in enumerate(kept, 1):
        got = store.read(spark, version).collect()
        assert len(got) == len(expected)
        assert {(tuple(r[c] for c in SCOPE), r.source_row_key): (str(r.debit), r.extract_batch_id, r.source_deleted_at is not None) for r in got} == expected


def test_facts_that_repeat_a_key_are_merged_as_whole_rows(spark, tmp_path):
    extract = ledger(spark, [(1, "2")])
    store = mart.FactFiles(str(tmp_path / "facts"), fact_schema(extract, ["entry_date", "debit"]))
    twice = P.as_batch(identity.with_identity(ledger(spark, [(1, "1"), (1, "1")]), entry(), F.col("id"), "SYS"),
                       payload=["entry_date", "debit"], batch_id="b0", extracted_at=T1)
    empty = spark.createDataFrame([], store.schema)
    store.replace_scopes(empty.unionByName(twice, allowMissingColumns=True))
    counts = ingest_extract(extract, entry(), source_system="SYS", row_key=F.col("id"), payload=["entry_date", "debit"], batch_id="b1", extracted_at=T1,
                            order_by=["source_row_key"], staging_path=str(tmp_path / "stg"), store=store, full_refresh=True)
    assert counts["updated"] == 2 and [r.debit for r in store.read(spark).collect()] == [D(2), D(2)]


def test_hash_bytes_keep_texts_apart(spark):
    from ledgerspark.functions.hashing import hash_bytes

    texts = ["ab" * 32, "AB" * 32, "ab" * 31, "xy" * 32, "", None, "=" + "a" * 31]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "h string").select(hash_bytes(F.col("h"))).collect()]
    assert bytes(got[0]) == bytes.fromhex("ab" * 32) and got[5] is None and len({bytes(g) for g in got if g is not None}) == 6
