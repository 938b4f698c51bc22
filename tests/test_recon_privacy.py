import hashlib
import json
from datetime import date, datetime
from decimal import Decimal as D

import pytest
from helpers import plan, rows
from pyspark.sql import Row
from pyspark.sql import functions as F

from ledgerspark.fixed_values import AGE_BUCKETS
from ledgerspark.operators import ageing, evidence, privacy, recon, settlement
from ledgerspark.plans import inputs as src
from ledgerspark.plans.reconcile import run_reconciliation
from ledgerspark.sources import control_files, ledgers, mart

# ---- ageing ----


def test_age_summary_keeps_the_total_and_all_buckets(spark):
    items = spark.createDataFrame([(date(2026, 9, 1), D("73.10")), (date(2025, 1, 1), D("18.40")), (date(2026, 12, 1), D("1.00"))],
                                  "d date, a decimal(20,2)")
    got = {r.age_bucket: r.amount for r in ageing.age_summary(items, date(2026, 10, 5), basis="d", amount="a").collect()}
    assert set(got) == set(AGE_BUCKETS) and sum(got.values()) == D("92.50")
    assert got["31-60"] == D("73.10") and got[">365"] == D("18.40") and got["not-due"] == 1 and got["0-30"] == 0
    empty = ageing.age_summary(items.limit(0), date(2026, 10, 5), basis="d", amount="a").collect()
    assert len(empty) == 7 and all(r.amount == 0 for r in empty)


def test_age_summary_per_group_and_unknown_dates(spark):
    items = spark.createDataFrame([("x", date(2026, 9, 1), D(1)), ("y", None, D(2)), ("y", date(2026, 9, 1), None)], "g string, d date, a decimal(20,2)")
    got = ageing.age_summary(items, date(2026, 10, 5), basis="d", amount="a", by=("g",)).collect()
    assert len(got) == 14 and sum(r.amount for r in got) == 1
    assert ageing.ageing_violations(items, basis="d", amount="a").count() == 2


def test_age_summary_has_one_small_shuffle_and_no_join(spark, small):
    lineitem = src.table(spark, small, "lineitem").withColumn("a", F.col("l_tax").cast("decimal(20,2)"))
    text = plan(ageing.age_summary(lineitem, date(2001, 6, 30), basis="l_shipdate", amount="a", by=("l_suppkey",)), "simple")
    assert text.count("Exchange") == 1 and "Join" not in text


# ---- reconciliation ----


def totals(spark, *values):
    return spark.createDataFrame([(c, s, D(v)) for c, s, v in values], "check_name string, scope string, value decimal(24,2)")


def test_zero_tolerance(spark):
    source = totals(spark, ("debit", "co", "100.00"), ("credit", "co", "100.00"), ("x", "s", "10"))
    mart_side = totals(spark, ("debit", "co", "100.01"), ("credit", "co", "100.00"), ("x", "s", "9"), ("new", "s", "0"))
    kpi = totals(spark, ("credit", "co", "100.00"))
    why = spark.createDataFrame([("x", "s", "accrual posted next day")], "check_name string, scope string, explanation string")
    results = recon.recon_compare(source, mart_side, kpi, why)
    got = {r.check_name: r for r in results.collect()}
    assert not got["debit"].passed and got["debit"].variance_mart == D("0.01") and not got["debit"].accepted
    assert got["credit"].passed and got["credit"].variance_kpi == 0
    assert not got["x"].passed and got["x"].accepted and got["x"].variance_mart == D("-1.00")
    assert got["new"].passed and got["new"].source == 0  # absent counts as 0
    assert tuple(recon.recon_gate(results).head()) == (4, 2, False)
    report = {r.check_name: r for r in recon.recon_report(results).collect()}
    assert report["debit"].kpi == "-" and report["debit"].status == "FAIL" and report["credit"].kpi == "100.00"


def test_kpi_variance_fails(spark):
    one = totals(spark, ("debit", "co", "5"))
    assert not recon.recon_compare(one, one, totals(spark, ("debit", "co", "6"))).head().passed


def test_kpi_without_a_mart_total_fails(spark):
    one = totals(spark, ("debit", "co", "5"))
    got = {r.check_name: r for r in recon.recon_compare(one, one, totals(spark, ("margin", "co", "6"))).collect()}
    assert got["debit"].passed and got["margin"].variance_kpi == 6 and not got["margin"].passed


def test_gate(spark):
    one = totals(spark, ("debit", "co", "5"))
    assert recon.recon_gate(recon.recon_compare(one, one)).head().gate_passed
    assert not recon.recon_gate(recon.recon_compare(one.limit(0), one.limit(0))).head().gate_passed  # empty never passes


def test_totals_of_all_scopes(spark):
    df = spark.createDataFrame([("S1", "A", D(1), D(0)), ("S1", "B", D(2), D(0)), (None, "A", D(0), D(4))],
                               "site string, acc string, debit decimal(20,2), credit decimal(20,2)")
    got = rows(recon.recon_totals(df, {"site": F.col("site"), "account": F.col("acc")}).filter("check_name = 'debit'"))
    assert got == [("debit", "account:A", D(1)), ("debit", "account:B", D(2)), ("debit", "company", D(3)),
                   ("debit", "site:S1", D(3)), ("debit", "site~", D(0))]


def test_totals_expand_only_the_summed_table(spark, small):
    text = plan(recon.recon_totals(src.ledger(spark, small), {"site": F.col("site_code"), "account": F.col("entry_glcode")}), "simple")
    below_expand = text.split("Expand")[1]
    assert "HashAggregate" in below_expand and text.count("FileScan parquet") == 2


def test_run_is_appended(spark, tmp_path):
    df = spark.createDataFrame([("S1", date(2024, 5, 1), "A", D(1), D(0), None)],
                               "site_code string, entry_date date, entry_glcode string, debit decimal(20,2), credit decimal(20,2), source_deleted_at timestamp")
    path = str(tmp_path / "runs")
    assert run_reconciliation(df, df, path, datetime(2025, 1, 1))
    gone = df.withColumn("source_deleted_at", F.lit(datetime(2025, 1, 1)))
    assert not run_reconciliation(df, gone, path, datetime(2025, 1, 2))
    runs = mart.read_recon_runs(spark, path)
    assert runs.count() == 24 and runs.filter("not passed").count() == 8
    assert set(runs.columns) == {"run_at", "scope", "check_name", "source_value", "mart_value", "kpi_value", "explanation", "passed"}


def some_results(spark, value):
    totals = spark.createDataFrame([("debit", "company", D(value))], "check_name string, scope string, value decimal(24,2)")
    return recon.recon_compare(totals, totals)


def test_a_repeated_run_is_stored_once_and_replaces_itself(spark, tmp_path, monkeypatch):
    path, at = str(tmp_path / "runs"), datetime(2025, 1, 1)
    assert mart.read_recon_runs(spark, path).count() == 0
    for value in (1, 1, 2):
        mart.append_recon_run(some_results(spark, value), path, at)
    mart.append_recon_run(some_results(spark, 5), path, at, run_id="evening")
    assert sorted(r.source_value for r in mart.read_recon_runs(spark, path).collect()) == [D(2), D(5)]
    assert mart.read_recon_runs(spark, path, "evening").count() == 1 and mart.read_recon_runs(spark, path, "morning").count() == 0

    def die(*args):
        raise OSError("gone")

    with monkeypatch.context() as m:  # a death before the rename changes nothing
        m.setattr(mart, "rename_new", die)
        with pytest.raises(OSError):
            mart.append_recon_run(some_results(spark, 9), path, at)
    assert sorted(r.source_value for r in mart.read_recon_runs(spark, path).collect()) == [D(2), D(5)]
    for bad in ("../x", "", "a@1", "_a"):
        with pytest.raises(ValueError):
            mart.append_recon_run(some_results(spark, 1), path, at, run_id=bad or "@")


# ---- settlement ----


def fifo(items, payments):
    """One charge after the other, oldest first, by hand."""
    left, out = sum(payments), []
    for day, amount in sorted(items, key=lambda i: (i[0] is None, i[0] or date.min)):
        paid = min(left, amount)
        left -= paid
        out.append((day, amount - paid))
    return out, left


def test_settlement_against_a_hand_made_fifo(spark):
    import random

    rnd = random.Random(8)
    rows_, by = [], {}
    for v in ("V1", "V2", "V3", "V4", None):
        items, payments = [], []
        for _ in range(60):
            day = date(2024, 1, 1 + rnd.randrange(28)) if rnd.random() < 0.95 else None
            charge, payment = (D(rnd.randrange(-500, 4000)) / 100, D(0)) if rnd.random() < 0.6 else (D(0), D(rnd.randrange(-300, 6000)) / 100)
            rows_.append((v, day, charge, payment))
            up, down = max(charge, D(0)) + max(-payment, D(0)), max(payment, D(0)) + max(-charge, D(0))
            items.append((day, up))
            payments.append(down)
        by[v] = fifo(items, payments)
    df = spark.createDataFrame(rows_, "vendor string, day date, debit decimal(20,2), credit decimal(20,2)")
    settled = settlement.settle(df, by=["vendor"], day="day")
    got = {(r.vendor, r.day): r.open for r in settled.collect()}
    ahead = {r.vendor: r.advance for r in settlement.advances(settled, by=["vendor"]).collect()}
    for v, (items, left) in by.items():
        expected = {}
        for day, rest in items:
            expected[v, day] = expected.get((v, day), D(0)) + rest
        assert {k: n for k, n in got.items() if k[0] == v} == expected and ahead[v] == left
    totals = {(r.check_name, r.scope): r.value for r in settlement.outstanding_totals(df, date(2024, 2, 1), party="vendor", day="day").collect()}
    balance = sum(c - p for _, _, c, p in rows_)
    assert totals["outstanding", "company"] - totals["advances", "company"] == balance
    assert totals["advances", "vendor~"] == by[None][1] and sum(n for (c, s), n in totals.items() if s.startswith("age")) == totals["outstanding", "company"]


def test_settlement_sorts_days_not_rows(spark):
    df = spark.range(1000).selectExpr("'HOT' as vendor", "date_add(date'2024-01-01', cast(id % 5 as int)) as day",
                                      "cast(1 as decimal(20,2)) as debit", "cast(0.25 as decimal(20,2)) as credit")
    settled = settlement.settle(df, by=["vendor"], day="day")
    assert settled.count() == 5 and [r.open for r in settled.orderBy("day").collect()] == [D(0), D(150), D(200), D(200), D(200)]
    text = plan(settled, "simple")
    below = text.split("Window [")[-1]
    assert "HashAggregate" in below and settled.schema["open"].dataType.simpleString() == "decimal(24,2)"


def test_vendors_are_summed_apart(spark):
    df = spark.createDataFrame([("S1", "V1", D(1)), ("S1", "V2", D(2)), ("S2", None, D(4))], "site string, vendor string, debit decimal(20,2)")
    got = {(r.check_name, r.scope): r.value for r in recon.recon_totals(df, {"site": F.col("site")}, ("debit",), apart={"vendor": F.col("vendor")}).collect()}
    assert got == {("debit", "company"): D(7), ("debit", "site:S1"): D(3), ("debit", "site:S2"): D(4), ("debit", "vendor:V1"): D(1),
                   ("debit", "vendor:V2"): D(2), ("debit", "vendor~"): D(4), ("rows", "company"): 3, ("rows", "site:S1"): 2,
                   ("rows", "site:S2"): 1, ("rows", "vendor:V1"): 1, ("rows", "vendor:V2"): 1, ("rows", "vendor~"): 1}


# ---- evidence ----

LIST = [{"CUBE_ID": "61", "TBL": "T_FIN_61", "NM": " site book "}, {"CUBE_ID": "48", "TBL": "CUBE_POS", "NM": "till_b"},
        {"CUBE_ID": "61", "TBL": "T_ELSEWHERE", "NM": None}, {"CUBE_ID": "1", "TBL": "own.t_lost", "NM": "  "}]


@pytest.fixture
def captured(spark, tmp_path):
    p = tmp_path / "list.json"
    p.write_text(json.dumps({"discovered_at": "2026-02-11T08:30:00+00:00", "list": {"rows": LIST}}))
    return str(p)


def judge(spark, captured, *claims):
    listed = control_files.read_evidence(spark, captured, ["CUBE_ID", "TBL", "NM"]).drop("discovered_at")
    schema = "registry_key string, copy_id string, owner string, object_name string, discriminator_value string, evidence_row_index int"
    got = evidence.match_evidence(spark.createDataFrame(list(claims), schema), listed, row_index="row_index")
    return {r.registry_key: (r.verification, len(r.notes), r.row_exists) for r in got.collect()}


def test_evidence_levels(spark, captured):
    got = judge(spark, captured,
                ("full", " 61 ", "OWN", "t_fin_61", None, 0), ("shared", "48", "OWN", "CUBE_POS", "TILL_B ", 1),
                ("no disc", "48", "OWN", "CUBE_POS", "OTHER", 1), ("copy only", "61", "OWN", "T_FIN_61", None, 2),
                ("object only", "2", "Own", "T_Lost", None, 3), ("unrelated", "61", "OWN", "T_FIN_61", None, 3),
                ("out", "61", "OWN", "T_FIN_61", None, 4), ("negative", "61", "OWN", "T_FIN_61", None, -1), ("far", "61", "OWN", "T_FIN_61", None, 99))
    assert got == {"full": ("MACHINE_VERIFIED", 0, True), "shared": ("MACHINE_VERIFIED", 0, True), "no disc": ("OPERATOR_CONFIRMED", 1, True),
                   "copy only": ("OPERATOR_CONFIRMED", 1, True), "object only": ("OPERATOR_CONFIRMED", 1, True),
                   "unrelated": ("REJECTED", 2, True), "out": ("REJECTED", 2, False), "negative": ("REJECTED", 2, False), "far": ("REJECTED", 2, False)}


def test_evidence_document_and_digest(spark, captured, tmp_path):
    listed = control_files.read_evidence(spark, captured, ["CUBE_ID", "TBL", "NM"]).orderBy("row_index").collect()
    assert [r.row_index for r in listed] == [0, 1, 2, 3] and listed[0].discovered_at.startswith("2026")
    digests = control_files.artifact_digests(spark, captured).head()
    assert digests.artifact_sha256 == hashlib.sha256(open(captured, "rb").read()).hexdigest()
    wrong = tmp_path / "wrong.json"
    wrong.write_text('{"foo": 1}')
    with pytest.raises(ValueError, match="list.rows"):
        control_files.read_evidence(spark, str(wrong), ["CUBE_ID"])


def test_evidence_sink_keeps_nulls(spark, tmp_path):
    df = spark.createDataFrame([("1", None)], "CUBE_ID string, NM string")
    mart.write_evidence(df, str(tmp_path / "e"))
    line = spark.read.text(str(tmp_path / "e")).head()[0]
    assert json.loads(line) == {"CUBE_ID": "1", "NM": None}


@pytest.mark.parametrize("size", ["128m", "200b"])
def test_evidence_lines_keep_their_index_however_they_are_split(spark, tmp_path, size):
    path = tmp_path / "e"
    mart.write_evidence(spark.range(0, 300, 1, 3).selectExpr("id", "concat('name ', id) as name", "cast(null as string) as note").repartition(3),
                        str(path), order_by=["id"], discovered_at=datetime(2026, 2, 11))
    files = sorted(path.glob("part-*"))
    extra = path / "part-99999.json"
    extra.write_text('{"id": "300", "name": "last", "discovered_at": null}\n\n  \nnot json\n["list"]\n{"id": "303"}')
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        lines = control_files.read_evidence_lines(spark, str(path), ["id", "name", "note"])
        got = {r.row_index: r for r in lines.collect()}
        tasks = spark.read.text(str(path)).rdd.getNumPartitions()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert files and (size == "128m" or tasks > 30)
    assert sorted(got) == list(range(304)) and all(got[i].id == str(i) for i in [*range(301), 303])
    assert got[7].name == "name 7" and got[7].note is None and got[7].discovered_at == "2026-02-11T00:00:00"
    assert got[301].corrupt == "not json" and got[301].id is None and got[302].corrupt == '["list"]' and got[0].corrupt is None


@pytest.mark.parametrize("content", [b"a\nb\n", b"a\nb", b"\n", b"\n\n", b"x", b"\xef\xbb\xbfa\nb\n", b"\xef\xbb\xbfa", b"a\r\nb\r\n\r",
                                     bytes(range(256)) * 40, b"\xff\xfe\n\x00" * 500])
def test_files_hashed_in_pieces_have_the_digest_of_their_bytes(spark, tmp_path, content):
    (tmp_path / "one.bin").write_bytes(content)
    (tmp_path / "two.bin").write_bytes(content * 3)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64b")
    try:
        got = control_files.artifact_digests(spark, str(tmp_path), whole_bytes=0).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert {r.path.split("/")[-1]: (r.artifact_sha256, r.length) for r in got} == {
        name: (hashlib.sha256(data).hexdigest(), len(data)) for name, data in (("one.bin", content), ("two.bin", content * 3))}
    mixed = control_files.artifact_digests(spark, str(tmp_path), whole_bytes=len(content))
    assert sorted((r.path.split("/")[-1], r.artifact_sha256, r.length) for r in mixed.collect()) == sorted(
        (r.path.split("/")[-1], r.artifact_sha256, r.length) for r in got)


# ---- privacy ----


@pytest.fixture
def listing(spark):
    return spark.createDataFrame([("61", "SITE_REG", "T_FIN_61", "pia.k"), ("5", "CANTEEN", "X", "ravi"), ("93", "out", "FINOTSD", "tomas"),
                                  ("7", None, "plain", "fin_user")], "CUBE_ID string, CUBE_NAME string, TBL string, CREATED_BY string")


def test_any_like(listing):
    assert {r.CUBE_ID for r in privacy.filter_any_like(listing).collect()} == {"61", "93", "7"}
    assert privacy.evidence_list(listing, row_index="CUBE_ID").count() == 3
    capped = privacy.evidence_list(listing, row_index="CUBE_ID", row_cap=2).collect()
    assert [(r.CUBE_ID, r.truncated) for r in capped] == [("61", True), ("7", True)]
    assert not any(r.truncated for r in privacy.evidence_list(listing, row_index="CUBE_ID", row_cap=3).collect())
    numbers = listing.select(F.lit(1).alias("n"))
    assert privacy.filter_any_like(numbers).count() == 4


def test_any_regex_and_contains(listing):
    assert {r.CUBE_ID for r in privacy.filter_any_regex(listing).collect()} == {"61", "93", "7"}
    found = privacy.filter_any_contains(listing, "finotsd", row_index="CUBE_ID").collect()
    assert [r.CUBE_ID for r in found] == ["93"]


def test_sensitive_names():
    names = ["USER_ID", "email", "eMailAddr", "PASSWD", "pwd", "created_by", "UPDATED_BY", "x_modified_by", "Author", "AMOUNT", "NARRATION"]
    assert privacy.sensitive_columns(names) == names[:9]


def test_shareable_view_does_not_leak(spark, listing):
    df = listing.withColumn("NOTE", F.concat(F.lit("DSN=LAKEDSN;UID=reader1;PWD=gate-77 by "), "CREATED_BY"))
    view = privacy.shareable_view(df, ["CUBE_ID", "CUBE_NAME", "CREATED_BY", "NOTE"], secrets=["pia.k", "tomas", "fin_user", "LAKEDSN"])
    text = json.dumps([r.asDict() for r in view.collect()])
    for leak in ("pia.k", "ravi", "tomas", "gate-77", "reader1", "LAKEDSN", "fin_user", "T_FIN_6"):
        assert leak not in text
    assert view.columns == ["CUBE_ID", "CUBE_NAME", "NOTE"]
    assert {r.CUBE_ID for r in view.collect()} == {"61", "93", "7"}  # judged on all cells, dropped ones too
    capped = privacy.shareable_view(df, ["CUBE_ID"], row_cap=2, order_by=["CUBE_ID"])
    assert [(r.CUBE_ID, r.truncated) for r in capped.collect()] == [("61", True), ("7", True)]
    with pytest.raises(ValueError):
        privacy.shareable_view(df, ["CUBE_ID"], row_cap=2)


def test_nested_values_do_not_leak(spark):
    df = spark.sql("""select 'FIN' as k, named_struct('note', 'pwd=abc', 'user_email', 'x@y', 'deep', array(named_struct('author', 'ravi', 't', 'uid=7 secret9'))) as s,
                      array('pwd=def', null) as a, map('author', 'ravi', 'n', 'secret9') as m, cast(null as struct<note:string,user_email:string>) as z""")
    view = privacy.shareable_view(df, ["k", "s", "a", "m", "z"], secrets=["secret9"])
    row = view.head()
    assert json.loads(view.select(F.to_json(F.struct("*"))).head()[0]) == {"k": "FIN", "s": {"note": "pwd=***", "deep": [{"t": "uid=*** ***"}]}, "a": ["pwd=***", None], "m": {"n": "***"}}
    assert row.z is None and row.s.asDict().keys() == {"note", "deep"}


def test_exact_reconciliation(spark):
    from ledgerspark.operators import recon

    source = spark.sql("select stack(3, 1.0049, 1.0049, 1.0049) as debit, 'a' as site")
    mart = spark.sql("select cast(1.00 as decimal(20,2)) as debit, 'a' as site from range(3)")
    scopes = {"site": F.col("site")}
    results = recon.recon_compare(recon.recon_totals(source, scopes, ("debit",)), recon.recon_totals(mart, scopes, ("debit",)))
    off = {r.scope: str(r.variance_mart) for r in results.filter("check_name = 'debit'").collect()}
    assert off == {"company": "-0.0147", "site:a": "-0.0147"} and not recon.recon_gate(results).head().gate_passed


def test_null_scopes_and_repeats(spark):
    from ledgerspark.operators import recon

    rows = spark.createDataFrame([(None, 1), ("-", 2), ("~", 3)], "site string, debit int")
    totals = recon.recon_totals(rows, {"site": F.col("site")}, ("debit",))
    assert {r.scope for r in totals.collect()} == {"company", "site~", "site:-", "site:~"}
    results = recon.recon_compare(totals, totals)
    assert results.count() == 8 and recon.recon_gate(results).head().gate_passed
    twice = spark.createDataFrame([("debit", "site:-", "x"), ("debit", "site:-", "y")], "check_name string, scope string, explanation string")
    with pytest.raises(Exception, match="more than one explanation"):
        recon.recon_compare(totals, totals, explanations=twice).collect()


def test_row_hash_is_blind_to_the_time_zone(spark):
    from ledgerspark.functions.hashing import row_hash

    df = spark.createDataFrame([(1_700_000_000,)], "s long").select(F.timestamp_seconds("s").alias("t"))
    kept, found = spark.conf.get("spark.sql.session.timeZone"), set()
    try:
        for zone in ("UTC", "Asia/Kolkata", "Europe/Berlin"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            found.add(df.select(row_hash(df, ["t"]).alias("h")).head().h)
    finally:
        spark.conf.set("spark.sql.session.timeZone", kept)
    assert len(found) == 1


# ---- sources ----


def entry(name, disc=(None, None), status="CONFIRMED", owner="own"):
    mode = "SHARED_DISCRIMINATOR" if disc[0] else "SEPARATE_OBJECT"
    physical = Row(owner=owner, object_name=name, object_type="TABLE", access_mode=mode, discriminator_column=disc[0], discriminator_value=disc[1])
    return Row(source_type="S", logical_cube_name="C", copy_id="1", status=status, physical=physical)


def test_read_source(spark, tmp_path):
    spark.createDataFrame([("a ", "x", 1), ("b", "y' OR '1'='1", 2)], "k string, cube string, n int").write.parquet(str(tmp_path / "T"))
    opener = ledgers.files_under(str(tmp_path))
    whole = ledgers.read_source(spark, entry("T"), opener, trim=True)
    assert whole.columns == ["K", "CUBE", "N"] and {r.K for r in whole.collect()} == {"a", "b"}
    shared = ledgers.read_source(spark, entry("T", ("CUBE", "y' OR '1'='1")), opener)
    assert [r.N for r in shared.collect()] == [2]
    assert "PushedFilters: [IsNotNull(cube), EqualTo(cube,y' OR '1'='1)]" in plan(shared)
    with pytest.raises(LookupError):
        ledgers.read_source(spark, entry("T", ("NOPE", "1")), opener)
    calls = []
    with pytest.raises(RuntimeError):
        ledgers.read_source(spark, entry("T", status="UNVERIFIED"), lambda s, p: calls.append(p))
    assert calls == []  # nothing was opened


def test_catalog_table_source(spark):
    spark.range(3).createOrReplaceTempView("src_rows")
    spark.sql("create database if not exists own")
    spark.sql("create view own.v_rows as select * from range(3)")
    assert ledgers.read_source(spark, entry("v_rows"), ledgers.catalog_table()).count() == 3
    spark.sql("drop view own.v_rows")


def test_jdbc_options_split_the_read():
    p = entry("LEDGER", owner="FIN").physical
    o = ledgers.jdbc_options("jdbc:x:", p, partition_column="ID", lower=0, upper=10**9, partitions=400, driver="d")
    assert o["dbtable"] == "FIN.LEDGER" and o["numPartitions"] == "400" and o["upperBound"] == "1000000000" and o["driver"] == "d"
    assert "partitionColumn" not in ledgers.jdbc_options("jdbc:x:", p, single_task=True)
    for odd in (entry("(select * from secrets) x"), entry("../T"), entry("T`", ("A", "1")), entry("T", owner="a b")):
        with pytest.raises(ValueError):
            ledgers.jdbc_options("jdbc:x:", odd.physical, single_task=True)
    with pytest.raises(ValueError):
        ledgers.jdbc_options("jdbc:x:", p)
    with pytest.raises(ValueError):
        ledgers.jdbc_options("jdbc:x:", p, partition_column="ID")
