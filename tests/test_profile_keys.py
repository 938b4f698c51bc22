from datetime import date
from decimal import Decimal as D

import pytest
from helpers import plan, rows
from pyspark.sql import functions as F

from ledgerspark.operators import profile as pr
from ledgerspark.operators import keys
from ledgerspark.operators.keys import rank_keys
from ledgerspark.plans import inputs as src
from ledgerspark.plans.discovery import discover_source

SCHEMA = "SITECODE string, GLCODE string, SLCODE string, ENTRYDATE date, DEBIT decimal(20,2), CREDIT decimal(20,2), RELSTATUS string, NARRATION string"
ROLES = dict(date_col="entrydate", debit_col="debit", credit_col="credit", site_col="sitecode", gl_col="glcode",
             sl_col="slcode", release_col="relstatus")


@pytest.fixture
def ledger(spark):
    d = date(2025, 6, 2)
    return spark.createDataFrame([
        ("S1", "G1", None, d, D("1.10"), D(0), "R", "x"), ("S1", "G2", "V", date(2025, 8, 9), D("2.20"), D(0), None, "y"),
        ("S2", "G1", "V", d, D(0), D("3.30"), "R", None)], SCHEMA)


def test_light_profile(ledger):
    p = pr.profile_light(ledger, date_col="ENTRYDATE", debit_col="DEBIT", credit_col="CREDIT", distinct_cols=("SITECODE", "SLCODE")).head()
    assert p.asDict() == {"N": 3, "DMIN": date(2025, 6, 2), "DMAX": date(2025, 8, 9), "DEBIT": D("3.30"), "CREDIT": D("3.30"),
                          "DISTINCT_SITECODE": 2, "DISTINCT_SLCODE": 1}
    assert pr.profile_light(ledger) is None  # nothing asked, nothing scanned
    assert pr.profile_light(ledger, exact_count=True).columns == ["N"]
    empty = pr.profile_light(ledger.limit(0), debit_col="DEBIT", date_col="ENTRYDATE").head()
    assert empty.N == 0 and empty.DEBIT is None and empty.DMIN is None


def test_light_profile_approximate(ledger):
    assert pr.profile_light(ledger, distinct_cols=("SITECODE",), approximate=True).head().DISTINCT_SITECODE == 2


def test_light_profile_is_one_scan_of_the_needed_columns(spark, small):
    lineitem = src.table(spark, small, "lineitem").withColumn("l_tax", F.col("l_tax").cast("decimal(20,4)"))
    text = plan(pr.profile_light(lineitem, date_col="l_shipdate", debit_col="l_tax", distinct_cols=("l_suppkey", "l_partkey", "l_returnflag")))
    assert text.count("Scan parquet") == 2  # once in the tree, once in the list of nodes
    assert "ReadSchema: struct<l_partkey:bigint,l_suppkey:bigint,l_tax:double,l_returnflag:string,l_shipdate:timestamp_ntz>" in text


@pytest.mark.parametrize("width", [1, 36, 100, 101, 250])
def test_deep_profile_is_one_scan_at_any_width(spark, tmp_path, width):
    df = spark.range(200).select(*[F.when(F.col("id") % 4 != 0, F.col("id")).alias(f"COL{i}") for i in range(width)])
    df.write.parquet(str(tmp_path / "w"))
    wide = spark.read.parquet(str(tmp_path / "w"))
    deep = pr.profile_deep(wide)
    assert plan(deep).count("Scan parquet") == 2
    got = deep.collect()
    assert len(got) == width and all((r.exact_rows, r.non_null, r.null_rate) == (200, 150, 0.25) for r in got)


def test_deep_profile_of_no_rows_has_no_rate(ledger):
    assert {r.null_rate for r in pr.profile_deep(ledger.limit(0)).collect()} == {None}


def test_group_profile(ledger):
    got = pr.profile_group(ledger, "RELSTATUS", debit_col="DEBIT", credit_col="CREDIT").orderBy("position").collect()
    assert [(r.GRP, r.N, r.DEBIT, r.truncated) for r in got] == [("R", 2, D("1.10"), False), (None, 1, D("2.20"), False)]


def test_group_profile_truncates_and_says_so(spark):
    df = spark.range(303).select((F.col("id") % 101).cast("string").alias("g"))
    got = pr.profile_group(df, "g").collect()
    assert len(got) == 100 and all(r.truncated and r.N == 3 for r in got)
    exact = pr.profile_group(df.filter("g <> '100'"), "g").collect()
    assert len(exact) == 100 and not any(r.truncated for r in exact)
    assert "TakeOrderedAndProject" in plan(pr.profile_group(df, "g"))


@pytest.mark.parametrize("bad", ["SITECODE, GLCODE", "SITECODE GLCODE", "no_such", ["SITECODE"], None, ""])
def test_group_profile_takes_exactly_one_column(ledger, bad):
    with pytest.raises(ValueError):
        pr.profile_group(ledger, bad)


def test_sample(spark):
    df = spark.range(100).select((99 - F.col("id")).alias("k"))
    assert [r.k for r in pr.bounded_sample(df, order_by=("k",)).collect()] == [0, 1, 2, 3, 4]
    assert pr.bounded_sample(df, 7).count() == 7


def test_roles(ledger):
    roles = (pr.Role("date_col"), pr.Role("debit_col"), pr.Role("sl_col", needed=False))
    given = {k: v for k, v in ROLES.items() if k in ("date_col", "debit_col", "sl_col")}
    assert pr.resolve_roles(ledger, given, roles) == {"date_col": "ENTRYDATE", "debit_col": "DEBIT", "sl_col": "SLCODE"}
    with pytest.raises(ValueError) as all_faults:  # one error names every fault
        pr.resolve_roles(ledger, {"date_col": "NOPE", "colour_col": "X"}, roles)
    for part in ("NOPE", "debit_col is not assigned", "colour_col is no role"):
        assert part in str(all_faults.value)


def test_amounts_keep_their_scale(spark):
    df = spark.sql("select stack(3, 1.0049, 1.0049, 1.0049) as amount").withColumn("f", F.col("amount").cast("double"))
    assert str(pr.profile_light(df, debit_col="amount").head().DEBIT) == "3.0147"
    with pytest.raises(TypeError):
        pr.profile_light(df, debit_col="f")


def test_discovery(ledger):
    found = discover_source(ledger, ROLES, key_candidates={"k": ["SITECODE", "GLCODE"]}, deep=True)
    assert set(found) == {"light", "sample", "deep", "release_groups", "keys"}
    assert found["light"].head().N == 3 and found["keys"].head().recommendation == "STRONG_CANDIDATE"
    assert found["sample"].count() == 3 and found["release_groups"].count() == 2


def test_key_ranking(spark):
    df = spark.createDataFrame([(1, 1, "a", None), (1, 2, "b", 5), (2, 1, "c", 6), (2, 2, None, None)], "a int, b int, c string, d int")
    ranked = rank_keys(df, {"pk": ["a", "b"], "pk_index": ["a", "b"], "ba": ["b", "a"], "c": ["c"], "a": ["a"], "d": ["d"], "cd": ["c", "d"]},
                       discriminator_column="a").collect()
    got = {tuple(r["columns"]): r for r in ranked}
    assert got["a", "b"].sources == ["pk", "pk_index"] and got["a", "b"].recommendation == "STRONG_CANDIDATE"
    assert got["b", "a"].recommendation == "STRONG_CANDIDATE" and got["b", "a"].includes_discriminator
    assert got["c",].recommendation == "WEAK_CANDIDATE" and got["c",].nullable_columns == ["c"] and not got["c",].includes_discriminator
    assert got["d",].recommendation == "WEAK_CANDIDATE" and got["d",].null_rows == 2
    assert got["c", "d"].recommendation == "WEAK_CANDIDATE" and got["c", "d"].null_rows == 2
    assert got["a",].recommendation == "NO_KEY" and got["a",].surplus_rows == 2 and "2 rows repeat a key" in got["a",].reasons
    assert [r.recommendation for r in ranked] == ["STRONG_CANDIDATE"] * 2 + ["WEAK_CANDIDATE"] * 3 + ["NO_KEY"]
    assert {r.overall for r in ranked} == {"STRONG_CANDIDATE"}


def test_key_ranking_without_a_key(spark):
    df = spark.createDataFrame([(1, None), (1, None)], "a int, b int")
    ranked = rank_keys(df, {"a": ["a"], "b": ["b"]}).collect()
    assert {r.recommendation for r in ranked} == {"NO_KEY"} == {r.overall for r in ranked}
    assert all(r.includes_discriminator is None for r in ranked)
    empty = rank_keys(df.limit(0), {"a": ["a"]}).collect()
    assert empty[0].recommendation == "NO_KEY" and empty[0].reasons == ["no rows to test"]
    with pytest.raises(ValueError):
        rank_keys(df, {"x": ["nope"]})


def test_key_ranking_is_one_scan(spark, small):
    lineitem = src.table(spark, small, "lineitem")
    text = plan(rank_keys(lineitem, {"a": ["l_orderkey", "l_linenumber"], "b": ["l_partkey"], "c": ["l_suppkey", "l_orderkey"]}))
    assert text.count("Scan parquet") == 2 and "Expand" in text


def test_bitmaps_count_distinct_values_without_expanding_rows(spark):
    df = spark.range(200_000).selectExpr("cast(id % 70000 - 35000 as int) as a", "date_add(date'1960-01-01', cast(id % 9000 as int)) as d",
                                         "if(id % 3 = 0, null, id % 11) as n", "cast(null as bigint) as none", "id * 1000000000 as wide")
    counted = ("a", "d", "n", "none", "wide")
    ranges = pr.integer_ranges(df, counted)
    assert ranges["a"] == (-35000, 34999) and ranges["n"] == (0, 10) and "none" not in ranges
    exact = pr.profile_light(df, distinct_cols=counted).head().asDict()
    got = pr.profile_light(df, distinct_cols=counted, ranges=ranges)
    assert got.head().asDict() == exact == {"N": 200_000, "DISTINCT_A": 70000, "DISTINCT_D": 9000, "DISTINCT_N": 11, "DISTINCT_NONE": 0, "DISTINCT_WIDE": 200_000}
    text = plan(pr.profile_light(df, distinct_cols=("a", "d", "n"), ranges=ranges), "simple")
    assert "Expand" not in text and text.count("Exchange") == 1 and text.count("Range (") == 1
    with pytest.raises(Exception, match="outside of its range"):
        pr.profile_light(df, distinct_cols=("a",), ranges={"a": (0, 50)}).head()
    with pytest.raises(TypeError):
        pr.integer_ranges(spark.createDataFrame([("x",)], "s string"), ["s"])


def test_bitmaps_are_not_kept_for_each_value_of_another_column(spark):
    df = spark.range(3000).selectExpr("id % 7 as n", "if(id = 0, null, id * 1000000000) as wide", "id % 5 as `b.c`")
    ranges = {k: r for k, r in pr.integer_ranges(df, ("n", "wide")).items()}
    got = pr.profile_light(df, distinct_cols=("n", "wide", "b.c"), ranges=ranges)
    assert got.columns == ["N", "DISTINCT_WIDE", "DISTINCT_B.C", "DISTINCT_N"]
    assert tuple(got.head()) == (3000, 2999, 5, 7)
    grouped = [line for line in plan(got, "simple").splitlines() if "bitmap_construct_agg" in line and "Aggregate(key=[]" not in line]
    assert "bitmap_construct_agg" in plan(got, "simple") and not grouped


def spied_sets(monkeypatch):
    """The sets of columns that are expanded, in the order of the jobs."""
    waves, exact = [], keys._surplus_rows

    def spy(df, sets):
        waves.append(sorted(tuple(sorted(s)) for s in sets))
        return exact(df, sets)

    monkeypatch.setattr(keys, "_surplus_rows", spy)
    return waves


def test_pruned_key_ranking_gives_the_same_rows_from_fewer_sets(spark, monkeypatch):
    waves = spied_sets(monkeypatch)
    df = spark.range(5000).selectExpr("id as a", "id % 50 as b", "if(id % 3 = 0, null, id) as c", "id div 2 as d", "id % 7 as e", "cast(null as int) as f")
    candidates = {"a": ["a"], "ab": ["a", "b"], "ba": ["b", "a"], "abc": ["a", "b", "c"], "b": ["b"], "be": ["b", "e"], "c": ["c"], "cd": ["d", "c"],
                  "ce": ["c", "e", "b"], "d": ["d"], "de": ["d", "e"], "f": ["f"], "af": ["a", "f"]}
    whole = rows(rank_keys(df, candidates, discriminator_column="b"))
    assert rows(rank_keys(df, candidates, discriminator_column="b", prune=True)) == whole
    # (a, b), (a, b, c), (c, d) and (b, c, e) contain a unique set; of (f) and (a, f) no row is free of NULL
    assert waves == [[("a",), ("b",), ("b", "e"), ("c",), ("d",), ("d", "e")]]
    waves.clear()
    labels = rank_keys(df, candidates, discriminator_column="b", count_repeats=False)
    position = labels.columns.index("recommendation")
    assert {(tuple(r[0]), r[position]) for r in labels.collect()} == {(tuple(r[0]), r[position]) for r in whole}
    assert waves == [[("a",), ("c",), ("d", "e")]]  # the sketch rules out b, (b, e) and d
    assert all(r.surplus_rows is None and "rows repeat a key" in r.reasons for r in labels.filter("columns[0] = 'd' and size(columns) = 1").collect())


def test_a_larger_set_is_counted_after_a_smaller_one_that_only_looks_unique(spark, monkeypatch):
    waves = spied_sets(monkeypatch)
    df = spark.range(3000).selectExpr("if(id = 7, 8, id) as a", "id % 2 as b", "id as c")
    got = {tuple(r["columns"]): r for r in rank_keys(df, {"a": ["a"], "ab": ["a", "b"], "abc": ["a", "b", "c"]}, prune=True).collect()}
    assert waves == [[("a",)], [("a", "b")]]
    assert got["a",].surplus_rows == 1 and got["a", "b"].recommendation == "STRONG_CANDIDATE" == got["a", "b", "c"].recommendation


def test_pruned_ranking_of_nothing(spark):
    df = spark.createDataFrame([], "a int, b int")
    got = rank_keys(df, {"a": ["a"], "ab": ["a", "b"]}, prune=True).collect()
    assert {r.recommendation for r in got} == {"NO_KEY"} and got[0].reasons == ["no rows to test"]
