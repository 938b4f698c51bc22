from datetime import date, timedelta
from decimal import Decimal as D

import pytest
from helpers import rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerspark.functions.ageing import age_bucket, age_days
from ledgerspark.functions.calendar import fiscal_year
from ledgerspark.functions.hashing import canonical_text, row_hash
from ledgerspark.functions.text import normalise_cell, redact_text, trim_char, upper_like


def test_every_bucket_boundary(spark):
    ages = [0, 30, 31, 60, 61, 90, 91, 180, 181, 365, 366, -1, None]
    expected = ["0-30", "0-30", "31-60", "31-60", "61-90", "61-90", "91-180", "91-180", "181-365", "181-365",
                ">365", "not-due", None]
    df = spark.createDataFrame([(i, a) for i, a in enumerate(ages)], "i int, a int")
    got = [r[0] for r in df.orderBy("i").select(age_bucket(F.col("a"))).collect()]
    assert got == expected


def test_age_days(spark):
    df = spark.createDataFrame([(date(2024, 2, 28), date(2024, 3, 1)), (date(2024, 3, 1), date(2024, 2, 1))], "a date, b date")
    assert [r[0] for r in df.select(age_days(F.col("a"), F.col("b"))).collect()] == [2, -29]


def test_fiscal_year_against_plain_python(spark):
    days = [date(1999, 1, 1) + timedelta(days=11 * i) for i in range(400)]
    days += [date(2026, 3, 31), date(2026, 4, 1), date(2000, 3, 31), date(1999, 4, 1)]

    def label(d):
        y = d.year - (d.month < 4)
        return f"FY{y % 100:02d}-{(y + 1) % 100:02d}"

    df = spark.createDataFrame([(d,) for d in days], "d date")
    for d, got in df.select("d", fiscal_year(F.col("d"))).collect():
        assert got == label(d)


def test_hash_is_blind_to_order_and_sensitive_to_values(spark):
    df = spark.createDataFrame([("x", D("1.00"), date(2024, 1, 1), 7, True)], "a string, b decimal(20,2), c date, d int, e boolean")
    h = df.select(row_hash(df, ["a", "b", "c", "d", "e"]), row_hash(df, ["e", "c", "a", "d", "b"])).head()
    assert h[0] == h[1] and len(h[0]) == 64
    text = df.select(canonical_text(df, df.columns)).head()[0]
    assert text == "|a=x|b=1.00|c=2024-01-01|d#7|e#true"
    other = df.withColumn("b", F.lit("1.01").cast("decimal(20,2)"))
    assert other.select(row_hash(other, df.columns)).head()[0] != h[0]
    typed = df.withColumn("d", F.col("d").cast("string"))
    assert typed.select(row_hash(typed, df.columns)).head()[0] != h[0]


def test_hash_keeps_null_blank_and_separators_apart(spark):
    tricky = [(None, "x"), ("", "x"), ("~", "x"), ("|b=x", None), ("\\", "|b=x"), ("\\|b=x", ""), ("|b~", ""), (None, None), ("", "")]
    df = spark.createDataFrame(tricky, "a string, b string")
    assert df.select(row_hash(df, ["a", "b"])).distinct().count() == len(tricky)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.none() | st.text("|\\~=#ab"), st.none() | st.text("|\\~=#ab")), min_size=1, max_size=200))
def test_canonical_text_never_collides(spark, pairs):
    df = spark.createDataFrame(pairs, "a string, b string")
    assert df.select(canonical_text(df, ["a", "b"])).distinct().count() == len(set(pairs))


def test_hash_refuses_floats(spark):
    df = spark.createDataFrame([(1.5,)], "a double")
    with pytest.raises(TypeError):
        row_hash(df, ["a"])


def test_redaction_masks_literals_longest_first_then_assignments(spark):
    text = "login to LAKEDSN;UID=reader1;PWD=k-9! refused; dsn=X;uid = q;Password= open b; pwdx=keep ab token tokens"
    df = spark.createDataFrame([(text,), (None,)], "t string")
    got = [r[0] for r in df.select(redact_text(F.col("t"), ["LAKEDSN", "token", "tokens", "ab"])).collect()]
    assert got[0] == "login to ***;UID=***;PWD=*** refused; dsn=X;uid=***;Password=*** b; pwdx=keep ab *** ***"
    assert got[1] is None


def test_redaction_of_regex_characters_is_literal(spark):
    df = spark.createDataFrame([("a.b$c k(9)+ axb$c",)], "t string")
    assert df.select(redact_text(F.col("t"), ["a.b$c", "k(9)+"])).head()[0] == "*** *** axb$c"


def test_text_helpers(spark):
    df = spark.createDataFrame([(" ab\t\n", "x "), ("   ", "y"), (None, "z")], "a string, b string")
    assert [r[0] for r in df.select(normalise_cell(F.col("a"))).collect()] == ["AB", None, None]
    assert rows(trim_char(df, ["b"]).select("b")) == [("x",), ("y",), ("z",)]
    one = spark.createDataFrame([("t_fin_x",), ("tafinbx",)], "a string")
    assert one.filter(upper_like(F.col("a"), "T_FIN_X")).count() == 2  # "_" is a wildcard
