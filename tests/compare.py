"""Compare a registered query with its SQL on one data set, by column name and value."""

from __future__ import annotations

from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{sf_dir}/{name}.parquet')")
    return con


def rows_by_name(names, rows) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple((names[i], r[i]) for i in order) for r in rows)


def differences(spark, con, query, sql: str, sf_dir: str) -> tuple[int, list, list]:
    result = query(spark, sf_dir)
    mine = rows_by_name(result.columns, [tuple(r) for r in result.collect()])
    cursor = con.execute(sql)
    theirs = rows_by_name([d[0] for d in cursor.description], cursor.fetchall())
    return sum(mine.values()), list((mine - theirs).items())[:3], list((theirs - mine).items())[:3]
