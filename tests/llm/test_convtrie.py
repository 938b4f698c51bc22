import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import pytest

from ledgerspark.llm import convtrie as T
from ledgerspark.llm.common import table
from ledgerspark.llm.queries import LLM_QUERIES

SCHEMA = "conv_id long, turn long, role string, text string, path string, words int, depth long, n long, key string, base int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1, 2, 3, "k", 4) for r in rows], SCHEMA)


def brute(rows):
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, r or "", x or ""))
    own = {c: [(a[2], a[3]) for a in sorted(v, key=lambda a: a[:2])] for c, v in own.items()}
    members, ends, kids = defaultdict(list), defaultdict(list), defaultdict(list)
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        path = tuple(own.get(c - int(math.fmod(c, 20)), [])[:h] + v[h:])
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
        ends[path].append(c)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) or 1
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        saved[p] = sum(saved[k] for k in kids[p]) + (len(members[p]) - 1) * words
    return sorted(
        (min(m), len(p), min(members[p[:-1]]) if p else -(10**9), len(m), len(kids[p]), leaves[p], saved[p],
         hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest())
        for p, m in members.items())


def found(df):
    return sorted(tuple(-(10**9) if v is None else v for v in r) for r in df.collect())


def test_query_against_brute_force(spark, small):
    rows = [tuple(r) for r in table(spark, small, "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert found(LLM_QUERIES["op12_prefix_trie"](spark, small)) == brute(rows)


@pytest.mark.parametrize("shards", [1, 4, 90])
def test_random_tries_over_any_number_of_shards(spark, shards):
    rnd = random.Random(4)
    rows = [(c, t, rnd.choice(["u", "a", None]), rnd.choice(["a b", "c", None, "x  y\tz"]))
            for c in range(-45, 160) if rnd.random() < 0.9 for t in range(rnd.randrange(0, 6))]
    rows = [(c, None if t == 0 and c % 7 == 0 else t, r, x) for c, t, r, x in rows] + [(None, 1, "u", "nobody's")]
    assert found(T.prefix_trie(frame(spark, rows), shards)) == brute(rows)


def test_copies_deep_paths_and_one_common_first_turn(spark):
    rows = [(c, i, "u", f"t{i}") for c in range(1000, 1300) for i in range(5)]  # copies but for their own heads
    rows += [(c, i, "u", f"deep {i}" if i < 250 else f"{c} {i}") for c in (2000, 2020, 2040) for i in range(300)]
    rows += [(c, 0, "u", "hello") for c in range(3000, 3300, 20)] + [(c, 1, "a", str(c)) for c in range(3000, 3300, 20)]
    assert found(T.prefix_trie(frame(spark, rows), 12)) == brute(rows)


def test_ids_of_one_path_over_many_tasks(spark):
    paths = spark.range(5000).selectExpr("if(id % 10 = 0, concat('k', id % 70), 'hot') as key", "id - 2000 as conv_id").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for piece in (1, 64, 4096):
            got = {r.key: r.ends_sha256 for r in T._ends(paths, piece).collect()}
            assert len(got) == 8
            for key, digest in got.items():
                ids = [i - 2000 for i in range(5000) if (f"k{i % 70}" if i % 10 == 0 else "hot") == key]
                assert digest == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_empty_turnless_and_long_texts(spark):
    assert T.prefix_trie(frame(spark, [])).count() == 0
    assert T.prefix_trie(frame(spark, [(None, 0, "u", "x")])).count() == 0
    alone = next(c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4 == 3)  # takes 3 turns of an absent conversation
    rows = [(alone, 0, "u", "a"), (alone, 1, "u", "b")]
    assert found(T.prefix_trie(frame(spark, rows))) == brute(rows) == [(alone, 0, -(10**9), 1, 0, 1, 0, brute(rows)[0][-1])]
    rows = [(20, 0, None, "w " * 300_000), (20, 0, "", "w " * 300_000), (40, 0, "", "w " * 300_000), (40, None, "", None)]
    assert found(T.prefix_trie(frame(spark, rows))) == brute(rows)


def test_common_turns():
    a, b, c = ("x" * 32, "y" * 32, "z" * 32)
    assert T.common("", a) == 0 and T.common(a + b, a) == 1 and T.common(a + b + c, a + b + b) == 2 and T.common(b, a) == 0
