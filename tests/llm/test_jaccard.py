import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerspark.llm import jaccard as J
from ledgerspark.llm.common import shingle_set, table, word_hashes
from ledgerspark.llm.queries import LLM_QUERIES


def sets(texts, k):
    out = {}
    for i, text in texts:
        w = (text or "").encode().lower().split(None) if text else []
        out[i] = frozenset(tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))) if w else frozenset()
    return out


def brute(texts, k, percent):
    """doc_id -> (size, component) by testing all pairs that share a shingle."""
    found = sets(texts, k)
    parent = {i: i for i in found}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    by: dict = {}
    for i, s in found.items():
        for t in s:
            by.setdefault(t, []).append(i)
    seen = set()
    for members in by.values():
        for x, a in enumerate(members):
            for b in members[x + 1 :]:
                if (a, b) not in seen:
                    seen.add((a, b))
                    both = len(found[a] & found[b])
                    if 100 * both >= percent * (len(found[a]) + len(found[b]) - both):
                        x1, y1 = sorted((root(a), root(b)))
                        parent[y1] = x1
    return {i: (len(s), root(i)) for i, s in found.items()}


def got(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def test_query_against_brute_force(spark, small):
    texts = [(r.doc_id, r.text) for r in table(spark, small, "documents").collect()]
    assert got(LLM_QUERIES["op1_jaccard"](spark, small)) == brute(texts, 3, 90)


def variants(rnd, base, n, edits):
    out = []
    for _ in range(n):
        words = base.split()
        for _ in range(rnd.randint(0, edits)):
            words[rnd.randrange(len(words))] = f"w{rnd.randint(0, 9999)}"
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("k, percent, stars", [(3, 90, True), (5, 80, True), (3, 90, False)])
def test_groups_of_near_copies(spark, monkeypatch, k, percent, stars):
    """Groups whose members are linked only through each other, a passage that all share, exact copies."""
    if stars:
        monkeypatch.setattr(J, "PAIRS", 0)
        monkeypatch.setattr(J, "LEADERS", 2)
    rnd = random.Random(k)
    shared = " ".join(f"s{i}" for i in range(30))
    texts = []
    for g in range(5):
        base = " ".join(f"g{g}x{i}" for i in range(80)) + " " + shared
        texts += variants(rnd, base, 25, 3)
    texts += [texts[0]] * 5 + [shared] * 3 + [shared + " tail"]
    numbered = list(enumerate(texts))
    rnd.shuffle(numbered)
    df = spark.createDataFrame(numbered, "doc_id long, text string")
    expected = brute(numbered, k, percent)
    assert got(J.jaccard_components(df, k, percent)) == expected
    kept = J.keep_one_of_each(df, k, percent)
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c in expected.values()})


def test_odd_rows(spark, documents):
    long = " ".join(f"t{i}" for i in range(60_000))
    docs = documents([None, "", " \t\n", "One two", "one  TWO", long, long + " end", "É x", "é x", "one two three"])
    out = got(J.jaccard_components(docs))
    assert out == {0: (0, 0), 1: (0, 1), 2: (0, 2), 3: (1, 3), 4: (1, 3), 5: (59_998, 5), 6: (59_999, 5), 7: (1, 7), 8: (1, 8), 9: (1, 9)}
    kept = J.keep_one_of_each(docs)
    assert sorted(r.doc_id for r in kept.collect()) == [0, 1, 2, 3, 5, 7, 8, 9] and kept.columns == docs.columns
    assert J.jaccard_components(docs.limit(0)).count() == 0 and J.keep_one_of_each(docs.limit(0)).count() == 0
    twice = docs.union(docs)
    assert J.jaccard_components(twice).count() == 20 and J.keep_one_of_each(twice).count() == 8


def test_null_ids(spark):
    df = spark.createDataFrame([(None, "a b c"), (2, "a b c"), (None, "x y z")], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in J.jaccard_components(df).collect()} == {(None, 2), (2, 2), (None, None)}
    assert sorted((r.doc_id or 0) for r in J.keep_one_of_each(df).collect()) == [0, 2]  # rows without id count as one id


def test_prefixes_hold_a_common_token():
    rnd = np.random.default_rng(5)
    frequent = np.sort(rnd.choice(2**40, 50, replace=False).astype(np.uint64))
    for _ in range(200):
        x = np.unique(np.r_[rnd.choice(2**40, rnd.integers(1, 60)).astype(np.uint64), rnd.choice(frequent, 5)])
        y = np.unique(np.r_[x[rnd.random(len(x)) > 0.05], rnd.choice(2**40, 1).astype(np.uint64)])
        both = len(np.intersect1d(x, y))
        if 100 * both >= 90 * (len(x) + len(y) - both):
            for p, q in zip(J._prefixes(x, frequent, 90), J._prefixes(y, frequent, 90)):
                assert len(np.intersect1d(p, q))


def test_sketches_never_count_too_little():
    rnd = np.random.default_rng(6)
    for size in (1, 50, 3000, 40_000):
        x = np.unique(rnd.choice(2**63, size).astype(np.uint64))
        y = np.unique(np.r_[x[rnd.random(len(x)) > 0.2], rnd.choice(2**63, 5).astype(np.uint64)])
        n, m, common = J.most_common(J.sketch(x), J.sketch(y))
        assert (n, m) == (len(x), len(y)) and common >= len(np.intersect1d(x, y))


def test_components_of_any_shape(spark):
    chain = [(i, i + 1) for i in range(200)]
    star = [(1000, 1000 + i) for i in range(1, 100)]
    df = spark.createDataFrame([*chain, *star, (5000, 5001), (7, 7)], "a long, b long")
    names = {r.node: r.component for r in J.components(df).collect()}
    groups = {}
    for n, c in names.items():
        groups.setdefault(c, set()).add(n)
    assert sorted(map(sorted, groups.values())) == [list(range(201)), list(range(1000, 1100)), [5000, 5001]]


def test_hashes_do_not_depend_on_pieces(monkeypatch):
    from ledgerspark.llm import common

    text = "Some WORDS of many-different lengths, " + "x" * 100 + " é " * 50 + "\x1c  end"
    whole = word_hashes(text)
    assert len(whole) == len(text.encode().lower().split())
    monkeypatch.setattr(common, "PIECE", 7)
    assert (word_hashes(text) == whole).all()
    assert len(shingle_set("a b", 3)) == 1 and len(shingle_set("a", 3)) == 1 and len(shingle_set(" ", 3)) == 0


def test_rows_without_id_or_of_one_id_stay_if_their_texts_differ(spark):
    near = " ".join(f"w{i}" for i in range(40))
    rows = [(None, "a b c"), (None, "d e f"), (None, "g h i"), (7, "j k l"), (7, "m n o"), (7, near), (3, near + " end"), (None, near)]
    rows += [(None, ""), (None, ""), (8, None), (8, ""), (8, ""), (None, "a b c")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = [(r.doc_id, r.text) for r in J.keep_one_of_each(df).collect()]
    expected = [(None, "a b c"), (None, "d e f"), (None, "g h i"), (7, "j k l"), (7, "m n o"), (3, near + " end"), (None, ""), (None, ""), (8, None), (8, "")]
    assert sorted(found, key=str) == sorted(expected, key=str)


def test_tasks_give_their_memory_back_at_the_end(monkeypatch):
    calls = []
    monkeypatch.setattr(J, "release_memory", lambda: calls.append(len(seen)))
    seen = []
    for x in J._frugal(lambda batches: (2 * b for b in batches))(iter([1, 2, 3])):
        seen.append(x)
    assert seen == [2, 4, 6] and calls == [3]


def test_pairs_whose_first_common_token_comes_too_late_are_not_formed(spark):
    """A common token of both prefixes is no longer enough: the sets must have enough left from it on. No linked pair is lost."""
    rnd = random.Random(5)
    texts = variants(rnd, " ".join(f"g{i}" for i in range(120)), 40, 5)
    join = J._Join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 3, 90, "text")
    members = join.postings.withColumn("component", F.col("set_id"))
    largest = members.groupBy("token").agg(F.max("component").alias("top"))
    formed = {frozenset((r.a, r.b)) for r in join.crossing(members, largest).collect()}
    by: dict = {}
    for r in join.postings.collect():
        by.setdefault(r.token, {})[r.set_id] = r.n
    near = {frozenset((a, b)) for m in by.values() for a in m for b in m if a < b and 90 * max(m[a], m[b]) <= 100 * min(m[a], m[b])}
    found = {J.set_id(s): set(s.tolist()) for s in (shingle_set(t, 3) for t in texts)}
    linked = {frozenset((a, b)) for a in found for b in found if a < b and 100 * len(found[a] & found[b]) >= 90 * len(found[a] | found[b])}
    assert linked and linked <= formed and len(formed) < 0.8 * len(near)
