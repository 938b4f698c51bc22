import numpy as np
import pytest

from ledgerspark.llm import topk as K
from ledgerspark.llm.queries import LLM_QUERIES
from ledgerspark.llm.common import table


def brute(vectors, queries, k):
    """(query, rank) -> (id, score) over dicts id -> list of ints."""
    out = {}
    for q, x in queries.items():
        scored = sorted((-sum(a * b for a, b in zip(x, y)), i) for i, y in vectors.items() if i != q)[:k]
        out |= {(q, n + 1): (i, -s) for n, (s, i) in enumerate(scored)}
    return out


def found(df):
    return {(r.query_id, r.rank): (r.vec_id, r.score) for r in df.collect()}


def whole(rows):
    return {r.vec_id: [int(np.floor(256 * float(v))) for v in r.embedding] for r in rows}


def test_query_against_brute_force(spark, small):
    vectors = whole(table(spark, small, "embeddings").collect())
    queries = {i: x for i, x in vectors.items() if i % 50 == 0}
    assert found(LLM_QUERIES["op8_topk"](spark, small)) == brute(vectors, queries, 5)


@pytest.mark.parametrize("block", [2, 256])
def test_ties_and_odd_vectors(spark, monkeypatch, block):
    monkeypatch.setattr(K, "BLOCK", block)
    monkeypatch.setattr(K, "GROUP_BLOCKS", 3)
    monkeypatch.setattr(K, "CHUNK", 4)
    rnd = np.random.default_rng(1)
    good = {int(i): [float(v) for v in rnd.integers(-2, 3, 3) / 4] for i in range(0, 300, 3)}
    rows = [(i, v, 0) for i, v in good.items()] + [(0, good[0], 1)]
    rows += [(1, None, 0), (4, [None, 0.5, 1.0], 0), (7, [float("nan"), 0.0, 0.0], 0), (10, [float("inf"), 0.0, 0.0], 0), (None, [1.0, 1.0, 1.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int")
    ints = {i: [int(np.floor(256 * x)) for x in v] for i, v in good.items()}
    got = found(K.search(df, df.filter("vec_id % 6 = 0 or vec_id = 4"), k=4))
    assert got == brute(ints, {i: x for i, x in ints.items() if i % 6 == 0}, 4)
    few = df.filter("vec_id in (3, 6)")
    assert found(K.search(few, few, k=4)) == brute({3: ints[3], 6: ints[6]}, {3: ints[3], 6: ints[6]}, 4)
    assert K.search(df.limit(0), df.limit(0)).count() == 0
