import numpy as np
import pytest

from ledgerspark.llm import whiten as W
from ledgerspark.llm.common import table
from ledgerspark.llm.queries import LLM_QUERIES

SCHEMA = "vec_id long, embedding array<float>, component int, n string, whitened double"


def brute(vectors, count=32):
    """Plain numpy on the whole matrix: deviations, eigenvalues, whitened rows up to sign, trace."""
    x = np.array([[int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v] for v in vectors], object)
    n, sums = len(x), x.sum(0)
    deviation = [int(((n * row - sums) ** 2).sum()) for row in x]
    centred = np.array(n * x - sums, float) / n
    v = centred.T @ centred / n
    e, u = np.linalg.eigh(v)
    keep = [i for i in np.argsort(-e)[:count] if e[i] > 1e-11 * max(e.max(), 1e-300)]
    return deviation, e[keep], centred @ u[:, keep] / np.sqrt(e[keep]), np.trace(v)


def check(got, vectors):
    deviation, e, white, trace = brute(vectors)
    n, k = len(vectors), len(e)
    assert len(got) == n * k
    by = {}
    for r in got:
        by.setdefault(r.component, []).append(r)
    assert sorted(by) == list(range(1, k + 1)) if k else not by
    for c, rows in by.items():
        rows.sort(key=lambda r: r.vec_id)
        assert {r.n for r in rows} == {n} and [r.deviation for r in rows] == deviation
        assert rows[0].explained == pytest.approx(e[c - 1] / trace, rel=1e-9)
        mine, theirs = np.array([r.whitened for r in rows]), white[:, c - 1]
        assert min(np.abs(mine - theirs).max(), np.abs(mine + theirs).max()) < 1e-6
    if got:
        assert len({r.identity_error for r in got}) == 1 and 0 <= got[0].identity_error < 1e-6


def test_query_against_brute_force(spark, small):
    rows = sorted(table(spark, small, "embeddings").collect(), key=lambda r: r.vec_id)
    got = LLM_QUERIES["op11_whiten"](spark, small)
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    check(got.collect(), [r.embedding for r in rows])


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [[0.5, 1.25, -3.0], [0.5, -1.25, 2.0], [7.0, 0.0, 0.25], [7.0, 0.0, 0.25], [-0.01, 0.0, 1e-9], [1.0, 2.0, 3.0]]
    bad = [None, [], [1.0, None, 2.0], [nan, 1.0, 2.0], [1.0, inf, 0.0], [1.0, -inf, 0.0], [1.0, 2.0], [1.0, 2.0, 3.0, 4.0]]
    rows = [(i, v, 3, "x", 0.5) for i, v in enumerate(good)] + [(100 + i, v, None, None, None) for i, v in enumerate(bad)]
    df = spark.createDataFrame(rows, SCHEMA)
    check(W.whiten(df).collect(), good)
    twice = df.union(df)  # repeated rows count twice, and are returned twice
    assert W.whiten(twice).filter("component = 1").count() == 2 * len(good)


def test_nothing_to_whiten(spark):
    def rows(*vectors):
        return spark.createDataFrame([(i, v, 1, "x", 0.5) for i, v in enumerate(vectors)], SCHEMA)

    for df in (rows([1.0]).limit(0), rows(None, []), rows([1.0, 2.0]), rows([1.0, 2.0], [1.0, 2.0])):
        got = W.whiten(df)
        assert got.count() == 0 and got.columns[:2] == ["vec_id", "component"]


def test_fewer_components_where_vectors_depend_on_each_other(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(-64, 64, (40, 3))
    vectors = (np.column_stack([base, base.sum(1), base[:, 0]]) / 64).tolist()
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>")
    got = W.whiten(df).collect()
    assert {r.component for r in got} == {1, 2, 3}
    check(got, vectors)


@pytest.mark.parametrize("kind", ["random", "multiple", "low rank", "graded", "near pair", "one"])
def test_contours_find_what_a_dense_solver_finds(kind):
    rng = np.random.default_rng(3)
    q = np.linalg.qr(rng.standard_normal((48, 48)))[0]
    spectra = {"multiple": [5.0] * 20 + [2.0] * 20 + [1.0] * 8, "graded": 10.0 ** -np.arange(48.0), "near pair": np.r_[3, 3 - 1e-10, np.linspace(2, 1, 46)]}
    if kind == "random":
        a = rng.standard_normal((200, 48))
        v = a.T @ a / 200
    elif kind == "low rank":
        a = rng.standard_normal((48, 5))
        v = a @ a.T
    elif kind == "one":
        v = np.array([[2.5]])
    else:
        v = q @ np.diag(spectra[kind]) @ q.T
    e, u = W.largest_components(v, 32)
    true = np.linalg.eigvalsh((v + v.T) / 2)[::-1]
    expected = min(32, int((true > 1e-11 * true[0]).sum()))
    assert len(e) in (expected, expected - 1) and (np.diff(e) <= 0).all()
    assert np.abs(e - true[: len(e)]).max() < 1e-13 * true[0]
    assert np.abs(u.T @ u - np.eye(len(e))).max() < 1e-13 and np.abs(v @ u - u * e).max() < 1e-13 * true[0]


def test_inertia_counts_eigenvalues():
    rng = np.random.default_rng(5)
    a = rng.standard_normal((30, 30))
    v = a + a.T
    form, true = W.tridiagonal(v), np.linalg.eigvalsh(v)
    for s in np.r_[np.linspace(-20, 20, 41), (true[1:] + true[:-1]) / 2]:
        assert W.below(form, s) == (true < s).sum()


def test_large_entries_fail_loudly(spark):
    df = spark.createDataFrame([(1, [1e30, 0.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<float>")
    with pytest.raises(Exception, match="does not fit a long"):
        W.whiten(df).collect()
