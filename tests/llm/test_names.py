"""Columns of the documents that are called like temporary or result columns of the operators."""

import pytest

import corpus_pipeline as P
from ledgerspark.llm import decontaminate, langid, lm
from ledgerspark.llm.common import table

CLASHES = ["score", "ambiguous", "lang_pred", "pii_spans", "base_spans", "kept", "_set", "_row", "_text", "_whole", "_null", "rest", "_rest", "_share", "_told",
           "_found", "_scored", "n_words", "hit_runs", "hit_items", "token", "component", "set_id", "share", "word", "place", "_column_3", "vector", "n", "k"]
LONG = " ".join(f"w{i}" for i in range(200))
TEXTS = [LONG, LONG, LONG + " x", "plain text of its own", "mail me at a@b.co please now", None, "", "12 !"]


@pytest.fixture(params=["own ids", "repeated ids"])
def clashing(spark, request):
    ids = range(len(TEXTS)) if request.param == "own ids" else [0, 0, 1, 1, None, None, 2, 2]
    rows = [(i, t, "en", "s", len(t or ""), *[f"{c} {n}" for c in CLASHES]) for n, (i, t) in enumerate(zip(ids, TEXTS))]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHES))


def test_stages_keep_columns_of_any_name(spark, small, clashing):
    given = {r.score: r.asDict() for r in clashing.collect()}
    docs = clashing
    for name, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, small)
        assert docs.columns == clashing.columns and docs.dtypes == clashing.dtypes, name
        left = docs.collect()
        assert left, name
        for r in left:
            before = given[r.score]
            assert {c: r[c] for c in CLASHES} == {c: before[c] for c in CLASHES} and r.doc_id == before["doc_id"]
            assert r.text == before["text"] or name == "personal_data" and r.text == "mail me at [EMAIL] please now"
    assert sorted(r.text for r in docs.collect() if r.text != LONG) == ["mail me at [EMAIL] please now", "plain text of its own"] and docs.count() == 3
    assert P.STAGES[-1][1](spark, docs, small).count() == 3


def test_scores_beside_columns_of_any_name(spark, clashing):
    counts = lm.word_counts(clashing)
    network, ids = lm.train(clashing, counts=counts)
    got = lm.score(clashing, network, ids, counts=counts)
    assert [c for c in got.columns if c in CLASHES and c != "n_words"] == [c for c in CLASHES if c != "n_words"]
    assert all(r["rest"].startswith("rest ") and r["_row"].startswith("_row ") for r in got.collect())


def test_found_passages_beside_columns_of_any_name(spark, small, clashing):
    assert decontaminate.remove_contamination(clashing, table(spark, small, "benchmark")).columns == clashing.columns


def test_language_stage_decides_by_its_codewords(spark, small):
    """An even mixture of the languages is as far from every codeword and goes; what is labelled, or short but clear, stays."""
    docs = table(spark, small, "documents")
    model = langid.train(docs.filter(~langid.is_held_out()))
    assert 1 / len(model.languages) < model.doubtful < 1
    texts = {}
    for r in docs.filter("lang is not null and length(text) > 500").orderBy("doc_id").collect():
        texts.setdefault(r.lang, r.text[:500])
    unsure = [t for t in mixtures(list(texts.values()))
              if (lambda p: p[2][0] and p[1][0] < model.doubtful)(model.predict(langid.features(t)[None]))]
    assert unsure
    rows = [(10**9 + i, t, None, "junk", len(t)) for i, t in enumerate(unsure)]
    added = spark.createDataFrame(rows, docs.schema)
    kept = langid.keep_identified(docs.unionByName(added))
    assert kept.filter("source = 'junk'").count() == 0
    assert kept.count() == docs.filter("text rlike '[A-Za-zÀ-ÿ]'").count()


def mixtures(parts):
    import random

    rnd = random.Random(2)
    for _ in range(4000):
        words = [w for p in parts for w in rnd.sample(p.split(), min(len(p.split()), rnd.randrange(1, 6)))]
        yield " ".join(words)
