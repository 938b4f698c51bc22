import hashlib

from tokenizers import Tokenizer

import corpus_pipeline as P
from ledgerspark.llm import bpe, decontaminate, langid, pii
from ledgerspark.llm.common import table
from test_decontaminate import brute as hits_of
from test_jaccard import brute as groups_of


def test_stages_against_brute_force(spark, small):
    docs = table(spark, small, "documents")
    items = [(str(r.item_id), r.text) for r in table(spark, small, "benchmark").collect()]
    stages = dict(P.STAGES)
    assert [n for n, _ in P.STAGES] == ["language", "near_duplicates", "decontaminate", "personal_data", "tokens"]
    texts = {r.doc_id: r.text for r in docs.collect()}

    kept = stages["language"](spark, docs, small).cache()
    assert {r.doc_id for r in kept.collect()} == {i for i, t in texts.items() if langid.has_letter(t)}

    single = stages["near_duplicates"](spark, kept, small).cache()
    groups = groups_of([(r.doc_id, r.text) for r in kept.collect()], 5, 80)
    assert {r.doc_id for r in single.collect()} == {c for _, c in groups.values()} and single.count() < kept.count()

    clean = stages["decontaminate"](spark, single, small).cache()
    after = {r.doc_id: r for r in clean.collect()}
    for r in single.limit(60).collect():
        n, hit, _ = hits_of(r.text, items, decontaminate.WINDOW)
        if not hit:
            assert after[r.doc_id] == r
        else:
            assert (r.doc_id in after) == (hit <= 0.5 * n)
    assert decontaminate.contamination_report(clean, table(spark, small, "benchmark")).filter("n_hit >= 10 and n_words < 10").count() == 0

    masked = stages["personal_data"](spark, clean, small).cache()
    assert masked.count() == clean.count()
    for r in masked.collect():
        assert not pii.base_spans(r.text)
        assert not pii.base_spans(after[r.doc_id].text) or r.text != after[r.doc_id].text
        assert r.n_chars == len(r.text)
    for stage in (kept, single, clean, masked):
        assert stage.columns == docs.columns and stage.dtypes == docs.dtypes

    lib = Tokenizer.from_file(bpe.vocabulary_path())
    last = {r.doc_id: r for r in stages["tokens"](spark, masked, small).collect()}
    for r in masked.collect():
        ids = lib.encode(r.text, add_special_tokens=False).ids
        assert last[r.doc_id].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def test_run_and_odd_documents(spark, small, documents, monkeypatch):
    long = " ".join(f"w{i}" for i in range(30_000))
    docs = documents([None, "", "12 !", long, long, long + " x", "call a@b.co please now", "fine text stays here"])
    monkeypatch.setattr(P, "table", lambda s, d, name: docs if name == "documents" else table(s, small, name))
    out = P.run(spark, small)
    assert sorted(r.doc_id for r in out.collect()) == [3, 6, 7]
    monkeypatch.setattr(P, "table", lambda s, d, name: docs.limit(0) if name == "documents" else table(s, small, name))
    assert P.run(spark, small).count() == 0
