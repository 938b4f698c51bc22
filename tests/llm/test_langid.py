import zlib

import numpy as np

from ledgerspark.llm import langid as L
from ledgerspark.llm.common import table
from ledgerspark.llm.queries import LLM_QUERIES


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r for r in table(spark, sf, "documents").collect()}
    got = LLM_QUERIES["op3_language"](spark, sf).collect()
    assert len(got) == len(docs)
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {i for i in docs if zlib.crc32(str(i).encode()) % 4 == 2}
    assert sum(docs[r.doc_id].lang == r.lang_pred for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in got)


def test_code_words():
    for n in (2, 3, 4, 6, 7, 40):
        code = L.codewords([f"l{i}" for i in range(n)])
        assert set(np.unique(code)) <= {-1.0, 1.0} and len({tuple(r) for r in code}) == n
        if n <= L.EXHAUSTIVE:
            assert code.shape[1] == 2 ** (n - 1) - 1


def test_prediction_sees_only_the_text(spark, small):
    docs = table(spark, small, "documents")
    model = L.train(docs.filter(~L.is_held_out()))
    plain = {r.doc_id: r.lang_pred for r in L.identify(docs, model).collect()}
    from pyspark.sql import functions as F

    changed = docs.withColumns({"lang": F.lit("xx"), "source": F.lit(None).cast("string")})
    assert {r.doc_id: r.lang_pred for r in L.identify(changed, model).collect()} == plain


def test_odd_rows(spark, documents):
    docs = documents([None, "", " 12 !? ", "the cat", "the cat", "é " * 40_000, "Ж"])
    out = L.language_report(docs).orderBy("doc_id").collect()
    assert [r.lang_pred for r in out] == ["und", "und", "und", "en", "en", "en", "en"]  # one language is known
    assert [r.doc_id for r in L.keep_identified(docs).orderBy("doc_id").collect()] == [3, 4, 5, 6]
    assert L.keep_identified(docs).columns == docs.columns
    nothing = L.language_report(docs.withColumn("lang", docs["lang"].substr(1, 0)).filter("doc_id < 0"))
    assert nothing.count() == 0
    from pyspark.sql import functions as F

    unlabelled = L.language_report(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in unlabelled} == {"und"} and {r.score for r in unlabelled} == {0.0}


def test_documents_stay_if_nothing_is_labelled(spark, documents):
    from pyspark.sql import functions as F

    docs = documents([None, "", "12 !?", "the cat", "Ж"]).withColumn("lang", F.lit(None).cast("string"))
    assert sorted(r.doc_id for r in L.keep_identified(docs).collect()) == [3, 4]
