import zlib

import numpy as np
from pyspark.sql import functions as F

from ledgerspark.llm import lm as M
from ledgerspark.llm.common import alnum_words, table
from ledgerspark.llm.queries import LLM_QUERIES


def test_probabilities_add_up_to_one():
    net = M.Network.fresh()
    padded = np.array([M.PAD, M.PAD, 5, 9, 77, 4000, M.PAD, M.PAD])
    total = 0.0
    for word in range(M.PAD):
        changed = padded.copy()
        changed[4] = word
        total += np.exp(net.log_probabilities(changed, np.array([4]))[0])
    assert abs(total - 1) < 1e-3


def test_both_sides_count():
    net = M.Network.fresh()
    base = np.array([M.PAD, M.PAD, 5, 9, 77, 40, M.PAD, M.PAD])
    score = net.log_probabilities(base, np.array([4]))[0]
    for at in (2, 3, 5, 6):
        changed = base.copy()
        changed[at] = 123
        assert net.log_probabilities(changed, np.array([4]))[0] != score


def test_training_beats_the_start_and_word_frequencies(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents").repartition(2)
    held = docs.filter("doc_id % 5 = 0")
    learned = docs.filter("doc_id % 5 <> 0")

    def mean(rounds):
        r = M.score(held, *M.train(learned, rounds=rounds)).agg(F.sum("log_likelihood"), F.sum("n_words")).head()
        return r[0] / r[1]

    start, one, many = mean(0), mean(1), mean(8)
    assert start < one < many
    ids = {w: i for i, w in enumerate(M.vocabulary(learned))}
    counts = np.ones(M.PAD)
    for r in learned.select("text").collect():
        counts += np.bincount(M.word_ids(alnum_words(r.text), ids), minlength=M.PAD)
    logs = np.log(counts / counts.sum())
    held_ids = np.concatenate([M.word_ids(alnum_words(r.text), ids) for r in held.select("text").collect()])
    assert many > logs[held_ids].mean() - 0.35  # on so few words; see README for larger corpora


def test_scores_do_not_depend_on_neighbouring_documents(spark, small):
    docs = table(spark, small, "documents")
    net, ids = M.train(docs, rounds=1)
    for r in M.score(docs, net, ids).limit(20).collect():
        words = M.word_ids(alnum_words(r.text), ids)
        assert r.n_words == len(words)
        padded = M._padded([words])
        at = np.flatnonzero(padded != M.PAD)
        assert abs(net.log_probabilities(padded, at).sum() - r.log_likelihood) < 1e-2 + 1e-4 * len(words)


def test_query_and_odd_rows(spark, small, documents):
    assert LLM_QUERIES["op2_likelihood"](spark, small).count() == table(spark, small, "documents").count()
    docs = documents([None, "", "!?", "one two", "one two", "word " * 60_000])
    out = M.score(docs, *M.train(docs)).orderBy("doc_id").collect()
    assert [r.n_words for r in out] == [0, 0, 0, 2, 2, 60_000]
    assert [r.log_likelihood for r in out[:3]] == [0.0] * 3 and [r.mean_log_likelihood for r in out[:3]] == [None] * 3
    assert abs(out[3].log_likelihood - out[4].log_likelihood) < 1e-4 and out[5].log_likelihood < 0
    assert M.likelihood_report(docs.limit(0)).count() == 0


def test_log_probabilities_stay_finite_and_at_most_0():
    for seed in range(4):
        net, rnd = M.Network.fresh(), np.random.default_rng(seed)
        word = int(rnd.integers(M.PAD))
        padded = M._padded([np.full(3000, word)])
        at = np.flatnonzero(padded != M.PAD)
        for scale, shift in ((1, 0), (300, 0), (1, 200), (1, -200)):  # weights as far as long steps may lead
            far = M.Network(net.embeddings, net.classes * scale, net.members * scale)
            far.classes[:, -1] += shift
            far.members[:, -1] += shift
            for _ in range(3):
                logs = far.log_probabilities(padded, at)
                assert np.isfinite(logs).all() and logs.max() <= 0
                far.step(padded, at, [np.zeros(len(t)) for t in far.tables])


def test_every_word_is_predicted_in_training(spark, documents):
    words = [f"w{i}" for i in range(16)]
    docs = documents([" ".join(words)] * 4 + ["single"])  # each word always stands at the same place
    net, ids = M.train(docs)
    fresh = M.Network.fresh()
    for word in [*words, "single"]:
        own = slice(ids[word.encode()] % M.CLASSES, None, M.CLASSES)
        assert np.abs(net.members[own] - fresh.members[own]).max() > 0, word
    padded = M._padded([np.arange(n) for n in (5, 0, 1, 8)])
    found = np.concatenate([M.targets([5, 0, 1, 8], padded, turn) for turn in range(M.ROUNDS)])
    assert sorted(found) == list(np.flatnonzero(padded != M.PAD))


def test_words_that_share_an_id_are_told_apart(spark, documents, monkeypatch):
    monkeypatch.setattr(M, "vocabulary", lambda docs, text_col="text", counts=None: [b"a", b"b"])
    alike = {}
    for i in range(2000):
        alike.setdefault(zlib.crc32(b"w%d" % i) % M.SHARED, []).append(f"w{i}")
    often, seldom, never = next(x for x in alike.values() if len(x) >= 3)[:3]
    docs = documents([f"a {often} b"] * 30 + [f"a {seldom} b", "a b", None], 0)
    counts = M.word_counts(docs)
    net, ids = M.train(docs, counts=counts)
    plain = {r.doc_id: r.log_likelihood for r in M.score(docs, net, ids).collect()}
    got = {r.doc_id: r.log_likelihood for r in M.likelihood_report(docs).collect()}
    for doc, share in ((0, 30 / 32), (29, 30 / 32), (30, 1 / 32), (31, 1), (32, 1)):
        assert abs(got[doc] - plain[doc] - np.log(share)) < 1e-3, doc
    other = documents([f"a {never} b"] * 2).withColumn("doc_id", F.lit(None).cast("long"))
    out = M.score(other, net, ids, counts=counts).collect()
    assert len(out) == 2 and all(abs(r.log_likelihood - plain[0] - np.log(1 / 32)) < 1e-3 for r in out)
    known, unseen = M.shares(counts, ids)  # the shares of an id's words and of unseen ones add up to one
    assert abs(sum(np.exp(r.share) for r in known.collect()) + np.exp(min(unseen)) - 1) < 1e-9
