import random

import pytest

from ledgerspark.llm import decontaminate as D
from ledgerspark.llm.common import alnum_words, sha256, table


def windows(text, size):
    w = alnum_words(text)
    return [tuple(w)] if 0 < len(w) < size else [tuple(w[i : i + size]) for i in range(len(w) - size + 1)] if w else []


def brute(text, items, size):
    words, hit, found = alnum_words(text), set(), set()
    for item, item_text in items:
        for win in windows(item_text, size):
            for i in range(len(words) - len(win) + 1):
                if tuple(words[i : i + len(win)]) == win:
                    hit |= set(range(i, i + len(win)))
                    found.add(item)
    return len(words), len(hit), found


def test_automaton_against_brute_force():
    rnd = random.Random(4)
    for _ in range(300):
        size = rnd.randint(1, 5)
        items = [(f"i{k % 5}", " ".join(rnd.choice("abcä") for _ in range(rnd.randint(0, 9)))) for k in range(rnd.randint(0, 7))]
        machine = D.SuffixAutomaton(size)
        for name, text in items:
            machine.add(name, alnum_words(text))
        machine.close()
        for _ in range(5):
            text = " ".join(rnd.choice("abcdä") for _ in range(rnd.randint(0, 40)))
            runs, found = machine.scan(alnum_words(text))
            assert all(a < b for a, b in runs) and all(x[1] < y[0] for x, y in zip(runs, runs[1:]))
            assert (len(alnum_words(text)), sum(b - a for a, b in runs), found) == brute(text, items, size)


@pytest.mark.parametrize("shard", [1, 10**9])
def test_query_against_brute_force(spark, small, monkeypatch, shard):
    monkeypatch.setattr(D, "SHARD_WORDS", shard * 300)
    docs, items = table(spark, small, "documents"), table(spark, small, "benchmark")
    got = {r.doc_id: r for r in D.contamination_report(docs, items).collect()}
    listed = [(str(r.item_id), r.text) for r in items.collect()]
    owners = {}
    for item, text in listed:
        for w in windows(text, D.WINDOW):
            owners.setdefault(w, set()).add(item)
    assert len(got) == docs.count() and any(r.contaminated for r in got.values())
    for d in docs.collect():
        words = alnum_words(d.text)
        hit, found = set(), set()
        for size in {len(w) for w in owners}:
            for i in range(len(words) - size + 1):
                if own := owners.get(tuple(words[i : i + size])):
                    hit |= set(range(i, i + size))
                    found |= own
        r = got[d.doc_id]
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256) == (len(words), len(hit), len(found), sha256(",".join(sorted(found))))
        assert r.contaminated == bool(hit)


def test_odd_rows(spark, documents):
    long = "x y " * 60_000
    passage = "One two, three FOUR five six seven eight nine ten eleven"
    docs = documents([None, "", "  ", long + passage + " " + long, passage, passage, "short item!", "é ß"])
    items = spark.createDataFrame([(1, passage), (1, "short item"), (None, "é ß"), (3, None), (4, "?!")], "item_id long, text string")
    got = [r for r in D.contamination_report(docs, items).orderBy("doc_id").collect()]
    assert [r.n_words for r in got] == [0, 0, 0, 240_011, 11, 11, 2, 2]
    assert [r.n_hit for r in got] == [0, 0, 0, 11, 11, 11, 2, 2]
    assert got[7].items_sha256 == sha256("null") and got[6].items_sha256 == sha256("1")
    clean = D.remove_contamination(docs, items).orderBy("doc_id").collect()
    assert [r.doc_id for r in clean] == [0, 1, 2, 3] and clean[3].text == long + " " + long and clean[3].n_chars == len(long) * 2 + 1
    assert D.remove_contamination(docs, items).columns == docs.columns
    assert D.contamination_report(docs, items.limit(0)).filter("n_hit > 0").count() == 0
    assert D.contamination_report(docs.limit(0), items).count() == 0
