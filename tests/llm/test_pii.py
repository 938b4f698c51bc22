import hashlib
import random
import re

import pytest

from ledgerspark.llm import pii as P
from ledgerspark.llm.common import table
from ledgerspark.llm.queries import LLM_QUERIES

PATTERNS = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)


def valid(kind, s):
    digits = re.sub("[^0-9]", "", s)
    if kind == 1:
        return all(int(p) <= 255 for p in s.split("."))
    if kind == 2:
        total = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits)))
        return 12 <= len(digits) <= 19 and total % 10 == 0
    return kind == 0 or 9 <= len(digits) <= 15


def brute(text):
    found = [(m.start(), m.end(), k) for k, p in enumerate(PATTERNS) for m in re.finditer(p, text or "") if valid(k, m.group())]
    return sorted(found, key=lambda s: (s[0], s[2]))


def test_order_is_by_start_and_then_kind():
    assert P.joined(P.base_spans("1.2.3.4@x.com 1.2.3.4")) == "email:0:13,ip:0:7,ip:14:21"


def test_base_spans_against_the_patterns():
    rnd = random.Random(9)
    pieces = ["a.b", "@", "x-y", ".", "com", "+", "1", "(826) ", "555-7388", " ", "4111 1111 1111 1111", "4111111111111111", "192.168.0.1", "256", "é", "-", "%", "00"]
    for _ in range(20_000):
        text = "".join(rnd.choice(pieces) for _ in range(rnd.randint(0, 12)))
        assert P.base_spans(text) == brute(text), text


def test_long_runs_take_linear_time():
    for text in ("1" * 300_000, "a" * 300_000 + "@", "1." * 150_000, "+1(" * 100_000, "a@" * 100_000):
        P.base_spans(text)


def test_query_keeps_every_base_span(spark, small):
    docs = {r.doc_id: r.text for r in table(spark, small, "documents").collect()}
    got = LLM_QUERIES["op4_pii"](spark, small).collect()
    assert len(got) == len(docs)
    for r in got:
        base = brute(docs[r.doc_id])
        listed = P.joined(base)
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for _, _, k in base) for i in range(4)]
        spans = [s.split(":") for s in r.spans.split(",")] if r.spans else []
        assert set(listed.split(",")) - {""} <= {":".join(s) for s in spans}
        assert [int(s[1]) for s in spans] == sorted(int(s[1]) for s in spans)


def training_texts(n=200):
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("aeiourstln") for _ in range(rnd.randint(2, 8)))
    make = [
        lambda: f"{word()}.{word()}@{word()}.example.org",
        lambda: ".".join(str(rnd.randint(0, 255)) for _ in range(4)),
        lambda: f"+1 ({rnd.randint(100, 999)}) 555-{rnd.randint(1000, 9999)}",
        lambda: str(rnd.randint(10, 999)),
        lambda: "4111111111111111",
    ]
    return [f"{word()} {word()} {word()} {rnd.choice(make)()} {word()} {word()} {word()}" for _ in range(n)]


def test_the_field_finds_other_spellings_and_leaves_the_rest():
    model = P.fit(training_texts())
    spans = lambda t: [(P.KINDS[k], t[a:b]) for a, b, k in P.all_spans(t, model)[1]]
    assert ("phone", "(826) 555-7388") in spans("please call (826) 555-7388 before noon")
    assert ("card", "4111/1111/1111/1111") in spans("paid with 4111/1111/1111/1111 today")
    for clean in ("the cat sat at home", "in 2023 we saw 12 of 45 at sea", "nothing here", "page 3 of 10", "version 1.2.3"):
        assert spans(clean) == []


def test_odd_rows(spark, documents):
    texts = [None, "", "mail a@b.co now", "mail a@b.co now", "x " * 60_000 + "10.0.0.1", "no data"]
    docs = documents(texts)
    out = P.pii_report(docs).orderBy("doc_id").collect()
    assert [r.spans for r in out[:4]] == ["", "", "email:5:11", "email:5:11"] and out[4].n_ip == 1
    masked = P.mask_pii(docs).orderBy("doc_id").collect()
    assert [r.text for r in masked] == [None, "", "mail [EMAIL] now", "mail [EMAIL] now", "x " * 60_000 + "[IP]", "no data"]
    assert masked[2].n_chars == len("mail [EMAIL] now") and P.mask_pii(docs).columns == docs.columns
    assert P.pii_report(docs.limit(0)).count() == 0


def test_every_trained_spelling_of_an_address_is_found(spark, documents):
    plain = ("jane.roe@example.org", "jane@mail.example.com")
    spelled = [P._rewritten(s, 0, way) for s in plain for way in range(6)] + ["jane.roe(at)example(dot)org", "jane (at) example.com", "jane at example.com"]
    texts = [f"please write to {s} before the end of the week" for s in spelled]
    for text in texts:
        assert len(P.windows(text)) == 1, text
    docs = documents(training_texts()).union(documents(texts, 1000)).union(documents(["we look at the house. then we go", "noon at last"], 2000))
    got = {r.doc_id: r.spans for r in P.pii_report(docs).collect()}
    for k, s in enumerate(spelled):
        assert got[1000 + k] == f"email:16:{16 + len(s)}", s
    assert got[2000] == got[2001] == ""
    masked = {r.doc_id: r.text for r in P.mask_pii(docs).collect()}
    assert {masked[1000 + k] for k in range(len(spelled))} == {"please write to [EMAIL] before the end of the week"}
    P.windows("at-" * 100_000)


def written(rnd, kind):
    """A span in a spelling that no pattern has."""
    word = lambda: "".join(rnd.choice("aeioubcdlmnrst") for _ in range(rnd.randint(3, 9)))
    if kind == "email":
        name = rnd.choice((word(), f"{word()}.{word()}", f"{word()}{rnd.randint(1, 99)}"))
        labels = [word() for _ in range(rnd.randint(1, 6))] + [rnd.choice(("com", "org", "de", "net", "uk"))]
        at, dot = rnd.choice(P.SPELLINGS)
        return name + at + dot.join(labels)
    if kind == "phone":
        return f"({rnd.randint(100, 999)}) {rnd.randint(100, 999)}-{rnd.randint(1000, 9999)}"
    while True:
        digits = "".join(rnd.choice("0123456789") for _ in range(16))
        if P.luhn(digits):
            return "/".join(digits[i : i + 4] for i in range(0, 16, 4))


CLEAN = """on 2024-01-02 12:30:45 it ran|look at example.com|met at noon dot com|version 10.2.3|order 20240102-123456 was sent|it was 12:30:45 then
from 01.02.2024 08:15 to 01.02.2024 09:45|isbn 978-3-16-148410-0 is it|the years 1999 2000 2001 and 2002|a total of 1,234,567,890 units
see us at www.example.org for more|we were at home dot and then|published at example.org in 2020|ratio 3.14159265358979|id 1234567890123 and so on
we look at house dot com|released 2023.11.05 in may|call at 12:30 or 14:45 on 05/06/2024|numbers 12 34 56 78 90 12|page available at docs.example.com/en
time 2024-01-02T12:30:45 ok|price 1 234 567 890 euro|see site at example dot org""".replace("\n", "|").split("|")


@pytest.mark.parametrize("folder", ["sf0.01", "sf0.1"])
def test_recall_and_precision_of_the_field_trained_on_the_given_tables(spark, folder):
    model = P.train(table(spark, f"/root/testdata/{folder}", "documents"))
    spans = lambda t: [(P.KINDS[k], t[a:b]) for a, b, k in P.all_spans(t, model)[1]]
    for clean in CLEAN:
        assert spans(clean) == [], clean
    assert spans("jane [at] mail [dot] example [dot] co [dot] uk") == [("email", "jane [at] mail [dot] example [dot] co [dot] uk")]
    rnd = random.Random(21)
    for kind in ("email", "phone", "card"):
        cases = [written(rnd, kind) for _ in range(150)]
        found = [spans(f"they said {s} in the end") for s in cases]
        right = sum((kind, s) in f for s, f in zip(cases, found))
        print(folder, kind, "whole spans found:", right / len(cases), "other spans:", sum(len(f) for f in found) - right)
        assert right >= 0.9 * len(cases), kind
        assert sum(len(f) for f in found) - right <= 0.05 * len(cases), kind


def test_long_texts_of_numbers():
    model = P.fit(training_texts(60))
    base, found = P.all_spans(" ".join(str(i * 7919) for i in range(20_000)) + " jane (at) example.com", model)
    assert found[-1][2] == 0 and set(base) <= set(found)
