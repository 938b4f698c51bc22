import random

import numpy as np
import pytest

from ledgerspark.llm import urlfilter as U
from ledgerspark.llm.common import table
from ledgerspark.llm.queries import LISTED_URLS, LLM_QUERIES, URL_RULES

ODD = [None, "", "x", "://", "http://", "HTTP://A.EXAMPLE.ORG", "http://EXAMPLE.org/es/x?y#z", "a://org/", "http://xorg/", "http://org",
       "http://example.org/en/1", "http://b.example.org/en/12", "http://x.com:80/fr/", "http://éÉ.com/de/é", "h://a..com/fr/", "h://.org/",
       "http://q?://com/de/", "http://com#/de/", "http://www.spam-farm.example.com", "http://spam-farm.example.org/x", "http://notspam-farm.example.com/",
       "http://" + "a." * 5000 + "com/de/" + "x" * 100_000, "http://example.org./es/"]


def brute(url, rules, listed):
    host = path = ""
    if url and "://" in url:
        rest = url[url.index("://") + 3:]
        at = min([rest.find(c) for c in "/?#" if c in rest] + [len(rest)])
        host, rest = rest[:at], rest[at:]
        path = rest[: min([rest.find(c) for c in "?#" if c in rest] + [len(rest)])]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)

    def fits(h, p):
        return (host == h or host.endswith("." + h)) and path.startswith(p)

    found = [(len(h + p), v == "block", h + p, v) for v, h, p in rules if fits(h, p)]
    if found:
        return host, path, *max(found)[2:]
    return host, path, None, "block" if any(fits(h, p) for h, p in listed) else "allow"


def frame(spark, urls):
    rows = [(i, u, "<html>", "h", "p", "k", 1) for i, u in enumerate(urls)]
    return spark.createDataFrame(rows, "page_id long, url string, html string, host string, path string, keys string, verdict int")


def test_query_and_odd_urls_against_brute_force(spark, small):
    urls = {r.page_id: r.url for r in table(spark, small, "pages").collect()}
    got = {r.page_id: tuple(r)[1:] for r in LLM_QUERIES["op13_urls"](spark, small).collect()}
    assert got == {i: brute(u, URL_RULES, LISTED_URLS) for i, u in urls.items()}
    got = {r.page_id: tuple(r)[1:] for r in U.judge(frame(spark, ODD), URL_RULES, U.listed_keys(spark, LISTED_URLS)).collect()}
    assert got == {i: brute(u, URL_RULES, LISTED_URLS) for i, u in enumerate(ODD)}


@pytest.mark.parametrize("limit", [64 << 20, 6000])
def test_long_lists_are_exact_also_in_parts(spark, limit):
    rnd = random.Random(1)
    hosts = [f"{rnd.choice('abc')}.h{rnd.randrange(400)}.example.{rnd.choice(['com', 'net'])}" for _ in range(1500)]
    urls = [f"http://{h}/{rnd.choice(['en', 'fr'])}/{rnd.randrange(60)}" for h in hosts] * 2
    listed = {(h.split(".", 1)[1] if rnd.random() < 0.5 else h, rnd.choice(["", "/en/", "/fr/1"])) for h in hosts if rnd.random() < 0.3}
    listed = sorted(listed | {(f"unseen{i}.example.com", "/en/") for i in range(800)})
    got = {r.page_id: tuple(r)[1:] for r in U.judge(frame(spark, urls), URL_RULES, U.listed_keys(spark, listed), limit=limit).collect()}
    assert got == {i: brute(u, URL_RULES, listed) for i, u in enumerate(urls)}
    assert {v for *_, v in got.values()} == {"allow", "block"}


def test_levels_alternate_until_nothing_wrong_passes(spark, monkeypatch):
    monkeypatch.setattr(U, "BITS", 1)  # poor filters, many levels
    monkeypatch.setattr(U, "BLOCK", 64)
    monkeypatch.setattr(U.math, "log2", lambda x: -3.0)
    names = [f"k{i}" for i in range(3000)]
    urls = U._hashed(spark.createDataFrame([(n,) for n in names], "key string")).selectExpr("array(key) as keys", "array(h1) as h1", "array(h2) as h2")
    listed = U._hashed(spark.createDataFrame([(n,) for n in names[:500]], "key string"))
    levels = U.cascade(listed, urls, 3000)
    assert len(levels) > 3
    flat = urls.selectExpr("keys[0] as key", "h1[0] as h1", "h2[0] as h2").toPandas()
    inside = U.member(levels, flat.h1.to_numpy(), flat.h2.to_numpy())
    assert set(flat.key[inside]) == set(names[:500])


def test_no_rows_no_rules_and_bad_rules(spark):
    assert U.judge(frame(spark, []), URL_RULES).count() == 0
    got = U.judge(frame(spark, ["http://a.org/", None]), []).collect()
    assert [(r.host, r.path, r.rule, r.verdict) for r in got] == [("a.org", "/", None, "allow"), ("", "", None, "allow")]
    for rule in (("deny", "org", "/"), ("allow", "", "/"), ("allow", "org/x", "/"), ("allow", "org", "x")):
        with pytest.raises(ValueError):
            U.judge(frame(spark, []), [rule])


def test_longest_rule_wins_and_block_wins_ties(spark):
    rules = [("allow", "example.com", "/a"), ("block", "com", "/a/b/c/d/e/f"), ("allow", "x.com", ""), ("block", "x.com", "")]
    urls = ["http://example.com/a/b/c/d/e/f", "http://example.com/a/", "http://y.x.com/", "http://com/a"]
    got = {r.page_id: (r.rule, r.verdict) for r in U.judge(frame(spark, urls), rules).collect()}
    assert got == {0: ("com/a/b/c/d/e/f", "block"), 1: ("example.com/a", "allow"), 2: ("x.com", "block"), 3: (None, "allow")}


def test_one_pass_tests_the_keys_and_html_is_not_read(spark, small):
    from helpers import plan

    text = plan(LLM_QUERIES["op13_urls"](spark, small))
    assert "html" not in text.split("ReadSchema")[1].split("\n")[0] and "Join" not in text


def test_member_of_an_empty_list():
    assert not U.member([U.Level(np.zeros(8, np.uint8), 3)], np.arange(5), np.arange(5)).any()
