import base64
import hashlib


from ledgerspark.llm import warc as W
from ledgerspark.llm.common import table
from ledgerspark.llm.queries import LLM_QUERIES


def expected(pages, min_bytes=0):
    first = {}
    for i, _, html in pages:
        if i is not None:
            first[html or ""] = min(first.get(html or "", i), i)
    out = []
    for i, _, html in pages:
        data = (html or "").encode()
        revisit = i is not None and first[html or ""] < i and len(data) >= min_bytes
        sha = base64.b32encode(hashlib.sha1(data).digest()).decode()
        out.append((i, len(data), sha, "revisit" if revisit else "response", first[html or ""] if revisit else None))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()), key=str)


def test_query_against_brute_force(spark, small):
    pages = [(r.page_id, r.url, r.html) for r in table(spark, small, "pages").collect()]
    assert got(LLM_QUERIES["op7_warc"](spark, small)) == expected(pages)


def test_odd_pages_round_trip(spark, tmp_path):
    tricky = "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.1\r\n\r\n"
    pages = [(5, "u", "same"), (3, None, "same"), (9, "a\r\nb", "same"), (4, "u", None), (6, "u", ""), (7, "u", tricky), (8, "u", "é😀" * 40_000), (None, "u", "same"), (3, None, "same")]
    df = spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, payload_digest int")
    for least, files in ((0, 10_000), (5, 2)):
        path = str(tmp_path / f"a{least}")
        W.write_archives(df, path, min_bytes=least, records_per_file=files)
        records = W.read_archives(spark, path)
        assert got(records) == expected(pages, least)
        back = sorted((str(r.page_id), r.payload) for r in W.resolved(records).collect())
        assert back == sorted((str(i), html or "") for i, _, html in pages)
        assert {r.url for r in records.collect()} == {"u", "about:blank", "a%0A%0Ab"}
    W.write_archives(df.limit(0), str(tmp_path / "none"))
    assert W.archive_report(df.limit(0)).count() == 0
