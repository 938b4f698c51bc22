"""WARC archives without repeated payloads: revisit resolution.

Headers (page id, digest, length) are shuffled by payload digest, where the smallest page id of each repeated payload becomes
its response. The other captures of that payload are joined to it and become revisit records, which name the response
and carry no payload. Bodies meet their role by page id, so a payload that a third of all pages share makes no large
partition; headers of one digest are summed up before their shuffle, and their join can be split by Spark.

An archive is written by Spark's text writer: a record is one row, and the two line ends behind a record are the row
separator. It is read file by file, record by record, by the lengths that the headers state.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerspark.session import durable, shared_dir

CRLF = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2020-01-01T00:00:00Z"  # of the captures: the pages have none
RECORDS_PER_FILE = 10_000
PIECE_BYTES = 16 << 20


def captures(pages: DataFrame) -> DataFrame:
    """page_id, url, payload (null html: empty), payload_bytes and payload_digest of each page."""
    payload = F.coalesce("html", F.lit(""))

    @F.pandas_udf("string")
    def base32_of_hex(digests: pd.Series) -> pd.Series:
        return digests.map(lambda d: base64.b32encode(bytes.fromhex(d)).decode())

    return pages.select("page_id", "url", payload.alias("payload"), F.octet_length(payload).cast("long").alias("payload_bytes"),
                        base32_of_hex(F.sha1(F.encode(payload, "UTF-8"))).alias("payload_digest"))


def revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, payload_digest, refers_to: captures whose payload of at least ``min_bytes`` has a response of a smaller page id."""
    headers = captures(pages).select("page_id", "payload_digest", "payload_bytes").filter(F.col("page_id").isNotNull())
    headers = durable(headers, "warc-headers")
    originals = headers.groupBy("payload_digest", "payload_bytes").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("last"))
    repeated = durable(originals.filter((F.col("last") > F.col("refers_to")) & (F.col("payload_bytes") >= min_bytes)).drop("last"), "warc-responses")
    found = headers.join(repeated, ["payload_digest", "payload_bytes"]).filter(F.col("page_id") > F.col("refers_to"))
    return found.select("page_id", "payload_digest", "refers_to").dropDuplicates()


def _record_id(page_id: Column, digest: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(":"), digest, F.lit(">"))


def record(url: Column, page_id: Column, digest: Column, size: Column, refers_to: Column, payload: Column) -> Column:
    """The text of one record: WARC header, HTTP header and, for a response, the payload."""
    revisit = refers_to.isNotNull()
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), size.cast("string"), F.lit(CRLF * 2))
    block = F.when(revisit, http).otherwise(F.concat(http, payload))
    uri = F.regexp_replace(F.coalesce(url, F.lit("about:blank")), r"[\r\n]", "%0A")
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), _record_id(page_id, digest)),
        F.concat(F.lit("WARC-Target-URI: "), uri),
        F.lit(f"WARC-Date: {DATE}"),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), digest),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), _record_id(refers_to, digest))),
        F.when(revisit, F.lit(f"WARC-Profile: {PROFILE}")),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    ]
    return F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF * 2), block)  # concat_ws leaves out nulls


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, records_per_file: int = RECORDS_PER_FILE) -> None:
    """Write one record per page to gzipped archives under ``path``.

    Equal payloads of at least ``min_bytes``: the capture of the smallest page id is the response, those of larger ids are
    revisits of it. Rows that repeat the smallest id and its payload, and rows without page id, are responses. A null
    html is an empty payload, a null url ``about:blank``; other columns are left out.
    """
    roles = durable(revisits(pages, min_bytes), "warc-revisits")
    bodies = captures(pages).join(roles, ["page_id", "payload_digest"], "left")
    c = F.col
    text = record(c("url"), c("page_id"), c("payload_digest"), c("payload_bytes"), c("refers_to"), c("payload"))
    writer = bodies.select(text.alias("value")).write.option("lineSep", CRLF * 2).option("maxRecordsPerFile", records_per_file)
    writer.option("compression", "gzip").text(path)


def _records(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record of an archive."""
    while True:
        line = stream.readline()
        if not line:
            return
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("an archive holds something that is no record")
        fields = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode().partition(":")
            fields[name.lower()] = value.strip()
        size = int(fields["content-length"])
        block = stream.read(size)
        if len(block) != size:
            raise ValueError("a record is cut off")
        yield fields, block


def _page(record_id: str) -> int | None:
    number = record_id.strip("<>").split(":")[2]
    return int(number) if number else None


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """page_id, url, record_type, refers_to, payload_bytes, payload_digest and payload of every record under ``path``.

    The payload is null for revisits. A response whose payload does not have the digest or length of its header is an error.
    """

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"]

        def frame(rows):
            out = pd.DataFrame(rows, columns=names)
            return out.assign(page_id=pd.array(out["page_id"], dtype="Int64"), refers_to=pd.array(out["refers_to"], dtype="Int64"))

        for batch in batches:
            for content in batch["content"]:
                rows, held = [], 0
                for fields, block in _records(io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(content)))):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    size = int(http.decode().lower().partition("content-length:")[2].split()[0])
                    digest = fields["warc-payload-digest"].removeprefix("sha1:")
                    kind = fields["warc-type"]
                    if kind == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
                        raise ValueError("a payload is not what its header says")
                    refers_to = _page(fields["warc-refers-to"]) if kind == "revisit" else None
                    text = payload.decode() if kind == "response" else None
                    rows.append((_page(fields["warc-record-id"]), fields["warc-target-uri"], kind, refers_to, size, digest, text))
                    held += len(block)
                    if held > PIECE_BYTES:
                        yield frame(rows)
                        rows, held = [], 0
                if rows:
                    yield frame(rows)

    schema = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload string"
    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(parse, schema)


def resolved(records: DataFrame) -> DataFrame:
    """``records`` in which revisits have the payload of their response."""
    responses = records.filter("record_type = 'response'").select(F.col("page_id").alias("refers_to"), "payload_digest", F.col("payload").alias("original"))
    joined = records.join(responses.dropDuplicates(["refers_to", "payload_digest"]), ["refers_to", "payload_digest"], "left")
    return joined.withColumn("payload", F.coalesce("payload", "original")).select(*records.columns)


def archive_report(pages: DataFrame) -> DataFrame:
    """One row per page, read back from archives in the shared folder: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    path = f"{shared_dir(pages.sparkSession)}/archives-{uuid.uuid4().hex}"
    write_archives(pages, path)
    return read_archives(pages.sparkSession, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
