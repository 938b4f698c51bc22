"""URL filters with a Bloom filter cascade.

A key is a host and the beginning of a path. A listed key fits a URL if the host is the key's or a subdomain of it and the path
starts with the key's; so a URL is judged by looking up its own keys, the ends of its host with the beginnings of its path,
in the lengths that listed keys have. The lookup is exact without a join: the first Bloom filter encodes the listed keys;
every key of the whole corpus is then put to it, and those that pass though they are not listed, its false positives, are
encoded by a second filter; the listed keys that pass that one by the third; and so on until a level lets nothing wrong through.
A key of the corpus is listed if the first level that stops it is one of false positives, or if all let it pass and the last one
encodes listed keys. Levels shrink about a hundredfold each.

Only the cascade is broadcast. Its size follows from the number of listed keys and is measured before: a list beyond
``BROADCAST_BYTES`` is cut by hash into parts, and each part has its own cascade and its own pass over the URLs, between which the
results are written to the shared folder, so one cascade is in memory at a time. The keys of the corpus are hashed and tested where they are
read, and only those that pass the first level are shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerspark.llm.common import mix64
from ledgerspark.session import BROADCAST_BYTES, durable

BITS, MOST_BITS = 12, 64  # per key in a level: with 12, about 1 key in 300 passes wrongly
BLOCK = 1 << 15  # bits of a filter that are reduced together
MAX_LEVELS = 40
ALLOW, BLOCK_VERDICT = "allow", "block"

Rule = tuple[str, str, str]  # verdict, host, path


# ---- hosts, paths and keys ------------------------------------------------------------------------


def host_and_path(url: str | Column = "url") -> tuple[Column, Column]:
    """Host: between the first ``://`` and the next ``/``, ``?`` or ``#``, A-Z lower-cased. Path: from there to ``?`` or ``#``. Both are
    empty for a null URL or one without ``://``."""
    url = F.coalesce(F.col(url) if isinstance(url, str) else url, F.lit(""))
    start = F.locate("://", url)
    rest = F.when(start > 0, F.substring(url, start + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^([^?#]*)", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return lower, path


def url_keys(host: Column, path: Column, labels: Sequence[int], lengths: Sequence[int]) -> Column:
    """The keys of a URL, longest first: the last ``labels`` labels of its host with the first ``lengths`` characters of its path."""
    parts = F.size(F.split(host, r"\."))
    found = []
    for n in labels:
        end = F.substring_index(host, ".", -n)
        for m in lengths:
            key = F.concat(end, F.left(path, F.lit(m)) if m else F.lit(""))
            order = F.struct((-F.length(key)).alias("size"), (-F.length(end)).alias("host"), key.alias("key"))
            found.append(F.when((parts >= n) & (F.length(path) >= m), order))
    return F.transform(F.array_sort(F.array_compact(F.array(*found))), lambda x: x["key"])


def listed_keys(spark: SparkSession, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Table of listed keys: host (lower case) and path."""
    return spark.createDataFrame([(h, p) for h, p in pairs], "host string, path string")


def _hashed(keys: DataFrame) -> DataFrame:
    return keys.select("key", F.xxhash64("key").alias("h1"), F.xxhash64("key", F.lit(1)).alias("h2"))


# ---- one level ----------------------------------------------------------------------------------


@dataclass(frozen=True)
class Level:
    bits: np.ndarray
    hashes: int


def _places(h1: np.ndarray, h2: np.ndarray, level: int, size: int, hashes: int) -> Iterator[np.ndarray]:
    """Bit of each key for each hash function; every level has functions of its own."""
    salt = np.uint64((level + 1) * 0x9E3779B97F4A7C15 % 2**64)
    a, b = mix64(h1.view(np.uint64) ^ salt), mix64(h2.view(np.uint64) + salt) | np.uint64(1)
    for _ in range(hashes):
        yield a % np.uint64(size)
        a = a + b


def passes(number: int, level: Level, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """True where all bits of a key are set."""
    out, bits = np.ones(len(h1), bool), level.bits
    for at in _places(h1, h2, number, 8 * len(bits), level.hashes):
        out &= (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return out


def _encoded(keys: DataFrame, n: int, level: int, tested: int = 0) -> Level:
    """Bloom filter of ``n`` hashed keys: each task sets bits in blocks, which are united by block.

    The more keys are ``tested`` for each that is encoded, the more bits a key gets, so that false positives stay fewer than these.
    """
    wanted = math.ceil(1.44 * (math.log2(max(tested / max(n, 1), 1)) + 3))
    per_key = min(max(BITS, wanted), MOST_BITS)
    hashes = round(per_key * math.log(2))
    size = max(BLOCK, -(-n * per_key // BLOCK) * BLOCK)
    schema = "block long, bits binary"

    def united(held: dict[int, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([b.tobytes() for b in held.values()], pa.binary())], ["block", "bits"])

    def set_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            h1, h2 = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("h1", "h2"))
            for at in _places(h1, h2, level, size, hashes):
                for block in np.unique(at // np.uint64(BLOCK)):
                    inside = at[at // np.uint64(BLOCK) == block] % np.uint64(BLOCK)
                    bits = held.setdefault(int(block), np.zeros(BLOCK // 8, np.uint8))
                    np.bitwise_or.at(bits, (inside >> np.uint64(3)).astype(np.int64), np.uint8(1) << (inside & np.uint64(7)).astype(np.uint8))
        yield united(held)

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                bits = held.setdefault(block, np.zeros(BLOCK // 8, np.uint8))
                bits |= np.frombuffer(data, np.uint8)
        yield united(held)

    whole = np.zeros(size // 8, np.uint8)
    for r in keys.select("h1", "h2").mapInArrow(set_bits, schema).repartition("block").mapInArrow(unite, schema).collect():
        whole[r.block * BLOCK // 8 : (r.block + 1) * BLOCK // 8] = np.frombuffer(r.bits, np.uint8)
    return Level(whole, hashes)


# ---- the cascade ------------------------------------------------------------------------------------


def member(levels: Sequence[Level], h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """True for listed keys, exact for all keys that the cascade was built over."""
    out = np.full(len(h1), len(levels) % 2 == 1)
    left = np.arange(len(h1))
    for number, level in enumerate(levels):
        ok = passes(number, level, h1[left], h2[left])
        out[left[~ok]] = number % 2 == 1  # stopped by a level of false positives: listed
        left = left[ok]
    return out


def _flat(h1: pa.ListArray, h2: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all keys of a batch, and where each URL's begin."""
    starts = np.concatenate([[0], np.cumsum(np.asarray(h1.value_lengths().fill_null(0)))])
    return starts, *(np.asarray(h.flatten().to_numpy(zero_copy_only=False), np.int64) for h in (h1, h2))


def _kept(keys: DataFrame, number: int, level: Level) -> DataFrame:
    """The hashed keys that pass a level."""
    shared = keys.sparkSession.sparkContext.broadcast(level)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h1, h2 = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("h1", "h2"))
            yield batch.filter(pa.array(passes(number, shared.value, h1, h2)))

    return keys.mapInArrow(work, keys.schema)


def cascade(listed: DataFrame, urls: DataFrame, tested: int) -> list[Level]:
    """Levels of the cascade of hashed ``listed`` keys (key, h1, h2) over all keys of ``urls`` (arrays keys, h1, h2), no more than ``tested``."""
    spark = listed.sparkSession
    levels = [_encoded(listed, listed.count(), 0, tested)]
    shared = spark.sparkContext.broadcast(levels[0])

    @F.arrow_udf("array<boolean>")
    def through(h1: pa.Array, h2: pa.Array) -> pa.Array:
        starts, a, b = _flat(h1, h2)
        return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(passes(0, shared.value, a, b)))

    marked = urls.select(F.arrays_zip("keys", through("h1", "h2").alias("ok")).alias("x"))
    found = marked.select(F.explode(F.filter("x", lambda x: x["ok"])["keys"]).alias("key")).distinct()
    inside, outside = listed, durable(_hashed(found).join(listed.select("key"), "key", "left_anti"), "passed")
    while True:
        n = outside.count()
        if not n:
            return levels
        if len(levels) == MAX_LEVELS:
            raise ArithmeticError("keys that no level tells apart")
        levels.append(_encoded(outside, n, len(levels)))
        inside, outside = outside, durable(_kept(inside, len(levels) - 1, levels[-1]), "passed")


def _first_place(shared) -> Callable:
    """Place of the first member of a broadcast cascade among the keys of each URL."""

    @F.arrow_udf("int")
    def place(h1: pa.Array, h2: pa.Array) -> pa.Array:
        starts, a, b = _flat(h1, h2)
        hits = np.flatnonzero(member(shared.value, a, b))
        hit = np.append(hits, np.iinfo(np.int64).max)[np.searchsorted(hits, starts[:-1])]
        return pa.array(np.where(hit < starts[1:], hit - starts[:-1] + 1, 0).astype(np.int32))

    return place


def first_listed(urls: DataFrame, listed: DataFrame, name: str, *, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``urls`` (with arrays keys, h1, h2) and a column ``name``: the place, from 1, of its first key in the table ``listed`` (key); 0 if none is.

    ``limit``: bytes that a cascade may have; a longer list is done in parts, one after the other.
    """
    spark = urls.sparkSession
    keys = durable(_hashed(listed.select("key").distinct()), "listed")
    tested = urls.agg(F.coalesce(F.sum(F.size("keys").cast("bigint")), F.lit(0))).head()[0]
    parts = max(1, -(-keys.count() * MOST_BITS // (4 * limit)))  # a cascade is little larger than its first level; half of the limit is left free
    for part in range(parts):
        levels = cascade(keys.filter(F.pmod(F.col("h2"), F.lit(parts)) == part), urls, tested)
        if sum(len(level.bits) for level in levels) > limit + BLOCK * MAX_LEVELS:
            raise ArithmeticError("the cascade is larger than its limit: false positives exceed the listed keys")
        shared = spark.sparkContext.broadcast(levels)

        now = _first_place(shared)("h1", "h2")
        if part:
            now = F.when(F.col(name) == 0, now).when(now == 0, F.col(name)).otherwise(F.least(F.col(name), now))
        urls = urls.withColumn(name, now)
        if parts > 1:
            urls = durable(urls, "urls")  # one cascade in memory at a time
    return urls


# ---- the filter ---------------------------------------------------------------------------------------


def judge(
    pages: DataFrame, rules: Sequence[Rule], listed: DataFrame | None = None, *, url_col: str = "url", id_col: str = "page_id", limit: int = BROADCAST_BYTES
) -> DataFrame:
    """page_id, host, path, rule, verdict for every row.

    ``rules``: verdict, host, path; the longest that fits decides, a blocking one if two are alike. Without a rule, a URL is blocked if one of its keys is in
    ``listed`` (columns host, path), a table of any size, and allowed otherwise. Null URLs and those without ``://`` have an empty host and
    path and are allowed. Rows that repeat an id are judged each. Other columns are not read.
    """
    spark = pages.sparkSession
    for verdict, host, path in rules:
        if verdict not in (ALLOW, BLOCK_VERDICT) or not host or "/" in host or path[:1] not in ("", "/"):
            raise ValueError(f"not a rule: {verdict} {host}{path}")
    if listed is None:
        listed = listed_keys(spark, [])
    shape = listed.filter("host <> '' and path is not null").select(F.size(F.split("host", r"\.")).alias("labels"), F.length("path").alias("length"))
    sizes = shape.agg(F.collect_set("labels").alias("labels"), F.collect_set("length").alias("lengths")).head()
    labels = sorted({*sizes.labels, *(len(h.split(".")) for _, h, _ in rules)})
    lengths = sorted({*sizes.lengths, *(len(p) for _, _, p in rules)})
    host, path = host_and_path(url_col)
    urls = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    if not labels:
        return urls.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(ALLOW).alias("verdict"))
    urls = urls.withColumn("keys", url_keys(F.col("host"), F.col("path"), labels, lengths)).withColumns(
        {"h1": F.transform("keys", lambda k: F.xxhash64(k)), "h2": F.transform("keys", lambda k: F.xxhash64(k, F.lit(1)))}
    )
    tables = {v: listed_keys(spark, [(h, p) for w, h, p in rules if w == v]) for v in (ALLOW, BLOCK_VERDICT)}
    for name, table in {**tables, "listed": listed}.items():
        urls = first_listed(urls, table.select(F.concat("host", "path").alias("key")).dropna(), f"in_{name}", limit=limit)
    allowed, blocked = F.col(f"in_{ALLOW}"), F.col(f"in_{BLOCK_VERDICT}")
    blocks = (blocked > 0) & ((allowed == 0) | (blocked <= allowed))
    at = F.when(blocks, blocked).when(allowed > 0, allowed)
    verdict = F.when(blocks | (at.isNull() & (F.col("in_listed") > 0)), BLOCK_VERDICT).otherwise(ALLOW)
    return urls.select("page_id", "host", "path", F.when(at.isNotNull(), F.element_at("keys", at)).alias("rule"), verdict.alias("verdict"))
