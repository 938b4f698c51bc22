"""Helpers of the text operators: tables, words and hashes."""

from __future__ import annotations

import ctypes
import gc
import hashlib
import os
import re
import tempfile
import zipfile
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession

LOWER = bytes(range(256)).lower()  # A-Z only
#: lower-cases A-Z and turns every other ASCII character but a-z and 0-9 into a space
ALNUM = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in LOWER)
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def ship(spark: SparkSession) -> None:
    """Send this package's code to the executors, once per session, so that their Python finds it wherever they run."""
    context = spark.sparkContext
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if getattr(context, "ledgerspark_shipped", False) or not os.path.isdir(root):
        return
    archive = os.path.join(tempfile.mkdtemp(), "ledgerspark_code.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, os.path.dirname(root)))
    context.addPyFile(archive)
    context.ledgerspark_shipped = True


BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Send texts to Python in batches of ``BATCH_ROWS`` from now on, unless the session has a size of its own.

    Spark's default of 10,000 rows is meant for numbers; that many texts are held several times over, in the executor and in Python.
    """
    if spark.conf.get(BATCH) == "10000":
        spark.conf.set(BATCH, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def release_memory() -> None:
    """Give freed memory back to the system. Python workers live on from task to task, and what a task freed would stay theirs."""
    gc.collect()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def plain_names(docs: DataFrame, *kept: str) -> tuple[DataFrame, list[str]]:
    """``docs`` with names for all columns but ``kept`` that clash with nothing, and the list of them; ``toDF`` gives the old ones back."""
    names = [c if c in kept else f"_column_{i}" for i, c in enumerate(docs.columns)]
    return docs.toDF(*names), names


def alnum_words(text: str | None) -> list[bytes]:
    """Runs of a-z, 0-9 and non-ASCII characters of the lower-cased text, as UTF-8."""
    return text.encode().translate(ALNUM).split() if text else []


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def sized(items: list, size: int, weight=len) -> Iterator[list]:
    """Consecutive pieces of ``items`` of about ``size`` in weight, at least one item each."""
    piece, held = [], 0
    for x in items:
        piece.append(x)
        held += weight(x)
        if held >= size:
            yield piece
            piece, held = [], 0
    if piece:
        yield piece


def mix64(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit numbers that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


POWER = 0x5851F42D4C957F2D
SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)  # keep the first n of eight bytes
PIECE = 1 << 20


def _hash_words(data: bytes) -> np.ndarray:
    """64-bit hashes of the words of ``data``, which are split at ASCII white space; eight bytes of all words at a time."""
    outside = SPACES[np.frombuffer(b" " + data + b" ", np.uint8)]
    edges = np.flatnonzero(outside[1:] != outside[:-1])
    starts, lengths = edges[::2], edges[1::2] - edges[::2]
    if not len(starts):
        return np.zeros(0, np.uint64)
    eights = np.ndarray((len(data),), "<u8", data + bytes(8), strides=(1,))  # the eight bytes from each place on
    found = mix64((eights[starts] & MASKS[np.minimum(lengths, 8)]) + lengths.astype(np.uint64) * np.uint64(POWER))
    at, longer = 8, np.flatnonzero(lengths > 8)
    while len(longer):
        part = eights[starts[longer] + at] & MASKS[np.minimum(lengths[longer] - at, 8)]
        found[longer] = mix64(found[longer] * np.uint64(POWER) + part)
        at += 8
        longer = longer[lengths[longer] > at]
    return found


def word_hashes(text: str | None) -> np.ndarray:
    """Hashes of the words ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased, in order.

    A long text is hashed in pieces cut between words, so that the arrays stay small.
    """
    if not text:
        return np.zeros(0, np.uint64)
    data = text.encode().translate(LOWER)
    if len(data) <= PIECE:
        return _hash_words(data)
    found, at = [], 0
    while at < len(data):
        cut = re.compile(rb"[\x20\x09-\x0D]").search(data, at + PIECE)
        end = cut.start() if cut else len(data)
        found.append(_hash_words(data[at:end]))
        at = end
    return np.concatenate(found)


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``k``-word shingles; a shorter text is one shingle, a text without words none."""
    words = word_hashes(text)
    n = len(words)
    if not n:
        return words
    width = min(k, n)
    total, factor = np.full(n - width + 1, width, np.uint64), 1
    for i in range(width):
        factor = factor * POWER % 2**64  # odd, another for each place
        total += words[i : n - width + 1 + i] * np.uint64(factor)
    found = mix64(total)
    found.sort()
    return found[np.flatnonzero(np.r_[True, found[1:] != found[:-1]])]
