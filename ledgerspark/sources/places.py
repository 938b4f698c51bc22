"""Rows named by their place in Parquet files, and sets of places as bitmaps."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerspark.session import BROADCAST_BYTES

PLACE = ("_file", "_row")
WORDS = 512  # of 64 bits; one bitmap of Spark's covers 32,768 rows
MAX_BITMAPS = BROADCAST_BYTES // (8 * WORDS)


def with_places(files: DataFrame) -> DataFrame:
    """A table as it was read from files, with the place of each row."""
    return files.withColumns({"_file": F.col("_metadata.file_name"), "_row": F.col("_metadata.row_index")})


def place_bits(places: DataFrame, by: Iterable[str] = ()) -> DataFrame:
    """One bit per place; the bitmaps are apart for each value of ``by``."""
    block, bit = F.expr("bitmap_bucket_number(_row + 1)"), F.expr("bitmap_bit_position(_row + 1)")
    return places.groupBy(*by, "_file", block.alias("_block")).agg(F.bitmap_construct_agg(bit).alias("_bits"))


def at_places(
    placed: DataFrame, bits: DataFrame, by: Iterable[str] = (), *, carry: Iterable[str] = (), small: bool = True
) -> DataFrame:
    """Rows of ``placed`` whose place is in ``bits``.

    ``by`` names columns that tell apart files of the same name, ``carry`` columns of ``bits`` to add. ``small`` says that the bitmaps
    fit a broadcast: then no row is shuffled.
    """
    by, carry = list(by), list(carry)
    # A byte of a bitmap begins with its lowest bit, a word made of eight bytes with its highest byte.
    words = bits.select(
        *by, *carry, "_file", "_block",
        F.expr(f"transform(sequence(0, {WORDS - 1}), i -> cast(conv(hex(substring(_bits, 8 * i + 1, 8)), 16, -10) as bigint))").alias("_words"),
    )
    bit = "bitmap_bit_position(_row + 1)"
    met = placed.withColumn("_block", F.expr("bitmap_bucket_number(_row + 1)")).join(
        F.broadcast(words) if small else words, [*by, "_file", "_block"]
    )
    there = f"getbit(element_at(_words, cast({bit} div 64 as int) + 1), cast(8 * (7 - {bit} % 64 div 8) + {bit} % 8 as int)) = 1"
    return met.filter(there).select(*placed.columns, *carry)
