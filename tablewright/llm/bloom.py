"""A Bloom filter as a table of 64-bit words, for use in DataFrame operations.

A key sets ``BITS_PER_KEY`` bits inside one word. The table has a row of two longs for each word
that holds a bit, at most ``words`` rows whatever the input, and so may be broadcast. A filter
that more keys go into than it was made for raises more false alarms; it never misses a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS = 1 << 20
BITS_PER_KEY = 3


def with_bits(rows: DataFrame, key: Column, words: int = WORDS) -> DataFrame:
    """``rows`` with ``_tw_word`` and ``_tw_bits`` (the key's bits, each as a long)."""
    other = "xxhash64(_tw_low, 1)"
    bits = ", ".join(f"shiftleft(1L, cast(shiftright(_tw_other, {6 * n}) & 63 AS int))" for n in range(BITS_PER_KEY))
    mixed = rows.withColumn("_tw_low", F.xxhash64(key)).withColumn("_tw_other", F.expr(other))
    mixed = mixed.withColumn("_tw_word", F.pmod("_tw_low", F.lit(words)))
    return mixed.withColumn("_tw_bits", F.expr(f"array_distinct(array({bits}))")).drop("_tw_low", "_tw_other")


def filled(rows: DataFrame, key: Column, words: int = WORDS, repeated: bool = False) -> DataFrame:
    """The filter of the keys of ``rows``: ``_tw_word, _tw_mask``. With ``repeated``, only bits that
    two or more rows set."""
    bits = with_bits(rows, key, words).select("_tw_word", F.explode("_tw_bits").alias("bit"))
    if repeated:
        bits = bits.groupBy("_tw_word", "bit").agg(F.count("*").alias("n")).where("n > 1")
    return bits.groupBy("_tw_word").agg(F.bit_or("bit").alias("_tw_mask"))


def tested(rows: DataFrame, key: Column, held: DataFrame, name: str, words: int = WORDS) -> DataFrame:
    """``rows`` with the flag ``name``: false only for keys that are not in the filter ``held``."""
    own = F.aggregate("_tw_bits", F.lit(0).cast("long"), lambda sum_, bit: sum_.bitwiseOR(bit))
    marked = with_bits(rows, key, words).withColumn("_tw_bits", own)
    # At most `words` rows of two longs.
    marked = marked.join(F.broadcast(held), "_tw_word", "left")
    hit = F.coalesce(F.col("_tw_mask").bitwiseAND(F.col("_tw_bits")) == F.col("_tw_bits"), F.lit(False))
    return marked.withColumn(name, hit).drop("_tw_word", "_tw_mask", "_tw_bits")
