"""SimHash of token trigrams, in built-in expressions: a text's bit is 1 where at least half of its trigrams' hashes have a 1."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkgrain.functions.text import TERM

BITS = 64


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TERM), F.lit(0))


def trigrams(words: Column) -> Column:
    """Each three consecutive words; the words themselves where there are fewer than three."""
    n = F.size(words)
    three = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), n - 2)), lambda i: F.array_join(F.slice(words, i, 3), " "))
    return F.when(n >= 3, three).otherwise(words)


def hash64(text: Column) -> Column:
    """The first half of an MD5, as a signed long: a hash that other engines have, too."""
    return F.conv(F.substring(F.md5(text), 1, 16), 16, -10).cast("long")


def simhashes(rows: DataFrame, key: list[str], text: str) -> DataFrame:
    """key, hash, tokens of each row; rows without a token are left out. Rows that repeat key and text are one.

    Counts of the bits are summed where the rows are read: one row of 64 sums a text is all that is exchanged.
    """
    words = rows.select(*key, F.xxhash64(text).alias("_row"), tokens(F.col(text)).alias("_w"))
    grams = words.select(*key, "_row", F.size("_w").alias("_t"), F.explode(trigrams(F.col("_w"))).alias("_g")).withColumn("_h", hash64(F.col("_g")))
    ones = [F.sum(F.shiftrightunsigned("_h", i).bitwiseAND(F.lit(1))).alias(f"_s{i}") for i in range(BITS)]
    counted = grams.groupBy(*key, "_row").agg(F.max("_t").alias("tokens"), F.count("*").alias("_n"), *ones)
    bits = [F.when(2 * F.col(f"_s{i}") >= F.col("_n"), F.lit(1 << i if i < 63 else -(1 << 63))).otherwise(F.lit(0).cast("long")) for i in range(BITS)]
    while len(bits) > 1:  # as a shallow tree
        bits = [a.bitwiseOR(b) for a, b in zip(bits[::2], bits[1::2], strict=True)]
    return counted.select(*key, bits[0].alias("hash"), "tokens")


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))
