"""Membership in sets that are too large to broadcast: a Bloom filter lets through what may be in the set, and only that meets the set in an exact join.

Most of what isn't in the set so is known where it stands, without a shuffle; what passes the filter is joined exactly, so results don't depend on it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a filter for each member, and bits at most (8 MB): a set that needs more goes without a filter.
BITS_A_MEMBER, MOST_BITS = 12, 1 << 26
HASHES = 6


def _place(key: Column, i: int, bits: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(i), key), F.lit(bits))


def bloom(members: DataFrame, key: str) -> tuple[DataFrame, int] | None:
    """(one row with the bits of a Bloom filter as an array of 64-bit words, number of bits), or None where it would be over MOST_BITS. members are read twice."""
    bits = 1 << max(6, (max(1, members.count()) * BITS_A_MEMBER - 1).bit_length())
    if bits > MOST_BITS:
        return None
    places = F.explode(F.array(*(_place(F.col(key), i, bits) for i in range(HASHES)))).alias("p")
    set_bits = members.where(F.col(key).isNotNull()).select(places).select(F.shiftright("p", 6).alias("word"), F.expr("shiftleft(1L, CAST(p % 64 AS INT))").alias("bit"))
    every = members.sparkSession.range(bits >> 6).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("bit"))
    words = set_bits.unionByName(every).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    return words.agg(F.array_sort(F.collect_list(F.struct("word", "bits"))).alias("w")).select(F.col("w.bits").alias("_words")), bits


def maybe(key: Column, words: Column, bits: int) -> Column:
    """Whether a key may be among the members of a filter."""
    fit = F.lit(True)
    for i in range(HASHES):
        p = _place(key, i, bits)
        word = F.element_at(words, (F.shiftright(p, 6) + 1).cast("int"))
        fit = fit & (F.call_function("shiftright", word, (p % 64).cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1)
    return F.coalesce(fit, F.lit(False))


def split(rows: DataFrame, members: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows whose key is among the members' keys, rows whose key isn't). Null keys are among none, and rows keep their repetitions. Both sides should be tables."""
    own = members.select(key).where(F.col(key).isNotNull())
    made = bloom(own, key)
    if made is None:
        return rows.join(own.distinct(), key, "left_semi"), rows.join(own.distinct(), key, "left_anti")
    words, bits = made
    held = F.broadcast(words)  # MOST_BITS at most
    passed = maybe(F.col(key), F.col("_words"), bits)
    likely, never = rows.join(held, passed, "left_semi"), rows.join(held, passed, "left_anti")
    return likely.join(own.distinct(), key, "left_semi"), never.unionByName(likely.join(own.distinct(), key, "left_anti"))


def known_members(rows: DataFrame, members: DataFrame, key: str) -> DataFrame:
    return split(rows, members, key)[0]


def missing_members(rows: DataFrame, members: DataFrame, key: str) -> DataFrame:
    return split(rows, members, key)[1]
