"""A bitmap of 64-bit keys that tells on the map side which rows can't find a partner, so that these aren't shuffled.

The bitmap has 16 bits for each key, up to ``MOST_BITS`` (16 MB), which bounds what is broadcast for any input. Past that bound more rows pass than
need to; every row that passes goes through an exact join anyway, so results don't depend on the bitmap's size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_BITS, WIDTH = 1 << 27, 1 << 15  # WIDTH: bits in a row of the bitmap, 512 numbers of 64 bits


def passing(df: DataFrame, key: Column, members: DataFrame) -> DataFrame:
    """df with a boolean column ``may_be_member``: false only where ``key`` (BIGINT) surely isn't in the one column of ``members``. Null keys are none."""
    (name,) = members.columns
    count = members.count()
    bits = WIDTH
    while bits < min(16 * count, MOST_BITS):
        bits *= 2
    place = lambda c: F.pmod(c, F.lit(bits))
    at = members.select(place(F.col(f"`{name}`")).alias("p"))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("p") % 64).cast("int"))
    none = df.sparkSession.range(0, bits // 64, 1, 1).select("id", F.lit(0).cast("long"))  # so that every word is there and has its place when they are sorted
    words = at.select(F.shiftright("p", 6).alias("word"), one.alias("bits")).union(none).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    maps = words.groupBy(F.shiftright("word", 9).alias("sieve_part")).agg(F.sort_array(F.collect_list(F.struct("word", "bits")))["bits"].alias("sieve_bits"))
    p = place(key)
    part = F.shiftright(p, 15)  # by WIDTH
    hit = F.getbit(F.get("sieve_bits", F.shiftright(p % WIDTH, 6).cast("int")), (p % 64).cast("int")) == 1
    tested = df.join(F.broadcast(maps), part == F.col("sieve_part"), "left")
    return tested.withColumn("may_be_member", F.coalesce(hit, F.lit(False))).drop("sieve_part", "sieve_bits")


def members_only(df: DataFrame, key: Column, members: DataFrame) -> DataFrame:
    """Rows of df whose key may be a member: all members, and a few others."""
    return passing(df, key, members).where("may_be_member").drop("may_be_member")
