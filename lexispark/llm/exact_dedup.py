"""Exact dedup by a heavy-hitter split: frequent digests are found by Misra-Gries counters and taken out on the map side.

DataFrame functions only. Steps:

1. Digest: SHA-256 of the normalised text (A-Z lower-cased). Only (row key, digest) go on, never a text.
2. Misra-Gries: ``freqItems`` keeps at most 1/support counters a task and merges them; every digest with more than
   support of all rows is among them. At most 1/support candidates exist, whatever the input.
3. Verification: the candidates' exact counts and winners, by an aggregate with map-side combine (at most 1/support
   rows a task are shuffled).
4. The verified winners (at most 1/support rows, a bound known beforehand) are broadcast; heavy rows are resolved on the
   map side without a shuffle. The remaining digests take an ordinary shuffle, in which no key has over support of the rows.

Defined cases: null text counts as empty; a null key loses to any other key (a group of null keys keeps null); equal keys
with equal text are one group, and each of those rows carries the group's answer; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispark.llm.text import ascii_lower
from lexispark.scratch import spill


def exact_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", support: float = 0.002) -> DataFrame:
    """One row per input row: key, keep_id, group_size, kept, text_sha256; the largest key of equal texts stays.

    support: digests with more than this share of the rows are heavy; at most 1/support rows are broadcast.
    """
    if not 0.0001 <= support <= 1:
        raise ValueError("support must lie between 0.0001 and 1: it bounds what is broadcast")
    norm = ascii_lower(F.coalesce(F.col(text), F.lit("")))
    d = spill(docs.select(F.col(key).alias("k"), F.unhex(F.sha2(norm, 256)).alias("d")), "digests")
    found = d.select(F.hex("d").alias("h")).freqItems(["h"], support).select(F.explode("h_freqItems").alias("h"))
    candidates = found.distinct().select(F.unhex("h").alias("d"))
    heavy = d.join(F.broadcast(candidates), "d", "left_semi").groupBy("d").agg(F.max("k").alias("keep_id"), F.count("*").alias("group_size"))
    heavy = spill(heavy, "heavy")
    marked = d.join(F.broadcast(heavy), "d", "left")
    light = marked.where("group_size is null").select("k", "d")
    groups = light.groupBy("d").agg(F.max("k").alias("keep_id"), F.count("*").alias("group_size"))
    done = marked.where("group_size is not null").select("k", "d", "keep_id", "group_size")
    rest = light.join(groups, "d").select("k", "d", "keep_id", "group_size")
    return done.unionByName(rest).select(
        F.col("k").alias(key), "keep_id", "group_size", F.col("k").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("d")).alias("text_sha256")
    )
