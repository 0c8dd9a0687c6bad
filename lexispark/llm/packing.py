"""Variable-capacity best-fit packing of documents into sequences of several permitted lengths.

A document's length is its UTF-8 bytes plus one end mark, as byte-level models count it. Longer documents than the largest
capacity are cut into pieces of that capacity and a rest; nothing is dropped. Pieces are dealt to shards by a hash of row and piece, so
copies and rows without a key spread too; the number of shards follows the total length and the number of pieces, so a shard is bounded in both
and its bins are filled in one task. In a shard, pieces go from long to short into the open bin with the least room that
holds them. If none does, a bin is opened: every permitted length that holds the piece is tried on the lengths still to come, filled by best fit, and that of
least cost per token filled is opened. At the end every bin is downsized to the smallest permitted length that holds its contents.

Cost of a sequence of c tokens: ``overhead`` + c + c^2 / ``quadratic``: what it costs to handle, linear layers, attention. Short lengths waste
overhead and long ones attention, so lengths have an optimum that depends on what is there to be packed.

Defined cases: null or empty text is one piece of length 1 (the end mark); a null key is kept; repeated rows are packed
each; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITIES = (1024, 2048, 4096, 8192, 16384)


def cost_of(c: int, overhead: float = 64.0, quadratic: float = 65536.0) -> float:
    """Cost of a sequence of c tokens."""
    return overhead + c + c * c / quadratic


def filled(falling: list[int], after: int, first: int, capacity: int) -> int:
    """Tokens in a bin that gets ``first`` and then, from long to short, whatever fits of the lengths behind place ``after``; falling: the lengths, negated."""
    room, j = capacity - first, after + 1
    while room and (j := bisect_left(falling, -room, j)) < len(falling):
        room += falling[j]
        j += 1
    return capacity - room


def pack(lengths: list[int], capacities: tuple[int, ...] = CAPACITIES, overhead: float = 64.0, quadratic: float = 65536.0) -> tuple[list[int], list[int], list[int], list[int]]:
    """Bin, offset, bin capacity and bin contents for each length; lengths must be sorted from long to short."""
    caps = sorted(capacities)
    cost = {c: cost_of(c, overhead, quadratic) for c in caps}
    falling = [-n for n in lengths]
    rooms: list[tuple[int, int]] = []  # (room, bin), sorted; bins without room aren't kept
    used: list[int] = []
    bins, offsets = [], []
    for i, n in enumerate(lengths):
        k = bisect_left(rooms, (n, -1))
        if k < len(rooms):
            room, b = rooms.pop(k)
        else:
            fills = {c: filled(falling, i, n, c) for c in caps if c >= n}
            b, room = len(used), min(fills, key=lambda c: (cost[caps[bisect_left(caps, fills[c])]] / fills[c], c))
            used.append(0)
        bins.append(b)
        offsets.append(used[b])
        used[b] += n
        if room > n:
            insort(rooms, (room - n, b))
    size = [caps[bisect_left(caps, u)] for u in used]
    return bins, offsets, [size[b] for b in bins], [used[b] for b in bins]


def best_fit(docs: DataFrame, key: str = "doc_id", text: str = "text", capacities: tuple[int, ...] = CAPACITIES, shard_tokens: int = 32_000_000, shard_pieces: int = 250_000, overhead: float = 64.0, quadratic: float = 65536.0) -> DataFrame:
    """One row per piece: key, piece, piece_start, piece_len, bin_id (shard and number), bin_capacity, bin_used, bin_offset.

    shard_tokens, shard_pieces: a shard's size; a bin left partly empty at a shard's end is the only loss against one shard.
    """
    most = max(capacities)
    n = (F.octet_length(F.coalesce(F.col(text), F.lit(""))) + 1).cast("long")
    lens = docs.select(F.col(key).alias("k"), n.alias("n"), F.monotonically_increasing_id().alias("row"))
    total, count = lens.agg(F.sum("n"), F.sum(F.expr(f"(n - 1) div {most} + 1"))).first()
    shards = max(1, -(-(total or 0) // shard_tokens), -(-(count or 0) // shard_pieces))
    cut = lens.select("k", "n", "row", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {most}"))).alias("piece"))
    pieces = cut.select("k", "row", "piece", (F.col("piece") * most).alias("start"), F.least(F.lit(most).cast("long"), F.col("n") - F.col("piece") * most).alias("len"))
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("row", "piece"), F.lit(shards))).drop("row")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["len", "k", "piece"], ascending=[False, True, True], ignore_index=True)
        b, o, c, u = pack(pdf["len"].tolist(), capacities, overhead, quadratic)
        return pd.DataFrame({"k": pdf["k"], "piece": pdf["piece"], "piece_start": pdf["start"], "piece_len": pdf["len"], "bin_id": [f"{s}-{x}" for s, x in zip(pdf["shard"], b, strict=True)], "bin_capacity": c, "bin_used": u, "bin_offset": o})

    kind = dict(docs.dtypes)[key]
    out = dealt.groupBy("shard").applyInPandas(run, f"k {kind}, piece long, piece_start long, piece_len long, bin_id string, bin_capacity long, bin_used long, bin_offset long")
    return out.withColumnRenamed("k", key)
