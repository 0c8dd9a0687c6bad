"""SimHash near-dedup: 64-bit fingerprints, linked within a Hamming radius, compared in bit slices.

Fingerprint: A-Z lower-cased, words between white space, shingles of three words (repeats count; fewer words: one shingle of
all; none: fingerprint zero), XXH64 (seed 42) of each; a bit is set if it is set in over half the hashes.

Candidates: the 64 bits are cut into ``blocks`` blocks. Fingerprints that differ in at most ``radius`` bits agree on at least
blocks - radius blocks, so they share one of the C(blocks, radius) keys of that many blocks: no link is lost. Only different
fingerprints are compared; copies were merged before by an aggregate with map-side combine.

Comparison: fingerprints that share a key are transposed into bit planes, 64 of them to a word. A query is compared with
a block of words plane by plane: XOR gives the differing fingerprints, and two counter planes plus an overflow plane take them up
by carry-save addition. Small groups, most by far, share bit planes of the differences of their pairs, a lane for each. Once every lane of a block has overflowed the radius the block is left. A local union-find keeps a link
to one representative for each, so what a task emits grows with its rows, not with pairs. Keys with over ``tile`` fingerprints are dealt
into tiles by hash, and each pair of tiles is a task's unit of its own: no key's fingerprints meet in one task beyond 2 x tile.

Defined cases: null text has no words; null keys are ignored when the smallest key is sought (a component of null keys has null);
repeated rows are linked like any; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexispark.llm.components import components
from lexispark.llm.sieve import passing
from lexispark.scratch import spill

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LITTLE = np.dtype("<u8")
SMALL = 24  # groups of so many fingerprints are compared pair by pair in common bit planes, larger ones query by query: the same counters either way


def fingerprint(text: str | None, width: int = 3) -> int:
    """The fingerprint as a signed 64-bit integer."""
    w = WORD.findall((text or "").encode().lower())
    if not w:
        return 0
    h = xxhash.xxh64_intdigest
    if len(w) <= width:
        value = h(b" ".join(w), 42)
        return value - (value >> 63 << 64)
    count, n = np.zeros(64, np.int64), len(w) - width + 1
    for a in range(0, n, 65536):
        b = min(n, a + 65536)
        grams = zip(*(w[a + i : b + i] for i in range(width)), strict=True)
        values = np.array([h(b" ".join(g), 42) for g in grams], LITTLE)
        count += np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits((2 * count > n).astype(np.uint8), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, text: str = "text", width: int = 3) -> DataFrame:
    """All columns of docs but the text, then fp (BIGINT)."""
    rest = [c for c in docs.columns if c not in (text, "fp")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = pa.array((fingerprint(t.as_py(), width) for t in batch.column(text)), pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), fp], names=[*rest, "fp"])

    kinds = dict(docs.dtypes)
    return docs.select(*[F.col(f"`{c}`") for c in [*rest, text]]).mapInArrow(run, "".join(f"`{c}` {kinds[c]}, " for c in rest) + "fp long")


ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def planes(fps: np.ndarray) -> np.ndarray:
    """64 bit planes of uint64 words; lane i of a plane is bit i % 64 of word i // 64."""
    n = -(-len(fps) // 64) * 64
    padded = np.zeros(n, LITTLE)
    padded[: len(fps)] = fps
    bits = np.unpackbits(padded.view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view(LITTLE)


def few_bits(differs: np.ndarray, radius: int = 3, block: int = 64) -> np.ndarray:
    """Lanes with at most ``radius`` (0 to 3) bits set in all of the 64 bit planes, by carry-save counting; blocks whose lanes are all past that are left."""
    found = []
    for a in range(0, differs.shape[1], block):
        part = differs[:, a : a + block]
        one = np.zeros(part.shape[1], np.uint64)
        two, over = one.copy(), one.copy()
        for bit in range(64):
            carry = one & part[bit]
            one ^= part[bit]
            over |= two & carry
            two ^= carry
            if bit % 8 == 7 and (over == ONES).all():
                break
        else:
            if radius < 3:
                over |= two & one if radius == 2 else two if radius == 1 else two | one
            near = np.unpackbits((~over).view(np.uint8), bitorder="little")
            found.append(np.flatnonzero(near) + a * 64)
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def within(query: int, sliced: np.ndarray, n: int, radius: int = 3) -> np.ndarray:
    """Lanes of the bit planes within the radius of the query."""
    flip = np.array([ONES if query >> bit & 1 else 0 for bit in range(64)], np.uint64)
    got = few_bits(sliced ^ flip[:, None], radius)
    return got[got < n]


def links(fps: np.ndarray, side: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, root) that connect what lies within the radius; if both sides occur, only links across sides are sought."""
    n, label = len(fps), np.arange(len(fps))
    two = side.any() and not side.all()
    targets = np.flatnonzero(side) if two else label.copy()
    queries = (np.flatnonzero(~side) if two else label).tolist()
    sliced = planes(fps[targets])
    for q in queries:
        met = label[targets[within(int(fps[q]), sliced, len(targets), radius)]]
        if (met != label[q]).any():
            met = np.unique(np.append(met, label[q]))
            label[np.isin(label, met)] = met[0]
    moved = np.flatnonzero(label != np.arange(n))
    return moved, label[moved]


def links_of_small(fps: np.ndarray, starts: np.ndarray, sizes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """As :func:`links` for many groups of few fingerprints each, whose pairs share one set of bit planes, a lane for each pair."""
    got: list[list[np.ndarray]] = [[], []]
    for size in np.unique(sizes[sizes > 1]).tolist():
        i, j = np.triu_indices(size, 1)
        first = starts[sizes == size]
        per = max(1, 65536 // len(i))
        for a in range(0, len(first), per):
            base = first[a : a + per, None]
            u, v = (base + i).ravel(), (base + j).ravel()
            near = few_bits(planes(fps[u] ^ fps[v]), radius)
            near = near[near < len(u)]
            got[0].append(u[near])
            got[1].append(v[near])
    u, v = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in got)
    root = {}
    for x, y in zip(u.tolist(), v.tolist(), strict=True):
        while root.get(x, x) != x:
            x = root[x]
        while root.get(y, y) != y:
            y = root[y]
        root[max(x, y)] = min(x, y)
    return np.array([*root.keys()], np.int64), np.array([*root.values()], np.int64)


def link_fingerprints(fps: DataFrame, radius: int = 3, blocks: int = 6, tile: int = 4096) -> DataFrame:
    """Links (u, v) between different fingerprints of column fp that connect all within the radius (0 to 3)."""
    if not 0 <= radius <= 3 or not radius < blocks <= 16:
        raise ValueError("radius must be 0 to 3 and below blocks")
    edges = [64 * i // blocks for i in range(blocks + 1)]
    masks = []
    for chosen in combinations(range(blocks), blocks - radius):
        m = sum((1 << edges[i + 1]) - (1 << edges[i]) for i in chosen)
        masks.append(m - (m >> 63 << 64))
    keys = F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m))) for i, m in enumerate(masks)])
    k = fps.select("fp", F.explode(keys).alias("key"))
    shared = k.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    k = k.join(shared, "key").withColumn("tiles", F.expr(f"cast((n + {tile - 1}) div {tile} as int)"))
    k = k.withColumn("t", F.pmod(F.xxhash64("fp"), F.col("tiles").cast("long")).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    k = k.select("key", F.least("t", "o").alias("a"), F.greatest("t", "o").alias("b"), (F.col("t") > F.col("o")).alias("side"), "fp")
    parts = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = k.repartition(parts, "key", "a", "b").sortWithinPartitions("key", "a", "b", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(group: np.ndarray, fps: np.ndarray, side: np.ndarray) -> pa.RecordBatch:
            starts = np.flatnonzero(np.concatenate([[True], (group[1:] != group[:-1]).any(axis=1)]))
            ends = np.append(starts[1:], len(group))
            small = ends - starts <= SMALL  # most groups; tiles of a key have sides and are never mixed with them
            small &= np.maximum.reduceat(side.astype(np.int8), starts) == 0
            i, r = links_of_small(fps, starts[small], (ends - starts)[small], radius)
            u, v = [fps[i]], [fps[r]]
            for s, e in zip(starts[~small].tolist(), ends[~small].tolist(), strict=True):
                i, r = links(fps[s:e], side[s:e], radius)
                u.append(fps[s:e][i])
                v.append(fps[s:e][r])
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (u, v)], names=["u", "v"])

        kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            kept.append((np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("key", "a", "b")], axis=1), batch.column("fp").to_numpy().view(np.uint64), batch.column("side").to_numpy(zero_copy_only=False).astype(bool)))
            if (kept[0][0][0] == kept[-1][0][-1]).all():
                continue
            group, fp, side = (np.concatenate(x) for x in zip(*kept, strict=True))
            cut = int(np.flatnonzero((group != group[-1]).any(axis=1))[-1]) + 1
            yield done(group[:cut], fp[:cut], side[:cut])
            kept = [(group[cut:], fp[cut:], side[cut:])]
        if kept:
            yield done(*(np.concatenate(x) for x in zip(*kept, strict=True)))

    return dealt.mapInArrow(run, "u long, v long")


def _labelled(docs: DataFrame, text: str, radius: int, blocks: int, width: int, tile: int, least: str) -> tuple[DataFrame, DataFrame]:
    """docs with fp instead of text, and fp, root of all fingerprints with the least value of the expression ``least`` in the group."""
    d = spill(fingerprints(docs, text, width), "fingerprints")
    each = spill(d.groupBy("fp").agg(F.min(F.expr(least)).alias("least")), "distinct-fingerprints")
    roots = components(link_fingerprints(each, radius, blocks, tile))
    named = each.join(roots, each["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    return d, spill(named, "roots")


def simhash_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = 3, blocks: int = 6, width: int = 3, tile: int = 4096) -> DataFrame:
    """One row per document: key, fingerprint (16 hex digits), component_id (smallest key reachable over links)."""
    d, named = _labelled(docs.select(F.col(key).alias("k"), F.col(text).alias("text")), "text", radius, blocks, width, tile, "k")
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = named.join(least, "root").select("fp", "component_id")
    return d.join(labels, "fp").select(F.col("k").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def simhash_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = 3, blocks: int = 6, width: int = 3, tile: int = 4096) -> DataFrame:
    """One row of each group: that of the smallest key (null keys last), then of the least hash of the text, then by the other columns. All columns stay.

    Only rows that go, and rows that have a double, are shuffled; a bitmap of these tells the others on the map side.
    """
    marks = {"_n": F.col(key).isNull(), "_k": F.coalesce(F.col(key), F.lit(0)), "_d": F.xxhash64(F.coalesce(F.col(text), F.lit("")))}
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *[v.alias(c) for c, v in marks.items()], F.col(text).alias("text"))
    d, named = _labelled(own.select(*marks, "text"), "text", radius, blocks, width, tile, "struct(_n, _k, _d)")
    stay = spill(named.groupBy("root").agg(F.min("least").alias("least")).select("least.*"), "rows-that-stay")
    mark = F.xxhash64(*marks)
    twice = d.groupBy(*marks).agg(F.count("*").alias("c")).where("c > 1").select(mark.alias("x"))
    doubt = spill(d.join(stay, list(marks), "left_anti").select(mark.alias("x")).union(twice).distinct(), "rows-in-doubt")
    tested = passing(own.drop("text"), mark, doubt)
    first = Window.partitionBy(*marks).orderBy("row")
    chosen = tested.where("may_be_member").join(stay, list(marks), "left_semi").withColumn("_r", F.row_number().over(first)).where("_r = 1")
    return tested.where("not may_be_member").select("row.*").unionByName(chosen.select("row.*"))
