"""Suffix-array dedup: every byte covered by a long string that starts anywhere else is found, over all texts.

A window is a string of ``length`` bytes. A window's suffix need only be compared with suffixes that can share a window with it, so:

1. Anchors. The least hash of the ``gram``-byte strings inside a window is its anchor (the leftmost, if equal). Equal windows
   have equal anchors, at the same offset. The windows of an anchor are a run of starts; the bytes they cover are its context. Windows of
   a text thus become length / 2 times fewer anchors, with a 64-bit key (the gram) and a 64-bit hash of the context.
2. Anchors whose key occurs once have no window that repeats. Of the others, equal contexts are counted with map-side combine, by two 64-bit hashes:
   contexts that occur twice or more are repeated whole. What remains to be compared are contexts that are alike at the anchor, but not as a whole, where
   one of each kind stands for all.
3. These contexts are dealt and sorted by key. Each task keeps a logarithmic index family (:class:`IndexFamily`): a new batch gets its suffix array
   (starts of windows in the order of their bytes, by prefix doubling), is merge-scanned against each level for windows that occur there, and what is new becomes a
   level; levels of equal size merge, as in binary counting. Matches are told by bytes. When a family holds ``family_bytes`` of contexts, the next key begins a new
   one, so a task's memory doesn't grow with its partition. A key with over ``share_rows`` contexts is dealt to several tasks, each of which indexes its share of the
   windows (told by a hash) but holds all bytes of the key's different contexts.
4. Runs of repeated windows are merged per text and cut out.

Texts are identified by two 64-bit hashes, so copies (also of rows) are worked on together, and keys may be null or repeat.

Defined cases: null text is empty; texts shorter than a window keep all; matches never cross texts; very long texts are
read in pieces that overlap by a window; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispark.scratch import drop, spill, sweep

PIECE = 1 << 19
HEAVY = 1000
BASE = 0x9E3779B97F4A7C15
_tables: dict[int, np.ndarray] = {}


def _powers(base: int) -> np.ndarray:
    """base to the power 0 .. 2 x PIECE, modulo 2^64."""
    if base not in _tables:
        p = np.empty(2 * PIECE + 1, np.uint64)
        p[0], n = 1, 1
        while n < len(p):
            m = min(n, len(p) - n)
            p[n : n + m] = p[:m] * np.uint64(pow(base, n, 1 << 64))
            n += m
        _tables[base] = p
    return _tables[base]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Rolling:
    """Hashes of any substrings of some bytes (2 x PIECE at most), by a polynomial modulo 2^64 in prefix sums."""

    def __init__(self, data: np.ndarray, base: int = BASE):
        self.up = _powers(base)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(pow(base, -1, 1 << 64))[: len(data)], out=self.sums[1:])

    def all(self, n: int) -> np.ndarray:
        """Of every substring of n bytes."""
        return mix((self.sums[n:] - self.sums[:-n]) * self.up[: len(self.sums) - n])

    def some(self, start: np.ndarray, n: np.ndarray | int) -> np.ndarray:
        return mix((self.sums[start + n] - self.sums[start]) * self.up[start])


def sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    """Least of each w neighbours, by prefix and suffix minima of blocks of w."""
    n = len(v)
    blocks = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, np.uint64)
    blocks[:n] = v
    blocks = blocks.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - w + 1], ahead[w - 1 : n])


def anchors(data: bytes, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Of a text: keys, context hashes, first window starts and numbers of windows."""
    raw = np.frombuffer(data, np.uint8)
    out = []
    mask = np.uint64((1 << 20) - 1)
    for a in range(0, max(0, len(raw) - length + 1), PIECE):
        part = raw[a : a + PIECE + length - 1]
        roll = Rolling(part)
        g = roll.all(gram)
        place = np.arange(len(g), dtype=np.uint64)
        at = (sliding_min((g & ~mask) | place, length - gram + 1) & mask).astype(np.int64)
        lo = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        n = np.diff(np.append(lo, len(at)))
        whole = roll.some(lo, n - 1 + length) ^ mix(((at[lo] - lo) * 4096 + n).astype(np.uint64))
        out.append((g[at[lo]].view(np.int64), whole.view(np.int64), lo + a, n))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 4


def dense(x: np.ndarray) -> np.ndarray:
    """Ranks of values: 0, 1, ..., equal for equal ones."""
    by = np.argsort(x)
    held = x[by]
    out = np.empty(len(x), np.int64)
    out[by] = np.concatenate([[0], np.cumsum(held[1:] != held[:-1])]) if len(x) else by
    return out


def heads_of(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The first eight bytes at each start, as numbers that compare as the bytes do."""
    return sliding_window_view(data, 8)[starts].view(">u8").ravel().astype(np.uint64)


def suffix_ranks(data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Ranks, by their bytes, of the strings of ``length`` bytes at starts: a suffix array's order by prefix doubling. Equal strings, and no others, have equal ranks."""
    n, width = len(data), 8
    rank = dense(heads_of(np.concatenate([data, np.zeros(8, np.uint8)]), np.arange(n)))
    while 2 * width <= length:
        ahead = np.zeros(n, np.int64)
        ahead[: n - width] = rank[width:]
        rank, width = dense(rank * n + ahead), 2 * width
    return dense(rank[starts] * n + rank[starts + length - width])


def compare(a: np.ndarray, at: np.ndarray, b: np.ndarray, bt: np.ndarray, length: int) -> np.ndarray:
    """Byte by byte, pairs of strings (of ``a`` at ``at``, of ``b`` at ``bt``): negative, zero or positive. Short prefixes are compared first."""
    out = np.zeros(len(at), np.int16)
    for lo, hi in ((0, min(48, length)), (min(48, length), length)):
        open_ = np.flatnonzero(out == 0)
        for i in range(0, len(open_) if lo < hi else 0, 8192):
            some = open_[i : i + 8192]
            x, y = sliding_window_view(a, hi - lo)[at[some] + lo], sliding_window_view(b, hi - lo)[bt[some] + lo]
            first = (np.arange(len(some)), (x != y).argmax(axis=1))
            out[some] = x[first].astype(np.int16) - y[first]
    return out


@dataclass
class Level:
    """Windows in suffix order, none twice: the bytes they lie in, starts, ids, first eight bytes, and which of them were told to be repeated."""

    data: np.ndarray
    starts: np.ndarray
    ids: np.ndarray
    heads: np.ndarray
    told: np.ndarray

    def places(self, other: Level, length: int) -> tuple[np.ndarray, np.ndarray]:
        """For the windows of another level, in order: the place here of the first window that isn't less, and whether it's equal.

        First bytes are merged in order; what ties there is told by comparing bytes.
        """
        lo, hi = (np.searchsorted(self.heads, other.heads, side) for side in ("left", "right"))
        equal = np.zeros(len(lo), bool)
        todo = np.flatnonzero(lo < hi)
        while len(todo):
            mid = (lo[todo] + hi[todo]) >> 1
            c = compare(self.data, self.starts[mid], other.data, other.starts[todo], length)
            hi[todo] = np.where(c > 0, mid, hi[todo])
            lo[todo] = np.where(c > 0, lo[todo], mid + (c < 0))
            equal[todo[c == 0]] = True
            todo = todo[(c != 0) & (lo[todo] < hi[todo])]
        return lo, equal

    def merged(self, other: Level, length: int) -> Level:
        """Both levels, which share no window, as one."""
        at = self.places(other, length)[0]
        cols = [np.insert(mine, at, its) for mine, its in ((self.starts, other.starts + len(self.data)), (self.ids, other.ids), (self.heads, other.heads), (self.told, other.told))]
        return Level(np.concatenate([self.data, other.data]), *cols)


class IndexFamily:
    """A logarithmic family of suffix arrays. A window (string of ``length`` bytes) is in one level at most, and all matches are of bytes, not hashes.

    ``repeated`` gathers ids of windows that occur again.
    """

    def __init__(self, length: int) -> None:
        self.length, self.bytes = length, 0
        self.levels: list[Level] = []
        self.repeated: list[np.ndarray] = []

    def add(self, data: np.ndarray, starts: np.ndarray, ids: np.ndarray) -> None:
        """A new batch: its suffix array is scanned against every level for windows that are there; the rest becomes a level."""
        if not len(starts):
            return
        rank = suffix_ranks(data, starts, self.length)
        by = np.argsort(rank, kind="stable")
        same = np.concatenate([[False], rank[by][1:] == rank[by][:-1], [False]])
        found = same[:-1] | same[1:]
        self.repeated.append(ids[by[found]])
        first = ~same[:-1]
        batch = self._part(data, starts[by[first]], ids[by[first]], found[first])
        for level in self.levels:
            at, equal = level.places(batch, self.length)
            old = at[equal]
            self.repeated += [batch.ids[equal & ~batch.told], level.ids[old[~level.told[old]]]]
            level.told[old] = True
            if equal.any():
                batch = Level(data, *[x[~equal] for x in (batch.starts, batch.ids, batch.heads, batch.told)])
        self.bytes += len(data)
        while self.levels and len(self.levels[-1].starts) <= 2 * len(batch.starts):
            batch = self.levels.pop().merged(batch, self.length)
        if len(batch.starts):
            self.levels.append(batch)

    @staticmethod
    def _part(data: np.ndarray, starts: np.ndarray, ids: np.ndarray, told: np.ndarray) -> Level:
        return Level(data, starts, ids, heads_of(data, starts), told)


def _runs(family: IndexFamily, rows: list[np.ndarray], length: int) -> Iterator[pa.RecordBatch]:
    """What a family found as runs (d1, d2, s, e) of bytes; rows: (d1, d2, lo, single, ...) of its contexts."""
    meta = np.concatenate(rows)
    ids = np.unique(np.concatenate([np.zeros(0, np.int64), *family.repeated]))
    ids = ids[meta[ids >> 12, 3] == 1]
    if not len(ids):
        return
    cut = np.concatenate([[True], ids[1:] != ids[:-1] + 1])
    first, last = ids[cut], ids[np.append(np.flatnonzero(cut)[1:], len(ids)) - 1]
    of = meta[first >> 12]
    s = of[:, 2] + (first & 4095)
    e = of[:, 2] + (last & 4095) + length
    for i in range(0, len(s), 50_000):
        yield pa.RecordBatch.from_arrays([pa.array(x[i : i + 50_000]) for x in (of[:, 0], of[:, 1], s, e)], names=["d1", "d2", "s", "e"])


def _repeats(length: int, family_bytes: int):
    """Contexts (key, d1, d2, lo, single, share, shares, ctx) of a task, by key and share, to runs (d1, d2, s, e) of bytes that repeat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family, rows, total, last = IndexFamily(length), [], 0, None
        for batch in batches:
            meta = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("d1", "d2", "lo", "single", "share", "shares", "key")], axis=1)
            ctx = batch.column("ctx")
            size = pc.binary_length(ctx).to_numpy(zero_copy_only=False).astype(np.int64)
            group = meta[:, [6, 4]]
            change = np.flatnonzero((group[1:] != group[:-1]).any(axis=1)) + 1
            a = 0
            while a < len(size):
                if family.bytes > family_bytes and not np.array_equal(last, group[a]):
                    yield from _runs(family, rows, length)
                    family, rows, total = IndexFamily(length), [], 0
                ends = np.cumsum(size[a:])
                b = a + max(1, int(np.searchsorted(ends, PIECE, side="right")))
                if family.bytes > family_bytes:  # end with the key, to begin anew behind it
                    ahead = change[change > a]
                    b = min(b, int(ahead[0])) if len(ahead) else b
                data = np.frombuffer(b"".join(ctx[a:b].to_pylist()), np.uint8)
                n = size[a:b] - length + 1
                which = np.repeat(np.arange(b - a), n)
                offset = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
                start = np.repeat(ends[: b - a] - size[a:b], n) + offset
                if (meta[a:b, 5] > 1).any():
                    deal = Rolling(data).some(start, length)
                    own = deal % meta[a:b, 5][which].astype(np.uint64) == meta[a:b, 4][which].astype(np.uint64)
                    which, offset, start = which[own], offset[own], start[own]
                family.add(data, start, ((which + total) << 12) | offset)
                rows.append(meta[a:b, :4])
                total, last, a = total + b - a, group[b - 1], b
        if rows:
            yield from _runs(family, rows, length)

    return run


def _with_groups(rows: DataFrame, groups: DataFrame, on: list[str]) -> DataFrame:
    """Written rows joined with their groups, which have the number ``c`` of their rows each.

    At most ``HEAVY`` groups have over a ``HEAVY``-th of all rows; these are broadcast, so that no task gets all rows of a hot key.
    """
    most = rows.count() // HEAVY
    heavy, light = groups.where(F.col("c") > most), groups.where(F.col("c") <= most)
    rest = rows.join(F.broadcast(heavy.select(*on)), on, "left_anti")
    return rows.join(F.broadcast(heavy), on).unionByName(rest.join(light, on))


def repeated_spans(docs: DataFrame, text: str = "text", length: int = 400, gram: int = 40, share_rows: int = 20_000, family_bytes: int = 1 << 25) -> DataFrame:
    """Rows (d1, d2, s, e): byte spans of the text with these two hashes that are covered by repeated strings; they may overlap."""
    if not 8 <= gram < length <= 2048:
        raise ValueError("8 <= gram < length <= 2048 is needed")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    t = docs.select(*_hashes(text), F.col(text).cast("binary").alias("b")).where(F.length("b") >= length)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["d1", "d2", "key", "ctx", "lo", "n"]
        for batch in batches:
            got: list[list[np.ndarray]] = []
            size = 0
            for d1, d2, b in zip(*(batch.column(c) for c in ("d1", "d2", "b")), strict=True):
                key, ctx, lo, n = anchors(b.as_py(), length, gram)
                got.append([np.full(len(key), d1.as_py()), np.full(len(key), d2.as_py()), key, ctx, lo, n])
                size += len(key)
                if size > 100_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*got, strict=True)], names=names)
                    got, size = [], 0
            if size:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*got, strict=True)], names=names)

    all_anchors = spill(t.mapInArrow(find, "d1 long, d2 long, key long, ctx long, lo long, n long"), "anchors")
    keys = all_anchors.groupBy("key").agg(F.count("*").alias("c"), (F.min("ctx") != F.max("ctx")).alias("mixed")).where("c > 1")
    token = F.xxhash64("d1", "d2", "lo")
    keys = spill(keys, "anchor-keys")
    again = spill(_with_groups(all_anchors, keys, ["key"]).drop("c").withColumn("token", token), "repeated-anchors")
    drop(all_anchors, keys)
    del all_anchors, keys
    sweep(docs.sparkSession)
    kinds = spill(again.groupBy("key", "ctx").agg(F.count("*").alias("c"), F.min("token").alias("stands")), "contexts")
    known = _with_groups(again, kinds, ["key", "ctx"])
    whole = known.where("c > 1").select("d1", "d2", F.col("lo").alias("s"), (F.col("lo") + F.col("n") + (length - 1)).alias("e")).distinct()
    hot = kinds.groupBy("key").agg(F.count("*").alias("k")).where(F.col("k") > share_rows)
    need = known.where("mixed and token = stands").select("d1", "d2", "key", "lo", "n", (F.col("c") == 1).alias("single")).distinct()
    need = need.join(hot, "key", "left").select("*", F.expr(f"cast(coalesce((k + {share_rows - 1}) div {share_rows}, 1) as int)").alias("shares"))
    lists = need.groupBy("d1", "d2").agg(F.collect_list(F.struct("key", "lo", "n", "single", "shares")).alias("want"))

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds_out = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.binary())
        names = ["d1", "d2", "key", "lo", "single", "shares", "ctx"]
        for batch in batches:
            rows, size = [], 0
            for d1, d2, b, want in zip(*(batch.column(c) for c in ("d1", "d2", "b", "want")), strict=True):
                d1, d2, data = d1.as_py(), d2.as_py(), b.as_py()
                for w in want.as_py():
                    part = data[w["lo"] : w["lo"] + w["n"] + length - 1]
                    rows.append((d1, d2, w["key"], w["lo"], w["single"], w["shares"], part))
                    size += len(part)
                    if size > 4_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds_out, strict=True)], names=names)
                        rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds_out, strict=True)], names=names)

    once = t.dropDuplicates(["d1", "d2"])
    contexts = once.join(lists, ["d1", "d2"]).mapInArrow(slices, "d1 long, d2 long, key long, lo long, single boolean, shares int, ctx binary")
    shared = contexts.withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
    dealt = shared.repartition(parts, "key", "share").sortWithinPartitions("key", "share")
    return whole.union(dealt.mapInArrow(_repeats(length, family_bytes), "d1 long, d2 long, s long, e long"))


def _hashes(text: str):
    b = F.coalesce(F.col(text), F.lit(""))
    return F.xxhash64(b).alias("d1"), F.xxhash64(F.lit(1), b).alias("d2")


def suffix_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = 400, gram: int = 40) -> DataFrame:
    """One row per document: key, n_bytes, n_removed, n_spans, kept_sha256, spans (removed byte runs [start, end)).

    Each byte that lies in a string of ``length`` bytes that also starts anywhere else is removed.
    """
    spans = spill(repeated_spans(docs, text, length, gram), "spans")
    lists = spans.groupBy("d1", "d2").agg(F.collect_list(F.struct("s", "e")).alias("spans"))
    t = docs.select(F.col(key).alias("k"), *_hashes(text), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("b"))
    kind = dict(docs.dtypes)[key]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for b, spans in zip(batch.column("b"), batch.column("spans"), strict=True):
                data, runs = b.as_py(), []
                for s, e in sorted((x["s"], x["e"]) for x in spans.as_py() or ()):
                    if runs and s <= runs[-1]["end"]:
                        runs[-1]["end"] = max(runs[-1]["end"], e)
                    else:
                        runs.append({"start": s, "end": e})
                sha, at = hashlib.sha256(), 0
                for r in runs:
                    sha.update(data[at : r["start"]])
                    at = r["end"]
                sha.update(data[at:])
                rows.append((len(data), sum(r["end"] - r["start"] for r in runs), len(runs), sha.hexdigest(), runs))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            cols = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("k"), *cols], names=["k", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    out = t.join(lists, ["d1", "d2"], "left").mapInArrow(cut, f"k {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start: long, end: long>>")
    return out.withColumnRenamed("k", key)
