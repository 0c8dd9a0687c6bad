"""Benchmark decontamination by a prefix-filtered set join.

Benchmark items become windows of ``width`` consecutive words (a shorter item is one window of its own size). A window's set is that of its shingles of
``SHINGLE`` words (fewer in shorter windows: the window itself). A window counts as contained only whole, so by the prefix principle one token is a
necessary prefix: its rarest shingle. Shingles are ordered by rarity over all windows (ties by hash), and a posting list leads from a rarest shingle to
the windows and its place in each.

A document's words are mapped to benchmark word numbers; only places whose shingle is some window's prefix probe. The length bound and the positional
bound (the window must lie inside the document) discard candidates, and what remains is verified word
by word. Windows are item-sized: an item's own number of words where that's below ``width``.

The benchmark is read in blocks of at most ``block_bytes`` of text (checked); each block is matched against all documents
and hits are merged per document. With one block, the usual case, documents are read once and nothing is shuffled.

Defined cases: null text has no words; an item without words has no windows; equal items are all reported; a repeated item_id
is reported once; a null item_id is matched, but not listed; item_id may be of any type that casts to a string; repeated documents are judged each; columns of docs
that bear the name of an added one are replaced, all others stay whatever their name; empty tables give n_hit 0 or no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text: str | None) -> list[bytes]:
    return WORD.findall((text or "").encode().lower())


SHINGLE, FACTOR, PROBES = 5, np.uint64(0x9E3779B97F4A7C15), 1 << 20


def shingle_hashes(ids: np.ndarray, size: int) -> np.ndarray:
    """Of every run of ``size`` word numbers, by a polynomial modulo 2^64."""
    x = ids.astype(np.uint64)
    h = np.zeros(len(x) - size + 1, np.uint64)
    for j in range(size):
        h = h * FACTOR + x[j : j + len(h)] + np.uint64(1)
    return h


class Windows:
    """Posting lists of one block of the benchmark."""

    def __init__(self, items: list[tuple[str | None, str | None]], width: int):
        windows: dict[tuple[bytes, ...], set[str]] = {}
        for item, text in items:
            w = words(text)
            for i in range(max(1, len(w) - width + 1) if w else 0):
                got = windows.setdefault(tuple(w[i : i + width]), set())
                if item is not None:
                    got.add(item)
        self.items = list(windows.values())
        self.number = {t: i for i, t in enumerate(sorted({t for w in windows for t in w}))}
        n = len(windows)
        self.size = np.array([len(w) for w in windows], np.int64)
        self.words = np.full((n, width), -2, np.int64)
        for k, w in enumerate(windows):
            self.words[k, : len(w)] = [self.number[t] for t in w]
        grams = [shingle_hashes(self.words[k, :m], min(m, SHINGLE)) for k, m in enumerate(self.size.tolist())]
        df = Counter(x for g in grams for x in set(g.tolist()))
        self.place = np.array([min(range(len(g)), key=lambda i: (df[g[i].item()], g[i].item(), i)) for g in grams], np.int64)
        first = np.array([g[p] for g, p in zip(grams, self.place, strict=True)], np.uint64)
        length = np.minimum(self.size, SHINGLE)
        self.lists = []  # of each shingle length: hashes, starts of their lists, windows
        for m in np.unique(length).tolist():
            own = np.flatnonzero(length == m)
            own = own[np.argsort(first[own], kind="stable")]
            keys, start = np.unique(first[own], return_index=True)
            self.lists.append((m, keys, np.append(start, len(own)), own))

    def match(self, w: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Places and windows of all occurrences in a document of these words."""
        get = self.number.get
        ids = np.fromiter((get(t, -1) for t in w), np.int64, len(w))
        known = np.concatenate([[0], np.cumsum(ids >= 0)])
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for m, keys, start, own in self.lists:
            if len(w) < m:
                continue
            place = np.flatnonzero(known[m:] - known[:-m] == m)
            if not len(place):
                continue
            h = shingle_hashes(ids, m)[place]
            k = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            hit = keys[k] == h
            place, k = place[hit], k[hit]
            ends = np.cumsum(start[k + 1] - start[k])
            a = 0
            while a < len(place):  # long lists are probed in parts of bounded size
                b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + PROBES, side="right")))
                found.append(self._verified(ids, place[a:b], start[k[a:b]], start[k[a:b] + 1], own))
                a = b
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at, win = (np.concatenate(x) for x in zip(*found, strict=True))
        return at, win

    def _verified(self, ids: np.ndarray, place: np.ndarray, start: np.ndarray, end: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = end - start
        win = own[np.repeat(start, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        at = np.repeat(place, n) - self.place[win]
        ok = (at >= 0) & (at + self.size[win] <= len(ids))
        at, win = at[ok], win[ok]
        for j in range(self.words.shape[1]):
            if not len(at):
                break
            want = self.words[win, j]
            ok = (want < 0) | (ids[np.minimum(at + j, len(ids) - 1)] == want)
            at, win = at[ok], win[ok]
        return at, win


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _blocks(benchmark: DataFrame, item_id: str, text: str, block_bytes: int) -> Iterator[list[tuple[str | None, str | None]]]:
    block: list[tuple[str | None, str | None]] = []
    size = 0
    for row in benchmark.select(F.col(item_id).cast("string").alias("i"), F.col(text).alias("t")).toLocalIterator():
        block.append((row["i"], row["t"]))
        size += len(row["t"] or "") * 4 + 16
        if size >= block_bytes:
            yield block
            block, size = [], 0
    if block:
        yield block


def decontaminate(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = 10, block_bytes: int = 8_000_000) -> DataFrame:
    """All columns of docs, then n_words, n_hit, n_items, items_sha256, contaminated and hit_spans (word places [start, end)).

    A document word inside any occurrence of a window is hit. key is not used in matching and may repeat.
    """
    added = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated", "hit_spans"]
    spark = docs.sparkSession
    out = docs.drop(*added)
    fields = ", ".join(f"`{c}` {t}" for c, t in out.dtypes)
    names = out.columns
    state = "_state" + "_" * max(map(len, names))
    for items in _blocks(benchmark, item_id, item_text, block_bytes):
        held = spark.sparkContext.broadcast(Windows(items, width))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            block = held.value
            for batch in batches:
                old = batch.column(state).to_pylist() if state in batch.schema.names else [None] * batch.num_rows
                rows = []
                for t, before in zip(batch.column(text), old, strict=True):
                    w = words(t.as_py())
                    at, win = block.match(w)
                    spans = list(zip(at.tolist(), (at + block.size[win]).tolist(), strict=True))
                    found: set[str] = set().union(*(block.items[k] for k in np.unique(win)))
                    if before:
                        spans += [(s["a"], s["b"]) for s in before["spans"]]
                        found |= set(before["items"])
                    rows.append({"n": len(w), "spans": [{"a": a, "b": b} for a, b in merged(spans)], "items": sorted(found)})
                keep = [batch.column(c) for c in names]
                kind = pa.struct([("n", pa.int64()), ("spans", pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))), ("items", pa.list_(pa.string()))])
                yield pa.RecordBatch.from_arrays([*keep, pa.array(rows, kind)], names=[*names, state])

        out = out.mapInArrow(run, f"{fields}, {state} struct<n: long, spans: array<struct<a: long, b: long>>, items: array<string>>")
    if state not in out.columns:  # no benchmark
        count = F.pandas_udf(lambda s: s.map(lambda t: len(words(t))).astype("int64"), "long")
        out = out.withColumn(state, F.struct(count(F.col(text)).alias("n"), F.array().cast("array<struct<a:bigint,b:bigint>>").alias("spans"), F.array().cast("array<string>").alias("items")))
    s = F.col(state)
    ids = F.array_join(F.array_sort(s["items"]), ",")
    hit = F.aggregate(s["spans"], F.lit(0).cast("long"), lambda acc, x: acc + x["b"] - x["a"])
    return out.select(*[F.col(f"`{c}`") for c in names], s["n"].alias("n_words"), hit.alias("n_hit"), F.size(s["items"]).cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), (hit > 0).alias("contaminated"), F.transform(s["spans"], lambda x: F.struct(x["a"].alias("start"), x["b"].alias("end"))).alias("hit_spans"))
