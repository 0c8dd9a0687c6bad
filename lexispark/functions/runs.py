"""Runs: consecutive postings of one list, packed in one row, so that joins, shuffles and sorts move a row a run and not a row a posting.

Items (docids, or termids in the direct index) are told from the run's first, frequencies and positions as they are, in numbers of as many bytes as the batch
needs. Python works in Arrow batches: built-in functions could tell a document's postings only by sorting all tokens. A batch of documents is inverted when it has
``GROUP`` tokens, which bounds memory; postings of a document never part, also where its docid is repeated, if rows come in order of docids.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GROUP = 4_000_000
ROWS = 50_000  # postings of a batch that is given back
PACKED = "base long, n long, cf long, maxtf long, sum_last long, item_bytes int, tf_bytes int, position_bytes int, items binary, tfs binary, positions binary"
RUNS = f"term string, {PACKED}"
NAMES = [c.split()[0] for c in PACKED.split(", ")]


def _narrow(x: np.ndarray) -> np.ndarray:
    top = int(x.max()) if len(x) else 0
    return x.astype("<u2" if top < 1 << 16 else "<u4" if top < 1 << 32 else "<i8")


def _wide(data: bytes | pa.Buffer, width: int) -> np.ndarray:
    return np.frombuffer(data, f"<{'i' if width == 8 else 'u'}{width}")


def _cut(x: np.ndarray, bounds: np.ndarray) -> pa.Array:
    offsets = (bounds * x.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(x))])


def pack(starts: np.ndarray, items: np.ndarray, tfs: np.ndarray, positions: np.ndarray | None, null_base: bool = False) -> list[pa.Array]:
    """The columns of ``PACKED`` of runs that begin at ``starts``; items don't fall inside a run."""
    n = len(starts)
    bounds = np.append(starts, len(items))
    sizes = np.diff(bounds)
    base = items[starts]
    rest, f = _narrow(items - np.repeat(base, sizes)), _narrow(tfs)
    ends = np.cumsum(tfs, dtype=np.int64)
    at = np.concatenate([[0], ends])[bounds]
    x = _narrow(positions) if positions is not None else np.zeros(0, "<u1")
    last = np.add.reduceat(positions[ends - 1].astype(np.int64), starts) if positions is not None else np.zeros(n, np.int64)
    width = lambda a: pa.array(np.full(n, a.itemsize, np.int32))
    return [
        pa.nulls(n, pa.int64()) if null_base else pa.array(base.astype(np.int64)),
        pa.array(sizes.astype(np.int64)),
        pa.array(np.diff(at)),
        pa.array(np.maximum.reduceat(tfs, starts).astype(np.int64)),
        pa.array(last),
        width(rest),
        width(f),
        width(x),
        _cut(rest, bounds),
        _cut(f, bounds),
        _cut(x, at) if positions is not None else pa.nulls(n, pa.binary()),
    ]


def _values(b: pa.RecordBatch, column: str, bytes_column: str) -> np.ndarray:
    """The numbers of all rows of a packed column, one row after the other."""
    data, widths = b.column(column), b.column(bytes_column).to_numpy()
    if (widths == widths[0]).all():
        offsets = np.frombuffer(data.buffers()[1], np.int32)[data.offset : data.offset + len(data) + 1]
        return _wide(data.buffers()[2][int(offsets[0]) : int(offsets[-1])], int(widths[0]))
    return np.concatenate([_wide(x, w).astype(np.int64) for x, w in zip(data.to_pylist(), widths.tolist(), strict=True)])


def unpack(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Items (from 0 where the run has none), frequencies and positions of a run."""
    x = _wide(row["positions"], row["position_bytes"]) if row.get("positions") is not None else None
    return _wide(row["items"], row["item_bytes"]).astype(np.int64) + (row["base"] or 0), _wide(row["tfs"], row["tf_bytes"]), x


class _Ids(dict):
    def __missing__(self, key: bytes) -> int:
        self[key] = n = len(self)
        return n


def _inverted(ids: _Ids, docids: list, toks: list[np.ndarray], max_term_length: int) -> Iterator[pa.RecordBatch]:
    """Runs of a group of documents in order, and one run without a term: the documents' lengths."""
    counts = np.array([len(t) for t in toks])
    own = np.array([0 if d is None else d for d in docids], np.int64)
    first = np.append(True, own[1:] != own[:-1])
    place = (np.cumsum(first) - 1).astype(np.int32)
    own = own[first]
    tok = np.concatenate(toks)
    pos = np.arange(len(tok), dtype=np.int32) - np.repeat((np.cumsum(counts) - counts).astype(np.int32), counts)
    doc = np.repeat(place, counts)
    names = list(ids)
    short = np.array([len(t) <= max_term_length for t in names], bool)
    if not short.all():
        keep = short[tok]
        tok, pos, doc = tok[keep], pos[keep], doc[keep]
    null = docids[0] is None
    columns = ["term", *NAMES]
    lengths = np.bincount(doc, minlength=len(own))
    yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.string()), *pack(np.zeros(1, np.int64), own, lengths, None, null)], names=columns)
    if not len(tok):
        return
    order = np.argsort(tok, kind="stable") if first.all() else np.lexsort((pos, doc, tok))
    tok, pos, doc = tok[order], pos[order], doc[order]
    other = np.append(True, tok[1:] != tok[:-1])
    posting = np.flatnonzero(other | np.append(True, doc[1:] != doc[:-1]))
    tfs = np.diff(np.append(posting, len(tok)))
    starts = np.flatnonzero(other[posting])
    terms = pa.array([names[i].decode() for i in tok[posting][starts].tolist()], pa.string())
    out = pa.RecordBatch.from_arrays([terms, *pack(starts, own[doc[posting]], tfs, pos, null)], names=columns)
    for a in range(0, len(starts), 10_000):
        yield out.slice(a, 10_000)


def runs_of(docs: DataFrame, docid: str, text: str, max_term_length: int, parts: int) -> DataFrame:
    """Runs of the documents' terms (``RUNS``), some for each term; runs without a term hold documents' lengths. Documents are dealt by ranges of docids."""
    own = docs.select(F.col(docid).cast("long").alias("docid"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    own = own.repartitionByRange(parts, "docid").sortWithinPartitions("docid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = re.compile(rb"[A-Za-z0-9]+").findall
        ids, docids, toks, size = _Ids(), [], [], 0
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                for d, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    if docids and (size >= GROUP and d != docids[-1] or (d is None) != (docids[-1] is None)):
                        yield from _inverted(ids, docids, toks, max_term_length)
                        ids, docids, toks, size = _Ids(), [], [], 0
                    found = words(t.lower())  # of bytes: A-Z only
                    toks.append(np.fromiter(map(ids.__getitem__, found), np.int32, len(found)))
                    docids.append(d)
                    size += len(found)
        if docids:
            yield from _inverted(ids, docids, toks, max_term_length)

    return own.mapInArrow(run, RUNS)


def lengths_of(runs: DataFrame) -> DataFrame:
    """docid, tf: a row for each posting of the runs, whatever their terms; of runs without terms, documents' lengths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                d, f, _ = unpack(row)
                d = pa.nulls(len(d), pa.int64()) if row["base"] is None else pa.array(d)
                out = pa.RecordBatch.from_arrays([d, pa.array(f.astype(np.int64))], names=["docid", "tf"])
                for a in range(0, out.num_rows, ROWS):
                    yield out.slice(a, ROWS)

    return runs.select("base", "item_bytes", "tf_bytes", "items", "tfs").mapInArrow(run, "docid long, tf long")


def rows_of(runs: DataFrame, positions: bool = True) -> DataFrame:
    """Runs with termids to postings (term, termid, docid, tf, positions), in the order in which they stand."""
    names = ["term", "termid", "docid", "tf", "positions"]

    def batch_of(b: pa.RecordBatch) -> pa.RecordBatch:
        n = b.column("n").to_numpy()
        which = pa.array(np.repeat(np.arange(len(n), dtype=np.int32), n))
        base = b.column("base")
        d = _values(b, "items", "item_bytes") + np.repeat(base.fill_null(0).to_numpy(zero_copy_only=False), n)
        f = _values(b, "tfs", "tf_bytes").astype(np.int64)
        if positions:
            x = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(f)]), pa.int32()), pa.array(_values(b, "positions", "position_bytes").astype(np.int32)))
        else:
            x = pa.nulls(len(d), pa.list_(pa.int32()))
        absent = np.repeat(base.is_null().to_numpy(zero_copy_only=False), n)
        return pa.RecordBatch.from_arrays([b.column("term").take(which), b.column("termid").take(which), pa.array(d, mask=absent), pa.array(f), x], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            upto = np.cumsum(b.column("n").to_numpy())
            a = 0
            while a < b.num_rows:  # so many runs that they have ROWS postings, one at least
                e = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + ROWS, "right")))
                out = batch_of(b.slice(a, e - a))
                for i in range(0, out.num_rows, ROWS):
                    yield out.slice(i, ROWS)
                a = e

    need = ["term", "termid", "base", "n", "item_bytes", "tf_bytes", "items", "tfs", *["position_bytes", "positions"] * positions]
    return runs.select(*need).mapInArrow(run, "term string, termid long, docid long, tf long, positions array<int>")


def runs_in(rows: DataFrame, key: list[str], item: str, positions: bool, cuts: list[int], types: str) -> DataFrame:
    """Runs of rows (key, item, tf, positions) as they stand, with pid: the place of the last of ``key`` among ``cuts``, first keys of parts in order.

    Rows in any order give right runs; rows in order of key and item give few.
    """
    bounds = np.array(cuts, np.int64)
    columns = [*key, item, "tf", *["positions"] * positions]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            if b.column(item).null_count:
                raise ValueError(f"{item} is null: a list of it can't be encoded")
            k, d, f = (b.column(c).to_numpy(zero_copy_only=False) for c in (key[-1], item, "tf"))
            starts = np.flatnonzero(np.append(True, (k[1:] != k[:-1]) | (d[1:] < d[:-1])))
            x = b.column("positions").flatten().to_numpy(zero_copy_only=False) if positions else None
            heads = [b.column(c).take(pa.array(starts)) for c in key]
            pid = np.maximum(np.searchsorted(bounds, k[starts], "right") - 1, 0).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*heads, pa.array(pid), *pack(starts, d, f, x)], names=[*key, "pid", *NAMES])

    return rows.select(*columns).mapInArrow(run, f"{types}, pid int, {PACKED}")


def joined(parts: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Runs of one list as one, in order of the items."""
    if len(parts) == 1:
        return parts[0]
    d, f = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    x = np.concatenate([p[2] for p in parts]) if parts[0][2] is not None else None
    if (d[1:] < d[:-1]).any():
        order = np.argsort(d, kind="stable")
        if x is not None:
            each = np.split(x, np.cumsum(f, dtype=np.int64)[:-1])
            x = np.concatenate([each[i] for i in order.tolist()])
        d, f = d[order], f[order]
    return d, f, x
