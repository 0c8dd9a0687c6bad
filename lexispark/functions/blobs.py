"""Encoded lists as a table, one row a list, and back: the codec in Arrow batches.

A list is the unit of encoding, as in the format; the rows of one list have to fit in a task. The row form of the postings has no such limit.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispark.functions import codec
from lexispark.functions.runs import ROWS, joined, runs_in, unpack

BLOBS = "term string, termid long, df long, cf long, sum_last long, docids binary, freqs binary, positions binary, docid_bits long, freq_bits long, position_bits long"
DIRECT_BLOBS = "docid long, n_terms long, length long, termids binary, freqs binary, termid_bits long, freq_bits long"


def _batch(rows: list[tuple], columns: list[tuple[str, pa.DataType]], head: list[pa.Array], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*head, *[pa.array([r[i] for r in rows], k) for i, (_, k) in enumerate(columns)]], names=[*names, *[c for c, _ in columns]])


def _by_list(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[dict, list[tuple]]]:
    """Of runs sorted by ``key``: the first row of each list, and its runs."""
    head, parts = None, []
    for b in batches:
        for a in range(0, b.num_rows, 256):
            for row in b.slice(a, 256).to_pylist():
                if head is None or row[key] != head[key]:
                    if head is not None:
                        yield head, parts
                    head, parts = {k: v for k, v in row.items() if not isinstance(v, bytes)}, []
                parts.append(unpack(row))
    if head is not None:
        yield head, parts


def _in_batches(rows: Iterator[tuple], fields: list[tuple[str, pa.DataType]], most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Rows as batches of at most 4096 rows and about ``most`` bytes of bit strings."""
    out, size = [], 0
    for row in rows:
        out.append(row)
        size += sum(len(x) for x in row if isinstance(x, bytes))
        if len(out) == 4096 or size >= most:
            yield _batch(out, fields, [], [])
            out, size = [], 0
    if out:
        yield _batch(out, fields, [], [])


def encode_lists(postings: DataFrame, n_docs: int, q: int, positions: bool = True, cuts: list[int] | None = None) -> DataFrame:
    """Postings (term, termid, docid, tf, positions) to one row of bit strings per term; without positions these are null and of no bits.

    Rows come in order of termid, in parts that begin at the termids ``cuts``.
    """
    cuts = cuts or [0]
    runs = runs_in(postings, ["term", "termid"], "docid", positions, cuts, "term string, termid long")
    sorted_runs = runs.repartitionById(len(cuts), "pid").sortWithinPartitions("termid", "base")
    fields = [("term", pa.string()), ("termid", pa.int64()), ("df", pa.int64()), ("cf", pa.int64()), ("sum_last", pa.int64()), ("docids", pa.binary()), ("freqs", pa.binary()), ("positions", pa.binary()), ("docid_bits", pa.int64()), ("freq_bits", pa.int64()), ("position_bits", pa.int64())]

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for head, parts in _by_list(batches, "termid"):
            d, f, x = joined(parts)
            f = f.astype(np.int64)
            cf = int(f.sum())
            (docids, docid_bits), (freqs, freq_bits) = codec.packed_docids(d, n_docs, q), codec.packed_freqs(f, cf, q)
            last, (bits, position_bits) = (int(x[np.cumsum(f) - 1].sum(dtype=np.int64)), codec.packed_positions(x, f, q)) if positions else (0, (None, 0))
            yield head["term"], head["termid"], len(d), cf, last, docids, freqs, bits, docid_bits, freq_bits, position_bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _in_batches(lists(batches), fields)

    return sorted_runs.mapInArrow(run, BLOBS)


def decode_lists(blobs: DataFrame, n_docs: int, q: int, positions: bool = True) -> DataFrame:
    """Bit strings back to postings (term, termid, docid, tf, positions); positions are null if not asked for."""
    names = ["term", "termid", "docid", "tf", "positions"]
    need = ["term", "termid", "df", "cf", "sum_last", "docids", "freqs", *["positions"] * positions]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            size = 0
            for row in (r for a in range(0, b.num_rows, 256) for r in b.slice(a, 256).to_pylist()):
                df, cf = row["df"], row["cf"]
                d, f = codec.read_docids(row["docids"], df, n_docs, q), codec.read_freqs(row["freqs"], df, cf, q)
                out.append((row["term"], row["termid"], d, f, codec.read_positions(row["positions"], f, cf, df + row["sum_last"], q) if positions else f))
                size += df
                if size > ROWS:
                    yield from batch_of(out)
                    out, size = [], 0
            if out:
                yield from batch_of(out)

    def batch_of(out: list[tuple]) -> Iterator[pa.RecordBatch]:
        n = [len(o[2]) for o in out]
        d, f = (np.concatenate([o[i] for o in out]) for i in (2, 3))
        if positions:
            x = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(f)]), pa.int32()), pa.array(np.concatenate([o[4] for o in out]), pa.int32()))
        else:
            x = pa.nulls(len(d), pa.list_(pa.int32()))
        terms = pa.array([o[0] for o in out], pa.string()).take(pa.array(np.repeat(np.arange(len(out)), n)))
        whole = pa.RecordBatch.from_arrays([terms, pa.array(np.repeat([o[1] for o in out], n), pa.int64()), pa.array(d, pa.int64()), pa.array(f, pa.int64()), x], names=names)
        for a in range(0, len(d), ROWS):
            yield whole.slice(a, ROWS)

    return blobs.select(*need).mapInArrow(run, "term string, termid long, docid long, tf long, positions array<int>")


def encode_direct(direct: DataFrame, doc_lengths: DataFrame, n_terms: int, q: int, cuts: list[int] | None = None) -> DataFrame:
    """The direct index (docid, termid, tf) to one row of bit strings per document, empty documents too; frequencies are bounded by the document's length.

    Rows come in order of docid, in parts that begin at the docids ``cuts``. Each row of ``doc_lengths`` has one, also where its docid is null or repeated.
    """
    cuts = cuts or [0]
    runs = runs_in(direct.where("docid is not null"), ["docid"], "termid", False, cuts, "docid long").withColumn("length", F.lit(None).cast("long"))
    bounds = np.array(cuts, np.int64)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.maximum(np.searchsorted(bounds, b.column("docid").fill_null(bounds[0].item()).to_numpy(zero_copy_only=False), "right") - 1, 0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at.astype(np.int32))], names=["docid", "length", "pid"])

    placed = doc_lengths.select("docid", "length").mapInArrow(place, "docid long, length long, pid int")
    # lengths first: nulls of base stand before others
    both = runs.unionByName(placed, allowMissingColumns=True).repartitionById(len(cuts), "pid").sortWithinPartitions("docid", "base")
    fields = [("docid", pa.int64()), ("n_terms", pa.int64()), ("length", pa.int64()), ("termids", pa.binary()), ("freqs", pa.binary()), ("termid_bits", pa.int64()), ("freq_bits", pa.int64())]
    none = np.zeros(0, np.int64)

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        docid, lengths, parts = None, [], []

        def out() -> Iterator[tuple]:
            d, f, _ = joined(parts) if parts else (none, none, None)
            for length in lengths:
                termids, freqs = codec.encode_docids(d, n_terms, q), codec.encode_freqs(f.astype(np.int64), length, q)
                yield docid, len(d), length, codec.pack(termids), codec.pack(freqs), len(termids), len(freqs)

        for b in batches:
            for a in range(0, b.num_rows, 256):
                for row in b.slice(a, 256).to_pylist():
                    if row["docid"] != docid:
                        yield from out()
                        docid, lengths, parts = row["docid"], [], []
                    if row["items"] is None:
                        lengths.append(row["length"])
                    else:
                        parts.append(unpack(row))
        yield from out()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _in_batches(lists(batches), fields)

    return both.select("docid", "length", "base", "item_bytes", "tf_bytes", "items", "tfs").mapInArrow(run, DIRECT_BLOBS)


def decode_direct(blobs: DataFrame, n_terms: int, q: int) -> DataFrame:
    """Bit strings of documents back to (docid, termid, tf)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, 256):
                out = []
                for row in b.slice(a, 256).to_pylist():
                    d = codec.decode_docids(codec.unpack(row["termids"]), row["n_terms"], n_terms, q)
                    out.append((np.full(len(d), row["docid"]), d, codec.decode_freqs(codec.unpack(row["freqs"]), len(d), row["length"], q)))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in zip(*out, strict=True)], names=["docid", "termid", "tf"])

    return blobs.select("docid", "n_terms", "length", "termids", "freqs").mapInArrow(run, "docid long, termid long, tf long")


def seek_in_lists(blobs: DataFrame, probes: DataFrame, n_docs: int, q: int, parts: int) -> DataFrame:
    """next-GEQ on encoded docid lists: probes (term, target) to (term, target, hit). Few probes of a list follow its pointers; for many the list is read once.

    Probes of a term that stand together travel as one row. They meet the term's list in one of ``parts`` tasks, in which one list is held at a time; targets without a list have no row.
    """

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            term = b.column("term")
            other = pc.fill_null(pc.not_equal(term.slice(1), term.slice(0, len(term) - 1)), True).to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(np.append(True, other))
            target = b.column("target")
            gone = target.is_null().to_numpy(zero_copy_only=False)
            t = np.where(gone, np.iinfo(np.int64).max, target.fill_null(0).to_numpy(zero_copy_only=False))  # a null target is sent as the largest number, past any list
            ends = np.append(starts[1:], len(t))
            yield pa.RecordBatch.from_arrays([term.take(pa.array(starts)), pa.array([t[a:e].tobytes() for a, e in zip(starts, ends, strict=True)], pa.binary())], names=["term", "targets"])

    asked = probes.select("term", F.col("target").cast("long").alias("target")).mapInArrow(packed, "term string, targets binary")
    both = blobs.select("term", "df", "docids").unionByName(asked.where("term is not null"), allowMissingColumns=True)
    dealt = both.repartition(parts, "term").sortWithinPartitions("term", F.col("docids").isNull())  # the list before its probes

    def hits_of(row: dict, t: np.ndarray) -> np.ndarray | list[int]:
        """The hits, -1 past the end."""
        if len(t) << q < row["df"]:
            return [-1 if h is None else h for h in (codec.next_geq(row["docids"], row["df"], n_docs, q, x) for x in t.tolist())]
        d = codec.read_docids(row["docids"], row["df"], n_docs, q)
        if isinstance(d, list):
            d.append(-1)
            return [d[bisect_left(d, x, 0, len(d) - 1)] for x in t.tolist()]
        return np.append(d, -1)[np.searchsorted(d, t)]

    def batch_of(out: list[tuple]) -> Iterator[pa.RecordBatch]:
        t, hits = (np.concatenate([o[i] for o in out]).astype(np.int64) for i in (1, 2))
        terms = pa.array([o[0] for o in out], pa.string()).take(pa.array(np.repeat(np.arange(len(out), dtype=np.int32), [len(o[1]) for o in out])))
        whole = pa.RecordBatch.from_arrays([terms, pa.array(t, mask=t == np.iinfo(np.int64).max), pa.array(hits, mask=hits < 0)], names=["term", "target", "hit"])
        for a in range(0, len(t), ROWS):
            yield whole.slice(a, ROWS)

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, np.ndarray]]:
        held, targets = None, []
        for b in batches:
            for a in range(0, b.num_rows, 256):
                for row in b.slice(a, 256).to_pylist():
                    if row["docids"] is not None:
                        if targets:
                            yield held, np.concatenate(targets)
                        held, targets = row, []
                    elif held is not None and row["term"] == held["term"]:
                        targets.append(np.frombuffer(row["targets"], np.int64))
        if targets:
            yield held, np.concatenate(targets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for row, t in gathered(batches):
            out.append((row["term"], t, hits_of(row, t)))
            size += len(t)
            if size >= ROWS:
                yield from batch_of(out)
                out, size = [], 0
        if out:
            yield from batch_of(out)

    return dealt.mapInArrow(run, "term string, target long, hit long")
