"""The codec and the stored index: round trips, closed forms, edge lists."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexispark.functions import codec
from lexispark.operators.index import TextIndex, term_partitions
from lexispark.plans.engine import Engine
from lexispark.scratch import new_path
from lexispark.sources import store


def test_worked_examples():
    assert np.flatnonzero(codec.encode_docids(np.array([1, 4, 7]), 10, 3)).tolist() == [0, 2, 4, 7, 9, 12]
    assert len(codec.encode_docids(np.array([1, 4, 7]), 10, 3)) == 13
    assert codec.encode_freqs(np.array([1, 3, 2]), 6, 3).tolist() == [1, 0, 0, 1, 0, 1]


@given(st.sets(st.integers(0, 3000), min_size=1), st.integers(0, 500), st.sampled_from([3, 4, 8]))
@settings(max_examples=150, deadline=None)
def test_docids(docs, spare, q):
    d = np.array(sorted(docs))
    n = int(d[-1]) + 1 + spare
    assert codec.decode_docids(codec.unpack(codec.pack(codec.encode_docids(d, n, q))), len(d), n, q).tolist() == d.tolist()


@given(st.lists(st.lists(st.integers(1, 2000), min_size=1, max_size=30), min_size=1, max_size=40), st.sampled_from([3, 4, 8]))
@settings(max_examples=100, deadline=None)
def test_freqs_and_positions(gaps, q):
    lists = [np.cumsum(g) - 1 for g in gaps]
    tfs = np.array([len(g) for g in gaps])
    bits = codec.unpack(codec.pack(codec.encode_freqs(tfs, int(tfs.sum()), q)))
    assert codec.decode_freqs(bits, len(tfs), int(tfs.sum()), q).tolist() == tfs.tolist()
    bits = codec.unpack(codec.pack(codec.encode_positions(lists, q)))
    u = len(lists) + sum(int(p[-1]) for p in lists)
    assert [p.tolist() for p in codec.decode_positions(bits, tfs, u, q)] == [p.tolist() for p in lists]


@pytest.mark.parametrize("docs", [[0], [9], [0, 9], list(range(10)), list(range(0, 10_000, 7))])
def test_edges(docs):
    n = docs[-1] + 1
    assert codec.decode_docids(codec.encode_docids(np.array(docs), n, 3), len(docs), n, 3).tolist() == docs


def test_faults():
    for bad in ([0], [5]):
        with pytest.raises(ValueError):
            codec.encode_freqs(np.array(bad), 3, 3)


@pytest.mark.parametrize("parts", [1, 2, 3])
def test_store(spark, parts):
    docs = spark.createDataFrame([(0, "The cat, the dog"), (1, None), (2, "dog 12 " + "x" * 30), (3, "")], "doc_id long, text string")
    e = Engine(spark, new_path(spark, "index")).build(docs, positions=True, partitions=parts).transpose()
    assert [r["length"] for r in e.doc_lengths().collect()] == [4, 0, 2, 0]
    assert tuple(e.stats().first()) == (4, 4, 5, 6)
    assert [tuple(r) for r in e.lexicon().select("term", "termid", "df", "cf", "maxtf").collect()] == [("12", 0, 1, 1, 1), ("cat", 1, 1, 1, 1), ("dog", 2, 2, 2, 1), ("the", 3, 1, 2, 2)]
    assert e.seek("dog", 1).first()["docid"] == 2 and e.seek("dog", 3).first() is None
    assert sorted(map(tuple, e.direct().collect())) == [(0, 1, 1), (0, 2, 1), (0, 3, 2), (2, 0, 1), (2, 2, 1)]
    assert sorted(map(tuple, e.direct_lists().collect())) == sorted(map(tuple, e.direct().collect()))
    want = sorted((r["term"], r["docid"], r["tf"], list(r["positions"])) for r in e.index().postings.collect())
    small = e.compress(new_path(spark, "index"), positions=True, partitions=parts, log2_quantum=1)
    assert sorted((r["term"], r["docid"], r["tf"], list(r["positions"])) for r in small.index().postings.collect()) == want
    assert [r["hit"] for r in small.seek_many(spark.createDataFrame([("dog", 1)], "term string, target long")).collect()] == [2]
    assert [r["num_tokens"] for r in small.stats().collect()] == [6] and small.properties()["num_terms"] == "4"
    assert small.transpose().direct_lists().count() == 5
    plain = e.compress(new_path(spark, "index"), positions=False, partitions=parts)
    assert not plain.has_positions() and plain.postings("the").count() == 1 and plain.seek("dog", 1).first()["docid"] == 2
    with pytest.raises(ValueError):
        plain.compress(new_path(spark, "index"), positions=True)
    with pytest.raises(FileExistsError):
        e.build(docs)
    with pytest.raises(FileExistsError):
        e.transpose()
    more = spark.createDataFrame([("zebra", 4, 1, 1, 1, 0)], e.lexicon().schema)
    store.append_lexicon(more, e.path)
    assert [r["term"] for r in e.lexicon().collect()][-1] == "zebra"
    with pytest.raises(ValueError):
        store.append_lexicon(more, e.path)


def test_cut_off_index_is_not_opened(spark):
    docs = spark.createDataFrame([(0, "a b")], "doc_id long, text string")
    e = Engine(spark, new_path(spark, "index"))
    docs.write.parquet(f"{e.path}/postings")
    with pytest.raises(Exception):
        e.index()
    with pytest.raises(FileExistsError):
        e.build(docs)


def test_commands(spark, tmp_path, capsys):
    from lexispark.__main__ import main

    spark.createDataFrame([(0, "a b b"), (1, "")], "doc_id long, text string").write.parquet(f"{tmp_path}/docs")
    (tmp_path / "stop").write_text("a\n")
    main(["build", f"{tmp_path}/docs", f"{tmp_path}/index", "-b", "--stopwords", f"{tmp_path}/stop"])
    main(["transpose", f"{tmp_path}/index", "-p", "2"])
    main(["compress", f"{tmp_path}/index", f"{tmp_path}/small", "-b", "-q", "3"])
    main(["doc-lengths", f"{tmp_path}/small"])
    assert capsys.readouterr().out.splitlines()[-2:] == ["0\t2", "1\t0"]


@given(st.sets(st.integers(0, 3000), min_size=1), st.sampled_from([1, 3, 8]), st.integers(-1, 3001))
@settings(max_examples=150, deadline=None)
def test_reads_by_pointers(docs, q, target):
    d = np.array(sorted(docs))
    n = 3001
    data = codec.pack(codec.encode_docids(d, n, q))
    assert codec.next_geq(data, len(d), n, q, target) == next((x for x in d.tolist() if x >= target), None)
    f = d % 7 + 1
    cf = int(f.sum())
    freqs = codec.pack(codec.encode_freqs(f, cf, q))
    i = target % len(d)
    assert codec.freq_at(freqs, len(d), cf, q, i) == f[i]
    lists = [np.arange(x) * 3 + x for x in f]
    packed = codec.pack(codec.encode_positions(lists, q))
    u = len(lists) + sum(int(p[-1]) for p in lists)
    assert codec.positions_at(packed, int(f[:i].sum()), int(f[i]), cf, u, q) == lists[i].tolist()


def test_stopwords_and_empty(spark):
    docs = spark.createDataFrame([(0, "the cat")], "doc_id long, text string")
    stop = spark.createDataFrame([("the",)], "term string")
    assert [r["term"] for r in TextIndex.build(docs, stopwords=stop).lexicon.collect()] == ["cat"]
    assert tuple(TextIndex.build(docs.limit(0)).stats().first()) == (0, 0, 0, 0)
    assert term_partitions(10, 3) == [(0, 3), (3, 6), (6, 10)]


@given(st.lists(st.lists(st.integers(1, 300), min_size=1, max_size=6), min_size=1, max_size=6), st.sets(st.integers(0, 900), max_size=codec.FEW), st.sampled_from([1, 2, 3, 8]))
@settings(max_examples=200, deadline=None)
def test_short_lists_have_the_same_bits(gaps, docs, q):
    d = np.array(sorted(docs), np.int64)
    bits = codec.encode_docids(d, 901, q)
    assert codec.packed_docids(d, 901, q) == (codec.pack(bits), len(bits))
    assert list(codec.read_docids(codec.pack(bits), len(d), 901, q)) == d.tolist()
    tfs = np.array([len(g) for g in gaps])
    cf, flat = int(tfs.sum()), np.concatenate([np.cumsum(g) - 1 for g in gaps])
    bits = codec.encode_freqs(tfs, cf, q)
    assert codec.packed_freqs(tfs, cf, q) == (codec.pack(bits), len(bits))
    assert list(codec.read_freqs(codec.pack(bits), len(tfs), cf, q)) == tfs.tolist()
    bits = codec.encode_flat_positions(flat, tfs, q)
    assert codec.packed_positions(flat, tfs, q) == (codec.pack(bits), len(bits))
    u = len(tfs) + int(flat[np.cumsum(tfs) - 1].sum())
    assert list(codec.read_positions(codec.pack(bits), tfs.tolist(), cf, u, q)) == flat.tolist()


def test_long_lists_take_little_memory():
    """A frequent term's list in a larger collection: a few bytes for each of its elements, not some for each of its bits."""
    import tracemalloc

    n = 400_000
    x = np.full(n, 100)
    tracemalloc.start()
    bits = codec.encode(x, 100 * n + 77, 3, False, True)
    assert np.array_equal(codec.decode(bits, n, 100 * n + 77, 3, False, True), 100 * np.arange(1, n + 1))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 75 * n


def test_index_in_many_parts_with_hard_keys(spark, monkeypatch):
    """Repeated, null and negative docids, long lists, many parts: rows, lists and the transposed index equal brute force."""
    import re
    from collections import Counter, defaultdict

    from lexispark.functions import runs
    from lexispark.operators import index as ops

    rows = [(i % 7 - 2 if i > 50 else i, f"the cat {i % 5} The {'x' * (i % 30)} é{i}z the") for i in range(90)] + [(None, "the null"), (None, "null the"), (200, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want: dict = defaultdict(list)
    for d, t in sorted(rows, key=repr):
        for pos, w in enumerate(re.findall("[A-Za-z0-9]+", t or "")):
            if len(w) <= 20:
                want[w.lower(), d].append(pos)
    monkeypatch.setattr(ops, "PART_BYTES", 200)
    monkeypatch.setattr(store, "PART_ROWS", 40)
    e = Engine(spark, new_path(spark, "index")).build(docs, positions=True, partitions=2)
    got = {(r["term"], r["docid"]): sorted(r["positions"]) for r in e.index().postings.collect()}
    assert got == {k: sorted(v) for k, v in want.items()}
    assert all(r["tf"] == len(r["positions"]) for r in e.index().postings.collect())
    lengths = Counter()
    for (_, d), v in want.items():
        lengths[d] += len(v)
    assert sorted(map(repr, map(tuple, e.index().doc_lengths.collect()))) == sorted(repr((d, lengths[d] if d is not None else 0)) for d, _ in rows)
    df = Counter(t for t, _ in want)
    assert {r["term"]: (r["termid"], r["df"]) for r in e.lexicon().collect()} == {t: (i, df[t]) for i, t in enumerate(sorted(df))}
    plain = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")
    p = Engine(spark, new_path(spark, "index")).build(plain, positions=True, partitions=2).transpose(2)
    small = p.compress(new_path(spark, "index"), positions=True, partitions=2, log2_quantum=1)
    key = lambda r: (r["term"], r["docid"], r["tf"], list(r["positions"]))
    assert sorted(map(key, small.index().postings.collect())) == sorted(map(key, p.index().postings.collect()))
    assert sorted(map(tuple, p.direct_lists().collect())) == sorted(map(tuple, p.direct().collect()))
    probes = spark.createDataFrame([(t, x) for x in (-1, 0, 30, 92, 500) for t in ("the", "cat", "3", "absent")] + [(None, 3), ("cat", None)], "term string, target long")
    hits = defaultdict(list)
    for r in p.index().postings.collect():
        hits[r["term"]].append(r["docid"])
    found = {(r["term"], r["target"]): r["hit"] for r in small.seek_many(probes).collect()}
    assert found == {(t, x): min((d for d in hits[t] if x is not None and d >= x), default=None) for t in ("the", "cat", "3") for x in (-1, 0, 30, 92, 500)} | {("cat", None): None}
    stop = spark.createDataFrame([("the",), ("cat",)], "term string")
    i = TextIndex.build(docs, stopwords=stop)
    assert {(r["term"], r["docid"]) for r in i.postings.collect()} == {k for k in want if k[0] not in ("the", "cat")}
    assert {r["docid"]: r["length"] for r in i.doc_lengths.collect() if r["docid"] is not None} == {d: sum(len(v) for (t, k), v in want.items() if k == d and t not in ("the", "cat")) for d in {d for d, _ in rows if d is not None}}
    monkeypatch.setattr(runs, "GROUP", 5)  # in this process only
    found = [r for b in runs._inverted(runs._Ids({b"a": 0, b"b": 1}), [3, 3, 9], [np.array([0, 1], np.int32), np.array([1], np.int32), np.array([], np.int32)], 20) for r in b.to_pylist()]
    assert [(r["term"], r["base"], r["n"], r["cf"]) for r in found] == [(None, 3, 2, 3), ("a", 3, 1, 1), ("b", 3, 1, 2)]


def test_tasks_grow_with_the_index(spark, monkeypatch):
    """Windows by term or document, differences and the table function: in as many tasks as the postings need, and on the lists asked for only."""
    from lexispark.operators import index as ops
    from lexispark.plans import catalogue

    sf = "/root/testdata/sf0.001"
    few = catalogue.postings_ordinal(spark, sf).rdd.getNumPartitions()
    monkeypatch.setattr(ops, "PART_ROWS", 5_000)
    n = catalogue.index(spark, sf).parts()
    assert n == 10 > few
    plan = lambda f: f(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    for f in (catalogue.postings_ordinal, catalogue.freq_prefix_sums, catalogue.position_start_index, catalogue.docid_gaps, catalogue.direct_termid_gaps):
        assert "RepartitionByExpression" in plan(f) and f", {n}" in plan(f), f.__name__
    for f in (catalogue.next_geq_batch, catalogue.direct_next_geq, catalogue.inv_minus_dir, catalogue.dir_minus_inv):
        assert f", {2 * n}" in plan(f), f.__name__
    assert catalogue.inv_minus_dir(spark, sf).first()[0] == catalogue.dir_minus_inv(spark, sf).first()[0] == 0
    a = spark.createDataFrame([(1, 1, 1), (1, 1, 1), (1, 2, 1), (2, 1, 3)], "termid long, docid long, tf long")
    b = spark.createDataFrame([(1, 1, 1), (2, 1, 4)], a.schema)
    assert catalogue._missing(a, b, 3).first()[0] == 3 and catalogue._missing(b, a, 3).first()[0] == 1 and catalogue._missing(a.limit(0), a, 3).first()[0] == 0
    scan = catalogue.ef_udtf_scan(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(df,100)" in scan  # lists are chosen as they are read
