"""Each operator against brute force, on small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lexispark.llm.components import components
from lexispark.llm import chat, decontaminate, exact_dedup, lang_id, line_dedup, packing, queries, sieve, simhash, suffix_dedup, url_filter, warc
from lexispark.scratch import new_path

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
PARTS = "th er in on an re nd at en es of the and ing ion to é ü ß ñ".split()


def prose(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choices(PARTS, k=rng.randint(1, 4))) for _ in range(n))


def some_docs(seed: int = 5) -> list[tuple]:
    rng = random.Random(seed)
    base = [prose(rng, rng.randint(1, 250)) for _ in range(30)]
    passage, line = prose(rng, 90), prose(rng, 30)
    texts = [*base, *base[:4], None, "", " \n\n", "a" * 1500, "a" * 380 + "b" * 500, passage, passage + " x"]
    for k, b in enumerate(base[4:16]):
        texts.append(b[: len(b) // 2] + f" {k} " + passage + " " + b[len(b) // 2 :])
        w = line.split()
        w[k % len(w)] = "zz"
        texts.append(b + "\n" + line + "\n" + " ".join(w))
        texts.append(b.replace(b.split()[0], "q", 1).upper())
    rows = [(i, t, "xx", "s", None) for i, t in enumerate(texts)]
    return [*rows, rows[3], (None, base[0], None, None, None), (None, None, None, None, None)]


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).withColumns({c: F.lit(1) for c in ("k", "h", "d1", "key", "fp", "score", "kept")})


def same(df, want):
    assert sorted(map(repr, (tuple(r) for r in df.collect()))) == sorted(map(repr, want))


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randint(-50, 150), rng.randint(-50, 150)) for _ in range(120)] + [(i, i + 1) for i in range(1000, 1060)] + [(7, 7), (None, 3)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for u, v in edges:
        if u is not None and u != v:
            a, b = find(u), find(v)
            root[max(a, b)] = min(a, b)
    same(components(spark.createDataFrame(edges, "u long, v long")), [(x, find(x)) for x in list(root)])
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def cover(texts, length):
    starts = defaultdict(int)
    raw = [(t or "").encode() for t in texts]
    for b in raw:
        for i in range(len(b) - length + 1):
            starts[b[i : i + length]] += 1
    out = []
    for b in raw:
        hit = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if starts[b[i : i + length]] > 1:
                hit[i : i + length] = True
        runs = int((np.diff(np.concatenate([[0], hit.astype(int), [0]])) == 1).sum())
        kept = bytes(x for x, h in zip(b, hit, strict=True) if not h)
        out.append((len(b), int(hit.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize(("length", "gram"), [(400, 40), (60, 16)])
def test_suffix_dedup(spark, length, gram):
    rows = some_docs()
    got = suffix_dedup.suffix_dedup(table(spark, rows), length=length, gram=gram).drop("spans")
    same(got, [(r[0], *c) for r, c in zip(rows, cover([r[1] for r in rows], length), strict=True)])


def test_suffix_dedup_in_pieces_and_shares(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PIECE", 700)
    rng = random.Random(3)
    a, b = (prose(rng, 700).encode() for _ in range(2))
    text = a + b + a[100:900] + b[:50]
    key, ctx, lo, n = suffix_dedup.anchors(text, 400, 40)
    assert n.sum() == len(text) - 399 and lo[0] == 0
    rows = [(i, prose(random.Random(i), 60) + " " + prose(rng, 70 if i % 3 else 100), "", "", 0) for i in range(9)] * 2
    rows += [(i + 50, r[1] + " tail" * i, "", "", 0) for i, r in enumerate(rows)]
    spans = suffix_dedup.repeated_spans(table(spark, rows), length=100, gram=16, share_rows=2)
    assert spans.count() > 0
    want = {(xxhash.xxh64_intdigest(r[1].encode(), 42), c[1]) for r, c in zip(rows, cover([r[1] for r in rows], 100), strict=True) if c[1]}
    hit = defaultdict(set)
    for r in spans.collect():
        hit[r["d1"] % 2**64].update(range(r["s"], r["e"]))
    assert {(k, len(v)) for k, v in hit.items()} == want


@pytest.mark.parametrize("length", [9, 20, 64, 100])
def test_index_family(length):
    rng = np.random.default_rng(length)
    family, seen = suffix_dedup.IndexFamily(length), defaultdict(list)
    known = rng.integers(0, 3, 4000).astype(np.uint8)
    for k in range(40):
        parts = [rng.integers(0, 2, length + 10) * 255, known[(at := rng.integers(0, 3700)) : at + length + 30], np.zeros(length + 3)]
        data = np.concatenate(parts).astype(np.uint8)
        starts = np.flatnonzero(rng.random(len(data) - length + 1) < 0.7)
        ids = starts + 10_000 * k
        for i, at in zip(ids.tolist(), starts.tolist(), strict=True):
            seen[data[at : at + length].tobytes()].append(i)
        family.add(data, starts, ids)
    assert sorted(set(np.concatenate(family.repeated).tolist())) == sorted(i for v in seen.values() if len(v) > 1 for i in v)
    assert sum(len(x.starts) for x in family.levels) == len(seen) and len(family.levels) <= 12
    for x in family.levels:
        held = [x.data[at : at + length].tobytes() for at in x.starts.tolist()]
        assert held == sorted(held)


def test_suffix_dedup_in_small_families(spark):
    """A task that begins a new family at nearly every key finds the same."""
    rows = some_docs(8)
    runs = lambda **how: {tuple(r) for r in suffix_dedup.repeated_spans(table(spark, rows), length=60, gram=16, **how).collect()}
    cut = lambda found: {(d, x) for d, _, s, e in found for x in range(s, e)}
    assert cut(runs(family_bytes=1)) == cut(runs()) != set()


def line_truth(rows, threshold=0.8):
    def grams(s):
        return {s} if len(s) <= 8 else {s[i : i + 8] for i in range(len(s) - 7)}

    lines = [(r[0], i, x) for r in rows for i, x in enumerate((r[1] or "").split("\n"))]
    text = [x for x in dict.fromkeys(x for *_, x in lines) if x.strip(" ")]
    root = {x: x for x in text}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    sets = {x: grams(x) for x in text}
    for i, a in enumerate(text):
        for b in text[:i]:
            if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    order = lambda k: (k[0] is not None, k[0] or 0, k[1])
    first = {}
    for k, i, x in lines:
        if x.strip(" "):
            first[find(x)] = min(first.get(find(x), (k, i)), (k, i), key=order)
    return [(k, i, *(first[find(x)] if x.strip(" ") else (None, None)), not x.strip(" ") or first[find(x)] == (k, i)) for k, i, x in lines]


def test_line_dedup(spark):
    rows = some_docs()
    got = line_dedup.line_groups(table(spark, rows)).select("k", "line_no", "keep_k", "keep_line_no", "kept")
    same(got, line_truth(rows))
    kept = {(k, i) for k, i, *_, keep in line_truth(rows) if keep}
    out = line_dedup.dedup_lines(table(spark, rows)).select("doc_id", "text").collect()
    want = []
    for k, t, *_ in rows:
        lines = (t or "").split("\n")
        left = [x for i, x in enumerate(lines) if (k, i) in kept]
        if not any(x.strip(" ") for x in lines):
            want.append((k, t))
        elif any(x.strip(" ") for x in left):
            want.append((k, "\n".join(left)))
    assert sorted(map(repr, map(tuple, out))) == sorted(map(repr, want))


def test_line_dedup_recall_on_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    rows = [tuple(r) for r in docs.collect()]
    got = line_dedup.line_groups(spark.createDataFrame(rows, SCHEMA)).select("k", "line_no", "keep_k", "keep_line_no", "kept")
    same(got, line_truth(rows))


def passage_lines(seed: int, pairs: int) -> list[tuple]:
    """Lines around one long passage, each with a tail of its own, and a variant of each: like its original and no other line."""
    rng = random.Random(seed)
    passage, lines = prose(rng, 60), []
    for _ in range(pairs):
        tail = prose(rng, 16)
        lines += [f"{passage} {tail}", f"{passage} {tail} {prose(rng, 5)}"]
    rng.shuffle(lines)
    return [(i, x, "xx", "s", None) for i, x in enumerate(lines)]


def test_line_dedup_links_in_large_buckets(spark):
    rows = passage_lines(9, 150)
    got = line_dedup.line_groups(spark.createDataFrame(rows, SCHEMA)).select("k", "line_no", "keep_k", "keep_line_no", "kept")
    want = line_truth(rows)
    assert sum(w[4] for w in want) == 150
    same(got, want)


def test_line_dedup_in_slices(spark, monkeypatch):
    """However many tokens and pairs there are, a join gets a slice of them only, and no link is lost by that."""
    lines = line_dedup.lines_of(spark.createDataFrame(passage_lines(9, 20), SCHEMA), "doc_id", "text")
    names, spill = [], line_dedup.spill
    monkeypatch.setattr(line_dedup, "spill", lambda df, name: names.append(name) or spill(df, name))
    monkeypatch.setattr(line_dedup, "log2", lambda c: 0)  # tokens by hash alone, so that the passage is among them
    roots = line_dedup.line_roots(lines, room=1200).collect()
    assert len(roots) == 40 and len({r.root for r in roots}) == 20
    assert names.count("met") > 1
    parts = [[r.id for r in part.collect()] for part in line_dedup.in_slices(spark.range(100), F.xxhash64("id"), 100, 30)]
    assert len(parts) == 4 and sorted(sum(parts, [])) == list(range(100))


def rows_of_tokens(spark, after=-1):
    """Rows that Spark has made of arrays of tokens in queries whose number is over ``after``, and the largest number."""
    store, made, last = spark._jsparkSession.sharedState().statusStore(), 0, after
    ran = store.executionsList()
    for e in (ran.apply(i) for i in range(ran.size())):
        if e.executionId() > after:
            last, values, nodes = max(last, e.executionId()), store.executionMetrics(e.executionId()), store.planGraph(e.executionId()).allNodes()
            for node in (nodes.apply(i) for i in range(nodes.size())):
                if node.name() == "Generate" and "token" in node.desc().split("[")[-1]:
                    made += sum(int(values.apply(m.accumulatorId()).replace(",", "")) for m in (node.metrics().apply(i) for i in range(node.metrics().size())) if values.contains(m.accumulatorId()))
    return made, last


def test_line_dedup_makes_rows_of_tokens_once(spark, monkeypatch):
    """The rows made of arrays of tokens don't grow with the number of slices and rounds."""
    lines = line_dedup.lines_of(spark.createDataFrame(passage_lines(9, 20), SCHEMA), "doc_id", "text")
    names, spill = [], line_dedup.spill
    monkeypatch.setattr(line_dedup, "spill", lambda df, name: names.append(name) or spill(df, name))
    monkeypatch.setattr(line_dedup, "log2", lambda c: 0)
    last = rows_of_tokens(spark)[1]
    roots = line_dedup.line_roots(lines, crowd=4, room=1200).collect()
    assert len(roots) == 40 and len({r.root for r in roots}) == 20
    tokens = line_dedup.rare_shingles(lines.where("h is not null").select("h", "line").distinct(), 8, 0.8).count()
    assert names.count("open-tokens") > 4 and 0 < rows_of_tokens(spark, last)[0] <= 3 * tokens  # one time is the count of them here


def test_line_dedup_sketches_tell_nearly_alike_lines(spark):
    """Sketches of long lines differ in no more bits than their sets in shingles, and tell most pairs that are just not alike without their texts."""
    rng, rows = random.Random(5), []
    for i in range(20):
        x = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=440))
        rows += [(2 * i, x), (2 * i + 1, x[:380] + "".join(rng.choices("ABCDEFGHIJ", k=60)))]  # 60 of 433 shingles are others: a similarity of 0.76
    sets = {h: {x[i : i + 8] for i in range(len(x) - 7)} for h, x in rows}
    got = {h: (n, sketch) for h, n, sketch in line_dedup.sketches(spark.createDataFrame(rows, "h long, line string"), 8).collect()}
    told = 0
    for i in range(0, 40, 2):
        differ = sum(((a ^ b) & (1 << 64) - 1).bit_count() for a, b in zip(got[i][1], got[i + 1][1], strict=True))
        assert differ <= len(sets[i] ^ sets[i + 1]) and len(sets[i] & sets[i + 1]) < 0.8 * len(sets[i] | sets[i + 1])
        told += 1.8 * differ > 0.2 * (got[i][0] + got[i + 1][0])
    assert told >= 15


def test_sieve_words_are_in_place(spark):
    """The bitmap's words are sorted, not looked up one by one, and no member is lost by it, whatever their number."""
    for count in (0, 1, 30, 5000):
        members = spark.range(count).select(F.xxhash64("id").alias("m"))
        df = spark.range(0, 2 * count + 50).select("id", F.xxhash64("id").alias("x"))
        told = sieve.passing(df, F.col("x"), members)
        assert "element_at" not in told._jdf.queryExecution().optimizedPlan().toString()
        got = {r["id"]: r["may_be_member"] for r in told.collect()}
        assert len(got) == 2 * count + 50 and all(got[i] for i in range(count))
        assert sum(got[i] for i in range(count, 2 * count + 50)) <= 0.15 * (count + 50)
    assert sieve.members_only(spark.sql("select cast(null as bigint) x"), F.col("x"), spark.range(3).select("id")).count() == 0


def test_line_dedup_without_spaces(spark):
    rng, lines = random.Random(12), []
    for at in (0, 0, 1, 7, 30, 30, 60):
        for alphabet in ("天地玄黄宇宙洪荒日月盈昃辰宿列张寒来暑往秋收冬藏", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"):
            x = "".join(rng.choices(alphabet, k=120))
            lines += [x, x[:at] + "文" + x[at:], x[:at] + x[at + 1 :]]
    rows = [(i, x, "zh", "s", None) for i, x in enumerate(lines)]
    want = line_truth(rows)
    assert sum(w[4] for w in want) == len(lines) / 3
    same(line_dedup.line_groups(spark.createDataFrame(rows, SCHEMA)).select("k", "line_no", "keep_k", "keep_line_no", "kept"), want)


def test_line_dedup_rare_shingles(spark):
    rows = [(x[0], x[1]) for x in passage_lines(4, 20)] + [(99, "short"), (98, "")]
    got = {}
    for h, n, pos, token in line_dedup.rare_shingles(spark.createDataFrame(rows, "h long, line string"), 8, 0.8).collect():
        got.setdefault(h, (n, {}))[1][token] = pos
    sets = {h: {x[i : i + 8] for i in range(max(1, len(x) - 7))} for h, x in rows}
    assert all(n == len(sets[h]) and len(t) <= n - 0.8 * n + 1 for h, (n, t) in got.items())
    for a in got:
        for b in got:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                (na, one), (nb, other) = got[a], got[b]
                assert any(1.8 * (1 + min(na - one[x], nb - other[x])) >= 0.8 * (na + nb) - 1e-6 for x in one.keys() & other.keys())


def test_decontaminate(spark):
    rows = some_docs()
    items = [(0, "The And ing"), (1, rows[5][1]), (2, None), (3, "--"), (4, rows[5][1]), (None, rows[6][1]), (4, rows[5][1]), (5, "aaa bbb"), (6, " ".join(prose(random.Random(2), 40).split()[:14]))]
    rows.append((900, "x aaa BBB, the-and ing " + items[-1][1], None, None, None))
    want = []
    windows = defaultdict(set)
    for i, t in items:
        w = decontaminate.words(t)
        for j in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[j : j + 10])].add(i)
    for k, t, *_ in rows:
        w = decontaminate.words(t)
        hit, found = set(), set()
        for x, ids in windows.items():
            for p in range(len(w) - len(x) + 1):
                if tuple(w[p : p + len(x)]) == x:
                    hit.update(range(p, p + len(x)))
                    found |= ids - {None}
        want.append((k, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit)))
    assert sum(x[5] for x in want) > 2
    cols = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block in (8_000_000, 100):
        same(decontaminate.decontaminate(table(spark, rows), bench, block_bytes=block).select(*cols), want)
    named = bench.select(F.concat(F.lit("q"), F.col("item_id").cast("string")).alias("item_id"), "text")
    odd = decontaminate.decontaminate(table(spark, rows).withColumns({"_state": F.lit(1), "n_hit": F.lit("x")}), named)
    same(odd.select("doc_id", "n_words", "n_hit", "n_items", "contaminated", "_state"), [(*w[:4], w[5], 1) for w in want])
    none = decontaminate.decontaminate(table(spark, rows), bench.limit(0)).select(*cols)
    same(none, [(k, n, 0, 0, hashlib.sha256(b"").hexdigest(), False) for k, n, *_ in want])


def test_packing(spark):
    rows = some_docs()
    got = packing.best_fit(table(spark, rows), capacities=(64, 256, 1024), shard_tokens=5000).collect()
    by_doc, by_bin = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r["doc_id"]].append((r["piece_start"], r["piece_len"]))
        by_bin[r["bin_id"]].append(r)
    for k, t, *_ in rows:
        n = len((t or "").encode()) + 1
        if k is not None and k != rows[3][0]:
            pieces = sorted(by_doc[k])
            assert [s for s, _ in pieces] == [1024 * i for i in range(len(pieces))] and sum(x for _, x in pieces) == n
    assert sum(r["piece_len"] for r in got) == sum(len((r[1] or "").encode()) + 1 for r in rows)
    for rs in by_bin.values():
        at = 0
        for r in sorted(rs, key=lambda r: r["bin_offset"]):
            assert r["bin_offset"] == at
            at += r["piece_len"]
        assert {r["bin_used"] for r in rs} == {at}
        assert {r["bin_capacity"] for r in rs} == {min(c for c in (64, 256, 1024) if c >= at)}
    assert sum(rs[0]["bin_used"] for rs in by_bin.values()) / sum(rs[0]["bin_capacity"] for rs in by_bin.values()) > 0.8


def plain_pack(lengths, caps, overhead, quadratic):
    """The packing rule, told without sorted lists: bins as plain lists of lengths."""
    caps, bins, cost = sorted(caps), [], lambda c: overhead + c + c * c / quadratic
    down = lambda n: min(c for c in caps if c >= n)
    for i, n in enumerate(lengths):
        fitting = [(size - sum(x), b) for b, (size, x) in enumerate(bins) if size - sum(x) >= n]
        if fitting:
            bins[min(fitting)[1]][1].append(n)
            continue
        tried = []
        for c in caps:
            if c >= n:
                fill = n
                for m in lengths[i + 1 :]:
                    fill += m if fill + m <= c else 0
                tried.append((cost(down(fill)) / fill, c))
        bins.append((min(tried)[1], [n]))
    return sorted((down(sum(x)), tuple(x)) for _, x in bins)


def test_packing_chooses_least_cost():
    rng, opened = random.Random(11), set()
    for _ in range(40):
        lengths = sorted((int(rng.choice([1, 30, 200, 900]) * rng.random()) + 1 for _ in range(rng.randint(0, 80))), reverse=True)
        b, o, c, u = packing.pack(lengths, (64, 256, 1024), 8.0, 2048.0)
        got = defaultdict(list)
        for n, k, at, size, used in zip(lengths, b, o, c, u, strict=True):
            assert at == sum(got[k, size, used])
            got[k, size, used].append(n)
        assert sorted((size, tuple(x)) for (_, size, _), x in got.items()) == plain_pack(lengths, (64, 256, 1024), 8.0, 2048.0)
        opened |= set(c)
    assert opened == {64, 256, 1024}


def test_packing_spreads_copies(spark):
    rows = [(None, "x" * 50, None, None, None)] * 40
    got = packing.best_fit(spark.createDataFrame(rows, SCHEMA), capacities=(64, 256), shard_pieces=10).collect()
    assert len(got) == 40 and len({r["bin_id"].split("-")[0] for r in got}) > 1


def simhash_truth(rows):
    def fp(t):
        b = (t or "").encode().lower()
        w = [x for x in b.replace(b"\t", b" ").replace(b"\n", b" ").replace(b"\x0b", b" ").replace(b"\x0c", b" ").replace(b"\r", b" ").split(b" ") if x]
        if not w:
            return 0
        grams = [w] if len(w) < 3 else [w[i : i + 3] for i in range(len(w) - 2)]
        hs = [xxhash.xxh64_intdigest(b" ".join(g), 42) for g in grams]
        return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hs) > len(hs))

    f = [fp(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (f[i] ^ f[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    group = defaultdict(list)
    for i, r in enumerate(rows):
        if r[0] is not None:
            group[find(i)].append(r[0])
    return [(r[0], f"{f[i]:016x}", min(group[find(i)], default=None)) for i, r in enumerate(rows)]


def test_simhash(spark):
    rows = some_docs()
    same(simhash.simhash_groups(table(spark, rows)), simhash_truth(rows))
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    same(simhash.simhash_groups(spark.createDataFrame(rows, SCHEMA)), simhash_truth(rows))


@pytest.mark.parametrize("tile", [5, 4096])
def test_simhash_links(spark, tile):
    rng = random.Random(4)
    centres = [rng.getrandbits(64) for _ in range(6)]
    fps = {c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for c in centres for _ in range(60)} | {rng.getrandbits(64) for _ in range(200)}
    fps = sorted(x - (x >> 63 << 64) for x in fps)
    got = components(simhash.link_fingerprints(spark.createDataFrame([(x,) for x in fps], "fp long"), tile=tile))
    label = {x: x for x in fps}
    changed = True
    while changed:
        changed = False
        for a in fps:
            m = min(label[b] for b in fps if ((a ^ b) % 2**64).bit_count() <= 3)
            if m < label[a]:
                label[a], changed = m, True
    roots = dict(map(tuple, got.collect()))
    assert {x: roots.get(x, x) for x in fps} == label


@pytest.mark.parametrize("radius", [0, 1, 2, 3])
def test_bit_slices(radius):
    rng = np.random.default_rng(radius)
    fps = rng.integers(0, 2**64, 5000, dtype=np.uint64)
    q = int(fps[77])
    for i in range(0, 3000, 300):
        fps[i] = np.uint64(q ^ sum(1 << int(b) for b in rng.choice(64, i // 300 % 6, replace=False)))
    got = simhash.within(q, simhash.planes(fps), len(fps), radius)
    assert got.tolist() == np.flatnonzero(np.bitwise_count(fps ^ np.uint64(q)) <= radius).tolist()


def test_warc(spark):
    pages = [(i, f"http://a.b/{i}", x) for i, x in enumerate(["<p>é</p>\r\n\r\nWARC/1.1", "", None, "same", "same", "same", "x" * 100_000, "\r\n", "\n"])] + [(3, "http://a.b/3", "same"), (None, None, "same"), (8, "http://a.b/8", "\n"), (40, "bad\r\nurl", "one")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("k", F.lit(1)).withColumn("sha256", F.lit("x"))
    path = new_path(spark, "test-warc")
    warc.write_archive(df, path, records_per_file=3)
    got = warc.read_archive(spark, path).collect()
    keep = {}
    for k, _, x in pages:
        if k is not None:
            keep[x or ""] = max(keep.get(x or "", k), k)
    want = [(k, None if u is None else u.replace("\r\n", "  "), "response" if k == keep[x or ""] else "revisit", None if k == keep[x or ""] else keep[x or ""], (x or "").encode()) for k, u, x in pages]
    assert sorted(map(repr, ((r["page_id"], r["url"], r["record_type"], r["refers_to"], bytes(r["payload"])) for r in got))) == sorted(map(repr, want))
    assert all(r["payload_bytes"] == len(r["payload"]) for r in got)
    stored = spark.read.parquet(f"{path}/headers")
    assert {r["header"] for r in got} == {r["header"] for r in stored.collect()}
    records = {part: [x for r in spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(f"{path}/{part}").collect() for x in warc.parse_warc(bytes(r["content"]))] for part in ("payloads", "revisits")}
    assert len(records["payloads"]) == len({x or "" for *_, x in pages}) and len(records["revisits"]) == sum(w[2] == "revisit" for w in want)
    for part, kind in (("payloads", "response"), ("revisits", "revisit")):
        for head, block in records[part]:
            assert head["WARC-Type"] == kind and head["WARC-Date"] and int(head["Content-Length"]) == len(block) and block.startswith(b"HTTP/1.1 200 OK")


def test_warc_keys_of_another_type(spark):
    df = spark.createDataFrame([("a<b", "u", "x"), ("z", "u", "x"), (None, None, None)], "page_id string, url string, html string")
    path = new_path(spark, "test-warc")
    warc.write_archive(df.replace("a<b", "ab"), path)
    same(warc.read_archive(spark, path).select("page_id", "record_type", "refers_to"), [("ab", "revisit", "z"), ("z", "response", None), (None, "response", None)])


def test_warc_small_payloads_and_empty(spark):
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")], "page_id long, url string, html string")
    path = new_path(spark, "test-warc")
    warc.write_archive(df, path, min_bytes=3)
    same(warc.read_archive(spark, path).select("page_id", "record_type"), [(1, "response"), (2, "response"), (3, "revisit"), (4, "response")])
    path = new_path(spark, "test-warc")
    warc.write_archive(df.limit(0), path)
    assert warc.read_archive(spark, path).count() == 0


def test_chat_fold(spark):
    log = [(1, 1, 0, "message", "user", "hi"), (1, 2, 1, "delta", "assistant", "he"), (1, 3, 1, "delta", "assistant", "llo"), (1, 4, 1, "regenerate", "assistant", "new"), (1, 5, 1, "delta", "assistant", "er"), (1, 6, 0, "edit", "user", "hi!"), (1, 7, 2, "message", "user", "gone"), (1, 8, 2, "delete", "user", None), (2, 1, 0, None, None, None), (None, 1, None, "message", "user", "x")]
    df = spark.createDataFrame(log, "conv_id long, seq long, turn long, kind string, role string, text string").withColumn("e", F.lit(1))
    same(chat.fold(df), [(1, 0, "user", "hi!"), (1, 1, "assistant", "newer"), (2, 0, "", ""), (None, None, "user", "x")])


def test_chat_round_trip(spark):
    rng = random.Random(6)
    bits = ["<|im_end|>\n", "<|im_start|>user\n", "\\", "<", "|", "<|", "<\\|", "<\\/|", "\n", "é", "ok", "<|im_end|>", " "]
    rows = [(c, t, rng.choice(["user", "assistant", "a\nb", "\\n", None]), rng.choice([None, ""] + ["".join(rng.choices(bits, k=rng.randint(1, 9))) for _ in range(8)])) for c in range(60) for t in range(rng.randint(1, 5))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.render(df).select("conv_id", chat.parse(F.col("formatted")).alias("turns"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("learned")).collect()
    for r in out:
        own = sorted((t, role or "", text or "") for c, t, role, text in rows if c == r["conv_id"])
        assert [tuple(x) for x in r["turns"]] == [x[1:] for x in own]
        assert r["learned"] == "".join(x[2] for x in own if x[1] == "assistant")
    assert chat.render(df.limit(0)).count() == 0


def test_chat_query_keeps_every_row(spark, tmp_path):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "b"), (1, 1, "assistant", "a"), (1, 1, "assistant", "a"), (1, 1, "user", None), (1, None, "user", "y"), (1, None, "assistant", "x"), (1, None, None, "z"), (2, 0, "user", "one"), (2, 0, "user", "one"), (None, 0, "user", "n"), (None, 0, "user", "m")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    said = "\\### Assistant: </turn> ok"
    by = defaultdict(list)
    for c, t, role, text in [*rows, (-7, 0, "user", said), (-7, 1, "assistant", said)]:
        by[c].append((t is None, t or 0, role or "", text or ""))
    want = []
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for c, ms in by.items():
        ms.sort()
        learned = "".join(x for *_, role, x in ms if role == "assistant")
        want.append((c, len(ms), sha("".join(f"{role}\n{x}\n" for *_, role, x in ms)), len(learned), sha(learned)))
    same(queries.op7_chat(spark, str(tmp_path)).drop("formatted_chars"), want)


def test_url_filter(spark):
    rng = random.Random(8)
    hosts = ["example.com", "a.example.com", "WWW.a.Example.com", "badexample.com", "com", "org", "x.net", "example.net", "", "a..com", "com.evil"]
    rules = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/", "block"), ("a.example.com", "/", "allow"), ("org", "", "block"), ("org", "", "allow"), (None, "/", "block"), ("example.com", "/en/7", "allow")]
    urls = [(i, f"http{'s' * (i % 2)}://{rng.choice(hosts)}{rng.choice(['', '/', '/en/', '/en/7', '/en/77/x', '/de', '?q=/en/', '#/en/'])}{rng.choice(['', '?a=://b', '#c'])}") for i in range(300)] + [(None, None), (5, "no scheme"), (6, "http://example.com/en/71"), (6, "http://example.com/en/71")]

    def judge(u):
        rest = (u or "").partition("://")
        rest = rest[2] if rest[1] else ""
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, path = rest[:cut].lower(), rest[cut:].split("?")[0].split("#")[0]
        fit = [(len(h + p), len(h), a == "block", h + p, a) for h, p, a in rules if h is not None and (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (host, path, max(fit)[3], max(fit)[4]) if fit else (host, path, None, "allow")

    df = spark.createDataFrame(urls, "page_id long, url string").withColumn("rule", F.lit(1)).withColumn("row", F.lit(1))
    r = spark.createDataFrame(rules, "host string, path string, action string")
    same(url_filter.filter_urls(df, r), [(k, *judge(u)) for k, u in urls])
    same(url_filter.filter_urls(df.limit(0), r), [])
    same(url_filter.filter_urls(df, r.limit(0)), [(k, *judge(u)[:2], None, "allow") for k, u in urls])


def test_url_filter_has_the_contracts_rules(spark, tmp_path):
    urls = ["http://a.com/en/1", "https://example.com/en/7?x", "http://example.com/en/8", "http://b.net/de/1", "http://example.net/de/1", "http://www.Example.net/de/8/x", "http://c.org/es/", "http://c.org/de/", "no scheme", None]
    want = [("com/en/", "block"), ("example.com/en/7", "allow"), ("com/en/", "block"), ("net/de/", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block"), (None, "allow"), (None, "allow"), (None, "allow")]
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    same(queries.op8_url_filter(spark, str(tmp_path)).select("page_id", "rule", "verdict"), [(i, *w) for i, w in enumerate(want)])
    assert "('net', '/de/', 'allow')" in queries.oracle_sql()["op8_url_filter"]


def test_exact_dedup(spark):
    rows = some_docs() + [(1000 + i, "HOT ä Ä", None, None, None) for i in range(40)] + [(2000, "hot ä Ä", None, None, None), (2001, "hot ä ä", None, None, None)]
    norm = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    by = defaultdict(list)
    for k, t, *_ in rows:
        by[norm(t)].append(k)
    want = []
    for k, t, *_ in rows:
        keep = max((x for x in by[norm(t)] if x is not None), default=None)
        want.append((k, keep, len(by[norm(t)]), k == keep, hashlib.sha256(norm(t).encode()).hexdigest()))
    same(exact_dedup.exact_dedup(table(spark, rows), support=0.05), want)
    assert exact_dedup.exact_dedup(table(spark, rows).limit(0)).count() == 0


def test_lang_id(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = lang_id.held_out(F.col("doc_id"))
    model = lang_id.fit(docs.where(~held))
    assert sorted(model) == ["de", "en", "es", "fr"]
    got = lang_id.predict(docs.where(held), model).select("doc_id", "lang", "lang_pred", "score", "accepted").collect()
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in got)
    assert sum(r["lang"] == r["lang_pred"] for r in got) / len(got) > 0.97
    assert sum(r["accepted"] for r in got) / len(got) > 0.97 and all(0 <= r["score"] <= 1 for r in got)
    odd = table(spark, [(1, None, None, "", 0), (2, "", None, "", 0), (3, "12 %$ \n 7", None, "", 0), (4, "the", None, "", 0)])
    out = lang_id.predict(odd, model).select("doc_id", "lang_pred").collect()
    assert [r["lang_pred"] for r in sorted(out)][:3] == ["und"] * 3
    assert {r["lang_pred"] for r in lang_id.predict(odd, lang_id.fit(odd)).collect()} == {"und"}


def test_lang_id_with_rare_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    held = lang_id.held_out(F.col("doc_id"))
    whole = lang_id.fit(docs.where(~held))
    rare = spark.createDataFrame([(-1, "ok then", "xx"), (-2, "a", "yy"), (-3, "η γλώσσα αυτή έχει λίγα κείμενα και λέξεις", "el")], "doc_id long, text string, lang string")
    model = lang_id.fit(docs.where(~held).union(rare))
    assert {k: model[k] for k in whole} == whole and sorted({*model} - {*whole}) == ["el", "xx", "yy"]
    got = lang_id.predict(docs.where(held).limit(200), model).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) / len(got) > 0.97
    assert sum(r["accepted"] for r in got) / len(got) > 0.95
    (greek,) = lang_id.predict(spark.createDataFrame([(1, "αυτή η γλώσσα έχει λέξεις και κείμενα")], "doc_id long, text string"), model).collect()
    assert greek["lang_pred"] == "el" and greek["accepted"]


def test_empty_tables(spark):
    none = table(spark, some_docs()).limit(0)
    assert suffix_dedup.suffix_dedup(none).count() == 0
    assert line_dedup.line_groups(none).count() == line_dedup.dedup_lines(none).count() == 0
    assert simhash.simhash_groups(none).count() == packing.best_fit(none).count() == 0
    assert decontaminate.decontaminate(none, spark.createDataFrame([(1, "a b")], "item_id long, text string")).count() == 0
