"""The catalogue of index queries over the documents table, each with its SQL.

The index of a table is built once in a session, written to the shared folder, encoded and transposed there on demand; every query reads the stored tables.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexispark.functions import udfs
from lexispark.functions.blobs import decode_lists, seek_in_lists
from lexispark.functions.sizes import ceil_log2, docid_sizes, floor_log2, lower_bits, position_header, strict_sizes
from lexispark.operators.index import TextIndex, dense_ids, inverted, merge_lexicons, next_geq, running_offsets, stats_of_runs, subtract_lexicons, term_partitions, tokens
from lexispark.plans.engine import Engine
from lexispark.schema import MAX_TERM_LENGTH
from lexispark.scratch import new_path, shared_dir
from lexispark.sources import store

TERM, DOC, TERMID, Q, DIRECT_Q, PARTS, K = "the", 7, 1234, 3, 8, 3, 3
LEX = ["term", "termid", "df", "cf", "maxtf"]
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

_BASE = f"""WITH tok AS MATERIALIZED (SELECT docid, lower(raw) AS term, pos FROM (SELECT doc_id AS docid, unnest(x) AS raw, generate_subscripts(x, 1) - 1 AS pos
  FROM (SELECT doc_id, regexp_extract_all(text, '[A-Za-z0-9]+') AS x FROM documents)) WHERE length(raw) <= {MAX_TERM_LENGTH}),
post0 AS MATERIALIZED (SELECT term, docid, count(*)::BIGINT AS tf, max(pos)::BIGINT AS lastpos, list(pos ORDER BY pos) AS positions FROM tok GROUP BY 1, 2),
lex AS MATERIALIZED (SELECT term, (row_number() OVER (ORDER BY term) - 1)::BIGINT AS termid, count(*)::BIGINT AS df, sum(tf)::BIGINT AS cf, max(tf)::BIGINT AS maxtf, sum(lastpos)::BIGINT AS s FROM post0 GROUP BY term),
post AS MATERIALIZED (SELECT term, termid, docid, tf, lastpos, positions FROM post0 JOIN lex USING (term)),
lens AS MATERIALIZED (SELECT doc_id AS docid, coalesce(length, 0)::BIGINT AS length FROM documents LEFT JOIN (SELECT docid, sum(tf) AS length FROM post0 GROUP BY 1) ON docid = doc_id),
k AS (SELECT (SELECT count(*) FROM documents)::BIGINT AS n, (SELECT count(*) FROM lex)::BIGINT AS v)
"""


def query(sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        SQL[f.__name__] = _BASE + sql
        return f

    return add


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


_built: dict[tuple[str, str, str], str] = {}


def _once(spark: SparkSession, sf_dir: str, kind: str, write: Callable[[str], object]) -> Engine:
    """The engine of a folder that ``write`` fills at the first call in this application."""
    key = (spark.sparkContext.applicationId + shared_dir(spark), sf_dir, kind)
    if key not in _built or not store.exists(spark, _built[key]):
        path = new_path(spark, f"index-{kind}")
        write(path)
        _built[key] = path
    return Engine(spark, _built[key])


def engine(spark: SparkSession, sf_dir: str) -> Engine:
    """The stored index of the documents, with positions."""
    return _once(spark, sf_dir, "rows", lambda path: Engine(spark, path).build(documents(spark, sf_dir), positions=True))


def transposed(spark: SparkSession, sf_dir: str) -> Engine:
    e = engine(spark, sf_dir)
    return e if store.exists(spark, f"{e.path}/direct_entries") else e.transpose()


def encoded(spark: SparkSession, sf_dir: str) -> Engine:
    """The same index as quasi-succinct lists."""
    return _once(spark, sf_dir, "lists", lambda path: engine(spark, sf_dir).compress(path, positions=True, log2_quantum=Q))


def index(spark: SparkSession, sf_dir: str) -> TextIndex:
    return engine(spark, sf_dir).index()


def duck(expr: str) -> str:
    """A size expression of lexispark.functions.sizes as DuckDB has it."""
    out = re.sub(r"\bdiv\b", "//", expr)
    while "shiftright(" in out:
        i = out.rindex("shiftright(")
        depth, j, comma = 0, i + len("shiftright"), 0
        while True:
            depth += (out[j] == "(") - (out[j] == ")")
            if out[j] == "," and depth == 1:
                comma = j
            if depth == 0:
                break
            j += 1
        out = f"{out[:i]}(({out[i + 11 : comma]}) >> ({out[comma + 1 : j]})){out[j + 1 :]}"
    return re.sub(r"\b0L\b", "0::BIGINT", out)


@query("SELECT n AS num_documents, v AS num_terms, (SELECT sum(df)::BIGINT FROM lex) AS num_pointers, (SELECT sum(cf)::BIGINT FROM lex) AS num_tokens FROM k")
def collection_stats(spark, sf):
    return index(spark, sf).stats()


@query("SELECT * FROM lens")
def doc_lengths(spark, sf):
    return index(spark, sf).doc_lengths


@query(f"SELECT * FROM lens WHERE docid = {DOC}")
def doc_length_lookup(spark, sf):
    return index(spark, sf).doc_lengths.where(F.col("docid") == DOC)


@query("SELECT docid FROM lens WHERE length = 0")
def empty_documents(spark, sf):
    return index(spark, sf).doc_lengths.where("length = 0").select("docid")


@query("SELECT term, termid, df, cf, maxtf FROM lex")
def lexicon_scan(spark, sf):
    return index(spark, sf).lexicon.select(*LEX)


@query(f"SELECT term, termid, df, cf, maxtf FROM lex WHERE term = '{TERM}'")
def lexicon_lookup_term(spark, sf):
    return index(spark, sf).term(TERM).select(*LEX)


@query(f"SELECT term, termid, df, cf, maxtf FROM lex WHERE termid = {TERMID}")
def lexicon_lookup_termid(spark, sf):
    return index(spark, sf).term_range(TERMID, TERMID + 1).select(*LEX)


@query("SELECT term, termid, df, cf, maxtf FROM lex WHERE termid >= 100 AND termid < 200")
def lexicon_range(spark, sf):
    return index(spark, sf).term_range(100, 200).select(*LEX)


@query("SELECT term, docid, tf FROM post")
def postings_scan(spark, sf):
    return index(spark, sf).postings.select("term", "docid", "tf")


@query(f"SELECT term, docid, tf, length FROM post JOIN lens USING (docid) WHERE term = '{TERM}'")
def postings_term(spark, sf):
    """The minimum slice: one term's postings with document lengths."""
    i = index(spark, sf)
    return i.postings_of_term(TERM).join(i.doc_lengths, "docid").select("term", "docid", "tf", "length")


@query("SELECT term, docid, tf, length FROM post JOIN lens USING (docid)")
def postings_with_doclen(spark, sf):
    return index(spark, sf).with_lengths().select("term", "docid", "tf", "length")


@query("SELECT term, docid, (row_number() OVER (PARTITION BY term ORDER BY docid) - 1)::BIGINT AS ord FROM post")
def postings_ordinal(spark, sf):
    return index(spark, sf).ordinals().select("term", "docid", "ord")


@query("SELECT term, docid, '(' || docid || ',' || tf || ')[' || array_to_string(positions, ',') || ']' AS posting FROM post")
def postings_formatted(spark, sf):
    return index(spark, sf).postings.select("term", "docid", F.format_string("(%d,%d)[%s]", "docid", "tf", F.array_join("positions", ",")).alias("posting"))


@query("SELECT term, docid, array_to_string(positions, ',') AS positions FROM post")
def postings_positions(spark, sf):
    return index(spark, sf).postings.select("term", "docid", F.array_join("positions", ",").alias("positions"))


@query("SELECT term, docid, array_to_string(list_transform(generate_series(1, len(positions)), lambda i: positions[i] - CASE WHEN i = 1 THEN -1 ELSE positions[i - 1] END), ',') AS gaps FROM post")
def position_gaps(spark, sf):
    """Position gaps inside a posting, the first position plus one."""
    before = lambda i: F.when(i == 0, F.lit(-1)).otherwise(F.try_element_at("positions", i))
    return index(spark, sf).postings.select("term", "docid", F.array_join(F.transform("positions", lambda p, i: p - before(i)), ",").alias("gaps"))


@query("SELECT term, docid, coalesce(sum(tf) OVER (PARTITION BY term ORDER BY docid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM post")
def position_start_index(spark, sf):
    before = Window.partitionBy("termid").orderBy("docid").rowsBetween(Window.unboundedPreceding, -1)
    return index(spark, sf).by_term("term", "termid", "docid", "tf").select("term", "docid", F.coalesce(F.sum("tf").over(before), F.lit(0)).alias("start"))


@query("SELECT term, sum(lastpos)::BIGINT AS sum_last, sum(len(positions))::BIGINT AS n_positions, sum(tf) = sum(len(positions)) AS agrees FROM post GROUP BY 1")
def position_checks(spark, sf):
    n = F.size("positions").cast("long")
    return index(spark, sf).postings.groupBy("term").agg(F.sum(F.element_at("positions", -1).cast("long")).alias("sum_last"), F.sum(n).alias("n_positions"), (F.sum("tf") == F.sum(n)).alias("agrees"))


@query("SELECT term, docid, docid - coalesce(lag(docid) OVER (PARTITION BY term ORDER BY docid), 0) AS gap FROM post")
def docid_gaps(spark, sf):
    before = F.lag("docid").over(Window.partitionBy("termid").orderBy("docid"))
    return index(spark, sf).by_term("term", "termid", "docid").select("term", "docid", (F.col("docid") - F.coalesce(before, F.lit(0))).alias("gap"))


@query("SELECT term, docid, sum(tf - 1) OVER (PARTITION BY term ORDER BY docid ROWS UNBOUNDED PRECEDING)::BIGINT AS prefix FROM post")
def freq_prefix_sums(spark, sf):
    upto = Window.partitionBy("termid").orderBy("docid").rowsBetween(Window.unboundedPreceding, 0)
    return index(spark, sf).by_term("term", "termid", "docid", "tf").select("term", "docid", F.sum(F.col("tf") - 1).over(upto).alias("prefix"))


@query("SELECT docid, termid, termid - coalesce(lag(termid) OVER (PARTITION BY docid ORDER BY termid), 0) AS gap FROM post")
def direct_termid_gaps(spark, sf):
    before = F.lag("termid").over(Window.partitionBy("docid").orderBy("termid"))
    e = transposed(spark, sf)
    return e.direct().select("docid", "termid").repartition(e.parts(), "docid").select("docid", "termid", (F.col("termid") - F.coalesce(before, F.lit(0))).alias("gap"))


@query(f"SELECT term, docid, tf FROM post WHERE term = '{TERM}' AND docid = (SELECT min(docid) FROM post WHERE term = '{TERM}' AND docid >= {DOC})")
def next_geq_single(spark, sf):
    return index(spark, sf).postings_of_term(TERM).where(F.col("docid") >= DOC).orderBy("docid").limit(1).select("term", "docid", "tf")


_NEXT = "SELECT term, docid, lead(docid) OVER (PARTITION BY term ORDER BY docid) AS hit, row_number() OVER (PARTITION BY term ORDER BY docid) - 1 AS o FROM post"


@query(f"SELECT term, docid + 1 AS target, hit FROM ({_NEXT})")
def next_geq_batch(spark, sf):
    """From just behind every posting, the next one of its term."""
    i = index(spark, sf)
    return next_geq(i.postings, i.postings.select("term", (F.col("docid") + 1).alias("target")), "term", "docid", parts=2 * i.parts())


@query(f"SELECT term, docid AS target, docid AS hit FROM ({_NEXT}) WHERE o % {K} = 0")
def seek_into_every_k(spark, sf):
    """Seeks to every K-th posting land on it."""
    i = index(spark, sf)
    return next_geq(i.postings, i.ordinals().where(F.col("ord") % K == 0).select("term", F.col("docid").alias("target")), "term", "docid", parts=2 * i.parts())


@query(f"SELECT term, docid + 1 AS target, hit FROM ({_NEXT}) WHERE o % {K} = 0")
def seek_after_every_k(spark, sf):
    i = index(spark, sf)
    return next_geq(i.postings, i.ordinals().where(F.col("ord") % K == 0).select("term", (F.col("docid") + 1).alias("target")), "term", "docid", parts=2 * i.parts())


@query(f"""SELECT term, docid, tf, skipped FROM (SELECT term, (r - coalesce(lag(r) OVER (ORDER BY r), 0) - 1)::BIGINT AS skipped FROM (SELECT term, row_number() OVER (ORDER BY term) AS r, term IN (SELECT term FROM lex) AS has
  FROM (SELECT term FROM lex UNION SELECT lower(x) FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z0-9]+')) AS x FROM benchmark) WHERE length(x) <= {MAX_TERM_LENGTH})) WHERE has) JOIN post USING (term)""")
def inverted_iterator(spark, sf):
    """A full scan by a lexicon that also has the benchmark's terms: those without a posting in the documents are skipped and counted."""
    i = index(spark, sf)
    other = tokens(spark.read.parquet(f"{sf}/benchmark.parquet"), "item_id").select("term")
    both = i.lexicon.select("term", "termid").unionByName(other.select("term", F.lit(None).cast("long").alias("termid")))
    has = both.groupBy("term").agg(F.max("termid").alias("termid")).withColumn("has", F.col("termid").isNotNull().cast("long"))
    kept = running_offsets(dense_ids(has, "term", "rank"), "rank", {"has": "at"}).where("has = 1").select("termid", "rank", "at")
    before = kept.select((F.col("at") + 1).alias("at"), F.col("rank").alias("previous"))
    gaps = kept.join(before, "at", "left").select("termid", (F.col("rank") - F.coalesce("previous", F.lit(-1)) - 1).alias("skipped"))
    return i.by_term("term", "termid", "docid", "tf").join(gaps, "termid").select("term", "docid", "tf", "skipped")


@query("SELECT docid, termid, tf FROM post")
def direct_scan(spark, sf):
    return transposed(spark, sf).direct()


@query(f"SELECT docid, termid, tf FROM post WHERE docid = {DOC}")
def direct_doc(spark, sf):
    return transposed(spark, sf).direct().where(F.col("docid") == DOC)


@query("SELECT docid, termid + 1 AS target, lead(termid) OVER (PARTITION BY docid ORDER BY termid) AS hit FROM post")
def direct_next_geq(spark, sf):
    e = transposed(spark, sf)
    return next_geq(e.direct(), e.direct().select("docid", (F.col("termid") + 1).alias("target")), "docid", "termid", parts=2 * e.parts())


@query("SELECT docid, termid, tf FROM post WHERE docid BETWEEN 10 AND 19")
def direct_docid_range(spark, sf):
    return transposed(spark, sf).direct().where(F.col("docid").between(10, 19))


_DIRECT = "(SELECT doc_id AS docid, termid, tf FROM (SELECT docid AS doc_id, term, count(*)::BIGINT AS tf FROM tok GROUP BY ALL) JOIN lex USING (term))"


def _missing(a: DataFrame, b: DataFrame, parts: int) -> DataFrame:
    """How many rows (termid, docid, tf) of a are left when those of b are taken off, repeated ones one by one."""
    both = a.select("termid", "docid", "tf", F.lit(1).alias("more")).unionByName(b.select("termid", "docid", "tf", F.lit(-1).alias("more")))
    left = both.repartition(parts, "docid").groupBy("docid", "termid", "tf").agg(F.sum("more").alias("more"))
    return left.agg(F.coalesce(F.sum(F.greatest("more", F.lit(0))), F.lit(0)).alias("missing"))


@query(f"SELECT count(*)::BIGINT AS missing FROM (SELECT termid, docid, tf FROM post EXCEPT ALL SELECT termid, docid, tf FROM {_DIRECT})")
def inv_minus_dir(spark, sf):
    """Postings of the stored inverted index that the encoded direct index doesn't have."""
    e = transposed(spark, sf)
    return _missing(e.index().postings, e.direct_lists(), 2 * e.parts())


@query(f"SELECT count(*)::BIGINT AS missing FROM (SELECT termid, docid, tf FROM {_DIRECT} EXCEPT ALL SELECT termid, docid, tf FROM post)")
def dir_minus_inv(spark, sf):
    e = transposed(spark, sf)
    return _missing(e.direct_lists(), e.index().postings, 2 * e.parts())


@query("SELECT (SELECT sum(tf)::BIGINT FROM post) AS direct_tokens, (SELECT sum(cf)::BIGINT FROM lex) AS num_tokens, (SELECT sum(tf) FROM post) = (SELECT sum(cf) FROM lex) AS agrees")
def token_total_check(spark, sf):
    """Tokens of the encoded direct index and of the lexicon."""
    e = transposed(spark, sf)
    both = e.direct_lists().agg(F.sum("tf").alias("direct_tokens")).unionByName(e.index().lexicon.agg(F.sum("cf").alias("num_tokens")), allowMissingColumns=True)
    return both.agg(F.max("direct_tokens").alias("direct_tokens"), F.max("num_tokens").alias("num_tokens"), (F.max("direct_tokens") == F.max("num_tokens")).alias("agrees"))


@query("SELECT docid, termid, tf FROM post")
def direct_lists_scan(spark, sf):
    """The direct index decoded from its lists."""
    return transposed(spark, sf).direct_lists()


@query("SELECT docid, count(*)::BIGINT AS n_terms, sum(tf)::BIGINT AS length FROM post GROUP BY 1")
def direct_lists_by_doc(spark, sf):
    """Numbers of terms and tokens of each document that has any, from the encoded direct index."""
    return transposed(spark, sf).direct_lists().groupBy("docid").agg(F.count("*").alias("n_terms"), F.sum("tf").alias("length"))


def _half(spark, sf, odd: int) -> DataFrame:
    return stats_of_runs(inverted(documents(spark, sf).where(F.col("doc_id") % 2 == odd)))


@query("SELECT term, df, cf, maxtf FROM lex")
def lexicon_merge_halves(spark, sf):
    """The lexicons of even and odd documents merged are the whole lexicon."""
    return merge_lexicons(_half(spark, sf, 0), _half(spark, sf, 1))


@query("SELECT term, (df - coalesce(d, 0))::BIGINT AS df, (cf - coalesce(c, 0))::BIGINT AS cf, maxtf FROM lex LEFT JOIN (SELECT term, count(*) AS d, sum(tf) AS c FROM post WHERE docid % 2 = 1 GROUP BY 1) USING (term)")
def lexicon_subtract(spark, sf):
    return subtract_lexicons(index(spark, sf).lexicon, _half(spark, sf, 1))


_DS, _FS = docid_sizes("df", "n", Q), strict_sizes("df", "cf", "cf", Q)
_PS = strict_sizes("cf", "(df + s)", "(df + s)", Q)
_PC = strict_sizes("cf", "(df + carried)", "(df + s)", Q)
_NAMES = ("l", "pointer_width", "n_pointers", "bits")


def _sized(sizes: dict[str, str], header: bool = False) -> dict[str, str]:
    extra = " + " + position_header(sizes["l"], sizes["pointer_width"], sizes["n_pointers"]) if header else ""
    return {c: sizes[c] + (extra if c == "bits" else "") for c in _NAMES}


def _select(sizes: dict[str, str]) -> str:
    return ", ".join(f"({duck(sizes[c])})::BIGINT AS {c}" for c in _NAMES)


def _lexicon(spark, sf) -> tuple[TextIndex, DataFrame]:
    i = index(spark, sf)
    n = documents(spark, sf).count()
    return i, i.lexicon.select("term", "termid", "df", "cf", F.col("sum_last_position").alias("s"), F.lit(n).cast("long").alias("n"))


def _columns(sizes: dict[str, str]) -> list:
    return [F.expr(sizes[c]).cast("long").alias(c) for c in _NAMES]


@query(f"SELECT term, {_select(_sized(_DS))} FROM lex, k")
def ef_docid_size(spark, sf):
    return _lexicon(spark, sf)[1].select("term", *_columns(_sized(_DS)))


@query(f"SELECT term, {_select(_sized(_FS))} FROM lex, k")
def ef_freq_size(spark, sf):
    return _lexicon(spark, sf)[1].select("term", *_columns(_sized(_FS)))


@query(f"SELECT term, {_select(_sized(_PS, True))} FROM lex, k")
def ef_pos_size(spark, sf):
    return _lexicon(spark, sf)[1].select("term", *_columns(_sized(_PS, True)))


@query(f"SELECT term, {_select(_sized(_PC, True))} FROM (SELECT *, sum(s) OVER (ORDER BY termid ROWS UNBOUNDED PRECEDING)::BIGINT AS carried FROM lex), k")
def ef_pos_size_carried(spark, sf):
    """With the position bound carried on from term to term."""
    lex = running_offsets(_lexicon(spark, sf)[1], "termid", {"s": "before"}).withColumn("carried", F.col("before") + F.col("s"))
    return lex.select("term", *_columns(_sized(_PC, True)))


def _bits(lex: DataFrame) -> DataFrame:
    return lex.withColumns({"docid_bits": F.expr(_DS["bits"]).cast("long"), "freq_bits": F.expr(_FS["bits"]).cast("long"), "pos_bits": F.expr(_sized(_PS, True)["bits"]).cast("long")})


_BITS = f"SELECT *, ({duck(_DS['bits'])})::BIGINT AS docid_bits, ({duck(_FS['bits'])})::BIGINT AS freq_bits, ({duck(_sized(_PS, True)['bits'])})::BIGINT AS pos_bits FROM lex, k"
_BEFORE = "coalesce(sum({0}) OVER (ORDER BY {1} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT"


@query(f"SELECT term, {_BEFORE.format('docid_bits', 'termid')} AS docid_offset, {_BEFORE.format('freq_bits', 'termid')} AS freq_offset, {_BEFORE.format('pos_bits', 'termid')} AS pos_offset FROM ({_BITS})")
def ef_lexicon_offsets(spark, sf):
    lex = running_offsets(_bits(_lexicon(spark, sf)[1]), "termid", {f"{c}_bits": f"{c}_offset" for c in ("docid", "freq", "pos")})
    return lex.select("term", "docid_offset", "freq_offset", "pos_offset")


_DT = docid_sizes("n_terms", "v", DIRECT_Q)
_DF = strict_sizes("n_terms", "length", "length", DIRECT_Q)


@query(f"""SELECT docid, n_terms, {_BEFORE.format('tb', 'docid')} AS termid_offset, {_BEFORE.format('fb', 'docid')} AS freq_offset FROM (SELECT docid, n_terms,
  ({duck(_DT['bits'])})::BIGINT AS tb, ({duck(_DF['bits'])})::BIGINT AS fb FROM (SELECT docid, coalesce(n_terms, 0)::BIGINT AS n_terms, length FROM lens LEFT JOIN (SELECT docid, count(*) AS n_terms FROM post GROUP BY 1) USING (docid)), k)""")
def ef_direct_entries(spark, sf):
    """Offsets of each document's lists in the stored direct index, documents in order."""
    return spark.read.parquet(f"{transposed(spark, sf).path}/direct_entries")


@query(f"SELECT i::BIGINT AS part, (v * i // {PARTS})::BIGINT AS begin_termid, (v * (i + 1) // {PARTS})::BIGINT AS end_termid FROM k, range({PARTS}) t(i)")
def ef_partition_bounds(spark, sf):
    bounds = term_partitions(index(spark, sf).lexicon.count(), PARTS)
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(bounds)], "part long, begin_termid long, end_termid long")


def _parted(spark, sf) -> DataFrame:
    i, lex = _lexicon(spark, sf)
    v = i.lexicon.count()
    return _bits(lex).withColumn("part", F.expr(f"((termid + 1) * {PARTS} - 1) div {max(v, 1)}"))


def _files(parted: DataFrame) -> DataFrame:
    sums = [F.sum(f"{c}_bits").alias(f"{c}_sum") for c in ("docid", "freq", "pos")]
    total = parted.groupBy("part").agg(*sums)
    return total.select("part", *[F.expr(f"8 * ({c}_sum div 64 + 1)").alias(f"{c}_bytes") for c in ("docid", "freq", "pos")])


_PART = f"(SELECT *, ((termid + 1) * {PARTS} - 1) // v AS part FROM ({_BITS}))"
_FILES = "SELECT part::BIGINT AS part, " + ", ".join(f"(8 * (sum({c}_bits) // 64 + 1))::BIGINT AS {c}_bytes" for c in ("docid", "freq", "pos")) + f" FROM {_PART} GROUP BY 1"


@query(_FILES)
def ef_partition_files(spark, sf):
    return _files(_parted(spark, sf))


@query(
    "SELECT term, "
    + ", ".join(f"(coalesce(8 * {c}_base, 0) + coalesce(sum({c}_bits) OVER (PARTITION BY p.part ORDER BY termid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS {c}_offset" for c in ("docid", "freq", "pos"))
    + f" FROM {_PART} p JOIN (SELECT part, "
    + ", ".join(f"sum({c}_bytes) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS {c}_base" for c in ("docid", "freq", "pos"))
    + f" FROM ({_FILES})) f ON p.part = f.part"
)
def ef_rebased_offsets(spark, sf):
    """Offsets after the partitions' files were put behind each other: whole words, so offsets move by whole bytes."""
    parted = _parted(spark, sf)
    kinds = ("docid", "freq", "pos")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = _files(parted).select("part", *[F.coalesce(F.sum(f"{c}_bytes").over(before), F.lit(0)).alias(f"{c}_base") for c in kinds])
    lex = running_offsets(parted, "termid", {f"{c}_bits": f"{c}_all" for c in kinds})
    first = lex.groupBy("part").agg(*[F.min(f"{c}_all").alias(f"{c}_first") for c in kinds])
    joined = lex.join(bases, "part").join(first, "part")
    return joined.select("term", *[(8 * F.col(f"{c}_base") + F.col(f"{c}_all") - F.col(f"{c}_first")).alias(f"{c}_offset") for c in kinds])


@query(f"SELECT sum(2 * {duck(floor_log2('length + 1'))} + 1)::BIGINT AS bits FROM lens")
def sizes_file_bits(spark, sf):
    return index(spark, sf).doc_lengths.agg(F.sum(F.expr(f"2 * {floor_log2('length + 1')} + 1")).alias("bits"))


@query(f"SELECT sum(docid_bits)::BIGINT AS docid_bits, sum(freq_bits)::BIGINT AS freq_bits, sum(pos_bits)::BIGINT AS pos_bits, (32 * sum(df))::BIGINT AS plain_docid_bits, (32 * sum(df))::BIGINT AS plain_freq_bits, (32 * sum(cf))::BIGINT AS plain_pos_bits FROM ({_BITS})")
def compression_summary(spark, sf):
    s = lambda e, c: F.sum(e).alias(c)
    return _bits(_lexicon(spark, sf)[1]).agg(*[s(c, c) for c in ("docid_bits", "freq_bits", "pos_bits")], s(F.col("df") * 32, "plain_docid_bits"), s(F.col("df") * 32, "plain_freq_bits"), s(F.col("cf") * 32, "plain_pos_bits"))


def _lists(spark, sf, positions: bool) -> DataFrame:
    e = encoded(spark, sf)
    return decode_lists(e.lists(), documents(spark, sf).count(), Q, positions)


@query("SELECT term, docid FROM post")
def ef_roundtrip_docids(spark, sf):
    return _lists(spark, sf, False).select("term", "docid")


@query("SELECT term, docid, tf FROM post")
def ef_roundtrip_freqs(spark, sf):
    return _lists(spark, sf, False).select("term", "docid", "tf")


@query("SELECT term, docid, tf, array_to_string(positions, ',') AS positions FROM post")
def ef_roundtrip_positions(spark, sf):
    return _lists(spark, sf, True).select("term", "docid", "tf", F.array_join("positions", ",").alias("positions"))


@query(f"SELECT term, docid_bits, freq_bits, pos_bits AS position_bits FROM ({_BITS})")
def ef_blob_lengths(spark, sf):
    """Bits that the codec wrote: the closed forms' values."""
    return encoded(spark, sf).lists().select("term", "docid_bits", "freq_bits", "position_bits")


@query(f"SELECT term, docid + 1 AS target, hit FROM ({_NEXT})")
def ef_seek_blob(spark, sf):
    """From just behind every posting, the next one of its term, in the encoded lists."""
    return encoded(spark, sf).seek_many(index(spark, sf).postings.select("term", (F.col("docid") + 1).alias("target")))


@query("SELECT lex.term, 500::BIGINT AS target, min(docid) FILTER (docid >= 500) AS hit FROM lex JOIN post USING (term) GROUP BY ALL")
def ef_seek_pointers(spark, sf):
    """One seek in each list, to the same document, by the skip pointers."""
    e = encoded(spark, sf)
    n, q = F.lit(documents(spark, sf).count()), F.lit(Q)
    target = F.lit(500).cast("long")
    return e.lists().select("term", target.alias("target"), udfs.ef_next_geq("docids", "df", n, q, target).alias("hit"))


@query("SELECT term, tf FROM (SELECT term, tf, row_number() OVER (PARTITION BY term ORDER BY docid) AS o, df FROM post JOIN lex USING (term)) WHERE o = df // 2 + 1")
def ef_middle_frequency(spark, sf):
    """The frequency in the middle of each list, read at its place."""
    return encoded(spark, sf).lists().select("term", udfs.ef_tf_at("freqs", "df", "cf", F.lit(Q), F.expr("df div 2")).alias("tf"))


@query("SELECT term, docid, tf FROM post JOIN lex USING (term) WHERE df BETWEEN 100 AND 400")
def ef_udtf_scan(spark, sf):
    """Lists of medium length through the table function, in SQL. They are chosen first: no condition goes below a table function, which would decode all lists."""
    udfs.register(spark)
    e = encoded(spark, sf)
    n = documents(spark, sf).count()
    return spark.sql("SELECT l.term, p.docid, p.tf FROM {lists} l, LATERAL ef_postings(l.docids, l.freqs, l.df, l.cf, :n, :q) p", args={"n": n, "q": Q}, lists=e.lists().where("df BETWEEN 100 AND 400"))


@query(f"SELECT term, docid, tf, length FROM post JOIN lens USING (docid) WHERE term = '{TERM}'")
def ef_postings_term(spark, sf):
    """One term's postings from the encoded index: only its list is decoded."""
    return encoded(spark, sf).postings(TERM).select("term", "docid", "tf", "length")


@query(f"SELECT term, {_BEFORE.format('docid_bits', 'termid')} AS docid_offset, {_BEFORE.format('freq_bits', 'termid')} AS freq_offset, {_BEFORE.format('pos_bits', 'termid')} AS position_offset FROM ({_BITS})")
def ef_stored_lexicon(spark, sf):
    """The encoded index's lexicon with the offsets that were written."""
    return encoded(spark, sf).index().lexicon.select("term", "docid_offset", "freq_offset", "position_offset")


@query(
    "SELECT term, "
    + ", ".join(f"(coalesce(8 * {c}_base, 0) + coalesce(sum({c}_bits) OVER (PARTITION BY p.part ORDER BY termid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS {c}_offset" for c in ("docid", "freq", "pos"))
    + f" FROM {_PART} p JOIN (SELECT part, "
    + ", ".join(f"sum({c}_bytes) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS {c}_base" for c in ("docid", "freq", "pos"))
    + f" FROM ({_FILES})) f ON p.part = f.part"
)
def ef_merged_parts(spark, sf):
    """Stored lists of term ranges, each with offsets of its own, merged as one lexicon."""
    lists = encoded(spark, sf).lists().select("term", "termid", "docid_bits", "freq_bits", "position_bits")
    kinds = ("docid", "freq", "position")
    parts = []
    for a, b in term_partitions(lists.count(), PARTS):
        part = lists.where((F.col("termid") >= a) & (F.col("termid") < b))
        parts.append(running_offsets(part, "termid", {f"{c}_bits": f"{c}_offset" for c in kinds}))
    return store.merge_lexicon_parts(parts).select("term", "docid_offset", "freq_offset", F.col("position_offset").alias("pos_offset"))


@query("SELECT key, value FROM (SELECT unnest(['num_documents', 'num_terms', 'num_pointers', 'num_tokens', 'has_positions', 'inverted']) AS key, unnest([n::VARCHAR, v::VARCHAR, (SELECT sum(df)::BIGINT FROM lex)::VARCHAR, (SELECT sum(cf)::BIGINT FROM lex)::VARCHAR, 'true', 'lists']) AS value FROM k)")
def ef_properties(spark, sf):
    """Properties of the encoded index."""
    kept = spark.read.parquet(f"{encoded(spark, sf).path}/properties")
    return kept.where(F.col("key").isin("num_documents", "num_terms", "num_pointers", "num_tokens", "has_positions", "inverted"))


_STOP = ("the", "of", "and", "die", "le")


@query(f"SELECT term, docid, tf FROM post WHERE term NOT IN {_STOP}")
def postings_without_stopwords(spark, sf):
    stop = spark.createDataFrame([(w,) for w in _STOP], "term string")
    return TextIndex.build(documents(spark, sf), stopwords=stop).postings.select("term", "docid", "tf")


_SCALARS = {"lower_bits": lower_bits("n", "u", True), "lower_bits_plain": lower_bits("n", "u", False), "ceil_log2": ceil_log2("u")}


@query("SELECT DISTINCT df AS n, cf AS u, " + ", ".join(f"({duck(e)})::BIGINT AS {c}" for c, e in _SCALARS.items()).replace("(n)", "(df)").replace("(u)", "(cf)") + " FROM lex")
def codec_scalars(spark, sf):
    """The codec's scalar functions on every pair of df and cf."""
    pairs = index(spark, sf).lexicon.select(F.col("df").alias("n"), F.col("cf").alias("u")).distinct()
    return pairs.select("n", "u", *[F.expr(e).cast("long").alias(c) for c, e in _SCALARS.items()])
