"""The index tables, built from a collection: documents are inverted to runs of postings (:mod:`lexispark.functions.runs`) once, all else are DataFrame operations on these."""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexispark.functions.runs import lengths_of, rows_of, runs_of
from lexispark.schema import MAX_TERM_LENGTH
from lexispark.scratch import spill

PART_BYTES = 32 << 20  # of text in a task
PART_ROWS = 2_000_000  # postings in a task, where rows are sorted


def tokens(docs: DataFrame, docid: str = "doc_id", text: str = "text", max_term_length: int = MAX_TERM_LENGTH) -> DataFrame:
    """docid, pos, term: runs of ASCII letters and digits, lower-cased; longer terms than max_term_length are dropped.

    pos counts all runs, dropped ones too. Null text has no tokens.
    """
    raw = docs.select(F.col(docid).cast("long").alias("docid"), F.posexplode(F.regexp_extract_all(text, F.lit("[A-Za-z0-9]+"), F.lit(0))).alias("pos", "raw"))
    return raw.where(F.length("raw") <= max_term_length).select("docid", "pos", F.lower("raw").alias("term"))


def without(toks: DataFrame, stopwords: DataFrame) -> DataFrame:
    """Tokens whose term isn't among the stopwords (column term)."""
    return toks.join(stopwords.select("term").distinct(), "term", "left_anti").select("docid", "pos", "term")


def postings_of(toks: DataFrame) -> DataFrame:
    """term, docid, tf, positions (ascending)."""
    return toks.groupBy("term", "docid").agg(F.count("*").alias("tf"), F.sort_array(F.collect_list("pos")).alias("positions"))


def lexicon_of(postings: DataFrame) -> DataFrame:
    """term, termid, df, cf, maxtf, sum_last_position; termids are dense and follow the order of terms (UTF-8 bytes).

    Ranks are dealt by :func:`dense_ids`, so no single task sees all terms.
    """
    last = F.element_at("positions", -1).cast("long") if "positions" in postings.columns else F.lit(0).cast("long")
    stats = postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"), F.max("tf").alias("maxtf"), F.sum(last).alias("sum_last_position"))
    return dense_ids(stats, "term", "termid").select("term", "termid", "df", "cf", "maxtf", "sum_last_position")


def dense_ids(df: DataFrame, order: str, name: str) -> DataFrame:
    """df with ``name``: 0, 1, ... by the values of ``order``, which must differ.

    Two levels: rows are counted by leading characters, whose running counts (as many as there are different leads) are joined back; the rest
    is ranked inside each lead.
    """
    lead = df.withColumn("_lead", F.substring(F.col(order).cast("string"), 1, 2))
    counts = lead.groupBy("_lead").agg(F.count("*").alias("_n"))
    before = counts.select("_lead", F.coalesce(F.sum("_n").over(Window.orderBy("_lead").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("_lead").orderBy(order))
    return lead.join(before, "_lead").withColumn(name, F.col("_before") + rank - 1).drop("_lead", "_before")


def parts_for(docs: DataFrame, text: str, least: int = 8) -> int:
    """Tasks in proportion to the documents' bytes."""
    return max(least, ceil((docs.agg(F.sum(F.octet_length(text))).first()[0] or 0) / PART_BYTES))


def inverted(docs: DataFrame, docid: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents' runs of postings."""
    return runs_of(docs, docid, text, MAX_TERM_LENGTH, parts_for(docs, text))


def stats_of_runs(runs: DataFrame) -> DataFrame:
    """term, df, cf, maxtf, sum_last_position, from runs."""
    of = runs.where("term is not null").groupBy("term")
    return of.agg(F.sum("n").alias("df"), F.sum("cf").alias("cf"), F.max("maxtf").alias("maxtf"), F.sum("sum_last").alias("sum_last_position"))


def lexicon_of_runs(runs: DataFrame) -> DataFrame:
    """As :func:`lexicon_of`, from runs."""
    return dense_ids(stats_of_runs(runs), "term", "termid").select("term", "termid", "df", "cf", "maxtf", "sum_last_position")


@dataclass
class TextIndex:
    """A collection's index: postings with termids, lexicon, document lengths and statistics, all lazy DataFrames; of one that was built, its runs too."""

    postings: DataFrame
    lexicon: DataFrame
    doc_lengths: DataFrame
    runs: DataFrame | None = None

    @classmethod
    def build(cls, docs: DataFrame, docid: str = "doc_id", text: str = "text", stopwords: DataFrame | None = None, work: str | None = None) -> TextIndex:
        """The documents are read once: their runs, and the lexicon, are written to the folder ``work``, by default in the shared folder."""
        runs = spill(inverted(docs, docid, text), "runs", work and f"{work}/runs")
        lengths = lengths_of(runs.where("term is null")).groupBy("docid").agg(F.sum("tf").alias("length"))
        if stopwords is not None:
            stop = stopwords.select("term").where("term is not null").distinct()
            less = lengths_of(runs.join(stop, "term", "left_semi")).groupBy("docid").agg(F.sum(-F.col("tf")).alias("length"))
            lengths = lengths.unionByName(less).groupBy("docid").agg(F.sum("length").alias("length"))
            runs = runs.where("term is not null").join(stop, "term", "left_anti")
        lexicon = spill(lexicon_of_runs(runs), "lexicon", work and f"{work}/lexicon")
        lengths = docs.select(F.col(docid).cast("long").alias("docid")).join(lengths, "docid", "left").select("docid", F.coalesce("length", F.lit(0)).alias("length"))
        return cls(rows_of(runs.join(lexicon.select("term", "termid"), "term")), lexicon, lengths, runs)

    @property
    def spark(self) -> SparkSession:
        return self.postings.sparkSession

    def stats(self) -> DataFrame:
        """num_documents, num_terms, num_pointers, num_tokens."""
        docs = self.doc_lengths.agg(F.count("*").alias("num_documents"))
        terms = self.lexicon.agg(F.count("*").alias("num_terms"), F.sum("df").alias("num_pointers"), F.sum("cf").alias("num_tokens"))
        names = ["num_documents", "num_terms", "num_pointers", "num_tokens"]
        return docs.unionByName(terms, allowMissingColumns=True).agg(*[F.coalesce(F.max(c), F.lit(0)).alias(c) for c in names])

    def term(self, term: str) -> DataFrame:
        return self.lexicon.where(F.col("term") == term)

    def term_range(self, begin: int, end: int) -> DataFrame:
        return self.lexicon.where(F.col("termid").between(begin, end - 1))

    def postings_of_term(self, term: str) -> DataFrame:
        return self.postings.where(F.col("term") == term)

    def with_lengths(self) -> DataFrame:
        """Postings with the document's length; Spark broadcasts the lengths only while they are small."""
        return self.postings.join(self.doc_lengths, "docid")

    def parts(self) -> int:
        """Tasks in proportion to the postings."""
        return parts_of_rows(self.spark, self.lexicon.agg(F.sum("df")).first()[0] or 0)

    def by_term(self, *columns: str) -> DataFrame:
        """Postings' columns dealt by termid, for windows by term: tasks don't grow with the input, but for the longest list."""
        return self.postings.select(*columns).repartition(self.parts(), "termid")

    def ordinals(self) -> DataFrame:
        """Postings (term, termid, docid, tf) with ord, the 0-based rank in the term's list."""
        return self.by_term("term", "termid", "docid", "tf").withColumn("ord", (F.row_number().over(Window.partitionBy("termid").orderBy("docid")) - 1).cast("long"))

    def direct(self) -> DataFrame:
        """The transposed index: docid, termid, tf; documents' lists are together and sorted once it's written (:func:`lexispark.sources.store.write_direct`)."""
        return self.postings.select("docid", "termid", "tf")


def parts_of_rows(spark: SparkSession, rows: int) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), ceil(rows / PART_ROWS))


def next_geq(lists: DataFrame, probes: DataFrame, group: str, item: str, target: str = "target", parts: int = 0) -> DataFrame:
    """For each probe (group, target): hit, the first item of the group's list at or above target; null past the end. parts: tasks, by default as many as the session's.

    One union and one window: going down from the largest, the least item so far is the hit, so each row is looked at once.
    """
    rows = lists.select(group, F.col(item).alias("at"), F.lit(1).alias("real")).unionByName(probes.select(group, F.col(target).alias("at"), F.lit(0).alias("real")))
    rows = rows.repartition(parts, group) if parts else rows
    down = Window.partitionBy(group).orderBy(F.desc("at"), F.desc("real")).rowsBetween(Window.unboundedPreceding, 0)
    hit = F.min(F.when(F.col("real") == 1, F.col("at"))).over(down)
    return rows.withColumn("hit", hit).where("real = 0").select(group, F.col("at").alias(target), "hit")


def running_offsets(df: DataFrame, order: str, sizes: dict[str, str], width: int = 4096) -> DataFrame:
    """df with a column for each item (size: name) of ``sizes``: the sum of ``size`` over all rows before, by the dense ids ``order``.

    Two levels: blocks of ``width`` ids are summed first, so the window without partitions sees one row a block.
    """
    block = df.withColumn("_block", F.expr(f"{order} div {width}"))
    sums = block.groupBy("_block").agg(*[F.sum(size).alias(f"_sum_{name}") for size, name in sizes.items()])
    blocks, rows = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("_block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("_block", *[F.coalesce(F.sum(f"_sum_{name}").over(blocks), F.lit(0)).alias(f"_before_{name}") for name in sizes.values()])
    inside = block.withColumns({f"_inside_{name}": F.coalesce(F.sum(size).over(rows), F.lit(0)) for size, name in sizes.items()})
    out = inside.join(before, "_block").withColumns({name: F.col(f"_before_{name}") + F.col(f"_inside_{name}") for name in sizes.values()})
    return out.drop("_block", *[f"_{part}_{name}" for name in sizes.values() for part in ("inside", "before")])


def merge_lexicons(a: DataFrame, b: DataFrame) -> DataFrame:
    """Statistics of two lexicons added: df and cf are summed, maxtf is the larger."""
    both = a.select("term", "df", "cf", "maxtf").unionByName(b.select("term", "df", "cf", "maxtf"))
    return both.groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"), F.max("maxtf").alias("maxtf"))


def subtract_lexicons(a: DataFrame, b: DataFrame) -> DataFrame:
    """b's df and cf taken off a's; maxtf stays a's."""
    less = b.select("term", F.col("df").alias("bdf"), F.col("cf").alias("bcf"))
    return a.join(less, "term", "left").select("term", (F.col("df") - F.coalesce("bdf", F.lit(0))).alias("df"), (F.col("cf") - F.coalesce("bcf", F.lit(0))).alias("cf"), "maxtf")


def term_partitions(n_terms: int, parts: int) -> list[tuple[int, int]]:
    """Half-open termid ranges that split 0 .. n_terms evenly."""
    return [(n_terms * i // parts, n_terms * (i + 1) // parts) for i in range(parts)]
