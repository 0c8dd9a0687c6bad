"""An index on disk: a folder of Parquet tables and a table of properties.

Properties are written last and say ``complete``: a folder without them isn't an index, so a write that was cut off can't be opened.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.functions.blobs import decode_direct, decode_lists, encode_direct, encode_lists
from lexispark.functions.runs import rows_of
from lexispark.operators.index import PART_ROWS, TextIndex, running_offsets
from lexispark.schema import LOG2_QUANTUM

DIRECT_QUANTUM = 8


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def vacant(spark: SparkSession, path: str) -> None:
    if exists(spark, path):
        raise FileExistsError(f"{path} exists already")


def parts_for(partitions: int, index_rows: int) -> int:
    """Tasks and files: at least ``partitions``, and in proportion to the postings."""
    return max(partitions, ceil(index_rows / PART_ROWS))


def dealt(table: DataFrame, order: str, weight: str, parts: int) -> DataFrame:
    """The table (ids ``order``, and a number ``weight``) with pid: ``parts`` ranges of ids of about equal weights."""
    weighed = table.select("*", F.expr(weight).cast("long").alias("_weight"))
    total = weighed.agg(F.sum("_weight")).first()[0] or 0
    before = running_offsets(weighed, order, {"_weight": "_before"})
    return before.withColumn("pid", F.expr(f"cast(least({parts - 1}, _before div {max(1, ceil(total / parts))}) as int)")).drop("_weight", "_before")


def cuts_of(placed: DataFrame, order: str) -> list[int]:
    """The first id of each range, in order; one at least. As many rows as there are tasks."""
    return sorted(r[0] for r in placed.groupBy("pid").agg(F.min(order)).select(F.col(f"min({order})")).collect()) or [0]


LIST_WEIGHT = "4 * df + 2 * cf + 16"


def write_index(index: TextIndex, path: str, with_positions: bool = False, log2_quantum: int = LOG2_QUANTUM, partitions: int = 8) -> None:
    """Write ``index``; fails if ``path`` exists. Postings are range-partitioned and sorted by termid, so row groups can be skipped; a term is in one file.

    There are ``partitions`` files at least, and more for more postings.
    """
    vacant(index.spark, path)
    _write_small(index, path, partitions)
    lexicon = index.spark.read.parquet(f"{path}/lexicon")
    parts = parts_for(partitions, lexicon.agg(F.sum("df")).first()[0] or 0)
    placed = dealt(lexicon.select("term", "termid", "df", "cf"), "termid", LIST_WEIGHT, parts).select("term", "termid", "pid")
    if index.runs is not None:
        runs = index.runs.where("term is not null").join(placed, "term").repartitionById(parts, "pid").sortWithinPartitions("termid", "base")
        posts = rows_of(runs, with_positions)
    else:
        posts = index.postings if with_positions else index.postings.withColumn("positions", F.lit(None).cast("array<int>"))
        posts = posts.join(placed.select("termid", "pid"), "termid").repartitionById(parts, "pid").sortWithinPartitions("termid", "docid")
    posts.select("term", "termid", "docid", "tf", "positions").write.parquet(f"{path}/postings")
    write_properties(index.spark, path, {"log2_quantum": log2_quantum, "has_positions": with_positions, "aligned": True, "byte_order": "little", "inverted": "rows"})


def _write_small(index: TextIndex, path: str, partitions: int) -> None:
    index.lexicon.repartitionByRange(partitions, "term").sortWithinPartitions("term").write.parquet(f"{path}/lexicon")
    index.doc_lengths.repartitionByRange(partitions, "docid").sortWithinPartitions("docid").write.parquet(f"{path}/doc_lengths")
    stored = TextIndex(index.postings, index.spark.read.parquet(f"{path}/lexicon"), index.spark.read.parquet(f"{path}/doc_lengths"))
    stored.stats().write.parquet(f"{path}/collection_stats")


def write_properties(spark: SparkSession, path: str, values: dict) -> None:
    """Properties of the inverted index, with the collection's statistics; written last, they make the index complete."""
    stats = spark.read.parquet(f"{path}/collection_stats").first().asDict()
    _properties(spark, values | stats | {"complete": True}, path)


def _properties(spark: SparkSession, values: dict, path: str) -> None:
    spark.createDataFrame([(k, str(v).lower()) for k, v in values.items()], "key string, value string").coalesce(1).write.mode("append").parquet(f"{path}/properties")


def properties(spark: SparkSession, path: str) -> dict[str, str]:
    return {r["key"]: r["value"] for r in spark.read.parquet(f"{path}/properties").collect()}  # a handful of rows


def open_index(spark: SparkSession, path: str) -> TextIndex:
    """The stored index; encoded lists are decoded when they are read."""
    kept = properties(spark, path)
    if kept.get("complete") != "true":
        raise ValueError(f"{path} holds no complete index")
    read = lambda name: spark.read.parquet(f"{path}/{name}")
    if kept["inverted"] == "lists":
        postings = decode_lists(read("ef_lists"), int(kept["num_documents"]), int(kept["log2_quantum"]), kept["has_positions"] == "true")
    else:
        postings = read("postings")
    return TextIndex(postings, read("lexicon"), read("doc_lengths"))


def append_lexicon(lexicon: DataFrame, path: str) -> None:
    """Add entries of a lexicon; their terms must follow all those stored."""
    spark = lexicon.sparkSession
    last = spark.read.parquet(f"{path}/lexicon").agg(F.max("term")).first()[0]
    first = lexicon.agg(F.min("term")).first()[0]
    if last is not None and first is not None and first.encode() <= last.encode():
        raise ValueError(f"{first!r} doesn't follow {last!r}")
    lexicon.sortWithinPartitions("term").write.mode("append").parquet(f"{path}/lexicon")


def write_compressed(spark: SparkSession, source: str, path: str, positions: bool = False, log2_quantum: int = LOG2_QUANTUM, partitions: int = 8) -> None:
    """Encode the stored index ``source`` to ``path``: lists as bit strings, a lexicon with their offsets, lengths, statistics, properties."""
    vacant(spark, path)
    index = open_index(spark, source)
    if positions and properties(spark, source)["has_positions"] != "true":
        raise ValueError("the index has no positions")
    parts = parts_for(partitions, int(properties(spark, source)["num_pointers"]))
    cuts = cuts_of(dealt(index.lexicon.select("termid", "df", "cf"), "termid", LIST_WEIGHT, parts), "termid")
    lists = encode_lists(index.postings, index.doc_lengths.count(), log2_quantum, positions, cuts)
    lists.write.parquet(f"{path}/ef_lists")
    bits = spark.read.parquet(f"{path}/ef_lists").select("termid", "docid_bits", "freq_bits", "position_bits")
    offsets = running_offsets(bits, "termid", {f"{c}_bits": f"{c}_offset" for c in ("docid", "freq", "position")})
    lexicon = index.lexicon.join(offsets.select("termid", "docid_offset", "freq_offset", "position_offset"), "termid").select(*index.lexicon.columns, "docid_offset", "freq_offset", "position_offset")
    _write_small(TextIndex(index.postings, lexicon, index.doc_lengths), path, partitions)
    write_properties(spark, path, {"log2_quantum": log2_quantum, "has_positions": positions, "aligned": True, "byte_order": "little", "inverted": "lists"})


def write_direct(spark: SparkSession, path: str, partitions: int = 8) -> None:
    """Transpose the stored postings: rows, and encoded lists with their offsets. Fails if there is a direct index, or if termids don't follow the terms."""
    kept = properties(spark, path)
    if kept.get("aligned") != "true":
        raise ValueError("termids must follow the order of terms")
    vacant(spark, f"{path}/direct")
    index = open_index(spark, path)
    parts = parts_for(partitions, int(kept["num_pointers"]))
    index.direct().repartitionByRange(parts, "docid").sortWithinPartitions("docid", "termid").write.parquet(f"{path}/direct")
    cuts = cuts_of(dealt(index.doc_lengths, "docid", "length + 16", parts), "docid")
    encode_direct(spark.read.parquet(f"{path}/direct"), index.doc_lengths, int(kept["num_terms"]), DIRECT_QUANTUM, cuts).write.parquet(f"{path}/direct_lists")
    bits = spark.read.parquet(f"{path}/direct_lists").select("docid", "n_terms", "termid_bits", "freq_bits")
    entries = running_offsets(bits, "docid", {"termid_bits": "termid_offset", "freq_bits": "freq_offset"})
    entries.select("docid", "n_terms", "termid_offset", "freq_offset").repartitionByRange(partitions, "docid").sortWithinPartitions("docid").write.parquet(f"{path}/direct_entries")
    write_direct_properties(spark, path)


def write_direct_properties(spark: SparkSession, path: str) -> None:
    _properties(spark, {"has_direct": True, "direct_log2_quantum": DIRECT_QUANTUM}, path)


def read_direct(spark: SparkSession, path: str) -> DataFrame:
    """docid, termid, tf, decoded from the encoded direct index."""
    kept = properties(spark, path)
    return decode_direct(spark.read.parquet(f"{path}/direct_lists"), int(kept["num_terms"]), int(kept["direct_log2_quantum"]))


def merge_lexicon_parts(parts: list[DataFrame]) -> DataFrame:
    """Lexicons of encoded parts, of term ranges in order, as one: offsets move by the whole 64-bit words that the parts before have.

    Each part has termid, the bits of its lists, and offsets that begin at 0.
    """
    kinds = ("docid", "freq", "position")
    moved, base = [], dict.fromkeys(kinds, 0)
    for part in parts:
        sums = part.agg(*[F.coalesce(F.sum(f"{c}_bits"), F.lit(0)).alias(c) for c in kinds]).first()
        moved.append(part.withColumns({f"{c}_offset": F.col(f"{c}_offset") + base[c] for c in kinds}))
        base = {c: base[c] + 64 * (sums[c] // 64 + 1) for c in kinds}
    out = moved[0]
    for part in moved[1:]:
        out = out.unionByName(part)
    return out
