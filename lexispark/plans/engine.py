"""The engine's commands over stored indexes."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.functions.blobs import decode_lists, seek_in_lists
from lexispark.operators.index import TextIndex, next_geq, parts_of_rows
from lexispark.schema import LOG2_QUANTUM
from lexispark.scratch import delete
from lexispark.sources import store


class Engine:
    """Build, compress, transpose and query the index in a folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def build(self, docs: DataFrame, docid: str = "doc_id", text: str = "text", stopwords: DataFrame | None = None, positions: bool = False, partitions: int = 8) -> Engine:
        """Intermediate tables stand beside the folder, and are deleted when the index is complete."""
        store.vacant(self.spark, self.path)
        work = f"{self.path.rstrip('/')}-work-{uuid.uuid4().hex}"
        store.write_index(TextIndex.build(docs, docid, text, stopwords, work), self.path, positions, partitions=partitions)
        delete(self.spark, work)
        return self

    def compress(self, target: str, positions: bool = False, partitions: int = 8, log2_quantum: int = LOG2_QUANTUM) -> Engine:
        """Encode the index to another folder, with or without positions."""
        store.write_compressed(self.spark, self.path, target, positions, log2_quantum, partitions)
        return Engine(self.spark, target)

    def transpose(self, partitions: int = 8) -> Engine:
        store.write_direct(self.spark, self.path, partitions)
        return self

    def index(self) -> TextIndex:
        return store.open_index(self.spark, self.path)

    def properties(self) -> dict[str, str]:
        return store.properties(self.spark, self.path)

    def parts(self) -> int:
        """Tasks in proportion to the postings."""
        return parts_of_rows(self.spark, int(self.properties()["num_pointers"]))

    def has_positions(self) -> bool:
        return self.properties().get("has_positions") == "true"

    def lexicon(self) -> DataFrame:
        return self.index().lexicon.orderBy("term")

    def doc_lengths(self) -> DataFrame:
        return self.index().doc_lengths.orderBy("docid")

    def stats(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/collection_stats")

    def lists(self) -> DataFrame:
        """The encoded lists, one row a term."""
        return self.spark.read.parquet(f"{self.path}/ef_lists")

    def _of(self, term: str) -> DataFrame:
        """A term's postings; of an encoded index only this list is decoded."""
        kept = self.properties()
        if kept["inverted"] == "lists":
            return decode_lists(self.lists().where(F.col("term") == term), int(kept["num_documents"]), int(kept["log2_quantum"]), kept["has_positions"] == "true")
        return self.index().postings_of_term(term)

    def postings(self, term: str) -> DataFrame:
        """A term's postings with document lengths, in order."""
        return self._of(term).join(self.index().doc_lengths, "docid").orderBy("docid")

    def seek(self, term: str, target: int) -> DataFrame:
        """The first posting of the term at or after the target; no row past the end."""
        return self._of(term).where(F.col("docid") >= target).orderBy("docid").limit(1)

    def seek_many(self, probes: DataFrame) -> DataFrame:
        """Probes (term, target) to (term, target, hit); in an encoded index by the lists' pointers."""
        kept = self.properties()
        if kept["inverted"] == "lists":
            return seek_in_lists(self.lists(), probes, int(kept["num_documents"]), int(kept["log2_quantum"]), self.parts())
        return next_geq(self.index().postings, probes, "term", "docid", parts=self.parts())

    def direct(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/direct")

    def direct_lists(self) -> DataFrame:
        """The direct index decoded from its encoded lists."""
        return store.read_direct(self.spark, self.path)
