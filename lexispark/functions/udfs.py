"""The codec as SQL functions: ef_postings (a table function), ef_next_geq, ef_tf_at."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from lexispark.functions import codec


@F.udtf(returnType=StructType().add("docid", LongType()).add("tf", LongType()))
class EfPostings:
    """Rows (docid, tf) of an encoded list: docids, freqs, df, cf, number of documents, log2 of the quantum."""

    def eval(self, docids: bytes, freqs: bytes, df: int, cf: int, n_docs: int, q: int):
        d = codec.decode_docids(codec.unpack(docids), df, n_docs, q)
        f = codec.decode_freqs(codec.unpack(freqs), df, cf, q)
        yield from zip(d.tolist(), f.tolist(), strict=True)


@F.pandas_udf(LongType())
def ef_next_geq(docids: pd.Series, df: pd.Series, n_docs: pd.Series, q: pd.Series, target: pd.Series) -> pd.Series:
    """The first docid at or above the target, null past the end."""
    return pd.Series([codec.next_geq(*row) for row in zip(docids, df, n_docs, q, target, strict=True)], dtype="Int64")


@F.pandas_udf(LongType())
def ef_tf_at(freqs: pd.Series, df: pd.Series, cf: pd.Series, q: pd.Series, i: pd.Series) -> pd.Series:
    """The i-th frequency of an encoded list, from 0."""
    return pd.Series([codec.freq_at(*row) for row in zip(freqs, df, cf, q, i, strict=True)], dtype="Int64")


def register(spark: SparkSession) -> None:
    spark.udtf.register("ef_postings", EfPostings)
    spark.udf.register("ef_next_geq", ef_next_geq)
    spark.udf.register("ef_tf_at", ef_tf_at)
