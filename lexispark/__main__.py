"""python -m lexispark build|compress|transpose|doc-lengths: the engine's commands, for spark-submit or a shell."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from lexispark.plans.engine import Engine
from lexispark.schema import LOG2_QUANTUM


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lexispark")
    of = p.add_subparsers(dest="command", required=True)
    build = of.add_parser("build", help="index a Parquet table of documents")
    build.add_argument("documents")
    build.add_argument("index")
    build.add_argument("--docid", default="doc_id")
    build.add_argument("--text", default="text")
    build.add_argument("--stopwords", help="a text file of words, one a line")
    compress = of.add_parser("compress", help="encode an index as quasi-succinct lists")
    compress.add_argument("index")
    compress.add_argument("target")
    compress.add_argument("-q", "--log2-quantum", type=int, default=LOG2_QUANTUM)
    transpose = of.add_parser("transpose", help="add the direct index")
    transpose.add_argument("index")
    lengths = of.add_parser("doc-lengths", help="print the documents' lengths")
    lengths.add_argument("index")
    for x in (build, compress):
        x.add_argument("-b", "--positions", action="store_true")
    for x in (build, compress, transpose):
        x.add_argument("-p", "--partitions", type=int, default=8)
    return p


def main(args: list[str] | None = None) -> None:
    a = parser().parse_args(args)
    spark = SparkSession.builder.appName("lexispark").getOrCreate()
    engine = Engine(spark, a.index)
    if a.command == "build":
        words = spark.read.text(a.stopwords).toDF("term") if a.stopwords else None
        engine.build(spark.read.parquet(a.documents), a.docid, a.text, words, a.positions, a.partitions)
    elif a.command == "compress":
        engine.compress(a.target, a.positions, a.partitions, a.log2_quantum)
    elif a.command == "transpose":
        engine.transpose(a.partitions)
    else:
        for docid, length in engine.doc_lengths().toLocalIterator():
            print(docid, length, sep="\t")


if __name__ == "__main__":
    main()
