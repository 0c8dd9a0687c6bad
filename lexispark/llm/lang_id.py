"""Language ID by compression: each language has a zstandard raw-content dictionary; the smallest encoding wins.

Fitting takes a bounded sample of labelled rows: of each language the ``per_language`` texts first in the order of a hash,
the first ``text_bytes`` bytes of each, up to ``dict_bytes`` bytes in all. Every language keeps its own sample, be it short: none is cut to another's
size, so a rare language or a mislabelled row takes nothing from the others. A shorter dictionary saves less, so sizes aren't
normalised: a language of little text wins where its own words tell, and else the others do. At most ``max_languages`` languages
are learned (the most frequent ones); more raise an error rather than being dropped. So dictionaries are bounded by
max_languages x dict_bytes and may go to the executors.

Texts are lower-cased, in fitting too. Matches of four bytes or more are searched for (zstandard's lazy strategy), which short words need.
Prediction reads a whole text in chunks of ``chunk`` bytes; each is compressed with every dictionary and the sizes are added up.
The score is the margin between the best and the second, over the second, times ``gain``, cut to 0..1. A score
below ``min_score`` is a narrow margin: the row is rejected (``accepted`` false), but its language is still told.

Defined cases: null text, or text without a letter: ``und``, score 0, rejected; no labelled rows: every row so; one language:
score 1; equal sizes: the first language in order, score 0, rejected; repeated rows are judged each; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LETTER = regex.compile(r"\p{L}")


def held_out(key: Column) -> Column:
    """Rows kept for measuring: the CRC-32 of the key as text is divisible by five. Null keys are not held out."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def fit(labelled: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = 200, text_bytes: int = 2000, dict_bytes: int = 65536, max_languages: int = 256) -> dict[str, bytes]:
    """Dictionaries by language, from a bounded sample of the labelled rows; see the module's text."""
    from pyspark.sql import Window

    rows = labelled.select(F.col(lang).alias("lang"), F.col(key).alias("k"), F.substring(F.col(text), 1, text_bytes).alias("text")).where("lang is not null and text is not null and text <> ''")
    n = rows.select("lang").distinct().limit(max_languages + 1).count()
    if n > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    first = Window.partitionBy("lang").orderBy(F.xxhash64("k", "text"), "k", "text")
    picked = rows.withColumn("r", F.row_number().over(first)).where(F.col("r") <= per_language)
    parts: dict[str, list[bytes]] = {}
    for row in picked.orderBy("lang", F.desc("r")).select("lang", "text").toLocalIterator():
        parts.setdefault(row["lang"], []).append(row["text"].lower().encode()[:text_bytes])
    whole = {k: b"\n".join(v) for k, v in parts.items()}
    return {k: v[-dict_bytes:] for k, v in whole.items()}


def predict(docs: DataFrame, dictionaries: dict[str, bytes], text: str = "text", chunk: int = 4096, search: int = 4, gain: float = 5.0, min_score: float = 0.005) -> DataFrame:
    """All columns of docs, then lang_pred, score, accepted."""
    names = sorted(dictionaries)
    raw = [dictionaries[k] for k in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        how = zstandard.ZstdCompressionParameters.from_level(3, window_log=17, hash_log=16, chain_log=16, search_log=search, min_match=4, strategy=zstandard.STRATEGY_LAZY, write_content_size=False, write_dict_id=False)
        packs = []
        for data in raw:
            d = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=how)
            packs.append(zstandard.ZstdCompressor(dict_data=d, compression_params=how))

        def judge(t: str | None) -> tuple[str, float, bool]:
            if t is None or not packs or not LETTER.search(t):
                return "und", 0.0, False
            b = t.lower().encode()
            sizes = [sum(len(z.compress(b[i : i + chunk])) for i in range(0, len(b), chunk)) for z in packs]
            order = sorted(range(len(sizes)), key=lambda i: (sizes[i], i))
            if len(order) == 1:
                return names[0], 1.0, True
            best, second = sizes[order[0]], sizes[order[1]]
            score = min(1.0, gain * (second - best) / second)
            return names[order[0]], score, score >= min_score

        for batch in batches:
            found = [judge(t.as_py()) for t in batch.column(text)]
            cols = [pa.array([x[i] for x in found], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *cols], names=[*batch.schema.names, "lang_pred", "score", "accepted"])

    clash = {"lang_pred", "score", "accepted"} & set(docs.columns)
    docs = docs.drop(*clash)
    fields = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes)
    return docs.mapInArrow(run, f"{fields}, lang_pred string, score double, accepted boolean")
