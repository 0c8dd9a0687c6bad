"""The queries of this subpackage's operators, with production parameters, over whole tables; and their SQL where SQL can tell."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexispark.llm import chat, decontaminate, exact_dedup, lang_id, line_dedup, packing, simhash, suffix_dedup, url_filter, warc
from lexispark.llm.text import table
from lexispark.scratch import new_path

RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(table(spark, sf_dir, "documents")).drop("spans")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = line_dedup.line_groups(table(spark, sf_dir, "documents"))
    return g.select(F.col("k").alias("doc_id"), "line_no", F.col("keep_k").alias("keep_doc_id"), "keep_line_no", "kept")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = decontaminate.decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return got.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op4_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit(table(spark, sf_dir, "documents"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(table(spark, sf_dir, "documents"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    warc.write_archive(table(spark, sf_dir, "pages"), path)
    return warc.read_archive(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def chat_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table's rows, and conversation -7, as messages folded from an event log.

    Every row is a message of its own, also where rows share a turn or repeat: its position is its number in the conversation by
    turn, role and text. Null turns come last, as in the SQL.
    """
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    extra = spark.range(2).select(F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.asc_nulls_last("turn"), F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))))
    events = rows.unionByName(extra).withColumn("turn", place).select("conv_id", F.col("turn").alias("seq"), "turn", F.lit("message").alias("kind"), "role", "text")
    return chat.fold(events)


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chat.render(chat_messages(spark, sf_dir)).withColumn("turns", chat.parse(F.col("formatted"))).withColumn("learned", chat.loss_text(F.col("formatted"), F.col("loss_spans")))
    flat = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(flat, 256).alias("turns_sha256"), F.length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, action string")
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), rules)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op10_lang_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = lang_id.held_out(F.col("doc_id"))
    dictionaries = lang_id.fit(docs.where(~held))
    got = lang_id.predict(docs.select("doc_id", "text"), dictionaries)
    return got.select("doc_id", lang_id.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "accepted")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_suffix_dedup, op2_line_dedup, op3_decontaminate, op4_pack, op5_simhash, op6_warc, op7_chat, op8_url_filter, op9_exact_dedup, op10_lang_id)
    return {f.__name__: f for f in own}


_B32 = " || ".join(
    "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, {0}, 5))::BIGINT >> {1}) & 31)::INT + 1, 1)".format(5 * i + 1, s) for i in range(8) for s in (15, 10, 5, 0)
)

_ESC = "replace(replace({0}, '\\', '\\\\'), '<|', '<\\|')"


def oracle_sql() -> dict[str, str]:
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    words = "regexp_extract_all({0}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')".format(lower)
    rules = ", ".join(f"('{h}', '{p}', '{a}')" for h, p, a in RULES)
    return {
        "op3_decontaminate": f"""
            WITH d AS (SELECT doc_id, {words} AS w FROM documents),
            b AS (SELECT item_id, {words} AS w FROM benchmark),
            win AS (SELECT DISTINCT item_id, w[i:i + least(len(w), 10) - 1] AS x FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
            sizes AS (SELECT DISTINCT len(x) AS n FROM win),
            places AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, sizes WHERE len(w) >= n),
            hits AS (SELECT doc_id, p, n, item_id FROM (SELECT doc_id, p, n, w[p:p + n - 1] AS x FROM places) JOIN win USING (x)),
            covered AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM (SELECT DISTINCT doc_id, p, n FROM hits)) GROUP BY 1),
            items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM hits) GROUP BY 1)
            SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
            FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)""",
        "op6_warc": f"""
            WITH p AS (SELECT page_id, coalesce(html, '') AS body, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS keep FROM pages),
            q AS (SELECT *, sha1(body) AS h FROM p)
            SELECT page_id, strlen(body)::BIGINT AS payload_bytes, {_B32} AS payload_digest, CASE WHEN page_id = keep THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> keep THEN keep END AS refers_to FROM q""",
        "op7_chat": f"""
            WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
              UNION ALL VALUES (-7, 0, 'user', '\\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\\### Assistant: </turn> ok')),
            e AS (SELECT *, {_ESC.format('text')} AS et, replace({_ESC.format('role')}, chr(10), '<\\/|') AS er FROM c)
            SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
              coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
              sum(length(er) + length(et) + {len(chat.START) + 1 + len(chat.END)})::BIGINT AS formatted_chars
            FROM e GROUP BY conv_id""",
        "op8_url_filter": f"""
            WITH r(rh, rp, action) AS (VALUES {rules}),
            u AS (SELECT page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
            m AS (SELECT page_id, arg_max(rh || rp, length(rh || rp) * 1000 + length(rh)) AS rule, arg_max(action, length(rh || rp) * 1000 + length(rh)) AS action FROM u JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY 1)
            SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM u LEFT JOIN m USING (page_id)""",
        "op9_exact_dedup": f"""
            WITH d AS (SELECT doc_id, {lower} AS t FROM documents), g AS (SELECT *, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size FROM d)
            SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM g""",
    }
