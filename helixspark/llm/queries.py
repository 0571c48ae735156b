"""The registered queries of this subpackage, each its operator with production parameters over the whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, classifier, exact_dedup, html_extract, minhash, packing, quality_rules, sharding, warc
from .common import scratch, table, text_of

SHARDS = 40


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    convs = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], convs.schema)
    return chat.digests(chat.format_conversations(convs.unionByName(more), tokenizer("byte_bpe_50k.json")))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), outputs=("n_tokens", "ids_sha256", "decoded_sha256"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    text = text_of("text")
    written = sharding.write_shards(sharding.shard_documents(docs, SHARDS, seed=20240229), scratch(spark, "shards"))
    return written.select(
        "doc_id",
        (F.octet_length(text) + sharding.OVERHEAD).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    return warc.read_archives(spark, path, ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = packing.pieces(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer("word_bpe_49k.json"))
    return packing.pack(cut).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = quality_rules.stored(quality_rules.ledger(table(spark, sf_dir, "documents").select("doc_id", "text")))
    columns = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "failed"]
    return ledger.select("doc_id", *columns, quality_rules.fails("base").alias("base_failed"), (~quality_rules.fails("v1")).alias("kept"))


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = quality_rules.stored(quality_rules.ledger(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return quality_rules.ablations(ledger, "v1")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"), keep="max")


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=2, least=0.8)


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = classifier.train(docs, table(spark, sf_dir, "labels"))
    return classifier.scored(docs, model).select("doc_id", classifier.held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat": op1_chat,
    "op2_bpe": op2_bpe,
    "op3_sharding": op3_sharding,
    "op4_warc": op4_warc,
    "op5_packing": op5_packing,
    "op6_quality_rules": op6_quality_rules,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_html": op8_html,
    "op9_minhash": op9_minhash,
    "op10_quality_classifier": op10_quality_classifier,
    "quality_ablations": quality_ablations,
}

ORACLE_SQL: dict[str, str] = {
    "op7_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256(t) AS text_sha256
        FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
        WINDOW same AS (PARTITION BY t)
    """,
    "op6_quality_rules": r"""
        WITH t AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS text FROM documents),
        w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws,
                     list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM t),
        g AS (SELECT r, i, list_slice(ws, i, i + 4) AS g FROM (SELECT r, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)),
        d AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g) WHERE n > 1),
        h AS (SELECT r, count(DISTINCT i + k) AS n FROM d, (SELECT unnest(range(0, 5)) AS k) GROUP BY r),
        m AS (SELECT doc_id, len(ws) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
                     length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
                     len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(h.n, 0) AS n_repeat_words,
                     len(list_filter(ws, lambda x: regexp_matches(x, '\p{Lu}') AND NOT regexp_matches(x, '\p{Ll}'))) AS n_upper_words
              FROM w LEFT JOIN h USING (r)),
        f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
                     CAST(CASE WHEN n_words < 10 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END
                     + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END + CASE WHEN 10 * n_dup_lines > 4 * n_lines THEN 8 ELSE 0 END
                     + CASE WHEN 2 * n_upper_words > n_words THEN 16 ELSE 0 END + CASE WHEN word_chars > 40 * n_words THEN 32 ELSE 0 END AS BIGINT) AS failed FROM m)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed, base_failed, failed = 0 AS kept FROM f
    """,
}

_RULES = "(VALUES " + ", ".join(f"('{name}', {bit})" for name, bit in quality_rules.BITS.items()) + ") AS rules(rule, bit)"
ORACLE_SQL["quality_ablations"] = f"""
    SELECT rule, count(*) FILTER (WHERE failed & bit <> 0) AS n_failed, count(*) FILTER (WHERE failed = bit) AS n_only,
           count(*) FILTER (WHERE failed IN (0, bit)) AS n_kept_without, count(*) FILTER (WHERE failed = 0) AS n_kept
    FROM ({ORACLE_SQL["op6_quality_rules"]}) AS ledger, {_RULES} GROUP BY rule
"""
