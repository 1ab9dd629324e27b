"""The operators on the driver's tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import bpe, conversation_sql, decontaminate, exact_dedup, line_dedup, packing, pii, prefix_trie, quality, repair, simhash, tokens, toxicity, warc
from cairn.llm.common import new_path

#: Pseudonyms depend on it; pass a secret of your own in production.
KEY = "cairn-demo-key"


def word_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_classes(table(spark, sf_dir, "documents"))


def op3_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "token-planes")
    tokens.write_ids(table(spark, sf_dir, "documents"), path, word_bpe(), end_id=2)
    return tokens.read_ids(spark, path)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_decisions(table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    warc.write_archive(table(spark, sf_dir, "pages"), path)
    return warc.read_index(spark, path)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymised(table(spark, sf_dir, "documents"), KEY)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxic_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), word_bpe(), capacity=4096, end_id=1)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = F.col("conv_id")
    nodes = prefix_trie.prefix_trie(
        table(spark, sf_dir, "conversations"), lambda rows: prefix_trie.spliced(rows, own - own % 100, F.pmod(F.crc32(own.cast("string")), F.lit(6)), 5)
    )
    return nodes.withColumnRenamed("saved", "saved_tokens")


def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), byte_bpe())


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair_report(table(spark, sf_dir, "conversations"), damage=True)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_exact_dedup, op2_simhash, op3_token_planes, op4_line_dedup, op5_warc,
        op6_decontamination, op7_pseudonyms, op8_toxicity, op9_packing, op10_quality,
        op11_prefix_trie, op12_bpe, op13_repair,
    )
}

SQL: dict[str, str] = {
    "op11_prefix_trie": conversation_sql.OP11,
    "op13_repair": conversation_sql.OP13,
    "op1_exact_dedup": r"""
        WITH t AS (
            SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
        ), g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM t JOIN g USING (norm)
    """,
    "op5_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        d AS (
            SELECT html, max(page_id) AS response_id, octet_length(encode(html)) AS payload_bytes, sha1(html) AS hex FROM p GROUP BY html
        ),
        b AS (
            SELECT *, list_aggregate(list_transform(range(0, 40), lambda i:
                bin(CAST(strpos('0123456789abcdef', substr(hex, i + 1, 1)) - 1 + 16 AS BIGINT))[2:5]), 'string_agg', '') AS bits FROM d
        ),
        e AS (
            SELECT *, list_aggregate(list_transform(range(0, 32), lambda i:
                substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(
                    16 * CAST(bits[5 * i + 1] AS INT) + 8 * CAST(bits[5 * i + 2] AS INT) + 4 * CAST(bits[5 * i + 3] AS INT)
                    + 2 * CAST(bits[5 * i + 4] AS INT) + CAST(bits[5 * i + 5] AS INT) AS BIGINT), 1)), 'string_agg', '') AS payload_digest FROM b
        )
        SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
            CASE WHEN page_id = response_id THEN 'response' ELSE 'revisit' END AS record_type,
            CASE WHEN page_id = response_id THEN NULL ELSE response_id END AS refers_to
        FROM p JOIN e USING (html)
    """,
}
