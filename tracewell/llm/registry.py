"""The queries of this subpackage, each over the whole of its table, and their SQL where it has any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import byte_bpe, chat_format, html_text, line_dedup, minhash_dedup, order_minhash, packing, quality_classifier, quality_rules, substring_dedup
from .common import documents, tokenizer_path


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(documents(spark, sf_dir))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import PATTERN

    return byte_bpe.encode_documents(documents(spark, sf_dir), tokenizer_path("byte_bpe_multi_50k.tiktoken"), PATTERN)


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_classifier.score(docs, quality_classifier.train(docs, labels))


def op4_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(documents(spark, sf_dir))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(documents(spark, sf_dir), digest=True)


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.drop_recurring_lines(documents(spark, sf_dir).select("doc_id", "text"), counts=True)


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.format_chats(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op9_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.neighbour_fingerprints(documents(spark, sf_dir))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import PATTERN

    return packing.pack_documents(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"), PATTERN)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_quality_rules, op2_byte_bpe, op3_quality_classifier, op4_minhash_dedup, op5_substring_dedup, op6_html_text, op7_line_dedup, op8_chat_format, op9_order_minhash, op10_packing, pipeline]
    return {f.__name__: f for f in found}


CHAT_SQL = """
WITH ordered AS (
  SELECT conv_id, role, text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS rn,
         count(*) OVER (PARTITION BY conv_id) AS n,
         coalesce(length(role) || ':' || role, '-') || coalesce(length(text) || ':' || text, '-') AS field,
         '<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || chr(10) AS part
  FROM conversations
), prefixes AS (
  SELECT conv_id, rn, n,
         string_agg(field, '|') OVER (PARTITION BY conv_id ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS prefix
  FROM ordered
), whole AS (
  SELECT prefix, min(conv_id) AS conv_id, max(n) AS n_turns, count(*) AS n_copies FROM prefixes WHERE rn = n GROUP BY prefix
), chats AS (
  SELECT conv_id, string_agg(part, '' ORDER BY rn) AS chat FROM ordered GROUP BY conv_id
)
SELECT w.conv_id, w.n_turns, w.n_copies, c.chat
FROM whole w JOIN chats c ON w.conv_id IS NOT DISTINCT FROM c.conv_id
WHERE w.prefix NOT IN (SELECT prefix FROM prefixes WHERE rn < n)
"""


def oracle_sql() -> dict[str, str]:
    import corpus_pipeline

    sql = {"op8_chat_format": CHAT_SQL}
    return sql | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
