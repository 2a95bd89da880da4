"""Corpus pipeline: quality classifier, line dedup, near-dedup, substring dedup, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before kept. All but the
last return the columns of documents; where a stage changes texts, n_chars follows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm import line_dedup, minhash_dedup, packing, quality_classifier, substring_dedup
from tracewell.llm.common import stash, tokenizer_path


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars, where there is one, as the text now has it."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: documents that the classifier rejects go."""
    weights = quality_classifier.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_classifier.keep_good(docs, weights)


def without_template_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: lines of recurring templates go; the row stays."""
    return _counted(line_dedup.drop_recurring_lines(docs))


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: of each group of near copies (five-word shingles, likeness 0.8) one document stays."""
    return minhash_dedup.keep_one_each(docs)


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: passages of 20 words or more that stood earlier go; the row stays."""
    return _counted(substring_dedup.substring_dedup(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: sequences of 1024 tokens, one row per piece."""
    from public_tokenizers import PATTERN

    return packing.pack_documents(docs, tokenizer_path("byte_bpe_50k.json"), PATTERN, with_ids=True)


STAGES = [
    ("quality classifier", good_quality),
    ("line dedup", without_template_lines),
    ("MinHash near-dedup", one_of_near_copies),
    ("substring dedup", without_repeated_passages),
    ("packing", packed),
]

#: No SQL: the classifier, the near-dedup and the packing are beyond it; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stash(stage(spark, docs, sf_dir), f"stage{i}")
    return docs
