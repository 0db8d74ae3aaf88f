"""The corpus pipeline: documents in, tokenized training texts out.  Each stage is written and read again."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loanloom.llm import byte_bpe, minhash, mixing, paragraphs, quality
from loanloom.session import write_scratch

#: Shingles and similarity of near-duplicates among documents.
SHINGLE, PERCENT = 5, 80


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model, learnt from the table ``labels``, doesn't reject."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document of least id; documents without id or words stay."""
    return minhash.keep_first(docs, k=SHINGLE, percent=PERCENT)


def without_repeated_paragraphs(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their texts without paragraphs that an earlier one has; ``n_chars`` follows the text."""
    cut = paragraphs.remove_paragraphs(docs).drop("spans")
    return cut.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cut


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: some not at all, some as several equal rows."""
    return mixing.mixed(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id``, ``source``, ``ids`` and ``n_tokens`` of every row, with ``intact``: whether the ids decode to its text."""
    return byte_bpe.encoded(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality classifier", good_documents),
    ("near-duplicates", one_of_each_group),
    ("substring dedup", without_repeated_paragraphs),
    ("mixing sources", mixed_sources),
    ("byte-level BPE", token_ids),
]

#: SQL can't express the stages; tests/llm compares each with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = write_scratch(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
