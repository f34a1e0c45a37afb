"""A corpus pipeline of five stages; each one's result is written as Parquet and read again by the next.

``langid`` drops documents whose language isn't known well enough; ``neardup`` keeps one document of
each group of near duplicates (similarity 0.8 or more); ``substrings`` takes out words in passages that are found elsewhere;
``mixing`` takes documents, whole and up to three times, to bring the sources to their weights;
``bpe`` adds token ids.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from palimpsest.llm import bpe, langid, mixing, neardup, substrings
from palimpsest.llm.shared import stored


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.accepted(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The general rule for stages on word shingles, 0.8; op10's contract (0.85) is for its query only."""
    return neardup.dedup(docs, similarity=80)


def drop_repeated_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """n_chars follows the text where words went."""
    out = substrings.dedup_substrings(docs)
    n_chars = F.when(F.col(out.columns[-1]) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", n_chars).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


STAGES = [
    ("langid", identify_language),
    ("neardup", drop_near_duplicates),
    ("substrings", drop_repeated_substrings),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: Learned models, signatures and token merges aren't SQL; the tests hold each stage against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; between them the rows are in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs, f"stage-{name}")
    return docs
