"""A training corpus in five stages, each on what the one before kept.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame; all but the last keep the columns of documents. The
caller writes each result as Parquet and reads it again as the next one's docs; `run` does so in the folder
that the cluster shares.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillspark.llm import bpe, common, jaccard, lines, mixing, quality
from quillspark.llm.queries_tokens import tokenizer_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality.keep(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines of templates that recur across documents; the first document keeps its own. Documents
    that have no line left because of it go. n_chars follows the text."""
    kept = lines.keep(docs)
    if "n_chars" not in kept.columns:
        return kept
    from pyspark.sql import functions as F

    return kept.withColumn("n_chars", F.length("text").cast(kept.schema["n_chars"].dataType))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of documents with five-word shingles at least 0.8 similar."""
    return jaccard.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.taken_rows(docs, mixing.plan_mix(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, with how many there are and their round trip's digests."""
    return bpe.round_trip(docs, tokenizer_path(), ids="ids").drop("text")


STAGES = [("quality", quality_rules), ("line_dedup", line_dedup), ("ngram_jaccard", near_duplicates), ("mixing", mix_sources), ("bpe", encode)]

#: Near duplicates, seeded draws and token ids can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, common.written_alone(lambda: stage(spark, docs, sf_dir), name)  # noqa: B023
        if k:
            common.drop_written(before)
    return STAGES[-1][1](spark, docs, sf_dir)
