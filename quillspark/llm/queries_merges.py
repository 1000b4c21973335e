"""op13: byte-level BPE over all documents by merges in rank order. SQL can't express it; tests hold it against the tiktoken library."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.readers import spread
from . import merges

RANKS = "byte_bpe_50k.tiktoken"


def rank_file(name: str = RANKS) -> tuple[str, str]:
    """Where a rank file is, and the pattern that goes with it."""
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN


def op13_merge_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return merges.round_trip(docs, *rank_file())


QUERIES = {"op13_merge_replay": op13_merge_replay}
SQL: dict[str, str] = {}
