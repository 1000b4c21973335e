"""op7: byte-level BPE over all documents. SQL can't express it; tests hold it against the tokenizers library."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.readers import spread
from . import bpe

TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return bpe.round_trip(docs.select("doc_id", "text"), tokenizer_path()).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


QUERIES = {"op7_bpe": op7_bpe}
SQL: dict[str, str] = {}
