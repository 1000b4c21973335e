"""op2: classes of similar documents by five-word shingles, over all documents. SQL can't express the join."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.readers import spread
from . import jaccard


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return jaccard.join(docs).select("doc_id", "class_id", "n_links", "n_copies")


QUERIES = {"op2_ngram_jaccard_join": op2_ngram_jaccard_join}
SQL: dict[str, str] = {}
