"""op12: all embeddings on the first eight components of their covariance. SQL has no eigenvectors; tests hold it against numpy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.readers import spread
from . import whitening


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spread(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
    return whitening.whiten(vectors)


QUERIES = {"op12_embedding_whitening": op12_embedding_whitening}
SQL: dict[str, str] = {}
