"""op4: how often the mix takes each document. Draws are seeded, so SQL can't express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.readers import spread
from . import mixing
from .common import written


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source"))
    sizes = written(mixing.sized(docs).select("doc_id", "source", "size", "_key"), "sizes")
    return mixing.dealt(sizes, mixing.plan_of(sizes)).select("doc_id", "size", "source_size", "target", "taken", "shards")


QUERIES = {"op4_mixing": op4_mixing}
SQL: dict[str, str] = {}
