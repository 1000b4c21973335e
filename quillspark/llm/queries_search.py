"""op3: the 20 nearest vectors by integer inner product, for every 20th vector."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.readers import spread
from . import topk


def op3_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spread(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
    return topk.search(topk.build_index(vectors), query="vec_id % 20 = 0", k=20)


OP3_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
           FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id AS vec_id,
             CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM v AS a JOIN v AS b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM s) WHERE r <= 20
"""

QUERIES = {"op3_topk_search": op3_topk_search}
SQL = {"op3_topk_search": OP3_SQL}
