"""op11: three rounds of Lloyd over the integer embeddings, and the same in SQL over all vectors instead of distinct ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.readers import spread
from . import centroids


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spread(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
    return centroids.cluster(vectors).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


START = """v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
      WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
c0 AS (SELECT row_number() OVER (ORDER BY h) - 1 AS c, q FROM (SELECT q, sha256('1:' || vec_id) AS h FROM v ORDER BY h LIMIT 16))"""

#: Number {n} of the assignments, to the centroids before it.
ASSIGN = """a{n} AS MATERIALIZED (SELECT vec_id, q, c, d FROM (
  SELECT v.vec_id, v.q, c.c, CAST(list_sum(list_transform(list_zip(v.q, c.q), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d
  FROM v CROSS JOIN c{n} AS c) QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, c) = 1)"""

#: The centroids after round {n}; the quotient is rounded down, below zero too.
MOVE = """s{n} AS (SELECT c, i, sum(q[i]) AS s, count(*) AS n FROM (SELECT c, q, unnest(range(1, 65)) AS i FROM a{p}) GROUP BY c, i),
m{n} AS (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS q FROM s{n} GROUP BY c),
c{n} AS MATERIALIZED (SELECT c{p}.c, coalesce(m{n}.q, c{p}.q) AS q FROM c{p} LEFT JOIN m{n} ON m{n}.c = c{p}.c)"""

OP11_SQL = (
    "WITH " + ",\n".join([START, ASSIGN.format(n=0), *(x.format(n=n, p=n - 1) for n in (1, 2, 3) for x in (MOVE, ASSIGN))])
    + """
SELECT a3.vec_id, CAST(a3.c AS INTEGER) AS cluster, a3.d AS distance, CAST(sum(a3.d) OVER (PARTITION BY a3.c) AS BIGINT) AS cluster_inertia,
       CAST(sum(a3.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c3.q, ',')) AS centroid_sha256
FROM a3 JOIN c3 ON c3.c = a3.c"""
)

QUERIES = {"op11_centroid_clustering": op11_centroid_clustering}
SQL = {"op11_centroid_clustering": OP11_SQL}
