"""op1 and op8: bytes and words that repeated windows cover, over all documents, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.readers import spread
from . import substrings, suffixes


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return suffixes.deduplicate(docs, text=False)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return substrings.deduplicate(docs, text=False)


OP1_SQL = """
WITH d AS (SELECT doc_id, hex(coalesce(text, '')) AS h FROM documents),
g AS (SELECT doc_id, i, md5(substring(h, 2 * i + 1, 400)) AS g FROM (SELECT doc_id, h, unnest(range(0, greatest(length(h) // 2 - 199, 0))) AS i FROM d)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY g) AS n FROM g) WHERE n > 1),
l AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM r),
k AS (SELECT doc_id, i, sum(CASE WHEN p IS NULL OR i > p + 200 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM l),
s AS (SELECT doc_id, min(i) AS a, max(i) + 200 AS b FROM k GROUP BY doc_id, k),
t AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS q FROM s),
o AS (SELECT t.doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS last, string_agg(substring(h, 2 * q + 1, 2 * (a - q)), '' ORDER BY a) AS kept FROM t JOIN d ON d.doc_id = t.doc_id GROUP BY t.doc_id)
SELECT d.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(CASE WHEN o.doc_id IS NULL THEN h ELSE concat(kept, substring(h, 2 * last + 1)) END)) AS kept_sha256
FROM d LEFT JOIN o ON o.doc_id = d.doc_id
"""

OP8_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 19], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 18, 1))) AS i FROM d)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS n FROM g) WHERE n > 1),
s AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM r),
c AS (SELECT DISTINCT doc_id, unnest(range(greatest(i, coalesce(p + 20, i)), i + 20)) AS i FROM s),
x AS (SELECT doc_id, w[i] AS w, i FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
o AS (SELECT x.doc_id, count(*) AS n_words, count(c.i) AS n_removed,
             coalesce(string_agg(CASE WHEN c.i IS NULL THEN x.w END, ' ' ORDER BY x.i), '') AS kept
      FROM x LEFT JOIN c ON c.doc_id = x.doc_id AND c.i = x.i GROUP BY x.doc_id)
SELECT d.doc_id, CAST(coalesce(n_words, 0) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN o ON o.doc_id = d.doc_id
"""

QUERIES = {"op1_suffix_array_dedup": op1_suffix_array_dedup, "op8_substring_dedup": op8_substring_dedup}
SQL = {"op1_suffix_array_dedup": OP1_SQL, "op8_substring_dedup": OP8_SQL}
