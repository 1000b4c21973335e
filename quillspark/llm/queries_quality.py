"""op5: quality rules over all documents, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.readers import spread
from . import quality


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    out = quality.judge(docs.select("doc_id", "text"), quality.estimate(docs, measured=True))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents),
g AS (SELECT doc_id, i, concat(w[i], ' ', w[i+1], ' ', w[i+2]) AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 1))) AS i FROM d)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1),
p AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM r, (VALUES (0), (1), (2)) AS o(k) GROUP BY doc_id),
m AS (
  SELECT d.doc_id, t, w, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(len(ls) AS BIGINT) AS n_lines,
         CAST(coalesce(p.n, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN p ON p.doc_id = d.doc_id),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR word_chars < 2 * n_words OR word_chars > 16 * n_words
            OR 4 * n_symbols > n_words OR 5 * n_dup_lines > 3 * n_lines
            OR 10 * length(regexp_replace(t, '[^0-9]+', '', 'g')) > 3 * word_chars
            OR 2 * length(regexp_replace(t, '[^A-Za-z\x{80}-\x{10FFFF}]+', '', 'g')) < word_chars
            OR 10 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 7 * word_chars
            OR 5 * coalesce(list_sum(list_transform(list_filter(w, lambda x: length(x) >= 40), lambda x: length(x))), 0) > word_chars
            OR 10 * coalesce(list_sum(list_transform(regexp_extract_all(t, '[.]{4,}|-{4,}|_{4,}|={4,}|~{4,}|!{4,}|[?]{4,}'), lambda x: length(x))), 0) > word_chars
            OR 2 * len(regexp_extract_all(t, '(?:[.][.][.]|…)[\x20\x09]*(?:\n|\z)')) > n_lines
            OR 10 * len(regexp_extract_all(t, '(?:\A|\n)[\x20\x09]*[-*•–][\x20\x09]')) > 9 * n_lines) AS kept
FROM b
"""

QUERIES = {"op5_quality_rules": op5_quality_rules}
SQL = {"op5_quality_rules": OP5_SQL}
