"""op6: line deduplication over all documents, and the same in SQL over strings instead of hashes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.readers import spread
from . import lines


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    out = lines.deduplicate(docs.select("doc_id", "text"), long_docs=lines.LONG_DOCS)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


#: A document counts once for a template, a token of a leaf and a generalised template, however many of its lines have it.
OP6_SQL = r"""
WITH raw AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, no, ls[no] AS line FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS no FROM raw)),
k AS (SELECT doc_id, no, line, list_transform(regexp_extract_all(line, '[^\x20\x09-\x0D]+'),
        lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END) AS w FROM l),
m AS (SELECT *, array_to_string(w, ' ') AS m, concat(len(w), ' ', array_to_string(w[1:3], ' ')) AS leaf FROM k WHERE len(w) > 0),
t AS (SELECT leaf, m, any_value(w) AS w, len(list_filter(any_value(w), lambda x: x <> '<*>')) >= 8 AS long, count(DISTINCT doc_id) AS docs, min(doc_id) AS first FROM m GROUP BY leaf, m),
v AS (SELECT leaf FROM t WHERE docs < 5 GROUP BY leaf HAVING sum(docs) >= 5),
x AS (SELECT leaf, m, docs, first, w, unnest(range(1, len(w) + 1)) AS pos FROM t WHERE leaf IN (SELECT leaf FROM v)),
y AS (SELECT leaf, m, docs, first, pos, w[pos] AS token FROM x),
o AS (SELECT DISTINCT m.leaf, m.m, m.doc_id FROM m JOIN t ON t.leaf = m.leaf AND t.m = m.m WHERE t.docs < 5 AND m.leaf IN (SELECT leaf FROM v)),
s AS (SELECT leaf, pos, token FROM y WHERE docs >= 5 AND token <> '<*>'
      UNION SELECT y.leaf, pos, token FROM y JOIN o ON o.leaf = y.leaf AND o.m = y.m WHERE docs < 5 AND token <> '<*>' GROUP BY y.leaf, pos, token HAVING count(DISTINCT doc_id) >= 5),
g AS (SELECT y.leaf, y.m, y.first, string_agg(CASE WHEN s.token IS NULL THEN '<*>' ELSE y.token END, ' ' ORDER BY y.pos) AS g,
             count(*) AS n, count(*) FILTER (WHERE s.token IS NOT NULL OR y.token = '<*>') AS same
      FROM y LEFT JOIN s ON s.leaf = y.leaf AND s.pos = y.pos AND s.token = y.token WHERE y.docs < 5
      GROUP BY y.leaf, y.m, y.first),
h AS (SELECT g.leaf, g.g, min(g.first) AS first FROM g JOIN o ON o.leaf = g.leaf AND o.m = g.m WHERE 5 * same >= 4 * n GROUP BY g.leaf, g.g HAVING count(DISTINCT doc_id) >= 5),
r AS (SELECT m, min(first) AS first FROM (
      SELECT m, first FROM t WHERE docs >= 5 OR (long AND docs >= {long_docs})
      UNION ALL SELECT g.m, h.first FROM g JOIN h ON h.leaf = g.leaf AND h.g = g.g WHERE 5 * g.same >= 4 * g.n) GROUP BY m),
d AS (SELECT m.doc_id, m.no FROM m JOIN r ON r.m = m.m WHERE m.doc_id <> r.first),
z AS (SELECT l.doc_id, count(*) FILTER (WHERE regexp_matches(l.line, '[^\x20\x09-\x0D]')) AS n_lines, count(d.no) AS n_dropped,
             coalesce(string_agg(CASE WHEN d.no IS NULL THEN l.line END, chr(10) ORDER BY l.no), '') AS kept
      FROM l LEFT JOIN d ON d.doc_id = l.doc_id AND d.no = l.no GROUP BY l.doc_id)
SELECT documents.doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_dropped, 0) AS BIGINT) AS n_dropped,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM documents LEFT JOIN z ON z.doc_id = documents.doc_id
"""

QUERIES = {"op6_line_dedup": op6_line_dedup}
SQL = {"op6_line_dedup": OP6_SQL.replace("{long_docs}", str(lines.LONG_DOCS))}
