"""The queries in SQL, written apart from the DataFrame code: windows and joins instead of arrays."""

from __future__ import annotations

from ..functions.lexicons import ABBREVIATIONS, BRIDGES, FUNCTION_WORDS, HEDGES, LIMITERS, VOCABULARY
from ..operators import resample
from ..operators.combine import COMBINER_DIRECTION, MODEL
from ..operators.features import LOW, REGISTRY
from .queries import GENRES, REPS, TOPICS
from .seasoned import SEASONED

WS = r"\s\x0b\x1c-\x1f\x85\p{Z}"
WORD = r"\p{L}\p{N}_"


def q(text: str) -> str:
    """A SQL literal."""
    return "'" + text.replace("'", "''") + "'"


def _re(text: str) -> str:
    out = text
    for c in r".+*?()[]{}|^$":
        out = out.replace(c, "\\" + c)
    return out


def _any(terms: list[str]) -> str:
    return "|".join(f"[{WS}]+".join(_re(p) for p in t.split(" ")) for t in sorted(terms, key=lambda t: (-len(t), t)))


TOKENS = r"list_transform(regexp_extract_all(text, '[A-Za-z]+(?:''[A-Za-z]+)?'), lambda x: lower(x))"
NOT_JUST = rf"(?i)(?:^|[^{WORD}])not[{WS}]+(?:{'|'.join(LIMITERS)})[^{WORD}.!?](?:[^.!?]{{0,78}}[^{WORD}.!?])?but(?:$|[^{WORD}])"
TRIAD = rf"(?i)(?:^|[^{WORD}])[{WORD}]+,[{WS}]+[{WORD}]+,[{WS}]+and[{WS}]+[{WORD}]+"
HEDGE = rf"(?i)(?:^|[^{WORD}])it[{WS}]+is[{WS}]+(?:{_any(HEDGES).replace('well-known', f'well[-{WS}]known')})(?:$|[^{WORD}])"
BRIDGE = rf"(?i)(?:^|[^{WORD}])(?:{_any(BRIDGES)})(?:$|[^{WORD}])"
# other characters are doubled, so that neighbouring hits don't share one
VOCAB = rf"(?:^|[^{WORD}])({'|'.join(''.join(c if c.isalnum() else _re(c) * 2 for c in t) for t in sorted(VOCABULARY, key=lambda t: (-len(t), t)))})(?:$|[^{WORD}])"
CLOSE = r"""["”’'')\]]"""
VETO = rf"(?:^|[^\p{{L}}\p{{N}}.’''])[.’'']*(?:(?i:{'|'.join(_re(a) for a in ABBREVIATIONS)})|\p{{L}})[.’'']*[.!?]+{CLOSE}*$"


def parsed(source: str) -> str:
    """CTEs ending in `f`: a row a document with counts, cv and MATTR. `source` selects doc_id, lang, source, text."""
    count = lambda p: f"len(regexp_extract_all(text, {q(p)}))"
    return rf"""
src AS ({source}),
b AS (SELECT doc_id, lang, source, text, len(regexp_extract_all(text, '[^{WS}]+')) AS wc, {TOKENS} AS tokens,
   len(regexp_extract_all(text, '—')) AS n_em, len(regexp_extract_all(text, '[“”‘’]')) AS n_smart,
   list_transform(regexp_extract_all(regexp_replace(lower(text), '([^{WORD}])', '\1\1', 'g'), {q(VOCAB)}, 1), lambda x: regexp_replace(x, '([^{WORD}])[^{WORD}]', '\1', 'g')) AS vocab, {count(NOT_JUST)} AS n_nj, {count(TRIAD)} AS n_tri,
   {count(HEDGE)} AS n_hedge, {count(BRIDGE)} AS n_br, len(regexp_extract_all(text, ',')) AS n_comma FROM src),
sp AS (SELECT doc_id, string_split(regexp_replace(text, '([.!?]+{CLOSE}*)', concat('\1', chr(1)), 'g'), chr(1)) AS segs FROM src),
sg AS (SELECT doc_id, i, segs[i] AS seg FROM (SELECT doc_id, segs, unnest(range(1, len(segs) + 1)) AS i FROM sp)),
ctx AS (SELECT doc_id, i, seg, lead(seg, 1) OVER w AS l1, lead(seg, 2) OVER w AS l2,
   concat(coalesce(lag(seg, 3) OVER w, ''), coalesce(lag(seg, 2) OVER w, ''), coalesce(lag(seg, 1) OVER w, ''), seg) AS back
   FROM sg WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
cut AS (SELECT doc_id, i, seg, CASE WHEN l1 IS NULL THEN 0
   WHEN (l1 = '' OR regexp_matches(l1, '^\p{{Lu}}') OR (regexp_matches(l1, '^[{WS}]') AND NOT regexp_matches(concat(l1, coalesce(l2, '')), '^[{WS}]+\p{{Ll}}')))
        AND NOT regexp_matches(back, '{VETO}') THEN 1 ELSE 0 END AS c FROM ctx),
sid AS (SELECT doc_id, i, seg, coalesce(sum(c) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sid FROM cut),
sl AS (SELECT doc_id, sid, len(regexp_extract_all(string_agg(seg, '' ORDER BY i), '[^{WS}]+')) AS n FROM sid GROUP BY doc_id, sid),
ss AS (SELECT doc_id, count(*) AS sc, sum(n) AS s1, sum(n * n) AS s2 FROM sl WHERE n > 0 GROUP BY doc_id),
tk AS (SELECT doc_id, i, tokens[i + 1] AS t, n FROM (SELECT doc_id, tokens, len(tokens) AS n, unnest(range(0, len(tokens))) AS i FROM b)),
tp AS (SELECT doc_id, i, n, lag(i) OVER (PARTITION BY doc_id, t ORDER BY i) AS p FROM tk),
tt AS (SELECT doc_id, CASE WHEN max(n) <= 40 THEN CAST(count(*) FILTER (WHERE p IS NULL) AS DOUBLE) / max(n)
   ELSE sum(greatest(0, least(i, n - 40) - greatest(coalesce(p + 1, 0), i - 39, 0) + 1)) / (CAST(40 AS DOUBLE) * (max(n) - 39)) END AS ttr FROM tp GROUP BY doc_id),
fw AS (SELECT doc_id, sum(CASE WHEN t IN ({', '.join(q(w) for w in FUNCTION_WORDS)}) THEN 1 ELSE 0 END) AS n_fw, sum(length(t)) AS n_chars FROM tk GROUP BY doc_id),
r AS (SELECT b.*, CASE WHEN wc > 0 THEN CAST(1000 AS DOUBLE) / wc ELSE 0 END AS per, coalesce(sc, 0) AS sc, coalesce(s1, 0) AS s1,
   CASE WHEN sc >= 2 THEN sqrt(CAST(sc * s2 - s1 * s1 AS DOUBLE)) / s1 END AS cv, coalesce(ttr, 1) AS ttr,
   coalesce(CAST(n_fw AS DOUBLE) / nullif(len(tokens), 0), 0) AS fwr, coalesce(CAST(fw.n_chars AS DOUBLE) / nullif(len(tokens), 0), 0) AS mwl
   FROM b LEFT JOIN ss ON ss.doc_id = b.doc_id LEFT JOIN tt ON tt.doc_id = b.doc_id LEFT JOIN fw ON fw.doc_id = b.doc_id),
f AS (SELECT doc_id, lang, source, text, wc, sc, s1, cv, len(tokens) AS n_tokens, per, n_smart, n_comma, n_nj, n_hedge, n_em, n_tri, n_br, vocab,
   len(vocab) AS n_vocab, sc < 4 AS low,
   n_em * per AS em_per_1k, n_smart * per AS smart_quotes_per_1k, len(vocab) * per AS vocab_per_1k, CAST(len(list_distinct(vocab)) AS DOUBLE) AS vocab_distinct,
   n_nj * per AS not_just_per_1k, n_tri * per AS tricolon_per_1k, n_hedge * per AS hedge_per_1k, n_br * per AS bridge_per_1k,
   cv AS sentence_cv, ttr AS type_token_ratio, fwr AS function_word_ratio, mwl AS mean_word_length,
   coalesce(CAST(s1 AS DOUBLE) / nullif(sc, 0), 0) AS mean_sentence_length, n_comma * per AS comma_per_1k FROM r)"""


RAW = "SELECT doc_id, lang, source, coalesce(text, '') AS text FROM documents"
NAMES = [f.name for f in REGISTRY]
VERDICT = "CASE WHEN {0} < 1.5 THEN 'human' WHEN {0} < 3 THEN 'mostly human, light tells' WHEN {0} < 5 THEN 'AI-leaning' ELSE 'reads as AI' END"
POINTS = {
    "em_per_1k": "CASE WHEN em_per_1k > 4 THEN least(em_per_1k - 4, 6) * CASE WHEN cv >= 0.7 THEN CAST(0.25 AS DOUBLE) ELSE 1 END END",
    "smart_quotes_per_1k": "CASE WHEN n_smart > 0 THEN least(n_smart * CAST(0.2 AS DOUBLE), 2) END",
    "vocab_per_1k": "CASE WHEN n_vocab > 0 AND vocab_distinct >= 2 THEN least(n_vocab * CAST(1.1 AS DOUBLE), 8) END",
    "not_just_per_1k": "CASE WHEN n_nj > 0 THEN least(CAST(n_nj AS DOUBLE), 3) END",
    "tricolon_per_1k": "CASE WHEN tricolon_per_1k > 3.5 AND wc >= 80 THEN least((tricolon_per_1k - 3.5) * CAST(0.4 AS DOUBLE), 3) END",
    "hedge_per_1k": "CASE WHEN n_hedge > 0 THEN least(n_hedge * CAST(0.8 AS DOUBLE), CASE WHEN wc < 300 THEN CAST(1.6 AS DOUBLE) ELSE CAST(2.4 AS DOUBLE) END) END",
    "bridge_per_1k": "CASE WHEN bridge_per_1k > 2 THEN least((bridge_per_1k - 2) * CAST(0.4 AS DOUBLE), 1.5) END",
    "sentence_cv": "CASE WHEN cv < 0.35 THEN CAST(4 AS DOUBLE) WHEN cv < 0.45 THEN 2.5 WHEN cv < 0.55 THEN 1.5 WHEN cv < 0.65 AND wc >= 80 THEN 0.75 END",
}
VALUES = {"em_per_1k": "em_per_1k", "smart_quotes_per_1k": "n_smart", "vocab_per_1k": "n_vocab", "not_just_per_1k": "n_nj", "tricolon_per_1k": "tricolon_per_1k", "hedge_per_1k": "n_hedge", "bridge_per_1k": "bridge_per_1k", "sentence_cv": "cv"}
SCORED = parsed(SEASONED) + ",\np AS (SELECT *, " + ", ".join(f"CASE WHEN wc > 0 THEN {e} END AS p_{n}" for n, e in POINTS.items()) + " FROM f),\nz AS (SELECT *, " + " + ".join(f"coalesce(p_{n}, CAST(0 AS DOUBLE))" for n in POINTS) + " AS score_raw FROM p)"
SIGNALS = " UNION ALL ".join(f"SELECT doc_id, {i} AS ord, '{n}' AS name, CAST({VALUES[n]} AS DOUBLE) AS value, p_{n} AS points FROM z WHERE p_{n} IS NOT NULL" for i, n in enumerate(POINTS))
LABELLED = SCORED + ",\ny AS (SELECT z.*, 1 - quality AS y, CAST(floor(score_raw * 1000000 + 0.5) AS BIGINT) AS s FROM z JOIN labels ON labels.doc_id = z.doc_id)"


def auc_sql(rows: str, by: str = "") -> str:
    """Pairs counted one by one: (by, n_pos, n_neg, auc) from rows (by, s, y)."""
    keys = [k for k in by.split(", ") if k]
    match = " AND ".join(f"a.{k} = h.{k}" for k in keys) or "TRUE"
    same = " AND ".join(f"t.{k} = w.{k}" for k in keys) or "TRUE"
    group = f"GROUP BY {by}" if by else ""
    lead = f"{by}, " if by else ""
    pair = f"GROUP BY {', '.join('a.' + k for k in keys)}" if by else ""
    first = "".join(f"a.{k} AS {k}, " for k in keys)
    return f"""rows_ AS ({rows}),
hist AS (SELECT {lead}s, y, count(*) AS n FROM rows_ GROUP BY {lead}s, y),
won AS (SELECT {first}CAST(sum(a.n * h.n * CASE WHEN a.s > h.s THEN 2 WHEN a.s = h.s THEN 1 ELSE 0 END) AS DOUBLE) AS w FROM hist a JOIN hist h ON a.y = 1 AND h.y = 0 AND {match} {pair}),
tot AS (SELECT {lead}count(*) FILTER (WHERE y = 1) AS n_pos, count(*) FILTER (WHERE y = 0) AS n_neg FROM rows_ {group}),
auc AS (SELECT {''.join(f't.{k} AS {k}, ' for k in keys)}t.n_pos, t.n_neg, w.w / nullif(CAST(2 AS DOUBLE) * t.n_pos * t.n_neg, 0) AS auc FROM tot t LEFT JOIN won w ON {same})"""


def zs(have: list[str]) -> dict[str, str]:
    """Each feature's clipped z; the model's stand-in for columns that aren't there."""
    return {n: f"greatest(-6, least(6, (coalesce({n if n in have else 'NULL'}, {MODEL['impute'][n]!r}) - {m!r}) / {s!r}))" for n, m, s in zip(MODEL["features"], MODEL["mean"], MODEL["std"])}


def logit(z: dict[str, str]) -> str:
    return f"CAST({MODEL['intercept']!r} AS DOUBLE) + " + " + ".join(f"CAST({c!r} AS DOUBLE) * CAST({z[n]} AS DOUBLE)" for n, c in zip(MODEL["features"], MODEL["coef"]))


Z = zs(NAMES)
LOGIT = logit(Z)
P_VERDICT = "CASE WHEN wc < 20 THEN 'uncertain (text too short to score reliably)' WHEN p < 0.2 THEN 'human' WHEN p < 0.5 THEN 'mostly human, light tells' WHEN p < 0.8 THEN 'AI-leaning' ELSE 'reads as AI' END"
SIGMOID = "CASE WHEN x < -60 THEN CAST(0 AS DOUBLE) WHEN x > 60 THEN CAST(1 AS DOUBLE) ELSE 1 / (1 + exp(-x)) END"

NGRAMS = rf"""
bt AS (SELECT item_id % 2 AS m, {TOKENS} AS w FROM benchmark),
b1 AS (SELECT m, unnest(w) AS word FROM bt),
b2 AS (SELECT m, w[i] AS prev, w[i + 1] AS word FROM (SELECT m, w, unnest(range(1, greatest(len(w), 1))) AS i FROM bt)),
u AS (SELECT word, count(*) FILTER (WHERE m = 0) AS o, count(*) FILTER (WHERE m = 1) AS p FROM b1 GROUP BY word),
g AS (SELECT prev, word, count(*) FILTER (WHERE m = 0) AS o, count(*) FILTER (WHERE m = 1) AS p FROM b2 GROUP BY prev, word)"""
LIKELIHOOD = NGRAMS + rf""",
n AS (SELECT CAST(sum(o) AS DOUBLE) + count(*) + 1 AS no, CAST(sum(p) AS DOUBLE) + count(*) + 1 AS np FROM u),
uu AS (SELECT word, (o + 1) / no AS uo, (p + 1) / np AS up FROM u, n),
base AS (SELECT (SELECT sum(up * -ln(uo)) FROM uu) + (1 / np) * -ln(1 / no) AS base, 1 / no AS xo FROM n),
c AS (SELECT prev, sum(o) AS co, sum(p) AS cp FROM g GROUP BY prev),
lp AS (SELECT g.prev, g.word, g.p, c.co, c.cp, uu.up,
   -ln(CASE WHEN co > 0 THEN CAST(0.5 AS DOUBLE) * g.o / co + CAST(0.5 AS DOUBLE) * uo ELSE uo END) AS lo,
   -ln(CASE WHEN co > 0 THEN CAST(0.5 AS DOUBLE) * uo ELSE uo END) AS l0 FROM g JOIN c ON c.prev = g.prev JOIN uu ON uu.word = g.word),
cx AS (SELECT prev, co, sum(CASE WHEN cp > 0 THEN CAST(0.5 AS DOUBLE) * p / cp ELSE 0 END * lo)
     + CASE WHEN cp > 0 THEN CAST(0.5 AS DOUBLE) ELSE 1 END * (max(base) + CASE WHEN co > 0 THEN -ln(CAST(0.5 AS DOUBLE)) ELSE 0 END + sum(up * (lo - l0))) AS xent
   FROM lp, base GROUP BY prev, co, cp),
src AS ({SEASONED}),
dt AS (SELECT doc_id, ({TOKENS}) AS w FROM src),
d2 AS (SELECT doc_id, w[i] AS prev, w[i + 1] AS word FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w), 1))) AS i FROM dt)),
x AS (SELECT d2.doc_id, coalesce(lp.lo, -ln(CASE WHEN coalesce(cx.co, 0) > 0 THEN CAST(0.5 AS DOUBLE) ELSE 1 END * coalesce(uu.uo, xo))) AS nll, coalesce(cx.xent, base) AS xe
   FROM d2 LEFT JOIN lp ON lp.prev = d2.prev AND lp.word = d2.word LEFT JOIN cx ON cx.prev = d2.prev LEFT JOIN uu ON uu.word = d2.word CROSS JOIN base),
ll AS (SELECT doc_id, exp(least(avg(nll), 50)) AS ll_perplexity, -avg(nll) AS ll_mean_logprob, stddev_pop(nll) AS ll_surprisal_stdev, CASE WHEN avg(xe) > 0.000001 THEN avg(nll) / avg(xe) END AS ll_binoculars FROM x GROUP BY doc_id)"""

TALK = "SELECT conv_id * 1000 + turn AS doc_id, role AS lang, CAST(conv_id AS VARCHAR) AS source, coalesce(text, '') AS text FROM conversations WHERE role <> 'system'"
CACHE = "cache AS (SELECT doc_id, CAST(doc_id % 7 + CASE WHEN doc_id % 13 = 0 THEN 100 ELSE 0 END AS DOUBLE) AS ll_mean_logprob, CASE WHEN doc_id % 13 = 0 THEN 2 ELSE 1 END AS seq FROM documents WHERE doc_id % 10 <> 0)"
RATIOS = """coalesce(CAST(tp + tn AS DOUBLE) / nullif(tp + fp + fn + tn, 0), 0) AS accuracy, coalesce(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 0) AS precision,
 coalesce(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 0) AS recall, coalesce(CAST(2 * tp AS DOUBLE) / nullif(2 * tp + fp + fn, 0), 0) AS f1"""


def half_even(x: str, digits: int) -> str:
    """Python's rounding: of the exact value, ties to the even digit. Printing does the same."""
    return f"CAST(format('{{:.{digits}f}}', CAST({x} AS DOUBLE)) AS DOUBLE)"


def rounded(*names: str, digits: int = 6) -> str:
    return ", ".join(f"round({n}, {digits}) AS {n}" for n in names)


def _auc_of(cte: str, rows: str, by: str, select: str) -> str:
    return f"WITH {cte},\n{auc_sql(rows, by)}\n{select}"


def build() -> dict[str, str]:
    """SQL by query name."""
    seas, raw = parsed(SEASONED), parsed(RAW)
    human = "'human'"
    out = {
        "q_text_stats": f"WITH {raw} SELECT doc_id, CAST(wc AS INTEGER) AS word_count, CAST(n_tokens AS INTEGER) AS n_tokens, round(per, 6) AS per_1k, CAST(n_comma AS INTEGER) AS n_commas FROM f",
        "q_sentence_stats": f"WITH {raw} SELECT doc_id, CAST(sc AS INTEGER) AS sentence_count, CAST(s1 AS BIGINT) AS sum_length, round(cv, 6) AS cv, low AS low_confidence FROM f",
        "q_surface_rates": f"WITH {seas} SELECT doc_id, {rounded('em_per_1k', 'smart_quotes_per_1k', 'comma_per_1k')} FROM f",
        "q_phrase_rates": f"WITH {seas} SELECT doc_id, {rounded('not_just_per_1k', 'tricolon_per_1k', 'hedge_per_1k', 'bridge_per_1k')} FROM f",
        "q_vocab_hits": f"WITH {seas} SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, unnest(vocab) AS term FROM f) GROUP BY doc_id, term",
        "q_vocab_rates": f"WITH {seas} SELECT doc_id, round(vocab_per_1k, 6) AS vocab_per_1k, vocab_distinct FROM f",
        "q_lexical": f"WITH {seas} SELECT doc_id, {rounded('type_token_ratio', 'function_word_ratio', 'mean_word_length', 'mean_sentence_length')} FROM f",
        "q_features_wide": f"WITH {seas} SELECT doc_id, {rounded(*NAMES)} FROM f",
        "q_features_long": f"WITH {seas} " + " UNION ALL ".join(f"SELECT doc_id, {i} AS feature_no, '{x.name}' AS feature, '{x.direction}' AS direction, round({x.name}, 6) AS value FROM f" for i, x in enumerate(REGISTRY)),
        "q_signals": f"WITH {SCORED}, g AS ({SIGNALS}) SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY ord) - 1 AS INTEGER) AS pos, name, {half_even('value', 3)} AS value, CASE WHEN points > 0 THEN 'ai' ELSE 'neutral' END AS leaning, {half_even('points', 2)} AS points FROM g",
        "q_heuristic_score": f"WITH {SCORED}, g AS ({SIGNALS}), k AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id) SELECT z.doc_id, round(score_raw, 6) AS score_raw, {VERDICT.format('score_raw')} AS verdict, CAST(wc AS INTEGER) AS word_count, low AS low_confidence, CAST(coalesce(n, 0) AS INTEGER) AS n_signals, CAST(coalesce(n, 0) + CASE WHEN wc = 0 OR low THEN 1 ELSE 0 END AS INTEGER) AS n_notes FROM z LEFT JOIN k ON k.doc_id = z.doc_id",
        "q_layers": f"WITH {SCORED} SELECT doc_id, 'heuristic' AS layer, CAST(format('{{:.1f}}', score_raw) AS DOUBLE) AS value FROM z WHERE wc > 0",
        "q_verdict_counts": f"WITH {SCORED} SELECT lang, {VERDICT.format('score_raw')} AS verdict, count(*) AS n, count(*) FILTER (WHERE low) AS n_low FROM z GROUP BY 1, 2",
        "q_top_issues": f"WITH {SCORED}, g AS ({SIGNALS}), o AS (SELECT doc_id, name, row_number() OVER (PARTITION BY doc_id ORDER BY round(points * 100 - 0.000001, 0) DESC, ord) AS rank FROM g WHERE points > 0) SELECT doc_id, CAST(rank AS INTEGER) AS rank, name FROM o WHERE rank <= 3",
        "q_gate": f"WITH {SCORED}, g AS (SELECT source, wc >= 20 AND score_raw >= 2.95 AS hit FROM z) SELECT source, count(*) AS n, count(*) FILTER (WHERE hit) AS n_flagged, bool_or(hit) AS any_flagged FROM g GROUP BY source",
        "q_combiner_prob": f"WITH {SCORED}, l AS (SELECT doc_id, wc, {LOGIT} AS x FROM z), s AS (SELECT doc_id, wc, x, {SIGMOID} AS p FROM l) SELECT doc_id, round(x, 6) AS logit, round(p, 6) AS prob, {P_VERDICT} AS verdict FROM s",
        "q_combiner_contrib": f"WITH {SCORED} " + " UNION ALL ".join(f"SELECT doc_id, '{n}' AS feature, round(CAST({Z[n]} AS DOUBLE), 6) AS z, round(CAST({c!r} AS DOUBLE) * CAST({Z[n]} AS DOUBLE), 6) AS contribution FROM z" for n, c in zip(MODEL["features"], MODEL["coef"])),
        "q_ngram_counts": f"WITH {NGRAMS} SELECT prev, word, o, p FROM g",
        "q_likelihood": f"WITH {LIKELIHOOD} SELECT src.doc_id, {rounded('ll_perplexity', 'll_mean_logprob', 'll_surprisal_stdev', 'll_binoculars')} FROM src LEFT JOIN ll ON ll.doc_id = src.doc_id",
        "q_auc": _auc_of(LABELLED, "SELECT s, y FROM y", "", "SELECT n_pos, n_neg, round(auc, 9) AS auc FROM auc"),
        "q_slice_auc": _auc_of(LABELLED, "SELECT 'lang' AS slice, lang AS value, s, y FROM y UNION ALL SELECT 'source', source, s, y FROM y", "slice, value", "SELECT slice, value, n_pos, n_neg, round(auc, 9) AS auc FROM auc WHERE n_pos > 0 AND n_neg > 0"),
        "q_feature_auc": _auc_of(LABELLED + ",\nfl AS (" + " UNION ALL ".join(f"SELECT '{n}' AS feature, CAST(floor({n} * 1000000 + 0.5) AS BIGINT) AS s, y FROM y WHERE {n} IS NOT NULL" for n in NAMES) + ")", "SELECT feature, s, y FROM fl", "feature", "SELECT d.feature, d.direction, coalesce(n_pos + n_neg, 0) AS coverage, CASE WHEN n_pos + n_neg >= 10 THEN round(CASE WHEN d.direction = 'low=AI' THEN 1 - auc ELSE auc END, 9) END AS auc FROM (VALUES " + ", ".join(f"('{x.name}', '{x.direction}')" for x in REGISTRY) + ") AS d(feature, direction) LEFT JOIN auc ON auc.feature = d.feature"),
        "q_paired_auc": f"WITH {SCORED.replace(SEASONED, TALK)}, m AS (SELECT source, avg(CASE WHEN lang = 'assistant' THEN floor(score_raw * 1000000 + 0.5) END) AS a, avg(CASE WHEN lang <> 'assistant' THEN floor(score_raw * 1000000 + 0.5) END) AS h FROM z GROUP BY source), k AS (SELECT * FROM m WHERE a IS NOT NULL AND h IS NOT NULL) SELECT count(*) AS pairs, count(*) FILTER (WHERE a > h) AS wins, count(*) FILTER (WHERE a = h) AS ties, count(*) FILTER (WHERE a < h) AS losses, round((count(*) FILTER (WHERE a > h) + CAST(0.5 AS DOUBLE) * count(*) FILTER (WHERE a = h)) / nullif(count(*), 0), 9) AS paired_auc, round(avg(a - h), 3) AS mean_delta FROM k",
        "q_confusion": f"WITH {LABELLED}, c AS (SELECT count(*) FILTER (WHERE s >= 2500000 AND y = 1) AS tp, count(*) FILTER (WHERE s >= 2500000 AND y = 0) AS fp, count(*) FILTER (WHERE s < 2500000 AND y = 1) AS fn, count(*) FILTER (WHERE s < 2500000 AND y = 0) AS tn FROM y), q1 AS (SELECT *, {RATIOS} FROM c) SELECT tp, fp, fn, tn, {rounded('accuracy', 'precision', 'recall', 'f1')} FROM q1",
        "q_best_threshold": f"WITH {LABELLED}, t AS (SELECT DISTINCT s AS t FROM y), c AS (SELECT t, count(*) FILTER (WHERE s >= t AND y = 1) AS tp, count(*) FILTER (WHERE s >= t AND y = 0) AS fp, count(*) FILTER (WHERE s < t AND y = 1) AS fn, count(*) FILTER (WHERE s < t AND y = 0) AS tn FROM t, y GROUP BY t), q1 AS (SELECT t, {RATIOS} FROM c) SELECT CAST(t AS DOUBLE) AS threshold, round(f1, 4) AS f1 FROM q1 ORDER BY round(f1, 4) DESC, t LIMIT 1",
        "q_dist": f"WITH {LABELLED}, o AS (SELECT y, CAST(s AS DOUBLE) AS s, row_number() OVER (PARTITION BY y ORDER BY s) - 1 AS r, count(*) OVER (PARTITION BY y) AS n FROM y) SELECT y, max(n) AS n, round(avg(s), 3) AS mean, (max(s) FILTER (WHERE r = (n - 1) // 2) + max(s) FILTER (WHERE r = n // 2)) / 2 AS median, max(s) FILTER (WHERE r = n // 4) AS p25, max(s) FILTER (WHERE r = (3 * n) // 4) AS p75, min(s) AS min, max(s) AS max FROM o GROUP BY y",
        "q_drift": _auc_of(LABELLED + f",\ne AS (SELECT concat(lang, ' · ', CASE WHEN doc_id % 2 = 0 THEN '2022' ELSE '2026' END, ' · ', CASE WHEN y = 0 THEN {human} WHEN doc_id % 3 = 0 THEN 'm1' ELSE 'm2' END) AS grp, y, CAST(s AS DOUBLE) AS s, CAST(wc AS DOUBLE) AS burst FROM y),\nel AS (SELECT grp, 's' AS metric, s AS v, y FROM e UNION ALL SELECT grp, 'burst', burst, y FROM e),\nai AS (SELECT DISTINCT grp, metric FROM el WHERE y = 1)", "SELECT grp, metric, v AS s, y FROM el WHERE y = 1 UNION ALL SELECT ai.grp, ai.metric, el.v, 0 FROM ai JOIN el ON el.metric = ai.metric AND el.y = 0", "grp, metric", ", k AS (SELECT grp, metric, count(*) AS n, median(v) AS median FROM el GROUP BY grp, metric) SELECT k.grp, k.metric, k.n, k.median, round(CASE WHEN k.metric = 'burst' THEN 1 - auc ELSE auc END, 9) AS auc FROM k LEFT JOIN auc ON auc.grp = k.grp AND auc.metric = k.metric"),
        "q_split": "WITH g AS (SELECT DISTINCT conv_id FROM conversations), r AS (SELECT conv_id, row_number() OVER (ORDER BY md5(concat(conv_id, ':13')), conv_id) AS r, count(*) OVER () AS n FROM g) SELECT c.conv_id, turn, CASE WHEN r <= floor(n * 0.3) THEN 'test' ELSE 'train' END AS part FROM conversations c JOIN r ON r.conv_id = c.conv_id",
        "q_balance": "SELECT doc_id, source, lang AS label FROM (SELECT doc_id, source, lang, row_number() OVER (PARTITION BY source, lang ORDER BY md5(concat(doc_id, ':13')), doc_id) AS r FROM documents) WHERE r <= 5",
        "q_merge_scores": f"WITH {CACHE} SELECT d.doc_id, d.source, c.ll_mean_logprob FROM documents d LEFT JOIN cache c ON c.doc_id = d.doc_id",
        "q_resume_anti": f"WITH {CACHE} SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM cache)",
        "q_misclassified": f"WITH {LABELLED}, k AS (SELECT CASE WHEN y = 0 AND s >= 2500000 THEN 'fp' WHEN y = 1 AND s < 2500000 THEN 'fn' END AS kind, doc_id, CAST(s AS DOUBLE) AS score, substring(text, 1, 280) AS snippet FROM y), o AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY CASE WHEN kind = 'fp' THEN -score ELSE score END, doc_id) AS rank FROM k WHERE kind IS NOT NULL) SELECT kind, CAST(rank AS INTEGER) AS rank, doc_id, score, snippet FROM o WHERE rank <= 15",
        "q_impute": f"WITH {seas}, m AS (SELECT median(cv) AS m FROM f) SELECT doc_id, round(coalesce(cv, m), 6) AS sentence_cv FROM f, m",
        "q_counts": "SELECT 'lang' AS key, lang AS value, count(*) AS n FROM documents GROUP BY lang UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY source",
        "q_job_grid": "SELECT doc_id, [" + ", ".join(map(q, GENRES)) + "][CAST(doc_id % 3 AS INTEGER) + 1] AS genre, [" + ", ".join(map(q, TOPICS)) + f"][CAST(CAST(concat('0x', substring(md5(concat(doc_id, ':13')), 1, 8)) AS BIGINT) % {len(TOPICS)} AS INTEGER) + 1] AS topic FROM documents",
        "q_csv_scan": "SELECT doc_id, lang, length(coalesce(text, '')) AS n_chars, md5(coalesce(text, '')) AS text_md5 FROM documents",
        "q_union": "SELECT CAST(doc_id AS VARCHAR) AS id, source, lang AS label, NULL AS model FROM documents UNION ALL SELECT concat_ws('-', conv_id, turn), NULL, NULL, role FROM conversations",
        "q_generated_filter": f"SELECT lang, count(*) AS n FROM documents WHERE len(regexp_extract_all(text, '[^{WS}]+')) >= 30 GROUP BY lang",
        "q_clean": f"SELECT conv_id, turn, md5(trim(regexp_replace(text, '[{WS}]+', ' ', 'g'))) AS clean_md5 FROM conversations",
    }
    likelihood = LIKELIHOOD.replace(f"src AS ({SEASONED}),", "")
    all_z = zs([*NAMES, "ll_mean_logprob", "ll_surprisal_stdev", "ll_binoculars"])
    full = logit(all_z)
    # leaning by the value's side, and only where it moves the logit
    n_ai = " + ".join(f"CASE WHEN CAST({all_z[n]} AS DOUBLE) {'< -0.4' if COMBINER_DIRECTION[n] == LOW else '> 0.4'} AND abs(CAST({c!r} AS DOUBLE) * CAST({all_z[n]} AS DOUBLE)) > 0.05 THEN 1 ELSE 0 END" for n, c in zip(MODEL["features"], MODEL["coef"]))
    out["q_augment"] = f"WITH {SCORED},{likelihood}, j AS (SELECT z.*, ll_mean_logprob, ll_surprisal_stdev, ll_binoculars FROM z LEFT JOIN ll ON ll.doc_id = z.doc_id), l AS (SELECT doc_id, wc, {full} AS x, {n_ai} AS n_ai FROM j), s AS (SELECT doc_id, wc, n_ai, {SIGMOID} AS p FROM l) SELECT doc_id, CAST(n_ai AS INTEGER) AS n_ai, {half_even('p', 4)} AS probability, {P_VERDICT} AS verdict, wc >= 20 AND p >= 0.49995 AS flagged, CAST(17 AS INTEGER) AS n_signals FROM s"
    out["q_score_waves"] = out["q_likelihood"]
    out["q_bootstrap_ci"] = _bootstrap()
    out["q_lr_model"] = _learned() + " " + _LR_MODEL
    out["q_train_lr"] = _learned() + f""",
s_ AS (SELECT y, {SIGMOID} AS p, h FROM (SELECT y, h, list_dot_product(z, b) AS x FROM zv, b{STEPS} WHERE doc_id % 10 >= 7)),
{auc_sql("SELECT 'combiner' AS which, p AS s, y FROM s_ UNION ALL SELECT 'heuristic', h, y FROM s_", "which")}
SELECT which, n_pos, n_neg, round(auc, 6) AS auc FROM auc"""
    out["q_qa_flatten"] = _QA
    out["q_flat_cells"] = _FLAT
    return out


def _bootstrap() -> str:
    """The same draws as resample.py's, one row a cell, digit and replicate."""
    digits = [(d, *resample.ladder(d)) for d in range(12)]
    ladders = ", ".join(f"({d}, {below}, {steps.tolist()})" for d, below, steps in digits)
    p, seed = resample.PRIME, 13
    return f"""WITH {LABELLED},
cell AS (SELECT s, y AS side, count(*) AS n FROM y GROUP BY s, y),
ladder(d, below, steps) AS (VALUES {ladders}),
dg AS (SELECT s, side, d, below, steps, ((s % {p}) * {resample.OF_WHOLE} + side * {resample.OF_SIDE}) % {p} AS code FROM cell JOIN ladder ON (n >> d) & 1 = 1),
{resample.fifth_sql('f1', 'dg', f'(code + d * {resample.OF_DIGIT}) % {p}', 'c')},
rp AS (SELECT f1.*, rep, (rep * {resample.OF_REPLICATE} + {seed * resample.OF_SEED + 1}) % {p} AS r FROM f1, (SELECT unnest(range({REPS})) AS rep)),
{resample.fifth_sql('f2', 'rp', f'(c + r) % {p}', 'x')},
{resample.fifth_sql('f3', 'f2', f'(x + r * {resample.AGAIN} + 1) % {p}', 'u')},
wt AS (SELECT rep, s, CAST(sum(CASE WHEN side = 1 THEN w ELSE 0 END) AS BIGINT) AS p, CAST(sum(CASE WHEN side = 0 THEN w ELSE 0 END) AS BIGINT) AS q
       FROM (SELECT rep, s, side, below + len(list_filter(steps, lambda t: t <= u)) AS w FROM f3) GROUP BY rep, s),
cm AS (SELECT rep, p, q, coalesce(sum(q) OVER (PARTITION BY rep ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lower FROM wt),
ac AS (SELECT CAST(sum(p * (2 * lower + q)) AS DOUBLE) / nullif(CAST(2 AS DOUBLE) * sum(p) * sum(q), 0) AS auc FROM cm GROUP BY rep),
o AS (SELECT auc, row_number() OVER (ORDER BY auc) - 1 AS i, count(*) OVER () AS m FROM ac WHERE auc IS NOT NULL)
SELECT max(round(auc, 4)) FILTER (WHERE i = floor(m * 0.025)) AS lo, max(round(auc, 4)) FILTER (WHERE i = floor(m * 0.975)) AS hi, count(*) AS reps_used FROM o"""


STEPS = 9  # of Newton's method


def _learned() -> str:
    """CTEs up to zv (doc_id, y, h, z with a leading 1) and b0, b1, ..., the coefficients after each step. A step solves its equations by elimination."""
    k = len(NAMES) + 1
    out = f"""WITH RECURSIVE {LABELLED},
xv AS (SELECT doc_id, y, CAST(format('{{:.1f}}', score_raw) AS DOUBLE) AS h, [{', '.join(f'CAST({n} AS DOUBLE)' for n in NAMES)}] AS x FROM y),
md AS (SELECT list(coalesce(m, 0) ORDER BY i) AS m FROM (SELECT i, median(x[i]) AS m FROM xv, (SELECT unnest(range(1, {k})) AS i) WHERE doc_id % 10 < 7 GROUP BY i)),
im AS (SELECT doc_id, y, h, list_transform(x, lambda v, i: coalesce(v, m[i])) AS x FROM xv, md),
ms AS (SELECT list(a ORDER BY i) AS a, list(CASE WHEN d = 0 THEN 1 ELSE d END ORDER BY i) AS d
       FROM (SELECT i, avg(x[i]) AS a, stddev_pop(x[i]) AS d FROM im, (SELECT unnest(range(1, {k})) AS i) WHERE doc_id % 10 < 7 GROUP BY i)),
zv AS MATERIALIZED (SELECT doc_id, y, h, list_concat([CAST(1 AS DOUBLE)], list_transform(x, lambda v, i: greatest(-6, least(6, (v - a[i]) / d[i])))) AS z FROM im, ms),
b0 AS (SELECT list_transform(range({k}), lambda i: CAST(0 AS DOUBLE)) AS b)"""
    for n in range(1, STEPS + 1):
        out += f""",
p{n} AS (SELECT z, y, b, 1 / (1 + exp(-list_dot_product(z, b))) AS p FROM zv, b{n - 1} WHERE doc_id % 10 < 7),
h{n} AS (SELECT i, j, CASE WHEN j > {k} THEN sum(z[i] * (p - y)) + CASE WHEN i > 1 THEN any_value(b[i]) ELSE 0 END
                           ELSE sum(z[i] * z[j] * p * (1 - p)) + CASE WHEN i = j AND i > 1 THEN 1 ELSE 0 END END AS v
         FROM p{n}, (SELECT unnest(range(1, {k + 1})) AS i), (SELECT unnest(range(1, {k + 2})) AS j) GROUP BY i, j),
m{n} AS MATERIALIZED (SELECT list(r ORDER BY i) AS m FROM (SELECT i, list(v ORDER BY j) AS r FROM h{n} GROUP BY i)),
e{n} AS (SELECT 1 AS k, m FROM m{n} UNION ALL
         SELECT k + 1, list_transform(m, lambda r, i: CASE WHEN i = k THEN list_transform(r, lambda v: v / r[k]) ELSE list_transform(r, lambda v, j: v - r[k] * m[k][j] / m[k][k]) END)
         FROM e{n} WHERE k <= {k}),
b{n} AS MATERIALIZED (SELECT list_transform(b, lambda v, i: v - m[i][{k + 1}]) AS b FROM b{n - 1}, e{n} WHERE k = {k + 1})"""
    return out


_LR_MODEL = "SELECT f.feature, round(a[i], 6) AS mean, round(d[i], 6) AS std, round(b[i + 1], 6) AS coef, round(m[i], 6) AS impute FROM (VALUES " + ", ".join(f"('{n}', {i})" for i, n in enumerate([*NAMES, "intercept"], 1)) + f") AS f(feature, i), ms, md, b{STEPS} WHERE f.feature <> 'intercept' UNION ALL SELECT 'intercept', NULL, NULL, round(b[1], 6), NULL FROM b{STEPS}"




def _clean(text: str) -> str:
    return f"trim(regexp_replace({text}, '[{WS}]+', ' ', 'g'))"


_QA = f"""
WITH t AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'human' ELSE 'ai' END AS label, {_clean('text')} AS text FROM conversations WHERE role <> 'system'),
u AS (SELECT conv_id, substring(arg_min(text, turn), 1, 300) AS question FROM t WHERE label = 'human' GROUP BY conv_id),
g AS (SELECT *, concat('d', conv_id % 5) AS domain, row_number() OVER (PARTITION BY conv_id, label ORDER BY turn) AS j FROM t WHERE len(regexp_extract_all(text, '[^{WS}]+')) >= 20),
k AS (SELECT conv_id, domain FROM g GROUP BY conv_id, domain HAVING count(DISTINCT label) = 2),
l AS (SELECT conv_id FROM (SELECT conv_id, row_number() OVER (PARTITION BY domain ORDER BY md5(concat(conv_id, ':13')), conv_id) AS r FROM k) WHERE r <= 12)
SELECT concat('hc3-', domain, '-', g.conv_id, '-', label, '-', j - 1) AS id, label, domain, CASE WHEN label = 'ai' THEN 'chatgpt-2022' ELSE 'human' END AS model, question, md5(text) AS text_md5
FROM g JOIN u ON u.conv_id = g.conv_id WHERE g.conv_id IN (SELECT conv_id FROM l) AND j <= CASE WHEN label = 'ai' THEN 2 ELSE 1 END
"""
_FLAT = f"""
WITH t AS (SELECT concat('r', doc_id) AS id, source AS source_id,
  CASE WHEN doc_id % 5 = 0 THEN 'recipes' WHEN doc_id % 2 = 0 THEN 'news' ELSE 'wiki' END AS domain,
  CASE WHEN doc_id % 7 = 0 THEN 'gpt2' WHEN doc_id % 4 = 0 THEN 'human' WHEN doc_id % 4 = 1 THEN 'm1' ELSE 'm2' END AS model,
  CASE WHEN doc_id % 2 = 0 THEN NULL ELSE 'greedy' END AS decoding, {_clean("coalesce(text, '')")} AS text FROM documents),
r AS (SELECT *, md5(concat(id, ':13')) AS h FROM t WHERE domain <> 'recipes' AND model <> 'gpt2' AND len(regexp_extract_all(text, '[^{WS}]+')) BETWEEN 50 AND 600),
a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY domain, model ORDER BY h, id) AS k FROM r WHERE model <> 'human') WHERE k <= 25),
n AS (SELECT count(*) AS n FROM a), d AS (SELECT count(DISTINCT domain) AS d FROM r WHERE model = 'human'),
m AS (SELECT * FROM (SELECT r.*, row_number() OVER (PARTITION BY domain ORDER BY h, id) AS k FROM r WHERE model = 'human') WHERE k <= greatest(1, (SELECT n FROM n) // greatest(1, (SELECT d FROM d)))),
b AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY h, id) AS x FROM m) WHERE x <= (SELECT n FROM n)),
o AS (SELECT id, source_id, domain, model, decoding, text, 'human' AS label FROM b UNION ALL SELECT id, source_id, domain, model, decoding, text, 'ai' FROM a)
SELECT concat('raid-', domain, '-', model, '-', id) AS id, label, domain, model, decoding, concat('raid:', domain, ':', source_id) AS question, md5(text) AS text_md5 FROM o
"""

SQL = build()
