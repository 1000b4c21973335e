"""Layer 1: the additive score of eight rules, with the signals, notes and verdict that explain it."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, fields
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lexicons import VERDICTS, VOCABULARY
from ..functions.text import pinned, rounded, shown
from .features import ADVICE, FEATURE_NAMES, features
from .parse import COLUMNS

SIGNAL = "struct<name:string,value:double,leaning:string,contribution:double,advice:string>"


@dataclass(frozen=True)
class Weights:
    # The calibration of the rules.
    em_floor: float = 4.0
    em_slope: float = 1.0
    em_cap: float = 6.0
    em_cv_suppress_above: float = 0.7
    em_cv_suppress_factor: float = 0.25
    smart_slope: float = 0.2
    smart_cap: float = 2.0
    vocab_slope: float = 1.1
    vocab_cap: float = 8.0
    vocab_min_distinct: int = 2
    not_just_slope: float = 1.0
    not_just_cap: float = 3.0
    tri_floor: float = 3.5
    tri_slope: float = 0.4
    tri_cap: float = 3.0
    tri_min_words: int = 80
    hedge_slope: float = 0.8
    hedge_cap_short: float = 1.6
    hedge_cap_long: float = 2.4
    hedge_short_words: int = 300
    bridge_floor: float = 2.0
    bridge_slope: float = 0.4
    bridge_cap: float = 1.5
    cv_t1: float = 0.35
    cv_p1: float = 4.0
    cv_t2: float = 0.45
    cv_p2: float = 2.5
    cv_t3: float = 0.55
    cv_p3: float = 1.5
    cv_t4: float = 0.65
    cv_p4: float = 0.75
    cv_t4_min_words: int = 80
    tier_human: float = 1.5
    tier_light: float = 3.0
    tier_lean: float = 5.0

    def save(self, path: str) -> None:
        Path(path).write_text(json.dumps(asdict(self), indent=2), encoding="utf-8")

    @classmethod
    def load(cls, path: str) -> Weights:
        """Weights from JSON; names that aren't weights are ignored, missing ones keep their default."""
        known = {f.name for f in fields(cls)}
        return cls(**{k: v for k, v in json.loads(Path(path).read_text(encoding="utf-8")).items() if k in known})


DEFAULT = Weights()


def verdict(score: Column, w: Weights = DEFAULT) -> Column:
    """The label of an unrounded score."""
    return F.when(score < w.tier_human, VERDICTS[0]).when(score < w.tier_light, VERDICTS[1]).when(score < w.tier_lean, VERDICTS[2]).otherwise(VERDICTS[3])


@dataclass(frozen=True)
class Rule:
    """When it fires, what it adds, which value it reports, and its note."""

    feature: str
    fires: Column
    points: Column
    value: Column
    note: Column


def _capped(x: Column, slope: float, cap: float) -> Column:
    return F.least(x * F.lit(float(slope)), F.lit(float(cap)))


def _vocab_note() -> Column:
    """The five most frequent terms; equal counts in the order of the list."""
    order = F.array(*map(F.lit, VOCABULARY))
    counted = F.transform(F.array_distinct("vocab"), lambda t: F.struct((-F.size(F.filter("vocab", lambda v: v == t))).alias("less"), F.array_position(order, t).alias("no"), t.alias("term")))
    shown = F.transform(F.slice(F.sort_array(counted), 1, 5), lambda x: F.concat(x["term"], F.lit("×"), (-x["less"]).cast("string")))
    return F.concat(F.lit("stock vocabulary: "), F.array_join(shown, ", "))


def rules(w: Weights = DEFAULT) -> list[Rule]:
    """The rules in the order in which points are added."""
    words, cv, none = F.col("word_count"), F.col("cv"), F.lit(0.0)
    em, tri, br = F.col("em_per_1k"), F.col("tricolon_per_1k"), F.col("bridge_per_1k")
    total = F.size("vocab")
    em_points = _capped(em - w.em_floor, w.em_slope, w.em_cap) * F.when(cv >= w.em_cv_suppress_above, F.lit(w.em_cv_suppress_factor)).otherwise(F.lit(1.0))
    hedge_cap = F.when(words < w.hedge_short_words, F.lit(w.hedge_cap_short)).otherwise(F.lit(w.hedge_cap_long))
    ramp = F.when(cv < w.cv_t1, F.lit(w.cv_p1)).when(cv < w.cv_t2, F.lit(w.cv_p2)).when(cv < w.cv_t3, F.lit(w.cv_p3)).when((cv < w.cv_t4) & (words >= w.cv_t4_min_words), F.lit(w.cv_p4)).otherwise(none)
    number = lambda c: c.cast("string")
    return [
        Rule("em_per_1k", em > w.em_floor, em_points, em, F.concat(F.lit("many em-dashes: "), number(F.col("n_em")), F.lit(" in "), number(words), F.lit(" words ("), shown(em, "0.0"), F.lit("/1k)"))),
        Rule("smart_quotes_per_1k", F.col("n_smart") > 0, _capped(F.col("n_smart"), w.smart_slope, w.smart_cap), F.col("n_smart"), F.concat(F.lit("curly quotes: "), number(F.col("n_smart")))),
        Rule("vocab_per_1k", (total > 0) & (F.col("vocab_distinct") >= w.vocab_min_distinct), _capped(total, w.vocab_slope, w.vocab_cap), total, _vocab_note()),
        Rule("not_just_per_1k", F.col("n_not_just") > 0, _capped(F.col("n_not_just"), w.not_just_slope, w.not_just_cap), F.col("n_not_just"), F.concat(F.lit("'not just ... but': "), number(F.col("n_not_just")))),
        Rule("tricolon_per_1k", (tri > w.tri_floor) & (words >= w.tri_min_words), _capped(tri - w.tri_floor, w.tri_slope, w.tri_cap), tri, F.concat(F.lit("lists of three: "), number(F.col("n_triads")), F.lit(" ("), shown(tri, "0.0"), F.lit("/1k)"))),
        Rule("hedge_per_1k", F.col("n_hedges") > 0, F.least(F.col("n_hedges") * F.lit(w.hedge_slope), hedge_cap), F.col("n_hedges"), F.concat(F.lit("hedged openings: "), number(F.col("n_hedges")))),
        Rule("bridge_per_1k", br > w.bridge_floor, _capped(br - w.bridge_floor, w.bridge_slope, w.bridge_cap), br, F.concat(F.lit("restatements: "), number(F.col("n_bridges")))),
        Rule("sentence_cv", F.coalesce(ramp, none) > 0, ramp, cv, F.concat(F.lit("even sentence lengths (cv="), shown(cv, "0.00"), F.lit(")"))),
    ]


def score(df: DataFrame, text_col: str = "text", w: Weights = DEFAULT, keep_parse: bool = False) -> DataFrame:
    """`df` with score_raw, score, verdict, signals, notes, layers, word_count, low_confidence and the features.

    The score adds unrounded points and is shown with one digit; the verdict goes by the unrounded one. An empty
    text has score 0, no signals and no layers."""
    made = ("score_raw", "score", "verdict", "signals", "notes", "layers")
    out = features(df.drop(*made), text_col, keep_parse=True)
    listed = rules(w)
    out = out.withColumns({f"_p{i}": F.when((F.col("word_count") > 0) & r.fires, r.points).cast("double") for i, r in enumerate(listed)})
    total = F.lit(0.0)
    for i in range(len(listed)):
        total = total + F.coalesce(F.col(f"_p{i}"), F.lit(0.0))
    signals, notes = [], []
    for i, r in enumerate(listed):
        p = F.col(f"_p{i}")
        ai = p > 0
        signals.append(F.when(p.isNotNull(), F.struct(F.lit(r.feature).alias("name"), rounded(r.value.cast("double"), 3).alias("value"), F.when(ai, "ai").otherwise("neutral").alias("leaning"), rounded(p, 2).alias("contribution"), F.when(ai, ADVICE[r.feature]).alias("advice"))))
        notes.append(F.when(p.isNotNull(), r.note))
    notes.append(F.when(F.col("low_confidence") & (F.col("word_count") > 0), F.lit("few sentences: what depends on their rhythm says little here")))
    notes.append(F.when(F.col("word_count") == 0, F.lit("empty text")))
    out = out.withColumn("score_raw", total)
    shown = rounded(F.col("score_raw"), 1)
    out = out.withColumns({
        "score": shown, "verdict": verdict(F.col("score_raw"), w),
        "signals": F.array_compact(F.array(*signals)), "notes": F.array_compact(F.array(*notes)),
        "layers": F.when(F.col("word_count") > 0, F.create_map(F.lit("heuristic"), shown)).otherwise(F.create_map().cast("map<string,double>")),
    }).drop(*(f"_p{i}" for i in range(len(listed))))
    return out if keep_parse else out.drop(*(c for c in COLUMNS if c not in ("word_count", "low_confidence")))


def lint_flat(df: DataFrame, text_col: str = "text", w: Weights = DEFAULT) -> DataFrame:
    """score, verdict, word_count, low_confidence, notes and the features beside the columns of `df`."""
    return score(df, text_col, w).select(*df.columns, "score", "verdict", "word_count", "low_confidence", "notes", *FEATURE_NAMES)


def top_issues_column(signals: Column, k: int = 5) -> Column:
    """The k signals that lean to the machine side with the largest contributions; equal ones stay in order."""
    ranked = F.filter(F.transform(signals, lambda s, i: F.struct((-F.abs(s["contribution"])).alias("less"), i.alias("i"), s.alias("s"))), lambda x: x["s"]["leaning"] == "ai")
    return F.transform(F.slice(F.sort_array(ranked), 1, k), lambda x: x["s"])


def top_issues(scored: DataFrame, key: list[str], k: int = 5) -> DataFrame:
    """(key, rank, name, value, contribution, advice): the issues of each text, largest first."""
    return scored.select(*key, pinned(top_issues_column(F.col("signals"), k)).alias("_top")).select(*key, F.posexplode("_top").alias("pos", "s")).select(*key, (F.col("pos") + 1).alias("rank"), "s.name", "s.value", "s.contribution", "s.advice")
