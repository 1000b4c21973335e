"""The combiner: a logistic regression over both layers, as expressions with the model's numbers in them."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lexicons import MIN_RELIABLE_WORDS, PROBABILITY_TIERS, TOO_SHORT, VERDICTS
from ..functions.text import pinned, rounded, shown
from .features import ADVICE, DIRECTION, FEATURE_NAMES, HIGH, LOW

LL_FEATURES = ["ll_perplexity", "ll_mean_logprob", "ll_surprisal_stdev", "ll_binoculars"]
LL_DIRECTION = {"ll_perplexity": LOW, "ll_mean_logprob": HIGH, "ll_surprisal_stdev": LOW, "ll_binoculars": LOW}
#: Perplexity is left out: it is a function of the mean log probability.
COMBINER_FEATURES = [*FEATURE_NAMES, *LL_FEATURES[1:]]
COMBINER_DIRECTION = DIRECTION | LL_DIRECTION
COMBINER_ADVICE = ADVICE | {
    "ll_perplexity": "A language model predicts this text easily; add particulars that only this text has.",
    "ll_mean_logprob": "Word choices are the likeliest ones throughout; be less generic.",
    "ll_surprisal_stdev": "Surprise is spread evenly; let plain passages and unexpected ones alternate.",
    "ll_binoculars": "Two language models agree closely on this text; prefer phrasing of your own.",
}

# The trained model (means, deviations, coefficients and medians in the order of `features`).
MODEL = {
    "features": ["em_per_1k", "smart_quotes_per_1k", "vocab_per_1k", "vocab_distinct", "not_just_per_1k", "tricolon_per_1k", "hedge_per_1k", "bridge_per_1k", "sentence_cv", "type_token_ratio", "function_word_ratio", "mean_word_length", "mean_sentence_length", "comma_per_1k", "ll_mean_logprob", "ll_surprisal_stdev", "ll_binoculars"],
    "mean": [0.47598845666872547, 1.2801191694035867, 0.6976300573740989, 0.1297614064462118, 0.11298489798346265, 1.9536257684224572, 1.0616242904176603, 0.02750567588574697, 0.3954548636607065, 0.8220462693036968, 0.4241962478640549, 4.95031555775908, 24.645423356770447, 54.68209639962717, -2.306232860474818, 2.372223107023387, 0.9286443673460119],
    "std": [2.979625473446781, 7.370169009090964, 2.3989517689057753, 0.41009343798513886, 1.311118827955583, 4.446695868576221, 3.983493913891509, 0.3921911162137804, 0.19604613388456, 0.06721327041215734, 0.07015913556900713, 0.5475820403493368, 21.72966640853686, 31.364956498842766, 0.8584642495062986, 0.5599365849720941, 0.13982863795553516],
    "coef": [0.32003718866772657, 0.0011488449725142581, -0.45785931548154507, 0.643274198156824, 0.4255661047647528, 0.5394944537821914, 0.22291168541881184, 0.11383146666360688, -0.07818516287566595, 1.2545585262073748, 0.24587110020173578, 0.01578006557397852, 0.29021221851513707, -0.2755310445403949, 0.36225027646218255, -2.583289075701188, -0.418376480743147],
    "intercept": 0.3402670348118704,
    "impute": {"em_per_1k": 0.0, "smart_quotes_per_1k": 0.0, "vocab_per_1k": 0.0, "vocab_distinct": 0.0, "not_just_per_1k": 0.0, "tricolon_per_1k": 0.0, "hedge_per_1k": 0.0, "bridge_per_1k": 0.0, "sentence_cv": 0.3582374846554792, "type_token_ratio": 0.8265765765765766, "function_word_ratio": 0.4263157894736842, "mean_word_length": 4.942028985507246, "mean_sentence_length": 21.6, "comma_per_1k": 51.72413793103448, "ll_mean_logprob": -2.323030710220337, "ll_surprisal_stdev": 2.4278736114501953, "ll_binoculars": 0.9442762931123494},
    "clip": 6.0,
    "meta": {"name": "lr-stylo+likelihood", "C": 1.0, "seed": 13, "n_train": 2389},
}


def load_model(path: str) -> dict:
    return json.loads(Path(path).read_text(encoding="utf-8"))


def save_model(model: dict, path: str) -> None:
    Path(path).write_text(json.dumps(model, indent=2), encoding="utf-8")


def _value(df: DataFrame, name: str) -> Column:
    """A feature, null where it is missing or not a number."""
    if name not in df.columns:
        return F.lit(None).cast("double")
    x = F.col(name).cast("double")
    return F.when(F.isnan(x), None).otherwise(x)


def standardized(df: DataFrame, model: dict) -> list[Column]:
    """Each feature's clipped z; missing ones count as the model's stand-in."""
    clip = float(model.get("clip", 6.0))
    out = []
    for name, mean, std in zip(model["features"], model["mean"], model["std"]):
        v = F.coalesce(_value(df, name), F.lit(float(model.get("impute", {}).get(name, mean))))
        out.append(F.greatest(F.lit(-clip), F.least(F.lit(clip), (v - float(mean)) / float(std))) if std else F.lit(0.0))
    return out


def sigmoid(x: Column) -> Column:
    return F.when(x < -60, F.lit(0.0)).when(x > 60, F.lit(1.0)).otherwise(1.0 / (1.0 + F.exp(-x)))


def predict(df: DataFrame, model: dict = MODEL) -> DataFrame:
    """`df` with contributions (array of name, z, contribution in the model's order), logit and prob_raw."""
    z = standardized(df, model)
    parts = [F.struct(F.lit(n).alias("name"), x.alias("z"), (F.lit(float(c)) * x).alias("contribution")) for n, x, c in zip(model["features"], z, model["coef"])]
    out = df.withColumn("contributions", F.array(*parts))
    out = out.withColumn("logit", F.aggregate("contributions", F.lit(float(model["intercept"])), lambda a, p: a + p["contribution"]))
    return out.withColumn("prob_raw", sigmoid(F.col("logit")))


def contributions(predicted: DataFrame, key: list[str]) -> DataFrame:
    """(key, feature, z, contribution): one row for each feature."""
    return predicted.select(*key, pinned(F.col("contributions")).alias("_all")).select(*key, F.explode("_all").alias("c")).select(*key, F.col("c.name").alias("feature"), "c.z", "c.contribution")


def probability_verdict(p: Column, words: Column) -> Column:
    a, b, c = PROBABILITY_TIERS
    label = F.when(p < a, VERDICTS[0]).when(p < b, VERDICTS[1]).when(p < c, VERDICTS[2]).otherwise(VERDICTS[3])
    return F.when(words < MIN_RELIABLE_WORDS, F.lit(TOO_SHORT)).otherwise(label)


def augment(scored: DataFrame, model: dict = MODEL) -> DataFrame:
    """Scored texts with likelihood columns: adds probability, replaces signals, extends layers and notes.

    A signal leans to the machine side by its value's direction, not by the coefficient's sign."""
    # pinned: else each of the many mentions below computes its part of the array again
    out = predict(scored, model)
    out = out.withColumns({c: pinned(F.col(c)) for c in ("contributions", "prob_raw")})
    layers = [F.struct(F.lit(n).alias("key"), rounded(_value(scored, n), 3).alias("value")) for n in LL_FEATURES if n in scored.columns]
    signals = []
    for i, name in enumerate(model["features"]):
        z, c = F.col("contributions")[i]["z"], F.col("contributions")[i]["contribution"]
        side = z < -0.4 if COMBINER_DIRECTION.get(name, HIGH) == LOW else z > 0.4
        ai = side & (F.abs(c) > 0.05)
        signals.append(F.struct(F.lit(name).alias("name"), rounded(_value(scored, name), 3).alias("value"), F.when(ai, "ai").otherwise("neutral").alias("leaning"), rounded(c, 3).alias("contribution"), F.when(ai, F.lit(COMBINER_ADVICE.get(name))).alias("advice")))
    if layers:
        extra = F.map_from_entries(F.filter(F.array(*layers), lambda e: e["value"].isNotNull()))
        out = out.withColumn("layers", F.map_concat("layers", extra))
    note = F.concat(F.lit("combined probability "), shown("prob_raw", "0.00"), F.lit(f" over {len(model['features'])} features (model: {model.get('meta', {}).get('name', 'combiner')})"))
    return out.withColumns({"probability": rounded(F.col("prob_raw"), 4), "verdict": probability_verdict(F.col("prob_raw"), F.col("word_count")), "signals": F.array(*signals), "notes": F.concat("notes", F.array(note))})
