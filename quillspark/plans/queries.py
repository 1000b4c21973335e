"""One query for each operator, over the driver's tables; oracles.py has the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import combine, corpus, gate, likelihood, stats, train
from ..functions.text import pinned
from ..operators.features import FEATURE_NAMES, dimension, features, features_long
from ..operators.parse import parse, vocab_hits
from ..operators.heuristic import score, top_issues
from ..sources.readers import spread
from ..sources.split_csv import read_csv
from ..sources.storage import fresh_path, settled
from .seasoned import SEASONED

#: Documents as rows of a benchmark of generations.
FLAT = """
SELECT concat('r', doc_id) AS id, source AS source_id,
  CASE WHEN doc_id % 5 = 0 THEN 'recipes' WHEN doc_id % 2 = 0 THEN 'news' ELSE 'wiki' END AS domain,
  CASE WHEN doc_id % 7 = 0 THEN 'gpt2' WHEN doc_id % 4 = 0 THEN 'human' WHEN doc_id % 4 = 1 THEN 'm1' ELSE 'm2' END AS model,
  CASE WHEN doc_id % 2 = 0 THEN '' ELSE 'greedy' END AS decoding, text AS generation
FROM {documents}
"""
REPS = 400  # resamples of q_bootstrap_ci
TOPICS, GENRES = ["tides", "bread", "maps", "clocks"], ["essay", "email", "story"]


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _texts(spark: SparkSession, sf: str, name: str = "documents") -> DataFrame:
    return spread(_table(spark, sf, name))


def seasoned(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql(SEASONED.replace("FROM documents", "FROM {documents}"), documents=_texts(spark, sf))


def scored(spark: SparkSession, sf: str) -> DataFrame:
    return score(seasoned(spark, sf))


def _grid(c: str, digits: int = 6) -> F.Column:
    """A double on a grid, as a whole number: ties are the same in any engine."""
    return F.floor(F.col(c) * float(10**digits) + 0.5).cast("long")


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    """Scored texts with the proxy label y = 1 - quality; s is the score in millionths. The join stands before the parse, which costs
    far more than it and which the optimiser doesn't move: texts without a label are read, but not parsed."""
    labels = _table(spark, sf, "labels").select("doc_id", (1 - F.col("quality")).cast("int").alias("y"))
    return score(seasoned(spark, sf).join(labels, "doc_id")).withColumn("s", _grid("score_raw"))


def _with_likelihood(spark: SparkSession, sf: str) -> tuple[likelihood.NgramPair, DataFrame]:
    bench = _table(spark, sf, "benchmark")
    return likelihood.NgramPair.fit(bench.where("item_id % 2 = 0"), bench.where("item_id % 2 = 1")), seasoned(spark, sf)


def q_text_stats(spark, sf):
    p = parse(_texts(spark, sf))
    return p.select("doc_id", "word_count", F.size("tokens").alias("n_tokens"), F.round("per_1k", 6).alias("per_1k"), "n_commas")


def q_sentence_stats(spark, sf):
    p = parse(_texts(spark, sf))
    return p.select("doc_id", "sentence_count", F.col("sum_length").alias("sum_length"), F.round("cv", 6).alias("cv"), "low_confidence")


def q_surface_rates(spark, sf):
    f = features(seasoned(spark, sf))
    return f.select("doc_id", *[F.round(c, 6).alias(c) for c in ("em_per_1k", "smart_quotes_per_1k", "comma_per_1k")])


def q_phrase_rates(spark, sf):
    f = features(seasoned(spark, sf))
    return f.select("doc_id", *[F.round(c, 6).alias(c) for c in ("not_just_per_1k", "tricolon_per_1k", "hedge_per_1k", "bridge_per_1k")])


def q_vocab_hits(spark, sf):
    return vocab_hits(seasoned(spark, sf), "doc_id").select("doc_id", "term", "n")


def q_vocab_rates(spark, sf):
    return features(seasoned(spark, sf)).select("doc_id", F.round("vocab_per_1k", 6).alias("vocab_per_1k"), "vocab_distinct")


def q_lexical(spark, sf):
    f = features(seasoned(spark, sf))
    return f.select("doc_id", *[F.round(c, 6).alias(c) for c in ("type_token_ratio", "function_word_ratio", "mean_word_length", "mean_sentence_length")])


def q_features_wide(spark, sf):
    return features(seasoned(spark, sf)).select("doc_id", *[F.round(c, 6).alias(c) for c in FEATURE_NAMES])


def q_features_long(spark, sf):
    long = features_long(seasoned(spark, sf), ["doc_id"]).join(F.broadcast(dimension(spark)), "feature")
    return long.select("doc_id", "feature_no", "feature", "direction", F.round("value", 6).alias("value"))


def q_signals(spark, sf):
    s = scored(spark, sf).select("doc_id", pinned(F.col("signals")).alias("all")).select("doc_id", F.posexplode("all").alias("pos", "s"))
    return s.select("doc_id", "pos", "s.name", "s.value", "s.leaning", F.col("s.contribution").alias("points"))


def q_heuristic_score(spark, sf):
    return scored(spark, sf).select("doc_id", F.round("score_raw", 6).alias("score_raw"), "verdict", "word_count", "low_confidence", F.size("signals").alias("n_signals"), F.size("notes").alias("n_notes"))


def q_layers(spark, sf):
    return scored(spark, sf).select("doc_id", pinned(F.col("layers")).alias("all")).select("doc_id", F.explode("all").alias("layer", "value"))


def q_verdict_counts(spark, sf):
    return scored(spark, sf).groupBy("lang", "verdict").agg(F.count(F.lit(1)).alias("n"), F.count_if("low_confidence").alias("n_low"))


def q_top_issues(spark, sf):
    return top_issues(scored(spark, sf), ["doc_id"], 3).select("doc_id", "rank", "name")


def q_gate(spark, sf):
    return gate.gate(scored(spark, sf)).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if("flagged").alias("n_flagged"), F.bool_or("flagged").alias("any_flagged"))


def q_combiner_prob(spark, sf):
    p = combine.predict(scored(spark, sf))
    return p.select("doc_id", F.round("logit", 6).alias("logit"), F.round("prob_raw", 6).alias("prob"), combine.probability_verdict(F.col("prob_raw"), F.col("word_count")).alias("verdict"))


def q_combiner_contrib(spark, sf):
    c = combine.contributions(combine.predict(scored(spark, sf)), ["doc_id"])
    return c.select("doc_id", "feature", F.round("z", 6).alias("z"), F.round("contribution", 6).alias("contribution"))


def q_ngram_counts(spark, sf):
    pair, _ = _with_likelihood(spark, sf)
    return pair.pairs.select("prev", "word", "o", "p")


def q_likelihood(spark, sf):
    pair, docs = _with_likelihood(spark, sf)
    return pair.score(docs).select("doc_id", *[F.round(c, 6).alias(c) for c in likelihood.LL_SCHEMA])


def q_auc(spark, sf):
    return stats.auc(labelled(spark, sf), "s", "y").select("n_pos", "n_neg", F.round("auc", 9).alias("auc"))


def q_slice_auc(spark, sf):
    return stats.slice_auc(labelled(spark, sf), "s", "y", ["lang", "source"]).select("slice", "value", "n_pos", "n_neg", F.round("auc", 9).alias("auc"))


def q_feature_auc(spark, sf):
    rows = labelled(spark, sf).select("y", *[(_grid(c) / 1e6).alias(c) for c in FEATURE_NAMES]).unpivot(["y"], FEATURE_NAMES, "feature", "value")
    return stats.feature_auc(rows, "y", dimension(spark)).select("feature", "direction", "coverage", F.round("auc", 9).alias("auc"))


def q_paired_auc(spark, sf):
    talk = _texts(spark, sf, "conversations").where("role <> 'system'").select("conv_id", F.concat_ws("-", "conv_id", "turn").alias("id"), (F.col("role") == "assistant").cast("int").alias("y"), "text")
    rows = score(talk).withColumn("s", _grid("score_raw").cast("double"))
    return stats.paired_auc(rows, "conv_id", "id", "s", "y").select("pairs", "wins", "ties", "losses", F.round("paired_auc", 9).alias("paired_auc"), F.round("mean_delta", 3).alias("mean_delta"))


def q_confusion(spark, sf):
    c = stats.confusion_at(labelled(spark, sf), "s", "y", 2_500_000.0)
    return c.select("tp", "fp", "fn", "tn", *[F.round(x, 6).alias(x) for x in ("accuracy", "precision", "recall", "f1")])


def q_best_threshold(spark, sf):
    return stats.best_threshold(labelled(spark, sf), "s", "y")


def q_dist(spark, sf):
    d = stats.dist(labelled(spark, sf), "s", ["y"])
    return d.select("y", "n", F.round("mean", 3).alias("mean"), "median", "p25", "p75", "min", "max")


def q_drift(spark, sf):
    rows = labelled(spark, sf).withColumns({"era": F.when(F.col("doc_id") % 2 == 0, "2022").otherwise("2026"), "model": F.when(F.col("doc_id") % 3 == 0, "m1").otherwise("m2"), "source": F.col("lang"), "burst": F.col("word_count").cast("double")})
    return stats.drift(rows, "y", {"s": False, "burst": True}).select("grp", "metric", "n", "median", F.round("auc", 9).alias("auc"))


def q_split(spark, sf):
    talk = _table(spark, sf, "conversations").select("conv_id", "turn", F.concat_ws("-", "conv_id", "turn").alias("id"))
    return corpus.grouped_split(talk, "conv_id", "id").select("conv_id", "turn", "part")


def q_balance(spark, sf):
    rows = _table(spark, sf, "documents").select("doc_id", "source", F.col("lang").alias("label"))
    return corpus.balance_sample(rows, 5, key="doc_id")


def _cache(spark, sf):
    """A made-up layer-2 cache: each tenth id is missing, each thirteenth twice."""
    ids = _table(spark, sf, "documents").select("doc_id").where("doc_id % 10 <> 0")
    row = lambda seq, add: ids.select("doc_id", (F.col("doc_id") % 7 + add).cast("double").alias("ll_mean_logprob"), F.lit(seq).alias("seq"))
    return row(1, 0).union(row(2, 100).where("doc_id % 13 = 0"))


def q_merge_scores(spark, sf):
    rows = _table(spark, sf, "documents").select("doc_id", "source")
    return corpus.merge_scores(rows, _cache(spark, sf), "doc_id")


def q_resume_anti(spark, sf):
    return likelihood.resume(_table(spark, sf, "documents").select("doc_id", "lang"), _cache(spark, sf), "doc_id")


def q_qa_flatten(spark, sf):
    talk = corpus.answers(_texts(spark, sf, "conversations"), "conv_id", "turn", "role", "text", 20, 3).withColumn("domain", F.concat(F.lit("d"), F.col("conv_id") % 5))
    out = corpus.flatten_qa(talk, "domain", 1, 2, min_words=20, limit=12, order="conv_id")
    return out.select("id", "label", "domain", "model", "question", F.md5(F.col("text").cast("binary")).alias("text_md5"))


def q_flat_cells(spark, sf):
    out = corpus.sample_cells(spark.sql(FLAT, documents=_texts(spark, sf)), per_cell=25)
    return out.select("id", "label", "domain", "model", "decoding", "question", F.md5(F.col("text").cast("binary")).alias("text_md5"))


def q_csv_scan(spark, sf):
    path = fresh_path(spark, "csv")
    docs = _table(spark, sf, "documents").select("doc_id", "lang", F.coalesce("text", F.lit("")).alias("text"))
    docs.write.options(header=True, quoteAll=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    back = read_csv(spark, path)
    return back.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", F.length("text").cast("long").alias("n_chars"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


def q_score_waves(spark, sf):
    pair, docs = _with_likelihood(spark, sf)
    cache = fresh_path(spark, "cache")
    likelihood.score_pending(docs.where("doc_id % 2 = 0"), pair, cache, "doc_id", wave_rows=100_000)
    out = likelihood.score_pending(docs, pair, cache, "doc_id", wave_rows=100_000)
    return out.select("doc_id", *[F.round(c, 6).alias(c) for c in likelihood.LL_SCHEMA])


def q_union(spark, sf):
    docs = _table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("id"), "source", F.col("lang").alias("label"))
    talk = _table(spark, sf, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("id"), F.col("role").alias("model"))
    return corpus.union_corpora(docs, talk)


def q_misclassified(spark, sf):
    rows = labelled(spark, sf).withColumn("s", F.col("s").cast("double"))
    return stats.misclassified(rows, "doc_id", "s", "y", 2_500_000.0, limit=15)


def q_impute(spark, sf):
    rows = features(seasoned(spark, sf)).select("doc_id", "sentence_cv")
    return stats.impute_medians(rows, ["sentence_cv"]).select("doc_id", F.round("sentence_cv", 6).alias("sentence_cv"))


def q_counts(spark, sf):
    return corpus.counts(_table(spark, sf, "documents"), ["lang", "source"])


def q_job_grid(spark, sf):
    return corpus.jobs_for(_table(spark, sf, "documents").select("doc_id"), "doc_id", GENRES, TOPICS)


def q_generated_filter(spark, sf):
    kept = corpus.at_least(_table(spark, sf, "documents"), 30)
    return kept.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


def q_clean(spark, sf):
    return _table(spark, sf, "conversations").select("conv_id", "turn", F.md5(corpus.clean(F.col("text")).cast("binary")).alias("clean_md5"))


def q_augment(spark, sf):
    pair, _ = _with_likelihood(spark, sf)
    a = gate.gate(combine.augment(pair.score(scored(spark, sf))))
    return a.select("doc_id", "probability", "verdict", "flagged", F.size("signals").alias("n_signals"), F.size(F.filter("signals", lambda s: s["leaning"] == "ai")).alias("n_ai"))


def q_bootstrap_ci(spark, sf):
    return stats.bootstrap_auc_ci(labelled(spark, sf), "s", "y", reps=REPS)


TRAINING = "doc_id % 10 < 7"


def q_train_lr(spark, sf):
    rows = settled(labelled(spark, sf).select("doc_id", "y", "score", *FEATURE_NAMES))
    model = train.train(rows.where(TRAINING), "y", FEATURE_NAMES)
    return train.evaluate_model(rows.where("doc_id % 10 >= 7"), model, "y").select("which", "n_pos", "n_neg", F.round("auc", 6).alias("auc"))


def q_lr_model(spark, sf):
    rows = settled(labelled(spark, sf).where(TRAINING).select("doc_id", "y", *FEATURE_NAMES))  # nothing else reaches the model
    model = train.train(rows, "y", FEATURE_NAMES)
    each = zip(model["features"], model["mean"], model["std"], model["coef"], (model["impute"][n] for n in model["features"]))
    rows = [(n, *(float(x) for x in numbers)) for n, *numbers in each] + [("intercept", None, None, model["intercept"], None)]
    return spark.createDataFrame(rows, "feature string, mean double, std double, coef double, impute double").select("feature", *[F.round(c, 6).alias(c) for c in ("mean", "std", "coef", "impute")])


QUERIES = {k: v for k, v in list(globals().items()) if k.startswith("q_")}
