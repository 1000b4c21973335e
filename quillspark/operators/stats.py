"""Rank statistics of a score against labels, as set operations.

All of them first collapse rows to a histogram of (score, positives, negatives): one shuffle with map-side
sums, after which work follows the number of distinct scores. Prefix sums over it run within groups (`by`), and
without groups over ranges of the score, so that no single task holds all of it.
"""

from __future__ import annotations

import operator
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.text import pinned
from ..sources.executors import ship
from ..sources.storage import settled
from . import resample


def histogram(df: DataFrame, score: str, label: str, by: list[str] = ()) -> DataFrame:
    """(by, score, pos, neg) over rows with a score; label 1 is positive."""
    rows = df.select(*by, pinned(F.col(score).cast("double")).alias("score"), pinned(F.col(label)).alias("_label")).where("score IS NOT NULL AND _label IS NOT NULL")
    label = "_label"
    return rows.groupBy(*by, "score").agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg"))


def _cut(h: DataFrame, by: list[str], ranges: int) -> DataFrame:
    """`h`, a settled histogram, with `_bin`, one of `ranges` intervals of its group's scores that hold about as many cells each.

    The edges are settled too: approximate quantiles depend on the order in which a shuffle's blocks come, so two branches that each
    computed them could cut the same cells differently."""
    points = F.array(*[F.lit(i / ranges) for i in range(1, ranges)])
    edges = settled(h.groupBy(*by).agg(F.percentile_approx("score", points, 1_000).alias("_edges")))
    cut = (h.join(edges, by) if by else h.join(F.broadcast(edges))).withColumn("_bin", F.size(F.filter("_edges", lambda x: x < F.col("score"))))
    return cut.drop("_edges")


def running(h: DataFrame, columns: dict[str, str], by: list[str] = (), descending: bool = False, inclusive: bool = False, ranges: int = 64) -> DataFrame:
    """Add, for each name in `columns`, the sum of its column over lower (or higher) scores of the group.

    Scores are cut at their quantiles, so one far-off score doesn't fill one range with all others; each range sums within
    itself and adds the totals of the ranges before it, of which there are few."""
    by = list(by)
    binned = _cut(settled(h), by, ranges)
    order = F.desc("_bin") if descending else F.asc("_bin")
    # one row a bin and group
    w = Window.partitionBy(*(by or [F.lit(0)])).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    before = binned.groupBy(*by, "_bin").agg(*[F.sum(c).alias(f"_all_{c}") for c in set(columns.values())]).select(*by, "_bin", *[F.coalesce(F.sum(f"_all_{c}").over(w), F.lit(0)).alias(f"_before_{out}") for out, c in columns.items()])
    inner = Window.partitionBy(*by, "_bin").orderBy(F.desc("score") if descending else F.asc("score")).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    joined = binned.join(F.broadcast(before) if not by else before, [*by, "_bin"])
    joined = joined.withColumns({out: (F.col(f"_before_{out}") + F.coalesce(F.sum(c).over(inner), F.lit(0))).cast("long") for out, c in columns.items()})
    return joined.drop("_bin", *(f"_before_{out}" for out in columns))


def auc(df: DataFrame, score: str, label: str, by: list[str] = ()) -> DataFrame:
    """(by, n_pos, n_neg, auc): the chance that a positive scores above a negative, ties for half; null with one class."""
    h = histogram(df, score, label, by)
    h = running(h, {"below": "neg"}, by)
    pos, neg = F.sum("pos"), F.sum("neg")
    wins = F.sum((F.col("pos") * (2 * F.col("below") + F.col("neg"))).cast("decimal(38,0)")).cast("double")
    return h.groupBy(*by).agg(pos.alias("n_pos"), neg.alias("n_neg"), F.try_divide(wins, 2.0 * F.nullif(pos * neg, F.lit(0))).alias("auc"))


def slice_auc(df: DataFrame, score: str, label: str, keys: list[str]) -> DataFrame:
    """(slice, value, n_pos, n_neg, auc) for each value of each key that has both classes; a missing value reads '?'."""
    cut = df.select(pinned(F.col(score)).alias("_s"), F.col(label).alias("_l"), *keys).select("_s", "_l", F.explode(F.array(*[F.struct(F.lit(k).alias("slice"), F.coalesce(F.col(k).cast("string"), F.lit("?")).alias("value")) for k in keys])).alias("_k")).select("_s", "_l", "_k.slice", "_k.value")
    return auc(cut, "_s", "_l", ["slice", "value"]).where("n_pos > 0 AND n_neg > 0")


def feature_auc(long: DataFrame, label: str, directions: DataFrame, least: int = 10) -> DataFrame:
    """(feature, direction, coverage, auc) over rows (feature, value, label) that have a value; 1 - auc where low is
    the machine side; null below `least` values or with one class."""
    found = auc(long.where(F.col("value").isNotNull() & ~F.isnan("value")), "value", label, ["feature"])
    a = F.when(F.col("direction") == "low=AI", 1 - F.col("auc")).otherwise(F.col("auc"))
    n = F.coalesce(F.col("n_pos") + F.col("n_neg"), F.lit(0))
    return directions.join(found, "feature", "left").select("feature", "direction", n.alias("coverage"), F.when(n >= least, a).alias("auc"))


def bootstrap_auc_ci(df: DataFrame, score: str, label: str, reps: int = 2000, seed: int = 13, cells: int = 200_000) -> DataFrame:
    """(lo, hi, reps_used): the 2.5 and 97.5 % points of AUC over resamples of all rows.

    A resample weighs each row by a Poisson number of mean 1, which is what drawing with replacement comes to where rows are many; the numbers are
    drawn a cell of the histogram at a time, by a function of cell and resample (see resample.py), so any partitioning and any engine
    draws the same. Each range of scores (about `cells` cells) draws in its task and sends three sums a resample, so the number of
    distinct scores has no bound. Resamples with one class don't count."""
    spark = df.sparkSession
    ship(spark)
    h = settled(histogram(df, score, label))
    cut = _cut(h, [], max(2, -(-h.count() // cells)))

    def draw(key, x: pd.DataFrame) -> pd.DataFrame:
        x, rows = x.sort_values("score"), []
        sides = [(resample.code(x["score"].to_numpy(), side), x[c].to_numpy()) for side, c in ((1, "pos"), (0, "neg"))]
        for rep in range(reps):
            p, q = (resample.weights(codes, counts, rep, seed) for codes, counts in sides)
            below = 2 * (np.cumsum(q) - q) + q
            wins = int(p @ below) if int(p.sum()) * int(2 * q.sum()) < 1 << 63 else sum(map(operator.mul, p.tolist(), below.tolist()))
            rows.append((rep, int(key[0]), int(p.sum()), int(q.sum()), Decimal(wins)))  # twice the wins, in whole numbers
        return pd.DataFrame(rows, columns=["rep", "bin", "p", "q", "wins"])

    parts = cut.groupBy("_bin").applyInPandas(draw, "rep long, bin int, p long, q long, wins decimal(38,0)")
    lower = F.coalesce(F.sum("q").over(Window.partitionBy("rep").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    exact = lambda c: F.col(c).cast("decimal(38,0)")
    sums = parts.withColumn("_lower", lower).groupBy("rep").agg(F.sum(F.col("wins") + 2 * exact("p") * exact("_lower")).cast("double").alias("w"), F.sum("p").cast("double").alias("n_p"), F.sum("q").cast("double").alias("n_q"))
    drawn = sums.where("n_p > 0 AND n_q > 0").select((F.col("w") / (2.0 * F.col("n_p") * F.col("n_q"))).alias("auc"))
    ranked = drawn.withColumn("r", F.row_number().over(Window.orderBy("auc")) - 1).withColumn("m", F.count(F.lit(1)).over(Window.partitionBy()))  # reps rows
    at = lambda q: F.max(F.when(F.col("r") == F.floor(F.col("m") * q), F.round("auc", 4)))
    return ranked.agg(at(0.025).alias("lo"), at(0.975).alias("hi"), F.count(F.lit(1)).alias("reps_used"))


def paired_auc(df: DataFrame, group: str, key: str, score: str, label: str) -> DataFrame:
    """(pairs, wins, ties, losses, paired_auc, mean_delta): groups that have both classes, by their mean scores. A row
    without a group is its own."""
    g = F.coalesce(F.nullif(F.col(group).cast("string"), F.lit("")), F.concat(F.lit("__solo__"), F.col(key).cast("string")))
    means = df.groupBy(g.alias("_g")).agg(F.avg(F.when(F.col(label) == 1, F.col(score))).alias("a"), F.avg(F.when(F.col(label) != 1, F.col(score))).alias("h")).where("a IS NOT NULL AND h IS NOT NULL")
    n = F.count(F.lit(1))
    return means.agg(n.alias("pairs"), F.count_if(F.col("a") > F.col("h")).alias("wins"), F.count_if(F.col("a") == F.col("h")).alias("ties"), F.count_if(F.col("a") < F.col("h")).alias("losses"), F.try_divide(F.count_if(F.col("a") > F.col("h")) + 0.5 * F.count_if(F.col("a") == F.col("h")), n).alias("paired_auc"), F.avg(F.col("a") - F.col("h")).alias("mean_delta"))


def _ratios(df: DataFrame) -> DataFrame:
    zero = F.lit(0.0)
    df = df.withColumns({"accuracy": F.coalesce(F.try_divide((F.col("tp") + F.col("tn")).cast("double"), F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")), zero), "precision": F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fp")), zero), "recall": F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fn")), zero)})
    return df.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), zero))


def confusion_at(df: DataFrame, score: str, label: str, threshold: float | Column) -> DataFrame:
    """(threshold, tp, fp, fn, tn, accuracy, precision, recall, f1) with score >= threshold as the prediction."""
    t = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    above, ai = F.col(score) >= t, F.col(label) == 1
    counts = df.agg(F.count_if(above & ai).alias("tp"), F.count_if(above & ~ai).alias("fp"), F.count_if(~above & ai).alias("fn"), F.count_if(~above & ~ai).alias("tn"))
    shown = F.lit(None).cast("double") if isinstance(threshold, Column) else F.lit(float(threshold))
    return _ratios(counts).select(shown.alias("threshold"), "tp", "fp", "fn", "tn", "accuracy", "precision", "recall", "f1")


def threshold_curve(df: DataFrame, score: str, label: str) -> DataFrame:
    """The confusion at each distinct score: reverse prefix sums over the histogram, not a pass for each threshold."""
    h = histogram(df, score, label)
    h = running(h, {"tp": "pos", "fp": "neg"}, descending=True, inclusive=True)
    totals = h.agg(F.sum("pos").alias("np"), F.sum("neg").alias("nn"))
    return _ratios(h.join(F.broadcast(totals)).withColumns({"fn": F.col("np") - F.col("tp"), "tn": F.col("nn") - F.col("fp")}))


def best_threshold(df: DataFrame, score: str, label: str) -> DataFrame:
    """(threshold, f1): the lowest of the scores with the best F1 at four digits; one row, threshold 0 without scores."""
    curve = threshold_curve(df, score, label).withColumn("f1", F.round("f1", 4))
    best = curve.agg(F.max(F.struct("f1", (-F.col("score")).alias("less"))).alias("b"))
    return best.select(F.coalesce(-F.col("b.less"), F.lit(0.0)).alias("threshold"), F.coalesce(F.col("b.f1"), F.lit(-1.0)).alias("f1"))


def dist(df: DataFrame, value: str, by: list[str] = ()) -> DataFrame:
    """(by, n, mean, median, p25, p75, min, max); the quartiles are the elements at n // 4 and 3 n // 4."""
    rows = df.select(*by, pinned(F.col(value).cast("double")).alias("score")).where("score IS NOT NULL")
    return _dist(rows.groupBy(*by, "score").agg(F.count(F.lit(1)).alias("c")), by)


def _dist(h: DataFrame, by: list[str]) -> DataFrame:
    """`dist` from (by, score, c)."""
    h = running(h, {"upto": "c"}, by)
    n = h.groupBy(*by).agg(F.sum("c").alias("n"), F.sum(F.col("score") * F.col("c")).alias("s"), F.min("score").alias("min"), F.max("score").alias("max"))
    h = h.join(n, list(by)) if by else h.join(F.broadcast(n))
    at = lambda place: F.max(F.when((F.col("upto") <= place) & (place < F.col("upto") + F.col("c")), F.col("score")))
    n = F.col("n")
    found = h.groupBy(*by, "n", "s", "min", "max").agg(at(F.floor(n / 4)).alias("p25"), at(F.floor(3 * n / 4)).alias("p75"), at(F.floor((n - 1) / 2)).alias("_a"), at(F.floor(n / 2)).alias("_b"))
    return found.select(*by, "n", (F.col("s") / n).alias("mean"), ((F.col("_a") + F.col("_b")) / 2).alias("median"), "p25", "p75", "min", "max")


def medians(df: DataFrame, columns: list[str]) -> dict[str, float]:
    """Each column's median over the values that are there, 0 if there is none: from one histogram of all columns."""
    long = df.select(*[pinned(F.col(c).cast("double")).alias(c) for c in columns]).unpivot([], list(columns), "feature", "score").where("score IS NOT NULL AND NOT isnan(score)")
    found = _dist(long.groupBy("feature", "score").agg(F.count(F.lit(1)).alias("c")), ["feature"])
    return {c: 0.0 for c in columns} | {r.feature: r.median for r in found.select("feature", "median").collect()}  # a row a column


def impute_medians(df: DataFrame, columns: list[str]) -> DataFrame:
    """`df` with missing values as the column's median over present ones, 0 if there is none."""
    found = medians(df, columns)
    return df.withColumns({c: F.coalesce(F.when(~F.isnan(F.col(c).cast("double")), F.col(c)), F.lit(found[c])) for c in columns})


def misclassified(df: DataFrame, key: str, score: str, label: str, threshold: float, text_col: str = "text", limit: int = 15, beside: tuple[str, ...] = ()) -> DataFrame:
    """(kind, rank, key, score, snippet, and the columns `beside`): false positives by falling score, false negatives by rising, at the threshold at
    two digits; the first `limit` of each for a report."""
    t = round(threshold, 2)
    kind = F.when((F.col(label) != 1) & (F.col(score) >= t), "fp").when((F.col(label) == 1) & (F.col(score) < t), "fn")
    wrong = df.select(pinned(kind).alias("kind"), F.col(key), F.col(score).alias("score"), F.substring(text_col, 1, 280).alias("snippet"), *beside).where("kind IS NOT NULL")
    order = F.when(F.col("kind") == "fp", -F.col("score")).otherwise(F.col("score"))
    return wrong.withColumn("rank", F.row_number().over(Window.partitionBy("kind").orderBy(order, key))).where(F.col("rank") <= limit).select("kind", "rank", key, "score", "snippet", *beside)


def drift(df: DataFrame, label: str, metrics: dict[str, bool]) -> DataFrame:
    """(grp, metric, n, median, auc): each machine group against all human rows pooled, for each metric (True where low is
    the machine side). Groups are source, era and model. Rows without a value are left out."""
    human = F.col(label) != 1
    name = F.concat_ws(" · ", F.coalesce("source", F.lit("?")), F.coalesce("era", F.lit("?")), F.when(human, "human").otherwise(F.coalesce("model", F.lit("ai"))))
    long = df.select(name.alias("grp"), F.col(label).alias("_l"), *[pinned(F.col(m).cast("double")).alias(m) for m in metrics]).unpivot(["grp", "_l"], list(metrics), "metric", "value").where("value IS NOT NULL")
    # all below reads this one histogram, which is kept: its groups are joined to the running sum of all human rows, and no human
    # cell is copied to a group
    cells = settled(long.groupBy("grp", "metric", F.col("value").alias("score")).agg(F.count_if(F.col("_l") == 1).alias("pos"), F.count_if(F.col("_l") != 1).alias("neg")))
    median = _dist(cells.select("grp", "metric", "score", (F.col("pos") + F.col("neg")).alias("c")), ["grp", "metric"]).select("grp", "metric", "n", "median")
    pooled = running(cells.groupBy("metric", "score").agg(F.sum("neg").alias("neg")), {"below": "neg"}, ["metric"])
    humans = cells.groupBy("metric").agg(F.sum("neg").alias("n_neg"))
    groups = cells.where("pos > 0").select("grp", "metric", "score", "pos").join(pooled, ["metric", "score"])
    wins = F.sum((F.col("pos") * (2 * F.col("below") + F.col("neg"))).cast("decimal(38,0)")).cast("double")
    found = groups.groupBy("grp", "metric").agg(wins.alias("wins"), F.sum("pos").alias("n_pos")).join(F.broadcast(humans), "metric")  # a row a metric
    a = found.select("grp", "metric", F.try_divide("wins", 2.0 * F.nullif(F.col("n_pos") * F.col("n_neg"), F.lit(0))).alias("auc"))
    low = F.col("metric").isin([m for m, x in metrics.items() if x] or [""])
    return median.join(a, ["grp", "metric"], "left").withColumn("auc", F.when(low, 1 - F.col("auc")).otherwise(F.col("auc")))
