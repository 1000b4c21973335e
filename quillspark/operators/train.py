"""Fitting and evaluating the combiner on a scored corpus."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.storage import settled
from . import stats
from .combine import COMBINER_FEATURES, predict


def gram_sums(rows: DataFrame, beta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """The logistic loss, its gradient and its Hessian at `beta` (intercept first) over rows (label, z): one pass, in which a task
    sends the sums of its own rows. What reaches the driver grows with the square of the features."""
    k = len(beta)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(1 + k + k * k)
        for b in batches:
            y = b.column(0).to_numpy()
            z = np.column_stack([np.ones(len(y)), b.column(1).flatten().to_numpy().reshape(len(y), -1)])
            m = z @ beta
            p = 1 / (1 + np.exp(-np.clip(m, -500, 500)))
            sums += np.concatenate(([(np.logaddexp(0, m) - y * m).sum()], z.T @ (p - y), ((z * (p * (1 - p))[:, None]).T @ z).ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(sums)), pa.int32()), pa.array(sums)], names=["i", "v"])

    out = np.zeros(1 + k + k * k)
    for r in rows.mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
        out[r.i] = r.v
    return float(out[0]), out[1 : 1 + k], out[1 + k :].reshape(k, k)


def newton(rows: DataFrame, k: int, c: float, steps: int) -> np.ndarray:
    """The intercept and k coefficients that minimise 1/2 |w|^2 + c x loss, the intercept free of penalty. Each step is one pass; a step that
    doesn't make it smaller is halved."""
    free = np.r_[0.0, np.ones(k)]
    beta, delta, best = np.zeros(k + 1), np.zeros(k + 1), np.inf
    for _ in range(steps + 1):
        loss, g, h = gram_sums(rows, beta + delta)
        now = c * loss + 0.5 * float(free @ (beta + delta) ** 2)
        if now > best + 1e-9 * abs(best):
            delta = delta / 2
            continue
        beta, best = beta + delta, now
        delta = -np.linalg.solve(c * h + np.diag(free), c * g + free * beta)
        if np.abs(delta).max() < 1e-13:
            break
    return beta


def train(df: DataFrame, label: str = "label", names: list[str] | None = None, c: float = 1.0, clip: float = 6.0, steps: int = 12, meta: dict | None = None) -> dict:
    """A combiner model from rows with feature columns and a 0/1 label.

    Missing values become the column's median (0 if there is none); features are standardised by the population
    deviation (0 counts as 1) and clipped. The penalty is the usual 1/2 |w|^2 + c x loss; Newton's method needs a few steps, each of which
    is one aggregate over the rows. Both labels have to be there."""
    names = names or COMBINER_FEATURES
    x = df.select(F.col(label).cast("double").alias("label"), *[F.when(F.isnan(F.col(n).cast("double")), None).otherwise(F.col(n).cast("double")).alias(n) for n in names]).where("label IS NOT NULL")
    medians = stats.medians(x, names)
    x = x.fillna({n: medians[n] for n in names})
    numbers = x.agg(F.count(F.lit(1)).alias("_n"), F.count_if(F.col("label") == 1).alias("_pos"), *[f(n).alias(f"{n}_{k}") for n in names for k, f in (("mean", F.avg), ("std", F.stddev_pop))]).first()
    n = numbers["_n"]
    if not 0 < numbers["_pos"] < n:
        raise ValueError("no rows to train on" if not n else "rows of one label only")
    mean, std = [numbers[f"{k}_mean"] for k in names], [numbers[f"{k}_std"] or 1.0 for k in names]
    z = [F.greatest(F.lit(-clip), F.least(F.lit(clip), (F.col(k) - m) / s)) for k, m, s in zip(names, mean, std)]
    beta = newton(settled(x.select("label", F.array(*z).alias("z"))), len(names), c, steps)
    return {"features": list(names), "mean": mean, "std": std, "coef": beta[1:].tolist(), "intercept": float(beta[0]), "impute": {k: medians[k] for k in names}, "clip": clip, "meta": {"name": "lr-stylo+likelihood", "C": c, "n_train": n} | (meta or {})}


def evaluate_model(test: DataFrame, model: dict, label: str = "label", by: list[str] = ()) -> DataFrame:
    """(by, which, n_pos, n_neg, auc) of the combiner and of the layer-1 score on held-out rows."""
    p = predict(test, model).select(*by, F.col(label).alias("_l"), F.explode(F.array(F.struct(F.lit("combiner").alias("which"), F.col("prob_raw").alias("s")), F.struct(F.lit("heuristic").alias("which"), F.col("score").cast("double").alias("s")))).alias("e")).select(*by, "_l", "e.*")
    return stats.auc(p, "s", "_l", [*by, "which"])


def top_coefficients(model: dict, k: int = 12) -> list[tuple[str, float]]:
    return sorted(zip(model["features"], model["coef"]), key=lambda x: -abs(x[1]))[:k]
