"""Flags on scored texts, and the one decision that a build gate takes from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lexicons import MIN_RELIABLE_WORDS


def flagged(df: DataFrame, threshold: float = 3.0, prob: float = 0.5) -> Column:
    """Never below 20 words; by the rounded probability where there is one, else by the rounded score."""
    by_score = F.col("score") >= threshold
    hit = F.when(F.col("probability").isNotNull(), F.col("probability") >= prob).otherwise(by_score) if "probability" in df.columns else by_score
    return F.when(F.col("word_count") < MIN_RELIABLE_WORDS, F.lit(False)).otherwise(hit)


def gate(df: DataFrame, threshold: float = 3.0, prob: float = 0.5) -> DataFrame:
    """`df` with flagged."""
    return df.withColumn("flagged", flagged(df, threshold, prob))


def exit_code(gated: DataFrame) -> int:
    """1 if any text is flagged, else 0: one aggregate row reaches the driver."""
    return int(bool(gated.agg(F.coalesce(F.bool_or("flagged"), F.lit(False))).first()[0]))
