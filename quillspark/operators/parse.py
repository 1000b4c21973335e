"""One parse of each text, which everything else draws from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.lexicons import VOCABULARY

#: What `parse` adds.
COLUMNS = (
    "word_count", "per_1k", "tokens", "sent_lengths", "sentence_count", "cv", "low_confidence", "ttr",
    "n_em", "n_smart", "vocab", "n_not_just", "n_triads", "n_hedges", "n_bridges", "n_commas", "sum_length",
)


def unused(columns: list[str], name: str) -> str:
    """A column name that none of `columns` has, whatever the case."""
    return "_" * (1 + max(map(len, columns), default=0)) + name


def parse(df: DataFrame, text_col: str = "text", vocabulary: list[str] | None = None) -> DataFrame:
    """`df` with the parse columns; all native and within a row. A null text parses as the empty one. Columns named
    like a parse column are replaced; all others pass untouched."""
    patterns, stems = (tx.vocabulary_patterns(vocabulary), tx.vocabulary_stems(vocabulary)) if vocabulary else (tx.VOCABULARY_PATTERNS, tx.VOCABULARY_STEMS)
    own, lowered, blanks, evened, folds, sorted_name, squares_name = (unused(df.columns, c) for c in ("text", "lowered", "spaced", "even", "folded", "numbers", "squares"))
    df = df.withColumn(own, tx.plain(F.col(f"`{text_col}`"))).drop(*(c for c in COLUMNS if c != text_col))
    t, low, spaced, even, fold = F.col(own), F.col(lowered), F.col(blanks), F.col(evened), F.col(folds)
    df = df.withColumns({lowered: F.lower(t), blanks: tx.spaced(t), folds: tx.folded(t)}).withColumn(evened, F.lower(spaced))
    df = df.withColumns({
        "word_count": tx.blank_words(spaced), "tokens": tx.tokens(t, low, fold), "sent_lengths": tx.sentence_lengths(spaced), "n_em": tx.em_dashes(t), "n_smart": tx.smart_quotes(t),
        "n_not_just": tx.not_just(t, low), "n_triads": tx.triads(t, even, fold), "n_hedges": tx.hedges(t, even, fold), "n_bridges": tx.bridges(t, even, fold), "n_commas": tx.count_char(t, ","),
    })
    runs = tx.vocabulary_runs(vocabulary or VOCABULARY)
    hits = tx.vocabulary_hits(low, patterns, [] if runs else stems)
    if runs:
        plainly = tx.lower_hits(low, tx.lower_patterns(vocabulary) if vocabulary else tx.LOWER_PATTERNS)
        hits = F.when(fold, hits).when(tx.may_have(F.col("tokens"), low, runs), plainly).otherwise(F.array().cast("array<string>"))
    df = df.withColumns({"vocab": hits, sorted_name: tx.mattr_numbers(F.col("tokens"))})
    n = F.size("sent_lengths")
    total = F.aggregate("sent_lengths", F.lit(0).cast("long"), lambda a, x: a + x)
    squares = F.aggregate("sent_lengths", F.lit(0).cast("long"), lambda a, x: a + x * x.cast("long"))
    df = df.withColumns({"per_1k": tx.per_1k(F.col("word_count")), "sentence_count": n, "sum_length": total, squares_name: squares, "ttr": tx.mattr(F.col("tokens"), numbers=F.col(sorted_name))})
    # integers under the root: the order of the sentences can't change the result
    spread = F.sqrt((F.col("sentence_count") * F.col(squares_name) - F.col("sum_length") * F.col("sum_length")).cast("double"))
    df = df.withColumn("cv", F.when((F.col("sentence_count") >= 2) & (F.col("sum_length") > 0), spread / F.col("sum_length"))).withColumn("low_confidence", F.col("sentence_count") < 4)
    return df.drop(own, lowered, blanks, evened, folds, sorted_name, squares_name)


def vocab_hits(df: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """(key, term, n, term_no): how often each term occurs in each text, numbered in list order."""
    order = F.array(*map(F.lit, VOCABULARY))
    hits = df.select(F.col(key), tx.pinned(tx.within(F.lower(tx.plain(F.col(text_col))), lambda low: tx.vocabulary_hits(low))).alias("_hits")).select(key, F.explode("_hits").alias("term"))
    return hits.groupBy(key, "term").agg(F.count(F.lit(1)).alias("n")).withColumn("term_no", F.array_position(order, F.col("term")).cast("int"))
