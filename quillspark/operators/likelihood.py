"""Layer 2: likelihood features from a pair of bigram models, fitted and applied by aggregation.

No neural model can run here, so the pair is another family: interpolated bigrams over lower-case words. The
features keep their names, directions and definitions; their values are not comparable with those of a neural
pair, and a combiner for them is trained on them.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx
from ..sources.storage import file_system, fresh_path, remove, settled, small

LL_SCHEMA = ("ll_perplexity", "ll_mean_logprob", "ll_surprisal_stdev", "ll_binoculars")


class Scorer(Protocol):
    """Anything that adds the four likelihood columns to a frame with a text column."""

    def score(self, df: DataFrame, text_col: str = "text") -> DataFrame: ...


def bigrams(df: DataFrame, key: list[str], text_col: str = "text", limit: int | None = None) -> DataFrame:
    """(key, at, prev, word): each word but the first of a text with the one before, up to `limit` words if it is given; in-row,
    without a shuffle."""
    words = tx.tokens(tx.plain(F.col(text_col)))
    if limit:
        words = F.slice(words, 1, limit)
    pairs = df.select(*key, tx.pinned(words).alias("_w")).where(F.size("_w") >= 2)
    shifted = F.arrays_zip(F.slice("_w", 1, F.size("_w") - 1).alias("prev"), F.slice("_w", 2, F.size("_w") - 1).alias("word"))
    return pairs.select(*key, tx.pinned(shifted).alias("_p")).select(*key, F.posexplode("_p").alias("at", "_p")).select(*key, "at", "_p.prev", "_p.word")


@dataclass
class NgramPair:
    """Count tables of the two models, and the constants of smoothing."""

    vocabulary: DataFrame  # word, o (observer's count), p (performer's)
    pairs: DataFrame  # prev, word, o, p
    add: float = 1.0
    share: float = 0.5  # weight of the bigram where its context is known
    _ready: list = field(default_factory=list, repr=False)
    _local: list = field(default_factory=list, repr=False)

    @classmethod
    def fit(cls, observer: DataFrame, performer: DataFrame, text_col: str = "text", add: float = 1.0, share: float = 0.5) -> NgramPair:
        """Counts over whole texts, computed here and now. One pass a table: both models are the same aggregate with conditions."""
        both = observer.select(F.col(text_col).alias("text"), F.lit(1).alias("o")).union(performer.select(F.col(text_col).alias("text"), F.lit(0).alias("o")))
        count = [F.sum("o").alias("o"), F.sum(1 - F.col("o")).alias("p")]
        words = both.select("o", F.explode(tx.tokens(tx.plain(F.col("text")))).alias("word"))
        return cls(settled(words.groupBy("word").agg(*count)), settled(bigrams(both, ["o"], "text").groupBy("prev", "word").agg(*count)), add, share)

    @classmethod
    def fit_halves(cls, corpus: DataFrame, text_col: str = "text", **how) -> NgramPair:
        """Both models from one corpus, each from the half that a hash of the text deals it."""
        side = F.pmod(F.xxhash64(F.col(text_col)), F.lit(2))
        return cls.fit(corpus.where(side == 0), corpus.where(side == 1), text_col, **how)

    def _tables(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Unigram probabilities; pair probabilities; and for each context what scoring needs of it. Once a model."""
        if not self._ready:
            tables = [settled(t) for t in self._computed()]
            self._ready = [small(t) for t in tables]
            self._local = [all(a is not b for a, b in zip(tables, self._ready))]  # all three are broadcast
        return tuple(self._ready)

    def _computed(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        lam, k = self.share, self.add
        totals = self.vocabulary.agg(F.sum("o").alias("no"), F.sum("p").alias("np"), F.count(F.lit(1)).alias("v"))
        # one row; the size of the vocabulary counts unknown words as one more
        uni = self.vocabulary.join(F.broadcast(totals)).select("word", ((F.col("o") + k) / (F.col("no") + k * (F.col("v") + 1))).alias("uo"), ((F.col("p") + k) / (F.col("np") + k * (F.col("v") + 1))).alias("up"))
        base = self._constants(uni)
        context = self.pairs.groupBy("prev").agg(F.sum("o").alias("co"), F.sum("p").alias("cp"))
        pairs = self.pairs.join(context, "prev").join(uni, "word")
        floor = F.when(F.col("co") > 0, F.lit(1 - lam)).otherwise(F.lit(1.0)) * F.col("uo")
        po = F.when(F.col("co") > 0, lam * F.col("o") / F.col("co")).otherwise(F.lit(0.0)) + floor
        pairs = pairs.withColumns({"lo": -F.log(po), "l0": -F.log(floor)})
        # the performer's expectation of the observer's surprise: that of unigrams for all words, corrected at known pairs
        known = F.when(F.col("cp") > 0, F.lit(1 - lam)).otherwise(F.lit(1.0))
        seen = pairs.groupBy("prev", "co", "cp").agg(
            F.sum(F.when(F.col("cp") > 0, lam * F.col("p") / F.col("cp")).otherwise(F.lit(0.0)) * F.col("lo")).alias("direct"),
            F.sum(F.col("up") * (F.col("lo") - F.col("l0"))).alias("shift"))
        shift = F.when(F.col("co") > 0, -F.log(F.lit(1 - lam))).otherwise(F.lit(0.0))
        contexts = seen.join(F.broadcast(base)).select("prev", "co", (F.col("direct") + known * (F.col("base") + shift + F.col("shift"))).alias("xent"))
        return uni, pairs.select("prev", "word", "lo"), contexts

    def score(self, df: DataFrame, text_col: str = "text") -> DataFrame:
        """`df` with the four features, null for texts of fewer than two words.

        They are functions of the text, so rows need no id: equal texts are scored together. Tables of a checked size are broadcast;
        then a text's occurrences stay in their task, which sends one row of sums. With larger tables they are first summed to
        (text, prev, word), so joins carry each pair of a text once."""
        uni, pairs, contexts = self._tables()
        lam, key = self.share, ["_text_a", "_text_b"]
        text = F.col(f"`{text_col}`")
        df = df.drop(*LL_SCHEMA).withColumns({"_text_a": F.xxhash64(text), "_text_b": F.xxhash64(F.lit(7), text)})
        spots = bigrams(df, key, text_col)
        spots = spots.select(*key, "prev", "word", F.lit(1).alias("n")) if self._local[0] else spots.groupBy(*key, "prev", "word").agg(F.count(F.lit(1)).alias("n"))
        constants = self._constants(uni)
        x = spots.join(pairs, ["prev", "word"], "left").join(contexts, "prev", "left").join(uni.select("word", "uo"), "word", "left").join(F.broadcast(constants))
        floor = F.when(F.coalesce("co", F.lit(0)) > 0, F.lit(1 - lam)).otherwise(F.lit(1.0)) * F.coalesce("uo", "xo")
        x = x.withColumn("nll", F.coalesce("lo", -F.log(floor))).withColumn("xe", F.coalesce("xent", "base"))
        n = F.sum("n")
        sums = x.groupBy(*key).agg(n.alias("n"), F.sum(F.col("n") * F.col("nll")).alias("s"), F.sum(F.col("n") * F.col("nll") * F.col("nll")).alias("q"), F.sum(F.col("n") * F.col("xe")).alias("e"))
        mean = F.col("s") / F.col("n")
        found = sums.select(*key, F.exp(F.least(mean, F.lit(50.0))).alias("ll_perplexity"), (-mean).alias("ll_mean_logprob"), F.sqrt(F.greatest(F.col("q") / F.col("n") - mean * mean, F.lit(0.0))).alias("ll_surprisal_stdev"), F.when(F.col("e") / F.col("n") > 1e-6, F.col("s") / F.col("e")).alias("ll_binoculars"))
        return df.join(found, key, "left").drop(*key)

    def _constants(self, uni: DataFrame) -> DataFrame:
        k = self.add
        totals = self.vocabulary.agg(F.sum("o").alias("no"), F.sum("p").alias("np"), F.count(F.lit(1)).alias("v"))
        unknown = totals.select((k / (F.col("no") + k * (F.col("v") + 1))).alias("xo"), (k / (F.col("np") + k * (F.col("v") + 1))).alias("xp"))
        return uni.agg(F.sum(F.col("up") * -F.log("uo")).alias("b")).join(unknown).select("xo", (F.coalesce("b", F.lit(0.0)) + F.col("xp") * -F.log("xo")).alias("base"))


_loaded: dict[str, Callable] = {}  # one a worker process and name


@dataclass
class BatchScorer:
    """Any model that scores lists of texts, over Arrow batches.

    `load` gives the model, once a worker process and `name`: a function from a list of texts to a tuple of the four features
    (or None) for each. Texts go to it in lists of `size`; blank ones and those of one word don't. A list holds texts of
    one Arrow batch only, and the results must not depend on what else is in it. With `max_words` a text ends after so many
    words for the model, which may have a window of its own."""

    name: str
    load: Callable[[], Callable[[list[str]], list[tuple | None]]]
    size: int = 16
    max_words: int | None = None

    def score(self, df: DataFrame, text_col: str = "text") -> DataFrame:
        df = df.drop(*LL_SCHEMA)
        schema = T.StructType([*df.schema.fields, *(T.StructField(c, T.DoubleType()) for c in LL_SCHEMA)])
        text_at, name, load, size = df.columns.index(text_col), self.name, self.load, self.size
        head = re.compile(rf"(?:\s*\S+){{1,{self.max_words}}}") if self.max_words else None

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if name not in _loaded:
                    _loaded[name] = load()
                texts = b.column(text_at).to_pylist()
                if head:
                    texts = [m.group() if t and (m := head.match(t)) else t for t in texts]
                found: list[tuple | None] = [None] * len(texts)
                # those of like length together, so that a model pads little
                wanted = sorted((i for i, t in enumerate(texts) if t and len(t.split()) > 1), key=lambda i: len(texts[i]))
                for at in range(0, len(wanted), size):
                    some = wanted[at : at + size]
                    for i, values in zip(some, _loaded[name]([texts[i] for i in some]), strict=True):
                        found[i] = values
                added = [pa.array([None if f is None else f[k] for f in found], pa.float64()) for k in range(len(LL_SCHEMA))]
                yield pa.RecordBatch.from_arrays([*b.columns, *added], names=schema.names)

        return df.mapInArrow(run, schema)


def resume(df: DataFrame, done: DataFrame, key: str = "id") -> DataFrame:
    """The rows of `df` whose key the cache `done` doesn't have."""
    return df.join(done.select(key).distinct(), key, "left_anti")


# ------------------------------------------------------------------ cache

def committed(spark: SparkSession, cache: str) -> list[str]:
    """The waves of a cache that were written to their end, in order. Spark's marker is what says so: it is the last file of a write."""
    fs, pattern = file_system(spark, f"{cache.rstrip('/')}/run=*/wave=*/_SUCCESS")
    return sorted(x.getPath().getParent().toString() for x in fs.globStatus(pattern) or [])


def read_cache(spark: SparkSession, cache: str, schema: str | T.StructType) -> DataFrame:
    """The rows of a cache's committed waves; none if there is no cache yet."""
    found = committed(spark, cache)
    return spark.read.schema(schema).parquet(*found) if found else spark.createDataFrame([], schema)


def score_pending(df: DataFrame, scorer: Scorer, cache: str, key: str = "id", text_col: str = "text", wave_rows: int = 100_000) -> DataFrame:
    """Score what the cache lacks in waves of about `wave_rows` rows, each of which is kept as soon as it is written, and give the whole cache.

    The run may stop at any point: what a rerun finds committed it doesn't score again, and a wave that was being written
    counts for nothing. Pending rows are first written dealt to waves by a hash of their key, so each wave reads its own
    rows only. A wave's folder is named by run and wave, and a run takes the first number above all that are there, committed or not; so no
    two writes meet in a folder. Rows with the same key are scored once; a null key is one key. One run at a time may write to a cache."""
    spark = df.sparkSession
    schema = T.StructType([df.schema[key], *(T.StructField(c, T.DoubleType()) for c in LL_SCHEMA)])
    done = read_cache(spark, cache, schema).select(F.col(f"`{key}`").alias("_done"))
    rows = df.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{text_col}`").cast("string").alias("_text"))
    pending = rows.join(done, F.col("_key").eqNullSafe(F.col("_done")), "left_anti")
    n = pending.select("_key").distinct().count()
    if not n:
        return read_cache(spark, cache, schema)
    waves = -(-n // wave_rows)
    staged_at, run = fresh_path(spark, "pending"), _next_run(spark, cache)
    once = pending.groupBy("_key").agg(F.min("_text").alias("_text")).withColumn("_wave", F.pmod(F.xxhash64("_key"), F.lit(waves)).cast("int"))
    once.repartition("_wave", F.pmod(F.hash("_key"), F.lit(_parts(spark, waves)))).write.partitionBy("_wave").parquet(staged_at)
    try:
        staged = spark.read.schema(once.schema).parquet(staged_at)
        for wave in range(waves):
            some = staged.where(F.col("_wave") == wave).select(F.col("_key").alias(key), F.col("_text").alias(text_col))
            scorer.score(some, text_col).select(key, *LL_SCHEMA).write.parquet(f"{cache.rstrip('/')}/run={run:06d}/wave={wave:06d}")
    finally:
        remove(spark, staged_at)
    return read_cache(spark, cache, schema)


def _parts(spark: SparkSession, waves: int) -> int:
    """How many files a wave is staged in: as many as there are tasks for it."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // waves)


def _next_run(spark: SparkSession, cache: str) -> int:
    fs, pattern = file_system(spark, f"{cache.rstrip('/')}/run=*")
    return 1 + max((int(x.getPath().getName().removeprefix("run=")) for x in fs.globStatus(pattern) or []), default=0)
