"""Quality rules as a short-circuit cascade, all in native expressions.

Each rule rejects a document by a count of its text. On a random sample of bounded size the cascade measures what
every rule costs, as processor time of executors with the code compiled and the cost of an empty rule taken off, and
how much it rejects; then it orders the rules by rejection per cost. A rule is evaluated only for documents that no
rule before it rejected: CASE WHEN stops at the first that does (`judge`), or each rule filters what the next one sees
(`keep`). The verdict is the same in any order, so the order (and the sample) changes the time and never the result.

Defined results: a null text has no words and is rejected by `base`; empty and very long texts are judged
whole; repeated rows are judged alike; an empty table stays empty; other columns pass through untouched, and a column whose name a result
needs is replaced.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, words

SYMBOLS = "#*$%&|<>"
BASE_COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
RESULTS = (*BASE_COLUMNS, "n_lines", "base_failed", "rejected_by", "kept")


def symbol_count(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"[^#*$%&|<>]++", "")).cast("long")


def word_characters(text: Column) -> Column:
    return F.length(F.regexp_replace(text, f"[{SPACE_CLASS}]++", "")).cast("long")


def _worded_lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{SPACE_CLASS}]"))


def repeated_words(df: DataFrame, words_col: str, out: str) -> DataFrame:
    """Add the number of words that a 3-word window found at least twice in the document covers.

    Windows are hashed into an array of longs whose distinct count tells most documents apart at once; only
    documents with a repeat sort (hash, position) pairs: n log n in the document's words, in one row.
    """
    w = F.col(words_col)
    df = df.withColumn("_grams", F.when(F.size(w) < 3, F.array().cast("array<bigint>")).otherwise(F.zip_with(F.zip_with(w, F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(1))), lambda a, b: F.struct(a.alias("a"), b.alias("b"))), F.slice(w, 3, F.greatest(F.size(w) - 2, F.lit(1))), lambda p, c: F.xxhash64(p["a"], p["b"], c))))
    df = df.withColumn("_grams", F.slice("_grams", 1, F.greatest(F.size(w) - 2, F.lit(0))))
    # position k of the sorted pairs repeats if a neighbour has its hash
    df = df.withColumn("_pairs", F.when(F.size(F.array_distinct("_grams")) < F.size("_grams"), F.sort_array(F.transform("_grams", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))))
    df = df.withColumn("_last", F.slice(F.concat(F.array(F.lit(None).cast("struct<g:bigint,i:int>")), F.col("_pairs")), 1, F.size("_pairs")))
    df = df.withColumn("_next", F.slice("_pairs", 2, F.greatest(F.size("_pairs") - 1, F.lit(0))))
    near = F.zip_with(F.zip_with("_pairs", "_last", lambda p, q: F.struct(p["g"].alias("g"), p["i"].alias("i"), q["g"].alias("l"))), "_next", lambda p, q: F.when(p["g"].eqNullSafe(p["l"]) | p["g"].eqNullSafe(q["g"]), p["i"]))
    df = df.withColumn("_at", F.sort_array(F.filter(near, lambda x: x.isNotNull())))
    # a window adds the words that the one before it did not cover
    covered = F.aggregate("_at", F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")), lambda acc, x: F.struct((acc["n"] + F.least(F.lit(3), x - acc["last"])).alias("n"), x.alias("last")), lambda acc: acc["n"].cast("long"))
    return df.withColumn(out, F.coalesce(covered, F.lit(0).cast("long"))).drop("_grams", "_pairs", "_last", "_next", "_at")


TEXT = "_quality_text"  # the text, empty for null, where rules are evaluated


@dataclass(frozen=True)
class Rule:
    """`fails` is SQL over the base columns that `needs` lists and over TEXT; integers only, so any engine agrees."""

    name: str
    needs: tuple[str, ...]
    fails: str


def _length_without(pattern: str) -> str:
    """SQL for how many characters TEXT has without what the pattern matches."""
    return f"length(regexp_replace({TEXT}, r'{pattern}', ''))"


BASE = Rule("base", ("n_words", "n_repeat_words"), "n_words < 50 OR 100 * n_repeat_words > 50 * n_words")
#: Word length from 2 to 16 on the whole, at most one symbol for four words, at most 60 % repeated lines; of the characters in words at most
#: 30 % digits, at least half letters (ASCII ones, or any character beyond), at most 70 % ASCII capitals, at most 20 % in words of 40 and
#: more, at most 10 % in leaders (four and more of the same mark); at most half the lines cut off by dots, at most 90 % bullets.
RULES = (
    Rule("word_length", ("n_words", "word_chars"), "word_chars < 2 * n_words OR word_chars > 16 * n_words"),
    Rule("symbols", ("n_words", "n_symbols"), "4 * n_symbols > n_words"),
    Rule("repeated_lines", ("n_dup_lines",), "5 * n_dup_lines > 3 * n_lines"),
    Rule("digits", ("word_chars",), f"10 * {_length_without('[^0-9]++')} > 3 * word_chars"),
    Rule("letters", ("word_chars",), f"2 * (length({TEXT}) - {_length_without('[A-Za-z\\x{80}-\\x{10FFFF}]++')}) < word_chars"),
    Rule("capitals", ("word_chars",), f"10 * {_length_without('[^A-Z]++')} > 7 * word_chars"),
    Rule("long_words", ("word_chars",), f"5 * (length({TEXT}) - {_length_without(f'(?<![^{SPACE_CLASS}])[^{SPACE_CLASS}]{{40,}}+')}) > word_chars"),
    Rule("leaders", ("word_chars",), f"10 * (length({TEXT}) - {_length_without('([.=~!?_-])\\1{3,}+')}) > word_chars"),
    Rule("cut_lines", ("n_dup_lines",), rf"2 * regexp_count({TEXT}, r'(?:[.][.][.]|…)[\x20\x09]*+(?:\n|\z)') > n_lines"),
    Rule("bullets", ("n_dup_lines",), rf"10 * regexp_count({TEXT}, r'(?:\A|\n)[\x20\x09]*+[-*•–][\x20\x09]') > 9 * n_lines"),
)


@dataclass
class Cascade:
    """Rules in the order in which they run, with (seconds, share rejected) that the sample showed of each."""

    rules: tuple[Rule, ...]
    measured: dict[str, tuple[float, float]] = field(default_factory=dict)

    def rejected_by(self) -> Column:
        """The name of the first rule that rejects, null if none does; no rule after it is evaluated."""
        chain = None
        for r in self.rules:
            chain = F.when(F.expr(r.fails), F.lit(r.name)) if chain is None else chain.when(F.expr(r.fails), F.lit(r.name))
        return chain

    def evaluations(self, judged: DataFrame) -> dict[str, int]:
        """How many documents each rule was evaluated for, from the column rejected_by."""
        stopped = {r.rejected_by: r["count"] for r in judged.groupBy("rejected_by").count().collect()}  # a row a rule
        left, out = sum(stopped.values()), {}
        for r in self.rules:
            out[r.name] = left
            left -= stopped.get(r.name, 0)
        return out


def measures(df: DataFrame, text_col: str = "text", only: tuple[str, ...] = BASE_COLUMNS) -> DataFrame:
    """`df` with the base columns of `only`, and `n_lines` (lines with a word) with `n_dup_lines`."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    df = df.drop(*only)
    if {"n_words", "n_repeat_words"} & set(only):
        df = df.withColumn("_words", words(F.col(text_col)))
    if "n_words" in only:
        df = df.withColumn("n_words", F.size("_words").cast("long"))
    if "word_chars" in only:
        df = df.withColumn("word_chars", word_characters(text))
    if "n_symbols" in only:
        df = df.withColumn("n_symbols", symbol_count(text))
    if "n_dup_lines" in only:
        df = df.withColumn("_lines", _worded_lines(text)).withColumn("n_lines", F.size("_lines").cast("long"))
        df = df.withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
    if "n_repeat_words" in only:
        df = repeated_words(df, "_words", "n_repeat_words")
    return df.drop("_words", "_lines")


def passing(df: DataFrame, rule: Rule) -> DataFrame:
    """The rows that `rule` doesn't reject. The row id keeps the optimiser from moving the condition below
    the projection, where it would compute each count once for every mention."""
    return df.withColumn("_row_id", F.monotonically_increasing_id()).where((F.col("_row_id") >= 0) & ~F.expr(rule.fails)).drop("_row_id")


def _executor_seconds(df: DataFrame) -> tuple[float, list]:
    """Processor time that executors spent on `df`, and its rows."""
    context = df.sparkSession.sparkContext
    group, before = f"quillspark-{uuid.uuid4().hex}", context.getLocalProperty("spark.jobGroup.id")
    context.setLocalProperty("spark.jobGroup.id", group)
    try:
        rows = df.collect()
    finally:
        context.setLocalProperty("spark.jobGroup.id", before)
    jvm = context._jsc.sc()
    jvm.listenerBus().waitUntilEmpty()
    tracker, store, nanos = context.statusTracker(), jvm.statusStore(), 0
    for job in tracker.getJobIdsForGroup(group):
        for stage in tracker.getJobInfo(job).stageIds:
            if tracker.getStageInfo(stage) is not None:  # None: skipped, as its shuffle was there
                nanos += store.lastStageAttempt(stage).executorCpuTime()
    return nanos / 1e9, rows


def estimate(df: DataFrame, rules: tuple[Rule, ...] = (BASE, *RULES), text_col: str = "text", sample_rows: int = 500, measured: bool = False) -> Cascade:
    """Order `rules` by rejection per cost on a random sample of about `sample_rows` rows, twice as many at most.

    With `measured` the base columns stand there already, as in `judge`; else a rule's cost includes the columns that it
    needs, as in `keep`. The sample only orders the rules: every row meets every rule until one rejects it."""
    n = df.count()
    some = df.select(F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    if n > sample_rows:
        some = some.sample(min(1.0, 1.2 * sample_rows / n), seed=13)
    sample = some.limit(2 * sample_rows).coalesce(1)
    sample = (measures(sample) if measured else sample).withColumn(TEXT, F.col("text")).cache()
    size = max(1, sample.count())

    def cost(rule: Rule) -> tuple[float, int]:
        of = sample if measured else measures(sample, only=rule.needs)
        job = of.select(F.expr(rule.fails).alias("fails")).agg(F.count_if("fails").alias("n"))
        _executor_seconds(job)  # compiles the code
        spent, rows = zip(*(_executor_seconds(job) for _ in range(2)))
        return min(spent), rows[0][0].n

    empty = cost(Rule("empty", (), f"length({TEXT}) < 0"))[0]
    found = {}
    for r in rules:
        seconds, rejected = cost(r)
        found[r.name] = (max(seconds - empty, 1e-6), rejected / size)
    sample.unpersist()
    return Cascade(tuple(sorted(rules, key=lambda r: (-found[r.name][1] / found[r.name][0], found[r.name][0], r.name))), found)


def judge(df: DataFrame, cascade: Cascade | None = None, text_col: str = "text") -> DataFrame:
    """`df` with the base columns, base_failed, kept and the rule that rejected (rejected_by)."""
    cascade = cascade or Cascade((BASE, *RULES))
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in RESULTS])
    out = measures(df.select(row.alias("_row"), F.col(f"`{text_col}`").alias("text")), "text")
    out = out.withColumn(TEXT, F.coalesce("text", F.lit("")))
    out = out.withColumn("base_failed", F.expr(BASE.fails)).withColumn("rejected_by", cascade.rejected_by())
    return out.withColumn("kept", ~F.col("base_failed") & F.col("rejected_by").isNull()).select("_row.*", *RESULTS)


def keep(df: DataFrame, text_col: str = "text", sample_rows: int = 500) -> DataFrame:
    """The rows of `df` that no rule rejects, with the columns of `df`.

    Here the cascade is a chain of filters: a count is only taken of rows that all rules before it let pass.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    left = df.select(row.alias("_row"), F.col(f"`{text_col}`").alias("text")).withColumn(TEXT, F.coalesce("text", F.lit("")))
    have: set[str] = set()
    for rule in estimate(df, text_col=text_col, sample_rows=sample_rows).rules:
        left = passing(measures(left, only=tuple(c for c in rule.needs if c not in have)), rule)
        have |= set(rule.needs)
    return left.select("_row.*")
