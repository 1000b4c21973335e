"""Corpus steps around scoring: flattening, sampling, splitting, merging.

Random choices are orders by md5 of a key and a seed: the same in any engine, at any partitioning, on any rerun.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.text import WS, word_count

CORPUS_SCHEMA = "id string, text string, label string, domain string, source string, model string, era string, license string, question string, decoding string"


def shuffled(key: Column, seed: int) -> Column:
    return F.md5(F.concat(key.cast("string"), F.lit(f":{seed}")).cast("binary"))


def clean(text: Column) -> Column:
    """White space collapsed to single spaces, none at the ends."""
    return F.trim(F.regexp_replace(text, f"[{WS}]+", " "))


def at_least(df: DataFrame, words: int = 30, text_col: str = "text") -> DataFrame:
    """Rows whose text has at least so many words: the filter on generated texts."""
    return df.where(word_count(F.col(text_col)) >= words)


def union_corpora(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def grouped_split(df: DataFrame, group: str, key: str, test_fraction: float = 0.3, seed: int = 13) -> DataFrame:
    """`df` with `part` ('test' or 'train'): whole groups fall on one side; a row without a group is its own.

    The first floor(groups x fraction) groups in shuffled order are the test part. Their order is found by
    ranges of the hash, whose counts add up, so no task sorts all groups."""
    g = F.coalesce(F.nullif(F.col(group).cast("string"), F.lit("")), F.concat(F.lit("__solo__"), F.col(key).cast("string")))
    rows = df.withColumn("_g", g)
    groups = rows.select("_g").distinct().withColumn("_h", shuffled(F.col("_g"), seed)).withColumn("_bin", F.substring("_h", 1, 2))
    w = Window.partitionBy(F.lit(0)).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)  # 256 rows
    bins = groups.groupBy("_bin").agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0))).withColumn("_all", F.sum("_n").over(Window.partitionBy(F.lit(0))))
    rank = F.row_number().over(Window.partitionBy("_bin").orderBy("_h", "_g")) + F.col("_before")
    parts = groups.join(F.broadcast(bins), "_bin").withColumn("_rank", rank).select("_g", F.when(F.col("_rank") <= F.floor(F.col("_all") * test_fraction), "test").otherwise("train").alias("part"))
    return rows.join(parts, "_g").drop("_g")


def capped(df: DataFrame, keys: list[str | Column], order: Column, tie: str, n: int) -> DataFrame:
    """At most `n` rows for each combination of keys, the first in `order`. Spark limits each partition to n rows a key
    before the shuffle, so a hot key moves little."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(order, tie))).where(F.col("_rank") <= n).drop("_rank")


def balance_sample(df: DataFrame, n: int, seed: int = 13, key: str = "id", keys: tuple[str, ...] = ("source", "label")) -> DataFrame:
    """At most n rows for each source and label, drawn by the seed."""
    return capped(df, [F.coalesce(F.col(keys[0]).cast("string"), F.lit("?")), *keys[1:]], shuffled(F.col(key), seed), key, n)


def merge_scores(rows: DataFrame, cache: DataFrame, key: str = "id", order: str = "seq") -> DataFrame:
    """Rows with the cached features of their key, null where there are none; of several cache rows the last counts."""
    payload = [c for c in cache.columns if c not in (key, order)]
    last = cache.groupBy(key).agg(F.max_by(F.struct(*payload), order).alias("_c"))
    return rows.join(last, key, "left").select(*rows.columns, *[F.col(f"_c.{c}").alias(c) for c in payload])


def flatten_qa(df: DataFrame, domain: str, per_human: int = 1, per_ai: int = 1, min_words: int = 50, limit: int | None = 300, seed: int = 13, order: str = "rec_no") -> DataFrame:
    """Questions with arrays of human and machine answers as corpus rows: cleaned answers of enough words, only questions
    with both, the first few of each side, and at most `limit` questions a domain in shuffled order."""
    def good(c: str) -> Column:
        return F.filter(F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), clean), lambda a: word_count(a) >= min_words)

    q = df.withColumns({"_human": good("human_answers"), "_ai": good("chatgpt_answers"), "_domain": F.col(domain)}).where((F.size("_human") > 0) & (F.size("_ai") > 0))
    if limit:
        q = capped(q, ["_domain"], shuffled(F.col(order), seed), order, limit)
    sides = []
    for side, column, n, model in (("human", "_human", per_human, "human"), ("ai", "_ai", per_ai, "chatgpt-2022")):
        rows = q.select("_domain", order, F.substring(clean(F.coalesce("question", F.lit(""))), 1, 300).alias("question"), F.posexplode(F.slice(column, 1, n)).alias("_j", "text"))
        sides.append(rows.select(F.concat_ws("-", F.lit("hc3"), "_domain", F.col(order).cast("string"), F.lit(side), F.col("_j").cast("string")).alias("id"), "text", F.lit(side).alias("label"), F.col("_domain").alias("domain"), F.lit("HC3").alias("source"), F.lit(model).alias("model"), F.lit("2022").alias("era"), "question"))
    return sides[0].union(sides[1])


# The domains that are English prose, and the models of another era.
KEEP_DOMAINS = ("abstracts", "books", "news", "reddit", "reviews", "wiki")
DROP_MODELS = ("gpt2",)


def sample_cells(df: DataFrame, per_cell: int = 60, min_words: int = 50, max_words: int = 600, seed: int = 13) -> DataFrame:
    """Flat benchmark rows (id, source_id, domain, model, decoding, generation) as a balanced corpus: so many machine rows for each
    domain and model, and as many human rows in all, spread over domains."""
    rows = df.where(F.col("domain").isin(*KEEP_DOMAINS) & ~F.coalesce(F.col("model"), F.lit("")).isin(*DROP_MODELS)).withColumn("text", clean(F.coalesce("generation", F.lit(""))))
    words = word_count(F.col("text"))
    rows = rows.where((words >= min_words) & (words <= max_words)).withColumn("_h", shuffled(F.col("id"), seed))
    ai = capped(rows.where("model <> 'human'"), ["domain", "model"], F.col("_h"), "id", per_cell)
    human = rows.where("model = 'human'")
    # two numbers, so that the ranks below have literal limits and each task passes on so many rows a domain at most
    n_ai, n_domains = ai.count(), human.select("domain").distinct().count()
    share = capped(human, ["domain"], F.col("_h"), "id", max(1, n_ai // max(1, n_domains)))
    # at most one row a domain is over the target, where there are fewer machine rows than domains
    share = share.orderBy("_h", "id").limit(n_ai)
    out = share.select(*rows.columns, F.lit("human").alias("label")).union(ai.select(*rows.columns, F.lit("ai").alias("label")))
    source = F.coalesce(F.nullif(F.col("source_id").cast("string"), F.lit("")), F.col("id").cast("string"))
    return out.select(F.concat_ws("-", F.lit("raid"), "domain", "model", F.col("id").cast("string")).alias("id"), "text", "label", "domain", F.lit("RAID").alias("source"), "model", F.lit("2023-24").alias("era"), F.nullif(F.col("decoding"), F.lit("")).alias("decoding"), F.concat_ws(":", F.lit("raid"), "domain", source).alias("question"))


def counts(df: DataFrame, keys: list[str]) -> DataFrame:
    """(key, value, n) for each value of each key, in one pass."""
    cells = df.select(F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.coalesce(F.col(k).cast("string"), F.lit("?")).alias("value")) for k in keys])).alias("c")).select("c.*")
    return cells.groupBy("key", "value").agg(F.count(F.lit(1)).alias("n"))


def jobs_for(df: DataFrame, number: str, genres: list[str], topics: list[str], seed: int = 13) -> DataFrame:
    """`df` with a genre and a topic for each row: genres in turn by the row's number, topics drawn by the seed."""
    job = F.col(number)
    topic = (F.conv(F.substring(shuffled(job, seed), 1, 8), 16, 10).cast("long") % len(topics)).cast("int")
    turn = F.pmod(job, F.lit(len(genres))).cast("int")
    return df.withColumns({"genre": F.element_at(F.array(*map(F.lit, genres)), turn + 1), "topic": F.element_at(F.array(*map(F.lit, topics)), topic + 1)})


def job_grid(spark, genres: list[str], topics: list[str], n: int, seed: int = 13) -> DataFrame:
    """(job, genre, topic) for n jobs."""
    return jobs_for(spark.range(n).select(F.col("id").alias("job")), "job", genres, topics, seed)


def answers(talk: DataFrame, group: str, turn: str, role: str, text: str, min_words: int = 50, most: int = 3) -> DataFrame:
    """Conversations as questions with arrays of answers, which is what `flatten_qa` takes: (group, question, human_answers, chatgpt_answers).

    The question is the first user turn; answers are the texts of enough words, in order, the first `most` of each side: more than a
    flattening will take aren't gathered, so the arrays are bounded however long a conversation is."""
    rows = talk.select(F.col(group), F.col(turn).alias("_turn"), F.col(role).alias("_role"), F.col(text).alias("_text")).where("_role IN ('user', 'assistant')")
    questions = rows.where("_role = 'user'").groupBy(group).agg(F.min_by("_text", "_turn").alias("question"))
    good = capped(rows.where(word_count(clean(F.col("_text"))) >= min_words), [group, "_role"], F.col("_turn"), "_text", most)
    side = lambda who: F.transform(F.array_sort(F.collect_list(F.when(F.col("_role") == who, F.struct("_turn", "_text")))), lambda x: x["_text"])
    return questions.join(good.groupBy(group).agg(side("user").alias("human_answers"), side("assistant").alias("chatgpt_answers")), group, "left")
