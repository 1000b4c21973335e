"""Where texts and corpora come from, and where results go."""

from __future__ import annotations

import json
import sys

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.corpus import CORPUS_SCHEMA
from ..operators.heuristic import top_issues_column
from .split_csv import read_csv

LL_CACHE_SCHEMA = "id string, features struct<ll_perplexity:double,ll_mean_logprob:double,ll_surprisal_stdev:double,ll_binoculars:double>, ll_perplexity double, ll_mean_logprob double, ll_surprisal_stdev double, ll_binoculars double"

FLAT_COLUMNS = ("id", "source_id", "domain", "model", "decoding", "title", "generation")


def existing(spark: SparkSession, paths: list[str]) -> list[str]:
    """The paths that are there; each missing one is told on stderr. Any file system that Spark knows."""
    jvm, out = spark.sparkContext._jvm, []
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        if path.getFileSystem(conf).globStatus(path):
            out.append(p)
        else:
            print(f"{p}: not found", file=sys.stderr)
    return out


def spread(df: DataFrame) -> DataFrame:
    """`df` over as many partitions as there are cores at least. A small table may be one split, and texts cost more to work on
    than to move. A table of more splits than cores is left as it is, unless one split holds more than twice a core's share of the rows:
    splits follow bytes of files, but a row group falls to one of them whole. Counting them reads footers only."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    splits = df.rdd.getNumPartitions()
    if splits < cores:
        return df.repartition(cores)
    rows = df.select(F.spark_partition_id().alias("split")).groupBy("split").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("most"), F.sum("n").alias("all")).first()
    return df.repartition(splits) if cores > 1 and (rows["most"] or 0) * cores > 2 * (rows["all"] or 0) else df


def read_texts(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(name, text): each file whole. Bytes that aren't UTF-8 become the replacement character."""
    found = existing(spark, paths)
    if not found:
        return spark.createDataFrame([], "name string, text string")
    files = spark.read.format("binaryFile").load(found)
    return files.select(F.col("path").alias("name"), F.expr("make_valid_utf8(cast(content AS STRING))").alias("text"))


def literal_text(spark: SparkSession, text: str, name: str = "<stdin>") -> DataFrame:
    return spark.createDataFrame([(name, text)], "name string, text string")


def read_corpus(spark: SparkSession, paths: list[str], defaults: dict[str, str] | None = None) -> DataFrame:
    """JSON-lines corpora as one frame: blank lines skipped, missing files told, unknown keys dropped."""
    found = existing(spark, paths)
    df = spark.read.schema(CORPUS_SCHEMA).json(found) if found else spark.createDataFrame([], CORPUS_SCHEMA)
    return df.fillna(defaults or {})


def read_layer2(spark: SparkSession, path: str) -> DataFrame:
    """A layer-2 cache (id, four features, seq) from JSON lines, nested or flat; seq orders lines within the cache."""
    df = spark.read.schema(LL_CACHE_SCHEMA).json(path).withColumn("seq", F.struct(F.input_file_name(), F.monotonically_increasing_id()))
    names = ("ll_perplexity", "ll_mean_logprob", "ll_surprisal_stdev", "ll_binoculars")
    return df.select("id", *[F.coalesce(f"features.{n}", n).alias(n) for n in names], "seq")


def read_qa(spark: SparkSession, path: str) -> DataFrame:
    """Questions with human and machine answers; `rec_no` is a hash of the record, so it doesn't follow the file's splits."""
    df = spark.read.schema("question string, human_answers array<string>, chatgpt_answers array<string>").json(path)
    return df.withColumn("rec_no", F.xxhash64("question", "human_answers", "chatgpt_answers"))


def read_flat(spark: SparkSession, path: str) -> DataFrame:
    """A CSV of generations: a header, quoted fields with line ends, fields of any length, in as many tasks as the file has splits."""
    df = read_csv(spark, path)
    return df.select(*[(F.col(n) if n in df.columns else F.lit(None).cast("string")).alias(n) for n in FLAT_COLUMNS])


def result_json(scored: DataFrame, extra: list[str] = ()) -> Column:
    """One text's result as JSON: undefined numbers are null, and the top issues stand beside all signals."""
    names = [*extra, *(c for c in ("score", "verdict", "probability", "low_confidence", "word_count") if c in scored.columns)]
    from ..operators.features import FEATURE_NAMES

    features = F.struct(*[F.when(~F.isnan(n), F.col(n)).alias(n) for n in FEATURE_NAMES]).alias("features")
    return F.to_json(F.struct(*names, features, "signals", "layers", "notes", top_issues_column(F.col("signals")).alias("top_issues")), {"ignoreNullFields": "false"})


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def console_lines(row: dict) -> list[str]:
    """What the command prints for one text: a line of its own for each finding, tab-separated after the name."""
    facts = {"score": row["score"], "verdict": row["verdict"], "probability": row.get("probability"), "words": row["word_count"], "sentence_cv": row["sentence_cv"], "mattr": row["type_token_ratio"]}
    shown = [f"{k}={round(v, 3) if isinstance(v, float) else v}" for k, v in facts.items() if v is not None]
    if row["low_confidence"]:
        shown.append("too short to be sure")
    return ["\t".join([row["name"], *shown]), *(f"\t{k}. {x['name']} adds {x['contribution']}: {x['advice']}" for k, x in enumerate(json.loads(row["top"]), 1))]
