"""CSV with line ends inside quotes, read in as many tasks as a file has splits.

Spark reads such files with `multiLine`, which gives a file to one task. Here the file is read as lines, which splits
at any byte range, and what a range can't see alone, whether it begins inside quotes, is found from all ranges before it:

1. A range counts its quotes. Their running sum over the file's ranges, odd or even, says where the range begins. There is one
   such row a range, not a line.
2. Within a range, a line begins a record if an even number of quotes stands before it. Lines are joined to records; the lines before a
   range's first record belong to the last record of an earlier range, and join it.
3. Records are parsed by Spark's own CSV functions.

Lines move once, to stay in order within their range; a range is no larger than `spark.sql.files.maxPartitionBytes`. A field may span any
number of ranges; a record has to fit a task. Compressed files can't be split and are one range each.

Quotes are doubled within quoted fields. A quote in the middle of a field that doesn't begin with one is beyond this format: Spark takes
it as it is, here it counts as any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

RANGE = ["_file", "_start"]


def _odd(quotes: Column) -> Column:
    return F.pmod(quotes, F.lit(2)) == 1


def _joined(lines: str, order: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, lines))), lambda x: x[lines]), "\n")


def csv_records(spark: SparkSession, paths: str | list[str], quote: str = '"') -> DataFrame:
    """(file, start, at, record): the text of each record, header included, with the byte range that it begins in and its
    place there. Blank lines between records are no records. In a file whose first line ends in CR and LF, each such pair
    counts as a line end and reads as LF, within quotes too, which is what Spark's own reader makes of it."""
    lines = spark.read.option("lineSep", "\n").text(paths).select(
        F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_at"), F.col("value").alias("_line"), F.endswith("value", F.lit("\r")).alias("_returned"))
    lines = lines.withColumn("_quotes", F.length("_line") - F.length(F.replace("_line", F.lit(quote), F.lit(""))))
    inner = Window.partitionBy(*RANGE).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    lines = lines.withColumn("_before", F.coalesce(F.sum("_quotes").over(inner), F.lit(0)))

    # a row a range: is it entered inside quotes, and which record is open there
    last = lambda odd: F.max(F.when(_odd(F.col("_before")) == F.lit(odd), F.col("_at")))
    ranges = lines.groupBy(*RANGE).agg(F.sum("_quotes").alias("_n"), last(False).alias("_if_even"), last(True).alias("_if_odd"), F.min_by("_returned", "_at").alias("_crlf"))
    earlier = Window.partitionBy("_file").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("_inside", _odd(F.coalesce(F.sum("_n").over(earlier), F.lit(0))))
    ranges = ranges.withColumn("_last", F.when(F.col("_inside"), F.col("_if_odd")).otherwise(F.col("_if_even")))
    opened = F.when(F.col("_last").isNotNull(), F.struct("_start", "_last"))
    crlf = F.first("_crlf").over(Window.partitionBy("_file").orderBy("_start"))
    ranges = ranges.select(*RANGE, "_inside", F.last(opened, ignorenulls=True).over(earlier).alias("_open"), crlf.alias("_crlf"))

    lines = lines.join(ranges, RANGE)
    begins = _odd(F.col("_before")) == F.col("_inside")
    upto = Window.partitionBy(*RANGE).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("_record", F.max(F.when(begins, F.col("_at"))).over(upto))
    whole = lines.where("_record IS NOT NULL").groupBy(*RANGE, "_record").agg(_joined("_line", "_at").alias("_text"), F.first("_crlf").alias("_crlf"))
    # what stands before a range's first record, a row a range, goes to the record that is open there
    rest = lines.where("_record IS NULL").groupBy(*RANGE).agg(_joined("_line", "_at").alias("_text"), F.first("_open").alias("_open"))
    rest = rest.groupBy("_file", F.col("_open._start").alias("_start"), F.col("_open._last").alias("_record")).agg(_joined("_text", "_start").alias("_more"))
    found = whole.join(rest, [*RANGE, "_record"], "left").select(*RANGE, "_record", "_crlf", F.concat("_text", F.coalesce(F.concat(F.lit("\n"), "_more"), F.lit(""))).alias("_text"))
    record = F.when(F.col("_crlf"), F.replace(F.regexp_replace("_text", "\r\\z", ""), F.lit("\r\n"), F.lit("\n"))).otherwise(F.col("_text"))
    record = F.when(F.col("_start") == 0, F.regexp_replace(record, "^\ufeff", "")).otherwise(record)
    return found.select(F.col("_file").alias("file"), F.col("_start").alias("start"), F.col("_record").alias("at"), record.alias("record")).where("record <> ''")


def read_csv(spark: SparkSession, paths: str | list[str], header: bool = True, schema: str | T.StructType | None = None, sep: str = ",", quote: str = '"') -> DataFrame:
    """CSV files as strings, or as `schema` has them. With a header, columns are named as in the first file, as Spark's own reader does, and
    each file's first record is left out; without it they are _c0, _c1, ..."""
    if schema is None:
        named = spark.read.option("header", header).option("multiLine", True).option("escape", quote).option("quote", quote).option("sep", sep).csv(paths)
        schema = T.StructType([T.StructField(c, T.StringType()) for c in named.columns])  # reads the first record
    elif isinstance(schema, str):
        schema = T._parse_datatype_string(schema)
    records = csv_records(spark, paths, quote)
    if header:
        first = records.where("start = 0").groupBy("file").agg(F.min("at").alias("at"))
        records = records.join(F.broadcast(first.withColumn("start", F.lit(0).cast("long"))), ["file", "start", "at"], "left_anti")
    options = {"sep": sep, "quote": quote, "escape": quote, "multiLine": "true", "maxCharsPerColumn": "-1", "mode": "PERMISSIVE"}
    return records.select(F.from_csv("record", _ddl(schema), options).alias("_r")).select("_r.*")


def _ddl(schema: T.StructType) -> str:
    return ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in schema)
