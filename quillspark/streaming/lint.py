"""Layer 1 on streams: the score is a projection of a row, so the batch code runs unchanged on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..api import lint
from ..operators.gate import gate


def read_stream(spark: SparkSession, path: str, schema: str, source: str = "parquet", files_a_batch: int = 100) -> DataFrame:
    return spark.readStream.format(source).schema(schema).option("maxFilesPerTrigger", files_a_batch).load(path)


def lint_stream(df: DataFrame, text_col: str = "text", threshold: float = 3.0) -> DataFrame:
    """Scored and flagged rows of a stream; no state, append mode."""
    return gate(lint(df, text_col), threshold)


def write_stream(df: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """To Parquet, exactly once: the sink's log and the checkpoint agree on each batch."""
    writer = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer).start()
