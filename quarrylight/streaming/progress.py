"""Progress as a stream: the batch fold's aggregates over a stream of log lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.progress import progress_aggregates, with_percent


def log_stream(spark: SparkSession, path: str) -> DataFrame:
    """Lines of JSON-lines files (run, seq, line) as they appear in a folder."""
    return spark.readStream.schema("run string, seq long, line string").json(path)


def stream_progress(lines: DataFrame, *keys: str) -> DataFrame:
    """Running progress; one row of state per run. Write it in complete or update mode."""
    return with_percent(lines.groupBy(*keys).agg(*progress_aggregates(F.col("line"), F.col("seq"))))


def start(lines: DataFrame, name: str, checkpoint: str, *keys: str) -> StreamingQuery:
    """Fold what is there into an in-memory table and stop; a restart goes on from the checkpoint."""
    writer = stream_progress(lines, *keys).writeStream.outputMode("complete").format("memory").queryName(name)
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
