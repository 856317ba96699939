"""Continuous queries over trace and ledger feeds.

Every stateful step has a watermark, so its state covers a bounded stretch of time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerlight.functions import ratio


def trace_windows(stream: DataFrame, at: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Steps, failures and duration per agent and tumbling window.

    stream: ``at``, agent, status, duration. A window is emitted once, when it is closed.
    """
    return (
        stream.withWatermark(at, late)
        .groupBy(F.window(at, width).alias("w"), "agent")
        .agg(F.count(F.lit(1)).alias("steps"), F.count_if(F.col("status") == "failed").alias("failed"), F.max("duration").alias("longest"))
        .select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "agent", "steps", "failed", "longest")
    )


def ledger_alerts(
    stream: DataFrame, baseline: DataFrame, at: str, kind: str, k: float, width: str = "1 day", late: str = "1 hour"
) -> DataFrame:
    """Windows in which a movement kind occurs at least ``k`` times as often as its baseline.

    baseline: ``kind``, usual (movements per window); a static table read again per batch.
    """
    counts = stream.withWatermark(at, late).groupBy(F.window(at, width).alias("w"), kind).agg(F.count(F.lit(1)).alias("n"))
    joined = counts.join(baseline, kind)
    return joined.withColumn("multiple", ratio(F.col("n"), F.col("usual"))).where(F.col("multiple") >= k).select(
        F.col("w.start").alias("start"), kind, "n", "multiple"
    )


def drop_repeats(stream: DataFrame, at: str, keys: Sequence[str], late: str = "2 hours") -> DataFrame:
    """First record per key; repeats are recognised as long as the watermark allows."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark(list(keys))


def read_feed(spark: SparkSession, like: DataFrame, path: str, fmt: str = "parquet") -> DataFrame:
    """Stream the files under a path with the columns of a static frame.

    The path is given as a pattern matching only itself: a file stream takes a plain
    path to be a folder, while a table here may be a folder or a single file.
    """
    return spark.readStream.schema(like.schema).format(fmt).load(f"{path[:-1]}[{path[-1]}]")


def start_append(stream: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Append closed results to Parquet; ``once`` works off what is there and stops."""
    writer = stream.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 minute")).start()
