"""Writing splits, traces and reports."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlight.session import ensure_checkpoint_dir


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder beside the shared checkpoints, readable by every executor."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def write_splits(df: DataFrame, path: str, split: str = "split") -> None:
    """One folder of JSON lines per split."""
    df.write.mode("errorifexists").partitionBy(split).json(path)


def append_traces(df: DataFrame, path: str) -> None:
    """Append trace records as JSON lines."""
    df.write.mode("append").json(path)


def write_report(report: DataFrame, path: str) -> None:
    """A one-row report as a single JSON document."""
    report.limit(1).coalesce(1).write.mode("errorifexists").json(path)


def write_new(df: DataFrame, path: str, drop: bool = False) -> None:
    """Write a table; an existing one is refused unless ``drop`` is given."""
    df.write.mode("overwrite" if drop else "errorifexists").parquet(path)


def write_facts(df: DataFrame, path: str, date: str) -> None:
    """Facts in folders by year and quarter of ``date``, so that a period reads its folders only.

    Each quarter goes to as many tasks as it needs: rows are rebalanced by folder, and adaptive
    execution splits large quarters.
    """
    dated = df.withColumns({"year": F.year(date), "quarter": F.quarter(date)})
    dated.hint("rebalance", "year", "quarter").write.mode("errorifexists").partitionBy("year", "quarter").parquet(path)
