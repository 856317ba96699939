"""Runs over a feed of steps: each is closed once it has been silent, with status and reasons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlight.operators.compare import judged_runs

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def closed_runs(
    stream: DataFrame, run: Sequence[str], at: str, planned: Sequence[str], sql_step: str, max_seconds: float, max_calls: int,
    silence_ms: int = 86_400_000, late: str = "10 minutes",
) -> DataFrame:
    """Status, reasons, steps and failed steps of each run that has been silent for ``silence_ms``.

    stream: the ``run`` columns, ``at``, agent, status, duration, calls. Steps may come ``late``;
    later ones are dropped. The judgement is that of ``run_status`` on the whole run. A run is one
    session of event time, so its state is a row of sums and no step leaves the engine; steps
    further apart than the silence are runs of their own. The state store ``ROCKS`` keeps
    many open runs out of the heap.
    """
    rows = stream.withColumnRenamed(at, "at").withWatermark("at", late)
    asked = list(dict.fromkeys([*planned, sql_step]))  # the judgement asks for no other agent
    sums = rows.groupBy(F.session_window("at", f"{silence_ms} milliseconds"), *run).agg(
        *[F.bool_or(F.col("agent") == a).alias(f"_agent_{i}") for i, a in enumerate(asked)],
        F.coalesce(F.sum("duration"), F.lit(0.0)).alias("seconds"), F.coalesce(F.sum("calls"), F.lit(0).cast("long")).alias("calls"),
        F.count(F.lit(1)).alias("steps"), F.count_if(F.col("status") == "failed").alias("failed"),
    )
    agents = F.array_compact(F.array(*[F.when(F.col(f"_agent_{i}"), F.lit(a)) for i, a in enumerate(asked)]))
    return judged_runs(sums.withColumn("agents", agents), run, planned, sql_step, max_seconds, max_calls, keep=("steps", "failed"))
