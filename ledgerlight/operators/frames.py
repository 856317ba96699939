"""User code over pandas frames, run by Spark in parallel.

A function never sees a whole table or group. It gets Arrow batches, or partial results that Spark
combines.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

FrameFn = Callable[[pd.DataFrame], pd.DataFrame]


def map_frames(df: DataFrame, fn: FrameFn, schema: str) -> DataFrame:
    """Apply a row-wise function of a frame to every batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield fn(batch)

    return df.mapInPandas(run, schema)


def fold_frames(df: DataFrame, partial: FrameFn, schema: str, by: Sequence[str], **merge: Column) -> DataFrame:
    """Partial results per batch, combined per key by Spark aggregates; safe for hot keys."""
    return map_frames(df, partial, schema).groupBy(*by).agg(*[c.alias(n) for n, c in merge.items()])


@F.udtf(returnType="key bigint, at timestamp_ntz, level double")
class DriftAlarms:
    """Cumulative sums that start anew after each alarm, over the rows of a partition in order.

    ``sum = max(0, sum + value - drift)``; at ``limit`` the row is an alarm and the sum is 0
    again. The reset makes a row depend on all before it, which no window frame can express. The
    state is one number, whatever the length of a partition.
    """

    def __init__(self) -> None:
        self.total = 0.0

    def eval(self, row: Row, drift: float, limit: float):
        if row["value"] is None:
            return
        self.total = max(0.0, self.total + row["value"] - drift)
        if self.total >= limit:
            yield row["_key"], row["at"], self.total
            self.total = 0.0

    def terminate(self):
        yield from ()


def drift_alarms(df: DataFrame, by: str, order: Sequence[str], drift: float, limit: float) -> DataFrame:
    """``(by, at, level)`` of every alarm. df: ``by`` (a whole number), at, value and the columns of ``order``.

    A registered table function: Spark partitions the table by ``by``, sorts it by ``order`` and
    streams the rows through, a partition never being held as a whole.
    """
    spark = df.sparkSession
    spark.udtf.register("drift_alarms", DriftAlarms)
    return spark.sql(
        f"SELECT * FROM drift_alarms(TABLE(SELECT * FROM {{rows}}) PARTITION BY {by} ORDER BY ({', '.join(order)}), CAST(:drift AS DOUBLE), CAST(:limit AS DOUBLE))",
        args={"drift": drift, "limit": limit}, rows=df.withColumn("_key", F.col(by)),
    ).withColumnRenamed("key", by)
