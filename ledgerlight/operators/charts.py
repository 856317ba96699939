"""The frame behind each chart; drawing is left to the caller."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlight.functions import rounded
from ledgerlight.operators.aggregates import histogram, pivot_fill
from ledgerlight.operators.anomaly import detect
from ledgerlight.operators.scale import join_null_safe, scalars
from ledgerlight.operators.windows import share_of_total


def chart_type(df: DataFrame, x: str, y: str) -> DataFrame:
    """Chart suited to the columns: few labels and numbers make a pie, dates a line, else bars."""
    numeric = isinstance(df.schema[y].dataType, T.NumericType)
    labels = df.groupBy(F.col(x).alias("x")).agg(F.lit(1).alias("_one"))
    n, longest = F.count("x"), F.max(F.length(F.col("x").cast("string")))
    dated = any(word in x.lower() for word in ("date", "time"))
    kind = F.when((F.col("n_labels") <= 6) & F.lit(numeric), "pie").when(F.lit(dated), "line").when(
        (F.col("n_labels") <= 10) & (F.col("longest") > 15), "hbar"
    ).otherwise("bar")
    return labels.agg(n.alias("n_labels"), longest.cast("long").alias("longest")).withColumn("chart_type", kind)


def grouped(df: DataFrame, x: str, group: str, values: Sequence[str], y: Column) -> DataFrame:
    return pivot_fill(df, [x], group, values, y)


def series(df: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    """Points of every series in drawing order."""
    return df.select(*by, x, y).orderBy(*by, x)


def bins(df: DataFrame, value: str, n: int = 20) -> DataFrame:
    """Counts of equal-width bins with their edges; empty bins are listed."""
    span = scalars(df, lo=F.min(value), hi=F.max(value))
    counted = histogram(df, value, n).select("bin", "n")
    edges = df.sparkSession.range(1, n + 1).select(F.col("id").alias("bin"), span.alias("_s"))
    width = (F.col("_s.hi") - F.col("_s.lo")) / n
    return edges.join(counted, "bin", "left").select(
        "bin", (F.col("_s.lo") + (F.col("bin") - 1) * width).alias("left"), (F.col("_s.lo") + F.col("bin") * width).alias("right"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def pie(df: DataFrame, value: str) -> DataFrame:
    return share_of_total(df, value, places=1, name="pct")


def flagged(df: DataFrame, key: str, value: str, sigma_threshold: float = 2.0) -> DataFrame:
    """Bars with a flag on outliers."""
    hits = detect(df, key, value, sigma_threshold=sigma_threshold).select(key, F.lit(True).alias("is_anomaly"))
    return join_null_safe(df, hits, [key]).select(key, rounded(F.col(value)).alias(value), F.coalesce("is_anomaly", F.lit(False)).alias("is_anomaly"))
