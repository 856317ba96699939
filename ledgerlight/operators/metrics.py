"""Composite business metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlight.functions import ratio
from ledgerlight.operators.scale import scalars


def rfm(df: DataFrame, customer: str, day: str, value: str, anchor: Column | None = None) -> DataFrame:
    """Recency in days before ``anchor``, frequency and monetary value per customer."""
    anchor = anchor if anchor is not None else df.agg(F.max(day)).scalar()
    return df.groupBy(customer).agg(
        F.max(day).alias("_last"), F.count(F.lit(1)).alias("frequency"), F.sum(value).alias("monetary")
    ).withColumn("recency", F.date_diff(anchor, F.col("_last")).cast("long")).drop("_last")


def cohort_retention(df: DataFrame, customer: str, period: Column) -> DataFrame:
    """Active customers per first-seen period and later period, as a share of the cohort.

    Rows are reduced to one per customer and period before the cohort is derived, so
    a customer contributes at most one row per calendar period.
    """
    seen = df.select(customer, period.alias("period")).distinct()
    cohort = F.min("period").over(Window.partitionBy(customer))
    cells = seen.withColumn("cohort", cohort).groupBy("cohort", "period").agg(F.count(F.lit(1)).alias("active"))
    size = F.max(F.when(F.col("period") == F.col("cohort"), F.col("active"))).over(Window.partitionBy("cohort"))
    return cells.withColumn("cohort_size", size).withColumn(
        "active_pct", 100.0 * ratio(F.col("active"), F.col("cohort_size"))
    )


def demand_per_day(
    moves: DataFrame, keys: Sequence[str], *, day: str = "movement_date", quantity: str = "quantity", kind: str = "outbound"
) -> DataFrame:
    """Outbound total and mean per calendar day over the span of the whole ledger.

    Dividing by days, not by movements: a mean per movement is no daily rate.
    """
    span = scalars(moves, days=F.date_diff(F.max(day), F.min(day)) + 1)
    out = moves.where(F.col("movement_type") == kind).groupBy(*keys).agg(F.sum(quantity).alias("outbound"))
    return out.withColumn("_days", span).withColumn(
        "per_day", ratio(F.col("outbound"), F.col("_days.days"))
    ).drop("_days")


def demand_spread(
    moves: DataFrame, keys: Sequence[str], *, day: str = "movement_date", quantity: str = "quantity", kind: str = "outbound"
) -> DataFrame:
    """Mean and sample deviation of daily demand, days without movement counting as zero.

    Daily sums give sum and sum of squares; the empty days enter only through the day count.
    """
    span = scalars(moves, days=F.date_diff(F.max(day), F.min(day)) + 1)
    daily = moves.where(F.col("movement_type") == kind).groupBy(*keys, day).agg(F.sum(quantity).cast("double").alias("_q"))
    sums = daily.groupBy(*keys).agg(F.sum("_q").alias("_s"), F.sum(F.col("_q") * F.col("_q")).alias("_ss"))
    n = F.col("_days.days").cast("double")
    mean = F.col("_s") / n
    variance = F.greatest((F.col("_ss") - n * mean * mean) / (n - 1), F.lit(0.0))
    return sums.withColumn("_days", span).select(*keys, mean.alias("mean_demand"), F.sqrt(variance).alias("std_demand"))


def missing_periods(df: DataFrame, by: Sequence[str], period: str) -> DataFrame:
    """Integer periods absent between the first and last one of each series."""
    seen = df.select(*by, period).distinct()
    ends = seen.groupBy(*by).agg(F.min(period).alias("_a"), F.max(period).alias("_z"))
    expected = ends.select(*by, F.explode(F.sequence("_a", "_z")).alias(period))
    return expected.join(seen, [*by, period], "left_anti")


def fill_periods(df: DataFrame, by: Sequence[str], period: str, values: Sequence[str]) -> DataFrame:
    """Every integer period between the ends of each series, missing values as zero."""
    ends = df.groupBy(*by).agg(F.min(period).alias("_a"), F.max(period).alias("_z"))
    expected = ends.select(*by, F.explode(F.sequence("_a", "_z")).alias(period))
    return expected.join(df, [*by, period], "left").fillna(0, subset=list(values))


def idle_days(
    df: DataFrame, keys: Sequence[str], day: str, start: str, end: str
) -> DataFrame:
    """Days of the period without a row, and days since the last row, per key."""
    a, z = F.lit(start).cast("date"), F.lit(end).cast("date")
    active = df.where(F.col(day).between(a, z)).select(*keys, day).distinct()
    length = F.date_diff(z, a) + 1
    return active.groupBy(*keys).agg(
        (length - F.count(F.lit(1))).cast("long").alias("idle_days"),
        F.date_diff(z, F.max(day)).cast("long").alias("days_since_last"),
    )


def growth(df: DataFrame, by: Sequence[str], value: str, first: Column, second: Column) -> DataFrame:
    """Sum under two period conditions and the growth from the first to the second."""
    return (
        df.where(first | second)
        .groupBy(*by)
        .agg(
            F.sum(F.when(first, F.col(value))).alias("previous"),
            F.sum(F.when(second, F.col(value))).alias("current"),
        )
        .withColumn("growth_pct", 100.0 * ratio(F.col("current") - F.col("previous"), F.col("previous")))
    )


def cagr(df: DataFrame, by: Sequence[str], year: str, value: str) -> DataFrame:
    """Compound annual growth from the first to the last year of each series."""
    ends = df.groupBy(*by).agg(
        F.min_by(value, year).cast("double").alias("first_value"), F.max_by(value, year).cast("double").alias("last_value"),
        (F.max(year) - F.min(year)).cast("double").alias("years"),
    )
    usable = (F.col("first_value") > 0) & (F.col("years") > 0)
    return ends.withColumn(
        "cagr", F.when(usable, F.pow(ratio(F.col("last_value"), F.col("first_value")), F.lit(1.0) / F.when(usable, F.col("years"))) - 1)
    )
