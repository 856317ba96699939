"""Stored sketches: quantiles and distinct counts of any period from those of its days.

A sketch of a day is a few kilobytes whatever the day holds, and sketches merge, so a query over
a year reads 365 rows a key instead of the facts. Quantile sketches keep ranks within an error
that ``size`` sets; distinct sketches can be united and intersected.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

QUANTILE_SIZE = 1_000  # ranks within about 0.3 %, far below RANK_BOUND
RANK_BOUND = 0.02
SET_SIZE = 14  # as a power of two: relative error of about 0.8 % a standard deviation
SET_BOUND = 0.05


def daily(df: DataFrame, by: Sequence[str], day: Column, value: str | None = None, member: str | None = None) -> DataFrame:
    """One row a key and day with the sketch of ``value`` (``q``) and of ``member`` (``s``)."""
    aggs = []
    if value:
        aggs.append(F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(QUANTILE_SIZE)).alias("q"))
    if member:
        aggs.append(F.theta_sketch_agg(member, SET_SIZE).alias("s"))
    return df.groupBy(*by, day.cast("date").alias("day")).agg(*aggs)


def quantiles_of(stored: DataFrame, by: Sequence[str], points: Mapping[str, float]) -> DataFrame:
    """``n_values`` and one column a point from the merged sketches of each key."""
    merged = stored.groupBy(*by).agg(F.kll_merge_agg_double("q").alias("q"))
    return merged.select(
        *by, F.kll_sketch_get_n_double("q").alias("n_values"),
        *[F.kll_sketch_get_quantile_double("q", F.lit(float(p))).alias(n) for n, p in points.items()],
    )


def rank_error(df: DataFrame, by: Sequence[str], value: str, estimates: DataFrame, points: Mapping[str, float]) -> DataFrame:
    """How far the exact rank of each estimate is from its point: ``(*by, point, error)``.

    An estimate has all ranks from the share of smaller values to the share of values up to it.
    """
    joined = df.where(F.col(value).isNotNull()).join(estimates, list(by))
    n = F.count(F.lit(1))
    aggs = []
    for name, p in points.items():
        low, high = F.count_if(F.col(value) < F.col(name)) / n, F.count_if(F.col(value) <= F.col(name)) / n
        aggs.append(F.greatest(F.lit(0.0), low - p, p - high).alias(name))
    return joined.groupBy(*by).agg(*aggs).unpivot(list(by), list(points), "point", "error")


def united(stored: DataFrame, by: Sequence[str]) -> DataFrame:
    """The union of the day sketches of each key, as a sketch ``s``."""
    return stored.groupBy(*by).agg(F.theta_union_agg("s", F.lit(SET_SIZE)).alias("s"))


def size_of(sketch: Column) -> Column:
    return F.theta_sketch_estimate(sketch)


def common(a: Column, b: Column) -> Column:
    return F.theta_intersection(a, b)
