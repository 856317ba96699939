"""Outlier detection and period comparison."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlight.functions import half_even, ratio
from ledgerlight.operators.scale import attach, group_total, quantiles, scalars

METHODS = ("sigma", "iqr", "hybrid")
PERIOD_TYPES = ("YOY", "QOQ")
IQR_FACTOR = 1.5


def _require(df: DataFrame, *cols: str) -> None:
    for c in cols:
        if c not in df.columns:
            raise KeyError(f"column not found: {c}")


def _number(df: DataFrame, col: str) -> Column:
    """Column as double; text that is no number becomes null."""
    return F.col(col).try_cast("double")


def thresholds(df: DataFrame, col: str, sigma_threshold: float = 2.0, method: str = "sigma") -> DataFrame:
    """One row: quartiles, IQR bounds, mean, population deviation, sigma bounds, effective bounds.

    Empty when fewer than two values are numeric.
    """
    _require(df, col)
    x = df.select(_number(df, col).alias("x"))
    moments = scalars(x, n=F.count("x"), mean=F.avg("x"), std=F.stddev_pop("x"))
    q = quantiles(x, "x", {"q1": 0.25, "q3": 0.75}).where(F.col("n_values") >= 2)
    q = q.withColumn("_m", moments).select(
        "q1", "q3", (F.col("q3") - F.col("q1")).alias("iqr"), F.col("_m.mean").alias("mean"), F.col("_m.std").alias("std")
    )
    out = q.withColumns({
        "iqr_lower": F.col("q1") - IQR_FACTOR * F.col("iqr"),
        "iqr_upper": F.col("q3") + IQR_FACTOR * F.col("iqr"),
        "sigma_lower": F.col("mean") - sigma_threshold * F.col("std"),
        "sigma_upper": F.col("mean") + sigma_threshold * F.col("std"),
    })
    kind = "sigma" if method == "sigma" else "iqr"
    return out.withColumns({"lower": F.col(f"{kind}_lower"), "upper": F.col(f"{kind}_upper")})


def detect(df: DataFrame, key: str, col: str, *, sigma_threshold: float = 2.0, method: str = "sigma") -> DataFrame:
    """Outlier rows of ``col`` with sigma distance, direction and both reasons.

    sigma: distance from the mean of at least ``sigma_threshold`` population deviations;
    iqr: strictly outside the 1.5 IQR fences; hybrid: either. Needs two numeric values.
    """
    _require(df, key, col)
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}")
    bounds = thresholds(df, col, sigma_threshold, method)
    b = bounds.select(F.struct("mean", "std", "iqr_lower", "iqr_upper")).scalar()
    x = F.col("_x")
    distance = F.when(F.col("_b.std") > 0, F.abs(x - F.col("_b.mean")) / F.col("_b.std")).otherwise(F.lit(0.0))
    scored = (
        df.select(F.col(key), _number(df, col).alias("_x"), b.alias("_b"))
        .where(x.isNotNull() & F.col("_b").isNotNull())
        .withColumn("_d", distance)
        .withColumn("reason_sigma", (F.col("_b.std") > 0) & (F.col("_d") >= sigma_threshold))
        .withColumn("reason_iqr", (x < F.col("_b.iqr_lower")) | (x > F.col("_b.iqr_upper")))
    )
    hit = {"sigma": F.col("reason_sigma"), "iqr": F.col("reason_iqr")}
    hit["hybrid"] = hit["sigma"] | hit["iqr"]
    return scored.where(hit[method]).select(
        key, x.alias("value"), half_even(F.col("_d"), 2).alias("sigma"),
        F.when(x > F.col("_b.mean"), "positive_outlier").otherwise("negative_outlier").alias("direction"),
        "reason_sigma", "reason_iqr",
    )


def sweep(df: DataFrame, key: str, cols: Sequence[str], sigma_threshold: float = 2.0) -> DataFrame:
    """Sigma outliers of every listed column; a column without a hit yields no row.

    One aggregate computes the moments of all columns, then the rows are tested in
    place, so nothing is shuffled per column.
    """
    _require(df, key, *cols)
    stats = scalars(df, **{
        f"{name}_{c}": fn(_number(df, c)) for c in cols for name, fn in (("m", F.avg), ("d", F.stddev_pop), ("n", F.count))
    })
    checks, any_hit = [], F.lit(False)
    for c in cols:
        x, m, d, n = _number(df, c), F.col(f"_s.m_{c}"), F.col(f"_s.d_{c}"), F.col(f"_s.n_{c}")
        hit = (n >= 2) & (d > 0) & (F.abs(x - m) / F.when(d > 0, d) >= sigma_threshold)
        any_hit = any_hit | hit
        checks.append(F.when(hit, F.struct(
            F.lit(c).alias("column"), x.alias("value"), half_even(F.abs(x - m) / F.when(d > 0, d), 2).alias("sigma"),
            F.when(x > m, "positive_outlier").otherwise("negative_outlier").alias("direction"),
        )))
    return df.withColumn("_s", stats).where(any_hit).select(key, F.inline(F.array_compact(F.array(*checks))))


def compare_periods(
    df: DataFrame, current: str, previous: str, group_col: str = "region",
    period_type: str = "YoY", sigma_threshold: float = 2.0,
) -> DataFrame:
    """Percentage change per group, its distance in sigmas and an outlier flag.

    The change is null unless the previous value is positive. With fewer than two
    changes, or no variation, no group is flagged.
    """
    _require(df, current, previous)
    if period_type.upper() not in PERIOD_TYPES:
        raise ValueError("period_type must be 'YoY' or 'QoQ'")
    c, p = F.col(current).cast("double"), F.col(previous).cast("double")
    out = df.withColumn("pct_change", F.when(p > 0, half_even((c - p) / F.when(p > 0, p) * 100, 2)))
    out = out.withColumn("period_comparison", F.lit(period_type.upper()))
    s = scalars(out, n=F.count("pct_change"), mean=F.avg("pct_change"), std=F.stddev_pop("pct_change"))
    usable = (F.col("_s.n") >= 2) & (F.col("_s.std") > 0)
    sigma = half_even(F.abs(F.col("pct_change") - F.col("_s.mean")) / F.when(usable, F.col("_s.std")), 2)
    out = out.withColumn("_s", s).withColumn("change_sigma", sigma).withColumn(
        "is_anomaly", F.coalesce(F.col("change_sigma") >= sigma_threshold, F.lit(False))
    ).drop("_s")
    first = [group_col] if group_col in df.columns else []
    return out.select(*first, *[n for n in out.columns if n not in first])


def change_outside_fences(df: DataFrame, current: str, previous: str) -> DataFrame:
    """Change in percent after dropping rows with nulls, flagged by the IQR fences."""
    clean = df.where(F.col(current).isNotNull() & F.col(previous).isNotNull()).withColumn(
        "yoy_pct", half_even(ratio(F.col(current).cast("double") - F.col(previous).cast("double"), F.col(previous)) * 100, 2)
    )
    q = quantiles(clean, "yoy_pct", {"q1": 0.25, "q3": 0.75}).select(F.struct("q1", "q3")).scalar()
    width = IQR_FACTOR * (F.col("_q.q3") - F.col("_q.q1"))
    outside = (F.col("yoy_pct") < F.col("_q.q1") - width) | (F.col("yoy_pct") > F.col("_q.q3") + width)
    return clean.withColumn("_q", q).withColumn("is_anomaly", F.coalesce(outside, F.lit(False))).drop("_q")


def group_fences(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """Rows strictly outside the IQR fences of their own group."""
    q = quantiles(df, value, {"q1": 0.25, "q3": 0.75}, by).withColumn("_w", IQR_FACTOR * (F.col("q3") - F.col("q1")))
    out = attach(df, q.drop("n_values"), by)
    x = F.col(value)
    return out.where((x < F.col("q1") - F.col("_w")) | (x > F.col("q3") + F.col("_w"))).drop("_w")


def above_mean(df: DataFrame, value: str, k: float, by: Sequence[str] = ()) -> DataFrame:
    """Rows above mean + k sample deviations, over the frame or per group."""
    out = group_total(df, by, _mean=F.avg(value), _std=F.stddev_samp(value))
    return out.where(F.col(value) > F.col("_mean") + k * F.col("_std")).drop("_mean", "_std")


def against_rest(df: DataFrame, value: str, by: Sequence[str] = (), k: float = 2.0) -> DataFrame:
    """Each row of an aggregated frame against the mean of the other rows of its group."""
    out = group_total(df, by, _sum=F.sum(value), _n=F.count(value))
    rest = ratio(F.col("_sum") - F.col(value), F.col("_n") - 1)
    multiple = ratio(F.col(value), F.col("baseline"))
    return (
        out.withColumn("baseline", rest)
        .withColumn("multiple", multiple)
        .withColumn("deviation_pct", (F.col("multiple") - 1) * 100)
        .withColumn("is_spike", F.coalesce(F.col("multiple") >= k, F.lit(False)))
        .drop("_sum", "_n")
    )


def flag_runs(df: DataFrame, by: Sequence[str], period: str, flag: str, name: str = "run_length") -> DataFrame:
    """Length so far of the current run of true flags along a series; 0 where the flag is false."""
    w = Window.partitionBy(*by).orderBy(period).rowsBetween(Window.unboundedPreceding, 0)
    isle = F.sum(F.when(F.col(flag), 0).otherwise(1)).over(w)
    at = Window.partitionBy(*by, "_isle").orderBy(period).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("_isle", isle).withColumn(
        name, F.sum(F.when(F.col(flag), 1).otherwise(0)).over(at).cast("long")
    ).drop("_isle")
