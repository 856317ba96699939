"""Grouped statistics."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlight.functions import ratio, rounded
from ledgerlight.functions.special import chi2_tail, t_quantile
from ledgerlight.operators.scale import quantiles, ranked, running, scalars


def rate(df: DataFrame, by: Sequence[str], hit: Column, name: str, places: int = 2) -> DataFrame:
    """Percentage of rows satisfying ``hit`` per group."""
    return df.groupBy(*by).agg(rounded(100.0 * ratio(F.count_if(hit), F.count(F.lit(1))), places).alias(name))


def weighted_mean(df: DataFrame, by: Sequence[str], value: str, weight: str, name: str) -> DataFrame:
    return df.groupBy(*by).agg(ratio(F.sum(F.col(value) * F.col(weight)), F.sum(weight)).alias(name))


def group_stats(df: DataFrame, by: Sequence[str], value: str, min_mean: float | None = None) -> DataFrame:
    """Mean, sample deviation and count, rounded to two places, highest mean first."""
    out = df.groupBy(*by).agg(
        F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.count(value).alias("n")
    )
    if min_mean is not None:
        out = out.where(F.col("mean") > min_mean)
    return out.withColumns({"mean": rounded(F.col("mean")), "std": rounded(F.col("std"))}).orderBy(F.desc("mean"), *by)


def percentiles(df: DataFrame, value: str, points: Sequence[int], by: Sequence[str] = ()) -> DataFrame:
    """Exact percentiles ``p25`` and so on, interpolated linearly."""
    out = quantiles(df, value, {f"p{p}": p / 100 for p in points}, by)
    return out.withColumns({f"p{p}": rounded(F.col(f"p{p}"), 4) for p in points})


def percentiles_approx(
    df: DataFrame, value: str, points: Sequence[int], by: Sequence[str] = (), accuracy: int = 10000
) -> DataFrame:
    """Approximate percentiles in a single aggregate, for callers that accept the error."""
    at = F.percentile_approx(value, [p / 100 for p in points], accuracy)
    out = df.groupBy(*by).agg(at.alias("_p"))
    return out.select(*by, *[F.col("_p")[i].alias(f"p{p}") for i, p in enumerate(points)])


def variation(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Coefficient of variation and sample variance."""
    return df.groupBy(*by).agg(
        rounded(ratio(F.stddev_samp(value), F.avg(value)), 6).alias("cv"),
        rounded(F.var_samp(value), 4).alias("variance"),
    )


def corr_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pearson correlation of every column pair from one pass over the rows."""
    pairs = list(combinations(cols, 2))
    one = df.agg(*[F.corr(a, c).alias(f"_{i}") for i, (a, c) in enumerate(pairs)])
    rows = F.array(*[
        F.struct(F.lit(a).alias("a"), F.lit(c).alias("b"), rounded(F.col(f"_{i}"), 6).alias("corr"))
        for i, (a, c) in enumerate(pairs)
    ])
    return one.select(F.inline(rows))


def trend(df: DataFrame, by: Sequence[str], period: str, value: str) -> DataFrame:
    """Least-squares slope, intercept and the forecast for the period after the last."""
    fit = df.groupBy(*by).agg(
        F.regr_slope(value, period).alias("slope"),
        F.regr_intercept(value, period).alias("intercept"),
        (F.max(period) + 1).alias("next_period"),
    )
    return fit.withColumn("forecast", F.col("intercept") + F.col("slope") * F.col("next_period"))


def mean_interval(df: DataFrame, by: Sequence[str], value: str, z: float = 1.96) -> DataFrame:
    """Mean with a normal-approximation confidence interval."""
    half = z * F.stddev_samp(value) / F.sqrt(F.count(value))
    return df.groupBy(*by).agg(
        F.count(value).alias("n"),
        rounded(F.avg(value), 4).alias("mean"),
        rounded(F.avg(value) - half, 4).alias("low"),
        rounded(F.avg(value) + half, 4).alias("high"),
    )


def chisq_uniform(df: DataFrame, category: str) -> DataFrame:
    """Chi-square statistic of the category counts against equal counts.

    With n categories and total N it equals (n / N) * sum(o^2) - N.
    """
    counts = df.groupBy(category).agg(F.count(F.lit(1)).cast("double").alias("o"))
    n, total = F.count(F.lit(1)), F.sum("o")
    return counts.agg(
        rounded(n * F.sum(F.col("o") * F.col("o")) / total - total, 6).alias("chi2"), (n - 1).alias("df")
    )


def mean_interval_t(df: DataFrame, by: Sequence[str], value: str, level: float = 0.95) -> DataFrame:
    """Mean with a confidence interval of Student's t, for groups too small for the normal curve."""
    stats = df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("_m"), F.stddev_samp(value).alias("_s"))
    half = t_quantile(1 - level, F.col("n") - 1) * F.col("_s") / F.sqrt("n")
    return stats.withColumn("_h", half).select(
        *by, "n", rounded(F.col("_m"), 4).alias("mean"), rounded(F.col("_m") - F.col("_h"), 4).alias("low"),
        rounded(F.col("_m") + F.col("_h"), 4).alias("high"),
    )


def chisq_test(df: DataFrame, category: str) -> DataFrame:
    """``chisq_uniform`` with the probability of a statistic at least as large."""
    return chisq_uniform(df, category).withColumn("p_value", rounded(chi2_tail(F.col("chi2"), F.col("df")), 9))


def lorenz(df: DataFrame, value: str, key: str) -> DataFrame:
    """Cumulative share of entities and of value, from the smallest value up."""
    order = [F.col(value).asc(), F.col(key).asc()]
    cum = running(df, order, {"_i": F.lit(1).cast("long"), "_x": F.col(value)})
    all_of = scalars(df, n=F.count(F.lit(1)), total=F.sum(value))
    return cum.select(
        *df.columns, all_of.alias("_all"), "_i", "_x"
    ).select(
        *df.columns,
        rounded(ratio(F.col("_i"), F.col("_all.n")), 6).alias("share_entities"),
        rounded(ratio(F.col("_x"), F.col("_all.total")), 6).alias("share_value"),
    )


def gini(df: DataFrame, value: str, key: str) -> DataFrame:
    """Gini coefficient of a positive value over entities."""
    cum = running(df, [F.col(value).asc(), F.col(key).asc()], {"_i": F.lit(1).cast("long")})
    x, n = F.col(value).cast("double"), F.count(F.lit(1))
    return cum.agg(rounded(2 * F.sum(F.col("_i") * x) / (n * F.sum(x)) - (n + 1) / n, 6).alias("gini"))


def pivot_fill(df: DataFrame, by: Sequence[str], column: str, values: Sequence[str], agg: Column) -> DataFrame:
    """Wide table over known column values, missing cells zero."""
    return df.groupBy(*by).pivot(column, list(values)).agg(agg).fillna(0, subset=list(values))


def histogram(df: DataFrame, value: str, bins: int = 20) -> DataFrame:
    """Equal-width bins between the smallest and largest value; the maximum joins the last bin."""
    span = scalars(df, lo=F.min(value), hi=F.max(value))
    x, lo, hi = F.col(value), F.col("_s.lo"), F.col("_s.hi")
    slot = F.coalesce(F.floor(F.try_divide((x - lo) * bins, hi - lo)), F.lit(0)) + 1
    return (
        df.where(x.isNotNull())
        .select(value, span.alias("_s"))
        .groupBy(F.least(slot, F.lit(bins)).cast("long").alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"), F.min(value).alias("smallest"), F.max(value).alias("largest"))
    )


def rank_size_slope(df: DataFrame, value: str) -> DataFrame:
    """Slope of log value on log rank."""
    return ranked(df, value).agg(
        rounded(F.regr_slope(F.ln(F.col(value).cast("double")), F.ln("rank")), 6).alias("slope")
    )


def top_share(df: DataFrame, value: str, key: str, k: int) -> DataFrame:
    """Share of the total held by the ``k`` largest entities, in percent."""
    total = df.agg(F.sum(value)).scalar()
    top = df.orderBy(F.desc(value), key).limit(k)
    part = top.agg(F.sum(value).alias("_top"))
    return part.select(rounded(ratio(F.col("_top"), total) * 100, 4).alias("top_share_pct"))
