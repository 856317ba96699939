"""Shares, ranks, series and scaling.

Series operators take one row per series and period (see ``period_frame``): the
facts are aggregated first, so a window partition holds at most as many rows as
there are calendar periods.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlight.functions import half_even, ratio, rounded
from ledgerlight.operators.scale import attach, group_total, numbered, ranked, running, scalars


def share_of_total(df: DataFrame, value: str, by: Sequence[str] = (), places: int = 1, name: str = "pct") -> DataFrame:
    """Percentage of each (already aggregated) row in its group total."""
    out = group_total(df, by, _total=F.sum(value))
    return out.withColumn(name, rounded(100.0 * ratio(F.col(value), F.col("_total")), places)).drop("_total")


def _series(by: Sequence[str], period: str):
    return Window.partitionBy(*by).orderBy(period)


def change(df: DataFrame, by: Sequence[str], period: str, value: str, places: int = 2) -> DataFrame:
    """Previous value and percentage change along a series."""
    prev = F.lag(value).over(_series(by, period))
    return df.withColumn("previous", prev).withColumn(
        "pct_change", rounded(100.0 * ratio(F.col(value) - F.col("previous"), F.col("previous")), places)
    )


def cumulative(df: DataFrame, by: Sequence[str], period: str, value: str, name: str = "cumulative") -> DataFrame:
    """Running sum along a series."""
    w = _series(by, period).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.sum(value).over(w))


def moving(df: DataFrame, by: Sequence[str], period: str, value: str, n: int, name: str = "moving_avg") -> DataFrame:
    """Mean of the current and the ``n - 1`` rows before it."""
    w = _series(by, period).rowsBetween(-(n - 1), 0)
    return df.withColumn(name, ratio(F.sum(value).over(w), F.count(value).over(w)))


def trailing_mean(df: DataFrame, by: Sequence[str], period: str, value: str, n: int, name: str = "prior_mean") -> DataFrame:
    """Mean of the ``n`` rows before the current one."""
    w = _series(by, period).rowsBetween(-n, -1)
    return df.withColumn(name, ratio(F.sum(value).over(w), F.count(value).over(w)))


def ema(df: DataFrame, by: Sequence[str], period: str, value: str, span: int = 3) -> DataFrame:
    """Exponential moving average with alpha 2 / (span + 1), seeded by the first value.

    The weight of a row fades by (1 - alpha) a step, so a row depends on a bounded number
    of rows before it: each is folded from the rows whose weight still counts in a double.
    At the start of a series these reach back to its first value. No series is gathered.
    """
    alpha = 2.0 / (span + 1)
    reach = 0 if alpha >= 1 else math.ceil(60 * math.log(2) / -math.log(1 - alpha))
    x = F.col(value).cast("double")
    recent = F.collect_list(F.struct(x.alias("x"))).over(_series(by, period).rowsBetween(-reach, 0))
    rest = F.slice("_recent", F.lit(2), F.greatest(F.size("_recent") - 1, F.lit(0)))
    folded = F.aggregate(rest, F.col("_recent")[0]["x"], lambda before, v: alpha * v["x"] + (1 - alpha) * before)
    return df.select(*by, period, x.alias(value), recent.alias("_recent")).withColumn("ema", folded).drop("_recent")


def abc_classes(
    df: DataFrame, value: str, key: str, cuts: Mapping[str, float] = {"A": 80.0, "B": 95.0}, rest: str = "C"
) -> DataFrame:
    """Cumulative share by descending value and its class; works for any number of entities."""
    cum = running(df, [F.col(value).desc(), F.col(key).asc()], {"_upto": F.col(value)})
    total = df.agg(F.sum(value)).scalar()
    out = cum.withColumn("cumulative_pct", rounded(100.0 * ratio(F.col("_upto"), total), 4)).drop("_upto")
    label = F.lit(None).cast("string")
    for name, bound in reversed(list(cuts.items())):
        label = F.when(F.col("cumulative_pct") <= bound, name).otherwise(label)
    return out.withColumn("abc", F.coalesce(label, F.lit(rest)))


def smallest_cover(df: DataFrame, value: str, key: str, pct: float = 80.0) -> DataFrame:
    """Fewest entities whose summed value reaches ``pct`` percent of the total."""
    cum = running(df, [F.col(value).desc(), F.col(key).asc()], {"_upto": F.col(value), "_k": F.lit(1).cast("long")})
    total = df.agg(F.sum(value)).scalar()
    before = F.col("_upto") - F.col(value)
    needed = ratio(before, total) * 100 < pct
    return cum.agg(
        F.count_if(needed).alias("n_entities"), F.count(F.lit(1)).alias("n_all"),
        F.sum(F.when(needed, F.col(value))).alias("covered"),
    )


def streaks(df: DataFrame, by: Sequence[str], period: str, value: str) -> DataFrame:
    """Runs of consecutive rises and falls along each series, with length and ends."""
    step = F.signum(F.col(value).cast("double") - F.lag(value).over(_series(by, period)).cast("double")).cast("int")
    turns = df.withColumn("direction", step).where(F.col("direction").isNotNull())
    brk = (F.col("direction") != F.lag("direction").over(_series(by, period))).cast("long")
    upto = _series(by, period).rowsBetween(Window.unboundedPreceding, 0)
    runs = turns.withColumn("_brk", F.coalesce(brk, F.lit(0))).withColumn("_run", F.sum("_brk").over(upto))
    return (
        runs.groupBy(*by, "_run", "direction")
        .agg(F.count(F.lit(1)).alias("length"), F.min(period).alias("first"), F.max(period).alias("last"))
        .drop("_run")
    )


def longest_streaks(df: DataFrame, by: Sequence[str], period: str, value: str) -> DataFrame:
    """Longest rise and fall per series."""
    longest = {"longest_rise": 1, "longest_fall": -1}
    return streaks(df, by, period, value).groupBy(*by).agg(
        *[
            F.coalesce(F.max(F.when(F.col("direction") == d, F.col("length"))), F.lit(0)).alias(n)
            for n, d in longest.items()
        ]
    )


def seasonal_index(df: DataFrame, by: Sequence[str], season: str, value: str) -> DataFrame:
    """Mean per season over the overall mean, with the season's sample deviation."""
    per = df.groupBy(*by, season).agg(
        F.sum(value).alias("_s"), F.count(value).alias("_n"), F.stddev_samp(value).alias("std")
    )
    out = group_total(per, by, _ts=F.sum("_s"), _tn=F.sum("_n"))
    mean, overall = ratio(F.col("_s"), F.col("_n")), ratio(F.col("_ts"), F.col("_tn"))
    return out.select(
        *by, season,
        rounded(mean, 4).alias("season_mean"), rounded(F.col("std"), 4).alias("season_std"),
        rounded(ratio(mean, overall), 6).alias("seasonal_index"),
    )


def zscore(df: DataFrame, value: str, by: Sequence[str] = (), limit: float = 3.0) -> DataFrame:
    """z within the group (population deviation), null becomes 0, three places, flag beyond ``limit``."""
    out = group_total(df, by, _mean=F.avg(value), _std=F.stddev_pop(value))
    z = F.coalesce(ratio(F.col(value) - F.col("_mean"), F.col("_std")), F.lit(0.0))
    return out.withColumn("z", half_even(z, 3)).withColumn("is_outlier", F.abs("z") > limit).drop("_mean", "_std")


def order_gaps(df: DataFrame, by: Sequence[str], day: str) -> DataFrame:
    """Mean days between consecutive rows and the span from first to last.

    The gaps between neighbours add up to the span, so no ordering is needed.
    """
    span = F.date_diff(F.max(day), F.min(day))
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"), span.cast("long").alias("span_days"),
        ratio(span, F.count(F.lit(1)) - 1).alias("mean_gap"),
    )


def top_per_group(df: DataFrame, by: Sequence[str], order: Sequence[Column], n: int, name: str = "position") -> DataFrame:
    """First ``n`` rows per group; Spark trims each task to ``n`` before the shuffle."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= n)


def bands(
    df: DataFrame, value: str, by: Sequence[str], cuts: Sequence[tuple[float, str]], top: str, name: str = "band"
) -> DataFrame:
    """Label by percent rank inside the group, lowest value first."""
    out = ranked(df, value, by=by, descending=False, name="_rank", percent="pct_rank")
    label = F.lit(top)
    for bound, text in reversed(list(cuts)):
        label = F.when(F.col("pct_rank") < bound, text).otherwise(label)
    return out.withColumn(name, label).drop("_rank")


def tiles(df: DataFrame, value: str, key: str, n: int, name: str = "tile") -> DataFrame:
    """NTILE over the whole frame, highest value first; early tiles take the surplus rows."""
    pos = numbered(df, [F.col(value).desc(), F.col(key).asc()], "_pos")
    rows = df.agg(F.count(F.lit(1))).scalar()
    small = F.floor(rows / n)
    surplus = rows % n
    wide = surplus * (small + 1)
    at = F.col("_pos") - 1
    tile = F.when(at < wide, F.floor(ratio(at, small + 1))).otherwise(surplus + F.floor(ratio(at - wide, small)))
    return pos.withColumn(name, (tile + 1).cast("long")).drop("_pos")


def minmax_scale(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Scale each column to [0, 1] over the whole frame; a constant column gives null."""
    s = scalars(df, **{f"{e}_{c}": fn(c) for c in cols for e, fn in (("lo", F.min), ("hi", F.max))})
    return df.withColumn("_s", s).withColumns({
        c: ratio(F.col(c) - F.col(f"_s.lo_{c}"), F.col(f"_s.hi_{c}") - F.col(f"_s.lo_{c}")) for c in cols
    }).drop("_s")


def standardise(df: DataFrame, cols: Sequence[str], places: int = 6) -> DataFrame:
    """z per column (sample deviation), then scaled to [0, 1]."""
    s = scalars(df, **{f"{e}_{c}": fn(c) for c in cols for e, fn in (("m", F.avg), ("d", F.stddev_samp))})
    z = df.withColumn("_s", s).withColumns({c: ratio(F.col(c) - F.col(f"_s.m_{c}"), F.col(f"_s.d_{c}")) for c in cols})
    scaled = minmax_scale(z.drop("_s"), cols)
    return scaled.withColumns({c: rounded(F.col(c), places) for c in cols})


def weighted_rank(df: DataFrame, weights: Mapping[str, float], name: str = "score") -> DataFrame:
    """Weighted sum of the descending ranks of several columns."""
    out = df
    for i, col in enumerate(weights):
        out = ranked(out, col, name=f"_r{i}")
    score = sum((F.lit(w) * F.col(f"_r{i}") for i, w in enumerate(weights.values())), F.lit(0.0))
    return out.withColumn(name, rounded(score, 4)).drop(*[f"_r{i}" for i in range(len(weights))])


def peer_gap(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """Mean of the peers in the group and the gap to it."""
    stats = df.groupBy(*by).agg(F.sum(value).alias("_s"), F.count(value).alias("_n"))
    mean = ratio(F.col("_s"), F.col("_n"))
    return attach(df, stats, by).withColumn("peer_mean", mean).withColumn(
        "gap", F.col(value).cast("double") - F.col("peer_mean")
    ).drop("_s", "_n")


def spread(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """Smallest, largest and mean value per group, and largest over smallest."""
    return df.groupBy(*by).agg(
        F.min(value).cast("double").alias("lowest"), F.max(value).cast("double").alias("highest"),
        ratio(F.sum(value), F.count(value)).alias("mean"),
        ratio(F.max(value), F.min(value)).alias("max_min_ratio"),
    )


def spread_flags(
    df: DataFrame, value: str, by: Sequence[str], over_mean: Mapping[str, float] = {"over_mean": 2.0}, k: float = 2.0
) -> DataFrame:
    """Rows above ``k`` times the group's smallest value, and above each named multiple of its mean."""
    stats = df.groupBy(*by).agg(
        F.min(value).cast("double").alias("_lo"), ratio(F.sum(value), F.count(value)).alias("_mean")
    )
    x = F.col(value).cast("double")
    flags = {name: x > factor * F.col("_mean") for name, factor in over_mean.items()}
    return attach(df, stats, by).withColumns({"over_lowest": x > k * F.col("_lo"), **flags}).drop("_lo", "_mean")
