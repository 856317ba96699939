"""Row-level and join operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlight.operators.scale import running


def with_calendar(df: DataFrame, col: str) -> DataFrame:
    """Add year, quarter, month, day and ISO week of a date or timestamp."""
    parts = {"year": F.year, "quarter": F.quarter, "month": F.month, "day": F.dayofmonth, "iso_week": F.weekofyear}
    return df.withColumns({name: fn(col).cast("long") for name, fn in parts.items()})


def threshold_class(col: str, steps: Sequence[tuple[float, str]], otherwise: str) -> Column:
    """First label whose exclusive upper bound exceeds the value."""
    (bound, label), *rest = steps
    chain = F.when(F.col(col) < bound, label)
    for bound, label in rest:
        chain = chain.when(F.col(col) < bound, label)
    return chain.otherwise(otherwise)


def shorten_cells(df: DataFrame, limit: int = 200) -> DataFrame:
    """Cut text cells to ``limit`` characters plus an ellipsis; other types stay."""
    out = [
        F.when(F.length(f.name) > limit, F.concat(F.substring(f.name, 1, limit), F.lit("…")))
        .otherwise(F.col(f.name)).alias(f.name)
        if isinstance(f.dataType, T.StringType)
        else F.col(f.name)
        for f in df.schema
    ]
    return df.select(*out)


def flatten_json(df: DataFrame, col: str, schema: str) -> DataFrame:
    """Replace a JSON text column by the columns of ``schema``; malformed text gives nulls."""
    return df.withColumn("_json", F.from_json(col, schema)).select(
        *[c for c in df.columns if c != col], "_json.*"
    )


def revenue_only(df: DataFrame, statuses: Sequence[str]) -> DataFrame:
    return df.where(F.col("status").isin(*statuses))


def day_kind(day: Column) -> Column:
    return F.when(F.weekday(day) >= 5, "weekend").otherwise("weekday")


def multiples_of(df: DataFrame, value: Column, unit: int) -> DataFrame:
    return df.where(F.pmod(value, F.lit(unit)) == 0)


def last_days(df: DataFrame, day: str, days: int, anchor: Column | None = None) -> DataFrame:
    """Rows of the last ``days`` days up to ``anchor`` (default: the latest day present)."""
    anchor = anchor if anchor is not None else df.agg(F.max(day)).scalar()
    return df.where((F.col(day) > F.date_sub(anchor, days)) & (F.col(day) <= anchor))


def trailing_windows(df: DataFrame, day: str, windows: Sequence[int], **aggs: Column) -> DataFrame:
    """Aggregates over several trailing windows in one pass.

    The longest window filters the scan; each row left counts for every window it falls
    into, and the few windows are combined before the shuffle.
    """
    latest = df.agg(F.max(day)).first()[0]  # as a value, so that the range reaches the scan
    anchor = F.lit(latest).cast(df.schema[day].dataType)
    recent = last_days(df, day, max(windows), anchor).withColumn("_age", F.date_diff(anchor, F.col(day)))
    spread = recent.withColumn(
        "days",
        F.explode(F.filter(F.array(*[F.lit(w).cast("long") for w in windows]), lambda w: F.col("_age") < w)),
    )
    return spread.groupBy("days").agg(*[c.alias(n) for n, c in aggs.items()])


def paid_below(
    df: DataFrame, *, who: str, group: str, level: str, pay: str, lower: str, upper: str
) -> DataFrame:
    """Members of the ``upper`` level paid less than someone of the ``lower`` level in their group.

    One row per such member with the number of ``lower`` members above and the widest
    gap. A running count along descending pay replaces the pairwise comparison, so a
    large group neither yields all its pairs nor sits in one task.
    """
    both = df.where(F.col(level).isin(lower, upper)).withColumn("_low", (F.col(level) == lower).cast("long"))
    # Strictly greater pay: at equal pay the upper level comes first.
    order = [F.col(pay).desc(), F.col("_low").asc(), F.col(who).asc()]
    counted = running(both, order, {"n_above": F.col("_low")}, by=[group])
    top = df.where(F.col(level) == lower).groupBy(group).agg(F.max(pay).alias("_top"))
    return (
        counted.where((F.col("_low") == 0) & (F.col("n_above") > 0))
        .join(top, group)
        .withColumn("widest_gap", F.col("_top") - F.col(pay))
        .drop("_low", "_top")
    )


def round_trips(
    outs: DataFrame, backs: DataFrame, *, keys: Sequence[str], day: str, quantity: str, within: int
) -> DataFrame:
    """Days with movements out followed within ``within`` days by movements back on the same keys.

    Both sides are first reduced to one row per key and day.
    """
    def daily(df: DataFrame) -> DataFrame:
        return df.groupBy(*keys, day).agg(F.count(F.lit(1)).alias("_n"), F.sum(quantity).alias("_qty"))

    return met_days(daily(outs), daily(backs), keys=keys, day=day, count="_n", quantity="_qty", within=within)


def met_days(
    outs: DataFrame, backs: DataFrame, *, keys: Sequence[str], day: str, count: str, quantity: str, within: int
) -> DataFrame:
    """The same over frames that already hold one row per key and day.

    The join runs on the key and a window of ``within`` + 1 days, so each day meets at
    most ``within`` + 1 return days however many movements a key has.
    """
    width = within + 1

    def side(df: DataFrame, name: str) -> DataFrame:
        values = ((day, f"{name}_date"), (count, f"n_{name}"), (quantity, f"qty_{name}"))
        return df.select(*keys, *[F.col(c).alias(n) for c, n in values])

    left = side(outs, "out").withColumn("_bucket", F.floor(F.unix_date("out_date") / width))
    own = F.floor(F.unix_date("back_date") / width)
    right = side(backs, "back").withColumn("_bucket", F.explode(F.array(own, own - 1)))
    gap = F.date_diff("back_date", "out_date")
    return (
        left.join(right, [*keys, "_bucket"])
        .where(gap.between(0, within))
        .select(
            *keys, "out_date", "back_date", "n_out", "qty_out", "n_back", "qty_back",
            gap.cast("long").alias("days_between"),
        )
    )


def there_and_back(
    moves: DataFrame, *, key: str, start: str, end: str, day: str, quantity: str, within: int
) -> DataFrame:
    """Days with movements from ``start`` to ``end`` met by days with movements back up to ``within`` days later.

    The movements are shuffled once, by key and the two ends in either order: both
    directions then lie together, are reduced to one row per day, and a day looks ahead over
    ``within`` + 1 days. A frame thus holds at most twice that many rows.
    """
    ends = [F.least(start, end).alias("_low"), F.greatest(start, end).alias("_high"), (F.col(start) < F.col(end)).alias("_up")]
    pair = [key, "_low", "_high"]
    apart = moves.where((F.col(start) != F.col(end)) & F.col(key).isNotNull() & F.col(day).isNotNull())
    # as many tasks as the session has for shuffles; left to be merged, they would fill up as the input grows
    tasks = int(moves.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = apart.select(key, *ends, F.col(day).alias("_day"), F.col(quantity).alias("_q")).repartition(tasks, *pair)
    days = dealt.groupBy(*pair, "_up", "_day").agg(F.count(F.lit(1)).alias("_n"), F.sum("_q").alias("_qty"))
    ahead = Window.partitionBy(*pair).orderBy(F.unix_date("_day")).rangeBetween(0, within)
    seen = days.withColumn("_ahead", F.collect_list(F.struct("_up", "_day", "_n", "_qty")).over(ahead)).where(F.size("_ahead") > 1)
    met = seen.withColumn("_back", F.explode("_ahead")).where(F.col("_back._up") != F.col("_up"))
    return met.select(
        key, F.when(F.col("_up"), F.col("_low")).otherwise(F.col("_high")).alias(start),
        F.when(F.col("_up"), F.col("_high")).otherwise(F.col("_low")).alias(end),
        F.col("_day").alias("out_date"), F.col("_back._day").alias("back_date"), F.col("_n").alias("n_out"), F.col("_qty").alias("qty_out"),
        F.col("_back._n").alias("n_back"), F.col("_back._qty").alias("qty_back"),
        F.date_diff("_back._day", "_day").cast("long").alias("days_between"),
    )


def first_per_key(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Lowest row in ``order`` for each key, combined before the shuffle."""
    rest = [c for c in df.columns if c not in key and c not in order]
    best = F.min(F.struct(*order, *rest)).alias("_first")
    return df.groupBy(*key).agg(best).select(*key, "_first.*")


def only_in_first(df: DataFrame, key: str, first: Column, second: Column) -> DataFrame:
    """Distinct keys seen under ``first`` and never under ``second``, in one pass."""
    return (
        df.where(first | second)
        .groupBy(key)
        .agg(F.bool_or(first).alias("_a"), F.bool_or(second).alias("_b"))
        .where(F.col("_a") & ~F.col("_b"))
        .select(key)
    )
