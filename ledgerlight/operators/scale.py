"""Building blocks that stay parallel when one key holds much of the data.

* ``running``   running sums over a total order, also without a partition key
* ``ranked``    rank, row number and percent rank on top of ``running``
* ``quantiles`` exact interpolated quantiles, global or per group
* ``attach``    bring per-group statistics back to the rows
* ``scalars``   one-row statistics as a scalar subquery
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlight.session import durable

# Groups with at most this many distinct values fit the exact percentile aggregate.
MAP_VALUES = 250_000
# A statistics frame above this many rows or bytes is joined by shuffle instead of broadcast.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 32 << 20


def scalars(df: DataFrame, **aggs: Column) -> Column:
    """Struct of ungrouped aggregates, usable as a column of any frame."""
    return df.agg(F.struct(*[c.alias(n) for n, c in aggs.items()]).alias("stats")).scalar()


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Equi join in which a null key matches a null key; keeps the left keys."""
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    cond = reduce(lambda a, b: a & b, [left[k].eqNullSafe(renamed[f"_r_{k}"]) for k in keys])
    return left.join(renamed, cond, how).drop(*[f"_r_{k}" for k in keys])


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Materialise ``df`` and mark it for broadcast only when its rows and bytes are proven small.

    Texts count by their length, all other values by eight bytes. The join gives the same
    rows either way.
    """
    kept = durable(df)
    texts = [F.coalesce(F.octet_length(f.name), F.lit(0)) for f in df.schema if isinstance(f.dataType, (T.StringType, T.BinaryType))]
    width = sum(texts, F.lit(8 * len(df.columns)))
    nested = any(isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)) for f in df.schema)
    n, size = kept.agg(F.count(F.lit(1)), F.coalesce(F.sum(width.cast("long")), F.lit(0))).first()
    return F.broadcast(kept) if n <= max_rows and size <= max_bytes and not nested else kept


def attach(facts: DataFrame, stats: DataFrame, by: Sequence[str], max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Left-join one statistics row per group to every fact row.

    A window over ``by`` would put a whole group into one task. Here the groups
    are pre-aggregated; few groups are broadcast, many are joined by shuffle,
    where adaptive execution splits the partitions of hot keys.
    """
    return join_null_safe(facts, broadcast_if_small(stats, max_rows), by)


def _wide(col: Column, dtype: T.DataType) -> Column:
    return col.cast(T.DecimalType(36, dtype.scale)) if isinstance(dtype, T.DecimalType) else col


def running(
    df: DataFrame,
    order: Sequence[Column],
    totals: Mapping[str, Column],
    by: Sequence[str] = (),
    spans: int | None = None,
) -> DataFrame:
    """Add inclusive running sums of ``totals`` along ``order`` inside each ``by`` group.

    Rows are range-partitioned on (by, order), so a hot group spreads over many
    tasks. Each span sums locally and is shifted by the total of the spans before
    it; only one row per span and group is gathered for the shift. ``order`` must
    end in a unique key, else tied rows get an arbitrary relative position. ``spans`` is
    their number (about one for 200 MB of rows); by default that of shuffle partitions.
    """
    staged = df.select("*", *[c.alias(f"_v_{n}") for n, c in totals.items()])
    keyed = [*[F.col(b) for b in by], *order]
    dealt = staged.repartitionByRange(*([spans] if spans else []), *keyed)
    cut = durable(dealt.withColumn("_span", F.spark_partition_id()))
    keys = ["_span", *by]
    per_span = cut.groupBy(*keys).agg(*[F.sum(f"_v_{n}").alias(f"_s_{n}") for n in totals])
    before = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    shift = per_span.select(*keys, *[F.sum(f"_s_{n}").over(before).alias(f"_b_{n}") for n in totals])
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = cut.select("*", *[F.sum(f"_v_{n}").over(inside).alias(f"_l_{n}") for n in totals])
    joined = join_null_safe(local, shift, keys, "inner")
    types = dict((f.name, f.dataType) for f in joined.schema)
    out = [
        (
            _wide(F.col(f"_l_{n}"), types[f"_l_{n}"])
            + F.coalesce(_wide(F.col(f"_b_{n}"), types[f"_b_{n}"]), F.lit(0).cast(_zero(types[f"_b_{n}"])))
        ).alias(n)
        for n in totals
    ]
    return joined.select(*df.columns, *out)


def _zero(dtype: T.DataType) -> T.DataType:
    return T.DecimalType(36, dtype.scale) if isinstance(dtype, T.DecimalType) else dtype


def numbered(
    df: DataFrame, order: Sequence[Column], name: str = "position", by: Sequence[str] = (), spans: int | None = None
) -> DataFrame:
    """Row number along ``order`` (which must be unique) without a single-task window."""
    return running(df, order, {name: F.lit(1).cast("long")}, by, spans)


def group_total(df: DataFrame, by: Sequence[str], **aggs: Column) -> DataFrame:
    """Attach grouped (or, without keys, global) aggregates to every row."""
    if not by:
        stats = scalars(df, **aggs)
        return df.select("*", stats.alias("_g")).select(*df.columns, *[F.col(f"_g.{n}").alias(n) for n in aggs])
    return attach(df, df.groupBy(*by).agg(*[c.alias(n) for n, c in aggs.items()]), by)


def ranked(
    df: DataFrame,
    value: str,
    *,
    by: Sequence[str] = (),
    descending: bool = True,
    name: str = "rank",
    percent: str | None = None,
) -> DataFrame:
    """Standard competition rank of ``value``; ties share the smallest position.

    Tied values are counted first, so the running sum works on distinct values
    and a value shared by many rows costs one row.
    """
    counts = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    order = [F.col(value).desc_nulls_last() if descending else F.col(value).asc_nulls_last()]
    upto = running(counts, order, {"_upto": F.col("_n")}, by)
    ranks = upto.select(*by, value, (F.col("_upto") - F.col("_n") + 1).alias(name), "_n")
    if percent:
        ranks = group_total(ranks, by, _rows=F.sum("_n"))
        ranks = ranks.withColumn(
            percent,
            F.when(F.col("_rows") > 1, (F.col(name) - 1) / (F.col("_rows") - 1)).otherwise(F.lit(0.0)),
        ).drop("_rows")
    return join_null_safe(df, ranks.drop("_n"), [*by, value])


def quantiles(
    df: DataFrame,
    value: str,
    probs: Mapping[str, float],
    by: Sequence[str] = (),
    map_values: int = MAP_VALUES,
) -> DataFrame:
    """Exact quantiles with linear interpolation, one row per group.

    The built-in exact aggregate keeps every distinct value of a group in one map, so it
    is used only where the largest group is known to be small. Beyond that the same
    formula works on order statistics: the values are counted, cumulative counts come from ``running`` and only the two order
    statistics around each position are kept, so no task holds a group.
    """
    clean = df.select(*by, F.col(value).cast("double").alias("_x")).where(F.col("_x").isNotNull())
    widest = clean.groupBy(*by).agg(F.approx_count_distinct("_x").alias("_d")).agg(F.max("_d")).first()[0]
    if (widest or 0) <= map_values:
        points = F.array(*[F.lit(float(p)) for p in probs.values()])
        q = clean.groupBy(*by).agg(F.count("_x").alias("n_values"), F.percentile("_x", points).alias("_q"))
        return q.select(*by, "n_values", *[F.col("_q")[i].alias(n) for i, n in enumerate(probs)])
    counts = clean.groupBy(*by, "_x").agg(F.count(F.lit(1)).alias("_n"))
    upto = running(counts, [F.col("_x").asc()], {"_hi": F.col("_n")}, by)
    cum = group_total(upto, by, _rows=F.sum("_n"))
    picks = []
    for name, p in probs.items():
        pos = (F.col("_rows") - 1) * F.lit(float(p))
        for side, at in (("lo", F.floor(pos)), ("hi", F.ceil(pos))):
            here = (at < F.col("_hi")) & (at >= F.col("_hi") - F.col("_n"))
            picks.append(F.max(F.when(here, F.col("_x"))).alias(f"_{side}_{name}"))
        # the same weights as in the built-in aggregate, so that both ways agree to the last bit
        picks.append(F.max(pos - F.floor(pos)).alias(f"_f_{name}"))
        picks.append(F.max(F.ceil(pos) - pos).alias(f"_c_{name}"))
    agg = cum.groupBy(*by).agg(F.max("_rows").alias("n_values"), *picks)
    return agg.select(
        *by,
        "n_values",
        *[
            F.when(F.col(f"_lo_{n}") == F.col(f"_hi_{n}"), F.col(f"_lo_{n}"))
            .otherwise(F.col(f"_c_{n}") * F.col(f"_lo_{n}") + F.col(f"_f_{n}") * F.col(f"_hi_{n}")).alias(n)
            for n in probs
        ],
    )
