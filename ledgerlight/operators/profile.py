"""Full profile of the columns of a table: nulls, defaults, frequent values, value lists, samples.

One scan of all cells gives counts, an estimate of the distinct values and a mergeable summary
of the frequent ones per column. It names every value that a share of SHARE of the rows holds,
as it tracks far more than 1 / SHARE values. A second scan counts what the first one named, and
only that, exactly: frequent values, all values of columns with few, and the values with the
smallest hashes, of which the smallest are the sample.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlight.session import durable

SHARE = 0.05  # of the rows of a table; a value this frequent is listed with its exact count
ENUM = 12  # most values of a column that are listed as its domain
SAMPLES = 5
TRACKED = 4_096  # values the summary follows; its error is below 0.1 % of the rows


def _cells(df: DataFrame) -> DataFrame:
    """(column_name, value): every cell as text, nulls as null."""
    cells = [F.struct(F.lit(f.name).alias("column_name"), F.col(f"`{f.name}`").cast("string").alias("value")) for f in df.schema]
    return df.select(F.inline(F.array(*cells)))


def _hash(value: str):
    return F.conv(F.substring(F.md5(value), 1, 8), 16, 10).cast("long")


def full_profile(
    df: DataFrame, table: str, share: float = SHARE, enum: int = ENUM, samples: int = SAMPLES, tracked: int = TRACKED
) -> DataFrame:
    """One row a column: type, nullable, default, rows, nulls, value list, frequent values, samples.

    ``enum_values`` lists all values if there are at most ``enum``; ``frequent`` holds value and
    exact count of each value in at least ``share`` of the rows, the most frequent first;
    ``samples`` are the ``samples`` different values with the smallest MD5, so they do not depend
    on the order of rows. Lists are joined by ``|``.
    """
    spark = df.sparkSession
    cells = _cells(df)
    top = F.expr(f"approx_top_k(value, {int(2 / share)}, {tracked})")
    first = durable(cells.groupBy("column_name").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("value").isNull()).alias("n_nulls"),
        F.approx_count_distinct("value").alias("about"), top.alias("top"),
    ))
    cut = F.floor(F.lit(float(1 << 32)) * F.least(F.lit(1.0), F.lit(16.0 * samples) / F.greatest(F.col("about"), F.lit(1)))).cast("long")
    plan = first.select(
        F.col("column_name"), (F.col("about") <= 4 * enum + 20).alias("_few"), cut.alias("_cut"), F.transform("top", lambda t: t["item"]).alias("_named")
    )
    wanted = cells.join(F.broadcast(plan), "column_name").where("value is not null")  # a row a column
    wanted = wanted.where(F.col("_few") | (_hash("value") < F.col("_cut")) | F.array_contains("_named", F.col("value")))
    counts = durable(wanted.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n")).withColumn("h", F.md5("value")))
    sized = counts.join(first.select("column_name", "n_rows", "about"), "column_name")

    often = sized.where(F.col("n") >= share * F.col("n_rows")).groupBy("column_name").agg(
        F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("less"), "value"))).alias("list")
    ).select("column_name", F.array_join(F.transform("list", lambda x: F.concat_ws(":", x["value"], -x["less"])), "|").alias("frequent"))
    domains = sized.where(F.col("about") <= 4 * enum + 20).groupBy("column_name").agg(F.array_sort(F.collect_list("value")).alias("list")).where(
        F.size("list") <= enum
    ).select("column_name", F.array_join("list", "|").alias("enum_values"))
    # at most some hundred values a column lie under the cut, so the list that is sorted here is short
    small = sized.where((_hash("value") < F.floor(F.lit(float(1 << 32)) * F.least(F.lit(1.0), F.lit(16.0 * samples) / F.greatest(F.col("about"), F.lit(1))))))
    chosen = small.groupBy("column_name").agg(F.array_sort(F.collect_list(F.struct("h", "value"))).alias("list")).select(
        "column_name", F.array_join(F.transform(F.slice("list", 1, samples), lambda x: x["value"]), "|").alias("samples")
    )
    kinds = [(f.name, f.dataType.simpleString(), f.nullable, (f.metadata or {}).get("CURRENT_DEFAULT")) for f in df.schema]
    declared = spark.createDataFrame(kinds, "column_name string, data_type string, nullable boolean, default_value string")
    out = declared.join(first.select("column_name", "n_rows", "n_nulls"), "column_name", "left")
    for part in (domains, often, chosen):
        out = out.join(part, "column_name", "left")
    return out.select(
        F.lit(table).alias("table_name"), "column_name", "data_type", "nullable", "default_value",
        F.coalesce("n_rows", F.lit(0)).alias("n_rows"), F.coalesce("n_nulls", F.lit(0)).alias("n_nulls"), "enum_values", "frequent", "samples",
    )
