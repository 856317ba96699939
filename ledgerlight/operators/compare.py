"""Comparison of result sets and roll-ups of evaluation runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlight.functions import ratio, rounded
from ledgerlight.operators.scale import numbered, quantiles
from ledgerlight.session import durable

PLACES = 6
# Possible outcomes of one compared question.
VERDICTS = ("match", "mismatch", "both_empty", "pred_error", "pred_timeout", "truncated", "gold_error")


def _plain_number(text: Column) -> Column:
    """Decimal text without trailing zeros or a negative zero."""
    cut = F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.when(cut == "-0", "0").otherwise(cut)


def canonical(col: Column, dtype: T.DataType) -> Column:
    """Type-tagged text of a cell: equal cells give equal text, unequal kinds never do.

    Whole numbers stay exact, fractions are rounded to six places, booleans differ
    from 0 and 1, binary is compared byte by byte.
    """
    if isinstance(dtype, T.BooleanType):
        text = F.concat(F.lit("bool:"), col.cast("string"))
    elif isinstance(dtype, T.IntegralType):
        text = F.concat(F.lit("num:"), col.cast("string"))
    elif isinstance(dtype, (T.FractionalType,)):
        fixed = F.bround(col.try_cast("decimal(38,9)"), PLACES).cast("string")
        text = F.concat(F.lit("num:"), F.coalesce(_plain_number(fixed), col.cast("string")))
    elif isinstance(dtype, T.BinaryType):
        text = F.concat(F.lit("hex:"), F.hex(col))
    elif isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        text = F.concat(F.lit("time:"), col.cast("string"))
    else:
        text = F.concat(F.lit("text:"), col.cast("string"))
    return F.coalesce(text, F.lit("null"))


def normalise(df: DataFrame, loose: bool = False) -> DataFrame:
    """One array of canonical cells per row, compared by position, not by column name.

    ``loose`` sorts the cells inside each row. That accepts a different permutation per
    row, so it is an upper bound for a diagnosis and no score.
    """
    cells = F.array(*[canonical(F.col(f"`{f.name}`"), f.dataType) for f in df.schema])
    return df.select((F.array_sort(cells) if loose else cells).alias("cells"))


def _verdict(n_gold: Column, n_pred: Column, n_off: Column) -> Column:
    return F.when((n_gold == 0) & (n_pred == 0), "both_empty").when(n_off == 0, "match").otherwise("mismatch")


BUCKETS = 1 << 16


def bucket_sums(rows: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Multiset hashes of two tables per bucket of rows, from one aggregate.

    rows: cells, bucket, sign (1 for one table, -1 for the other). ``g`` and ``p`` count rows,
    ``h1`` to ``h4`` are the differences of the sums of 24 bits each of two row hashes, so that
    no sum outgrows a long. Sums do not depend on the order of rows and count every copy.
    """
    marked = rows.select("bucket", "sign", *[F.xxhash64("cells", F.lit(k)).alias(f"x{k}") for k in (1, 2)])
    counts = [F.count_if(F.col("sign") == s).alias(n) for s, n in ((1, "g"), (-1, "p"))]
    parts = [F.shiftright(F.col(x), n).bitwiseAND(0xFFFFFF) * F.col("sign") for x in ("x1", "x2") for n in (0, 24)]
    return marked.groupBy("bucket").agg(*counts, *[F.sum(x).alias(f"h{k}") for k, x in enumerate(parts, 1)])


def multiset_diff(gold: DataFrame, pred: DataFrame, loose: bool = False, buckets: int = BUCKETS) -> DataFrame:
    """Compare as multisets: one row with both counts, unmatched rows and the verdict.

    Both sides are first compared by the hashes of their buckets. Equal tables are done with
    that, one aggregate over both; otherwise only rows of buckets that differ are counted on
    both sides, in a single grouping, so copies cost nothing. Rows that differ go unseen only
    where 128 bits of sums agree by chance. At most ``buckets`` numbers come to the driver.
    """
    sides = [normalise(side, loose).withColumn("sign", F.lit(sign)) for side, sign in ((gold, 1), (pred, -1))]
    rows = sides[0].unionByName(sides[1]).withColumn("bucket", F.pmod(F.xxhash64("cells"), F.lit(buckets)))
    per_bucket = durable(bucket_sums(rows, buckets))
    totals = per_bucket.agg(F.struct(F.coalesce(F.sum("g"), F.lit(0)).alias("g"), F.coalesce(F.sum("p"), F.lit(0)).alias("p"))).scalar()
    off = per_bucket.where("g <> p or h1 <> 0 or h2 <> 0 or h3 <> 0 or h4 <> 0").select("bucket")
    # ``buckets`` bounds what is broadcast; with no bucket off, adaptive execution drops the second reading
    per_row = rows.join(F.broadcast(off), "bucket", "left_semi").groupBy("cells").agg(F.sum("sign").alias("more"))
    more, zero = F.col("more"), F.lit(0).cast("long")
    unmatched = per_row.agg(
        F.coalesce(F.sum(F.greatest(more, zero)), zero).alias("missing"), F.coalesce(F.sum(F.greatest(-more, zero)), zero).alias("surplus")
    )
    counted = unmatched.select(totals.alias("_t"), "missing", "surplus").select(
        F.col("_t.g").alias("n_gold"), F.col("_t.p").alias("n_pred"), "missing", "surplus"
    )
    return counted.withColumn("verdict", _verdict(F.col("n_gold"), F.col("n_pred"), F.col("missing") + F.col("surplus")))


def ordered_diff(gold: DataFrame, gold_order: Sequence[Column], pred: DataFrame, pred_order: Sequence[Column]) -> DataFrame:
    """Compare row by row in the declared orders (each must be unique)."""

    def placed(df: DataFrame, order: Sequence[Column], side: str) -> DataFrame:
        cells = F.array(*[canonical(F.col(f"`{f.name}`"), f.dataType) for f in df.schema])
        return numbered(df, order, "_at").select("_at", cells.alias(side))

    both = placed(gold, gold_order, "g").join(placed(pred, pred_order, "p"), "_at", "full_outer")
    return both.agg(
        F.count("g").alias("n_gold"), F.count("p").alias("n_pred"),
        F.count_if(~F.col("g").eqNullSafe(F.col("p"))).alias("n_off"),
    ).withColumn("verdict", _verdict(F.col("n_gold"), F.col("n_pred"), F.col("n_off")))


def verdict_rollup(verdicts: DataFrame) -> DataFrame:
    """Counts per outcome and accuracy.

    verdicts: verdict, loose_match. Broken gold leaves the denominator; empty on both
    sides and cut results count neither as passed nor leave it.
    """
    counts = [F.count_if(F.col("verdict") == v).alias(v) for v in VERDICTS]
    out = verdicts.agg(F.count(F.lit(1)).alias("total"), *counts, F.count_if("loose_match").alias("loose_match"))
    out = out.withColumn("scored", F.col("total") - F.col("gold_error"))
    return out.withColumn("exec_accuracy", F.coalesce(ratio(F.col("match"), F.col("scored")), F.lit(0.0)))


JSON_SKILLS = ("supervisor-routing", "insight-generation", "error-reflection")


def _pct(hit: Column, rows: Column) -> Column:
    """Percentage to one place; 0 when there are no rows."""
    return F.coalesce(rounded(100.0 * ratio(F.count_if(hit), F.count_if(rows)), 1), F.lit(0.0))


def skill_rates(results: DataFrame) -> DataFrame:
    """Pass rates of a run: skill, passed, exec_pass, heuristic_pass, latency_s."""
    skill, passed, wait = F.col("skill"), F.col("passed"), F.col("latency_s")
    sql, structured = skill == "text-to-sql", skill.isin(*JSON_SKILLS)

    def rate(name: str) -> Column:
        return _pct((skill == name) & passed, skill == name)

    return results.agg(
        F.count(F.lit(1)).alias("total_samples"),
        _pct(sql & F.col("exec_pass"), sql).alias("sql_execution_accuracy"),
        _pct(sql & F.col("heuristic_pass"), sql).alias("sql_heuristic_accuracy"),
        rate("data-analysis").alias("python_syntax_rate"),
        rate("supervisor-routing").alias("supervisor_json_rate"),
        rate("insight-generation").alias("insight_json_rate"),
        rate("error-reflection").alias("reflector_json_rate"),
        _pct(structured & passed, structured).alias("overall_json_valid_rate"),
        F.coalesce(rounded(F.avg(F.when(wait > 0, wait))), F.lit(0.0)).alias("avg_latency_s"),
    )


RATES = (
    "sql_execution_accuracy", "sql_heuristic_accuracy", "python_syntax_rate", "supervisor_json_rate",
    "insight_json_rate", "reflector_json_rate", "overall_json_valid_rate", "avg_latency_s",
)
# The goal of each rate.
TARGETS = {
    "sql_execution_accuracy": "≥82%",
    "python_syntax_rate": "≥90%",
    "supervisor_json_rate": "≥88%",
    "insight_json_rate": "≥88%",
    "overall_json_valid_rate": "≥88%",
}


def as_metrics(rates: DataFrame) -> DataFrame:
    """One row per metric out of the single row of ``skill_rates``."""
    return rates.unpivot([], list(RATES), "metric", "value")


def meets_target(value: Column, target: Column) -> Column:
    """Whether a value satisfies a goal such as ``≥82%``; a goal in another form is not met."""
    bound = F.regexp_extract(target, r"^[≥>=<]+\s*(\d+(?:\.\d+)?)%", 1).try_cast("double")
    at_least = target.contains("≥") | target.contains(">=")
    return F.coalesce(F.when(at_least, value >= bound).when(target.contains("<"), value < bound), F.lit(False))


def run_delta(base: DataFrame, new: DataFrame) -> DataFrame:
    """Metric by metric difference of two runs; an absent metric counts as 0."""
    both = base.select("metric", F.col("value").alias("baseline")).join(
        new.select("metric", F.col("value").alias("candidate")), "metric", "full_outer"
    ).fillna(0.0, ["baseline", "candidate"])
    diff = F.col("candidate") - F.col("baseline")
    places = F.when(F.col("metric") == "avg_latency_s", rounded(diff, 2)).otherwise(rounded(diff, 1))
    return both.withColumn("delta", places)


def trace_slo(traces: DataFrame, run: Sequence[str], goal: float = 45.0) -> DataFrame:
    """Median and 95th percentile of run time, share of runs within ``goal``, calls, failures.

    traces: duration, calls, status, one row per step; ``run`` identifies a run.
    """
    runs = traces.groupBy(*run).agg(
        F.sum("duration").alias("wall"), F.sum("calls").alias("calls"), F.bool_or(F.col("status") == "failed").alias("failed")
    )
    q = quantiles(runs, "wall", {"p50": 0.5, "p95": 0.95})
    rest = runs.agg(F.struct(
        ratio(F.count_if(F.col("wall") <= goal), F.count(F.lit(1))).alias("hit_rate"), F.sum("calls").alias("calls"),
        F.count_if("failed").alias("failed_runs"),
    )).scalar()
    return q.withColumn("_r", rest).select(F.col("n_values").alias("runs"), "p50", "p95", "_r.hit_rate", "_r.calls", "_r.failed_runs")


def run_status(
    steps: DataFrame, run: Sequence[str], planned: Sequence[str], sql_step: str, max_seconds: float, max_calls: int
) -> DataFrame:
    """success, partial or failed per run, with the reasons.

    steps: agent, duration, calls. A planned step without a row was skipped. Success
    needs the SQL result, no skipped step and no reason; partial needs the SQL result.
    """
    sums = steps.groupBy(*run).agg(F.collect_set(F.when(F.col("agent").isin(*planned, sql_step), F.col("agent"))).alias("agents"), F.sum("duration").alias("seconds"), F.sum("calls").alias("calls"))
    return judged_runs(sums, run, planned, sql_step, max_seconds, max_calls)


def judged_runs(
    sums: DataFrame, run: Sequence[str], planned: Sequence[str], sql_step: str, max_seconds: float, max_calls: int, keep: Sequence[str] = ()
) -> DataFrame:
    """Status and reasons from the sums of whole runs: agents (those with a step), seconds, calls."""
    skipped = F.array_except(F.array(*[F.lit(a) for a in planned]), "agents")
    sql = F.array_contains("agents", sql_step)
    reasons = F.array_compact(F.array(
        F.when(F.col("seconds") > max_seconds, "time"), F.when(F.col("calls") >= max_calls, "calls"),
        F.when(F.size("_skipped") > 0, F.concat(F.lit("skipped "), F.array_join("_skipped", ","))),
    ))
    out = sums.withColumn("_skipped", skipped).withColumn("_reasons", reasons)
    clean = F.size("_reasons") == 0
    status = F.when(sql & clean, "success").when(sql, "partial").otherwise("failed")
    why = F.when(~sql & clean, "no usable output").otherwise(F.array_join("_reasons", "; "))
    return out.select(*run, status.alias("status"), why.alias("reasons"), *keep)


def failure_reasons(judged: DataFrame) -> DataFrame:
    """Runs that did not succeed by status and reason; a run counts under each of its reasons."""
    rows = judged.where("status <> 'success'").select("status", F.explode(F.split("reasons", "; ")).alias("reason"))
    return rows.groupBy("status", "reason").agg(F.count(F.lit(1)).alias("n_runs"))
