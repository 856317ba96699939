"""Sketches, full profiles, tests with p-values, replayed loads, run state and partition pruning."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import functions as F

from ledgerlight.functions import rounded
from ledgerlight.functions.special import t_tails
from ledgerlight.operators import aggregates, compare, profile, sketches
from ledgerlight.plans import bindings as b
from ledgerlight.plans.bindings import sql_round as r
from ledgerlight.plans.evaluation import SQL_RUNS, daily_runs, run_status
from ledgerlight.plans.feeds import run_stream
from ledgerlight.plans.quality import stacked
from ledgerlight.plans.registry import query
from ledgerlight.session import durable
from ledgerlight.sources import loading, writers
from ledgerlight.streaming import feeds, runs

POINTS = {"p50": 0.5, "p90": 0.9, "p99": 0.99}
HALF = "2024-01-16"


def half(at):
    return F.when(F.col(at) < F.lit(HALF).cast("date"), "first").otherwise("second")


# --- sketches ----------------------------------------------------------------
@query("quantile_sketches", f"""WITH x AS (SELECT event_type, CASE WHEN CAST(ts AS DATE) < DATE '{HALF}' THEN 'first' ELSE 'second' END AS period, value FROM events WHERE value IS NOT NULL),
  n AS (SELECT event_type, period, COUNT(*) AS n FROM x GROUP BY 1, 2 UNION ALL SELECT event_type, 'all', COUNT(*) FROM x GROUP BY 1)
  SELECT event_type, period, point, n AS n_values, TRUE AS within FROM n, (VALUES ('p50'), ('p90'), ('p99')) p(point)""")
def quantile_sketches(t):
    """Quantiles of periods merged from sketches of days; their exact ranks must lie within the bound."""
    facts = t("events").select("event_type", F.col("ts").cast("date").alias("day"), F.col("value").cast("double").alias("value"))
    stored = durable(sketches.daily(facts.where("value is not null"), ["event_type"], F.col("day"), value="value"))
    out = []
    for rows, days in ((stored.withColumn("period", half("day")), facts.withColumn("period", half("day"))),
                       (stored.withColumn("period", F.lit("all")), facts.withColumn("period", F.lit("all")))):
        keys = ["event_type", "period"]
        found = durable(sketches.quantiles_of(rows, keys, POINTS))
        errors = sketches.rank_error(days, keys, "value", found, POINTS)
        out.append(errors.join(found.select(*keys, "n_values"), keys).select(*keys, "point", "n_values", (F.col("error") <= sketches.RANK_BOUND).alias("within")))
    return stacked(out)


@query("distinct_sketches", f"""WITH x AS (SELECT event_type, user_id, CAST(ts AS DATE) < DATE '{HALF}' AS early FROM events WHERE user_id IS NOT NULL),
  u AS (SELECT event_type, user_id, bool_or(early) AS a, bool_or(NOT early) AS z FROM x GROUP BY 1, 2)
  SELECT event_type, period, n AS n_users, TRUE AS within FROM (SELECT event_type, COUNT(*) FILTER (WHERE a) AS first, COUNT(*) FILTER (WHERE z) AS second,
    COUNT(*) AS either, COUNT(*) FILTER (WHERE a AND z) AS common FROM u GROUP BY 1) UNPIVOT (n FOR period IN (first, second, either, common))""")
def distinct_sketches(t):
    """Users of periods from united and intersected sketches of days, against exact counts.

    The error of an intersection is measured against the union, as its bound is.
    """
    facts = t("events").select("event_type", "user_id", F.col("ts").cast("date").alias("day")).where("user_id is not null")
    stored = durable(sketches.daily(facts, ["event_type"], F.col("day"), member="user_id"))
    halves = sketches.united(stored.withColumn("period", half("day")), ["event_type", "period"])
    wide = halves.groupBy("event_type").agg(*[F.first(F.when(F.col("period") == p, F.col("s")), ignorenulls=True).alias(p) for p in ("first", "second")])
    both = sketches.united(stored, ["event_type"]).withColumnRenamed("s", "either").join(wide, "event_type")
    none = F.lit(0).cast("long")
    estimates = both.select("event_type", *[F.coalesce(sketches.size_of(F.col(p)), none).alias(p) for p in ("first", "second", "either")],
                            F.coalesce(sketches.size_of(sketches.common(F.col("first"), F.col("second"))), none).alias("common"))
    early = F.col("day") < F.lit(HALF).cast("date")
    users = facts.groupBy("event_type", "user_id").agg(F.bool_or(early).alias("a"), F.bool_or(~early).alias("z"))
    exact = users.groupBy("event_type").agg(
        F.count_if("a").alias("first"), F.count_if("z").alias("second"), F.count(F.lit(1)).alias("either"), F.count_if(F.col("a") & F.col("z")).alias("common")
    )
    names = ["first", "second", "either", "common"]
    long = [df.unpivot(["event_type"], names, "period", n) for df, n in ((estimates, "estimate"), (exact, "n_users"))]
    joined = long[0].join(long[1], ["event_type", "period"]).join(exact.select("event_type", F.col("either").alias("_all")), "event_type")
    room = sketches.SET_BOUND * F.when(F.col("period") == "common", F.col("_all")).otherwise(F.col("n_users"))
    return joined.select("event_type", "period", "n_users", (F.abs(F.col("estimate") - F.col("n_users")) <= room).alias("within"))


# --- profiles ----------------------------------------------------------------
WIDE = {
    "orders": {"o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string", "o_totalprice": "decimal(18,2)", "o_orderdate": "date", "o_orderpriority": "string"},
    "events": {"event_id": "bigint", "user_id": "bigint", "event_type": "string"},
    "customer": {"c_custkey": "bigint", "c_nationkey": "int", "c_mktsegment": "string"},
    "labels": {"doc_id": "bigint", "quality": "int", "toxic": "int"},
}


def full_profile_sql(table: str, col: str, kind: str) -> str:
    sql_type = {"string": "VARCHAR"}.get(kind, kind.upper())
    return f"""SELECT '{table}' AS table_name, '{col}' AS column_name, '{kind}' AS data_type, TRUE AS nullable, NULL::VARCHAR AS default_value,
    (SELECT COUNT(*) FROM {table}) AS n_rows, (SELECT COUNT(*) FROM {table} WHERE {col} IS NULL) AS n_nulls,
    CASE WHEN COUNT(*) BETWEEN 1 AND {profile.ENUM} THEN string_agg(v, '|' ORDER BY v) END AS enum_values,
    string_agg(v || ':' || n, '|' ORDER BY n DESC, v) FILTER (WHERE n >= {profile.SHARE} * (SELECT COUNT(*) FROM {table})) AS frequent,
    array_to_string(list(v ORDER BY md5(v))[1:{profile.SAMPLES}], '|') AS samples
  FROM (SELECT CAST(CAST({col} AS {sql_type}) AS VARCHAR) AS v, COUNT(*) AS n FROM {table} WHERE {col} IS NOT NULL GROUP BY 1)"""


@query("full_profile", " UNION ALL ".join(full_profile_sql(t, c, kind) for t, cols in WIDE.items() for c, kind in cols.items()))
def full_profile(t):
    return stacked(profile.full_profile(t(name).select(*[F.col(c).cast(kind).alias(c) for c, kind in cols.items()]), name) for name, cols in WIDE.items())


# --- tests -------------------------------------------------------------------
def sql_t_tails(t: str, v: str) -> str:
    """Two-sided p-value of t by the series of the incomplete beta function."""
    y = f"(({t}) * ({t}) / ({v} + ({t}) * ({t})))"
    front = f"exp(lgamma(0.5 + {v} / 2) - lgamma(0.5) - lgamma({v} / 2) + 0.5 * ln({y}) + {v} / 2 * ln(1 - {y}))"
    series = f"list_sum(list_transform(range(0, 4000), lambda zz: exp(lgamma(0.5 + {v} / 2 + zz) - lgamma(0.5 + {v} / 2) - lgamma(1.5 + zz) + lgamma(0.5) + zz * ln({y}))))"
    return f"CASE WHEN {t} = 0 THEN 1 ELSE 1 - {front} * {series} END"


@query("chisq_test", """WITH c AS (SELECT o_orderpriority AS k, COUNT(*)::DOUBLE AS o FROM orders GROUP BY 1),
  s AS (SELECT ROUND(CAST(COUNT(*) * SUM(o * o) / SUM(o) - SUM(o) AS DECIMAL(30,8)), 6)::DOUBLE AS chi2, COUNT(*) - 1 AS df FROM c)
  SELECT chi2, df, """ + r("1 - list_sum(list_transform(range(0, 2000), lambda n: exp((df / 2 + n) * ln(chi2 / 2) - chi2 / 2 - lgamma(df / 2 + n + 1))))", 9) + " AS p_value FROM s")
def chisq_test(t):
    return aggregates.chisq_test(t("orders"), "o_orderpriority")


@query("mean_t_test", f"""WITH g AS (SELECT c_mktsegment, COUNT(*)::DOUBLE AS n, AVG(c_acctbal) AS m, STDDEV_SAMP(c_acctbal) AS s FROM customer GROUP BY 1),
  x AS (SELECT c_mktsegment, n, (m - 4500) / (s / sqrt(n)) AS t FROM g)
  SELECT c_mktsegment, n::BIGINT AS n, {r('t', 6)} AS t, {r(sql_t_tails('t', '(n - 1)'), 8)} AS p_value FROM x""")
def mean_t_test(t):
    """Whether the mean balance of a segment differs from 4500."""
    stats = t("customer").groupBy("c_mktsegment").agg(F.count("c_acctbal").alias("n"), F.avg("c_acctbal").alias("m"), F.stddev_samp("c_acctbal").alias("s"))
    value = (F.col("m") - 4500) / (F.col("s") / F.sqrt("n"))
    return stats.withColumn("t", value).select("c_mktsegment", "n", rounded(F.col("t"), 6).alias("t"), rounded(t_tails(F.col("t"), F.col("n") - 1), 8).alias("p_value"))


@query("mean_t95", f"""WITH RECURSIVE g AS (SELECT n_name AS nation, COUNT(*) AS n, AVG(c_acctbal) AS m, STDDEV_SAMP(c_acctbal) AS s FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1),
  q(v, lo, hi, i) AS (SELECT DISTINCT (n - 1)::DOUBLE, 0::DOUBLE, 13::DOUBLE, 0 FROM g WHERE n > 1 UNION ALL
    SELECT v, CASE WHEN p > 0.05 THEN (lo + hi) / 2 ELSE lo END, CASE WHEN p > 0.05 THEN hi ELSE (lo + hi) / 2 END, i + 1
    FROM (SELECT *, {sql_t_tails('((lo + hi) / 2)', 'v').replace('range(0, 4000)', 'range(0, 1500)')} AS p FROM q WHERE i < 46)),
  f AS (SELECT v, (lo + hi) / 2 AS t FROM q WHERE i = 46)
  SELECT nation, n, {r('m', 4)} AS mean, {r('m - t * s / sqrt(n)', 4)} AS low, {r('m + t * s / sqrt(n)', 4)} AS high FROM g LEFT JOIN f ON v = n - 1""")
def mean_t95(t):
    people = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("nation"), "c_acctbal")
    return aggregates.mean_interval_t(people, ["nation"], "c_acctbal")


# --- loads -------------------------------------------------------------------
DECLARED = {"o_totalprice": "REAL", "o_orderdate": "DATE", "o_custkey": "INTEGER"}


def text_orders(t):
    """Orders as text; some prices, days and customers are not what they are declared as."""
    o = t("orders")
    key = F.col("o_orderkey")
    return o.select(
        "o_orderkey", F.when(F.col("o_orderpriority") == "1-URGENT", "n/a").otherwise(F.col("o_totalprice").cast("string")).alias("o_totalprice"),
        F.when(key % 11 == 3, "1997-13-01").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("o_orderdate"),
        F.when(key % 7 == 2, F.lit(None)).when(key % 13 == 5, F.concat(F.lit("c"), F.col("o_custkey"))).otherwise(F.col("o_custkey").cast("string")).alias("o_custkey"),
    )


@query("typed_load_replayed", """WITH x AS (SELECT o_orderkey AS k, o_orderpriority = '1-URGENT' AS a, o_orderkey % 11 = 3 AS d, o_orderkey % 7 <> 2 AND o_orderkey % 13 = 5 AS c,
    o_orderkey % 7 = 2 AS e, o_totalprice AS p, CAST(o_orderdate AS DATE) AS day, o_custkey AS u FROM orders)
  SELECT 'rows' AS part, NULL AS reason, COUNT(*) AS n, SUM(k)::BIGINT AS keys, COUNT(*) FILTER (WHERE NOT a) AS prices, COUNT(*) FILTER (WHERE NOT d) AS days,
    (SUM(u) FILTER (WHERE NOT e AND NOT c))::BIGINT AS customers FROM x
  UNION ALL SELECT 'o_totalprice', 'no double', COUNT(*), SUM(k)::BIGINT, NULL, NULL, NULL FROM x WHERE a HAVING COUNT(*) > 0
  UNION ALL SELECT 'o_orderdate', 'no date', COUNT(*), SUM(k)::BIGINT, NULL, NULL, NULL FROM x WHERE d HAVING COUNT(*) > 0
  UNION ALL SELECT 'o_custkey', 'no bigint', COUNT(*), SUM(k)::BIGINT, NULL, NULL, NULL FROM x WHERE c HAVING COUNT(*) > 0""")
def typed_load_replayed(t):
    """Text orders loaded as a stream of several batches, one of which is played back, read from both sides."""
    folder = writers.scratch_folder(t.spark, "load")
    text_orders(t).repartition(4, "o_orderkey").write.parquet(f"{folder}/in")
    like = t.spark.read.parquet(f"{folder}/in")
    stream = t.spark.readStream.schema(like.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    loading.load_stream(stream, folder, "o_orderkey", DECLARED).awaitTermination()
    again = loading.loaded(t.spark, folder).where("batch = 0").select("o_orderkey")
    loading.load_batch(like.join(again, "o_orderkey", "left_semi"), 0, folder, "o_orderkey", DECLARED)
    none = F.lit(None).cast("long")
    rows = loading.loaded(t.spark, folder).agg(
        F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys"), F.count("o_totalprice").alias("prices"), F.count("o_orderdate").alias("days"),
        F.sum("o_custkey").alias("customers"),
    ).select(F.lit("rows").alias("part"), F.lit(None).cast("string").alias("reason"), "*")
    bad = loading.loaded(t.spark, folder, "failures").groupBy(F.col("column_name").alias("part"), "reason").agg(
        F.count(F.lit(1)).alias("n"), F.sum("key").alias("keys")
    )
    return rows.unionByName(bad.select("*", none.alias("prices"), none.alias("days"), none.alias("customers")))


# --- runs --------------------------------------------------------------------
SQL_STATUS = SQL_RUNS + """, s AS (SELECT *, concat_ws(',', CASE WHEN NOT v THEN 'view' END, CASE WHEN NOT c THEN 'click' END, CASE WHEN NOT p THEN 'purchase' END) AS sk FROM n),
    f AS (SELECT *, concat_ws('; ', CASE WHEN wall > 120 THEN 'time' END, CASE WHEN calls >= 250 THEN 'calls' END, CASE WHEN sk <> '' THEN 'skipped ' || sk END) AS why FROM s),
    j AS (SELECT query_id, day, CASE WHEN v AND why = '' THEN 'success' WHEN v THEN 'partial' ELSE 'failed' END AS status,
      CASE WHEN NOT v AND why = '' THEN 'no usable output' ELSE why END AS reasons FROM f)"""


@query("failure_reasons", SQL_STATUS + """ SELECT status, UNNEST(string_split(reasons, '; ')) AS reason, COUNT(*) AS n_runs FROM j WHERE status <> 'success' GROUP BY 1, 2""")
def failure_reasons(t):
    return compare.failure_reasons(run_status(t))


@contextmanager
def rocks(spark):
    """The state store for many open runs, for the time a stream runs."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, runs.ROCKS)
    try:
        yield
    finally:
        spark.conf.set(key, before)


@query("stream_run_status", SQL_STATUS + """, e AS (SELECT query_id, CAST("at" AS DATE) AS day, COUNT(*) AS steps, COUNT(*) FILTER (WHERE status = 'failed') AS failed,
    MAX("at") AS last FROM traces GROUP BY 1, 2)
  SELECT j.query_id, j.day, j.status, j.reasons, e.steps, e.failed FROM j JOIN e ON j.query_id = e.query_id AND j.day = e.day
  WHERE e.last + INTERVAL 1 DAY <= (SELECT date_trunc('millisecond', MAX("at")) FROM traces) - INTERVAL 10 MINUTE""")
def stream_run_status(t):
    """Runs closed after a day of silence, judged as in ``run_status``."""
    def build(stream):
        steps = stream.select(
            F.col("user_id").alias("query_id"), F.col("ts").cast("date").alias("day"), "ts", F.col("event_type").alias("agent"),
            F.when(F.col("event_type") == "error", "failed").otherwise("success").alias("status"), F.col("value").alias("duration"),
            F.get_json_object("props", "$.k").cast("long").alias("calls"),
        )
        return runs.closed_runs(steps, ["query_id", "day"], "ts", ["view", "click", "purchase"], "view", 120, 250)

    with rocks(t.spark):
        return run_stream(t, "runs", build)


# --- partitions --------------------------------------------------------------
@query("pruned_periods", f"""WITH x AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS year, CAST(quarter(o_orderdate) AS INTEGER) AS quarter, CAST(o_totalprice AS DECIMAL(18,2)) AS p, o_orderdate FROM orders)
  SELECT year, quarter, COUNT(*) AS n, CAST(SUM(p) AS DOUBLE) AS total FROM x WHERE year = 1997 AND quarter <= 2 GROUP BY 1, 2
  UNION ALL SELECT year, quarter, COUNT(*), CAST(SUM(p) AS DOUBLE) FROM x WHERE year > 1997 AND quarter = 4 GROUP BY 1, 2""")
def pruned_periods(t):
    """Orders in folders by year and quarter: two quarters by a filter, others through a calendar."""
    path = writers.scratch_folder(t.spark, "facts")
    writers.write_facts(t("orders").select("o_orderkey", "o_totalprice", "o_orderdate"), path, "o_orderdate")
    facts = t.spark.read.parquet(path)
    calendar = t("orders").select(F.year("o_orderdate").alias("year"), F.quarter("o_orderdate").alias("quarter")).distinct()
    wanted = durable(calendar).where("year > 1997 AND quarter = 4")
    parts = facts.where("year = 1997 AND quarter <= 2").unionByName(facts.join(F.broadcast(wanted), ["year", "quarter"]).select(*facts.columns))
    return parts.groupBy("year", "quarter").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total")
    )
