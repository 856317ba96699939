"""Shares, ranks and series over the business roles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlight.functions import money, ratio, rounded
from ledgerlight.operators import windows as w
from ledgerlight.plans import bindings as b
from ledgerlight.plans.bindings import sql_money as m
from ledgerlight.plans.bindings import sql_ratio as q
from ledgerlight.plans.bindings import sql_round as r
from ledgerlight.plans.registry import query
from ledgerlight.session import durable

S = f"WITH {b.SQL_SALES} "
H = f"WITH {b.SQL_HEADS} "
STAFF = f"WITH {b.SQL_STAFF} "
# Months counted from year 0, so that neighbouring months differ by one.
REGION_MONTHS = S + """, s AS (SELECT region, year * 12 + month - 1 AS period, SUM(amount) AS revenue
  FROM sales GROUP BY 1, 2) """
SPEND = H + ", v AS (SELECT customer_id, SUM(total) AS spend, COUNT(*) AS orders FROM heads GROUP BY 1) "
PRODUCTS = S + ", v AS (SELECT product_id, SUM(amount) AS revenue, SUM(quantity)::BIGINT AS units FROM sales GROUP BY 1) "


def region_months(t):
    return b.order_sums(t, "customer").groupBy("region", (F.col("year") * 12 + F.col("month") - 1).alias("period")).agg(
        F.sum("amount").alias("revenue")
    )


def spend(t):
    return b.heads(t).groupBy("customer_id").agg(F.sum("total").alias("spend"), F.count(F.lit(1)).alias("orders"))


def products(t):
    return b.sales(t).groupBy("product_id").agg(F.sum("amount").alias("revenue"), F.sum("quantity").alias("units"))


@query("share_of_total", H + f"""
  SELECT year, payment, COUNT(*) AS orders,
    {r(q('100.0 * COUNT(*)', 'SUM(COUNT(*)) OVER (PARTITION BY year)'), 1)} AS pct FROM heads GROUP BY 1, 2""")
def share_of_total(t):
    counts = b.heads(t).groupBy("year", "payment").agg(F.count(F.lit(1)).alias("orders"))
    return w.share_of_total(durable(counts), "orders", ["year"])


@query("rank_metric", S + f"""
  SELECT nation, {m('SUM(amount)')} AS revenue, RANK() OVER (ORDER BY SUM(amount) DESC) AS position
  FROM sales GROUP BY 1 ORDER BY SUM(amount) DESC, nation LIMIT 10""")
def rank_metric(t):
    by_nation = b.order_sums(t, "customer").groupBy("nation").agg(F.sum("amount").alias("x"))
    top = w.ranked(durable(by_nation), "x", name="position").orderBy(F.desc("x"), "nation").limit(10)
    return top.select("nation", money(F.col("x")).alias("revenue"), "position")


@query("ntile_tiers", SPEND + f"""
  SELECT tile::BIGINT AS tile, COUNT(*) AS customers, {m('SUM(spend)')} AS spend, {m('MIN(spend)')} AS lowest FROM (
    SELECT *, NTILE(5) OVER (ORDER BY spend DESC, customer_id) AS tile FROM v) GROUP BY 1""")
def ntile_tiers(t):
    return w.tiles(durable(spend(t)), "spend", "customer_id", 5).groupBy("tile").agg(
        F.count(F.lit(1)).alias("customers"), money(F.sum("spend")).alias("spend"), money(F.min("spend")).alias("lowest")
    )


@query("peer_avg", STAFF + f"""
  SELECT employee_id, level, CAST(salary AS DOUBLE) AS salary,
    {q('SUM(salary) OVER (PARTITION BY level)', 'COUNT(*) OVER (PARTITION BY level)')} AS peer_mean,
    CAST(salary AS DOUBLE) - {q('SUM(salary) OVER (PARTITION BY level)', 'COUNT(*) OVER (PARTITION BY level)')} AS gap
  FROM staff""")
def peer_avg(t):
    # No self join on the team: that would weight the mean by team size.
    return w.peer_gap(b.staff(t), "salary", ["level"]).select(
        "employee_id", "level", F.col("salary").cast("double").alias("salary"), "peer_mean", "gap"
    )


@query("pct_change", REGION_MONTHS + f""", c AS (
    SELECT *, LAG(revenue) OVER (PARTITION BY region ORDER BY period) AS previous FROM s),
  p AS (SELECT *, {r('100.0::DOUBLE * ' + q('revenue - previous', 'previous'))} AS pct_change FROM c)
  SELECT region, period, {m('revenue')} AS revenue, {m('previous')} AS previous, pct_change,
    pct_change < -20 AS drop_20, pct_change < -30 AS drop_30 FROM p""")
def pct_change(t):
    out = w.change(region_months(t), ["region"], "period", "revenue")
    return out.select(
        "region", "period", money(F.col("revenue")).alias("revenue"), money(F.col("previous")).alias("previous"),
        "pct_change", (F.col("pct_change") < -20).alias("drop_20"), (F.col("pct_change") < -30).alias("drop_30"),
    )


@query("running_total", H + f""", s AS (SELECT payment, year, month, SUM(total) AS x FROM heads GROUP BY 1, 2, 3)
  SELECT payment, year, month, {m('SUM(x) OVER (PARTITION BY payment, year ORDER BY month)')} AS year_to_date,
    {m('SUM(x) OVER (PARTITION BY payment, year ORDER BY month) - 5000000 * month')} AS variance_to_plan FROM s""")
def running_total(t):
    plan_per_month = 5_000_000
    months = b.heads(t).groupBy("payment", "year", "month").agg(F.sum("total").alias("x"))
    out = w.cumulative(months, ["payment", "year"], "month", "x")
    return out.select(
        "payment", "year", "month", money(F.col("cumulative")).alias("year_to_date"),
        money(F.col("cumulative") - plan_per_month * F.col("month")).alias("variance_to_plan"),
    )


@query("moving_avg", REGION_MONTHS + f""", a AS (SELECT *,
    {q('SUM(revenue) OVER w', 'COUNT(*) OVER w')} AS ma FROM s
    WINDOW w AS (PARTITION BY region ORDER BY period ROWS 2 PRECEDING))
  SELECT region, period, {r('ma', 4)} AS moving_avg, {r('CAST(revenue AS DOUBLE) - ma', 4)} AS deviation,
    CAST(revenue AS DOUBLE) > 2 * ma AS is_double FROM a""")
def moving_avg(t):
    x = F.col("revenue").cast("double")
    return w.moving(region_months(t), ["region"], "period", "revenue", 3).select(
        "region", "period", rounded(F.col("moving_avg"), 4).alias("moving_avg"),
        rounded(x - F.col("moving_avg"), 4).alias("deviation"), (x > 2 * F.col("moving_avg")).alias("is_double"),
    )


@query("ema", "WITH RECURSIVE " + (REGION_MONTHS[5:] + f""", k AS (SELECT region, period, CAST(revenue AS DOUBLE) AS x,
    ROW_NUMBER() OVER (PARTITION BY region ORDER BY period) AS i FROM s),
  f AS (SELECT region, period, i, x AS ema FROM k WHERE i = 1
    UNION ALL SELECT k.region, k.period, k.i, 0.5::DOUBLE * k.x + 0.5::DOUBLE * f.ema FROM f JOIN k
      ON k.region = f.region AND k.i = f.i + 1)
  SELECT region, period, {r('ema', 4)} AS ema FROM f"""))
def ema(t):
    return w.ema(region_months(t), ["region"], "period", "revenue", span=3).select(
        "region", "period", rounded(F.col("ema"), 4).alias("ema")
    )


@query("pareto_abc", PRODUCTS + f""", c AS (SELECT product_id, revenue, {r('100.0::DOUBLE * ' + q(
    'SUM(revenue) OVER (ORDER BY revenue DESC, product_id ROWS UNBOUNDED PRECEDING)', 'SUM(revenue) OVER ()'), 4)} AS cumulative_pct FROM v)
  SELECT product_id, {m('revenue')} AS revenue, cumulative_pct,
    CASE WHEN cumulative_pct <= 80 THEN 'A' WHEN cumulative_pct <= 95 THEN 'B' ELSE 'C' END AS abc FROM c""")
def pareto_abc(t):
    out = w.abc_classes(durable(products(t).select("product_id", "revenue")), "revenue", "product_id")
    return out.withColumn("revenue", money(F.col("revenue")))


@query("pareto_cover", PRODUCTS + f""", c AS (SELECT *, SUM(revenue) OVER (ORDER BY revenue DESC, product_id ROWS UNBOUNDED PRECEDING)
    - revenue AS before, SUM(revenue) OVER () AS total FROM v)
  SELECT COUNT(*) FILTER (WHERE {q('before', 'total')} * 100 < 80) AS n_entities, COUNT(*) AS n_all,
    {m(f"SUM(revenue) FILTER (WHERE {q('before', 'total')} * 100 < 80)")} AS covered FROM c""")
def pareto_cover(t):
    out = w.smallest_cover(durable(products(t).select("product_id", "revenue")), "revenue", "product_id", 80.0)
    return out.withColumn("covered", money(F.col("covered")))


STREAKS = REGION_MONTHS + """, d AS (SELECT region, period,
    CAST(SIGN(CAST(revenue AS DOUBLE) - CAST(LAG(revenue) OVER (PARTITION BY region ORDER BY period) AS DOUBLE)) AS INTEGER) AS dir FROM s),
  g AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY region ORDER BY period)
    - ROW_NUMBER() OVER (PARTITION BY region, dir ORDER BY period) AS isle FROM d WHERE dir IS NOT NULL),
  runs AS (SELECT region, dir, COUNT(*) AS length, MIN(period) AS first, MAX(period) AS last FROM g GROUP BY region, dir, isle) """


@query("streaks", STREAKS + """
  SELECT region, MAX(CASE WHEN dir = 1 THEN length ELSE 0 END) AS longest_rise,
    MAX(CASE WHEN dir = -1 THEN length ELSE 0 END) AS longest_fall FROM runs GROUP BY 1""")
def streaks(t):
    return w.longest_streaks(region_months(t), ["region"], "period", "revenue")


@query("falls_in_a_row", STREAKS + """
  SELECT region, length, first, last FROM runs WHERE dir = -1 AND length >= 3""")
def falls_in_a_row(t):
    runs = w.streaks(region_months(t), ["region"], "period", "revenue")
    return runs.where((F.col("direction") == -1) & (F.col("length") >= 3)).drop("direction")


@query("seasonal_index", REGION_MONTHS + f"""
  SELECT region, (period % 12 + 1)::BIGINT AS month, {r(q('SUM(revenue)', 'COUNT(*)'), 4)} AS season_mean,
    {r('STDDEV_SAMP(CAST(revenue AS DOUBLE))', 4)} AS season_std,
    {r(q('SUM(revenue)', 'COUNT(*)') + ' / ' + q('SUM(SUM(revenue)) OVER (PARTITION BY region)', 'SUM(COUNT(*)) OVER (PARTITION BY region)'), 6)} AS seasonal_index
  FROM s GROUP BY 1, 2""")
def seasonal_index(t):
    months = region_months(t).withColumn("month", F.col("period") % 12 + 1)
    return w.seasonal_index(durable(months), ["region"], "month", "revenue")


@query("group_zscore", """WITH g AS (SELECT o_orderkey, o_orderpriority, (o_totalprice - AVG(o_totalprice) OVER p)
    / NULLIF(STDDEV_POP(o_totalprice) OVER p, 0) AS z FROM orders WINDOW p AS (PARTITION BY o_orderpriority)),
  k AS (SELECT o_orderkey, o_orderpriority, ROUND(COALESCE(z, 0), 3) AS z FROM g)
  SELECT *, abs(z) > 1.7 AS is_outlier FROM k""")
def group_zscore(t):
    df = t("orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    return w.zscore(df, "o_totalprice", ["o_orderpriority"], limit=1.7).drop("o_totalprice")


@query("order_gap", H + """, g AS (SELECT customer_id, order_date, date_diff('day',
    LAG(order_date) OVER (PARTITION BY customer_id ORDER BY order_date, order_id), order_date) AS gap FROM heads)
  SELECT customer_id, COUNT(*) AS n_rows, date_diff('day', MIN(order_date), MAX(order_date))::BIGINT AS span_days,
    CAST(SUM(gap) AS DOUBLE) / COUNT(gap) AS mean_gap FROM g GROUP BY 1""")
def order_gap(t):
    return w.order_gaps(b.heads(t), ["customer_id"], "order_date")


@query("vs_trailing_mean", REGION_MONTHS + f"""
  SELECT region, period, {r('CAST(revenue AS DOUBLE) / ' + q('SUM(revenue) OVER w', 'COUNT(*) OVER w'), 4)} AS vs_prior FROM s
  WINDOW w AS (PARTITION BY region ORDER BY period ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)""")
def vs_trailing_mean(t):
    return w.trailing_mean(region_months(t), ["region"], "period", "revenue", 3).select(
        "region", "period", rounded(ratio(F.col("revenue"), F.col("prior_mean")), 4).alias("vs_prior")
    )


@query("topn_per_group", S + f""", v AS (SELECT region, product_id, SUM(amount) AS x FROM sales GROUP BY 1, 2),
    k AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY region ORDER BY x DESC, product_id) AS position FROM v)
  SELECT region, product_id, {m('x')} AS revenue, position FROM k WHERE position <= 5""")
def topn_per_group(t):
    df = b.sales(t, "customer").groupBy("region", "product_id").agg(F.sum("amount").alias("x"))
    top = w.top_per_group(df, ["region"], [F.desc("x"), F.col("product_id")], 5)
    return top.select("region", "product_id", money(F.col("x")).alias("revenue"), F.col("position").cast("long").alias("position"))


@query("salary_bands", STAFF + f""", p AS (SELECT employee_id, department, salary,
    PERCENT_RANK() OVER (PARTITION BY department ORDER BY salary) AS pr FROM staff)
  SELECT employee_id, department, pr AS pct_rank,
    CASE WHEN pr < 0.2 THEN 'Low' WHEN pr < 0.5 THEN 'Mid' ELSE 'High' END AS band FROM p""")
def salary_bands(t):
    return w.bands(b.staff(t), "salary", ["department"], [(0.2, "Low"), (0.5, "Mid")], "High").select(
        "employee_id", "department", "pct_rank", "band"
    )


@query("minmax_scale", """
  SELECT p_partkey, (p_size - (SELECT MIN(p_size) FROM part))::DOUBLE / (SELECT MAX(p_size) - MIN(p_size) FROM part)::DOUBLE AS p_size,
    (p_retailprice - (SELECT MIN(p_retailprice) FROM part)) / (SELECT MAX(p_retailprice) - MIN(p_retailprice) FROM part) AS p_retailprice
  FROM part""")
def minmax_scale(t):
    return w.minmax_scale(t("part").select("p_partkey", "p_size", "p_retailprice"), ["p_size", "p_retailprice"])


@query("standardise", f"""WITH z AS (SELECT c_custkey, (c_acctbal - (SELECT AVG(c_acctbal) FROM customer)) /
    (SELECT STDDEV_SAMP(c_acctbal) FROM customer) AS z FROM customer)
  SELECT c_custkey, {r('(z - (SELECT MIN(z) FROM z)) / (SELECT MAX(z) - MIN(z) FROM z)', 6)} AS c_acctbal FROM z""")
def standardise(t):
    return w.standardise(t("customer").select("c_custkey", "c_acctbal"), ["c_acctbal"])


@query("weighted_rank", PRODUCTS + f"""
  SELECT product_id, {r('0.4 * RANK() OVER (ORDER BY revenue DESC) + 0.6 * RANK() OVER (ORDER BY units DESC)', 4)} AS score FROM v""")
def weighted_rank(t):
    return w.weighted_rank(durable(products(t)), {"revenue": 0.4, "units": 0.6}).select("product_id", "score")


@query("spread_in_group", STAFF + f"""
  SELECT level, CAST(MIN(salary) AS DOUBLE) AS lowest, CAST(MAX(salary) AS DOUBLE) AS highest,
    {q('SUM(salary)', 'COUNT(*)')} AS mean, {q('MAX(salary)', 'MIN(salary)')} AS max_min_ratio
  FROM staff WHERE salary > 0 GROUP BY 1""")
def spread_in_group(t):
    return w.spread(b.staff(t).where("salary > 0"), "salary", ["level"])


@query("spread_flags", STAFF + f""", p AS (SELECT * FROM staff WHERE salary > 0)
  SELECT employee_id, level, CAST(salary AS DOUBLE) > 2 * CAST(MIN(salary) OVER g AS DOUBLE) AS over_lowest,
    CAST(salary AS DOUBLE) > 1.5 * {q('SUM(salary) OVER g', 'COUNT(*) OVER g')} AS over_mean_150,
    CAST(salary AS DOUBLE) > 2 * {q('SUM(salary) OVER g', 'COUNT(*) OVER g')} AS over_mean
  FROM p WINDOW g AS (PARTITION BY level)""")
def spread_flags(t):
    df = b.staff(t).where("salary > 0").select("employee_id", "level", "salary")
    return w.spread_flags(df, "salary", ["level"], {"over_mean_150": 1.5, "over_mean": 2.0}).drop("salary")
