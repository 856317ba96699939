"""Outlier detection, period comparison and the named detectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlight.functions import money, ratio, rounded
from ledgerlight.operators import anomaly, relational
from ledgerlight.operators import windows as w
from ledgerlight.operators.scale import broadcast_if_small, group_total
from ledgerlight.plans import bindings as b
from ledgerlight.plans.bindings import sql_money as m
from ledgerlight.plans.bindings import sql_ratio as q
from ledgerlight.plans.bindings import sql_round as r
from ledgerlight.plans.registry import query
from ledgerlight.session import durable

S = f"WITH {b.SQL_SALES}"
H = f"WITH {b.SQL_HEADS}"

BOUNDS = """WITH s AS (SELECT AVG(value) AS mean, STDDEV_POP(value) AS std, quantile_cont(value, 0.25) AS q1,
    quantile_cont(value, 0.75) AS q3 FROM events),
  f AS (SELECT *, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM s),
  e AS (SELECT event_id, value, ABS(value - mean) / std AS d, value > mean AS up, value < lo OR value > hi AS reason_iqr,
    ABS(value - mean) / std >= 2 AS reason_sigma FROM events, f)
  """
FOUND = f"""SELECT event_id, value, {r('d')} AS sigma,
    CASE WHEN up THEN 'positive_outlier' ELSE 'negative_outlier' END AS direction, reason_sigma, reason_iqr FROM e WHERE """


@query("anomaly_sigma", BOUNDS + FOUND + "reason_sigma")
def anomaly_sigma(t):
    return anomaly.detect(t("events"), "event_id", "value", method="sigma")


@query("anomaly_iqr", BOUNDS + FOUND + "reason_iqr")
def anomaly_iqr(t):
    return anomaly.detect(t("events"), "event_id", "value", method="iqr")


@query("anomaly_hybrid", BOUNDS + FOUND + "(reason_sigma OR reason_iqr)")
def anomaly_hybrid(t):
    return anomaly.detect(t("events"), "event_id", "value", method="hybrid")


LIMITS = ["q1", "q3", "iqr", "iqr_lower", "iqr_upper", "mean", "std", "sigma_lower", "sigma_upper", "lower", "upper"]


@query("anomaly_thresholds", BOUNDS + ", l AS (SELECT q1, q3, iqr, lo AS iqr_lower, hi AS iqr_upper, mean, std, mean - 2 * std AS sigma_lower, "
       "mean + 2 * std AS sigma_upper, lo AS lower, hi AS upper FROM f) SELECT "
       .replace("  , l AS", ", l AS") + ", ".join(f"{r(c, 6)} AS {c}" for c in LIMITS) + " FROM l")
def anomaly_thresholds(t):
    out = anomaly.thresholds(t("events"), "value", method="hybrid")
    return out.select(*[rounded(F.col(c), 6).alias(c) for c in LIMITS])


SWEPT = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("anomaly_sweep", "WITH u AS (" + " UNION ALL ".join(
    f"SELECT l_orderkey, '{c}' AS \"column\", CAST({c} AS DOUBLE) AS value FROM lineitem" for c in SWEPT) + f"""),
  s AS (SELECT "column", AVG(value) AS mean, STDDEV_POP(value) AS std FROM u GROUP BY 1)
  SELECT l_orderkey, u."column", value, {r('ABS(value - mean) / std')} AS sigma,
    CASE WHEN value > mean THEN 'positive_outlier' ELSE 'negative_outlier' END AS direction
  FROM u JOIN s ON u."column" = s."column" WHERE ABS(value - mean) / std >= 1.7""")
def anomaly_sweep(t):
    return anomaly.sweep(t("lineitem"), "l_orderkey", SWEPT, 1.7)


YEARS = S + """, p AS (SELECT nation, SUM(CASE WHEN year = 2000 THEN amount END) AS cur, SUM(CASE WHEN year = 1999 THEN amount END) AS prev
    FROM sales WHERE year IN (1999, 2000) GROUP BY 1)"""


def two_years(t):
    def of(year):
        return F.sum(F.when(F.col("year") == year, F.col("amount")))

    return durable(b.order_sums(t, "customer", where=b.year_span(1999, 2000)).groupBy("nation").agg(
        of(2000).alias("rev_current"), of(1999).alias("rev_previous")
    ))


@query("compare_periods", YEARS + f""", c AS (SELECT nation, cur, prev, CASE WHEN prev > 0 THEN
    {r('(CAST(cur AS DOUBLE) - CAST(prev AS DOUBLE)) / CAST(prev AS DOUBLE) * 100')} END AS pct_change FROM p),
  g AS (SELECT *, {r('ABS(pct_change - AVG(pct_change) OVER ()) / STDDEV_POP(pct_change) OVER ()')} AS change_sigma FROM c)
  SELECT nation, {m('cur')} AS rev_current, {m('prev')} AS rev_previous, pct_change, 'YOY' AS period_comparison, change_sigma,
    change_sigma >= 2.0 AS is_anomaly FROM g""")
def compare_periods(t):
    out = anomaly.compare_periods(two_years(t), "rev_current", "rev_previous", group_col="nation")
    return out.withColumns({c: money(F.col(c)) for c in ("rev_current", "rev_previous")})


@query("yoy_iqr_flag", YEARS + f""", c AS (SELECT nation, {r(q('CAST(cur AS DOUBLE) - CAST(prev AS DOUBLE)', 'prev') + ' * 100')} AS y FROM p),
  f AS (SELECT quantile_cont(y, 0.25) AS q1, quantile_cont(y, 0.75) AS q3 FROM c)
  SELECT nation, y AS yoy_pct, y < q1 - 1.5 * (q3 - q1) OR y > q3 + 1.5 * (q3 - q1) AS is_anomaly FROM c, f""")
def yoy_iqr_flag(t):
    return anomaly.change_outside_fences(two_years(t), "rev_current", "rev_previous").select(
        "nation", "yoy_pct", "is_anomaly"
    )


@query("group_iqr", """WITH f AS (SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3
    FROM events GROUP BY 1)
  SELECT event_id, e.event_type, value FROM events e JOIN f USING (event_type)
  WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)""")
def group_iqr(t):
    df = t("events").select("event_id", "event_type", "value")
    return anomaly.group_fences(df, "value", ["event_type"]).select("event_id", "event_type", "value")


@query("mean_kstd", """WITH s AS (SELECT event_type, AVG(value) AS m, STDDEV_SAMP(value) AS d FROM events GROUP BY 1)
  SELECT event_id, e.event_type, value FROM events e JOIN s USING (event_type) WHERE value > m + 3 * d""")
def mean_kstd(t):
    return anomaly.above_mean(t("events").select("event_id", "event_type", "value"), "value", 3.0, ["event_type"])


def rest_sql(value: str, part: str) -> str:
    """Leave-one-out mean of an aggregated column."""
    return q(f"SUM({value}) OVER ({part}) - {value}", f"COUNT({value}) OVER ({part}) - 1")


@query("baseline_multiple", H + f""", a AS (SELECT payment, year * 100 + month AS ym, COUNT(*) AS orders FROM heads GROUP BY 1, 2),
  k AS (SELECT *, {rest_sql('orders', 'PARTITION BY payment')} AS baseline FROM a)
  SELECT payment, ym, orders, {r('baseline', 4)} AS baseline, {r('orders / baseline', 4)} AS multiple,
    {r('(orders / baseline - 1) * 100', 4)} AS deviation_pct, orders / baseline >= 1.2 AS is_spike FROM k""")
def baseline_multiple(t):
    months = b.heads(t).groupBy("payment", (F.col("year") * 100 + F.col("month")).alias("ym")).agg(
        F.count(F.lit(1)).alias("orders")
    )
    out = anomaly.against_rest(durable(months), "orders", ["payment"], 1.2)
    return out.withColumns({c: rounded(F.col(c), 4) for c in ("baseline", "multiple", "deviation_pct")})


# --- named detectors ---------------------------------------------------------
@query("spike_month", S + f""", a AS (SELECT region, month, SUM(amount) AS x FROM sales WHERE status = 'F' AND year = 1998 GROUP BY 1, 2),
  k AS (SELECT *, {rest_sql('x', 'PARTITION BY region')} AS baseline FROM a)
  SELECT region, month, {m('x')} AS revenue, {r('CAST(x AS DOUBLE) / baseline', 4)} AS multiple, CAST(x AS DOUBLE) / baseline >= 1.2 AS is_spike FROM k""")
def spike_month(t):
    done = b.year_span(1998) & (F.col("status") == "F")
    months = b.order_sums(t, "customer", where=done).groupBy("region", "month").agg(
        F.sum("amount").alias("x")
    )
    return anomaly.against_rest(durable(months), "x", ["region"], 1.2).select(
        "region", "month", money(F.col("x")).alias("revenue"), rounded(F.col("multiple"), 4).alias("multiple"), "is_spike"
    )


@query("below_cost", S + f"""
  SELECT order_id, product_id, order_date, {m('amount')} AS effective_price, {m('amount - cost')} AS margin
  FROM sales WHERE order_date >= DATE '2000-04-01' AND amount < cost""")
def below_cost(t):
    late = F.col("order_date") >= F.lit("2000-04-01").cast("date")
    return b.sales(t, "order", "product").where(late & (F.col("amount") < F.col("cost"))).select(
        "order_id", "product_id", "order_date", money(F.col("amount")).alias("effective_price"),
        money(F.col("amount") - F.col("cost")).alias("margin"),
    )


@query("segment_churn", f"""WITH c AS (SELECT c_custkey, c_mktsegment AS segment FROM customer)
  SELECT segment, COUNT(DISTINCT c_custkey) AS churned FROM c
  WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderdate < TIMESTAMP '2000-07-01')
    AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderdate >= TIMESTAMP '2000-07-01') GROUP BY 1""")
def segment_churn(t):
    # Bought before and never since: the last order of the customer lies before the day.
    last = t("orders").groupBy("o_custkey").agg(F.max("o_orderdate").alias("last")).where(
        F.col("last") < F.lit("2000-07-01").cast("timestamp_ntz")
    )
    return t("customer").join(last, F.col("c_custkey") == F.col("o_custkey")).groupBy(
        F.col("c_mktsegment").alias("segment")
    ).agg(F.count(F.lit(1)).alias("churned"))


@query("refund_surge", S + f""", a AS (SELECT category, month, COUNT(*) AS refunds FROM sales
    WHERE return_flag = 'R' AND year = 1999 GROUP BY 1, 2), k AS (SELECT *, {rest_sql('refunds', 'PARTITION BY category')} AS baseline FROM a)
  SELECT category, month, refunds, {r('refunds / baseline', 4)} AS multiple, refunds / baseline >= 1.5 AS is_spike FROM k""")
def refund_surge(t):
    months = b.sales(t, "order", "product").where(b.year_span(1999) & (F.col("return_flag") == "R")).groupBy("category", "month").agg(
        F.count(F.lit(1)).alias("refunds")
    )
    return anomaly.against_rest(durable(months), "refunds", ["category"], 1.5).select(
        "category", "month", "refunds", rounded(F.col("multiple"), 4).alias("multiple"), "is_spike"
    )


@query("mix_shift", H + f""", a AS (SELECT CASE WHEN order_date < DATE '1998-04-01' THEN 'before' ELSE 'from' END AS period,
    payment, COUNT(*) AS cnt FROM heads GROUP BY 1, 2)
  SELECT period, payment, cnt, {r(q('100.0 * cnt', 'SUM(cnt) OVER (PARTITION BY period)'), 1)} AS pct FROM a""")
def mix_shift(t):
    period = F.when(F.col("order_date") < F.lit("1998-04-01").cast("date"), "before").otherwise("from")
    counts = b.heads(t).groupBy(period.alias("period"), "payment").agg(F.count(F.lit(1)).alias("cnt"))
    return w.share_of_total(durable(counts), "cnt", ["period"], places=1)


@query("below_threshold", f"""WITH {b.SQL_STOCK}
  SELECT product_id, site_id, product, quantity, min_threshold, quantity - min_threshold AS gap FROM stock
  WHERE quantity < min_threshold""")
def below_threshold(t):
    return b.stock(t).where(F.col("quantity") < F.col("min_threshold")).select(
        "product_id", "site_id", "product", "quantity", "min_threshold",
        (F.col("quantity") - F.col("min_threshold")).alias("gap"),
    )


@query("dead_stock", f"""WITH {b.SQL_STOCK}, {b.SQL_MOVES},
  a AS (SELECT MAX(movement_date) AS today FROM moves),
  l AS (SELECT product_id, MAX(CASE WHEN movement_type = 'outbound' THEN movement_date END) AS last_outbound,
    COUNT(*) FILTER (WHERE movement_type = 'inbound') AS inbound FROM moves GROUP BY 1),
  h AS (SELECT product_id, SUM(quantity)::BIGINT AS held FROM stock GROUP BY 1)
  SELECT product_id, last_outbound, held FROM h JOIN l USING (product_id), a
  WHERE inbound > 0 AND (last_outbound IS NULL OR last_outbound < today - 180)""")
def dead_stock(t):
    per = b.ledger(t, "product_id")
    today = per.agg(F.max("last_day")).scalar()
    idle = F.col("last_outbound").isNull() | (F.col("last_outbound") < F.date_sub(today, 180))
    return b.known_products(t, per.where((F.col("inbound") > 0) & idle)).select("product_id", "last_outbound", "held")


@query("writeoff_spike", f"""WITH {b.SQL_MOVES}, {b.SQL_SITES}, a AS (SELECT region, year(movement_date)::BIGINT AS yr,
    quarter(movement_date)::BIGINT AS qtr, COUNT(*) AS event_count, SUM(quantity)::BIGINT AS total_qty
    FROM moves JOIN sites USING (site_id) WHERE movement_type = 'write_off' GROUP BY 1, 2, 3),
  k AS (SELECT *, {rest_sql('event_count', 'PARTITION BY region')} AS baseline FROM a)
  SELECT region, yr, qtr, event_count, total_qty, {r('event_count / baseline', 4)} AS multiple FROM k""")
def writeoff_spike(t):
    quarters = b.movements(t).where("movement_type = 'write_off'").join(b.sites(t), "site_id").groupBy(
        "region", F.year("movement_date").cast("long").alias("yr"), F.quarter("movement_date").cast("long").alias("qtr")
    ).agg(F.count(F.lit(1)).alias("event_count"), F.sum("quantity").alias("total_qty"))
    return anomaly.against_rest(durable(quarters), "event_count", ["region"]).select(
        "region", "yr", "qtr", "event_count", "total_qty", rounded(F.col("multiple"), 4).alias("multiple")
    )


@query("orphan_outbound", f"""WITH {b.SQL_MOVES}, {b.SQL_SITES}
  SELECT region, COUNT(*) FILTER (WHERE order_ref IS NULL) AS unlinked_rows,
    COALESCE(SUM(quantity) FILTER (WHERE order_ref IS NULL), 0)::BIGINT AS unlinked_qty,
    COUNT(*) FILTER (WHERE order_ref IS NOT NULL AND o_orderkey IS NULL) AS dangling_rows
  FROM moves JOIN sites USING (site_id) LEFT JOIN orders ON order_ref = o_orderkey
  WHERE movement_type = 'outbound' AND movement_date >= DATE '2000-10-01' GROUP BY 1""")
def orphan_outbound(t):
    out = b.movements(t).where(
        (F.col("movement_type") == "outbound") & (F.col("movement_date") >= F.lit("2000-10-01").cast("date"))
    )
    # Rows without a reference never reach the join; they would all meet on the null key.
    known = t("orders").select(F.col("o_orderkey").alias("order_ref"), F.lit("linked").alias("link"))
    unlinked = out.where(F.col("order_ref").isNull()).withColumn("link", F.lit("none"))
    referring = out.where(F.col("order_ref").isNotNull()).join(known, "order_ref", "left")
    per_site = unlinked.unionByName(referring).groupBy("site_id").agg(
        F.count_if(F.col("link") == "none").alias("unlinked_rows"),
        F.coalesce(F.sum(F.when(F.col("link") == "none", F.col("quantity"))), F.lit(0)).alias("unlinked_qty"),
        F.count_if(F.col("link").isNull()).alias("dangling_rows"),
    )
    return per_site.join(b.sites(t), "site_id").groupBy("region").agg(
        *[F.sum(c).alias(c) for c in ("unlinked_rows", "unlinked_qty", "dangling_rows")]
    )


@query("transfer_loop", S + f""", {b.SQL_SITES}, legs AS (SELECT product_id, s.nation AS a, sales.nation AS z, ship_date AS d,
    COUNT(*) AS n, SUM(quantity)::BIGINT AS qty FROM sales JOIN sites s USING (site_id) WHERE s.nation <> sales.nation GROUP BY 1, 2, 3, 4)
  SELECT o.product_id, o.a AS from_nation, o.z AS to_nation, o.d AS out_date, i.d AS back_date, o.n AS n_out, o.qty AS qty_out,
    i.n AS n_back, i.qty AS qty_back, date_diff('day', o.d, i.d)::BIGINT AS days_between
  FROM legs o JOIN legs i ON o.product_id = i.product_id AND o.a = i.z AND o.z = i.a
  WHERE date_diff('day', o.d, i.d) BETWEEN 0 AND 30""")
def transfer_loop(t):
    # Orders get their nation before the lines meet them, so a line is shuffled once to its order
    # and once to its product and pair of nations; the sites are broadcast after a count.
    to = b.heads(t).select("order_id", "customer_id").join(
        b.members(t).select("customer_id", F.col("nation").alias("to_nation")), "customer_id"
    ).drop("customer_id")
    sites = broadcast_if_small(b.sites(t).select("site_id", F.col("nation").alias("from_nation")), max_rows=1_000_000)
    legs = b.sales(t).select("order_id", "product_id", "site_id", "quantity", "ship_date").join(to, "order_id").join(sites, "site_id")
    return relational.there_and_back(
        legs, key="product_id", start="from_nation", end="to_nation", day="ship_date", quantity="quantity", within=30
    )


@query("bonus_outlier", f"WITH {b.SQL_PAY}" + f""", s AS (SELECT *, CAST(bonus AS DOUBLE) > AVG(CAST(bonus AS DOUBLE)) OVER g
      + 3 * STDDEV_SAMP(CAST(bonus AS DOUBLE)) OVER g AS over_peers FROM pay WHERE month = 12 WINDOW g AS (PARTITION BY level))
  SELECT employee_id, level, order_date, CAST(base AS DOUBLE) AS base, CAST(bonus AS DOUBLE) AS bonus,
    {r(q('bonus', 'base'), 4)} AS bonus_ratio, over_peers FROM s WHERE over_peers OR {q('bonus', 'base')} > 0.075""")
def bonus_outlier(t):
    december = b.payroll(t).where("month = 12").withColumn("x", F.col("bonus").cast("double"))
    out = group_total(december, ["level"], _m=F.avg("x"), _d=F.stddev_samp("x"))
    share = ratio(F.col("bonus"), F.col("base"))
    return out.withColumn("over_peers", F.col("x") > F.col("_m") + 3 * F.col("_d")).where(
        F.col("over_peers") | (share > 0.075)
    ).select(
        "employee_id", "level", "order_date", F.col("base").cast("double").alias("base"), F.col("x").alias("bonus"),
        rounded(share, 4).alias("bonus_ratio"), "over_peers",
    )


@query("attrition_cluster", f"""WITH {b.SQL_STAFF_DATES}
  SELECT department, year(end_date)::BIGINT AS year, quarter(end_date)::BIGINT AS quarter, COUNT(*) AS terminated
  FROM staffed WHERE end_date IS NOT NULL GROUP BY 1, 2, 3""")
def attrition_cluster(t):
    return b.staff(t, dates=True).where("end_date IS NOT NULL").groupBy(
        "department", F.year("end_date").cast("long").alias("year"), F.quarter("end_date").cast("long").alias("quarter")
    ).agg(F.count(F.lit(1)).alias("terminated"))


@query("salary_inversion", f"""WITH {b.SQL_STAFF}, p AS (SELECT m.department, m.employee_id, MAX(s.salary) - m.salary AS gap, COUNT(*) AS n
    FROM staff m JOIN staff s ON m.department = s.department AND m.level = 'MACHINERY' AND s.level = 'BUILDING' AND m.salary < s.salary
    GROUP BY 1, 2, m.salary)
  SELECT department, COUNT(*) AS managers_below, SUM(n)::BIGINT AS pairs, CAST(MAX(gap) AS DOUBLE) AS widest_gap FROM p GROUP BY 1""")
def salary_inversion(t):
    below = relational.paid_below(
        b.staff(t), who="employee_id", group="department", level="level", pay="salary", lower="BUILDING", upper="MACHINERY"
    )
    return below.groupBy("department").agg(
        F.count(F.lit(1)).alias("managers_below"), F.sum("n_above").alias("pairs"),
        F.max("widest_gap").cast("double").alias("widest_gap"),
    )


@query("overtime_surge", f"WITH {b.SQL_PAY}" + f""", a AS (SELECT department, year, month, {q('SUM(overtime)', 'COUNT(*)')} AS x FROM pay GROUP BY 1, 2, 3),
  k AS (SELECT *, (SUM(x) OVER g - x) / NULLIF(COUNT(x) OVER g - 1, 0) AS baseline FROM a WINDOW g AS (PARTITION BY department, year))
  SELECT department, year, month, {r('x', 1)} AS avg_overtime, {r('x / baseline', 4)} AS multiple FROM k""")
def overtime_surge(t):
    months = b.payroll_sums(t).groupBy("department", "year", "month").agg(ratio(F.sum("overtime"), F.sum("records")).alias("x"))
    return anomaly.against_rest(durable(months), "x", ["department", "year"]).select(
        "department", "year", "month", rounded(F.col("x"), 1).alias("avg_overtime"),
        rounded(F.col("multiple"), 4).alias("multiple"),
    )


def dept_months(t):
    """Net pay and monthly budget per department and month."""
    paid = b.payroll_sums(t).groupBy("department", (F.col("year") * 12 + F.col("month") - 1).alias("period")).agg(
        F.sum("net").alias("paid")
    )
    budget = b.staff(t).groupBy("department").agg((F.sum("salary") * F.lit(str(b.BUDGET_RATE)).cast("decimal(4,2)")).alias("budget"))
    return paid.join(budget, "department")


SQL_BUDGET = f"""WITH {b.SQL_PAY}, {b.SQL_STAFF}, paid AS (
    SELECT department, year * 12 + month - 1 AS period, SUM(net) AS paid FROM pay GROUP BY 1, 2),
  bud AS (SELECT department, SUM(salary) * 2.5 AS budget FROM staff GROUP BY 1),
  dm AS (SELECT * FROM paid JOIN bud USING (department))"""


@query("budget_overrun", SQL_BUDGET + f""", f AS (SELECT *, paid > budget AS over,
    SUM(CASE WHEN paid > budget THEN 0 ELSE 1 END) OVER (PARTITION BY department ORDER BY period) AS isle FROM dm)
  SELECT department, period, {m('paid')} AS paid, {m('budget')} AS budget, {m('paid - budget')} AS overrun,
    SUM(CASE WHEN over THEN 1 ELSE 0 END) OVER (PARTITION BY department, isle ORDER BY period)::BIGINT AS months_over FROM f""")
def budget_overrun(t):
    flagged = dept_months(t).withColumn("over", F.col("paid") > F.col("budget"))
    return anomaly.flag_runs(flagged, ["department"], "period", "over", "months_over").select(
        "department", "period", money(F.col("paid")).alias("paid"), money(F.col("budget")).alias("budget"),
        money(F.col("paid") - F.col("budget")).alias("overrun"), "months_over",
    )


@query("cross_series", S + f""", a AS (SELECT region, year * 12 + month - 1 AS p, CAST(SUM(amount) AS DOUBLE) AS rev,
    {q('SUM(quantity)', 'COUNT(*)')} AS ot FROM sales GROUP BY 1, 2)
  SELECT region, {r('CORR(rev, ot)', 6)} AS corr, arg_max(p, rev) AS revenue_peak, arg_max(p, ot) AS overtime_peak,
    arg_max(p, rev) = arg_max(p, ot) AS same_peak FROM a GROUP BY 1""")
def cross_series(t):
    revenue = b.order_sums(t, "customer").groupBy("region", (F.col("year") * 12 + F.col("month") - 1).alias("p")).agg(
        F.sum("amount").cast("double").alias("rev")
    )
    overtime = b.payroll_sums(t).groupBy("region", (F.col("year") * 12 + F.col("month") - 1).alias("p")).agg(
        ratio(F.sum("overtime"), F.sum("records")).alias("ot")
    )
    peaks = revenue.join(overtime, ["region", "p"]).groupBy("region").agg(
        rounded(F.corr("rev", "ot"), 6).alias("corr"),
        F.max_by("p", "rev").alias("revenue_peak"), F.max_by("p", "ot").alias("overtime_peak"),
    )
    return peaks.withColumn("same_peak", F.col("revenue_peak") == F.col("overtime_peak"))
