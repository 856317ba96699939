"""Composite metrics over the business roles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlight.functions import money, ratio, rounded
from ledgerlight.operators import metrics as k
from ledgerlight.operators import windows as w
from ledgerlight.operators.scale import scalars
from ledgerlight.plans import bindings as b
from ledgerlight.plans.anomalies import SQL_BUDGET, dept_months
from ledgerlight.plans.bindings import sql_money as m
from ledgerlight.plans.bindings import sql_ratio as q
from ledgerlight.plans.bindings import sql_round as r
from ledgerlight.plans.bindings import year_span
from ledgerlight.plans.registry import query
from ledgerlight.session import durable

S = f"WITH {b.SQL_SALES}"
H = f"WITH {b.SQL_HEADS}"
PAY = f"WITH {b.SQL_PAY}"
MV = f"WITH {b.SQL_MOVES}"
SM = f"WITH {b.SQL_STOCK}, {b.SQL_MOVES}"
STAFF = f"WITH {b.SQL_STAFF}"


def day(text: str):
    return F.lit(text).cast("date")


# --- customers ---------------------------------------------------------------
@query("rfm", H + """
  SELECT customer_id, date_diff('day', MAX(order_date), (SELECT MAX(order_date) FROM heads))::BIGINT AS recency,
    COUNT(*) AS frequency, CAST(SUM(total) AS DOUBLE) AS monetary
  FROM heads GROUP BY 1 ORDER BY SUM(total) DESC, customer_id LIMIT 20""")
def rfm(t):
    top = k.rfm(b.heads(t), "customer_id", "order_date", "total").orderBy(F.desc("monetary"), "customer_id").limit(20)
    return top.withColumn("monetary", F.col("monetary").cast("double"))


@query("churn_recency", H + """, l AS (SELECT customer_id, date_diff('day', MAX(order_date), (SELECT MAX(order_date) FROM heads)) AS idle
    FROM heads GROUP BY 1)
  SELECT COUNT(*) AS customers, COUNT(*) FILTER (WHERE idle > 60) AS churned_60, COUNT(*) FILTER (WHERE idle > 90) AS churned_90 FROM l""")
def churn_recency(t):
    return k.rfm(b.heads(t), "customer_id", "order_date", "total").agg(
        F.count(F.lit(1)).alias("customers"),
        F.count_if(F.col("recency") > 60).alias("churned_60"), F.count_if(F.col("recency") > 90).alias("churned_90"),
    )


@query("cohort_retention", H + f""", s AS (SELECT DISTINCT customer_id, year * 4 + quarter - 1 AS period FROM heads),
  c AS (SELECT customer_id, MIN(period) AS cohort FROM s GROUP BY 1),
  n AS (SELECT cohort, COUNT(*) AS cohort_size FROM c GROUP BY 1)
  SELECT cohort, period, COUNT(*) AS active, cohort_size, {r(q('100.0 * COUNT(*)', 'cohort_size'))} AS active_pct
  FROM s JOIN c USING (customer_id) JOIN n USING (cohort) GROUP BY cohort, period, cohort_size""")
def cohort_retention(t):
    out = k.cohort_retention(b.heads(t), "customer_id", F.col("year") * 4 + F.col("quarter") - 1)
    return out.withColumn("active_pct", rounded(F.col("active_pct")))


def customer_class(orders):
    return F.when(orders == 1, "new").when(orders <= 5, "repeat").otherwise("loyal")


@query("customer_class", H + f""", v AS (SELECT customer_id, COUNT(*) AS n, SUM(total) AS x FROM heads GROUP BY 1)
  SELECT CASE WHEN n = 1 THEN 'new' WHEN n <= 5 THEN 'repeat' ELSE 'loyal' END AS class, COUNT(*) AS customers,
    {m('SUM(x)')} AS revenue, {r(q('100.0 * SUM(x)', 'SUM(SUM(x)) OVER ()'))} AS revenue_pct FROM v GROUP BY 1""")
def customer_classes(t):
    per = b.heads(t).groupBy("customer_id").agg(F.count(F.lit(1)).alias("n"), F.sum("total").alias("x"))
    by_class = per.groupBy(customer_class(F.col("n")).alias("class")).agg(
        F.count(F.lit(1)).alias("customers"), F.sum("x").alias("revenue")
    )
    out = w.share_of_total(by_class, "revenue", places=2, name="revenue_pct")
    return out.withColumn("revenue", money(F.col("revenue")))


@query("clv_proxy", H + f"""
  SELECT customer_id, {r(q('SUM(total)', 'COUNT(*)'), 4)} AS avg_order,
    {r('COUNT(*) * 365.0 / (date_diff(\'day\', MIN(order_date), MAX(order_date)) + 1)', 4)} AS orders_per_year,
    {r(q('SUM(total)', 'COUNT(*)') + ' * (COUNT(*) * 365.0::DOUBLE / (date_diff(\'day\', MIN(order_date), MAX(order_date)) + 1))')} AS clv
  FROM heads GROUP BY 1""")
def clv_proxy(t):
    span = F.date_diff(F.max("order_date"), F.min("order_date")) + 1
    out = b.heads(t).groupBy("customer_id").agg(
        ratio(F.sum("total"), F.count(F.lit(1))).alias("a"), ratio(F.count(F.lit(1)) * 365.0, span).alias("f")
    )
    return out.select(
        "customer_id", rounded(F.col("a"), 4).alias("avg_order"), rounded(F.col("f"), 4).alias("orders_per_year"),
        rounded(F.col("a") * F.col("f")).alias("clv"),
    )


@query("cross_sell", S + f""", c AS (SELECT customer_id, COUNT(DISTINCT category) AS n FROM sales GROUP BY 1)
  SELECT COUNT(*) AS customers, {r(q('100.0 * COUNT(*) FILTER (WHERE n > 1)', 'COUNT(*)'))} AS over_one_pct,
    {r(q('100.0 * COUNT(*) FILTER (WHERE n >= 3)', 'COUNT(*)'))} AS three_plus_pct FROM c""")
def cross_sell(t):
    kinds = b.sales(t, "order", "product").select("customer_id", "category").distinct()
    per = kinds.groupBy("customer_id").agg(F.count(F.lit(1)).alias("n"))
    return per.agg(
        F.count(F.lit(1)).alias("customers"),
        rounded(100.0 * ratio(F.count_if(F.col("n") > 1), F.count(F.lit(1)))).alias("over_one_pct"),
        rounded(100.0 * ratio(F.count_if(F.col("n") >= 3), F.count(F.lit(1)))).alias("three_plus_pct"),
    )


@query("retained_revenue", H + f""", f AS (SELECT customer_id, MIN(order_date) AS first FROM heads GROUP BY 1)
  SELECT {m('SUM(total)')} AS revenue, {r(q("100.0 * SUM(CASE WHEN first < DATE '2000-01-01' THEN total ELSE 0 END)", 'SUM(total)'))} AS retained_pct
  FROM heads JOIN f USING (customer_id) WHERE year = 2000""")
def retained_revenue(t):
    # One pass per customer gives both the first day and the revenue of the period.
    per = b.heads(t).groupBy("customer_id").agg(
        F.min("order_date").alias("first"), F.sum(F.when(F.col("year") == 2000, F.col("total"))).alias("x")
    ).where("x IS NOT NULL")
    old = F.sum(F.when(F.col("first") < day("2000-01-01"), F.col("x")).otherwise(F.lit(0)))
    return per.agg(money(F.sum("x")).alias("revenue"), rounded(100.0 * ratio(old, F.sum("x"))).alias("retained_pct"))


@query("spend_growth", H + f""", v AS (SELECT customer_id, SUM(CASE WHEN month <= 6 THEN total END) AS prev,
    SUM(CASE WHEN month > 6 THEN total END) AS cur FROM heads WHERE year = 2000 GROUP BY 1)
  SELECT customer_id, {m('prev')} AS previous, {m('cur')} AS current, {r(q('100.0 * (cur - prev)', 'prev'))} AS growth_pct
  FROM v WHERE prev > 0 AND cur > 0 ORDER BY 100.0::DOUBLE * {q('cur - prev', 'prev')} DESC, customer_id LIMIT 20""")
def spend_growth(t):
    half = F.col("month") <= 6
    out = k.growth(b.heads(t).where(year_span(2000)), ["customer_id"], "total", half, ~half)
    top = out.where("previous > 0 AND current > 0").orderBy(F.desc("growth_pct"), "customer_id").limit(20)
    return top.select(
        "customer_id", money(F.col("previous")).alias("previous"), money(F.col("current")).alias("current"),
        rounded(F.col("growth_pct")).alias("growth_pct"),
    )


@query("declining_top_customers", H + f""", v AS (SELECT customer_id, SUM(total) FILTER (WHERE year = 1999) AS prev,
    SUM(total) FILTER (WHERE year = 2000) AS cur, SUM(total) AS both_years FROM heads WHERE year IN (1999, 2000) GROUP BY 1),
  top AS (SELECT * FROM v ORDER BY both_years DESC, customer_id LIMIT 100)
  SELECT customer_id, {m('prev')} AS previous, {m('COALESCE(cur, 0)')} AS current FROM top WHERE COALESCE(cur, 0) < prev""")
def declining_top_customers(t):
    out = k.growth(
        b.heads(t).where(year_span(1999, 2000)), ["customer_id"], "total", F.col("year") == 1999, F.col("year") == 2000
    ).withColumn("cur", F.coalesce("current", F.lit(0)))
    top = out.orderBy(F.desc(F.coalesce("previous", F.lit(0)) + F.col("cur")), "customer_id").limit(100)
    return top.where("cur < previous").select(
        "customer_id", money(F.col("previous")).alias("previous"), money(F.col("cur")).alias("current")
    )


# --- growth and margin -------------------------------------------------------
@query("growth_rank", S + f""", v AS (SELECT category, SUM(amount) FILTER (WHERE year = 1999) AS prev, SUM(amount) FILTER (WHERE year = 2000) AS cur
    FROM sales WHERE year IN (1999, 2000) GROUP BY 1), g AS (SELECT *, {r(q('100.0 * (cur - prev)', 'prev'))} AS growth_pct FROM v)
  SELECT category, {m('prev')} AS previous, {m('cur')} AS current, growth_pct, RANK() OVER (ORDER BY growth_pct DESC) AS position FROM g""")
def growth_rank(t):
    df = b.sales(t, "order", "product").where(year_span(1999, 2000))
    out = k.growth(df, ["category"], "amount", F.col("year") == 1999, F.col("year") == 2000)
    out = out.select(
        "category", money(F.col("previous")).alias("previous"), money(F.col("current")).alias("current"),
        rounded(F.col("growth_pct")).alias("growth_pct"),
    )
    return w.ranked(durable(out), "growth_pct", name="position")


@query("cagr", S + f""", v AS (SELECT region, year, SUM(amount) AS x FROM sales WHERE year <= 2000 GROUP BY 1, 2)
  SELECT region, CAST(arg_min(x, year) AS DOUBLE) AS first_value, CAST(arg_max(x, year) AS DOUBLE) AS last_value,
    CAST(MAX(year) - MIN(year) AS DOUBLE) AS years,
    {r('pow(CAST(arg_max(x, year) AS DOUBLE) / CAST(arg_min(x, year) AS DOUBLE), 1.0 / (MAX(year) - MIN(year))) - 1', 6)} AS cagr
  FROM v GROUP BY 1""")
def cagr(t):
    years = b.order_sums(t, "customer").where("year <= 2000").groupBy("region", "year").agg(F.sum("amount").alias("x"))
    return k.cagr(years, ["region"], "year", "x").withColumn("cagr", rounded(F.col("cagr"), 6))


@query("margin_by_dim", S + f"""
  SELECT category, family, {m('SUM(amount)')} AS revenue, {m('SUM(amount - cost)')} AS margin,
    {r(q('100.0 * SUM(amount - cost)', 'SUM(amount)'))} AS margin_pct,
    {r(q('SUM(amount - cost)', 'SUM(quantity)'), 4)} AS profit_per_unit, SUM(amount - cost) < 0 AS is_negative
  FROM sales GROUP BY 1, 2""")
def margin_by_dim(t):
    v = b.sales(t, "product").groupBy("category", "family").agg(
        F.sum("amount").alias("a"), F.sum(F.col("amount") - F.col("cost")).alias("g"), F.sum("quantity").alias("u")
    )
    return v.select(
        "category", "family", money(F.col("a")).alias("revenue"), money(F.col("g")).alias("margin"),
        rounded(100.0 * ratio(F.col("g"), F.col("a"))).alias("margin_pct"),
        rounded(ratio(F.col("g"), F.col("u")), 4).alias("profit_per_unit"), (F.col("g") < 0).alias("is_negative"),
    )


@query("budget_variance", SQL_BUDGET + f""", y AS (SELECT *, SUM(paid) OVER (PARTITION BY department, period // 12 ORDER BY period) AS ytd FROM dm)
  SELECT department, period, {m('paid - budget')} AS variance, {r(q('100.0 * (paid - budget)', 'budget'))} AS over_pct,
    {r(q('ytd', 'budget * 12'), 4)} AS annual_use, ytd > budget * 12 * 0.9 AS near_annual_limit FROM y""")
def budget_variance(t):
    months = dept_months(t).withColumn("year", F.floor(F.col("period") / 12))
    out = w.cumulative(months, ["department", "year"], "period", "paid", "ytd")
    annual = F.col("budget") * 12
    return out.select(
        "department", "period", money(F.col("paid") - F.col("budget")).alias("variance"),
        rounded(100.0 * ratio(F.col("paid") - F.col("budget"), F.col("budget"))).alias("over_pct"),
        rounded(ratio(F.col("ytd"), annual), 4).alias("annual_use"),
        (F.col("ytd") > annual * F.lit("0.9").cast("decimal(2,1)")).alias("near_annual_limit"),
    )


@query("net_of_refunds", """
  SELECT l_partkey AS product_id, CAST(COALESCE(SUM(a) FILTER (WHERE l_returnflag <> 'R'), 0) AS DOUBLE) AS sold,
    CAST(COALESCE(SUM(a) FILTER (WHERE l_returnflag = 'R'), 0) AS DOUBLE) AS refunded,
    CAST(COALESCE(SUM(a) FILTER (WHERE l_returnflag <> 'R'), 0) - COALESCE(SUM(a) FILTER (WHERE l_returnflag = 'R'), 0) AS DOUBLE) AS net
  FROM (SELECT *, CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4)) AS a FROM lineitem) GROUP BY 1""")
def net_of_refunds(t):
    back = F.col("return_flag") == "R"
    zero = F.lit(0).cast("decimal(18,4)")
    v = b.sales(t).groupBy("product_id").agg(
        F.sum(F.when(~back, F.col("amount")).otherwise(zero)).alias("s"),
        F.sum(F.when(back, F.col("amount")).otherwise(zero)).alias("r"),
    )
    return v.select(
        "product_id", F.col("s").cast("double").alias("sold"), F.col("r").cast("double").alias("refunded"),
        (F.col("s") - F.col("r")).cast("double").alias("net"),
    )


@query("completion_minus_refund", S + f"""
  SELECT region, {r(q("100.0 * COUNT(*) FILTER (WHERE status = 'F')", 'COUNT(*)') + ' - ' + q("100.0 * COUNT(*) FILTER (WHERE return_flag = 'R')", 'COUNT(*)'))} AS gap_pct
  FROM sales GROUP BY 1""")
def completion_minus_refund(t):
    orders = b.order_rollup(t, n=F.count(F.lit(1)), r=F.count_if(F.col("return_flag") == "R"))
    done = 100.0 * ratio(F.sum(F.when(F.col("status") == "F", F.col("n")).otherwise(0)), F.sum("n"))
    back = 100.0 * ratio(F.sum("r"), F.sum("n"))
    return orders.groupBy("region").agg(rounded(done - back).alias("gap_pct"))


# --- inventory ---------------------------------------------------------------
HELD = """, span AS (SELECT date_diff('day', MIN(movement_date), MAX(movement_date)) + 1 AS days, MAX(movement_date) AS today FROM moves),
  held AS (SELECT product_id, SUM(quantity)::BIGINT AS held FROM stock GROUP BY 1),
  dem AS (SELECT product_id, SUM(quantity)::BIGINT AS outbound, CAST(SUM(quantity) AS DOUBLE) / MAX(days) AS per_day
    FROM moves, span WHERE movement_type = 'outbound' GROUP BY 1)"""


def held_by_product(t):
    return b.stock(t).groupBy("product_id").agg(F.sum("quantity").alias("held"))


@query("days_on_hand", SM + HELD + f"""
  SELECT product_id, held, {r('per_day', 6)} AS per_day, {r('held / per_day', 4)} AS days_on_hand, {r('held / per_day / 7', 4)} AS weeks_of_cover,
    held / per_day < 14 AS is_short, today + CAST(FLOOR(held / per_day) AS INTEGER) AS stockout_date FROM held JOIN dem USING (product_id), span""")
def days_on_hand(t):
    per = b.ledger(t, "product_id")
    span = scalars(per, days=F.date_diff(F.max("last_day"), F.min("first_day")) + 1, today=F.max("last_day"))
    cover = b.known_products(t, per.where("outbound IS NOT NULL")).withColumn("_span", span)
    cover = cover.withColumn("per_day", ratio(F.col("outbound"), F.col("_span.days")))
    days = ratio(F.col("held"), F.col("per_day"))
    return cover.select(
        "product_id", "held", rounded(F.col("per_day"), 6).alias("per_day"), rounded(days, 4).alias("days_on_hand"),
        rounded(days / 7, 4).alias("weeks_of_cover"), (days < 14).alias("is_short"),
        F.date_add(F.col("_span.today"), F.floor(days).cast("int")).alias("stockout_date"),
    )


@query("safety_stock_days", SM + HELD + f""", daily AS (SELECT product_id, movement_date, SUM(quantity) AS x FROM moves
    WHERE movement_type = 'outbound' GROUP BY 1, 2),
  st AS (SELECT product_id, SUM(x)::DOUBLE / MAX(days) AS mean, SQRT(GREATEST((SUM(x * x)::DOUBLE - MAX(days) * POW(SUM(x)::DOUBLE / MAX(days), 2)) / (MAX(days) - 1), 0)) AS std
    FROM daily, span GROUP BY 1)
  SELECT product_id, held, {r('mean', 6)} AS mean_demand, {r('std', 6)} AS std_demand, {r('held / (mean + 2 * std)', 4)} AS safe_days,
    held / (mean + 2 * std) < 7 AS is_short FROM held JOIN st USING (product_id)""")
def safety_stock_days(t):
    both = held_by_product(t).join(k.demand_spread(b.movements(t), ["product_id"]), "product_id")
    days = ratio(F.col("held"), F.col("mean_demand") + 2 * F.col("std_demand"))
    return both.select(
        "product_id", "held", rounded(F.col("mean_demand"), 6).alias("mean_demand"),
        rounded(F.col("std_demand"), 6).alias("std_demand"), rounded(days, 4).alias("safe_days"), (days < 7).alias("is_short"),
    )


@query("turnover", SM + f""", c AS (SELECT product_id, SUM(quantity)::BIGINT AS sold FROM moves WHERE movement_type = 'outbound' GROUP BY 1),
    h AS (SELECT product_id, ANY_VALUE(category) AS category, SUM(quantity) AS held, MAX(unit_cost) AS unit_cost FROM stock GROUP BY 1)
  SELECT category, {q('SUM(COALESCE(sold, 0) * unit_cost)', 'SUM(held * unit_cost)')} AS turnover, COALESCE(SUM(sold), 0)::BIGINT AS sold
  FROM h LEFT JOIN c USING (product_id) GROUP BY 1""")
def turnover(t):
    priced = b.items(t).withColumn("unit_cost", (F.lit(b.COST_RATE) * F.col("list_price")).cast("decimal(18,4)"))
    both = b.ledger(t, "product_id").join(priced, "product_id").withColumn("sold", F.coalesce("outbound", F.lit(0)))
    value = {c: F.sum(F.col(c).cast("decimal(18,0)") * F.col("unit_cost")) for c in ("sold", "held")}
    return both.groupBy("category").agg(ratio(value["sold"], value["held"]).alias("turnover"), F.sum("sold").alias("sold"))


@query("fill_rate", S + f"""
  SELECT site_id, year, month, SUM(quantity)::BIGINT AS demanded, COALESCE(SUM(quantity) FILTER (WHERE ship_date >= order_date), 0)::BIGINT AS shipped,
    {q('COALESCE(SUM(quantity) FILTER (WHERE ship_date >= order_date), 0)', 'SUM(quantity)')} AS fill_rate FROM sales GROUP BY 1, 2, 3""")
def fill_rate(t):
    # A line counts as shipped when its ship date is not before the order date.
    ok = F.coalesce(F.sum(F.when(F.col("ship_date") >= F.col("order_date"), F.col("quantity"))), F.lit(0))
    return b.sales(t, "order").groupBy("site_id", "year", "month").agg(
        F.sum("quantity").alias("demanded"), ok.alias("shipped"), ratio(ok, F.sum("quantity")).alias("fill_rate")
    )


@query("inout_ratio", MV + f""", v AS (SELECT site_id, year(movement_date)::BIGINT * 12 + month(movement_date) - 1 AS period,
    COALESCE(SUM(quantity) FILTER (WHERE movement_type = 'inbound'), 0)::BIGINT AS inbound,
    COALESCE(SUM(quantity) FILTER (WHERE movement_type = 'outbound'), 0)::BIGINT AS outbound FROM moves GROUP BY 1, 2)
  SELECT site_id, period, inbound, outbound, inbound - outbound AS net_change, {q('inbound', 'outbound')} AS in_out FROM v""")
def inout_ratio(t):
    def of(kind):
        return F.coalesce(F.sum(F.when(F.col("movement_type") == kind, F.col("quantity"))), F.lit(0)).alias(kind)

    d = F.col("movement_date")
    v = b.movements(t).groupBy("site_id", (F.year(d).cast("long") * 12 + F.month(d) - 1).alias("period")).agg(
        of("inbound"), of("outbound")
    )
    return v.withColumn("net_change", F.col("inbound") - F.col("outbound")).withColumn(
        "in_out", ratio(F.col("inbound"), F.col("outbound"))
    )


@query("utilisation", f"WITH {b.SQL_STOCK}, {b.SQL_MOVES}, {b.SQL_SITES}" + f""", h AS (SELECT site_id, SUM(quantity)::BIGINT AS held FROM stock GROUP BY 1),
    o AS (SELECT site_id, SUM(quantity)::BIGINT AS out_qty FROM moves WHERE movement_type = 'outbound' GROUP BY 1)
  SELECT site_id, site, held, CAST(capacity AS DOUBLE) AS capacity, {q('held', 'capacity')} AS utilisation, {q('out_qty', 'capacity')} AS outbound_use,
    COALESCE({q('held', 'capacity')} > 0.9, FALSE) AS is_full FROM sites JOIN h USING (site_id) LEFT JOIN o USING (site_id)""")
def utilisation(t):
    per = b.known_products(t, b.ledger(t, "product_id", "site_id")).groupBy("site_id").agg(
        F.sum("held").alias("held"), F.sum("outbound").alias("out_qty")
    )
    use = ratio(F.col("held"), F.col("capacity"))
    return b.sites(t).join(per, "site_id").select(
        "site_id", "site", "held", F.col("capacity").cast("double").alias("capacity"), use.alias("utilisation"),
        ratio(F.col("out_qty"), F.col("capacity")).alias("outbound_use"), F.coalesce(use > 0.9, F.lit(False)).alias("is_full"),
    )


@query("idle_days", MV + """, d AS (SELECT DISTINCT product_id, movement_date FROM moves WHERE movement_type = 'outbound'
    AND movement_date BETWEEN DATE '2000-01-01' AND DATE '2000-12-31')
  SELECT product_id, (366 - COUNT(*))::BIGINT AS idle_days, date_diff('day', MAX(movement_date), DATE '2000-12-31')::BIGINT AS days_since_last,
    date_diff('day', MAX(movement_date), DATE '2000-12-31') > 90 AS over_90 FROM d GROUP BY 1""")
def idle_days(t):
    out = b.movements(t).where("movement_type = 'outbound'")
    return k.idle_days(out, ["product_id"], "movement_date", "2000-01-01", "2000-12-31").withColumn(
        "over_90", F.col("days_since_last") > 90
    )


@query("inventory_aging", MV + """, l AS (SELECT product_id, site_id, date_diff('day', MAX(movement_date), (SELECT MAX(movement_date) FROM moves)) AS age
    FROM moves WHERE movement_type = 'inbound' GROUP BY 1, 2)
  SELECT CASE WHEN age <= 30 THEN '0-30' WHEN age <= 90 THEN '31-90' WHEN age <= 365 THEN '91-365' ELSE '366+' END AS age_band,
    COUNT(*) AS stock_rows, MAX(age)::BIGINT AS oldest FROM l GROUP BY 1""")
def inventory_aging(t):
    moves = b.movements(t)
    today = moves.agg(F.max("movement_date")).scalar()
    last = moves.where("movement_type = 'inbound'").groupBy("product_id", "site_id").agg(F.max("movement_date").alias("d"))
    aged = last.withColumn("age", F.date_diff(today, F.col("d")).cast("long"))
    band = F.when(F.col("age") <= 30, "0-30").when(F.col("age") <= 90, "31-90").when(F.col("age") <= 365, "91-365").otherwise("366+")
    return aged.groupBy(band.alias("age_band")).agg(F.count(F.lit(1)).alias("stock_rows"), F.max("age").alias("oldest"))


@query("stock_value", f"WITH {b.SQL_SALES}, {b.SQL_STOCK}" + f""", v AS (SELECT site_id, SUM(quantity * unit_cost) AS value FROM stock GROUP BY 1),
    s AS (SELECT site_id, SUM(amount) AS revenue FROM sales GROUP BY 1)
  SELECT site_id, CAST(value AS DOUBLE) AS stock_value, CAST(revenue AS DOUBLE) AS revenue, {q('revenue', 'value')} AS efficiency
  FROM v LEFT JOIN s USING (site_id)""")
def stock_value(t):
    value = b.stock(t).groupBy("site_id").agg(F.sum(F.col("quantity").cast("decimal(18,0)") * F.col("unit_cost")).alias("v"))
    revenue = b.sales(t).groupBy("site_id").agg(F.sum("amount").alias("a"))
    return value.join(revenue, "site_id", "left").select(
        "site_id", F.col("v").cast("double").alias("stock_value"), F.col("a").cast("double").alias("revenue"),
        ratio(F.col("a"), F.col("v")).alias("efficiency"),
    )


# --- workforce ---------------------------------------------------------------
@query("headcount_mix", STAFF + f"""
  SELECT department, level, COUNT(*) AS headcount, {r(q('100.0 * COUNT(*)', 'SUM(COUNT(*)) OVER (PARTITION BY department)'), 1)} AS pct
  FROM staff GROUP BY 1, 2""")
def headcount_mix(t):
    counts = b.staff(t).groupBy("department", "level").agg(F.count(F.lit(1)).alias("headcount"))
    return w.share_of_total(durable(counts), "headcount", ["department"], places=1)


@query("turnover_rate", f"WITH {b.SQL_STAFF_DATES}" + f"""
  SELECT department, COUNT(*) FILTER (WHERE hire_date < DATE '2000-10-01' AND (end_date IS NULL OR end_date >= DATE '2000-10-01')) AS at_start,
    COUNT(*) FILTER (WHERE end_date BETWEEN DATE '2000-10-01' AND DATE '2000-12-31') AS terminated,
    {r(q("100.0 * COUNT(*) FILTER (WHERE end_date BETWEEN DATE '2000-10-01' AND DATE '2000-12-31')",
         "COUNT(*) FILTER (WHERE hire_date < DATE '2000-10-01' AND (end_date IS NULL OR end_date >= DATE '2000-10-01'))"))} AS turnover_pct
  FROM staffed GROUP BY 1""")
def turnover_rate(t):
    start, end = day("2000-10-01"), day("2000-12-31")
    there = F.count_if((F.col("hire_date") < start) & (F.col("end_date").isNull() | (F.col("end_date") >= start)))
    left = F.count_if(F.col("end_date").between(start, end))
    return b.staff(t, dates=True).groupBy("department").agg(
        there.alias("at_start"), left.alias("terminated"), rounded(100.0 * ratio(left, there)).alias("turnover_pct")
    )


@query("tenure", f"WITH {b.SQL_STAFF_DATES}" + """
  SELECT employee_id, hire_date, date_sub('year', hire_date, DATE '2001-08-01')::BIGINT AS years,
    end_date IS NULL AND date_sub('year', hire_date, DATE '2001-08-01') > 5 AS is_senior FROM staffed""")
def tenure(t):
    years = F.floor(F.months_between(day("2001-08-01"), F.col("hire_date")) / 12).cast("long")
    return b.staff(t, dates=True).select(
        "employee_id", "hire_date", years.alias("years"), (F.col("end_date").isNull() & (years > 5)).alias("is_senior")
    )


@query("pay_ratios", PAY + f"""
  SELECT department, level, {r(q('SUM(bonus)', 'SUM(base)'), 6)} AS bonus_ratio, {r(q('SUM(deduction)', 'SUM(base)'), 6)} AS deduction_ratio,
    {r(q('SUM(deduction)', 'SUM(net)'), 6)} AS deduction_of_net FROM pay GROUP BY 1, 2""")
def pay_ratios(t):
    base, net = F.sum("base"), F.sum("net")
    return b.payroll_sums(t).groupBy("department", "level").agg(
        rounded(ratio(F.sum("bonus"), base), 6).alias("bonus_ratio"),
        rounded(ratio(F.sum("deduction"), base), 6).alias("deduction_ratio"),
        rounded(ratio(F.sum("deduction"), net), 6).alias("deduction_of_net"),
    )


@query("revenue_per_head", PAY + f""", {b.SQL_STAFF}, a AS (SELECT region, SUM(amount) AS rev FROM sales GROUP BY 1),
    p AS (SELECT region, SUM(net) AS net FROM pay GROUP BY 1), h AS (SELECT region, COUNT(*) AS heads FROM staff GROUP BY 1)
  SELECT region, {r(q('rev', 'heads'))} AS revenue_per_head, {r(q('net', 'rev'), 6)} AS payroll_to_revenue
  FROM a JOIN p USING (region) JOIN h USING (region)""")
def revenue_per_head(t):
    revenue = b.order_sums(t, "customer").groupBy("region").agg(F.sum("amount").alias("rev"))
    pay = b.payroll_sums(t).groupBy("region").agg(F.sum("net").alias("net"))
    heads = b.staff(t).groupBy("region").agg(F.count(F.lit(1)).alias("heads"))
    return revenue.join(pay, "region").join(heads, "region").select(
        "region", rounded(ratio(F.col("rev"), F.col("heads"))).alias("revenue_per_head"),
        rounded(ratio(F.col("net"), F.col("rev")), 6).alias("payroll_to_revenue"),
    )


# --- calendars ---------------------------------------------------------------
@query("month_gaps", H + """, s AS (SELECT DISTINCT customer_id, year * 12 + month - 1 AS period FROM heads),
  e AS (SELECT customer_id, UNNEST(range(MIN(period), MAX(period) + 1)) AS period FROM s GROUP BY 1)
  SELECT customer_id, period FROM e EXCEPT SELECT customer_id, period FROM s""")
def month_gaps(t):
    months = b.heads(t).select("customer_id", (F.col("year") * 12 + F.col("month") - 1).alias("period"))
    return k.missing_periods(months, ["customer_id"], "period")


def week_number(d):
    """Weeks since Monday 1969-12-29."""
    return F.floor((F.unix_date(d) + 3) / 7)


@query("week_fill", H + """, s AS (SELECT payment, ((order_date - DATE '1970-01-01') + 3) // 7 AS week, COUNT(*) AS orders FROM heads
    WHERE total > 400000 GROUP BY 1, 2),
  e AS (SELECT payment, UNNEST(range(MIN(week), MAX(week) + 1)) AS week FROM s GROUP BY 1)
  SELECT payment, week, COALESCE(orders, 0) AS orders FROM e LEFT JOIN s USING (payment, week)""")
def week_fill(t):
    weeks = b.heads(t).where("total > 400000").groupBy("payment", week_number(F.col("order_date")).alias("week")).agg(
        F.count(F.lit(1)).alias("orders")
    )
    return k.fill_periods(weeks, ["payment"], "week", ["orders"])


@query("weekly_rollup", H + f""", d AS (SELECT payment, order_date, SUM(total) AS x FROM heads GROUP BY 1, 2)
  SELECT payment, CAST(date_trunc('week', order_date) AS DATE) AS week, {m('SUM(x)')} AS total, {r(q('SUM(x)', 'COUNT(*)'), 4)} AS per_active_day
  FROM d GROUP BY 1, 2""")
def weekly_rollup(t):
    days = b.heads(t).groupBy("payment", "order_date").agg(F.sum("total").alias("x"))
    return days.groupBy("payment", F.date_trunc("week", "order_date").cast("date").alias("week")).agg(
        money(F.sum("x")).alias("total"), rounded(ratio(F.sum("x"), F.count(F.lit(1))), 4).alias("per_active_day")
    )


@query("demand_spike", S + f""", v AS (SELECT product_id, COUNT(*) FILTER (WHERE month = 6) AS cur, COUNT(*) FILTER (WHERE month = 5) AS prev
    FROM sales WHERE year = 2000 AND month IN (5, 6) GROUP BY 1)
  SELECT product_id, cur, prev, {q('cur', 'prev')} AS growth FROM v WHERE cur > prev * 2""")
def demand_spike(t):
    span = F.col("order_date").between(day("2000-05-01"), day("2000-06-30"))
    v = b.sales(t, "order").where(span).groupBy("product_id").agg(
        F.count_if(F.col("month") == 6).alias("cur"), F.count_if(F.col("month") == 5).alias("prev")
    )
    return v.where(F.col("cur") > F.col("prev") * 2).withColumn("growth", ratio(F.col("cur"), F.col("prev")))


@query("category_skew", S + f""", v AS (SELECT family, category, SUM(amount) AS a FROM sales GROUP BY 1, 2),
    p AS (SELECT p_type AS family, COUNT(*) AS skus FROM part GROUP BY 1), f AS (SELECT family, SUM(a) AS a FROM v GROUP BY 1),
  x AS (SELECT family, 100.0::DOUBLE * {q('a', 'SUM(a) OVER ()')} AS rp, 100.0::DOUBLE * {q('skus', 'SUM(skus) OVER ()')} AS sp FROM f JOIN p USING (family))
  SELECT family, {r('rp')} AS revenue_pct, {r('sp')} AS sku_pct, rp > 30 AND sp < 10 AS is_skewed FROM x""")
def category_skew(t):
    revenue = b.sales(t, "product").groupBy("family").agg(F.sum("amount").alias("a"))
    skus = b.items(t).groupBy("family").agg(F.count(F.lit(1)).alias("skus"))
    shares = w.share_of_total(
        w.share_of_total(revenue, "a", places=2, name="revenue_pct").join(skus, "family"), "skus", places=2, name="sku_pct"
    )
    return shares.select(
        "family", "revenue_pct", "sku_pct", ((F.col("revenue_pct") > 30) & (F.col("sku_pct") < 10)).alias("is_skewed")
    )


@query("seasonal_shortage", MV + """, v AS (SELECT product_id, month(movement_date)::BIGINT AS month, SUM(quantity) AS x FROM moves
    WHERE movement_type = 'outbound' GROUP BY 1, 2)
  SELECT month, COUNT(*) FILTER (WHERE x < p_size * 2) AS short_skus, COUNT(*) AS skus FROM v JOIN part ON product_id = p_partkey GROUP BY 1""")
def seasonal_shortage(t):
    v = b.movements(t).where("movement_type = 'outbound'").groupBy(
        "product_id", F.month("movement_date").cast("long").alias("month")
    ).agg(F.sum("quantity").alias("x"))
    return v.join(b.items(t), "product_id").groupBy("month").agg(
        F.count_if(F.col("x") < F.col("min_threshold") * 2).alias("short_skus"), F.count(F.lit(1)).alias("skus")
    )


@query("board_summary", PAY + f""", {b.SQL_STAFF}, {b.SQL_SITES}, a AS (SELECT region, SUM(amount) AS rev, SUM(quantity)::BIGINT AS units FROM sales WHERE year = 2000 GROUP BY 1),
    p AS (SELECT region, SUM(net) AS net FROM pay WHERE year = 2000 GROUP BY 1), h AS (SELECT region, COUNT(*) AS heads FROM staff GROUP BY 1),
    s AS (SELECT region, COUNT(*) AS sites FROM sites GROUP BY 1)
  SELECT region, {m('rev')} AS revenue, units, {m('net')} AS payroll, heads, sites FROM h LEFT JOIN a USING (region) LEFT JOIN p USING (region) LEFT JOIN s USING (region)""")
def board_summary(t):
    revenue = b.order_sums(t, "customer", where=year_span(2000)).groupBy("region").agg(
        money(F.sum("amount")).alias("revenue"), F.sum("quantity").alias("units")
    )
    pay = b.payroll_sums(t).where(year_span(2000)).groupBy("region").agg(money(F.sum("net")).alias("payroll"))
    heads = b.staff(t).groupBy("region").agg(F.count(F.lit(1)).alias("heads"))
    hosts = b.sites(t).groupBy("region").agg(F.count(F.lit(1)).alias("sites"))
    return heads.join(revenue, "region", "left").join(pay, "region", "left").join(hosts, "region", "left")
