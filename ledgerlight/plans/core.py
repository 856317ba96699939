"""Projections, filters, joins, aggregates, ordering and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlight.functions import money, ratio, rounded
from ledgerlight.operators import aggregates, relational
from ledgerlight.plans import bindings as b
from ledgerlight.plans.bindings import sql_money as m
from ledgerlight.plans.bindings import sql_ratio as q
from ledgerlight.plans.bindings import sql_round as r
from ledgerlight.plans.registry import query
from ledgerlight.session import durable

S = f"WITH {b.SQL_SALES} "
H = f"WITH {b.SQL_HEADS} "
MV = f"WITH {b.SQL_MOVES} "
PAY = f"WITH {b.SQL_PAY} "
SHORT = 200


# --- projections -------------------------------------------------------------
@query("effective_price", S + f"""
  SELECT order_id, product_id, {m('amount')} AS effective_price, {m('amount - cost')} AS margin FROM sales""")
def effective_price(t):
    return b.sales(t, "product").select(
        "order_id", "product_id",
        money(F.col("amount")).alias("effective_price"),
        money(F.col("amount") - F.col("cost")).alias("margin"),
    )


@query("date_parts", """
  SELECT o_orderkey, CAST(year(o_orderdate) AS BIGINT) AS year, CAST(quarter(o_orderdate) AS BIGINT) AS quarter,
    CAST(month(o_orderdate) AS BIGINT) AS month, CAST(day(o_orderdate) AS BIGINT) AS day,
    CAST(weekofyear(o_orderdate) AS BIGINT) AS iso_week FROM orders""")
def date_parts(t):
    return relational.with_calendar(t("orders"), "o_orderdate").select(
        "o_orderkey", "year", "quarter", "month", "day", "iso_week"
    )


@query("case_bucket", H + """
  SELECT order_id, CASE WHEN order_date < DATE '1998-04-01' THEN 'before' ELSE 'from' END AS period,
    CASE WHEN total < 50000 THEN 'small' WHEN total < 200000 THEN 'medium' ELSE 'large' END AS size_class
  FROM heads""")
def case_bucket(t):
    return b.heads(t).select(
        "order_id",
        F.when(F.col("order_date") < F.lit("1998-04-01").cast("date"), "before").otherwise("from").alias("period"),
        relational.threshold_class("total", [(50000, "small"), (200000, "medium")], "large").alias("size_class"),
    )


@query("round_scale", f"""
  SELECT year(o_orderdate)::BIGINT AS year, {m('SUM(CAST(o_totalprice AS DECIMAL(18,2))) / 1', 0)} AS total,
    {r('CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / 1e6', 1)} AS total_millions
  FROM orders GROUP BY 1""")
def round_scale(t):
    return b.heads(t).groupBy("year").agg(
        money(F.sum("total"), 0).alias("total"),
        rounded(F.sum("total").cast("double") / 1e6, 1).alias("total_millions"),
    )


@query("cast_text_float", """
  SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS key_text, CAST(o_orderkey AS DOUBLE) AS key_float,
    CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day_text,
    CAST(trunc(o_totalprice) AS BIGINT) AS whole_price FROM orders""")
def cast_text_float(t):
    return t("orders").select(
        "o_orderkey",
        F.col("o_orderkey").cast("string").alias("key_text"),
        F.col("o_orderkey").cast("double").alias("key_float"),
        F.col("o_orderdate").cast("date").cast("string").alias("day_text"),
        F.col("o_totalprice").cast("long").alias("whole_price"),
    )


@query("null_defaults", MV + """
  SELECT product_id, site_id, COALESCE(SUM(CASE WHEN movement_type = 'outbound' THEN quantity END), 0)::BIGINT AS sold,
    CAST(SUM(CASE WHEN movement_type = 'inbound' THEN quantity END) AS DOUBLE)
      / NULLIF(CAST(COALESCE(SUM(CASE WHEN movement_type = 'outbound' THEN quantity END), 0) AS DOUBLE), 0) AS back_ratio
  FROM moves GROUP BY 1, 2""")
def null_defaults(t):
    out = F.coalesce(F.sum(F.when(F.col("movement_type") == "outbound", F.col("quantity"))), F.lit(0))
    back = F.sum(F.when(F.col("movement_type") == "inbound", F.col("quantity")))
    return b.movements(t).groupBy("product_id", "site_id").agg(
        out.cast("long").alias("sold"), ratio(back, out).alias("back_ratio")
    )


@query("derived_pay", PAY + f"""
  SELECT employee_id, {m('SUM(net)')} AS net, {m('CAST(SUM(base * overtime) AS DECIMAL(24,4)) * 0.009375::DECIMAL(7,6)')} AS overtime_cost,
    {m('SUM(base) * 0.15')} AS overhead, {r('CAST(SUM(base) AS DOUBLE) * 0.20::DOUBLE / 12')} AS carrying_cost
  FROM pay GROUP BY 1""")
def derived_pay(t):
    # 160 paid hours a month, overtime at 1.5 times (1.5 / 160), 15% overhead, 20% carrying cost a year.
    overtime_rate = F.lit("0.009375").cast("decimal(7,6)")
    pay = b.payroll(t).withColumn("hours_pay", F.col("base") * F.col("overtime").cast("decimal(10,0)"))
    return pay.groupBy("employee_id").agg(
        money(F.sum("net")).alias("net"),
        money(F.sum("hours_pay").cast("decimal(24,4)") * overtime_rate).alias("overtime_cost"),
        money(F.sum("base") * F.lit("0.15").cast("decimal(4,2)")).alias("overhead"),
        rounded(F.sum("base").cast("double") * 0.20 / 12).alias("carrying_cost"),
    )


@query("shorten_cells", f"""
  SELECT doc_id, CASE WHEN length(text) > {SHORT} THEN substring(text, 1, {SHORT}) || '…' ELSE text END AS text
  FROM documents""")
def shorten_cells(t):
    return relational.shorten_cells(t("documents").select("doc_id", "text"), SHORT)


@query("flatten_struct", """
  SELECT event_id, event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events""")
def flatten_struct(t):
    parsed = relational.flatten_json(t("events"), "props", "k long")
    return parsed.select("event_id", "event_type", "k")


# --- filters -----------------------------------------------------------------
@query("predicate_mix", """
  SELECT l_orderkey, l_linenumber, l_returnflag, l_quantity FROM lineitem
  WHERE l_returnflag IN ('R', 'A') AND l_linestatus = 'F' AND l_quantity BETWEEN 10 AND 20
    AND (l_discount >= 0.05 OR l_shipdate >= TIMESTAMP '2000-01-01')""")
def predicate_mix(t):
    return t("lineitem").where(
        F.col("l_returnflag").isin("R", "A")
        & (F.col("l_linestatus") == "F")
        & F.col("l_quantity").between(10, 20)
        & ((F.col("l_discount") >= 0.05) | (F.col("l_shipdate") >= F.lit("2000-01-01").cast("timestamp_ntz")))
    ).select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity")


@query("null_filter", MV + """
  SELECT movement_type, COUNT(*) AS without_order, SUM(quantity)::BIGINT AS quantity FROM moves
  WHERE order_ref IS NULL AND movement_date IS NOT NULL GROUP BY 1""")
def null_filter(t):
    return (
        b.movements(t)
        .where(F.col("order_ref").isNull() & F.col("movement_date").isNotNull())
        .groupBy("movement_type")
        .agg(F.count(F.lit(1)).alias("without_order"), F.sum("quantity").alias("quantity"))
    )


@query("revenue_status", H + f"""
  SELECT year, {m('SUM(total)')} AS revenue FROM heads WHERE status IN ('F', 'O') GROUP BY 1""")
def revenue_status(t):
    return relational.revenue_only(b.heads(t), b.REVENUE_STATUSES).groupBy("year").agg(
        money(F.sum("total")).alias("revenue")
    )


@query("column_vs_column", f"""WITH {b.SQL_STOCK}
  SELECT product_id, site_id, quantity, min_threshold FROM stock WHERE quantity < min_threshold * 1.5""")
def column_vs_column(t):
    return b.stock(t).where(F.col("quantity") < F.col("min_threshold") * 1.5).select(
        "product_id", "site_id", "quantity", "min_threshold"
    )


@query("trailing_days", H + f"""
  SELECT days::BIGINT AS days, COUNT(*) AS orders, {m('SUM(total)')} AS total
  FROM heads CROSS JOIN (VALUES (7), (30), (60), (90), (180)) w(days)
  WHERE order_date > (SELECT MAX(order_date) FROM heads) - CAST(days AS INTEGER) GROUP BY 1""")
def trailing_days(t):
    return relational.trailing_windows(
        b.heads(t), "order_date", (7, 30, 60, 90, 180),
        orders=F.count(F.lit(1)), total=F.sum("total"),
    ).withColumn("total", money(F.col("total")))


@query("weekday_weekend", H + f"""
  SELECT CASE WHEN isodow(order_date) >= 6 THEN 'weekend' ELSE 'weekday' END AS day_kind, COUNT(*) AS orders,
    {m('SUM(total)')} AS total FROM heads GROUP BY 1""")
def weekday_weekend(t):
    return (
        b.heads(t)
        .groupBy(relational.day_kind(F.col("order_date")).alias("day_kind"))
        .agg(F.count(F.lit(1)).alias("orders"), money(F.sum("total")).alias("total"))
    )


@query("round_amounts", "SELECT p_partkey, p_retailprice FROM part WHERE CAST(p_retailprice AS DECIMAL(12,2)) % 10 = 0")
def round_amounts(t):
    price = F.col("p_retailprice").cast("decimal(12,2)")
    return relational.multiples_of(t("part"), price, 10).select("p_partkey", "p_retailprice")


@query("rows_over", H + """
  SELECT order_id, customer_id, order_date, CAST(total AS DOUBLE) AS total FROM heads
  WHERE total > 450000 AND year = 1998""")
def rows_over(t):
    # The year test is on the date itself, so it reaches the Parquet scan.
    return b.heads(t).where(b.year_span(1998) & (F.col("total") > 450000)).select(
        "order_id", "customer_id", "order_date", F.col("total").cast("double").alias("total")
    )


# --- joins -------------------------------------------------------------------
@query("join_inner", f"""
  SELECT p_brand AS category, COUNT(*) AS lines, SUM(CAST(l_quantity AS BIGINT))::BIGINT AS quantity
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1""")
def join_inner(t):
    return b.sales(t, "product").groupBy("category").agg(
        F.count(F.lit(1)).alias("lines"), F.sum("quantity").alias("quantity")
    )


@query("join_chain", S + f"""
  SELECT region, nation, category, {m('SUM(amount)')} AS revenue FROM sales GROUP BY 1, 2, 3""")
def join_chain(t):
    return b.sales(t, "customer", "product").groupBy("region", "nation", "category").agg(
        money(F.sum("amount")).alias("revenue")
    )


@query("join_left_on_pred", """
  SELECT c_custkey, COUNT(o_orderkey) AS urgent_orders,
    CAST(COALESCE(SUM(CAST(o_totalprice AS DECIMAL(18,2))), 0) AS DOUBLE) AS urgent_total
  FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderpriority = '1-URGENT'
    AND o_orderdate >= TIMESTAMP '2000-01-01' GROUP BY 1""")
def join_left_on_pred(t):
    c, o = t("customer"), t("orders")
    on = (
        (c.c_custkey == o.o_custkey)
        & (o.o_orderpriority == "1-URGENT")
        & (o.o_orderdate >= F.lit("2000-01-01").cast("timestamp_ntz"))
    )
    return c.join(o, on, "left").groupBy("c_custkey").agg(
        F.count("o_orderkey").alias("urgent_orders"),
        F.coalesce(F.sum(F.col("o_totalprice").cast("decimal(18,2)")), F.lit(0)).cast("double").alias("urgent_total"),
    )


@query("anti_join", """
  SELECT c_custkey, c_name FROM customer c WHERE NOT EXISTS (
    SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderdate >= TIMESTAMP '2000-07-01')""")
def anti_join(t):
    late = t("orders").where(F.col("o_orderdate") >= F.lit("2000-07-01").cast("timestamp_ntz"))
    return t("customer").join(late, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


@query("semi_join", """
  SELECT p_partkey, p_brand FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_discount >= 0.1)""")
def semi_join(t):
    cut = t("lineitem").where(F.col("l_discount") >= 0.1)
    return t("part").join(cut, F.col("p_partkey") == F.col("l_partkey"), "left_semi").select("p_partkey", "p_brand")


@query("join_role_twice", S + f""", {b.SQL_SITES}
  SELECT s.nation AS from_nation, sales.nation AS to_nation, COUNT(*) AS shipments, SUM(quantity)::BIGINT AS quantity
  FROM sales JOIN sites s USING (site_id) GROUP BY 1, 2""")
def join_role_twice(t):
    shipped = b.sales(t, "customer").withColumnRenamed("nation", "to_nation").drop("region")
    source = b.sites(t).select("site_id", F.col("nation").alias("from_nation"))
    return shipped.join(source, "site_id").groupBy("from_nation", "to_nation").agg(
        F.count(F.lit(1)).alias("shipments"), F.sum("quantity").alias("quantity")
    )


@query("self_join_hierarchy", f"""WITH {b.SQL_STAFF}, heads AS (
    SELECT department, MIN(employee_id) AS manager_id FROM staff WHERE level = 'MACHINERY' GROUP BY 1)
  SELECT e.employee_id, e.name, g.name AS manager_name FROM staff e LEFT JOIN heads h USING (department)
  LEFT JOIN staff g ON g.employee_id = h.manager_id AND g.employee_id <> e.employee_id""")
def self_join_hierarchy(t):
    staff = b.staff(t)
    # The manager of a department is its first member of the manager level.
    heads = staff.where("level = 'MACHINERY'").groupBy("department").agg(
        F.min(F.struct(F.col("employee_id").alias("manager_id"), F.col("name").alias("manager_name"))).alias("h")
    ).select("department", "h.*")
    return staff.join(heads, "department", "left").select(
        "employee_id", "name",
        F.when(F.col("manager_id") != F.col("employee_id"), F.col("manager_name")).alias("manager_name"),
    )


@query("theta_self_join", f"""WITH {b.SQL_STAFF}
  SELECT m.employee_id, m.department, CAST(m.salary AS DOUBLE) AS salary, COUNT(*) AS seniors_above,
    CAST(MAX(s.salary) - m.salary AS DOUBLE) AS widest_gap
  FROM staff m JOIN staff s ON m.department = s.department AND m.level = 'MACHINERY' AND s.level = 'BUILDING'
    AND m.salary < s.salary GROUP BY 1, 2, 3, m.salary""")
def theta_self_join(t):
    return relational.paid_below(
        b.staff(t), who="employee_id", group="department", level="level", pay="salary",
        lower="BUILDING", upper="MACHINERY",
    ).select(
        "employee_id", "department", F.col("salary").cast("double").alias("salary"),
        F.col("n_above").alias("seniors_above"), F.col("widest_gap").cast("double").alias("widest_gap"),
    )


@query("cte_join_using", S + f""", cur AS (SELECT region, SUM(amount) AS x FROM sales WHERE year = 2000 GROUP BY 1),
    prev AS (SELECT region, SUM(amount) AS x FROM sales WHERE year = 1999 GROUP BY 1)
  SELECT region, {m('cur.x')} AS rev_current, {m('prev.x')} AS rev_previous FROM cur LEFT JOIN prev USING (region)""")
def cte_join_using(t):
    def of(year, name):
        return b.order_sums(t, "customer", where=b.year_span(year)).groupBy("region").agg(
            money(F.sum("amount")).alias(name)
        )

    return of(2000, "rev_current").join(of(1999, "rev_previous"), "region", "left")


@query("interval_join", f"""WITH {b.SQL_MOVES},
  outs AS (SELECT product_id, site_id, movement_date AS out_date, COUNT(*) AS n_out, SUM(quantity)::BIGINT AS qty_out
    FROM moves WHERE movement_type = 'outbound' GROUP BY 1, 2, 3),
  backs AS (SELECT product_id, site_id, movement_date AS back_date, COUNT(*) AS n_back, SUM(quantity)::BIGINT AS qty_back
    FROM moves WHERE movement_type = 'inbound' GROUP BY 1, 2, 3)
  SELECT product_id, site_id, out_date, back_date, n_out, qty_out, n_back, qty_back,
    date_diff('day', out_date, back_date)::BIGINT AS days_between
  FROM outs JOIN backs USING (product_id, site_id) WHERE date_diff('day', out_date, back_date) BETWEEN 0 AND 30""")
def interval_join(t):
    moves = b.movements(t)
    return relational.round_trips(
        moves.where("movement_type = 'outbound'"), moves.where("movement_type = 'inbound'"),
        keys=["product_id", "site_id"], day="movement_date", quantity="quantity", within=30,
    )


@query("soft_region_join", S + f""", {b.SQL_SITES}, a AS (SELECT region, SUM(amount) AS x FROM sales GROUP BY 1),
    c AS (SELECT region, COUNT(*) AS n, SUM(capacity) AS cap FROM sites GROUP BY 1)
  SELECT region, {m('a.x')} AS revenue, c.n AS sites, CAST(c.cap AS DOUBLE) AS capacity FROM a JOIN c USING (region)""")
def soft_region_join(t):
    revenue = b.order_sums(t, "customer").groupBy("region").agg(money(F.sum("amount")).alias("revenue"))
    hosts = b.sites(t).groupBy("region").agg(
        F.count(F.lit(1)).alias("sites"), F.sum("capacity").cast("double").alias("capacity")
    )
    return revenue.join(hosts, "region")


@query("fanout_safe_join", f"""WITH {b.SQL_STOCK}, {b.SQL_MOVES}
  SELECT product_id, held, last_outbound FROM (SELECT product_id, SUM(quantity)::BIGINT AS held FROM stock GROUP BY 1)
  LEFT JOIN (SELECT product_id, MAX(movement_date) AS last_outbound FROM moves WHERE movement_type = 'outbound' GROUP BY 1)
  USING (product_id)""")
def fanout_safe_join(t):
    # Snapshot and movements are brought to product grain together, so no row is multiplied.
    return b.known_products(t, b.ledger(t, "product_id")).select("product_id", "held", "last_outbound")


@query("coverage_join", S + f""", {b.SQL_STOCK}, top AS (
    SELECT product_id, SUM(quantity)::BIGINT AS sold FROM sales WHERE status IN ('F', 'O') GROUP BY 1
    ORDER BY 2 DESC, 1 LIMIT 20)
  SELECT product_id, sold, held, {q('held', 'sold')} AS cover FROM top LEFT JOIN
    (SELECT product_id, SUM(quantity)::BIGINT AS held FROM stock GROUP BY 1) USING (product_id)""")
def coverage_join(t):
    top = (
        relational.revenue_only(b.sales(t, "order"), b.REVENUE_STATUSES)
        .groupBy("product_id").agg(F.sum("quantity").alias("sold"))
        .orderBy(F.desc("sold"), "product_id").limit(20)
    )
    held = b.stock(t).groupBy("product_id").agg(F.sum("quantity").alias("held"))
    return top.join(held, "product_id", "left").withColumn("cover", ratio(F.col("held"), F.col("sold")))


# --- aggregates --------------------------------------------------------------
@query("group_agg", S + f"""
  SELECT region, {m('SUM(amount)')} AS revenue, COUNT(*) AS lines, {q('SUM(amount)', 'COUNT(*)')} AS avg_amount,
    CAST(MIN(amount) AS DOUBLE) AS min_amount, CAST(MAX(amount) AS DOUBLE) AS max_amount
  FROM sales WHERE status IN ('F', 'O') GROUP BY 1""")
def group_agg(t):
    return relational.revenue_only(b.order_sums(t, "customer"), b.REVENUE_STATUSES).groupBy("region").agg(
        money(F.sum("amount")).alias("revenue"),
        F.sum("lines").alias("lines"),
        ratio(F.sum("amount"), F.sum("lines")).alias("avg_amount"),
        F.min("min_amount").cast("double").alias("min_amount"),
        F.max("max_amount").cast("double").alias("max_amount"),
    )


@query("count_distinct", S + """
  SELECT region, COUNT(DISTINCT customer_id) AS buyers FROM sales GROUP BY 1""")
def count_distinct(t):
    # An order without lines is no sale. Buyers are reduced to one row each before the few regions are counted.
    sold = b.known_products(t, b.sales(t)).select("order_id")
    buyers = b.heads(t).join(sold, "order_id", "left_semi").select("customer_id").distinct()
    return buyers.join(b.members(t), "customer_id").groupBy("region").agg(F.countDistinct("customer_id").alias("buyers"))


@query("filtered_agg", S + f"""
  SELECT region, COUNT(*) FILTER (WHERE return_flag = 'R') AS refunded, COUNT(*) FILTER (WHERE return_flag = 'N') AS kept,
    {m("COALESCE(SUM(CASE WHEN year = 1999 THEN amount END), 0)")} AS rev_1999,
    {m("COALESCE(SUM(CASE WHEN year = 2000 THEN amount END), 0)")} AS rev_2000 FROM sales GROUP BY 1""")
def filtered_agg(t):
    def of(year):
        return money(F.coalesce(F.sum(F.when(F.col("year") == year, F.col("amount"))), F.lit(0)))

    flag = F.col("return_flag")
    orders = b.order_rollup(t, amount=F.sum("amount"), r=F.count_if(flag == "R"), n=F.count_if(flag == "N"))
    return orders.groupBy("region").agg(
        F.sum("r").alias("refunded"), F.sum("n").alias("kept"), of(1999).alias("rev_1999"), of(2000).alias("rev_2000"),
    )


@query("rate_by_group", S + f"""
  SELECT category, {r("100.0::DOUBLE * " + q("COUNT(*) FILTER (WHERE return_flag = 'R')", "COUNT(*)"))} AS refund_pct
  FROM sales GROUP BY 1""")
def rate_by_group(t):
    return aggregates.rate(b.sales(t, "product"), ["category"], F.col("return_flag") == "R", "refund_pct")


@query("having_filter", H + f"""
  SELECT customer_id, COUNT(*) AS orders, {m('SUM(total)')} AS total FROM heads GROUP BY 1
  HAVING COUNT(*) > 12 AND MAX(order_date) < DATE '2001-06-01'""")
def having_filter(t):
    return (
        b.heads(t).groupBy("customer_id")
        .agg(F.count(F.lit(1)).alias("orders"), F.sum("total").alias("total"), F.max("order_date").alias("last"))
        .where((F.col("orders") > 12) & (F.col("last") < F.lit("2001-06-01").cast("date")))
        .select("customer_id", "orders", money(F.col("total")).alias("total"))
    )


@query("global_agg", f"""
  SELECT COUNT(*) AS lines, SUM(CAST(l_quantity AS BIGINT))::BIGINT AS quantity,
    {m('SUM(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4)))')} AS revenue,
    MIN(CAST(l_shipdate AS DATE)) AS first_day, MAX(CAST(l_shipdate AS DATE)) AS last_day FROM lineitem""")
def global_agg(t):
    return b.sales(t).agg(
        F.count(F.lit(1)).alias("lines"), F.sum("quantity").alias("quantity"),
        money(F.sum("amount")).alias("revenue"),
        F.min("ship_date").alias("first_day"), F.max("ship_date").alias("last_day"),
    )


@query("expr_agg", """
  SELECT l_suppkey, CAST(SUM(CAST(p_retailprice * l_quantity AS DECIMAL(18,4))) AS DOUBLE) AS list_value
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1""")
def expr_agg(t):
    value = (F.col("list_price") * F.col("quantity")).cast("decimal(18,4)")
    return b.sales(t, "product").groupBy(F.col("site_id").alias("l_suppkey")).agg(
        F.sum(value).cast("double").alias("list_value")
    )


@query("ratio_of_aggs", S + f"""
  SELECT region, {q('SUM(amount)', 'COUNT(DISTINCT order_id)')} AS avg_order_value,
    {q('SUM(amount)', 'COUNT(DISTINCT customer_id)')} AS revenue_per_customer,
    {q('SUM(amount - cost)', 'SUM(amount)')} AS margin_ratio,
    CAST(COALESCE(SUM(amount) FILTER (WHERE year = 2000 AND quarter = 4), 0) AS DOUBLE) * 4 AS run_rate
  FROM sales GROUP BY 1""")
def ratio_of_aggs(t):
    # Roll up to orders, then to customers, then to regions: the counts need no distinct.
    quarter = F.when((F.col("year") == 2000) & (F.col("quarter") == 4), F.col("a"))
    orders = b.order_rollup(t, "product", a=F.sum("amount"), c=F.sum("cost"))
    buyers = orders.groupBy("region", "customer_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("a").alias("a"), F.sum("c").alias("c"), F.sum(quarter).alias("q")
    )
    return buyers.groupBy("region").agg(
        ratio(F.sum("a"), F.sum("n")).alias("avg_order_value"),
        ratio(F.sum("a"), F.count(F.lit(1))).alias("revenue_per_customer"),
        ratio(F.sum("a") - F.sum("c"), F.sum("a")).alias("margin_ratio"),
        (F.coalesce(F.sum("q"), F.lit(0)).cast("double") * 4).alias("run_rate"),
    )


@query("weighted_avg", f"""
  SELECT p_brand AS category, {q('SUM(CAST(p_retailprice AS DECIMAL(12,2)) * CAST(l_quantity AS BIGINT))', 'SUM(l_quantity)')} AS weighted_price
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1""")
def weighted_avg(t):
    df = b.sales(t, "product").withColumn("price", F.col("list_price").cast("decimal(12,2)"))
    return aggregates.weighted_mean(df, ["category"], "price", "quantity", "weighted_price")


@query("group_stats", f"""
  SELECT o_orderpriority AS payment, {r('AVG(o_totalprice)')} AS mean, {r('STDDEV_SAMP(o_totalprice)')} AS std, COUNT(*) AS n
  FROM orders GROUP BY 1 HAVING AVG(o_totalprice) > 1000""")
def group_stats(t):
    df = t("orders").withColumnRenamed("o_orderpriority", "payment")
    return aggregates.group_stats(df, ["payment"], "o_totalprice", min_mean=1000)


@query("percentiles", f"""
  SELECT l_returnflag, COUNT(*) AS n_values, {r('quantile_cont(l_extendedprice, 0.25)', 4)} AS p25,
    {r('quantile_cont(l_extendedprice, 0.5)', 4)} AS p50, {r('quantile_cont(l_extendedprice, 0.75)', 4)} AS p75,
    {r('quantile_cont(l_extendedprice, 0.9)', 4)} AS p90 FROM lineitem GROUP BY 1""")
def percentiles(t):
    return aggregates.percentiles(t("lineitem"), "l_extendedprice", (25, 50, 75, 90), ["l_returnflag"])


@query("cv_stability", f"""
  SELECT event_type, {r('STDDEV_SAMP(value) / AVG(value)', 6)} AS cv, {r('VAR_SAMP(value)', 4)} AS variance
  FROM events GROUP BY 1""")
def cv_stability(t):
    return aggregates.variation(t("events"), ["event_type"], "value")


@query("corr_pair", f"""
  SELECT l_returnflag, {r('CORR(l_quantity, l_extendedprice)', 6)} AS corr FROM lineitem GROUP BY 1""")
def corr_pair(t):
    return t("lineitem").groupBy("l_returnflag").agg(
        rounded(F.corr("l_quantity", "l_extendedprice"), 6).alias("corr")
    )


@query("corr_matrix", " UNION ALL ".join(
    f"SELECT '{x}' AS a, '{y}' AS b, {r(f'CORR({x}, {y})', 6)} AS corr FROM lineitem"
    for i, x in enumerate(["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
    for y in ["l_quantity", "l_extendedprice", "l_discount", "l_tax"][i + 1:]))
def corr_matrix(t):
    return aggregates.corr_matrix(t("lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])


MONTHLY = """, monthly AS (SELECT region, year * 12 + month - 1 AS p, CAST(SUM(amount) AS DOUBLE) AS x
  FROM sales GROUP BY 1, 2)"""


def monthly(t):
    """Revenue per region and month index."""
    return b.order_sums(t, "customer").groupBy("region", (F.col("year") * 12 + F.col("month") - 1).alias("p")).agg(
        F.sum("amount").cast("double").alias("x")
    )


@query("linreg_slope", S + MONTHLY + f"""
  SELECT region, {r('REGR_SLOPE(x, p - 23940)', 4)} AS slope FROM monthly GROUP BY 1""")
def linreg_slope(t):
    return aggregates.trend(monthly(t).withColumn("p", F.col("p") - 23940), ["region"], "p", "x").select(
        "region", rounded(F.col("slope"), 4).alias("slope")
    )


@query("linreg_next", S + MONTHLY + f"""
  SELECT region, MAX(p)::BIGINT + 1 AS next_period,
    {r('REGR_INTERCEPT(x, p - 23940) + REGR_SLOPE(x, p - 23940) * (MAX(p - 23940) + 1)')} AS forecast
  FROM monthly GROUP BY 1""")
def linreg_next(t):
    shifted = monthly(t).withColumn("p", F.col("p") - 23940)
    return aggregates.trend(shifted, ["region"], "p", "x").select(
        "region", (F.col("next_period") + 23940).alias("next_period"), rounded(F.col("forecast")).alias("forecast")
    )


@query("mean_ci95", f"""
  SELECT c_mktsegment, COUNT(*) AS n, {r('AVG(c_acctbal)', 4)} AS mean,
    {r('AVG(c_acctbal) - 1.96 * STDDEV_SAMP(c_acctbal) / SQRT(COUNT(*))', 4)} AS low,
    {r('AVG(c_acctbal) + 1.96 * STDDEV_SAMP(c_acctbal) / SQRT(COUNT(*))', 4)} AS high FROM customer GROUP BY 1""")
def mean_ci95(t):
    return aggregates.mean_interval(t("customer"), ["c_mktsegment"], "c_acctbal")


@query("chisq_uniform", f"""WITH c AS (SELECT event_type, COUNT(*) AS o FROM events GROUP BY 1),
    e AS (SELECT SUM(o)::DOUBLE / COUNT(*) AS e, COUNT(*) - 1 AS df FROM c)
  SELECT {r('SUM((o - e) * (o - e) / e)', 6)} AS chi2, MAX(df)::BIGINT AS df FROM c, e""")
def chisq_uniform(t):
    return aggregates.chisq_uniform(t("events"), "event_type")


@query("gini", H + f""", v AS (SELECT customer_id, SUM(total) AS x FROM heads GROUP BY 1),
    k AS (SELECT x, ROW_NUMBER() OVER (ORDER BY x, customer_id) AS i, COUNT(*) OVER () AS n FROM v)
  SELECT {r('2 * SUM(i * CAST(x AS DOUBLE)) / (MAX(n) * SUM(CAST(x AS DOUBLE))) - (MAX(n) + 1) / MAX(n)::DOUBLE', 6)} AS gini
  FROM k""")
def gini(t):
    spend = b.heads(t).groupBy("customer_id").agg(F.sum("total").alias("x"))
    return aggregates.gini(durable(spend), "x", "customer_id")


@query("lorenz", H + f""", v AS (SELECT customer_id, SUM(total) AS x FROM heads GROUP BY 1)
  SELECT customer_id, {r('ROW_NUMBER() OVER (ORDER BY x, customer_id) / CAST(COUNT(*) OVER () AS DOUBLE)', 6)} AS share_entities,
    {r('CAST(SUM(x) OVER (ORDER BY x, customer_id ROWS UNBOUNDED PRECEDING) AS DOUBLE) / CAST(SUM(x) OVER () AS DOUBLE)', 6)} AS share_value
  FROM v""")
def lorenz(t):
    spend = b.heads(t).groupBy("customer_id").agg(F.sum("total").alias("x"))
    return aggregates.lorenz(durable(spend), "x", "customer_id").select("customer_id", "share_entities", "share_value")


@query("pivot_fill", S + """
  SELECT region, """ + ", ".join(
    f"CAST(ROUND(COALESCE(SUM(CASE WHEN quarter = {k} THEN amount END), 0), 2) AS DOUBLE) AS q{k}" for k in (1, 2, 3, 4)) + """
  FROM sales WHERE year = 1999 GROUP BY 1""")
def pivot_fill(t):
    df = b.order_sums(t, "customer", where=b.year_span(1999)).withColumn("q", F.concat(F.lit("q"), F.col("quarter")))
    wide = aggregates.pivot_fill(df, ["region"], "q", ["q1", "q2", "q3", "q4"], F.sum("amount"))
    return wide.select("region", *[money(F.col(f"q{k}")).alias(f"q{k}") for k in (1, 2, 3, 4)])


@query("melt", "SELECT l_orderkey, l_partkey, 'quantity' AS metric, l_quantity AS value FROM lineitem UNION ALL "
       "SELECT l_orderkey, l_partkey, 'tax', l_tax FROM lineitem UNION ALL "
       "SELECT l_orderkey, l_partkey, 'discount', l_discount FROM lineitem")
def melt(t):
    wide = t("lineitem").select(
        "l_orderkey", "l_partkey", F.col("l_quantity").alias("quantity"), F.col("l_tax").alias("tax"),
        F.col("l_discount").alias("discount"),
    )
    return wide.unpivot(["l_orderkey", "l_partkey"], ["quantity", "tax", "discount"], "metric", "value")


@query("arg_extreme", S + f""", x AS (SELECT region, year, month, SUM(amount) AS a FROM sales GROUP BY 1, 2, 3)
  SELECT region, arg_max(year * 100 + month, a)::BIGINT AS best_month, arg_min(year * 100 + month, a)::BIGINT AS worst_month,
    {m('MAX(a)')} AS best, {m('MIN(a)')} AS worst FROM x GROUP BY 1""")
def arg_extreme(t):
    df = b.order_sums(t, "customer").groupBy("region", (F.col("year") * 100 + F.col("month")).alias("ym")).agg(
        F.sum("amount").alias("a")
    )
    return df.groupBy("region").agg(
        F.max_by("ym", "a").alias("best_month"), F.min_by("ym", "a").alias("worst_month"),
        money(F.max("a")).alias("best"), money(F.min("a")).alias("worst"),
    )


@query("histogram", """WITH s AS (SELECT MIN(o_totalprice) AS lo, MAX(o_totalprice) AS hi FROM orders)
  SELECT LEAST(CAST(FLOOR((o_totalprice - lo) * 20 / (hi - lo)) AS BIGINT) + 1, 20) AS bin, COUNT(*) AS n
  FROM orders, s GROUP BY 1""")
def histogram(t):
    return aggregates.histogram(t("orders"), "o_totalprice", 20).select("bin", "n")


@query("power_law_slope", H + f""", v AS (SELECT customer_id, CAST(SUM(total) AS DOUBLE) AS x FROM heads GROUP BY 1)
  SELECT {r('REGR_SLOPE(LN(x), LN(k))', 6)} AS slope FROM (
    SELECT x, RANK() OVER (ORDER BY x DESC) AS k FROM v)""")
def power_law_slope(t):
    spend = b.heads(t).groupBy("customer_id").agg(F.sum("total").alias("x"))
    return aggregates.rank_size_slope(durable(spend), "x")


@query("share_concentration", H + f""", v AS (SELECT customer_id, SUM(total) AS x FROM heads GROUP BY 1)
  SELECT {r(q('(SELECT SUM(x) FROM (SELECT x FROM v ORDER BY x DESC, customer_id LIMIT 10))', '(SELECT SUM(x) FROM v)') + ' * 100', 4)} AS top_share_pct""")
def share_concentration(t):
    spend = b.heads(t).groupBy("customer_id").agg(F.sum("total").alias("x"))
    return aggregates.top_share(durable(spend), "x", "customer_id", 10)


# --- order, limit, set operations --------------------------------------------
@query("order_limit", S + f"""
  SELECT product_id, {m('SUM(amount)')} AS revenue FROM sales GROUP BY 1 ORDER BY SUM(amount) DESC, product_id LIMIT 10""")
def order_limit(t):
    return (
        b.sales(t).groupBy("product_id").agg(F.sum("amount").alias("x"))
        .orderBy(F.desc("x"), "product_id").limit(10)
        .select("product_id", money(F.col("x")).alias("revenue"))
    )


@query("multi_sort", H + """
  SELECT year, payment, COUNT(*) AS orders FROM heads GROUP BY 1, 2 ORDER BY year, orders DESC, payment""")
def multi_sort(t):
    return b.heads(t).groupBy("year", "payment").agg(F.count(F.lit(1)).alias("orders")).orderBy(
        "year", F.desc("orders"), "payment"
    )


@query("top1", S + f"""
  SELECT nation, {m('SUM(amount)')} AS revenue FROM sales GROUP BY 1 ORDER BY SUM(amount) DESC, nation LIMIT 1""")
def top1(t):
    by_nation = b.order_sums(t, "customer").groupBy("nation").agg(F.sum("amount").alias("x"))
    return by_nation.orderBy(F.desc("x"), "nation").limit(1).select("nation", money(F.col("x")).alias("revenue"))


@query("best_and_worst", S + """, v AS (SELECT category, product_id, SUM(quantity) AS sold FROM sales GROUP BY 1, 2)
  SELECT category, arg_max(product_id, sold * 1000000000000 - product_id) AS best_product,
    arg_min(product_id, sold * 1000000000000 + product_id) AS slowest_product,
    MAX(sold)::BIGINT AS best_sold, MIN(sold)::BIGINT AS slowest_sold FROM v GROUP BY 1""")
def best_and_worst(t):
    sold = b.sales(t, "product").groupBy("category", "product_id").agg(F.sum("quantity").alias("sold"))
    # Ties go to the lowest product id on both ends.
    best = F.max_by("product_id", F.struct("sold", -F.col("product_id")))
    return sold.groupBy("category").agg(
        best.alias("best_product"),
        F.min_by("product_id", F.struct("sold", "product_id")).alias("slowest_product"),
        F.max("sold").alias("best_sold"), F.min("sold").alias("slowest_sold"),
    )


@query("union_metrics", """
  SELECT 'orders' AS metric, CAST(COUNT(*) AS VARCHAR) AS value FROM orders UNION ALL
  SELECT 'customers', CAST(COUNT(*) AS VARCHAR) FROM customer UNION ALL
  SELECT 'units', CAST(SUM(CAST(l_quantity AS BIGINT)) AS VARCHAR) FROM lineitem UNION ALL
  SELECT 'order_value', CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS VARCHAR) FROM orders""")
def union_metrics(t):
    orders = t("orders").agg(
        F.count(F.lit(1)).cast("string").alias("orders"),
        F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("string").alias("order_value"),
    ).unpivot([], ["orders", "order_value"], "metric", "value")
    customers = t("customer").agg(F.count(F.lit(1)).cast("string").alias("value"))
    units = t("lineitem").agg(F.sum(F.col("l_quantity").cast("long")).cast("string").alias("value"))
    return (
        orders.unionByName(customers.withColumn("metric", F.lit("customers")))
        .unionByName(units.withColumn("metric", F.lit("units")))
    )


@query("drop_duplicates", """
  SELECT doc_id, lang, source FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS k FROM documents)
  WHERE k = 1""")
def drop_duplicates(t):
    df = t("documents").select("doc_id", "lang", "source", F.md5("text").alias("key"))
    return relational.first_per_key(df, ["key"], ["doc_id"]).select("doc_id", "lang", "source")


@query("period_overlap", H + """
  SELECT DISTINCT customer_id FROM heads WHERE year = 1999 AND customer_id NOT IN (
    SELECT customer_id FROM heads WHERE year = 2000)""")
def period_overlap(t):
    return relational.only_in_first(b.heads(t), "customer_id", b.year_span(1999), b.year_span(2000))
