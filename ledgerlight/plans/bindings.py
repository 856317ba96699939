"""Business roles over the shared tables.

Each function joins only what the caller asks for, so a query that needs no
product columns reads no product table. No join is hinted: small dimensions are
broadcast by size, large ones are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlight.functions import exact
from ledgerlight.sources.tables import Tables

# Share of the list price taken as cost; the tables hold no cost column.
COST_RATE = 0.6
# Order statuses that count as revenue.
REVENUE_STATUSES = ("F", "O")
# Return flags read as ledger movements.
MOVEMENTS = {"N": "outbound", "R": "inbound", "A": "write_off"}
# A member without an order since this day has left.
LEFT_BEFORE = "2001-01-01"
# Department budget per month as a multiple of its members' balances.
BUDGET_RATE = 2.5
# Site capacity as a multiple of the site balance.
CAPACITY_RATE = 4


def amount():
    return exact(F.col("l_extendedprice") * (1 - F.col("l_discount")))


def places(t: Tables) -> DataFrame:
    """Nation with its region."""
    n, r = t("nation"), t("region")
    return n.join(r, n.n_regionkey == r.r_regionkey).select(
        "n_nationkey", F.col("n_name").alias("nation"), F.col("r_name").alias("region")
    )


def members(t: Tables) -> DataFrame:
    """Customer with nation, region and segment."""
    c = t("customer").select(
        F.col("c_custkey").alias("customer_id"), "c_name", "c_nationkey", "c_acctbal",
        F.col("c_mktsegment").alias("segment"),
    )
    return c.join(places(t), c.c_nationkey == F.col("n_nationkey")).drop("c_nationkey", "n_nationkey")


def items(t: Tables) -> DataFrame:
    """Product with category, family, list price and unit cost."""
    return t("part").select(
        F.col("p_partkey").alias("product_id"),
        F.col("p_name").alias("product"),
        F.col("p_brand").alias("category"),
        F.col("p_type").alias("family"),
        F.col("p_size").cast("long").alias("min_threshold"),
        F.col("p_retailprice").alias("list_price"),
    )


def sales(t: Tables, *dims: str) -> DataFrame:
    """Order lines; ``dims`` out of ``order``, ``customer``, ``product``."""
    df = t("lineitem").select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_suppkey").alias("site_id"),
        F.col("l_quantity").cast("long").alias("quantity"),
        F.col("l_discount").alias("discount"),
        F.col("l_extendedprice").alias("gross"),
        F.col("l_tax").alias("tax"),
        amount().alias("amount"),
        F.col("l_returnflag").alias("return_flag"),
        F.col("l_linestatus").alias("line_status"),
        F.col("l_shipdate").cast("date").alias("ship_date"),
    )
    if "order" in dims or "customer" in dims:
        df = df.join(heads(t), "order_id")
    if "customer" in dims:
        df = df.join(members(t), "customer_id")
    if "product" in dims:
        df = df.join(items(t), "product_id").withColumn(
            "cost", exact(F.lit(COST_RATE) * F.col("list_price") * F.col("quantity"))
        )
    return df


def heads(t: Tables) -> DataFrame:
    """Orders with their calendar columns."""
    day = F.col("o_orderdate").cast("date")
    return t("orders").select(
        F.col("o_orderkey").alias("order_id"),
        F.col("o_custkey").alias("customer_id"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_orderpriority").alias("payment"),
        exact(F.col("o_totalprice"), 2).alias("total"),
        day.alias("order_date"),
        F.year(day).cast("long").alias("year"),
        F.quarter(day).cast("long").alias("quarter"),
        F.month(day).cast("long").alias("month"),
    )


def year_span(first: int, last: int | None = None) -> Column:
    """Whole years as a date range, which reaches the Parquet scan; ``year = n`` would not."""
    days = [F.lit(d).cast("date") for d in (f"{first}-01-01", f"{last or first}-12-31")]
    return F.col("order_date").between(*days)


def order_sums(t: Tables, *dims: str, where: Column | None = None) -> DataFrame:
    """Orders with the sums of their lines: amount, quantity, lines.

    Lines are rolled up on the order key, on which they are joined to the orders anyway,
    and customers are joined to orders instead of lines. ``where`` restricts the orders;
    the lines then meet the remaining orders before they are added up.
    """
    orders, lines = heads(t), sales(t)
    if where is not None:
        orders = orders.where(where)
        lines = lines.join(orders.select("order_id"), "order_id")
    sums = lines.groupBy("order_id").agg(
        F.sum("amount").alias("amount"), F.sum("quantity").alias("quantity"), F.count(F.lit(1)).alias("lines"),
        F.min("amount").alias("min_amount"), F.max("amount").alias("max_amount"),
    )
    df = sums.join(orders, "order_id")
    return df.join(members(t), "customer_id") if "customer" in dims else df


def order_rollup(t: Tables, *dims: str, **aggs: Column) -> DataFrame:
    """Orders with the given aggregates of their lines, joined to order and customer columns.

    The one shuffle of the lines is by order, on which they meet the orders anyway.
    ``product`` in ``dims`` gives the lines their product columns first.
    """
    lines = sales(t, *[d for d in dims if d == "product"])
    sums = lines.groupBy("order_id").agg(*[c.alias(n) for n, c in aggs.items()])
    return sums.join(heads(t), "order_id").join(members(t), "customer_id")


def ledger(t: Tables, *keys: str) -> DataFrame:
    """Snapshot and movements of each key from one pass over the ledger.

    The snapshot is the sum of all movements of a key, so nothing is joined to get it.
    """
    def of(kind: str) -> Column:
        return F.col("movement_type") == kind

    return movements(t).groupBy(*keys).agg(
        F.sum("quantity").alias("held"), F.sum(F.when(of("outbound"), F.col("quantity"))).alias("outbound"),
        F.max(F.when(of("outbound"), F.col("movement_date"))).alias("last_outbound"), F.count_if(of("inbound")).alias("inbound"),
        F.min("movement_date").alias("first_day"), F.max("movement_date").alias("last_day"),
    )


def known_products(t: Tables, df: DataFrame) -> DataFrame:
    """Rows whose product is listed, as the snapshot has them."""
    return df.join(items(t).select("product_id"), "product_id", "left_semi")


def movements(t: Tables) -> DataFrame:
    """Stock ledger: one row per shipped line, typed by its return flag."""
    kind = F.create_map(*[F.lit(x) for kv in MOVEMENTS.items() for x in kv])[F.col("l_returnflag")]
    return t("lineitem").select(
        F.col("l_partkey").alias("product_id"),
        F.col("l_suppkey").alias("site_id"),
        kind.alias("movement_type"),
        F.col("l_quantity").cast("long").alias("quantity"),
        F.col("l_shipdate").cast("date").alias("movement_date"),
        F.when(F.col("l_linestatus") == "O", F.col("l_orderkey")).alias("order_ref"),
    )


def stock(t: Tables) -> DataFrame:
    """Snapshot per product and site with threshold and unit cost."""
    held = (
        t("lineitem")
        .groupBy(F.col("l_partkey").alias("product_id"), F.col("l_suppkey").alias("site_id"))
        .agg(F.sum(F.col("l_quantity").cast("long")).alias("quantity"))
    )
    return held.join(items(t), "product_id").withColumn(
        "unit_cost", (F.lit(COST_RATE) * F.col("list_price")).cast("decimal(18,4)")
    )


def sites(t: Tables) -> DataFrame:
    """Site with nation, region and capacity."""
    s = t("supplier").select(
        F.col("s_suppkey").alias("site_id"), F.col("s_name").alias("site"), "s_nationkey",
        (F.col("s_acctbal").cast("decimal(12,2)") * CAPACITY_RATE).alias("capacity"),
    )
    return s.join(places(t), s.s_nationkey == F.col("n_nationkey")).drop("s_nationkey", "n_nationkey")


def staff(t: Tables, dates: bool = False) -> DataFrame:
    """Customers read as staff: department = nation, level = segment, salary = balance."""
    df = members(t).select(
        F.col("customer_id").alias("employee_id"),
        F.col("c_name").alias("name"),
        F.col("nation").alias("department"),
        "region",
        F.col("segment").alias("level"),
        F.col("c_acctbal").cast("decimal(12,2)").alias("salary"),
    )
    if dates:
        spans = (
            t("orders")
            .groupBy(F.col("o_custkey").alias("employee_id"))
            .agg(
                F.min("o_orderdate").cast("date").alias("hire_date"),
                F.max("o_orderdate").cast("date").alias("last_date"),
            )
        )
        df = df.join(spans, "employee_id").withColumn(
            "end_date", F.when(F.col("last_date") < F.lit(LEFT_BEFORE).cast("date"), F.col("last_date"))
        )
    return df


PAY_PARTS = ("base", "bonus", "deduction", "overtime")
PAID = ["employee_id", "department", "region", "level", "year", "month", "order_date"]


def _pay_parts() -> dict:
    gross = F.col("gross")
    parts = (exact(gross), exact(gross * F.col("tax")), exact(gross * F.col("discount")), F.col("quantity"))
    return dict(zip(PAY_PARTS, parts))


def _as_staff(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({"customer_id": "employee_id", "nation": "department", "segment": "level"})


def payroll(t: Tables) -> DataFrame:
    """Order lines read as pay records of the ordering customer."""
    df = _as_staff(sales(t, "customer").withColumns(_pay_parts()))
    return df.select(*PAID, *PAY_PARTS, (F.col("base") + F.col("bonus") - F.col("deduction")).alias("net"))


def payroll_sums(t: Tables) -> DataFrame:
    """Pay records added up per order, with their number in ``records``, for sums and means."""
    per_order = sales(t).withColumns(_pay_parts()).groupBy("order_id").agg(
        *[F.sum(c).alias(c) for c in PAY_PARTS], F.count(F.lit(1)).alias("records")
    )
    df = _as_staff(per_order.join(heads(t), "order_id").join(members(t), "customer_id"))
    return df.select(*PAID, *PAY_PARTS, "records", (F.col("base") + F.col("bonus") - F.col("deduction")).alias("net"))


def traces(t: Tables) -> DataFrame:
    """Events read as run traces."""
    return t("events").select(
        F.col("event_id").alias("trace_id"),
        F.col("user_id").alias("query_id"),
        F.col("event_type").alias("agent"),
        F.when(F.col("event_type") == "error", "failed").otherwise("success").alias("status"),
        F.col("ts").alias("at"),
        F.col("value").alias("duration"),
        F.get_json_object("props", "$.k").cast("long").alias("calls"),
    )


def sql_round(expr: str, places: int = 2) -> str:
    """SQL text of ``functions.rounded``."""
    return f"CAST(ROUND(CAST({expr} AS DECIMAL(30,8)), {places}) AS DOUBLE)"


def sql_money(expr: str, places: int = 2) -> str:
    """SQL text of ``functions.money``."""
    return f"CAST(ROUND({expr}, {places}) AS DOUBLE)"


def sql_ratio(num: str, den: str) -> str:
    """SQL text of ``functions.ratio``."""
    return f"(CAST({num} AS DOUBLE) / NULLIF(CAST({den} AS DOUBLE), 0))"


# SQL counterparts of the roles above, as common table expressions.
SQL_SALES = """sales AS (
  SELECT l_orderkey AS order_id, l_partkey AS product_id, l_suppkey AS site_id, o_custkey AS customer_id,
    CAST(l_quantity AS BIGINT) AS quantity, l_discount AS discount, l_extendedprice AS gross, l_tax AS tax,
    CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4)) AS amount,
    l_returnflag AS return_flag, l_linestatus AS line_status, CAST(l_shipdate AS DATE) AS ship_date,
    o_orderstatus AS status, o_orderpriority AS payment, CAST(o_orderdate AS DATE) AS order_date,
    CAST(year(o_orderdate) AS BIGINT) AS year, CAST(quarter(o_orderdate) AS BIGINT) AS quarter,
    CAST(month(o_orderdate) AS BIGINT) AS month,
    c_name, c_acctbal, c_mktsegment AS segment, n_name AS nation, r_name AS region,
    p_name AS product, p_brand AS category, p_type AS family, p_retailprice AS list_price,
    CAST(0.6::DOUBLE * p_retailprice * l_quantity AS DECIMAL(18,4)) AS cost
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  JOIN part ON l_partkey = p_partkey)"""
SQL_HEADS = """heads AS (
  SELECT o_orderkey AS order_id, o_custkey AS customer_id, o_orderstatus AS status, o_orderpriority AS payment,
    CAST(o_totalprice AS DECIMAL(18,2)) AS total, CAST(o_orderdate AS DATE) AS order_date,
    CAST(year(o_orderdate) AS BIGINT) AS year, CAST(quarter(o_orderdate) AS BIGINT) AS quarter,
    CAST(month(o_orderdate) AS BIGINT) AS month FROM orders)"""
SQL_MOVES = """moves AS (
  SELECT l_partkey AS product_id, l_suppkey AS site_id,
    CASE l_returnflag WHEN 'N' THEN 'outbound' WHEN 'R' THEN 'inbound' WHEN 'A' THEN 'write_off' END AS movement_type,
    CAST(l_quantity AS BIGINT) AS quantity, CAST(l_shipdate AS DATE) AS movement_date,
    CASE WHEN l_linestatus = 'O' THEN l_orderkey END AS order_ref FROM lineitem)"""
SQL_STOCK = """stock AS (
  SELECT h.*, p_name AS product, p_brand AS category, p_type AS family, CAST(p_size AS BIGINT) AS min_threshold,
    p_retailprice AS list_price, CAST(0.6::DOUBLE * p_retailprice AS DECIMAL(18,4)) AS unit_cost
  FROM (SELECT l_partkey AS product_id, l_suppkey AS site_id, CAST(SUM(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity
        FROM lineitem GROUP BY 1, 2) h JOIN part ON product_id = p_partkey)"""
SQL_SITES = """sites AS (
  SELECT s_suppkey AS site_id, s_name AS site, CAST(s_acctbal AS DECIMAL(12,2)) * 4 AS capacity,
    n_name AS nation, r_name AS region
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
SQL_STAFF = """staff AS (
  SELECT c_custkey AS employee_id, c_name AS name, n_name AS department, r_name AS region, c_mktsegment AS level,
    CAST(c_acctbal AS DECIMAL(12,2)) AS salary
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
SQL_STAFF_DATES = SQL_STAFF + """, staffed AS (
  SELECT staff.*, hire_date, last_date, CASE WHEN last_date < DATE '2001-01-01' THEN last_date END AS end_date
  FROM staff JOIN (SELECT o_custkey, CAST(MIN(o_orderdate) AS DATE) AS hire_date,
    CAST(MAX(o_orderdate) AS DATE) AS last_date FROM orders GROUP BY 1) ON employee_id = o_custkey)"""
SQL_PAY = SQL_SALES + """, pay AS (
  SELECT customer_id AS employee_id, nation AS department, region, segment AS level, year, month, order_date,
    CAST(gross AS DECIMAL(18,4)) AS base, CAST(gross * tax AS DECIMAL(18,4)) AS bonus,
    CAST(gross * discount AS DECIMAL(18,4)) AS deduction, quantity AS overtime,
    CAST(gross AS DECIMAL(18,4)) + CAST(gross * tax AS DECIMAL(18,4)) - CAST(gross * discount AS DECIMAL(18,4)) AS net
  FROM sales)"""
SQL_TRACES = """traces AS (
  SELECT event_id AS trace_id, user_id AS query_id, event_type AS agent,
    CASE WHEN event_type = 'error' THEN 'failed' ELSE 'success' END AS status, ts AS "at", value AS duration,
    CAST(json_extract(props, '$.k') AS BIGINT) AS calls FROM events)"""
