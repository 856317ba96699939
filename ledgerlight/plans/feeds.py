"""Sources, sinks, streams, charts and user code over the shared tables."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from ledgerlight.functions import money, rounded, tokens
from ledgerlight.operators import charts, corpus, frames
from ledgerlight.operators.scale import quantiles
from ledgerlight.plans import bindings as b
from ledgerlight.plans.bindings import sql_money as m
from ledgerlight.plans.bindings import sql_ratio as q
from ledgerlight.plans.bindings import sql_round as r
from ledgerlight.plans.corpus import SQL_SPLIT
from ledgerlight.plans.quality import SQL_TOKENS, stacked
from ledgerlight.plans.registry import query
from ledgerlight.session import durable
from ledgerlight.sources import readers, writers
from ledgerlight.streaming import feeds

S = f"WITH {b.SQL_SALES}"


# --- sources and sinks -------------------------------------------------------
@query("scan_table", """SELECT l_orderkey, l_quantity, l_discount FROM lineitem WHERE l_discount >= 0.08 AND l_returnflag = 'R'""")
def scan_table(t):
    return readers.scan_sql(
        t.spark, "SELECT l_orderkey, l_quantity, l_discount FROM {lines} WHERE l_discount >= :cut AND l_returnflag = :flag",
        {"lines": t("lineitem")}, cut=0.08, flag="R",
    )


@query("table_sample", "SELECT c_custkey, c_name, c_acctbal FROM customer ORDER BY c_custkey LIMIT 5")
def table_sample(t):
    return readers.first_rows(t("customer").select("c_custkey", "c_name", "c_acctbal"), [F.col("c_custkey")])


@query("random_sample", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY md5('42:' || o_orderkey), o_orderkey LIMIT 100")
def random_sample(t):
    return readers.random_rows(t("orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 100)


@query("capped_result", """SELECT o_orderkey, o_custkey, (SELECT COUNT(*) FROM orders) > 1200 AS truncated FROM orders ORDER BY o_orderkey LIMIT 1200""")
def capped_result(t):
    return readers.capped(t("orders").select("o_orderkey", "o_custkey"), [F.col("o_orderkey")], 1_200)


def json_lines(t):
    """Event properties as JSON lines, some broken, blank, no object or without the field."""
    kind = F.col("event_type")
    line = F.when(kind == "error", F.substring("props", 1, 4)).when(kind == "view", "  ").when(
        kind == "click", F.concat(F.lit("["), F.col("props"), F.lit("]"))).when(kind == "signup", F.replace("props", F.lit("k"), F.lit("z"))
    ).otherwise(F.col("props"))
    return t("events").select("event_id", line.alias("line"))


@query("jsonl_intake", """SELECT event_id, CASE event_type WHEN 'error' THEN 'invalid json line' WHEN 'click' THEN 'not an object'
    WHEN 'signup' THEN 'missing field k' END AS reason, CASE WHEN event_type = 'purchase' THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS k
  FROM events WHERE event_type <> 'view'""")
def jsonl_intake(t):
    return readers.parse_lines(json_lines(t), "line", "k long", ["k"]).select("event_id", "reason", F.col("record.k").alias("k"))


@query("jsonl_file_intake", """WITH x AS (SELECT event_id, event_type AS e, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE event_type <> 'view')
  SELECT CASE e WHEN 'error' THEN 'invalid json line' WHEN 'click' THEN 'not an object' WHEN 'signup' THEN 'missing field k' ELSE 'accepted' END AS part,
    COUNT(*) AS n_lines, (SUM(k) FILTER (WHERE e = 'purchase'))::BIGINT AS k_sum, TRUE AS in_place FROM x GROUP BY 1""")
def jsonl_file_intake(t):
    """Lines are written to files in event order and read back with file and line number.

    Accepted lines hold their event's number, so in each file number and line number must
    keep one distance, blank and broken lines included.
    """
    kind, path = F.col("event_type"), writers.scratch_folder(t.spark, "lines")
    whole = F.to_json(F.struct(F.col("event_id").alias("id"), F.get_json_object("props", "$.k").cast("long").alias("k")))
    lines = json_lines(t).join(t("events").select("event_id", "event_type", whole.alias("whole")), "event_id")
    lines = lines.withColumn("line", F.when(kind == "purchase", F.col("whole")).otherwise(F.col("line")))
    lines.repartitionByRange("event_id").sortWithinPartitions("event_id").select("line").write.text(path)
    rows = durable(readers.parse_lines(readers.read_lines(t.spark, path), "line", "id long, k long", ["k"]))
    gap = F.col("record.id") - F.col("line_no")
    apart = rows.where("reason IS NULL").groupBy("file").agg((F.min(gap) != F.max(gap)).alias("apart"))
    return rows.groupBy(F.coalesce("reason", F.lit("accepted")).alias("part")).agg(
        F.count(F.lit(1)).alias("n_lines"), F.sum("record.k").alias("k_sum")
    ).withColumn("in_place", F.coalesce(apart.agg(~F.bool_or("apart")).scalar(), F.lit(True)))


@query("split_sink", f"WITH pool AS (SELECT * FROM documents), {SQL_SPLIT} SELECT split, COUNT(*) AS n, SUM(doc_id)::BIGINT AS ids FROM split GROUP BY 1")
def split_sink(t):
    path = writers.scratch_folder(t.spark, "splits")
    writers.write_splits(corpus.stratified_split(t("documents").select("doc_id", "lang", "text"), "lang", "doc_id"), path)
    back = t.spark.read.schema("doc_id long, lang string, text string, split string").json(path)
    return back.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum("doc_id").alias("ids"))


@query("catalogue_intake", """SELECT 'table' AS kind, c_name AS table_name, NULL AS column_name, c_mktsegment AS detail FROM customer UNION ALL
  SELECT 'column', c_name, 'balance', 'double' FROM customer UNION ALL SELECT 'column', c_name, 'nation', 'int' FROM customer UNION ALL
  SELECT 'link', c_name, 'nation', 'nation_' || c_nationkey FROM customer UNION ALL
  SELECT 'link', c_name, 'balance', 'segment_' || c_mktsegment FROM customer""")
def catalogue_intake(t):
    column = [F.struct(F.lit(n).alias("name"), F.lit(k).alias("type")) for n, k in (("balance", "double"), ("nation", "int"))]
    table = F.struct(
        F.col("c_name").alias("name"), F.col("c_mktsegment").alias("description"), F.array(*column).alias("columns"),
        F.create_map(F.lit("nation"), F.concat(F.lit("nation_"), F.col("c_nationkey").cast("string"))).alias("foreign_keys"),
    )
    hint = F.struct(F.col("c_name").alias("table"), F.lit("balance").alias("column"), F.concat(F.lit("segment_"), F.col("c_mktsegment")).alias("target"))
    docs = t("customer").select(F.to_json(F.struct(F.array(table).alias("tables"), F.array(hint).alias("cross_domain"))).alias("document"))
    return readers.catalogue_rows(docs)


@query("normalised_questions", """SELECT conv_id AS doc_id, turn, length(text)::BIGINT AS size FROM conversations WHERE role = 'user' AND conv_id IN (SELECT doc_id FROM labels)""")
def normalised_questions(t):
    asked = t("conversations").where("role = 'user'").select(F.col("conv_id").alias("doc_id"), "turn", F.length("text").cast("long").alias("size"))
    return readers.with_schema(asked, t("labels"), "doc_id")


@query("typed_load", f"""WITH w AS (SELECT UNNEST({SQL_TOKENS.format('text')}) AS w FROM documents), u AS (SELECT upper(w) AS u FROM w)
  SELECT CASE WHEN u = 'DATE' THEN 'date' WHEN contains(u, 'DATETIME') OR contains(u, 'TIMESTAMP') THEN 'timestamp' WHEN contains(u, 'INT') THEN 'bigint'
    WHEN contains(u, 'CHAR') OR contains(u, 'CLOB') OR contains(u, 'TEXT') THEN 'string' WHEN contains(u, 'BLOB') THEN 'binary'
    WHEN contains(u, 'REAL') OR contains(u, 'FLOA') OR contains(u, 'DOUB') THEN 'double' WHEN contains(u, 'NUMERIC') OR contains(u, 'DECIMAL') THEN 'decimal(38,9)'
    WHEN contains(u, 'BOOL') THEN 'boolean' ELSE 'string' END AS concrete_type, COUNT(*) AS n FROM u GROUP BY 1""")
def typed_load(t):
    words = t.spread("documents", "doc_id").select(F.explode(tokens(F.col("text"))).alias("w"))
    return words.groupBy(readers.declared_type(F.col("w")).alias("concrete_type")).agg(F.count(F.lit(1)).alias("n"))


CASTS = {"c_name": "INTEGER", "c_acctbal": "REAL", "c_mktsegment": "DATE", "c_custkey": "BIGINT"}


@query("typed_cast", """SELECT 'c_name' AS column_name, COUNT(*) FILTER (WHERE TRY_CAST(c_name AS BIGINT) IS NULL) AS failures FROM customer UNION ALL
  SELECT 'c_acctbal', COUNT(*) FILTER (WHERE TRY_CAST(CAST(c_acctbal AS VARCHAR) AS DOUBLE) IS NULL) FROM customer UNION ALL
  SELECT 'c_mktsegment', COUNT(*) FILTER (WHERE TRY_CAST(c_mktsegment AS DATE) IS NULL) FROM customer UNION ALL
  SELECT 'c_custkey', COUNT(*) FILTER (WHERE TRY_CAST(CAST(c_custkey AS VARCHAR) AS BIGINT) IS NULL) FROM customer""")
def typed_cast(t):
    text = t("customer").select(*[F.col(c).cast("string").alias(c) for c in CASTS])
    return readers.cast_failures(text, CASTS)


TRACE_SCHEMA = "query_id long, agent string, status string, timestamp double, llm_calls long, duration_ms double"


@query("trace_log", f"WITH {b.SQL_TRACES} SELECT agent, status, COUNT(*) AS steps, SUM(calls)::BIGINT AS calls, MAX(duration) AS longest FROM traces GROUP BY 1, 2")
def trace_log(t):
    path = writers.scratch_folder(t.spark, "traces")
    rows = b.traces(t).select(
        "query_id", "agent", "status", F.unix_micros(F.col("at").cast("timestamp")).cast("double").alias("timestamp"),
        F.col("calls").alias("llm_calls"), F.col("duration").alias("duration_ms"),
    )
    writers.append_traces(rows.where("status = 'success'"), path)
    writers.append_traces(rows.where("status = 'failed'"), path)
    return t.spark.read.schema(TRACE_SCHEMA).json(path).groupBy("agent", "status").agg(
        F.count(F.lit(1)).alias("steps"), F.sum("llm_calls").alias("calls"), F.max("duration_ms").alias("longest")
    )


@query("report_sink", f"SELECT COUNT(*) AS total, COUNT(*) FILTER (WHERE event_type = 'error') AS failed, {q('SUM(CAST(value AS DECIMAL(12,2)))', 'COUNT(*)')} AS mean_value FROM events")
def report_sink(t):
    path = writers.scratch_folder(t.spark, "report")
    report = t("events").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("event_type") == "error").alias("failed"),
        (F.sum(F.col("value").cast("decimal(12,2)")).cast("double") / F.count(F.lit(1))).alias("mean_value"),
    )
    writers.write_report(report, path)
    return t.spark.read.schema("total long, failed long, mean_value double").json(path)


@query("refuse_overwrite", "SELECT COUNT(*) AS kept_rows, TRUE AS refused FROM customer")
def refuse_overwrite(t):
    path = writers.scratch_folder(t.spark, "table")
    writers.write_new(t("customer"), path)
    try:
        writers.write_new(t("orders"), path)
        refused = False
    except AnalysisException:
        refused = True
    return t.spark.read.parquet(path).agg(F.count(F.lit(1)).alias("kept_rows"), F.lit(refused).alias("refused"))


# --- streams -----------------------------------------------------------------
def run_stream(t, name, build):
    """Work off the event files as a stream and return what was appended."""
    like = t("events")
    stream = feeds.read_feed(t.spark, like, t.path("events")).withColumn("ts", F.col("ts").cast("timestamp"))
    out = build(stream)
    folder = writers.scratch_folder(t.spark, name)
    feeds.start_append(out, f"{folder}/data", f"{folder}/state", once=True).awaitTermination()
    return t.spark.read.schema(out.schema).parquet(f"{folder}/data")


@query("stream_trace_slo", """WITH w AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type AS agent, COUNT(*) AS steps,
    COUNT(*) FILTER (WHERE event_type = 'error') AS failed, MAX(value) AS longest FROM events GROUP BY 1, 2)
  SELECT start, start + INTERVAL 1 HOUR AS "end", agent, steps, failed, longest FROM w
  WHERE start + INTERVAL 1 HOUR <= (SELECT MAX(ts) FROM events) - INTERVAL 10 MINUTE""")
def stream_trace_slo(t):
    def build(stream):
        status = F.when(F.col("event_type") == "error", "failed").otherwise("success")
        return feeds.trace_windows(
            stream.select("ts", F.col("event_type").alias("agent"), status.alias("status"), F.col("value").alias("duration")), "ts"
        )

    out = run_stream(t, "trace-windows", build)
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


@query("stream_ledger_alert", f"""WITH w AS (SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, COUNT(*) AS n FROM events GROUP BY 1, 2),
    u AS (SELECT event_type, AVG(n) AS usual FROM w GROUP BY 1)
  SELECT start, w.event_type, n, {r('n / usual', 6)} AS multiple FROM w JOIN u USING (event_type)
  WHERE n / usual >= 1.15 AND start + INTERVAL 1 DAY <= (SELECT MAX(ts) FROM events) - INTERVAL 1 HOUR""")
def stream_ledger_alert(t):
    days = t("events").groupBy("event_type", F.col("ts").cast("date").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    baseline = days.groupBy("event_type").agg((F.sum("n") / F.count(F.lit(1))).alias("usual"))
    out = run_stream(t, "ledger-alerts", lambda s: feeds.ledger_alerts(s, baseline, "ts", "event_type", 1.15))
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", rounded(F.col("multiple"), 6).alias("multiple"))


@query("stream_dedup", "SELECT DISTINCT user_id, event_type, date_trunc('hour', ts) AS hour FROM events")
def stream_dedup(t):
    def build(stream):
        keyed = stream.withColumn("hour", F.date_trunc("hour", "ts"))
        return feeds.drop_repeats(keyed, "ts", ["user_id", "event_type", "hour"]).select("user_id", "event_type", "hour")

    return run_stream(t, "dedup", build).withColumn("hour", F.col("hour").cast("timestamp_ntz"))


# --- user code ---------------------------------------------------------------
DRIFT, LIMIT = 60.0, 150.0


@query("user_frame_fn", f"""WITH RECURSIVE r AS (SELECT user_id, ts, value, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events WHERE value IS NOT NULL),
  s(user_id, i, ts, level, total) AS (SELECT user_id, 0::BIGINT, NULL::TIMESTAMP, 0::DOUBLE, 0::DOUBLE FROM (SELECT DISTINCT user_id FROM r) UNION ALL
    SELECT r.user_id, r.i, r.ts, GREATEST(0, s.total + r.value - {DRIFT}), CASE WHEN GREATEST(0, s.total + r.value - {DRIFT}) >= {LIMIT} THEN 0 ELSE GREATEST(0, s.total + r.value - {DRIFT}) END
    FROM s JOIN r ON r.user_id = s.user_id AND r.i = s.i + 1)
  SELECT user_id, ts AS "at", {r('level', 6)} AS level FROM s WHERE i > 0 AND level >= {LIMIT}""")
def user_frame_fn(t):
    """Alarms of a sum that restarts, by a registered table function over each user's events in order."""
    rows = t("events").select("user_id", F.col("ts").alias("at"), "event_id", "value")
    return frames.drift_alarms(rows, "user_id", ["at", "event_id"], DRIFT, LIMIT).withColumn("level", rounded(F.col("level"), 6))


@query("user_fold_fn", "SELECT l_returnflag, l_linestatus, COUNT(*) AS n, MAX(l_quantity * l_discount) AS peak FROM lineitem GROUP BY 1, 2")
def user_fold_fn(t):
    def partial(pdf):
        pdf = pdf.assign(x=pdf["l_quantity"] * pdf["l_discount"])
        return pdf.groupby(["l_returnflag", "l_linestatus"], as_index=False).agg(n=("x", "size"), peak=("x", "max"))

    df = t("lineitem").select("l_returnflag", "l_linestatus", "l_quantity", "l_discount")
    return frames.fold_frames(
        df, partial, "l_returnflag string, l_linestatus string, n long, peak double", ["l_returnflag", "l_linestatus"],
        n=F.sum("n"), peak=F.max("peak"),
    )


@query("user_group_fn", f"SELECT l_suppkey, {r('MEDIAN(l_extendedprice)', 4)} AS median_price FROM lineitem GROUP BY 1")
def user_group_fn(t):
    """A user statistic of whole groups, the median, by distributed order statistics."""
    middle = quantiles(t("lineitem").select("l_suppkey", "l_extendedprice"), "l_extendedprice", {"median_price": 0.5}, ["l_suppkey"])
    return middle.select("l_suppkey", rounded(F.col("median_price"), 4).alias("median_price"))


# --- charts ------------------------------------------------------------------
CHARTS = (("orders", "o_orderstatus", "o_totalprice"), ("orders", "o_orderdate", "o_totalprice"), ("orders", "o_orderpriority", "o_orderstatus"),
          ("part", "p_brand", "p_retailprice"), ("customer", "c_mktsegment", "c_name"))
KIND = {("orders", "o_orderstatus"): "num", ("orders", "o_orderdate"): "num", ("orders", "o_orderpriority"): "text", ("part", "p_brand"): "num",
        ("customer", "c_mktsegment"): "text"}


@query("chart_type_auto", " UNION ALL ".join(
    f"SELECT '{table}.{x}' AS chart, n AS n_labels, l AS longest, CASE WHEN n <= 6 AND {KIND[table, x] == 'num'} THEN 'pie' WHEN {'date' in x} THEN 'line' "
    f"WHEN n <= 10 AND l > 15 THEN 'hbar' ELSE 'bar' END AS chart_type FROM (SELECT COUNT(DISTINCT {x}) AS n, MAX(length(CAST({x} AS VARCHAR))) AS l FROM {table})"
    for table, x, _ in CHARTS))
def chart_type_auto(t):
    return stacked(
        charts.chart_type(t(table), x, y).select(F.lit(f"{table}.{x}").alias("chart"), "n_labels", "longest", "chart_type") for table, x, y in CHARTS
    )


@query("chart_grouped", f"WITH {b.SQL_HEADS} SELECT year, " + ", ".join(
    f"CAST(COALESCE(SUM(CASE WHEN quarter = {i} THEN total END), 0) AS DOUBLE) AS q{i}" for i in (1, 2, 3, 4)) + " FROM heads GROUP BY 1")
def chart_grouped(t):
    names = ["q1", "q2", "q3", "q4"]
    df = b.heads(t).withColumn("q", F.concat(F.lit("q"), F.col("quarter").cast("string")))
    return charts.grouped(df, "year", "q", names, F.sum("total")).select("year", *[F.col(n).cast("double").alias(n) for n in names])


@query("chart_series", S + f" SELECT region, year, month, {m('SUM(amount)')} AS revenue FROM sales GROUP BY 1, 2, 3 ORDER BY region, year, month")
def chart_series(t):
    points = b.order_sums(t, "customer").groupBy("region", "year", "month").agg(money(F.sum("amount")).alias("revenue"))
    return charts.series(points, ["region", "year"], "month", "revenue")


@query("chart_hist", """WITH s AS (SELECT MIN(c_acctbal) AS lo, MAX(c_acctbal) AS hi FROM customer), k AS (
    SELECT LEAST(CAST(FLOOR((c_acctbal - lo) * 20 / (hi - lo)) AS BIGINT) + 1, 20) AS bin, COUNT(*) AS n FROM customer, s GROUP BY 1)
  SELECT g.bin, lo + (g.bin - 1) * ((hi - lo) / 20) AS left, lo + g.bin * ((hi - lo) / 20) AS right, COALESCE(n, 0) AS n
  FROM (SELECT UNNEST(range(1, 21)) AS bin) g CROSS JOIN s LEFT JOIN k USING (bin)""")
def chart_hist(t):
    return charts.bins(t("customer"), "c_acctbal", 20)


@query("chart_pie", f"""SELECT o_orderstatus, COUNT(*) AS n, {r('100.0::DOUBLE * COUNT(*) / SUM(COUNT(*)) OVER ()', 1)} AS pct FROM orders GROUP BY 1""")
def chart_pie(t):
    return charts.pie(t("orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n")), "n")


@query("chart_flagged", S + f""", v AS (SELECT nation, CAST(SUM(amount) AS DOUBLE) AS x FROM sales GROUP BY 1)
  SELECT nation, {r('x')} AS revenue, ABS(x - AVG(x) OVER ()) / STDDEV_POP(x) OVER () >= 1.5 AS is_anomaly FROM v""")
def chart_flagged(t):
    bars = b.order_sums(t, "customer").groupBy("nation").agg(F.sum("amount").cast("double").alias("revenue"))
    return charts.flagged(durable(bars), "nation", "revenue", 1.5)
