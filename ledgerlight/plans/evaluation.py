"""Result comparison and run metrics; events stand for the records of runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlight.functions import rounded
from ledgerlight.operators import compare as k
from ledgerlight.plans import bindings as b
from ledgerlight.plans.bindings import sql_ratio as q
from ledgerlight.plans.bindings import sql_round as r
from ledgerlight.plans.registry import query


def sql_number(expr: str) -> str:
    """SQL text of a canonical fractional cell."""
    fixed = f"CAST(CAST({expr} AS DECIMAL(30,6)) AS VARCHAR)"
    return f"'num:' || regexp_replace(regexp_replace({fixed}, '(\\.[0-9]*?)0+$', '\\1'), '\\.$', '')"


@query("normalise_cells", f"""
  SELECT o_orderkey, 'num:' || o_orderkey || ',' || {sql_number('o_totalprice')} || ',' || 'text:' || o_orderstatus || ',bool:'
    || CASE WHEN o_totalprice > 100000 THEN 'true' ELSE 'false' END AS cells FROM orders""")
def normalise_cells(t):
    df = t("orders").select("o_orderkey", "o_totalprice", "o_orderstatus", (F.col("o_totalprice") > 100000).alias("large"))
    cells = [k.canonical(F.col(f.name), f.dataType) for f in df.schema]
    return df.select("o_orderkey", F.concat_ws(",", *cells).alias("cells"))


def side_pairs(t):
    o, li = t("orders"), t("lineitem")
    price = o.select("o_orderkey", "o_totalprice")
    exact = o.select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").cast("decimal(18,2)").alias("v"))
    flags = li.select("l_returnflag", "l_linestatus")
    return {
        "decimal_vs_double": (price, exact),
        "lost_duplicates": (flags, flags.distinct()),
        "swapped_columns": (flags, flags.select("l_linestatus", "l_returnflag")),
        "one_changed": (
            o.select("o_orderkey", "o_custkey"),
            o.select("o_orderkey", F.col("o_custkey") + F.when(F.col("o_orderkey") % 1000 == 7, 1).otherwise(0)),
        ),
        "both_empty": (o.where("o_totalprice < 0").select("o_orderkey"), o.where("o_totalprice < -1").select("o_orderkey")),
    }


def sql_pair(name: str, gold: str, pred: str) -> str:
    """Both sides as rows of canonical cells, compared by EXCEPT ALL both ways."""
    return f"""SELECT '{name}' AS pair, *, CASE WHEN n_gold = 0 AND n_pred = 0 THEN 'both_empty' WHEN missing + surplus = 0 THEN 'match' ELSE 'mismatch' END AS verdict
  FROM (SELECT (SELECT COUNT(*) FROM ({gold})) AS n_gold, (SELECT COUNT(*) FROM ({pred})) AS n_pred,
    (SELECT COUNT(*) FROM ({gold} EXCEPT ALL {pred})) AS missing, (SELECT COUNT(*) FROM ({pred} EXCEPT ALL {gold})) AS surplus)"""


SQL_SIDES = {
    "decimal_vs_double": (f"SELECT o_orderkey, {sql_number('o_totalprice')} FROM orders",
                          f"SELECT o_orderkey, {sql_number('CAST(o_totalprice AS DECIMAL(18,2))')} FROM orders"),
    "lost_duplicates": ("SELECT l_returnflag, l_linestatus FROM lineitem", "SELECT * FROM (SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem)"),
    "swapped_columns": ("SELECT l_returnflag, l_linestatus FROM lineitem", "SELECT l_linestatus, l_returnflag FROM lineitem"),
    "both_empty": ("SELECT o_orderkey FROM orders WHERE o_totalprice < 0", "SELECT o_orderkey FROM orders WHERE o_totalprice < -1"),
    "one_changed": ("SELECT o_orderkey, o_custkey FROM orders", "SELECT o_orderkey, o_custkey + CASE WHEN o_orderkey % 1000 = 7 THEN 1 ELSE 0 END FROM orders"),
}
SQL_LOOSE = [f"SELECT list_sort([{cells}]) FROM lineitem" for cells in ("l_returnflag, l_linestatus", "l_linestatus, l_returnflag")]


@query("multiset_diff", " UNION ALL ".join(sql_pair(n, *sides) for n, sides in SQL_SIDES.items()))
def multiset_diff(t):
    out = None
    for name, (gold, pred) in side_pairs(t).items():
        one = k.multiset_diff(gold, pred).select(F.lit(name).alias("pair"), "n_gold", "n_pred", "missing", "surplus", "verdict")
        out = one if out is None else out.unionByName(one)
    return out


@query("loose_diff", sql_pair("swapped_columns", *SQL_LOOSE))
def loose_diff(t):
    gold, pred = side_pairs(t)["swapped_columns"]
    return k.multiset_diff(gold, pred, loose=True).select(
        F.lit("swapped_columns").alias("pair"), "n_gold", "n_pred", "missing", "surplus", "verdict"
    )


@query("ordered_diff", """WITH g AS (SELECT o_orderkey AS a, o_custkey AS c, ROW_NUMBER() OVER (ORDER BY o_orderdate, o_orderkey) AS i FROM orders),
    p AS (SELECT o_orderkey AS a, o_custkey AS c, ROW_NUMBER() OVER (ORDER BY o_orderdate, o_orderkey DESC) AS i FROM orders)
  SELECT COUNT(g.i) AS n_gold, COUNT(p.i) AS n_pred, COUNT(*) FILTER (WHERE g.a <> p.a OR g.c <> p.c) AS n_off,
    CASE WHEN COUNT(*) FILTER (WHERE g.a <> p.a OR g.c <> p.c) = 0 THEN 'match' ELSE 'mismatch' END AS verdict FROM g FULL JOIN p USING (i)""")
def ordered_diff(t):
    df = t("orders").select("o_orderkey", "o_custkey", "o_orderdate")
    day, key = F.col("o_orderdate"), F.col("o_orderkey")
    return k.ordered_diff(df, [day.asc(), key.asc()], df, [day.asc(), key.desc()])


SQL_VERDICTS = """WITH v AS (SELECT CASE event_type WHEN 'purchase' THEN 'match' WHEN 'view' THEN 'mismatch' WHEN 'click' THEN 'both_empty'
    WHEN 'error' THEN 'gold_error' ELSE 'truncated' END AS verdict, event_type = 'purchase' OR (event_type = 'view' AND value > 50) AS loose FROM events)"""


@query("verdict_rollup", SQL_VERDICTS + """ SELECT COUNT(*) AS total, """ + ", ".join(
    f"COUNT(*) FILTER (WHERE verdict = '{v}') AS {v}" for v in k.VERDICTS) + f""", COUNT(*) FILTER (WHERE loose) AS loose_match,
    COUNT(*) FILTER (WHERE verdict <> 'gold_error') AS scored,
    {q("COUNT(*) FILTER (WHERE verdict = 'match')", "COUNT(*) FILTER (WHERE verdict <> 'gold_error')")} AS exec_accuracy FROM v""")
def verdict_rollup(t):
    kind = F.col("event_type")
    verdict = (
        F.when(kind == "purchase", "match").when(kind == "view", "mismatch").when(kind == "click", "both_empty")
        .when(kind == "error", "gold_error").otherwise("truncated")
    )
    loose = (kind == "purchase") | ((kind == "view") & (F.col("value") > 50))
    return k.verdict_rollup(t("events").select(verdict.alias("verdict"), loose.alias("loose_match")))


SKILLS = {"purchase": "text-to-sql", "view": "data-analysis", "click": "supervisor-routing", "error": "insight-generation",
          "signup": "error-reflection"}


def results(t):
    skill = F.create_map(*[F.lit(x) for kv in SKILLS.items() for x in kv])[F.col("event_type")]
    k_ = F.get_json_object("props", "$.k").cast("long")
    return t("events").select(
        skill.alias("skill"), (k_ < 85).alias("passed"), (k_ < 80).alias("exec_pass"), (k_ < 95).alias("heuristic_pass"),
        (F.col("value") - 5).alias("latency_s"), F.col("ts").cast("date").alias("day"),
    )


SQL_RESULTS = "WITH x AS (SELECT event_type AS e, CAST(json_extract(props, '$.k') AS BIGINT) AS k, value - 5 AS wait, CAST(ts AS DATE) AS day FROM events)"


def sql_pct(hit: str, rows: str) -> str:
    return r(f"100.0::DOUBLE * {q(f'COUNT(*) FILTER (WHERE {rows} AND {hit})', f'COUNT(*) FILTER (WHERE {rows})')}", 1)


JSON_EVENTS = "e IN ('click', 'error', 'signup')"
RATE_SQL = {
    "sql_execution_accuracy": sql_pct("k < 80", "e = 'purchase'"), "sql_heuristic_accuracy": sql_pct("k < 95", "e = 'purchase'"),
    "python_syntax_rate": sql_pct("k < 85", "e = 'view'"), "supervisor_json_rate": sql_pct("k < 85", "e = 'click'"),
    "insight_json_rate": sql_pct("k < 85", "e = 'error'"), "reflector_json_rate": sql_pct("k < 85", "e = 'signup'"),
    "overall_json_valid_rate": sql_pct("k < 85", JSON_EVENTS), "avg_latency_s": r("AVG(wait) FILTER (WHERE wait > 0)"),
}


@query("skill_pass_rates", SQL_RESULTS + " SELECT COUNT(*) AS total_samples, " + ", ".join(f"{e} AS {n}" for n, e in RATE_SQL.items()) + " FROM x")
def skill_pass_rates(t):
    return k.skill_rates(results(t))


@query("skill_counts", "SELECT CASE event_type " + " ".join(f"WHEN '{e}' THEN '{s}'" for e, s in SKILLS.items()) + " END AS skill, COUNT(*) AS n FROM events GROUP BY 1")
def skill_counts(t):
    return results(t).groupBy("skill").agg(F.count(F.lit(1)).alias("n"))


@query("metric_targets", SQL_RESULTS + " " + " UNION ALL ".join(
    f"SELECT '{n}' AS metric, {RATE_SQL[n]} AS value, '{g}' AS target, {RATE_SQL[n]} >= {g[1:-1]} AS meets FROM x" for n, g in k.TARGETS.items()))
def metric_targets(t):
    goal = F.create_map(*[F.lit(x) for kv in k.TARGETS.items() for x in kv])[F.col("metric")]
    out = k.as_metrics(skill_pass_rates(t)).withColumn("target", goal).where("target IS NOT NULL")
    return out.withColumn("meets", k.meets_target(F.col("value"), F.col("target")))


@query("run_delta", SQL_RESULTS + ", " + ", ".join(
    f"{side} AS (SELECT {', '.join(f'{e} AS {n}' for n, e in RATE_SQL.items())} FROM x WHERE {cond})"
    for side, cond in (("a", "day < DATE '2024-01-16'"), ("z", "day >= DATE '2024-01-16'"))) + " " + " UNION ALL ".join(
    f"SELECT '{n}' AS metric, a.{n} AS baseline, z.{n} AS candidate, {r(f'z.{n} - a.{n}', 2 if n == 'avg_latency_s' else 1)} AS delta FROM a, z" for n in RATE_SQL))
def run_delta(t):
    half = F.lit("2024-01-16").cast("date")
    runs = [k.as_metrics(k.skill_rates(results(t).where(c))) for c in (F.col("day") < half, F.col("day") >= half)]
    return k.run_delta(*runs)


SQL_RUNS = f"WITH {b.SQL_TRACES}, n AS (SELECT query_id, CAST(\"at\" AS DATE) AS day, SUM(duration) AS wall, SUM(calls)::BIGINT AS calls, bool_or(status = 'failed') AS failed, " + \
    "bool_or(agent = 'view') AS v, bool_or(agent = 'click') AS c, bool_or(agent = 'purchase') AS p FROM traces GROUP BY 1, 2)"


def daily_runs(t):
    return b.traces(t).withColumn("day", F.col("at").cast("date"))


@query("trace_slo", SQL_RUNS + f""" SELECT COUNT(*) AS runs, {r('quantile_cont(wall, 0.5)', 4)} AS p50, {r('quantile_cont(wall, 0.95)', 4)} AS p95,
    {q('COUNT(*) FILTER (WHERE wall <= 45)', 'COUNT(*)')} AS hit_rate, SUM(calls)::BIGINT AS calls, COUNT(*) FILTER (WHERE failed) AS failed_runs FROM n""")
def trace_slo(t):
    out = k.trace_slo(daily_runs(t), ["query_id", "day"])
    return out.withColumns({c: rounded(F.col(c), 4) for c in ("p50", "p95")})


@query("run_status", SQL_RUNS + """, s AS (SELECT *, concat_ws(',', CASE WHEN NOT v THEN 'view' END, CASE WHEN NOT c THEN 'click' END, CASE WHEN NOT p THEN 'purchase' END) AS sk FROM n),
    f AS (SELECT *, concat_ws('; ', CASE WHEN wall > 120 THEN 'time' END, CASE WHEN calls >= 250 THEN 'calls' END, CASE WHEN sk <> '' THEN 'skipped ' || sk END) AS why FROM s)
  SELECT query_id, day, CASE WHEN v AND why = '' THEN 'success' WHEN v THEN 'partial' ELSE 'failed' END AS status,
    CASE WHEN NOT v AND why = '' THEN 'no usable output' ELSE why END AS reasons FROM f""")
def run_status(t):
    return k.run_status(daily_runs(t), ["query_id", "day"], ["view", "click", "purchase"], "view", 120, 250)
