"""Special functions, sketches, full profiles, replayed loads, run state, partitions and table functions."""

import datetime as dt
import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from ledgerlight.functions import special
from ledgerlight.operators import aggregates, compare, frames, profile, sketches
from ledgerlight.plans.scaled import rocks
from ledgerlight.sources import loading, writers
from ledgerlight.sources.readers import load_typed
from ledgerlight.streaming import feeds, runs


# --- special functions -------------------------------------------------------
def test_chi_square_tails_against_closed_forms(spark):
    points = [(x, float(df)) for df in (1, 2, 4, 10, 60, 400) for x in (0.0, 0.01, 0.7, 3.84, 9.5, 40.0, 380.0, 700.0)]
    rows = spark.createDataFrame(points, "x double, df double").select("x", "df", special.chi2_tail(F.col("x"), F.col("df")).alias("p")).collect()
    for x, df, p in rows:
        if df == 1:
            want = math.erfc(math.sqrt(x / 2))
        else:
            want = math.fsum(math.exp(-x / 2 + k * math.log(x / 2) - math.lgamma(k + 1)) if x else float(k == 0) for k in range(int(df) // 2))
        assert p == pytest.approx(want, abs=1e-9)


def test_student_tails_and_quantiles_against_closed_forms(spark):
    points = [(t, v) for v in (1, 2, 4, 30, 5_000) for t in (0.0, 0.3, 1.0, 2.5, 12.0)]
    df = spark.createDataFrame([(t, float(v)) for t, v in points], "t double, v double")
    for t, v, p in df.select("t", "v", special.t_tails(F.col("t"), F.col("v")).alias("p")).collect():
        if v == 1:
            assert p == pytest.approx(1 - 2 / math.pi * math.atan(t), abs=1e-9)
        elif v == 2:
            assert p == pytest.approx(1 - t / math.sqrt(2 + t * t), abs=1e-9)
        elif v == 4:
            assert p == pytest.approx(1 - t * (t * t + 6) / (t * t + 4) ** 1.5, abs=1e-9)
        elif v == 5_000:
            assert p == pytest.approx(math.erfc(t / math.sqrt(2)), abs=3e-4)
    q = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (30.0,), (900.0,), (0.0,), (None,)], "v double").select("v", special.t_quantile(0.05, F.col("v")).alias("t"))
    got = {r["v"]: r["t"] for r in q.collect()}
    assert got[1.0] == pytest.approx(math.tan(math.pi * 0.475), abs=1e-8)
    assert got[2.0] == pytest.approx(math.sqrt(2 * 0.95**2 / (1 - 0.95**2)), abs=1e-9)
    assert got[30.0] == pytest.approx(2.0422724563, abs=1e-9) and got[0.0] is None and got[None] is None
    back = q.where("v > 0").select(special.t_tails(F.col("t"), F.col("v")).alias("p")).collect()
    assert all(r["p"] == pytest.approx(0.05, abs=1e-10) for r in back)


def test_beta_and_gamma_at_their_ends(spark):
    one = spark.range(1)
    a, b = F.lit(2.5), F.lit(0.5)
    got = one.select(special.beta_i(a, b, F.lit(0.0)), special.beta_i(a, b, F.lit(1.0)), special.gamma_q(a, F.lit(0.0)), special.gamma_q(a, F.lit(None))).first()
    assert tuple(got) == (0.0, 1.0, 1.0, None)
    x = F.lit(0.3)
    left, right = one.select(special.beta_i(a, b, x), special.beta_i(b, a, 1 - x)).first()
    assert left + right == pytest.approx(1, abs=1e-12)


def test_interval_of_a_small_group_is_wide(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0)], "k string, x double")
    got = {r["k"]: tuple(r)[1:] for r in aggregates.mean_interval_t(df, ["k"], "x").collect()}
    assert got["a"] == (2, 2.0, -10.7062, 14.7062) and got["b"] == (1, 5.0, None, None)


# --- sketches ----------------------------------------------------------------
def test_merged_quantile_sketches_keep_their_rank_bound(spark):
    df = spark.range(60_000).select(
        (F.col("id") % 2).alias("k"), F.expr("date_add(DATE '2024-01-01', cast(id % 30 as int))").alias("day"),
        F.when(F.col("id") % 3 == 0, F.lit(7.0)).otherwise(F.exp((F.xxhash64("id") % 1000) / 100.0)).alias("x"),
    )
    points = {"p10": 0.1, "p50": 0.5, "p99": 0.99}
    stored = sketches.daily(df, ["k"], F.col("day"), value="x")
    assert stored.count() == 30
    found = sketches.quantiles_of(stored.where("day < DATE '2024-01-20'"), ["k"], points)
    errors = sketches.rank_error(df.where("day < DATE '2024-01-20'"), ["k"], "x", found, points).collect()
    assert len(errors) == 6 and all(r["error"] <= sketches.RANK_BOUND for r in errors)
    assert {r["n_values"] for r in found.collect()} == {20_000, 18_000}


def test_set_sketches_unite_and_intersect(spark):
    df = spark.range(200_000).select(
        F.expr("date_add(DATE '2024-01-01', cast(id % 4 as int))").alias("day"), F.when(F.col("id") % 4 < 2, F.col("id") % 60_000).otherwise(F.col("id") % 60_000 + 30_000).alias("u")
    )
    stored = sketches.daily(df, [], F.col("day"), member="u").withColumn("half", F.col("day") < "2024-01-03")
    two = sketches.united(stored, ["half"]).collect()
    assert len(two) == 2
    sets = {r["half"]: {x["u"] for x in df.withColumn("half", F.col("day") < "2024-01-03").where(F.col("half") == r["half"]).select("u").distinct().collect()} for r in two}
    wide = sketches.united(stored, ["half"]).groupBy().pivot("half", [True, False]).agg(F.first("s"))
    a, b = [F.col(f"`{c}`") for c in wide.columns]
    got = wide.select(sketches.size_of(a), sketches.size_of(b), sketches.size_of(sketches.common(a, b))).first()
    want = [len(sets[True]), len(sets[False]), len(sets[True] & sets[False])]
    assert all(abs(g - w) <= sketches.SET_BOUND * len(sets[True] | sets[False]) for g, w in zip(got, want))


# --- profiles ----------------------------------------------------------------
def test_profile_against_plain_counting(spark):
    import hashlib

    chance = random.Random(4)
    rows = [(k, chance.choice(["x"] * 8 + ["y"] * 3 + [f"v{k}"] * 4 + [None]), chance.choice([1, 2, None]), None) for k in range(3_000)]
    df = spark.createDataFrame(rows, "id long, s string, e int, nothing string").repartition(5)
    got = {r["column_name"]: r for r in profile.full_profile(df, "t").collect()}
    for i, name in enumerate(["id", "s", "e", "nothing"]):
        n = Counter(str(r[i]) for r in rows if r[i] is not None)
        r = got[name]
        assert (r["n_rows"], r["n_nulls"]) == (3_000, 3_000 - n.total())
        frequent = sorted(((-c, v) for v, c in n.items() if c >= 0.05 * 3_000))
        assert (r["frequent"] or "") == "|".join(f"{v}:{-c}" for c, v in frequent)
        assert r["enum_values"] == ("|".join(sorted(n)) if 0 < len(n) <= 12 else None)
        assert (r["samples"] or "") == "|".join(sorted(n, key=lambda v: hashlib.md5(v.encode()).hexdigest())[:5])
    assert profile.full_profile(df.limit(0), "t").count() == 4


# --- loads -------------------------------------------------------------------
TYPES = {"n": "INTEGER", "d": "DATE"}


def batch_of(spark, rows):
    return spark.createDataFrame(rows, "k long, n string, d string")


def state_of(spark, folder):
    return tuple(sorted(map(tuple, loading.loaded(spark, folder, part).collect()), key=repr) for part in ("rows", "failures"))


def test_replayed_and_broken_batches_change_nothing(spark, tmp_path):
    folder = str(tmp_path)
    first, second = batch_of(spark, [(1, "5", "2024-01-02"), (2, "x", None)]), batch_of(spark, [(3, None, "no"), (4, "7", "2024-02-30")])
    assert loading.load_batch(first, 0, folder, "k", TYPES)
    assert loading.load_batch(second, 1, folder, "k", TYPES)
    before = state_of(spark, folder)
    assert [tuple(r) for r in loading.loaded(spark, folder).select("k", "n", "d").orderBy("k").collect()] == [
        (1, 5, dt.date(2024, 1, 2)), (2, None, None), (3, None, None), (4, 7, None)]
    bad = {(r["key"], r["column_name"], r["value"], r["reason"]) for r in loading.loaded(spark, folder, "failures").collect()}
    assert bad == {(2, "n", "x", "no bigint"), (3, "d", "no", "no date"), (4, "d", "2024-02-30", "no date")}
    assert not loading.load_batch(batch_of(spark, [(9, "9", None)]), 1, folder, "k", TYPES)
    # a batch that wrote its rows but never reached the ledger is not seen
    load_typed(first, TYPES).write.parquet(f"{folder}/rows/batch=2")
    assert state_of(spark, folder) == before
    assert loading.load_batch(batch_of(spark, [(6, "1", None)]), 2, folder, "k", TYPES)
    assert loading.loaded(spark, folder).where("batch = 2").count() == 1
    assert [tuple(r) for r in loading.ledger(spark, folder).orderBy("batch").collect()] == [(0, 2, 1), (1, 2, 2), (2, 1, 0)]


# --- runs --------------------------------------------------------------------
STEP = "query_id long, day date, ts timestamp, agent string, status string, duration double, calls long"
PLAN = (["query_id", "day"], "ts", ["view", "click"], "view", 100.0, 20)


def test_runs_close_after_silence_as_the_batch_query_judges_them(spark, tmp_path):
    chance, start = random.Random(6), dt.datetime(2024, 3, 1)
    steps = []
    for query in range(6):
        for day in range(5):
            for _ in range(chance.randint(0, 5)):
                at = start + dt.timedelta(days=day, minutes=chance.randint(0, 1439))
                steps.append((query, at.date(), at, chance.choice(["view", "click", "other"]), chance.choice(["success", "failed"]), float(chance.randint(1, 60)), chance.randint(0, 9)))
    steps.sort(key=lambda r: r[2])
    swapped = [steps[i : i + 9] for i in range(0, len(steps), 9)]
    swapped = [sorted(part, key=lambda r: r[0]) for part in swapped]
    swapped.append([(99, dt.date(2024, 4, 1), dt.datetime(2024, 4, 1), "view", "success", 1.0, 1)])
    source = tmp_path / "in"
    source.mkdir()
    like = spark.createDataFrame([], STEP)
    with rocks(spark):
        for part in swapped:  # every batch is a run of its own over the same state
            spark.createDataFrame(part, STEP).coalesce(1).write.mode("append").parquet(str(source))
            out = runs.closed_runs(feeds.read_feed(spark, like, str(source)), *PLAN)
            feeds.start_append(out, str(tmp_path / "out"), str(tmp_path / "state"), once=True).awaitTermination()
    got = sorted(map(tuple, spark.read.schema(out.schema).parquet(str(tmp_path / "out")).collect()))
    frame = spark.createDataFrame(steps, STEP)
    judged = compare.run_status(frame, PLAN[0], PLAN[2], PLAN[3], PLAN[4], PLAN[5])
    sums = frame.groupBy("query_id", "day").agg(F.count(F.lit(1)).alias("steps"), F.count_if(F.col("status") == "failed").alias("failed"))
    assert got == sorted(map(tuple, judged.join(sums, ["query_id", "day"]).collect()))
    assert {r[2] for r in got} == {"success", "partial", "failed"}


# --- partitions --------------------------------------------------------------
def test_periods_read_their_folders_only(spark, tmp_path):
    days = spark.range(0, 1500, 3).select("id", F.expr("date_add(DATE '2020-01-01', cast(id as int))").alias("day"))
    writers.write_facts(days, str(tmp_path / "f"), "day")
    facts = spark.read.parquet(str(tmp_path / "f"))
    one = facts.where("year = 2021 AND quarter = 2")
    assert one.count() == days.where("day BETWEEN DATE '2021-04-01' AND DATE '2021-06-30'").count()
    assert "PartitionFilters: [isnotnull(year" in one._jdf.queryExecution().executedPlan().toString()
    calendar = spark.createDataFrame([(2021, 2, "x"), (2022, 1, "y")], "year int, quarter int, name string").where("name = 'x'")
    joined = facts.join(F.broadcast(calendar), ["year", "quarter"])
    assert "dynamicpruning" in joined._jdf.queryExecution().executedPlan().toString()
    assert joined.count() == one.count()


# --- table functions ---------------------------------------------------------
def test_alarms_of_each_partition_in_order(spark, many_tasks):
    chance, start = random.Random(8), dt.datetime(2024, 1, 1)
    rows = [(chance.randint(0, 4), start + dt.timedelta(seconds=k), k, None if k % 31 == 0 else float(chance.randint(0, 100))) for k in range(800)]
    shuffled = rows[:]
    chance.shuffle(shuffled)
    df = spark.createDataFrame(shuffled, "u long, at timestamp_ntz, i long, value double").repartition(6)
    want, total = [], defaultdict(float)
    for u, at, _, value in rows:
        if value is not None:
            total[u] = max(0.0, total[u] + value - 45.0)
            if total[u] >= 120.0:
                want.append((u, at, total.pop(u)))
    assert sorted(map(tuple, frames.drift_alarms(df, "u", ["at", "i"], 45.0, 120.0).collect())) == sorted(want) and len(want) > 20
