import pytest
from pyspark.sql import functions as F

from ledgerlight.operators import anomaly, metrics, relational, windows


def frame(spark, values, names=None):
    names = names or [f"r{i}" for i in range(len(values))]
    return spark.createDataFrame(list(zip(names, values)), "region string, value int")


def test_sigma_outlier(spark):
    out = anomaly.detect(frame(spark, [10, 12, 11, 9, 13, 50]), "region", "value").collect()
    assert len(out) == 1 and out[0]["value"] == 50 and out[0]["direction"] == "positive_outlier"
    assert out[0]["sigma"] == 2.23 and out[0]["reason_sigma"] and out[0]["reason_iqr"]


def test_nothing_to_find(spark):
    assert anomaly.detect(frame(spark, [10, 12, 11]), "region", "value").count() == 0
    assert anomaly.detect(frame(spark, [10]), "region", "value", method="hybrid").count() == 0
    assert anomaly.detect(frame(spark, [5, 5, 5]), "region", "value").count() == 0


def test_thresholds(spark):
    t = anomaly.thresholds(frame(spark, [10, 12, 11, 9, 13, 50]), "value").first()
    assert (t["q1"], t["q3"]) == (10.25, 12.75) and t["lower"] == t["sigma_lower"]
    assert anomaly.thresholds(frame(spark, [10, 12]), "value", method="hybrid").first()["lower"] == 10.5 - 1.5


def test_text_that_is_no_number_is_skipped(spark):
    df = spark.createDataFrame([("a", "10"), ("b", "x"), ("c", None), ("d", "11"), ("e", "12"), ("f", "9"), ("g", "90")], "region string, value string")
    out = anomaly.detect(df, "region", "value", method="iqr").collect()
    assert [r["region"] for r in out] == ["g"]


def test_bad_arguments(spark):
    df = frame(spark, [1, 2])
    with pytest.raises(KeyError):
        anomaly.detect(df, "region", "missing")
    with pytest.raises(ValueError):
        anomaly.compare_periods(df, "value", "value", period_type="MoM")


def test_compare_periods(spark):
    df = spark.createDataFrame([("N", 150000, 80000), ("S", 120000, 110000), ("X", 5, 0), ("Y", 5, None)], "region string, cur int, prev int")
    out = {r["region"]: r for r in anomaly.compare_periods(df, "cur", "prev").collect()}
    assert out["N"]["pct_change"] == 87.5 and out["S"]["pct_change"] == 9.09
    assert out["X"]["pct_change"] is None and out["Y"]["is_anomaly"] is False
    assert out["N"]["change_sigma"] == 1.0 and out["N"]["period_comparison"] == "YOY"


def test_one_valid_change_flags_nothing(spark):
    df = spark.createDataFrame([("N", 10, 5), ("S", 3, 0)], "region string, cur int, prev int")
    assert [(r["change_sigma"], r["is_anomaly"]) for r in anomaly.compare_periods(df, "cur", "prev").collect()] == [(None, False)] * 2


def test_sweep_lists_only_columns_with_hits(spark):
    df = spark.createDataFrame([(i, 1.0, float(i % 2), 100.0 if i == 9 else 1.0 * (i % 3)) for i in range(10)], "id int, a double, b double, c double")
    assert [(r["id"], r["column"]) for r in anomaly.sweep(df, "id", ["a", "b", "c"]).collect()] == [(9, "c")]


def test_spike_against_the_rest(spark):
    df = spark.createDataFrame([("N", m, 340 if m == 11 else 100) for m in range(1, 13)], "region string, month int, n int")
    hits = anomaly.against_rest(df, "n", ["region"], 3.0).where("is_spike").collect()
    assert [(r["month"], r["multiple"]) for r in hits] == [(11, 3.4)]


def test_consecutive_overruns(spark):
    df = spark.createDataFrame([("a", m, m in (7, 8, 9)) for m in range(1, 13)], "d string, m int, over boolean")
    runs = {r["m"]: r["run_length"] for r in anomaly.flag_runs(df, ["d"], "m", "over").collect()}
    assert (runs[6], runs[7], runs[8], runs[9], runs[10]) == (0, 1, 2, 3, 0)


def test_paid_below_counts_like_a_pairwise_join(many_tasks):
    rows = [(i, "d" if i % 3 else "e", "M" if i % 4 == 0 else "S", (i * 37) % 50) for i in range(200)]
    df = many_tasks.createDataFrame(rows, "id long, dept string, level string, pay int")
    got = {r["id"]: (r["n_above"], r["widest_gap"]) for r in relational.paid_below(
        df, who="id", group="dept", level="level", pay="pay", lower="S", upper="M").collect()}
    want = {}
    for i, dept, level, pay in rows:
        above = [p for _, d, l, p in rows if d == dept and l == "S" and p > pay]
        if level == "M" and above:
            want[i] = (len(above), max(above) - pay)
    assert got == want


def test_round_trips_match_brute_force(spark):
    outs = [("p", (i * 7) % 90) for i in range(40)]
    backs = [("p", (i * 11) % 90) for i in range(40)] + [("q", 3)]

    def df(rows):
        return spark.createDataFrame(rows, "k string, n int").select("k", F.date_add(F.lit("2024-01-01").cast("date"), F.col("n")).alias("d"), F.lit(1).alias("q"))

    got = relational.round_trips(df(outs), df(backs), keys=["k"], day="d", quantity="q", within=30)
    pairs = got.agg(F.sum(F.col("n_out") * F.col("n_back"))).first()[0]
    assert pairs == sum(1 for k, a in outs for j, z in backs if k == j and 0 <= z - a <= 30)


def test_streaks(spark):
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate([1, 2, 3, 2, 1, 0, 5, 5, 6])], "k string, p int, x int")
    r = windows.longest_streaks(df, ["k"], "p", "x").first()
    assert (r["longest_rise"], r["longest_fall"]) == (2, 3)


def test_abc_and_cover(many_tasks):
    df = many_tasks.createDataFrame([(1, 60), (2, 20), (3, 15), (4, 5)], "id long, v int")
    assert {r["id"]: r["abc"] for r in windows.abc_classes(df, "v", "id").collect()} == {1: "A", 2: "A", 3: "B", 4: "C"}
    assert windows.smallest_cover(df, "v", "id", 80.0).first()["n_entities"] == 2


def test_missing_periods(spark):
    df = spark.createDataFrame([("a", 1), ("a", 4), ("b", 2)], "k string, p int")
    assert sorted(r["p"] for r in metrics.missing_periods(df, ["k"], "p").collect()) == [2, 3]


def test_quarterly_change(spark):
    df = spark.createDataFrame([("a", q, v) for q, v in enumerate([280, 310, 350, 420])], "k string, q int, v int")
    out = [r["pct_change"] for r in windows.change(df, ["k"], "q", "v", 1).orderBy("q").collect()]
    assert out == [None, 10.7, 12.9, 20.0]
