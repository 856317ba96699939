"""The parallel building blocks against pandas, with groups and ties crossing task borders."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerlight.operators import scale, windows

rng = np.random.default_rng(7)
N = 3000
FRAME = pd.DataFrame({
    "id": np.arange(N),
    # One group holds most rows.
    "g": np.where(rng.random(N) < 0.7, "hot", rng.choice(list("abc"), N)),
    "x": rng.integers(0, 200, N),
})


@pytest.fixture
def df(many_tasks):
    return many_tasks.createDataFrame(FRAME).repartition(8)


def test_running_global_and_grouped(df):
    out = scale.running(df, [F.col("x").asc(), F.col("id").asc()], {"s": F.col("x")}).toPandas().set_index("id")["s"].sort_index()
    want = FRAME.sort_values(["x", "id"]).set_index("id")["x"].cumsum().sort_index()
    assert (out == want).all()
    spans = scale.durable(df.repartitionByRange(F.col("x"))).rdd.getNumPartitions()
    assert spans > 1
    out = scale.running(df, [F.col("x").asc(), F.col("id").asc()], {"s": F.col("x")}, ["g"]).toPandas().set_index("id")["s"].sort_index()
    want = FRAME.sort_values(["x", "id"]).set_index("id").groupby("g")["x"].cumsum().sort_index()
    assert (out == want).all()


def test_running_keeps_null_groups(many_tasks):
    df = many_tasks.createDataFrame([(1, None), (2, None), (3, "a")], "id long, g string")
    out = scale.numbered(df, [F.col("id").asc()], "n", ["g"]).orderBy("id").collect()
    assert [r["n"] for r in out] == [1, 2, 1]


@pytest.mark.parametrize("by", [[], ["g"]])
def test_ranked(df, by):
    out = scale.ranked(df, "x", by=by, percent="p").toPandas().set_index("id").sort_index()
    grouped = FRAME.groupby("g")["x"] if by else FRAME["x"]
    assert (out["rank"] == grouped.rank(method="min", ascending=False)).all()
    n = FRAME.groupby("g")["x"].transform("size") if by else N
    assert np.allclose(out["p"], (out["rank"] - 1) / (n - 1))


@pytest.mark.parametrize("map_values", [scale.MAP_VALUES, 0])
@pytest.mark.parametrize("by", [[], ["g"]])
def test_quantiles(df, by, map_values):
    probs = {"a": 0.25, "b": 0.5, "c": 0.913, "lo": 0.0, "hi": 1.0}
    out = scale.quantiles(df, "x", probs, by, map_values).toPandas()
    for _, row in out.iterrows():
        part = FRAME if not by else FRAME[FRAME["g"] == row["g"]]
        for name, p in probs.items():
            assert row[name] == pytest.approx(part["x"].quantile(p), abs=1e-9)


def test_attach_by_shuffle_equals_broadcast(df):
    stats = df.groupBy("g").agg(F.sum("x").alias("s"))
    few = scale.attach(df, stats, ["g"]).toPandas().sort_values("id")
    many = scale.attach(df, stats, ["g"], max_rows=1).toPandas().sort_values("id")
    assert (few["s"].to_numpy() == many["s"].to_numpy()).all()


@pytest.mark.parametrize("n", [4, 7])
def test_tiles(df, n):
    out = windows.tiles(df, "x", "id", n).toPandas().groupby("tile").size()
    assert out.sum() == N and out.max() - out.min() <= 1 and list(out.index) == list(range(1, n + 1))
    assert list(out) == sorted(out, reverse=True)


def test_shares_add_up(df):
    out = windows.share_of_total(df.groupBy("g").agg(F.sum("x").alias("v")), "v", places=6).toPandas()
    assert out["pct"].sum() == pytest.approx(100, abs=1e-4)


def test_ema_matches_pandas(spark):
    pdf = pd.DataFrame({"k": ["a"] * 30 + ["b"] * 12, "p": list(range(30)) + list(range(12)), "x": rng.random(42)})
    out = windows.ema(spark.createDataFrame(pdf), ["k"], "p", "x").toPandas().sort_values(["k", "p"])
    want = pdf.groupby("k")["x"].transform(lambda s: s.ewm(span=3, adjust=False).mean())
    assert np.allclose(out["ema"].to_numpy(), want.to_numpy())


@pytest.mark.parametrize("span", [1, 2, 3, 20])
def test_ema_of_a_long_series(spark, span):
    pdf = pd.DataFrame({"k": "a", "p": np.arange(20_000), "x": rng.normal(size=20_000) * 1e6})
    out = windows.ema(spark.createDataFrame(pdf), ["k"], "p", "x", span=span).toPandas().sort_values("p")
    want = pdf["x"].ewm(span=span, adjust=False).mean()
    assert np.allclose(out["ema"].to_numpy(), want.to_numpy(), rtol=1e-12, atol=1e-6)


def test_quantiles_agree_to_the_last_bit_on_both_ways(many_tasks):
    pdf = pd.DataFrame({"g": rng.integers(0, 4, 3_000), "x": rng.normal(size=3_000).round(2) * 1.1})
    df, probs = many_tasks.createDataFrame(pdf), {f"q{k}": k / 37 for k in range(38)}
    ways = [sorted(map(tuple, scale.quantiles(df, "x", probs, ["g"], map_values=m).collect())) for m in (0, 10**9)]
    assert ways[0] == ways[1]


@pytest.mark.parametrize("value,want", [(1.005, 1.01), (-2.345, -2.35), (4e22, 4e22), (-1e300, -1e300), (float("inf"), float("inf")), (None, None), (2.0**70, 2.0**70)])
def test_rounding_never_overflows(spark, value, want):
    from ledgerlight.functions import rounded

    assert spark.createDataFrame([(value,)], "v double").select(rounded(F.col("v"))).first()[0] == want


def test_statistics_are_broadcast_by_bytes(spark):
    small, wide = spark.range(10), spark.range(10).select("id", F.repeat(F.lit("x"), 1000).alias("t"))
    hinted = lambda df: "broadcast" in df._jdf.queryExecution().logical().toString().lower()
    assert hinted(scale.broadcast_if_small(small)) and not hinted(scale.broadcast_if_small(wide, max_bytes=5_000))
    assert not hinted(scale.broadcast_if_small(small, max_rows=9))
