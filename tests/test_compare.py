import random
from collections import Counter
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerlight.operators import compare


def verdict(spark, gold, pred, gold_type, pred_type=None, loose=False):
    g = spark.createDataFrame(gold, gold_type)
    p = spark.createDataFrame(pred, pred_type or gold_type)
    return compare.multiset_diff(g, p, loose).first()["verdict"]


PAIRS = "a string, b int"


def rows(n, seed):
    rng = random.Random(seed)
    return [(rng.choice(["north", "south", None]), rng.choice([rng.randint(-9, 9), None])) for _ in range(n)]


@pytest.mark.parametrize("seed", range(3))
def test_any_order_matches_and_any_change_does_not(spark, seed):
    gold = rows(30, seed)
    other = random.Random(seed + 50).sample(gold, len(gold))
    assert verdict(spark, gold, other, PAIRS) == "match"
    for changed in (other[1:], other + other[:1], other[1:] + [("west", 1)]):
        assert verdict(spark, gold, changed, PAIRS) == "mismatch"


@pytest.mark.parametrize("power", [53, 55, 60])
@pytest.mark.parametrize("side", [-1, 1])
def test_long_ids_keep_every_digit(spark, power, side):
    at = 2**power + 6
    assert verdict(spark, [(at,)], [(at,)], "v long") == "match"
    assert verdict(spark, [(at,)], [(at + side,)], "v long") == "mismatch"


@pytest.mark.parametrize("cents", [5, 1999, -75, 10**9 + 25])
def test_one_number_in_several_types(spark, cents):
    exact, near = Decimal(cents) / 100, cents / 100
    assert verdict(spark, [(exact,)], [(near,)], "v decimal(16,2)", "v double") == "match"
    assert verdict(spark, [(near,)], [(near + 1e-11,)], "v double") == "match"
    assert verdict(spark, [(near,)], [(near + 0.01,)], "v double") == "mismatch"


def test_kinds_stay_apart(spark):
    assert verdict(spark, [(False,)], [(0,)], "v boolean", "v int") == "mismatch"
    assert verdict(spark, [("7",)], [(7,)], "v string", "v int") == "mismatch"
    assert verdict(spark, [(0.0,)], [(-0.0,)], "v double") == "match"
    assert verdict(spark, [(bytearray(b"\x00z"),)], [(bytearray(b"\x00z"),)], "v binary") == "match"
    assert verdict(spark, [], [], "v date") == "both_empty"


def test_column_swap_is_only_a_loose_match(spark):
    gold, pred, kinds = [("a", 1)], [(1, "a")], ("x string, y int", "y int, x string")
    assert verdict(spark, gold, pred, *kinds) == "mismatch"
    assert verdict(spark, gold, pred, *kinds, loose=True) == "match"


def test_order_counts_when_declared(many_tasks):
    g = many_tasks.createDataFrame([("a", 1), ("b", 2)], PAIRS)
    p = many_tasks.createDataFrame([("a", 1), ("b", 2)], PAIRS)
    same = compare.ordered_diff(g, [F.col("b").asc()], p, [F.col("b").asc()]).first()
    other = compare.ordered_diff(g, [F.col("b").asc()], p, [F.col("b").desc()]).first()
    assert (same["verdict"], other["verdict"], other["n_off"]) == ("match", "mismatch", 2)


def test_a_frame_equals_its_shuffle(spark):
    df = spark.range(500).select((F.col("id") % 7).alias("a"), (F.col("id") / 3).alias("b"))
    assert compare.multiset_diff(df, df.repartition(5).orderBy(F.rand(1))).first()["verdict"] == "match"


@pytest.mark.parametrize("value,target,want", [
    (82.0, "≥82%", True), (81.9, "≥82%", False), (5.0, "<10%", True), (90.0, ">=90.5%", False), (50.0, "about 5%", False),
])
def test_targets(spark, value, target, want):
    df = spark.createDataFrame([(value, target)], "v double, t string")
    assert df.select(compare.meets_target(F.col("v"), F.col("t"))).first()[0] is want


def test_rollup_keeps_broken_gold_out(spark):
    rows = [("match", True), ("mismatch", True), ("gold_error", False), ("both_empty", False), ("truncated", False)]
    r = compare.verdict_rollup(spark.createDataFrame(rows, "verdict string, loose_match boolean")).first()
    assert (r["total"], r["scored"], r["exec_accuracy"], r["loose_match"]) == (5, 4, 0.25, 2)


@pytest.mark.parametrize("buckets", [1, 7, 1 << 16])
def test_bucket_hashes_agree_with_counting(spark, buckets):
    chance = random.Random(buckets)
    for _ in range(4):
        gold = [(chance.randint(0, 6), chance.choice("abc")) for _ in range(chance.randint(0, 60))]
        pred = list(gold)
        chance.shuffle(pred)
        for _ in range(chance.choice([0, 1, 3])):
            pred = pred[1:] if chance.random() < 0.5 else [*pred, (chance.randint(0, 9), "z")]
        frames = [spark.createDataFrame(rows, "a int, b string") for rows in (gold, pred)]
        want, got = Counter(gold), Counter(pred)
        r = compare.multiset_diff(*frames, buckets=buckets).first()
        assert (r["n_gold"], r["n_pred"], r["missing"], r["surplus"]) == (len(gold), len(pred), (want - got).total(), (got - want).total())


def test_equal_tables_are_read_once(spark):
    gold = spark.range(1000).select("id", (F.col("id") % 7).alias("k"))
    same = compare.multiset_diff(gold, gold.orderBy(F.desc("id")))
    assert tuple(same.first()) == (1000, 1000, 0, 0, "match")
    same.collect()
    plan = same._jdf.queryExecution().executedPlan().toString()
    assert "LocalTableScan <empty>" in plan or "Range (0, 1000" not in plan.split("Initial Plan")[0]
