"""Feeds that come in several files, with rows that are late by less and by more than allowed."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerlight.streaming import feeds

DAY = dt.datetime(2024, 5, 1)
TRACE = "at timestamp, agent string, status string, duration double"


def at(minutes):
    return DAY + dt.timedelta(minutes=minutes)


def works_off(spark, tmp_path, batches, schema, build):
    """Each batch is one run over the same folder, so state and watermark pass from run to run."""
    source = tmp_path / "in"
    source.mkdir()
    like = spark.createDataFrame([], schema)
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
        out = build(feeds.read_feed(spark, like, str(source)))
        feeds.start_append(out, str(tmp_path / "out"), str(tmp_path / "state"), once=True).awaitTermination()
    return spark.read.schema(out.schema).parquet(str(tmp_path / "out"))


@pytest.fixture
def few_states(spark):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", old)


def test_rows_within_the_allowance_count(few_states, tmp_path):
    batches = [
        [(at(5), "a", "failed", 1.0), (at(62), "a", "success", 2.0)],
        [(at(58), "a", "failed", 9.0), (at(64), "b", "success", 3.0)],  # late, yet the first hour is open
        [(at(200), "a", "success", 1.0)],
    ]
    got = works_off(few_states, tmp_path, batches, TRACE, lambda s: feeds.trace_windows(s, "at"))
    rows = {(r["start"], r["agent"]): (r["steps"], r["failed"], r["longest"]) for r in got.collect()}
    assert rows == {(at(0), "a"): (2, 2, 9.0), (at(60), "a"): (1, 0, 2.0), (at(60), "b"): (1, 0, 3.0)}


def test_rows_beyond_the_allowance_change_nothing(few_states, tmp_path):
    batches = [
        [(at(5), "a", "failed", 1.0), (at(200), "a", "success", 2.0)],
        [(at(6), "a", "failed", 50.0), (at(300), "a", "success", 2.0)],  # its hour was closed by the row at 200
        [(at(500), "a", "success", 2.0)],
    ]
    got = works_off(few_states, tmp_path, batches, TRACE, lambda s: feeds.trace_windows(s, "at"))
    rows = {r["start"]: (r["steps"], r["longest"]) for r in got.collect()}
    assert rows[at(0)] == (1, 1.0) and set(rows) == {at(0), at(180), at(300)}


def test_repeats_in_later_files_are_dropped(few_states, tmp_path):
    schema = "at timestamp, k string, n int"
    batches = [[(at(0), "x", 1), (at(1), "y", 2)], [(at(30), "x", 3), (at(31), "z", 4)], [(at(29), "y", 5), (at(60), "w", 6)]]
    got = works_off(few_states, tmp_path, batches, schema, lambda s: feeds.drop_repeats(s, "at", ["k"]))
    assert sorted((r["k"], r["n"]) for r in got.collect()) == [("w", 6), ("x", 1), ("y", 2), ("z", 4)]


def test_alerts_over_several_files(few_states, tmp_path):
    schema = "at timestamp, kind string"
    baseline = few_states.createDataFrame([("out", 2.0), ("in", 50.0)], "kind string, usual double")
    day = 24 * 60
    batches = [[(at(k), "out") for k in range(3)] + [(at(9), "in")], [(at(40), "out")], [(at(3 * day), "out")]]
    got = works_off(few_states, tmp_path, batches, schema, lambda s: feeds.ledger_alerts(s, baseline, "at", "kind", 1.5))
    assert [(r["start"], r["kind"], r["n"], r["multiple"]) for r in got.select("start", "kind", "n", F.col("multiple")).collect()] == [(at(0), "out", 4, 2.0)]
