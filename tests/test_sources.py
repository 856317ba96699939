import json

import pytest
from pyspark.sql import functions as F

from ledgerlight.operators import charts, frames
from ledgerlight.sources import readers, writers
from ledgerlight.streaming import feeds


def test_lines_keep_their_numbers(spark, tmp_path):
    lines = [json.dumps({"k": i}) if i % 3 else "" for i in range(1, 300)] + ["{bad", "[1]", '{"z": 1}']
    (tmp_path / "a.jsonl").write_text("\n".join(lines), encoding="utf-8")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "256")
    try:
        df = readers.read_lines(spark, str(tmp_path / "a.jsonl"))
        out = {r["line_no"]: r for r in readers.parse_lines(df, "line", "k long", ["k"]).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(out) == sum(1 for x in lines if x)
    assert all(r["record"]["k"] == n for n, r in out.items() if n < 300)
    assert [out[n]["reason"] for n in (300, 301, 302)] == ["invalid json line", "not an object", "missing field k"]


@pytest.mark.parametrize("declared,want", [
    ("date", "date"), ("DATETIME", "timestamp"), ("timestamp with time zone", "timestamp"), ("UNSIGNED BIG INT", "bigint"), ("varchar(20)", "string"),
    ("blob", "binary"), ("double precision", "double"), ("DECIMAL(10,2)", "decimal(38,9)"), ("boolean", "boolean"), ("", "string"), (None, "string"), ("POINT", "bigint"),
])
def test_declared_types(spark, declared, want):
    assert readers.concrete_type(declared) == want
    assert spark.createDataFrame([(declared,)], "d string").select(readers.declared_type(F.col("d"))).first()[0] == want


def test_typed_load_counts_failures(spark):
    df = spark.createDataFrame([("1", "2024-01-01"), ("x", "soon"), (None, None)], "a string, b string")
    kinds = {"a": "INT", "b": "DATE"}
    assert {r["column_name"]: r["failures"] for r in readers.cast_failures(df, kinds).collect()} == {"a": 1, "b": 1}
    assert readers.load_typed(df, kinds).dtypes == [("a", "bigint"), ("b", "date")]


def test_cap_reports_more(spark):
    df = spark.range(10)
    assert readers.capped(df, [F.col("id")], 4).agg(F.count("*"), F.bool_and("truncated")).first()[:] == (4, True)
    assert readers.capped(df, [F.col("id")], 10).agg(F.bool_or("truncated")).first()[0] is False


def test_accept_and_reject_cover_the_input(spark):
    df = spark.createDataFrame([(1, None), (2, "bad"), (3, None)], "id long, reason string")
    good, bad = readers.accept_reject(df)
    assert sorted(r["id"] for r in good.collect()) == [1, 3] and [tuple(r) for r in bad.collect()] == [(2, "bad")]


@pytest.mark.parametrize("cap", [0, 1, 20, 100, 500])
def test_cap_at_any_size(many_tasks, cap):
    out = readers.capped(many_tasks.range(100).repartition(8), [F.col("id").asc()], cap).collect()
    assert sorted(r["id"] for r in out) == list(range(min(cap, 100))) and all(r["truncated"] is (cap < 100) for r in out)


def test_empty_result_keeps_columns(spark):
    out = readers.scan_sql(spark, "SELECT id, id * 2 AS twice FROM {x} WHERE id > :n", {"x": spark.range(3)}, n=10)
    assert out.columns == ["id", "twice"] and out.count() == 0


def test_existing_table_is_refused(spark, tmp_path):
    path = str(tmp_path / "t")
    writers.write_new(spark.range(3), path)
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        writers.write_new(spark.range(5), path)
    writers.write_new(spark.range(5), path, drop=True)
    assert spark.read.parquet(path).count() == 5


@pytest.mark.parametrize("n,name,text,want", [(3, "status", "a", "pie"), (9, "order_date", "a", "line"), (9, "label", "a label that is long ", "hbar"), (9, "label", "a", "bar"), (40, "label", "a", "bar")])
def test_chart_choice(spark, n, name, text, want):
    df = spark.range(n).select(F.concat(F.lit(text), F.col("id").cast("string")).alias(name), F.col("id").alias("y"))
    assert charts.chart_type(df, name, "y").first()["chart_type"] == want


def test_histogram_maximum_joins_last_bin(spark):
    df = spark.createDataFrame([(float(i),) for i in range(101)], "x double")
    out = charts.bins(df, "x", 20).orderBy("bin").collect()
    assert [r["n"] for r in out] == [5] * 19 + [6] and out[-1]["right"] == 100.0


def test_stream_closes_windows_and_drops_late_rows(spark, tmp_path):
    src = str(tmp_path / "in")

    def put(rows):
        df = spark.createDataFrame(rows, "at string, agent string, status string, duration double")
        df.withColumn("at", F.col("at").cast("timestamp")).coalesce(1).write.mode("append").parquet(src)

    def run():
        static = spark.read.parquet(src)
        stream = spark.readStream.schema(static.schema).parquet(src)
        q = feeds.start_append(feeds.trace_windows(stream, "at"), str(tmp_path / "out"), str(tmp_path / "state"), once=True)
        q.awaitTermination()
        return {(r["agent"], r["start"].hour): (r["steps"], r["failed"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}

    put([("2024-01-01 10:05:00", "sql", "success", 1.0), ("2024-01-01 10:50:00", "sql", "failed", 2.0), ("2024-01-01 12:30:00", "sql", "success", 1.0)])
    assert run() == {("sql", 10): (2, 1)}
    # The window of 10 o'clock is closed; a row arriving for it now is too late.
    put([("2024-01-01 10:55:00", "sql", "failed", 9.0), ("2024-01-01 15:00:00", "sql", "success", 1.0)])
    assert run() == {("sql", 10): (2, 1), ("sql", 12): (1, 0)}
