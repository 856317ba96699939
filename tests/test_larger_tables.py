"""Queries on tables that differ in kind from the small ones: several files, odd keys, orders without lines."""

import datetime as dt
import random
import shutil
from collections import Counter

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from ledgerlight.llm import packing, queries
from ledgerlight.operators import inverted, passages, relational, retrieval
from ledgerlight.streaming import feeds, runs
from oracle_check import TABLES, compare, connect


@pytest.fixture
def folder(tmp_path):
    """The small tables as copies that a test may replace, each a folder of files."""
    for name in TABLES:
        (tmp_path / f"{name}.parquet").mkdir()
        shutil.copy(f"{entry.SMOKE_FOLDER}/{name}.parquet", tmp_path / f"{name}.parquet" / "a.parquet")
    return tmp_path


def replace(df, folder, name, files=3):
    """Put ``df`` in place of a table, in several files."""
    df.repartition(files).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")


def against_sql(spark, folder, name):
    con = connect(folder)
    for table in TABLES:
        con.execute(f"CREATE OR REPLACE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    return compare(entry.queries()[name](spark, str(folder)), con, entry.oracle_sql()[name])


def test_card_of_a_table_in_several_files(spark, folder):
    docs = spark.read.parquet(f"{entry.SMOKE_FOLDER}/documents.parquet")
    lang = F.when(F.col("doc_id") % 7 == 0, None).when(F.col("doc_id") % 7 == 1, "en-gb").otherwise(F.col("lang"))
    replace(docs.withColumn("lang", lang), folder, "documents")
    assert against_sql(spark, folder, "corpus_card") is None


def test_card_of_an_empty_table(spark, folder):
    replace(spark.read.parquet(f"{entry.SMOKE_FOLDER}/documents.parquet").limit(0), folder, "documents", files=1)
    assert against_sql(spark, folder, "corpus_card") is None


def test_a_customer_whose_orders_have_no_lines_is_no_buyer(spark, folder):
    lines = spark.read.parquet(f"{entry.SMOKE_FOLDER}/lineitem.parquet")
    replace(lines.where("l_orderkey % 5 = 0"), folder, "lineitem")
    assert against_sql(spark, folder, "count_distinct") is None


def test_postings_of_an_entry_lie_in_one_file(spark, tmp_path):
    """So a task that adds up weights holds the entries of its files, not a share of all entries for each token."""
    rows = [(e, e, f"name {e}", f"common words {e % 5} and {e % 7} more", "x") for e in range(400)]
    frame = spark.createDataFrame(rows, "entry long, position long, name string, description string, columns string")
    index = inverted.build(frame, str(tmp_path / "index"), files=6)
    files = index.postings.select("entry", F.input_file_name().alias("file")).distinct()
    assert files.select("file").distinct().count() == 6
    assert files.groupBy("entry").count().where("count > 1").count() == 0


def test_round_trips_of_one_frame_read_the_lines_once(spark):
    plan = entry.queries()["transfer_loop"](spark, entry.SMOKE_FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert plan.split("== Initial Plan ==")[-1].count("FileScan parquet [l_orderkey") == 1


def test_there_and_back_matches_brute_force(spark):
    chance = random.Random(5)
    moves = [(chance.randint(1, 3), chance.choice("ABC"), chance.choice("ABC"), dt.date(2024, 1, 1) + dt.timedelta(chance.randint(0, 90)), 2) for _ in range(400)]
    moves += [(None, "A", "B", dt.date(2024, 1, 1), 1), (None, "B", "A", dt.date(2024, 1, 1), 1), (1, "A", "B", None, 1), (1, None, "B", dt.date(2024, 1, 5), 1)]
    frame = spark.createDataFrame(moves, "k long, a string, z string, d date, q long")
    got = relational.there_and_back(frame, key="k", start="a", end="z", day="d", quantity="q", within=30)
    legs = Counter((k, a, z, d) for k, a, z, d, _ in moves if None not in (k, a, z, d) and a != z)
    want = sorted((k, a, z, d, e, n, 2 * n, m, 2 * m, (e - d).days) for (k, a, z, d), n in legs.items() for (j, b, y, e), m in legs.items()
                  if (j, b, y) == (k, z, a) and 0 <= (e - d).days <= 30)
    assert sorted(map(tuple, got.collect())) == want


def test_open_runs_are_summed_without_python(spark, tmp_path):
    """A state kept by Python rows cost about a millisecond a run."""
    like = spark.createDataFrame([], "r long, at timestamp, agent string, status string, duration double, calls long")
    (tmp_path / "in").mkdir()
    out = runs.closed_runs(feeds.read_feed(spark, like, str(tmp_path / "in")), ["r"], "at", ["a"], "a", 1, 1)
    plan = out._jdf.queryExecution().logical().toString()
    assert "TransformWithState" not in plan and "Python" not in plan


def test_each_word_is_looked_up_once(monkeypatch):
    class Known(dict):
        def __contains__(self, word):
            raise AssertionError("a look-up beside the one that fetches the ids")

    path = queries.tokenizer_path()
    monkeypatch.setitem(packing._chunks, path, Known())
    texts = [x.encode() for x in ("plain Words, don't I'M PLAIN x1 Été <|endoftext|>", "", "again plain " + "z" * 80)]
    whole = packing._tokenizer(path)
    for _ in range(2):
        want = [packing._packed(whole.encode(t.decode(), add_special_tokens=False).ids) for t in texts]
        assert packing.encode_words(path, texts) == want


def test_an_index_for_known_questions_holds_their_words_only(spark, tmp_path):
    """Every entry is read, other words are not stored, and the rows are those of the whole index."""
    chance = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    rows = [(e, e, f"name {e % 9}", " ".join(chance.choices(words, k=chance.randint(0, 40))), "x") for e in range(300)]
    frame = spark.createDataFrame(rows, "entry long, position long, name string, description string, columns string")
    asked = spark.createDataFrame([(q, " ".join(chance.choices(words[:40], k=6)) + " name") for q in range(20)], "question_id long, text string")
    vocabulary = asked.select(F.explode(F.split("text", " ")).alias("token"))
    part = inverted.build(frame, str(tmp_path / "part"), vocabulary=vocabulary)
    whole = inverted.build(frame, str(tmp_path / "whole"))
    known = {r["token"] for r in vocabulary.collect()}
    assert {r["token"] for r in part.postings.select("token").distinct().collect()} <= known
    assert 2 * part.postings.count() < whole.postings.count()
    only = frame.where("entry % 3 = 0").select("entry")
    for candidates in (None, only):
        got, want = [sorted(map(tuple, inverted.search(i, asked, 4, candidates).collect())) for i in (part, whole)]
        assert got == want and len(got) > 60


def test_questions_meet_common_words_by_masks(spark, tmp_path):
    """An entry gives a row for a 64-bit word of common tokens, not one for each of 256 tokens."""
    rows = [(e, e, "", f"every word here c{e % 40} d{e % 41}", "") for e in range(300)]
    frame = spark.createDataFrame(rows, "entry long, position long, name string, description string, columns string")
    index = inverted.build(frame, str(tmp_path / "index"))
    plan = inverted.search(index, spark.createDataFrame([(1, "every word d7")], "question_id long, text string"), 3)._jdf.queryExecution().toString()
    assert "getbit" not in plan and "bit_get" not in plan


def test_windows_of_passages_are_rows_of_the_scan(spark):
    """No function runs for each word of a text, and the anchor is the longest pair of words that fewest passages share."""
    docs = spark.createDataFrame([(1, "x of the extraordinary circumstances of the y"), (2, "of the of the"), (3, None)], "entry long, text string")
    asked = spark.createDataFrame([(1, "x of the extraordinary circumstances of the y"), (2, "a of the b")], "question_id long, passage string")
    found = passages.passages_in(docs, asked)
    assert [tuple(r) for r in found.collect()] == [(1, 1)]
    marks = passages._windows(docs.select("entry", "text"), "text", True, 2, 9)
    assert "transform(" not in marks._jdf.queryExecution().toString() and marks.where("entry = 2").count() == 3
    wanted = asked.select("passage", F.lit("of the extraordinary circumstances of the").alias("part")).limit(1)
    assert passages._anchors(wanted, True, 2).first()["mark"] == spark.range(1).select(F.xxhash64(F.lit("extraordinary"), F.lit("circumstances"))).first()[0]


def test_links_are_not_shuffled_to_few_hits(spark):
    edges = spark.createDataFrame([(e, e // 2) for e in range(2, 500)], "entry long, reference long")
    hits = spark.createDataFrame([(1, 7), (1, 7), (2, 400)], "question_id long, entry long")
    known = spark.createDataFrame([(e,) for e in [*range(300), 7, 3]], "entry long")
    out = retrieval.fk_expand(hits, edges, within=known)
    assert sorted(map(tuple, out.collect())) == [(1, 3), (1, 7), (1, 14), (1, 15), (2, 200)]
    assert "SortMergeJoin" not in out._jdf.queryExecution().executedPlan().toString()


def test_causes_of_few_misses_do_not_shuffle_the_catalogue(spark):
    names = spark.range(400).select(F.concat(F.lit("doc_"), "id").alias("entry"))
    gold = spark.createDataFrame([(1, "doc_1"), (1, "DOC_2"), (1, "doc_3"), (2, "doc_9999"), (2, "doc_4"), (2, "doc_5")], "question_id long, entry string")
    got = spark.createDataFrame([(2, "doc_4")], "question_id long, entry string")
    out = retrieval.miss_causes(gold, got, names, names.where("entry != 'doc_3'"))
    assert sorted(map(tuple, out.collect())) == [(1, "DOC_2", "case_mismatch"), (1, "doc_1", "other"), (1, "doc_3", "not_permitted"), (2, "doc_5", "other"), (2, "doc_9999", "other")]
    # each pass over the names meets the few asked ones before it is grouped
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join LeftSemi") == 3
