import hashlib
import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from ledgerlight.functions import tokens
from ledgerlight.operators import inverted, passages, quality, retrieval


def test_folding(spark):
    df = spark.createDataFrame([("Bảng lương nhân_viên Đơn base_salary2",)], "t string")
    assert sorted(df.select(tokens(F.col("t"))).first()[0]) == ["bang", "base", "don", "luong", "nhan", "salary2", "vien"]


def test_every_latin_letter_with_marks_folds(spark):
    points = [c for c in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)) if "a" <= unicodedata.normalize("NFD", chr(c).lower())[0] <= "z"]
    letters = [chr(c) for c in points if len(unicodedata.normalize("NFD", chr(c))) > 1]
    rows = [(f"x{form(c)}y", f"x{unicodedata.normalize('NFD', c.lower())[0]}y") for c in letters for form in (lambda c: c, lambda c: unicodedata.normalize("NFD", c))]
    df = spark.createDataFrame(rows, "t string, w string")
    wrong = [(r["t"], r["f"]) for r in df.select("t", "w", F.array_join(tokens(F.col("t")), " ").alias("f")).collect() if r["f"] != r["w"]]
    assert len(letters) > 300 and not wrong
    text = spark.createDataFrame([("Dvořák Ťažký țară ľudia",)], "t string")
    assert sorted(text.select(tokens(F.col("t"))).first()[0]) == ["dvorak", "ludia", "tara", "tazky"]


@pytest.fixture
def catalogue(spark):
    rows = [("orders", 0, "orders", "sales of goods", "id amount region"), ("customers", 1, "customers", "people who buy goods", "id name segment"),
            ("payroll", 2, "payroll", "salary paid", "id base_salary month")]
    return spark.createDataFrame(rows, "entry string, position long, name string, description string, columns string")


@pytest.fixture
def asked(spark):
    return spark.createDataFrame([(1, "orders of customers"), (2, "goods by segment"), (3, "zzz"), (4, "")], "question_id long, text string")


@pytest.mark.parametrize("options", [{}, {"files": 1}, {"files": 5, "probes": 1}])
def test_weights_and_ties_in_any_blocks(catalogue, asked, options):
    out = retrieval.lexical_topk(asked, catalogue, 2, **options).orderBy("question_id", "place").collect()
    assert [(r["question_id"], r["entry"], r["score"], r["place"]) for r in out] == [
        (1, "orders", 5.0, 1), (1, "customers", 3.0, 2), (2, "customers", 3.0, 1), (2, "orders", 2.0, 2)]


def test_candidates_restrict_before_ranking(spark, catalogue, asked):
    only = spark.createDataFrame([("customers",)], "entry string")
    out = retrieval.lexical_topk(asked, catalogue, 1, candidates=only).collect()
    assert {(r["question_id"], r["entry"]) for r in out} == {(1, "customers"), (2, "customers")}


def test_one_hop_both_directions(spark):
    edges = spark.createDataFrame([("orders", "customers"), ("orders", "products"), ("items", "orders"), ("far", "items")], "entry string, reference string")
    hits = spark.createDataFrame([(1, "orders"), (2, "customers")], "question_id long, entry string")
    out = {(r[0], r[1]) for r in retrieval.fk_expand(hits, edges).collect()}
    assert out == {(1, "orders"), (1, "customers"), (1, "products"), (1, "items"), (2, "customers"), (2, "orders")}


def test_recall_needs_all_gold(spark):
    gold = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "question_id long, entry string")
    got = spark.createDataFrame([(1, "a"), (2, "a"), (2, "c"), (3, "a")], "question_id long, entry string")
    r = retrieval.full_cover_recall(gold, got).first()
    assert (r["total"], r["full_hits"], r["recall"], r["mean_context"]) == (2, 1, 0.5, 1.5)


PASSAGES = ["gamma", "beta gamma", "beta gamma delta", "alpha beta gamma delta", "a b c d e", "a b c d e f", "mma de", "", None, "nowhere", "É.\nx", "gamma"]
TEXTS = ["alpha beta gamma delta", "xbeta gamma deltax", "0 a b c d e f 1", "", None, "É.\nx É.\nx"]


def plain_topk(asked, rows, k):
    weights = {"name": 3.0, "description": 2.0, "columns": 1.0}
    out = []
    for question, text in asked:
        words = set((text or "").split())
        scores = []
        for entry, position, *parts in rows:
            score = sum(x * len(words & set((p or "").split())) for x, p in zip(weights.values(), parts))
            if score > 0:
                scores.append((-score, position, entry))
        out += [(question, entry, -score, place) for place, (score, _, entry) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("k,probes,words", [(1, 1, 4), (3, 1, 1), (8, 4, 4)])
def test_search_gives_the_rows_of_plain_scoring(spark, tmp_path, monkeypatch, k, probes, words):
    monkeypatch.setattr(inverted, "WORDS", words)
    monkeypatch.setattr(inverted, "BITS", 6 if words == 1 else 64 * words)
    chance = random.Random(k)
    common, rare = [f"c{i}" for i in range(12)], [f"r{i}" for i in range(300)]

    def text(n):
        return " ".join(chance.choice(common if chance.random() < 0.8 else rare) for _ in range(n))

    rows = [(e, 1000 - e, text(2), text(chance.randint(0, 25)) or None, None if e % 7 == 0 else text(3)) for e in range(250)]
    asked = [(q, text(chance.randint(1, 30))) for q in range(40)] + [(90, "absent words"), (91, ""), (92, None)]
    frame = spark.createDataFrame(rows, "entry long, position long, name string, description string, columns string")
    index = inverted.build(frame, str(tmp_path / "index"), files=40)
    questions = spark.createDataFrame(asked, "question_id long, text string")
    got = inverted.search(index, questions, k, probes=probes)
    assert sorted(map(tuple, got.collect())) == plain_topk(asked, rows, k)
    plan = got._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Nested" not in plan and "Cartesian" not in plan
    allowed = [r for r in rows if r[0] % 3 == 0]
    only = spark.createDataFrame([(r[0],) for r in allowed], "entry long")
    assert sorted(map(tuple, inverted.search(index, questions, k, only, probes).collect())) == plain_topk(asked, allowed, k)
    # a common word is dealt over several files
    places = index.postings.where("token = 'c1'").select(F.input_file_name().alias("f")).distinct().count()
    assert places > 1 or index.postings.where("token = 'c1'").count() < 100


def test_an_index_of_nothing(spark, tmp_path):
    empty = spark.createDataFrame([], "entry long, position long, name string, description string, columns string")
    index = inverted.build(empty, str(tmp_path / "index"))
    assert inverted.search(index, spark.createDataFrame([(1, "a b")], "question_id long, text string")).count() == 0


def test_floor_leaves_out_common_words(spark, tmp_path):
    """With one good entry for a question, the words that all entries hold are not read."""
    rows = [(e, e, "", "every word here", "") for e in range(300)] + [(999, 999, "rare thing", "every word here rare thing", "")]
    frame = spark.createDataFrame(rows, "entry long, position long, name string, description string, columns string")
    index = inverted.build(frame, str(tmp_path / "index"))
    seen = []
    real = inverted._met
    inverted._met = lambda asked, *rest: seen.append(asked) or real(asked, *rest)
    try:
        got = inverted.search(index, spark.createDataFrame([(1, "every rare thing")], "question_id long, text string"), 1).collect()
    finally:
        inverted._met = real
    assert [(r["entry"], r["score"]) for r in got] == [(999, 12.0)]
    assert "every" not in {r["token"] for r in seen[1].collect()}


PASSAGES = ["gamma", "beta gamma", "beta gamma delta", "alpha beta gamma delta", "a b c d e", "a b c d e f", "mma de", "", None, "nowhere", "É.\nx", "gamma", "\U0001f600", "x"]
TEXTS = ["alpha beta gamma delta", "xbeta gamma deltax", "0 a b c d e f 1", "", None, "É.\nx É.\nx", "a\U0001f600b", "alpha beta gamma delta"]


def held(texts, asked):
    return sorted((q, e) for q, p in asked for e, t in texts if p and t is not None and p in t)


@pytest.mark.parametrize("piece", [65_536, 5, 1])
def test_passages_of_any_length_are_found(spark, piece):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "entry long, text string")
    asked = spark.createDataFrame(list(enumerate(PASSAGES)), "question_id long, passage string")
    got = passages.passages_in(docs, asked, piece)
    assert sorted(map(tuple, got.collect())) == held(list(enumerate(TEXTS)), list(enumerate(PASSAGES)))
    plan = got._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
    assert [tuple(r) for r in passages.everywhere(docs, asked).collect()] == [(7, 7)]
    assert passages.passages_in(docs, asked.where("passage = ''")).count() == 0
    assert passages.passages_in(docs.limit(0), asked).count() == 0


def test_passages_from_one_to_ten_thousand_characters(spark):
    chance = random.Random(2)
    long = "".join(chance.choice("ab é.\n") for _ in range(60_000))
    texts = [(e, long[chance.randint(0, 40_000) :][: chance.randint(1, 30_000)]) for e in range(12)]
    asked = []
    for q, size in enumerate([1, 2, 3, 5, 8, 31, 32, 33, 64, 65, 100, 1_000, 9_999, 10_000] * 3):
        source = chance.choice(texts)[1]
        at = chance.randint(0, max(0, len(source) - size))
        asked.append((q, source[at : at + size] + ("#" if q % 5 == 0 else "")))
    docs = spark.createDataFrame(texts, "entry long, text string")
    got = passages.passages_in(docs, spark.createDataFrame(asked, "question_id long, passage string"))
    assert sorted(map(tuple, got.collect())) == held(texts, asked)


def test_expansion_stays_within_the_catalogue(spark):
    edges = spark.createDataFrame([("a", "b"), ("a", "gone"), ("c", "a")], "entry string, reference string")
    hits = spark.createDataFrame([(1, "a"), (2, "gone")], "question_id long, entry string")
    known = spark.createDataFrame([("a",), ("b",), ("c",)], "entry string")
    assert {tuple(r) for r in retrieval.fk_expand(hits, edges, within=known).collect()} == {(1, "a"), (1, "b"), (1, "c"), (2, "a")}


@pytest.mark.parametrize("name,want", [("A2", True), ("col3", True), ("f1", True), ("B365D", True), ("CPK", True), ("x", True), ("name", False), ("cust_id", False), ("year2", False), ("", False)])
def test_opaque(spark, name, want):
    assert spark.createDataFrame([(name,)], "n string").select(quality.is_opaque(F.col("n"))).first()[0] is want


def test_foreign_script_lowers_confidence(spark):
    df = spark.createDataFrame([("amount", "売上", "high"), ("amount", "revenue", "high"), ("amount", "revenue", "sure"), ("amount", None, "low")], "n string, t string, c string")
    assert [r[0] for r in df.select(quality.settled_confidence(F.col("n"), F.col("t"), F.col("c"))).collect()] == ["low", "high", "low", "low"]


COLS = "table_name string, column_name string, data_type string, is_generated boolean, is_key boolean, reference string"


def test_fingerprint_ignores_order_and_sees_changes(spark):
    rows = [("o", "id", "int", False, True, None), ("o", "cid", "int", False, False, "c"), ("c", "id", "int", False, True, None)]

    def of(rs):
        return quality.catalogue_fingerprint(spark.createDataFrame([("db", *r) for r in rs], "db string, " + COLS), "db").first()["fingerprint"]

    base = of(rows)
    assert base == of(rows[::-1]) and len(base) == 16
    assert base != of([(*rows[0][:3], True, True, None), *rows[1:]]) and base != of([rows[0], (*rows[1][:5], None), rows[2]])


def test_catalogue_fingerprint_streams_its_lines(spark, monkeypatch, many_tasks):
    monkeypatch.setattr(quality, "CHUNK", 100)
    rows = [(d, f"t{k}é", "id", "int", False, True, None) for d, n in [("a", 1), ("b", 500), (None, 40)] for k in range(n)]
    frame = spark.createDataFrame(rows, "db string, " + COLS).repartition(5)
    out = quality.catalogue_fingerprint(frame, "db")
    got = {r["db"]: r["fingerprint"] for r in out.collect()}
    want = {}
    for d in ("a", "b", None):
        lines = sorted((r[1].encode(), f"{r[1]}|id:int:False|id|".encode()) for r in rows if r[0] == d)
        want[d] = hashlib.sha256(b"\n".join(line for _, line in lines)).hexdigest()[:16]
    assert got == want
    # lists hold the columns of a table, never the tables of a database
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list(struct(table_name" not in plan
    assert quality.catalogue_fingerprint(frame.limit(0), "db").count() == 0


def test_fk_targets(spark):
    cols = spark.createDataFrame([("c", "id"), ("c", "name"), ("c", "Code"), ("c", "CODE"), ("o", "cid")], "table_name string, column_name string")
    keys = spark.createDataFrame([("c", "id")], "table_name string, column_name string")
    links = spark.createDataFrame([("o", "cid", p, q) for p, q in [("C", "ID"), ("c", "name"), ("c", "code"), ("c", "zip"), ("x", "id")]],
                                  "child_table string, child_column string, parent_table string, parent_column string")
    got = {(r["parent_table"], r["parent_column"]): (r["kept"], r["reason"]) for r in quality.fk_targets(links, cols, keys).collect()}
    assert got == {("C", "ID"): (True, None), ("c", "name"): (False, "target not unique"), ("c", "code"): (False, "ambiguous column"),
                   ("c", "zip"): (False, "no such column"), ("x", "id"): (False, "no such table")}


def test_merge_guard_refuses_large_losses(spark):
    note = "table_name string, column_name string, text string, reviewed_by string"
    old = spark.createDataFrame([("a", None, "x", "human"), ("b", None, "y", "human"), ("b", "k", "z", "human"), ("a", "m", "w", "model")], note)
    fresh = spark.createDataFrame([("a", None, "new", "model")], note)
    merged = quality.merge_entries(old, fresh)
    assert [tuple(r) for r in merged.collect()] == [("a", None, "x", "human", "existing")]
    g = quality.merge_guard(old, merged).first()
    assert (g["reviewed"], g["lost"], g["refuse"]) == (3, 2, True)


def test_enum_discovery_skips_keys(spark):
    df = spark.range(5000).select(F.col("id").cast("string").alias("k"), (F.col("id") % 3).cast("string").alias("e"))
    assert [(r["column_name"], r["enum_values"]) for r in quality.enum_values(df, ["k", "e"], "t").collect()] == [("e", "0|1|2")]


def test_grants(spark):
    cat = spark.createDataFrame([("a",), ("b",)], "entry string")
    users = spark.createDataFrame([(1,), (2,), (3,)], "user_id long")
    grants = spark.createDataFrame([(1, "*"), (2, "a"), (2, "gone")], "user_id long, entry string")
    got = {r["user_id"]: (r["scope"], r["n_tables"]) for r in retrieval.grant_scope(users, grants, cat).collect()}
    assert got == {1: ("all", 2), 2: ("listed", 1), 3: ("none", 0)}
    asked = users.select("user_id", F.explode(F.array(F.lit("a"), F.lit("b"), F.lit("gone"))).alias("entry"))
    assert sorted((r["user_id"], r["entry"]) for r in retrieval.permitted(asked, grants, cat).collect()) == [(1, "a"), (1, "b"), (2, "a")]
