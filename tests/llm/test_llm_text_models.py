"""Quality vectors, isolation rules, extraction and the language model against plain versions."""

import collections
import math
import re
import zlib

import numpy as np
import pytest

from ledgerlight.llm import bloom_lm, crf_extract, isolation_rules, quality_svm

WORD = re.compile(r"[^\x20\x09-\x0D]+")
GOOD = ["the river ran by the old mill and on to the sea", "a small house stood near the wood", "we went home in the rain"]
BAD = ["the### mill%%% and$$$ river***", "buy buy buy buy now now now now", "WIN!! BIG!! PRIZE!! NOW!!"]


def labelled(spark, times=40):
    rows = [(f"{t} {k}", 1) for k in range(times) for t in GOOD] + [(f"{t} x{k}", 0) for k in range(times) for t in BAD]
    return spark.createDataFrame(rows, "text string, quality int")


@pytest.fixture(scope="module")
def model(spark):
    return quality_svm.fit(labelled(spark), fit_rows=200)


def test_quality_tells_new_texts_apart(spark, model):
    docs = spark.createDataFrame([(1, "the old river ran near the house", 0.0), (2, "rain$$$ wood### house%%%", 0.0)], "doc_id long, text string, score double")
    got = {r["doc_id"]: r["score_"] for r in quality_svm.scores(docs, model).collect()}
    assert got[1] > 0.5 > got[2]


def test_quality_edge_rows(spark, model):
    rows = [(1, None), (2, ""), (3, " "), (4, "word " * 60_000), (5, "the mill"), (5, "the mill"), (None, "the mill")]
    got = quality_svm.scores(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()
    scores = [r["score"] for r in got]
    assert len(scores) == 7 and all(0 <= s <= 1 for s in scores)
    assert scores[0] == scores[1] and scores[4] == scores[5] == scores[6]
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert quality_svm.scores(empty, model).count() == 0


@pytest.mark.parametrize("rows", [[], [("only good", 1)], [("a", None), ("b", 7)]])
def test_quality_without_both_classes(spark, rows):
    model = quality_svm.fit(spark.createDataFrame(rows, "text string, quality int"))
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    first, second = [r["score"] for r in quality_svm.scores(docs, model).collect()]
    assert first == second and 0 <= first <= 1


def test_log_count_ratios_count_every_row(spark):
    got = quality_svm.log_count_ratios(labelled(spark, 5).repartition(7), "text", "quality")
    counts = np.ones((2, quality_svm.DIM))
    for text, y in labelled(spark, 5).collect():
        counts[y][quality_svm.indicators(text.encode())] += 1
    want = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    assert np.allclose(got, want)


def test_descent_reaches_the_dual_optimum():
    rng = np.random.default_rng(1)
    rows = [np.sort(rng.choice(30, 6, replace=False)) for _ in range(60)]
    y = rng.integers(0, 2, 60).astype(float)
    ratio = rng.normal(size=30)
    w, bias = quality_svm.descend(rows, y, ratio, cost=1.0, epochs=3_000)
    x = np.zeros((60, 31))
    for k, idx in enumerate(rows):
        norm = np.sqrt(ratio[idx] @ ratio[idx] + 1)
        x[k, idx], x[k, 30] = ratio[idx] / norm, 1 / norm
    limit = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    s = 2 * y - 1

    def primal(v):
        return v @ v / 2 + (limit * np.maximum(0, 1 - s * (x @ v))).sum()

    best = primal(np.append(w, bias))
    for _ in range(300):
        assert primal(np.append(w, bias) + rng.normal(scale=0.05, size=31)) >= best - 1e-4


def plain_counts(text):
    words = WORD.findall(text or "")
    windows = collections.Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
    inside = {j for k in range(len(words) - 4) if windows[tuple(words[k : k + 5])] > 1 for j in range(k, k + 5)}
    lines, again = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            again += line in lines
            lines.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), again, len(inside)


TEXTS = [
    None, "", " \t\n", "a", "a b c d e f", "a b c d e a b c d e", "x\nx\nx \n\n\n x", "é ü# %% z\u0085y", "w " * 50,
    "a b a b a b a b a b a b", "q\rw\x0be\x0cr\x1ct | < >",
]


@pytest.mark.parametrize("text", TEXTS)
def test_rule_counts(text):
    assert isolation_rules.rule_counts(text)[:5] == plain_counts(text)


def test_judge_keeps_good_and_drops_odd(spark):
    clean = [(k, " ".join(f"word{(k * 7 + j * j) % 997}" for j in range(40)), "x") for k in range(300)]
    odd = [(1000 + k, " ".join(f"w{k}{j}###" for j in range(40)), "x") for k in range(12)]
    rest = [(2000, None, "x"), (2001, "few words", "x"), (0, clean[0][1], "x"), (None, clean[1][1], "x"), (2002, "same " * 99, "x")]
    docs = spark.createDataFrame(clean + odd + rest, "doc_id long, text string, kept string")
    labels = spark.createDataFrame([(k, 1) for k in range(300)] + [(1000 + k, 0) for k in range(6)] + [(5, None)], "doc_id long, quality int")
    got = isolation_rules.judge(docs, labels).collect()
    assert len(got) == len(clean) + len(odd) + len(rest)
    kept = collections.defaultdict(set)
    for r in got:
        kept[r["doc_id"]].add(r["kept"])
    assert all(kept[k] == {True} for k in range(300)) and not any(True in kept[1000 + k] for k in range(12))
    assert kept[2000] == kept[2001] == kept[2002] == {False} and kept[None] == {True}
    assert isolation_rules.judge(docs.limit(0), labels).count() == 0
    assert isolation_rules.judge(docs, labels.limit(0)).where("kept").count() == 300 + 12 + 2


@pytest.mark.parametrize("wanted", [7, 60, 700, 5_000])
def test_sample_of_the_forest_against_a_sort_of_all_rows(many_tasks, wanted):
    rows = [(k % 1_200, k % 17 + 1, *[k % (3 + j) for j in range(7)]) for k in range(1_500)] + [(9_999, 5, *[1] * 7)] * 800
    names = [n for n in (*isolation_rules.COUNTS, *isolation_rules.EXTRA)]
    counts = many_tasks.createDataFrame(rows, "doc_id long, " + ", ".join(f"{n} long" for n in names)).repartition(16)
    full = isolation_rules.with_features(counts)
    from pyspark.sql import functions as F

    every = full.select(F.xxhash64("doc_id", *names).alias("h"), *isolation_rules.FEATURES).collect()
    want = np.array([r[1:] for r in sorted(map(tuple, every))][:wanted])
    assert np.array_equal(isolation_rules.smallest(full, wanted), want)
    assert isolation_rules.smallest(full.limit(0), wanted).shape == (0, len(isolation_rules.FEATURES))


def test_forest_scores_follow_path_lengths():
    x = np.random.default_rng(0).uniform(0.4, 0.6, size=(400, 7))
    forest = isolation_rules.grow([x[k::4] for k in range(4)] * 5, np.zeros(7), np.ones(7))
    odd = np.full((1, 7), 0.5)
    odd[0, 3] = 0.97
    scores = forest.scores(np.concatenate([x, odd]))
    assert scores[400] > np.quantile(scores[:400], 0.99)

    def path(tree, row):
        node = depth = 0
        while forest.feature[tree, node] >= 0:
            node = forest.child[tree, node] + (row[forest.feature[tree, node]] >= forest.value[tree, node])
            depth += 1
        return forest.length[tree, node], depth

    for row, got in zip(x[:20], scores):
        lengths = [path(t, row)[0] for t in range(len(forest.feature))]
        assert got == pytest.approx(2 ** (-np.mean(lengths) / forest.expected))


FIELD = crf_extract.fit()


def test_crf_on_unseen_layouts():
    field = FIELD
    right = total = 0
    for page, labels in crf_extract.labelled_pages(80, seed=77):
        got = crf_extract.decode(field, crf_extract.featured(crf_extract.leaves(page)))
        right += sum(a == b for a, b in zip(got, labels))
        total += len(labels)
    assert right / total > 0.98


LONG = "The river ran past the mill, and the people of the town walked along its banks every evening to talk."
LAYOUTS = [
    (f"<h1>@Title</h1><p>@{LONG}</p><p>@{LONG}</p><p>@Short one.</p>"),
    (f"<div><div><a href=a>Home</a> <a href=b>News</a></div><div><h1>@Title</h1><div>@{LONG}</div><div>@{LONG}</div></div><div>© 2024</div></div>"),
    (f"<div id='cookie-banner'>We use cookies. <button>OK</button></div><header class='site'><h1>Daily</h1><nav><a>Home</a></nav></header><main><article>"
     f"<header><h1>@Title</h1></header><p>@{LONG}</p><aside class='related'><ul><li><a>Other story</a></li></ul></aside><p>@{LONG}</p></article><section id='comments'>"
     f"<div class='comment'><p>{LONG}</p></div></section></main><aside class='sidebar'><p>{LONG}</p></aside><footer><p>{LONG}</p></footer>"),
    (f"<nav><ul><li><a>x</a></ul></nav><div class='notice'>{LONG}</div><article><h1>@T</h1><p>@{LONG}<p>@{LONG}<div class='ad'>{LONG}</div><p>@{LONG}</article>"
     f"<div class='comments'><article class='comment'>{LONG}</article></div><form><p>{LONG}</p></form><footer>{LONG}</footer>"),
]


@pytest.mark.parametrize("layout", LAYOUTS)
def test_crf_on_written_pages(layout):
    want = [x.text.startswith("@") for x in crf_extract.leaves(layout)]
    found = crf_extract.leaves(layout.replace("@", ""))
    assert crf_extract.decode(FIELD, crf_extract.featured(found)) == [int(w) for w in want]


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(4)
    field = crf_extract.Field(rng.normal(size=(len(crf_extract.NAMES), 2)), rng.normal(size=(2, 2)))
    for n in range(1, 8):
        features = [rng.choice(len(crf_extract.NAMES), 4, replace=False).tolist() for _ in range(n)]

        def value(path):
            own = sum(field.state[i, y] for idx, y in zip(features, path) for i in idx)
            return own + sum(field.step[a, b] for a, b in zip(path, path[1:]))

        paths = [[(k >> j) & 1 for j in range(n)] for k in range(1 << n)]
        assert value(crf_extract.decode(field, features)) == pytest.approx(max(map(value, paths)))


def test_crf_gradient_learns_the_chain():
    pages = [([[0], [1], [1]], [0, 1, 1]), ([[1], [0]], [1, 0])] * 5
    field = crf_extract.train(pages, rounds=100)
    assert crf_extract.decode(field, [[1], [0], [1]]) == [1, 0, 1] and crf_extract.decode(field, []) == []


PAGE = (
    "<html><head><title>T</title><script>if (a</b>) x='<p>no</p>'</script></head><body><nav><ul><li><a href=x>Home</a><li>"
    "<a href=y>More</a></ul></nav><div class='cookie-notice'>We use cookies.</div><article><h1>A &amp; B</h1>"
    "<p>First  line\n here, with <b>bold</b> text and more words to read.<br>second<p>Caf&eacute; &#x41;&nbsp;is open today, come in."
    "</article><section class=comments><p>I liked this article a lot, thank you for it.</p></section>"
    "<form><label>Mail</label><input></form><footer>&copy; us</footer>"
)


def test_extract(spark):
    rows = [(1, "u", PAGE, 5), (2, None, None, 5), (3, "u", "", 5), (1, "u", PAGE, 5), (4, "u", "<", 5), (5, "u", "<div " + "a" * 100_000, 5)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, TEXT int")
    got = crf_extract.extract(pages, FIELD)
    assert got.columns == ["page_id", "url", "text"]
    want = "A & B First line here, with bold text and more words to read. second Café A is open today, come in."
    texts = collections.defaultdict(list)
    for r in got.collect():
        texts[r["page_id"]].append(r["text"])
    assert texts[1] == [want, want] and texts[2] == texts[3] == [""] and len(texts) == 5
    assert crf_extract.extract(pages.limit(0), FIELD).count() == 0


@pytest.mark.parametrize("start", ["<body>", "", "<div>", "<p>", "<span>", "<img src=a>", "<svg></svg>", "<body><head>"])
def test_a_head_without_its_end_tag_hides_no_text(start):
    page = f"<!doctype html><html><head><title>No text</title><meta charset=utf-8><style>p {{}}</style>\n{start}First words here.<p>More words.</p>"
    assert [x.text for x in crf_extract.leaves(page)] == ["First words here.", "More words."]
    late = page.replace("More", "</head>More")
    assert [x.text for x in crf_extract.leaves(late)][-1] == "More words."


@pytest.mark.parametrize("part", ["<template><p>no</p></template>", "<script>'<p>no'</script>", "<noframes><p>no</p></noframes>", " \n "])
def test_parts_of_a_head_stay_hidden(part):
    page = f"<head>{part}<title>no</title></head><body><p>Words.</p>"
    assert [x.text for x in crf_extract.leaves(page)] == ["Words."]


def test_language_model_base_score_is_exact(spark, monkeypatch):
    monkeypatch.setattr(bloom_lm, "FREQUENT", 3)
    rows = [(k, f"the cat sat on mat {k % 5} The Ünder dog{k}") for k in range(40)] + [(50, None), (51, ""), (None, "the cat"), (3, "again the")]
    docs = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, score double")
    from pyspark.sql import functions as F

    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 == 2
    got = bloom_lm.score(docs, ~held).collect()
    tokens = lambda t: [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall(t or "")] + ["\n"]
    train = [t for i, t in rows if zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2]
    counts = collections.Counter(w for t in train for w in tokens(t))
    total, distinct = sum(counts.values()), len(counts)
    want = collections.Counter()
    for i, t in rows:
        ws = tokens(t)
        base = sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in ws)
        want[i, len(ws), sum(counts[w] > 0 for w in ws), total, round(base, 8)] += 1
    seen = collections.Counter((r[0], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 8)) for r in got)
    assert seen == want and all(r["score"] < 0 for r in got)


@pytest.fixture(scope="module", params=[(1.0, 0.05), (2.0, 0.1)], ids=["one_byte_a_bit", "two_bytes_a_bit"])
def model_and_exact(spark, request):
    """Scores by the filter of one size and the error allowed for it, and by a plain model of exact counts, of Zipf texts, a fifth of them held out."""
    from pyspark.sql import functions as F

    rng = np.random.default_rng(3)
    rows = [(k, " ".join(f"w{x}" for x in rng.zipf(1.4, int(rng.integers(0, 120))) % 2_000)) for k in range(1_500)]
    got = {r["doc_id"]: r for r in bloom_lm.score(spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id") % 5 != 0, bytes_a_bit=request.param[0]).collect()}
    words, pairs = collections.Counter(), collections.Counter()
    tokens = {k: ["\n", *WORD.findall(t), "\n"] for k, t in rows}  # the end mark is the first context too
    for k, ts in tokens.items():
        if k % 5:
            words.update(ts[1:])
            pairs.update(zip(ts, ts[1:]))
    total, distinct = sum(words.values()), len(words)
    step = lambda n: bloom_lm.SEEN[np.searchsorted(bloom_lm.SCALE, n, side="right")]

    def plain(ts, seen):
        out = 0.0
        for a, b in zip(ts, ts[1:]):
            single = (seen(words[b]) + 1) / (total + distinct + 1)
            out += math.log10(0.3 * min(1.0, seen(pairs[a, b]) / max(seen(words[a]), 1)) + 0.7 * single if words[a] else single)
        return out / (len(ts) - 1)

    return request.param[1], [(k, got[k]["score"] / got[k]["n_tokens"], plain(ts, float), plain(ts, step)) for k, ts in tokens.items()]


def test_language_model_score_against_exact_counts(model_and_exact):
    """Log10 a token: steps of the scale move a text little, false steps of the filter by its bits a byte."""
    allowed, rows = model_and_exact
    held = np.array([k % 5 == 0 for k, *_ in rows])
    got, exact, steps = np.array([r[1:] for r in rows]).T
    for part in (held, ~held):
        assert np.abs(steps - exact)[part].mean() < 0.03
        assert np.abs(got - steps)[part].mean() < allowed
        assert np.abs(got - exact)[part].mean() < allowed + 0.01 and np.corrcoef(got[part], exact[part])[0, 1] > 0.97


def test_language_model_empty_table(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([], "doc_id long, text string")
    assert bloom_lm.score(docs, F.lit(True)).count() == 0
    some = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert bloom_lm.score(some, F.lit(False)).first()["n_known"] == 0


def test_filter_counts_never_fall_short(spark):
    rows = [(1, " ".join(f"w{k % 50}" for k in range(2_000)))] + [(2 + k, f"v{k} v{k} u") for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model, words = bloom_lm.fit(docs)
    table = {r["gram"]: r["n"] for r in words.collect()}
    keys = np.array(list(table), dtype=np.int64).view(np.uint64)
    steps = model.steps(keys)
    exact = np.searchsorted(bloom_lm.SCALE, np.array(list(table.values())), side="right")
    assert (steps >= exact).all() and (steps == exact).mean() > 0.9
    missing = bloom_lm._keyed(bloom_lm.word_hashes([b"none%d" % k for k in range(2_000)]), 0)
    assert (model.steps(missing) == 0).mean() > 0.9


def test_filter_grows_with_the_text():
    for volume in (0, 10**6, 10**9, 2**33, 30 * 10**9, 10**13):
        segments, size = bloom_lm.layout(volume, 2.0)
        assert segments * size >= volume / 2 and size // 8 <= bloom_lm.PART
        assert segments & (segments - 1) == 0 and size & (size - 1) == 0
    keys = bloom_lm.word_hashes([b"w%d" % k for k in range(5_000)])
    found = bloom_lm._segment(keys, 4096)
    assert 0 <= found.min() and 4000 < found.max() < 4096
    assert (bloom_lm._segment(keys, 1024) == found >> 2).all()


@pytest.mark.parametrize("bits", [1 << 24, 1 << 5])  # the usual number of segments, and more of them
def test_parts_of_the_filter_give_the_same_scores(spark, monkeypatch, bits):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(7)
    rows = [(k, " ".join(f"w{x}" for x in rng.zipf(1.3, int(rng.integers(1, 60))) % 3_000)) for k in range(2_000)]
    docs = spark.createDataFrame([*rows, (9_000, None), (9_001, "")], "doc_id long, text string").repartition(3)
    held = F.col("doc_id") % 5 == 0
    monkeypatch.setattr(bloom_lm, "SEGMENT_BITS", bits)
    want = {r["doc_id"]: tuple(r) for r in bloom_lm.score(docs, ~held).collect()}
    monkeypatch.setattr(bloom_lm, "PART", 1_000)
    monkeypatch.setattr(bloom_lm, "PROBED", 3_000)
    model, _ = bloom_lm.fit(docs.where(~held))
    parts = model.parts
    assert len(parts.values) > 4 and all(v.value.nbytes <= 1_000 for v in parts.values)
    assert parts.segments * parts.size >= sum(len(t) for k, t in rows if k % 5) / 2
    got = {r["doc_id"]: tuple(r) for r in bloom_lm.score(docs, ~held).collect()}
    assert got.keys() == want.keys()
    for k, row in got.items():
        assert row == pytest.approx(want[k])


def test_pages_of_unclosed_tags_take_time_in_proportion():
    import time

    start = time.perf_counter()
    for unit, n in (("<font><p>x</p>", 70_000), ("<div>x", 100_000), ("<b><li>x", 60_000)):
        found = crf_extract.leaves(unit * n)
        assert len(found) == n and {leaf.text for leaf in found} == {"x"}
    assert found[-1].above.parent == "li"
    assert time.perf_counter() - start < 30


def test_extraction_keeps_columns_with_clashing_names(spark):
    pages = spark.createDataFrame([("<p>x</p>", 1, 2)], "html string, _html_ int, Text int")
    got = crf_extract.extract(pages, crf_extract.Field(np.zeros((len(crf_extract.NAMES), 2)), np.zeros((2, 2))))
    assert sorted(got.columns) == ["_html_", "text"] and got.first()["_html_"] == 1


@pytest.mark.parametrize("stage", range(5))
def test_pipeline_stages_take_odd_rows_and_names(spark, tmp_path, stage):
    import corpus_pipeline

    words = " ".join(f"word{k}" for k in range(40))
    rows = [(1, words, "en", "a", 5, 1, 2), (1, words, "en", "a", 5, 1, 2), (2, words, None, None, None, None, None), (3, None, "en", "a", 0, 1, 2),
            (4, "", "en", "a", 0, 1, 2), (None, "mail someone.else@example.org", "en", "a", 9, 1, 2), (None, None, None, None, None, None, None), (5, "z " * 30_000, "en", "a", 5, 1, 2)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, found int, score int"
    docs = spark.createDataFrame(rows, schema)
    spark.createDataFrame([(k, k % 2, 0) for k in range(6)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([("i", "no such words"), (None, None)], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    name, run = corpus_pipeline.STAGES[stage]
    got = run(spark, docs, str(tmp_path))
    kept = got.collect()
    if stage < 4:
        assert got.columns == docs.columns
    if stage == 1:  # one of each group and every row without id
        assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept) == [(False, 1), (False, 3), (False, 4), (False, 5), (True, 0), (True, 0)]
    elif stage in (2, 3):
        assert len(kept) == len(rows)
    if stage == 3:
        assert {r["n_chars"] for r in kept if r["text"] is None} == {None} and not any("someone.else@" in (r["text"] or "") for r in kept)
    assert run(spark, docs.limit(0), str(tmp_path)).count() == 0
