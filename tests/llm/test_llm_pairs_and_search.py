"""Jaccard join, components and suffix arrays against brute force."""

import collections
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerlight.llm import jaccard_join, suffix_shards
from ledgerlight.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def roots_of(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(parent)}


def plain_components(rows, percent=75):
    sets = []
    for i, text in rows:
        w = WORD.findall(low(text))
        sets.append((i, frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()))
    links = [
        (a, b) for a, x in sets for b, y in sets
        if a != b and x and y and 100 * len(x & y) >= percent * len(x | y)
    ]
    roots = roots_of(links)
    return collections.Counter((i, len(s), roots.get(i, i)) for i, s in sets)


def corpus(seed, groups=14):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    passage = rng.choices(vocabulary, k=55)
    rows, i = [], 0
    for _ in range(groups):
        base = rng.choices(vocabulary, k=rng.choice([3, 4, 5, 6, 9, 30, 90, 200]))
        if rng.random() < 0.4:
            base = base + passage
        for _ in range(rng.choice([1, 1, 2, 4, 9])):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 5, 12])):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            rows.append((i, rng.choice([" ", "\n", "\t "]).join(w.upper() if rng.random() < 0.1 else w for w in own)))
            i += rng.randint(1, 3)
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", range(4))
def test_join_equals_brute_force(many_tasks, seed):
    rows = corpus(seed) + [(90_000, None), (90_001, ""), (90_002, " \n"), (90_003, "one"), (90_004, "One"), (90_005, "one two")]
    docs = many_tasks.createDataFrame([(*r, "c", 1) for r in rows], "doc_id long, text string, component_id string, node int")
    got = collections.Counter(tuple(r) for r in jaccard_join.jaccard_components(docs).collect())
    assert got == plain_components(rows)


@pytest.mark.parametrize("levels,stars", [(1, 1), (3, 2)])
def test_join_by_other_settings(spark, levels, stars):
    rows = corpus(11)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = collections.Counter(tuple(r) for r in jaccard_join.jaccard_components(docs, levels=levels, stars=stars).collect())
    assert got == plain_components(rows)


def test_join_repeated_rows_missing_ids_and_empty_table(spark):
    text = " ".join(f"a{k}" for k in range(30))
    rows = [(5, text), (5, text), (None, text), (7, text), (None, "alone in the set here"), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = jaccard_join.jaccard_components(docs)
    got = collections.Counter((r[0], r[2]) for r in found.collect())
    assert got == {(5, 5): 2, (None, 5): 1, (7, 5): 1, (None, None): 1, (3, 3): 1}
    kept = [r["doc_id"] for r in jaccard_join.one_of_each(docs, found).collect()]
    assert collections.Counter(kept) == {5: 1, 3: 1, None: 2}
    assert jaccard_join.jaccard_components(docs.limit(0)).count() == 0


def test_long_text_is_read_to_its_end(spark):
    words = [f"q{k}" for k in range(30_000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:24_000] + [f"z{k}" for k in range(6_000)])), (3, " ".join(words[:29_000]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_components(docs).collect()}
    assert got == {1: 1, 2: 1 if 23_996 * 100 >= 75 * (29_996 * 2 - 23_996) else 2, 3: 1}


@pytest.mark.parametrize("edges", [
    [(k, k + 1) for k in range(200)], [(k, 0) for k in range(1, 80)], [(5, 5)], [],
    [(a * 31 % 97, a * 17 % 89 + 100) for a in range(60)], [(3, 1), (3, 1), (1, 3)],
])
def test_components(many_tasks, edges):
    links = many_tasks.createDataFrame(edges, "u long, v long")
    got = {r["node"]: r["root"] for r in components(links).collect()}
    assert got == roots_of([e for e in edges if e[0] != e[1]])


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(text))


def plain_hits(text, items, window):
    words, hit, met = words_of(text), set(), set()
    for name, item in items:
        w = words_of(item)
        size = min(window, len(w))
        grams = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if size else set()
        for k in range(len(words) - size + 1) if size else ():
            if tuple(words[k : k + size]) in grams:
                hit |= set(range(k, k + size))
                met.add("" if name is None else str(name))
    return len(words), len(hit), sorted(met)


letters = st.sampled_from(["a", "b", "c", "d", "É", "7", "A", "x-y", "."])
texts = st.lists(letters, max_size=40).map(" ".join)


@settings(max_examples=200, deadline=None)
@given(st.lists(texts, min_size=1, max_size=6), st.lists(st.lists(letters, max_size=12).map(" ".join), min_size=1, max_size=5), st.sampled_from([2, 4, 10]))
def test_shard_equals_brute_force(documents, tests, window):
    items = [(str(k), t) for k, t in enumerate(tests)]
    block = suffix_shards.coded([(n, suffix_shards.words_in(t.encode())) for n, t in items], window)
    split = [suffix_shards.words_in(t.encode()) for t in documents]
    found = suffix_shards._shard(split, block)
    for k, text in enumerate(documents):
        got = suffix_shards._result(len(split[k]), found.get(k), None)
        assert (got["n_words"], got["n_hit"], got["items"]) == plain_hits(text, items, window)
        own = words_of(text)
        for m in got["matches"]:
            test = words_of(dict(items)[m["item_id"]])
            a, b, n = m["doc_start"], m["item_start"], m["words"]
            assert own[a : a + n] == test[b : b + n]
            assert a + n == len(own) or b + n == len(test) or own[a + n] != test[b + n]


def test_contamination_blocks_and_edge_rows(spark):
    item = " ".join(f"t{k}" for k in range(25))
    items = [(1, item, 0), (2, "short one here", 0), (3, None, 0), (None, "nameless item of five words", 0), (2, "other words", 0), (4, "", 0)]
    benchmark = spark.createDataFrame(items, "item_id int, text string, doc_id int")
    rows = [
        (1, "x " + " ".join(item.split()[4:18]) + " y"), (2, None), (3, ""), (4, "A SHORT, one here!"), (4, "A SHORT, one here!"),
        (None, "the nameless item of five words"), (6, "clean " * 5000), (7, " ".join(item.split()[:9])), (8, "other words short one here " + item),
    ]
    docs = spark.createDataFrame([(*r, "f") for r in rows], "doc_id long, text string, found string")
    plain = [(a, b) for a, b, _ in items]
    for options in ({}, {"block_words": 8, "shard_words": 20}):
        found = suffix_shards.contamination(docs, benchmark, **options).collect()
        got = sorted((str(r["doc_id"]), r["found"]["n_words"], r["found"]["n_hit"], r["found"]["items"]) for r in found)
        assert got == sorted((str(i), *plain_hits(t, plain, 10)) for i, t in rows)
    clean = suffix_shards.decontaminate(docs.drop("found"), benchmark)
    assert sorted(r["doc_id"] for r in clean.collect()) == [2, 3, 6, 7] and clean.columns == ["doc_id", "text"]
    assert suffix_shards.contamination(docs.limit(0), benchmark).count() == 0
    assert suffix_shards.decontaminate(docs, benchmark.limit(0)).count() == len(rows)


def test_the_prefix_bound_holds_for_every_percent():
    """Over all sizes of two linked sets, the smaller one's prefix holds what the other asks for."""
    for percent in range(50, 101):
        for n in range(1, 130):
            for m in range(-(-n * percent // 100), n + 1):
                # shingles that two linked sets of n >= m have in common
                least = next(k for k in range(m + 1) if 100 * k >= percent * (n + m - k))
                inside = min(least - jaccard_join._needed(k, percent) + int(jaccard_join._ell(k)) for k in (n, m))
                assert inside >= max(jaccard_join._asked(n, percent), jaccard_join._asked(m, percent))


def test_sets_that_differ_in_one_of_twenty_link_at_95_percent(spark):
    words = [f"w{k}" for k in range(24)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:-1])), (3, " ".join(reversed(words)))]
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), percent=95)
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == {1: 1, 2: 1, 3: 3}


def test_private_names_may_be_taken(spark):
    words = " ".join(f"w{k}" for k in range(30))
    docs = spark.createDataFrame([(1, words, 5, 6, 7), (2, words, 5, 6, 7), (3, "other words here", 5, 6, 7)],
                                 "doc_id long, text string, _kept_id int, found int, _text_ int")
    kept = jaccard_join.one_of_each(docs, jaccard_join.jaccard_components(docs))
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3] and kept.columns == docs.columns
    items = spark.createDataFrame([("a", "other words here")], "item_id string, text string")
    left = suffix_shards.decontaminate(docs, items)
    assert left.columns == docs.columns and [tuple(r)[2:] for r in left.collect()] == [(5, 6, 7)] * 2
