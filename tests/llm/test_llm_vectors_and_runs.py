"""Cosine groups, centroid search and periodic runs against brute force, and their odd inputs."""

import hashlib
import math
import random
import time
import zlib

import numpy as np
import pytest

from ledgerlight.llm import balanced_search, periodic_runs, queries, spherical_cells


# --- op13 ------------------------------------------------------------------------------------
def plain_runs(words, least=12):
    """Every maximal stretch with its smallest period, straight from the definition."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = q
        while i < n:
            if words[i] != words[i - q]:
                i += 1
                continue
            end = i
            while end < n and words[end] == words[end - q]:
                end += 1
            start = i - q
            if end - start >= max(least, 2 * q) and not any(
                all(words[k] == words[k - p] for k in range(start + p, end)) for p in range(1, q)
            ):
                found[start, q] = end - start
            i = end + 1
    return [(s, length, q) for (s, q), length in sorted(found.items())]


def texts():
    chance = random.Random(5)
    for n in (0, 1, 11, 12, 13, 25, 40, 90, 160):
        for letters in ("a", "ab", "abc", "abcdefgh"):
            yield [chance.choice(letters).encode() for _ in range(n)]
    for _ in range(60):
        unit = [chance.choice("abcde").encode() for _ in range(chance.randint(1, 9))]
        around = [chance.choice("abcde").encode() for _ in range(chance.randint(0, 20))]
        yield around + unit * chance.randint(1, 9) + unit[: chance.randint(0, 5)] + around[::-1] + unit * chance.randint(1, 8)
    line = [b"x%d" % k for k in range(30)]
    yield line * 6
    yield line * 2 + [b"y"] + line * 2
    yield ([b"a"] * 20 + [b"b"]) * 5


def test_both_ways_find_the_runs_of_the_definition():
    from ledgerlight.llm.common import window_hashes, word_hashes

    for words in texts():
        want = plain_runs(words)
        assert periodic_runs.runs_of(words) == want, words
        if len(words) >= 12:
            hashes = word_hashes(words)
            windows = np.unique(window_hashes(hashes, 6), return_inverse=True)[1]
            assert sorted(periodic_runs._diagonals(np.arange(len(windows)), windows), key=lambda r: (r[0], r[2])) == want
            assert sorted(periodic_runs._levels(hashes), key=lambda r: (r[0], r[2])) == want


def test_a_text_of_few_words_without_end_takes_little_time():
    start = time.perf_counter()
    assert periodic_runs.runs_of([b"clean"] * 100_000) == [(0, 100_000, 1)]
    assert periodic_runs.runs_of([b"a", b"b", b"a"] * 30_000) == [(0, 90_000, 3)]
    runs = periodic_runs.runs_of(([b"a"] * 999 + [b"b"]) * 60)
    assert (0, 60_000, 1000) in runs and len(runs) == 61
    assert time.perf_counter() - start < 20


def test_words_after_the_first_period_go():
    words = [b"x", *[b"a", b"b"] * 6, b"y"]
    assert periodic_runs.collapsed(words, periodic_runs.runs_of(words)) == [b"x", b"a", b"b", b"y"]


def test_run_query_against_the_definition(spark, tmp_path):
    chance = random.Random(9)
    rows = []
    for k in range(120):
        words = [chance.choice(["the", "sea", "é", "a b", "no", "Ö"]) for _ in range(chance.randint(0, 90))]
        text = "".join(w + chance.choice([" ", "\n", "\t ", "\x0b"]) for w in words)
        rows.append((chance.randint(0, 10**12) if k % 3 else k, text if k % 17 else None, "extra"))
    rows += [rows[1], (7, "", "e"), (7, "  \n", "e"), (8, "go on " * 3000, "e")]
    spark.createDataFrame(rows, "doc_id long, text string, n_words string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, queries.op13_diagonal_runs(spark, str(tmp_path)).collect()), key=repr)
    want = []
    for doc_id, text, _ in rows:
        words = (text or "").encode().split()
        h, n = zlib.crc32(str(doc_id).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = plain_runs(words) if n < 2000 else periodic_runs.runs_of(words)
        gone = {i for s, length, q in runs for i in range(s + q, s + length)}
        left = b" ".join(w for i, w in enumerate(words) if i not in gone)
        s, length, q = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
        listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()
        want.append((doc_id, len(runs), s, length, q, 1000 * length // q if runs else None,
                     hashlib.sha256(listed).hexdigest(), hashlib.sha256(left).hexdigest()))
    assert got == sorted(want, key=repr)
    assert sum(r[1] > 0 for r in got) > 5


def test_runs_of_odd_tables(spark):
    docs = spark.createDataFrame([(None, "a " * 20, 1), (2, None, 2)], "doc_id long, text string, runs int")
    got = {r["doc_id"]: r for r in periodic_runs.periodic_runs(docs).collect()}
    assert got[None]["runs"] == [(0, 20, 1)] and got[None]["collapsed"] == "a"
    assert (got[2]["n_words"], got[2]["runs"], got[2]["collapsed"]) == (0, [], "")
    assert periodic_runs.periodic_runs(docs.limit(0)).count() == 0


# --- op12 ------------------------------------------------------------------------------------
def plain_clusters(rows, k=40, rounds=5):
    """Everything compared with everything, in Python's whole numbers."""
    kept = [(i, [math.floor(256 * float(np.float32(c))) for c in v]) for i, v in rows
            if v is not None and len(v) == 64 and None not in v and np.isfinite(v).all()]
    first = sorted(kept, key=lambda r: hashlib.sha256(f"2:{r[0]}".encode()).hexdigest())[:k]
    centroids = [list(v) for _, v in first]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids)) for _, v in kept]

    for _ in range(rounds):
        own = assign()
        for j in range(len(centroids)):
            mine = [v for (_, v), (_, c) in zip(kept, own) if c == j]
            if mine:
                centroids[j] = [sum(col) // len(mine) for col in zip(*mine)]
    own, total = assign(), [0] * len(centroids)
    for d, c in own:
        total[c] += d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted((i, c, d, total[c], sum(total), digest[c]) for (i, _), (d, c) in zip(kept, own))


def vectors(n=230, seed=3):
    chance = np.random.default_rng(seed)
    x = chance.normal(size=(n, 64)) * chance.choice([0.01, 0.3, 40.0], size=(n, 1))
    rows = [(k, [float(np.float32(c)) for c in v]) for k, v in enumerate(x)]
    rows += [(500, [0.0] * 64), (501, [0.0] * 64), (502, rows[3][1]), (503, [1.0] * 63), (504, None), (505, [None] + [1.0] * 63),
             (506, [math.nan] * 64), (507, [math.inf] * 64), (508, [-0.001] * 64), (509, []), (3, rows[3][1])]
    return rows


def test_clusters_against_everything_compared(spark):
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    got = sorted(map(tuple, balanced_search.cluster(df).collect()))
    assert got == plain_clusters(rows)


def test_search_leaves_out_distances_and_keeps_ties():
    chance = np.random.default_rng(1)
    centroids = chance.integers(-300, 300, size=(40, 64)) + chance.integers(-200, 200, size=(40, 1))
    centroids[7] = centroids[2]
    x = np.concatenate([centroids + chance.integers(-9, 9, size=(40, 64)) for _ in range(30)] + [centroids])
    number, distance, computed = balanced_search.nearest(x, balanced_search.codebook(centroids))
    every = ((x[:, None, :] - centroids[None]) ** 2).sum(axis=2)
    assert (number == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all()
    assert computed < every.size / 4


def test_clusters_of_odd_tables(spark):
    schema = "vec_id long, embedding array<float>, cluster string"
    assert balanced_search.cluster(spark.createDataFrame([], schema)).count() == 0
    odd = spark.createDataFrame([(1, [1e30] * 64, "x"), (2, [0.5] * 64, "x"), (None, [0.5] * 64, "x"), (2, [0.5] * 64, "x")], schema)
    got = {(r["vec_id"], r["cluster"], r["distance"]) for r in balanced_search.cluster(odd).collect()}
    assert got == {(1, None, None), (2, 0, 0), (None, 0, 0)}
    big = spark.createDataFrame([(k, [6e4 * (-1) ** k] * 64, "x") for k in range(50)], schema)
    assert {r["distance"] for r in balanced_search.cluster(big).collect()} == {0}


# --- op11 ------------------------------------------------------------------------------------
def plain_groups(rows, threshold=0.98):
    def good(label, v):
        return label is not None and v and None not in v and np.isfinite(v).all() and any(v)

    links = [[] for _ in rows]
    unit = [np.array(v, dtype=float) / np.abs(v).max() if good(label, v) and key is not None else None for key, label, v in rows]
    unit = [None if u is None else u / np.sqrt(u @ u) for u in unit]
    for a in range(len(rows)):
        for b in range(len(rows)):
            if a != b and unit[a] is not None and unit[b] is not None and rows[a][1] == rows[b][1]:
                if len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= threshold:
                    links[a].append(b)
    out = []
    for a, (key, _, _) in enumerate(rows):
        seen, todo = {a}, [a]
        while todo:
            for b in links[todo.pop()]:
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        least = None if key is None else min(rows[b][0] for b in seen)
        out.append((key, len(links[a]), least, None if key is None else key == least))
    return sorted(out, key=repr)


def copies(seed=4, dims=16):
    chance = np.random.default_rng(seed)
    rows = []
    for k in range(12):
        base = chance.normal(size=dims)
        for _ in range(chance.integers(1, 14)):
            near = base + chance.normal(size=dims) * chance.choice([0.0, 0.05, 0.12, 0.2])
            rows.append((int(chance.integers(0, 10**9)), k % 3 if k else None, [float(np.float32(c)) for c in near]))
    chain = chance.normal(size=dims)
    for k in range(25):  # neighbours link, the ends do not
        chain = chain + chance.normal(size=dims) * 0.13
        rows.append((2000 - k, 1, [float(np.float32(c)) for c in chain]))
    rows += [(None, 1, rows[20][2]), (31, 1, None), (32, 1, [0.0] * dims), (33, 1, [math.nan] * dims), (34, 1, [None] * dims), (35, 1, []),
             (36, 1, [1.0] * 5), (37, 1, [2.0] * 5), (38, 2, [1e38] * dims), (39, 2, [1e-40] * dims), rows[20], (rows[20][0], 1, rows[40][2])]
    return rows


@pytest.mark.parametrize("limits", [{}, {"cell": 3, "cells": 9, "block": 4}, {"cell": 8, "sample": 10, "block": 5}])
def test_cosine_groups_against_all_pairs(spark, limits):
    rows = copies()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, label int, embedding array<float>, node string, links int")
    got = sorted(map(tuple, spherical_cells.cosine_groups(df.repartition(6), **limits).collect()), key=repr)
    assert got == plain_groups(rows)
    assert sum(r[1] > 0 for r in got) > 40


def test_cosine_groups_of_an_empty_table(spark):
    df = spark.createDataFrame([], "vec_id long, label int, embedding array<float>")
    assert spherical_cells.cosine_groups(df).count() == 0


def test_cells_lose_no_link_of_spread_vectors(spark):
    """Recall of the cells over vectors in all directions: every pair at the threshold is found."""
    chance = np.random.default_rng(8)
    x = chance.normal(size=(600, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    turn = chance.normal(size=x.shape)
    turn -= (turn * x).sum(axis=1, keepdims=True) * x
    turn /= np.linalg.norm(turn, axis=1, keepdims=True)
    y = 0.9801 * x + math.sqrt(1 - 0.9801**2) * turn
    rows = [(k, 1, v.tolist()) for k, v in enumerate(np.concatenate([x, y]))]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    got = {r["vec_id"]: r["n_links"] for r in spherical_cells.cosine_groups(df, cell=20, block=64).collect()}
    assert all(got[k] >= 1 for k in range(600))
