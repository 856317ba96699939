"""Hash trees against plain hashing, and drift against a plain comparison."""

import hashlib
import random

import pytest

from ledgerlight.operators import hash_tree

LEAF = "database string, table_name string, hash string"


def plain_root(hashes, fan_out):
    depth = 0
    while len(hashes) > 1:
        groups = [hashes[i : i + fan_out] for i in range(0, len(hashes), fan_out)]
        hashes, depth = [hashlib.sha256("\n".join(g).encode()).hexdigest()[:16] for g in groups], depth + 1
    return hashes[0], depth


def databases(seed):
    chance = random.Random(seed)
    rows = [(d, f"t{k:03d}", f"{chance.getrandbits(64):016x}") for d, n in (("a", 1), ("b", 4), ("c", 17), ("d", 90), (None, 5)) for k in range(n)]
    chance.shuffle(rows)
    return rows


@pytest.mark.parametrize("fan_out", [2, 4, 16])
def test_roots_are_those_of_plain_hashing(spark, many_tasks, fan_out):
    rows = databases(1)
    tree = hash_tree.build(spark.createDataFrame(rows, LEAF).repartition(7), fan_out)
    got = {r["database"]: (r["fingerprint"], r["depth"]) for r in hash_tree.roots(tree).collect()}
    want = {d: plain_root([h for e, _, h in sorted(rows, key=lambda r: r[1]) if e == d], fan_out) for d in {r[0] for r in rows}}
    assert got == want
    assert hash_tree.build(spark.createDataFrame([], LEAF)).count() == 0


def plain_drift(old, new):
    a, b = ({r[:2]: r[2] for r in rows} for rows in (old, new))
    names = {k: "removed" if k not in b else "added" if k not in a else "changed" for k in a.keys() | b.keys() if a.get(k) != b.get(k)}
    return sorted(((*k, v) for k, v in names.items()), key=repr)


def test_drift_reads_only_branches_that_differ(spark):
    old = databases(2)
    new = [(d, t, "x" if (d, t) in {("d", "t041"), ("c", "t016"), (None, "t002")} else h) for d, t, h in old]
    trees = [hash_tree.build(spark.createDataFrame(rows, LEAF), 4) for rows in (old, new)]
    found, compared = hash_tree.drift(*trees, 4)
    assert sorted(map(tuple, found.collect()), key=repr) == plain_drift(old, new)
    # five databases of 1 to 90 tables: a root each and at most four children of a node that differs
    assert sum(compared) < 40 < len(old)


def test_drift_with_tables_and_databases_that_come_and_go(spark):
    old = databases(3)
    new = [r for r in old if r[:2] != ("b", "t001") and r[0] != "a"] + [("e", "t1", "h"), ("c", "t0005", "h")]
    new = [(d, t, "y" if (d, t) == ("d", "t000") else h) for d, t, h in new]
    trees = [hash_tree.build(spark.createDataFrame(rows, LEAF), 4) for rows in (old, new)]
    assert sorted(map(tuple, hash_tree.drift(*trees, 4)[0].collect()), key=repr) == plain_drift(old, new)
    assert hash_tree.drift(trees[0], trees[0], 4)[0].count() == 0
    empty = hash_tree.build(spark.createDataFrame([], LEAF), 4)
    assert hash_tree.drift(empty, trees[0], 4)[0].count() == len(old)
    assert hash_tree.drift(empty, empty, 4)[0].count() == 0
