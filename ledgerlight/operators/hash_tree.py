"""Hash trees over the tables of databases: fingerprints built in parallel, drift found from the root down.

The tables of a database stand in order of their names; FAN_OUT neighbours make a node of the
next level, and so on up to one root. A leaf is the fingerprint of a table, the hash of a node
that of its children's hashes in order. A level is one grouping, so a large database is spread
over as many tasks as it has nodes, and no value holds more than FAN_OUT hashes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlight.operators.quality import fingerprint
from ledgerlight.operators.scale import numbered
from ledgerlight.session import durable

FAN_OUT = 16


def _level(below: DataFrame, level: int, fan_out: int) -> DataFrame:
    """Nodes of ``level`` over databases that have more than one node below."""
    child = F.struct("node", "hash")
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(child)), lambda c: c["hash"]), "\n")
    return (
        below.where("siblings > 1")
        .groupBy("database", "siblings", F.floor(F.col("node") / fan_out).alias("node"))
        .agg(fingerprint(joined).alias("hash"), F.max("last").alias("last"))
        .select(
            "database", F.lit(level).alias("level"), "node", "hash", "last", F.ceil(F.col("siblings") / fan_out).alias("siblings")
        )
    )


def build(leaves: DataFrame, fan_out: int = FAN_OUT) -> DataFrame:
    """All nodes ``(database, level, node, hash, last, siblings)``; leaves are level 0.

    leaves: database, table_name (unique in it), hash, which must cover the name. ``last`` is the last table name under a
    node, ``siblings`` the number of nodes of its level. A null database is one of its own.
    """
    placed = numbered(leaves.select("database", "table_name", "hash"), [F.col("table_name").asc()], "at", ["database"])
    sizes = placed.groupBy("database").agg(F.count(F.lit(1)).alias("siblings"))
    sized = placed.join(sizes.withColumnRenamed("database", "_d"), F.col("database").eqNullSafe(F.col("_d")))
    level = durable(sized.select(
        "database", F.lit(0).alias("level"), (F.col("at") - 1).alias("node"), "hash", F.col("table_name").alias("last"), "siblings"
    ))
    tree, most = level, level.agg(F.max("siblings")).first()[0] or 0
    number = 0
    while most > 1:
        number, most = number + 1, -(-most // fan_out)
        level = durable(_level(level, number, fan_out))
        tree = tree.unionByName(level)
    return tree


def roots(tree: DataFrame) -> DataFrame:
    """``(database, fingerprint, depth)`` from the one node of the topmost level."""
    return tree.where("siblings = 1").select("database", F.col("hash").alias("fingerprint"), F.col("level").cast("long").alias("depth"))


def drift(old: DataFrame, new: DataFrame, fan_out: int = FAN_OUT) -> tuple[DataFrame, list[int]]:
    """Tables that were added, removed or changed, and the nodes compared on each level.

    old and new: trees of ``build`` with one fan-out. Databases of equal size are walked from
    the root: only children of nodes that differ are read on the next level. Where the number of
    tables differs, positions say nothing, and the leaves of that database are joined by name.
    """
    def side(tree: DataFrame, mark: str) -> DataFrame:
        names = {"node": "node", "hash": f"{mark}_hash", "last": f"{mark}_name", "siblings": f"{mark}_siblings"}
        return tree.select(F.col("database").alias(f"{mark}_db"), "level", *[F.col(c).alias(n) for c, n in names.items()])

    a, b = side(old, "old"), side(new, "new")
    top = [r["m"] for r in old.agg(F.max("level").alias("m")).collect() + new.agg(F.max("level").alias("m")).collect() if r["m"] is not None]
    sizes = a.where("level = 0").groupBy("old_db").agg(F.max("old_siblings").alias("n")).join(
        b.where("level = 0").groupBy("new_db").agg(F.max("new_siblings").alias("m")), F.col("old_db").eqNullSafe(F.col("new_db")), "full_outer"
    )
    sizes = durable(sizes.withColumn("known", F.coalesce("n", F.lit(0)) > 0).select(
        F.when(F.col("known"), F.col("old_db")).otherwise(F.col("new_db")).alias("db"), F.col("n").eqNullSafe(F.col("m")).alias("even")
    ))
    even = sizes.where("even").select("db")
    open_: DataFrame | None = None  # nodes of this level whose parents differ
    compared = []
    for level in range(max(top, default=-1), -1, -1):
        here = a.where(F.col("level") == level).join(even, F.col("old_db").eqNullSafe(F.col("db")), "left_semi").drop("level")
        there = b.where(F.col("level") == level).drop("level").withColumnRenamed("node", "node_b")
        root = F.col("old_siblings") == 1
        if open_ is not None:
            parents = open_.select(F.col("old_db").alias("p_db"), F.col("node").alias("p_node"))
            below = here.where(~root).join(
                parents, F.col("old_db").eqNullSafe(F.col("p_db")) & (F.floor(F.col("node") / fan_out) == F.col("p_node")), "left_semi"
            )
            here = here.where(root).unionByName(below)
        else:
            here = here.where(root)
        both = durable(here.join(there, F.col("old_db").eqNullSafe(F.col("new_db")) & (F.col("node") == F.col("node_b"))))
        compared.append(both.count())
        open_ = both.where("old_hash <> new_hash")
    uneven = sizes.where("not even").select("db")
    parts = []
    if open_ is not None:
        old_side = F.struct(F.col("old_name").alias("table_name"), "old_hash", F.lit(None).cast("string").alias("new_hash"))
        new_side = F.struct(F.col("new_name").alias("table_name"), F.lit(None).cast("string").alias("old_hash"), "new_hash")
        parts.append(open_.select(F.col("old_db").alias("database"), F.inline(F.array(old_side, new_side))))
    none = F.lit(None).cast("string")
    for tree, own, other in ((a, "old", "new"), (b, "new", "old")):
        rest = tree.where("level = 0").join(uneven, F.col(f"{own}_db").eqNullSafe(F.col("db")), "left_semi")
        parts.append(rest.select(
            F.col(f"{own}_db").alias("database"), F.col(f"{own}_name").alias("table_name"), f"{own}_hash", none.alias(f"{other}_hash")
        ))
    merged = reduce(DataFrame.unionByName, parts).groupBy("database", "table_name").agg(F.max("old_hash").alias("old_hash"), F.max("new_hash").alias("new_hash"))
    change = F.when(F.col("old_hash").isNull(), "added").when(F.col("new_hash").isNull(), "removed").when(F.col("old_hash") != F.col("new_hash"), "changed")
    return merged.withColumn("change", change).where("change is not null").select("database", "table_name", "change"), compared
