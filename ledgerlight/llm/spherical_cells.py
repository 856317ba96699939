"""Near copies of vectors by cosine: spherical k-means cells, blocked products inside the cells.

1. Equal vectors of one label become one class that knows its number of copies.
2. Spherical k-means on a bounded sample of classes, chosen by hash, gives unit centres. Every
   class lies in the cell of its nearest centre.
3. A class also visits each other cell whose centre is nearly as near. Two unit vectors with
   cosine >= t are at most ``sqrt(2 - 2t)`` apart, so between the cells of their centres c1 and
   c2 the sum of their two leads is at most ``sqrt(2 - 2t) * |c1 - c2|``, and one of the two
   leads is at most half of that. Visiting every cell within that half therefore loses no link.
4. Inside a cell, blocks of at most BLOCK classes meet block by block as products of matrices,
   each pair of blocks in a task of its own. A task sends no pairs: one row for each class with
   links, with their number and the smallest class its links reach inside the task.
5. Components of those rows are the groups; the vector with the smallest id of each is kept.

Only vectors of equal label and equal length are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlight.llm.common import mapped, stored
from ledgerlight.llm.components import components

THRESHOLD = 0.98
SAMPLE = 16_384  # classes that the centres are fitted on
CELL = 512  # classes of one label wanted in a cell
CELLS = 1_024  # most centres of one length; larger cells take more pairs of blocks
BLOCK = 1_024
STEPS = 8  # rounds of k-means
CLOSE = 1e-9  # products this near the threshold are computed anew

GROUP = ["label", "size"]


def usable(label: Column, key: Column, vector: Column) -> Column:
    """True for a vector that may link: label and id, finite components, not all zero."""
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf")))
    some = F.exists(vector, lambda v: v != 0)
    return F.coalesce(label.isNotNull() & key.isNotNull() & vector.isNotNull() & finite & some, F.lit(False))


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, first by their largest component so that no square overflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def spherical_kmeans(x: np.ndarray, k: int, steps: int = STEPS) -> np.ndarray:
    """``k`` unit centres of unit rows; they start as rows spread evenly over the sample."""
    centres = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(steps):
        own = np.argmax(x @ centres.T, axis=1)
        total = np.zeros_like(centres)
        np.add.at(total, own, x)
        length = np.sqrt((total * total).sum(axis=1))
        full = length > 1e-9
        centres[full] = total[full] / length[full, None]
    return np.unique(centres, axis=0)


def fit_cells(classes: DataFrame, sample: int = SAMPLE, cell: int = CELL, cells: int = CELLS) -> dict[int, np.ndarray]:
    """Centres for each vector length. At most ``sample`` classes of each of the four commonest
    lengths are read; other lengths have one cell. Their number follows the largest label."""
    sizes = classes.groupBy(*GROUP).agg(F.count("*").alias("n")).groupBy("size")
    common = sizes.agg(F.sum("n").alias("n"), F.max("n").alias("most")).orderBy(F.desc("n"), "size").limit(4).collect()
    centres = {}
    for row in common:
        k = min(cells, -(-row["most"] // cell))
        if k < 2:
            continue
        part = 2.0 * sample / row["n"]
        few = classes.where(F.col("size") == row["size"])
        if part < 1:
            few = few.where(F.pmod(F.xxhash64("node", F.lit(3)), F.lit(1 << 30)) < int(part * (1 << 30)))
        got = few.orderBy(F.xxhash64("node", F.lit(4)), "node").limit(sample).select("vector").toArrow()
        x = got.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        centres[row["size"]] = spherical_kmeans(unit_rows(x.reshape(-1, row["size"])), k)
    return centres


def _placed(classes: DataFrame, centres: dict[int, np.ndarray], threshold: float) -> DataFrame:
    """The classes with their nearest cell, and the other cells that may hold a link of theirs."""
    reach = float(np.sqrt(2 - 2 * threshold)) / 2 + 1e-9

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apart = {d: np.sqrt(np.maximum(0.0, 2 - 2 * (c @ c.T))) for d, c in centres.items()}
        for batch in batches:
            sizes = np.asarray(batch.column("size"))
            cell, visits = np.zeros(len(batch), dtype=np.int32), [[] for _ in range(len(batch))]
            for d in [d for d in np.unique(sizes).tolist() if d in centres]:
                rows = np.flatnonzero(sizes == d)
                flat = batch.column("vector").take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False)
                near = unit_rows(flat.astype(np.float64).reshape(-1, d)) @ centres[d].T
                each, own = np.arange(len(rows)), near.argmax(axis=1)
                cell[rows] = own
                close = near[each, own][:, None] - near <= reach * apart[d][own] + 1e-9
                close[each, own] = False
                for r, c in zip(*(v.tolist() for v in np.nonzero(close))):
                    visits[rows[r]].append(c)
            more = [pa.array(cell), pa.array(visits, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "cell", "visits"])

    return mapped(classes, run, T.StructType([*classes.schema, T.StructField("cell", T.IntegerType()), T.StructField("visits", T.ArrayType(T.IntegerType()))]))


def _blocks(rows: DataFrame, block: int) -> DataFrame:
    """Every class once for each pair of blocks it takes part in, with the side it is on.

    Residents and visitors of a cell are cut into blocks by hash; residents meet residents
    and visitors, visitors do not meet each other.
    """
    at = [*GROUP, "at"]
    count = rows.groupBy(*at).agg(F.count_if("resident").alias("residents"), F.count_if(~F.col("resident")).alias("visitors"))
    count = count.where("residents > 1 or (residents = 1 and visitors > 0)").select(
        *at, F.ceil(F.col("residents") / block).cast("int").alias("r"), F.ceil(F.col("visitors") / block).cast("int").alias("v")
    )
    own = F.pmod(F.xxhash64("node", F.lit(7)), F.when(F.col("resident"), F.col("r")).otherwise(F.col("v"))).cast("int")
    dealt = rows.join(count, at).withColumn("own", own)

    def pairs(n: Column, make) -> Column:
        return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), make)).otherwise(F.array().cast("array<struct<i:int,j:int,side:int>>"))

    def pair(i: Column, j: Column, side: Column) -> Column:
        return F.struct(i.alias("i"), j.alias("j"), side.cast("int").alias("side"))

    mine = F.col("own")
    among = pairs(F.col("r"), lambda k: pair(F.least(mine, k), F.greatest(mine, k), F.when(k >= mine, 0).otherwise(1)))
    outward = pairs(F.col("v"), lambda k: pair(mine, F.col("r") + k, F.lit(0)))
    inward = pairs(F.col("r"), lambda k: pair(k, F.col("r") + mine, F.lit(1)))
    tasks = F.when(F.col("resident"), F.concat(among, outward)).otherwise(inward)
    return dealt.select(*at, "node", "copies", "resident", "cell", "visits", "vector", F.explode(tasks).alias("task")).select(
        *at, F.col("task.i").alias("i"), F.col("task.j").alias("j"), F.col("task.side").alias("side"), "node", "copies",
        "resident", "cell", "visits", "vector",
    )


def _links(a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Which unit rows of ``a`` and ``b`` have a cosine of at least ``threshold``."""
    product = a @ b.T
    linked = product >= threshold
    for i, j in zip(*np.nonzero(np.abs(product - threshold) <= CLOSE)):
        linked[i, j] = float(np.sum(a[i] * b[j])) >= threshold
    return linked


def _met(table: pa.Table, threshold: float) -> pa.Table:
    """Links of one pair of blocks: a row a class with links (node, links, reached)."""
    table = table.combine_chunks()
    size, here, i, j = (table.column(c)[0].as_py() for c in ("size", "at", "i", "j"))
    node = table.column("node").combine_chunks()
    ids, tags = np.asarray(node.field("id")), np.asarray(node.field("tag"))
    side, copies = np.asarray(table.column("side")), np.asarray(table.column("copies"))
    flat = table.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    x = unit_rows(flat.astype(np.float64).reshape(-1, size))
    left = np.flatnonzero(side == 0)
    right = left if i == j else np.flatnonzero(side == 1)
    linked = _links(x[left], x[right], threshold)
    if i == j:
        linked &= ~np.eye(len(left), dtype=bool)
    elif len(right) and not table.column("resident")[int(right[0])].as_py():
        # A pair that meets in the cells of both counts in the one with the smaller number.
        owner = np.asarray(table.column("cell"))[right]
        visits = [set(v) for v in table.column("visits").take(pa.array(left)).to_pylist()]
        for other in [c for c in np.unique(owner).tolist() if c < here]:
            linked[np.ix_(np.array([other in v for v in visits], dtype=bool), owner == other)] = False
    links = np.zeros(len(x), dtype=np.int64)
    links[left] += linked @ copies[right]
    if i != j:
        links[right] += copies[left] @ linked

    order = np.lexsort((tags, ids))
    least = np.empty(len(x), dtype=np.int64)
    least[order] = np.arange(len(x))
    rows, cols = np.flatnonzero(linked.any(axis=1)), np.flatnonzero(linked.any(axis=0))
    core, moved = linked[np.ix_(rows, cols)], len(rows) > 0
    while moved:  # the smallest number spreads over the links
        before = least.sum()
        least[left[rows]] = np.minimum(least[left[rows]], np.where(core, least[right[cols]], len(x)).min(axis=1))
        least[right[cols]] = np.minimum(least[right[cols]], np.where(core.T, least[left[rows]], len(x)).min(axis=1))
        moved = least.sum() < before
    met = np.flatnonzero(links > 0)
    reached = order[least[met]]

    def nodes(at: np.ndarray) -> pa.Array:
        return pa.StructArray.from_arrays([pa.array(ids[at]), pa.array(tags[at])], names=["id", "tag"])

    return pa.table({"node": nodes(met), "links": pa.array(links[met]), "reached": nodes(reached)})


def cosine_groups(
    df: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    sample: int = SAMPLE, cell: int = CELL, cells: int = CELLS, block: int = BLOCK,
) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)``, one row a row of ``df``.

    Two rows link if their labels are equal and not null and the cosine of their vectors, in
    double precision, is at least ``threshold``; ``n_links`` counts the other rows a row links
    with and ``component_id`` is the smallest id it reaches over links. Vectors that are null,
    empty, zero or hold null or non-finite components, and rows without id or label, link with
    nothing and stand for themselves; vectors of different length do not link. Rows that repeat
    an id and a vector link with each other like other copies. ``kept`` marks the rows that name
    their group, and is null without an id. An empty table gives no rows, other columns are
    ignored. ``sample``, ``cell``, ``cells`` and ``block`` change the work, never the links.
    """
    key, vector = F.col(id_col).cast("long"), F.col(vector_col)
    rows = df.select(key.alias("vec_id"), F.col(label_col).alias("label"), vector.alias("vector"))
    good = usable(F.col("label"), F.col("vec_id"), F.col("vector"))
    # Two hashes of 64 bits name a vector.
    marks = [F.xxhash64("vector", F.lit(1)).alias("k1"), F.xxhash64(F.lit(2), "vector").alias("k2")]
    named = rows.where(good).select("vec_id", "label", "vector", F.size("vector").alias("size"), *marks)
    classes = stored(
        named.groupBy("label", "size", "k1", "k2").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"), F.first("vector").alias("vector"))
        .select("label", "size", "k1", "k2", F.struct("id", F.xxhash64("label", "k1", "k2").alias("tag")).alias("node"), "copies", "vector")
    )
    placed = _placed(classes.drop("k1", "k2"), fit_cells(classes, sample, cell, cells), threshold)
    at = F.explode(F.concat(F.array("cell"), F.col("visits"))).alias("at")
    dealt = placed.select("*", at).withColumn("resident", F.col("at") == F.col("cell"))
    tasks = _blocks(dealt, block).groupBy(*GROUP, "at", "i", "j")
    pair = "struct<id:bigint,tag:bigint>"
    met = stored(tasks.applyInArrow(lambda table: _met(table, threshold), f"node {pair}, links long, reached {pair}"))
    counts = met.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(met.select(F.col("node").alias("u"), F.col("reached").alias("v")))
    told = classes.select("label", "k1", "k2", "node", "copies").join(counts, "node", "left").join(roots, "node", "left")
    told = told.select(
        F.col("label").alias("_l"), "k1", "k2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("root.id", "node.id").alias("component_id"),
    )
    linked = named.select("vec_id", "label", "k1", "k2").join(told, (F.col("label") == F.col("_l")) & (named.k1 == told.k1) & (named.k2 == told.k2))
    alone = rows.where(~good).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    every = linked.select("vec_id", "n_links", "component_id").unionByName(alone)
    return every.withColumn("kept", F.col("vec_id") == F.col("component_id"))
