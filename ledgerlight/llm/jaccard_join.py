"""Exact n-gram Jaccard join with adaptive multi-match prefixes.

Two sets of n and m shingles with Jaccard similarity of at least t share at least
``ceil(t * max(n, m))`` of them. So whatever the common order of the shingles, their
prefixes of ``n - ceil(t * n) + l`` shingles share at least l, for every l. A longer
prefix demands more shared shingles and lets fewer pairs through. The work goes in
steps, each of which loses no link:

1. Equal sets become one class, named by its smallest document.
2. A class survives if enough of its prefix in hash order is shared with other classes;
   the prefix is lengthened by a twentieth of the set, so that one common line is not enough.
3. Over the survivors the shingles are ordered by document frequency, the rare ones
   first, and every class chooses its own l by the estimated cost of its candidates.
4. Min-hash stars link most of a group of near copies to one hub, each link verified on
   the whole sets. Then only pairs of different components are candidates, so a group
   of copies never becomes all its pairs, and parity bits of the sets rule out most of them.
5. Candidates with l shared prefix shingles are verified on the whole sets.

Shingles are 64-bit hashes of word runs; sets are identified by 128 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlight.llm.common import fresh, long_list, lowered, mapped, mixed, release, stored, utf8, window_hashes, word_hashes
from ledgerlight.llm.components import components

LEVELS = 8  # the largest l
STARS = 4  # min-hash hubs of a class
STEPS_A_DOUBLING = 64  # of the frequencies by which shingles are ordered
MARKS = [f"bits_{k}" for k in range(8)]  # parity bits of a set, 64 in each
BROADCAST_CLASSES = 500_000  # at most 4 MB of class keys go to every task


def shingle_set(text: bytes | None, size: int = 5) -> np.ndarray:
    """Sorted distinct shingle hashes; a text of fewer words is one shingle, no words none."""
    hashes = word_hashes(lowered(text).split())
    return np.unique(window_hashes(hashes, min(size, len(hashes)))) if len(hashes) else hashes


def _needed(n: np.ndarray | int, percent: int) -> np.ndarray | int:
    return -(-n * percent // 100)


def _signatures(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Per row: set size, 128-bit key of the set, its hash-order prefix and the shared part it needs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), utf8(batch.column(1))
            for at in range(0, len(texts), 1024):
                sets = [shingle_set(t, size) for t in texts[at : at + 1024]]
                keys = np.array([divmod(xxhash.xxh3_128_intdigest(s.tobytes()), 1 << 64) for s in sets], dtype=np.uint64)
                heads = [s[: len(s) - _needed(len(s), percent) + _ell(len(s))] for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(at, len(sets)), pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(keys[:, 0].view(np.int64)), pa.array(keys[:, 1].view(np.int64)), long_list(heads),
                        pa.array([_asked(len(s), percent) for s in sets], pa.int64()),
                    ],
                    names=["doc_id", "n_shingles", "k1", "k2", "head", "asked"],
                )

    return mapped(docs, run, "doc_id long, n_shingles long, k1 long, k2 long, head array<long>, asked long")


def _ell(n: np.ndarray | int) -> np.ndarray | int:
    """By how many shingles the hash-order prefix is lengthened: a twentieth of the set."""
    return np.minimum(n, 1 + n // 20)


@lru_cache(maxsize=1 << 16)
def _asked(n: int, percent: int) -> int:
    """Shingles of its prefix that a class of ``n`` must share with others to survive.

    Two linked sets of n >= m shingles share at least ``percent * (n + m) / (100 + percent)``,
    so the prefix of the smaller one holds that less ``needed(m)`` plus ``ell(m)`` of them; over
    all m that may link with n, the least of this is safe. Up to 90 percent it is ``ell(n)``.
    """
    if not n:
        return 0
    m = np.arange(_needed(n, percent), n + 1)
    shared = -(-percent * (n + m) // (100 + percent))
    return int(min(_ell(n), (shared - _needed(m, percent) + _ell(m)).min()))


def _survivors(heads: DataFrame) -> DataFrame:
    """Nodes of the classes whose hash-order prefix is shared often enough with other classes.

    heads: node, asked, head, one row a class. A class holds a token once, so a token that
    occurs twice is shared. A repeated row can only let a class survive that need not.
    """
    posts = heads.select("node", "asked", F.explode("head").alias("token"))
    shared = posts.groupBy("token").agg(F.count("*").alias("df")).where("df > 1").select("token")
    met = posts.join(shared, "token").groupBy("node", "asked").agg(F.count("*").alias("met"))
    return met.where("met >= asked").select("node")


def _few(rows: DataFrame) -> DataFrame:
    """A stored column of ids, to be broadcast where a count proves it small."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_CLASSES else rows


def _sets(docs: DataFrame, size: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), utf8(batch.column(1))
            for at in range(0, len(texts), 512):
                sets = [shingle_set(t, size) for t in texts[at : at + 512]]
                bits = np.stack([_parity(s) for s in sets])
                columns = [ids.slice(at, len(sets)), long_list(sets), *[pa.array(c) for c in bits.T]]
                yield pa.RecordBatch.from_arrays(columns, names=["node", "shingles", *MARKS])

    return mapped(docs, run, "node long, shingles array<long>, " + ", ".join(f"{m} long" for m in MARKS))


def _parity(shingles: np.ndarray) -> np.ndarray:
    """64 * len(MARKS) bits; a bit is the parity of the shingles that fall on it."""
    at = (mixed(shingles) >> np.uint64(40)).astype(np.int64) % (64 * len(MARKS))
    odd = (np.bincount(at, minlength=64 * len(MARKS)) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64)


def _may_link(percent: int) -> Column:
    """False only where the parity bits alone prove that a pair does not link.

    Every differing bit stands for at least one shingle that only one side has, and a link
    leaves room for n + m - 2 * overlap such shingles, with overlap at its least.
    """
    apart = reduce(lambda a, b: a + b, [F.bit_count(F.col(f"a_{m}").bitwiseXOR(F.col(f"b_{m}"))) for m in MARKS])
    both = F.col("a_n") + F.col("b_n")
    return (both - apart) * (100 + percent) >= 2 * percent * both


def _similar(percent: int) -> Column:
    both = F.size(F.array_intersect("left_set", "right_set"))
    return 100 * both >= percent * (F.size("left_set") + F.size("right_set") - both)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(u, v)`` whose whole sets are similar enough."""
    left = sets.select(F.col("node").alias("u"), F.col("shingles").alias("left_set"))
    right = sets.select(F.col("node").alias("v"), F.col("shingles").alias("right_set"))
    return pairs.join(left, "u").join(right, "v").where(_similar(percent)).select("u", "v")


def _star_pairs(sets: DataFrame, stars: int, percent: int) -> DataFrame:
    """Each class beside the smallest class that has the same min-hash, for several hashes.

    Pairs that the parity bits rule out are left out before any set is read.
    """
    def mark(k: int) -> Column:
        return F.array_min(F.transform("shingles", lambda x: F.xxhash64(x, F.lit(k))))

    mins = sets.select("node", F.posexplode(F.array(*[mark(k) for k in range(stars)])).alias("k", "mark"))
    hubs = mins.groupBy("k", "mark").agg(F.min("node").alias("v"), F.count("*").alias("c")).where("c > 1")
    pairs = mins.join(hubs, ["k", "mark"]).where("node > v").select(F.col("node").alias("u"), "v").distinct()
    marks = sets.select("node", F.size("shingles").cast("long").alias("n"), *MARKS)
    for side, end in (("a", "u"), ("b", "v")):
        own = marks.select(F.col("node").alias(end), *[F.col(c).alias(f"{side}_{c}") for c in ("n", *MARKS)])
        pairs = pairs.join(own, end)
    return pairs.where(_may_link(percent)).select("u", "v")


def _prefixes(sets: DataFrame, percent: int, levels: int) -> DataFrame:
    """Postings ``(token, node, level, ell)`` of every class, rare shingles first.

    ``level`` is the smallest l whose prefix holds the posting; ``ell`` is the l that the
    class chooses: the one with the least postings to read plus candidates to verify,
    where at most ``(postings read) / l`` candidates share l of them.
    """
    posts = sets.select("node", F.explode("shingles").alias("token"))
    common = posts.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    # One number holds the rank of a shingle: frequency step, then 48 bits of its hash. Where
    # two shingles share a number a pair meets once more than it should, and is verified.
    rank = F.shiftleft(F.floor(F.log2("df") * STEPS_A_DOUBLING), 48).bitwiseOR(F.shiftrightunsigned("token", 16))
    ranked = posts.join(common, "token").groupBy("node").agg(F.sort_array(F.collect_list(rank)).alias("shared"))
    sizes = sets.select("node", F.size("shingles").cast("long").alias("n"))
    free = F.col("n") - F.size("shared")  # shingles of no other class come first
    base = F.col("n") - F.ceil(F.col("n") * percent / 100)
    reach = ranked.join(sizes, "node").select("node", "n", "shared", free.alias("free"), base.alias("base"))

    def frequency(key: Column) -> Column:
        return F.pow(F.lit(2.0), F.shiftrightunsigned(key, 48) / STEPS_A_DOUBLING)

    cost = F.transform(
        F.sequence(F.lit(1), F.lit(levels)),
        lambda lv: F.struct(
            F.aggregate(
                F.slice("shared", F.lit(1), F.greatest(F.lit(0), (F.col("base") + lv - F.col("free")).cast("int"))),
                F.lit(0.0),
                lambda total, key: total + frequency(key),
            ).alias("read"),
            lv.alias("ell"),
        ),
    )
    verify = F.col("n") / 8.0  # reading two whole sets, in postings
    chosen = F.array_min(
        F.transform(cost, lambda c: F.struct((c["read"] * (1 + verify / c["ell"])).alias("cost"), c["ell"].alias("ell")))
    )["ell"]
    picked = reach.withColumn("ell", F.least(chosen, F.col("n")))
    level = F.greatest(F.lit(1), F.col("free") + F.col("at") - F.col("base") + 1)
    return (
        picked.select("node", "free", "base", "ell", F.posexplode("shared").alias("at", "token"))
        .select("node", "token", level.cast("int").alias("level"), "ell")
        .where(F.col("level") <= levels)
    )


def _cross_candidates(posts: DataFrame, roots: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components that share enough prefix shingles.

    Per shingle only the classes outside its largest component probe, so a component
    costs its rows, not its pairs; both sides of a pair use the l of the smaller one. The
    parity bits of both sets drop most pairs inside the join.
    """
    own = posts.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    own = stored(own)
    per_root = own.groupBy("token", "root").agg(F.count("*").alias("c"))
    mode = per_root.groupBy("token").agg(
        F.max(F.struct("c", "root"))["root"].alias("mode"), F.count("*").alias("roots")
    ).where("roots > 1").select("token", "mode")
    marks = sets.select("node", F.size("shingles").cast("long").alias("n"), *MARKS)
    shared = own.join(mode, "token").join(marks, "node")

    def side(name: str) -> list[Column]:
        keys = [F.col(c).alias(f"{name}{c[0]}") for c in ("root", "level", "ell")]
        return [F.col("node").alias(name), *keys, *[F.col(c).alias(f"{name}_{c}") for c in ("n", *MARKS)]]

    probe = shared.where("root <> mode").select("token", *side("a"))
    index = shared.select("token", *side("b"), (F.col("root") == F.col("mode")).alias("major"))
    ell = F.when(F.col("a") < F.col("b"), F.col("ae")).otherwise(F.col("be"))
    met = probe.join(index, "token").where(
        (F.col("ar") != F.col("br")) & (F.col("major") | (F.col("a") < F.col("b"))) & (F.greatest("al", "bl") <= ell)
        & _may_link(percent)
    )
    return (
        met.groupBy(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .agg(F.count("*").alias("met"), F.max(ell).alias("ell"))
        .where("met >= ell")
        .select("u", "v")
    )


def jaccard_components(
    docs: DataFrame, percent: int = 75, size: int = 5, id_col: str = "doc_id", text_col: str = "text",
    levels: int = LEVELS, stars: int = STARS,
) -> DataFrame:
    """``(doc_id, n_shingles, component_id)``, one row a document row.

    ``component_id`` is the smallest document reachable over links; two documents link
    when 100 * intersection >= ``percent`` * union of their shingle sets. Texts without
    words (null, empty, white space) have no shingles and link with nothing. Repeated
    rows give repeated results; a row without id takes the component of its set, if other
    documents have one, else null. An empty table gives no rows; other columns are ignored.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    signed = stored(_signatures(source, size, percent))
    filled = signed.where("n_shingles > 0")
    classes = stored(
        filled.groupBy("k1", "k2").agg(F.min("doc_id").alias("node"), F.count("*").alias("copies")).where("node is not null")
    )
    # Copies, which are not the smallest document of their class, and ids of several rows.
    copies = filled.join(classes, ["k1", "k2"]).where("doc_id <> node").select(F.col("doc_id").alias("copy")).distinct()
    copies = stored(copies)
    repeated = stored(filled.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("copy")))
    firsts = filled.where("doc_id is not null").join(_few(copies), F.col("doc_id") == F.col("copy"), "left_anti")
    alive = stored(_survivors(firsts.select(F.col("doc_id").alias("node"), "asked", "head")).distinct())
    narrow = stored(signed.drop("head", "asked"))
    release(signed)
    chosen = source.join(_few(alive), source["doc_id"] == F.col("node"), "left_semi")
    some = _few(repeated)
    once = chosen.join(some, F.col("doc_id") == F.col("copy"), "left_anti")
    more = chosen.join(some, F.col("doc_id") == F.col("copy"), "left_semi").dropDuplicates(["doc_id"])
    sets = stored(_sets(once.unionByName(more), size))

    stars_found = stored(_verified(_star_pairs(sets, stars, percent), sets, percent))
    first = components(stars_found)
    rest = _verified(_cross_candidates(_prefixes(sets, percent, levels), first, sets, percent), sets, percent)
    roots = components(stars_found.union(rest))

    named = classes.join(roots, "node", "left").select("k1", "k2", F.coalesce("root", "node").alias("component_id"))
    joined = narrow.join(named, ["k1", "k2"], "left")
    return joined.select(
        "doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")
    )


def one_of_each(docs: DataFrame, found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that name their component; of rows with one id, one stays.

    ``found`` comes from ``jaccard_components(docs)``. Rows without id stay.
    """
    counts = found.where("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("copies"))
    name = fresh(docs.columns, "_kept_id")
    key = counts.withColumnRenamed("doc_id", name)
    once = docs.join(key.where("copies = 1"), docs[id_col] == F.col(name), "left_semi")
    more = docs.join(key.where("copies > 1"), docs[id_col] == F.col(name), "left_semi").dropDuplicates([id_col])
    return once.unionByName(more).unionByName(docs.where(F.col(id_col).isNull()))
