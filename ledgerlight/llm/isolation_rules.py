"""Quality rules with an isolation forest over rule statistics.

Each text gives exact counts. Documents that fail a base rule go; the others are judged
by the length of their paths through a forest of random splits: odd documents are cut
off early. Every tree sees ``tree_rows`` rows, as the method asks, chosen by a hash among
the documents labelled good (all documents, where none is). Splits fall at random into
the box that a node has of the range of all documents, not of the rows it holds: rows
that are odd in one statistic are common here (a tenth of the corpus), and splits inside
the sampled range hide them behind each other. The threshold comes from all labelled
rows, whose scores are counted by label in bins.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlight.llm.common import mapped, stored

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOLS = "#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
EXTRA = ("n_upper", "n_distinct", "n_runs")
FEATURES = tuple(f"share_{k}" for k in range(7))
BINS = 2_000


def rule_counts(text: str | None, window: int = 5) -> tuple[int, ...]:
    """The counts of ``COUNTS`` and ``EXTRA`` for one text; all 0 for null or empty."""
    if not text:
        return (0,) * (len(COUNTS) + len(EXTRA))
    words = WORD.findall(text)
    n = len(words)
    seen: set[str] = set()
    again = 0
    for line in text.split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    repeated = 0
    if n >= window + 1:
        grams = list(zip(*(words[k:] for k in range(window))))
        if len(set(grams)) < len(grams):
            counts = Counter(grams)
            covered = np.zeros(n + 1, dtype=np.int64)
            at = np.flatnonzero(np.fromiter((counts[g] > 1 for g in grams), dtype=bool, count=len(grams)))
            np.add.at(covered, at, 1)
            np.add.at(covered, at + window, -1)
            repeated = int((np.cumsum(covered)[:n] > 0).sum())
    runs = sum(map(str.__eq__, words[1:], words[:-1]))
    upper = sum(map(str.isupper, words))
    return (
        n, sum(map(len, words)), sum(map(text.count, SYMBOLS)), again, repeated, upper, len(set(words)), runs,
    )


def counted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    names = ["doc_id", *COUNTS, *EXTRA]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(zip(*map(rule_counts, batch.column(1).to_pylist()))) or [[]] * (len(names) - 1)
            columns = [batch.column(0), *[pa.array(c, pa.int64()) for c in rows]]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    source = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    return mapped(source, run, ", ".join(f"{n} long" for n in names))


def with_features(counts: DataFrame) -> DataFrame:
    """Adds the columns ``FEATURES``: shares on scales on which small ones still differ."""
    words = F.greatest(F.col("n_words"), F.lit(1))

    def root(name: str) -> Column:
        return F.sqrt(F.col(name) / words)

    values = (
        F.log1p(F.col("word_chars") / words), root("n_symbols"), root("n_dup_lines"), F.col("n_repeat_words") / words,
        root("n_upper"), root("n_runs"), F.log1p("n_distinct") / F.log1p(words),
    )
    return counts.withColumns(dict(zip(FEATURES, values)))


@dataclass(frozen=True)
class Forest:
    """Trees as arrays: split feature (-1 at a leaf), split value, left child, path length at a leaf."""

    feature: np.ndarray
    value: np.ndarray
    child: np.ndarray
    length: np.ndarray
    expected: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        """2 ** (-mean path length / expected length): near 1 for odd rows."""
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for f, v, c, h in zip(self.feature, self.value, self.child, self.length):
            node = np.zeros(len(x), dtype=np.int64)
            while True:
                at = f[node]
                inner = at >= 0
                if not inner.any():
                    break
                right = x[rows, np.maximum(at, 0)] >= v[node]
                node = np.where(inner, c[node] + right, node)
            total += h[node]
        return 2.0 ** (-(total / max(len(self.feature), 1)) / self.expected)


def _harmonic_path(n: int) -> float:
    """Mean path length of a failed search among n rows."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2.0 * (np.log(n - 1.0) + np.euler_gamma) - 2.0 * (n - 1.0) / n


def grow(samples: list[np.ndarray], low: np.ndarray, high: np.ndarray, limit: int = 16, seed: int = 11) -> Forest:
    """One tree for each sample of rows; cuts are uniform in a node's box of (``low``, ``high``)."""
    rng = np.random.default_rng(seed)
    wide = np.flatnonzero(high > low)
    trees = []
    for x in samples:
        feature, value, child, length = [-1], [0.0], [0], [0.0]
        open_ = [(0, x, 0, low, high)]
        while open_:
            node, rows, depth, start, stop = open_.pop()
            if depth >= limit or len(rows) <= 1 or not len(wide):
                length[node] = depth + _harmonic_path(len(rows))
                continue
            f = int(rng.choice(wide))
            cut = rng.uniform(start[f], stop[f])
            feature[node], value[node], child[node] = f, cut, len(feature)
            for right in (False, True):
                ends = (start.copy(), stop.copy())
                ends[0 if right else 1][f] = cut
                open_.append((len(feature), rows[(rows[:, f] >= cut) == right], depth + 1, *ends))
                feature.append(-1)
                value.append(0.0)
                child.append(0)
                length.append(0.0)
        trees.append((feature, value, child, length))
    width = max((len(t[0]) for t in trees), default=1)
    arrays = [
        np.array([list(t[k]) + [pad] * (width - len(t[k])) for t in trees], dtype=kind)
        for k, (kind, pad) in enumerate(((np.int64, -1), (np.float64, 0.0), (np.int64, 0), (np.float64, 0.0)))
    ]
    size = int(np.median([len(x) for x in samples])) if samples else 2
    return Forest(*arrays, max(_harmonic_path(size), 1.0))


def _matrix(table: pa.Table | pa.RecordBatch) -> np.ndarray:
    columns = (table.column(n).to_pandas() for n in FEATURES)
    return np.stack([np.asarray(c, dtype=np.float64) for c in columns], axis=1)


def smallest(df: DataFrame, wanted: int) -> np.ndarray:
    """The ``wanted`` rows with the smallest hashes as a matrix of ``FEATURES``, repeated rows as often as they occur.

    Only rows under a cut on the hash, about twice as many as wanted, are grouped and sorted,
    so what the last task reads depends neither on the number of tasks nor on that of
    repeated rows. A cut that leaves too few is widened.
    """
    hashed = df.select(*FEATURES, F.xxhash64("doc_id", *COUNTS, *EXTRA).alias("h"))
    share = 2 * wanted / max(1, hashed.agg(F.approx_count_distinct("h")).first()[0])
    while True:
        few = hashed if share >= 1 else hashed.where(F.col("h") < int(share * (1 << 64)) - (1 << 63))
        each = few.groupBy("h", *FEATURES).agg(F.count("*").alias("n"))
        got = each.orderBy("h", *FEATURES).limit(wanted).toArrow()
        if share >= 1 or got.num_rows == wanted:
            return np.repeat(_matrix(got), np.minimum(got.column("n").to_numpy(), wanted), axis=0)[:wanted]
        share *= 4


def train(rows: DataFrame, good: DataFrame, trees: int = 100, tree_rows: int = 256) -> Forest:
    """Forest of ``good`` rows, or of ``rows`` where there are none, over the range of ``rows``.

    Its ``trees * tree_rows`` rows are those with the smallest hashes, a bounded sample by design.
    """
    ends = rows.agg(*[f(n).alias(f"{k}{n}") for k, f in (("a", F.min), ("z", F.max)) for n in FEATURES]).first()
    if ends[0] is None:
        return grow([], np.zeros(len(FEATURES)), np.ones(len(FEATURES)))
    x = smallest(good, trees * tree_rows)
    if not len(x):
        x = smallest(rows, trees * tree_rows)
    deal = np.random.default_rng(5).permutation(len(x))
    samples = [x[deal[k::trees]] for k in range(trees) if len(deal[k::trees])]
    return grow(samples, np.array(ends[: len(FEATURES)]), np.array(ends[len(FEATURES) :]))


def scored(rows: DataFrame, forest: Forest) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(forest)
    schema = rows.withColumn("oddness", F.lit(0.0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            odd = shared.value.scores(_matrix(batch))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(odd, pa.float64())], names=schema.names)

    return mapped(rows, run, schema)


def threshold(judged: DataFrame, keep_good: float = 0.99) -> float:
    """Oddness beyond which a document goes, from all rows of ``judged`` with a label ``y``.

    Among the cuts that keep at least ``keep_good`` of the good rows, the one with the
    largest share of bad rows beyond it less five times that of good ones; of equals the
    highest. Without good rows nothing goes.
    """
    bins = F.least(F.floor(F.col("oddness") * BINS), F.lit(BINS - 1)).alias("bin")
    rows = judged.where("y is not null").groupBy("y", bins).count().collect()
    table = np.zeros((2, BINS))
    for y, b, n in rows:
        table[y, int(b)] += n
    beyond = table[:, ::-1].cumsum(axis=1)[:, ::-1]  # rows in this bin or above
    share = beyond / np.maximum(table.sum(axis=1, keepdims=True), 1)
    fine = np.flatnonzero(share[1] <= 1 - keep_good)
    if not table[1].sum() or not len(fine):
        return 1.0
    gain = (share[0] - 5 * share[1])[fine]
    best = fine[np.flatnonzero(gain >= gain.max() - 1e-12)[-1]]
    return float(best) / BINS if share[0][best] > 0 else 1.0


def judge(
    docs: DataFrame, labels: DataFrame, trees: int = 100, tree_rows: int = 256, keep_good: float = 0.99,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Counts, ``base_failed``, ``oddness`` and ``kept`` for every row of ``docs``.

    A null or empty text has no words and fails the base rules. Repeated rows get equal
    verdicts; a document labelled both ways counts as bad; a row without id has no label. Empty tables give
    no rows. Other columns are ignored.
    """
    counts = stored(counted(docs, id_col, text_col))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    known = labels.where("quality in (0, 1)").groupBy(F.col("doc_id").alias("_id")).agg(F.min("quality").cast("int").alias("y"))
    rows = with_features(counts).withColumn("base_failed", failed)
    rows = stored(rows.join(known, F.col("doc_id") == F.col("_id"), "left").drop("_id"))
    passed = rows.where(~F.col("base_failed"))
    judged = stored(scored(rows, train(passed, passed.where("y = 1"), trees, tree_rows)))
    cut = threshold(judged.where(~F.col("base_failed")), keep_good)
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("oddness") < cut)).drop("y", *FEATURES)
