"""Document quality by naive Bayes support vectors.

Every text becomes a set of hashed n-gram indicators: runs of one to three bytes, runs of one
or two words, runs of three to five kinds of bytes (small letter, capital, digit, mark, space),
which see marks glued to any word, and whether a word stands twice, three or four times in a row. Class counts of all training rows give each indicator its
log-count ratio; indicators scaled by that ratio, at unit length, feed a linear
hinge-loss model fitted by dual coordinate descent. The counts come from all labelled
training rows; the descent sees at most ``fit_rows`` of them, chosen by a hash of the
text, so it stays in one small task at every size. A logistic curve fitted to the
margins turns them into scores from 0 to 1.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlight.llm.common import STEPS, fresh, mapped, mixed, utf8, word_hashes

BITS = 17
DIM = 1 << BITS


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # hinge weight times log-count ratio
    ratio: np.ndarray
    bias: float
    slope: float
    shift: float


# Buckets of the runs of one and two bytes.
_BUCKETS_1 = (mixed(np.arange(1 << 8, dtype=np.uint64) + np.uint64(1 << 40)) >> np.uint64(64 - BITS)).astype(np.int64)
_BUCKETS_2 = (mixed(np.arange(1 << 16, dtype=np.uint64) + np.uint64(2 << 40)) >> np.uint64(64 - BITS)).astype(np.int64)


# Kinds of bytes; those of letters beyond ASCII count as small letters.
_KIND = np.full(256, 3, dtype=np.int64)
_KIND[ord("a") : ord("z") + 1] = _KIND[128:] = 0
_KIND[ord("A") : ord("Z") + 1] = 1
_KIND[ord("0") : ord("9") + 1] = 2
_KIND[[9, 10, 11, 12, 13, 32]] = 4
_SHAPES = [(mixed(np.arange(5**n, dtype=np.uint64) + np.uint64(n << 50)) >> np.uint64(64 - BITS)).astype(np.int64) for n in (3, 4, 5)]


def indicators(text: bytes | None) -> np.ndarray:
    """Sorted distinct n-gram buckets of a text; empty for an empty or null text."""
    if not text:
        return np.empty(0, dtype=np.int64)
    out = np.zeros(DIM, dtype=bool)
    b = np.frombuffer(text, dtype=np.uint8)
    out[_BUCKETS_1[b]] = True
    if len(b) > 1:
        two = (b[:-1].astype(np.uint32) << np.uint32(8)) | b[1:]
        out[_BUCKETS_2[two]] = True
        three = (two[:-1] << np.uint32(8)) | b[2:]
        out[(three * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)] = True
    kind = _KIND[b]
    run = kind[:-1] * 5 + kind[1:]
    for n, buckets in zip((3, 4, 5), _SHAPES):
        if len(kind) < n:
            break
        run = run[:-1] * 5 + kind[n - 1 :]
        out[buckets[run]] = True
    words = word_hashes(text.split())
    shift = np.uint64(64 - BITS)
    out[words >> shift] = True
    out[(words[:-1] * STEPS[1] + words[1:] * STEPS[2]) >> shift] = True
    same = words[1:] == words[:-1]
    for n in (1, 2, 3):  # runs of n + 1 equal words, whatever the word
        if not same.any():
            break
        out[n] = True
        same = same[1:] & same[:-1]
    return np.flatnonzero(out)


def log_count_ratios(train: DataFrame, text_col: str, label_col: str, smoothing: float = 1.0) -> np.ndarray:
    """Log ratio of each indicator's share in class 1 and class 0, over all rows.

    Each task counts for itself, Spark adds the counts up; at most ``DIM`` rows come back.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, DIM), dtype=np.int64)
        for batch in batches:
            for text, label in zip(utf8(batch.column(0)), batch.column(1).to_pylist()):
                seen[int(label)][indicators(text)] += 1
        at = np.flatnonzero(seen.any(axis=0))
        yield pa.RecordBatch.from_arrays(
            [pa.array(at), pa.array(seen[0][at]), pa.array(seen[1][at])], names=["feature", "bad", "good"]
        )

    counts = mapped(train.select(text_col, label_col), count, "feature long, bad long, good long")
    total = counts.groupBy("feature").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).toArrow()
    both = np.full((2, DIM), smoothing)
    at = total.column("feature").to_numpy()
    both[0][at] += total.column("bad").to_numpy()
    both[1][at] += total.column("good").to_numpy()
    return np.log(both[1] / both[1].sum()) - np.log(both[0] / both[0].sum())


def descend(
    rows: list[np.ndarray], labels: np.ndarray, ratio: np.ndarray, cost: float, epochs: int, seed: int = 7
) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the hinge loss on unit-length scaled indicators."""
    values = []
    for idx in rows:
        v = ratio[idx]
        values.append(v / (np.sqrt(v @ v + 1.0)))
    ones = [1.0 / np.sqrt(ratio[i] @ ratio[i] + 1.0) for i in rows]
    norms = np.array([v @ v + o * o for v, o in zip(values, ones)])
    alpha, w, bias = np.zeros(len(rows)), np.zeros(len(ratio)), 0.0
    share = labels.mean() if len(labels) else 0.5
    # each class carries half of the total cost
    limit = np.where(labels > 0, cost * 0.5 / max(share, 1e-9), cost * 0.5 / max(1 - share, 1e-9))
    sign = np.where(labels > 0, 1.0, -1.0)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            idx, v = rows[i], values[i]
            slack = sign[i] * (w[idx] @ v + bias * ones[i]) - 1.0
            new = min(max(alpha[i] - slack / norms[i], 0.0), limit[i])
            step = (new - alpha[i]) * sign[i]
            if step:
                alpha[i] = new
                w[idx] += step * v
                bias += step * ones[i]
                moved = max(moved, abs(step))
        if moved < 1e-3 * cost:
            break
    return w, bias


def _margin(idx: np.ndarray, weights: np.ndarray, ratio: np.ndarray, bias: float) -> float:
    v = ratio[idx]
    return (weights[idx].sum() + bias) / np.sqrt(v @ v + 1.0)


def _curve(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve of the labels over the margins, by Newton steps."""
    good, bad = labels.sum(), len(labels) - labels.sum()
    target = np.where(labels > 0, (good + 1) / (good + 2), 1 / (bad + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        g = np.array([(target - p) @ margins - 1e-6 * a, (target - p).sum()])
        h = p * (1 - p)
        hess = np.array([[h @ margins**2 + 1e-3, h @ margins], [h @ margins, h.sum() + 1e-3]])
        step = np.linalg.solve(hess, g)
        a, b = a + np.clip(step[0], -5, 5), b + np.clip(step[1], -5, 5)
        if abs(step).max() < 1e-6:
            break
    return max(a, 1e-3), b


def fit(
    train: DataFrame, text_col: str = "text", label_col: str = "quality", fit_rows: int = 5_000,
    cost: float = 8.0, epochs: int = 8,
) -> Model:
    """Model of ``label_col`` (0 or 1; other rows are left out) from ``text_col`` alone.

    Log-count ratios cover all rows. The descent uses ``fit_rows`` different texts, those with
    the smallest hashes, a bounded sample by design; a cut on the hash leaves about twice as many
    before they are sorted, however many tasks there are. Without rows of both classes the
    model scores every text alike, with the share of class 1.
    """
    rows = train.select(F.col(text_col).alias("t"), F.col(label_col).cast("int").alias("y")).where("y in (0, 1)")
    ratio = log_count_ratios(rows, "t", "y")
    keyed = rows.withColumn("h", F.xxhash64(F.coalesce("t", F.lit(""))))
    place = F.pmod(F.xxhash64("h", F.lit(5)), F.lit(1 << 30))
    share = 2 * fit_rows / max(1, keyed.agg(F.approx_count_distinct("h")).first()[0])
    few = keyed if share >= 1 else keyed.where(place < int(share * (1 << 30)))
    each = few.groupBy("h", "y").agg(F.first("t").alias("t"))
    sample = each.orderBy(place, "h", "y").limit(fit_rows).select("t", "y")

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, labels = [], []
        for batch in batches:
            found += [indicators(t) for t in utf8(batch.column(0))]
            labels += batch.column(1).to_pylist()
        y = np.array(labels, dtype=np.float64)
        if len(y) and 0 < y.mean() < 1:
            w, bias = descend(found, y, ratio, cost, epochs)
            scaled = w * ratio
            slope, shift = _curve(np.array([_margin(i, scaled, ratio, bias) for i in found]), y)
        else:
            share = (y.sum() + 1) / (len(y) + 2)
            scaled, bias, slope, shift = np.zeros(DIM), 0.0, 1.0, float(np.log(share / (1 - share)))
        yield pa.RecordBatch.from_arrays(
            [pa.array([x.tobytes()], pa.binary()) for x in (scaled, np.array([bias, slope, shift]))], names=["w", "c"]
        )

    got = mapped(sample.repartition(1), learn, "w binary, c binary").toArrow()
    if not got.num_rows:
        return Model(np.zeros(DIM), ratio, 0.0, 1.0, 0.0)
    bias, slope, shift = np.frombuffer(got.column("c")[0].as_py())
    return Model(np.frombuffer(got.column("w")[0].as_py()), ratio, float(bias), float(slope), float(shift))


def scores(docs: DataFrame, model: Model, text_col: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the column ``name``: how likely class 1 is, between 0 and 1.

    The weights (two vectors of ``DIM`` numbers) are broadcast, whatever the corpus. An
    empty or null text has no indicators and gets the score of the bias. No shuffle; all
    columns stay, and a taken ``name`` gets a trailing underscore. An empty table stays
    empty; repeated rows get equal scores.
    """
    name = fresh(docs.columns, name)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)
    schema = docs.withColumn(name, F.lit(0.0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            margins = np.array([_margin(indicators(t), m.weights, m.ratio, m.bias) for t in utf8(batch.column(at))])
            p = 1 / (1 + np.exp(-np.clip(m.slope * margins + m.shift, -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p, pa.float64())], names=schema.names)

    return mapped(docs, run, schema)
