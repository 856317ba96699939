"""Language-model scores from a log-frequency Bloom filter.

Word and word-pair counts of all training texts are added up by Spark. A count is
quantised to a step of a geometric scale; the filter holds, for every n-gram, its steps
from the first to its own. A count comes back by probing step after step until one is
missing, so errors only ever raise it. Every n-gram hashes into one segment of the
filter, which one task builds. Runs of segments of at most ``PART`` bytes are broadcast
each for itself; a worker gathers many tokens and probes them part after part, holding
one part at a time.

The filter has at least a bit for every ``bytes_a_bit`` bytes of training text, whatever
their number, so the rate of false steps does not grow with it. Pair and word
probabilities are mixed with fixed weights (Jelinek-Mercer smoothing).

The unigram base score uses exact counts: those of the most frequent words (a bounded
number) travel with the filter, all others come from a join by word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlight.llm.common import LONG_MASK, STEPS, long_list, lowered, mapped, mixed, stored, utf8, word_hashes

END = b"\n"  # no word can hold it
SEGMENTS = 1024  # at least; more when one would have over SEGMENT_BITS
SEGMENT_BITS = 1 << 24
PART = 1 << 26  # bytes of the filter in one broadcast
BUILT = 1 << 27  # bytes of the filter that one task builds, about
PROBES = 3
FLUSH = 1_000_000  # tokens counted together in a task
PROBED = 4_000_000  # tokens probed together in a task when there are several parts
FREQUENT = 200_000  # words whose exact counts are broadcast: 16 bytes each
# Least counts of the steps: 1, 2, 3, 4, 6, 8, 12, 16, ...
SCALE = np.array(sorted({1, *(2**k for k in range(1, 48)), *(3 * 2**k for k in range(47))}), dtype=np.int64)
SEEN = np.concatenate([[0.0], np.sqrt(SCALE[:-1] * (SCALE[1:] - 1.0)), [float(SCALE[-1])]])  # mean count of a step


def token_hashes(text: bytes | None) -> np.ndarray:
    return word_hashes([*lowered(text).split(), END])


def pair_hashes(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mixed(first * STEPS[3] + mixed(second) * STEPS[5])


def _keyed(grams: np.ndarray, order: int) -> np.ndarray:
    """n-gram keys: the lowest bit tells pairs (1) from words (0)."""
    return (grams & ~np.uint64(1)) | np.uint64(order)


def _segment(keys: np.ndarray, segments: int) -> np.ndarray:
    """Segment of each key; ``segments`` is a power of two."""
    return (mixed(keys ^ STEPS[7]) >> np.uint64(65 - segments.bit_length())).astype(np.int64)


def layout(volume: int, bytes_a_bit: float) -> tuple[int, int]:
    """Number of segments and bits of each, both powers of two, for so many bytes of text."""
    bits = 1 << int(np.ceil(np.log2(max(volume / bytes_a_bit, SEGMENTS * 64))))
    segments = max(SEGMENTS, bits // SEGMENT_BITS)
    return segments, bits // segments


def _bits(keys: np.ndarray, step: int, size: int) -> Iterator[np.ndarray]:
    """Bit positions of one step inside a segment of ``size`` bits."""
    h = mixed(keys + np.uint64(int(STEPS[9]) * (step + 1) & LONG_MASK))
    one, two = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    for k in range(PROBES):
        yield ((one + np.uint64(k) * two) & np.uint64(size - 1)).astype(np.int64)


def _joined(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts and where each text begins."""
    words, sizes = [], []
    for t in texts:
        own = lowered(t).split()
        words += own
        words.append(END)
        sizes.append(len(own) + 1)
    return word_hashes(words), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def _contexts(tokens: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """The token before each; the end mark stands before the first one."""
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[begins[:-1]] = word_hashes([END])[0]
    return before


def ngram_counts(train: DataFrame, text_col: str, segments: int = SEGMENTS) -> DataFrame:
    """``(segment, gram, n)``: partial counts, several rows an n-gram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out():
            keys, counts = np.unique(np.concatenate(held), return_counts=True)
            for at in range(0, len(keys), 500_000):
                part = keys[at : at + 500_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(_segment(part, segments).astype(np.int32)), pa.array(part.view(np.int64)), pa.array(counts[at : at + 500_000])],
                    names=["segment", "gram", "n"],
                )

        for batch in batches:
            texts = utf8(batch.column(0))
            for at in range(0, len(texts), 512):
                tokens, begins = _joined(texts[at : at + 512])
                held += [_keyed(tokens, 0), _keyed(pair_hashes(_contexts(tokens, begins), tokens), 1)]
                size += len(tokens)
                if size >= FLUSH:
                    yield from out()
                    held, size = [], 0
        if held:
            yield from out()

    return mapped(train.select(text_col), run, "segment int, gram long, n long")


def build(counts: DataFrame, size: int, segments: int = SEGMENTS) -> DataFrame:
    """Finished segments ``(segment, bits)`` beside the word counts ``(gram, n)``, in one stored table."""
    tasks = segments * (size // 8) // BUILT
    usual = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # past the usual number of tasks their number follows the filter, and each holds a bounded part of it
    dealt = counts.repartition(tasks, "segment") if tasks > usual else counts.repartition("segment")
    total = dealt.groupBy("segment", "gram").agg(F.sum("n").alias("n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segments: dict[int, np.ndarray] = {}
        for batch in batches:
            where = batch.column(0).to_numpy()
            keys = batch.column(1).to_numpy().view(np.uint64)
            n = batch.column(2).to_numpy()
            for s in np.unique(where).tolist():
                bits = segments.setdefault(s, np.zeros(size // 8, dtype=np.uint8))
                own = keys[where == s]
                top = np.searchsorted(SCALE, n[where == s], side="right")
                for step in range(int(top.max())):
                    for at in _bits(own[top > step], step, size):
                        np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
            words = (keys & np.uint64(1)) == 0
            count = int(words.sum())
            yield _row_batch([None] * count, keys[words].view(np.int64), n[words], [None] * count)
        for s in list(segments):
            yield _row_batch([s], [None], [None], [segments.pop(s).tobytes()])

    return stored(mapped(total, run, "segment int, gram long, n long, bits binary"))


def _row_batch(segment, gram, n, bits) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(segment, pa.int32()), pa.array(gram, pa.int64()), pa.array(n, pa.int64()), pa.array(bits, pa.binary())],
        names=["segment", "gram", "n", "bits"],
    )


@dataclass(frozen=True)
class Parts:
    """The filter in broadcasts: each holds the bytes of ``run`` segments that follow each other."""

    values: tuple[Broadcast, ...]
    segments: int
    run: int
    size: int  # bits of a segment

    def steps(self, keys: np.ndarray) -> np.ndarray:
        """Steps of the quantised count of each key, by repeated probes, part after part."""
        found = np.zeros(len(keys), dtype=np.uint8)
        if len(self.values) == 1:
            self._probe(self.values[0].value, keys, np.arange(len(keys)), 0, found)
            return found
        part = _segment(keys, self.segments) // self.run
        order = np.argsort(part, kind="stable")
        cuts = np.searchsorted(part[order], np.arange(len(self.values) + 1))
        for k, value in enumerate(self.values):
            if cuts[k] < cuts[k + 1]:
                self._probe(value.value, keys, order[cuts[k] : cuts[k + 1]], k * self.run, found)
                vars(value).pop("_value", None)  # read again from the local file when needed
        return found

    def _probe(self, bits: np.ndarray, keys: np.ndarray, live: np.ndarray, first: int, found: np.ndarray) -> None:
        base, step = (_segment(keys[live], self.segments) - first) * (self.size // 8), 0
        while len(live) and step < len(SCALE):
            there = np.ones(len(live), dtype=bool)
            for at in _bits(keys[live], step, self.size):
                there &= (bits[base + (at >> 3)] >> (at & 7).astype(np.uint8)) & 1 > 0
            live, base = live[there], base[there]
            found[live] += 1
            step += 1


@dataclass(frozen=True)
class Model:
    parts: Parts
    total: int  # training tokens
    distinct: int
    frequent: np.ndarray  # sorted keys of the most frequent words
    counts: np.ndarray  # their exact counts
    mix: float = 0.3  # weight of the pair, at contexts that were seen

    def steps(self, keys: np.ndarray) -> np.ndarray:
        return self.parts.steps(keys)

    def log_probabilities(self, tokens: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """log10 P(token | token before): mixed pair and add-one word probabilities.

        ``begins`` are the places where texts begin, and the end of the last one.
        """
        words, back = np.unique(_keyed(tokens, 0), return_inverse=True)
        before, last = np.empty_like(tokens), begins[1] - 1
        before[1:] = tokens[:-1]
        # an end mark stands before the first token, as it does behind the last one
        before[begins[:-1]] = tokens[last]
        keys = np.concatenate([words, _keyed(pair_hashes(before, tokens), 1)])
        found = self.steps(keys)
        word = SEEN[found[: len(words)]][back]
        # a pair occurs no oftener than its word, so a false step of a rare or unseen word goes
        pair = np.minimum(SEEN[found[len(words) :]], word)
        context = np.empty_like(word)
        context[1:] = word[:-1]
        context[begins[:-1]] = word[last]
        single = (word + 1) / (self.total + self.distinct + 1)
        weight = np.where(context > 0, self.mix, 0.0)
        follow = np.minimum(np.where(context > 0, pair / np.maximum(context, 1), 0.0), 1.0)
        return np.log10(weight * follow + (1 - weight) * single)

    def exact(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exact counts of the frequent tokens, and which tokens are not among them."""
        keys = _keyed(tokens, 0)
        if not len(self.frequent):
            return np.zeros(len(keys), dtype=np.int64), np.ones(len(keys), dtype=bool)
        at = np.minimum(np.searchsorted(self.frequent, keys), len(self.frequent) - 1)
        known = self.frequent[at] == keys
        return np.where(known, self.counts[at], 0), ~known


def _parts(table: DataFrame, segments: int, size: int) -> Parts:
    """Broadcasts of the filter; the driver gathers one of them at a time."""
    wide = size // 8
    run = min(segments, max(1, PART // wide))
    values = []
    for first in range(0, segments, run):
        bits = np.zeros(run * wide, dtype=np.uint8)
        inside = F.col("segment").between(first, first + run - 1) & F.col("bits").isNotNull()
        done = table.where(inside).select("segment", "bits").toArrow()
        for k, data in zip(done.column("segment").to_pylist(), done.column("bits")):
            bits[(k - first) * wide : (k - first + 1) * wide] = np.frombuffer(data.as_buffer(), dtype=np.uint8)
        del done
        values.append(table.sparkSession.sparkContext.broadcast(bits))
    return Parts(tuple(values), segments, run, size)


def fit(train: DataFrame, text_col: str = "text", bytes_a_bit: float = 2.0) -> tuple[Model, DataFrame]:
    """Model of all ``train`` texts, and the exact word counts ``(gram, n)``.

    Null and empty texts are one end mark. Without rows all counts are 0.
    """
    volume = train.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    segments, size = layout(volume, bytes_a_bit)
    table = build(ngram_counts(train, text_col, segments), size, segments)
    words = table.where("gram is not null").select("gram", "n")
    bins = words.groupBy(F.floor(F.log2("n") * 16).alias("b")).agg(F.count("*").alias("c"), F.sum("n").alias("s")).collect()
    total, distinct = sum(r["s"] for r in bins), sum(r["c"] for r in bins)
    room, least = FREQUENT, None
    for r in sorted(bins, key=lambda r: -r["b"]):
        if r["c"] > room:
            break
        room, least = room - r["c"], r["b"]
    keys, n = np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
    if least is not None:
        top = words.where(F.floor(F.log2("n") * 16) >= least).toArrow()
        keys, n = top.column("gram").to_numpy().view(np.uint64), top.column("n").to_numpy()
        order = np.argsort(keys)
        keys, n = keys[order], n[order]
    return Model(_parts(table, segments, size), total, distinct, keys, n), words


SCORED = (
    "row long, doc_id long, n_tokens long, n_known long, base_score double, score double, rare array<long>"
)


def _scored(docs: DataFrame, model: Model) -> DataFrame:
    several = len(model.parts.values) > 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 33
        held, size = [], 0
        for batch in batches:
            ids, texts = batch.column(0), utf8(batch.column(1))
            for at in range(0, len(texts), 512):
                tokens, begins = _joined(texts[at : at + 512])
                held.append((ids.slice(at, len(begins) - 1), tokens, begins))
                size += len(tokens)
                if not several or size >= PROBED:
                    for done in _score_rows(held, model, row):
                        yield done
                        row += done.num_rows
                    held, size = [], 0
        if held:
            yield from _score_rows(held, model, row)

    return mapped(docs, run, SCORED)


def _score_rows(held: list[tuple[pa.Array, np.ndarray, np.ndarray]], m: Model, row: int) -> Iterator[pa.RecordBatch]:
    """Scored rows of the texts ``(ids, tokens, begins)``, which are probed together."""
    sizes = [len(tokens) for _, tokens, _ in held]
    shifts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    joined = np.concatenate([begins[:-1] + shift for (_, _, begins), shift in zip(held, shifts)] + [shifts[-1:]])
    every = m.log_probabilities(np.concatenate([tokens for _, tokens, _ in held]), joined)
    norm = np.log10(float(m.total + m.distinct + 1))
    for (ids, tokens, begins), shift in zip(held, shifts):
        count, rare = m.exact(tokens)
        starts, n = begins[:-1], len(begins) - 1
        base = np.where(rare, 0.0, np.log10(count + 1.0) - norm)
        kept = _keyed(tokens, 0)
        rest = [kept[a:b][rare[a:b]].view(np.int64) for a, b in zip(starts, begins[1:])]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.arange(row, row + n)), ids, pa.array(np.diff(begins)),
                pa.array(np.add.reduceat((~rare).astype(np.int64), starts)), pa.array(np.add.reduceat(base, starts)),
                pa.array(np.add.reduceat(every[shift : shift + len(tokens)], starts)), long_list(rest),
            ],
            names=[c.split()[0] for c in SCORED.split(", ")],
        )
        row += n


def score(docs: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Scores of all rows of ``docs`` by a model of those where ``training`` holds.

    Rows ``(doc_id, n_tokens, n_known, train_tokens, base_score, score)``. Every text
    ends in an end mark, so null and empty texts have one token. Repeated rows are scored
    each; a null id stays null. Other columns are ignored.
    """
    text = F.col(text_col).cast("string").alias("text")
    model, words = fit(docs.where(training).select(text), "text", **options)
    rows = stored(_scored(docs.select(F.col(id_col).cast("long"), text), model))
    rare = rows.select("row", F.explode("rare").alias("gram")).groupBy("row", "gram").agg(F.count("*").alias("tf"))
    norm = float(np.log10(float(model.total + model.distinct + 1)))
    n = F.coalesce(F.col("n"), F.lit(0))
    sums = rare.join(words, "gram", "left").groupBy("row").agg(
        F.sum(F.col("tf") * (F.log10(n + 1) - F.lit(norm))).alias("more"),
        F.sum(F.when(n > 0, F.col("tf")).otherwise(0)).alias("met"),
    )
    return rows.drop("rare").join(sums, "row", "left").select(
        "doc_id", "n_tokens", (F.col("n_known") + F.coalesce("met", F.lit(0))).alias("n_known"),
        F.lit(model.total).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("more", F.lit(0.0))).alias("base_score"), "score",
    )
