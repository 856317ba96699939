"""Periodic runs of words in whole texts, by an online sparse dynamic program over diagonals.

A run with period q matches itself q words earlier, so it is a stretch of matches on the
diagonal of lag q. A stretch that makes a run has at least ``max(12 - q, q) >= 6`` matches,
hence the table is kept sparse by starting a diagonal only where six words in a row have
occurred before. Words are read once from left to right: every earlier occurrence of the six
words that start at a word lengthens the match of its lag, and a lag that no longer matches
ends its diagonal, which emits a run at once if the match is long enough. Multiples of a
period end together with it and on the same words, so the smallest lag names the run.

In a text whose few distinct words repeat without end, the occurrences alone grow with the
square of the text. Where they exceed PAIRS_PER_WORD a word, the same stretches are found
level by level instead: for lags from g to 2g every stretch covers a word whose number is a
multiple of g, and its ends come from exact ranks of word runs of doubling length. Time there
is n * log(n)**2, the result is the same.

Words are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlight.llm.common import mapped, utf8, window_hashes, word_hashes, words_of

LEAST = 12  # words of the shortest run
SEED = 6  # matches that any run has in a row
PAIRS_PER_WORD = 64
ANCHORS = 1 << 20  # pairs of a word and a lag in one step of the levels
SCHEMA = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"

Run = tuple[int, int, int]  # first word, words, period


def _closed(active: dict[int, int], last: int, out: list[Run]) -> None:
    """Emit what the diagonals that end with the six words from ``last`` on make of runs."""
    best: dict[int, int] = {}
    for lag, first in active.items():
        match = last + SEED - first
        if match >= lag and match + lag >= LEAST:
            start = first - lag
            best[start] = min(lag, best.get(start, lag))
    out += [(start, last + SEED - start, lag) for start, lag in best.items()]


def _diagonals(at: np.ndarray, which: np.ndarray) -> list[Run]:
    """Runs from the places ``at`` of six-word windows that occur more than once, by window number."""
    out: list[Run] = []
    earlier: dict[int, list[int]] = {}
    active: dict[int, int] = {}  # lag: first word of its match
    before = -2
    for i, window in zip(at.tolist(), which.tolist()):
        if i != before + 1 and active:
            _closed(active, before, out)
            active = {}
        places = earlier.setdefault(window, [])
        now = {i - j: active.pop(i - j, i) for j in places}
        if active:
            _closed(active, before, out)
        active, before = now, i
        places.append(i)
    _closed(active, before, out)
    return out


def _ranks(hashes: np.ndarray) -> list[np.ndarray]:
    """For each k, a number for the 2**k words from each word on; equal numbers mean equal words."""
    ranks = [np.unique(hashes, return_inverse=True)[1].astype(np.int64)]
    size = 1
    while 2 * size <= len(hashes):
        last = ranks[-1]
        pair = last[: len(last) - size] * (int(last.max()) + 1) + last[size:]
        ranks.append(np.unique(pair, return_inverse=True)[1].astype(np.int64))
        size *= 2
    return ranks


def _matched(ranks: list[np.ndarray], a: np.ndarray, lag: np.ndarray, forward: bool) -> np.ndarray:
    """Words that match at ``lag`` from word ``a`` on, or up to the word before it."""
    n, total = len(ranks[0]), np.zeros(len(a), dtype=np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        step = 1 << k
        here = a + total if forward else a - total - step
        ok = np.flatnonzero((here + step <= n) & (here - lag >= 0))
        same = ok[ranks[k][here[ok]] == ranks[k][here[ok] - lag[ok]]]
        total[same] += step
    return total


def _levels(hashes: np.ndarray) -> list[Run]:
    ranks, n, found = _ranks(hashes), len(hashes), {}
    g = 1
    while 2 * g <= n:
        lags = np.arange(g, min(2 * g, n // 2 + 1))
        anchors = np.arange(g, n, g)
        step = max(1, ANCHORS // len(lags))
        for at in range(0, len(anchors), step):
            a = np.repeat(anchors[at : at + step], len(lags))
            lag = np.tile(lags, len(a) // len(lags))
            keep = a >= lag
            keep[keep] = ranks[0][a[keep]] == ranks[0][a[keep] - lag[keep]]
            a, lag = a[keep], lag[keep]
            after, ahead = _matched(ranks, a, lag, True), _matched(ranks, a, lag, False)
            match = after + ahead
            good = (match >= lag) & (match + lag >= LEAST)
            spans = np.unique(np.stack([a[good] - ahead[good] - lag[good], a[good] + after[good], lag[good]], 1), axis=0)
            for start, end, period in spans.tolist():
                found[start, end] = min(period, found.get((start, end), period))
        g *= 2
    return [(start, end - start, period) for (start, end), period in found.items()]


def runs_of(words: list[bytes]) -> list[Run]:
    """All maximal runs ``(start, length, period)``, by start and period."""
    if len(words) < LEAST:
        return []
    hashes = word_hashes(words)
    windows = window_hashes(hashes, SEED)
    order = np.argsort(windows, kind="stable")
    ranked = windows[order]
    new = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    group = np.cumsum(new) - 1
    counts = np.bincount(group)
    if counts.max() == 1:
        return []
    if int((counts * (counts - 1) // 2).sum()) > PAIRS_PER_WORD * len(words):
        runs = _levels(hashes)
    else:
        which = np.empty(len(windows), dtype=np.int64)
        which[order] = group
        at = np.flatnonzero(counts[which] > 1)
        runs = _diagonals(at, which[at])
    return sorted(runs, key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words without those that any run holds after its first period."""
    if not runs:
        return words
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]


def periodic_runs(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    rewrite: Callable[[int | None, list[bytes]], list[bytes]] | None = None,
) -> DataFrame:
    """``(doc_id, n_words, runs, collapsed)``, one row a document row.

    A run is a stretch of consecutive words with smallest period q (words q apart are equal)
    and at least ``max(12, 2 * q)`` words that no neighbouring word extends. ``runs`` holds
    (start, length, period) by start and period; ``collapsed`` joins by one space the words
    that no run holds after its first q words. ``rewrite`` may change the words of a document
    first. Null, empty and white texts have no words, no runs and an empty ``collapsed``.
    Texts are read whole, whatever their length; repeated rows and rows without id give a row
    each. An empty table gives no rows, other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), utf8(batch.column(1))
            for at in range(0, len(texts), 256):
                part, counts, runs, left = ids.slice(at, 256), [], [], []
                for key, text in zip(part.to_pylist(), texts[at : at + 256]):
                    words = words_of(text)
                    if rewrite:
                        words = rewrite(key, words)
                    found = runs_of(words)
                    counts.append(len(words))
                    runs.append([{"start": s, "length": n, "period": q} for s, n, q in found])
                    left.append(b" ".join(collapsed(words, found)))
                kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
                yield pa.RecordBatch.from_arrays(
                    [part, pa.array(counts, pa.int64()), pa.array(runs, kind), pa.array(left, pa.binary()).cast(pa.string())],
                    names=["doc_id", "n_words", "runs", "collapsed"],
                )

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return mapped(chosen, run, SCHEMA)
