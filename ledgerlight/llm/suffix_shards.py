"""Benchmark decontamination over suffix arrays of the training text.

Each task cuts its documents into shards of a bounded number of words and sorts the
suffixes of a shard. Every suffix of every test item is then looked up by binary search:
once for the range of training suffixes that share its window, once for the longest
verbatim match. Words are coded by the vocabulary of the test items, and a suffix whose
first words hold one outside it is left out, since no window can start there.

Test items are read in blocks of a bounded number of words; each block is broadcast and
takes one pass over the documents. Nothing else is shuffled or gathered.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlight.llm.common import fresh, mapped, utf8

# A-Z to a-z; everything but letters, digits and bytes over 127 to a space.
TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256)
)
MATCH = "array<struct<item_id:string,item_start:long,doc_start:long,words:long>>"


def words_in(text: bytes | None) -> list[bytes]:
    return text.translate(TABLE).split() if text else []


@dataclass(frozen=True)
class Block:
    """Coded test items: ``codes`` of all of them with a 0 behind each."""

    vocabulary: dict[bytes, int]
    codes: np.ndarray
    starts: np.ndarray  # of the suffixes that hold a whole window
    window: np.ndarray  # its length, for each suffix
    rest: np.ndarray  # words up to the item's end
    item: np.ndarray  # index into names
    offset: np.ndarray  # place in the item
    names: list[str]

    @property
    def pack(self) -> int:
        return 4 if len(self.vocabulary) < (1 << 15) - 1 else 2


def coded(items: list[tuple[str, list[bytes]]], window: int) -> Block:
    vocabulary: dict[bytes, int] = {}
    codes, starts, sizes, rest, item, offset = [], [], [], [], [], []
    for k, (_, words) in enumerate(items):
        w = min(window, len(words))
        for p in range(len(words) - w + 1) if w else ():
            starts.append(len(codes) + p)
            sizes.append(w)
            rest.append(len(words) - p)
            item.append(k)
            offset.append(p)
        codes += [vocabulary.setdefault(x, len(vocabulary) + 1) for x in words] + [0]
    as_array = lambda x: np.array(x, dtype=np.int64)
    return Block(
        vocabulary, as_array(codes), as_array(starts), as_array(sizes), as_array(rest), as_array(item), as_array(offset),
        [n for n, _ in items],
    )


def _packs(codes: np.ndarray, pack: int) -> np.ndarray:
    """For each position, its next ``pack`` codes as one number in word order."""
    bits = np.int64(15 if pack == 4 else 31)
    padded = np.concatenate([codes, np.zeros(pack, dtype=np.int64)])
    out = np.zeros(len(codes), dtype=np.int64)
    for k in range(pack):
        out = (out << bits) | padded[k : k + len(codes)]
    return out


def suffix_array(packs: np.ndarray, starts: np.ndarray, pack: int, depth: int) -> np.ndarray:
    """``starts`` in the order of their suffixes, compared over at least ``depth`` words."""
    order = starts
    group = np.zeros(len(order), dtype=np.int64)
    open_ = np.arange(len(order))  # places whose suffixes are not told apart yet
    for d in range(0, depth, pack):
        if not len(open_):
            break
        at = order[open_] + d
        key = np.where(at < len(packs), packs[np.minimum(at, len(packs) - 1)], 0)
        sort = np.lexsort((key, group[open_]))
        order[open_], key, own = order[open_][sort], key[sort], group[open_][sort]
        new = np.ones(len(open_) + 1, dtype=bool)
        new[1:-1] = (own[1:] != own[:-1]) | (key[1:] != key[:-1])
        first = open_[np.maximum.accumulate(np.where(new[:-1], np.arange(len(open_)), 0))]
        group[open_] = first
        open_ = open_[~(new[:-1] & new[1:])]
    return order


def _compare(packs: np.ndarray, at: np.ndarray, own: np.ndarray, start: np.ndarray, length: np.ndarray, pack: int):
    """Sign of training suffix against test suffix over ``length`` words, and how many agree."""
    bits = 15 if pack == 4 else 31
    sign = np.zeros(len(at), dtype=np.int64)
    same = length.copy()
    live = np.arange(len(at))
    d = 0
    while len(live):
        live = live[length[live] > d]
        if not len(live):
            break
        a, b = at[live] + d, start[live] + d
        x = np.where(a < len(packs), packs[np.minimum(a, len(packs) - 1)], 0)
        y = np.where(b < len(own), own[np.minimum(b, len(own) - 1)], 0)
        left = np.minimum(length[live] - d, pack)
        drop = (pack - left) * bits
        x, y = x >> drop, y >> drop
        differ = x != y
        if differ.any():
            who = live[differ]
            sign[who] = np.where(x[differ] < y[differ], -1, 1)
            agree = np.zeros(len(who), dtype=np.int64)
            xs, ys, many = x[differ], y[differ], left[differ]
            going = np.ones(len(who), dtype=bool)
            for k in range(pack):
                down = np.maximum(many - 1 - k, 0) * bits
                going &= (k < many) & ((xs >> down) == (ys >> down))
                agree += going
            same[who] = d + agree
        live = live[~differ]
        d += pack
    return sign, same


def _bound(packs, order, own, start, length, pack, upper: bool) -> np.ndarray:
    """First place in ``order`` whose suffix is not before (``upper``: is after) the test suffix."""
    lo = np.zeros(len(start), dtype=np.int64)
    hi = np.full(len(start), len(order), dtype=np.int64)
    while True:
        live = np.flatnonzero(lo < hi)
        if not len(live):
            return lo
        mid = (lo[live] + hi[live]) // 2
        sign, _ = _compare(packs, order[mid], own, start[live], length[live], pack)
        right = sign <= 0 if upper else sign < 0
        lo[live[right]] = mid[right] + 1
        hi[live[~right]] = mid[~right]


def _look_up(codes: np.ndarray, block: Block):
    """Occurrences of windows in a coded shard: suffix index, position, and longest match there."""
    none = np.empty(0, dtype=np.int64)
    if not len(block.starts) or not len(codes):
        return none, none, none
    least = int(block.window.min())
    zeros = np.concatenate([[0], np.cumsum(codes == 0)])
    room = len(codes) - least + 1
    starts = np.flatnonzero(zeros[least : least + room] == zeros[:room]) if room > 0 else none
    if not len(starts):
        return none, none, none
    pack = block.pack
    packs, own = _packs(codes, pack), _packs(block.codes, pack)
    order = suffix_array(packs, starts, pack, int(block.rest.max()))
    lo = _bound(packs, order, own, block.starts, block.window, pack, upper=False)
    hi = _bound(packs, order, own, block.starts, block.window, pack, upper=True)
    counts = hi - lo
    which = np.repeat(np.arange(len(counts)), counts)
    place = np.repeat(lo, counts) + np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts)
    at = order[place]
    _, same = _compare(packs, at, own, block.starts[which], block.rest[which], pack)
    return which, at, same


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def _shard(texts: list[list[bytes]], block: Block) -> dict[int, dict]:
    """Hits of the documents of one shard, by their place in it."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    begins = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]
    codes = np.zeros(int((sizes + 1).sum()), dtype=np.int64)
    get = block.vocabulary.get
    for b, words in zip(begins.tolist(), texts):
        codes[b : b + len(words)] = np.fromiter(map(get, words, repeat(0)), dtype=np.int64, count=len(words))
    which, at, same = _look_up(codes, block)
    found: dict[int, dict] = {}
    doc = np.searchsorted(begins, at, side="right") - 1
    item, offset, window = block.item[which], block.offset[which], block.window[which]
    test_at = block.starts[which]
    # the longest match at a place is reported once, where it cannot grow to the left
    grows = (offset > 0) & (at > 0) & (codes[np.maximum(at - 1, 0)] == block.codes[np.maximum(test_at - 1, 0)])
    columns = (doc, item, offset, at - begins[doc], window, same, grows)
    for d, i, o, p, w, s, g in zip(*(c.tolist() for c in columns)):
        hit = found.setdefault(d, {"items": set(), "matches": [], "spans": set()})
        hit["items"].add(block.names[i])
        hit["spans"].add((p, p + w))
        if not g:
            hit["matches"].append((block.names[i], o, p, s))
    return found


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, window: int, block_words: int) -> Iterator[Block]:
    rows, held = [], 0
    for name, text in benchmark.select(F.col(id_col).cast("string"), F.col(text_col).cast("string")).toLocalIterator():
        words = words_in((text or "").encode())
        rows.append((name or "", words))
        held += len(words)
        if held >= block_words:
            yield coded(rows, window)
            rows, held = [], 0
    yield coded(rows, window)


def contamination(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
    window: int = 10, shard_words: int = 1_000_000, block_words: int = 500_000, carry: list[str] | None = None,
) -> DataFrame:
    """The columns ``carry`` (all by default) of every row of ``docs``, with the struct ``found``.

    ``found`` holds n_words, n_hit (words inside an occurrence of a window of ``window``
    words, or of a whole shorter item), items (sorted names of the items met), matches
    (longest verbatim matches: item, place in it, place in the document, words) and
    hit_spans. Null and empty texts have no words; an item without words meets nothing,
    one without name is called by the empty text, and items of one name count once.
    Repeated rows are kept. A column called ``found`` is replaced.
    """
    spark = docs.sparkSession
    carry = [c for c in (docs.columns if carry is None else carry) if c.lower() != "found"]
    own = fresh(carry, "_text_")
    out = docs.select(*carry, F.col(text_col).alias(own), F.lit(None).cast(f"struct<{_fields()}>").alias("found"))
    for block in _blocks(benchmark, item_col, item_text, window, block_words):
        out = _pass(out, own, spark.sparkContext.broadcast(block), shard_words)
    return out.drop(own)


def _fields() -> str:
    return ",".join(c.strip().replace(" ", ":", 1) for c in (
        "n_words long", "n_hit long", "items array<string>", f"matches {MATCH}",
        "hit_spans array<struct<start:long,stop:long>>",
    ))


def _pass(docs: DataFrame, text_col: str, block, shard_words: int) -> DataFrame:
    at, own = docs.columns.index(text_col), docs.columns.index("found")
    schema: T.StructType = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            before, first, held, texts = batch.column(own).to_pylist(), 0, 0, []
            for k, text in enumerate(utf8(batch.column(at))):
                texts.append(words_in(text))
                held += len(texts[-1])
                if held >= shard_words or k + 1 == batch.num_rows:
                    hits = _shard(texts, block.value)
                    part = batch.slice(first, len(texts))
                    results = [_result(len(t), hits.get(j), before[first + j]) for j, t in enumerate(texts)]
                    columns = list(part.columns)
                    columns[own] = pa.array(results, part.schema.field(own).type)
                    yield pa.RecordBatch.from_arrays(columns, schema=part.schema)
                    first, held, texts = k + 1, 0, []

    return mapped(docs, run, schema)


def _result(n_words: int, hit: dict | None, before: dict | None) -> dict:
    if hit is None and before is not None:
        return before
    hit = hit or {"items": set(), "matches": [], "spans": set()}
    old = before or {"items": [], "matches": [], "hit_spans": []}
    spans = _merge([*hit["spans"], *((s["start"], s["stop"]) for s in old["hit_spans"])])
    matches = [dict(zip(("item_id", "item_start", "doc_start", "words"), m)) for m in hit["matches"]]
    return {
        "n_words": n_words, "n_hit": sum(b - a for a, b in spans), "items": sorted({*hit["items"], *old["items"]}),
        "matches": sorted([*old["matches"], *matches], key=lambda m: (m["doc_start"], m["item_id"], m["item_start"])),
        "hit_spans": [{"start": a, "stop": b} for a, b in spans],
    }


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` without any hit, with all their own columns, one called ``found`` too."""
    clash = [c for c in docs.columns if c.lower() == "found"]
    aside = {c: fresh(docs.columns, "_own_found_") for c in clash}
    found = contamination(docs.withColumnsRenamed(aside) if aside else docs, benchmark, **options)
    return found.where("found.n_hit = 0").select(*[F.col(aside[c]).alias(c) if c in aside else F.col(c) for c in docs.columns])
