"""Order-preserving packing of documents into fixed token windows.

Documents keep the order in which their partition holds them. A dynamic program over
the cut points (document ends, sentence ends and, inside sentences longer than
``LONG_SENTENCE`` ids, every ``LONG_SENTENCE`` ids) chooses the windows with the least
padding plus cut penalties. The cheapest predecessor inside the sliding window of one
sequence length comes from a monotone queue, so the work is linear in the cut points.

Nothing is shuffled: each partition packs its rows in blocks of a bounded number of ids,
and only the pieces leave the task. A lost task reads its split again and gives the same
sequences.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlight.llm.common import mapped, utf8

PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
)
LONG_SENTENCE = 256
CACHED_CHUNKS = 500_000
CACHED_PIECES = 300_000
_chunks: dict[str, dict[bytes, bytes]] = {}
_pieces: dict[str, dict[str, bytes]] = {}


@lru_cache(maxsize=4)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=4)
def _sentence_ends(path: str) -> np.ndarray:
    """For each id, whether its token closes a sentence."""
    vocab = _tokenizer(path).get_vocab()
    flags = np.zeros(max(vocab.values()) + 1, dtype=bool)
    for token, i in vocab.items():
        core = token.removesuffix("</w>")
        flags[i] = bool(core) and not core.strip(".!?") and token.endswith("</w>")
    return flags


PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
# The tokenizer's rule for pieces, for plain chunks in lower case.
PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")


def _byte_letters() -> dict[int, str]:
    """Latin-1 characters to the letters that stand for their UTF-8 bytes in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letter = {b: chr(b) for b in shown}
    letter |= {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in letter)}
    return {c: "".join(letter[b] for b in chr(c).encode()) for c in range(33, 256)}


BYTE_LETTERS = _byte_letters()


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def _encode_chunks(path: str, chunks: list[bytes]) -> list[bytes]:
    """Ids of chunks without white space. Plain ones go piece by piece, so that words with other
    marks or capitals share the work; all others through the whole tokenizer."""
    tokenizer, pieces = _tokenizer(path), _pieces.setdefault(path, {})
    if len(pieces) > CACHED_PIECES:
        pieces.clear()
    model, out, rest = tokenizer.model, [b""] * len(chunks), []
    for k, chunk in enumerate(chunks):
        text = chunk.decode("utf-8", "replace")
        if len(text) > 64 or "<|" in text or not PLAIN.fullmatch(text):
            rest.append((k, text))
            continue
        if text.isascii() and text.isalpha():  # one piece, whose letters stand for themselves
            word = text.lower()
            ids = pieces.get(word)
            if ids is None:
                ids = pieces[word] = _packed([t.id for t in model.tokenize(word)])
            out[k] = ids
            continue
        found = []
        for piece in PIECE.findall(text.lower()):
            ids = pieces.get(piece)
            if ids is None:
                ids = _packed([t.id for t in model.tokenize(piece.translate(BYTE_LETTERS))])
                pieces[piece] = ids
            found.append(ids)
        out[k] = b"".join(found)
    encoded = tokenizer.encode_batch_fast([t for _, t in rest], add_special_tokens=False)
    for (k, _), e in zip(rest, encoded):
        out[k] = _packed(e.ids)
    return out


def encode_words(path: str, texts: list[bytes]) -> list[bytes]:
    """Ids of each text as little-endian 32-bit values.

    The tokenizer treats what stands between ASCII white space on its own, so each
    distinct chunk is encoded once and remembered; the memory is bounded.
    """
    cache = _chunks.setdefault(path, {})
    if len(cache) > CACHED_CHUNKS:
        cache.clear()
    split = [t.split() for t in texts]
    found = [list(map(cache.get, ws)) for ws in split]  # one look-up a word
    missing, gaps = {}, []
    for ws, parts in zip(split, found):
        at = -1
        for _ in range(parts.count(None)):
            at = parts.index(None, at + 1)
            missing[ws[at]] = parts[at] = b""
            gaps.append((parts, at, ws[at]))
    cache.update(zip(missing, _encode_chunks(path, list(missing))))
    for parts, at, word in gaps:
        parts[at] = cache[word]
    return [b"".join(parts) for parts in found]


def cut_points(ids: np.ndarray, sentence_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions inside one document where a window may end, and whether each lies inside a sentence."""
    n = len(ids)
    ends = np.flatnonzero(sentence_end[ids[:-1]]) + 1 if n > 1 else np.empty(0, dtype=np.int64)
    ends = np.append(ends[ends < n], n)
    gaps = np.diff(ends, prepend=0)
    if (gaps > LONG_SENTENCE).any():
        extra = [np.arange(e - g + LONG_SENTENCE, e, LONG_SENTENCE) for e, g in zip(ends, gaps) if g > LONG_SENTENCE]
        inner = np.concatenate(extra)
        every = np.concatenate([ends, inner])
        kind = np.concatenate([np.zeros(len(ends), dtype=bool), np.ones(len(inner), dtype=bool)])
        order = np.argsort(every, kind="stable")
        return every[order], kind[order]
    return ends, np.zeros(len(ends), dtype=bool)


def best_cuts(points: np.ndarray, penalty: np.ndarray, limit: int) -> list[int]:
    """Indices of the chosen cut points; the last point always closes a window.

    ``points`` grow and no gap passes ``limit``. The cost of a window is its padding
    plus the penalty of the point that closes it; ties go to the earliest start.
    """
    n = len(points)
    position = points.tolist()
    extra = penalty.tolist()
    back = [-1] * n
    queue: deque[tuple[float, int, int]] = deque([(0.0, 0, -1)])  # cost + position, position, index
    for i in range(n):
        here = position[i]
        while queue[0][1] < here - limit:
            queue.popleft()
        best, _, j = queue[0]
        back[i] = j
        reach = best + limit + extra[i]  # cost up to here plus the position
        while queue and queue[-1][0] > reach:
            queue.pop()
        queue.append((reach, here, i))
    cuts, i = [], n - 1
    while i >= 0:
        cuts.append(i)
        i = back[i]
    return cuts[::-1]


class _Packer:
    def __init__(self, partition: int, limit: int, inside_document: float, inside_sentence: float):
        self.limit, self.inside_document, self.inside_sentence = limit, inside_document, inside_sentence
        self.sequence = partition << 33
        self.held: list[tuple[int | None, bytes, np.ndarray, np.ndarray, int]] = []
        self.size = 0

    def add(self, doc_id: int | None, data: bytes, ends: np.ndarray, inner: np.ndarray) -> None:
        self.held.append((doc_id, data, ends, inner, self.size))
        self.size += len(data) // 4

    def flush(self) -> list[tuple]:
        """Pack what is held."""
        if not self.held:
            return []
        points = np.concatenate([ends + at for _, _, ends, _, at in self.held])
        penalty = np.concatenate([np.where(inner, self.inside_sentence, self.inside_document) for *_, inner, _ in self.held])
        closing = np.cumsum([len(h[2]) for h in self.held]) - 1
        penalty[closing] = 0.0
        cuts = [0, *points[best_cuts(points, penalty, self.limit)].tolist()]
        rows, k = [], 0
        for doc_id, data, _, _, at in self.held:
            total = len(data) // 4
            start = 0
            while start < total:
                while cuts[k + 1] <= at + start:
                    k += 1
                stop = min(total, cuts[k + 1] - at)
                piece = data[4 * start : 4 * stop]
                rows.append((doc_id, start, stop - start, zlib.crc32(piece), total, self.sequence + k, at + start - cuts[k]))
                start = stop
        self.sequence += len(cuts) - 1
        self.held, self.size = [], 0
        return rows


def pack(
    docs: DataFrame,
    tokenizer: str,
    limit: int = 2048,
    end_id: int = 1,
    inside_document: float = 8.0,
    inside_sentence: float = 64.0,
    block_ids: int = 1 << 19,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Pieces of every document, one row each, with their sequence and place in it.

    ``tokenizer`` is the path of a tokenizer file that every worker can open. A block
    closes after the document that takes it past ``block_ids`` ids; its last sequence is
    padded. A null or empty text is the single id ``end_id``. Repeated rows are packed
    each; a null id stays null. An empty table gives no rows. Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        flags = _sentence_ends(tokenizer)
        close = np.array([end_id], dtype="<u4").tobytes()
        packer = _Packer(TaskContext.get().partitionId(), limit, inside_document, inside_sentence)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), [t or b"" for t in utf8(batch.column(1))]
            for at in range(0, len(texts), 256):
                rows = []
                for doc_id, body in zip(ids[at : at + 256], encode_words(tokenizer, texts[at : at + 256])):
                    data = body + close
                    packer.add(doc_id, data, *cut_points(np.frombuffer(data, dtype="<u4"), flags))
                    if packer.size >= block_ids:
                        rows += packer.flush()
                if rows:
                    yield _batch(rows)
        if rows := packer.flush():
            yield _batch(rows)

    return mapped(docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")), run, PIECES)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [c.split()[0] for c in PIECES.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=names)
