"""Format-preserving pseudonyms for personal numbers, dates, addresses and secrets.

A value is found by pattern, checked by its own rule (Luhn and mod-97 digits, octet
ranges, the calendar, number plans) and replaced by a keyed permutation of the values of
its format: a Feistel network over mixed-radix positions, walked along its cycle until
the rule holds again. Values longer than a block are permuted block by block, chained in
both directions, so length costs time in proportion and every block depends on all others.
Equal values get equal pseudonyms in every document and spelling
(separators and letter case are kept, not permuted); without the key nothing is
reversible, with it ``reveal`` gives the text back.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import math
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ledgerlight.llm.common import fresh, mapped

ROUNDS = 10
BLOCK = 128  # positions permuted together
DIGITS, LETTERS, HEX = "0123456789", "abcdefghijklmnopqrstuvwxyz", "0123456789abcdef"
FIRST_DAY, DAYS = dt.date(1900, 1, 1).toordinal(), 73_049  # up to the end of 2099


class Feistel:
    """Keyed permutation of 0..size-1; ``tweak`` separates the formats."""

    def __init__(self, key: bytes, tweak: str, size: int):
        self.key, self.tweak, self.size = hashlib.blake2b(key).digest(), tweak.encode(), size
        self.left = max(1, _root(size))
        self.right = -(-size // self.left)
        # bytes of a round: 64, or as many as a half of more than 448 bits needs
        self.width = max(64, self.right.bit_length() // 8 + 9) if self.right.bit_length() > 448 else 64

    def _round(self, k: int, value: int) -> int:
        if self.width > 64:
            data = b"".join(n.to_bytes(2 * self.width, "big") for n in (k, self.size, value)) + self.tweak
            return int.from_bytes(hashlib.shake_256(self.key + data).digest(self.width), "big")
        data = b"%d|%d|%d|" % (k, self.size, value) + self.tweak
        return int.from_bytes(hashlib.blake2b(data, key=self.key, digest_size=64).digest(), "big")

    def _step(self, x: int, back: bool) -> int:
        left, right = divmod(x, self.right)
        sign = -1 if back else 1
        for k in reversed(range(ROUNDS)) if back else range(ROUNDS):
            if k % 2:
                right = (right + sign * self._round(k, left)) % self.right
            else:
                left = (left + sign * self._round(k, right)) % self.left
        return left * self.right + right

    def apply(self, x: int, back: bool = False, valid: Callable[[int], bool] = lambda _: True) -> int:
        """Image of ``x``; walks on while it lies outside the domain or breaks the rule."""
        while True:
            x = self._step(x, back)
            if x < self.size and valid(x):
                return x


def _root(n: int) -> int:
    x = 1 << (-(-n.bit_length() // 2))
    while x * x > n:
        x = (x + n // x) // 2
    return x


@lru_cache(maxsize=4096)
def _feistel(key: bytes, tweak: str, size: int) -> Feistel:
    return Feistel(key, tweak, size)


def _alphabets(text: str, letters: str = LETTERS) -> list[str]:
    """The characters that may stand at each position; separators stay."""
    return [DIGITS if c in DIGITS else letters if c.lower() in letters else c for c in text]


def permuted(
    text: str, key: bytes, kind: str, back: bool = False, alphabets: list[str] | None = None,
    valid: Callable[[str], bool] = lambda _: True,
) -> str:
    """``text`` with each position permuted inside its alphabet, letter case kept."""
    sets = alphabets or _alphabets(text)
    low = [c.lower() for c in text]
    places = [(k, s) for k, s in enumerate(sets) if len(s) > 1 and low[k] in s]
    if not places:
        return text
    if len(places) > BLOCK:
        return _chained(text, key, kind, back, places, valid)
    size, x = 1, 0
    for k, s in places:
        size, x = size * len(s), x * len(s) + s.index(low[k])

    def spelled(value: int) -> str:
        out = list(text)
        for k, s in reversed(places):
            value, at = divmod(value, len(s))
            out[k] = s[at].upper() if text[k].isupper() else s[at]
        return "".join(out)

    tweak = kind + ":" + ",".join(str(len(s)) for _, s in places)
    return spelled(_feistel(key, tweak, size).apply(x, back, lambda v: valid(spelled(v))))


def _chained(
    text: str, key: bytes, kind: str, back: bool, places: list[tuple[int, str]], valid: Callable[[str], bool]
) -> str:
    """``permuted`` for more than BLOCK positions: one pass over the blocks and one in reverse.

    The tweak of a block holds a digest of all blocks done before it in the same pass.
    """
    count = -(-len(places) // BLOCK)
    cuts = [len(places) * k // count for k in range(count + 1)]
    blocks = [[len(s) for _, s in places[a:b]] for a, b in zip(cuts, cuts[1:])]
    sizes = [math.prod(b) for b in blocks]
    values = []
    for a, b in zip(cuts, cuts[1:]):
        x = 0
        for k, s in places[a:b]:
            x = x * len(s) + s.index(text[k].lower())
        values.append(x)

    def run(values: list[int], turn: int) -> list[int]:
        """Both ways the chain runs over the permuted side, in the order of the forward pass."""
        out = list(values)
        state = hashlib.blake2b(f"{kind}|{turn}|{blocks}".encode()).hexdigest()
        for k in range(count) if turn == 0 else reversed(range(count)):
            out[k] = Feistel(key, f"{kind}:{state}", sizes[k]).apply(values[k], back)
            known = values[k] if back else out[k]
            state = hashlib.blake2b(f"{state}|{known:x}".encode()).hexdigest()
        return out

    while True:
        for turn in (1, 0) if back else (0, 1):
            values = run(values, turn)
        out = list(text)
        for x, a, b in zip(values, cuts, cuts[1:]):
            for k, s in reversed(places[a:b]):
                x, at = divmod(x, len(s))
                out[k] = s[at].upper() if text[k].isupper() else s[at]
        done = "".join(out)
        if valid(done):
            return done


def luhn_digit(payload: str) -> str:
    total = 0
    for k, c in enumerate(reversed(payload)):
        d = int(c) * (1 if k % 2 else 2)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def _refill(pattern: str, digits: str) -> str:
    left = iter(digits)
    return "".join(next(left) if c in DIGITS else c for c in pattern)


def _card(text: str, key: bytes, back: bool) -> str | None:
    digits = "".join(c for c in text if c in DIGITS)
    if not 13 <= len(digits) <= 19 or digits[0] == "0" or luhn_digit(digits[:-1]) != digits[-1]:
        return None
    body = digits[0] + permuted(digits[1:-1], key, "card" + digits[0], back)
    return _refill(text, body + luhn_digit(body))


def _mod97(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text)) % 97


def _iban(text: str, key: bytes, back: bool) -> str | None:
    plain = text.replace(" ", "")
    if not 15 <= len(plain) <= 34 or _mod97(plain[4:] + plain[:4]) != 1:
        return None
    body = permuted(plain[4:], key, "iban" + plain[:2], back)
    chars = iter(plain[:2] + f"{98 - _mod97(body + plain[:2] + '00'):02d}" + body)
    return "".join(c if c == " " else next(chars) for c in text)


def _address(text: str, key: bytes, back: bool) -> str | None:
    octets = text.split(".")
    if any(int(o) > 255 or (len(o) > 1 and o[0] == "0") for o in octets):
        return None
    value = int.from_bytes(bytes(map(int, octets)), "big")
    return ".".join(map(str, _feistel(key, "address", 1 << 32).apply(value, back).to_bytes(4, "big")))


def _social(text: str, key: bytes, back: bool) -> str | None:
    def valid(s: str) -> bool:
        return s[:3] not in ("000", "666") and s[0] != "9" and s[4:6] != "00" and s[7:] != "0000"

    return permuted(text, key, "social", back, valid=valid) if valid(text) else None


def _phone(text: str, key: bytes, back: bool) -> str | None:
    at = [k for k, c in enumerate(text) if c in DIGITS]
    if not 8 <= len(at) <= 15:
        return None
    sets = list(text)
    for k in at[-10:]:
        sets[k] = DIGITS
    for k in (at[-10], at[-7]) if len(at) >= 10 else ():
        sets[k] = "23456789" if text[k] in "23456789" else "01"
    if len(at) < 10:
        sets[at[0]] = text[at[0]]
    return permuted(text, key, "phone", back, sets)


DATE_ORDERS = {"iso": "ymd", "day": "dmy", "month": "mdy"}


def _date(text: str, key: bytes, back: bool) -> str | None:
    parts = re.split(r"([-/.])", text)
    numbers = [int(p) for p in parts[::2]]
    orders = ("ymd",) if len(parts[0]) == 4 else ("dmy",) if parts[1] == "." else ("mdy", "dmy")
    for order in orders:
        got = dict(zip(order, numbers))
        try:
            day = dt.date(got["y"], got["m"], got["d"]).toordinal() - FIRST_DAY
        except ValueError:
            continue
        if not 0 <= day < DAYS:
            return None

        def fits(value: int, order: str = order) -> bool:
            # a day-month text stays one: it must not read as month-day
            return order == "mdy" or len(orders) == 1 or dt.date.fromordinal(value + FIRST_DAY).day > 12

        new = dt.date.fromordinal(_feistel(key, "date", DAYS).apply(day, back, fits) + FIRST_DAY)
        value = {"y": f"{new.year:04d}", "m": f"{new.month:02d}", "d": f"{new.day:02d}"}
        return parts[1].join(value[c] for c in order)
    return None


def _email(text: str, key: bytes, back: bool) -> str | None:
    name, _, host = text.partition("@")
    return permuted(name, key, "email@" + host.lower(), back) + "@" + host


def _secret(text: str, key: bytes, back: bool) -> str | None:
    def hexed(s: str) -> bool:
        return all(c in HEX for c in s.lower())

    if hexed(text):
        return permuted(text, key, "hex", back, [HEX] * len(text))
    return permuted(text, key, "secret", back, valid=lambda s: not hexed(s))  # never reads as hex


def _access_key(text: str, key: bytes, back: bool) -> str | None:
    sets = list(text[:4]) + [DIGITS + LETTERS] * (len(text) - 4)
    return permuted(text[:4] + text[4:].lower(), key, "access", back, sets).upper()


# In order of precedence; a span taken by an earlier kind is not looked at again.
KINDS: tuple[tuple[str, re.Pattern, Callable[[str, bytes, bool], str | None]], ...] = (
    ("email", re.compile(r"(?<![\w.+-])[\w.+-]++@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63})*\.[A-Za-z]{2,24}"), _email),
    ("secret", re.compile(r"(?i)(?<![a-z])(?:password|passwd|secret|token|api[_-]?key)\s{0,3}[=:]\s{0,3}[\"']?([A-Za-z0-9+/_=.-]{5,}[A-Za-z0-9+/_=-])"), _secret),
    ("secret", re.compile(r"(?<![A-Za-z0-9])(AKIA[A-Z0-9]{16})(?![A-Za-z0-9])"), _access_key),
    ("secret", re.compile(r"(?<![A-Za-z0-9])((?=[0-9]*[a-fA-F])(?=[a-fA-F]*[0-9])[0-9a-fA-F]{32,})(?![A-Za-z0-9])"), _secret),
    ("iban", re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?(?![A-Za-z0-9])"), _iban),
    ("date", re.compile(r"(?<![\w./-])(?:[0-9]{4}([-/.])[0-9]{2}\1[0-9]{2}|[0-9]{2}([-/.])[0-9]{2}\2[0-9]{4})(?![\w/-])"), _date),
    ("address", re.compile(r"(?<![\w.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\w|\.\w)"), _address),
    ("card", re.compile(r"(?<![\w.+-])[0-9](?:[ -]?[0-9]){12,18}(?![\w-])"), _card),
    ("social", re.compile(r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])"), _social),
    ("phone", re.compile(r"(?<![\w.+-])(?<![0-9][ -])(?:\+[0-9]{1,3}[ .-]?)?\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![\w-])(?! ?[0-9])"), _phone),
    ("phone", re.compile(r"(?<![\w.+-])\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,5}(?![\w-])"), _phone),
)
LABELLED = KINDS[1][1]
NAMES = tuple(dict.fromkeys(k for k, _, _ in KINDS))
DIGIT = re.compile("[0-9]")
LABELS = ("password", "passwd", "secret", "token", "api")


def _candidates(text: str) -> list[bool]:
    """For each of KINDS, whether ``text`` can hold a value of it at all."""
    digit = DIGIT.search(text) is not None
    low = text.lower()
    needs = ["@" in text, any(w in low for w in LABELS), "AKIA" in text]
    return needs + [digit] * (len(KINDS) - len(needs))


def replace(text: str, key: bytes, back: bool = False) -> tuple[str, dict[str, int]]:
    """Text with every valid value replaced, and the number of replacements by kind."""
    taken: list[tuple[int, int, str]] = []  # apart from each other and in order
    counts: dict[str, int] = {}
    for (kind, pattern, change), possible in zip(KINDS, _candidates(text)):
        new: list[tuple[int, int, str]] = []
        for m in pattern.finditer(text) if possible else ():
            group = 1 if kind == "secret" else 0
            start, stop = m.span(group)
            met, k = [], bisect_right(taken, start, key=lambda span: span[1])
            while k < len(taken) and taken[k][0] < stop:
                met.append(taken[k][:2])
                k += 1
            if met and pattern is LABELLED:
                # the rest of a labelled run beside an address found in it stays no clear text
                edges = [start, *[max(start, min(e, stop)) for span in met for e in span], stop]
                rest = [(a, b) for a, b in zip(edges[::2], edges[1::2]) if a < b]
                new += [(a, b, _secret(text[a:b], key, back)) for a, b in rest]
                counts[kind] = counts.get(kind, 0) + bool(rest)
            if met:
                continue
            value = change(m.group(group), key, back)
            if value is not None:
                new.append((start, stop, value))
                counts[kind] = counts.get(kind, 0) + 1
        if new:
            taken = sorted(taken + new)
    if not taken:
        return text, counts
    out, at = [], 0
    for start, stop, value in taken:
        out += [text[at:start], value]
        at = stop
    return "".join(out) + text[at:], counts


def pseudonymise(docs: DataFrame, key: bytes, text_col: str = "text", back: bool = False) -> DataFrame:
    """``docs`` with ``text_col`` replaced and one count column ``n_<kind>`` a kind.

    Row by row, without a shuffle. A null text stays null and counts nothing; all other
    columns stay as they are, and a count column whose name is taken gets a trailing
    underscore. Repeated rows give repeated rows; an empty table stays empty.
    """
    names = {}
    for kind in NAMES:
        names[kind] = fresh([*docs.columns, *names.values()], f"n_{kind}")
    at = docs.columns.index(text_col)
    schema = T.StructType([*docs.schema.fields, *[T.StructField(n, T.LongType()) for n in names.values()]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [(None, {}) if t is None else replace(t, key, back) for t in batch.column(at).to_pylist()]
            columns = list(batch.columns)
            columns[at] = pa.array([t for t, _ in done], batch.schema.field(at).type)
            columns += [pa.array([c.get(k, 0) for _, c in done], pa.int64()) for k in NAMES]
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema.fields])

    return mapped(docs, run, schema)


def reveal(docs: DataFrame, key: bytes, text_col: str = "text") -> DataFrame:
    """The texts before ``pseudonymise`` with the same key; rows and columns as given."""
    return pseudonymise(docs, key, text_col, back=True).select(*docs.columns)
