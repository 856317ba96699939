"""Text column helpers."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

def _letters() -> tuple[str, str]:
    """Every small letter with marks whose Unicode decomposition starts with a-z, and that letter."""
    found = {"đ": "d"}
    for point in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        base, *marks = unicodedata.normalize("NFD", chr(point).lower())
        if "a" <= base <= "z" and marks and all(unicodedata.category(m) == "Mn" for m in marks):
            found[chr(point).lower()[0]] = base
    found.pop("i", None)
    return "".join(found), "".join(found.values())


_FROM, _TO = _letters()
# Fixed value: the fences that a model writes around code.
FENCE = r"```(?:json|python|sql)?\s*|\s*```"


def fold(text: Column) -> Column:
    """Lower case without accents, composed or not; đ becomes d. Plain ASCII text skips the letter map."""
    lower = F.lower(text)
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, lower).otherwise(F.regexp_replace(F.translate(lower, _FROM, _TO), r"\p{M}+", ""))


def tokens(text: Column) -> Column:
    """Distinct runs of a-z and 0-9 after folding; snake_case is split."""
    return F.array_remove(F.array_distinct(F.split(fold(text), "[^a-z0-9]+")), "")


def strip_fences(text: Column) -> Column:
    """Remove Markdown code fences and outer white space."""
    return F.regexp_replace(F.regexp_replace(text, FENCE, ""), r"^\s+|\s+$", "")
