"""Column functions shared by the operators."""

from ledgerlight.functions.numeric import exact, half_even, money, ratio, rounded, share_pct
from ledgerlight.functions.text import fold, strip_fences, tokens

__all__ = ["exact", "half_even", "money", "ratio", "rounded", "share_pct", "fold", "strip_fences", "tokens"]
