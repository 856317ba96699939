"""Numeric column helpers with the library's null and rounding rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(col: Column, places: int = 2) -> Column:
    """Half-away-from-zero rounding as a double (the SQL rule).

    Rounds in decimal, so 1.005 is a tie although its binary form lies below. Numbers too
    large for the decimal have no such digits left and are rounded as doubles.
    """
    exact_form = F.round(col.try_cast("decimal(30,8)"), places).cast("double")
    return F.coalesce(exact_form, F.round(col.cast("double"), places))


def half_even(col: Column, places: int = 2) -> Column:
    """Half-to-even rounding as a double (the data-frame rule)."""
    return F.bround(col.cast("double"), places)


def exact(col: Column, places: int = 4) -> Column:
    """Decimal of a double that stands for a number of at most ``places`` decimals.

    Goes through a whole number: a direct cast prints and parses the double. Meant for the
    amount of one row, below 9e14 with four places; sums of it widen by themselves.
    """
    unit = F.lit(f"{10 ** -places:.{places}f}").cast(f"decimal({places},{places})")
    whole = F.rint(col * 10**places).cast("long").cast("decimal(18,0)")
    return (whole * unit).cast(f"decimal(18,{places})")


def money(col: Column, places: int = 2) -> Column:
    """Exact decimal rounded, then handed over as a double."""
    return F.round(col, places).cast("double")


def ratio(num: Column, den: Column) -> Column:
    """Double division; null when the denominator is zero or null."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def share_pct(part: Column, whole: Column, places: int = 2) -> Column:
    return rounded(100.0 * ratio(part, whole), places)
