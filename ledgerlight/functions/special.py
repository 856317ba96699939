"""Regularised incomplete gamma and beta as column expressions, and what statistics needs of them.

Series and continued fractions run as ``aggregate`` over a fixed number of steps, so a p-value
is one more column: no Python worker and no call from the driver. Parameters may differ a row.
"""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

STEPS = 600  # terms of a series or fraction; enough for parameters up to about 50,000
TINY = 1e-300
# Coefficients of Stirling's series, 1/12, -1/360 and so on.
STIRLING = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188, -691 / 360360)
SHIFT = 12


def ln_gamma(x: Column) -> Column:
    """Logarithm of the gamma function for x > 0, by Stirling's series beyond ``SHIFT``."""
    x = x.cast("double")
    far = x + SHIFT
    series, power = F.lit(0.0), far
    for c in STIRLING:
        series, power = series + F.lit(c) / power, power * far * far
    below = F.lit(0.0)
    for k in range(SHIFT):
        below = below + F.ln(x + k)
    return (far - 0.5) * F.ln(far) - far + 0.9189385332046727 + series - below


def _steps(n: int) -> Column:
    return F.sequence(F.lit(1), F.lit(n))


def gamma_q(a: Column, x: Column, steps: int = STEPS) -> Column:
    """Upper regularised incomplete gamma: 1 for x <= 0, null where an argument is null."""
    a, x = a.cast("double"), x.cast("double")
    front = F.exp(a * F.ln(F.greatest(x, F.lit(TINY))) - x - ln_gamma(a))
    first = F.struct((1 / a).alias("term"), F.lit(0.0).alias("total"))
    series = F.aggregate(_steps(steps), first, lambda s, n: F.struct(
        (s["term"] * x / (a + n)).alias("term"), (s["total"] + s["term"]).alias("total")
    ), lambda s: s["total"])
    b0 = x + 1 - a
    # c and d of the last step are multiplied in one step later, so that each is computed once
    start = F.struct((b0 + 1 / TINY).alias("c"), (1 / (b0 + TINY)).alias("d"), F.lit(TINY).alias("h"))

    def fraction(s: Column, n: Column) -> Column:
        an, b = n * (a - n), b0 + 2 * n
        return F.struct(
            (b + an / s["c"] + TINY).alias("c"), (1 / (an * s["d"] + b + TINY)).alias("d"), (s["h"] * s["c"] * s["d"]).alias("h")
        )

    tail = F.aggregate(_steps(steps), start, fraction, lambda s: s["h"] * s["c"] * s["d"])
    return F.when(x <= 0, F.when(a.isNotNull(), F.lit(1.0))).when(x < a + 1, F.greatest(F.lit(0.0), 1 - front * series)).otherwise(front * tail)


def beta_i(a: Column, b: Column, x: Column, steps: int = STEPS) -> Column:
    """Regularised incomplete beta, 0 for x <= 0 and 1 for x >= 1."""
    a, b, x = a.cast("double"), b.cast("double"), x.cast("double")
    turned = x > (a + 1) / (a + b + 2)  # the fraction converges fast on the other side
    p, q, y = F.when(turned, b).otherwise(a), F.when(turned, a).otherwise(b), F.when(turned, 1 - x).otherwise(x)
    inside, outside = F.greatest(F.least(y, F.lit(1.0)), F.lit(TINY)), F.greatest(1 - y, F.lit(TINY))
    front = F.exp(ln_gamma(a + b) - ln_gamma(a) - ln_gamma(b) + p * F.ln(inside) + q * F.ln(outside)) / p
    given = F.struct(p.alias("p"), q.alias("q"), y.alias("y"))
    start = F.struct(
        F.lit(1.0).alias("c"), (1 / (1 - (p + q) * y / (p + 1) + TINY)).alias("d"), F.lit(1.0).alias("h"), given.alias("g")
    )

    def fraction(s: Column, k: Column) -> Column:
        g, m = s["g"], F.floor(k / 2).cast("double")  # steps 2 m and 2 m + 1 of the fraction
        p, q, y = g["p"], g["q"], g["y"]
        top = F.when(k % 2 == 0, m * (q - m)).otherwise(-(p + m) * (p + q + m))
        coefficient = top * y / ((p + k - 1) * (p + k))
        return F.struct(
            (1 + coefficient / s["c"] + TINY).alias("c"), (1 / (1 + coefficient * s["d"] + TINY)).alias("d"),
            (s["h"] * s["c"] * s["d"]).alias("h"), g.alias("g"),
        )

    half = F.aggregate(F.sequence(F.lit(2), F.lit(2 * steps + 1)), start, fraction, lambda s: s["h"] * s["c"] * s["d"])
    value = front * half
    return F.when(x <= 0, F.lit(0.0)).when(x >= 1, F.lit(1.0)).otherwise(F.when(turned, 1 - value).otherwise(value))


def chi2_tail(x: Column, df: Column) -> Column:
    """Probability that a chi-square variable with ``df`` degrees exceeds ``x``."""
    return gamma_q(df / 2, x / 2)


def t_tails(t: Column, df: Column, steps: int = STEPS) -> Column:
    """Two-sided p-value of Student's t."""
    v = df.cast("double")
    return 1 - beta_i(F.lit(0.5), v / 2, t * t / (v + t * t), steps)


def t_quantile(tails: float, df: Column, rounds: int = 14, steps: int = 100) -> Column:
    """The t whose two tails hold ``tails`` together; null without degrees of freedom.

    Newton's steps from an expansion around the normal quantile. The tail falls and bends
    upward, so they close in from below.
    """
    v = df.cast("double")
    z = NormalDist().inv_cdf(1 - tails / 2)
    first = z + (z**3 + z) / (4 * v) + (5 * z**5 + 16 * z**3 + 3 * z) / (96 * v * v)
    scale = F.exp(ln_gamma((v + 1) / 2) - ln_gamma(v / 2)) / F.sqrt(v * math.pi)

    def step(s: Column, _: Column) -> Column:
        t = s["t"]
        slope = 2 * s["scale"] * F.pow(1 + t * t / s["v"], -(s["v"] + 1) / 2)
        return F.struct((t + (t_tails(t, s["v"], steps) - tails) / slope).alias("t"), s["v"].alias("v"), s["scale"].alias("scale"))

    start = F.struct(first.alias("t"), v.alias("v"), scale.alias("scale"))
    return F.when(v > 0, F.aggregate(_steps(rounds), start, step, lambda s: s["t"]))
