"""Tail probabilities as column expressions: nothing leaves the JVM.

Spark has neither a gamma nor a beta function. The logarithm of gamma is
Stirling's series after a shift of its argument; the regularised incomplete beta
function is its continued fraction, evaluated by a fold over a fixed number of
steps (enough for parameters up to some thousands).
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = ["beta_regularized", "f_upper_tail", "log_gamma", "normal_two_sided_p", "t_two_sided"]

# --- fixed values: shift and coefficients of Stirling's series, steps of the fraction, its smallest divisor ---
SHIFT = 8
STIRLING = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188, -691 / 360360)
STEPS = 300
TINY = 1e-300
FAR = 12.0  # standard deviations beyond which a normal tail is 0 here
# --- end of fixed values ---


def log_gamma(x: Column) -> Column:
    """ln gamma(x) for x > 0."""
    z = x + SHIFT
    series = reduce(lambda s, c: s / (z * z) + c, reversed(STIRLING), F.lit(0.0)) / z
    passed = reduce(lambda a, b: a * b, [x + i for i in range(SHIFT)])
    return (z - 0.5) * F.ln(z) - z + math.log(2 * math.pi) / 2 + series - F.ln(passed)


def _fraction(x: Column, a: Column, b: Column) -> Column:
    """Continued fraction of the incomplete beta function, by the modified Lentz rule."""
    safe = lambda v: F.when(F.abs(v) < TINY, F.lit(TINY)).otherwise(v)

    def turn(state: Column, term: Column) -> Column:
        d = 1 / safe(1 + term * state["d"])
        c = safe(1 + term / state["c"])
        return F.struct(c.alias("c"), d.alias("d"), (state["h"] * d * c).alias("h"))

    def step(state: Column, m: Column) -> Column:
        m = m.cast("double")
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        # the inner fold makes each state once, however often its fields are used
        return F.aggregate(F.array(even, odd), state, turn)

    first = 1 / safe(1 - (a + b) * x / (a + 1))
    start = F.struct(F.lit(1.0).alias("c"), first.alias("d"), first.alias("h"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, step, lambda s: s["h"])


def beta_regularized(x: Column, a: Column, b: Column) -> Column:
    """I_x(a, b) for a, b > 0 and x in [0, 1]; null in, null out."""
    x, a, b = (c.cast("double") for c in (x, a, b))
    inside = (x > 0) & (x < 1)
    front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.ln(x) + b * F.ln(1 - x))
    # the fraction converges fast on the side of the mean where x lies; beyond it the complement does
    low = x < (a + 1) / (a + b + 2)
    value = F.when(low, front * _fraction(x, a, b) / a).otherwise(1 - front * _fraction(1 - x, b, a) / b)
    return F.when(inside, F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0))).when(x <= 0, F.lit(0.0)).when(x >= 1, F.lit(1.0))


def f_upper_tail(f: Column, d1: Column, d2: Column) -> Column:
    """P(F >= f) of the F distribution with d1 and d2 degrees of freedom; null where one of them is not positive."""
    f, d1, d2 = (c.cast("double") for c in (f, d1, d2))
    return F.when((d1 > 0) & (d2 > 0), F.when(f <= 0, F.lit(1.0)).otherwise(
        beta_regularized(d2 / (d2 + d1 * f), d2 / 2, d1 / 2)))


def normal_two_sided_p(z: Column) -> Column:
    """P(|Z| >= |z|) of the normal distribution, to about 1e-15: one less the series of the lower incomplete gamma function."""
    x = z * z / 2
    step = lambda s, n: F.struct((s["sum"] + s["term"] * x / (n + 0.5)).alias("sum"), (s["term"] * x / (n + 0.5)).alias("term"))
    start = F.struct(F.lit(2.0).alias("sum"), F.lit(2.0).alias("term"))
    series = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, step, lambda s: s["sum"])
    inside = 1 - series * F.exp(-x) * F.sqrt(x) / math.sqrt(math.pi)
    return F.when(F.abs(z) >= FAR, F.lit(0.0)).otherwise(F.greatest(inside, F.lit(0.0)))


def t_two_sided(t: Column, dof: Column) -> Column:
    """P(|T| >= |t|) of Student's distribution."""
    t, dof = t.cast("double"), dof.cast("double")
    return F.when(dof > 0, beta_regularized(dof / (dof + t * t), dof / 2, F.lit(0.5)))
