"""Tails of the normal and Student's distribution as column expressions, for a row per test."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Terms of a series or a continued fraction, which are summed from the last one.
TERMS = 200
#: From so many degrees of freedom on, Student's tail is read off the normal one by Wallace's transformation.
NEARLY_NORMAL = 10_000


def _folded(first: Column, step) -> Column:
    """``step(value, k)`` for k from TERMS down to 1."""
    return F.aggregate(F.sequence(F.lit(TERMS), F.lit(1), F.lit(-1)), first.cast("double"), lambda f, k: step(f, k.cast("double")))


def log_gamma(x: Column) -> Column:
    """For positive x: Stirling's series eight places on."""
    y = x + 8
    series = (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * F.pow(y, 3)) + 1 / (1260 * F.pow(y, 5)) - 1 / (1680 * F.pow(y, 7))
    return series - sum((F.log(x + i) for i in range(1, 8)), F.log(x))


def normal_tail(z: Column) -> Column:
    """P(Z > z)."""
    x = F.abs(z) / math.sqrt(2)
    near = 1 - 2 / math.sqrt(math.pi) * F.exp(-x * x) * x * _folded(F.lit(1.0), lambda f, k: 1 + 2 * x * x / (2 * k + 1) * f)
    far = F.exp(-x * x) / (math.sqrt(math.pi) * _folded(x, lambda f, k: x + k / 2 / f))
    half = F.when(x < 2.5, near).otherwise(far) / 2
    return F.when(z >= 0, half).otherwise(1 - half)


def _beta_share(a: Column, b: Column, x: Column, rest: Column) -> Column:
    """The regularised incomplete beta function at x = 1 - rest, for x below (a + 1) / (a + b + 2)."""

    def term(k: Column) -> Column:
        m = F.floor(k / 2)
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        return F.when(k % 2 == 1, odd).otherwise(even)

    front = F.exp(a * F.log(x) + b * F.log(rest) + log_gamma(a + b) - log_gamma(a) - log_gamma(b))
    return front / a / _folded(F.lit(1.0), lambda f, k: 1 + term(k) / f)


def student_two_sided(t: Column, freedom: Column) -> Column:
    """P(|T| > |t|); null without a t or a degree of freedom."""
    v = freedom.cast("double")
    a, b, x, rest = v / 2, F.lit(0.5), v / (v + t * t), t * t / (v + t * t)
    exact = F.when(x < (a + 1) / (a + b + 2), _beta_share(a, b, x, rest)).otherwise(1 - _beta_share(b, a, rest, x))
    z = (8 * v + 1) / (8 * v + 3) * F.sqrt(v * F.log1p(t * t / v))
    return F.when((v > 0) & t.isNotNull(), F.when(t == 0, 1.0).when(v > NEARLY_NORMAL, 2 * normal_tail(z)).otherwise(exact))
