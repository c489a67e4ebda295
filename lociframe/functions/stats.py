"""Probability columns. Spark has no erf, gamma or t functions, so the first two are plain column
expressions and the last ones Arrow UDFs meant for small result tables."""

from __future__ import annotations

from functools import cache
from itertools import accumulate
from math import comb, isnan, log10, pow

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def nan() -> Column:
    return F.lit(float("nan"))


# Coefficients of the published ten-term Chebyshev fit of erfc, constant term first.
ERFC_COEFFICIENTS = (
    -1.26551223,
    1.00002368,
    0.37409196,
    0.09678418,
    -0.18628806,
    0.27886807,
    -1.13520398,
    1.48851587,
    -0.82215223,
    0.17087277,
)


def erfc(z: Column) -> Column:
    """Complementary error function for any z, relative error below 1.2e-7."""
    a = F.abs(z)
    t = 1.0 / (1.0 + 0.5 * a)
    poly = F.lit(ERFC_COEFFICIENTS[-1])
    for c in reversed(ERFC_COEFFICIENTS[:-1]):
        poly = F.lit(c) + t * poly
    tail = t * F.exp(-a * a + poly)
    return F.when(z >= 0, tail).otherwise(2.0 - tail)


def normal_two_sided(z: Column) -> Column:
    return erfc(F.abs(z) / F.sqrt(F.lit(2.0)))


def chi2_sf_1df(x: Column) -> Column:
    return erfc(F.sqrt(x / 2.0))


EXACT_TRIALS = 100


@cache
def _fair_tails() -> str:
    """Numbers as text: twice the chance of at most k heads in n fair flips, for all n up to EXACT_TRIALS and k up to n / 2, at n * (EXACT_TRIALS // 2 + 1) + k."""
    tails = []
    for n in range(EXACT_TRIALS + 1):
        upto = list(accumulate(comb(n, k) for k in range(n // 2 + 1)))
        tails += [min(1.0, 2 * u / 2**n) for u in upto] + [1.0] * (EXACT_TRIALS // 2 - n // 2)
    return ",".join(map(repr, tails))


def fair_binomial_p(successes: Column, trials: Column) -> Column:
    """Two-sided binomial p-value for a fair coin.

    Exact up to 100 trials, from a table made once; beyond that the normal approximation with a half-step
    continuity correction. Symmetric in successes and failures.
    """
    n = trials.cast("double")
    k = F.least(successes.cast("double"), n - successes.cast("double"))
    table = F.split(F.lit(_fair_tails()), ",").cast("array<double>")  # a constant by the time the plan runs
    exact = F.get(table, (n * (EXACT_TRIALS // 2 + 1) + k).cast("int"))
    normal = erfc((n / 2 - k - 0.5) / (F.sqrt(n) / 2) / F.sqrt(F.lit(2.0)))
    return F.when(F.abs(k - n / 2) < 1e-5, 1.0).when(n <= EXACT_TRIALS, exact).otherwise(F.least(F.lit(1.0), normal))


def neglog10(p: Column | str) -> Column:
    """-log10; NULL where p <= 0."""
    return -F.log10(p)


def student_t_two_sided(t: Column, dof: Column) -> Column:
    """Two-sided p of a t statistic (regularised incomplete beta). For small result tables."""

    @F.pandas_udf("double")
    def _p(ts: pd.Series, dofs: pd.Series) -> pd.Series:
        import math

        def tail(x, v):
            if x is None or v is None or x != x or v != v:
                return None
            if v > 1e5:
                # Wallace's normal transform; its relative error falls with the square of the degrees of freedom.
                z = (8 * v + 1) / (8 * v + 3) * math.sqrt(v * math.log1p(x * x / v))
                return math.erfc(z / math.sqrt(2))
            y = v / (v + x * x)
            return _beta_inc(v / 2.0, 0.5, y, math)

        def _beta_inc(a, b, x, m):
            if x <= 0.0:
                return 0.0
            if x >= 1.0:
                return 1.0
            front = m.exp(m.lgamma(a + b) - m.lgamma(a) - m.lgamma(b) + a * m.log(x) + b * m.log1p(-x))
            if x > (a + 1.0) / (a + b + 2.0):
                return 1.0 - _beta_inc(b, a, 1.0 - x, m)
            # Continued fraction of the incomplete beta, Lentz's method.
            tiny, c, d = 1e-300, 1.0, 1.0 - (a + b) * x / (a + 1.0)
            d = 1.0 / (d if abs(d) > tiny else tiny)
            h = d
            for i in range(1, 500):
                for num in (
                    i * (b - i) * x / ((a + 2 * i - 1) * (a + 2 * i)),
                    -(a + i) * (a + b + i) * x / ((a + 2 * i) * (a + 2 * i + 1)),
                ):
                    d = 1.0 + num * d
                    d = 1.0 / (d if abs(d) > tiny else tiny)
                    c = 1.0 + num / (c if abs(c) > tiny else tiny)
                    h *= c * d
                if abs(c * d - 1.0) < 1e-15:
                    break
            return front * h / a

        return pd.Series([tail(x, v) for x, v in zip(ts, dofs)], dtype="float64")

    return _p(t, dof)


def student_t_quantile_975(dof: Column) -> Column:
    """97.5 % point of Student's t by bisection on its tail. For small result tables."""

    @F.pandas_udf("double")
    def _q(dofs: pd.Series) -> pd.Series:
        import math

        import numpy as np

        def central(t, v):
            # Mass in [-t, t] by Gauss-Legendre on u = atan(x / sqrt(v)), where the density is cos^(v-1).
            lim = math.atan(t / math.sqrt(v))
            nodes, weights = np.polynomial.legendre.leggauss(200)
            u = 0.5 * lim * (nodes + 1.0)
            power = np.exp((v - 1) * np.log1p(-2 * np.sin(u / 2) ** 2))
            return 2 * gamma_ratio(v / 2) / math.sqrt(math.pi) * 0.5 * lim * float(np.sum(weights * power))

        def gamma_ratio(a):
            # gamma(a + 1/2) / gamma(a); the difference of logarithms loses its digits where a is large.
            if a < 500:
                return math.exp(math.lgamma(a + 0.5) - math.lgamma(a))
            return math.sqrt(a) * (1 - 1 / (8 * a) + 1 / (128 * a**2) + 5 / (1024 * a**3) - 21 / (32768 * a**4))

        def quantile(v):
            lo, hi = 0.0, 20.0
            while central(hi, v) < 0.95:
                hi *= 2
            for _ in range(100):
                mid = (lo + hi) / 2
                lo, hi = (mid, hi) if central(mid, v) < 0.95 else (lo, mid)
            return (lo + hi) / 2

        return pd.Series([quantile(v) if v == v and v > 0 else None for v in dofs], dtype="float64")

    return _q(dof)


def chi2_sf(x: Column, dof: Column) -> Column:
    """Upper tail of chi-square with any degrees of freedom above 0, null otherwise. For small result tables."""

    @F.pandas_udf("double")
    def _p(xs: pd.Series, dofs: pd.Series) -> pd.Series:
        import math

        def upper(a, x):
            if x <= 0:
                return 1.0
            if math.isinf(x):
                return 0.0
            lead = math.exp(-x + a * math.log(x) - math.lgamma(a))
            if x < a + 1:
                term = total = 1.0 / a
                n = a
                while abs(term) > abs(total) * 1e-16:
                    n += 1
                    term *= x / n
                    total += term
                return 1.0 - total * lead
            b, d = x + 1 - a, 1.0 / (x + 1 - a)
            c, h = 1e300, d
            for i in range(1, 10000):
                an = -i * (i - a)
                b += 2
                d = 1.0 / (an * d + b)
                c = b + an / c
                h *= d * c
                if abs(d * c - 1) < 1e-15:
                    break
            return lead * h

        return pd.Series(
            [None if x is None or v is None or x != x or not v > 0 else upper(v / 2.0, x / 2.0) for x, v in zip(xs, dofs)],
            dtype="float64",
        )

    return _p(x, dof)


def c_log10(x: Column) -> Column:
    """log10 by the C library, which differs from Java's in the last bit of some values; null where there is none."""
    @F.pandas_udf("double")
    def run(v: pd.Series) -> pd.Series:
        return pd.Series([log10(a) if a > 0 else None for a in v], dtype="float64")

    return run(x)


def c_pow(x: Column, y: Column) -> Column:
    """x to the power of y by the C library, which differs from Java's in the last bit of some values; null where there is none, infinite where it is too big."""
    def one(a: float, b: float) -> float | None:
        try:
            return pow(a, b)
        except OverflowError:
            return float("inf") if a > 0 or b % 2 == 0 else float("-inf")
        except ValueError:
            return None

    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if isnan(u) or isnan(v) else one(u, v) for u, v in zip(a, b)], dtype="float64")

    return run(x, y)
