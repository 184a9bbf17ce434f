"""Numeric column helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: free throws count 0.44 of a shot attempt
FREE_THROW_WEIGHT = 0.44
# fixed values: rational approximation 26.2.17 of the normal distribution
# (Abramowitz & Stegun), absolute error below 7.5e-8
NORMAL_P = 0.2316419
NORMAL_B = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
INV_SQRT_2PI = 0.3989422804014327


def ratio(num: Column, den: Column, scale: float = 1.0) -> Column:
    """``scale * num / den`` as double; NULL when the denominator is zero."""
    return F.try_divide(num.cast("double") * F.lit(scale), den.cast("double"))


def count_true(cond: Column) -> Column:
    """Number of rows where the condition holds."""
    return F.count_if(cond)


def shot_weight(shot_type: str, n: str, free_throw: str = "free throw") -> Column:
    """Attempts weighted: free throws by 0.44, the rest by 1."""
    w = F.when(F.col(shot_type) == free_throw, F.lit(FREE_THROW_WEIGHT)).otherwise(F.lit(1.0))
    return F.col(n) * w


def two_sided_p(z: Column) -> Column:
    """Two-sided normal p-value, 2 * (1 - Phi(|z|))."""
    x = F.abs(z)
    t = 1 / (1 + F.lit(NORMAL_P) * x)
    poly = F.lit(0.0)
    for b in reversed(NORMAL_B):
        poly = (poly + F.lit(b)) * t
    return 2 * F.lit(INV_SQRT_2PI) * F.exp(-x * x / 2) * poly


def ln_gamma(x: Column) -> Column:
    """Logarithm of the gamma function of a positive number: Stirling's series, eight above ``x``."""
    z = x + 8
    shift = x
    for i in range(1, 8):
        shift = shift * (x + i)
    s = 1 / (z * z)
    tail = (1 - s * (F.lit(1 / 30) - s * (F.lit(1 / 105) - s / 140))) / (12 * z)
    return (z - 0.5) * F.ln(z) - z + 0.5 * F.ln(2 * F.pi()) + tail - F.ln(shift)


def beta_cdf(x: Column, a: Column, b: Column) -> Column:
    """Regularised incomplete beta function I_x(a, b) for positive ``a``, ``b`` and ``x`` from 0 to 1.

    The continued fraction is evaluated from the front, with as many steps as its convergence needs, which grow with the square root of
    the larger parameter. Where it converges slowly, the complement is taken.
    """
    turn = x > (a + 1) / (a + b + 2)
    parts = F.struct(F.when(turn, 1 - x).otherwise(x).alias("x"), F.when(turn, b).otherwise(a).alias("a"), F.when(turn, a).otherwise(b).alias("b"))
    away = lambda v: F.when(F.abs(v) < 1e-300, F.lit(1e-300)).otherwise(v)

    def of(p: Column) -> Column:
        x, a, b = p["x"], p["a"], p["b"]

        def grown(s: Column, numerator: Column) -> Column:
            """One more partial fraction: (front, its inverse tail, product so far)."""
            d = 1 / away(1 + numerator * s["d"])
            c = away(1 + numerator / s["c"])
            return F.struct(c.alias("c"), d.alias("d"), (s["h"] * c * d).alias("h"))

        def step(s: Column, m: Column) -> Column:
            even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
            odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
            return F.get(F.transform(F.array(grown(s, even)), lambda half: grown(half, odd)), 0)

        first = 1 / away(1 - (a + b) * x / (a + 1))
        steps = F.transform(F.sequence(F.lit(1), (40 + 6 * F.sqrt(F.greatest(a, b))).cast("int")), lambda m: m.cast("double"))
        start = F.struct(F.lit(1.0).alias("c"), first.alias("d"), first.alias("h"))
        fraction = F.aggregate(steps, start, step, lambda s: s["h"])
        front = F.exp(a * F.ln(x) + b * F.log1p(-x) + ln_gamma(a + b) - ln_gamma(a) - ln_gamma(b)) / a
        return F.when(x <= 0, F.lit(0.0)).otherwise(front * fraction)

    value = F.get(F.transform(F.array(parts), of), 0)
    return F.when(turn, 1 - value).otherwise(value)


def student_p(t: Column, df: Column) -> Column:
    """Two-sided p-value of Student's t; NULL without degrees of freedom."""
    t, df = t.cast("double"), df.cast("double")
    return F.when(df > 0, beta_cdf(df / (df + t * t), df / 2, F.lit(0.5)))


def fisher_p(f: Column, df1: Column, df2: Column) -> Column:
    """Upper p-value of the F distribution; NULL without degrees of freedom."""
    f, df1, df2 = f.cast("double"), df1.cast("double"), df2.cast("double")
    return F.when((df1 > 0) & (df2 > 0), beta_cdf(df2 / (df2 + df1 * f), df2 / 2, df1 / 2))
