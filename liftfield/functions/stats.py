"""Normal and Student-t probabilities."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

# Abramowitz & Stegun 26.2.17 coefficients (absolute error below 7.5e-8).
CDF_STEP = 0.2316419
CDF_COEFFICIENTS = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
INV_SQRT_2PI = 0.3989422804014327


def normal_cdf(x: Column) -> Column:
    """Standard normal distribution function as a codegen-friendly expression."""
    a = F.abs(x)
    t = 1.0 / (1.0 + F.lit(CDF_STEP) * a)
    poly = F.lit(0.0)
    for c in reversed(CDF_COEFFICIENTS):
        poly = t * (F.lit(c) + poly)
    tail = F.lit(INV_SQRT_2PI) * F.exp(-a * a / 2.0) * poly
    return F.when(x >= 0, 1.0 - tail).otherwise(tail)


def two_sided_p(z: Column) -> Column:
    return 2.0 * (1.0 - normal_cdf(F.abs(z)))


def normal_quantile(p: float) -> float:
    return NormalDist().inv_cdf(p)


def student_t_two_sided_p(t: Column, dof: Column) -> Column:
    """Two-sided p-value for whole degrees of freedom; NULL where t or the degrees of freedom are unusable.

    With an angle a = atan(|t| / sqrt(n)) the distribution is a finite series in cos(a)^2, whose terms are built one
    from the other.
    """
    n = dof.cast("int")
    x = F.abs(t) / F.sqrt(n.cast("double"))
    odd = n % 2 == 1
    square = 1.0 / (1.0 + x * x)
    terms = F.floor(n / 2).cast("int")
    rest = F.when(terms > 1, F.sequence(F.lit(1), terms - 1)).otherwise(F.array().cast("array<int>"))

    def step(acc: Column, k: Column) -> Column:
        term = acc["term"] * square * F.when(odd, 2.0 * k / (2.0 * k + 1.0)).otherwise((2.0 * k - 1.0) / (2.0 * k))
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    start = F.when(terms > 0, 1.0).otherwise(0.0)
    series = F.aggregate(rest, F.struct(start.alias("term"), start.alias("total")), step, lambda acc: acc["total"])
    sine = x * F.sqrt(square)
    inside = F.when(odd, (F.atan(x) + sine * F.sqrt(square) * series) * (2.0 / math.pi)).otherwise(sine * series)
    usable = t.isNotNull() & ~F.isnan(t) & (dof > 0)
    return F.when(usable, F.greatest(1.0 - inside, F.lit(0.0)))
