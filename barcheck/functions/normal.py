"""Normal distribution as column expressions (Spark has no erf and no quantile function).

The distribution function is the Hart rational approximation in double precision; the quantile is
Acklam's rational approximation followed by one Halley step.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, functions as F

# --- fixed values: published coefficients of the two approximations
HART_NUM = (
    3.52624965998911e-02,
    0.700383064443688,
    6.37396220353165,
    33.912866078383,
    112.079291497871,
    221.213596169931,
    220.206867912376,
)
HART_DEN = (
    8.83883476483184e-02,
    1.75566716318264,
    16.064177579207,
    86.7807322029461,
    296.564248779674,
    637.333633378831,
    793.826512519948,
    440.413735824752,
)
ACKLAM_A = (
    -3.969683028665376e01,
    2.209460984245205e02,
    -2.759285104469687e02,
    1.383577518672690e02,
    -3.066479806614716e01,
    2.506628277459239e00,
)
ACKLAM_B = (
    -5.447609879822406e01,
    1.615858368580409e02,
    -1.556989798598866e02,
    6.680131188771972e01,
    -1.328068155288572e01,
)
ACKLAM_C = (
    -7.784894002430293e-03,
    -3.223964580411365e-01,
    -2.400758277161838e00,
    -2.549732539343734e00,
    4.374664141464968e00,
    2.938163982698783e00,
)
ACKLAM_D = (
    7.784695709041462e-03,
    3.224671290700398e-01,
    2.445134137142996e00,
    3.754408661907416e00,
)
ACKLAM_LOW = 0.02425


def _horner(coeffs: tuple[float, ...], x: Column) -> Column:
    acc = F.lit(float(coeffs[0]))
    for c in coeffs[1:]:
        acc = acc * x + F.lit(float(c))
    return acc


def let(x: Column, body: Callable[[Column], Column]) -> Column:
    """Binds ``x`` once: without it a nested formula repeats its argument exponentially often in the plan."""
    return F.get(F.transform(F.array(x), body), 0)


def _cdf(x: Column) -> Column:
    a = F.abs(x)
    tail = F.exp(-a * a / 2.0)
    body = tail * _horner(HART_NUM, a) / _horner(HART_DEN, a)
    far = a + 1.0 / (a + 2.0 / (a + 3.0 / (a + 4.0 / (a + 0.65))))
    upper = F.when(a > 37.0, F.lit(0.0)).when(a < 7.07106781186547, body).otherwise(tail / far / 2.506628274631)
    return let(upper, lambda u: F.when(x > 0, 1.0 - u).otherwise(u))


def _ppf_start(p: Column) -> Column:
    tail = F.sqrt(-2.0 * F.log(F.least(p, 1.0 - p)))
    outer = let(tail, lambda t: _horner(ACKLAM_C, t) / _horner(ACKLAM_D + (1.0,), t))
    q = p - 0.5
    mid = let(q * q, lambda r: _horner(ACKLAM_A, r) / _horner(ACKLAM_B + (1.0,), r)) * q
    return F.when(p < ACKLAM_LOW, outer).when(p > 1 - ACKLAM_LOW, -outer).otherwise(mid)


def norm_cdf(x: Column) -> Column:
    return let(x, _cdf)


def norm_ppf(p: Column) -> Column:
    """Quantile for 0 < p < 1."""

    def refine(p0: Column, z: Column) -> Column:
        step = (_cdf(z) - p0) * math.sqrt(2 * math.pi) * F.exp(z * z / 2.0)
        return let(step, lambda e: z - e / (1.0 + z * e / 2.0))

    return let(p, lambda p0: let(_ppf_start(p0), lambda z: refine(p0, z)))
