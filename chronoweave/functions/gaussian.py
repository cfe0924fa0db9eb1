"""Normal distribution as Column expressions; Spark has no erf."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

SQRT_2PI = math.sqrt(2 * math.pi)

# fixed values: coefficients of the double-precision normal integral approximation (Hart 1968, given in
# West, "Better approximations to cumulative normal functions", Wilmott, 2005), highest power first
_TOP = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871,
        221.213596169931, 220.206867912376)
_BOTTOM = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674,
           637.333633378831, 793.826512519948, 440.413735824752)
_KNEE = 7.07106781186547


def _polynomial(coefficients: tuple[float, ...], x: Column) -> Column:
    total = F.lit(coefficients[0])
    for c in coefficients[1:]:
        total = total * x + F.lit(c)
    return total


def normal_cdf(z: Column) -> Column:
    """P(Z <= z), accurate to about 1e-15; the far tail uses a continued fraction."""
    size = F.abs(z)
    bell = F.exp(-size * size / F.lit(2.0))
    fraction = size + F.lit(0.65)
    for step in (4.0, 3.0, 2.0, 1.0):
        fraction = size + F.lit(step) / fraction
    tail = (
        F.when(size > 37, F.lit(0.0))
        .when(size < _KNEE, bell * _polynomial(_TOP, size) / _polynomial(_BOTTOM, size))
        .otherwise(bell / fraction / F.lit(SQRT_2PI))
    )
    return F.when(z.isNull(), None).when(z > 0, F.lit(1.0) - tail).otherwise(tail)


def normal_pdf(z: Column) -> Column:
    return F.exp(-z * z / F.lit(2.0)) / F.lit(SQRT_2PI)


def normal_log_density(y: Column, mu: Column, sigma: Column) -> Column:
    z = (y - mu) / sigma
    return -F.lit(math.log(SQRT_2PI)) - F.ln(sigma) - z * z / F.lit(2.0)


def normal_quantile(p: float) -> float:
    """For a constant level, so it is worked out once while the plan is built."""
    return NormalDist().inv_cdf(p)
