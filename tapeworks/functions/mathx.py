"""Math column expressions Spark lacks: the normal CDF and its inverse, ANSI-safe division, clipping."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# The rational approximation of the normal tail (Hart 1968, algorithm 5666; West 2005).
HART_NUM = (
    0.0352624965998911, 0.700383064443688, 6.37396220353165, 33.912866078383,
    112.079291497871, 221.213596169931, 220.206867912376,
)
HART_DEN = (
    0.0883883476483184, 1.75566716318264, 16.064177579207, 86.7807322029461,
    296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752,
)
SQRT_2PI = math.sqrt(2 * math.pi)

# The rational approximation of the normal quantile (Acklam 2003).
ACKLAM_A = (
    -39.69683028665376, 220.9460984245205, -275.9285104469687,
    138.3577518672690, -30.66479806614716, 2.506628277459239,
)
ACKLAM_B = (
    -54.47609879822406, 161.5858368580409, -155.6989798598866,
    66.80131188771972, -13.28068155288572, 1.0,
)
ACKLAM_C = (
    -0.007784894002430293, -0.3223964580411365, -2.400758277161838,
    -2.549732539343734, 4.374664141464968, 2.938163982698783,
)
ACKLAM_D = (0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416, 1.0)
ACKLAM_SPLIT = 0.02425

EULER_GAMMA = 0.5772156649015329
Z_975 = 1.959963984540054  # the 97.5% point of the standard normal


def c(x) -> Column:
    """Column from a name, a Column or a literal number."""
    if isinstance(x, Column):
        return x
    return F.col(x) if isinstance(x, str) else F.lit(x)


def horner(coefs, x: Column) -> Column:
    return reduce(lambda acc, k: acc * x + F.lit(k), coefs[1:], F.lit(coefs[0]))


def div(a, b) -> Column:
    """a / b, NULL when b is 0 or NULL (ANSI mode raises on division by zero)."""
    return c(a) / F.nullif(c(b).cast("double"), F.lit(0.0))


def clip(x: Column, lo: float, hi: float) -> Column:
    """Clip that keeps NULL (greatest and least alone would skip it)."""
    return F.when(x.isNull(), None).otherwise(F.least(F.greatest(x, F.lit(lo)), F.lit(hi)))


def bind(x: Column, fn) -> Column:
    """fn(x) with x computed once, however often fn uses it."""
    return F.transform(F.array(x), fn)[0]


def norm_cdf(x) -> Column:
    """P(Z <= x), double precision, inside the JVM."""
    x = c(x).cast("double")
    a = F.abs(x)
    e = F.exp(-a * a / 2)
    near = e * horner(HART_NUM, a) / horner(HART_DEN, a)
    far = e / ((a + 1 / (a + 2 / (a + 3 / (a + 4 / (a + 0.65))))) * SQRT_2PI)
    tail = F.when(a > 37, 0.0).when(a < 7.07106781186547, near).otherwise(far)
    return F.when(x > 0, 1 - tail).otherwise(tail)


def norm_pdf(x) -> Column:
    x = c(x).cast("double")
    return F.exp(-x * x / 2) / SQRT_2PI


def norm_ppf(p) -> Column:
    """Normal quantile for 0 < p < 1, one Newton step on the rational start; NULL outside."""
    return bind(c(p).cast("double"), _ppf)


def _ppf(p: Column) -> Column:

    def tail(u: Column) -> Column:
        q = F.sqrt(-2 * F.ln(u))
        return horner(ACKLAM_C, q) / horner(ACKLAM_D, q)

    r = p - 0.5
    mid = horner(ACKLAM_A, r * r) * r / horner(ACKLAM_B, r * r)
    x0 = (
        F.when((p <= 0) | (p >= 1), None)
        .when(p < ACKLAM_SPLIT, tail(p))
        .when(p > 1 - ACKLAM_SPLIT, -tail(1 - p))
        .otherwise(mid)
    )
    return bind(F.struct(x0.alias("x"), p.alias("p")), lambda s: s["x"] - (norm_cdf(s["x"]) - s["p"]) / norm_pdf(s["x"]))


def _beta_tail(x: np.ndarray, a: np.ndarray, b: float) -> np.ndarray:
    """Regularised incomplete beta by its continued fraction (modified Lentz), vectorised."""
    lg = np.vectorize(math.lgamma)
    swap = x > (a + 1) / (a + b + 2)
    xx = np.where(swap, 1 - x, x)
    aa = np.where(swap, b, a)
    bb = np.where(swap, a, b)
    front = np.exp(
        lg(aa + bb) - lg(aa) - lg(bb)
        + aa * np.log(np.clip(xx, 1e-300, None)) + bb * np.log(np.clip(1 - xx, 1e-300, None))
    )
    tiny = 1e-300
    cc = np.ones_like(xx)
    d = 1 / np.where(np.abs(1 - (aa + bb) * xx / (aa + 1)) < tiny, tiny, 1 - (aa + bb) * xx / (aa + 1))
    f = d.copy()
    for m in range(1, 300):
        for num in (
            m * (bb - m) * xx / ((aa + 2 * m - 1) * (aa + 2 * m)),
            -(aa + m) * (aa + bb + m) * xx / ((aa + 2 * m) * (aa + 2 * m + 1)),
        ):
            d = 1 + num * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            cc = 1 + num / cc
            cc = np.where(np.abs(cc) < tiny, tiny, cc)
            f = f * d * cc
        if np.all(np.abs(d * cc - 1) < 1e-15):
            break
    res = front * f / aa
    return np.where(xx <= 0, np.where(swap, 1.0, 0.0), np.where(swap, 1 - res, res))


@F.pandas_udf(DoubleType())
def t_cdf(t: pd.Series, dof: pd.Series) -> pd.Series:
    """Student-t CDF. One value per compared pair, never per data row."""
    tv, nu = t.to_numpy(float), dof.to_numpy(float)
    half = 0.5 * _beta_tail(nu / (nu + tv * tv), nu / 2, 0.5)
    return pd.Series(np.where(np.isnan(tv), np.nan, np.where(tv > 0, 1 - half, half)))


def uniform(seed: int, *parts) -> Column:
    """A number in [0, 1) fixed by seed and keys, so that results do not depend on partitioning."""
    text = F.concat_ws(":", F.lit(str(seed)), *[c(p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") / float(16**12)
