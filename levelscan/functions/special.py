"""Distribution tails as native column expressions, plus their inverse functions.

The inverse functions are meant for small aggregated tables; the beta quantile is an Arrow UDF.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import DoubleType

from levelscan.functions.scalars import let


def _scaled_erfc(z: float) -> float:
    """erfc(z) * exp(z^2) for z >= 0."""
    if z < 20:
        return math.erfc(z) * math.exp(z * z)
    s, term = 1.0, 1.0
    for k in range(1, 8):
        term *= -(2 * k - 1) / (2 * z * z)
        s += term
    return s / (z * math.sqrt(math.pi))


def _fit(degree: int = 20) -> list[float]:
    """Power-series coefficients (in s = 2t - 1, t = 2/(2+z)) of log(erfc(z) exp(z^2) / t)."""
    def f(s):
        t = (s + 1) / 2
        z = 2 / t - 2
        return math.log(_scaled_erfc(z) / t)

    cheb = np.polynomial.chebyshev.chebinterpolate(np.vectorize(f), degree)
    return [float(c) for c in np.polynomial.chebyshev.cheb2poly(cheb)]


ERFC_COEFFICIENTS = _fit()


def erfc_abs(z: Column) -> Column:
    """erfc of a non-negative number."""

    def at(x):
        def horner(s):
            poly = F.lit(ERFC_COEFFICIENTS[-1])
            for c in reversed(ERFC_COEFFICIENTS[:-1]):
                poly = poly * s + c
            return poly

        return 2.0 / (2.0 + x) * F.exp(let(4.0 / (2.0 + x) - 1.0, horner) - x * x)

    return let(z, at)


def normal_two_sided(z: Column) -> Column:
    return erfc_abs(F.abs(z) / math.sqrt(2.0))


def normal_sf(z: Column) -> Column:
    return let(z, lambda x: let(normal_two_sided(x) / 2.0, lambda half: F.when(x >= 0, half).otherwise(1.0 - half)))


def normal_cdf(z: Column) -> Column:
    return let(z, lambda x: let(normal_two_sided(x) / 2.0, lambda half: F.when(x >= 0, 1.0 - half).otherwise(half)))


def t_two_sided(t: Column, df: Column) -> Column:
    """P(|T| >= t) for whole degrees of freedom.

    Up to 1000: the finite sum in cos(theta), theta = atan(t / sqrt(df)); above: Hill's normal expansion.
    """
    return let(F.abs(t), lambda a: F.when(df <= 1000, _t_sum(a, df)).otherwise(_t_hill(a, df.cast("double"))))


def _t_sum(a: Column, df: Column) -> Column:
    odd = df % 2 == 1
    terms = F.when(odd, (df - 1) / 2).otherwise(df / 2).cast("int")
    ks = F.when((terms >= 1) & (terms <= 500), F.sequence(F.lit(1), terms)).otherwise(F.array().cast("array<int>"))

    def at(theta):
        def total(cos2):
            def step(acc, k):
                nxt = F.when(odd, acc["term"] * cos2 * (2 * k) / (2 * k + 1)).otherwise(acc["term"] * cos2 * (2 * k - 1) / (2 * k))
                return F.struct(nxt.alias("term"), (acc["sum"] + acc["term"]).alias("sum"))

            first = F.struct(F.when(odd, F.cos(theta)).otherwise(F.lit(1.0)).alias("term"), F.lit(0.0).alias("sum"))
            return F.sin(theta) * F.aggregate(ks, first, step, lambda s: s["sum"])

        inside = let(let(F.pow(F.cos(theta), 2), total), lambda x: F.when(odd, 2.0 / math.pi * (theta + x)).otherwise(x))
        return F.greatest(1.0 - inside, F.lit(0.0))

    return let(F.atan(a / F.sqrt(df.cast("double"))), at)


def _t_hill(a: Column, n: Column) -> Column:
    b = 48.0 * F.pow(n - 0.5, 2)

    def z(w):
        tail = (4 * F.pow(w, 7) + 33 * F.pow(w, 5) + 240 * F.pow(w, 3) + 855 * w) / (10 * b * (b + 0.8 * F.pow(w, 4) + 100))
        return normal_two_sided(w + (F.pow(w, 3) + 3 * w) / b - tail)

    return let(F.sqrt((n - 0.5) * F.ln(1.0 + a * a / n)), z)


def chi2_even_sf(x: Column, k: Column) -> Column:
    """Upper tail of chi-square with 2k degrees of freedom: exp(-x/2) * sum_{i<k} (x/2)^i / i!."""
    half = x / 2.0

    def step(acc, i):
        return F.struct((acc["term"] * half / i).alias("term"), (acc["sum"] + acc["term"]).alias("sum"))

    total = F.aggregate(F.sequence(F.lit(1), k.cast("int")), F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("sum")), step, lambda s: s["sum"])
    return F.exp(-half) * total


def _betacf(a: float, b: float, x: float) -> float:
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return h


def beta_cdf(x: float, a: float, b: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _betacf(a, b, x) / a
    return 1.0 - front * _betacf(b, a, 1 - x) / b


@F.pandas_udf(DoubleType())
def beta_ppf(p: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
    def one(q, s, t):
        lo, hi = 0.0, 1.0
        for _ in range(100):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if beta_cdf(mid, s, t) < q else (lo, mid)
        return (lo + hi) / 2

    return pd.Series([one(*v) if all(map(math.isfinite, v)) and min(v[1], v[2]) > 0 else float("nan") for v in zip(p, a, b)])


def normal_ppf(p: Column) -> Column:
    """The normal quantile, by 60 halvings of [-10, 10] around ``normal_cdf``; null of null."""

    def halve(s, _):
        mid = (s["lo"] + s["hi"]) / 2
        low = normal_cdf(mid) < p
        return F.struct(F.when(low, mid).otherwise(s["lo"]).alias("lo"), F.when(low, s["hi"]).otherwise(mid).alias("hi"))

    start = F.struct(F.lit(-10.0).alias("lo"), F.lit(10.0).alias("hi"))
    return F.when(p.isNotNull(), F.aggregate(F.sequence(F.lit(1), F.lit(60)), start, halve, lambda s: (s["lo"] + s["hi"]) / 2))


def erfc_sql(z: str) -> str:
    """The same tail as SQL text (for checks in another engine); ``z`` must not be negative."""
    s = f"(4.0 / (2.0 + ({z})) - 1.0)"
    poly = repr(ERFC_COEFFICIENTS[-1])
    for c in reversed(ERFC_COEFFICIENTS[:-1]):
        poly = f"({poly} * {s} + ({c!r}))"
    return f"(2.0 / (2.0 + ({z})) * exp({poly} - ({z}) * ({z})))"


#: Null distribution of sqrt(n) * dip by sample size (the last row is the limit law): the values reached with these chances.
#: Fixed values, drawn by tools/dip_surface.py.
DIP_SHARES = (0.99, 0.9, 0.7, 0.5, 0.3, 0.2, 0.1, 0.05, 0.02, 0.01, 0.001)
DIP_SIZES = (4, 6, 8, 10, 15, 20, 30, 50)
DIP_QUANTILES = (
    (0.2500, 0.2500, 0.2500, 0.2500, 0.2661, 0.3155, 0.3739, 0.4145, 0.4479, 0.4631, 0.4893),
    (0.2041, 0.2041, 0.2542, 0.3017, 0.3442, 0.3661, 0.3900, 0.4035, 0.4396, 0.4712, 0.5388),
    (0.1768, 0.2322, 0.2819, 0.3140, 0.3407, 0.3537, 0.4001, 0.4357, 0.4693, 0.4896, 0.5493),
    (0.1914, 0.2458, 0.2849, 0.3081, 0.3454, 0.3735, 0.4107, 0.4398, 0.4757, 0.5053, 0.5724),
    (0.2102, 0.2489, 0.2874, 0.3211, 0.3569, 0.3806, 0.4197, 0.4509, 0.4890, 0.5156, 0.5940),
    (0.2128, 0.2527, 0.2922, 0.3231, 0.3612, 0.3862, 0.4228, 0.4569, 0.4952, 0.5216, 0.6007),
    (0.2157, 0.2570, 0.2962, 0.3286, 0.3648, 0.3888, 0.4248, 0.4586, 0.4979, 0.5288, 0.6242),
    (0.2200, 0.2595, 0.2974, 0.3295, 0.3646, 0.3888, 0.4251, 0.4573, 0.4944, 0.5221, 0.5979),
    (0.2235, 0.2630, 0.2980, 0.3274, 0.3613, 0.3840, 0.4170, 0.4483, 0.4855, 0.5064, 0.5812),
)


def dip_sf(dip: Column, n: Column) -> Column:
    """P(dip of n uniform values >= dip) for any n from 4 on; smaller groups give 1.

    The quantiles are interpolated in 1/sqrt(n), between the sizes of the table and on to the limit law at 0; log p is interpolated between
    the quantiles, and goes on in a straight line beyond the last.
    """
    s = 1 / F.sqrt(n.cast("double"))
    knots = [size**-0.5 for size in DIP_SIZES] + [0.0]

    def quantile(j: int) -> Column:
        out = F.lit(None).cast("double")
        for i in reversed(range(len(knots) - 1)):
            low, high = DIP_QUANTILES[i + 1][j], DIP_QUANTILES[i][j]
            out = F.when(s >= knots[i + 1], low + (high - low) * (s - knots[i + 1]) / (knots[i] - knots[i + 1])).otherwise(out)
        return out

    def at(t: Column) -> Column:
        def between(q: Column) -> Column:
            logs = [math.log(p) for p in DIP_SHARES]
            last = len(logs) - 1
            out = F.lit(1.0)
            for j in range(1, last + 1):
                lo, hi = q[j - 1], q[j]
                line = logs[j - 1] + (logs[j] - logs[j - 1]) * (t - lo) / (hi - lo)
                out = F.when((t > lo) & (F.lit(True) if j == last else t <= hi), F.exp(line)).otherwise(out)
            return out

        return let(F.array(*[quantile(j) for j in range(len(DIP_SHARES))]), between)

    return F.when(n >= 4, let(dip * F.sqrt(n.cast("double")), at)).otherwise(1.0)


def dip_sf_sql(dip: str, n: str) -> str:
    """The same as SQL text, over lists: the row of the table by its place, then the pair of quantiles around the value."""
    knots = str([size**-0.5 for size in DIP_SIZES] + [0.0]) + "::DOUBLE[]"
    table = str([list(r) for r in DIP_QUANTILES]) + "::DOUBLE[][]"
    logs = str([math.log(p) for p in DIP_SHARES]) + "::DOUBLE[]"
    s = f"(1 / sqrt(({n})::DOUBLE))"
    i = f"least(greatest(len(list_filter({knots}, lambda k: k >= {s})), 1), {len(DIP_SIZES)})"
    q = f"list_transform(range(1, {len(DIP_SHARES) + 1}), lambda j: ({table})[{i} + 1][j] + (({table})[{i}][j] - ({table})[{i} + 1][j]) * ({s} - ({knots})[{i} + 1]) / (({knots})[{i}] - ({knots})[{i} + 1]))"
    t = f"(({dip}) * sqrt(({n})::DOUBLE))"
    c = f"least(len(list_filter(q, lambda x: x < {t})), {len(DIP_SHARES) - 1})"
    return f"(SELECT CASE WHEN ({n}) < 4 OR c = 0 THEN 1.0 ELSE exp(({logs})[c] + (({logs})[c + 1] - ({logs})[c]) * ({t} - q[c]) / (q[c + 1] - q[c])) END FROM (SELECT q, {c} AS c FROM (SELECT {q} AS q)))"
