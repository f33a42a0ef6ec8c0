"""P-values of aggregated rows, as vectorised pandas UDFs.

The heavy part (counts, moments, rank sums) is aggregated by Spark; these
functions see one small row per tested group. Tails are incomplete beta
functions, so their cost does not grow with the counts.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf


def _lgamma(x):
    return np.array([math.lgamma(v) for v in np.atleast_1d(x)])


def _beta_fraction(a, b, x, eps=1e-16, rounds=20000):
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c = np.ones_like(x)
    d = 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, rounds):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + num * d
            d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1.0 + num / np.where(np.abs(c) < tiny, tiny, c)
            delta = c * d
            h = h * delta
        if np.all(np.abs(delta - 1.0) < eps * 8):
            break
    return h


def _stirling_rest(z):
    """lgamma(z) less Stirling's leading terms."""
    w = 1.0 / (z * z)
    far = (1 / 12 - w * (1 / 360 - w * (1 / 1260 - w * (1 / 1680 - w * (1 / 1188 - w * 691 / 360360))))) / z
    near = np.where(z < 15, z, 15.0)
    return np.where(z < 15, _lgamma(near) - ((near - 0.5) * np.log(near) - near + 0.5 * math.log(2 * math.pi)), far)


def _log_less(u, ratio):
    """log(1 + u) - u without cancellation near 0; ``ratio`` is 1 + u, which holds more digits where u is near -1."""
    small = np.where(np.abs(u) < 0.01, u, 0.0)
    series = sum((-1) ** (k + 1) * small**k / k for k in range(10, 1, -1))
    return np.where(np.abs(u) < 0.01, series, np.log(ratio) - u)


def _beta_front(a, b, x):
    """x^a (1 - x)^b / B(a, b) by deviations from a / (a + b): the huge logarithms of large counts never meet."""
    d = x * b - (1.0 - x) * a
    n = a + b
    out = a * _log_less(d / a, x * n / a) + b * _log_less(-d / b, (1.0 - x) * n / b)
    return np.sqrt(a * (b / n) / (2 * math.pi)) * np.exp(out + _stirling_rest(n) - _stirling_rest(a) - _stirling_rest(b))


def betainc(a, b, x):
    """Regularised incomplete beta function I_x(a, b) for a, b > 0."""
    a, b, x = (np.atleast_1d(np.asarray(v, dtype=float)) for v in (a, b, x))
    a, b, x = np.broadcast_arrays(a, b, x)
    inner = np.clip(x, 1e-300, 1 - 1e-16)
    front = _beta_front(a, b, inner)
    flip = inner > (a + 1.0) / (a + b + 2.0)
    aa, bb, xx = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1.0 - inner, inner)
    val = front * _beta_fraction(aa, bb, xx) / aa
    val = np.where(flip, 1.0 - val, val)
    return np.clip(np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, val)), 0.0, 1.0)


def binomial_tails(k, n, p=0.5):
    """P(X >= k) and P(X <= k)."""
    k, n = np.asarray(k, dtype=float), np.asarray(n, dtype=float)
    ge = np.where(k <= 0, 1.0, betainc(np.maximum(k, 1.0), n - np.maximum(k, 1.0) + 1.0, np.full(k.shape, p)))
    le = np.where(k >= n, 1.0, betainc(np.maximum(n - k, 1.0), np.minimum(k, n - 1) + 1.0, np.full(k.shape, 1.0 - p)))
    return ge, le


@pandas_udf(T.DoubleType())
def _binomial_p(k: pd.Series, n: pd.Series, alternative: pd.Series) -> pd.Series:
    ge, le = binomial_tails(k.to_numpy(float), n.to_numpy(float))
    alt = alternative.to_numpy()
    two = np.minimum(1.0, 2.0 * np.minimum(ge, le))
    return pd.Series(np.where(alt == "greater", ge, np.where(alt == "less", le, two)))


def binomial_p(k: Column, n: Column, alternative: Column | str = "greater") -> Column:
    """Exact binomial test against 0.5: greater, less or two-sided."""
    alt = F.lit(alternative) if isinstance(alternative, str) else alternative
    return _binomial_p(k.cast("double"), n.cast("double"), alt)


@pandas_udf(T.DoubleType())
def _t_p(t: pd.Series, dof: pd.Series) -> pd.Series:
    tv, dv = t.to_numpy(float), dof.to_numpy(float)
    ok = ~np.isnan(tv) & (dv > 0)
    out = np.full(tv.shape, np.nan)
    if ok.any():
        out[ok] = betainc(dv[ok] / 2.0, np.full(ok.sum(), 0.5), dv[ok] / (dv[ok] + tv[ok] ** 2))
    return pd.Series(out)


def t_p(t: Column, dof: Column) -> Column:
    """Two-sided p-value of Student's t; NULL without degrees of freedom."""
    return F.nanvl(_t_p(t.cast("double"), dof.cast("double")), F.lit(None).cast("double"))


@pandas_udf(T.DoubleType())
def normal_p(z: pd.Series) -> pd.Series:
    """Two-sided p-value of a standard normal deviate."""
    return pd.Series([None if pd.isna(v) else math.erfc(abs(v) / math.sqrt(2.0)) for v in z], dtype="float64")


#: Below this size of the smaller sample, and without ties, the rank-sum distribution is counted out.
FEW_RANKS = 8
#: Numbers in a null distribution that is counted out; beyond that the normal form is used.
COUNTED = 10_000_000


def rank_sum_tail(n1: int, n2: int, u: int) -> float:
    """P(U <= u) without ties: subsets of the ranks are counted by their sum.

    Numbers of partitions that fit into a box of n1 x n2: one factor (1 - q^(n2 + i)) / (1 - q^i) after the other, cut at u.
    """
    small, large = min(n1, n2), max(n1, n2)
    ways = np.zeros(u + 1)
    ways[0] = 1.0
    for i in range(1, small + 1):
        if large + i <= u:
            ways[large + i :] -= ways[: u + 1 - large - i].copy()
        for first in range(i):
            ways[first::i] = np.cumsum(ways[first::i])
    return float(ways.sum() / math.comb(n1 + n2, n1))


@pandas_udf(T.DoubleType())
def _mann_whitney_p(u: pd.Series, n1: pd.Series, n2: pd.Series, tied: pd.Series, z: pd.Series) -> pd.Series:
    out = []
    for a, m, n, t, v in zip(u, n1, n2, tied, z):
        if pd.isna(a) or pd.isna(v) or not m or not n:
            out.append(None)
        elif not t and min(m, n) <= FEW_RANKS and m * n < COUNTED:
            out.append(min(1.0, 2 * rank_sum_tail(int(m), int(n), int(min(a, m * n - a)))))
        else:
            out.append(math.erfc(abs(v) / math.sqrt(2.0)))
    return pd.Series(out, dtype="float64")


def mann_whitney_p(u: Column, n1: Column, n2: Column, tied: Column, z: Column) -> Column:
    """Two-sided p-value of U: exact for a sample of at most FEW_RANKS without ties, the normal form of ``z`` otherwise."""
    return _mann_whitney_p(u.cast("double"), n1.cast("long"), n2.cast("long"), tied, z.cast("double"))


#: Up to this size of the larger sample the two-sample distribution is counted out.
PATH_SIDE = 10_000


def paths_inside(n1: int, n2: int, h: int) -> float:
    """Share of the lattice paths from (0, 0) to (n1, n2) whose points all have |i n2 - j n1| < h.

    Row by row, a point's paths are those of the point below and of the one to the left; each row is divided by the number of
    all paths to its end, so numbers stay below one.
    """
    row = np.zeros(n2 + 1)
    row[: min(n2, (h - 1) // n1) + 1] = 1.0
    for i in range(1, n1 + 1):
        low = max(0, -((h - 1 - i * n2) // n1))
        high = min(n2, (i * n2 + h - 1) // n1)
        new = np.zeros(n2 + 1)
        if low <= high:
            new[low : high + 1] = np.cumsum(row[low : high + 1]) * (i / (n2 + i))
        row = new
    return float(row[n2])


def kolmogorov_tail(n: int, d: float) -> float:
    """P(D >= d) of one sample of n values against its distribution.

    For n up to 140 the matrix form, which is exact; beyond it, or where the tail is small, the one-sided sum taken twice
    or the expansion in powers of 1 / sqrt(n).
    """
    if d * n <= 0.5:
        return 1.0
    if d >= 1:
        return 0.0
    x = n * d * d
    if x > 18:
        return 0.0
    if x > 4:
        return min(1.0, 2 * _one_sided_tail(n, d))
    if n <= 140:
        return 1 - _matrix_form(n, d)
    return min(1.0, max(0.0, 1 - _expansion(n, d)))


def _one_sided_tail(n: int, d: float) -> float:
    j = np.arange(int(n * (1 - d)) + 1)
    up, down = d + j / n, 1 - d - j / n
    keep = down > 0
    j, up, down = j[keep], up[keep], down[keep]
    ways = math.lgamma(n + 1) - _lgamma(j + 1.0) - _lgamma(n - j + 1.0)
    return float(d * np.exp(ways + (j - 1) * np.log(up) + (n - j) * np.log(down)).sum())


def _matrix_form(n: int, d: float) -> float:
    k = math.ceil(n * d)
    m, h = 2 * k - 1, k - n * d
    i, j = np.indices((m, m))
    power = np.where(i - j + 1 >= 0, 1.0, 0.0)
    edge = h ** np.arange(1, m + 1)
    power[:, 0] -= edge
    power[-1] -= edge[::-1]
    if 2 * h - 1 > 0:
        power[-1, 0] += (2 * h - 1) ** m
    fact = np.array([math.factorial(max(int(v), 0)) for v in (i - j + 1).ravel()], float).reshape(m, m)
    step, out, left, shift = power / fact, np.eye(m), n, 0.0
    grown = 0.0
    while left:
        if left & 1:
            out, shift = out @ step, shift + grown
        step, grown, left = step @ step, grown * 2, left >> 1
        if (top := np.abs(step).max()) > 1e100:
            step, grown = step / top, grown + math.log(top)
        if (top := np.abs(out).max()) > 1e100:
            out, shift = out / top, shift + math.log(top)
    value = out[k - 1, k - 1]
    return 0.0 if value <= 0 else min(1.0, math.exp(math.log(value) + shift + math.lgamma(n + 1) - n * math.log(n)))


def _expansion(n: int, d: float) -> float:
    """P(D < d) to the third power of 1 / sqrt(n)."""
    z = d * math.sqrt(n)
    j = np.arange(0, 60)
    odd = (j + 0.5) ** 2 * math.pi**2
    e = np.exp(-odd / (2 * z * z))
    k = np.arange(1, 60)
    even = k * k * math.pi**2
    f = np.exp(-even / (2 * z * z))
    root = math.sqrt(math.pi / 2)
    z2, z4, z6 = z**2, z**4, z**6
    first = 2 * root / z * e.sum()
    second = root / (3 * z4) * ((odd - z2) * e).sum()
    third = (root / (36 * z**7) * ((6 * z6 + 2 * z4 + (2 * z4 - 5 * z2) * odd + (1 - 2 * z2) * odd**2) * e).sum()
             - root / (18 * z**3) * (even * f).sum())
    fourth = (root / (3240 * z**10) * ((odd**3 * (5 - 30 * z2) + odd**2 * (-60 * z2 + 212 * z4) + odd * (135 * z4 - 96 * z6) - 30 * z6 - 90 * z**8) * e).sum()
              + root / (108 * z6) * ((-(even**2) + 3 * even * z2) * f).sum())
    return first + second / math.sqrt(n) + third / n + fourth / n**1.5


@pandas_udf(T.DoubleType())
def _ks_p(d: pd.Series, n1: pd.Series, n2: pd.Series) -> pd.Series:
    out = []
    for v, m, n in zip(d, n1, n2):
        if pd.isna(v) or not m or not n:
            out.append(None)
            continue
        m, n = int(min(m, n)), int(max(m, n))
        h = round(v * m * n / math.gcd(m, n)) * math.gcd(m, n)
        if h == 0:
            out.append(1.0)
        elif n <= PATH_SIDE:
            out.append(min(1.0, max(0.0, 1 - paths_inside(m, n, h))))
        else:
            out.append(kolmogorov_tail(round(m * n / (m + n)), v))
    return pd.Series(out, dtype="float64")


def ks_p(d: Column, n1: Column, n2: Column) -> Column:
    """Two-sided p-value of the two-sample distance: exact for samples of up to PATH_SIDE, by the finite one-sample form beyond."""
    return _ks_p(d.cast("double"), n1.cast("long"), n2.cast("long"))


@pandas_udf(T.DoubleType())
def _ks_limit_p(lam: pd.Series) -> pd.Series:
    def tail(v):
        if pd.isna(v):
            return None
        if v < 0.2:
            return 1.0
        return min(1.0, max(0.0, 2.0 * sum((-1) ** (j - 1) * math.exp(-2.0 * j * j * v * v) for j in range(1, 101))))

    return pd.Series([tail(v) for v in lam], dtype="float64")


def ks_limit_p(d: Column, n1: Column, n2: Column) -> Column:
    """Two-sided p-value of the two-sample distance by its limit distribution."""
    return _ks_limit_p(d * F.sqrt(n1 * n2 / (n1 + n2)))


def stars(p: Column) -> Column:
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("")


def trend_class(slope: Column, falling: str = "converging", rising: str = "diverging", flat: str = "stable") -> Column:
    """Class of a slope; NULL slope means too little data."""
    return F.when(slope.isNull(), "insufficient").when(slope < 0, falling).when(slope > 0, rising).otherwise(flat)
