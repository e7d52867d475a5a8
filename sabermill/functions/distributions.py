"""Distribution functions as Arrow-batched UDFs over numpy, for families that SQL has no closed form for."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import DoubleType

_ERF = np.frompyfunc(math.erf, 1, 1)
_LGAMMA = np.frompyfunc(math.lgamma, 1, 1)


def normal_cdf(x: np.ndarray, mean: np.ndarray, sd: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + _ERF((x - mean) / (sd * math.sqrt(2))).astype(float))


#: Cells (row, term) of a distribution's terms that are held at a time.
CELLS = 1 << 21


def _alike(size: np.ndarray):
    """Groups of rows whose numbers of terms differ little, so that one row with many terms costs no other row any; each group's table stays within CELLS, or is one row."""
    order = np.argsort(size, kind="stable")
    lo = 0
    while lo < len(order):
        hi = int(np.searchsorted(size[order], 2 * max(size[order[lo]], 32), "right"))
        hi = max(lo + 1, min(hi, lo + int(CELLS // max(size[order[hi - 1]], 1))))
        yield order[lo:hi]
        lo = hi


def _sum_pmf(k: np.ndarray, log_pmf) -> np.ndarray:
    """Sum of a pmf from 0 to k; ``log_pmf`` takes a number and the rows it is for."""
    out, n = np.zeros(len(k)), np.where(np.isnan(k), -1, np.maximum(k, -1))
    for rows in _alike(n + 1):
        for i in range(int(n[rows].max(initial=-1)) + 1):
            out[rows] += np.where(i <= n[rows], np.exp(log_pmf(i, rows)), 0.0)
    return np.where(np.isnan(k), np.nan, np.minimum(out, 1.0))


def poisson_cdf(k: np.ndarray, mean: np.ndarray) -> np.ndarray:
    log = np.log(mean)
    return _sum_pmf(k, lambda i, rows: i * log[rows] - mean[rows] - math.lgamma(i + 1))


def negbin_cdf(k: np.ndarray, mean: np.ndarray, size: np.ndarray) -> np.ndarray:
    p = size / (size + mean)
    base = _LGAMMA(size).astype(float)
    return _sum_pmf(k, lambda i, rows: _LGAMMA(size[rows] + i).astype(float) - base[rows] - math.lgamma(i + 1) + size[rows] * np.log(p[rows]) + i * np.log1p(-p[rows]))


def gamma_cdf(x: np.ndarray, mean: np.ndarray, shape: np.ndarray, terms: int = 400) -> np.ndarray:
    """Regularised lower incomplete gamma function by its power series."""
    z = np.maximum(x * shape / mean, 0)
    term = 1 / shape
    total = term.copy()
    for n in range(1, terms):
        term = term * z / (shape + n)
        total += term
    with np.errstate(divide="ignore"):
        return np.clip(np.where(z > 0, np.exp(shape * np.log(np.maximum(z, 1e-300)) - z - _LGAMMA(shape).astype(float)) * total, 0.0), 0, 1)


def double_poisson_cdf(k: np.ndarray, mean: np.ndarray, precision: np.ndarray) -> np.ndarray:
    """Double Poisson of an exact mean, normalised over a grid of 12 standard deviations past the means and points of rows alike; see ``double_poisson_cdfs``."""
    return double_poisson_cdfs([k], mean, precision)[0]


#: Cells of a double Poisson's table that are held at a time: few enough for a processor's cache.
NEAR = 1 << 15


def double_poisson_cdfs(points: list[np.ndarray], mean: np.ndarray, precision: np.ndarray) -> list[np.ndarray]:
    """The distribution function at several points of each row, whose location is sought once. Rows go in order of their grids, so that a table's rows are alike; a row with anything missing gives NaN."""
    outs = [np.full(len(mean), np.nan) for _ in points]
    with np.errstate(all="ignore"):
        reach = np.maximum.reduce([mean + 12 * np.sqrt(mean / np.minimum(precision, 1)), *points]) + 13
    order = np.argsort(reach, kind="stable")
    order, lo = order[np.isfinite(reach[order])], 0
    while lo < len(order):
        hi = min(len(order), lo + max(1, int(NEAR // max(reach[order[lo]], 13))))
        hi = lo + max(1, int(np.searchsorted(reach[order[lo:hi]], 2 * max(reach[order[lo]], 32), "right")))
        rows = order[lo:hi]
        for out, found in zip(outs, _double_poisson([k[rows] for k in points], mean[rows], precision[rows], int(reach[rows[-1]]))):
            out[rows] = found
        lo = hi
    return outs


_Y = np.arange(4096, dtype=float)
_YLOGY = _Y * np.log(np.maximum(_Y, 1))
_BASE = _YLOGY - _Y - _LGAMMA(_Y + 1).astype(float)


def _double_poisson(points: list[np.ndarray], mean: np.ndarray, precision: np.ndarray, top: int) -> list[np.ndarray]:
    """log p(y) = base(y) - precision * y log y + slope * y, less its sum. The log of the mean is nearly straight in the slope, so a few Newton steps find it; rows that they leave unsettled are bisected."""
    if top <= len(_Y):
        y, ylogy, base = _Y[:top], _YLOGY[:top], _BASE[:top]
    else:
        y = np.arange(top, dtype=float)
        ylogy = y * np.log(np.maximum(y, 1))
        base = ylogy - y - _LGAMMA(y + 1).astype(float)
    alike = (precision == precision[0]).all()
    fixed = (base - precision[0] * ylogy)[None, :] if alike else base - precision[:, None] * ylogy
    moments = np.stack([np.ones(top), y, y * y], axis=1)

    def pmf(slope: np.ndarray) -> np.ndarray:
        log = slope[:, None] * y
        log += fixed
        log -= log.max(axis=1, keepdims=True)
        return np.exp(log, out=log)

    with np.errstate(all="ignore"):
        slope, step = precision * np.log(mean), np.full(len(mean), np.inf)
        for _ in range(8):
            p = pmf(slope)
            total, first, second = (p @ moments).T
            first /= total
            step = (np.log(mean) - np.log(first)) * first / (second / total - first * first)
            slope = slope + step
            if (np.abs(step) < 1e-7).all():  # the error after a step is about its square
                break
    left = ~(np.abs(step) < 1e-7)
    if left.any():
        lo, hi, some, wanted = np.full(left.sum(), 1e-9), 2 * mean[left] + 10, precision[left], mean[left]
        whole, fixed = fixed, fixed if alike else fixed[left]
        for _ in range(50):
            mid = (lo + hi) / 2
            p = pmf(some * np.log(mid))
            high = p @ y > wanted * p.sum(axis=1)
            lo, hi = np.where(high, lo, mid), np.where(high, mid, hi)
        slope[left], fixed = some * np.log((lo + hi) / 2), whole
    total = np.cumsum(pmf(slope), axis=1)
    at = np.arange(len(mean))
    return [np.where(k < 0, 0.0, total[at, np.maximum(k, 0).astype(int)] / total[:, -1]) for k in points]


_NODES, _WEIGHTS = np.polynomial.legendre.leggauss(64)


def skew_normal_cdf(x: np.ndarray, mean: np.ndarray, sd: np.ndarray, alpha: np.ndarray) -> np.ndarray:
    """Skew-normal of a given mean and standard deviation: the normal CDF less twice Owen's T, by Gauss-Legendre quadrature."""
    delta = alpha / np.sqrt(1 + alpha**2)
    scale = sd / np.sqrt(1 - 2 * delta**2 / math.pi)
    z = (x - mean) / scale + delta * math.sqrt(2 / math.pi)
    t = (_NODES[None, :] + 1) / 2 * alpha[:, None]
    owen = (np.exp(-0.5 * z[:, None] ** 2 * (1 + t**2)) / (1 + t**2)) @ _WEIGHTS * alpha / (4 * math.pi)
    return np.clip(normal_cdf(z, np.zeros(len(z)), np.ones(len(z))) - 2 * owen, 0, 1)


def under_probability(family: np.ndarray, line: np.ndarray, mean: np.ndarray, shape: np.ndarray) -> np.ndarray:
    """P(below the line) with half of the mass on it; families poisson, negbin, doublepoisson, normal, gamma."""
    out = np.full(len(line), np.nan)
    i = family == "doublepoisson"
    if i.any():
        low, high = double_poisson_cdfs([np.ceil(line[i]) - 1, np.floor(line[i])], mean[i], shape[i])
        out[i] = (low + high) / 2
    for name, cdf in (("poisson", lambda k, m, s: poisson_cdf(k, m)), ("negbin", negbin_cdf)):
        i = family == name
        if i.any():
            low, high = cdf(np.ceil(line[i]) - 1, mean[i], shape[i]), cdf(np.floor(line[i]), mean[i], shape[i])
            out[i] = (low + high) / 2
    for name, cdf in (("normal", normal_cdf), ("gamma", gamma_cdf)):
        i = family == name
        if i.any():
            out[i] = cdf(line[i], mean[i], shape[i])
    return out


@F.pandas_udf(DoubleType())
def under_prob(family: pd.Series, line: pd.Series, mean: pd.Series, shape: pd.Series) -> pd.Series:
    return pd.Series(under_probability(family.to_numpy(), *(x.to_numpy(float) for x in (line, mean, shape))))


@F.pandas_udf(DoubleType())
def mean_from_price(family: pd.Series, line: pd.Series, under: pd.Series, shape: pd.Series) -> pd.Series:
    """The mean at which the under has a given probability: 60 bisections on [1e-6, max(5 line, 1)] for all rows together."""
    f, ln, p, s = family.to_numpy(), *(x.to_numpy(float) for x in (line, under, shape))
    lo, hi = np.full(len(ln), 1e-6), np.maximum(5 * ln, 1)
    for _ in range(60):
        mid = (lo + hi) / 2
        high = under_probability(f, ln, mid, s) > p  # the under falls as the mean rises
        lo, hi = np.where(high, mid, lo), np.where(high, hi, mid)
    return pd.Series((lo + hi) / 2)


@F.pandas_udf(DoubleType())
def poisson_crps(mean: pd.Series, actual: pd.Series) -> pd.Series:
    """Sum over k of (F(k) - 1{actual <= k}) squared."""
    m, a = mean.to_numpy(float), actual.to_numpy(float)
    out, reach = np.zeros(len(m)), np.maximum(m + 12 * np.sqrt(m), a) + 12
    for rows in _alike(reach):
        cdf, one, x = np.zeros(len(rows)), m[rows], a[rows]
        for k in range(int(reach[rows].max())):
            cdf = np.minimum(cdf + np.exp(k * np.log(one) - one - math.lgamma(k + 1)), 1)
            out[rows] += (cdf - (x <= k)) ** 2
    return pd.Series(out)


@F.pandas_udf(DoubleType())
def skew_normal_under(line: pd.Series, mean: pd.Series, sd: pd.Series, alpha: pd.Series) -> pd.Series:
    return pd.Series(skew_normal_cdf(*(x.to_numpy(float) for x in (line, mean, sd, alpha))))


def zero_inflated(under: Column, gate: Column, line: Column) -> Column:
    """``under`` of a family whose outcome is zero with chance ``gate`` besides; half of that mass counts at a line of zero, none below."""
    return gate * F.when(line > 0, 1.0).when(line == 0, 0.5).otherwise(0.0) + (1 - gate) * under


def mixture(parts: list[tuple[Column, Column]]) -> Column:
    """Probability under a mixture of (weight, probability); weights need not sum to one."""
    weights = sum((w for w, _ in parts[1:]), parts[0][0])
    return sum((w * p for w, p in parts[1:]), parts[0][0] * parts[0][1]) / weights
