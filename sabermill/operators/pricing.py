"""Entries of correlated legs, priced by a Gaussian copula, and factors that fit a distribution into bounds."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType

#: Normal numbers of entries that are priced together.
BLOCK = 1 << 17


def normal_quantile(p: np.ndarray) -> np.ndarray:
    """The standard normal's quantile, within -9 and 9; -9 for NaN."""
    p = np.asarray(p, float)
    out = np.where(p >= 1, 9.0, -9.0)
    inside = (p > 0) & (p < 1)
    out[inside] = np.clip(np.fromiter(map(NormalDist().inv_cdf, p[inside].tolist()), float), -9.0, 9.0)
    return out


def nearest_correlation(matrix: np.ndarray) -> np.ndarray:
    """A valid correlation matrix: negative eigenvalues are raised to almost zero, and the diagonal is scaled back to one."""
    values, vectors = np.linalg.eigh((matrix + matrix.T) / 2)
    if values.min() >= 1e-9:
        return matrix
    fixed = (vectors * np.maximum(values, 1e-9)) @ vectors.T
    scale = np.sqrt(np.diag(fixed))
    return fixed / np.outer(scale, scale)


def prices(p: np.ndarray, push: np.ndarray, rho: np.ndarray, payouts: dict[tuple[int, int], float], draws: int, seeds: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(chances that every leg wins, mean payouts) of entries of as many legs each, over ``draws`` draws an entry; a push takes its leg out, and an entry of under two legs is paid back."""
    count, n = p.shape
    rho = rho.copy()
    for i in np.flatnonzero(~(np.linalg.eigvalsh((rho + rho.swapaxes(1, 2)) / 2).min(axis=1) >= 1e-9)):
        rho[i] = nearest_correlation(rho[i])
    factor = np.linalg.cholesky(rho + 1e-12 * np.eye(n))
    win = normal_quantile(np.clip(p, 1e-12, 1 - 1e-12).ravel()).reshape(count, n, 1)
    out = np.maximum(win, normal_quantile(np.clip(p + push, 1e-12, 1 - 1e-12).ravel()).reshape(count, n, 1))
    table = np.zeros((n + 1, n + 1))  # by legs taken out and misses
    for (size, missed), pays in payouts.items():
        if size <= n and missed <= n:
            table[n - size, missed] = pays
    table[max(n - 1, 0) :] = 1.0
    half, cells = draws // 2, table.size
    step = max(1, min(count, BLOCK // max(half * n, 1)))
    tally, drawn, held = np.empty((count, cells), np.int64), np.empty((step, half, n)), np.empty((step, n, half))
    for lo in range(0, count, step):
        hi = min(lo + step, count)
        z, x = drawn[: hi - lo], held[: hi - lo]
        for k in range(lo, hi):
            np.random.default_rng(seeds[k]).standard_normal(out=z[k - lo])
        np.matmul(factor[lo:hi], z.swapaxes(1, 2), out=x)
        base, seen = np.arange(hi - lo)[:, None] * cells, 0
        for beyond in (lambda q: x >= q, lambda q: x <= -q):  # each draw and its mirror image
            lost, missed = (np.add.reduce(beyond(q[lo:hi]), axis=1, dtype=np.int16) for q in (win, out))
            seen = seen + np.bincount((base + (lost * np.int16(n + 1) - missed * np.int16(n))).ravel(), minlength=(hi - lo) * cells)
        tally[lo:hi] = seen.reshape(hi - lo, cells)
    return tally[:, 0] / (2 * half), tally @ table.ravel() / (2 * half)


def price(p: np.ndarray, push: np.ndarray, rho: np.ndarray, payouts: dict[tuple[int, int], float], draws: int, seed: int) -> tuple[float, float]:
    """``prices`` of one entry."""
    win, paid = prices(p[None], push[None], rho[None], payouts, draws, [seed])
    return float(win[0]), float(paid[0])


def copula_prices(entries: DataFrame, key: str, p: str, push: str, rho: str, payouts: dict[tuple[int, int], float], draws: int = 4096) -> DataFrame:
    """(key, win, payout) of entries with arrays of legs' chances and push chances and a flat correlation matrix; the draws of an entry depend on its key alone.

    Entries are rows and are priced where they lie, those of as many legs together; an entry without legs wins nothing and is paid back.
    """
    kind = entries.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, start, flat = [], [], []
            for i in (1, 2, 3):
                lists = batch.column(i)
                size.append(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
                start.append(np.cumsum(size[-1]) - size[-1])
                flat.append(lists.flatten().to_numpy(zero_copy_only=False).astype(float))
            n = size[0]
            if ((n > 0) & ((size[1] != n) | (size[2] != n * n))).any():
                raise ValueError("an entry needs a push chance a leg and a correlation a pair of legs")
            seeds = [zlib.crc32(str(k).encode()) for k in batch.column(0).to_pylist()]
            win, paid = np.zeros(len(n)), np.ones(len(n))
            for legs in np.unique(n[n > 0]).tolist():
                at = np.flatnonzero(n == legs)
                a, b, m = (x[s[at, None] + np.arange(k)] for x, s, k in zip(flat, start, (legs, legs, legs * legs)))
                win[at], paid[at] = prices(a, b, m.reshape(-1, legs, legs), payouts, draws, [seeds[i] for i in at.tolist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(win), pa.array(paid)], ["key", "win", "payout"])

    return entries.select(F.col(key).alias("key"), F.col(p).cast("array<double>"), F.col(push).cast("array<double>"), F.col(rho).cast("array<double>")).mapInArrow(run, f"key {kind}, win double, payout double").withColumnRenamed("key", key)


@F.pandas_udf(DoubleType())
def bounds_factor(mean: pd.Series, sd: pd.Series, low: pd.Series, high: pd.Series) -> pd.Series:
    """The largest factor up to 1 on a normal's deviation that leaves at most 5 percent outside [low, high]; bisection for all rows together."""
    m, s, a, b = (x.to_numpy(float) for x in (mean, sd, low, high))
    erf = np.frompyfunc(math.erf, 1, 1)

    def outside(f: np.ndarray) -> np.ndarray:
        cdf = lambda x: 0.5 * (1 + erf((x - m) / (np.maximum(s * f, 1e-12) * math.sqrt(2))).astype(float))
        return cdf(a) + 1 - cdf(b)

    lo, hi = np.zeros(len(m)), np.ones(len(m))
    fits = outside(hi) <= 0.05
    for _ in range(50):
        mid = (lo + hi) / 2
        ok = outside(mid) <= 0.05
        lo, hi = np.where(ok, mid, lo), np.where(ok, hi, mid)
    return pd.Series(np.where(fits, 1.0, lo))


def correlation_matrix(players: Column, rho) -> Column:
    """Flat matrix of an array's members, 1 on the diagonal and ``rho`` of two members off it."""
    return F.flatten(F.transform(players, lambda a: F.transform(players, lambda b: F.when(a == b, 1.0).otherwise(rho(a, b)))))
