import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sabermill.operators.pricing import bounds_factor, copula_prices, nearest_correlation, normal_quantile, price


def test_copula_limits():
    p, none = np.array([0.6, 0.7, 0.5]), np.zeros(3)
    free, _ = price(p, none, np.eye(3), {}, 200_000, 1)
    tied, _ = price(p, none, np.full((3, 3), 0.999999) + np.eye(3) * 1e-6, {}, 200_000, 1)
    assert free == pytest.approx(0.21, abs=0.005) and tied == pytest.approx(0.5, abs=0.005)
    rho = 0.4
    both, _ = price(np.array([0.5, 0.5]), np.zeros(2), np.array([[1, rho], [rho, 1]]), {}, 400_000, 2)
    assert both == pytest.approx(0.25 + math.asin(rho) / (2 * math.pi), abs=0.003)


def test_payouts_with_pushes():
    win, paid = price(np.array([0.5, 0.5, 0.5]), np.array([0.2, 0.2, 0.2]), np.eye(3), {(3, 0): 6.0, (2, 0): 3.0}, 400_000, 3)
    one_push, refund = 3 * 0.2 * 0.5**2, 3 * 0.2**2 * 0.8 + 0.2**3
    assert win == pytest.approx(0.125, abs=0.003) and paid == pytest.approx(0.125 * 6 + one_push * 3 + refund, abs=0.02)


def test_repair_and_quantile():
    bad = np.array([[1, 0.9, -0.9], [0.9, 1, 0.9], [-0.9, 0.9, 1]])
    fixed = nearest_correlation(bad)
    assert np.linalg.eigvalsh(fixed).min() > -1e-9 and np.allclose(np.diag(fixed), 1)
    assert normal_quantile(np.array([0.5, 0.975])) == pytest.approx([0, 1.959964], abs=1e-5)


def test_columns(spark):
    rows = spark.createDataFrame([(1, [0.5, 0.5], [0.0, 0.0], [1.0, 0.0, 0.0, 1.0]), (2, [], [], [])], "e long, p array<double>, push array<double>, rho array<double>")
    got = {r.e: (r.win, r.payout) for r in copula_prices(rows, "e", "p", "push", "rho", {(2, 0): 3.0}, 100_000).collect()}
    assert got[1] == pytest.approx((0.25, 0.75), abs=0.02) and got[2] == (0.0, 1.0)
    again = {r.e: (r.win, r.payout) for r in copula_prices(rows.repartition(2), "e", "p", "push", "rho", {(2, 0): 3.0}, 100_000).collect()}
    assert again == got
    f = spark.createDataFrame([(0.0, 1.0, -1.959964, 1.959964), (0.0, 2.0, -1.959964, 1.959964), (0.0, 0.1, -9.0, 9.0)], "m double, s double, a double, b double")
    assert [r.f for r in f.select(bounds_factor("m", "s", "a", "b").alias("f")).collect()] == pytest.approx([1.0, 0.5, 1.0], abs=1e-4)
    assert f.where(F.lit(False)).select(bounds_factor("m", "s", "a", "b").alias("f")).count() == 0


def test_entries_priced_together_match_draws_counted_one_by_one():
    from sabermill.operators.pricing import prices

    rng = np.random.default_rng(3)
    payouts = {(2, 0): 3.0, (3, 0): 6.0, (4, 0): 10.0, (4, 1): 1.5}
    for n in (1, 2, 4):
        p, push = rng.uniform(0.05, 1.0, (40, n)), rng.uniform(-0.05, 0.4, (40, n))
        rho = np.eye(n) + rng.choice([-0.6, 0.3], (40, 1, 1)) * (1 - np.eye(n))
        got = prices(p, push, rho, payouts, 4096, list(range(40)))
        for i in range(40):
            half = np.random.default_rng(i).standard_normal((2048, n)) @ np.linalg.cholesky(nearest_correlation(rho[i]) + 1e-12 * np.eye(n)).T
            upto = normal_quantile(np.minimum(p[i], 1 - 1e-12)), normal_quantile(np.clip(p[i] + push[i], 1e-12, 1 - 1e-12))
            won = paid = 0
            for z in np.concatenate([half, -half]):
                out = int(((z >= upto[0]) & (z < upto[1])).sum())
                wins = int((z < upto[0]).sum())
                won += wins == n
                paid += 1.0 if n - out < 2 else payouts.get((n - out, n - out - wins), 0.0)
            assert (got[0][i], got[1][i]) == pytest.approx((won / 4096, paid / 4096), abs=1e-12)
