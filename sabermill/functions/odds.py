"""Odds, stakes and probability transforms as Column expressions; all stay inside code generation."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def stable_round(x: Column, digits: int = 4) -> Column:
    """Rounds a double; the nudge keeps exact ties away, which engines round differently."""
    return F.round(x.cast("double") + F.lit(1e-7), digits)


def american_to_prob(odds: Column) -> Column:
    return F.when(odds > 0, 100.0 / (odds + 100.0)).otherwise(-odds / (-odds + 100.0))


def prob_to_american(p: Column) -> Column:
    """Rounded to the nearest even integer on ties."""
    return F.bround(F.when(p > 0.5, -100.0 * p / (1 - p)).otherwise(100.0 * (1 - p) / p), 0)


def devig(over: Column, under: Column, hold: float = 1.0652) -> Column:
    """No-vig over probability by proportion; a one-sided price is divided by the usual hold."""
    return F.when(over.isNull(), 1 - under / hold).when(under.isNull(), over / hold).otherwise(over / (over + under))


def devig_power(over: Column, under: Column, steps: int = 40) -> Column:
    """The k that solves over^k + under^k = 1 by a fixed number of bisections in [0, 8], as one fold."""
    start = F.struct(F.lit(0.0).alias("lo"), F.lit(8.0).alias("hi"))

    def halve(s: Column, _: Column) -> Column:
        mid = (s["lo"] + s["hi"]) / 2
        high = F.pow(over, mid) + F.pow(under, mid) > 1
        return F.struct(F.when(high, mid).otherwise(s["lo"]).alias("lo"), F.when(high, s["hi"]).otherwise(mid).alias("hi"))

    k = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, halve, lambda s: (s["lo"] + s["hi"]) / 2)
    return F.pow(over, k)


def logit(p: Column, eps: float = 1e-6) -> Column:
    q = F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))
    return F.log(q / (1 - q))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def temperature(p: Column, t: float) -> Column:
    return sigmoid(logit(p) / t)


def interpolate(x: Column, knots: list[tuple[float, float]]) -> Column:
    """Piecewise-linear map through sorted knots, flat outside them."""
    out = F.lit(float(knots[-1][1]))
    for (x0, y0), (x1, y1) in reversed(list(zip(knots, knots[1:]))):
        out = F.when(x < x1, y0 + (x - x0) * ((y1 - y0) / (x1 - x0))).otherwise(out)
    return F.when(x <= knots[0][0], F.lit(float(knots[0][1]))).otherwise(out)


def kelly_fraction(p: Column, payout: Column, share: float = 0.25, cap: float = 0.005, shrink: float = 0.0) -> Column:
    q = 0.5 + (p - 0.5) * (1 - shrink)
    full = (payout * q - (1 - q)) / F.nullif(payout, F.lit(0.0))
    return F.least(F.greatest(full, F.lit(0.0)) * share, F.lit(cap))


def stake(bankroll: Column, fraction: Column) -> Column:
    """Money in cents, rounded down, never negative."""
    return F.greatest(F.floor(bankroll * fraction * 100 + F.lit(1e-6)) / 100, F.lit(0.0)).cast("decimal(18,2)")


def payout(boost: Column, plain: Column) -> Column:
    """``plain`` platforms pay boost - 1, others 100/110 of the boost; non-finite pays nothing."""
    value = F.when(plain, boost - 1).otherwise(boost * (100.0 / 110.0))
    return F.when(value.isNull() | F.isnan(value) | (F.abs(value) == float("inf")), 0.0).otherwise(value)


def signed_clv(open_: Column, close: Column, over: Column) -> Column:
    return F.when(over, close - open_).otherwise(open_ - close)


def shrink(x: Column, n: Column, prior: Column, k: float = 10.0) -> Column:
    """Empirical-Bayes shrinkage n/(n+k) x + k/(n+k) prior."""
    return (n * F.coalesce(x, F.lit(0.0)) + k * prior) / (n + k)


def usable(ev: Column, line: Column, cap: float = 2000.0, times: float = 5.0) -> Column:
    """Finite, positive, at most ``cap`` and ``times`` the line, and not that product itself (a clamp's mark)."""
    fine = ev.isNotNull() & ~F.isnan(ev) & (ev > 0) & (ev <= cap)
    return fine & (line.isNull() | (line <= 0) | ((ev <= times * line) & (F.abs(ev - times * line) > 1e-9)))


def lifecycle(skill: Column, settled: Column, live_skill: Column, precision: Column) -> Column:
    """First rule that holds: never shipped, still in test, demoted, graduated."""
    return F.when(skill.isNull() | (skill <= 0), "not-shipped").when(settled.isNull() | (settled < 100), "in-test").when((live_skill < 0) | (precision < 0.5), "demoted").otherwise("graduated")


def cut_right(x: Column, low: float, width: float) -> Column:
    """Bin number of (low + i width, low + (i + 1) width], in whole thousandths so that edges are exact."""
    milli, lo, w = F.round(x * 1000).cast("long"), round(low * 1000), round(width * 1000)
    return (F.ceil((milli - lo) / F.lit(float(w))) - 1).cast("long")


def poisson_binomial(probs: Column) -> Column:
    """The distribution of the number of successes, as a fold of convolutions over an array of probabilities."""
    def step(pmf: Column, p: Column) -> Column:
        longer = F.concat(pmf, F.array(F.lit(0.0)))
        moved = F.concat(F.array(F.lit(0.0)), pmf)
        return F.zip_with(longer, moved, lambda a, b: a * (1 - p) + b * p)

    return F.aggregate(probs, F.array(F.lit(1.0)), step)


def harmonic_mean(values: Column) -> Column:
    """Of the non-zero entries of an array."""
    some = F.filter(values, lambda x: x.isNotNull() & (x != 0))
    return F.size(some) / F.nullif(F.aggregate(some, F.lit(0.0), lambda a, x: a + 1 / x), F.lit(0.0))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-|-$", "")
