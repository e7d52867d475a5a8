"""Means, spreads and blends of predictive distributions as Column arithmetic; no Python runs."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F


def logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def log_pool(weight: Column, model: Column, books: Column) -> Column:
    """Geometric blend of two means, as pooling log chances gives for counts."""
    return F.exp(weight * F.log(model) + (1 - weight) * F.log(books))


def precision_pool(weight: Column, model: Column, model_sd: Column, books: Column, book_sd: Column) -> Column:
    """Blend of two locations by precision, each side's weighted."""
    a, b = weight / (model_sd * model_sd), (1 - weight) / (book_sd * book_sd)
    return (a * model + b * books) / (a + b)


def pooled_gate(weight: Column, model: Column, books: Column) -> Column:
    """Chances of a zero are blended straight; a side without one leaves it to the other."""
    return F.coalesce(weight * model + (1 - weight) * books, model, books, F.lit(0.0))


def fused_mean(family: Column, weight: Column, model: Column, books: Column, model_sd: Column, book_sd: Column) -> Column:
    """The blend by family: counts by logarithms, others by precision; without the books the model alone, and the other way round."""
    both = F.when(family.isin("poisson", "negbin"), log_pool(weight, model, books)).otherwise(precision_pool(weight, model, model_sd, books, book_sd))
    return F.coalesce(both, model, books)


def sanitised_books(books: Column, line: Column, model: Column, model_sd: Column) -> Column:
    """A book's mean beyond ten lines is a runaway: at most the model and four deviations."""
    return F.when(books > 10 * line, F.least(books, model + 4 * model_sd)).otherwise(books)


def winsorised(model: Column, books: Column, sd: Column, times: float = 3.0) -> Column:
    return F.least(F.greatest(model, books - times * sd), books + times * sd)


def skew_delta(alpha: Column) -> Column:
    return alpha / F.sqrt(1 + alpha * alpha)


def skew_location(mean: Column, scale: Column, alpha: Column) -> Column:
    """Location of a skew-normal of a given mean."""
    return mean - scale * skew_delta(alpha) * math.sqrt(2 / math.pi)


def skew_scale(variance: Column, alpha: Column) -> Column:
    """Scale of a skew-normal of a given variance."""
    return F.sqrt(variance / (1 - 2 * F.pow(skew_delta(alpha), 2) / math.pi))


def skew_shape(skewness: Column, cap: float = 0.99) -> Column:
    """Shape of a skew-normal of a given skewness, which is held inside what the family can have."""
    most = cap * 0.9952717
    g = F.least(F.greatest(skewness, F.lit(-most)), F.lit(most))
    two_thirds = F.pow(F.abs(g), 2 / 3)
    delta = F.sqrt(math.pi / 2 * two_thirds / (two_thirds + ((4 - math.pi) / 2) ** (2 / 3)))
    return F.signum(g) * delta / F.sqrt(1 - delta * delta)


def decoded_mean(family: Column, first: Column, second: Column, gate: Column) -> Column:
    """Mean from a family's raw parameters: rate; size and chance; shape and rate; location and scale; less the share of extra zeros."""
    mean = F.when(family == "poisson", first).when(family == "negbin", first * (1 - second) / second).when(family == "gamma", first / second).otherwise(first)
    return (1 - F.coalesce(gate, F.lit(0.0))) * mean


def predictive_sd(family: Column, mean: Column, shape: Column, gate: Column) -> Column:
    """Deviation in closed form, extra zeros included."""
    g = F.coalesce(gate, F.lit(0.0))
    variance = F.when(family == "poisson", mean).when(family == "negbin", mean + mean * mean / shape).when(family == "gamma", mean * mean / shape).otherwise(shape * shape)
    return F.sqrt((1 - g) * (variance + g * mean * mean))


def integer_settlement(below: Column, upto: Column) -> Column:
    """(under, push, over) from the distribution function just under the line and at it."""
    return F.struct(below.alias("under"), (upto - below).alias("push"), (1 - upto).alias("over"))


def poisson_cdf(k: Column, mean: Column) -> Column:
    """Distribution function of a Poisson count, as one fold over its terms; negative k: zero."""
    start = F.struct(F.exp(-mean).alias("term"), F.exp(-mean).alias("sum"))

    def more(s: Column, i: Column) -> Column:
        term = s["term"] * mean / i
        return F.struct(term.alias("term"), (s["sum"] + term).alias("sum"))

    n = F.greatest(k, F.lit(0)).cast("int")
    terms = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    return F.when(k < 0, 0.0).otherwise(F.aggregate(terms, start, more, lambda s: F.least(s["sum"], F.lit(1.0))))


def geometric_cdf(k: Column, mean: Column) -> Column:
    """Distribution function of a negative binomial of size 1."""
    return F.when(k < 0, 0.0).otherwise(1 - F.pow(mean / (1 + mean), F.floor(k) + 1))


def exponential_cdf(x: Column, mean: Column) -> Column:
    return F.when(x < 0, 0.0).otherwise(1 - F.exp(-x / mean))
