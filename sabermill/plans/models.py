"""Distributions, searches and simulations: SQL can't express them, tests hold them against small brute force."""

from __future__ import annotations

from pyspark.sql import functions as F

from sabermill.functions import distributions as dist
from sabermill.functions.odds import stable_round
from sabermill.operators import search
from sabermill.plans.base import query


_COUNTS = "list_sum(list_transform(range(0, CAST({k} AS BIGINT) + 1), lambda i: {pmf}))"
_POISSON, _NEGBIN = "exp(i * ln(mean) - mean - lgamma(i + 1))", "exp(lgamma(4 + i) - lgamma(4) - lgamma(i + 1) + 4 * ln(4 / (4 + mean)) + i * ln(mean / (4 + mean)))"


def _half(pmf: str) -> str:
    """Half below the line and half up to it, by plain sums."""
    below = _COUNTS.format(k="greatest(ceil(line) - 1, 0)", pmf=pmf)
    return f"(CASE WHEN ceil(line) < 1 THEN 0 ELSE {below} END + {_COUNTS.format(k='floor(line)', pmf=pmf)}) / 2"


@query("under_probabilities", f"""WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE l_linenumber % 3 WHEN 0 THEN 'poisson' WHEN 1 THEN 'negbin' ELSE 'gamma' END AS family, l_quantity / 2 AS line, l_extendedprice / 2500 + 1 AS mean FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, family, round(CASE family WHEN 'poisson' THEN {_half(_POISSON)} WHEN 'negbin' THEN {_half(_NEGBIN)} ELSE 1 - exp(-4 * line / mean) * (1 + 4 * line / mean + pow(4 * line / mean, 2) / 2 + pow(4 * line / mean, 3) / 6) END + 1e-7, 5) AS under FROM r""")
def under(t):
    """Poisson, negative binomial of size 4 and gamma of shape 4, whose distribution function SQL can write out."""
    family = F.element_at(F.array(*map(F.lit, ("poisson", "negbin", "gamma"))), (F.col("l_linenumber") % 3 + 1).cast("int"))
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", family.alias("family"), (F.col("l_quantity") / 2).alias("line"), (F.col("l_extendedprice") / 2500 + 1).alias("mean"))
    p = dist.under_prob("family", "line", "mean", F.lit(4.0))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "family", stable_round(p, 5).alias("under"))


@query("under_normal")
def under_normal(t):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_quantity") / 2).alias("line"), (F.col("l_extendedprice") / 2500 + 1).alias("mean"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", F.round(dist.under_prob(F.lit("normal"), "line", "mean", F.lit(4.0)), 6).alias("under"))


@query("means_from_prices")
def means(t):
    family = F.when(F.col("s_suppkey") % 2 == 0, "normal").otherwise("poisson")
    rows = t.supplier.select("s_suppkey", family.alias("family"), (F.col("s_suppkey") % 9 + 2.5).alias("line"))
    return rows.select("s_suppkey", "family", F.round(dist.mean_from_price("family", "line", F.lit(0.45), F.lit(2.0)), 5).alias("mean"))


@query("poisson_crps", f"""WITH {{log}}, r AS (SELECT player, avg(value) / 10 AS mean, floor(max(value) / 10) AS a FROM log GROUP BY player), k AS (SELECT player, mean, a, unnest(range(0, 120)) AS k FROM r),
f AS (SELECT player, a, k, least({_COUNTS.format(k='k', pmf=_POISSON)}, 1) AS f FROM k) SELECT player, round(sum(pow(f - CASE WHEN a <= k THEN 1 ELSE 0 END, 2)) + 1e-7, 5) AS crps FROM f GROUP BY player""")
def crps(t):
    return t.log.groupBy("player").agg(F.avg("value").alias("m"), F.max("value").alias("a")).select("player", stable_round(dist.poisson_crps(F.col("m") / 10, F.floor(F.col("a") / 10)), 5).alias("crps"))


def _legs(t):
    return t.lineitem.groupBy(F.col("l_orderkey").alias("game"), F.col("l_partkey").alias("leg")).agg(F.max("l_suppkey").alias("player"), F.max(0.5 + 2 * F.col("l_discount")).alias("prob"), F.max(1.4 + F.col("l_tax") * 5).alias("boost"))


@query("beam_search")
def beam(t):
    return search.beam_search(_legs(t), "game", "leg", "player", "prob", "boost")


@query("ranked_greedy_entries")
def greedy(t):
    rows = t.lineitem.groupBy(F.col("l_orderkey").alias("entry")).agg(F.collect_set(F.col("l_suppkey")).alias("legs"), F.sum("l_extendedprice").alias("value"), F.floor(F.first("l_orderkey") / 300).alias("slate"))
    return search.ranked_greedy(rows, "slate", "entry", "legs", "value")


@query("joint_kelly")
def kelly(t):
    rows = t.orders.select(F.col("o_orderkey").alias("bet"), F.floor(F.col("o_orderkey") / 400).alias("slate"), (0.45 + (F.col("o_orderkey") % 30) / 100).alias("prob"), F.lit(1.0).alias("payout"))
    return search.joint_kelly(rows, "slate", "bet", "prob", "payout")


@query("bankroll_simulation")
def simulation(t):
    rows = t.events.select(F.col("user_id").alias("run"), F.col("ts").cast("date").alias("day"), (F.col("value") / 200 + 0.25).alias("prob"), F.lit(1.0).alias("payout"))
    return search.simulate(rows, "run", "day", "prob", "payout")


@query("under_other_families")
def other_families(t):
    line, mean = F.col("l_quantity") / 2, F.col("l_extendedprice") / 2500 + 1
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", line.alias("line"), mean.alias("mean"))
    skew = dist.skew_normal_under("line", "mean", F.sqrt("mean"), F.lit(2.0))
    double = dist.under_prob(F.lit("doublepoisson"), "line", "mean", F.lit(0.8))
    rows = rows.withColumns({"skew": skew, "double": double})
    mixed = dist.mixture([(F.lit(0.3), F.col("skew")), (F.lit(0.7), F.col("double"))])
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", *[F.round(c, 6).alias(n) for n, c in (("skew", F.col("skew")), ("double", F.col("double")), ("inflated", dist.zero_inflated(F.col("double"), F.lit(0.1), F.col("line"))), ("mixed", mixed))])
