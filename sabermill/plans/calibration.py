"""Scores of predictions: calibration, gates, verdicts, fits, splits and draws."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from sabermill.functions.odds import devig_power, prob_to_american, sigmoid, stable_round as r
from sabermill.plans.base import query
from sabermill.plans.profiles import numbered, ratio

c = F.col


def uniform(*parts: Column | str) -> Column:
    """A number in (0, 1) that depends on the parts alone, whatever the order or partition of rows: the first 32 bits of their MD5."""
    text = F.concat_ws("|", *[F.coalesce((c(p) if isinstance(p, str) else p).cast("string"), F.lit("")) for p in parts])
    return (F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0


def _u(*parts: str) -> str:
    """The same in DuckDB."""
    text = ", ".join(f"coalesce(CAST({p} AS VARCHAR), '')" for p in parts)
    return f"(CAST(CAST('0x' || substr(md5(concat_ws('|', {text})), 1, 8) AS BIGINT) AS DOUBLE) + 0.5) / 4294967296.0"


def outcomes(t) -> DataFrame:
    """Settled predictions with their outcome y: whether the result went over the line; pushes are left out."""
    return t.history.where("actual <> line").withColumn("y", (c("actual") > c("line")).cast("int"))


_Y = "y AS (SELECT *, CAST(actual > line AS INTEGER) AS y FROM history WHERE actual <> line)"


# ---- calibration


def equal_mass_edges(rows: DataFrame, keys: list[str], p: str, bins: int) -> DataFrame:
    """(keys, edges): distinct inner quantiles of ``p``."""
    at = [i / bins for i in range(1, bins)]
    return rows.groupBy(*keys).agg(F.array_distinct(F.percentile(p, F.array(*map(F.lit, at)))).alias("edges"))


@query("equal_mass_ece", f"""WITH {{history}}, {_Y}, e AS (SELECT league, market, list_distinct(quantile_cont(prob, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS edges FROM y GROUP BY league, market),
b AS (SELECT league, market, len(list_filter(edges, lambda x: round(x, 9) < round(prob, 9))) AS bin, count(*) AS n, avg(prob) AS p, avg(y) AS a FROM y JOIN e USING (league, market) GROUP BY ALL)
SELECT league, market, count(*) AS bins, round(sum(n * abs(p - a)) / sum(n) + 1e-7, 4) AS ece FROM b GROUP BY league, market""")
def ece(t):
    """Expected calibration error over bins of equal mass; equal edges are one, so heavy values don't make empty bins."""
    rows = outcomes(t)
    edged = rows.join(F.broadcast(equal_mass_edges(rows, ["league", "market"], "prob", 10)), ["league", "market"])
    place = F.size(F.filter("edges", lambda x: F.round(x, 9) < F.round(c("prob"), 9)))
    bins = edged.groupBy("league", "market", place.alias("bin")).agg(F.count("*").alias("n"), F.avg("prob").alias("p"), F.avg("y").alias("a"))
    return bins.groupBy("league", "market").agg(F.count("*").alias("bins"), r(F.sum(c("n") * F.abs(c("p") - c("a"))) / F.sum("n")).alias("ece"))


@query("segment_bias", "WITH {history} SELECT league, market, platform, round(abs(avg(line) - avg(actual)) / nullif(stddev_samp(actual), 0) + 1e-7, 4) AS z FROM history GROUP BY ALL")
def segment_bias(t):
    return t.history.groupBy("league", "market", "platform").agg(r(ratio(F.abs(F.avg("line") - F.avg("actual")), F.stddev_samp("actual"))).alias("z"))


@query("iqr_ratio", "WITH {history} SELECT league, market, round((quantile_cont(line, 0.75) - quantile_cont(line, 0.25)) / (quantile_cont(actual, 0.75) - quantile_cont(actual, 0.25)) + 1e-7, 4) AS spread FROM history GROUP BY ALL")
def iqr(t):
    width = lambda x: F.percentile(x, F.lit(0.75)) - F.percentile(x, F.lit(0.25))
    return t.history.groupBy("league", "market").agg(r(ratio(width("line"), width("actual"))).alias("spread"))


@query("brier_pairs", f"WITH {{history}}, {_Y} SELECT league, market, count(*) AS n, round(avg(pow(least(greatest(prob, 1e-6), 1 - 1e-6) - y, 2)) + 1e-7, 5) AS model, round(avg(pow(least(greatest(market_prob, 1e-6), 1 - 1e-6) - y, 2)) + 1e-7, 5) AS books FROM y WHERE platform % 7 > 0 GROUP BY league, market")
def brier_pairs(t):
    """Both Brier scores over the rows whose quote is authentic (here all but one platform in seven)."""
    clipped = lambda p: F.least(F.greatest(c(p), F.lit(1e-6)), F.lit(1 - 1e-6))
    score = lambda p: r(F.avg(F.pow(clipped(p) - c("y"), 2)), 5)
    return outcomes(t).where("platform % 7 > 0").groupBy("league", "market").agg(F.count("*").alias("n"), score("prob").alias("model"), score("market_prob").alias("books"))


@query("sharpness_and_divergence", f"""WITH {{history}}, {_Y}, d AS (SELECT market, abs(actual - line) / line AS gap, CAST((prob >= 0.7) = (y = 1) AS INTEGER) AS right_, prob, actual, line FROM y), q AS (SELECT market, quantile_cont(gap, [0.2, 0.4, 0.6, 0.8]) AS e FROM d GROUP BY market),
s AS (SELECT market, stddev_samp(prob) AS sd, avg(CAST(actual BETWEEN line * 0.5 AND line * 2 AS INTEGER)) AS cover FROM d GROUP BY market)
SELECT market, len(list_filter(e, lambda x: round(x, 9) < round(gap, 9))) AS bucket, count(*) AS n, round(avg(right_) + 1e-7, 4) AS accuracy, round(any_value(sd) + 1e-7, 4) AS sharpness, round(any_value(cover) + 1e-7, 4) AS coverage FROM d JOIN q USING (market) JOIN s USING (market) GROUP BY 1, 2""")
def sharpness(t):
    """Spread of the chances, accuracy by how far the projection is from the line, and the share of results inside an interval."""
    rows = outcomes(t).withColumns({"gap": F.abs(c("actual") - c("line")) / c("line"), "right": ((c("prob") >= 0.7) == (c("y") == 1)).cast("int")})
    whole = rows.groupBy("market").agg(F.percentile("gap", F.array(*[F.lit(x) for x in (0.2, 0.4, 0.6, 0.8)])).alias("e"), r(F.stddev_samp("prob")).alias("sharpness"), r(F.avg(c("actual").between(c("line") * 0.5, c("line") * 2).cast("int"))).alias("coverage"))
    rows = rows.join(F.broadcast(whole), "market").withColumn("bucket", F.size(F.filter("e", lambda x: F.round(x, 9) < F.round(c("gap"), 9))).cast("long"))
    return rows.groupBy("market", "bucket", "sharpness", "coverage").agg(F.count("*").alias("n"), r(F.avg("right")).alias("accuracy"))


@query("affine_correction", f"WITH {{history}}, {_Y}, f AS (SELECT league, regr_slope(y, prob) AS b, regr_intercept(y, prob) AS a FROM y WHERE day < DATE '1999-01-01' GROUP BY league) SELECT league, count(*) AS n, round(avg(least(greatest(a + b * prob, 0.01), 0.99)) + 1e-7, 4) AS corrected, round(avg(prob) + 1e-7, 4) AS raw FROM y JOIN f USING (league) WHERE day >= DATE '1999-01-01' GROUP BY league")
def affine_correction(t):
    """A straight line fitted on earlier days, applied to later ones."""
    rows, cut = outcomes(t), F.lit("1999-01-01").cast("date")
    line = rows.where(c("day") < cut).groupBy("league").agg(F.regr_slope("y", "prob").alias("b"), F.regr_intercept("y", "prob").alias("a"))
    fixed = F.least(F.greatest(c("a") + c("b") * c("prob"), F.lit(0.01)), F.lit(0.99))
    return rows.where(c("day") >= cut).join(F.broadcast(line), "league").groupBy("league").agg(F.count("*").alias("n"), r(F.avg(fixed)).alias("corrected"), r(F.avg("prob")).alias("raw"))


def isotonic(rows: DataFrame, x: str, y: str, weight: str) -> DataFrame:
    """(x, weight, fitted): the non-decreasing fit of y by x, as max over starts of min over ends of the mean in between; for as many distinct x as a lattice has.

    Rows must be added up by x first. The min-max formula needs no pooling loop: prefix sums give every interval's mean.
    """
    order = Window.orderBy(x)
    s = rows.select(x, weight, F.sum(c(weight) * c(y)).over(order).alias("sy"), F.sum(weight).over(order).alias("sw"), F.row_number().over(order).alias("i"))
    s = s.withColumns({"py": F.lag("sy", 1, 0.0).over(order), "pw": F.lag("sw", 1, 0).over(order)})
    a, b = s.select(c("i").alias("from"), "py", "pw"), s.select(c("i").alias("to"), c("sy").alias("ey"), c("sw").alias("ew"))
    mean = a.join(b, c("from") <= c("to")).select("from", "to", ((c("ey") - c("py")) / (c("ew") - c("pw"))).alias("m"))
    points = s.select(x, weight, "i").join(mean, (c("from") <= c("i")) & (c("i") <= c("to")))
    low = points.groupBy(x, weight, "i", "from").agg(F.min("m").alias("m"))
    return low.groupBy(x, weight).agg(F.max("m").alias("fitted"))


@query("isotonic_correction", f"""WITH {{history}}, {_Y}, g AS (SELECT round(prob, 3) AS x, count(*) AS n, avg(y) AS a FROM y GROUP BY 1), m AS (SELECT f.x AS fx, t.x AS tx, (SELECT sum(n * a) / sum(n) FROM g k WHERE k.x BETWEEN f.x AND t.x) AS m FROM g f JOIN g t ON f.x <= t.x),
l AS (SELECT g.x, n, fx, min(m) AS m FROM g JOIN m ON fx <= g.x AND g.x <= tx GROUP BY ALL) SELECT x, n, round(max(m) + 1e-7, 4) AS fitted FROM l GROUP BY x, n""")
def isotonic_correction(t):
    points = outcomes(t).groupBy(F.round("prob", 3).alias("x")).agg(F.count("*").alias("n"), F.avg("y").alias("a"))
    return isotonic(points, "x", "a", "n").select("x", "n", r(c("fitted")).alias("fitted"))


def platt(rows: DataFrame, x: str, y: str, steps: int = 8) -> tuple[float, float]:
    """Slope and intercept of a logistic fit by Newton steps; each step is one aggregation, and five sums come back."""
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = sigmoid(a * c(x) + b)
        w, d = p * (1 - p), p - c(y)
        s = rows.agg(F.sum(d * c(x)), F.sum(d), F.sum(w * c(x) * c(x)), F.sum(w * c(x)), F.sum(w)).first()
        if s[0] is None:
            return a, b
        det = s[2] * s[4] - s[3] * s[3]
        if det <= 1e-12:
            return a, b
        a, b = a - (s[4] * s[0] - s[3] * s[1]) / det, b - (s[2] * s[1] - s[3] * s[0]) / det
    return a, b


@query("platt_correction")
def platt_correction(t):
    points = outcomes(t).groupBy(F.round("prob", 3).alias("p"), "y").agg(F.count("*").alias("n"))
    rows = outcomes(t).withColumn("x", F.log(c("prob") / (1.0001 - c("prob"))))
    a, b = platt(rows, "x", "y")
    return points.groupBy("p").agg(F.sum("n").alias("n")).select("p", "n", r(sigmoid(F.lit(a) * F.log(c("p") / (1.0001 - c("p"))) + F.lit(b))).alias("fitted"))


@query("randomised_pit", f"""WITH {{history}}, h AS (SELECT okey, lnum, player, market, prob, least(floor(actual), 3) AS k FROM history), d AS (SELECT market, (CASE WHEN k = 0 THEN 0 ELSE 1 - pow(1 - prob * 0.4, k) END) + {_u('okey', 'lnum', 'player', 'i')} * (1 - pow(1 - prob * 0.4, k + 1) - CASE WHEN k = 0 THEN 0 ELSE 1 - pow(1 - prob * 0.4, k) END) AS pit FROM h, range(1, 6) g(i)),
n AS (SELECT market, pit, row_number() OVER (PARTITION BY market ORDER BY pit) AS i, count(*) OVER (PARTITION BY market) AS n FROM d) SELECT market, CAST(max(n) AS BIGINT) AS draws, round(avg(pit) + 1e-7, 4) AS mean, round(max(greatest(abs(i / n - pit), abs((i - 1) / n - pit))) + 1e-7, 4) AS ks FROM n GROUP BY market""")
def pit(t):
    """Uniform draws between the distribution function's two values at a result (here geometric), and their greatest distance from uniform.

    Ranks among all draws of a market come from counts by ten-thousandths, added up in order, and ranks inside those, so no task sorts a market.
    """
    rows = t.history.withColumn("k", F.least(F.floor("actual"), F.lit(3)))
    below = F.when(c("k") == 0, 0.0).otherwise(1 - F.pow(1 - c("prob") * 0.4, c("k")))
    upto = 1 - F.pow(1 - c("prob") * 0.4, c("k") + 1)
    drawn = rows.withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(5)))).select("market", (below + uniform("okey", "lnum", "player", "i") * (upto - below)).alias("pit"))
    drawn = drawn.withColumn("cell", F.floor(c("pit") * 10000))
    cells = drawn.groupBy("market", "cell").agg(F.count("*").alias("m"))
    order = Window.partitionBy("market").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("market", "cell", F.coalesce(F.sum("m").over(order), F.lit(0)).alias("before"), F.sum("m").over(Window.partitionBy("market")).alias("n"))
    placed = drawn.join(cells, ["market", "cell"]).withColumn("i", c("before") + F.row_number().over(Window.partitionBy("market", "cell").orderBy("pit")))
    off = F.greatest(F.abs(c("i") / c("n") - c("pit")), F.abs((c("i") - 1) / c("n") - c("pit")))
    return placed.groupBy("market").agg(F.max("n").alias("draws"), r(F.avg("pit")).alias("mean"), r(F.max(off)).alias("ks"))


@query("probability_pool", f"""WITH {{history}}, {_Y}, s AS (SELECT league, sum((y - market_prob) * (prob - market_prob)) AS a, sum(pow(prob - market_prob, 2)) AS b FROM y GROUP BY league)
SELECT league, round(least(greatest(a / nullif(b, 0), 0), 1) + 1e-7, 4) AS weight FROM s""")
def pool(t):
    """The weight of the model beside the books that makes the Brier score of the blend least: closed form from two sums, clipped to [0, 1]."""
    d = c("prob") - c("market_prob")
    s = outcomes(t).groupBy("league").agg(F.sum((c("y") - c("market_prob")) * d).alias("a"), F.sum(d * d).alias("b"))
    return s.select("league", r(F.least(F.greatest(ratio(c("a"), c("b")), F.lit(0.0)), F.lit(1.0))).alias("weight"))


@query("shape_regression", """WITH {history}, b AS (SELECT league, floor(line / 5) AS bin, count(*) AS n, ln(avg(actual)) AS x, ln(var_samp(actual)) AS z FROM history GROUP BY ALL HAVING count(*) >= 12 AND var_samp(actual) > 0),
s AS (SELECT league, sum(n) AS w, sum(n * x) AS sx, sum(n * z) AS sz, sum(n * x * z) AS sxz, sum(n * x * x) AS sxx, count(*) AS bins FROM b GROUP BY league HAVING count(*) > 1)
SELECT league, bins, round((w * sxz - sx * sz) / nullif(w * sxx - sx * sx, 0) + 1e-7, 2) AS power, round(sz / w - (w * sxz - sx * sz) / nullif(w * sxx - sx * sx, 0) * sx / w + 1e-7, 2) AS level FROM s""")
def shape_regression(t):
    """Variance as a power of the mean: a weighted straight line through the logarithms over bins of lines with rows enough."""
    b = t.history.groupBy("league", F.floor(c("line") / 5).alias("bin")).agg(F.count("*").alias("n"), F.log(F.avg("actual")).alias("x"), F.var_samp("actual").alias("v")).where("n >= 12 AND v > 0").withColumn("z", F.log("v"))
    n, x, z = c("n"), c("x"), c("z")
    s = b.groupBy("league").agg(F.sum(n).alias("w"), F.sum(n * x).alias("sx"), F.sum(n * z).alias("sz"), F.sum(n * x * z).alias("sxz"), F.sum(n * x * x).alias("sxx"), F.count("*").alias("bins")).where("bins > 1")
    power = ratio(c("w") * c("sxz") - c("sx") * c("sz"), c("w") * c("sxx") - c("sx") * c("sx"))
    return s.select("league", "bins", r(power, 2).alias("power"), r(c("sz") / c("w") - power * c("sx") / c("w"), 2).alias("level"))


# ---- bootstraps, gates and verdicts

#: The distribution function of a Poisson count of mean 1 at 0, 1, 2, ...
POISSON_ONE = [sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) for k in range(8)]


def poisson_weight(u: Column) -> Column:
    """How often a row stands in a resample: a Poisson count of mean 1 from a uniform number."""
    return sum((F.when(u > edge, 1).otherwise(0) for edge in POISSON_ONE), F.lit(0))


_WEIGHT = " + ".join(f"CAST(u > {edge!r} AS INTEGER)" for edge in POISSON_ONE)


@query("cluster_ratio_bootstrap", f"""WITH {{history}}, s AS (SELECT league, player, sum(actual) AS a, sum(line) AS b FROM history GROUP BY league, player), d AS (SELECT league, i, a, b, {_u('league', 'player', 'i')} AS u FROM s, range(0, 40) g(i)),
b AS (SELECT league, i, sum(({_WEIGHT}) * a) / sum(({_WEIGHT}) * b) AS q FROM d GROUP BY league, i)
SELECT league, round(avg(q) + 1e-7, 3) AS ratio, round(quantile_cont(q, 0.05) + 1e-7, 3) AS low, round(quantile_cont(q, 0.95) + 1e-7, 3) AS high FROM b GROUP BY league""")
def cluster_bootstrap(t):
    """Interval of a ratio of sums by resampling players, not rows: sums by player first, then a Poisson count a resample from hashed numbers."""
    clusters = t.history.groupBy("league", "player").agg(F.sum("actual").alias("a"), F.sum("line").alias("b"))
    drawn = clusters.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(39))))
    w = poisson_weight(uniform("league", "player", "i"))
    q = drawn.groupBy("league", "i").agg((F.sum(w * c("a")) / F.sum(w * c("b"))).alias("q"))
    return q.groupBy("league").agg(r(F.avg("q"), 3).alias("ratio"), r(F.percentile("q", F.lit(0.05)), 3).alias("low"), r(F.percentile("q", F.lit(0.95)), 3).alias("high"))


@query("ship_gates", f"""WITH {{history}}, {_Y}, m AS (SELECT league, market, count(*) AS n, avg(pow(prob - y, 2)) AS model, avg(pow(market_prob - y, 2)) AS books, abs(avg(prob) - avg(y)) AS bias, stddev_samp(prob) AS sharp FROM y GROUP BY league, market)
SELECT league, market, n >= 200 AS g_rows, model < books AS g_skill, bias < 0.2 AS g_bias, sharp > 0.05 AS g_sharp, round(books - model + 1e-7, 4) + 0.0 AS slack, n >= 200 AND model < books AND bias < 0.2 AND sharp > 0.05 AS ships FROM m""")
def ship_gates(t):
    """One row a cell: which gates it passes, by how much it beats the books, and whether it ships."""
    m = outcomes(t).groupBy("league", "market").agg(F.count("*").alias("n"), F.avg(F.pow(c("prob") - c("y"), 2)).alias("model"), F.avg(F.pow(c("market_prob") - c("y"), 2)).alias("books"), F.abs(F.avg("prob") - F.avg("y")).alias("bias"), F.stddev_samp("prob").alias("sharp"))
    gates = {"g_rows": c("n") >= 200, "g_skill": c("model") < c("books"), "g_bias": c("bias") < 0.2, "g_sharp": c("sharp") > 0.05}
    return m.withColumns(gates).select("league", "market", *gates, r(c("books") - c("model")).alias("slack"), F.forall(F.array(*gates), lambda g: g).alias("ships"))


@query("supersede_verdict", f"""WITH {{history}}, {_Y}, d AS (SELECT league, pow(market_prob - y, 2) - pow(prob - y, 2) AS gain, (prob - 0.5) * (2 * y - 1) AS a, (market_prob - 0.5) * (2 * y - 1) AS b FROM y),
s AS (SELECT league, count(*) AS n, avg(gain) AS gain, stddev_samp(gain) / sqrt(count(*)) AS se, avg(a) AS ma, avg(b) AS mb, stddev_samp(a) AS sa, stddev_samp(b) AS sb, covar_samp(a, b) AS ab FROM d GROUP BY league)
SELECT league, round(gain + 1e-7, 5) + 0.0 AS gain, round(gain - 1.96 * se + 1e-7, 5) + 0.0 AS low, round((sb * ma - sa * mb) / sqrt((2 * sa * sa * sb * sb - 2 * sa * sb * ab + 0.5 * ma * ma * sb * sb + 0.5 * mb * mb * sa * sa - ma * mb / (sa * sb) * ab * ab) / n) + 1e-7, 3) AS sharpe_z,
CASE WHEN gain - 1.96 * se > 0 THEN 'supersedes' WHEN gain + 1.96 * se < 0 THEN 'worse' ELSE 'undecided' END AS verdict FROM s""")
def supersede(t):
    """Paired comparison of two models: the interval of the Brier gain, and the z of the difference of Sharpe ratios (Jobson and Korkie, as corrected by Memmel)."""
    sign = 2 * c("y") - 1
    d = outcomes(t).select("league", (F.pow(c("market_prob") - c("y"), 2) - F.pow(c("prob") - c("y"), 2)).alias("gain"), ((c("prob") - 0.5) * sign).alias("a"), ((c("market_prob") - 0.5) * sign).alias("b"))
    s = d.groupBy("league").agg(F.count("*").alias("n"), F.avg("gain").alias("gain"), (F.stddev_samp("gain") / F.sqrt(F.count("*"))).alias("se"), *[f(x).alias(k + x) for x in "ab" for k, f in (("m", F.avg), ("s", F.stddev_samp))], F.covar_samp("a", "b").alias("ab"))
    sa, sb, ma, mb, ab = (c(x) for x in ("sa", "sb", "ma", "mb", "ab"))
    spread = 2 * sa * sa * sb * sb - 2 * sa * sb * ab + 0.5 * ma * ma * sb * sb + 0.5 * mb * mb * sa * sa - ma * mb / (sa * sb) * ab * ab
    half = 1.96 * c("se")
    verdict = F.when(c("gain") - half > 0, "supersedes").when(c("gain") + half < 0, "worse").otherwise("undecided")
    return s.select("league", r(c("gain"), 5).alias("gain"), r(c("gain") - half, 5).alias("low"), r((sb * ma - sa * mb) / F.sqrt(spread / c("n")), 3).alias("sharpe_z"), verdict.alias("verdict"))


@query("paired_runs", """WITH b AS (SELECT l_partkey AS player, CAST(l_shipdate AS DATE) AS day, l_quantity AS line, l_discount AS p FROM lineitem WHERE l_linestatus = 'O'), n AS (SELECT l_partkey AS player, CAST(l_shipdate AS DATE) AS day, l_quantity AS line, l_tax AS p FROM lineitem WHERE l_linenumber < 5 AND l_linestatus = 'O'),
bu AS (SELECT player, day, line, any_value(p) AS p FROM b GROUP BY player, day, line HAVING count(*) = 1), nu AS (SELECT player, day, line, any_value(p) AS p FROM n GROUP BY player, day, line HAVING count(*) = 1)
SELECT player, CAST(day AS VARCHAR) AS day, line, bu.p AS base, nu.p AS candidate FROM bu JOIN nu USING (player, day, line)""")
def paired_runs(t):
    """Events that two runs share exactly; a key that either run has twice is left out."""
    rows = t.lineitem.where("l_linestatus = 'O'").withColumn("day", c("l_shipdate").cast("date"))
    keys = [c("l_partkey").alias("player"), "day", c("l_quantity").alias("line")]

    def once(run: DataFrame, p: str, name: str) -> DataFrame:
        return run.groupBy(*keys).agg(F.first(p).alias(name), F.count("*").alias("n")).where("n = 1").drop("n")

    both = once(rows, "l_discount", "base").join(once(rows.where("l_linenumber < 5"), "l_tax", "candidate"), ["player", "day", "line"])
    return both.withColumn("day", c("day").cast("string"))


@query("gates_by_lifecycle", f"""WITH {{history}}, {_Y}, a AS (SELECT league, market, avg(pow(market_prob - y, 2)) - avg(pow(prob - y, 2)) AS skill FROM y WHERE day < DATE '1999-01-01' GROUP BY ALL),
b AS (SELECT league, market, count(*) AS settled, avg(pow(market_prob - y, 2)) - avg(pow(prob - y, 2)) AS live, avg(y) AS hit FROM y WHERE day >= DATE '1999-01-01' AND league <> 'N' GROUP BY ALL)
SELECT league, market, CAST(settled AS BIGINT) AS settled, CASE WHEN skill IS NULL OR skill <= -0.2 THEN 'not-shipped' WHEN settled IS NULL OR settled < 100 THEN 'in-test' WHEN live < -0.1 OR hit < 0.2 THEN 'demoted' ELSE 'graduated' END AS state FROM a LEFT JOIN b USING (league, market)""")
def gates_lifecycle(t):
    """Offline skill of every cell, joined to its live record where it has one, and the state that follows."""
    skill = F.avg(F.pow(c("market_prob") - c("y"), 2)) - F.avg(F.pow(c("prob") - c("y"), 2))
    cut = F.lit("1999-01-01").cast("date")
    offline = outcomes(t).where(c("day") < cut).groupBy("league", "market").agg(skill.alias("skill"))
    live = outcomes(t).where((c("day") >= cut) & (c("league") != "N")).groupBy("league", "market").agg(F.count("*").alias("settled"), skill.alias("live"), F.avg("y").alias("hit"))
    state = F.when(c("skill").isNull() | (c("skill") <= -0.2), "not-shipped").when(c("settled").isNull() | (c("settled") < 100), "in-test").when((c("live") < -0.1) | (c("hit") < 0.2), "demoted").otherwise("graduated")
    return offline.join(live, ["league", "market"], "left").select("league", "market", "settled", state.alias("state"))


@query("over_rate_diagnostics", f"WITH {{history}}, {_Y} SELECT league, count(*) FILTER (prob >= 0.75) AS over_n, round(avg(y) FILTER (prob >= 0.75) + 1e-7, 4) AS over_rate, count(*) FILTER (prob < 0.6) AS under_n, round(avg(y) FILTER (prob < 0.6) + 1e-7, 4) AS under_rate, round(avg(actual) / avg(line) + 1e-7, 4) AS level FROM y GROUP BY league")
def over_rates(t):
    high, low = c("prob") >= 0.75, c("prob") < 0.6
    return outcomes(t).groupBy("league").agg(F.count_if(high).alias("over_n"), r(F.avg(F.when(high, c("y")))).alias("over_rate"), F.count_if(low).alias("under_n"), r(F.avg(F.when(low, c("y")))).alias("under_rate"), r(F.avg("actual") / F.avg("line")).alias("level"))


@query("gate_shift_medians", "WITH b AS (SELECT l_returnflag AS a, l_linestatus AS b, l_suppkey % 5 AS k, l_partkey % 7 AS s, avg(l_quantity) AS v FROM lineitem WHERE l_linenumber <= 3 GROUP BY ALL), n AS (SELECT l_returnflag AS a, l_linestatus AS b, l_suppkey % 5 AS k, l_partkey % 7 AS s, avg(l_quantity) AS v FROM lineitem WHERE l_linenumber > 3 GROUP BY ALL) SELECT k AS gate, count(*) AS n, round(median(n.v - b.v) + 1e-7, 4) + 0.0 AS shift FROM n JOIN b USING (a, b, k, s) GROUP BY k HAVING count(*) >= 5")
def gate_shifts(t):
    """How far each gate moved between two runs of the same cells: the middle of the paired differences."""
    keys = [c("l_returnflag").alias("a"), c("l_linestatus").alias("b"), (c("l_suppkey") % 5).alias("gate"), (c("l_partkey") % 7).alias("s")]
    run = lambda which, name: t.lineitem.where(which).groupBy(*keys).agg(F.avg("l_quantity").alias(name))
    both = run("l_linenumber > 3", "confirm").join(run("l_linenumber <= 3", "board"), ["a", "b", "gate", "s"])
    return both.groupBy("gate").agg(F.count("*").alias("n"), r(F.median(c("confirm") - c("board"))).alias("shift")).where("n >= 5")


@query("band_by_family", "SELECT CAST(least(floor(l_quantity / 10), 4) AS BIGINT) AS band, round(avg(l_discount) FILTER (l_returnflag = 'A') + 1e-7, 4) AS \"A_mean\", count(*) FILTER (l_returnflag = 'A') AS \"A_n\", round(avg(l_discount) FILTER (l_returnflag = 'N') + 1e-7, 4) AS \"N_mean\", count(*) FILTER (l_returnflag = 'N') AS \"N_n\", round(avg(l_discount) FILTER (l_returnflag = 'R') + 1e-7, 4) AS \"R_mean\", count(*) FILTER (l_returnflag = 'R') AS \"R_n\" FROM lineitem GROUP BY 1")
def bands(t):
    """Success by band, closed on the left, and family, wide."""
    band = F.least(F.floor(c("l_quantity") / 10), F.lit(4)).alias("band")
    wide = t.lineitem.groupBy(band).pivot("l_returnflag", ["A", "N", "R"]).agg(r(F.avg("l_discount")).alias("mean"), F.count(F.lit(1)).alias("n"))
    return wide.select("band", *[F.coalesce(f"{k}_n", F.lit(0)).alias(f"{k}_n") for k in "ANR"], *[f"{k}_mean" for k in "ANR"])


@query("cell_run_times", "SELECT l_returnflag AS league, l_linestatus AS market, round(avg(l_quantity) + 1e-7, 4) AS seconds, count(*) AS runs FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), ())")
def run_times(t):
    return t.lineitem.select(c("l_returnflag").alias("league"), c("l_linestatus").alias("market"), "l_quantity").groupingSets([["league", "market"], []], "league", "market").agg(r(F.avg("l_quantity")).alias("seconds"), F.count("*").alias("runs")).select("league", "market", "seconds", "runs")


@query("run_cost_means", "WITH s AS (SELECT l_orderkey AS run, l_returnflag AS league, sum(CASE WHEN l_linenumber > 2 THEN l_quantity ELSE 0 END) AS cost FROM lineitem GROUP BY ALL HAVING sum(CASE WHEN l_linenumber > 2 THEN l_quantity ELSE 0 END) > 0) SELECT league, count(*) AS runs, round(avg(cost) + 1e-7, 4) AS cost FROM s GROUP BY league")
def run_costs(t):
    cost = t.lineitem.groupBy(c("l_orderkey").alias("run"), c("l_returnflag").alias("league")).agg(F.sum(F.when(c("l_linenumber") > 2, c("l_quantity")).otherwise(0.0)).alias("cost")).where("cost > 0")
    return cost.groupBy("league").agg(F.count("*").alias("runs"), r(F.avg("cost")).alias("cost"))


@query("zero_inflation_indices", "WITH k AS (SELECT l_suppkey AS team, CAST(floor(l_quantity / 9) AS BIGINT) AS y FROM lineitem), m AS (SELECT team, avg(y) AS m, var_samp(y) AS v, avg(CAST(y = 0 AS INTEGER)) AS p0 FROM k GROUP BY team) SELECT team, round(1 + ln(greatest(p0, 1e-9)) / m + 1e-7, 4) + 0.0 AS zip, round(p0 - CASE WHEN v > m THEN pow(m / v, m * m / (v - m)) ELSE exp(-m) END + 1e-7, 4) + 0.0 AS excess FROM m")
def zero_inflation(t):
    """How many more zeros there are than a Poisson count gives, and than a negative binomial fitted by moments."""
    m = t.lineitem.select(c("l_suppkey").alias("team"), F.floor(c("l_quantity") / 9).alias("y")).groupBy("team").agg(F.avg("y").alias("m"), F.var_samp("y").alias("v"), F.avg((c("y") == 0).cast("int")).alias("p0"))
    fitted = F.when(c("v") > c("m"), F.pow(c("m") / c("v"), c("m") * c("m") / (c("v") - c("m")))).otherwise(F.exp(-c("m")))
    return m.select("team", r(1 + F.log(F.greatest(c("p0"), F.lit(1e-9))) / c("m")).alias("zip"), r(c("p0") - fitted).alias("excess"))


@query("distinct_counts", "WITH {history} SELECT league, count(DISTINCT (player, day)) AS player_days, count(DISTINCT platform) AS platforms, count(*) AS n FROM history GROUP BY league")
def distinct_counts(t):
    return t.history.groupBy("league").agg(F.countDistinct("player", "day").alias("player_days"), F.countDistinct("platform").alias("platforms"), F.count("*").alias("n"))


@query("training_row_estimate", """WITH {history}, a AS (SELECT DISTINCT player, day FROM history WHERE league = 'A'), p AS (SELECT player, day, max(actual) AS usage FROM history GROUP BY player, day), q AS (SELECT quantile_cont(usage, 0.25) AS floor FROM p)
SELECT CAST(count(*) FILTER (a.player IS NOT NULL) AS BIGINT) AS archived, CAST(count(*) FILTER (a.player IS NULL AND usage > floor + 1e-9) AS BIGINT) AS used FROM p LEFT JOIN a ON a.player = p.player AND a.day = p.day, q""")
def row_estimate(t):
    """How many rows a matrix would have: played and archived ones, and others used more than the first quartile."""
    archived = t.history.where("league = 'A'").select("player", "day").distinct().withColumn("known", F.lit(True))
    played = t.history.groupBy("player", "day").agg(F.max("actual").alias("usage"))
    rows = played.join(archived, ["player", "day"], "left").join(F.broadcast(played.agg(F.percentile("usage", F.lit(0.25)).alias("floor"))))
    return rows.agg(F.count_if(c("known").isNotNull()).alias("archived"), F.count_if(c("known").isNull() & (c("usage") > c("floor") + 1e-9)).alias("used"))


# ---- top rows, splits and draws


@query("worst_cells", "SELECT l_suppkey AS team, l_returnflag AS league, round(avg(CASE WHEN l_linenumber > 6 THEN l_discount - l_tax END) + 1e-7, 4) + 0.0 AS skill FROM lineitem GROUP BY 1, 2 ORDER BY round(avg(CASE WHEN l_linenumber > 6 THEN l_discount - l_tax END) + 1e-7, 4) ASC NULLS LAST, 1, 2 LIMIT 25")
def worst(t):
    skill = r(F.avg(F.when(c("l_linenumber") > 6, c("l_discount") - c("l_tax")))).alias("skill")
    return t.lineitem.groupBy(c("l_suppkey").alias("team"), c("l_returnflag").alias("league")).agg(skill).orderBy(F.asc_nulls_last("skill"), "team", "league").limit(25)


@query("top_features", "WITH f AS (SELECT p_brand AS market, split_part(p_name, ' ', 2) AS feature, p_retailprice AS importance, p_partkey FROM part WHERE p_type <> 'SMALL'), d AS (SELECT market, feature, max(importance) AS importance FROM f GROUP BY ALL) SELECT market, feature, CAST(row_number() OVER (PARTITION BY market ORDER BY importance DESC, feature) AS BIGINT) AS place FROM d QUALIFY place <= 2")
def top_features(t):
    best = t.part.where("p_type <> 'SMALL'").groupBy(c("p_brand").alias("market"), F.split_part("p_name", F.lit(" "), F.lit(2)).alias("feature")).agg(F.max("p_retailprice").alias("importance"))
    return best.withColumn("place", numbered(["market"], F.desc("importance"), "feature").cast("long")).where("place <= 2").select("market", "feature", "place")


@query("temporal_and_hash_split", f"""WITH {{history}}, d AS (SELECT day, count(*) AS n FROM history GROUP BY day), s AS (SELECT day, (sum(n) OVER (ORDER BY day) - n) / sum(n) OVER () AS share FROM d),
h AS (SELECT CASE WHEN share < 0.7 THEN 'train' WHEN {_u('player', 'day')} < 0.5 THEN 'calibration' ELSE 'test' END AS part, player, day FROM history JOIN s USING (day)) SELECT part, count(*) AS n, CAST(count(DISTINCT player) AS BIGINT) AS players, CAST(min(day) AS VARCHAR) AS first FROM h GROUP BY part""")
def split(t):
    """The first 70 percent of rows by day train; later ones are parted by a hash of player and day, so that equal keys stay together. Days are counted before they are ordered."""
    days = t.history.groupBy("day").agg(F.count("*").alias("n"))
    order = Window.orderBy("day")  # one row a day
    share = (F.sum("n").over(order) - c("n")) / F.sum("n").over(Window.partitionBy())
    rows = t.history.join(days.select("day", share.alias("share")), "day")
    part = F.when(c("share") < 0.7, "train").when(uniform("player", "day") < 0.5, "calibration").otherwise("test")
    return rows.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.countDistinct("player").alias("players"), F.min("day").cast("string").alias("first"))


def draw_key(u: Column, weight: Column) -> Column:
    """Key of weighted sampling without replacement: the largest keys are the sample."""
    return F.log(u) / F.greatest(weight, F.lit(1e-12))


@query("weighted_day_draw", f"""WITH {{history}}, k AS (SELECT day, player, okey, lnum, line, ln({_u('day', 'player', 'okey', 'lnum', 'line')}) / greatest(prob - 0.5, 1e-12) AS key FROM history), b AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY day, player ORDER BY key DESC, okey, lnum, line) = 1)
SELECT CAST(day AS VARCHAR) AS day, player, okey, lnum FROM b QUALIFY row_number() OVER (PARTITION BY day ORDER BY key DESC, player) <= 3""")
def weighted_draw(t):
    """Three bets a day by weighted sampling without replacement, no player twice: keys depend on the row alone, so the draw is the same on every run."""
    key = draw_key(uniform("day", "player", "okey", "lnum", "line"), c("prob") - 0.5)
    best = t.history.withColumn("key", key).withColumn("k", numbered(["day", "player"], F.desc("key"), "okey", "lnum", "line")).where("k = 1")
    return best.withColumn("k", numbered(["day"], F.desc("key"), "player")).where("k <= 3").select(c("day").cast("string").alias("day"), "player", "okey", "lnum")


@query("diversity_weighted_draw", f"""WITH e AS (SELECT l_orderkey AS entry, l_orderkey % 40 AS slate, list(DISTINCT l_suppkey % 12) AS players, sum(l_extendedprice) AS value FROM lineitem GROUP BY ALL), p AS (SELECT *, percent_rank() OVER (PARTITION BY slate ORDER BY value, entry) AS pct FROM e),
f AS (SELECT slate, players AS chosen FROM p QUALIFY row_number() OVER (PARTITION BY slate ORDER BY value DESC, entry) = 1), j AS (SELECT entry, slate, pct, len(list_intersect(players, chosen)) / len(list_distinct(list_concat(players, chosen))) AS overlap FROM p JOIN f USING (slate))
SELECT slate, entry, round(pct * exp(-3 * overlap * (1 - pct)) + 1e-7, 4) AS weight FROM j QUALIFY row_number() OVER (PARTITION BY slate ORDER BY ln({_u('slate', 'entry')}) / greatest(round(pct * exp(-3 * overlap * (1 - pct)) + 1e-7, 4), 1e-12) DESC, entry) <= 5""")
def diversity_draw(t):
    """Entries drawn by rank and by how little they overlap with what is already chosen (here each slate's best)."""
    e = t.lineitem.groupBy(c("l_orderkey").alias("entry")).agg(F.collect_set(c("l_suppkey") % 12).alias("players"), F.sum("l_extendedprice").alias("value")).withColumn("slate", c("entry") % 40)
    e = e.withColumn("pct", F.percent_rank().over(Window.partitionBy("slate").orderBy("value", "entry")))
    chosen = e.groupBy("slate").agg(F.max_by("players", F.struct("value", -c("entry"))).alias("chosen"))
    overlap = F.size(F.array_intersect("players", "chosen")) / F.size(F.array_union("players", "chosen"))
    e = e.join(F.broadcast(chosen), "slate").withColumn("weight", r(c("pct") * F.exp(-3 * overlap * (1 - c("pct")))))
    e = e.withColumn("k", numbered(["slate"], F.desc(draw_key(uniform("slate", "entry"), c("weight"))), "entry"))
    return e.where("k <= 5").select("slate", "entry", "weight")


@query("balanced_training_set", f"""WITH {{history}}, {_Y}, n AS (SELECT league, count(*) FILTER (y = 1) AS up, count(*) FILTER (y = 0) AS down FROM y GROUP BY league), k AS (SELECT y.*, least(up, down) AS keep, row_number() OVER (PARTITION BY league, y ORDER BY {_u('okey', 'lnum', 'player', 'line')} , okey, lnum, player, line) AS rn FROM y JOIN n USING (league))
SELECT league, y, count(*) AS kept, round(avg(least(line, 45)) + 1e-7, 4) AS line FROM k WHERE rn <= keep GROUP BY league, y""")
def balanced(t):
    """As many rows over as under in each league: the larger side loses rows by hashed keys; extreme lines are clipped.

    A side's rows are not ranked in one task: keys are counted by ten-thousandths, and only rows in the cell where the quota ends are ranked.
    """
    rows = outcomes(t).withColumn("u", uniform("okey", "lnum", "player", "line")).withColumn("cell", F.floor(c("u") * 10000))
    size = rows.groupBy("league").agg(F.least(F.count_if(c("y") == 1), F.count_if(c("y") == 0)).alias("keep"))
    cells = rows.groupBy("league", "y", "cell").agg(F.count("*").alias("m"))
    before = F.coalesce(F.sum("m").over(Window.partitionBy("league", "y").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = cells.withColumn("before", before).join(F.broadcast(size), "league")
    placed = rows.join(cells, ["league", "y", "cell"]).where("before < keep")
    rank = c("before") + F.row_number().over(Window.partitionBy("league", "y", "cell").orderBy("u", "okey", "lnum", "player", "line"))
    kept = placed.withColumn("rank", rank).where("rank <= keep")
    return kept.groupBy("league", "y").agg(F.count("*").alias("kept"), r(F.avg(F.least("line", F.lit(45.0)))).alias("line"))


# ---- odds and targets


@query("odds_round_trip", """WITH {quotes}, p AS (SELECT entity, book, okey, lnum, ev, round(0.3 + 4 * under_prob, 4) AS o, round(0.35 + 4 * tax, 4) AS u FROM quotes), k AS (SELECT *, CASE WHEN abs(o / (o + u) - 0.5) > 0.05 THEN 1 ELSE 0 END AS lop FROM p)
SELECT entity, book, okey, lnum, ev, CASE WHEN o > 0.5 THEN round_even(-100 * o / (1 - o), 0) ELSE round_even(100 * (1 - o) / o, 0) END + 0.0 AS american, round(3 / (1 / o + 1 / u + 1 / (o + u)) + 1e-7, 4) AS harmonic, lop = 1 AS lopsided FROM k""")
def odds_trip(t):
    """American odds of a chance, and a harmonic mean."""
    o, u = F.round(0.3 + 4 * c("under_prob"), 4), F.round(0.35 + 4 * c("tax"), 4)
    values = F.filter(F.array(o, u, o + u), lambda x: x != 0)
    harmonic = F.size(values) / F.aggregate(values, F.lit(0.0), lambda a, x: a + 1 / x)
    return t.quotes.select("entity", "book", "okey", "lnum", "ev", (prob_to_american(o) + 0.0).alias("american"), r(harmonic).alias("harmonic"), (F.abs(o / (o + u) - 0.5) > 0.05).alias("lopsided"))


@query("power_devig", """WITH RECURSIVE p AS (SELECT DISTINCT round(0.3 + 6 * l_discount, 4) AS o, round(0.2 + 4 * l_tax, 4) AS u FROM lineitem), b AS (SELECT o, u, 0.0::DOUBLE AS lo, 8.0::DOUBLE AS hi, 0 AS i FROM p UNION ALL SELECT o, u, CASE WHEN pow(o, (lo + hi) / 2) + pow(u, (lo + hi) / 2) > 1 THEN (lo + hi) / 2 ELSE lo END, CASE WHEN pow(o, (lo + hi) / 2) + pow(u, (lo + hi) / 2) > 1 THEN hi ELSE (lo + hi) / 2 END, i + 1 FROM b WHERE i < 40)
SELECT o, u, round(CASE WHEN abs(o / (o + u) - 0.5) > 0.1 THEN pow(o, (lo + hi) / 2) ELSE o / (o + u) END + 1e-7, 4) AS fair FROM b WHERE i = 40""")
def power(t):
    """Lopsided prices lose their margin by a common power, others in proportion."""
    pairs = t.lineitem.select(F.round(0.3 + 6 * c("l_discount"), 4).alias("o"), F.round(0.2 + 4 * c("l_tax"), 4).alias("u")).distinct()
    share = c("o") / (c("o") + c("u"))
    return pairs.select("o", "u", r(F.when(F.abs(share - 0.5) > 0.1, devig_power(c("o"), c("u"))).otherwise(share)).alias("fair"))


#: Pairs (forward, back) of target normalisations: of the result, the player's mean, shrunk mean, last ten, and projected volume.
TARGETS = {
    "ratio": (lambda y, m, e, k, v: y / m, lambda z, m, e, k, v: z * m),
    "shrunk": (lambda y, m, e, k, v: y - e, lambda z, m, e, k, v: z + e),
    "recent": (lambda y, m, e, k, v: y - k, lambda z, m, e, k, v: z + k),
    "volume": (lambda y, m, e, k, v: y / v, lambda z, m, e, k, v: z * v),
}


@query("target_normalisations", """WITH {history}, m AS (SELECT player, avg(actual) AS m, count(*) AS n, max(actual) AS v FROM history GROUP BY player), g AS (SELECT avg(actual) AS g FROM history)
SELECT okey, lnum, history.player, line, round(actual / m + 1e-7, 4) + 0.0 AS ratio, round(actual - (n * m + 10 * g) / (n + 10) + 1e-7, 4) + 0.0 AS shrunk, round(actual - m / 2 + 1e-7, 4) + 0.0 AS recent, round(actual / v + 1e-7, 4) + 0.0 AS volume, true AS exact FROM history JOIN m USING (player), g""")
def targets(t):
    """All normalisations of a result, and whether each one's way back gives the result again."""
    m = t.history.groupBy("player").agg(F.avg("actual").alias("m"), F.count("*").alias("n"), F.max("actual").alias("v"))
    rows = t.history.join(m, "player").join(F.broadcast(t.history.agg(F.avg("actual").alias("g"))))
    e = (c("n") * c("m") + 10 * c("g")) / (c("n") + 10)
    args = (c("m"), e, c("m") / 2, c("v"))
    forward = {name: f(c("actual"), *args) for name, (f, _) in TARGETS.items()}
    exact = F.forall(F.array(*[F.abs(back(forward[name], *args) - c("actual")) < 1e-6 for name, (_, back) in TARGETS.items()]), lambda x: x)
    return rows.select("okey", "lnum", "player", "line", *[r(v).alias(k) for k, v in forward.items()], exact.alias("exact"))


@query("parlay_deciles", """WITH {history}, {y}, e AS (SELECT okey AS entry, exp(sum(ln(prob - 0.1))) AS p, CAST(min(y) AS INTEGER) AS won FROM y GROUP BY okey), q AS (SELECT list_distinct(quantile_cont(p, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS edges FROM e),
b AS (SELECT len(list_filter(edges, lambda x: round(x, 9) < round(p, 9))) AS bin, count(*) AS n, avg(p) AS predicted, avg(won) AS a FROM e, q GROUP BY 1)
SELECT bin, n, round(predicted + 1e-7, 4) AS predicted, round(a + 1e-7, 4) AS actual, round((a + 1.9208 / n - 1.96 * sqrt(a * (1 - a) / n + 0.9604 / (n * n))) / (1 + 3.8416 / n) + 1e-7, 4) + 0.0 AS low, round((a + 1.9208 / n + 1.96 * sqrt(a * (1 - a) / n + 0.9604 / (n * n))) / (1 + 3.8416 / n) + 1e-7, 4) AS high FROM b""".replace("{y}", _Y))
def parlay_deciles(t):
    """Entries in bins of equal mass by their predicted chance, with what came of them and its Wilson interval."""
    e = outcomes(t).groupBy(c("okey").alias("entry")).agg(F.exp(F.sum(F.log(c("prob") - 0.1))).alias("p"), F.min("y").alias("won"))
    rows = e.join(F.broadcast(equal_mass_edges(e, [], "p", 10)))
    place = F.size(F.filter("edges", lambda x: F.round(x, 9) < F.round(c("p"), 9))).cast("long")
    b = rows.groupBy(place.alias("bin")).agg(F.count("*").alias("n"), F.avg("p").alias("predicted"), F.avg("won").alias("a"))
    n, a = c("n"), c("a")
    half, down = 1.96 * F.sqrt(a * (1 - a) / n + 0.9604 / (n * n)), 1 + 3.8416 / n
    return b.select("bin", "n", r(c("predicted")).alias("predicted"), r(a).alias("actual"), r((a + 1.9208 / n - half) / down).alias("low"), r((a + 1.9208 / n + half) / down).alias("high"))


@query("parlay_metrics", """WITH {history}, {y}, e AS (SELECT okey AS entry, min(day) AS day, count(*) AS size, count(*) FILTER (y = 0) AS misses FROM y GROUP BY okey HAVING count(*) BETWEEN 2 AND 6),
t(size, misses, pays) AS (VALUES (2, 0, 3.0), (3, 0, 6.0), (4, 0, 10.0), (5, 0, 20.0), (6, 0, 37.5), (4, 1, 1.5), (5, 1, 2.0), (6, 1, 2.5)), p AS (SELECT e.*, round(least(coalesce(pays, 0), 100) * 2) / 2 - 1 AS profit FROM e LEFT JOIN t USING (size, misses)),
d AS (SELECT size, day, avg(profit) AS profit, count(*) AS n, count(*) FILTER (misses = 0) AS hit FROM p GROUP BY size, day) SELECT size, CAST(sum(n) AS BIGINT) AS entries, CAST(sum(hit) AS BIGINT) AS hits, round(sum(profit) + 1e-7, 3) + 0.0 AS profit FROM d GROUP BY size""".replace("{y}", _Y))
def parlay_metrics(t):
    """Entries by size: how many, how many without a miss, and the sum over days of the day's mean profit by the table of payouts."""
    e = outcomes(t).groupBy("okey").agg(F.min("day").alias("day"), F.count("*").alias("size"), F.count_if(c("y") == 0).alias("misses")).where("size BETWEEN 2 AND 6")
    paid = e.join(F.broadcast(payout_table(t)), ["size", "misses"], "left")
    profit = F.round(F.least(F.coalesce("pays", F.lit(0.0)), F.lit(100.0)) * 2) / 2 - 1
    days = paid.groupBy("size", "day").agg(F.avg(profit).alias("profit"), F.count("*").alias("n"), F.count_if(c("misses") == 0).alias("hit"))
    return days.groupBy("size").agg(F.sum("n").alias("entries"), F.sum("hit").alias("hits"), r(F.sum("profit"), 3).alias("profit"))


#: Multipliers by size and misses of one product.
PAYOUTS = [(2, 0, 3.0), (3, 0, 6.0), (4, 0, 10.0), (5, 0, 20.0), (6, 0, 37.5), (4, 1, 1.5), (5, 1, 2.0), (6, 1, 2.5)]


def payout_table(t) -> DataFrame:
    return t.spark.createDataFrame(PAYOUTS, "size long, misses long, pays double")


@query("payout_curves", "WITH t(size, misses, pays) AS (VALUES (2, 0, 3.0), (3, 0, 6.0), (4, 0, 10.0), (5, 0, 20.0), (6, 0, 37.5), (4, 1, 1.5), (5, 1, 2.0), (6, 1, 2.5)) SELECT CAST(n_regionkey AS BIGINT) AS platform, CAST(size AS BIGINT) AS size, CAST(misses AS BIGINT) AS misses, CAST(pays * CASE WHEN n_regionkey % 2 = 0 THEN 1 ELSE 0.9 END AS DOUBLE) AS pays FROM (SELECT DISTINCT n_regionkey FROM nation), t WHERE misses = 0 OR n_regionkey < 3")
def payout_curves(t):
    """Multiplier by platform, size and misses: a product's table, scaled by platform; some platforms pay nothing after a miss."""
    platforms = t.nation.select(c("n_regionkey").cast("long").alias("platform")).distinct()
    rows = platforms.join(F.broadcast(payout_table(t))).where("misses = 0 OR platform < 3")
    return rows.select("platform", "size", "misses", F.when(c("platform") % 2 == 0, c("pays")).otherwise(F.round(c("pays") * 0.9, 6)).alias("pays"))
