"""Scoring of offers, settlement of history and entries, repair of quotes, and correlations."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from sabermill.functions import fusion as fu
from sabermill.functions.odds import stable_round as r
from sabermill.operators.asof import latest_per_key
from sabermill.plans.base import half_weight, query
from sabermill.plans.offers import TIES, place

c = F.col
KEYS = ["okey", "lnum", "player", "price"]
_KEYS = "okey, lnum, player, price"
_FAMILY = "CASE lnum % 4 WHEN 0 THEN 'poisson' WHEN 1 THEN 'negbin' WHEN 2 THEN 'gamma' ELSE 'normal' END"


def families(t) -> DataFrame:
    names = F.array(*map(F.lit, ("poisson", "negbin", "gamma", "normal")))
    return t.offers.withColumn("family", F.element_at(names, (c("lnum") % 4 + 1).cast("int")))


# ---- distributions


@query("fused_means", f"""WITH {{offers}}, f AS (SELECT *, {_FAMILY} AS family, CASE WHEN lnum % 5 > 0 THEN proj END AS m, CASE WHEN lnum % 7 > 0 THEN line END AS b, 1 + sharp AS ms, 2 - over AS bs FROM offers)
SELECT {_KEYS}, round(coalesce(CASE WHEN family IN ('poisson', 'negbin') THEN exp(over * ln(m) + (1 - over) * ln(b)) ELSE (over / (ms * ms) * m + (1 - over) / (bs * bs) * b) / (over / (ms * ms) + (1 - over) / (bs * bs)) END, m, b) + 1e-7, 4) AS fused, round(over * 0.1 + (1 - over) * 0.3 + 1e-7, 4) AS gate FROM f""")
def fused(t):
    model, books = F.when(c("lnum") % 5 > 0, c("proj")), F.when(c("lnum") % 7 > 0, c("line"))
    mean = fu.fused_mean(c("family"), c("over"), model, books, 1 + c("sharp"), 2 - c("over"))
    return families(t).select(*KEYS, r(mean).alias("fused"), r(fu.pooled_gate(c("over"), F.lit(0.1), F.lit(0.3))).alias("gate"))


@query("sanitised_blend", f"WITH {{offers}}, f AS (SELECT *, CASE WHEN price > 10 * line THEN least(price, proj + 4 * (1 + sharp)) ELSE price END AS b FROM offers) SELECT {_KEYS}, round(b + 1e-7, 4) AS books, round(least(greatest(proj, b - 3 * (1 + sharp)), b + 3 * (1 + sharp)) + 1e-7, 4) AS model FROM f")
def sanitised(t):
    sd = 1 + c("sharp")
    books = fu.sanitised_books(c("price"), c("line"), c("proj"), sd)
    return t.offers.select(*KEYS, r(books).alias("books"), r(fu.winsorised(c("proj"), books, sd)).alias("model"))


@query("skew_normal_moments", f"""WITH {{offers}}, d AS (SELECT *, over * 4 - 2 AS alpha, line AS variance, sharp * 3 - 1.2 AS g FROM offers), e AS (SELECT *, alpha / sqrt(1 + alpha * alpha) AS delta, least(greatest(g, -0.985318983), 0.985318983) AS k FROM d), s AS (SELECT *, sqrt(variance / (1 - 2 * delta * delta / pi())) AS scale, sqrt(pi() / 2 * pow(abs(k), 2.0 / 3) / (pow(abs(k), 2.0 / 3) + pow((4 - pi()) / 2, 2.0 / 3))) AS q FROM e)
SELECT {_KEYS}, round(scale + 1e-7, 4) AS scale, round(proj - scale * delta * sqrt(2 / pi()) + 1e-7, 4) + 0.0 AS location, round(sign(k) * q / sqrt(1 - q * q) + 1e-7, 3) + 0.0 AS shape FROM s""")
def moments(t):
    alpha = c("over") * 4 - 2
    scale = fu.skew_scale(c("line"), alpha)
    return t.offers.select(*KEYS, r(scale).alias("scale"), r(fu.skew_location(c("proj"), scale, alpha)).alias("location"), r(fu.skew_shape(c("sharp") * 3 - 1.2), 3).alias("shape"))


@query("decoded_means_and_spread", f"""WITH {{offers}}, f AS (SELECT *, {_FAMILY} AS family, CASE WHEN lnum % 3 = 0 THEN 0.1 END AS gate FROM offers), m AS (SELECT *, (1 - coalesce(gate, 0)) * CASE family WHEN 'negbin' THEN line * (1 - sharp) / sharp WHEN 'gamma' THEN line / sharp ELSE line END AS mean FROM f)
SELECT {_KEYS}, round(mean + 1e-7, 4) AS mean, round(sqrt((1 - coalesce(gate, 0)) * (CASE family WHEN 'poisson' THEN mean WHEN 'negbin' THEN mean + mean * mean / 4 WHEN 'gamma' THEN mean * mean / 4 ELSE 16 END + coalesce(gate, 0) * mean * mean)) + 1e-7, 4) AS sd FROM m""")
def decoded(t):
    gate = F.when(c("lnum") % 3 == 0, 0.1)
    mean = fu.decoded_mean(c("family"), c("line"), c("sharp"), gate)
    return families(t).select(*KEYS, r(mean).alias("mean"), r(fu.predictive_sd(c("family"), mean, F.lit(4.0), gate)).alias("sd"))


@query("book_shape", f"WITH {{offers}} SELECT {_KEYS}, round(CASE WHEN league = 'A' THEN sqrt(1.3 * pow(line, 1.2)) ELSE 0.4 * line END + 1e-7, 4) AS scale, round(CASE WHEN league = 'A' THEN 0.2 + 0.01 * line ELSE 0 END + 1e-7, 4) AS skew FROM offers")
def book_shape(t):
    """Variance as a power of the mean and skewness as a line, for leagues that have both configured; else a share of the mean and none."""
    known = c("league") == "A"
    return t.offers.select(*KEYS, r(F.when(known, F.sqrt(1.3 * F.pow("line", F.lit(1.2)))).otherwise(0.4 * c("line"))).alias("scale"), r(F.when(known, 0.2 + 0.01 * c("line")).otherwise(0.0)).alias("skew"))


_POISSON = "list_sum(list_transform(range(0, CAST({k} AS BIGINT) + 1), lambda i: exp(-{m} + i * ln({m}) - lgamma(i + 1))))"


@query("integer_settlement", f"""WITH {{offers}}, f AS (SELECT *, CAST(floor(line / 5) AS BIGINT) / 2.0 AS l, proj / 6 + 0.5 AS m FROM offers), p AS (SELECT *, CASE WHEN ceil(l) - 1 < 0 THEN 0 ELSE {_POISSON.format(k='greatest(ceil(l) - 1, 0)', m='m')} END AS below, {_POISSON.format(k='floor(l)', m='m')} AS upto FROM f)
SELECT {_KEYS}, round(below + 1e-7, 5) AS under, round(upto - below + 1e-7, 5) AS push, round(1 - upto + 1e-7, 5) AS over FROM p""")
def settlement(t):
    """Chances under, at and over a line, by the counts just below it and at it; a half line has no push."""
    line, mean = F.floor(c("line") / 5) / 2.0, c("proj") / 6 + 0.5
    s = fu.integer_settlement(fu.poisson_cdf(F.ceil(line) - 1, mean), fu.poisson_cdf(F.floor(line), mean))
    return t.offers.select(*KEYS, s.alias("s")).select(*KEYS, *[r(c(f"s.{k}"), 5).alias(k) for k in ("under", "push", "over")])


@query("push_mass", f"WITH {{offers}}, f AS (SELECT *, CAST(floor(line / 5) AS BIGINT) / 2.0 AS l, proj / 6 + 0.5 AS m FROM offers) SELECT {_KEYS}, round(CASE WHEN l <> floor(l) THEN 0 WHEN lnum % 2 = 0 THEN exp(-m + l * ln(m) - lgamma(l + 1)) ELSE 0 END + 1e-7, 5) AS push FROM f")
def push_mass(t):
    """Mass on the line: none for a half line or for a continuous family (here odd lines)."""
    line, mean = F.floor(c("line") / 5) / 2.0, c("proj") / 6 + 0.5
    mass = fu.poisson_cdf(F.floor(line), mean) - fu.poisson_cdf(F.floor(line) - 1, mean)
    return t.offers.select(*KEYS, r(F.when((line == F.floor(line)) & (c("lnum") % 2 == 0), mass).otherwise(0.0), 5).alias("push"))


@query("combined_market_pmf", """WITH {log}, d AS (SELECT player, team, CAST(least(floor(value / 10), 6) AS BIGINT) AS k, count(*) AS n FROM log WHERE team IN ('click', 'view') GROUP BY ALL), p AS (SELECT player, team, k, n / sum(n) OVER (PARTITION BY player, team) AS p FROM d)
SELECT a.player, a.k + b.k AS k, round(sum(a.p * b.p) + 1e-7, 5) AS p FROM p a JOIN p b ON a.player = b.player AND a.team = 'click' AND b.team = 'view' GROUP BY 1, 2""")
def combined(t):
    """The distribution of the sum of two independent counts: their tables joined by player, products added up by sum."""
    d = t.log.where("team IN ('click', 'view')").groupBy("player", "team", F.least(F.floor(c("value") / 10), F.lit(6)).alias("k")).agg(F.count("*").alias("n"))
    d = d.withColumn("p", c("n") / F.sum("n").over(Window.partitionBy("player", "team")))
    one = lambda team, s: d.where(c("team") == team).select("player", c("k").alias(f"k{s}"), c("p").alias(f"p{s}"))
    both = one("click", "a").join(one("view", "b"), "player")
    return both.groupBy("player", (c("ka") + c("kb")).alias("k")).agg(r(F.sum(c("pa") * c("pb")), 5).alias("p"))


@query("gamma_crps", f"WITH {{offers}} SELECT {_KEYS}, round(abs(proj - line) + CASE WHEN line > proj THEN 0 ELSE 0 END + 1e-7, 4) AS gap, round(line + 2 * proj * exp(-line / proj) - 1.5 * proj + 1e-7, 4) + 0.0 AS crps FROM offers")
def gamma_crps(t):
    """Continuous ranked probability score of an exponential (gamma of shape 1) forecast in closed form, beside the plain error."""
    y, m = c("line"), c("proj")
    return t.offers.select(*KEYS, r(F.abs(m - y)).alias("gap"), r(y + 2 * m * F.exp(-y / m) - 1.5 * m).alias("crps"))


@query("reconstructed_probability", f"WITH {{offers}} SELECT {_KEYS}, round(CASE WHEN lnum % 2 = 0 THEN 1 - pow(proj / (1 + proj), floor(line / 5) + 1) ELSE 1 - exp(-line / proj) END + 1e-7, 4) AS under, round(CASE WHEN lnum % 2 = 0 THEN ceil(ln(0.5) / ln(proj / (1 + proj))) - 1 ELSE -proj * ln(0.5) END + 1e-7, 4) + 0.0 AS middle FROM offers")
def reconstructed(t):
    """Chance under a new line, and the median, from stored parameters: geometric for counts, exponential for others."""
    even = c("lnum") % 2 == 0
    under = F.when(even, fu.geometric_cdf(F.floor(c("line") / 5), c("proj"))).otherwise(fu.exponential_cdf(c("line"), c("proj")))
    middle = F.when(even, F.ceil(math.log(0.5) / F.log(c("proj") / (1 + c("proj")))) - 1).otherwise(-c("proj") * math.log(0.5))
    return t.offers.select(*KEYS, r(under).alias("under"), r(middle).alias("middle"))


# ---- scoring


@query("score_offers", f"""WITH {{offers}}, m AS (SELECT l_partkey AS player, avg(l_extendedprice / 2000) AS model FROM lineitem WHERE l_partkey % 3 > 0 AND l_shipdate < TIMESTAMP '1999-01-01' GROUP BY 1), s AS (SELECT o.*, coalesce(exp(0.6 * ln(model) + 0.4 * ln(line)), line) AS mean, model IS NOT NULL AS own FROM offers o LEFT JOIN m USING (player) WHERE day >= DATE '1999-01-01'),
p AS (SELECT *, exp(-line / mean) AS up FROM s) SELECT {_KEYS}, CASE WHEN own THEN 'model' ELSE 'books' END AS origin, CASE WHEN least(up, 0.9) >= least(1 - up, 0.9) THEN 'Over' ELSE 'Under' END AS bet, round(greatest(least(up, 0.9), least(1 - up, 0.9)) + 1e-7, 4) AS win, round(greatest(least(up, 0.9), least(1 - up, 0.9)) * 1.8 * boost + 1e-7, 4) AS ev FROM p""")
def score(t):
    """Every offer of the slate by the model's mean fused with the books' where there is a model, else by the books' alone; the better side and its value."""
    cut = F.lit("1999-01-01").cast("date")
    model = t.offers.where((c("player") % 3 > 0) & (c("day") < cut)).groupBy("player").agg(F.avg("proj").alias("model"))
    slate = t.offers.where(c("day") >= cut).join(model, "player", "left")
    up = 1 - fu.exponential_cdf(c("line"), F.coalesce(fu.log_pool(F.lit(0.6), c("model"), c("line")), c("line")))
    over, under = F.least(up, F.lit(0.9)), F.least(1 - up, F.lit(0.9))
    win = F.greatest(over, under)
    return slate.select(*KEYS, F.when(c("model").isNotNull(), "model").otherwise("books").alias("origin"), F.when(over >= under, "Over").otherwise("Under").alias("bet"), r(win).alias("win"), r(win * 1.8 * c("boost")).alias("ev"))


@query("book_ev_for_players", """WITH {quotes}, k AS (SELECT * FROM quotes QUALIFY row_number() OVER (PARTITION BY entity, book ORDER BY observed_at DESC, okey, lnum, ev, line) = 1), e AS (SELECT entity, sum(pow(2.0, book % 4) * line) / sum(pow(2.0, book % 4)) AS ev FROM k WHERE entity % 4 > 0 GROUP BY entity)
SELECT p_partkey AS player, round(coalesce(e.ev, (a.ev + b.ev) / 2) + 1e-7, 4) AS ev, CASE WHEN e.ev IS NOT NULL THEN 'own' WHEN a.ev + b.ev IS NOT NULL THEN 'parts' ELSE 'none' END AS origin, round(exp(-20 / coalesce(e.ev, (a.ev + b.ev) / 2)) + 1e-7, 4) AS over FROM part LEFT JOIN e ON e.entity = p_partkey LEFT JOIN e a ON a.entity = p_partkey + 1 LEFT JOIN e b ON b.entity = p_partkey + 2""")
def book_ev(t):
    """Consensus mean of each player, of its parts where it has none of its own, and the chance over a line that follows."""
    last = latest_per_key(t.quotes, ["entity", "book"], [F.desc("observed_at"), c("okey"), c("lnum"), c("ev"), c("line")])
    e = last.where("entity % 4 > 0").groupBy("entity").agg((F.sum(half_weight("book") * c("line")) / F.sum(half_weight("book"))).alias("ev"))
    rows = t.part.select(c("p_partkey").alias("player"))
    for name, shift in (("own", 0), ("first", 1), ("second", 2)):
        rows = rows.join(e.select((c("entity") - shift).alias("player"), c("ev").alias(name)), "player", "left")
    parts = (c("first") + c("second")) / 2
    ev = F.coalesce("own", parts)
    origin = F.when(c("own").isNotNull(), "own").when(parts.isNotNull(), "parts").otherwise("none")
    return rows.select("player", r(ev).alias("ev"), origin.alias("origin"), r(F.exp(-20 / ev)).alias("over"))


# ---- settlement


@query("history_resolution", """WITH h AS (SELECT l_orderkey AS okey, l_linenumber AS lnum, l_extendedprice AS price, l_partkey AS player, CAST(l_shipdate AS DATE) AS day, CASE l_linenumber % 3 WHEN 0 THEN l_partkey || ' + ' || (l_partkey + 1) WHEN 1 THEN l_partkey || ' vs. ' || (l_partkey + 1) ELSE CAST(l_partkey AS VARCHAR) END AS entity, CASE WHEN l_linenumber > 5 THEN l_tax END AS actual, l_linenumber % 3 AS k FROM lineitem),
g AS (SELECT l_partkey AS player, avg(l_quantity) AS v FROM lineitem WHERE l_partkey % 10 > 0 GROUP BY 1)
SELECT okey, lnum, price, entity, round(coalesce(actual, CASE WHEN day < DATE '2000-06-01' THEN CASE k WHEN 0 THEN a.v + b.v WHEN 1 THEN a.v - b.v ELSE a.v END END) + 1e-7, 4) + 0.0 AS actual FROM h LEFT JOIN g a ON a.player = h.player LEFT JOIN g b ON b.player = h.player + 1""")
def resolution(t):
    """Results of past days that are missing, from the game log: sums for combined entities, differences for head-to-head ones; unknown if any part is."""
    p, q = c("l_partkey").cast("string"), (c("l_partkey") + 1).cast("string")
    entity = F.when(c("l_linenumber") % 3 == 0, F.concat(p, F.lit(" + "), q)).when(c("l_linenumber") % 3 == 1, F.concat(p, F.lit(" vs. "), q)).otherwise(p)
    rows = t.lineitem.select(c("l_orderkey").alias("okey"), c("l_linenumber").alias("lnum"), c("l_extendedprice").alias("price"), entity.alias("entity"), c("l_shipdate").cast("date").alias("day"), F.when(c("l_linenumber") > 5, c("l_tax")).alias("known"))
    results = t.lineitem.where("l_partkey % 10 > 0").groupBy(c("l_partkey").cast("string").alias("name")).agg(F.avg("l_quantity").alias("v"))
    return resolve_history(rows, results, F.lit("2000-06-01").cast("date")).select("okey", "lnum", "price", "entity", r(c("actual")).alias("actual"))


def resolve_history(rows: DataFrame, results: DataFrame, today: Column) -> DataFrame:
    """``rows`` (entity, day, known, ..) with ``actual``; ``results``: (name, v). Distinct entities alone are taken apart and joined."""
    from sabermill.functions.names import sides_of

    sides = rows.where("known IS NULL").select("entity").distinct().select("entity", F.inline(sides_of(c("entity"))))
    found = sides.join(results, "name", "left").groupBy("entity").agg(F.when(F.count("v") == F.count("*"), F.sum(c("sign") * c("v"))).alias("found"))
    return rows.join(found, "entity", "left").withColumn("actual", F.coalesce("known", F.when(c("day") < today, c("found")))).drop("found")


@query("closing_fill", """WITH {quotes}, h AS (SELECT l_orderkey AS okey, l_linenumber AS lnum, l_extendedprice AS price, l_partkey AS entity, l_quantity AS line, l_shipdate AS starts, CASE WHEN l_linenumber % 4 = 0 THEN l_discount END AS closed FROM lineitem),
k AS (SELECT h.okey, h.lnum, h.price, h.entity, h.line, h.closed, q.line AS mean, q.observed_at FROM h ASOF LEFT JOIN (SELECT entity, observed_at, max(line) AS line FROM quotes GROUP BY ALL) q ON q.entity = h.entity AND q.observed_at < h.starts)
SELECT okey, lnum, price, entity, round(coalesce(closed, exp(-line / mean)) + 1e-7, 4) AS close_over, closed IS NULL AND mean IS NOT NULL AS filled FROM k""")
def closing_fill(t):
    """The close of each settled prediction: the last quote before its start, turned into a chance at the prediction's own line; only where none is known."""
    rows = t.lineitem.select(c("l_orderkey").alias("okey"), c("l_linenumber").alias("lnum"), c("l_extendedprice").alias("price"), c("l_partkey").alias("entity"), c("l_quantity").alias("line"), c("l_shipdate").alias("starts"), F.when(c("l_linenumber") % 4 == 0, c("l_discount")).alias("closed"))
    quotes = t.quotes.groupBy("entity", "observed_at").agg(F.max("line").alias("mean"))
    last = Window.partitionBy("entity").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    own = rows.select("entity", c("starts").alias("at"), F.lit(0).alias("kind"), F.struct("okey", "lnum", "price", "line", "closed").alias("row"))
    both = own.unionByName(quotes.select("entity", c("observed_at").alias("at"), F.lit(1).alias("kind"), "mean"), allowMissingColumns=True)
    found = both.withColumn("mean", F.last("mean", ignorenulls=True).over(last)).where("kind = 0").select("entity", "mean", "row.*")
    close = F.coalesce("closed", F.exp(-c("line") / c("mean")))
    return found.select("okey", "lnum", "price", "entity", r(close).alias("close_over"), (c("closed").isNull() & c("mean").isNotNull()).alias("filled"))


@query("leg_and_slip_settlement", """WITH l AS (SELECT l_orderkey AS slip, l_partkey AS leg, max(l_quantity) AS line, max(l_extendedprice / 2000) AS actual, max(l_linenumber) AS k FROM lineitem GROUP BY ALL), s AS (SELECT slip, leg, CASE WHEN leg % 13 = 0 THEN 'void' WHEN round(line) = round(actual) THEN 'push' WHEN (actual > line) = (k % 2 = 0) THEN 'won' ELSE 'lost' END AS state FROM l)
SELECT slip, count(*) FILTER (state IN ('won', 'lost')) AS legs, count(*) FILTER (state = 'lost') AS misses, CASE WHEN count(*) FILTER (state IN ('won', 'lost')) < 2 THEN 'refund' WHEN count(*) FILTER (state = 'lost') = 0 THEN 'won' WHEN slip % 2 = 0 AND count(*) FILTER (state = 'lost') = 1 AND count(*) FILTER (state IN ('won', 'lost')) >= 4 THEN 'partial' ELSE 'lost' END AS status FROM s GROUP BY slip""")
def slips(t):
    """Each leg by its result, pushes and void legs left out; each slip by its misses: all or nothing, or flexible with one miss of four."""
    legs = t.lineitem.groupBy(c("l_orderkey").alias("slip"), c("l_partkey").alias("leg")).agg(F.max("l_quantity").alias("line"), F.max(c("l_extendedprice") / 2000).alias("actual"), F.max("l_linenumber").alias("k"))
    state = F.when(c("leg") % 13 == 0, "void").when(F.round("line") == F.round("actual"), "push").when((c("actual") > c("line")) == (c("k") % 2 == 0), "won").otherwise("lost")
    s = legs.withColumn("state", state).groupBy("slip").agg(F.count_if(c("state").isin("won", "lost")).alias("legs"), F.count_if(c("state") == "lost").alias("misses"))
    status = F.when(c("legs") < 2, "refund").when(c("misses") == 0, "won").when((c("slip") % 2 == 0) & (c("misses") == 1) & (c("legs") >= 4), "partial").otherwise("lost")
    return s.withColumn("status", status)


@query("distinct_leg_clv", """WITH {offers}, d AS (SELECT DISTINCT player, day, market FROM offers WHERE lnum <= 4), h AS (SELECT player, day, market, over, sharp FROM offers QUALIFY row_number() OVER (PARTITION BY player, day, market ORDER BY okey, lnum, price, line) = 1)
SELECT d.player, CAST(d.day AS VARCHAR) AS day, d.market, round(sharp - over + 1e-7, 4) + 0.0 AS clv FROM d LEFT JOIN h ON h.player = d.player AND h.day = d.day AND h.market = d.market""")
def leg_clv(t):
    """Distinct legs of all entries, each with the one prediction that it goes back to."""
    keys = ["player", "day", "market"]
    one = t.offers.withColumn("k", place(keys, *TIES)).where("k = 1").select(*keys, r(c("sharp") - c("over")).alias("clv"))
    return t.offers.where("lnum <= 4").select(*keys).dropDuplicates().join(one, keys, "left").withColumn("day", c("day").cast("string"))


# ---- repair of stored quotes


@query("shape_free_backfill", """WITH {quotes}, l AS (SELECT entity, CAST(observed_at AS DATE) AS day, median(line) AS mid FROM quotes GROUP BY ALL) SELECT q.entity, book, okey, lnum, q.ev, CASE WHEN lnum % 2 = 0 THEN under_prob ELSE round(1 - exp(-mid / (ev / 1000)) + 1e-7, 4) END AS under FROM quotes q JOIN l ON l.entity = q.entity AND l.day = CAST(observed_at AS DATE)""")
def backfill(t):
    """Quotes without a chance get the one that their mean gives at the day's consensus line."""
    rows = t.quotes.withColumn("day", c("observed_at").cast("date"))
    line = rows.groupBy("entity", "day").agg(F.median("line").alias("mid"))
    under = F.when(c("lnum") % 2 == 0, c("under_prob")).otherwise(r(fu.exponential_cdf(c("mid"), c("ev") / 1000)))
    return rows.join(line, ["entity", "day"]).select("entity", "book", "okey", "lnum", "ev", under.alias("under"))


@query("cached_quote_repair", """WITH {quotes}, m AS (SELECT l_orderkey AS okey, l_linenumber AS lnum, l_extendedprice AS price, l_partkey AS entity, l_quantity AS cached, CAST(l_shipdate AS DATE) AS day FROM lineitem), r AS (SELECT entity, CAST(observed_at AS DATE) AS day, line, count(*) AS n FROM quotes GROUP BY ALL QUALIFY row_number() OVER (PARTITION BY entity, CAST(observed_at AS DATE) ORDER BY count(*) DESC, line) = 1)
SELECT okey, lnum, price, m.entity, r.line, cached <> r.line AS repaired FROM m JOIN r ON r.entity = m.entity AND r.day = m.day""".replace("GROUP BY ALL QUALIFY", "GROUP BY entity, CAST(observed_at AS DATE), line QUALIFY"))
def quote_repair(t):
    """Cached rows against the line that most quotes of their day have."""
    daily = t.quotes.groupBy("entity", c("observed_at").cast("date").alias("day"), c("line").alias("modal")).agg(F.count("*").alias("n"))
    modal = latest_per_key(daily, ["entity", "day"], [F.desc("n"), c("modal")])
    rows = t.lineitem.select(c("l_orderkey").alias("okey"), c("l_linenumber").alias("lnum"), c("l_extendedprice").alias("price"), c("l_partkey").alias("entity"), c("l_quantity").alias("cached"), c("l_shipdate").cast("date").alias("day"))
    return rows.join(modal, ["entity", "day"]).select("okey", "lnum", "price", "entity", c("modal").alias("line"), (c("cached") != c("modal")).alias("repaired"))


@query("live_metrics_backfill", """WITH {history}, e AS (SELECT CAST(unnest(range(TIMESTAMP '1997-01-01', TIMESTAMP '2000-01-02', INTERVAL 1 YEAR)) AS DATE) AS endpoint), p AS (SELECT *, pow(prob - CAST(actual > line AS INTEGER), 2) AS s FROM history)
SELECT CAST(endpoint AS VARCHAR) AS endpoint, league, count(*) AS n, round(avg(s) + 1e-7, 4) AS brier FROM e JOIN p ON day < endpoint AND day >= endpoint - 180 GROUP BY ALL""")
def live_backfill(t):
    """Metrics of a trailing window at several past endpoints: each day goes to the endpoints that see it, after rows are added up by day."""
    days = t.history.withColumn("s", F.pow(c("prob") - (c("actual") > c("line")).cast("int"), 2)).groupBy("day", "league").agg(F.sum("s").alias("s"), F.count("*").alias("n"))
    ends = t.spark.sql("SELECT explode(sequence(DATE '1997-01-01', DATE '2000-01-01', INTERVAL 1 YEAR)) AS endpoint")
    seen = days.join(F.broadcast(ends), (c("day") < c("endpoint")) & (c("day") >= F.date_sub("endpoint", 180)))
    return seen.groupBy(c("endpoint").cast("string").alias("endpoint"), "league").agg(F.sum("n").alias("n"), r(F.sum("s") / F.sum("n")).alias("brier"))


# ---- correlations

_RECORDS = "rec AS (SELECT l_orderkey AS game, 'P' || (l_suppkey % 4) || '.' || l_linestatus AS col, avg(l_quantity) AS v FROM lineitem GROUP BY 1, 2)"


def records(t) -> DataFrame:
    """Team records of each game in long form: one row a (game, position and market)."""
    name = F.concat(F.lit("P"), (c("l_suppkey") % 4).cast("string"), F.lit("."), "l_linestatus")
    return t.lineitem.groupBy(c("l_orderkey").alias("game"), name.alias("col")).agg(F.avg("l_quantity").alias("v"))


@query("team_game_wide_records", f"WITH {_RECORDS} SELECT game, " + ", ".join(f"round(max(v) FILTER (col = '{x}') + 1e-7, 4) AS \"{x.replace('.', '_')}\"" for x in ("P0.O", "P1.O", "P0.F", "P1.F")) + ", round(max(v) FILTER (col = 'P2.O') + 1e-7, 4) AS \"_OPP_P2_O\" FROM rec GROUP BY game")
def wide_records(t):
    """One row a game with a column for each position and market, opponents' with a prefix; only the columns asked for are pivoted."""
    columns = {"P0.O": "P0_O", "P1.O": "P1_O", "P0.F": "P0_F", "P1.F": "P1_F", "P2.O": "_OPP_P2_O"}
    return records(t).groupBy("game").agg(*[r(F.max(F.when(c("col") == k, c("v")))).alias(v) for k, v in columns.items()])


_PAIRS = f"{_RECORDS}, pr AS (SELECT a.col AS a, b.col AS b, count(*) AS n, corr(a.v, b.v) AS rho FROM rec a JOIN rec b ON a.game = b.game AND a.col < b.col GROUP BY 1, 2)"


def correlations(t) -> DataFrame:
    """(a, b, n, rho) of all pairs of columns over the games that have both; a game has as many columns as positions and markets."""
    one = lambda s: records(t).select("game", c("col").alias(s), c("v").alias(f"v{s}"))
    return one("a").join(one("b"), "game").where("a < b").groupBy("a", "b").agg(F.count("*").alias("n"), F.corr("va", "vb").alias("rho"))


@query("shrunk_correlations", f"WITH {_PAIRS} SELECT a, b, n, round(rho * least(n / 3000.0, 1) + 1e-7, 4) + 0.0 AS rho, CASE WHEN left(a, 2) = left(b, 2) THEN 'same' ELSE 'opposing' END AS scope FROM pr WHERE abs(round(rho * least(n / 3000.0, 1) + 1e-7, 4)) > 0.002")
def shrunk(t):
    """Correlations shrunk by how many games both have, above a floor, parted by scope; mirrored pairs are one."""
    rho = r(c("rho") * F.least(c("n") / 3000.0, F.lit(1.0)))
    scope = F.when(F.substring("a", 1, 2) == F.substring("b", 1, 2), "same").otherwise("opposing")
    return correlations(t).select("a", "b", "n", rho.alias("rho"), scope.alias("scope")).where("abs(rho) > 0.002")


@query("correlation_market_summary", f"WITH {_PAIRS} SELECT split_part(a, '.', -1) AS market_a, split_part(b, '.', -1) AS market_b, round(avg(rho) + 1e-7, 4) + 0.0 AS rho, count(*) AS n FROM pr GROUP BY 1, 2")
def market_summary(t):
    last = lambda x: F.element_at(F.split(x, r"\."), -1)
    return correlations(t).groupBy(last("a").alias("market_a"), last("b").alias("market_b")).agg(r(F.avg("rho")).alias("rho"), F.count("*").alias("n"))


@query("game_correlation_map", f"WITH {_PAIRS}, u AS (SELECT a, b, 0.75 * rho AS w FROM pr UNION ALL SELECT b, a, 0.25 * rho FROM pr), m AS (SELECT a, b, sum(CASE WHEN left(a, 2) = left(b, 2) THEN w ELSE -w END) AS w FROM u GROUP BY a, b) SELECT a, b, round(w + 1e-7, 4) + 0.0 AS rho, round(exp(w) + 1e-7, 4) AS modifier FROM m")
def game_map(t):
    """Both teams' correlations as one map: three quarters of the own side's, a quarter of the other's, with the sign turned where sides differ."""
    base = correlations(t)
    both = base.select("a", "b", (0.75 * c("rho")).alias("w")).unionByName(base.select(c("b").alias("a"), c("a").alias("b"), (0.25 * c("rho")).alias("w")))
    signed = F.when(F.substring("a", 1, 2) == F.substring("b", 1, 2), c("w")).otherwise(-c("w"))
    return both.groupBy("a", "b").agg(F.sum(signed).alias("w")).select("a", "b", r(c("w")).alias("rho"), r(F.exp("w")).alias("modifier"))


@query("comp_profile_vectors", """WITH s AS (SELECT l_partkey AS player, avg(l_quantity) AS q, avg(l_discount) AS d, avg(l_tax) AS x FROM lineitem GROUP BY 1), l AS (SELECT avg(q) AS mq, stddev_samp(q) AS sq, avg(d) AS md, stddev_samp(d) AS sd, avg(x) AS mx, stddev_samp(x) AS sx FROM s)
SELECT player, array_to_string([CAST(round(round((q - mq) / sq * 2 + 1e-7, 2) * 100) AS BIGINT), CAST(round(round((d - md) / sd + 1e-7, 2) * 100) AS BIGINT), CAST(round(round((x - mx) / sx * 0.5 + 1e-7, 2) * 100) AS BIGINT)], ',') AS vector FROM s, l""")
def vectors(t):
    """Profiles as weighted z-scores in one array, in hundredths."""
    weights = {"l_quantity": 2.0, "l_discount": 1.0, "l_tax": 0.5}
    s = t.lineitem.groupBy(c("l_partkey").alias("player")).agg(*[F.avg(n).alias(n) for n in weights])
    level = s.agg(*[f(n).alias(k + n) for n in weights for k, f in (("m_", F.avg), ("s_", F.stddev_samp))])
    z = [F.round(r((c(n) - c("m_" + n)) / c("s_" + n) * w, 2) * 100).cast("long") for n, w in weights.items()]
    return s.join(F.broadcast(level)).select("player", F.array_join(F.array(*z), ",").alias("vector"))


@query("cross_game_combos", f"""WITH {{offers}}, b AS (SELECT day, okey, player, over, okey * 100000 + player AS id FROM offers WHERE over >= 0.7 QUALIFY row_number() OVER (PARTITION BY day, okey ORDER BY over DESC, player, lnum, price, line) = 1), k AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY day ORDER BY over DESC, id) <= 6)
SELECT a.id AS first, b.id AS second, CAST(a.day AS VARCHAR) AS day, round(a.over * b.over + 1e-7, 4) AS p FROM k a JOIN k b ON a.day = b.day AND a.okey <> b.okey AND a.id < b.id""")
def cross_game(t):
    """Pairs of the best legs of different games of a day, taken as independent: six legs a day, so at most 15 pairs."""
    best = t.offers.where("over >= 0.7").withColumn("id", c("okey") * 100000 + c("player")).withColumn("k", place(["day", "okey"], F.desc("over"), "player", "lnum", "price", "line")).where("k = 1")
    few = best.withColumn("k", place(["day"], F.desc("over"), "id")).where("k <= 6").select("day", "id", "over")
    one = few.select("day", c("id").alias("first"), c("over").alias("p1"))
    two = few.select("day", c("id").alias("second"), c("over").alias("p2"))
    return one.join(two, "day").where("first < second").select("first", "second", c("day").cast("string").alias("day"), r(c("p1") * c("p2")).alias("p"))


@query("flat_bankroll_path", "WITH {history}, d AS (SELECT day, sum(CASE WHEN actual > line THEN 10 * boost - 10 ELSE -10 END) AS pnl FROM history WHERE actual <> line GROUP BY day) SELECT CAST(day AS VARCHAR) AS day, round(5000 + sum(pnl) OVER (ORDER BY day) + 1e-7, 2) AS balance FROM d")
def flat_path(t):
    """Bankroll under a flat stake: rows are added up by day, and one running sum over days follows."""
    pnl = F.sum(F.when(c("actual") > c("line"), 10 * c("boost") - 10).otherwise(-10.0))
    days = t.history.where("actual <> line").groupBy("day").agg(pnl.alias("pnl"))
    return days.select(c("day").cast("string").alias("day"), r(5000 + F.sum("pnl").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)), 2).alias("balance"))


@query("offer_details", """WITH k AS (SELECT l_partkey AS player, l_quantity AS v, row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate DESC, l_orderkey, l_linenumber, l_extendedprice) AS rn FROM lineitem), m AS (SELECT player, avg(v) AS m, count(*) AS n, string_agg(CAST(CAST(v AS BIGINT) AS VARCHAR), ',' ORDER BY rn) FILTER (rn <= 5) AS last FROM k GROUP BY player)
SELECT player, round(m + 1e-7, 4) AS mean, n, last, round(m / avg(m) OVER (PARTITION BY player % 10) - 1 + 1e-7, 4) + 0.0 AS against, round(percent_rank() OVER (PARTITION BY player % 10 ORDER BY round(m + 1e-7, 4)) + 1e-7, 4) AS cohort FROM m""")
def details(t):
    """What an offer shows: level, sample, the last five results in order, and the player among its cohort."""
    order = F.struct(F.col("l_shipdate"), (-c("l_orderkey")).alias("a"), (-c("l_linenumber")).alias("b"), (-c("l_extendedprice")).alias("p"), c("l_quantity").alias("v"))
    newest = F.slice(F.reverse(F.array_sort(F.collect_list(order))), 1, 5)
    m = t.lineitem.groupBy(c("l_partkey").alias("player")).agg(F.avg("l_quantity").alias("m"), F.count("*").alias("n"), newest.alias("last"))
    cohort = Window.partitionBy(c("player") % 10)
    last = F.array_join(F.transform("last", lambda x: x["v"].cast("long").cast("string")), ",")
    return m.select("player", r(c("m")).alias("mean"), "n", last.alias("last"), r(c("m") / F.avg("m").over(cohort) - 1).alias("against"), r(F.percent_rank().over(cohort.orderBy(r(c("m"))))).alias("cohort"))


@query("position_edges_json", """WITH g AS (SELECT l_suppkey % 10 AS game, 'T' || (l_suppkey % 3) AS team, regexp_replace(left(p_type, 2) || (l_linenumber % 3), '[0-9]+$', '') AS pos, round(avg(l_quantity) + 1e-7, 2) AS mean, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2, 3)
SELECT game, '{' || string_agg('"' || team || '.' || pos || '":{"n":' || n || ',"mean":' || mean || '}', ',' ORDER BY team || '.' || pos) || '}' AS edges FROM g GROUP BY game""")
def position_edges(t):
    """Mean and number by team and position without its trailing rank, as one JSON object a game."""
    label = F.concat(F.substring("p_type", 1, 2), (c("l_linenumber") % 3).cast("string"))
    rows = t.lineitem.join(t.part, c("p_partkey") == c("l_partkey")).select((c("l_suppkey") % 10).alias("game"), F.concat(F.lit("T"), (c("l_suppkey") % 3).cast("string"), F.lit("."), F.regexp_replace(label, "[0-9]+$", "")).alias("key"), "l_quantity")
    g = rows.groupBy("game", "key").agg(F.count("*").alias("n"), r(F.avg("l_quantity"), 2).alias("mean"))
    pairs = F.array_sort(F.collect_list(F.struct("key", F.struct("n", "mean").alias("v"))))
    return g.groupBy("game").agg(F.to_json(F.map_from_entries(pairs)).alias("edges"))


@query("modifier_overlay_fold", "WITH b AS (SELECT l_suppkey AS k, l_returnflag AS f, round(avg(l_discount), 3) AS v FROM lineitem WHERE l_suppkey < 70 GROUP BY ALL), o AS (SELECT l_suppkey AS k, l_returnflag AS f, round(avg(l_discount) FILTER (l_linenumber <= 6), 3) AS v FROM lineitem WHERE l_suppkey >= 30 GROUP BY ALL) SELECT coalesce(o.k, b.k) AS k, coalesce(o.f, b.f) AS f, coalesce(o.v, b.v) AS v, CASE WHEN o.v IS NULL THEN 'base' WHEN b.v IS NULL THEN 'new' WHEN o.v = b.v THEN 'pruned' ELSE 'overlay' END AS origin FROM b FULL JOIN o ON o.k = b.k AND o.f = b.f")
def overlay(t):
    """A keyed overlay over a base; keys on which both agree can be pruned from it."""
    keys = [c("l_suppkey").alias("k"), c("l_returnflag").alias("f")]
    base = t.lineitem.where("l_suppkey < 70").groupBy(*keys).agg(F.round(F.avg("l_discount"), 3).alias("base"))
    over = t.lineitem.where("l_suppkey >= 30").groupBy(*keys).agg(F.round(F.avg(F.when(c("l_linenumber") <= 6, c("l_discount"))), 3).alias("over"))
    origin = F.when(c("over").isNull(), "base").when(c("base").isNull(), "new").when(c("over") == c("base"), "pruned").otherwise("overlay")
    return base.join(over, ["k", "f"], "full").select("k", "f", F.coalesce("over", "base").alias("v"), origin.alias("origin"))


@query("nested_config_merge", "WITH k AS (SELECT l_partkey AS player, max(l_discount) FILTER (l_linestatus = 'O') AS a, max(l_tax) FILTER (l_linestatus = 'F') AS b, list(DISTINCT l_linenumber ORDER BY l_linenumber) FILTER (l_linestatus = 'O') AS x, list(DISTINCT l_linenumber ORDER BY l_linenumber) FILTER (l_linestatus = 'F') AS y FROM lineitem GROUP BY 1) SELECT player, coalesce(b, a) AS ev, array_to_string(list_concat(coalesce(x, []), coalesce(y, [])), ',') AS lines FROM k")
def config_merge(t):
    """Two nested settings as one: of maps the later value wins, lists follow each other."""
    lines = lambda s: F.array_sort(F.collect_set(F.when(c("l_linestatus") == s, c("l_linenumber"))))
    of = lambda s, v: F.max(F.when(c("l_linestatus") == s, c(v)))
    k = t.lineitem.groupBy(c("l_partkey").alias("player")).agg(of("O", "l_discount").alias("a"), of("F", "l_tax").alias("b"), lines("O").alias("x"), lines("F").alias("y"))
    single = lambda v: F.when(c(v).isNotNull(), F.create_map(F.lit("ev"), c(v))).otherwise(F.create_map().cast("map<string,double>"))
    merged = F.map_zip_with(single("a"), single("b"), lambda _, old, new: F.coalesce(new, old))
    return k.select("player", merged["ev"].alias("ev"), F.array_join(F.transform(F.concat("x", "y"), lambda n: n.cast("string")), ",").alias("lines"))


@query("key_coercion", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) + 1 AS restored, 'k' AS key, CAST(json_extract(props, '$.k') AS VARCHAR) AS text FROM events")
def coercion(t):
    """Maps as JSON and back: keys become text and are restored, mixed values become text."""
    numbers = F.from_json("props", "map<string,bigint>")
    shifted = F.transform_values(F.transform_keys(numbers, lambda k, v: F.lit(7)), lambda k, v: v + 1)
    back = F.from_json(F.to_json(F.transform_keys(shifted, lambda k, v: k.cast("string"))), "map<string,bigint>")
    restored = F.transform_keys(back, lambda k, v: k.cast("int"))
    return t.events.select("event_id", restored[7].alias("restored"), F.map_keys(numbers)[0].alias("key"), F.map_values(F.from_json("props", "map<string,string>"))[0].alias("text"))


@query("json_feature_maps", "WITH {offers} SELECT okey, lnum, player, price, CASE WHEN over > 0.5 THEN 2 ELSE 1 END AS n, over AS over, CASE WHEN over > 0.5 THEN sharp END AS sharp FROM offers")
def feature_maps(t):
    """A map column written as JSON and read again; missing features are not written."""
    features = F.map_filter(F.create_map(F.lit("over"), c("over"), F.lit("sharp"), F.when(c("over") > 0.5, c("sharp"))), lambda k, v: v.isNotNull())
    rows = t.offers.select("okey", "lnum", "player", "price", F.to_json(features).alias("json"))
    back = rows.withColumn("m", F.from_json("json", "map<string,double>"))
    return back.select("okey", "lnum", "player", "price", F.size("m").alias("n"), c("m")["over"].alias("over"), c("m")["sharp"].alias("sharp"))


@query("frame_level_column_choice", "WITH {history}, h AS (SELECT league, CASE WHEN league = 'A' AND lnum = 3 THEN prob END AS win, market_prob FROM history), f AS (SELECT league, count(win) > 0 AS has_win FROM h GROUP BY league) SELECT league, round(avg(CASE WHEN has_win THEN win ELSE market_prob END) + 1e-7, 4) AS chance, CAST(count(CASE WHEN has_win THEN win ELSE market_prob END) AS BIGINT) AS n FROM h JOIN f USING (league) GROUP BY league")
def column_choice(t):
    """The win chance where a league has any, else the model's value: one choice a frame, so its gaps stay gaps."""
    h = t.history.select("league", F.when((c("league") == "A") & (c("lnum") == 3), c("prob")).alias("win"), "market_prob")
    both = h.groupBy("league").agg(F.count("win").alias("some"), F.avg("win").alias("w"), F.avg("market_prob").alias("m"), F.count("market_prob").alias("n"))
    return both.select("league", r(F.when(c("some") > 0, c("w")).otherwise(c("m"))).alias("chance"), F.when(c("some") > 0, c("some")).otherwise(c("n")).alias("n"))


@query("book_result_nll", """WITH {quotes}, k AS (SELECT entity, book, okey, lnum, ev, CASE WHEN ev / 1000 > line THEN 1 ELSE 0 END AS y, least(greatest(0.2 + 6 * under_prob, 0.001), 0.999) AS p FROM quotes) SELECT book, count(*) AS n, round(-sum(pow(2.0, book % 4) * (y * ln(p) + (1 - y) * ln(1 - p))) / sum(pow(2.0, book % 4)) + 1e-7, 4) AS nll FROM k GROUP BY book""")
def book_nll(t):
    """Weighted log loss of each book's chances against the results attached to its quotes."""
    y = (c("ev") / 1000 > c("line")).cast("int")
    p = F.least(F.greatest(0.2 + 6 * c("under_prob"), F.lit(0.001)), F.lit(0.999))
    w = half_weight("book")
    return t.quotes.groupBy("book").agg(F.count("*").alias("n"), r(-F.sum(w * (y * F.log(p) + (1 - y) * F.log(1 - p))) / F.sum(w)).alias("nll"))


@query("model_versions", "SELECT DISTINCT CAST(CAST(l_shipdate AS DATE) AS VARCHAR) || '.' || lower(l_returnflag) || '-' || lower(l_linestatus) || '.' || left(sha256(l_returnflag || l_linestatus), 8) AS version FROM lineitem WHERE l_suppkey = 5")
def versions(t):
    """Identity of a served model: date, slug and the start of a digest."""
    slug = F.lower(F.concat_ws("-", "l_returnflag", "l_linestatus"))
    return t.lineitem.where("l_suppkey = 5").select(F.concat_ws(".", c("l_shipdate").cast("date").cast("string"), slug, F.substring(F.sha2(F.concat("l_returnflag", "l_linestatus"), 256), 1, 8)).alias("version")).distinct()


@query("history_metric_bundles", """WITH {history}, h AS (SELECT *, CAST(actual > line AS INTEGER) AS y FROM history WHERE actual <> line), b AS (SELECT 'league' AS kind, league AS key, * FROM h UNION ALL SELECT 'market', market, * FROM h UNION ALL SELECT 'platform', CAST(platform AS VARCHAR), * FROM h UNION ALL SELECT 'year', CAST(year(day) AS VARCHAR), * FROM h)
SELECT kind, key, count(*) AS n, round(avg(y) + 1e-7, 4) AS hit, round(avg(prob) + 1e-7, 4) AS predicted, round(sum(CASE WHEN y = 1 THEN boost - 1 ELSE -1 END) + 1e-7, 2) + 0.0 AS profit FROM b GROUP BY kind, key""")
def bundles(t):
    """Four tables of the whole history in one pass: grouping sets over their keys."""
    h = t.history.where("actual <> line").withColumn("y", (c("actual") > c("line")).cast("int")).select("league", "market", c("platform").cast("string").alias("platform"), F.year("day").cast("string").alias("year"), "y", "prob", F.when(c("y") == 1, c("boost") - 1).otherwise(-1.0).alias("pnl"))
    keys = ["league", "market", "platform", "year"]
    out = h.groupingSets([[k] for k in keys], *keys).agg(F.grouping_id().alias("g"), F.count("*").alias("n"), r(F.avg("y")).alias("hit"), r(F.avg("prob")).alias("predicted"), r(F.sum("pnl"), 2).alias("profit"))
    kind = F.when(c("g") == 7, "league").when(c("g") == 11, "market").when(c("g") == 13, "platform").otherwise("year")
    return out.select(kind.alias("kind"), F.coalesce(*keys).alias("key"), "n", "hit", "predicted", "profit")
