"""Scoring, calibration and settlement of prediction history; odds arithmetic."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from sabermill.functions import odds
from sabermill.functions.odds import stable_round as r
from sabermill.operators import aggregates as agg
from sabermill.plans.base import query

def profit():
    return F.when(F.col("hit"), 100.0 / 110.0).otherwise(-1.0)


@query("offer_outcomes", "WITH {history} SELECT okey, lnum, player, CASE WHEN actual > line THEN 'Over' WHEN actual < line THEN 'Under' ELSE 'Push' END AS result, count(*) AS n FROM history GROUP BY ALL")
def outcomes(t):
    result = F.when(F.col("actual") > F.col("line"), "Over").when(F.col("actual") < F.col("line"), "Under").otherwise("Push")
    return t.history.groupBy("okey", "lnum", "player", result.alias("result")).agg(F.count("*").alias("n"))


@query("kelly_columns", """WITH {history}, k AS (SELECT okey, lnum, player, boost * (100.0 / 110.0) AS payout, prob, market_prob FROM history)
SELECT okey, lnum, player, round(sum(prob * payout) + 1e-7, 4) AS model_ev, round(sum(market_prob * payout) + 1e-7, 4) AS market_ev, round(sum((prob * payout - 1) / nullif(payout - 1, 0)) + 1e-7, 3) AS kelly FROM k GROUP BY ALL""")
def kelly(t):
    pay = odds.payout(F.col("boost"), F.lit(False))
    k = t.history.withColumn("payout", pay)
    return k.groupBy("okey", "lnum", "player").agg(r(F.sum(F.col("prob") * F.col("payout"))).alias("model_ev"), r(F.sum(F.col("market_prob") * F.col("payout"))).alias("market_ev"), r(F.sum((F.col("prob") * F.col("payout") - 1) / F.nullif(F.col("payout") - 1, F.lit(0.0))), 3).alias("kelly"))


@query("bet_universe", "WITH {history} SELECT league, market, count(*) AS n, round(avg(prob) + 1e-7, 4) AS prob FROM history WHERE prob * boost > 1.2 AND market_prob * boost > 1.1 AND platform % 5 IN (1, 2, 3) GROUP BY ALL")
def universe(t):
    rows = t.history.where((F.col("prob") * F.col("boost") > 1.2) & (F.col("market_prob") * F.col("boost") > 1.1) & (F.col("platform") % 5).isin(1, 2, 3))
    return rows.groupBy("league", "market").agg(F.count("*").alias("n"), r(F.avg("prob")).alias("prob"))


@query("timeframe_metrics", """WITH {history}, tf(timeframe, days) AS (VALUES ('30d', 30), ('90d', 90), ('180d', 180), ('365d', 365), ('all', 100000)), m AS (SELECT max(day) AS last FROM history)
SELECT timeframe, coalesce(league, '*') AS league, coalesce(market, '*') AS market, count(*) AS n, round(avg(CAST(hit AS INTEGER)) + 1e-7, 4) AS accuracy, round(avg(pow(prob - CAST(hit AS INTEGER), 2)) + 1e-7, 4) AS brier,
round(-avg(ln(CASE WHEN hit THEN prob ELSE 1 - prob END)) + 1e-7, 4) AS logloss, round(avg(CASE WHEN hit THEN 100.0 / 110.0 ELSE -1 END) + 1e-7, 4) AS roi
FROM history, tf, m WHERE day > last - CAST(days AS INTEGER) GROUP BY GROUPING SETS ((timeframe), (timeframe, league), (timeframe, league, market))""")
def timeframes(t):
    tf = t.spark.createDataFrame([("30d", 30), ("90d", 90), ("180d", 180), ("365d", 365), ("all", 100000)], "timeframe string, days int")
    last = t.history.agg(F.max("day").alias("last"))
    rows = t.history.join(F.broadcast(last)).join(F.broadcast(tf), F.datediff("last", "day") < F.col("days"))
    hit = F.col("hit").cast("int")
    sets = rows.groupingSets([["timeframe"], ["timeframe", "league"], ["timeframe", "league", "market"]], "timeframe", "league", "market")
    out = sets.agg(F.count("*").alias("n"), r(F.avg(hit)).alias("accuracy"), r(F.avg(F.pow(F.col("prob") - hit, 2))).alias("brier"), r(-F.avg(F.log(F.when(F.col("hit"), F.col("prob")).otherwise(1 - F.col("prob"))))).alias("logloss"), r(F.avg(profit())).alias("roi"))
    return out.select("timeframe", F.coalesce("league", F.lit("*")).alias("league"), F.coalesce("market", F.lit("*")).alias("market"), "n", "accuracy", "brier", "logloss", "roi")


@query("daily_pnl", "WITH {history} SELECT CAST(day AS VARCHAR) AS day, league, market, count(*) AS n, round(avg(prob) + 1e-7, 4) AS prob, round(sum(CASE WHEN hit THEN 100.0 / 110.0 ELSE -1 END) + 1e-7, 4) AS profit FROM history GROUP BY ALL")
def daily(t):
    return t.history.groupBy(F.col("day").cast("string").alias("day"), "league", "market").agg(F.count("*").alias("n"), r(F.avg("prob")).alias("prob"), r(F.sum(profit())).alias("profit"))


@query("calibration_bins", """WITH {history}, b AS (SELECT CAST(ceil((round(prob * 1000) - 400) / 50.0) - 1 AS BIGINT) AS bin, prob, hit FROM history), g AS (SELECT bin, avg(prob) AS p, avg(CAST(hit AS INTEGER)) AS y, count(*) AS n FROM b GROUP BY bin)
SELECT CAST(s.bin AS BIGINT) AS bin, round(p + 1e-7, 4) AS predicted, round(y + 1e-7, 4) AS actual, coalesce(n, 0) AS n, round(sum(n * abs(p - y)) OVER () / sum(n) OVER () + 1e-7, 4) AS ece FROM (SELECT unnest(range(12)) AS bin) s LEFT JOIN g USING (bin)""")
def calibration(t):
    b = t.history.select(odds.cut_right(F.col("prob"), 0.4, 0.05).alias("bin"), "prob", "hit")
    g = b.groupBy("bin").agg(F.avg("prob").alias("p"), F.avg(F.col("hit").cast("int")).alias("y"), F.count("*").alias("n"))
    total = g.where("bin BETWEEN 0 AND 11").agg((F.sum(F.col("n") * F.abs(F.col("p") - F.col("y"))) / F.sum("n")).alias("e"))
    out = t.spark.range(12).withColumnRenamed("id", "bin").join(g, "bin", "left").join(F.broadcast(total))
    return out.select("bin", r(F.col("p")).alias("predicted"), r(F.col("y")).alias("actual"), F.coalesce("n", F.lit(0)).alias("n"), r(F.col("e")).alias("ece"))


@query("roi_thresholds", """WITH {history}, th(least) AS (VALUES (0.55), (0.6), (0.65), (0.7), (0.8)) SELECT CAST(least AS DOUBLE) AS least, league, count(*) AS n, round(avg(CASE WHEN hit THEN 100.0 / 110.0 ELSE -1 END) + 1e-7, 4) AS roi FROM history JOIN th ON prob >= least + 1e-9 GROUP BY ALL""")
def thresholds(t):
    th = t.spark.createDataFrame([(0.55,), (0.6,), (0.65,), (0.7,), (0.8,)], "least double")
    return t.history.join(F.broadcast(th), F.col("prob") >= F.col("least") + 1e-9).groupBy("least", "league").agg(F.count("*").alias("n"), r(F.avg(profit())).alias("roi"))


@query("record_summaries", """WITH {history}, m AS (SELECT league, strftime(day, '%Y-%m') AS month, count(*) FILTER (hit) AS wins, count(*) FILTER (NOT hit) AS losses, round(sum(CASE WHEN hit THEN 100.0 / 110.0 ELSE -1 END), 6) AS units FROM history WHERE prob > 0.6 GROUP BY ALL)
SELECT market, sum(wins) AS wins FROM m, (SELECT 'x' AS market) GROUP BY market""".replace("SELECT market, sum(wins) AS wins FROM m, (SELECT 'x' AS market) GROUP BY market", "SELECT league, CAST(sum(wins) AS BIGINT) AS wins, CAST(sum(losses) AS BIGINT) AS losses, round(sum(units) + 1e-7, 4) AS units, arg_min(month, (units, month)) AS worst_month FROM m GROUP BY league"))
def records(t):
    m = t.history.where("prob > 0.6").groupBy("league", F.date_format("day", "yyyy-MM").alias("month")).agg(F.count_if("hit").alias("wins"), F.count_if(~F.col("hit")).alias("losses"), F.round(F.sum(profit()), 6).alias("units"))
    return m.groupBy("league").agg(F.sum("wins").alias("wins"), F.sum("losses").alias("losses"), r(F.sum("units")).alias("units"), F.min_by("month", F.struct("units", "month")).alias("worst_month"))


@query("murphy_decomposition", """WITH {history}, b AS (SELECT least(greatest(CAST(ceil((round(prob * 1000) - 500) / 50.0) - 1 AS BIGINT), 0), 9) AS bin, prob, CAST(hit AS INTEGER) AS y FROM history), g AS (SELECT bin, count(*) AS n, avg(prob) AS p, avg(y) AS o FROM b GROUP BY bin), a AS (SELECT avg(y) AS base, count(*) AS total FROM b)
SELECT round(sum(n * pow(p - o, 2)) / max(total) + 1e-7, 4) AS reliability, round(sum(n * pow(o - base, 2)) / max(total) + 1e-7, 4) AS resolution, round(max(base * (1 - base)) + 1e-7, 4) AS uncertainty FROM g, a""")
def murphy(t):
    b = t.history.select(F.least(F.greatest(odds.cut_right(F.col("prob"), 0.5, 0.05), F.lit(0)), F.lit(9)).alias("bin"), "prob", F.col("hit").cast("int").alias("y"))
    g = b.groupBy("bin").agg(F.count("*").alias("n"), F.avg("prob").alias("p"), F.avg("y").alias("o"))
    total = g.agg((F.sum(F.col("n") * F.col("o")) / F.sum("n")).alias("base"), F.sum("n").alias("total"))
    j = g.join(F.broadcast(total))
    return j.agg(r(F.sum(F.col("n") * F.pow(F.col("p") - F.col("o"), 2)) / F.max("total")).alias("reliability"), r(F.sum(F.col("n") * F.pow(F.col("o") - F.col("base"), 2)) / F.max("total")).alias("resolution"), r(F.max(F.col("base") * (1 - F.col("base")))).alias("uncertainty"))


@query("brier_skill", "WITH {history} SELECT league, round(1 - avg(pow(prob - CAST(hit AS INTEGER), 2)) / 0.25 + 1e-7, 4) AS skill, round(1 - avg(pow(prob - CAST(hit AS INTEGER), 2)) / avg(pow(market_prob - CAST(hit AS INTEGER), 2)) + 1e-7, 4) AS book_skill FROM history GROUP BY league")
def brier_skill(t):
    y = F.col("hit").cast("int")
    b, m = F.avg(F.pow(F.col("prob") - y, 2)), F.avg(F.pow(F.col("market_prob") - y, 2))
    return t.history.groupBy("league").agg(r(1 - b / 0.25).alias("skill"), r(1 - b / m).alias("book_skill"))


@query("live_window_metrics", """WITH {history}, m AS (SELECT max(day) AS last FROM history), cells AS (SELECT DISTINCT league, market, platform FROM history, m WHERE day > last - 300), wd(w) AS (VALUES (70), (300))
SELECT c.league, c.market, c.platform, CAST(w AS BIGINT) AS days, count(h.hit) AS n, round(avg(CAST(h.hit AS INTEGER)) + 1e-7, 4) AS precision FROM cells c CROSS JOIN wd CROSS JOIN m LEFT JOIN history h ON h.league = c.league AND h.market = c.market AND h.platform = c.platform AND h.day > last - CAST(w AS INTEGER) GROUP BY ALL""")
def live(t):
    last = t.history.agg(F.max("day").alias("last"))
    rows = t.history.join(F.broadcast(last)).withColumn("age", F.datediff("last", "day")).where("age < 300")
    cell = rows.groupBy("league", "market", "platform").agg(*[x for d in (70, 300) for x in (F.count(F.when(F.col("age") < d, 1)).alias(f"n{d}"), F.avg(F.when(F.col("age") < d, F.col("hit").cast("int"))).alias(f"p{d}"))])
    return cell.select("league", "market", "platform", F.explode(F.array(*[F.struct(F.lit(d).cast("long").alias("days"), F.col(f"n{d}").alias("n"), r(F.col(f"p{d}")).alias("precision")) for d in (70, 300)])).alias("x")).select("league", "market", "platform", "x.*")


@query("clv_segments", """WITH {history}, c AS (SELECT league, market, platform, CASE WHEN hit THEN market_prob - prob ELSE prob - market_prob END AS clv FROM history)
SELECT league, market, platform, count(*) AS n, round(avg(clv) + 1e-7, 4) AS clv, round(avg(CAST(clv > 0 AS INTEGER)) + 1e-7, 4) AS beat, round(least(greatest(2 * (avg(CAST(clv > 0 AS INTEGER)) - 0.5), 0), 1) + 1e-7, 4) AS shrinkage FROM c GROUP BY ALL HAVING count(*) >= 20""")
def clv(t):
    c = t.history.withColumn("clv", odds.signed_clv(F.col("prob"), F.col("market_prob"), F.col("hit")))
    beat = F.avg((F.col("clv") > 0).cast("int"))
    return c.groupBy("league", "market", "platform").agg(F.count("*").alias("n"), r(F.avg("clv")).alias("clv"), r(beat).alias("beat"), r(F.least(F.greatest(2 * (beat - 0.5), F.lit(0.0)), F.lit(1.0))).alias("shrinkage")).where("n >= 20")


@query("scorecard", "WITH {history} SELECT platform, count(*) AS n, round(avg(abs(actual - line)) + 1e-7, 4) AS mae, round(avg(line) - avg(actual) + 1e-7, 4) AS bias, round(stddev_pop(line) / stddev_pop(actual) + 1e-7, 4) AS sd_ratio, round(corr(actual, line) + 1e-7, 4) AS r, round(abs(avg(line) - avg(actual)) / stddev_samp(actual) + 1e-7, 4) AS bias_z FROM history GROUP BY platform")
def scorecard(t):
    bias = F.avg("line") - F.avg("actual")
    return t.history.groupBy("platform").agg(F.count("*").alias("n"), r(F.avg(F.abs(F.col("actual") - F.col("line")))).alias("mae"), r(bias).alias("bias"), r(F.stddev_pop("line") / F.stddev_pop("actual")).alias("sd_ratio"), r(F.corr("actual", "line")).alias("r"), r(F.abs(bias) / F.stddev_samp("actual")).alias("bias_z"))


@query("classification_auc", """WITH {history}, k AS (SELECT league, CAST(hit AS INTEGER) AS y, rank() OVER (PARTITION BY league ORDER BY s) + (count(*) OVER (PARTITION BY league, s) - 1) / 2.0 AS rk FROM (SELECT market AS league, actual > line AS hit, round(prob, 6) AS s FROM history))
SELECT league AS market, round((sum(y * rk) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * sum(1 - y)) + 1e-7, 4) AS auc FROM k GROUP BY league""")
def classification(t):
    rows = t.history.select("market", (F.col("actual") > F.col("line")).alias("y"), F.round("prob", 6).alias("s"))
    return agg.auc(rows, ["market"], "s", "y").select("market", r(F.col("auc")).alias("auc"))


@query("wilson_deciles", """WITH {history}, k AS (SELECT league, prob, CAST(actual > line AS INTEGER) AS y, row_number() OVER (PARTITION BY platform ORDER BY prob, player, okey, lnum, line, actual, day) AS rn, count(*) OVER (PARTITION BY platform) AS n, platform FROM history),
g AS (SELECT platform, CAST(greatest(ceil((rn - 1) * 10.0 / greatest(n - 1, 1)) - 1, 0) AS BIGINT) AS bin, count(*) AS n, avg(prob) AS p, avg(y) AS y FROM k GROUP BY ALL)
SELECT platform, bin, n, round(p + 1e-7, 4) AS predicted, round((y + 1.9208 / n - 1.96 * sqrt(greatest(y * (1 - y), 0) / n + 0.9604 / (n * n))) / (1 + 3.8416 / n) + 1e-7, 4) AS low, round((y + 1.9208 / n + 1.96 * sqrt(greatest(y * (1 - y), 0) / n + 0.9604 / (n * n))) / (1 + 3.8416 / n) + 1e-7, 4) AS high FROM g""")
def wilson(t):
    part = Window.partitionBy("platform")
    rn, total = F.row_number().over(part.orderBy("prob", "player", "okey", "lnum", "line", "actual", "day")), F.count(F.lit(1)).over(part)
    k = t.history.withColumn("rn", rn).withColumn("bin", F.greatest(F.ceil((F.col("rn") - 1) * 10.0 / F.greatest(total - 1, F.lit(1))) - 1, F.lit(0)).cast("long"))
    g = k.groupBy("platform", "bin").agg(F.count("*").alias("n"), F.avg("prob").alias("p"), F.avg((F.col("actual") > F.col("line")).cast("int")).alias("y"))
    y, n = F.col("y"), F.col("n")
    half = 1.96 * F.sqrt(F.greatest(y * (1 - y), F.lit(0.0)) / n + 0.9604 / (n * n))
    return g.select("platform", "bin", "n", r(F.col("p")).alias("predicted"), r((y + 1.9208 / n - half) / (1 + 3.8416 / n)).alias("low"), r((y + 1.9208 / n + half) / (1 + 3.8416 / n)).alias("high"))


@query("odds_conversion", """SELECT n_nationkey, round(CASE WHEN o > 0 THEN 100.0 / (o + 100.0) ELSE -o / (-o + 100.0) END + 1e-7, 6) AS prob, round(1 / (1 + exp(-ln(p / (1 - p)) / 1.3)) + 1e-7, 6) AS scaled, round(p / (p + 0.55) + 1e-7, 6) AS devig,
round(CASE WHEN p <= 0.1 THEN 0.2 WHEN p < 0.5 THEN 0.2 + (p - 0.1) * 0.75 WHEN p < 0.9 THEN 0.5 + (p - 0.5) * 0.75 ELSE 0.8 END + 1e-7, 6) AS mapped FROM (SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 100 + n_nationkey * 10 ELSE -100 - n_nationkey * 10 END AS o, (n_nationkey + 1) / 27.0 AS p FROM nation)""")
def conversion(t):
    n = t.nation.select("n_nationkey", F.when(F.col("n_nationkey") % 2 == 0, 100 + F.col("n_nationkey") * 10).otherwise(-100 - F.col("n_nationkey") * 10).alias("o"), ((F.col("n_nationkey") + 1) / 27.0).alias("p"))
    p = F.col("p")
    return n.select("n_nationkey", r(odds.american_to_prob(F.col("o")), 6).alias("prob"), r(odds.temperature(p, 1.3), 6).alias("scaled"), r(odds.devig(p, F.lit(0.55)), 6).alias("devig"), r(odds.interpolate(p, [(0.1, 0.2), (0.5, 0.5), (0.9, 0.8)]), 6).alias("mapped"))


@query("kelly_stakes", """SELECT c_custkey, CAST(greatest(floor(abs(c_acctbal) * least(greatest((1.5 * p - (1 - p)) / 1.5, 0) * 0.25, 0.05) * 100 + 1e-6) / 100, 0) AS DECIMAL(18,2))::VARCHAR AS stake FROM (SELECT c_custkey, c_acctbal, 0.4 + (c_custkey % 30) / 100.0 AS p FROM customer)""")
def stakes(t):
    p = 0.4 + (F.col("c_custkey") % 30) / 100.0
    return t.customer.select("c_custkey", odds.stake(F.abs("c_acctbal"), odds.kelly_fraction(p, F.lit(1.5), cap=0.05)).cast("string").alias("stake"))


@query("poisson_binomial_pmf", "WITH b AS (SELECT c_custkey AS k, 0.1 + (c_custkey % 7) / 10.0 AS p, 0.2 + (c_custkey % 5) / 10.0 AS q, 0.3 + (c_custkey % 3) / 10.0 AS s FROM customer) SELECT k, round((1-p)*(1-q)*(1-s) + 1e-7, 6) AS p0, round(p*(1-q)*(1-s) + (1-p)*q*(1-s) + (1-p)*(1-q)*s + 1e-7, 6) AS p1, round(p*q*(1-s) + p*(1-q)*s + (1-p)*q*s + 1e-7, 6) AS p2, round(p*q*s + 1e-7, 6) AS p3 FROM b")
def pmf(t):
    k = F.col("c_custkey")
    out = t.customer.select(k.alias("k"), odds.poisson_binomial(F.array(0.1 + (k % 7) / 10.0, 0.2 + (k % 5) / 10.0, 0.3 + (k % 3) / 10.0)).alias("d"))
    return out.select("k", *[r(F.col("d")[i], 6).alias(f"p{i}") for i in range(4)])


@query("lifecycle_states", "SELECT c_custkey, CASE WHEN c_acctbal <= 0 THEN 'not-shipped' WHEN c_custkey % 200 < 100 THEN 'in-test' WHEN c_nationkey < 5 OR c_custkey % 10 < 3 THEN 'demoted' ELSE 'graduated' END AS state FROM customer")
def lifecycle(t):
    c = F.col("c_custkey")
    return t.customer.select("c_custkey", odds.lifecycle(F.col("c_acctbal"), c % 200, F.col("c_nationkey") - 5, (c % 10) / 10.0 + 0.2 + 1e-9).alias("state"))


@query("name_slugs", "SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug, string_split(p_type, ' ')[1] AS first_word FROM part")
def slugs(t):
    return t.part.select("p_partkey", odds.slug(F.col("p_name")).alias("slug"), F.split("p_type", " ")[0].alias("first_word"))


@query("week_anchor_and_zone", """SELECT event_id, CAST(CAST(ts AS DATE) - CAST((isodow(ts) + 4) % 7 AS INTEGER) AS VARCHAR) AS week_start, CAST(CAST(ts - INTERVAL 5 HOUR AS DATE) AS VARCHAR) AS local_day FROM events""")
def weeks(t):
    back = (F.weekday("ts") + 5) % 7  # days since Wednesday
    return t.events.select("event_id", F.date_sub(F.col("ts").cast("date"), back).cast("string").alias("week_start"), F.expr("cast(cast(ts - INTERVAL 5 HOURS AS date) AS string)").alias("local_day"))


@query("parlay_settlement", """WITH l AS (SELECT l_orderkey AS parlay, count(*) AS legs, count(*) FILTER (l_returnflag = 'N') AS misses, count(*) FILTER (l_returnflag = 'A') AS pushes, list_sort(list(DISTINCT l_partkey))::VARCHAR AS players FROM lineitem GROUP BY 1),
p(size, misses, pays) AS (VALUES (2, 0, 3.0), (3, 0, 5.0), (3, 1, 1.0), (4, 0, 10.0), (4, 1, 1.5), (5, 0, 20.0), (5, 1, 2.0), (5, 2, 0.4))
SELECT parlay, legs, l.misses, pushes, players, CASE WHEN legs - pushes < 2 THEN 1.0 ELSE coalesce(CAST(pays AS DOUBLE), 0.0) END AS pays FROM l LEFT JOIN p ON p.size = legs - pushes AND p.misses = l.misses""")
def parlays(t):
    legs = t.lineitem.groupBy(F.col("l_orderkey").alias("parlay")).agg(F.count("*").alias("legs"), F.count_if(F.col("l_returnflag") == "N").alias("misses"), F.count_if(F.col("l_returnflag") == "A").alias("pushes"), F.array_sort(F.collect_set("l_partkey")).alias("ids"))
    table = [(2, 0, 3.0), (3, 0, 5.0), (3, 1, 1.0), (4, 0, 10.0), (4, 1, 1.5), (5, 0, 20.0), (5, 1, 2.0), (5, 2, 0.4)]
    p = F.broadcast(t.spark.createDataFrame(table, "size long, m long, table_pays double"))
    j = legs.join(p, (F.col("size") == F.col("legs") - F.col("pushes")) & (F.col("m") == F.col("misses")), "left")
    text = F.concat(F.lit("["), F.array_join(F.transform("ids", lambda x: x.cast("string")), ", "), F.lit("]"))
    return j.select("parlay", "legs", "misses", "pushes", text.alias("players"), F.when(F.col("legs") - F.col("pushes") < 2, 1.0).otherwise(F.coalesce("table_pays", F.lit(0.0))).alias("pays"))


@query("ledger_bankroll", """SELECT o_custkey % 20 AS persona, o_orderkey, CAST(CAST(5000 AS DECIMAL(18,2)) + sum(CAST(CASE WHEN o_orderstatus = 'F' THEN 10.25 ELSE -5.5 END AS DECIMAL(18,2))) OVER (PARTITION BY o_custkey % 20 ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS VARCHAR) AS bankroll FROM orders""")
def ledger(t):
    w = Window.partitionBy("persona").orderBy("o_orderdate", "o_orderkey").rowsBetween(Window.unboundedPreceding, 0)
    pnl = F.when(F.col("o_orderstatus") == "F", F.lit("10.25")).otherwise(F.lit("-5.50")).cast("decimal(18,2)")
    rows = t.orders.select((F.col("o_custkey") % 20).alias("persona"), "o_orderkey", "o_orderdate", pnl.alias("pnl"))
    return rows.select("persona", "o_orderkey", (F.lit(5000).cast("decimal(18,2)") + F.sum("pnl").over(w)).cast("string").alias("bankroll"))
