"""Windowed features over the game log, and the pieces of a training matrix."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from sabermill.functions.odds import stable_round as r
from sabermill.operators import aggregates as agg
from sabermill.operators import windows as w
from sabermill.operators.asof import latest_per_key
from sabermill.plans.base import query

OLD = ["ts", "seq"]


def newest():
    return [F.desc("ts"), F.desc("seq")]


@query("tail_features", """WITH {log}, k AS (SELECT *, row_number() OVER (PARTITION BY player ORDER BY ts DESC, seq DESC) AS rn FROM log)
SELECT player, count(*) AS games, round(avg(value) + 1e-7, 4) AS mean_all, round(median(value) + 1e-7, 4) AS median_all, round(stddev_samp(value) + 1e-7, 4) AS sd_all, round(avg(CAST(value = 0 AS INTEGER)) + 1e-7, 4) AS zero_share,
round(avg(value) FILTER (rn <= 3) + 1e-7, 4) AS mean_3, round(avg(value) FILTER (rn <= 5) + 1e-7, 4) AS mean_5, round(avg(value) FILTER (rn <= 10) + 1e-7, 4) AS mean_10 FROM k GROUP BY player""")
def tail(t):
    out = w.tail_features(t.log, "player", newest(), "value")
    return out.select("player", "games", *[r(F.col(c)).alias(c) for c in ("mean_all", "median_all", "sd_all", "zero_share", "mean_3", "mean_5", "mean_10")])


@query("recent_slope", """WITH {log}, k AS (SELECT *, row_number() OVER (PARTITION BY player ORDER BY ts DESC, seq DESC) AS rn FROM log)
SELECT player, round(CASE WHEN count(*) < 3 THEN 0 ELSE coalesce(regr_slope(value, -rn), 0) END + 1e-7, 4) AS slope FROM k WHERE rn <= 5 GROUP BY player""")
def slope(t):
    return w.recent_slope(t.log, "player", newest(), "value").select("player", r(F.col("slope")).alias("slope"))


@query("prior_rolling_residual", """WITH {log} SELECT seq, player, round(CASE WHEN count(value) OVER p >= 3 THEN value - avg(value) OVER p END + 1e-7, 4) AS residual FROM log WINDOW p AS (PARTITION BY player ORDER BY ts, seq ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING)""")
def residual(t):
    return w.prior_rolling_residual(t.log, "player", OLD, "value").select("seq", "player", r(F.col("residual")).alias("residual"))


@query("rolling_season_mean", "WITH {log} SELECT seq, player, round(avg(value) OVER (PARTITION BY player ORDER BY ts, seq ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) + 1e-7, 4) AS rolling FROM log")
def rolling(t):
    return w.rolling_mean(t.log, "player", OLD, "value", 3).select("seq", "player", r(F.col("rolling")).alias("rolling"))


@query("expanding_shrunk_mean", """WITH {log}, p AS (SELECT team, avg(value) AS prior FROM log GROUP BY team)
SELECT seq, player, count(value) OVER e AS prior_n, round((count(value) OVER e * coalesce(avg(value) OVER e, 0) + 10 * prior) / (count(value) OVER e + 10) + 1e-7, 4) AS shrunk
FROM log JOIN p USING (team) WINDOW e AS (PARTITION BY player, team ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def expanding(t):
    prior = t.log.groupBy("team").agg(F.avg("value").alias("prior"))
    out = w.expanding_shrunk(t.log.join(prior, "team"), ["player", "team"], OLD, "value", F.col("prior"))
    return out.select("seq", "player", "prior_n", r(F.col("shrunk")).alias("shrunk"))


@query("depth_rank", "WITH {log}, u AS (SELECT team, player, avg(value) AS usage FROM log GROUP BY ALL) SELECT team, player, row_number() OVER (PARTITION BY team ORDER BY round(usage + 1e-7, 4) DESC, player) AS depth FROM u")
def depth(t):
    usage = t.log.groupBy("team", "player").agg(r(F.avg("value")).alias("usage"))
    return w.depth_rank(usage, ["team"], [F.desc("usage"), F.col("player")]).select("team", "player", F.col("depth").cast("long"))


@query("within_player_z", """WITH {log} SELECT seq, round(coalesce((value - avg(value) OVER p) / nullif(stddev_samp(value) OVER p, 0), 0) + 1e-7, 4) AS z FROM log WINDOW p AS (PARTITION BY player)""")
def within(t):
    return w.within_z(t.log, "player", "value").select("seq", r(F.col("z")).alias("z"))


@query("weighted_quantile", """WITH {quotes}, s AS (SELECT book, ev, sum(line) OVER o / sum(line) OVER (PARTITION BY book) AS s, row_number() OVER o AS rn, okey, lnum, tax, entity FROM quotes WINDOW o AS (PARTITION BY book ORDER BY ev, entity, okey, lnum, tax, under_prob, observed_at ROWS UNBOUNDED PRECEDING)),
k AS (SELECT *, lag(s) OVER (PARTITION BY book ORDER BY rn) AS s0, lag(ev) OVER (PARTITION BY book ORDER BY rn) AS v0 FROM s)
SELECT book, round(coalesce(min(CASE WHEN s >= 0.6 AND s0 IS NULL THEN ev WHEN s >= 0.6 AND s0 < 0.6 THEN v0 + (ev - v0) * (0.6 - s0) / (s - s0) END), max(ev)) + 1e-7, 4) AS quantile FROM k GROUP BY book""")
def quantile(t):
    out = w.weighted_quantile(t.quotes, ["book"], "ev", "line", ["entity", "okey", "lnum", "tax", "under_prob", "observed_at"], 0.6)
    return out.select("book", r(F.col("quantile")).alias("quantile"))


@query("drawdown_by_run", """WITH {log}, b AS (SELECT player, ts, seq, value - 50 AS pnl, 5000 + sum(value - 50) OVER (PARTITION BY player ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS b FROM log),
p AS (SELECT *, greatest(max(b) OVER (PARTITION BY player ORDER BY ts, seq ROWS UNBOUNDED PRECEDING), 5000) AS peak, pnl / greatest(coalesce(lag(b) OVER (PARTITION BY player ORDER BY ts, seq), 5000), 1) AS r FROM b)
SELECT player, round(sum(pnl) + 1e-7, 2) AS pnl, round(max((peak - b) / peak) + 1e-7, 4) AS drawdown, round(avg(r) / nullif(stddev_pop(r), 0) + 1e-7, 4) AS sharpe, round(avg(CAST(pnl > 0 AS INTEGER)) + 1e-7, 4) AS win_rate FROM p GROUP BY player""")
def drawdown(t):
    out = w.drawdown(t.log.withColumn("pnl", F.col("value") - 50), "player", OLD, "pnl", 5000.0)
    return out.select("player", r(F.col("pnl"), 2).alias("pnl"), *[r(F.col(c)).alias(c) for c in ("drawdown", "sharpe", "win_rate")])


@query("average_tie_rank", "SELECT o_orderkey, o_orderpriority, rank() OVER (PARTITION BY o_orderpriority ORDER BY floor(o_totalprice / 1000)) + (count(*) OVER (PARTITION BY o_orderpriority, floor(o_totalprice / 1000)) - 1) / 2.0 AS rank FROM orders")
def ranks(t):
    rows = t.orders.select("o_orderkey", "o_orderpriority", F.floor(F.col("o_totalprice") / 1000).alias("x"))
    return w.average_rank(rows, ["o_orderpriority"], "x").select("o_orderkey", "o_orderpriority", "rank")


@query("days_off", "WITH {log} SELECT seq, player, CAST(coalesce(date_diff('day', lag(day) OVER (PARTITION BY player ORDER BY ts, seq), day), -1) AS BIGINT) AS days_off FROM log")
def days_off(t):
    return w.gap_days(t.log, "player", OLD, "day").select("seq", "player", F.coalesce("days_off", F.lit(-1)).cast("long").alias("days_off"))


@query("percentile_rank", "WITH {log} SELECT seq, team, round((row_number() OVER (PARTITION BY team ORDER BY value, seq) - 1) / greatest(count(*) OVER (PARTITION BY team) - 1, 1) + 1e-7, 4) AS pct, round(cume_dist() OVER (PARTITION BY team ORDER BY value) + 1e-7, 4) AS at_most FROM log")
def percentile(t):
    ranked = w.placed(t.log, ["team"], "value", ["seq"])
    pct = (F.col("_place") - 1) / F.greatest(F.col("_total") - 1, F.lit(1))
    return ranked.select("seq", "team", r(pct).alias("pct"), r(F.col("_upto") / F.col("_total")).alias("at_most"))


@query("series_record", """WITH {log} SELECT seq, player, count(*) FILTER (value > 50) OVER s AS wins, count(*) FILTER (value <= 50) OVER s AS losses FROM log WINDOW s AS (PARTITION BY player, team ORDER BY day RANGE BETWEEN INTERVAL 30 DAYS PRECEDING AND INTERVAL 1 DAYS PRECEDING)""")
def series(t):
    s = Window.partitionBy("player", "team").orderBy("n").rangeBetween(-30, -1)
    rows = t.log.withColumn("n", F.unix_date("day"))
    return rows.select("seq", "player", F.count_if(F.col("value") > 50).over(s).alias("wins"), F.count_if(F.col("value") <= 50).over(s).alias("losses"))


@query("recency_weighted_mean", "WITH {log}, m AS (SELECT max(day) AS last FROM log) SELECT player, round(sum(value * exp(-date_diff('day', day, last) / 45.0)) / sum(exp(-date_diff('day', day, last) / 45.0)) + 1e-7, 4) AS recent FROM log, m GROUP BY player")
def recency(t):
    last = t.log.agg(F.max("day").alias("last"))
    weight = F.exp(-F.datediff("last", "day") / F.lit(45.0))
    return t.log.join(F.broadcast(last)).groupBy("player").agg(r(agg.weighted_mean(F.col("value"), weight)).alias("recent"))


@query("equal_frequency_deciles", """WITH {log}, k AS (SELECT team, value, player, row_number() OVER (PARTITION BY team ORDER BY value, seq) AS rn, count(*) OVER (PARTITION BY team) AS n FROM log)
SELECT team, CAST(greatest(ceil((rn - 1) * 10.0 / greatest(n - 1, 1)) - 1, 0) AS BIGINT) AS bin, count(*) AS n, round(avg(value) + 1e-7, 4) AS mean, round(avg(abs(value - 50)) + 1e-7, 4) AS mae FROM k GROUP BY ALL""")
def deciles(t):
    out = w.equal_deciles(t.log, "value", ["seq"], ["team"])
    return out.groupBy("team", "bin").agg(F.count("*").alias("n"), r(F.avg("value")).alias("mean"), r(F.avg(F.abs(F.col("value") - 50))).alias("mae"))


@query("nested_top_k", """WITH a AS (SELECT o_custkey, o_orderkey, o_orderpriority, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 2)
SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) <= 30""")
def nested(t):
    best = [F.desc("o_totalprice"), F.col("o_orderkey")]
    rows = t.orders.select("o_custkey", "o_orderkey", "o_orderpriority", "o_totalprice")
    return w.top_k(w.top_k(rows, ["o_custkey"], best, 2), ["o_orderpriority"], best, 30)


@query("top_union_dedup", """SELECT DISTINCT * FROM ((SELECT o_orderkey, o_custkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 300) UNION ALL (SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 300) UNION ALL (SELECT o_orderkey, o_custkey FROM orders ORDER BY o_custkey, o_orderkey LIMIT 300))""")
def top_union(t):
    parts = [t.orders.orderBy(*o).limit(300).select("o_orderkey", "o_custkey") for o in ([F.desc("o_totalprice"), "o_orderkey"], [F.desc("o_orderdate"), "o_orderkey"], ["o_custkey", "o_orderkey"])]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).distinct()


@query("first_last_seen", "SELECT o_custkey, o_orderkey, CAST(min(o_orderdate) OVER (PARTITION BY o_custkey, o_orderstatus) AS VARCHAR) AS first_seen, CAST(max(o_orderdate) OVER (PARTITION BY o_custkey, o_orderstatus) AS VARCHAR) AS last_seen FROM orders")
def seen(t):
    part = Window.partitionBy("o_custkey", "o_orderstatus")
    return t.orders.select("o_custkey", "o_orderkey", F.date_format(F.min("o_orderdate").over(part), "yyyy-MM-dd HH:mm:ss").alias("first_seen"), F.date_format(F.max("o_orderdate").over(part), "yyyy-MM-dd HH:mm:ss").alias("last_seen"))


@query("era_segmentation", """WITH f AS (SELECT c_mktsegment AS cell, concat_ws('|', o_orderstatus, o_orderpriority) AS fp, CAST(o_orderdate AS DATE) AS day FROM orders JOIN customer ON o_custkey = c_custkey),
s AS (SELECT cell, fp, min(day) AS first_day, max(day) AS last_day FROM f GROUP BY ALL)
SELECT cell, fp, CAST(first_day AS VARCHAR) AS first_day, CAST(last_day AS VARCHAR) AS last_day, dense_rank() OVER (PARTITION BY cell ORDER BY first_day, fp) - 1 AS era FROM s""")
def eras(t):
    f = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_mktsegment").alias("cell"), F.concat_ws("|", "o_orderstatus", "o_orderpriority").alias("fp"), F.col("o_orderdate").cast("date").alias("day"))
    s = f.groupBy("cell", "fp").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"))
    era = (F.dense_rank().over(Window.partitionBy("cell").orderBy("first_day", "fp")) - 1).cast("long")
    return s.select("cell", "fp", F.col("first_day").cast("string"), F.col("last_day").cast("string"), era.alias("era"))


@query("participation_filter", """WITH {log}, k AS (SELECT player FROM log GROUP BY player HAVING avg(least(greatest(value / 100, 0), 1)) > 0.45 AND count(*) > 1) SELECT player, count(*) AS n FROM log WHERE player IN (SELECT player FROM k) GROUP BY player""")
def participation(t):
    keep = t.log.groupBy("player").agg(F.avg(F.least(F.greatest(F.col("value") / 100, F.lit(0.0)), F.lit(1.0))).alias("m"), F.count("*").alias("c")).where("m > 0.45 AND c > 1")
    return t.log.join(keep, "player", "left_semi").groupBy("player").agg(F.count("*").alias("n"))


@query("league_z_scores", """WITH {log}, m AS (SELECT player, avg(value) AS mean, count(*) AS n FROM log GROUP BY player HAVING count(*) >= 2), l AS (SELECT avg(mean) AS lm, stddev_samp(mean) AS ls FROM m)
SELECT player, round(mean + 1e-7, 4) AS mean, round((mean - lm) / nullif(ls, 0) + 1e-7, 4) AS z FROM m, l""")
def league_z(t):
    return agg.two_level_z(t.log, "player", "value").select("player", r(F.col("mean")).alias("mean"), r(F.col("z")).alias("z"))


@query("opponent_allowed", "WITH {log}, g AS (SELECT team, day, sum(value) AS s FROM log GROUP BY ALL), m AS (SELECT team, avg(s) AS m FROM g GROUP BY team), l AS (SELECT avg(m) AS lm FROM m) SELECT team, round(m / lm - 1 + 1e-7, 4) AS allowed FROM m, l")
def allowed(t):
    return agg.allowed_profile(t.log, "team", "day", "value").select("team", r(F.col("allowed")).alias("allowed"))


@query("home_away_ratio", "WITH {log} SELECT player, round(avg(CASE WHEN seq % 2 = 0 THEN value END) / nullif(avg(value), 0) - 1 + 1e-7, 4) AS home FROM log GROUP BY player")
def home(t):
    return t.log.groupBy("player").agg(r(agg.home_ratio(F.col("seq") % 2 == 0, F.col("value"))).alias("home"))


@query("market_slope", """WITH x AS (SELECT l_suppkey AS k, l_extendedprice / avg(l_extendedprice) OVER (PARTITION BY l_suppkey) AS y, l_quantity / avg(l_quantity) OVER (PARTITION BY l_suppkey) AS x FROM lineitem)
SELECT k AS book, round((count(*) * sum(x * y) - sum(x) * sum(y)) / nullif(round(count(*) * sum(x * x) - sum(x) * sum(x), 9), 0) + 1e-7, 4) AS slope FROM x GROUP BY k""")
def market_slope(t):
    return agg.slope_against(t.quotes, "book", "ev", "line").select("book", r(F.col("slope")).alias("slope"))


@query("year_over_year", """WITH y AS (SELECT l_suppkey AS k, year(l_shipdate) AS s, avg(l_extendedprice) AS v FROM lineitem GROUP BY ALL), p AS (SELECT k, s, v, lead(v) OVER (PARTITION BY k ORDER BY s) AS nv, lead(s) OVER (PARTITION BY k ORDER BY s) AS ns FROM y)
SELECT CAST(s AS BIGINT) AS season, count(*) AS pairs, round(corr(v, nv) + 1e-7, 4) AS rho FROM p WHERE ns = s + 1 GROUP BY s""")
def yoy(t):
    y = t.lineitem.groupBy(F.col("l_suppkey").alias("k"), F.year("l_shipdate").alias("s")).agg(F.avg("l_extendedprice").alias("v"))
    part = Window.partitionBy("k").orderBy("s")
    p = y.withColumn("nv", F.lead("v").over(part)).withColumn("ns", F.lead("s").over(part)).where("ns = s + 1")
    return p.groupBy(F.col("s").cast("long").alias("season")).agg(F.count("*").alias("pairs"), r(F.corr("v", "nv")).alias("rho"))


@query("icc_decomposition", """WITH {log}, g AS (SELECT team, player, count(*) AS n, avg(value) AS m, var_pop(value) * count(*) AS ssw FROM log GROUP BY ALL), l AS (SELECT team, sum(n * m) / sum(n) AS gm FROM g GROUP BY team)
SELECT team, round(sum(ssw) / (sum(n) - count(*)) + 1e-7, 3) AS within_var, round(sum(n * pow(m - gm, 2)) / (count(*) - 1) + 1e-7, 3) AS between_ms FROM g JOIN l USING (team) GROUP BY team""")
def icc(t):
    g = t.log.groupBy("team", "player").agg(F.count("*").alias("n"), F.avg("value").alias("m"), (F.var_pop("value") * F.count("*")).alias("ssw"))
    g = g.join(g.groupBy("team").agg((F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("gm")), "team")
    return g.groupBy("team").agg(r(F.sum("ssw") / (F.sum("n") - F.count("*")), 3).alias("within_var"), r(F.sum(F.col("n") * F.pow(F.col("m") - F.col("gm"), 2)) / (F.count("*") - 1), 3).alias("between_ms"))


@query("recipe_aggregation", """SELECT l_suppkey AS book, sum(l_quantity) AS qty, round(sum(l_extendedprice) / nullif(sum(l_quantity), 0) + 1e-7, 4) AS unit, round(sum(l_discount * l_quantity) / sum(l_quantity) + 1e-7, 4) AS disc, round(avg(l_tax) + 1e-7, 4) AS tax, round((sum(l_discount) - sum(l_tax)) / nullif(sum(l_tax), 0) + 1e-7, 4) AS excess FROM lineitem GROUP BY 1""")
def recipe(t):
    table = [("qty", "sum", ("l_quantity",)), ("unit", "rate", ("l_extendedprice", "l_quantity")), ("disc", "wmean", ("l_discount", "l_quantity")), ("tax", "mean", ("l_tax",)), ("excess", "excess", ("l_discount", "l_tax"))]
    out = agg.recipes(t.lineitem.withColumnRenamed("l_suppkey", "book"), ["book"], table)
    return out.select("book", "qty", *[r(F.col(c)).alias(c) for c in ("unit", "disc", "tax", "excess")])


@query("json_bucket_mean", """SELECT user_id AS player, CAST(json_extract_string(props, '$.k') AS BIGINT) % 3 AS bucket, round(sum(value * (event_id % 5 + 1)) / sum(event_id % 5 + 1) + 1e-7, 4) AS wmean FROM events GROUP BY ALL""")
def json_bucket(t):
    rows = t.events.withColumn("bucket", F.from_json("props", "map<string,bigint>")["k"] % 3)
    return rows.groupBy(F.col("user_id").alias("player"), "bucket").agg(r(agg.weighted_mean(F.col("value"), F.col("event_id") % 5 + 1)).alias("wmean"))


@query("grouped_quantile", "SELECT l_returnflag, l_linestatus, round(quantile_cont(l_extendedprice, 0.75) + 1e-7, 4) AS q75, round(avg(l_extendedprice) + 1e-7, 4) AS mean, round((quantile_cont(l_extendedprice, 0.75) - quantile_cont(l_extendedprice, 0.25)) / (quantile_cont(l_quantity, 0.75) - quantile_cont(l_quantity, 0.25)) + 1e-7, 4) AS iqr_ratio FROM lineitem GROUP BY ALL")
def grouped_quantile(t):
    q = lambda c, p: F.percentile(c, F.lit(p))
    iqr = (q("l_extendedprice", 0.75) - q("l_extendedprice", 0.25)) / (q("l_quantity", 0.75) - q("l_quantity", 0.25))
    return t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(r(q("l_extendedprice", 0.75)).alias("q75"), r(F.avg("l_extendedprice")).alias("mean"), r(iqr).alias("iqr_ratio"))


@query("most_frequent_value", "SELECT user_id AS player, event_type AS team FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) = 1")
def frequent(t):
    return latest_per_key(t.log.groupBy("player", "team").agg(F.count("*").alias("n")), ["player"], [F.desc("n"), F.col("team")]).select("player", "team")
