"""Feeds and bodies as they come in, built from plain rows so that what is read back can be compared."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from sabermill.functions.odds import stable_round as r
from sabermill.plans.base import query
from sabermill.sources import feeds
from sabermill.sources.tables import FEED, feed_outcomes

c = F.col


@query("odds_feed_outcomes", "SELECT CAST(l_orderkey AS VARCHAR) AS id, 'B' || l_suppkey AS book, l_linestatus AS market, CASE WHEN l_linenumber % 2 = 0 THEN 'Over' ELSE 'Under' END AS side, 'P' || l_partkey AS player, round(1.2 + l_tax * 12, 4) AS price, l_quantity AS point FROM lineitem")
def odds_feed(t):
    """Events with bookmakers, markets and outcomes as JSON, read by an explicit schema and flattened."""
    side = F.when(c("l_linenumber") % 2 == 0, "Over").otherwise("Under")
    outcome = F.struct(side.alias("name"), F.concat(F.lit("P"), "l_partkey").alias("description"), F.round(1.2 + c("l_tax") * 12, 4).alias("price"), c("l_quantity").alias("point"))
    markets = t.lineitem.groupBy("l_orderkey", "l_suppkey", "l_linestatus").agg(F.collect_list(outcome).alias("outcomes"))
    books = markets.groupBy("l_orderkey", "l_suppkey").agg(F.collect_list(F.struct(c("l_linestatus").alias("key"), "outcomes")).alias("markets"))
    events = books.groupBy("l_orderkey").agg(F.collect_list(F.struct(F.concat(F.lit("B"), "l_suppkey").alias("key"), "markets")).alias("bookmakers"))
    body = F.to_json(F.struct(c("l_orderkey").cast("string").alias("id"), "bookmakers"))
    parsed = events.select(F.from_json(body, FEED).alias("e")).select("e.*")
    return feed_outcomes(parsed).select("id", "book", "market", "side", "player", "price", "point")


@query("linked_platform_offers", "SELECT 'N' || l_partkey AS player, CASE WHEN l_orderkey % 5 > 0 THEN 'G' || l_orderkey END AS game, l_linestatus AS market, l_quantity AS line, round(0.9 + l_discount, 4) AS boost_over, CASE WHEN l_linenumber % 2 = 0 THEN round(0.9 + l_tax, 4) END AS boost_under FROM lineitem WHERE l_linenumber < 7")
def linked(t):
    """A feed of lines, appearances, players and games by id; every seventh line's appearance is unknown."""
    appearance = F.concat_ws("-", "l_orderkey", "l_partkey")
    line = F.struct(F.when(c("l_linenumber") < 7, appearance).otherwise("gone").alias("appearance"), c("l_linestatus").alias("stat"), c("l_quantity").alias("value"), F.round(0.9 + c("l_discount"), 4).alias("over"), F.when(c("l_linenumber") % 2 == 0, F.round(0.9 + c("l_tax"), 4)).alias("under"))
    entries = lambda k, v: F.map_from_entries(F.array_distinct(F.collect_list(F.struct(k, v))))
    player, game = c("l_partkey").cast("string"), c("l_orderkey").cast("string")
    payload = t.lineitem.groupBy("l_orderkey").agg(F.collect_list(line).alias("lines"), entries(appearance, F.struct(player.alias("player"), game.alias("game"))).alias("appearances"), entries(player, F.concat(F.lit("N"), player)).alias("players"), F.map_from_entries(F.array_distinct(F.collect_list(F.when(c("l_orderkey") % 5 > 0, F.struct(game, F.concat(F.lit("G"), game)))))).alias("games"))
    return feeds.linked_offers(payload)


@query("included_platform_offers", "SELECT 'N' || l_partkey AS player, 'T' || (l_partkey % 30) AS team, l_linestatus AS market, l_quantity AS line, CAST(CASE l_linenumber % 3 WHEN 0 THEN 1.25 WHEN 1 THEN 0.8 ELSE 1.0 END AS DOUBLE) AS boost FROM lineitem")
def included(t):
    kind = F.element_at(F.array(F.lit("demon"), F.lit("goblin"), F.lit("standard")), (c("l_linenumber") % 3 + 1).cast("int"))
    data = F.struct(c("l_partkey").cast("string").alias("player_id"), c("l_linestatus").alias("stat"), c("l_quantity").alias("line"), kind.alias("odds"))
    player = F.struct(F.lit("player").alias("type"), c("l_partkey").cast("string").alias("id"), F.concat(F.lit("N"), "l_partkey").alias("name"), F.concat(F.lit("T"), (c("l_partkey") % 30).cast("string")).alias("team"))
    league = F.struct(F.lit("league").alias("type"), c("l_partkey").cast("string").alias("id"), F.lit("L").alias("name"), F.lit("").alias("team"))
    payload = t.lineitem.groupBy("l_orderkey").agg(F.collect_list(data).alias("data"), F.array_union(F.collect_set(player), F.collect_set(league)).alias("included"))
    return feeds.included_offers(payload)


@query("tabular_bodies", "SELECT user_id AS body, event_id AS id, value, event_type AS kind FROM events WHERE user_id % 5 < 4")
def tabular(t):
    """Responses in four shapes, one for each user, and a fifth that is none of them."""
    row = F.struct(c("event_id").alias("id"), "value", c("event_type").alias("kind"))
    g = t.events.groupBy("user_id").agg(F.collect_list(row).alias("rows"))
    cells = F.transform("rows", lambda x: F.array(x["kind"], x["id"].cast("string"), x["value"].cast("string")))
    shapes = [F.to_json("rows"), F.to_json(F.struct(c("rows").alias("data"))), F.to_json(F.struct("rows")), F.to_json(F.struct(F.array(F.lit("kind"), F.lit("id"), F.lit("value")).alias("columns"), cells.alias("data"))), F.lit("<html>busy</html>")]
    bodies = g.select(c("user_id").alias("body"), F.element_at(F.array(*shapes), (c("user_id") % 5 + 1).cast("int")).alias("json"))
    return bodies.select("body", F.inline(feeds.tabular_rows(c("json"), "id bigint, value double, kind string")))


@query("weekly_window_read", "SELECT event_type AS kind, CAST(week(ts) AS BIGINT) AS week, count(*) AS n, round(sum(value) + 1e-7, 3) AS total FROM events WHERE event_type = 'click' AND week(ts) BETWEEN 2 AND 4 GROUP BY 1, 2")
def weekly(t):
    """Rows of one kind and a range of weeks, as the partition filter of the stored snapshots selects them."""
    rows = t.events.select(c("event_type").alias("kind"), F.weekofyear("ts").cast("long").alias("week"), "value").where((c("kind") == "click") & c("week").between(2, 4))
    return rows.groupBy("kind", "week").agg(F.count("*").alias("n"), r(F.sum("value"), 3).alias("total"))


@query("collector_backlog", "SELECT w.season, w.week FROM (SELECT DISTINCT year(o_orderdate) AS season, unnest(range(1, 54)) AS week FROM orders) w WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey % 7 = 0 AND year(o_orderdate) = w.season AND week(o_orderdate) = w.week)")
def backlog(t):
    """Weeks of each season that no stored part has yet."""
    season = F.year("o_orderdate").cast("long").alias("season")
    wanted = t.orders.select(season).distinct().withColumn("week", F.explode(F.sequence(F.lit(1), F.lit(53)).cast("array<bigint>")))
    present = t.orders.where("o_orderkey % 7 = 0").select(season, F.weekofyear("o_orderdate").cast("long").alias("week"))
    return feeds.missing_parts(wanted, present, ["season", "week"])


@query("finite_snapshot", "SELECT l_orderkey AS okey, l_linenumber AS lnum, l_partkey AS player, l_extendedprice AS price, CASE WHEN l_tax > 0 THEN round(l_discount / l_tax + 1e-7, 4) END AS model_ev FROM lineitem")
def finite_snapshot(t):
    """Values without infinite and undefined numbers, as snapshots are written."""
    value = F.when(c("l_tax") > 0, r(c("l_discount") / c("l_tax"))).when(c("l_discount") > 0, F.lit(float("inf"))).otherwise(F.lit(float("nan")))
    return feeds.finite(t.lineitem.select(c("l_orderkey").alias("okey"), c("l_linenumber").alias("lnum"), c("l_partkey").alias("player"), c("l_extendedprice").alias("price"), value.alias("model_ev")))


@query("cell_report", "SELECT l_returnflag AS league, l_linestatus AS market, count(*) AS n, round(avg(l_discount) + 1e-7, 4) AS skill, round(100 * count(*) / sum(count(*)) OVER () + 1e-7, 3) AS share, CAST(min(CAST(l_shipdate AS DATE)) AS VARCHAR) AS first_day, CAST(max(CAST(l_shipdate AS DATE)) AS VARCHAR) AS last_day FROM lineitem GROUP BY 1, 2")
def report(t):
    """One wide row a cell."""
    cells = t.lineitem.groupBy(c("l_returnflag").alias("league"), c("l_linestatus").alias("market")).agg(F.count("*").alias("n"), r(F.avg("l_discount")).alias("skill"), F.min(c("l_shipdate").cast("date")).cast("string").alias("first_day"), F.max(c("l_shipdate").cast("date")).cast("string").alias("last_day"))
    return cells.withColumn("share", r(100 * c("n") / F.sum("n").over(Window.partitionBy()), 3))  # a handful of cells


@query("incremental_correlation_log", "WITH d AS (SELECT max(CAST(l_shipdate AS DATE)) AS last FROM lineitem), k AS (SELECT l_orderkey AS game, l_suppkey AS team, CAST(l_shipdate AS DATE) AS day, l_quantity AS v FROM lineitem, d WHERE CAST(l_shipdate AS DATE) > last - 300 AND l_linenumber <= 4), n AS (SELECT l_orderkey AS game, l_suppkey AS team, CAST(l_shipdate AS DATE) AS day, l_quantity AS v FROM lineitem, d WHERE CAST(l_shipdate AS DATE) > last - 300 AND l_orderkey NOT IN (SELECT game FROM k)) SELECT game, count(*) AS n, round(sum(v) + 1e-7, 2) AS total FROM (SELECT * FROM k UNION ALL SELECT * FROM n) GROUP BY game")
def incremental_log(t):
    """Of stored games the last 300 days are kept, and games that are not stored yet are appended."""
    rows = t.lineitem.select(c("l_orderkey").alias("game"), c("l_shipdate").cast("date").alias("day"), c("l_quantity").alias("v"), "l_linenumber")
    recent = rows.join(F.broadcast(rows.agg(F.max("day").alias("last")))).where("day > date_sub(last, 300)")
    stored = recent.where("l_linenumber <= 4")
    fresh = recent.join(stored.select("game").distinct(), "game", "left_anti")
    return stored.unionByName(fresh).groupBy("game").agg(F.count("*").alias("n"), r(F.sum("v"), 2).alias("total"))
