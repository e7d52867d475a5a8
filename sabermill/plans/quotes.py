"""Quote-store reads."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from sabermill.functions.odds import stable_round as r
from sabermill.operators.aggregates import consensus_line, movement, weighted_mean
from sabermill.operators.asof import as_of, asof_join, latest_per_key, snapshot_before
from sabermill.plans.base import half_weight, query

CUT = datetime.datetime(1996, 6, 1)


def latest_order():
    return [F.desc("observed_at"), F.desc_nulls_last("line"), F.desc_nulls_last("under_prob"), F.desc_nulls_last("ev"), F.desc("okey"), F.desc("lnum"), F.desc("tax")]


LATEST_SQL = "ORDER BY observed_at DESC, line DESC NULLS LAST, under_prob DESC NULLS LAST, ev DESC NULLS LAST, okey DESC, lnum DESC, tax DESC"


@query("asof_latest_per_book", f"WITH {{quotes}} SELECT entity, book, ev, line, under_prob, observed_at FROM quotes WHERE observed_at <= TIMESTAMP '1996-06-01' QUALIFY row_number() OVER (PARTITION BY entity, book {LATEST_SQL}) = 1")
def latest_book(t):
    return latest_per_key(as_of(t.quotes, "observed_at", CUT), ["entity", "book"], latest_order()).select("entity", "book", "ev", "line", "under_prob", "observed_at")


@query("book_weighted_consensus", f"""WITH {{quotes}}, last AS (SELECT * FROM quotes WHERE observed_at <= TIMESTAMP '1996-06-01' QUALIFY row_number() OVER (PARTITION BY entity, book {LATEST_SQL}) = 1),
m AS (SELECT entity, sum(ev * pow(2.0, book % 4)) / sum(pow(2.0, book % 4)) AS ev, CAST(count(*) AS BIGINT) AS books FROM last GROUP BY entity),
l AS (SELECT entity, floor(2 * median(line)) / 2 AS line FROM (SELECT DISTINCT entity, line FROM last) GROUP BY entity)
SELECT entity, round(ev + 1e-7, 4) AS ev, books, CAST(line AS DOUBLE) AS line FROM m JOIN l USING (entity)""")
def book_weighted_consensus(t):
    last = latest_per_key(as_of(t.quotes, "observed_at", CUT), ["entity", "book"], latest_order())
    mean = last.groupBy("entity").agg(r(weighted_mean(F.col("ev"), half_weight("book"))).alias("ev"), F.count("*").alias("books"))
    return mean.join(consensus_line(last, ["entity"], "line"), "entity")


@query("consensus_line_distinct", "WITH {quotes} SELECT entity, CAST(floor(2 * median(line)) / 2 AS DOUBLE) AS line FROM (SELECT DISTINCT entity, line FROM quotes) GROUP BY entity")
def consensus_distinct(t):
    return consensus_line(t.quotes, ["entity"], "line")


@query("consensus_line_all", "WITH {quotes} SELECT entity, CAST(floor(2 * median(line)) / 2 AS DOUBLE) AS line FROM quotes GROUP BY entity")
def consensus_all(t):
    return consensus_line(t.quotes, ["entity"], "line", distinct=False)


@query("asof_join_quotes", """WITH {quotes}, g AS (SELECT o_orderkey AS game, o_custkey % 200 AS entity, o_orderdate + INTERVAL 12 HOUR AS cutoff FROM orders),
q AS (SELECT entity, observed_at, max(okey) AS okey, max(ev) AS ev, max(line) AS line FROM quotes GROUP BY entity, observed_at)
SELECT game, entity, cutoff, ev, line FROM g ASOF LEFT JOIN q ON g.entity = q.entity AND g.cutoff >= q.observed_at""".replace("SELECT game, entity,", "SELECT game, g.entity,"))
def asof_quotes(t):
    games = t.orders.selectExpr("o_orderkey AS game", "o_custkey % 200 AS entity", "o_orderdate + INTERVAL 12 HOURS AS cutoff")
    q = t.quotes.groupBy("entity", "observed_at").agg(F.max("ev").alias("ev"), F.max("line").alias("line"))
    return asof_join(games, q, "entity", "cutoff", "observed_at", ["ev", "line"], ["ev"])


@query("asof_join_snapshot_strict", """WITH {quotes}, g AS (SELECT o_orderkey AS game, o_custkey % 200 AS entity, o_orderdate AS day FROM orders),
q AS (SELECT entity, observed_at, max(ev) AS ev FROM quotes GROUP BY entity, observed_at)
SELECT game, g.entity, day, ev FROM g ASOF LEFT JOIN q ON g.entity = q.entity AND g.day > q.observed_at""")
def asof_strict(t):
    games = t.orders.selectExpr("o_orderkey AS game", "o_custkey % 200 AS entity", "o_orderdate AS day")
    q = t.quotes.groupBy("entity", "observed_at").agg(F.max("ev").alias("ev"))
    return asof_join(games, q, "entity", "day", "observed_at", ["ev"], ["ev"], strict=True)


@query("snapshot_strictly_before", "WITH {quotes} SELECT entity, book, ev, okey, lnum FROM quotes WHERE observed_at = (SELECT max(observed_at) FROM quotes WHERE observed_at < TIMESTAMP '1996-06-01')")
def snapshot(t):
    return snapshot_before(t.quotes, "observed_at", CUT).select("entity", "book", "ev", "okey", "lnum")


@query("snapshot_window_inventory", "SELECT CAST(year(l_shipdate) AS INTEGER) AS season, CAST(month(l_shipdate) AS INTEGER) AS week, l_returnflag AS kind, count(*) AS files FROM lineitem WHERE l_shipdate >= TIMESTAMP '1995-01-01' AND l_shipdate < TIMESTAMP '1997-01-01' GROUP BY ALL")
def inventory(t):
    rows = t.lineitem.where("l_shipdate >= timestamp_ntz'1995-01-01' AND l_shipdate < timestamp_ntz'1997-01-01'")
    return rows.groupBy(F.year("l_shipdate").alias("season"), F.month("l_shipdate").alias("week"), F.col("l_returnflag").alias("kind")).agg(F.count("*").alias("files"))


@query("line_history", "WITH {quotes} SELECT book, observed_at, line, ev FROM quotes WHERE entity <= 40 AND book % 2 = 1 AND observed_at >= TIMESTAMP '1995-06-01' AND observed_at <= TIMESTAMP '1997-01-01'")
def line_history(t):
    rows = t.quotes.where((F.col("entity") <= 40) & (F.col("book") % 2 == 1) & F.col("observed_at").between(datetime.datetime(1995, 6, 1), datetime.datetime(1997, 1, 1)))
    return rows.select("book", "observed_at", "line", "ev").orderBy("observed_at", "book", "line", "ev")


@query("line_movement", """WITH {quotes}, s AS (SELECT entity, observed_at, avg(line) AS v FROM quotes GROUP BY ALL), m AS (SELECT *, lag(v) OVER (PARTITION BY entity ORDER BY observed_at) AS prev FROM s)
SELECT entity, round(min_by(v, observed_at) + 1e-7, 4) AS open, round(max_by(v, observed_at) + 1e-7, 4) AS close, round(max(v) + 1e-7, 4) AS peak, round(min(v) + 1e-7, 4) AS trough, count(*) AS n_obs, count(CASE WHEN v <> prev THEN 1 END) AS n_moves,
CAST(date_diff('second', min(observed_at), max(observed_at)) / 60.0 AS DOUBLE) AS minutes FROM m GROUP BY entity""")
def line_movement(t):
    out = movement(t.quotes, ["entity"], "observed_at", "line")
    return out.select("entity", *[r(F.col(c)).alias(c) for c in ("open", "close", "peak", "trough")], "n_obs", "n_moves", "minutes")


@query("quotes_wide_pivot", "SELECT l_partkey AS entity, " + ", ".join(f"max(CASE WHEN l_suppkey % 5 = {i} THEN l_extendedprice END) AS book_{i}" for i in range(5)) + ", CAST(floor(2 * median(l_quantity)) / 2 AS DOUBLE) AS line FROM lineitem GROUP BY l_partkey")
def wide(t):
    pivot = t.quotes.withColumn("g", F.concat(F.lit("book_"), (F.col("book") % 5).cast("string"))).groupBy("entity").pivot("g", [f"book_{i}" for i in range(5)]).agg(F.max("ev"))
    return pivot.join(consensus_line(t.quotes, ["entity"], "line", distinct=False), "entity")


@query("entities_per_date", "SELECT CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS day, list_sort(list(DISTINCT l_partkey))::VARCHAR AS entities FROM lineitem GROUP BY 1")
def entities(t):
    ids = F.array_sort(F.collect_set("entity"))
    return t.quotes.groupBy(F.col("observed_at").cast("date").cast("string").alias("day")).agg(F.concat(F.lit("["), F.array_join(F.transform(ids, lambda x: x.cast("string")), ", "), F.lit("]")).alias("entities"))


@query("closing_line", f"""WITH {{quotes}}, last AS (SELECT * FROM quotes QUALIFY row_number() OVER (PARTITION BY entity, book {LATEST_SQL}) = 1)
SELECT entity, CAST(floor(2 * median(line)) / 2 AS DOUBLE) AS line, round(avg(1 - under_prob) + 1e-7, 4) AS over_prob, max(observed_at) AS observed_at, count(DISTINCT book) AS books FROM last GROUP BY entity""")
def closing(t):
    last = latest_per_key(t.quotes, ["entity", "book"], latest_order())
    return last.groupBy("entity").agg((F.floor(2 * F.median("line")) / 2).cast("double").alias("line"), r(F.avg(1 - F.col("under_prob"))).alias("over_prob"), F.max("observed_at").alias("observed_at"), F.countDistinct("book").alias("books"))


@query("team_market_lookup", """WITH m AS (SELECT n_regionkey AS region, c_mktsegment AS segment, sum(c_acctbal * (1 + c_custkey % 4)) / sum(1 + c_custkey % 4) AS v FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 3 = 0 GROUP BY ALL)
SELECT c_custkey, round(coalesce(v, 0.5) + 1e-7, 4) AS market FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN m ON n_regionkey = region AND c_mktsegment = segment""")
def team_market(t):
    c = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    m = c.where("c_custkey % 3 = 0").groupBy(F.col("n_regionkey").alias("region"), F.col("c_mktsegment").alias("segment")).agg(weighted_mean(F.col("c_acctbal"), 1 + F.col("c_custkey") % 4).alias("v"))
    return c.join(m, (F.col("n_regionkey") == F.col("region")) & (F.col("c_mktsegment") == F.col("segment")), "left").select("c_custkey", r(F.coalesce("v", F.lit(0.5))).alias("market"))


@query("usable_quotes", "WITH {quotes} SELECT entity, count(*) AS n, count(CASE WHEN ev > 0 AND ev / 100 <= 2000 AND ev / 100 <= 15 * line AND abs(ev / 100 - 15 * line) > 1e-9 THEN 1 END) AS usable FROM quotes GROUP BY entity")
def usable_quotes(t):
    from sabermill.functions.odds import usable

    return t.quotes.groupBy("entity").agg(F.count("*").alias("n"), F.count_if(usable(F.col("ev") / 100, F.col("line"), times=15.0)).alias("usable"))
