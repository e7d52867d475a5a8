"""Quote resolution, parsing of prices, picks, trims and fits."""

from __future__ import annotations

from pyspark.sql import functions as F

from sabermill.functions.odds import stable_round as r
from sabermill.operators import resolution as op
from sabermill.operators.asof import latest_per_key
from sabermill.plans.base import half_weight, query
from sabermill.plans.quotes import LATEST_SQL, latest_order

PRICES = "l_partkey AS entity, l_suppkey AS book, CASE l_linenumber % 4 WHEN 0 THEN 'Over' WHEN 1 THEN 'Under' WHEN 2 THEN 'Yes' ELSE 'No' END AS name, CASE WHEN l_linenumber % 5 = 0 THEN NULL ELSE floor(l_quantity / 10) + 0.5 END AS point, 1.2 + 12 * l_tax AS price"
_PRICES = f"WITH prices AS (SELECT {PRICES} FROM lineitem)"


@query("training_quote", f"""WITH {{quotes}}, last AS (SELECT * FROM quotes QUALIFY row_number() OVER (PARTITION BY entity, book {LATEST_SQL}) = 1),
v AS (SELECT *, median(line) OVER (PARTITION BY entity) AS middle FROM last WHERE line IS NOT NULL AND under_prob > 0 AND under_prob < 1),
l AS (SELECT entity, line, min(abs(line - middle)) AS off, count(*) AS books, sum(pow(2.0, book % 4) * under_prob) / sum(pow(2.0, book % 4)) AS under, max(observed_at) AS observed_at FROM v GROUP BY entity, line),
m AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY entity ORDER BY books DESC, off, line) = 1),
e AS (SELECT entity, sum(pow(2.0, book % 4) * ev) FILTER (ev > 0 AND ev <= 2000) / sum(pow(2.0, book % 4)) FILTER (ev > 0 AND ev <= 2000) AS mean FROM last GROUP BY entity)
SELECT e.entity, m.line, round(coalesce(m.under, 0.5) + 1e-7, 4) AS under, round(CASE WHEN m.line IS NULL THEN mean END + 1e-7, 4) AS ev, CAST(coalesce(books, 0) AS BIGINT) AS books, observed_at, CASE WHEN m.line IS NOT NULL THEN 'modal' WHEN mean IS NOT NULL THEN 'ev' ELSE 'neutral' END AS source FROM e LEFT JOIN m USING (entity)""")
def training_quote(t):
    last = latest_per_key(t.quotes, ["entity", "book"], latest_order())
    found = op.resolve_quote(last, "entity", half_weight("book"))
    return found.withColumns({"under": r(F.col("under")), "ev": r(F.col("ev"))})


@query("ladder_devig", f"""{_PRICES}, s AS (SELECT entity, book, point, max(CASE WHEN name = 'Over' THEN 1 / price END) AS o, max(CASE WHEN name = 'Under' THEN 1 / price END) AS u FROM prices GROUP BY entity, book, point)
SELECT entity, book, CAST(point AS DOUBLE) AS point, round(CASE WHEN o IS NULL THEN 1 - u / 1.0652 WHEN u IS NULL THEN o / 1.0652 ELSE o / (o + u) END + 1e-7, 4) AS p_over FROM s WHERE o IS NOT NULL OR u IS NOT NULL""")
def ladder(t):
    return op.devig_ladder(t.lineitem.selectExpr(*_split(PRICES)), ["entity", "book"]).withColumns({"point": F.col("point").cast("double"), "p_over": r(F.col("p_over"))})


@query("prop_lines", f"""{_PRICES}, n AS (SELECT entity, book, CASE name WHEN 'Yes' THEN 'Over' WHEN 'No' THEN 'Under' ELSE name END AS name, coalesce(point, 0.5) AS point, price FROM prices),
b AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY entity, book, name ORDER BY abs(price - 2), point, price) = 1),
o AS (SELECT * FROM b WHERE name = 'Over'), u AS (SELECT * FROM b WHERE name = 'Under')
SELECT entity, book, CAST(coalesce(o.point, u.point) AS DOUBLE) AS point, round(coalesce(o.price, u.price / (u.price - 1)) + 1e-7, 4) AS over, round(u.price + 1e-7, 4) AS under FROM o FULL JOIN u USING (entity, book)""")
def props(t):
    return op.prop_lines(t.lineitem.selectExpr(*_split(PRICES)), ["entity", "book"]).withColumns({"point": F.col("point").cast("double"), "over": r(F.col("over")), "under": r(F.col("under"))})


@query("event_archive", f"{_PRICES}, b AS (SELECT entity, book, max(point) AS point FROM prices GROUP BY entity, book) SELECT entity, CAST(median(point) AS DOUBLE) AS line, CAST(count(point) AS BIGINT) AS books FROM b GROUP BY entity HAVING count(point) > 0")
def archive(t):
    book = t.lineitem.selectExpr(*_split(PRICES)).groupBy("entity", "book").agg(F.max("point").alias("point"))
    return book.groupBy("entity").agg(F.median("point").cast("double").alias("line"), F.count("point").alias("books")).where("books > 0")


@query("market_team_totals", "SELECT l_orderkey AS game, l_suppkey AS book, round((avg(l_quantity) + 200 - avg(l_tax) * 100 + 4) / 2 + 1e-7, 4) AS home, round((avg(l_quantity) + 200 + avg(l_tax) * 100 - 4) / 2 + 1e-7, 4) AS away FROM lineitem GROUP BY 1, 2")
def market_totals(t):
    games = t.lineitem.groupBy(F.col("l_orderkey").alias("game"), F.col("l_suppkey").alias("book")).agg((F.avg("l_quantity") + 200).alias("total"), (F.avg("l_tax") * 100 - 4).alias("spread"))
    home, away = op.team_totals(F.col("total"), F.col("spread"))
    return games.select("game", "book", r(home).alias("home"), r(away).alias("away"))


@query("upcoming_events", """WITH l AS (SELECT o_orderkey AS event, o_orderdate AS starts FROM orders WHERE o_orderkey % 3 <> 0), i AS (SELECT o_orderkey AS event, o_orderdate + INTERVAL 1 DAY AS starts FROM orders WHERE o_orderkey % 2 = 0),
m AS (SELECT event, coalesce(i.starts, l.starts) AS starts FROM l FULL JOIN i USING (event))
SELECT event, starts, starts < TIMESTAMP '1996-06-01' + INTERVAL 30 DAY AS closing FROM m WHERE starts >= TIMESTAMP '1996-06-01'""")
def upcoming_events(t):
    ledger = t.orders.where("o_orderkey % 3 <> 0").selectExpr("o_orderkey AS event", "o_orderdate AS starts")
    incoming = t.orders.where("o_orderkey % 2 = 0").selectExpr("o_orderkey AS event", "o_orderdate + INTERVAL 1 DAY AS starts")
    return op.upcoming(ledger, incoming, "event", "starts", F.expr("TIMESTAMP_NTZ '1996-06-01'"), F.expr("INTERVAL 30 DAY"))


@query("day_bet_pick", """WITH {history}, b AS (SELECT day, player, prob, okey, lnum FROM history QUALIFY row_number() OVER (PARTITION BY day, player ORDER BY prob DESC, okey, lnum) = 1)
SELECT day, player, round(prob + 1e-7, 4) AS prob, okey, CAST(row_number() OVER (PARTITION BY day ORDER BY prob DESC, okey, lnum, player) AS BIGINT) AS place FROM b QUALIFY place <= 2""")
def day_picks(t):
    picks = op.best_per_player(t.history, "day", "player", [-F.col("prob"), F.col("okey"), F.col("lnum")], 2)
    return picks.select("day", "player", r(-F.col("best.k0")).alias("prob"), F.col("best.k1").alias("okey"), F.col("place").cast("long").alias("place"))


@query("trimmed_matrix", """WITH {history}, q AS (SELECT league, market, quantile_cont(actual, 0.05) AS lo, quantile_cont(actual, 0.95) AS hi FROM history GROUP BY league, market)
SELECT league, market, CAST(count(*) AS BIGINT) AS kept, round(avg(actual) + 1e-7, 4) AS mean FROM history JOIN q USING (league, market) WHERE platform % 5 = 0 OR actual BETWEEN lo - 1e-6 AND hi + 1e-6 GROUP BY league, market""")
def trimmed(t):
    kept = op.trim_outliers(t.history, ["league", "market"], "actual", F.col("platform") % 5 == 0)
    return kept.groupBy("league", "market").agg(F.count("*").alias("kept"), r(F.avg("actual")).alias("mean"))


@query("affine_mean_fit", "WITH {history} SELECT league, market, round(regr_slope(actual, line) + 1e-7, 4) AS slope, round(regr_intercept(actual, line) + 1e-7, 4) AS intercept FROM history GROUP BY league, market")
def affine(t):
    return t.history.groupBy("league", "market").agg(r(F.regr_slope("actual", "line")).alias("slope"), r(F.regr_intercept("actual", "line")).alias("intercept"))


@query("bootstrap_intervals")
def bootstrap(t):
    found = op.poisson_bootstrap(t.history, ["league", "market"], "actual", ["okey", "lnum", "player", "line", "actual"])
    return found.select("league", "market", *[r(F.col(c)).alias(c) for c in ("mean", "low", "high")])


def _split(columns: str) -> list[str]:
    """The select list's expressions; none has a comma of its own."""
    return columns.split(", ")
