"""Offers of a slate: ingest, filters, sides, legs and partners."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from sabermill.functions.names import normalised, sides_of
from sabermill.functions.odds import devig, stable_round as r
from sabermill.operators.asof import latest_per_key
from sabermill.plans.base import query

c = F.col
TIES = ["okey", "lnum", "price", "line"]
_TIES = ", ".join(TIES)


def place(keys: list[str], *order: Column | str) -> Column:
    """Number of a row among those of its keys."""
    return F.row_number().over(Window.partitionBy(*keys).orderBy(*order))


# ---- ingest


def nearest_neutral(offers: DataFrame, keys: list[str], ties: list[str]) -> DataFrame:
    """Of each key the offer whose boost (of the over side, else the plain one) is nearest to 1."""
    return latest_per_key(offers, keys, [F.abs(F.coalesce("boost_over", "boost") - 1), *map(c, ties)])


def renamed_market(league: Column, market: Column, names: dict[str, str], exceptions: dict[tuple[str, str], str]) -> Column:
    """A market by its league's exception, else by the common table, else as it is."""
    out = market
    for old, new in names.items():
        out = F.when(market == old, new).otherwise(out)
    for (where, old), new in exceptions.items():
        out = F.when((league == where) & (market == old), new).otherwise(out)
    return out


def exponential_mean(line: Column, under: Column, times: float = 5.0) -> Column:
    """The mean of an exponential outcome that stays below the line with a given chance; null where it reaches the cap of ``times`` the line."""
    mean = -line / F.log(1 - under)
    return F.when((under > 0) & (under < 1) & (mean < times * line), mean)


NAMES, EXCEPTIONS = {"F": "final", "O": "open"}, {("R", "O"): "reopened"}


@query("offer_dedup_by_boost", f"WITH {{offers}} SELECT player, market, okey, lnum, round(coalesce(boost_over, boost) + 1e-7, 4) AS boost FROM offers QUALIFY row_number() OVER (PARTITION BY player, market ORDER BY abs(coalesce(boost_over, boost) - 1), {_TIES}) = 1")
def dedup(t):
    return nearest_neutral(t.offers, ["player", "market"], TIES).select("player", "market", "okey", "lnum", r(F.coalesce("boost_over", "boost")).alias("boost"))


@query("market_renaming", "WITH {offers}, n(market, name) AS (VALUES ('F', 'final'), ('O', 'open')) SELECT league, CASE WHEN league = 'R' AND o.market = 'O' THEN 'reopened' ELSE coalesce(name, o.market) END AS market, count(*) AS n FROM offers o LEFT JOIN n ON n.market = o.market GROUP BY 1, 2")
def renaming(t):
    return t.offers.groupBy("league", renamed_market(c("league"), c("market"), NAMES, EXCEPTIONS).alias("market")).agg(F.count("*").alias("n"))


@query("staged_quotes", "WITH {quotes} SELECT entity, book, okey, lnum, line, tax, coalesce(CASE WHEN lnum % 2 = 0 THEN observed_at END, TIMESTAMP '2002-01-01 00:00:00') AS observed_at, ev FROM quotes")
def staged(t):
    """Observations without a time of their own get the run's."""
    own = F.when(c("lnum") % 2 == 0, c("observed_at"))
    return t.quotes.select("entity", "book", "okey", "lnum", "line", "tax", F.coalesce(own, F.expr("TIMESTAMP_NTZ '2002-01-01 00:00:00'")).alias("observed_at"), "ev")


@query("platform_offers_append", f"""WITH {{offers}}, d AS (SELECT * FROM offers QUALIFY row_number() OVER (PARTITION BY player, market ORDER BY abs(coalesce(boost_over, boost) - 1), {_TIES}) = 1),
u AS (SELECT player, CASE WHEN league = 'R' AND market = 'O' THEN 'reopened' WHEN market = 'F' THEN 'final' ELSE 'open' END AS market, platform, line, (1 - sharp) / ((1 - sharp) + 1.05 * sharp) AS under FROM d)
SELECT player, market, platform, line, round(under + 1e-7, 4) AS under, round(CASE WHEN -line / ln(1 - under) < 5 * line THEN -line / ln(1 - under) END + 1e-7, 4) AS ev FROM u""")
def platform_append(t):
    kept = nearest_neutral(t.offers, ["player", "market"], TIES)
    under = devig(1 - c("sharp"), 1.05 * c("sharp"))
    out = kept.select("player", renamed_market(c("league"), c("market"), NAMES, EXCEPTIONS).alias("market"), "platform", "line", under.alias("under"))
    return out.withColumns({"ev": r(exponential_mean(c("line"), c("under"))), "under": r(c("under"))})


def _nested(t) -> DataFrame:
    """Per (game, player) its books' quotes as nested rows, as a feed delivers them; some means and chances are missing."""
    quote = F.struct("book", F.when(c("lnum") % 3 > 0, c("ev")).alias("ev"), F.when(c("lnum") % 2 > 0, c("under_prob")).alias("under"), "line")
    return t.quotes.groupBy("okey", "entity").agg(F.collect_list(quote).alias("books"))


@query("book_quotes_append", "WITH {quotes}, q AS (SELECT okey, entity, book, CASE WHEN lnum % 3 > 0 THEN ev END AS ev, CASE WHEN lnum % 2 > 0 THEN under_prob END AS under, line FROM quotes) SELECT * FROM q WHERE ev IS NOT NULL OR under IS NOT NULL")
def book_append(t):
    return _nested(t).select("okey", "entity", F.inline("books")).where("ev IS NOT NULL OR under IS NOT NULL")


@query("team_markets_append", "WITH {quotes} SELECT okey, book, sum(line) AS ev, count(*) AS n FROM quotes WHERE lnum % 3 > 0 GROUP BY okey, book")
def team_append(t):
    means = F.transform(F.filter("books", lambda b: b["ev"].isNotNull()), lambda b: F.struct(b["book"].alias("book"), b["line"].alias("ev")))
    return _nested(t).select("okey", F.inline(means)).groupBy("okey", "book").agg(F.sum("ev").alias("ev"), F.count("*").alias("n"))


@query("ladder_append", "WITH {quotes} SELECT entity, book, okey, line + k AS line, under_prob / (k + 1) AS p_over FROM quotes, (SELECT unnest([0, 1, 2]) AS k) WHERE k < 2 AND lnum % 4 > k")
def ladder_append(t):
    rung = lambda k: F.struct((c("line") + k).alias("line"), F.when(c("lnum") % 4 > k, c("under_prob") / (k + 1)).alias("p_over"))
    rows = t.quotes.select("entity", "book", "okey", F.inline(F.array(rung(0), rung(1), F.struct(F.lit(None).cast("double").alias("line"), c("under_prob").alias("p_over")))))
    return rows.where("line IS NOT NULL AND p_over IS NOT NULL")


# ---- filters

#: Preset predicates; a session is only needed where they are used.
LENSES = {
    "best": "over * boost > 0.7",
    "sharp": "abs(over - sharp) <= 0.05D",
    "longshots": "over < 0.35D AND boost > 1",
    "unboosted": "abs(boost - 1) < 0.011D",
    "heavy": "proj > 1.5 * line",
}


@query("named_lenses", """WITH {offers}, s AS (SELECT min(day) AS soonest FROM offers WHERE day >= DATE '1999-01-01')
SELECT lens, count(*) AS n, CAST(count(DISTINCT player) AS BIGINT) AS players FROM (
SELECT 'best' AS lens, player FROM offers WHERE over * boost > 0.7 UNION ALL SELECT 'sharp', player FROM offers WHERE abs(over - sharp) <= 0.05 UNION ALL SELECT 'longshots', player FROM offers WHERE over < 0.35 AND boost > 1
UNION ALL SELECT 'unboosted', player FROM offers WHERE abs(boost - 1) < 0.011 UNION ALL SELECT 'heavy', player FROM offers WHERE proj > 1.5 * line UNION ALL SELECT 'soonest', player FROM offers, s WHERE day = soonest) GROUP BY lens""")
def lenses(t):
    """All lenses in one pass: an offer is counted under each lens that it passes; the soonest day is a scalar beside them."""
    soonest = t.offers.where("day >= DATE '1999-01-01'").agg(F.min("day").alias("soonest"))
    tests = {name: F.expr(test) for name, test in LENSES.items()} | {"soonest": c("day") == c("soonest")}
    named = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in tests.items()]))
    rows = t.offers.join(F.broadcast(soonest)).select("player", F.explode(named).alias("lens"))
    return rows.groupBy("lens").agg(F.count("*").alias("n"), F.countDistinct("player").alias("players"))


def sidebar(history: DataFrame, leagues=None, platforms=None, markets=None, days: tuple[str, str] | None = None, least: float | None = None) -> DataFrame:
    """Settled rows by optional lists, a range of days and a least chance; pushes go."""
    for name, wanted in (("league", leagues), ("platform", platforms), ("market", markets)):
        history = history.where(c(name).isin(wanted)) if wanted else history
    history = history.where(c("day").between(*map(F.lit, days))) if days else history
    history = history.where(c("prob") >= least) if least is not None else history
    return history.where("actual <> line")


@query("sidebar_filter", "WITH {history} SELECT league, platform, count(*) AS n, round(avg(prob) + 1e-7, 4) AS prob FROM history WHERE league IN ('A', 'R') AND market IN ('O') AND day BETWEEN DATE '1996-01-01' AND DATE '1999-12-31' AND prob >= 0.6 AND actual <> line GROUP BY ALL")
def sidebar_filter(t):
    found = sidebar(t.history, leagues=["A", "R"], markets=["O"], days=("1996-01-01", "1999-12-31"), least=0.6)
    return found.groupBy("league", "platform").agg(F.count("*").alias("n"), r(F.avg("prob")).alias("prob"))


@query("alternate_line_flag", "WITH {offers}, k AS (SELECT *, CASE WHEN lnum % 7 = 0 THEN NULL ELSE median(line) OVER (PARTITION BY player) END AS mid FROM offers) SELECT okey, lnum, price, player, CASE WHEN mid IS NULL THEN false ELSE abs(line - mid) > CASE WHEN market = 'O' THEN 0.75 ELSE 2.5 END END AS alternate FROM k")
def alternate(t):
    mid = F.when(c("lnum") % 7 != 0, F.median("line").over(Window.partitionBy("player")))
    limit = F.when(c("market") == "O", 0.75).otherwise(2.5)  # counts, and everything else
    return t.offers.select("okey", "lnum", "price", "player", F.coalesce(F.abs(c("line") - mid) > limit, F.lit(False)).alias("alternate"))


@query("side_selection", f"""WITH {{offers}}, s AS (SELECT *, least(over, 0.9) AS o, least(1 - over, 0.9) AS u FROM offers),
b AS (SELECT *, CASE WHEN o >= u THEN 'Over' ELSE 'Under' END AS bet, greatest(o, u) AS win, least(CASE WHEN o >= u THEN coalesce(boost_over, boost) ELSE 2 - boost END * 3.4, 3.65) AS pays FROM s)
SELECT player, okey, lnum, price, bet, round(win + 1e-7, 4) AS win, round(pays + 1e-7, 4) AS pays FROM b QUALIFY row_number() OVER (PARTITION BY player ORDER BY abs(round(pays + 1e-7, 4) - 1), {_TIES}) <= 3""")
def sides(t):
    o, u = F.least(c("over"), F.lit(0.9)), F.least(1 - c("over"), F.lit(0.9))
    boost = F.when(o >= u, F.coalesce("boost_over", "boost")).otherwise(2 - c("boost"))
    rows = t.offers.withColumns({"bet": F.when(o >= u, "Over").otherwise("Under"), "win": r(F.greatest(o, u)), "pays": r(F.least(boost * 3.4, F.lit(3.65)))})
    return rows.withColumn("k", place(["player"], F.abs(c("pays") - 1), *TIES)).where("k <= 3").select("player", "okey", "lnum", "price", "bet", "win", "pays")


@query("leg_filter", "WITH {offers} SELECT okey, lnum, price, player FROM offers WHERE over - 0.5 >= 0.05 AND sharp - 0.5 >= 0.02 AND abs(over - sharp) <= 0.15")
def leg_filter(t):
    rules = {"edge": c("over") - 0.5 >= 0.05, "sharp": c("sharp") - 0.5 >= 0.02, "agreement": F.abs(c("over") - c("sharp")) <= 0.15}
    return t.offers.where(reduce(Column.__and__, rules.values())).select("okey", "lnum", "price", "player")


@query("no_history_drop", """WITH {offers}, {log}, k AS (SELECT player % 150 AS player, avg(value) AS mean_yr, stddev_samp(value) AS sd_yr FROM log WHERE value < 40 GROUP BY 1),
o AS (SELECT *, player % 200 AS p FROM offers) SELECT okey, lnum, price, o.player FROM o LEFT JOIN k ON k.player = o.p WHERE greatest(coalesce(mean_yr, 0), coalesce(sd_yr, 0)) >= 0.1 OR lnum = 7""")
def no_history(t):
    """Offers of players whose recent level and spread are both about nothing go, but head-to-head ones (here the seventh line) stay."""
    level = t.log.where("value < 40").groupBy((c("player") % 150).alias("p")).agg(F.avg("value").alias("mean_yr"), F.stddev_samp("value").alias("sd_yr"))
    signal = F.greatest(F.coalesce("mean_yr", F.lit(0.0)), F.coalesce("sd_yr", F.lit(0.0)))
    return t.offers.withColumn("p", c("player") % 200).join(level, "p", "left").where((signal >= 0.1) | (c("lnum") == 7)).select("okey", "lnum", "price", "player")


@query("empty_signal_drop", "SELECT l_orderkey AS okey, l_linenumber AS lnum, l_extendedprice AS price, CASE WHEN l_linestatus = 'O' THEN l_discount END AS cv, CASE WHEN l_linestatus = 'F' THEN l_discount END AS sigma FROM lineitem WHERE l_discount <> 0 OR l_tax <> 0")
def empty_signal(t):
    """Rows whose signals are all zero go; one column of shapes is split by family."""
    rows = t.lineitem.where(F.greatest(*[F.abs(F.coalesce(x, F.lit(0.0))) for x in ("l_discount", "l_tax")]) > 0)
    shape = {"cv": F.when(c("l_linestatus") == "O", c("l_discount")), "sigma": F.when(c("l_linestatus") == "F", c("l_discount"))}
    return rows.select(c("l_orderkey").alias("okey"), c("l_linenumber").alias("lnum"), c("l_extendedprice").alias("price"), *[v.alias(k) for k, v in shape.items()])


ELIGIBLE = {"O": ["ECONOMY", "PROMO"], "F": ["STANDARD", "SMALL", "MEDIUM", "LARGE", "PROMO"]}


@query("position_eligibility", "SELECT l_linestatus AS market, p_type AS position, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey WHERE (l_linestatus = 'O' AND p_type IN ('ECONOMY', 'PROMO')) OR (l_linestatus = 'F' AND p_type IN ('STANDARD', 'SMALL', 'MEDIUM', 'LARGE', 'PROMO')) GROUP BY ALL")
def eligibility(t):
    able = t.spark.createDataFrame([(m, p) for m, ps in ELIGIBLE.items() for p in ps], "market string, position string")
    rows = t.lineitem.join(t.part, c("p_partkey") == c("l_partkey")).select(c("l_linestatus").alias("market"), c("p_type").alias("position"))
    return rows.join(F.broadcast(able), ["market", "position"], "left_semi").groupBy("market", "position").agg(F.count("*").alias("n"))


@query("edge_and_match_columns", "WITH {offers} SELECT okey, lnum, price, player, round(over * boost * 1.8 - 1 + 1e-7, 4) + 0.0 AS edge, CASE WHEN lnum % 2 = 0 THEN 'T' || team || ' @ T' || (team + 1) ELSE 'T' || team || ' v T' || (team + 1) END AS match, 'Player ' || player AS label FROM offers")
def edges(t):
    home = F.concat(F.lit("T"), "team")
    away = F.concat(F.lit("T"), (c("team") + 1).cast("string"))
    match = F.concat(home, F.when(c("lnum") % 2 == 0, " @ ").otherwise(" v "), away)
    return t.offers.select("okey", "lnum", "price", "player", r(c("over") * c("boost") * 1.8 - 1).alias("edge"), match.alias("match"), F.concat(F.lit("Player "), "player").alias("label"))


# ---- legs


def leg(player: Column, market: Column, line: Column, over: Column, boost: Column, team: Column, game: Column) -> Column:
    """An offer as one structured value; what is missing has a default, so that legs compare and print alike."""
    text = lambda x: F.coalesce(x.cast("string"), F.lit(""))
    side = F.when(F.coalesce(over, F.lit(0.5)) >= 0.5, "Over").otherwise("Under")
    return F.struct(text(player).alias("player"), text(market).alias("market"), side.alias("bet"), F.coalesce(line, F.lit(0.0)).alias("line"), F.coalesce(boost, F.lit(1.0)).alias("boost"), text(team).alias("team"), text(game).alias("game"))


def legs(t) -> DataFrame:
    """One leg a (game, player), the least by its own order."""
    rows = t.offers.withColumn("k", place(["okey", "player"], *TIES)).where("k = 1")
    return rows.select("okey", "player", "over", "sharp", "team", leg(c("player"), c("market"), c("line"), c("over"), c("boost_over"), c("team"), c("okey")).alias("leg"))


_LEGS = f"legs AS (SELECT okey, player, over, sharp, team, market, line, boost_over FROM offers QUALIFY row_number() OVER (PARTITION BY okey, player ORDER BY {_TIES}) = 1)"


@query("structured_legs", f"WITH {{offers}}, {_LEGS} SELECT CAST(player AS VARCHAR) AS player, market, CASE WHEN over >= 0.5 THEN 'Over' ELSE 'Under' END AS bet, line, coalesce(boost_over, 1.0) AS boost, CAST(team AS VARCHAR) AS team, CAST(okey AS VARCHAR) AS game FROM legs")
def structured(t):
    return legs(t).select("leg.*")


def parlay_faults(legs: Column) -> Column:
    """What is wrong with an array of legs: repeated players, one team alone, more than one game; empty if nothing is."""
    of = lambda field: F.transform(legs, lambda x: x[field])
    found = {"repeated": F.size(F.array_distinct(of("player"))) < F.size(legs), "one team": F.size(F.array_distinct(of("team"))) < 2, "games": F.size(F.array_distinct(of("game"))) > 1}
    return F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in found.items()]))


@query("parlay_validation", """WITH l AS (SELECT l_orderkey AS entry, list(l_partkey) AS p, list(l_suppkey % 9) AS s, list(l_linestatus) AS g FROM lineitem GROUP BY 1)
SELECT entry, concat_ws(',', CASE WHEN len(list_distinct(p)) < len(p) THEN 'repeated' END, CASE WHEN len(list_distinct(s)) < 2 THEN 'one team' END, CASE WHEN len(list_distinct(g)) > 1 THEN 'games' END) AS faults FROM l""")
def validation(t):
    one = F.struct(c("l_partkey").alias("player"), (c("l_suppkey") % 9).alias("team"), c("l_linestatus").alias("game"))
    entries = t.lineitem.groupBy(c("l_orderkey").alias("entry")).agg(F.collect_list(one).alias("legs"))
    return entries.select("entry", F.array_join(parlay_faults(c("legs")), ",").alias("faults"))


def _entity() -> Column:
    """Combined and head-to-head entities out of plain players."""
    p, q = F.concat(F.lit("P"), "player"), F.concat(F.lit("P"), (c("player") + 1).cast("string"))
    return F.when(c("lnum") % 3 == 0, F.concat(p, F.lit(" + "), q)).when(c("lnum") % 3 == 1, F.concat(p, F.lit(" vs. "), q)).otherwise(p)


@query("combo_and_versus_split", """WITH {offers}, s AS (SELECT okey, lnum, price, 'P' || player AS name, 1 AS sign FROM offers UNION ALL SELECT okey, lnum, price, 'P' || (player + 1), CASE WHEN lnum % 3 = 1 THEN -1 ELSE 1 END FROM offers WHERE lnum % 3 < 2)
SELECT okey, lnum, price, name, sign FROM s""")
def split(t):
    return t.offers.select("okey", "lnum", "price", F.inline(sides_of(_entity())))


@query("nearest_offer", f"WITH {{offers}}, w AS (SELECT p_partkey AS player, 1 + p_partkey % 50 AS wanted FROM part) SELECT w.player, wanted, line, okey, lnum FROM w LEFT JOIN (SELECT * FROM offers) o ON o.player = w.player QUALIFY row_number() OVER (PARTITION BY w.player ORDER BY abs(line - wanted), {_TIES}) = 1")
def nearest(t):
    wanted = t.part.select(c("p_partkey").alias("player"), (1 + c("p_partkey") % 50).alias("wanted"))
    return wanted.join(t.offers, "player", "left").withColumn("k", place(["player"], F.abs(c("line") - c("wanted")), *TIES)).where("k = 1").select("player", "wanted", "line", "okey", "lnum")


@query("cross_batch_parlay_dedup", "WITH {offers}, b AS (SELECT okey, lnum % 2 AS batch, round(sum(over) + 1e-7, 4) AS model_ev, round(sum(sharp) + 1e-7, 4) AS market_ev FROM offers GROUP BY ALL) SELECT model_ev, market_ev, min(batch * 100000000 + okey) AS first, count(*) AS copies FROM b GROUP BY ALL")
def parlay_dedup(t):
    """Entries of several batches with the same two values are one; the earliest batch's stays."""
    batch = t.offers.groupBy("okey", (c("lnum") % 2).alias("batch")).agg(r(F.sum("over")).alias("model_ev"), r(F.sum("sharp")).alias("market_ev"))
    number = c("batch") * F.lit(100000000).cast("long") + c("okey")
    return batch.groupBy("model_ev", "market_ev").agg(F.min(number).alias("first"), F.count("*").alias("copies"))


@query("normalised_names", """WITH n AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN c_name || ' Jr. (X)' WHEN 1 THEN 'José ' || c_mktsegment || ' III' WHEN 2 THEN 'a. o’neal + ' || c_name ELSE lower(c_mktsegment) || ' vs ' || c_name || ' Sr' END AS name FROM customer),
b AS (SELECT c_custkey, regexp_replace(replace(replace(strip_accents(name), '.', ''), '’', chr(39)), '[(\\[][^)\\]]*[)\\]]', '', 'g') AS bare FROM n),
s AS (SELECT c_custkey, bare, list_transform(string_split_regex(bare, '\\+|(?i: vs )'), lambda x: regexp_replace(trim(x), ' (Jr|Sr|II|III|IV)$', '')) AS sides FROM b),
t AS (SELECT c_custkey, bare, list_transform(sides, lambda x: list_aggregate(list_transform(regexp_extract_all(lower(trim(x)), '[a-z]+|[^a-z]+'), lambda w: upper(w[1]) || w[2:]), 'string_agg', '')) AS sides FROM s),
a AS (SELECT c_custkey, bare, list_transform(sides, lambda x: CASE WHEN x = 'Customer#000000004' THEN 'First' ELSE x END) AS sides FROM t)
SELECT c_custkey, CASE WHEN contains(bare, '+') THEN array_to_string(sides, ' + ') ELSE array_to_string(sides, ' vs. ') END AS name FROM a""")
def names(t):
    kinds = [F.concat("c_name", F.lit(" Jr. (X)")), F.concat(F.lit("José "), "c_mktsegment", F.lit(" III")), F.concat(F.lit("a. o’neal + "), "c_name"), F.concat(F.lower("c_mktsegment"), F.lit(" vs "), "c_name", F.lit(" Sr"))]
    name = F.element_at(F.array(*kinds), (c("c_custkey") % 4 + 1).cast("int"))
    return t.customer.select("c_custkey", normalised(name, {"Customer#000000004": "First"}).alias("name"))


# ---- partners and pairs of legs


def pairs_of(rows: DataFrame) -> DataFrame:
    """Ordered pairs of different legs of one game; a game has few legs."""
    return rows.alias("a").join(rows.alias("b"), (c("a.okey") == c("b.okey")) & (c("a.player") != c("b.player")))


_RHO = "((a.player * 7 + b.player * 7) % 41 - 20) / 50.0"


def rho() -> Column:
    """A stand-in for the stored correlation of two players."""
    return ((c("a.player") * 7 + c("b.player") * 7) % 41 - 20) / F.lit(50.0)


@query("leg_pair_modifiers", f"""WITH {{offers}}, {_LEGS}, p AS (SELECT a.okey, a.player AS p1, b.player AS p2, CASE WHEN a.team = b.team THEN 'same team' WHEN a.market = b.market THEN 'same market' ELSE 'other' END AS kind, a.over * b.over AS fair, least(a.sharp * b.sharp, 0.4) AS quoted
FROM legs a JOIN legs b ON a.okey = b.okey AND a.player < b.player) SELECT okey, p1, p2, kind, round(quoted / fair * CASE kind WHEN 'same team' THEN 0.9 WHEN 'same market' THEN 0.95 ELSE 1 END + 1e-7, 4) AS modifier FROM p""")
def pair_modifiers(t):
    kind = F.when(c("a.leg.team") == c("b.leg.team"), "same team").when(c("a.leg.market") == c("b.leg.market"), "same market").otherwise("other")
    modifier = F.least(c("a.sharp") * c("b.sharp"), F.lit(0.4)) / (c("a.over") * c("b.over"))
    table = F.when(kind == "same team", 0.9).when(kind == "same market", 0.95).otherwise(1.0)
    return pairs_of(legs(t)).where("a.player < b.player").select("a.okey", c("a.player").alias("p1"), c("b.player").alias("p2"), kind.alias("kind"), r(modifier * table).alias("modifier"))


@query("correlated_partners", f"""WITH {{offers}}, {_LEGS}, p AS (SELECT a.okey, a.player AS player, b.player AS partner, a.team = b.team AS same, {_RHO} AS rho, a.over AS p, b.over AS q FROM legs a JOIN legs b ON a.okey = b.okey AND a.player <> b.player)
SELECT okey, player, same, partner, round(exp(rho * sqrt(p * (1 - p) * q * (1 - q))) + 1e-7, 4) AS multiplier FROM p WHERE q >= 0.4 AND rho > 0.05 QUALIFY row_number() OVER (PARTITION BY okey, player, same ORDER BY rho DESC, partner) = 1""")
def partners(t):
    """The best partner of each leg on its own and on the other team, above floors of chance and correlation, and what the pair is worth over independence."""
    spread = F.sqrt(c("a.over") * (1 - c("a.over")) * c("b.over") * (1 - c("b.over")))
    rows = pairs_of(legs(t)).select("a.okey", "a.player", (c("a.team") == c("b.team")).alias("same"), c("b.player").alias("partner"), rho().alias("rho"), r(F.exp(rho() * spread)).alias("multiplier"), c("b.over").alias("q"))
    best = rows.where("q >= 0.4 AND rho > 0.05").withColumn("k", place(["okey", "player", "same"], F.desc("rho"), "partner"))
    return best.where("k = 1").select("okey", "player", "same", "partner", "multiplier")


@query("top_partner_per_player", f"WITH {{offers}}, {_LEGS} SELECT a.player, b.player AS partner, round({_RHO} + 1e-7, 4) + 0.0 AS rho FROM legs a JOIN legs b ON a.okey = b.okey AND a.player <> b.player QUALIFY row_number() OVER (PARTITION BY a.player ORDER BY {_RHO} DESC, b.player, a.okey) = 1")
def top_partner(t):
    rows = pairs_of(legs(t)).select("a.okey", "a.player", c("b.player").alias("partner"), rho().alias("rho"))
    return rows.withColumn("k", place(["player"], F.desc("rho"), "partner", "okey")).where("k = 1").select("player", "partner", r(c("rho")).alias("rho"))


SHRINK = {"O": 0.8, "F": 0.6}


@query("leg_arrays", f"""WITH {{offers}}, {_LEGS}, l AS (SELECT okey, player, 0.5 + (over - 0.5) * CASE market WHEN 'O' THEN 0.8 ELSE 0.6 END AS p, CASE WHEN over >= 0.5 THEN coalesce(boost_over, 1.0) ELSE 2 - coalesce(boost_over, 1.0) END AS boost FROM legs)
SELECT okey, string_agg(CAST(player AS VARCHAR), ',' ORDER BY player) AS players, round(exp(sum(ln(greatest(p, 1 - p)))) + 1e-7, 4) AS p_all, round(exp(sum(ln(boost))) + 1e-7, 4) AS boost FROM l GROUP BY okey""")
def leg_arrays(t):
    """Each game once: its legs in order as arrays, shrunk by market, with the boost of the side taken."""
    factor = F.create_map(*[F.lit(x) for pair in SHRINK.items() for x in pair])[c("leg.market")]
    p = 0.5 + (c("over") - 0.5) * factor
    boost = F.when(c("over") >= 0.5, c("leg.boost")).otherwise(2 - c("leg.boost"))
    games = legs(t).groupBy("okey").agg(F.array_sort(F.collect_list(F.struct("player", F.greatest(p, 1 - p).alias("p"), boost.alias("boost")))).alias("legs"))
    product = lambda field: F.aggregate(F.transform("legs", lambda x: x[field]), F.lit(1.0), lambda a, x: a * x)
    return games.select("okey", F.array_join(F.transform("legs", lambda x: x["player"].cast("string")), ",").alias("players"), r(product("p")).alias("p_all"), r(product("boost")).alias("boost"))


@query("position_rank_labels", """WITH u AS (SELECT p_type AS position, p_partkey AS player, sum(l_quantity) AS usage FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY position ORDER BY usage DESC, player) AS rank FROM u)
SELECT player, left(position, 2) || rank AS label, left(position, 2) || rank || '.O,' || left(position, 2) || rank || '.F' AS own, '_OPP_' || left(position, 2) || rank || '.O' AS against FROM k WHERE rank <= 40""")
def position_labels(t):
    """Position code and rank as a label, the label's markets, and the label as an opponent's."""
    usage = t.lineitem.join(t.part, c("p_partkey") == c("l_partkey")).groupBy(c("p_type").alias("position"), c("p_partkey").alias("player")).agg(F.sum("l_quantity").alias("usage"))
    ranked = usage.withColumn("rank", place(["position"], F.desc("usage"), "player")).where("rank <= 40")
    label = F.concat(F.substring("position", 1, 2), c("rank").cast("string"))
    markets = F.transform(F.array(F.lit("O"), F.lit("F")), lambda m: F.concat(label, F.lit("."), m))
    return ranked.select("player", label.alias("label"), F.array_join(markets, ",").alias("own"), F.concat(F.lit("_OPP_"), markets[0]).alias("against"))


@query("interaction_features", "WITH {offers} SELECT okey, lnum, price, player, round(over * proj + 1.37e-9, 4) AS over_x_proj, round(over * sharp + 1.37e-9, 4) AS over_x_sharp, round(proj * sharp + 1.37e-9, 4) AS proj_x_sharp FROM offers")
def interactions(t):
    features = ["over", "proj", "sharp"]
    products = [(a, b) for i, a in enumerate(features) for b in features[i + 1 :]]
    return t.offers.select("okey", "lnum", "price", "player", *[F.round(c(a) * c(b) + F.lit(1.37e-9), 4).alias(f"{a}_x_{b}") for a, b in products])  # products have up to eight digits, so the nudge has more


@query("playoff_flag", "SELECT o_orderkey AS game, substr(lpad(CAST(o_orderkey AS VARCHAR), 8, '0'), 7, 1) IN ('4', '5') AS playoff, CAST(CASE WHEN substr(lpad(CAST(o_orderkey AS VARCHAR), 8, '0'), 7, 1) IN ('4', '5') THEN CASE WHEN o_orderkey % 10 < 4 THEN 3 ELSE 4 END ELSE 0 END AS BIGINT) AS to_win FROM orders")
def playoffs(t):
    """A game's kind is a digit of its id; the wins needed depend on the round, the last digit."""
    code = F.lpad(c("o_orderkey").cast("string"), 8, "0")
    playoff = code.substr(7, 1).isin("4", "5")
    wins = F.when(playoff, F.when(code.substr(8, 1).cast("int") < 4, 3).otherwise(4)).otherwise(0)
    return t.orders.select(c("o_orderkey").alias("game"), playoff.alias("playoff"), wins.cast("long").alias("to_win"))


@query("role_score_tiers", """WITH s AS (SELECT l_partkey AS player, l_linestatus AS grp, l_shipdate < TIMESTAMP '1999-01-01' AS train, sum(l_quantity) * (sum(l_quantity * l_discount) + sum(l_quantity * l_tax)) AS score FROM lineitem GROUP BY ALL),
q AS (SELECT grp, quantile_cont(score, 0.33) AS lo, quantile_cont(score, 0.67) AS hi FROM s WHERE train GROUP BY grp)
SELECT player, grp, round(score + 1e-7, 3) AS score, CASE WHEN round(score + 1e-7, 6) <= round(lo + 1e-7, 6) THEN 'low' WHEN round(score + 1e-7, 6) <= round(hi + 1e-7, 6) THEN 'mid' ELSE 'high' END AS tier FROM s JOIN q USING (grp) WHERE NOT train""")
def role_tiers(t):
    """Volume times usage-weighted efficiency; tiers by thresholds learned on earlier rows."""
    efficiency = F.sum(c("l_quantity") * c("l_discount")) + F.sum(c("l_quantity") * c("l_tax"))
    s = t.lineitem.groupBy(c("l_partkey").alias("player"), c("l_linestatus").alias("grp"), (c("l_shipdate") < F.expr("TIMESTAMP_NTZ '1999-01-01'")).alias("train")).agg((F.sum("l_quantity") * efficiency).alias("score"))
    edges = s.where("train").groupBy("grp").agg(F.percentile("score", F.lit(0.33)).alias("lo"), F.percentile("score", F.lit(0.67)).alias("hi"))
    six = lambda x: r(c(x), 6)
    tier = F.when(six("score") <= six("lo"), "low").when(six("score") <= six("hi"), "mid").otherwise("high")
    return s.where("NOT train").join(F.broadcast(edges), "grp").select("player", "grp", r(c("score"), 3).alias("score"), tier.alias("tier"))


# ---- entries


@query("entry_building", f"""WITH {{offers}}, {_LEGS}, l AS (SELECT okey, player, team, over, 0.5 + (over - 0.5) * CASE market WHEN 'O' THEN 0.8 ELSE 0.6 END AS p, CASE market WHEN 'O' THEN 0.8 ELSE 0.6 END AS shrink FROM legs WHERE over >= 0.4),
e AS (SELECT okey AS entry, count(*) AS size, exp(sum(ln(p))) * pow(1.9, count(*)) AS value, min(shrink) AS shrink, count(DISTINCT team) AS teams FROM l GROUP BY okey)
SELECT entry, size, round(value + 1e-7, 4) AS value, CAST(shrink AS DOUBLE) AS shrink, round(floor(greatest((value - 1) / 4, 0) * shrink * 10000 + 1e-6) / 100, 2) AS stake FROM e WHERE size BETWEEN 2 AND 6 AND teams >= 2 AND value > 1.01""")
def entries(t):
    """Legs that pass make one entry a game; the least trust among its legs shrinks the stake; entries need legs of two teams."""
    trust = F.create_map(*[F.lit(x) for pair in SHRINK.items() for x in pair])[c("leg.market")]
    rows = legs(t).where("over >= 0.4").select(c("okey").alias("entry"), "team", (0.5 + (c("over") - 0.5) * trust).alias("p"), trust.alias("trust"))
    built = rows.groupBy("entry").agg(F.collect_list("p").alias("p"), F.collect_list("trust").alias("trust"), F.collect_set("team").alias("teams"))
    value = F.aggregate("p", F.lit(1.0), lambda a, x: a * x) * F.pow(F.lit(1.9), F.size("p"))
    built = built.withColumns({"value": value, "shrink": F.array_min("trust"), "size": F.size("p").cast("long")}).where((c("size").between(2, 6)) & (F.size("teams") >= 2) & (c("value") > 1.01))
    stake = F.floor(F.greatest((c("value") - 1) / 4, F.lit(0.0)) * c("shrink") * 10000 + 1e-6) / 100
    return built.select("entry", "size", r(c("value")).alias("value"), "shrink", F.round(stake, 2).alias("stake"))


@query("entries_to_flat_rows", f"WITH {{offers}}, {_LEGS} SELECT okey AS entry, CAST(row_number() OVER (PARTITION BY okey ORDER BY player) AS BIGINT) AS place, CAST(player AS VARCHAR) AS player, market, line, CAST(count(*) OVER (PARTITION BY okey) AS BIGINT) AS size FROM legs")
def flat(t):
    nested = legs(t).groupBy(c("okey").alias("entry")).agg(F.array_sort(F.collect_list(F.struct("player", "leg"))).alias("legs"))
    return nested.select("entry", F.size("legs").cast("long").alias("size"), F.posexplode("legs").alias("i", "x")).select("entry", (c("i") + 1).cast("long").alias("place"), "x.leg.player", "x.leg.market", "x.leg.line", "size")


@query("daily_commit_budget", """SELECT CAST(o_orderdate AS DATE) AS day, CAST(greatest(5 - count(*), 0) AS BIGINT) AS left_entries, round(greatest(0.25 - sum(o_totalprice / 1e6) / 5000 * 100, 0) + 1e-7, 4) AS left_fraction, count(*) FILTER (o_orderstatus = 'F') AS power, count(*) FILTER (o_orderstatus <> 'F') AS flex FROM orders GROUP BY 1""")
def commit_budget(t):
    """What a day's earlier entries leave: of five entries, and of a quarter of the bankroll; entries are parted by their rule."""
    rows = t.orders.groupBy(c("o_orderdate").cast("date").alias("day"))
    return rows.agg(F.greatest(5 - F.count("*"), F.lit(0)).cast("long").alias("left_entries"), r(F.greatest(0.25 - F.sum(c("o_totalprice") / 1e6) / 5000 * 100, F.lit(0.0))).alias("left_fraction"), F.count_if(c("o_orderstatus") == "F").alias("power"), F.count_if(c("o_orderstatus") != "F").alias("flex"))


@query("settled_filter_and_balance", """WITH done AS (SELECT DISTINCT l_orderkey AS id FROM lineitem WHERE l_returnflag = 'R') SELECT o_custkey AS account, count(*) AS open, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS balance FROM orders WHERE o_orderkey NOT IN (SELECT id FROM done) GROUP BY 1""")
def settled(t):
    done = t.lineitem.where("l_returnflag = 'R'").select(c("l_orderkey").alias("o_orderkey")).distinct()
    left = t.orders.join(done, "o_orderkey", "left_anti")
    return left.groupBy(c("o_custkey").alias("account")).agg(F.count("*").alias("open"), F.max_by("o_totalprice", F.struct("o_orderdate", "o_orderkey")).alias("balance"))
