"""Profiles, joins and game logs: what feature rows and training matrices are made of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from sabermill.functions.odds import stable_round as r
from sabermill.operators.asof import latest_per_key
from sabermill.plans.base import query

c = F.col


def rounded(*names: str) -> list[Column]:
    return [r(c(n)).alias(n) for n in names]


def numbered(keys: list[str], *order) -> Column:
    return F.row_number().over(Window.partitionBy(*keys).orderBy(*order))


def ratio(over: Column, under: Column) -> Column:
    return over / F.nullif(under, F.lit(0.0))


# ---- joins


def suffixed_join(left: DataFrame, right: DataFrame, on: list[str], suffix: str, how: str = "left") -> DataFrame:
    """A join whose right columns get a suffix where the left has their name, so that none is lost or ambiguous."""
    renamed = right.select(*[c(n).alias(n if n in on or n not in left.columns else n + suffix) for n in right.columns])
    return left.join(renamed, on, how)


@query("left_join_with_suffixes", "WITH a AS (SELECT l_partkey AS player, sum(l_quantity) AS usage, count(*) AS games FROM lineitem WHERE l_shipdate < TIMESTAMP '1999-01-01' GROUP BY 1), b AS (SELECT l_partkey AS player, sum(l_quantity) AS usage, avg(l_tax) AS tax FROM lineitem WHERE l_shipdate >= TIMESTAMP '1999-01-01' AND l_returnflag = 'R' GROUP BY 1) SELECT player, a.usage, games, b.usage AS usage_next, round(tax + 1e-7, 4) AS tax FROM a LEFT JOIN b USING (player)")
def suffix_join(t):
    rows = t.lineitem.withColumn("player", c("l_partkey"))
    cut = F.expr("TIMESTAMP_NTZ '1999-01-01'")
    before = rows.where(c("l_shipdate") < cut).groupBy("player").agg(F.sum("l_quantity").alias("usage"), F.count("*").alias("games"))
    after = rows.where((c("l_shipdate") >= cut) & (c("l_returnflag") == "R")).groupBy("player").agg(F.sum("l_quantity").alias("usage"), r(F.avg("l_tax")).alias("tax"))
    return suffixed_join(before, after, ["player"], "_next")


@query("bio_right_join", "WITH s AS (SELECT o_custkey AS player, sum(o_totalprice) AS total, count(*) AS games FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) SELECT player, c_name AS name, c_mktsegment AS position, round(total + 1e-7, 2) AS total, games FROM customer RIGHT JOIN s ON c_custkey = player AND c_acctbal > 0")
def bio(t):
    season = t.orders.where("o_orderstatus = 'F'").groupBy(c("o_custkey").alias("player")).agg(r(F.sum("o_totalprice"), 2).alias("total"), F.count("*").alias("games"))
    facts = t.customer.where("c_acctbal > 0").select(c("c_custkey").alias("player"), c("c_name").alias("name"), c("c_mktsegment").alias("position"))
    return facts.join(season, "player", "right")


def prefixed(profile: DataFrame, key: str, prefix: str) -> DataFrame:
    return profile.select(key, *[c(n).alias(prefix + n) for n in profile.columns if n != key])


@query("prefixed_profile_joins", """WITH p AS (SELECT l_partkey AS player, avg(l_quantity) AS q FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1), m AS (SELECT l_suppkey AS team, avg(l_quantity) AS q, avg(l_tax) AS x FROM lineitem WHERE l_suppkey % 5 > 0 GROUP BY 1)
SELECT l_orderkey AS okey, l_linenumber AS lnum, l_extendedprice AS price, round(p.q + 1e-7, 4) AS player_q, round(a.q + 1e-7, 4) AS team_q, round(a.x + 1e-7, 4) AS team_x, round(b.q + 1e-7, 4) AS opp_q, round(b.x + 1e-7, 4) AS opp_x FROM lineitem LEFT JOIN p ON player = l_partkey LEFT JOIN m a ON a.team = l_suppkey LEFT JOIN m b ON b.team = (l_suppkey + 7) % 100""")
def profile_joins(t):
    """Player, team and opponent profiles beside each row; who has none gets nulls."""
    player = t.lineitem.where("l_returnflag <> 'N'").groupBy(c("l_partkey").alias("player")).agg(r(F.avg("l_quantity")).alias("q"))
    team = t.lineitem.where("l_suppkey % 5 > 0").groupBy(c("l_suppkey").alias("team")).agg(r(F.avg("l_quantity")).alias("q"), r(F.avg("l_tax")).alias("x"))
    rows = t.lineitem.select(c("l_orderkey").alias("okey"), c("l_linenumber").alias("lnum"), c("l_extendedprice").alias("price"), c("l_partkey").alias("player"), c("l_suppkey").alias("team"), ((c("l_suppkey") + 7) % 100).alias("opponent"))
    rows = rows.join(prefixed(player, "player", "player_"), "player", "left").join(prefixed(team, "team", "team_"), "team", "left")
    return rows.join(prefixed(team.withColumnRenamed("team", "opponent"), "opponent", "opp_"), "opponent", "left").drop("player", "team", "opponent")


@query("column_by_position", "SELECT l_orderkey AS okey, l_linenumber AS lnum, l_partkey AS player, l_extendedprice AS price, CASE l_linenumber % 4 WHEN 0 THEN l_quantity WHEN 1 THEN l_discount WHEN 2 THEN l_tax END AS allowed FROM lineitem")
def by_position(t):
    """The value of the column that the row's position code names; a code without a column gives null."""
    named = F.create_map(*[x for code, name in enumerate(("l_quantity", "l_discount", "l_tax")) for x in (F.lit(code), c(name))])
    return t.lineitem.select(c("l_orderkey").alias("okey"), c("l_linenumber").alias("lnum"), c("l_partkey").alias("player"), c("l_extendedprice").alias("price"), named[(c("l_linenumber") % 4).cast("int")].alias("allowed"))


_COMPS = "comps AS (SELECT p_partkey AS player, unnest([p_partkey + 1, p_partkey + 2, p_partkey + 5]) AS comp, p_size AS s FROM part), pairs AS (SELECT a.player, a.comp, 1.0 / (1 + abs(a.s - b.p_size)) AS weight FROM comps a JOIN part b ON b.p_partkey = a.comp JOIN part o ON o.p_partkey = a.player WHERE b.p_type = o.p_type OR a.comp = a.player + 1)"


def comp_pairs(t) -> DataFrame:
    """(player, comp, weight): comparable players, of the same type but for the first, weighted by nearness in size."""
    near = t.part.select(c("p_partkey").alias("player"), c("p_type").alias("kind"), c("p_size").alias("size"), F.posexplode(F.array(c("p_partkey") + 1, c("p_partkey") + 2, c("p_partkey") + 5)).alias("i", "comp"))
    other = t.part.select(c("p_partkey").alias("comp"), c("p_type").alias("other"), c("p_size").alias("far"))
    return near.join(other, "comp").where((c("kind") == c("other")) | (c("i") == 0)).select("player", "comp", (1 / (1 + F.abs(c("size") - c("far")))).alias("weight"))


@query("comp_game_rows", f"WITH {_COMPS} SELECT player, l_suppkey AS opponent, count(*) AS n, round(sum(weight * l_quantity) / sum(weight) + 1e-7, 4) AS mean FROM pairs JOIN lineitem ON l_partkey = comp WHERE l_suppkey = player % 100 GROUP BY ALL")
def comp_rows(t):
    """Games of a player's comps against the opponent of the day."""
    games = t.lineitem.select(c("l_partkey").alias("comp"), c("l_suppkey").alias("opponent"), c("l_quantity").alias("value"))
    rows = comp_pairs(t).withColumn("opponent", c("player") % 100).join(games, ["comp", "opponent"])
    return rows.groupBy("player", "opponent").agg(F.count("*").alias("n"), r(F.sum(c("weight") * c("value")) / F.sum("weight")).alias("mean"))


@query("comp_weighted_stats", f"""WITH {_COMPS}, g AS (SELECT l_partkey AS comp, l_quantity AS v, CAST(l_shipdate AS DATE) AS day FROM lineitem), a AS (SELECT avg(l_quantity) AS overall FROM lineitem),
s AS (SELECT player, count(*) AS n, sum(weight) AS w, sum(weight * v) / sum(weight) AS m, sum(weight * v * v) / sum(weight) AS m2, sum(weight * exp(date_diff('day', day, DATE '2002-01-01') / -450.0) * v) / sum(weight * exp(date_diff('day', day, DATE '2002-01-01') / -450.0)) AS recent FROM pairs JOIN g USING (comp) GROUP BY player)
SELECT player, n, round(m + 1e-7, 4) AS mean, round(sqrt(greatest(m2 - m * m, 0)) + 1e-7, 4) AS sd, round((n * m + 10 * overall) / (n + 10) + 1e-7, 4) AS shrunk, round(recent - m + 1e-7, 4) + 0.0 AS trend FROM s, a""")
def comp_stats(t):
    """Distance-weighted level, spread, shrunk level and recent trend over all games of a player's comps."""
    games = t.lineitem.select(c("l_partkey").alias("comp"), c("l_quantity").alias("v"), c("l_shipdate").cast("date").alias("day"))
    age = F.exp(F.datediff(F.lit("2002-01-01").cast("date"), c("day")) / F.lit(-450.0)) * c("weight")
    mean = lambda w, x: F.sum(w * x) / F.sum(w)
    s = comp_pairs(t).join(games, "comp").groupBy("player").agg(F.count("*").alias("n"), mean(c("weight"), c("v")).alias("m"), mean(c("weight"), c("v") * c("v")).alias("m2"), mean(age, c("v")).alias("recent"))
    overall = t.lineitem.agg(F.avg("l_quantity").alias("overall"))
    s = s.join(F.broadcast(overall))
    return s.select("player", "n", r(c("m")).alias("mean"), r(F.sqrt(F.greatest(c("m2") - c("m") * c("m"), F.lit(0.0)))).alias("sd"), r((c("n") * c("m") + 10 * c("overall")) / (c("n") + 10)).alias("shrunk"), r(c("recent") - c("m")).alias("trend"))


@query("comp_recency_signals", f"""WITH {_COMPS}, g AS (SELECT l_partkey AS comp, l_suppkey AS opponent, l_quantity AS v, CAST(l_shipdate AS DATE) AS day FROM lineitem), m AS (SELECT comp, avg(v) AS own FROM g GROUP BY comp)
SELECT player, round(sum(weight * exp(date_diff('day', day, DATE '2002-01-01') / -45.0) * (v - own)) / nullif(sum(weight * exp(date_diff('day', day, DATE '2002-01-01') / -45.0)), 0) + 1e-7, 4) + 0.0 AS signal FROM pairs JOIN g USING (comp) JOIN m USING (comp) WHERE opponent % 10 = player % 10 GROUP BY player""")
def comp_signals(t):
    """How comps did against a kind of opponent over their own level, weighted by nearness and age."""
    games = t.lineitem.select(c("l_partkey").alias("comp"), c("l_suppkey").alias("opponent"), c("l_quantity").alias("v"), c("l_shipdate").cast("date").alias("day"))
    own = games.groupBy("comp").agg(F.avg("v").alias("own"))
    rows = comp_pairs(t).join(games, "comp").where("opponent % 10 = player % 10").join(own, "comp")
    w = c("weight") * F.exp(F.datediff(F.lit("2002-01-01").cast("date"), c("day")) / F.lit(-45.0))
    return rows.groupBy("player").agg(r(ratio(F.sum(w * (c("v") - c("own"))), F.sum(w))).alias("signal"))


@query("head_to_head", "WITH today AS (SELECT p_partkey AS player, p_partkey % 100 AS opponent FROM part) SELECT player, opponent, count(l_quantity) AS games, round(avg(l_quantity) + 1e-7, 4) AS mean FROM today LEFT JOIN lineitem ON l_partkey = player AND l_suppkey = opponent GROUP BY ALL")
def head_to_head(t):
    today = t.part.select(c("p_partkey").alias("player"), (c("p_partkey") % 100).alias("opponent"))
    games = t.lineitem.select(c("l_partkey").alias("player"), c("l_suppkey").alias("opponent"), "l_quantity")
    return today.join(games, ["player", "opponent"], "left").groupBy("player", "opponent").agg(F.count("l_quantity").alias("games"), r(F.avg("l_quantity")).alias("mean"))


@query("team_broadcast", "WITH t AS (SELECT n_nationkey, n_name, count(*) AS rivals FROM nation JOIN supplier ON s_nationkey = n_nationkey GROUP BY ALL) SELECT c_custkey AS player, n_name AS team, rivals FROM customer LEFT JOIN t ON n_nationkey = c_nationkey")
def team_broadcast(t):
    """Team columns beside each player; the side that is broadcast is one row a nation, a bounded dimension."""
    team = t.nation.join(t.supplier, c("s_nationkey") == c("n_nationkey")).groupBy("n_nationkey", "n_name").agg(F.count("*").alias("rivals"))
    return t.customer.join(team, c("n_nationkey") == c("c_nationkey"), "left").select(c("c_custkey").alias("player"), c("n_name").alias("team"), "rivals")


@query("name_id_lookup", "WITH k AS (SELECT lower(replace(p_name, ' ', '-')) AS slug, p_type AS position, min(p_partkey) AS id, count(*) AS n FROM part GROUP BY ALL) SELECT p_partkey AS player, CASE WHEN n = 1 THEN id END AS id, n FROM part JOIN k ON slug = lower(replace(p_name, ' ', '-')) AND position = p_type")
def name_ids(t):
    """An id by normalised name and position; a name that several ids share in a position has none."""
    slug = F.regexp_replace(F.lower("p_name"), " ", "-")
    lookup = t.part.groupBy(slug.alias("slug"), c("p_type").alias("position")).agg(F.min("p_partkey").alias("id"), F.count("*").alias("n"))
    rows = t.part.select(c("p_partkey").alias("player"), slug.alias("slug"), c("p_type").alias("position"))
    return rows.join(lookup, ["slug", "position"]).select("player", F.when(c("n") == 1, c("id")).alias("id"), "n")


@query("moneyline_and_total_lookup", "WITH m AS (SELECT l_suppkey AS team, avg(l_discount * 6 + 0.2) FILTER (l_linestatus = 'O') AS moneyline, avg(l_quantity) FILTER (l_linestatus = 'F') AS total FROM lineitem WHERE l_suppkey % 3 > 0 GROUP BY 1) SELECT s_suppkey AS team, round(coalesce(moneyline, 0.5) + 1e-7, 4) AS moneyline, round(coalesce(total, 22.5) + 1e-7, 4) AS total FROM supplier LEFT JOIN m ON team = s_suppkey")
def team_markets(t):
    """A team's win chance and total, with the even chance and the league's usual total where no book has them."""
    known = t.lineitem.where("l_suppkey % 3 > 0").groupBy(c("l_suppkey").alias("team")).agg(F.avg(F.when(c("l_linestatus") == "O", c("l_discount") * 6 + 0.2)).alias("moneyline"), F.avg(F.when(c("l_linestatus") == "F", c("l_quantity"))).alias("total"))
    teams = t.supplier.select(c("s_suppkey").alias("team"))
    return teams.join(known, "team", "left").select("team", r(F.coalesce("moneyline", F.lit(0.5))).alias("moneyline"), r(F.coalesce("total", F.lit(22.5))).alias("total"))


# ---- profiles


@query("grouped_mean_profile", """WITH k AS (SELECT l_partkey AS player, l_quantity AS q, l_tax AS x, row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate DESC, l_orderkey, l_linenumber, l_extendedprice) AS rn, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate DESC, l_orderkey, l_linenumber, l_extendedprice) AS tn FROM lineitem WHERE l_shipdate >= TIMESTAMP '1999-06-01' - INTERVAL 300 DAY AND l_shipdate < TIMESTAMP '1999-06-01')
SELECT player, round(avg(q) + 1e-7, 4) AS q, round(avg(x) + 1e-7, 4) AS x, round(avg(q) FILTER (rn <= 5) + 1e-7, 4) AS q_short, round(avg(x) FILTER (rn <= 5) + 1e-7, 4) AS x_short, round(avg(q) FILTER (tn <= 10) + 1e-7, 4) AS q_team FROM k GROUP BY player""")
def mean_profile(t):
    """Means of all statistics over 300 days, over the last five games, and over games that are among the team's last ten."""
    order = [F.desc("l_shipdate"), "l_orderkey", "l_linenumber", "l_extendedprice"]
    end = F.expr("TIMESTAMP_NTZ '1999-06-01'")
    rows = t.lineitem.where((c("l_shipdate") >= end - F.expr("INTERVAL 300 DAY")) & (c("l_shipdate") < end))
    rows = rows.withColumns({"rn": numbered(["l_partkey"], *order), "tn": numbered(["l_suppkey"], *order)})
    means = [r(F.avg(v)).alias(k) for k, v in (("q", c("l_quantity")), ("x", c("l_tax")))]
    short = [r(F.avg(F.when(c("rn") <= 5, v))).alias(k) for k, v in (("q_short", c("l_quantity")), ("x_short", c("l_tax")))]
    return rows.groupBy(c("l_partkey").alias("player")).agg(*means, *short, r(F.avg(F.when(c("tn") <= 10, c("l_quantity")))).alias("q_team"))


@query("slice_300_days", "SELECT l_suppkey AS team, count(*) AS games, sum(l_quantity) AS total FROM lineitem WHERE CAST(l_shipdate AS DATE) >= DATE '1999-06-01' - 300 AND CAST(l_shipdate AS DATE) < DATE '1999-06-01' GROUP BY 1")
def slice_days(t):
    end = F.lit("1999-06-01").cast("date")
    day = c("l_shipdate").cast("date")
    return t.lineitem.where((day >= F.date_sub(end, 300)) & (day < end)).groupBy(c("l_suppkey").alias("team")).agg(F.count("*").alias("games"), F.sum("l_quantity").alias("total"))


@query("position_z_and_allowed", """WITH m AS (SELECT p_type AS position, p_partkey AS player, avg(l_quantity) AS m FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL),
z AS (SELECT position, player, (m - avg(m) OVER (PARTITION BY position)) / nullif(stddev_samp(m) OVER (PARTITION BY position), 0) AS z FROM m),
a AS (SELECT l_suppkey AS opponent, p_type AS position, avg(l_quantity) AS a FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL), l AS (SELECT position, avg(a) AS la FROM a GROUP BY position)
SELECT position, opponent, round(a / la - 1 + 1e-7, 4) + 0.0 AS allowed, round(z + 1e-7, 4) + 0.0 AS z FROM a JOIN l USING (position) JOIN z USING (position) WHERE player % 100 = opponent""")
def position_z(t):
    """A player's level among its position, and what an opponent allows a position against the league."""
    rows = t.lineitem.join(t.part, c("p_partkey") == c("l_partkey")).select(c("p_type").alias("position"), c("p_partkey").alias("player"), c("l_suppkey").alias("opponent"), c("l_quantity").alias("v"))
    level = rows.groupBy("position", "player").agg(F.avg("v").alias("m"))
    league = level.groupBy("position").agg(F.avg("m").alias("lm"), F.stddev_samp("m").alias("ls"))
    z = level.join(F.broadcast(league), "position").select("position", "player", r(ratio(c("m") - c("lm"), c("ls"))).alias("z"))
    allowed = rows.groupBy("opponent", "position").agg(F.avg("v").alias("a"))
    usual = allowed.groupBy("position").agg(F.avg("a").alias("la"))
    allowed = allowed.join(F.broadcast(usual), "position").select("position", "opponent", r(c("a") / c("la") - 1).alias("allowed"))
    return z.withColumn("opponent", c("player") % 100).join(allowed, ["position", "opponent"]).select("position", "opponent", "allowed", "z")


@query("totals_and_lookup", "WITH s AS (SELECT l_suppkey AS team, l_orderkey AS game, sum(l_quantity) AS total FROM lineitem GROUP BY ALL) SELECT team, sum(total) AS total, round(avg(total) + 1e-7, 4) AS game_mean, max(total) FILTER (game % 10 = 3) AS looked_up FROM s GROUP BY team")
def totals(t):
    """Sum by game, then total and mean by team, and the value at a key."""
    game = t.lineitem.groupBy(c("l_suppkey").alias("team"), c("l_orderkey").alias("game")).agg(F.sum("l_quantity").alias("total"))
    return game.groupBy("team").agg(F.sum("total").alias("total"), r(F.avg("total")).alias("game_mean"), F.max(F.when(c("game") % 10 == 3, c("total"))).alias("looked_up"))


@query("json_bucket_pass_rate", """WITH j AS (SELECT event_type AS team, event_id, CASE WHEN event_id % 11 = 0 THEN '{broken' ELSE props END AS body FROM events), v AS (SELECT team, CASE WHEN json_valid(body) THEN coalesce(CAST(json_extract_string(body, '$.k') AS BIGINT), 0) ELSE 0 END AS k, event_id % 2 AS pass FROM j)
SELECT team, round(sum(k) FILTER (pass = 1) / nullif(sum(k), 0) + 1e-7, 4) AS rate, count(*) FILTER (k = 0) AS empty FROM v GROUP BY team""")
def pass_rate(t):
    """Share of one kind in a JSON count; what can't be read counts as nothing."""
    body = F.when(c("event_id") % 11 == 0, "{broken").otherwise(c("props"))
    k = F.coalesce(F.get_json_object(body, "$.k").try_cast("bigint"), F.lit(0).cast("long"))
    rows = t.events.select(c("event_type").alias("team"), k.alias("k"), (c("event_id") % 2 == 1).alias("passing"))
    return rows.groupBy("team").agg(r(ratio(F.sum(F.when(c("passing"), c("k"))), F.sum("k"))).alias("rate"), F.count_if(c("k") == 0).alias("empty"))


@query("coverage_buckets", """WITH b AS (SELECT user_id AS player, unnest(['man', 'zone', 'deep']) AS bucket, unnest([k % 3, k % 5, k % 2]) AS routes, value FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events))
SELECT player, round(sum(routes * value) FILTER (bucket = 'man') / nullif(sum(routes) FILTER (bucket = 'man'), 0) + 1e-7, 4) AS man, round(sum(routes * value) FILTER (bucket = 'zone') / nullif(sum(routes) FILTER (bucket = 'zone'), 0) + 1e-7, 4) AS zone,
round(sum(routes * value) FILTER (bucket = 'deep') / nullif(sum(routes) FILTER (bucket = 'deep'), 0) + 1e-7, 4) AS deep, CAST(sum(routes) AS BIGINT) AS routes FROM b GROUP BY player""")
def coverage(t):
    """Yield per route in each bucket of a nested count, by one recipe for all of them."""
    k = F.from_json("props", "map<string,bigint>")["k"]
    buckets = {"man": k % 3, "zone": k % 5, "deep": k % 2}
    rows = t.events.select(c("user_id").alias("player"), "value", *[v.alias(n) for n, v in buckets.items()])
    return rows.groupBy("player").agg(*[r(ratio(F.sum(c(n) * c("value")), F.sum(n))).alias(n) for n in buckets], F.sum(sum((c(n) for n in buckets), F.lit(0))).alias("routes"))


@query("latest_metadata", "WITH {log} SELECT player, count(*) AS games, arg_max(team, (day, ts, seq)) AS team, round(arg_max(value, (day, ts, seq)) + 1e-7, 4) AS value FROM log GROUP BY player")
def metadata(t):
    newest = F.struct("day", "ts", "seq")
    return t.log.groupBy("player").agg(F.count("*").alias("games"), F.max_by("team", newest).alias("team"), r(F.max_by("value", newest)).alias("value"))


@query("minimum_sample_means", "WITH {log} SELECT player, team, count(*) AS n, round(avg(value) + 1e-7, 4) AS mean FROM log GROUP BY player, team HAVING count(*) >= 3")
def minimum_sample(t):
    return t.log.groupBy("player", "team").agg(F.count("*").alias("n"), r(F.avg("value")).alias("mean")).where("n >= 3")


@query("derived_metrics", """WITH s AS (SELECT l_partkey AS player, sum(l_quantity) AS snaps, count(*) AS games, sum(l_quantity) FILTER (l_returnflag = 'R') AS targets, sum(l_extendedprice) FILTER (l_returnflag = 'R') AS yards, sum(CAST(l_linestatus = 'F' AS INTEGER)) AS scores FROM lineitem GROUP BY 1)
SELECT player, round(coalesce(targets, 0) / nullif(snaps, 0) + 1e-7, 4) AS target_share, round(yards / nullif(targets, 0) + 1e-7, 4) AS yards_per_target, round(scores / games + 1e-7, 4) AS score_rate, round(snaps / games + 1e-7, 4) AS snaps_per_game FROM s""")
def derived(t):
    back = c("l_returnflag") == "R"
    s = t.lineitem.groupBy(c("l_partkey").alias("player")).agg(F.sum("l_quantity").alias("snaps"), F.count("*").alias("games"), F.sum(F.when(back, c("l_quantity"))).alias("targets"), F.sum(F.when(back, c("l_extendedprice"))).alias("yards"), F.count_if(c("l_linestatus") == "F").alias("scores"))
    metrics = {"target_share": ratio(F.coalesce("targets", F.lit(0.0)), c("snaps")), "yards_per_target": ratio(c("yards"), c("targets")), "score_rate": c("scores") / c("games"), "snaps_per_game": c("snaps") / c("games")}
    return s.select("player", *[r(v).alias(k) for k, v in metrics.items()])


@query("season_shares", """SELECT l_suppkey AS team, l_partkey AS player, round(sum(l_quantity) / sum(sum(l_quantity)) OVER (PARTITION BY l_suppkey) + 1e-7, 4) AS share, round(48 * sum(l_quantity) / sum(l_extendedprice) * 1000 + 1e-7, 4) AS per_48, round(sum(l_quantity + 10 * l_discount + 10 * l_tax) + 1e-7, 3) AS combined FROM lineitem GROUP BY 1, 2""")
def shares(t):
    s = t.lineitem.groupBy(c("l_suppkey").alias("team"), c("l_partkey").alias("player")).agg(F.sum("l_quantity").alias("q"), F.sum("l_extendedprice").alias("minutes"), r(F.sum(c("l_quantity") + 10 * c("l_discount") + 10 * c("l_tax")), 3).alias("combined"))
    whole = s.groupBy("team").agg(F.sum("q").alias("whole"))
    return s.join(whole, "team").select("team", "player", r(c("q") / c("whole")).alias("share"), r(48 * c("q") / c("minutes") * 1000).alias("per_48"), "combined")


@query("box_score_rows", """WITH p AS (SELECT l_orderkey AS game, l_suppkey AS team, l_partkey AS player, count(*) AS at_bats, count(*) FILTER (l_linenumber % 4 = 1) AS singles, count(*) FILTER (l_linenumber % 4 = 2) AS homers, count(*) FILTER (l_linenumber % 4 = 3) AS walks, sum(l_quantity) AS pitches FROM lineitem GROUP BY ALL)
SELECT game, team, player, round((singles + homers) / nullif(at_bats - walks, 0) + 1e-7, 4) AS avg, round((singles + homers + walks) / at_bats + 1e-7, 4) AS obp, round((singles + 4 * homers) / nullif(at_bats - walks, 0) + 1e-7, 4) AS slg, round((13 * homers + 3 * walks) / (pitches / 15) + 3.1 + 1e-7, 4) AS fip, round((singles + homers + walks) / (pitches / 15) + 1e-7, 4) AS whip, CAST(sum(at_bats) OVER (PARTITION BY game) AS BIGINT) AS game_at_bats FROM p""")
def box_scores(t):
    """One row a player and game from single plays: counts by kind, rates from them, and the game's total beside."""
    kind = c("l_linenumber") % 4
    counts = {"singles": kind == 1, "homers": kind == 2, "walks": kind == 3}
    p = t.lineitem.groupBy(c("l_orderkey").alias("game"), c("l_suppkey").alias("team"), c("l_partkey").alias("player")).agg(F.count("*").alias("at_bats"), *[F.count_if(v).alias(k) for k, v in counts.items()], (F.sum("l_quantity") / 15).alias("innings"))
    official = (c("at_bats") - c("walks")).cast("double")
    rates = {"avg": ratio(c("singles") + c("homers"), official), "obp": (c("singles") + c("homers") + c("walks")) / c("at_bats"), "slg": ratio(c("singles") + 4 * c("homers"), official), "fip": (13 * c("homers") + 3 * c("walks")) / c("innings") + 3.1, "whip": (c("singles") + c("homers") + c("walks")) / c("innings")}
    return p.select("game", "team", "player", *[r(v).alias(k) for k, v in rates.items()], F.sum("at_bats").over(Window.partitionBy("game")).alias("game_at_bats"))


@query("fill_first_in_group", "SELECT l_orderkey AS okey, l_linenumber AS lnum, l_partkey AS player, l_extendedprice AS price, first_value(CASE WHEN l_linenumber % 2 = 0 THEN l_quantity END IGNORE NULLS) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS total FROM lineitem")
def fill_first(t):
    """Every row of a game gets the game's first known value."""
    known = F.when(c("l_linenumber") % 2 == 0, c("l_quantity"))
    first = t.lineitem.where(known.isNotNull()).groupBy(c("l_orderkey").alias("okey")).agg(F.min_by("l_quantity", F.struct("l_linenumber", "l_partkey", "l_extendedprice")).alias("total"))
    rows = t.lineitem.select(c("l_orderkey").alias("okey"), c("l_linenumber").alias("lnum"), c("l_partkey").alias("player"), c("l_extendedprice").alias("price"))
    return rows.join(first, "okey", "left")


@query("first_known_row_per_key", """WITH o AS (SELECT l_partkey AS player, l_shipdate, l_orderkey, l_linenumber, l_extendedprice, CASE WHEN l_linenumber % 3 = 0 THEN l_tax END AS height, CASE WHEN l_linenumber % 2 = 0 THEN l_discount END AS weight FROM lineitem)
SELECT player, arg_min(height, (l_shipdate, l_orderkey, l_linenumber, l_extendedprice)) FILTER (height IS NOT NULL) AS height, arg_min(weight, (l_shipdate, l_orderkey, l_linenumber, l_extendedprice)) FILTER (weight IS NOT NULL) AS weight FROM o GROUP BY player""")
def first_known(t):
    """Of each column its first known value in order."""
    order = F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_extendedprice")
    first = lambda value, known: F.min_by(value, F.when(known, order))
    return t.lineitem.groupBy(c("l_partkey").alias("player")).agg(first("l_tax", c("l_linenumber") % 3 == 0).alias("height"), first("l_discount", c("l_linenumber") % 2 == 0).alias("weight"))


@query("paired_team_rows", "WITH g AS (SELECT l_orderkey AS game, l_suppkey AS team, sum(l_quantity) AS points FROM lineitem GROUP BY l_orderkey, l_suppkey QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_suppkey) <= 2) SELECT a.game, a.team, b.team AS opponent, a.points, b.points AS allowed FROM g a JOIN g b ON a.game = b.game AND a.team <> b.team")
def paired_rows(t):
    """The two rows of a game become each other's opponents: the other value of a window of two, without a join."""
    game = t.lineitem.groupBy(c("l_orderkey").alias("game"), c("l_suppkey").alias("team")).agg(F.sum("l_quantity").alias("points"))
    both = Window.partitionBy("game").orderBy("team")
    game = game.withColumn("k", F.row_number().over(both)).where("k <= 2")
    other = lambda n: F.coalesce(F.lag(n).over(both), F.lead(n).over(both)).alias
    return game.select("game", "team", other("team")("opponent"), "points", other("points")("allowed")).where("opponent IS NOT NULL")


@query("three_way_market_profile", """WITH g AS (SELECT l_partkey AS player, l_suppkey AS opponent, (l_partkey + l_suppkey) % 50 AS pitcher, l_quantity AS v, l_linenumber % 2 AS home, l_discount AS x FROM lineitem), a AS (SELECT avg(v) AS m FROM g),
k AS (SELECT 'player' AS kind, player AS id, v, home, x FROM g UNION ALL SELECT 'opponent', opponent, v, home, x FROM g UNION ALL SELECT 'pitcher', pitcher, v, home, x FROM g)
SELECT kind, id, count(*) AS n, round(avg(v) / m - 1 + 1e-7, 4) + 0.0 AS level, round(avg(v) FILTER (home = 1) / nullif(avg(v), 0) - 1 + 1e-7, 4) + 0.0 AS home, round(regr_slope(v, x) + 1e-7, 3) + 0.0 AS slope FROM k, a GROUP BY kind, id, m HAVING count(*) > 1 AND avg(CAST(v > 10 AS INTEGER)) >= 0.5""")
def three_way(t):
    """The same profile by player, by opponent and by opposing pitcher, in one pass over exploded keys."""
    rows = t.lineitem.select(c("l_partkey").alias("player"), c("l_suppkey").alias("opponent"), ((c("l_partkey") + c("l_suppkey")) % 50).alias("pitcher"), c("l_quantity").alias("v"), (c("l_linenumber") % 2 == 1).alias("home"), c("l_discount").alias("x"))
    keys = F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), c(k).alias("id")) for k in ("player", "opponent", "pitcher")]))
    found = rows.select(keys, "v", "home", "x").groupBy("kind", "id").agg(F.count("*").alias("n"), F.avg("v").alias("m"), F.avg(F.when(c("home"), c("v"))).alias("at_home"), F.regr_slope("v", "x").alias("slope"), F.avg((c("v") > 10).cast("int")).alias("hits")).where("n > 1 AND hits >= 0.5")
    return found.join(F.broadcast(rows.agg(F.avg("v").alias("league")))).select("kind", "id", "n", r(c("m") / c("league") - 1).alias("level"), r(ratio(c("at_home"), c("m")) - 1).alias("home"), r(c("slope"), 3).alias("slope"))


CURVE = [4.6, 4.5, 4.4, 4.3, 4.2, 4.1, 4.0, 3.9, 3.8]


@query("plate_appearance_projection", """WITH s AS (SELECT l_suppkey AS team, l_partkey AS starter, count(*) AS n FROM lineitem GROUP BY l_suppkey, l_partkey QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY count(*) DESC, l_partkey) = 1),
k AS (SELECT l_partkey, l_quantity, l_extendedprice, row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate DESC, l_orderkey, l_linenumber, l_extendedprice) AS rn FROM lineitem), f AS (SELECT l_partkey AS starter, sum(l_extendedprice) / 2000 / sum(l_quantity) AS factor FROM k WHERE rn <= 5 GROUP BY 1)
SELECT p_partkey AS player, s.starter, round((4.6 - 0.1 * (p_partkey % 9) + CASE WHEN p_partkey % 2 = 0 THEN -0.1 ELSE 0 END) * least(greatest(0.6 * coalesce(factor, 1) + 0.4 * (0.9 + p_size / 250.0), 0.85), 1.15) + 1e-7, 4) AS appearances FROM part JOIN s ON team = p_partkey % 100 LEFT JOIN f USING (starter)""")
def plate_appearances(t):
    """A curve by batting slot, less a little at home, times a clipped blend of the opposing starter's recent ratio and the hitter's own; the starter is the most frequent one."""
    used = t.lineitem.groupBy(c("l_suppkey").alias("team"), c("l_partkey").alias("starter")).agg(F.count("*").alias("n"))
    starter = latest_per_key(used, ["team"], [F.desc("n"), c("starter")]).select("team", "starter")
    last = t.lineitem.withColumn("k", numbered(["l_partkey"], F.desc("l_shipdate"), "l_orderkey", "l_linenumber", "l_extendedprice")).where("k <= 5")
    factor = last.groupBy(c("l_partkey").alias("starter")).agg((F.sum("l_extendedprice") / 2000 / F.sum("l_quantity")).alias("factor"))
    slot = F.element_at(F.array(*map(F.lit, CURVE)), (c("p_partkey") % 9 + 1).cast("int")) - F.when(c("p_partkey") % 2 == 0, 0.1).otherwise(0.0)
    blend = F.least(F.greatest(0.6 * F.coalesce("factor", F.lit(1.0)) + 0.4 * (0.9 + c("p_size") / 250.0), F.lit(0.85)), F.lit(1.15))
    rows = t.part.withColumn("team", c("p_partkey") % 100).join(starter, "team").join(factor, "starter", "left")
    return rows.select(c("p_partkey").alias("player"), "starter", r(slot * blend).alias("appearances"))


@query("combo_market_means", """WITH m AS (SELECT l_partkey AS player, l_suppkey % 3 AS sub, avg(l_quantity) AS ev FROM lineitem WHERE l_linenumber > 2 GROUP BY ALL), f AS (SELECT l_suppkey % 3 AS sub, avg(l_quantity) AS usual FROM lineitem GROUP BY 1),
w(sub, weight) AS (VALUES (0, 1.0), (1, 1.2), (2, 1.5)) SELECT p_partkey AS player, round(sum(weight * coalesce(ev, usual)) + 1e-7, 4) AS ev, CAST(count(ev) AS BIGINT) AS quoted FROM part CROSS JOIN w JOIN f USING (sub) LEFT JOIN m ON m.player = p_partkey AND m.sub = w.sub GROUP BY 1""")
def combo_means(t):
    """A derived market's mean from its parts' weighted means; a part without a quote takes the league's usual one."""
    weights = {0: 1.0, 1: 1.2, 2: 1.5}
    sub = (c("l_suppkey") % 3).cast("int")
    usual = t.lineitem.agg(*[F.avg(F.when(sub == k, c("l_quantity"))).alias(f"u{k}") for k in weights])
    quoted = t.lineitem.where("l_linenumber > 2").groupBy(c("l_partkey").alias("p_partkey")).agg(*[F.avg(F.when(sub == k, c("l_quantity"))).alias(f"e{k}") for k in weights])
    rows = t.part.select("p_partkey").join(quoted, "p_partkey", "left").join(F.broadcast(usual))
    return rows.select(c("p_partkey").alias("player"), r(sum((w * F.coalesce(f"e{k}", f"u{k}") for k, w in weights.items()), F.lit(0.0))).alias("ev"), sum((c(f"e{k}").isNotNull().cast("long") for k in weights), F.lit(0)).cast("long").alias("quoted"))


@query("comp_opponent_z", f"""WITH {_COMPS}, g AS (SELECT l_partkey AS comp, l_suppkey AS opponent, l_quantity AS v FROM lineitem), s AS (SELECT comp, avg(v) AS m, stddev_samp(v) AS sd FROM g GROUP BY comp),
z AS (SELECT player, avg((v - m) / nullif(sd, 0)) AS z, count(*) AS n FROM pairs JOIN g USING (comp) JOIN s USING (comp) WHERE opponent = player % 100 GROUP BY player),
p AS (SELECT l_partkey AS player, avg(l_quantity) AS m, avg(l_quantity) FILTER (l_suppkey % 10 = l_partkey % 10) AS against FROM lineitem GROUP BY 1)
SELECT player, n, round(z + 1e-7, 4) + 0.0 AS z, round(against / nullif(m, 0) - 1 + 1e-7, 4) + 0.0 AS against FROM z JOIN p USING (player)""")
def comp_opponent_z(t):
    """How far comps were from their own level against this opponent, and the player's level against comparable pitchers over its own."""
    games = t.lineitem.select(c("l_partkey").alias("comp"), c("l_suppkey").alias("opponent"), c("l_quantity").alias("v"))
    own = games.groupBy("comp").agg(F.avg("v").alias("m"), F.stddev_samp("v").alias("sd"))
    met = comp_pairs(t).withColumn("opponent", c("player") % 100).join(games, ["comp", "opponent"]).join(own, "comp")
    z = met.groupBy("player").agg(F.count("*").alias("n"), r(F.avg(ratio(c("v") - c("m"), c("sd")))).alias("z"))
    level = games.groupBy(c("comp").alias("player")).agg(F.avg("v").alias("m"), F.avg(F.when(c("opponent") % 10 == c("comp") % 10, c("v"))).alias("a"))
    return z.join(level, "player").select("player", "n", "z", r(ratio(c("a"), c("m")) - 1).alias("against"))


@query("comp_pool_usage_filter", """WITH u AS (SELECT p_type AS position, p_partkey AS player, sum(l_quantity) AS usage FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL), q AS (SELECT position, quantile_cont(usage, 0.4) AS floor FROM u GROUP BY position) SELECT position, player, usage FROM u JOIN q USING (position) WHERE usage >= floor - 1e-9""")
def usage_pool(t):
    usage = t.lineitem.join(t.part, c("p_partkey") == c("l_partkey")).groupBy(c("p_type").alias("position"), c("p_partkey").alias("player")).agg(F.sum("l_quantity").alias("usage"))
    floors = usage.groupBy("position").agg(F.percentile("usage", F.lit(0.4)).alias("floor"))
    return usage.join(F.broadcast(floors), "position").where("usage >= floor - 1e-9").select("position", "player", "usage")


@query("log_trimming", """WITH d AS (SELECT CAST(l_shipdate AS DATE) AS day, l_returnflag AS league, count(*) AS n FROM lineitem GROUP BY ALL), b AS (SELECT league, day, coalesce(sum(n) OVER (PARTITION BY league ORDER BY day DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS newer FROM d),
f AS (SELECT league, min(day) - 365 AS since FROM b WHERE newer < 900 GROUP BY league), q AS (SELECT l_returnflag AS league, quantile_cont(l_quantity, 0.15) AS floor FROM lineitem GROUP BY 1)
SELECT l_returnflag AS league, count(*) AS kept, min(l_quantity) AS least FROM lineitem JOIN f ON f.league = l_returnflag JOIN q ON q.league = l_returnflag WHERE CAST(l_shipdate AS DATE) >= since AND l_quantity >= floor - 1e-9 GROUP BY 1""")
def trimming(t):
    """Each league keeps its newest days until there are rows enough, and a year before them, without the least used rows. Rows are counted by day before they are ordered."""
    rows = t.lineitem.select(c("l_returnflag").alias("league"), c("l_shipdate").cast("date").alias("day"), "l_quantity")
    days = rows.groupBy("league", "day").agg(F.count("*").alias("n"))
    newer = F.coalesce(F.sum("n").over(Window.partitionBy("league").orderBy(F.desc("day")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    since = days.withColumn("newer", newer).where("newer < 900").groupBy("league").agg(F.date_sub(F.min("day"), 365).alias("since"))
    floors = rows.groupBy("league").agg(F.percentile("l_quantity", F.lit(0.15)).alias("floor"))
    kept = rows.join(F.broadcast(since), "league").join(F.broadcast(floors), "league").where("day >= since AND l_quantity >= floor - 1e-9")
    return kept.groupBy("league").agg(F.count("*").alias("kept"), F.min("l_quantity").alias("least"))


# ---- feature rows and training matrices

FEATURE_WINDOWS = {"mean_3": 3, "mean_10": 10}


def as_of_features(games: DataFrame, player: str, day: str, value: str, opponent: str) -> DataFrame:
    """Features of each game row out of earlier days alone, for all days at once.

    Frames end at the day before, so that no row sees its own day: level over the last 3 and 10 days of play and over the career shrunk to what the league had by then, days off,
    and what the opponent has allowed so far. Rows are exchanged once by opponent and once by player, and joined with nothing but the league's days, which are broadcast.
    """
    known = games.where(c(day).isNotNull()).withColumn("_t", F.datediff(c(day), F.lit("1970-01-01").cast("date")))
    league = known.groupBy(day).agg(F.sum(value).alias("ls"), F.count("*").alias("ln"))
    so_far = Window.orderBy(day).rowsBetween(Window.unboundedPreceding, -1)  # one row a day
    league = league.select(day, (F.sum("ls").over(so_far) / F.sum("ln").over(so_far)).alias("league"))
    faced = Window.partitionBy(opponent).orderBy("_t").rangeBetween(Window.unboundedPreceding, -1)
    rows = known.withColumn("allowed", F.sum(value).over(faced) / F.nullif(F.count(F.lit(1)).over(faced), F.lit(0)))
    past = Window.partitionBy(player).orderBy("_t")
    before = past.rangeBetween(Window.unboundedPreceding, -1)
    rows = rows.where(c(player).isNotNull()).withColumns({"_total": F.coalesce(F.sum(value).over(before), F.lit(0.0)), "games": F.count(F.lit(1)).over(before), "days_off": c("_t") - F.max("_t").over(before), "_place": F.dense_rank().over(past)})
    last = lambda k: Window.partitionBy(player).orderBy("_place").rangeBetween(-k, -1)
    rows = rows.withColumns({name: F.sum(value).over(last(k)) / F.nullif(F.count(F.lit(1)).over(last(k)), F.lit(0)) for name, k in FEATURE_WINDOWS.items()})
    rows = rows.where(c(opponent).isNotNull()).join(F.broadcast(league), day)
    return rows.withColumns({"shrunk": (c("_total") + 10 * c("league")) / (c("games") + 10), "allowed": c("allowed") / c("league") - 1}).drop("_t", "_total", "_place")


_FEATURES = """g AS (SELECT l_orderkey AS okey, l_linenumber AS lnum, l_extendedprice AS price, l_partkey AS player, l_suppkey AS opponent, CAST(l_shipdate AS DATE) AS day, l_quantity AS v, l_discount AS x FROM lineitem),
d AS (SELECT player, day, sum(v) AS s, count(*) AS n FROM g GROUP BY ALL), l AS (SELECT day, sum(sum(v)) OVER w / sum(count(*)) OVER w AS league FROM g GROUP BY day WINDOW w AS (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT player, day, sum(s) OVER (PARTITION BY player ORDER BY day ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) / sum(n) OVER (PARTITION BY player ORDER BY day ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS mean_3, sum(s) OVER (PARTITION BY player ORDER BY day ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) / sum(n) OVER (PARTITION BY player ORDER BY day ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS mean_10,
coalesce(sum(n) OVER (PARTITION BY player ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS games, coalesce(sum(s) OVER (PARTITION BY player ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS total, date_diff('day', lag(day) OVER (PARTITION BY player ORDER BY day), day) AS days_off FROM d),
a AS (SELECT opponent, day, sum(sum(v)) OVER w / sum(count(*)) OVER w AS allowed FROM g GROUP BY opponent, day WINDOW w AS (PARTITION BY opponent ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
m AS (SELECT okey, lnum, price, player, opponent, day, v, x, mean_3, mean_10, games, days_off, league, (total + 10 * league) / (games + 10) AS shrunk, allowed / league - 1 AS allowed FROM g JOIN f USING (player, day) JOIN l USING (day) JOIN a USING (opponent, day))"""


def _games(t) -> DataFrame:
    return t.lineitem.select(c("l_orderkey").alias("okey"), c("l_linenumber").alias("lnum"), c("l_extendedprice").alias("price"), c("l_partkey").alias("player"), c("l_suppkey").alias("opponent"), c("l_shipdate").cast("date").alias("day"), c("l_quantity").alias("v"), c("l_discount").alias("x"))


@query("feature_rows", f"WITH {_FEATURES} SELECT okey, lnum, price, player, CAST(games AS BIGINT) AS games, CAST(days_off AS BIGINT) AS days_off, round(mean_3 + 1e-7, 4) AS mean_3, round(mean_10 + 1e-7, 4) AS mean_10, round(shrunk + 1e-7, 4) AS shrunk, round(allowed + 1e-7, 4) + 0.0 AS allowed FROM m")
def feature_rows(t):
    rows = as_of_features(_games(t), "player", "day", "v", "opponent")
    return rows.select("okey", "lnum", "price", "player", c("games").cast("long").alias("games"), c("days_off").cast("long").alias("days_off"), *rounded("mean_3", "mean_10", "shrunk", "allowed"))


@query("training_matrix", f"""WITH {_FEATURES}, q AS (SELECT quantile_cont(v, 0.15) AS floor FROM g)
SELECT okey, lnum, price, player, CAST(day AS VARCHAR) AS day, v AS result, coalesce(round(mean_3 + 1e-7, 4), 0) AS mean_3, coalesce(round(mean_10 + 1e-7, 4), 0) AS mean_10, coalesce(round(shrunk + 1e-7, 4), 0) AS shrunk, coalesce(round(allowed + 1e-7, 4), 0) + 0.0 AS allowed, CASE WHEN x > 0 THEN 'archive' END AS source FROM m, q WHERE v > floor + 1e-9 OR x > 0.05""")
def training_matrix(t):
    """Feature rows with their results: of rows used more than the 15th percentile, or archived. Missing features are filled with nothing; provenance is never filled."""
    games = _games(t)
    floor = games.agg(F.percentile("v", F.lit(0.15)).alias("floor"))
    rows = as_of_features(games, "player", "day", "v", "opponent").join(F.broadcast(floor)).where("v > floor + 1e-9 OR x > 0.05")
    features = [F.coalesce(r(c(n)), F.lit(0.0)).alias(n) for n in ("mean_3", "mean_10", "shrunk", "allowed")]
    return rows.select("okey", "lnum", "price", "player", c("day").cast("string").alias("day"), c("v").alias("result"), *features, F.when(c("x") > 0, "archive").alias("source"))


@query("volume_model_join", "WITH p AS (SELECT l_partkey AS player, avg(l_quantity) AS loc, stddev_samp(l_quantity) AS scale FROM lineitem WHERE l_linestatus = 'F' AND l_partkey % 4 > 0 GROUP BY 1) SELECT p_partkey AS player, round(coalesce(loc, 25) + 1e-7, 4) AS proj_volume, round(coalesce(scale, 0) + 1e-7, 4) AS proj_scale, loc IS NOT NULL AS modelled FROM part LEFT JOIN p ON player = p_partkey WHERE p_type <> 'SMALL'")
def volume_join(t):
    """Location and scale that another market's model predicts, beside each player of a position that has that market."""
    predicted = t.lineitem.where("l_linestatus = 'F' AND l_partkey % 4 > 0").groupBy(c("l_partkey").alias("p_partkey")).agg(F.avg("l_quantity").alias("loc"), F.stddev_samp("l_quantity").alias("scale"))
    rows = t.part.where("p_type <> 'SMALL'").join(predicted, "p_partkey", "left")
    return rows.select(c("p_partkey").alias("player"), r(F.coalesce("loc", F.lit(25.0))).alias("proj_volume"), r(F.coalesce("scale", F.lit(0.0))).alias("proj_scale"), c("loc").isNotNull().alias("modelled"))


@query("incremental_matrix_load", """WITH cached AS (SELECT l_partkey AS player, CAST(l_shipdate AS DATE) AS day, max(l_quantity) AS v FROM lineitem WHERE l_shipdate < TIMESTAMP '1999-01-01' GROUP BY ALL), edge AS (SELECT max(day) AS last FROM cached),
fresh AS (SELECT l_partkey AS player, CAST(l_shipdate AS DATE) AS day, min(l_quantity) AS v FROM lineitem, edge WHERE CAST(l_shipdate AS DATE) >= last GROUP BY ALL),
u AS (SELECT *, 0 AS k FROM cached UNION ALL SELECT *, 1 FROM fresh) SELECT player, CAST(day AS VARCHAR) AS day, v, CASE k WHEN 0 THEN 'cached' ELSE 'new' END AS origin FROM u QUALIFY row_number() OVER (PARTITION BY player, day ORDER BY k DESC) = 1""")
def incremental(t):
    """Cached rows up to their last day and new rows from it on; of a (player, day) in both, the new row."""
    rows = t.lineitem.select(c("l_partkey").alias("player"), c("l_shipdate").cast("date").alias("day"), "l_quantity")
    cached = rows.where("day < DATE '1999-01-01'").groupBy("player", "day").agg(F.max("l_quantity").alias("v")).withColumn("origin", F.lit("cached"))
    last = cached.agg(F.max("day").alias("last"))
    fresh = rows.join(F.broadcast(last)).where("day >= last").groupBy("player", "day").agg(F.min("l_quantity").alias("v")).withColumn("origin", F.lit("new"))
    merged = cached.unionByName(fresh).groupBy("player", "day").agg(F.max(F.struct("origin", "v")).alias("m"))  # 'new' sorts after 'cached'
    return merged.select("player", c("day").cast("string").alias("day"), "m.v", "m.origin")


@query("odds_synthesis", """WITH m AS (SELECT l_orderkey AS okey, l_linenumber AS lnum, l_partkey AS player, l_extendedprice AS price, l_quantity AS v, CASE WHEN l_linenumber % 3 = 0 THEN l_discount * 6 + 0.2 END AS odds, CASE WHEN l_linenumber % 2 = 0 THEN l_extendedprice / 1000 END AS ev FROM lineitem),
s AS (SELECT min(gap) AS step FROM (SELECT lead(v) OVER (ORDER BY v) - v AS gap FROM (SELECT DISTINCT v FROM m)))
SELECT okey, lnum, player, price, round(coalesce(odds, exp(-v / ev), 0.5) + 1e-7, 4) AS odds, CASE WHEN odds IS NOT NULL THEN 'quoted' WHEN ev IS NOT NULL THEN 'from mean' ELSE 'even' END AS origin, step FROM m, s""")
def synthesis(t):
    """Missing chances come from the mean, else are even, and say so; beside them the lattice on which results lie."""
    rows = t.lineitem.select(c("l_orderkey").alias("okey"), c("l_linenumber").alias("lnum"), c("l_partkey").alias("player"), c("l_extendedprice").alias("price"), c("l_quantity").alias("v"), F.when(c("l_linenumber") % 3 == 0, c("l_discount") * 6 + 0.2).alias("odds"), F.when(c("l_linenumber") % 2 == 0, c("l_extendedprice") / 1000).alias("ev"))
    values = rows.select("v").distinct()  # a lattice has few values
    step = values.withColumn("gap", F.lead("v").over(Window.orderBy("v")) - c("v")).agg(F.min("gap").alias("step"))
    origin = F.when(c("odds").isNotNull(), "quoted").when(c("ev").isNotNull(), "from mean").otherwise("even")
    return rows.join(F.broadcast(step)).select("okey", "lnum", "player", "price", r(F.coalesce("odds", F.exp(-c("v") / c("ev")), F.lit(0.5))).alias("odds"), origin.alias("origin"), "step")


@query("dispersion_by_player", """WITH p AS (SELECT l_partkey AS player, count(*) AS n, avg(l_quantity) AS m, stddev_samp(l_quantity) AS sd, avg(CAST(l_quantity < 2 AS INTEGER)) AS zero FROM lineitem GROUP BY 1 HAVING count(*) > 1 AND stddev_samp(l_quantity) > 0)
SELECT round(sum(sd / m * n) / sum(n) + 1e-7, 4) AS cv, round(quantile_cont(least(m * m / greatest(sd * sd - m, 0.01), 1000), 0.5) + 1e-7, 3) AS nb_size, round(sum(zero * n) / sum(n) + 1e-7, 4) AS zero_share, CAST(sum(n) AS BIGINT) AS rows FROM p""")
def dispersion(t):
    """Share of zeros, coefficient of variation weighted by games, and the middle of players' negative binomial sizes."""
    p = t.lineitem.groupBy("l_partkey").agg(F.count("*").alias("n"), F.avg("l_quantity").alias("m"), F.stddev_samp("l_quantity").alias("sd"), F.avg((c("l_quantity") < 2).cast("int")).alias("zero")).where("n > 1 AND sd > 0")
    size = F.least(c("m") * c("m") / F.greatest(c("sd") * c("sd") - c("m"), F.lit(0.01)), F.lit(1000.0))
    return p.agg(r(F.sum(c("sd") / c("m") * c("n")) / F.sum("n")).alias("cv"), r(F.percentile(size, F.lit(0.5)), 3).alias("nb_size"), r(F.sum(c("zero") * c("n")) / F.sum("n")).alias("zero_share"), F.sum("n").alias("rows"))
