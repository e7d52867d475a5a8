"""Merges, sweeps, upserts, set operations, joins and audits."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from sabermill.functions.odds import stable_round as r
from sabermill.operators import aggregates as agg
from sabermill.operators.asof import latest_per_key
from sabermill.plans.base import query
from sabermill.sources.tables import retain, upsert


@query("merge_archives", """WITH {quotes}, a AS (SELECT entity, book, observed_at, ev, NULL::DOUBLE AS under_prob FROM quotes WHERE okey % 3 <> 0), b AS (SELECT entity, book, observed_at, ev, under_prob FROM quotes WHERE okey % 3 <> 1)
SELECT entity, book, observed_at, ev, max(under_prob) AS under_prob FROM (SELECT * FROM a UNION SELECT * FROM b) GROUP BY ALL""")
def merge(t):
    a = t.quotes.where("okey % 3 <> 0").select("entity", "book", "observed_at", "ev")
    b = t.quotes.where("okey % 3 <> 1").select("entity", "book", "observed_at", "ev", "under_prob")
    return a.unionByName(b, allowMissingColumns=True).groupBy("entity", "book", "observed_at", "ev").agg(F.max("under_prob").alias("under_prob"))


@query("runaway_sweep", """WITH {quotes}, m AS (SELECT entity, max(line) AS top FROM quotes WHERE line > 0 GROUP BY entity)
SELECT okey, lnum, entity, book, CASE WHEN under_prob > 0.02 THEN 'null-ev' ELSE 'delete' END AS action, count(*) AS n FROM quotes LEFT JOIN m USING (entity) WHERE ev / 100 > 2000 OR ev / 100 > 12 * top GROUP BY ALL""")
def sweep(t):
    top = t.quotes.where("line > 0").groupBy("entity").agg(F.max("line").alias("top"))
    bad = t.quotes.join(top, "entity", "left").where("ev / 100 > 2000 OR ev / 100 > 12 * top")
    return bad.groupBy("okey", "lnum", "entity", "book", F.when(F.col("under_prob") > 0.02, "null-ev").otherwise("delete").alias("action")).agg(F.count("*").alias("n"))


@query("corrupt_seed_detection", """WITH {quotes} SELECT okey, lnum, entity, book FROM quotes q WHERE EXISTS (SELECT 1 FROM quotes s WHERE s.entity = q.entity GROUP BY s.entity HAVING count(DISTINCT s.book) >= 12 AND stddev_pop(s.line) < 14)""")
def corrupt(t):
    groups = t.quotes.groupBy("entity").agg(F.countDistinct("book").alias("books"), agg.deviation_below("line", 14).alias("even")).where("books >= 12 AND even")
    return t.quotes.join(groups, "entity", "left_semi").select("okey", "lnum", "entity", "book")


@query("retention_delete", "WITH e AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, CASE o_orderkey % 4 WHEN 0 THEN 'P' || o_custkey || ' + P' || (o_custkey + 1) WHEN 1 THEN 'P' || o_custkey || ' vs. P' || (o_custkey + 1) ELSE 'P' || o_custkey END AS entity FROM orders) SELECT o_orderkey, entity FROM e WHERE day >= DATE '1996-01-01' AND NOT contains(entity, ' + ') AND NOT contains(entity, ' vs. ')")
def retention(t):
    """Old days go, and so do combined and head-to-head entities, which are no players of their own."""
    p, q = F.concat(F.lit("P"), "o_custkey"), F.concat(F.lit("P"), (F.col("o_custkey") + 1).cast("string"))
    kind = F.col("o_orderkey") % 4
    entity = F.when(kind == 0, F.concat(p, F.lit(" + "), q)).when(kind == 1, F.concat(p, F.lit(" vs. "), q)).otherwise(p)
    rows = t.orders.select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"), entity.alias("entity"))
    return retain(rows, "day", F.lit("1996-01-01").cast("date"), "entity").select("o_orderkey", "entity")


@query("column_backfill", "SELECT event_id, CAST(coalesce(CASE WHEN event_id % 3 = 0 THEN ts END, CAST(CAST(ts AS DATE) AS TIMESTAMP)) AS VARCHAR) AS observed_at FROM events WHERE date_part('microsecond', ts) % 1000000 = 0 OR event_id % 3 <> 0")
def backfill(t):
    kept = t.events.where("extract(SECOND FROM ts) = floor(extract(SECOND FROM ts)) OR event_id % 3 <> 0")
    at = F.coalesce(F.when(F.col("event_id") % 3 == 0, F.col("ts")), F.col("ts").cast("date").cast("timestamp_ntz"))
    return kept.select("event_id", F.date_format(at, "yyyy-MM-dd HH:mm:ss").alias("observed_at"))


@query("keyed_upsert", "SELECT c_custkey, c_acctbal, 'old' AS origin FROM customer WHERE c_custkey % 10 <> 3 UNION ALL SELECT c_custkey, c_acctbal + 1, 'new' FROM customer WHERE c_custkey % 10 = 3")
def keyed(t):
    base = t.customer.select("c_custkey", "c_acctbal", F.lit("old").alias("origin"))
    return upsert(base, t.customer.where("c_custkey % 10 = 3").select("c_custkey", (F.col("c_acctbal") + 1).alias("c_acctbal"), F.lit("new").alias("origin")), ["c_custkey"])


@query("history_upsert", """WITH {history} SELECT player, league, market, platform, CAST(count(*) AS BIGINT) AS n FROM (SELECT *, row_number() OVER (PARTITION BY player, league, market, platform ORDER BY hit DESC, day DESC, okey DESC, lnum DESC, line DESC, actual DESC) AS rn FROM history) WHERE rn = 1 AND hit GROUP BY ALL""")
def history_upsert(t):
    kept = latest_per_key(t.history, ["player", "league", "market", "platform"], [F.desc("hit"), F.desc("day"), F.desc("okey"), F.desc("lnum"), F.desc("line"), F.desc("actual")])
    return kept.where("hit").groupBy("player", "league", "market", "platform").agg(F.count("*").alias("n"))


@query("matrix_audit", "SELECT count(*) AS n_rows, count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS duplicates, count(*) FILTER (l_quantity <> floor(l_quantity)) AS off_lattice, count(*) FILTER (l_discount IS NULL OR l_tax IS NULL) AS incomplete, count(DISTINCT l_returnflag) AS codes FROM lineitem")
def audit(t):
    return t.lineitem.agg(F.count("*").alias("n_rows"), (F.count("*") - F.countDistinct("l_orderkey", "l_linenumber")).alias("duplicates"), F.count_if(F.col("l_quantity") != F.floor("l_quantity")).alias("off_lattice"), F.count_if(F.col("l_discount").isNull() | F.col("l_tax").isNull()).alias("incomplete"), F.countDistinct("l_returnflag").alias("codes"))


@query("close_freshness", "SELECT l_suppkey, count(*) AS late, max(CAST(date_diff('second', o_orderdate, l_shipdate) / 86400.0 AS DOUBLE)) AS worst FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE date_diff('second', o_orderdate, l_shipdate) > 90 * 86400 GROUP BY 1")
def freshness(t):
    lag = F.unix_timestamp(F.col("l_shipdate").cast("timestamp")) - F.unix_timestamp(F.col("o_orderdate").cast("timestamp"))
    rows = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).withColumn("lag", lag).where("lag > 90 * 86400")
    return rows.groupBy("l_suppkey").agg(F.count("*").alias("late"), (F.max("lag") / 86400.0).cast("double").alias("worst"))


@query("set_union_intersect_except", """SELECT 'union' AS op, count(*) AS n FROM (SELECT l_partkey FROM lineitem WHERE l_tax > 0.05 UNION SELECT p_partkey FROM part WHERE p_size < 10) UNION ALL SELECT 'intersect', count(*) FROM (SELECT l_partkey FROM lineitem WHERE l_tax > 0.05 INTERSECT SELECT p_partkey FROM part WHERE p_size < 10)
UNION ALL SELECT 'except', count(*) FROM (SELECT p_partkey FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_tax > 0.05) UNION ALL SELECT 'all', count(*) FROM (SELECT l_partkey FROM lineitem UNION ALL SELECT p_partkey FROM part)""")
def sets(t):
    a, b = t.lineitem.where("l_tax > 0.05").select("l_partkey"), t.part.where("p_size < 10").select("p_partkey")
    parts = {"union": a.union(b).distinct(), "intersect": a.intersect(b), "except": t.part.select("p_partkey").subtract(a), "all": t.lineitem.select("l_partkey").union(t.part.select("p_partkey"))}
    out = None
    for op, df in parts.items():
        row = df.agg(F.count("*").alias("n")).select(F.lit(op).alias("op"), "n")
        out = row if out is None else out.union(row)
    return out


@query("dedup_keep_fullest", """SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY CAST(l_tax > 0 AS INTEGER) + CAST(l_discount > 0 AS INTEGER) DESC, l_extendedprice DESC, l_partkey DESC) AS rn FROM lineitem) WHERE rn = 1""")
def fullest(t):
    full = (F.col("l_tax") > 0).cast("int") + (F.col("l_discount") > 0).cast("int")
    return latest_per_key(t.lineitem, ["l_orderkey", "l_linenumber"], [full.desc(), F.desc("l_extendedprice"), F.desc("l_partkey")]).select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")


@query("outer_merge_coalesce", """WITH a AS (SELECT o_custkey AS k, max(o_totalprice) AS x FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), b AS (SELECT o_custkey AS k, max(o_totalprice) AS x, min(o_totalprice) AS y FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) SELECT coalesce(a.k, b.k) AS k, coalesce(a.x, b.x) AS x, y FROM a FULL JOIN b ON a.k = b.k""")
def outer(t):
    a = t.orders.where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_totalprice").alias("x"))
    b = t.orders.where("o_orderstatus = 'O'").groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_totalprice").alias("x2"), F.min("o_totalprice").alias("y"))
    return a.join(b, "k", "full_outer").select("k", F.coalesce("x", "x2").alias("x"), "y")


@query("semi_anti_membership", "SELECT 'semi' AS kind, count(*) AS n FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000) UNION ALL SELECT 'anti', count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
def semi(t):
    big = t.orders.where("o_totalprice > 200000")
    on = F.col("c_custkey") == F.col("o_custkey")
    row = lambda how: t.customer.join(big, on, f"left_{how}").agg(F.count("*").alias("n")).select(F.lit(how).alias("kind"), "n")
    return row("semi").union(row("anti"))


@query("pairs_within_game", "WITH l AS (SELECT l_orderkey AS game, l_linenumber AS idx, max(l_partkey) AS leg, max(l_returnflag) AS side FROM lineitem GROUP BY ALL) SELECT a.game, a.idx AS i, b.idx AS j, a.leg AS leg_i, b.leg AS leg_j, CASE WHEN a.side = b.side THEN 1 ELSE -1 END AS sign FROM l a JOIN l b ON a.game = b.game AND a.idx < b.idx")
def pairs(t):
    legs = t.lineitem.groupBy(F.col("l_orderkey").alias("game"), F.col("l_linenumber").alias("idx")).agg(F.max("l_partkey").alias("leg"), F.max("l_returnflag").alias("side"))
    a, b = legs.alias("a"), legs.alias("b")
    j = a.join(b, (F.col("a.game") == F.col("b.game")) & (F.col("a.idx") < F.col("b.idx")))
    return j.select("a.game", F.col("a.idx").alias("i"), F.col("b.idx").alias("j"), F.col("a.leg").alias("leg_i"), F.col("b.leg").alias("leg_j"), F.when(F.col("a.side") == F.col("b.side"), 1).otherwise(-1).alias("sign"))


@query("spearman_pairs", """WITH {log}, x AS (SELECT player, day, team, avg(value) AS v FROM log GROUP BY ALL), k AS (SELECT player, day, team, rank() OVER (PARTITION BY team ORDER BY round(v + 1e-7, 4)) + (count(*) OVER (PARTITION BY team, round(v + 1e-7, 4)) - 1) / 2.0 AS r FROM x)
SELECT a.team AS col_a, b.team AS col_b, round(corr(a.r, b.r) + 1e-7, 4) AS rho, round(2 * sin(pi() * corr(a.r, b.r) / 6) * least(count(*) / 30.0, 1) + 1e-7, 4) AS shrunk, count(*) AS n FROM k a JOIN k b ON a.player = b.player AND a.day = b.day AND a.team < b.team GROUP BY ALL HAVING count(*) >= 10""")
def spearman(t):
    from sabermill.operators.windows import average_rank

    x = t.log.groupBy("player", "day", "team").agg(r(F.avg("value")).alias("v")).withColumn("row", F.struct("player", "day"))
    out = agg.spearman_pairs(average_rank(x, ["team"], "v"), "row", "team", "rank", 10)
    return out.select("col_a", "col_b", r(F.col("rho")).alias("rho"), r(2 * F.sin(F.pi() * F.col("rho") / 6) * F.least(F.col("n") / 30.0, F.lit(1.0))).alias("shrunk"), "n")


@query("knn_comps", """WITH v AS (SELECT vec_id, label, embedding FROM embeddings), p AS (SELECT a.vec_id AS player, b.vec_id AS comp, round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS dist FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id)
SELECT player, comp, dist, round(1 / (1 + dist) + 1e-7, 4) AS weight FROM p QUALIFY row_number() OVER (PARTITION BY player ORDER BY dist, comp) <= 5""")
def knn(t):
    from sabermill.operators.neighbors import comps

    return comps(t.embeddings, "vec_id", "label", "embedding", 5).select("player", "comp", "dist", r(1 / (1 + F.col("dist"))).alias("weight"))


@query("schedule_unpivot", "SELECT o_orderkey AS game, o_custkey AS team, true AS home FROM orders UNION ALL SELECT o_orderkey, o_custkey + 1, false FROM orders")
def unpivot(t):
    both = F.array(F.struct(F.col("o_custkey").alias("team"), F.lit(True).alias("home")), F.struct((F.col("o_custkey") + 1).alias("team"), F.lit(False).alias("home")))
    return t.orders.select(F.col("o_orderkey").alias("game"), F.explode(both).alias("x")).select("game", "x.team", "x.home")


@query("next_game_per_team", "SELECT o_custkey AS team, o_orderkey AS game FROM orders WHERE o_orderdate > TIMESTAMP '1996-06-01' QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1")
def next_game(t):
    later = t.orders.where("o_orderdate > timestamp_ntz'1996-06-01'")
    return latest_per_key(later, ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")]).select(F.col("o_custkey").alias("team"), F.col("o_orderkey").alias("game"))


@query("conditional_aggregates", "SELECT user_id AS team, event_type, round(avg(value) FILTER (event_id % 2 = 0) + 1e-7, 4) AS even_mean, round(avg(CAST(value > 50 AS INTEGER)) + 1e-7, 4) AS share, max_by(value, event_id) AS last_value FROM events GROUP BY ALL")
def conditional(t):
    return t.events.groupBy(F.col("user_id").alias("team"), "event_type").agg(r(F.avg(F.when(F.col("event_id") % 2 == 0, F.col("value")))).alias("even_mean"), r(F.avg((F.col("value") > 50).cast("int"))).alias("share"), F.max_by("value", "event_id").alias("last_value"))


@query("fantasy_scores", "SELECT l_orderkey, round(sum(3 * l_quantity - 2 * l_tax * 100 + 0.5 * l_discount * 100) + 1e-7, 4) AS points FROM lineitem GROUP BY 1")
def fantasy(t):
    weights = {"l_quantity": 3.0, "l_tax": -200.0, "l_discount": 50.0}
    total = sum((F.col(c) * x for c, x in weights.items()), F.lit(0.0))
    return t.lineitem.groupBy("l_orderkey").agg(r(F.sum(total)).alias("points"))


@query("feature_columns", "SELECT count(l_quantity) > 0 AND count(DISTINCT l_quantity) > 1 AS quantity, count(DISTINCT l_linestatus) > 1 AS status, sum(CAST(l_discount <> l_tax AS INTEGER)) = 0 AS discount_is_tax FROM lineitem")
def feature_columns(t):
    return t.lineitem.agg(((F.count("l_quantity") > 0) & (F.countDistinct("l_quantity") > 1)).alias("quantity"), (F.countDistinct("l_linestatus") > 1).alias("status"), (F.sum((F.col("l_discount") != F.col("l_tax")).cast("int")) == 0).alias("discount_is_tax"))


@query("volume_budget_rescale", """WITH u AS (SELECT event_type AS team, user_id AS player, avg(value) AS v, coalesce(var_samp(value), 0) AS s FROM events GROUP BY ALL)
SELECT team, player, round(v * least(greatest((v + (240 - sum(v) OVER (PARTITION BY team)) * s / sum(s) OVER (PARTITION BY team)) / v, 0.5), 1.5) + 1e-7, 3) AS scaled FROM u""")
def budget(t):
    u = t.events.groupBy(F.col("event_type").alias("team"), F.col("user_id").alias("player")).agg(F.avg("value").alias("v"), F.coalesce(F.var_samp("value"), F.lit(0.0)).alias("s"))
    w = Window.partitionBy("team")
    ratio = (F.col("v") + (240 - F.sum("v").over(w)) * F.col("s") / F.sum("s").over(w)) / F.col("v")
    return u.select("team", "player", r(F.col("v") * F.least(F.greatest(ratio, F.lit(0.5)), F.lit(1.5)), 3).alias("scaled"))


@query("game_context", """WITH g AS (SELECT o_custkey AS game, o_orderkey AS team, o_totalprice AS total FROM orders) SELECT game, round(median(total) + 1e-7, 4) AS middle, arg_max(team, (total, team)) AS favourite, CASE WHEN max(total) - min(total) > 200000 THEN 'blowout' WHEN median(total) > 150000 THEN 'shootout' ELSE 'grind' END AS script FROM g GROUP BY game""")
def context(t):
    spread = F.max("o_totalprice") - F.min("o_totalprice")
    script = F.when(spread > 200000, "blowout").when(F.median("o_totalprice") > 150000, "shootout").otherwise("grind")
    return t.orders.groupBy(F.col("o_custkey").alias("game")).agg(r(F.median("o_totalprice")).alias("middle"), F.max_by("o_orderkey", F.struct("o_totalprice", "o_orderkey")).alias("favourite"), script.alias("script"))


@query("tier_and_budget_admission", """WITH a AS (SELECT s_nationkey AS k, s_suppkey AS id, greatest(1, CAST(floor(abs(s_acctbal)) AS BIGINT) % 40) AS cost FROM supplier) SELECT id, k, cost, sum(cost) OVER (PARTITION BY k ORDER BY id ROWS UNBOUNDED PRECEDING) <= 60 AS admitted FROM a""")
def admission(t):
    cost = F.greatest(F.lit(1), F.abs("s_acctbal").cast("long") % 40)
    w = Window.partitionBy("k").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    rows = t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("k"), cost.alias("cost"))
    return rows.select("id", "k", "cost", (F.sum("cost").over(w) <= 60).alias("admitted"))
