"""Resolving quotes and prices to one line, picks, trims and intervals; groups are pre-aggregated before any shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sabermill.functions.odds import devig
from sabermill.operators.aggregates import exact_quantiles


def resolve_quote(rows: DataFrame, key: str, weight: Column, most: float = 2000.0) -> DataFrame:
    """(key, line, under, ev, books, observed_at, source) from each book's last quote (line, under_prob, ev, observed_at).

    'modal': the line that most books with a line and a probability inside (0, 1) have; ties go to the line nearest their median, then to the lowest. Else 'ev': the weighted mean of usable values
    (0 to ``most``). Else 'neutral', 0.5.
    """
    rows = rows.withColumn("w", weight)
    valid = rows.where("line IS NOT NULL AND under_prob > 0 AND under_prob < 1")
    lines = valid.groupBy(key, "line").agg(F.count("*").alias("books"), (F.sum(F.col("w") * F.col("under_prob")) / F.sum("w")).alias("under"), F.max("observed_at").alias("observed_at"))
    middle = valid.groupBy(key).agg(F.median("line").alias("middle"))
    order = F.struct((-F.col("books")).alias("less"), F.abs(F.col("line") - F.col("middle")).alias("off"), "line", "under", "books", "observed_at")
    modal = lines.join(middle, key).groupBy(key).agg(F.min(order).alias("m"))
    usable = (F.col("ev") > 0) & (F.col("ev") <= most)
    total = F.sum(F.when(usable, F.col("w")))
    every = rows.groupBy(key).agg(F.when(total > 0, F.sum(F.when(usable, F.col("w") * F.col("ev"))) / total).alias("mean"))
    found = every.join(modal, key, "left")
    none = F.col("m").isNull()
    source = F.when(~none, "modal").when(F.col("mean").isNotNull(), "ev").otherwise("neutral")
    return found.select(key, F.col("m.line").alias("line"), F.when(none, 0.5).otherwise(F.col("m.under")).alias("under"), F.when(none, F.col("mean")).alias("ev"), F.coalesce("m.books", F.lit(0).cast("long")).alias("books"), F.col("m.observed_at").alias("observed_at"), source.alias("source"))


def devig_ladder(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, point, p_over): the no-vig over probability of each point from prices (name, point, price); the shortest price of a side counts."""
    side = lambda name: F.max(F.when(F.col("name") == name, 1 / F.col("price")))
    both = rows.where("price > 1").groupBy(*keys, "point").agg(side("Over").alias("over"), side("Under").alias("under"))
    return both.where("over IS NOT NULL OR under IS NOT NULL").select(*keys, "point", devig(F.col("over"), F.col("under")).alias("p_over"))


def prop_lines(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, point, over, under): one price a side, nearest 2.0; Yes and No are Over and Under, a missing point is 0.5, and a lone Under price u gives an Over of u / (u - 1)."""
    named = rows.select(*keys, F.when(F.col("name") == "Yes", "Over").when(F.col("name") == "No", "Under").otherwise(F.col("name")).alias("name"), F.coalesce("point", F.lit(0.5)).alias("point"), "price")
    best = lambda name: F.min(F.when(F.col("name") == name, F.struct(F.abs(F.col("price") - 2).alias("off"), "point", "price")))
    sides = named.where("price IS NOT NULL").groupBy(*keys).agg(best("Over").alias("o"), best("Under").alias("u"))
    implied = F.when(F.col("u.price") > 1, F.col("u.price") / (F.col("u.price") - 1))
    return sides.select(*keys, F.coalesce("o.point", "u.point").alias("point"), F.coalesce(F.col("o.price"), implied).alias("over"), F.col("u.price").alias("under"))


def team_totals(totals: Column, spread: Column) -> tuple[Column, Column]:
    """Home and away totals of a game; a negative spread favours the home side."""
    return (totals - spread) / 2, (totals + spread) / 2


def upcoming(ledger: DataFrame, incoming: DataFrame, key: str, start: str, now: Column, window: Column) -> DataFrame:
    """The ledger with ``incoming`` rows put over those of the same key, without events before ``now``; ``closing``: starts before the window ends."""
    kept = ledger.join(incoming.select(key), key, "left_anti")
    return kept.unionByName(incoming).where(F.col(start) >= now).withColumn("closing", F.col(start) < now + window)


def best_per_player(bets: DataFrame, day: str, player: str, order: list[Column], most: int) -> DataFrame:
    """Of each day the ``most`` first bets in ``order`` (columns, least first), at most one a player."""
    from pyspark.sql import Window

    best = bets.groupBy(day, player).agg(F.min(F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)])).alias("best"))
    ranked = best.withColumn("place", F.row_number().over(Window.partitionBy(day).orderBy("best", player)))
    return ranked.where(F.col("place") <= most)


def trim_outliers(rows: DataFrame, cell: list[str], value: str, always: Column, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """The rows from the low to the high percentile of their cell, and those that ``always`` keeps. Cells are few; rows are neither buffered nor exchanged by cell."""
    edges = exact_quantiles(rows, cell, value, [low, high])
    return rows.join(F.broadcast(edges), cell).where(always | F.col(value).between(F.col("q0") - 1e-6, F.col("q1") + 1e-6)).drop("q0", "q1")


def poisson_bootstrap(rows: DataFrame, cell: list[str], value: str, ident: list[str], draws: int = 200, level: float = 0.95) -> DataFrame:
    """(cell, mean, low, high): interval of the mean from ``draws`` resamples in which a row counts Poisson(1) times, drawn from a hash of ``ident`` and the draw.

    Rows are summed by cell and draw map-side, so only cells times draws are shuffled, however large a cell is.
    """
    steps, p, below = [], 0.36787944117144233, 0.0
    for k in range(8):
        below += p
        p /= k + 1
        steps.append(below)
    drawn = rows.where(F.col(value).isNotNull()).select(*cell, F.col(value).alias("x"), F.xxhash64(*ident).alias("h")).withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    u = F.pmod(F.xxhash64("h", "draw"), F.lit(1 << 30)) / float(1 << 30)
    weight = sum((F.when(u >= s, 1).otherwise(0) for s in steps[1:]), F.when(u >= steps[0], 1).otherwise(0))
    sums = drawn.withColumn("w", weight).groupBy(*cell, "draw").agg(F.sum(F.col("w") * F.col("x")).alias("wx"), F.sum("w").alias("n"))
    means = sums.where("n > 0").groupBy(*cell).agg(F.percentile(F.col("wx") / F.col("n"), F.lit((1 - level) / 2)).alias("low"), F.percentile(F.col("wx") / F.col("n"), F.lit((1 + level) / 2)).alias("high"))
    return rows.groupBy(*cell).agg(F.avg(value).alias("mean")).join(means, cell)
