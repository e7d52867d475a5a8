"""Weighted, two-level and recipe-driven aggregates, all with map-side partial sums."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window, functions as F


def weighted_mean(value: Column, weight: Column) -> Column:
    """Sum of w v over sum of w where v is not null; null without weight."""
    return F.sum(value * weight) / F.nullif(F.sum(F.when(value.isNotNull(), weight)), F.lit(0.0))


def deviation_below(value: str, limit: int) -> Column:
    """Whether the population deviation of a numeric column is under ``limit``; null without values.

    Decided in whole numbers where all values are under 10^7 and have at most two decimals, so that a deviation of exactly ``limit`` isn't under it by rounding, in whatever order rows come.
    """
    d = F.expr(f"try_cast({value} AS DECIMAL(9, 2))")
    exact = F.bool_and(F.col(value).isNull() | F.coalesce(d.cast("double") == F.col(value).cast("double"), F.lit(False)))
    n, total, squares = F.count(value).cast("decimal(10, 0)"), F.sum(d), F.sum(d * d)
    return F.when(exact, n * squares - total * total < n * n * F.lit(limit * limit)).otherwise(F.stddev_pop(value) < limit)


def exact_quantiles(df: DataFrame, keys: list[str], value: str, at: list[float], cells: int = 4096) -> DataFrame:
    """(keys, q0, q1, ..): what ``percentile`` gives of each key for the shares in ``at``, without a buffer of its values; null where it has none. Keys are few, their spans are broadcast.

    Values fall into equal cells between a key's least and largest, and cells are counted; only rows of cells that hold a wanted rank are exchanged, counted by value and ordered inside their cell.
    """
    rows = df.select(*keys, F.col(value).cast("double").alias("_v"))
    span = rows.groupBy(*keys).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count("_v").alias("_total"))
    share = (F.col("_v") - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0))
    celled = rows.where("_v IS NOT NULL").join(F.broadcast(span), keys).withColumn("_cell", F.coalesce(F.floor(share * cells), F.lit(0))).select(*keys, "_cell", "_v")
    before = lambda by, part: F.coalesce(F.sum("_n").over(Window.partitionBy(*part).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = celled.groupBy(*keys, "_cell").agg(F.count("*").alias("_n")).withColumn("_before", before("_cell", keys))
    wanted = F.array(*[F.struct(F.lit(i).alias("i"), ((F.col("_total") - 1) * F.lit(q)).alias("at")) for i, q in enumerate(at)])
    ranks = span.where("_total > 0").select(*keys, F.explode(wanted).alias("_w")).select(*keys, "_w.*").select(*keys, "i", "at", F.explode(F.array(F.floor("at"), F.ceil("at"))).alias("_rank"))
    held = (F.col("_rank") >= F.col("_before")) & (F.col("_rank") < F.col("_before") + F.col("_n"))
    places = ranks.select(*keys, "_rank").distinct()
    needed = counts.join(F.broadcast(places), keys).where(held).select(*keys, "_cell", F.col("_before").alias("_start")).distinct()
    few = celled.join(F.broadcast(needed), [*keys, "_cell"]).groupBy(*keys, "_cell", "_start", "_v").agg(F.count("*").alias("_n"))
    few = few.withColumn("_before", F.col("_start") + before("_v", [*keys, "_cell"]))
    found = few.join(F.broadcast(ranks), keys).where(held).groupBy(*keys, "i", "at").agg(F.min_by("_v", "_rank").alias("a"), F.max_by("_v", "_rank").alias("b"))
    a, b, x = F.col("a"), F.col("b"), F.col("at")
    found = found.withColumn("q", F.when(a == b, a).otherwise((F.ceil(x) - x) * a + (x - F.floor(x)) * b))
    found = found.groupBy(*keys).agg(*[F.max(F.when(F.col("i") == i, F.col("q"))).alias(f"q{i}") for i in range(len(at))])
    return span.select(*keys).join(F.broadcast(found), keys, "left")


def rate(top: Column, bottom: Column) -> Column:
    return F.sum(top) / F.nullif(F.sum(bottom), F.lit(0.0))


def consensus_line(df: DataFrame, keys: list[str], line: str, distinct: bool = True) -> DataFrame:
    """Median of the (distinct) lines, down to a half; 0 without any."""
    base = df.select(*keys, line).distinct() if distinct else df
    return base.groupBy(*keys).agg(F.coalesce(F.floor(2 * F.median(line)) / 2, F.lit(0.0)).cast("double").alias("line"))


def recipes(df: DataFrame, keys: list[str], table: Iterable[tuple[str, str, tuple[str, ...]]]) -> DataFrame:
    """Many named aggregates in one pass. Patterns: sum(x), rate(x, y), wmean(x, w), mean(x), excess(actual, expected)."""
    kinds = {
        "sum": lambda x: F.sum(x),
        "rate": lambda x, y: rate(F.col(x), F.col(y)),
        "wmean": lambda x, w: weighted_mean(F.col(x), F.col(w)),
        "mean": lambda x: F.avg(x),
        "excess": lambda a, e: (F.sum(a) - F.sum(e)) / F.nullif(F.sum(e), F.lit(0.0)),
    }
    return df.groupBy(*keys).agg(*[kinds[kind](*args).alias(name) for name, kind, args in table])


def two_level_z(df: DataFrame, key: str, value: str, least: int = 2) -> DataFrame:
    """z of each key's mean against the mean and sample deviation of the keys' means."""
    means = df.groupBy(key).agg(F.avg(value).alias("mean"), F.count("*").alias("n")).where(f"n >= {least}")
    league = means.agg(F.avg("mean").alias("lm"), F.stddev_samp("mean").alias("ls"))
    return means.join(F.broadcast(league)).select(key, "mean", ((F.col("mean") - F.col("lm")) / F.nullif("ls", F.lit(0.0))).alias("z"))


def allowed_profile(df: DataFrame, opponent: str, game: str, value: str) -> DataFrame:
    """Sum per opponent and game, mean per opponent against the mean of those means, less 1."""
    games = df.groupBy(opponent, game).agg(F.sum(value).alias("s"))
    means = games.groupBy(opponent).agg(F.avg("s").alias("m"))
    return means.join(F.broadcast(means.agg(F.avg("m").alias("lm")))).select(opponent, (F.col("m") / F.col("lm") - 1).alias("allowed"))


def home_ratio(home: Column, value: Column) -> Column:
    return F.avg(F.when(home, value)) / F.nullif(F.avg(value), F.lit(0.0)) - 1


def slope_against(df: DataFrame, key: str, value: str, signal: str) -> DataFrame:
    """Closed-form slope of relative value on relative signal within a key; null without spread."""
    w = Window.partitionBy(key)
    rel = df.select(key, (F.col(value) / F.avg(value).over(w)).alias("y"), (F.col(signal) / F.avg(signal).over(w)).alias("x"))
    n, sx, sy = F.count("*"), F.sum("x"), F.sum("y")
    sxy, sxx = F.sum(F.col("x") * F.col("y")), F.sum(F.col("x") * F.col("x"))
    return rel.groupBy(key).agg(((n * sxy - sx * sy) / F.nullif(F.round(n * sxx - sx * sx, 9), F.lit(0.0))).alias("slope"))


def movement(df: DataFrame, keys: list[str], ts: str, value: str) -> DataFrame:
    """Open, close, peak, trough, observations, moves and span in minutes of a time series; equal times take their mean value."""
    series = df.groupBy(*keys, ts).agg(F.avg(value).alias("v"))
    moved = series.withColumn("prev", F.lag("v").over(Window.partitionBy(*keys).orderBy(ts)))
    return moved.groupBy(*keys).agg(
        F.min_by("v", ts).alias("open"), F.max_by("v", ts).alias("close"), F.max("v").alias("peak"), F.min("v").alias("trough"), F.count("*").alias("n_obs"),
        F.count(F.when(F.col("v") != F.col("prev"), 1)).alias("n_moves"), ((F.unix_timestamp(F.max(ts).cast("timestamp")) - F.unix_timestamp(F.min(ts).cast("timestamp"))) / 60).cast("double").alias("minutes"),
    )


def auc(df: DataFrame, keys: list[str], score: str, hit: str) -> DataFrame:
    """Area under the ROC curve from average ranks; scores are counted first, so that the ranks are over distinct values."""
    per = df.groupBy(*keys, score).agg(F.count("*").alias("n"), F.sum(F.col(hit).cast("long")).alias("h"))
    part = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    below = F.sum("n").over(part.orderBy(score).rowsBetween(Window.unboundedPreceding, -1))
    ranked = per.withColumn("r", F.coalesce(below, F.lit(0)) + (F.col("n") + 1) / 2.0)
    pos, neg = F.sum("h"), F.sum(F.col("n") - F.col("h"))
    return ranked.groupBy(*keys).agg(((F.sum(F.col("h") * F.col("r")) - pos * (pos + 1) / 2.0) / F.nullif(pos * neg, F.lit(0))).alias("auc"))


def spearman_pairs(long: DataFrame, row: str, column: str, rank: str, least: int) -> DataFrame:
    """Pearson correlation of ranks and overlap for each pair of columns, from the long form; pairs are made within a row only."""
    a, b = long.alias("a"), long.alias("b")
    pairs = a.join(b, (F.col(f"a.{row}") == F.col(f"b.{row}")) & (F.col(f"a.{column}") < F.col(f"b.{column}")))
    out = pairs.groupBy(F.col(f"a.{column}").alias("col_a"), F.col(f"b.{column}").alias("col_b")).agg(F.corr(f"a.{rank}", f"b.{rank}").alias("rho"), F.count("*").alias("n"))
    return out.where(f"n >= {least}")
