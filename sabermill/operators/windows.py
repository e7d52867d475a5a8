"""Trailing, expanding and ranking features within a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def tail_features(df: DataFrame, key: str, order: list[Column], value: str, sizes: tuple[int, ...] = (3, 5, 10)) -> DataFrame:
    """Per key: count, mean, median and zero share of all rows and means of its last n rows, from one ranking."""
    ranked = df.withColumn("_rn", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    x = F.col(value).cast("double")
    aggs = [F.count("*").alias("games"), F.avg(x).alias("mean_all"), F.median(x).alias("median_all"), F.stddev_samp(x).alias("sd_all"), F.avg((x == 0).cast("double")).alias("zero_share")]
    return ranked.groupBy(key).agg(*aggs, *[F.avg(F.when(F.col("_rn") <= n, x)).alias(f"mean_{n}") for n in sizes])


def recent_slope(df: DataFrame, key: str, order: list[Column], value: str, size: int = 5, least: int = 3) -> DataFrame:
    """Least-squares slope over the last rows, oldest first; 0 with too few rows or no spread."""
    ranked = df.withColumn("_rn", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(f"_rn <= {size}")
    slope = F.regr_slope(F.col(value).cast("double"), -F.col("_rn").cast("double"))
    return ranked.groupBy(key).agg(F.when(F.count("*") < least, 0.0).otherwise(F.coalesce(slope, F.lit(0.0))).alias("slope"))


def prior_rolling_residual(df: DataFrame, key: str, order: list[Column], value: str, size: int = 8, least: int = 3) -> DataFrame:
    """Adds ``residual``: the value less the mean of the ``size`` rows before it; null with fewer than ``least``."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(-size, -1)
    return df.withColumn("residual", F.when(F.count(value).over(w) >= least, F.col(value) - F.avg(value).over(w)))


def rolling_mean(df: DataFrame, key: str, order: list[Column], value: str, size: int) -> DataFrame:
    return df.withColumn("rolling", F.avg(value).over(Window.partitionBy(key).orderBy(*order).rowsBetween(1 - size, 0)))


def expanding_shrunk(df: DataFrame, keys: list[str], order: list[Column], value: str, prior: Column, k: float = 10.0) -> DataFrame:
    """Adds n and the mean of all rows before, shrunk towards ``prior``: no row sees itself or a later one."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    n, mean = F.count(value).over(w), F.avg(value).over(w)
    return df.withColumn("prior_n", n).withColumn("shrunk", (n * F.coalesce(mean, F.lit(0.0)) + k * prior) / (n + k))


def depth_rank(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("depth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def within_z(df: DataFrame, key: str, value: str) -> DataFrame:
    """z-score within the key by sample deviation; no spread gives 0."""
    w = Window.partitionBy(key)
    sd = F.stddev_samp(value).over(w)
    return df.withColumn("z", F.coalesce(F.when(sd != 0, (F.col(value) - F.avg(value).over(w)) / sd), F.lit(0.0)))


def weighted_quantile(df: DataFrame, keys: list[str], value: str, weight: str, tie: list[str], q: float) -> DataFrame:
    """Linear interpolation of ``q`` on the cumulative weight share at each sorted value, clamped at the ends."""
    order = [F.col(value), *map(F.col, tie)]
    ws = Window.partitionBy(*keys).orderBy(*order)
    share = F.sum(weight).over(ws.rowsBetween(Window.unboundedPreceding, 0)) / F.sum(weight).over(Window.partitionBy(*keys))
    s = df.withColumn("_s", share).withColumn("_s0", F.lag("_s").over(ws)).withColumn("_v0", F.lag(value).over(ws))
    v = F.col(value)
    hit = F.when((F.col("_s") >= q) & F.col("_s0").isNull(), v).when((F.col("_s") >= q) & (F.col("_s0") < q), F.col("_v0") + (v - F.col("_v0")) * (q - F.col("_s0")) / (F.col("_s") - F.col("_s0")))
    return s.groupBy(*keys).agg(F.coalesce(F.min(hit), F.max(v)).alias("quantile"))


def drawdown(df: DataFrame, run: str, order: list[Column], pnl: str, start: float) -> DataFrame:
    """Per run: final balance, largest drawdown from the running peak, mean and deviation of returns, win rate."""
    w = Window.partitionBy(run).orderBy(*order)
    cum = w.rowsBetween(Window.unboundedPreceding, 0)
    b = df.withColumn("_b", start + F.sum(pnl).over(cum)).withColumn("_peak", F.greatest(F.max("_b").over(cum), F.lit(start)))
    b = b.withColumn("_r", F.col(pnl) / F.greatest(F.coalesce(F.lag("_b").over(w), F.lit(start)), F.lit(1.0)))
    sd = F.stddev_pop("_r")
    return b.groupBy(run).agg(F.sum(pnl).alias("pnl"), F.max((F.col("_peak") - F.col("_b")) / F.col("_peak")).alias("drawdown"), F.when(sd > 0, F.avg("_r") / sd).alias("sharpe"), F.avg((F.col(pnl) > 0).cast("double")).alias("win_rate"))


def average_rank(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rank with ties averaged; nulls keep a null rank. Rows are counted by value first, so a key with many rows is ordered by its distinct values alone."""
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    below = F.sum("_n").over(Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, -1))
    ranks = counted.select(*keys, value, (F.coalesce(below, F.lit(0)) + (F.col("_n") + 1) / 2.0).alias("rank"))
    return df.join(ranks, [*keys, value], "left")


def placed(df: DataFrame, keys: list[str], value: str, ties: list[str], cells: int = 4096) -> DataFrame:
    """Adds ``_place`` (1 ..), ``_upto`` (rows of no larger value) and ``_total`` of each row within its keys, by value and then ties; no task orders a whole key.

    Values fall into equal cells between a key's least and largest; cells are counted and added up in order, and rows are only ordered inside their cell. Rows of one value share a cell.
    """
    span = df.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.count("*").alias("_total"))
    width = F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0))
    celled = df.join(F.broadcast(span), keys).withColumn("_cell", F.coalesce(F.floor((F.col(value) - F.col("_lo")) / width * cells), F.lit(0)))
    order = Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    counts = celled.groupBy(*keys, "_cell").agg(F.count("*").alias("_in")).withColumn("_before", F.coalesce(F.sum("_in").over(order), F.lit(0)))
    cell = Window.partitionBy(*keys, "_cell")
    out = celled.join(counts, [*keys, "_cell"])
    out = out.withColumn("_place", F.col("_before") + F.row_number().over(cell.orderBy(value, *ties)))
    return out.withColumn("_upto", F.col("_before") + F.round(F.cume_dist().over(cell.orderBy(value)) * F.col("_in"))).drop("_lo", "_hi", "_cell", "_in", "_before")


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """At most ``k`` rows per key, cut per task before the shuffle."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(f"_rn <= {k}").drop("_rn")


def gap_days(df: DataFrame, key: str, order: list[Column], day: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("days_off", F.datediff(day, F.lag(day).over(w)).cast("long"))


def equal_deciles(df: DataFrame, value: str, ties: list[str], keys: list[str], n: int = 10) -> DataFrame:
    """Equal-frequency bins 0 .. n-1 with linearly interpolated edges over the first-come rank; see ``placed``."""
    ranked = placed(df, keys, value, ties)
    edge = F.ceil((F.col("_place") - 1) * float(n) / F.greatest(F.col("_total") - 1, F.lit(1))) - 1
    return ranked.withColumn("bin", F.greatest(edge, F.lit(0)).cast("long")).drop("_place", "_upto", "_total")
