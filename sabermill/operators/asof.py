"""Latest-per-key and as-of reads over append-only tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def latest_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the first by ``order``, which must be total. Spark keeps one row per key and task before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def as_of(df: DataFrame, ts: str, at) -> DataFrame:
    """The rows that had been observed at a cut-off; pushed into the scan."""
    return df.where(F.col(ts) <= F.lit(at))


def asof_join(probes: DataFrame, quotes: DataFrame, key: str, probe_ts: str, quote_ts: str, values: list[str], tie: list[str], strict: bool = False) -> DataFrame:
    """Each probe row with the values of the key's last quote at or before (``strict``: before) its time.

    Both sides are stacked, sorted once by time within the key, and the last quote is carried forward: linear after one shuffle, where a range join would be quadratic. ``tie``
    orders quotes of one time; probes follow quotes of their time, or go before them if ``strict``.
    """
    names = probes.columns
    p = probes.select(F.col(key).alias("_k"), F.col(probe_ts).alias("_t"), F.lit(0 if strict else 1).alias("_kind"), F.struct(*names).alias("_p"), F.lit(None).cast(quotes.select(F.struct(*tie)).schema[0].dataType).alias("_tie"), F.lit(None).cast(quotes.select(F.struct(*values)).schema[0].dataType).alias("_q"))
    q = quotes.select(F.col(key).alias("_k"), F.col(quote_ts).alias("_t"), F.lit(1 if strict else 0).alias("_kind"), F.lit(None).cast(p.schema["_p"].dataType).alias("_p"), F.struct(*tie).alias("_tie"), F.struct(*values).alias("_q"))
    w = Window.partitionBy("_k").orderBy("_t", "_kind", "_tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = p.unionByName(q).withColumn("_last", F.last("_q", ignorenulls=True).over(w)).where("_p IS NOT NULL")
    return carried.select("_p.*", *[F.col(f"_last.{v}").alias(v) for v in values])


def snapshot_before(df: DataFrame, snap: str, at) -> DataFrame:
    """All rows of the last snapshot strictly before a date; the scalar maximum prunes partitions at run time."""
    last = df.where(F.col(snap) < F.lit(at)).agg(F.max(snap).alias("_last"))
    return df.join(F.broadcast(last), F.col(snap) == F.col("_last")).drop("_last")
