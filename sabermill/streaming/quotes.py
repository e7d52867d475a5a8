"""A stream of quotes that keeps the latest one per key, and windowed counts with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery


def read_quotes(spark: SparkSession, path: str, files: int = 1) -> DataFrame:
    """New Parquet files of a folder as a stream, ``files`` a batch, with the folder's schema."""
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files).parquet(path)


def latest(stream: DataFrame, keys: list[str], ts: str, values: list[str]) -> DataFrame:
    """The values of the latest row per key, updated as rows arrive; the state is one row per key."""
    return stream.groupBy(*keys).agg(F.max(F.struct(ts, *values)).alias("m")).select(*keys, "m.*")


def window_counts(stream: DataFrame, ts: str, key: str, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Counts per key and tumbling window; rows later than the watermark are dropped and windows behind it leave the state."""
    at = F.col(ts).cast("timestamp")
    return stream.withColumn("_at", at).withWatermark("_at", late).groupBy(F.window("_at", width), key).agg(F.count("*").alias("n"))


def drain(result: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> StreamingQuery:
    """Runs the stream over all that is there now into a table in memory, and waits."""
    query = result.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def closing_pass(stream: DataFrame, events: DataFrame, now: str, soon: int = 5, late: int = 25) -> DataFrame:
    """Quotes of events that start between ``soon`` and ``late`` minutes after ``now``; ``events``: (event, starts), the day's, so it is joined as a small static side."""
    at = F.lit(now).cast("timestamp_ntz")
    minutes = (F.unix_timestamp(F.col("starts").cast("timestamp")) - F.unix_timestamp(at.cast("timestamp"))) / 60
    return stream.join(events.where((minutes >= soon) & (minutes <= late)), "event")


def append_batches(stream: DataFrame, path: str, checkpoint: str, keys: list[str]) -> StreamingQuery:
    """Appends new rows to a table, a batch at a time, without rows whose key the table has; waits until all that is there now is in."""

    def add(batch: DataFrame, _: int) -> None:
        from sabermill.sources.tables import read_parquet_safe

        have = read_parquet_safe(batch.sparkSession, path, batch.schema, keys).distinct()
        batch.dropDuplicates(keys).join(have, keys, "left_anti").write.mode("append").parquet(path)

    query = stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
