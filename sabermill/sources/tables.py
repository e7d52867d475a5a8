"""Parquet, CSV and JSON sources with explicit schemas, and sinks that replace a table by a rename."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

#: One event of an odds feed: bookmakers, their markets, and the priced outcomes.
FEED = "id string, sport_key string, commence_time string, home_team string, away_team string, bookmakers array<struct<key:string,last_update:string,markets:array<struct<key:string,outcomes:array<struct<name:string,description:string,price:double,point:double>>>>>>"


def read_parquet_safe(spark: SparkSession, path: str, schema: StructType | str, columns: list[str] | None = None) -> DataFrame:
    """The table's columns, or an empty table of ``schema`` if there is none yet."""
    empty = spark.createDataFrame([], schema)
    try:
        found = spark.read.schema(empty.schema).parquet(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        found = empty
    return found.select(*columns) if columns else found


def read_csv(spark: SparkSession, path: str, schema: str, prefix: str = "") -> DataFrame:
    """A CSV with a header; names in lower case with underscores and a prefix."""
    found = spark.read.schema(schema).option("header", True).csv(path)
    return found.toDF(*[prefix + "_".join(c.lower().split()) for c in found.columns])


def feed_outcomes(events: DataFrame) -> DataFrame:
    """One row per outcome of a nested feed."""
    books = events.select("id", "home_team", "away_team", "commence_time", F.explode("bookmakers").alias("b"))
    markets = books.select("id", "home_team", "away_team", "commence_time", F.col("b.key").alias("book"), F.explode("b.markets").alias("m"))
    rows = markets.select("id", "home_team", "away_team", "commence_time", "book", F.col("m.key").alias("market"), F.explode("m.outcomes").alias("o"))
    return rows.select("id", "home_team", "away_team", "commence_time", "book", "market", F.col("o.name").alias("side"), F.col("o.description").alias("player"), F.col("o.price").alias("price"), F.col("o.point").alias("point"))


def read_ledger(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON-lines ledger. A torn last line of a file, one without a line end, is skipped; any other bad line is an error, raised here.

    Bad lines are looked for once, and of a file that has one only its last bytes are read on the driver.
    """
    lines = spark.read.text(path).where("trim(value) <> ''").select("value", F.col("_metadata.file_path").alias("_file"))
    parsed = lines.select("_file", "value", F.from_json("value", f"{schema}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("_row"))
    bad = parsed.where("_row._corrupt IS NOT NULL").groupBy("_file").agg(F.count("*").alias("n"), F.min("value").alias("line"))
    torn = [r["_file"] for r in bad.toLocalIterator() if _is_torn(spark, r["_file"], r["line"], r["n"])]
    good = parsed.where("_row._corrupt IS NULL") if torn else parsed
    return good.select("_row.*").drop("_corrupt")


def _is_torn(spark: SparkSession, file: str, line: str, n: int) -> bool:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(file))
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    raw = line.encode()
    size = fs.getFileStatus(at).getLen()
    stream = fs.open(at)
    try:
        stream.seek(max(0, size - len(raw)))
        end = bytes(stream.readNBytes(len(raw)))
    finally:
        stream.close()
    if n > 1 or end != raw:
        raise ValueError(f"bad ledger line in {file}: {line}")
    return True


def _swap(spark: SparkSession, fresh: str, path: str) -> None:
    """Puts ``fresh`` in the place of ``path``; if that fails, what was there is put back."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path
    fs = p(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    old = f"{path}.old-{uuid.uuid4().hex}"
    had = fs.exists(p(path))
    if had and not fs.rename(p(path), p(old)):
        raise OSError(f"{path} could not be moved away")
    try:
        if not fs.rename(p(fresh), p(path)):
            raise OSError(f"{fresh} could not be moved to {path}")
    except Exception:
        if had and not fs.exists(p(path)):
            fs.rename(p(old), p(path))
        raise
    if had:
        fs.delete(p(old), True)


def replace_table(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """Writes a Parquet, JSON or CSV table beside the old one and then moves both; ``df`` may read the table itself.

    A reader never sees a half-written table. Between the two moves there is none for a moment; if the second one fails, the old table is put back and the error raised.
    """
    fresh = f"{path}.new-{uuid.uuid4().hex}"
    writer = df.write.option("header", True) if kind == "csv" else df.write
    writer.format(kind).save(fresh)
    _swap(df.sparkSession, fresh, path)


def upsert(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` replace rows of the same key."""
    return table.join(rows.select(*keys).distinct(), keys, "left_anti").unionByName(rows, allowMissingColumns=True)


def retain(df: DataFrame, day: str, since: Column, entity: str) -> DataFrame:
    """Rows on or after a day, without combined and head-to-head entities."""
    return df.where((F.col(day) >= since) & ~F.col(entity).like("% + %") & ~F.col(entity).like("% vs. %"))
