"""The registry of queries and the tables they read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """Parquet tables of a folder by attribute, and the engine's views of them."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @property
    def quotes(self) -> DataFrame:
        """Price observations: entity, book, ev, line, under_prob, observed_at; (okey, lnum, tax, qty) break ties."""
        return self.lineitem.selectExpr("l_partkey AS entity", "l_suppkey AS book", "l_extendedprice AS ev", "l_quantity AS line", "l_discount AS under_prob", "l_shipdate AS observed_at", "l_orderkey AS okey", "l_linenumber AS lnum", "l_tax AS tax")

    @property
    def log(self) -> DataFrame:
        """Game log: player, day, ts, seq (unique), team, value."""
        return self.events.selectExpr("user_id AS player", "cast(ts AS date) AS day", "ts", "event_id AS seq", "event_type AS team", "value")

    @property
    def history(self) -> DataFrame:
        """Settled predictions: prob, market_prob, hit, boost, day, league, market, platform."""
        return self.lineitem.selectExpr("0.5D + 4 * l_discount AS prob", "0.5D + 4 * l_tax AS market_prob", "l_returnflag = 'R' AS hit", "1 + l_quantity / 50 AS boost", "cast(l_shipdate AS date) AS day", "l_returnflag AS league", "l_linestatus AS market", "l_suppkey AS platform", "l_partkey AS player", "l_quantity AS line", "l_extendedprice / 1000 AS actual", "l_orderkey AS okey", "l_linenumber AS lnum")

    @property
    def offers(self) -> DataFrame:
        """Offers of a slate: player, team, league, market, day, line, proj, over, sharp, boost, boost_over; (okey, lnum, price, line) break ties."""
        return self.lineitem.selectExpr(*OFFER_COLUMNS)


OFFER_COLUMNS = ["l_orderkey AS okey", "l_linenumber AS lnum", "l_partkey AS player", "l_suppkey AS team", "l_suppkey % 4 AS platform", "l_returnflag AS league", "l_linestatus AS market", "CAST(l_shipdate AS DATE) AS day", "l_quantity AS line", "l_extendedprice / 2000 AS proj", "l_extendedprice AS price", "l_discount * 6 + 0.2 AS over", "l_tax * 5 + 0.3 AS sharp", "l_tax * 2 + 0.9 AS boost", "CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_discount * 3 + 0.85 END AS boost_over"]

#: The same views for DuckDB.
OFFERS = f"offers AS (SELECT {', '.join(OFFER_COLUMNS)} FROM lineitem)"
QUOTES = "quotes AS (SELECT l_partkey AS entity, l_suppkey AS book, l_extendedprice AS ev, l_quantity AS line, l_discount AS under_prob, l_shipdate AS observed_at, l_orderkey AS okey, l_linenumber AS lnum, l_tax AS tax FROM lineitem)"
LOG = "log AS (SELECT user_id AS player, CAST(ts AS DATE) AS day, ts, event_id AS seq, event_type AS team, value FROM events)"
HISTORY = "history AS (SELECT 0.5 + 4 * l_discount AS prob, 0.5 + 4 * l_tax AS market_prob, l_returnflag = 'R' AS hit, 1 + l_quantity / 50 AS boost, CAST(l_shipdate AS DATE) AS day, l_returnflag AS league, l_linestatus AS market, l_suppkey AS platform, l_partkey AS player, l_quantity AS line, l_extendedprice / 1000 AS actual, l_orderkey AS okey, l_linenumber AS lnum FROM lineitem)"


def query(name: str, sql: str | None = None) -> Callable:
    """Registers ``fn(tables)`` and its SQL; {quotes}, {log}, {history} and {offers} in the SQL stand for the views."""

    def add(fn: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql:
            ORACLES[name] = sql.replace("{quotes}", QUOTES).replace("{log}", LOG).replace("{history}", HISTORY).replace("{offers}", OFFERS)
        return fn

    return add


def half_weight(book: str):
    """Weight of a book: 1, 2, 4 or 8 by its number."""
    return F.pow(F.lit(2.0), F.col(book) % 4)
