"""Nested feeds, histories, bundles and snapshots: what comes in and goes out besides plain tables."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sabermill.sources.tables import read_parquet_safe, replace_table

c = F.col

HISTORY = "player string, day date, league string, market string, line double, prob double, actual double"
PARLAYS = "entry string, day date, legs array<struct<player:string,market:string,bet:string,line:double>>, profit double"


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """The flat history of predictions, empty if there is none yet."""
    return read_parquet_safe(spark, path, HISTORY)


def read_parlays(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Entries with their legs as an array of structures; only the columns asked for are read."""
    return read_parquet_safe(spark, path, PARLAYS, columns)


def read_bundle(spark: SparkSession, folder: str, players: str = "player string, team string, position string") -> dict[str, DataFrame]:
    """A league's game log, team log and players, the last as Parquet or as one JSON object by player."""
    out = {name: spark.read.parquet(f"{folder}/{name}") for name in ("gamelog", "teamlog")}
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(f"{folder}/players.json")
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        facts = spark.read.text(f"{folder}/players.json", wholetext=True).select(F.explode(F.from_json("value", "map<string,struct<team:string,position:string>>")).alias("player", "f"))
        out["players"] = facts.select("player", "f.*")
    else:
        out["players"] = read_parquet_safe(spark, f"{folder}/players", players)
    return out


def read_weeks(spark: SparkSession, folder: str, first: int, last: int, kind: str) -> DataFrame:
    """Weekly snapshots of one kind from ``first`` to ``last``; the folder is partitioned by kind and week, so other weeks are not read."""
    return spark.read.parquet(folder).where((c("kind") == kind) & c("week").between(first, last))


def linked_offers(payload: DataFrame) -> DataFrame:
    """Flat offers of a platform whose feed has lines, appearances, players and games by id (columns of maps or arrays of structures).

    ``payload``: lines array<struct<appearance:string,stat:string,value:double,over:double,under:double>>, appearances map<string,struct<player:string,game:string>>, players map<string,string>, games map<string,string>.
    A line whose appearance is unknown is dropped; an unknown player or game is null.
    """
    rows = payload.select(F.explode("lines").alias("l"), "appearances", "players", "games")
    rows = rows.withColumn("a", c("appearances")[c("l.appearance")]).where("a IS NOT NULL")
    return rows.select(c("players")[c("a.player")].alias("player"), c("games")[c("a.game")].alias("game"), c("l.stat").alias("market"), c("l.value").alias("line"), c("l.over").alias("boost_over"), c("l.under").alias("boost_under"))


def included_offers(payload: DataFrame) -> DataFrame:
    """Flat offers of a platform whose feed lists projections and, apart from them, the included records that they name by type and id.

    ``payload``: data array<struct<player_id:string,stat:string,line:double,odds:string>>, included array<struct<type:string,id:string,name:string,team:string>>. Odds 'demon' pay more, 'goblin' less.
    """
    players = F.map_from_entries(F.transform(F.filter("included", lambda x: x["type"] == "player"), lambda x: F.struct(x["id"], F.struct(x["name"].alias("name"), x["team"].alias("team")))))
    rows = payload.select(F.explode("data").alias("d"), players.alias("p")).withColumn("who", c("p")[c("d.player_id")])
    boost = F.when(c("d.odds") == "demon", 1.25).when(c("d.odds") == "goblin", 0.8).otherwise(1.0)
    return rows.select(c("who.name").alias("player"), c("who.team").alias("team"), c("d.stat").alias("market"), c("d.line").alias("line"), boost.alias("boost"))


def tabular_rows(body: Column, fields: str) -> Column:
    """Array of structures from a response in any of four shapes: a list of objects, {"data": [..]}, {"rows": [..]}, or {"columns": [..], "data": [[..]]}; anything else gives null."""
    names = [f.split()[0] for f in fields.split(", ")]
    kinds = [f.split()[1] for f in fields.split(", ")]
    plain, listed = f"array<struct<{', '.join(f'{n}:{k}' for n, k in zip(names, kinds))}>>", "array<array<string>>"
    columns = F.from_json(body, "struct<columns:array<string>>")["columns"]
    table = F.from_json(body, f"struct<data:{listed}>")["data"]
    cell = lambda row, n, k: F.get(row, F.array_position(columns, n).cast("int") - 1).try_cast(k).alias(n)
    crossed = F.transform(table, lambda row: F.struct(*[cell(row, n, k) for n, k in zip(names, kinds)]))
    return F.when(columns.isNotNull(), crossed).otherwise(F.coalesce(F.when(F.ltrim(body).startswith("["), F.from_json(body, plain)), F.from_json(body, f"struct<data:{plain}>")["data"], F.from_json(body, f"struct<rows:{plain}>")["rows"]))


# ---- sinks


def flush(buffers: dict[str, DataFrame], folder: str) -> None:
    """Appends each buffer to the table of its name."""
    for name, rows in buffers.items():
        rows.write.mode("append").parquet(f"{folder}/{name}")


def finite(df: DataFrame) -> DataFrame:
    """Infinite and undefined numbers as null."""
    doubles = [f.name for f in df.schema.fields if f.dataType.simpleString() in ("double", "float")]
    return df.withColumns({n: F.when(~F.isnan(n) & (F.abs(n) < float("inf")), c(n)) for n in doubles})


def write_snapshots(tables: dict[str, DataFrame], folder: str, order: str = "model_ev") -> None:
    """Each table replaced by its new state, best first, without infinite numbers, and a JSON file that says what there is."""
    meta = []
    for name, df in tables.items():
        rows = finite(df)
        replace_table(rows.orderBy(F.desc_nulls_last(order)) if order in df.columns else rows, f"{folder}/{name}")
        meta.append((name, ",".join(df.columns)))
    spark = next(iter(tables.values())).sparkSession
    replace_table(spark.createDataFrame(meta, "name string, columns string").coalesce(1), f"{folder}/meta", "json")


def write_correlations(same: DataFrame, opposing: DataFrame, folder: str) -> None:
    """Both pair tables, a summary by market, and what they were made of."""
    last = lambda x: F.element_at(F.split(x, r"\."), -1)
    both = same.withColumn("scope", F.lit("same")).unionByName(opposing.withColumn("scope", F.lit("opposing")))
    summary = both.groupBy("scope", last("a").alias("market_a"), last("b").alias("market_b")).agg(F.avg("rho").alias("rho"), F.count("*").alias("n"))
    replace_table(same, f"{folder}/same")
    replace_table(opposing, f"{folder}/opposing")
    replace_table(summary, f"{folder}/summary")
    replace_table(both.groupBy("scope").agg(F.count("*").alias("pairs")).coalesce(1), f"{folder}/meta", "json")


def recommendation_yaml(entries: list[dict], day: str, bankroll: float) -> str:
    """A day's entries as YAML; texts are quoted as JSON strings, which YAML reads alike."""
    out = [f"date: {json.dumps(day)}", f"bankroll: {bankroll:.2f}", "entries:" + ("" if entries else " []")]
    for e in entries:
        out += [f"  - stake: {e['stake']:.2f}", "    legs:" + ("" if e["legs"] else " []")]
        out += [f"      - {json.dumps(x, ensure_ascii=False)}" for x in e["legs"]]
    return "\n".join(out) + "\n"


def missing_parts(wanted: DataFrame, present: DataFrame, keys: list[str]) -> DataFrame:
    """Parts that a collector still has to fetch: those wanted that are not there."""
    return wanted.join(present.select(*keys).distinct(), keys, "left_anti")
