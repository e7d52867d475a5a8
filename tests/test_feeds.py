"""Sources and sinks that queries don't exercise: files, bundles, snapshots, ledgers, streams."""

import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sabermill.functions import distributions as d
from sabermill.operators import search
from sabermill.plans import calibration
from sabermill.sources import feeds
from sabermill.sources.tables import read_csv, read_ledger, replace_table, retain
from sabermill.streaming import quotes


def test_histories_bundles_and_weeks(spark, tmp_path):
    assert feeds.read_history(spark, f"{tmp_path}/none").count() == 0
    assert feeds.read_parlays(spark, f"{tmp_path}/none", ["entry", "legs"]).columns == ["entry", "legs"]
    spark.range(3).write.parquet(f"{tmp_path}/nba/gamelog")
    spark.range(2).write.parquet(f"{tmp_path}/nba/teamlog")
    (tmp_path / "nba" / "players.json").write_text(json.dumps({"A": {"team": "X", "position": "G"}, "B": {"team": "Y", "position": None}}))
    found = feeds.read_bundle(spark, f"{tmp_path}/nba")
    assert (found["gamelog"].count(), found["teamlog"].count()) == (3, 2)
    assert sorted(map(tuple, found["players"].collect()), key=str) == [("A", "X", "G"), ("B", "Y", None)]
    spark.range(40).selectExpr("id", "id % 10 AS week", "if(id % 2 = 0, 'a', 'b') AS kind").write.partitionBy("kind", "week").parquet(f"{tmp_path}/weeks")
    assert sorted(r.id for r in feeds.read_weeks(spark, f"{tmp_path}/weeks", 2, 4, "a").collect()) == [2, 4, 12, 14, 22, 24, 32, 34]


def test_csv_and_retention(spark, tmp_path):
    (tmp_path / "x.csv").write_text("Player Name,Yards\nA,3\n")
    out = read_csv(spark, f"{tmp_path}/x.csv", "`Player Name` string, Yards int", "fp_")
    assert out.columns == ["fp_player_name", "fp_yards"] and tuple(out.first()) == ("A", 3)
    rows = spark.createDataFrame([("A", 5), ("A + B", 5), ("A vs. B", 5), ("B", 1)], "e string, day int")
    assert [r.e for r in retain(rows, "day", F.lit(2), "e").collect()] == ["A"]


@pytest.mark.parametrize("bad", ['{"a":1}\n{"a": 2, "b"\n{"a":3}\n', '{"a": 1\n', '{"a":1}\nx\n{"a"'])
def test_bad_ledger_lines_are_errors(spark, tmp_path, bad):
    (tmp_path / "l.jsonl").write_text(bad)
    with pytest.raises(ValueError, match="bad ledger line"):
        read_ledger(spark, f"{tmp_path}/l.jsonl", "a long").collect()


def test_ledgers_of_several_files(spark, tmp_path):
    (tmp_path / "l").mkdir()
    (tmp_path / "l" / "a.jsonl").write_text('{"a":1}\n\n{"a":2}\n')
    (tmp_path / "l" / "b.jsonl").write_text('{"a":3}\n{"a":4')
    assert sorted(r.a for r in read_ledger(spark, f"{tmp_path}/l", "a long").collect()) == [1, 2, 3]


def test_a_failed_replacement_keeps_the_old_table(spark, tmp_path):
    from sabermill.sources.tables import _swap

    path = f"{tmp_path}/t"
    replace_table(spark.range(3), path)
    with pytest.raises(Exception):
        _swap(spark, f"{tmp_path}/absent", path)
    assert spark.read.parquet(path).count() == 3
    replace_table(spark.range(2), f"{tmp_path}/c", "csv")
    replace_table(spark.range(4), f"{tmp_path}/c", "csv")
    assert spark.read.option("header", True).csv(f"{tmp_path}/c").count() == 4


def test_sinks(spark, tmp_path):
    for _ in range(2):
        feeds.flush({"odds": spark.range(3), "lines": spark.range(1)}, f"{tmp_path}/store")
    assert spark.read.parquet(f"{tmp_path}/store/odds").count() == 6
    rows = spark.createDataFrame([(1, float("inf")), (2, 0.5), (3, float("nan")), (4, 2.0)], "id long, model_ev double")
    feeds.write_snapshots({"offers": rows}, f"{tmp_path}/snap")
    got = spark.read.parquet(f"{tmp_path}/snap/offers")
    assert sorted(((r.id, r.model_ev) for r in got.collect())) == [(1, None), (2, 0.5), (3, None), (4, 2.0)]
    assert spark.read.json(f"{tmp_path}/snap/meta").first()["columns"] == "id,model_ev"
    pairs = spark.createDataFrame([("P1.O", "P2.F", 0.5), ("P1.O", "P3.F", 0.1)], "a string, b string, rho double")
    feeds.write_correlations(pairs, pairs.limit(1), f"{tmp_path}/corr")
    summary = {(r.scope, r.market_a, r.market_b): r.n for r in spark.read.parquet(f"{tmp_path}/corr/summary").collect()}
    assert summary == {("same", "O", "F"): 2, ("opposing", "O", "F"): 1}
    text = feeds.recommendation_yaml([{"stake": 1.5, "legs": ['A "x": over 2']}], "2024-01-01", 5000)
    assert text == 'date: "2024-01-01"\nbankroll: 5000.00\nentries:\n  - stake: 1.50\n    legs:\n      - "A \\"x\\": over 2"\n'
    assert feeds.recommendation_yaml([], "d", 0).endswith("entries: []\n")


def test_streams(spark, tmp_path):
    rows = spark.range(200).selectExpr("id", "id % 20 AS event", "timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, CAST(id AS INT), 0, 0) AS at", "id % 3 AS k")
    rows.repartition(4).write.parquet(f"{tmp_path}/in")
    stream = quotes.read_quotes(spark, f"{tmp_path}/in", files=2)
    for _ in range(2):  # the second run finds nothing new
        quotes.append_batches(stream, f"{tmp_path}/out", f"{tmp_path}/check", ["id"])
    assert sorted(r.id for r in spark.read.parquet(f"{tmp_path}/out").collect()) == list(range(200))
    quotes.append_batches(stream, f"{tmp_path}/out", f"{tmp_path}/check2", ["id"])  # a lost checkpoint adds no row twice
    assert spark.read.parquet(f"{tmp_path}/out").count() == 200
    counts = quotes.window_counts(stream, "at", "k", "1 day", "30 days")
    quotes.drain(counts, "window_counts_test", f"{tmp_path}/check3", "complete")
    batch = {(str(r.day), r.k): r.n for r in rows.groupBy(F.to_date("at").alias("day"), "k").agg(F.count("*").alias("n")).collect()}
    assert {(str(r.window.start)[:10], r.k): r.n for r in spark.table("window_counts_test").collect()} == batch
    events = spark.range(20).selectExpr("id AS event", "timestamp_ntz'2024-01-01 12:00:00' + make_interval(0, 0, 0, 0, 0, CAST(id * 3 AS INT), 0) AS starts")
    quotes.drain(quotes.closing_pass(stream, events, "2024-01-01 12:00:00"), "closing_test", f"{tmp_path}/check4", "append")
    assert {r.event for r in spark.table("closing_test").collect()} == {e for e in range(20) if 5 <= 3 * e <= 25}


def test_late_rows_are_dropped_behind_the_watermark(spark, tmp_path):
    got = []
    for day, n in (("2024-01-10", 2), ("2024-01-20", 1), ("2024-01-01", 5), ("2024-01-19", 4)):
        spark.createDataFrame([(pd.Timestamp(day).to_pydatetime(), 0)] * n, "at timestamp, k long").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        counts = quotes.window_counts(quotes.read_quotes(spark, f"{tmp_path}/in"), "at", "k", "1 day", "2 days")
        sink = counts.writeStream.foreachBatch(lambda batch, _: got.extend((str(r.window.start)[:10], r.n) for r in batch.collect())).outputMode("update")
        sink.option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start().awaitTermination()
    assert got == [("2024-01-10", 2), ("2024-01-20", 1), ("2024-01-19", 4)]


def test_poisson_crps_and_prices_against_brute_force(spark):
    rows = spark.createDataFrame([(2.5, 1.0), (0.3, 0.0), (40.0, 55.0), (2000.0, 1990.0)], "m double, a double")
    got = rows.select("m", "a", d.poisson_crps(F.col("m"), F.col("a")).alias("s")).collect()
    for r in got:
        cdf, pmf, want = 0.0, 0.0, 0.0
        for k in range(int(r.m + 40 * np.sqrt(r.m)) + 60):
            cdf += float(np.exp(k * np.log(r.m) - r.m - sum(np.log(np.arange(1, k + 1)))))
            want += (min(cdf, 1) - (r.a <= k)) ** 2
        assert r.s == pytest.approx(want, rel=1e-6)
    prices = spark.createDataFrame([("normal", 10.0, 0.3, 2.0), ("poisson", 4.5, 0.6, 1.0), ("gamma", 3.0, 0.5, 1.0)], "f string, l double, p double, s double")
    for r in prices.select("*", d.mean_from_price("f", "l", "p", "s").alias("m")).collect():
        assert d.under_probability(np.array([r.f]), np.array([r.l]), np.array([r.m]), np.array([r.s]))[0] == pytest.approx(r.p, abs=1e-6)
    big = d.double_poisson_cdf(np.array([3.0, 1e5]), np.array([2.5, 1e5]), np.array([1.0, 0.8]))
    assert big[0] == pytest.approx(0.757576, abs=1e-6) and big[1] == pytest.approx(0.5, abs=0.01)


def test_greedy_and_simulation_against_brute_force(spark):
    legs = {i: sorted({i % 4, i % 3, 9 + i % 2}) for i in range(12)}
    rows = spark.createDataFrame([(1, i, legs[i], float(i)) for i in range(12)], "slate long, entry long, legs array<long>, value double")
    got = [r.entry for r in search.ranked_greedy(rows, "slate", "entry", "legs", "value").orderBy("rank").collect()]
    assert got[0] == 11 and got == sorted(got, reverse=True) and len(got) < 12
    runs = spark.createDataFrame([(1, day, 0.6, 1.0) for day in range(50)], "run long, day int, prob double, payout double")
    a, b = (sorted(map(tuple, search.simulate(runs, "run", "day", "prob", "payout").collect())) for _ in range(2))
    assert a and a == b


def test_platt_recovers_a_logistic(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=6000)
    y = (rng.random(6000) < 1 / (1 + np.exp(-(1.7 * x - 0.4)))).astype(int)
    rows = spark.createDataFrame([(float(a), int(b)) for a, b in zip(x, y)], "x double, y int")
    a, b = calibration.platt(rows, "x", "y")
    assert a == pytest.approx(1.7, abs=0.15) and b == pytest.approx(-0.4, abs=0.1)
    assert calibration.platt(rows.where("false"), "x", "y") == (1.0, 0.0)


def test_isotonic_against_pooling(spark):
    rng = np.random.default_rng(2)
    y, w = rng.random(25), rng.integers(1, 6, 25)
    blocks = []
    for v, n in zip(y, w):
        blocks.append([v * n, n, 1])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] > blocks[-1][0] / blocks[-1][1]:
            s, n2, m = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + n2, blocks[-1][2] + m]
    want = [s / n for s, n, m in blocks for _ in range(m)]
    rows = spark.createDataFrame([(i, float(v), int(n)) for i, (v, n) in enumerate(zip(y, w))], "x long, y double, n long")
    got = [r.fitted for r in calibration.isotonic(rows, "x", "y", "n").orderBy("x").collect()]
    assert got == pytest.approx(want)
