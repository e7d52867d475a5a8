import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sabermill.functions import distributions as d
from pyspark.sql import functions as F

from sabermill.functions.names import normalised
from sabermill.operators import resolution, search
from sabermill.sources.tables import read_ledger, read_parquet_safe, replace_table
from sabermill.streaming.quotes import drain, latest, read_quotes


def test_distributions():
    k = np.array([0.0, 3.0, 7.0])
    assert d.poisson_cdf(k, np.full(3, 2.5)) == pytest.approx([math.exp(-2.5), 0.757576, 0.995753], abs=1e-6)
    assert d.gamma_cdf(np.array([2.0]), np.array([3.0]), np.array([1.0])) == pytest.approx([1 - math.exp(-2 / 3)])
    assert d.negbin_cdf(np.array([0.0]), np.array([2.0]), np.array([1.0])) == pytest.approx([1 / 3])
    assert d.under_probability(np.array(["normal"]), np.array([1.0]), np.array([1.0]), np.array([2.0])) == pytest.approx([0.5])


def test_beam_and_kelly(spark):
    legs = spark.createDataFrame([(1, i, i % 3, 0.6, 2.0) for i in range(5)], "game long, leg long, player long, prob double, boost double")
    got = search.beam_search(legs, "game", "leg", "player", "prob", "boost", size=3).collect()
    assert sorted(r.legs for r in got) == [[0, 1, 2], [0, 2, 4], [1, 2, 3], [2, 3, 4]] and all(r.ev == pytest.approx(1.728) for r in got)
    bets = spark.createDataFrame([(1, i, 0.6, 1.0) for i in range(10)], "slate long, bet long, prob double, payout double")
    assert sum(r.fraction for r in search.joint_kelly(bets, "slate", "bet", "prob", "payout").collect()) == pytest.approx(0.25, abs=1e-6)


def test_sources(spark, tmp_path):
    path = f"{tmp_path}/t"
    assert read_parquet_safe(spark, path, "a long, b string", ["a"]).count() == 0
    replace_table(spark.createDataFrame([(1, "x")], "a long, b string"), path)
    replace_table(spark.read.parquet(path).union(spark.createDataFrame([(2, "y")], "a long, b string")), path)
    assert sorted(r.a for r in read_parquet_safe(spark, path, "a long, b string").collect()) == [1, 2]
    (tmp_path / "l.jsonl").write_text('{"a": 1}\n{"a": 2}\n{"a": 3')
    assert sorted(r.a for r in read_ledger(spark, f"{tmp_path}/l.jsonl", "a long").collect()) == [1, 2]


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame([(i % 5, i, float(i * 7 % 11)) for i in range(100)], "k long, t long, v double")
    rows.repartition(4).write.parquet(f"{tmp_path}/q")
    drain(latest(read_quotes(spark, f"{tmp_path}/q"), ["k"], "t", ["v"]), "latest_quotes", f"{tmp_path}/c")
    got = sorted(map(tuple, spark.table("latest_quotes").collect()))
    assert got == [(k, 95 + k, float((95 + k) * 7 % 11)) for k in range(5)]


def test_resolve_quote_cascade(spark):
    rows = [("a", 1.5, 0.4, 9.0, 1), ("a", 1.5, 0.6, 9.0, 2), ("a", 2.5, 0.5, 9.0, 3), ("b", None, 0.5, 4.0, 1), ("b", 3.5, 1.0, 8.0, 1), ("c", None, None, 5000.0, 1), ("d", 1.0, 0.5, 1.0, 1), ("d", 3.0, 0.5, 1.0, 1)]
    quotes = spark.createDataFrame(rows, "k string, line double, under_prob double, ev double, observed_at long")
    got = {r.k: (r.line, r.under, r.ev, r.books, r.source) for r in resolution.resolve_quote(quotes, "k", F.lit(1.0)).collect()}
    assert got == {"a": (1.5, 0.5, None, 2, "modal"), "b": (None, 0.5, 6.0, 0, "ev"), "c": (None, 0.5, None, 0, "neutral"), "d": (1.0, 0.5, None, 1, "modal")}


def test_bootstrap_covers_the_mean(spark):
    rows = spark.range(4000).selectExpr("id", "id % 2 AS cell", "cast(id % 100 AS double) AS x")
    for row in resolution.poisson_bootstrap(rows, ["cell"], "x", ["id"]).collect():
        assert row.low < row.mean < row.high and row.high - row.low == pytest.approx(2 * 1.96 * 28.9 / math.sqrt(2000), rel=0.3)


def test_further_families():
    mean, phi = np.array([2.5, 4.0]), np.array([1.0, 0.6])
    assert d.double_poisson_cdf(np.array([3.0, 0.0]), mean, phi)[0] == pytest.approx(0.757576, abs=1e-6)  # precision 1: Poisson
    tail = sum(1 - d.double_poisson_cdf(np.array([float(k)] * 2), mean, phi) for k in range(60))
    assert tail == pytest.approx([2.5, 4.0], abs=1e-6)
    x = np.linspace(-6, 14, 4001)
    same = lambda v: np.full(len(x), v)
    cdf = d.skew_normal_cdf(x, same(2.0), same(1.5), same(3.0))
    pdf = np.gradient(cdf, x)
    at = float((pdf * x).sum() * (x[1] - x[0]))
    assert at == pytest.approx(2.0, abs=1e-3) and float((pdf * (x - at) ** 2).sum() * (x[1] - x[0])) == pytest.approx(2.25, abs=1e-2)
    assert d.skew_normal_cdf(x, same(2.0), same(1.5), same(0.0)) == pytest.approx(d.normal_cdf(x, same(2.0), same(1.5)))


def test_names(spark):
    cases = {
        None: "", "": "", "  ": "", "Luka Don\u010di\u0107": "Luka Doncic", "Jose\u0301 A. N\u00fa\u00f1ez III": "Jose A Nunez", "d\u2019ante o\u2019NEAL jr. Jr.": "D'Ante O'Neal Jr", "BO [IL] smith (Q)": "Bo  Smith",
        "A. Jones Sr + b lee IV": "Al Jones + B Lee", "a Jones VS b Lee II": "Al Jones vs. B Lee", "x9y 3d": "X9Y 3D", "Jr": "Jr", "IIImar II": "Iiimar",
    }
    rows = spark.createDataFrame([(k, v) for k, v in cases.items()], "name string, want string")
    got = rows.select("name", "want", normalised(F.col("name"), {"A Jones": "Al Jones"}).alias("got")).collect()
    assert [(r.name, r.got) for r in got] == [(r.name, r.want) for r in got]


def test_deviation_of_exactly_the_limit_is_not_below(spark, tmp_path):
    from sabermill.operators.aggregates import deviation_below

    tie = [30, 48, 10, 10, 20, 44, 48, 39, 14, 40, 15, 37, 24, 42, 49, 18]  # deviation 14; sums in floating point stay under it
    groups = {"tie": tie, "tie_cents": [x + 0.25 for x in tie], "under": [*tie[:-1], 19], "over": [*tie[:-1], 17], "thirds": [x / 3 for x in tie], "nan": [*tie, math.nan], "huge": [1e300, -1e300], "none": [None]}
    rows = [(k, None if x is None else float(x)) for k, v in groups.items() for x in v]
    got = spark.createDataFrame(rows, "k string, v double").coalesce(1).groupBy("k").agg(deviation_below("v", 14).alias("x"), (F.stddev_pop("v") < 14).alias("plain"))
    got = {r.k: (r.x, r.plain) for r in got.collect()}
    assert got["tie"] == (False, True) and got["tie_cents"][0] is False
    assert [got[k][0] for k in ("under", "over", "thirds", "nan", "huge")] == [True, False, True, False, False] and not got["none"][0]

    from sabermill.plans.base import QUERIES
    import sabermill.plans.maintenance  # noqa: F401

    quotes = spark.createDataFrame([(1, b, float(x)) for b, x in enumerate(tie)] + [(2, b, float(x)) for b, x in enumerate(groups["under"])], "l_partkey long, l_suppkey long, l_quantity double")
    quotes.selectExpr("*", "1D AS l_extendedprice", "0D AS l_discount", "timestamp_ntz'2020-01-01' AS l_shipdate", "l_suppkey AS l_orderkey", "1 AS l_linenumber", "0D AS l_tax").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    assert {r.entity for r in QUERIES["corrupt_seed_detection"](spark, str(tmp_path)).collect()} == {2}


def test_beam_search_of_many_games_matches_one_by_one(spark, monkeypatch):
    def alone(legs, size, beam, least):
        t = sorted(legs)
        level = [((i,), x[2], x[3]) for i, x in enumerate(t)]
        for _ in range(size - 1):
            grown = [((*c, j), x * t[j][2], y * t[j][3]) for c, x, y in level for j in range(c[-1] + 1, len(t)) if t[j][1] is None or t[j][1] not in {t[k][1] for k in c}]
            level = sorted(grown, key=lambda s: (-s[1] * s[2], s[0]))[:beam]
        return {(tuple(t[i][0] for i in c), x, y, x * y) for c, x, y in level if x * y >= least}

    rng = np.random.default_rng(5)
    games = {g: [(10 * i, int(rng.integers(0, 6)) if rng.random() < 0.9 else None, float(rng.choice([0.4, 0.6, 0.7])), float(rng.choice([1.5, 2.0]))) for i in rng.permutation(int(n)).tolist()] for g, n in enumerate(rng.integers(1, 15, 60))}
    rows = [(None if g == 7 else g, *x) for g, own in games.items() for x in own]
    df = spark.createDataFrame(rows, "game long, leg long, player long, prob double, boost double")
    for size, beam in ((1, 3), (2, 5), (3, 1000), (3, 9), (4, 20)):
        got = search.beam_search(df, "game", "leg", "player", "prob", "boost", size=size, beam=beam).collect()
        assert len(got) == len({(r.game, tuple(r.legs)) for r in got})
        for g, own in games.items():
            assert {(tuple(r.legs), r.prob, r.payout, r.ev) for r in got if r.game == (None if g == 7 else g)} == alone(own, size, beam, 1.05), (g, size, beam)
    assert search.beam_search(df.where("false"), "game", "leg", "player", "prob", "boost").count() == 0
    own, who, p = np.repeat([0, 1, 2], [9, 1, 30]), rng.integers(0, 9, 40), rng.random(40)
    whole = search._grow((own, np.arange(40)[:, None], p, p), np.array([9, 10, 40]), who, p, p, 12)
    for grown in (1, 7, 50):
        monkeypatch.setattr(search, "GROWN", grown)
        parts = search._grow((own, np.arange(40)[:, None], p, p), np.array([9, 10, 40]), who, p, p, 12)
        assert all((a == b).all() for a, b in zip(search._cut(whole, 12), search._cut(parts, 12)))
    # a call of Python code for each game is what took the time
    assert "FlatMapGroupsInPandas" not in search.beam_search(df, "game", "leg", "player", "prob", "boost")._jdf.queryExecution().optimizedPlan().toString()


def test_exact_quantiles_are_percentiles_without_a_buffer_of_a_cell(spark, tmp_path):
    from sabermill.operators.aggregates import exact_quantiles
    from sabermill.operators.resolution import trim_outliers

    draw = random.Random(3)
    groups = {"many": [draw.gauss(0, 1) for _ in range(3000)], "ties": [float(draw.randrange(4)) for _ in range(500)], "far": [1e300, *map(float, range(99))], "one": [7.5], "same": [2.0] * 9, "nan": [1.0, 2.0, math.nan], "inf": [-math.inf, 1.0, 2.0, math.inf, math.inf], "none": [None, None], "holes": [None, 3.0, 1.0, 0.0, 0.0]}
    rows = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in vs], "k string, v double").repartition(5)
    at = [0.0, 0.05, 0.3, 0.5, 0.95, 1.0]
    got = {r[0]: r[1:] for r in exact_quantiles(rows, ["k"], "v", at).collect()}
    want = {r[0]: r[1:] for r in rows.groupBy("k").agg(*[F.percentile("v", F.lit(q)) for q in at]).collect()}
    assert {k: repr(v) for k, v in got.items()} == {k: repr(v) for k, v in want.items()}

    kept = trim_outliers(rows, ["k"], "v", F.col("k") == "none")
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile" not in plan
    edges = rows.groupBy("k").agg(F.percentile("v", F.lit(0.05)).alias("low"), F.percentile("v", F.lit(0.95)).alias("high"))
    plain = rows.join(edges, "k").where((F.col("k") == "none") | F.col("v").between(F.col("low") - 1e-6, F.col("high") + 1e-6)).select("k", "v")
    assert sorted(map(repr, kept.collect())) == sorted(map(repr, plain.collect())) and kept.where("k = 'none'").count() == 2


def test_double_poisson_seeks_its_location_once_and_briefly(monkeypatch):
    draw = np.random.default_rng(5)
    n = 400
    line, mean = draw.integers(1, 51, n) / 2, draw.uniform(0.5, 43, n)
    calls, exp = [], np.exp
    monkeypatch.setattr(d.np, "exp", lambda *a, **k: calls.append(1) or exp(*a, **k))
    got = d.under_probability(np.full(n, "doublepoisson", dtype=object), line, mean, np.full(n, 0.8))
    monkeypatch.undo()
    assert len(calls) < 60  # bisection took 102 for each table
    y = np.arange(400.0)
    ylogy = y * np.log(np.maximum(y, 1))
    base = ylogy - y - np.array([math.lgamma(v + 1) for v in y])
    for i in range(0, n, 13):
        lo, hi = 1e-9, 2 * mean[i] + 10
        for _ in range(60):
            mid = (lo + hi) / 2
            p = np.exp(base + 0.8 * (y * (1 + math.log(mid)) - ylogy - mid))
            p /= p.sum()
            lo, hi = (lo, mid) if p @ y > mean[i] else (mid, hi)
        want = (p[: math.ceil(line[i])].sum() + p[: math.floor(line[i]) + 1].sum()) / 2
        assert got[i] == pytest.approx(want, abs=1e-10)
    assert d.double_poisson_cdf(np.array([0.0]), np.array([1e-6]), np.array([0.3]))[0] == pytest.approx(1, abs=1e-5)
    odd = d.under_probability(np.full(3, "doublepoisson", dtype=object), np.array([2.0, np.nan, 2.0]), np.array([2.5, 2.5, np.nan]), np.full(3, 0.8))
    assert np.isnan(odd).tolist() == [False, True, True]


@pytest.fixture
def games(spark, tmp_path):
    draw = random.Random(11)
    rows = [(i, draw.randrange(25), draw.randrange(6), 1, float(draw.randrange(1, 51)), 0.01, draw.randrange(900)) for i in range(3000)]
    rows = spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_discount double, d int")
    rows.selectExpr("*", "1000D AS l_extendedprice", "cast(date_add(DATE'1997-06-01', d) AS timestamp_ntz) AS l_shipdate").repartition(3).write.parquet(f"{tmp_path}/lineitem.parquet")
    return str(tmp_path)


def _nodes(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_matrix_of_a_cell_is_written_once_and_exchanged_twice(spark, games):
    from sabermill.plans import profiles, training
    from sabermill.plans.base import Tables

    t = Tables(spark, games)
    features = profiles.as_of_features(profiles._games(t).select("player", "opponent", "day", "v"), "player", "day", "v", "opponent")
    assert "SortMergeJoin" not in _nodes(features) and "ShuffledHashJoin" not in _nodes(features)
    assert "Exchange" not in _nodes(training._matrix(t))  # fits and scores read files


def test_trees_of_sums_are_those_of_rows(spark, games):
    from pyspark.ml.regression import GBTRegressor

    from sabermill.plans import training
    from sabermill.plans.base import Tables

    matrix = training._matrix(Tables(spark, games)).fillna(0.0, training.FEATURES)
    cell = training.Cell(matrix, training.FEATURES, "v", 4, 2)
    rows = cell.assembled(cell.binned(matrix))
    plain = GBTRegressor(featuresCol="features", labelCol="v", predictionCol="predicted", maxIter=4, maxDepth=2, maxBins=training.BINS + 1, seed=7).fit(rows)
    assert cell.sums.agg(F.sum("_weight")).first()[0] == 3000
    assert plain.featureImportances.toArray() == pytest.approx(cell.model.featureImportances.toArray(), abs=1e-6)
    assert [r.predicted for r in plain.transform(rows).collect()] == pytest.approx([r.predicted for r in cell.transform(matrix).collect()], abs=1e-6)


def test_grid_writes_its_matrix_once(spark, games, monkeypatch):
    from sabermill.plans import training
    from sabermill.plans.base import QUERIES

    made, of = [], training.as_of_features
    monkeypatch.setattr(training, "as_of_features", lambda *a: made.append(of(*a)) or made[-1])
    fits, init = [], training.Cell._bins
    monkeypatch.setattr(training.Cell, "_bins", lambda self, *a: fits.append(1) or init(self, *a))
    assert sorted(r.depth for r in QUERIES["grid_search"](spark, games).collect()) == [1, 2]
    assert len(made) == 1 and len(fits) == 2  # rows are added up once a fold
    shares = QUERIES["feature_importance"](spark, games).collect()
    assert sum(r.percent for r in shares) == pytest.approx(100, abs=0.01) and len(fits) == 3
