"""Models of one cell, their report, and entries priced by simulation: no SQL can express them."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from sabermill.functions.odds import stable_round as r
from sabermill.operators.aggregates import exact_quantiles
from sabermill.operators.pricing import bounds_factor, copula_prices, correlation_matrix
from sabermill.plans.base import query
from sabermill.plans.calibration import PAYOUTS, uniform
from sabermill.plans.offers import legs
from sabermill.plans.profiles import _games, as_of_features
from sabermill.sources.scratch import Scratch

c = F.col
FEATURES = ["mean_3", "mean_10", "shrunk", "allowed", "games"]
BINS = 32


class Cell:
    """Boosted trees for the mean of ``label``, fitted on rows with a label; ``model`` is Spark's. Rows need no nulls among the features.

    Trees see a feature as one of at most 32 bins between its exact quantiles. Rows of equal bins are alike to them, so they are added up first, and the fit keeps sums of distinct bins instead of rows:
    a weighted row of the mean label leads to the same splits and leaves.
    """

    def __init__(self, rows: DataFrame, features: list[str], label: str, trees: int, depth: int) -> None:
        self._bins(rows.where(c(label).isNotNull()), features, label)
        self.fit(trees, depth)

    def _bins(self, rows: DataFrame, features: list[str], label: str) -> None:
        long = rows.select(F.explode(F.array(*[F.struct(F.lit(i).alias("feature"), c(n).cast("double").alias("x")) for i, n in enumerate(features)])).alias("f")).select("f.*")
        cuts = {row.feature: row for row in exact_quantiles(long, ["feature"], "x", [k / BINS for k in range(1, BINS)]).collect()}
        edges = [sorted({x for x in cuts[i][1:] if x is not None and not math.isnan(x) and math.isfinite(x)}) if i in cuts else [] for i in range(len(features))]
        self.features, self.edges = features, [e or [0.0] for e in edges]
        self.names = [f"_bin{i}" for i in range(len(features))]
        self.sums = self.binned(rows).groupBy(*self.names).agg(F.avg(c(label).cast("double")).alias("_label"), F.count("*").cast("double").alias("_weight"))

    def binned(self, rows: DataFrame) -> DataFrame:
        from pyspark.ml.feature import Bucketizer

        return Bucketizer(splitsArray=[[-math.inf, *e, math.inf] for e in self.edges], inputCols=self.features, outputCols=self.names, handleInvalid="keep").transform(rows)

    def assembled(self, rows: DataFrame) -> DataFrame:
        from pyspark.ml.feature import VectorAssembler

        return VectorAssembler(inputCols=self.names, outputCol="features").transform(rows)

    def fit(self, trees: int, depth: int) -> Cell:
        from pyspark.ml.regression import GBTRegressor

        self.model = GBTRegressor(featuresCol="features", labelCol="_label", weightCol="_weight", predictionCol="predicted", maxIter=trees, maxDepth=depth, maxBins=BINS + 1, seed=7, subsamplingRate=1.0).fit(self.assembled(self.sums))
        return self

    def transform(self, rows: DataFrame) -> DataFrame:
        return self.model.transform(self.assembled(self.binned(rows))).drop(*self.names, "features")


def trained_cell(matrix: DataFrame, features: list[str], label: str, day: str, cut: str, trees: int = 8, depth: int = 3):
    """(model, scored later rows with ``predicted``, deviation of the earlier rows' residuals): boosted trees for the mean, fitted on rows before ``cut``."""
    rows = matrix.fillna(0.0, features)
    early, late = rows.where(c(day) < F.lit(cut).cast("date")), rows.where(c(day) >= F.lit(cut).cast("date"))
    cell = Cell(early, features, label, trees, depth)
    spread = cell.transform(early).agg(F.stddev_samp(c(label) - c("predicted")).alias("sd"))
    return cell.model, cell.transform(late), spread


def _matrix(t) -> DataFrame:
    """The cell's rows, written once: fits, scores and folds read them again, and nothing is exchanged twice."""
    games = _games(t).select("player", "opponent", "day", "v")
    rows = as_of_features(games, "player", "day", "v", "opponent").withColumn("games", c("games").cast("double"))
    return Scratch(t.spark).write(rows.select("player", "day", "v", *FEATURES), "matrix")


@query("train_one_cell")
def train_cell(t):
    """One cell from matrix to scores: mean by boosted trees, dispersion from residuals, then error and bias on later rows."""
    _, scored, spread = trained_cell(_matrix(t), FEATURES, "v", "day", "1999-01-01")
    out = scored.join(F.broadcast(spread))
    return out.agg(F.count("*").alias("n"), r(F.avg(F.abs(c("v") - c("predicted"))), 3).alias("mae"), r(F.avg(c("predicted") - c("v")), 3).alias("bias"), r(F.first("sd"), 3).alias("sd"))


@query("feature_importance")
def importance(t):
    """What each feature is worth in the cell's model, in percent."""
    model, _, _ = trained_cell(_matrix(t), FEATURES, "v", "day", "1999-01-01")
    shares = model.featureImportances.toArray()
    total = float(shares.sum()) or 1.0
    return t.spark.createDataFrame([(n, round(100 * float(x) / total, 3)) for n, x in zip(FEATURES, shares)], "feature string, percent double")


@query("copula_entry_prices")
def copula(t):
    """Chance and mean payout of each game's entry of two to six legs, correlated by a stored value a pair."""
    one = F.struct("player", (0.3 + c("over") * 0.6).alias("p"), F.lit(0.03).alias("push"))
    games = legs(t).groupBy(c("okey").alias("entry")).agg(F.array_sort(F.collect_list(one)).alias("legs")).where(F.size("legs").between(2, 6))
    of = lambda field: F.transform("legs", lambda x: x[field])
    matrix = correlation_matrix(of("player"), lambda a, b: ((a * 7 + b * 7) % 41 - 20) / F.lit(50.0))
    rows = games.select("entry", of("p").alias("p"), of("push").alias("push"), matrix.alias("rho"))
    priced = copula_prices(rows, "entry", "p", "push", "rho", {(n, m): x for n, m, x in PAYOUTS})
    return priced.select("entry", r(c("win")).alias("win"), r(c("payout")).alias("payout"))


@query("bounds_fitting_factors")
def bounds(t):
    rows = t.lineitem.groupBy(c("l_partkey").alias("player")).agg(F.avg("l_quantity").alias("mean"), F.stddev_samp("l_quantity").alias("sd")).where("sd > 0")
    return rows.select("player", r(bounds_factor(c("mean"), c("sd"), F.lit(0.0), F.lit(51.0))).alias("factor"))


@query("grid_search")
def grid(t):
    """Depths of trees compared over two folds by a hash of the player; the least mean error is the choice."""
    matrix = _matrix(t).fillna(0.0, FEATURES).withColumn("fold", (uniform("player") < 0.5).cast("int"))
    found = []
    for fold in (0, 1):
        early = matrix.where((c("fold") != fold) & (c("day") < F.lit("2010-01-01").cast("date")))
        cell = None
        for depth in (1, 2):
            cell = Cell(early, FEATURES, "v", 3, depth) if cell is None else cell.fit(3, depth)
            held = cell.transform(matrix.where(c("fold") == fold))
            found.append((depth, float(held.agg(F.avg(F.abs(c("v") - c("predicted")))).first()[0] or 0.0)))
    rows = t.spark.createDataFrame(found, "depth int, error double")
    return rows.groupBy("depth").agg(r(F.avg("error"), 3).alias("error"))
