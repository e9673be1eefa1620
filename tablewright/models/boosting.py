"""Adaptive boosting over weighted Spark decision trees."""

from __future__ import annotations

import math

from pyspark.ml import Estimator, Model
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import Column, DataFrame, functions as F

from tablewright.models.features import FEATURES, LABEL, PREDICTION, SCORES, argmax
from tablewright.models.saving import Saved
from tablewright.session import settle

WEIGHT = "_weight"
SETTLE_EVERY = 5    # rounds after which the row weights are written out and the plan starts afresh
TREE_COLUMNS = ("rawPrediction", "probability", PREDICTION)


def predict_into(df: DataFrame, tree: Model, name: str) -> DataFrame:
    """The tree's prediction as a column of its own."""
    return tree.transform(df.drop(*TREE_COLUMNS)).withColumnRenamed(PREDICTION, name).drop(*TREE_COLUMNS)


class VotedClasses(Saved, Model):
    def __init__(self, trees: list[Model], votes: list[float], classes: int):
        super().__init__()
        self.trees, self.votes, self.classes = trees, votes, classes

    def _transform(self, df: DataFrame) -> DataFrame:
        names = df.columns
        for i, tree in enumerate(self.trees):
            df = predict_into(df, tree, f"_vote_{i}")
        total = sum(self.votes)

        def share(c: int) -> Column:
            cast = [F.when(F.col(f"_vote_{i}") == c, F.lit(v / total)).otherwise(0.0) for i, v in enumerate(self.votes)]
            return sum(cast[1:], cast[0])

        scored = df.select(*names, F.array(*(share(c) for c in range(self.classes))).alias(SCORES))
        return scored.withColumn(PREDICTION, argmax(F.col(SCORES)).cast("double"))


class AdaBoostClassifier(Saved, Estimator):
    """SAMME (Zhu and others, 2009): each round fits a shallow tree and raises the weight of its misses."""

    def __init__(self, rounds: int = 50, depth: int = 1, rate: float = 1.0, seed: int = 123):
        super().__init__()
        self.rounds, self.depth, self.rate, self.seed = rounds, depth, rate, seed

    def _fit(self, df: DataFrame) -> Model:
        rows = settle(df.select(FEATURES, LABEL).withColumn(WEIGHT, F.lit(1.0)))
        classes = int(rows.agg(F.max(LABEL)).first()[0]) + 1
        trees, votes = [], []
        for i in range(self.rounds):
            tree = DecisionTreeClassifier(maxDepth=self.depth, weightCol=WEIGHT, seed=self.seed + i).fit(rows)
            missed = (F.col("_said") != F.col(LABEL)).cast("double")
            judged = predict_into(rows, tree, "_said")
            sums = judged.agg(F.sum(F.col(WEIGHT) * missed).alias("wrong"), F.sum(WEIGHT).alias("all")).first()
            error = sums["wrong"] / sums["all"]
            if error <= 0:
                return VotedClasses([tree], [1.0], classes)
            vote = self.rate * (math.log((1 - error) / error) + math.log(max(classes - 1, 1)))
            if vote <= 0:
                break
            trees.append(tree)
            votes.append(vote)
            # weights are rescaled to mean 1 so that they stay in range over many rounds
            level = 1 + error * (math.exp(vote) - 1)
            rows = judged.withColumn(WEIGHT, F.col(WEIGHT) * F.exp(missed * vote) / level).drop("_said")
            rows = settle(rows) if (i + 1) % SETTLE_EVERY == 0 else rows
        return VotedClasses(trees or [tree], votes or [1.0], classes)


class MedianOfTrees(Saved, Model):
    """The weighted median of the trees' predictions."""

    def __init__(self, trees: list[Model], votes: list[float]):
        super().__init__()
        self.trees, self.votes = trees, votes

    def _transform(self, df: DataFrame) -> DataFrame:
        names = df.columns
        for i, tree in enumerate(self.trees):
            df = predict_into(df, tree, f"_vote_{i}")
        half = sum(self.votes) / 2
        said = F.array_sort(F.array(*(F.struct(F.col(f"_vote_{i}").alias("p"), F.lit(float(v)).alias("v"))
                                      for i, v in enumerate(self.votes))))
        start = F.struct(F.lit(0.0).alias("sum"), F.lit(None).cast("double").alias("median"))

        def step(state: Column, vote: Column) -> Column:
            total = state["sum"] + vote["v"]
            return F.struct(total.alias("sum"), F.coalesce(state["median"], F.when(total >= half, vote["p"]))
                            .alias("median"))

        return df.withColumn(PREDICTION, F.aggregate(said, start, step)["median"]).select(*names, PREDICTION)


class AdaBoostRegressor(Saved, Estimator):
    """AdaBoost.R2 with linear loss (Drucker, 1997), on row weights."""

    def __init__(self, rounds: int = 50, depth: int = 3, rate: float = 1.0, seed: int = 123):
        super().__init__()
        self.rounds, self.depth, self.rate, self.seed = rounds, depth, rate, seed

    def _fit(self, df: DataFrame) -> Model:
        rows = settle(df.select(FEATURES, LABEL).withColumn(WEIGHT, F.lit(1.0)))
        trees, votes = [], []
        for i in range(self.rounds):
            tree = DecisionTreeRegressor(maxDepth=self.depth, weightCol=WEIGHT, seed=self.seed + i).fit(rows)
            judged = predict_into(rows, tree, "_said")
            error = F.abs(F.col("_said") - F.col(LABEL))
            sums = judged.agg(F.max(error).alias("worst"), F.sum(F.col(WEIGHT) * error).alias("loss"),
                              F.sum(WEIGHT).alias("all")).first()
            if not sums["worst"]:
                return MedianOfTrees([tree], [1.0])
            loss = sums["loss"] / sums["worst"] / sums["all"]
            if loss >= 0.5:
                break
            beta = max(loss, 1e-12) / (1 - loss)
            trees.append(tree)
            votes.append(self.rate * math.log(1 / beta))
            factor = F.pow(F.lit(beta), self.rate * (1 - error / sums["worst"]))
            rows = judged.withColumn(WEIGHT, F.col(WEIGHT) * factor / math.sqrt(beta)).drop("_said")
            rows = settle(rows) if (i + 1) % SETTLE_EVERY == 0 else rows
        return MedianOfTrees(trees or [tree], votes or [1.0])
