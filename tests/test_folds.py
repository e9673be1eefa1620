"""Models of all folds from the same passes are those of separate fits."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablewright.models.algebra import BayesianRidge, LinearDiscriminant, MatchingPursuit, QuadraticDiscriminant, RidgeClassifier
from tablewright.models.features import PREDICTION, assemble
from tablewright.models.histogram import HistogramBoosting
from tablewright.models.leaderboard import compare_models
from tablewright.models.linear import LinearNet
from tablewright.models.simple import MajorityClass, MeanTarget
from tablewright.models.trees import ExtraTrees
from tablewright.models.zoo import Sizes, classifiers, regressors
from tablewright.queries import scenarios

RNG = np.random.default_rng(3)
X = RNG.normal(size=(150, 3))
FOLD = np.arange(150) % 3
CLASS = (X[:, 0] + X[:, 1] > 0).astype(int) + (X[:, 2] > 0.8)
NUMBER = 3 * X[:, 0] - X[:, 1] ** 2


def frame(spark, y):
    data = pd.DataFrame(X, columns=list("abc")).assign(id=range(150), fold=FOLD, y=y)
    return assemble(spark.createDataFrame(data), list("abc"), "y", ["id", "fold"]).repartition(2).cache()


CASES = [
    (ExtraTrees(True, 5, 4), CLASS), (ExtraTrees(False, 5, 4), NUMBER),
    (HistogramBoosting(True, 3, 4), CLASS), (HistogramBoosting(False, 11, 4, min_rows=5), NUMBER),
    (LinearDiscriminant(), CLASS), (QuadraticDiscriminant(), CLASS), (RidgeClassifier(), CLASS), (MajorityClass(), CLASS),
    (LinearNet(0.1, 0.5), NUMBER), (BayesianRidge(), NUMBER), (MatchingPursuit(), NUMBER), (MeanTarget(), NUMBER)]


@pytest.mark.parametrize("estimator, y", CASES, ids=[f"{type(e).__name__}-{n}" for n, (e, _) in enumerate(CASES)])
def test_folds_together_are_folds_alone(spark, estimator, y):
    df = frame(spark, y)
    models = estimator.fit_folds(df, "fold", [0, 1, 2])
    assert sorted(models) == [0, 1, 2]
    alone = estimator.fit(df.filter("fold <> 1"))
    one, two = (m.transform(df).orderBy("id").select(PREDICTION).toPandas()[PREDICTION] for m in (models[1], alone))
    assert one.to_numpy() == pytest.approx(two.to_numpy())


def test_a_failure_of_all_folds_leaves_each_to_itself(spark):
    class Odd(MeanTarget):
        def fit_folds(self, df, fold, names):
            raise RuntimeError("not together")

    with pytest.warns(RuntimeWarning, match="not together"):
        board = compare_models(frame(spark, NUMBER).drop("fold"), "regression", ["id"], {"odd": lambda classes, key: Odd()}, folds=2)
        assert [(r["folds"], r["status"]) for r in board.collect()] == [(2, "ok")]


def test_trees_of_forests_are_built_when_asked_for(spark):
    small = Sizes(trees=3, depth=2, rounds=2)
    for makers, y in ((classifiers(small), (CLASS > 0).astype(int)), (regressors(small), NUMBER)):
        for name in ("rf", "gbt"):
            model = makers[name](2, "id").fit(frame(spark, y))
            assert "trees" not in vars(model) and len(model.trees) == model.getNumTrees


def test_the_analysis_compares_every_classifier_in_all_folds(spark, monkeypatch):
    asked = {}

    def analyze(train, test, task, target, key, models=None, **sizes):
        asked.update(sizes, models=models)
        said = test.select(*key, F.lit(0.0).alias("label"), F.lit(0.0).alias("prediction_label"))
        return None, "lr", None, None, said

    monkeypatch.setattr(scenarios, "analyze", analyze)
    empty = spark.createDataFrame([], "o_orderkey long, o_orderstatus string")
    monkeypatch.setattr(scenarios, "orders_split", lambda spark, sf_dir: (empty, empty))
    scenarios.automl_analysis_query(spark, "")
    assert asked == {"models": None}
