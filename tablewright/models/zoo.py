"""The compared models by their short names."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml import Estimator
from pyspark.ml import classification as c, regression as r

from tablewright.models import ensembles
from tablewright.models.algebra import (BayesianRidge, LinearDiscriminant, MatchingPursuit, QuadraticDiscriminant,
                                        RidgeClassifier)
from tablewright.models.boosting import AdaBoostClassifier, AdaBoostRegressor
from tablewright.models.histogram import HistogramBoosting
from tablewright.models.linear import LinearNet
from tablewright.models.neighbours import NeighbourEstimator
from tablewright.models.simple import MajorityClass, MeanTarget
from tablewright.models.trees import ExtraTrees
from tablewright.schema import CLASSIFICATION, check_task

SEED = 123
PENALTY = 0.01     # of ridge, lasso and elastic net, for standardized features
Maker = Callable[[int, str | None], Estimator]


@dataclass(frozen=True)
class Sizes:
    """How large the iterative models get. Defaults are those of the study's libraries, but for a bound on the depth of trees."""

    trees: int = 100          # of a forest
    depth: int = 10           # of forests and single trees, which the libraries leave open
    rounds: int = 100         # of gradient boosting
    boosted_depth: int = 3
    leaves: int = 31          # of a tree of histogram boosting
    adaptive: int = 50        # rounds of adaptive boosting
    steps: int = 100          # of solvers


FULL = Sizes()


def per_class(binary: Callable[[], Estimator]) -> Maker:
    """A two-class learner as it is for two classes, one against the rest above."""
    return lambda classes, key: binary() if classes <= 2 else c.OneVsRest(classifier=binary())


def fixed(build: Callable[[], Estimator]) -> Maker:
    return lambda classes, key: build()


def classifiers(sizes: Sizes = FULL) -> dict[str, Maker]:
    """"unbagged" is a forest on the full table with random features and the best thresholds; "et" has random thresholds too."""
    forest = {"numTrees": sizes.trees, "maxDepth": sizes.depth, "featureSubsetStrategy": "sqrt", "seed": SEED}
    return {
        "lr": fixed(lambda: c.LogisticRegression(maxIter=sizes.steps)),
        "ridge": fixed(RidgeClassifier),
        "lda": fixed(LinearDiscriminant),
        "qda": fixed(QuadraticDiscriminant),
        "nb": fixed(lambda: c.NaiveBayes(modelType="gaussian")),
        "svm": per_class(lambda: c.LinearSVC(maxIter=sizes.steps, standardization=True)),
        "dt": fixed(lambda: c.DecisionTreeClassifier(maxDepth=sizes.depth, seed=SEED)),
        "rf": fixed(lambda: ensembles.RandomForestClassifier(bootstrap=True, **forest)),
        "unbagged": fixed(lambda: ensembles.RandomForestClassifier(bootstrap=False, **forest)),
        "et": fixed(lambda: ExtraTrees(True, sizes.trees, sizes.depth, seed=SEED)),
        "gbt": per_class(lambda: ensembles.GBTClassifier(maxIter=sizes.rounds, maxDepth=sizes.boosted_depth, seed=SEED)),
        "hgb": fixed(lambda: HistogramBoosting(True, sizes.rounds, sizes.leaves)),
        "ada": fixed(lambda: AdaBoostClassifier(rounds=sizes.adaptive)),
        "knn": lambda classes, key: NeighbourEstimator(id_column=key),
        "dummy": fixed(MajorityClass),
    }


def regressors(sizes: Sizes = FULL) -> dict[str, Maker]:
    forest = {"numTrees": sizes.trees, "maxDepth": sizes.depth, "featureSubsetStrategy": "onethird", "seed": SEED}
    return {
        "linear": fixed(lambda: r.LinearRegression(solver="normal")),
        "ridge": fixed(lambda: LinearNet(PENALTY, 0.0)),
        "lasso": fixed(lambda: LinearNet(PENALTY, 1.0)),
        "enet": fixed(lambda: LinearNet(PENALTY, 0.5)),
        "huber": fixed(lambda: r.LinearRegression(loss="huber", maxIter=sizes.steps)),
        "bayes_ridge": fixed(BayesianRidge),
        "omp": fixed(MatchingPursuit),
        "dt": fixed(lambda: r.DecisionTreeRegressor(maxDepth=sizes.depth, seed=SEED)),
        "rf": fixed(lambda: ensembles.RandomForestRegressor(bootstrap=True, **forest)),
        "unbagged": fixed(lambda: ensembles.RandomForestRegressor(bootstrap=False, **forest)),
        "et": fixed(lambda: ExtraTrees(False, sizes.trees, sizes.depth, seed=SEED)),
        "gbt": fixed(lambda: ensembles.GBTRegressor(maxIter=sizes.rounds, maxDepth=sizes.boosted_depth, seed=SEED)),
        "hgb": fixed(lambda: HistogramBoosting(False, sizes.rounds, sizes.leaves)),
        "ada": fixed(lambda: AdaBoostRegressor(rounds=sizes.adaptive)),
        "knn": lambda classes, key: NeighbourEstimator(classify=False, id_column=key),
        "dummy": fixed(MeanTarget),
    }


CLASSIFIERS, REGRESSORS = classifiers(), regressors()


def models_for(task: str, sizes: Sizes = FULL) -> dict[str, Maker]:
    return classifiers(sizes) if check_task(task) == CLASSIFICATION else regressors(sizes)
