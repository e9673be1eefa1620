"""Grown forests, histogram boosting and linear models from sums, against plain numpy."""

from __future__ import annotations

from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablewright.models import linear
from tablewright.models.algebra import Moments, Regression, class_moments
from tablewright.models.features import LABEL, PREDICTION, assemble
from tablewright.models.histogram import HistogramBoosting
from tablewright.models.linear import Folds, LinearNet, LinearSearch, choices
from tablewright.models.trees import ExtraTrees
from tablewright.session import SHUFFLE_CLEANUP, settle

DRAW = np.random.default_rng(7)
X = np.column_stack([DRAW.normal(size=600), DRAW.integers(0, 9, 600), DRAW.normal(size=600).round(1), np.ones(600)])
NUMBER = np.where(X[:, 0] > 0.3, 5.0, -1.0) + X[:, 1] + 0.1 * DRAW.normal(size=600)
CLASS = np.digitize(X[:, 1] + 0.5 * X[:, 2], [2.5, 5.5])


def frame(spark, y, x=X, parts=3, keep=None):
    names = [f"x{i}" for i in range(x.shape[1])]
    data = pd.DataFrame(x, columns=names).assign(y=y, fold=np.arange(len(x)) % 4)
    return assemble(spark.createDataFrame(data).repartition(parts), names, "y", ["fold"])


def said(model, df):
    rows = model.transform(df).select(LABEL, PREDICTION).toPandas()
    return rows[LABEL].to_numpy(), rows[PREDICTION].to_numpy()


def test_thresholds_lie_within_their_nodes(spark):
    nodes, _ = ExtraTrees(trees=4, depth=5).grow(frame(spark, CLASS))
    for tree in range(4):
        rows_of = {tree: np.arange(len(X))}
        for at in [n for n in range(len(nodes.feature)) if nodes.tree[n] == tree]:
            mine = rows_of[at]
            assert nodes.value[at].tolist() == np.bincount(CLASS[mine], minlength=3).tolist()
            if nodes.feature[at] >= 0:
                values = X[mine, nodes.feature[at]]
                assert values.min() <= nodes.threshold[at] < values.max()
                goes = values <= nodes.threshold[at]
                rows_of[nodes.left[at]], rows_of[nodes.left[at] + 1] = mine[goes], mine[~goes]
    assert not (nodes.feature == 3).any()          # never the constant one


def test_forests_do_not_depend_on_the_layout(spark):
    one, _ = ExtraTrees(trees=3, depth=4).grow(frame(spark, CLASS, parts=1))
    two, _ = ExtraTrees(trees=3, depth=4).grow(frame(spark, CLASS, parts=7))
    for name in ("feature", "threshold", "left", "tree", "place", "value"):
        assert (getattr(one, name) == getattr(two, name)).all()


def test_forests_learn_classes_and_numbers(spark):
    y, found = said(ExtraTrees(trees=15, depth=9).fit(frame(spark, CLASS)), frame(spark, CLASS))
    assert (y == found).mean() > 0.95
    y, found = said(ExtraTrees(False, trees=15, depth=9).fit(frame(spark, NUMBER)), frame(spark, NUMBER))
    assert 1 - ((y - found) ** 2).mean() / y.var() > 0.97
    y, found = said(ExtraTrees(False, trees=2).fit(frame(spark, np.ones(600))), frame(spark, np.ones(600)))
    assert (found == 1).all()


def best_first(x, slope, curvature, leaves, min_rows):
    """Leaf by leaf with every split looked up: (rows, value) of the leaves."""
    def best(rows):
        found, whole = (0.0, None), slope[rows].sum() ** 2 / curvature[rows].sum()
        for j in range(x.shape[1]):
            for cut in np.unique(x[rows, j])[:-1]:
                goes = x[rows, j] <= cut
                if min(goes.sum(), (~goes).sum()) < min_rows:
                    continue
                sides = [rows[goes], rows[~goes]]
                gain = sum(slope[s].sum() ** 2 / curvature[s].sum() for s in sides) - whole
                if gain > found[0] + 1e-9:
                    found = gain, sides
        return found

    ends = [(np.arange(len(x)), best(np.arange(len(x))))]
    while len(ends) < leaves and max(e[1][0] for e in ends) > 1e-9:
        at = max(range(len(ends)), key=lambda n: ends[n][1][0])
        ends[at:at + 1] = [(side, best(side)) for side in ends[at][1][1]]
    return {tuple(sorted(rows)): -0.1 * slope[rows].sum() / curvature[rows].sum() for rows, _ in ends}


@pytest.mark.parametrize("leaves", [2, 5, 12])
def test_trees_grow_leaf_by_leaf(spark, leaves):
    x = np.column_stack([X[:, 1], X[:, 2]])
    model = HistogramBoosting(False, rounds=1, leaves=leaves, min_rows=10).fit(frame(spark, NUMBER, x))
    [[tree]] = model.rounds
    from tablewright.models.histogram import binned
    at = tree.walk(binned(x, model.edges))
    found = {tuple(np.flatnonzero(at == n)): tree.value[n] for n in np.unique(at)}
    want = best_first(x, NUMBER.mean() - NUMBER, np.ones(600), leaves, 10)
    assert set(found) == set(want) and all(found[k] == pytest.approx(want[k]) for k in want)


def test_boosting_learns_three_classes_without_one_against_rest(spark):
    df = frame(spark, CLASS)
    model = HistogramBoosting(rounds=12, leaves=6).fit(df)
    assert model.kind == "softmax" and all(len(trees) == 3 for trees in model.rounds)
    y, found = said(model, df)
    assert (y == found).mean() > 0.95
    scores = model.transform(df).select("scores").toPandas()["scores"]
    assert all(sum(s) == pytest.approx(1) for s in scores)


def test_boosting_of_two_classes_numbers_and_many_rounds(spark):
    df = frame(spark, (CLASS > 0).astype(int))
    model = HistogramBoosting(rounds=12, leaves=5).fit(df)       # over the rounds after which scores are settled
    y, found = said(model, df)
    assert model.kind == "logistic" and len(model.rounds) == 12 and (y == found).mean() > 0.97
    scores = np.tile(model.start, (600, 1))
    assert model.raw(X).shape == scores.shape
    y, found = said(HistogramBoosting(False, rounds=12, rate=0.5).fit(frame(spark, NUMBER)), frame(spark, NUMBER))
    assert 1 - ((y - found) ** 2).mean() / y.var() > 0.97


def test_boosting_ends_where_nothing_splits(spark):
    model = HistogramBoosting(False, rounds=5).fit(frame(spark, np.ones(600)))
    assert model.rounds == [] and (said(model, frame(spark, np.ones(600)))[1] == 1).all()
    with pytest.raises(ValueError):
        HistogramBoosting().fit(frame(spark, np.full(600, 2)))


def least_squares(x, y, penalty):
    x, y = x - x.mean(axis=0), y - y.mean()
    return np.linalg.solve(x.T @ x / len(y) + penalty * np.eye(x.shape[1]), x.T @ y / len(y))


def test_ridge_lasso_and_net(spark):
    df, x = frame(spark, NUMBER, X[:, :3]), X[:, :3]
    assert LinearNet(0.3, 0.0).fit(df).weights == pytest.approx(least_squares(x, NUMBER, 0.3))
    for penalty, share in ((0.2, 1.0), (0.2, 0.5), (5.0, 1.0), (1e-4, 1.0)):
        model = LinearNet(penalty, share).fit(df)
        error = NUMBER - x @ model.weights - model.offset
        pull = x.T @ error / len(x) - penalty * (1 - share) * model.weights
        assert error.mean() == pytest.approx(0, abs=1e-9)
        for p, w in zip(pull, model.weights):        # the conditions of the minimum
            assert p == pytest.approx(penalty * share * np.sign(w), abs=1e-6) if w else abs(p) <= penalty * share + 1e-9


def test_folds_from_one_scan_are_those_of_separate_fits(spark):
    x, fold = X[:, :3], np.arange(600) % 4
    found = choices(Folds.of(frame(spark, NUMBER, x), "fold"), [0.1, 1.0], [0.0, 1.0])
    assert len(found) == 16
    for c in found:
        train, held = fold != c.fold, fold == c.fold
        if c.share == 0:
            assert c.weights == pytest.approx(least_squares(x[train], NUMBER[train], c.penalty).tolist())
        assert c.mse == pytest.approx(((NUMBER[held] - x[held] @ c.weights - c.offset) ** 2).mean())
    model = LinearSearch("fold", [0.001, 50.0]).fit(frame(spark, NUMBER, x))
    assert model.penalty == 0.001
    with pytest.raises(ValueError):
        LinearSearch("fold", [1.0]).fit(frame(spark, NUMBER, x).filter("fold = 0"))


def test_one_scan_in_the_plan(spark):
    from tablewright.models.algebra import cross_products
    plan = cross_products(frame(spark, NUMBER), with_label=True, by="fold")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInPandas") == 1


def test_sums_far_from_zero_keep_their_digits(spark):
    far = X[:, :3] + 1e8
    df = frame(spark, NUMBER + 1e7, far)
    assert LinearNet(0.0, 0.0).fit(df).weights == pytest.approx(least_squares(X[:, :3], NUMBER, 0), rel=1e-4)
    sums = Regression.of(df)
    assert sums.xx == pytest.approx(np.cov(X[:, :3].T, bias=True) * 600, rel=1e-5, abs=1e-3)
    assert class_moments(frame(spark, CLASS, far))[0].mean == pytest.approx(far[CLASS == 0].mean(axis=0))
    assert Moments.of(np.array([[2.0, 4.0], [4.0, 10.0]])).scatter == pytest.approx(np.array([[2.0]]))


def test_empty_tables_are_refused(spark):
    empty = frame(spark, NUMBER).limit(0)
    for estimator in (ExtraTrees(), HistogramBoosting(), LinearNet()):
        with pytest.raises(ValueError):
            estimator.fit(empty)


def test_shrinking():
    assert [linear.shrink(v, 1.0) for v in (3.0, -3.0, 0.5)] == [2.0, -2.0, 0.0]


@pytest.mark.parametrize("before", [None, "false", "true"])
def test_settling_on_threads_leaves_the_session_as_it_was(spark, before):
    own = spark.newSession()
    if before is None:
        own.conf.unset(SHUFFLE_CLEANUP)
    else:
        own.conf.set(SHUFFLE_CLEANUP, before)
    said = own.conf.get(SHUFFLE_CLEANUP)
    with ThreadPool(4) as pool:
        sizes = pool.map(lambda n: settle(own.range(n).groupBy((F.col("id") % 7).alias("k")).count()).count(), range(50, 66))
    assert sizes == [7] * 16
    assert own.conf.get(SHUFFLE_CLEANUP) == said
