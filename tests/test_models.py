"""Outliers, models, neighbours, the comparison and the network."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from tablewright.models import neighbours
from tablewright.models.algebra import Regression, class_moments
from tablewright.models.features import LABEL, PREDICTION, assemble
from tablewright.models.leaderboard import best_model, compare_models, fold_of
from tablewright.models import mlp
from tablewright.models.mlp import HELD, Crew, Network, NetworkClassifier, NetworkRegressor, Worker, learning_rate
from tablewright.models.neighbours import Index
from tablewright.models.network import Architecture, batch_edges, gradient, loss_and_slope, predict
from tablewright.models.zoo import Sizes, classifiers, regressors
from tablewright.operators.outliers import (category_codes, category_places, expected_length, iqr_filter, outlier_report,
                                             outlier_scores, remove_outliers, tree_samples)
from tablewright.plans.automl import analyze, automl_prepare

RNG = np.random.default_rng(42)
SMALL = Sizes(trees=10, depth=6, rounds=12, leaves=8, adaptive=6, steps=50)
CLASSIFIERS, REGRESSORS = classifiers(SMALL), regressors(SMALL)


def frame(spark, x, y):
    names = [f"x{i}" for i in range(x.shape[1])]
    data = pd.DataFrame(x, columns=names).assign(id=range(len(x)), y=y)
    return assemble(spark.createDataFrame(data), names, "y", ["id"])


@pytest.fixture(scope="module")
def classes(spark):
    x = np.vstack([RNG.normal(2, 1, (60, 4)), RNG.normal(-2, 1, (40, 4))])
    return frame(spark, x, np.repeat([0, 1], [60, 40])).cache()


@pytest.fixture(scope="module")
def line(spark):
    x = np.linspace(-5, 5, 120)
    return frame(spark, np.column_stack([x, RNG.normal(size=120)]), 2 * x + 0.1 * RNG.normal(size=120)).cache()


def right(df) -> float:
    return df.agg(F.avg((F.col(LABEL) == F.col(PREDICTION)).cast("double"))).first()[0]


def explained(df) -> float:
    error, spread = df.agg(F.avg((F.col(LABEL) - F.col(PREDICTION)) ** 2), F.var_pop(LABEL)).first()
    return 1 - error / spread


@pytest.mark.parametrize("name", list(CLASSIFIERS))
def test_classifiers_beat_the_majority(classes, name):
    share = right(CLASSIFIERS[name](2, "id").fit(classes).transform(classes))
    assert share == pytest.approx(0.6) if name == "dummy" else share > 0.9


@pytest.mark.parametrize("name", list(REGRESSORS))
def test_regressors_beat_the_mean(line, name):
    fit = explained(REGRESSORS[name](0, "id").fit(line).transform(line))
    assert fit == pytest.approx(0, abs=1e-9) if name == "dummy" else fit > 0.8


def test_three_classes(spark):
    x = np.vstack([RNG.normal(c, 0.5, (30, 2)) for c in ((0, 3), (3, 0), (-3, -3))])
    df = frame(spark, x, np.repeat([0, 1, 2], 30)).cache()
    for name in ("ridge", "lda", "qda", "svm", "gbt", "ada", "knn"):
        assert right(CLASSIFIERS[name](3, "id").fit(df).transform(df)) > 0.8, name


def test_outliers_among_texts_alone(spark):
    rows = [(i, "ab"[i % 2], "xyz"[i % 3]) for i in range(300)] + [(1000 + i, f"odd {i}", None if i else "w") for i in range(3)]
    df = spark.createDataFrame(rows, "id bigint, one string, two string")
    kept = {r["id"] for r in remove_outliers(df, 3 / 303, key=["id"]).collect()}
    assert kept == set(range(300))
    with pytest.raises(ValueError):
        outlier_scores(df.select("id"), key=["id"])


def test_samples_are_the_smallest_hashes_of_the_whole_table(spark):
    df = spark.range(20_000).select("id", (F.col("id") % 1_000).cast("double").alias("v"))
    samples = tree_samples(df, F.array("id", "v").cast("array<double>"), category_codes([]), ["id"], 20_000, 3, 64, 9)
    found = {}
    for r in samples.collect():
        found.setdefault(r["tree"], set()).add(int(r["x"][0]))
    parts = 1 << 40
    for tree in range(3):
        draws = df.select("id", F.pmod(F.xxhash64(F.lit(tree), F.lit(10), F.xxhash64(F.lit(9), "id")), F.lit(parts)).alias("draw"))
        assert found[tree] == {r["id"] for r in draws.orderBy("draw").limit(64).collect()}


def test_categories_are_cut_in_another_order_by_each_tree():
    codes = np.arange(-50, 50)
    places = [category_places(codes, tree, 123) for tree in range(3)]
    assert all(0 <= p.min() and p.max() < 1 and len(set(p)) == 100 and 0.4 < p.mean() < 0.6 for p in places)
    assert not (np.argsort(places[0]) == np.argsort(places[1])).all()


def test_sums_match_numpy(classes, line):
    rows = classes.collect()
    for c, m in class_moments(classes).items():
        x = np.array([r["features"].toArray() for r in rows if r[LABEL] == c])
        assert m.count == len(x)
        assert m.mean == pytest.approx(x.mean(axis=0)) and m.scatter == pytest.approx(np.cov(x.T, ddof=0) * len(x))
    rows = line.collect()
    x, y = np.array([r["features"].toArray() for r in rows]), np.array([r[LABEL] for r in rows])
    sums = Regression.of(line)
    assert sums.xy == pytest.approx(((x - x.mean(0)) * (y - y.mean())[:, None]).sum(0))


def brute(points, asked, k):
    return {tuple(q): sorted((float(np.sqrt(sum((a - b) ** 2 for a, b in zip(p, q)))), i) for i, p in points)[:k] for q in asked}


@pytest.mark.parametrize("chunk,cell", [(20_000, 4_000), (7, 10)])
def test_neighbours_match_brute_force(spark, monkeypatch, chunk, cell):
    monkeypatch.setattr(neighbours, "CHUNK", chunk)
    monkeypatch.setattr(neighbours, "CELL_POINTS", cell)
    x = np.round(RNG.normal(size=(150, 3)), 2)
    x[:50] = x[0]                                             # a third of the points are the same
    asked = np.vstack([np.round(RNG.normal(size=(40, 3)) * 1.5, 2), x[:2], [[9.0, 9.0, 9.0]]])
    points = [(i, [float(v) for v in p]) for i, p in enumerate(x)]
    train = spark.createDataFrame([(p, i, float(i % 2)) for i, p in points], "x array<double>, id long, label double")
    queries = spark.createDataFrame([([float(v) for v in q],) for q in asked], "x array<double>")
    for k in (1, 5):
        found = {}
        for r in Index(train, k).nearest(queries).collect():
            found.setdefault(tuple(r["x"]), []).append((r["distance"], r["id"]))
        expected = brute(points, [tuple(map(float, q)) for q in asked], k)
        assert set(found) == set(expected)
        for q, hits in expected.items():
            assert [i for _, i in sorted(found[q])] == [i for _, i in hits]
            assert [d for d, _ in sorted(found[q])] == pytest.approx([d for d, _ in hits])


def test_forest_finds_planted_outliers(spark):
    rows = [(i, float(RNG.normal()), float(RNG.normal())) for i in range(400)] + [(1000 + i, 12.0 + i, -12.0) for i in range(4)]
    df = spark.createDataFrame(rows, "id long, x double, y double").repartition(5)
    left = remove_outliers(df, 0.01, key=["id"], trees=30)
    ids = {r["id"] for r in left.collect()}
    assert len(ids) == 404 - 5 or len(ids) == 404 - 4
    assert not ids & {1000, 1001, 1002, 1003}
    again = remove_outliers(df.repartition(3), 0.01, key=["id"], trees=30)
    assert {r["id"] for r in again.collect()} == ids
    report = outlier_report(df, [0.01, 0.05], key=["id"], trees=30).collect()
    assert [r["removed_rows"] for r in report] == [5, 21]
    scores = [r[0] for r in outlier_scores(df, key=["id"], trees=10).select("_outlier_score").collect()]
    assert 0 < min(scores) and max(scores) <= 1


def test_expected_length():
    assert expected_length(1) == 0 and expected_length(2) == 1
    assert expected_length(256) == pytest.approx(10.2448, abs=1e-3)


def test_iqr(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 2, 3, 4, 5, 100]] + [(None,)], "x double")
    assert [r["x"] for r in iqr_filter(df, ["x"]).collect()] == [1, 2, 3, 4, 5, None]


def test_leaderboard(classes, line):
    board = compare_models(classes, "classification", ["id"], {k: CLASSIFIERS[k] for k in ("lr", "lda", "dummy")}, folds=3)
    rows = {r["model"]: r for r in board.collect()}
    assert best_model(board) in ("lr", "lda") and rows["dummy"]["auc"] == 0.5 and rows["lda"]["auc"] > 0.95
    assert rows["dummy"]["kappa"] == 0.0 and rows["lr"]["fit_seconds"] > 0
    board = compare_models(line, "regression", ["id"], {k: REGRESSORS[k] for k in ("linear", "dummy")}, 3, 1)
    assert [r["model"] for r in board.collect()] == ["linear", "dummy"]


def test_analyze(spark):
    rows = [(i, float(i % 20) if i % 7 else None, ["a", "b"][i % 2], "yes" if i % 20 > 9 else "no") for i in range(300)]
    df = spark.createDataFrame(rows, "id long, x double, s string, y string")
    makers = {k: CLASSIFIERS[k] for k in ("dt", "dummy")}
    board, best, _, holdout, test = analyze(df.filter("id < 240"), df.filter("id >= 240"), "classification", "y", ["id"],
                                            makers, folds=2, rounds=1)
    assert best == "dt" and test.count() == 60 and board.count() == 2
    assert {"prediction_label", "prediction_score"} <= set(holdout.columns)


def test_the_holdout_does_not_reach_the_training_share(spark):
    rows = [(i, float(i % 20) if i % 7 else None, ["a", "b"][i % 2], "yes" if i % 20 > 9 else "no") for i in range(200)]
    df = spark.createDataFrame(rows, "id long, x double, s string, y string")
    held = fold_of(["id"], 100) >= 70
    changed = df.withColumn("x", F.when(held, F.col("x") * 50).otherwise(F.col("x"))).withColumn("s", F.when(held, F.lit("c")).otherwise(F.col("s")))
    one, two = (sorted(map(repr, automl_prepare(t, "classification", "y", ["id"], rounds=1, trees=10).train.collect())) for t in (df, changed))
    assert one == two


def test_a_failing_model_is_a_row(spark):
    rows = [(i, [float(i % 20), float(i % 3)], float(i % 20 > 9) if i else 2.0) for i in range(200)]
    df = assemble(spark.createDataFrame([(i, *x, y) for i, x, y in rows], "id long, a double, b double, y double"), ["a", "b"], "y", ["id"])

    def broken(classes, key):
        raise RuntimeError("no such model")

    board = compare_models(df, "classification", ["id"], {"dummy": CLASSIFIERS["dummy"], "dt": CLASSIFIERS["dt"], "bad": broken}, folds=3)
    found = {r["model"]: r for r in board.collect()}
    assert found["dt"]["status"] == "ok" and found["dt"]["folds"] == 3
    assert found["bad"]["folds"] == 0 and "no such model" in found["bad"]["status"] and found["bad"]["accuracy"] is None


# the network -----------------------------------------------------------------------------------------


def test_architecture_sizes():
    assert Architecture(5, 2, "classification").hidden == [64, 32, 16]
    assert Architecture(100, 2, "classification").hidden == [200, 100, 50]
    net = Architecture(10, 3, "classification")
    parts = net.views(net.initial(1))
    for name, value in parts.items():
        if name[0] == "w":
            assert np.abs(value).max() <= math.sqrt(6 / sum(value.shape)) and abs(value.mean()) < 0.1
        elif name[0] in "bhm":
            assert not value.any()
    assert net.info()["dropout_rates"] == [0.3, 0.2, 0.1]


@pytest.mark.parametrize("task,outputs", [("classification", 3), ("regression", 1)])
def test_slopes_match_differences(task, outputs):
    net = Architecture(3, outputs, task, hidden=[6, 5, 4])
    vector, random = net.initial(7), np.random.default_rng(1)
    x = random.normal(size=(12, 3))
    y = random.integers(0, outputs, 12).astype(float) if task == "classification" else random.normal(size=12)
    _, _, slopes = gradient(net, vector.copy(), x, y, None)
    for place in random.choice(net.trained_size(), 25, replace=False):
        up, down = vector.copy(), vector.copy()
        up[place] += 1e-6
        down[place] -= 1e-6
        rise = (gradient(net, up, x, y, None)[0] - gradient(net, down, x, y, None)[0]) / 2e-6
        assert slopes[place] == pytest.approx(rise, abs=1e-5)
    frozen = vector.copy()
    predict(net, frozen, x)
    assert (frozen == vector).all()
    assert loss_and_slope(net, predict(net, vector, x), y)[0] >= 0


def test_batches_and_rate():
    assert batch_edges(10, 4) == [(0, 4), (4, 8), (8, 10)]
    assert batch_edges(9, 4) == [(0, 4), (4, 9)]
    assert batch_edges(1, 4) == [(0, 1)]
    assert [learning_rate(e) for e in (0, 29, 30)] == pytest.approx([1e-3, 1e-3, 1e-4])


def test_network_classifier(spark, classes, tmp_path):
    model = NetworkClassifier(epochs=8, batch=16, workers=1).fit(classes)
    history = model.history(spark, "s").orderBy("epoch").collect()
    assert len(history) == 8 and history[-1]["loss"] < history[0]["loss"] and history[-1]["accuracy"] > 50
    assert right(model.transform(classes)) > 0.9
    again = NetworkClassifier(epochs=8, batch=16, workers=1).fit(classes)
    assert (again.vector == model.vector).all()
    model.save_to(spark, str(tmp_path / "net"))
    loaded = Network.load_from(spark, str(tmp_path / "net"))
    assert right(loaded.transform(classes)) == right(model.transform(classes))


@pytest.mark.parametrize("workers", [1, 3, 20])
def test_network_weights_do_not_depend_on_the_layout(classes, workers):
    rows = classes.select("features", "label").unionByName(classes.select("features", "label").limit(30))
    vectors = [NetworkClassifier(epochs=3, batch=4, workers=workers).fit(rows.repartition(parts)).vector for parts in (1, 7)]
    assert (vectors[0] == vectors[1]).all() and np.isfinite(vectors[0]).all()


def test_batches_of_a_worker_are_those_of_one_table():
    net = Architecture(3, 2, "classification")
    for rows in (1, 2, 7, 8, 9, 10, 33):
        x, y = RNG.normal(size=(rows, 3)), RNG.integers(0, 2, rows).astype(float)
        seen = []
        for cut in (1, 3, rows):
            start = net.initial(1)
            worker = Worker(net, (start, np.zeros(net.trained_size()), np.zeros(net.trained_size()), 0), 8, 0.01, np.random.default_rng(1))
            for at in range(0, rows, cut):
                worker.feed(x[at:at + cut], y[at:at + cut])
            number, state, count, losses, batches, right = worker.block(5)
            assert (number, count, batches) == (5, rows, len(batch_edges(rows, 8)))
            seen.append(state)
        assert len(set(seen)) == 1


@pytest.mark.parametrize("task,outputs", [("classification", 3), ("regression", 1)])
@pytest.mark.parametrize("sizes", [(90, 97, 64), (1, 300, 40), (HELD + 50, 7, 33)])
def test_workers_side_by_side_give_the_weights_of_each_alone(task, outputs, sizes, monkeypatch):
    """One step trains a batch of each; rows of one worker far beyond the others' do not pile up."""
    net, steps, own = Architecture(3, outputs, task), [], np.random.default_rng(3)
    parts = [(own.normal(size=(n, 3)), own.integers(0, outputs, n).astype(float) if task == "classification" else own.normal(size=n))
             for n in sizes]

    def hire(number: int) -> Worker:
        none = np.zeros(net.trained_size())
        return Worker(net, (net.initial(1), none, none, 5), 8, 0.01, np.random.default_rng([1, number]))

    alone = []
    for number, (x, y) in enumerate(parts):
        worker = hire(number)
        worker.feed(x, y)
        alone.append(worker.block(number))
    crew = Crew(hire)
    monkeypatch.setattr(mlp, "gradient", lambda *rest: steps.append(1) or gradient(*rest))
    for at in range(0, max(sizes), 35):
        crew.feed([(n, x[at:at + 35], y[at:at + 35]) for n, (x, y) in enumerate(parts) if at < len(y)])
        assert all(worker.waiting <= HELD for worker in crew.workers.values())
    assert [tuple(row) for row in crew.blocks().itertuples(index=False)] == alone
    batches = sum(block[4] for block in alone)
    assert len(steps) < batches * 0.6 if min(sizes) > 50 else len(steps) <= batches


def test_tasks_train_several_workers_at_once(spark):
    """Workers beyond the cores share tasks, and their weights are those of a task each."""
    rows = [(Vectors.dense(float(i % 7), float(i)), float(i % 2)) for i in range(900)]
    data, vectors = spark.createDataFrame(rows, ["features", "label"]), []
    for side in (1, 8):
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(mlp, "SIDE", side)
            vectors.append(NetworkClassifier(epochs=2, batch=4, workers=40).fit(data).vector)
    assert (vectors[0] == vectors[1]).all()


def test_network_workers_share_the_training(classes):
    model = NetworkClassifier(epochs=10, batch=8, workers=3).fit(classes)
    assert right(model.transform(classes)) > 0.9


def test_network_regressor(spark, line):
    """Dropout, the fixed rate and its decay leave this noisy line underfitted on so few rows: only the loss is judged."""
    model = NetworkRegressor(epochs=10, batch=16, workers=1).fit(line)
    history = model.history(spark, "s").orderBy("epoch").collect()
    assert history[-1]["loss"] < history[0]["loss"]
    assert {r["accuracy"] for r in history} == {None}


def test_network_fits_the_repeated_line(spark):
    x = np.linspace(-5, 5, 100)
    rows = frame(spark, np.column_stack([x] * 10), 2 * x + 0.1 * RNG.normal(size=100)).cache()
    model = NetworkRegressor(epochs=30, batch=8, workers=1).fit(rows)
    assert explained(model.transform(rows)) > 0.9


def test_labels_must_be_dense(spark):
    with pytest.raises(ValueError, match="without gaps"):
        NetworkClassifier(epochs=1).fit(frame(spark, np.ones((4, 2)), [0, 2, 0, 2]))


def test_every_worker_has_a_partition_of_its_own(spark):
    """Two workers in one partition are trained one after the other by one task."""
    rows = [(Vectors.dense(float(i % 7), float(i)), float(i % 2)) for i in range(400)]
    data, seen = spark.createDataFrame(rows, ["features", "label"]), []

    class Watched(NetworkClassifier):
        def run_epoch(self, data, *rest):
            seen.extend(data.groupBy(F.spark_partition_id().alias("part")).agg(F.count_distinct("worker").alias("n")).collect())
            return super().run_epoch(data, *rest)

    Watched(epochs=1, workers=9).fit(data)
    assert [r["n"] for r in seen] == [1] * 9
