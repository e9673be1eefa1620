"""Metrics, results tables, sources and experiments."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from tablewright.operators.metrics import classification_metrics, regression_metrics
from tablewright.operators.results import (best_scenario, empty_results, long_results, report_text, results_table,
                                           scenario_delta)
from tablewright.plans import automl
from tablewright.plans.experiment import Experiment, run_folder
from tablewright.plans.scenario import STEPS, ScenarioSettings, plain, prepare, scenario_matrix, scenario_names, write_matrix
from tablewright.session import checkpoint_root
from tablewright.sources.pairs import TablePair, discover_pairs, read_pair, write_pair
from tablewright.sources.registry import Layout, registry
from tablewright.sources.store import read_scenario, read_scenarios, scenario_counts


def test_classification_fixture(spark):
    df = spark.createDataFrame(list(zip([0, 1, 0, 1, 1], [0, 1, 1, 1, 0])), "y int, p int").withColumn("g", F.lit("e"))
    row = classification_metrics(df, "y", "p", ["g"], agreement=True).first()
    for name in ("accuracy", "precision", "recall", "f1"):
        assert row[name] == pytest.approx(0.6)
    assert row["kappa"] == pytest.approx((0.6 - 0.52) / 0.48) and row["mcc"] == pytest.approx(1 / 6)


def test_regression_fixture(spark):
    df = spark.createDataFrame(list(zip([1.5, 2.0, 3.0, 4.0, 5.0], [1.7, 2.1, 2.9, 4.2, 4.8])), "y double, p double")
    row = regression_metrics(df.withColumn("g", F.lit("e")), "y", "p", ["g"], extended=True).first()
    assert row["mse"] == pytest.approx(0.028) and row["r2"] == pytest.approx(0.982927, abs=1e-6)
    constant = regression_metrics(df.select(F.lit("e").alias("g"), F.lit(1.0).alias("y"), "p"), "y", "p", ["g"]).first()
    assert constant["r2"] is None


def test_undefined_precision_counts_as_zero(spark):
    df = spark.createDataFrame([("e", "a", "a"), ("e", "b", "a")], "g string, y string, p string")
    row = classification_metrics(df, "y", "p", ["g"]).first()
    assert (row["accuracy"], row["precision"]) == (0.5, 0.25)


def test_results(spark):
    scores = spark.createDataFrame([("b", .91234, .9, .9, .9), ("a", .5, .5, .5, .9), ("c", .4, .4, .4, .1)],
                                   "scenario string, accuracy double, precision double, recall double, f1 double")
    table = results_table(long_results(scores, "classification"), "classification")
    assert {r["scenario"]: r["accuracy"] for r in table.collect()}["b"] == 0.9123
    assert tuple(best_scenario(table, "classification").first()) == ("a", "F1", 0.9)
    delta = {r["scenario"]: r["f1_delta"] for r in scenario_delta(table, "classification", "c").collect()}
    assert delta == {"a": 0.8, "b": 0.8, "c": 0.0}
    assert "best: a (F1 0.9000)" in report_text(table, "classification")
    assert report_text(empty_results(spark, "regression"), "regression") == "no results"


def orders_pair(spark):
    rows = [(i, float(i % 17) if i % 6 else None, "abc"[i % 3] if i % 5 else "?", i % 2) for i in range(240)]
    df = spark.createDataFrame(rows, "id long, x double, s string, y long")
    return TablePair(df.filter("id < 180"), df.filter("id >= 180"))


def test_csv_pairs_and_discovery(spark, tmp_path):
    pair = orders_pair(spark)
    root = str(tmp_path)
    write_pair(pair, root)
    write_pair(pair, f"{root}/02_imputed_mean")
    pair.train.toPandas().to_csv(os.path.join(root, "plain.csv"), index=False)
    os.makedirs(f"{root}/files")
    pair.train.toPandas().to_csv(f"{root}/files/train.csv", index=False)
    pair.test.toPandas().to_csv(f"{root}/files/test.csv", index=False)
    pair.train.write.option("header", True).csv(f"{root}/half/train.csv")
    found = discover_pairs(spark, root).collect()
    assert [r["path"] for r in found] == [root, f"{root}/02_imputed_mean", f"{root}/files"]
    assert [r["scenario"] for r in found][1:] == ["02_imputed_mean", "files"]
    for folder in (root, f"{root}/files"):
        back = read_pair(spark, folder)
        assert dict(back.train.dtypes)["x"] == "double"
        assert back.train.filter("s IS NULL").count() == pair.train.filter("s = '?'").count()
        assert back.train.schema == back.test.schema
    assert discover_pairs(spark, f"{root}/nothing").count() == 0
    assert run_folder(spark, f"{root}/nothing", Experiment("classification", "y")) is None


def test_registry_and_layout(spark):
    assert registry(spark).filter("task = 'regression'").count() == 2
    assert Layout("r", "regression", "bike_sharing").model(100) == "r/model/regression/bike_sharing/epochs_100"
    with pytest.raises(ValueError):
        Layout("r", "ranking", "x")


def test_matrix_and_store(spark, tmp_path):
    how = ScenarioSettings("classification", "y", ["id"], trees=10, sample=64)
    pair = orders_pair(spark)
    written = write_matrix(pair, how, str(tmp_path))
    assert written == list(STEPS)
    counts = {(r["scenario"], r["split"]): r["rows"] for r in scenario_counts(read_scenarios(spark, str(tmp_path))).collect()}
    assert len(counts) == 20
    assert counts["02_imputed_mean", "train"] == 180 and counts["01_without_NaN", "train"] == 120
    assert 169 <= counts["05_no_outliers_0.05", "train"] <= 173
    again = prepare(pair.map(lambda d: d.replace("?", None)), "05_no_outliers_0.05", how)
    stored = read_scenario(spark, str(tmp_path), "05_no_outliers_0.05", "train")
    assert sorted(r["id"] for r in again.train.collect()) == sorted(r["id"] for r in stored.collect())
    scaled = read_scenario(spark, str(tmp_path), "06_normalized", "train").agg(F.avg("x"), F.stddev_pop("x")).first()
    assert scaled[0] == pytest.approx(0, abs=1e-9) and scaled[1] == pytest.approx(1)


def test_each_split_on_its_own_and_custom_steps(spark):
    pair = orders_pair(spark).map(lambda d: d.replace("?", None))
    each = prepare(pair, "06_normalized", ScenarioSettings("classification", "y", ["id"], fit_on="each"))
    assert each.test.agg(F.avg("x")).first()[0] == pytest.approx(0, abs=1e-9)
    filled = pair.map(lambda d: d.na.drop())
    how = ScenarioSettings("classification", "y", ["id"])
    assert "02_imputed_mean" not in scenario_names(filled, how)
    mine = {"twice": plain(lambda d: d.unionByName(d))}
    assert prepare(pair, "twice", how, mine).train.count() == 360


def test_experiment_isolates_failures(spark, tmp_path):
    pair = orders_pair(spark).map(lambda d: d.drop("id").replace("?", None))
    run = Experiment("classification", "y", epochs=2, workers=1).run(
        spark, [("good", pair), ("bad", pair.map(lambda d: d.drop("y")))], str(tmp_path))
    assert [r["scenario"] for r in run.results.collect()] == ["good"]
    assert {r["scenario"]: r["status"] for r in run.status.collect()} == {"good": "ok", "bad": "failed"}
    assert run.history.count() == 2
    assert sorted(os.listdir(tmp_path)) == ["good_model", "good_preprocessor"]
    failed = Experiment("classification", "y", epochs=1).run(spark, [("bad", pair.map(lambda d: d.drop("y")))])
    assert failed.results.isEmpty() and failed.history is None


def test_experiments_over_a_folder(spark, tmp_path):
    write_pair(orders_pair(spark).map(lambda d: d.drop("id")), f"{tmp_path}/raw")
    outcome = run_folder(spark, str(tmp_path), Experiment("classification", "y", epochs=1, workers=1))
    assert [r["scenario"] for r in outcome.results.collect()] == ["raw"]


def test_checkpoints_go_where_the_session_says(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    assert named is None or checkpoint_root(spark).replace("file:", "").startswith(named.replace("file:", ""))


def test_the_pair_is_made_once_for_all_variants(spark):
    """A pair that comes from a join: no variant joins again."""
    left = spark.createDataFrame([(i, float(i % 5) if i % 4 else None, "ab"[i % 2]) for i in range(60)], "id long, x double, target string")
    right = spark.createDataFrame([(i, float(i * i % 7)) for i in range(60)], "id long, y double")
    both = left.join(right, "id")
    pair = TablePair(both.filter("id < 40"), both.filter("id >= 40"))
    how = ScenarioSettings("classification", "target", ["id"], trees=3)
    made = dict(scenario_matrix(pair, how))
    assert list(made) == list(STEPS)
    plans = {(name, split): getattr(made[name], split)._jdf.queryExecution().optimizedPlan().toString() for name in made for split in ("train", "test")}
    assert [which for which, plan in plans.items() if "Join" in plan] == []
    assert {made["02_imputed_mean"].train.count(), made["02_imputed_mean"].test.count()} == {40, 20}


def test_tables_of_one_file_are_spread_over_all_cores(spark, monkeypatch):
    """A matrix and a comparison learn much from few bytes: one file would keep one core busy."""
    cores = spark.sparkContext.defaultParallelism
    rows = spark.range(0, 3_000 * cores, 1, 1).selectExpr("id", "CAST(id % 7 AS DOUBLE) AS x", "CAST(id % 2 AS STRING) AS target")
    how = ScenarioSettings("classification", "target", ["id"], trees=3)
    made = dict(scenario_matrix(TablePair(rows, rows), how, {"plain": plain(lambda df: df)}))
    assert len(made["plain"].train.inputFiles()) >= cores
    seen = []

    def watched(inside, *rest):
        seen.append(len(inside.inputFiles()))
        raise InterruptedError

    monkeypatch.setattr(automl, "fit_iterative", watched)
    with pytest.raises(InterruptedError):
        automl.automl_prepare(rows, "classification", "target", ["id"])
    assert seen[0] >= cores
