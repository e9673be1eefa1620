"""Scenarios x network: prepare, train and score every variant, and report them side by side."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from tablewright.models.features import LABEL, PREDICTION, assemble
from tablewright.models.mlp import BATCH, EPOCHS, NetworkClassifier, NetworkRegressor
from tablewright.operators.metrics import score_predictions
from tablewright.operators.results import empty_results, long_results, metric_names, results_table
from tablewright.plans.preprocessor import TablePreprocessor
from tablewright.schema import CLASSIFICATION, check_task
from tablewright.session import settle
from tablewright.sources.pairs import TablePair, discover_pairs, read_pair

STATUS = "scenario string, status string, error string"


@dataclass
class Outcome:
    """What a run leaves: the results table, per-epoch histories, and the status of each scenario."""

    results: DataFrame
    history: DataFrame | None
    status: DataFrame


@dataclass
class Experiment:
    """Settings of a run; ``preparation`` holds options of ``TablePreprocessor``."""

    task: str
    target: str
    epochs: int = EPOCHS
    batch: int = BATCH
    workers: int | None = None
    preparation: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        check_task(self.task)

    def network(self):
        kind = NetworkClassifier if self.task == CLASSIFICATION else NetworkRegressor
        return kind(self.epochs, self.batch, workers=self.workers)

    def run_one(self, spark: SparkSession, scenario: str, pair: TablePair,
                model_folder: str | None = None) -> tuple[DataFrame, DataFrame]:
        """(scores, history) of one variant. A fresh preprocessor is fitted for each."""
        missing = [n for n, t in (("train", pair.train), ("test", pair.test)) if self.target not in t.columns]
        if missing:
            raise ValueError(f"target column {self.target!r} is not in {' and '.join(missing)}")
        fitted = TablePreprocessor(self.task, **self.preparation).fit(pair.train, self.target)
        train, test = (assemble(fitted.transform(t, gate=True), fitted.features, self.target)
                       for t in (pair.train, pair.test))
        network = self.network().fit(train)
        if model_folder:
            network.save_to(spark, f"{model_folder}/{scenario}_model")
            fitted.save(spark, f"{model_folder}/{scenario}_preprocessor")
        said = network.transform(test).withColumn("scenario", F.lit(scenario))
        scores = score_predictions(said, LABEL, PREDICTION, self.task, ["scenario"])
        return settle(scores.select("scenario", *metric_names(self.task))), network.history(spark, scenario)

    def run(self, spark: SparkSession, pairs: Iterable[tuple[str, TablePair]],
            model_folder: str | None = None) -> Outcome:
        """Every variant in turn; one that fails is noted and skipped."""
        scores, histories, status = [], [], []
        for scenario, pair in pairs:
            try:
                score, history = self.run_one(spark, scenario, pair, model_folder)
            except Exception as error:  # noqa: BLE001  one bad variant must not end the others
                status.append((scenario, "failed", f"{type(error).__name__}: {error}"))
                continue
            scores.append(score)
            histories.append(history)
            status.append((scenario, "ok", None))
        done = reduce(DataFrame.unionByName, scores) if scores else None
        results = results_table(long_results(done, self.task), self.task) if scores else empty_results(spark, self.task)
        return Outcome(results, reduce(DataFrame.unionByName, histories) if histories else None,
                       spark.createDataFrame(status, STATUS))


def run_folder(spark: SparkSession, root: str, experiment: Experiment,
               model_folder: str | None = None) -> Outcome | None:
    """Run every train/test pair found under a folder; None when there is none."""
    found = discover_pairs(spark, root).collect()
    if not found:
        return None
    pairs = ((r["scenario"], read_pair(spark, r["path"])) for r in found)
    outcome = experiment.run(spark, pairs, model_folder)
    return outcome if not outcome.results.isEmpty() else None
