"""Cross-validated comparison of models: one table of metrics, best model first."""

from __future__ import annotations

import time
import warnings
from collections.abc import Callable
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Estimator, Model
from pyspark.sql import Column, DataFrame, Window, functions as F

from tablewright.functions import ref, round_to
from tablewright.models.features import LABEL, PREDICTION, SCORES, class_scores
from tablewright.models.zoo import Maker, models_for
from tablewright.operators.metrics import class_auc, classification_metrics, regression_metrics
from tablewright.schema import CLASSIFICATION, check_task
from tablewright.session import settle, settle_for_training

FOLDS = 10     # fixed value: folds of the comparison
RANGES = 1_000 # hash ranges of a class that are dealt to folds side by side
Outcome = tuple[str, float | None, DataFrame | None, str | None]     # model, seconds, predictions, error
CLASS_COLUMNS = ("accuracy", "auc", "recall", "precision", "f1", "kappa", "mcc")
REGRESSION_COLUMNS = ("mae", "mse", "rmse", "r2", "rmsle", "mape")


def fold_of(key: list[str], folds: int) -> Column:
    """A fold number from a hash of the key, the same in every run."""
    return F.pmod(F.xxhash64(*(ref(c) for c in key)), F.lit(folds)).cast("int")


def with_folds(data: DataFrame, key: list[str], folds: int, by_label: bool) -> DataFrame:
    """``data`` with ``fold``. By label, the rows of each class are dealt in turn, in the order of the key's hash, so a
    class is in as many folds as it has rows; its places come from counts per hash range, not from one task for a class.
    """
    if not by_label:
        return data.withColumn("fold", fold_of(key, folds))
    mark = F.xxhash64(*(ref(c) for c in key))
    marked = data.withColumns({"_mark": mark, "_range": F.pmod(mark, F.lit(RANGES))})
    within = Window.partitionBy(LABEL, "_range").orderBy("_mark", *(ref(c) for c in key))
    sizes = marked.groupBy(F.col(LABEL).alias("_label"), F.col("_range").alias("_of")).agg(F.count(F.lit(1)).alias("_rows"))
    starts = sizes.select("_label", "_of", F.coalesce(F.sum("_rows").over(
        Window.partitionBy("_label").orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    dealt = marked.withColumn("_nth", F.row_number().over(within)).join(
        starts, F.col(LABEL).eqNullSafe(F.col("_label")) & (F.col("_range") == F.col("_of")))
    return dealt.select(*(ref(c) for c in data.columns), F.pmod(F.col("_start") + F.col("_nth"), F.lit(folds)).cast("int").alias("fold"))


def predictions_of(model: Model, rows: DataFrame, task: str, classes: int, keep: list[str]) -> DataFrame:
    """Key, label, prediction and, for classes, one score per class."""
    said = model.transform(rows)
    if task != CLASSIFICATION:
        return said.select(*keep, LABEL, PREDICTION)
    return class_scores(said, classes).select(*keep, LABEL, PREDICTION, SCORES)


def measure(predictions: DataFrame, task: str, by: list[str]) -> DataFrame:
    """The leaderboard's metrics per group."""
    if check_task(task) != CLASSIFICATION:
        return regression_metrics(predictions, LABEL, PREDICTION, by, extended=True)
    found = classification_metrics(predictions, LABEL, PREDICTION, by, agreement=True)
    return found.join(class_auc(predictions, LABEL, SCORES, by), by)


def compare_models(data: DataFrame, task: str, key: list[str], models: dict[str, Maker] | None = None,
                   folds: int = FOLDS, parallelism: int = 4) -> DataFrame:
    """(model, metrics..., fit_seconds, folds, status), ordered by accuracy or R2, the best first.

    ``data`` holds the key, ``features`` and ``label``. Its folds are written once; models train side
    by side on driver threads, which only submit Spark jobs. A model with ``fit_folds`` is trained for all folds
    at once, in the same passes over the rows, any other fold by fold. Every held-out row is predicted once per
    model, and one grouped aggregation scores all models and folds. A model that fails in a fold is scored on
    the others; ``status`` tells the first error, else ``ok``. With classes, folds are stratified.
    """
    makers = models if models is not None else models_for(task)
    classification = check_task(task) == CLASSIFICATION
    rows = settle_for_training(with_folds(data, key, folds, classification))
    found = rows.groupBy("fold").agg(F.max(LABEL).alias("top")).collect()
    classes = int(max(r["top"] for r in found)) + 1 if classification else 0
    present = sorted(r["fold"] for r in found)
    if len(present) < 2:
        raise ValueError("a comparison needs rows in two folds at least")

    def made(name: str) -> Estimator:
        return makers[name](classes, key[0] if len(key) == 1 else None)

    def held_out(name: str, model: Model, fold: int) -> DataFrame:
        said = predictions_of(model, rows.filter(F.col("fold") == fold), task, classes, ["fold"])
        return said.withColumn("model", F.lit(name))

    def one(name: str, fold: int) -> Outcome:
        start = time.perf_counter()
        try:
            model = made(name).fit(rows.filter(F.col("fold") != fold))
            seconds = time.perf_counter() - start
            return name, seconds, settle(held_out(name, model, fold)), None
        except Exception as error:  # noqa: BLE001  one failing model must not end the others
            return name, None, None, f"fold {fold}: {type(error).__name__}: {error}"

    def run(job: tuple[str, int | None]) -> list[Outcome]:
        name, fold = job
        if fold is not None:
            return [one(name, fold)]
        start = time.perf_counter()
        try:
            models = made(name).fit_folds(rows, "fold", present)
            seconds = (time.perf_counter() - start) / len(present)
            said = settle(reduce(DataFrame.unionByName, (held_out(name, models[f], f) for f in present)))
        except Exception as error:  # noqa: BLE001  alone, each fold tells its own error
            warnings.warn(f"{name}: fold by fold after {type(error).__name__}: {error}", RuntimeWarning)
            return [one(name, f) for f in present]
        return [(name, seconds, said if f == present[0] else None, None) for f in present]

    def together(name: str) -> bool:
        try:
            return hasattr(made(name), "fit_folds")
        except Exception:  # noqa: BLE001  told by the folds
            return False

    # what takes all folds at once takes longest, and comes first
    at_once = [name for name in makers if together(name)]
    jobs = [(name, None) for name in at_once] + [(name, fold) for name in makers if name not in at_once for fold in present]
    if parallelism > 1:
        with ThreadPool(parallelism) as pool:
            done = pool.map(inheritable_thread_target(data.sparkSession)(run), jobs, chunksize=1)
    else:
        done = [run(job) for job in jobs]
    done = [outcome for outcomes in done for outcome in outcomes]
    if all(said is None for _, _, said, _ in done):
        raise RuntimeError(f"every model failed: {done[0][3]}")
    clock = [(name, seconds, error) for name, seconds, _, error in done]
    times = data.sparkSession.createDataFrame(clock, "model string, seconds double, error string")
    scores = measure(reduce(DataFrame.unionByName, (p for _, _, p, _ in done if p is not None)), task, ["model", "fold"])
    columns = CLASS_COLUMNS if classification else REGRESSION_COLUMNS
    mean = scores.groupBy("model").agg(*(round_to(F.avg(c), 4).alias(c) for c in columns))
    timed = times.groupBy("model").agg(F.round(F.avg("seconds"), 3).alias("fit_seconds"), F.count("seconds").alias("folds"),
                                       F.coalesce(F.min("error"), F.lit("ok")).alias("status"))
    return timed.join(mean, "model", "left").select("model", *columns, "fit_seconds", "folds", "status").orderBy(
        F.desc_nulls_last("accuracy" if classification else "r2"), "model")


def best_model(board: DataFrame) -> str:
    metric = "accuracy" if "accuracy" in board.columns else "r2"
    return board.orderBy(F.desc_nulls_last(metric), "model").first()["model"]


def label_predictions(model: Model, rows: DataFrame, task: str, classes: int, keep: list[str]) -> DataFrame:
    """Rows with ``prediction_label`` and, for classes, ``prediction_score``, the score of that label."""
    said = predictions_of(model, rows, task, classes, keep).withColumnRenamed(PREDICTION, "prediction_label")
    if task != CLASSIFICATION:
        return said
    return said.withColumn("prediction_score", F.array_max(SCORES)).drop(SCORES)
