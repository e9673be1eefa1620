"""Scores of predictions, each a grouped aggregation over (group columns, truth, prediction)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tablewright.functions import divide, ref
from tablewright.operators.distribution import ONE_TASK_ROWS, running_total
from tablewright.schema import CLASSIFICATION, check_task
from tablewright.session import settle

EPSILON = 2.220446049250313e-16    # fixed value: double precision, the least divisor of a percentage error
CLASS_METRICS = ("accuracy", "precision", "recall", "f1")
REGRESSION_METRICS = ("mse", "mae", "r2")


def confusion(df: DataFrame, truth: str, prediction: str, by: list[str]) -> DataFrame:
    return (df.select(*(ref(c) for c in by), ref(truth).alias("_truth"), ref(prediction).alias("_prediction"))
            .groupBy(*by, "_truth", "_prediction").agg(F.count(F.lit(1)).alias("n")))


def class_margins(counts: DataFrame, by: list[str]) -> DataFrame:
    """Per group and class: its rows, its hits, and how often it was predicted.

    Each confusion cell is counted once for its true and once for its predicted class, which needs no
    join of the two margins.
    """
    hit = F.when(F.col("_truth") == F.col("_prediction"), F.col("n")).otherwise(0)
    sides = F.array(F.struct(F.col("_truth").cast("string").alias("label"), F.col("n").alias("support"),
                             hit.alias("hits"), F.lit(0).cast("bigint").alias("predicted")),
                    F.struct(F.col("_prediction").cast("string").alias("label"),
                             F.lit(0).cast("bigint").alias("support"),
                             F.lit(0).cast("bigint").alias("hits"), F.col("n").alias("predicted")))
    return (counts.select(*(ref(c) for c in by), F.inline(sides))
            .groupBy(*by, "label").agg(*(F.sum(c).alias(c) for c in ("support", "hits", "predicted"))))


def classification_metrics(df: DataFrame, truth: str, prediction: str, by: list[str],
                           agreement: bool = False) -> DataFrame:
    """Accuracy and support-weighted precision, recall and F1; with ``agreement`` also kappa and MCC."""
    label = "string" if dict(df.dtypes)[truth] == "string" else "bigint"
    typed = df.withColumns({truth: ref(truth).cast(label), prediction: ref(prediction).cast(label)})
    margins = class_margins(confusion(typed, truth, prediction, by), by)
    support, hits, predicted = (F.col(c).cast("double") for c in ("support", "hits", "predicted"))

    def weighted(score: Column) -> Column:
        return divide(F.sum(support * F.coalesce(score, F.lit(0.0))), F.sum(support))

    found = [divide(F.sum(hits), F.sum(support)).alias("accuracy"),
             weighted(divide(hits, predicted)).alias("precision"),
             weighted(divide(hits, support)).alias("recall"),
             weighted(divide(2 * hits, support + predicted)).alias("f1")]
    if agreement:
        total, right = F.sum(support), F.sum(hits)
        chance = F.sum(support * predicted)
        spread = ((total * total - F.sum(predicted * predicted)) * (total * total - F.sum(support * support)))
        found += [F.coalesce(divide(right * total - chance, total * total - chance), F.lit(0.0)).alias("kappa"),
                  F.coalesce(divide(right * total - chance, F.sqrt(spread)), F.lit(0.0)).alias("mcc")]
    return margins.groupBy(*by).agg(*found)


def regression_metrics(df: DataFrame, truth: str, prediction: str, by: list[str],
                       extended: bool = False) -> DataFrame:
    """MSE, MAE and R2 against the mean; with ``extended`` also RMSE, RMSLE and MAPE.

    RMSLE takes negative values at their absolute size.
    """
    y, p = ref(truth).cast("double"), ref(prediction).cast("double")
    error = y - p
    found = [F.avg(error * error).alias("mse"), F.avg(F.abs(error)).alias("mae"),
             (1 - divide(F.sum(error * error), F.var_pop(y) * F.count(y))).alias("r2")]
    if extended:
        log_error = F.log1p(F.abs(p)) - F.log1p(F.abs(y))
        found += [F.sqrt(F.avg(error * error)).alias("rmse"), F.sqrt(F.avg(log_error * log_error)).alias("rmsle"),
                  F.avg(F.abs(error) / F.greatest(F.abs(y), F.lit(EPSILON))).alias("mape")]
    return df.groupBy(*by).agg(*found)


def roc_auc(df: DataFrame, positive: Column, score: Column, by: list[str]) -> DataFrame:
    """(by, auc): the rank-sum area under the ROC curve, ties counted half; 0.5 with one class only.

    Rows are first counted per distinct score. Short runs are ranked by a window, long ones by the
    range-partitioned running total.
    """
    counts = settle(df.select(*(ref(c) for c in by), score.cast("double").alias("_score"),
                              positive.cast("boolean").alias("_positive"))
                    .groupBy(*by, "_score")
                    .agg(F.count_if("_positive").alias("_hits"), F.count_if(~F.col("_positive")).alias("_misses")))
    ranked = running_total(counts, by, ["_score"], F.col("_misses"), "_below",
                           one_task=counts.count() <= ONE_TASK_ROWS)
    hits, misses = F.col("_hits").cast("double"), F.col("_misses").cast("double")
    won = F.sum(hits * (F.col("_below").cast("double") + misses / 2))
    return ranked.groupBy(*by).agg(F.coalesce(divide(won, F.sum(hits) * F.sum(misses)), F.lit(0.5)).alias("auc"))


def class_auc(df: DataFrame, truth: str, scores: str, by: list[str]) -> DataFrame:
    """(by, auc): one-against-rest areas averaged by class size; ``scores`` holds one score per class."""
    rows = df.select(*(ref(c) for c in by), ref(truth).cast("bigint").alias("_truth"),
                     F.posexplode(ref(scores)).alias("_class", "_score"))
    each = roc_auc(rows, F.col("_truth") == F.col("_class"), F.col("_score"), [*by, "_class"])
    sizes = (df.groupBy(*by, ref(truth).cast("int").alias("_class")).agg(F.count(F.lit(1)).cast("double").alias("_size")))
    return (each.join(sizes, [*by, "_class"]).groupBy(*by)
            .agg(divide(F.sum(F.col("auc") * F.col("_size")), F.sum("_size")).alias("auc")))


def score_predictions(df: DataFrame, truth: str, prediction: str, task: str, by: list[str]) -> DataFrame:
    """The study's metrics for its task, one row per group."""
    measure = classification_metrics if check_task(task) == CLASSIFICATION else regression_metrics
    return measure(df, truth, prediction, by)
