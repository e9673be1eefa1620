"""Results tables: one row per experiment, the best one, and changes against a base."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tablewright.functions import ref, round_to
from tablewright.operators.metrics import CLASS_METRICS, REGRESSION_METRICS
from tablewright.schema import CLASSIFICATION, check_task

PLACES = 4     # fixed value: decimals of the results table


def metric_names(task: str) -> tuple[str, ...]:
    return CLASS_METRICS if check_task(task) == CLASSIFICATION else REGRESSION_METRICS


def primary_metric(task: str) -> str:
    return "f1" if check_task(task) == CLASSIFICATION else "r2"


def empty_results(spark: SparkSession, task: str) -> DataFrame:
    return spark.createDataFrame([], "scenario string, " + ", ".join(f"{m} double" for m in metric_names(task)))


def long_results(scores: DataFrame, task: str) -> DataFrame:
    """(scenario, metric, value)."""
    return scores.unpivot(["scenario"], list(metric_names(task)), "metric", "value")


def results_table(long: DataFrame, task: str) -> DataFrame:
    """One row per scenario, one column per metric, rounded."""
    names = list(metric_names(task))
    wide = long.groupBy("scenario").pivot("metric", names).agg(F.first("value"))
    return wide.select("scenario", *(round_to(ref(m), PLACES).alias(m) for m in names))


def best_scenario(results: DataFrame, task: str) -> DataFrame:
    """(best_scenario, metric, score): the highest rounded primary metric, the first name on ties."""
    metric = primary_metric(task)
    return (results.filter(ref(metric).isNotNull())
            .select(F.col("scenario").alias("best_scenario"), F.lit(metric.upper()).alias("metric"),
                    ref(metric).alias("score"))
            .orderBy(F.desc("score"), "best_scenario").limit(1))


def report_text(results: DataFrame, task: str) -> str:
    """The printed report: the table and the best experiment."""
    rows = results.orderBy("scenario").toPandas()
    if rows.empty:
        return "no results"
    best = best_scenario(results, task).first()
    return f"{rows.to_string(index=False)}\n\nbest: {best['best_scenario']} ({best['metric']} {best['score']:.4f})"


def scenario_delta(results: DataFrame, task: str, base: str) -> DataFrame:
    """Each scenario's metrics minus those of the base scenario, whose one row enters as literals."""
    names = metric_names(task)
    row = results.filter(F.col("scenario") == base).select(*names).first()
    if row is None:
        raise ValueError(f"no scenario {base!r} in the results")
    return results.select("scenario", *(round_to(ref(m) - F.lit(row[m]), PLACES).alias(f"{m}_delta") for m in names))
