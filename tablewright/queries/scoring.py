"""Queries on metrics and results tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tablewright.functions import ref, round_to
from tablewright.models.features import argmax
from tablewright.operators.metrics import (class_auc, classification_metrics, regression_metrics, roc_auc,
                                           score_predictions)
from tablewright.operators.results import best_scenario, long_results, results_table, scenario_delta
from tablewright.queries.registry import query
from tablewright.queries.tables import table

PLACES = 6


def guesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A guess at each line's return flag, by rule, with a score; one scenario per line number."""
    return table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("line_"), F.col("l_linenumber").cast("string")).alias("scenario"),
        F.col("l_returnflag").alias("y"),
        F.when(F.col("l_quantity") > 30, "R").when(F.col("l_discount") > 0.05, "A").otherwise("N").alias("pred"),
        F.col("l_quantity").alias("score"),
        F.col("l_extendedprice").alias("price"),
        (F.col("l_quantity") * 2000 * (1 - F.col("l_discount"))).alias("guess"))


GUESSES = """g AS (SELECT concat('line_', l_linenumber) AS scenario, l_returnflag AS y,
  CASE WHEN l_quantity > 30 THEN 'R' WHEN l_discount > 0.05 THEN 'A' ELSE 'N' END AS pred,
  l_quantity AS score, l_extendedprice AS price, l_quantity * 2000 * (1 - l_discount) AS guess FROM lineitem)"""
CLASSES = GUESSES + """, labels_of AS (SELECT scenario, y AS label FROM g UNION SELECT scenario, pred FROM g),
  per AS (SELECT l.scenario, l.label, count(*) FILTER (g.y = l.label) AS support, count(*) FILTER (g.pred = l.label) AS said,
          count(*) FILTER (g.y = l.label AND g.pred = l.label) AS hits
          FROM labels_of l JOIN g ON g.scenario = l.scenario GROUP BY l.scenario, l.label),
  scored AS (SELECT scenario, sum(hits)::DOUBLE / sum(support) AS accuracy,
          sum(support * coalesce(hits::DOUBLE / nullif(said, 0), 0)) / sum(support) AS precision,
          sum(support * coalesce(hits::DOUBLE / nullif(support, 0), 0)) / sum(support) AS recall,
          sum(support * coalesce(2.0::DOUBLE * hits / nullif(support + said, 0), 0)) / sum(support) AS f1,
          sum(support)::DOUBLE AS n, sum(hits)::DOUBLE AS c, sum(support * said)::DOUBLE AS chance,
          sum(said * said)::DOUBLE AS pp, sum(support * support)::DOUBLE AS tt FROM per GROUP BY scenario)"""
ERRORS = GUESSES + """, scored AS (SELECT scenario, avg(pow(price - guess, 2)) AS mse, avg(abs(price - guess)) AS mae,
  1 - sum(pow(price - guess, 2)) / (var_pop(price) * count(*)) AS r2, sqrt(avg(pow(price - guess, 2))) AS rmse,
  sqrt(avg(pow(ln(1 + guess) - ln(1 + price), 2))) AS rmsle, avg(abs(price - guess) / abs(price)) AS mape
  FROM g GROUP BY scenario)"""


def picked(columns: list[str], places: int = PLACES) -> str:
    return ", ".join(f"round({c}, {places}) + 0.0 AS {c}" for c in columns)


def kept(df: DataFrame, columns: list[str], places: int = PLACES) -> DataFrame:
    return df.select("scenario", *(round_to(ref(c), places).alias(c) for c in columns))


@query("class_count", "SELECT count(DISTINCT o_orderstatus) AS classes, count(*) AS rows FROM orders")
def class_count_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").agg(F.count_distinct("o_orderstatus").alias("classes"),
                                              F.count(F.lit(1)).alias("rows"))


@query("argmax_label", "SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS BIGINT) AS label FROM embeddings")
def argmax_label_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", argmax(F.col("embedding")).cast("bigint").alias("label"))


@query("preview", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 5")
def preview_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rows by key, as the comparison prints them."""
    return (table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
            .orderBy("o_orderkey").limit(5))


CLASS_NAMES = ["accuracy", "precision", "recall", "f1"]


@query("metrics_classification", f"WITH {CLASSES} SELECT scenario, {picked(CLASS_NAMES)} FROM scored")
def metrics_classification_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept(classification_metrics(guesses(spark, sf_dir), "y", "pred", ["scenario"]), CLASS_NAMES)


@query("kappa_mcc", f"WITH {CLASSES} SELECT scenario, round((c * n - chance) / (n * n - chance), 6) + 0.0 AS kappa, "
                    "round((c * n - chance) / sqrt((n * n - pp) * (n * n - tt)), 6) + 0.0 AS mcc FROM scored")
def kappa_mcc_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept(classification_metrics(guesses(spark, sf_dir), "y", "pred", ["scenario"], agreement=True),
                ["kappa", "mcc"])


@query("metrics_regression", f"WITH {ERRORS} SELECT scenario, round(mse, 2) + 0.0 AS mse, round(mae, 4) + 0.0 AS mae, "
                             "round(r2, 6) + 0.0 AS r2 FROM scored")
def metrics_regression_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = regression_metrics(guesses(spark, sf_dir), "price", "guess", ["scenario"])
    return found.select("scenario", round_to(ref("mse"), 2).alias("mse"), round_to(ref("mae"), 4).alias("mae"),
                        round_to(ref("r2"), 6).alias("r2"))


@query("metrics_regression_ext", f"WITH {ERRORS} SELECT scenario, {picked(['rmse', 'rmsle', 'mape'], 5)} FROM scored")
def metrics_regression_ext_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept(regression_metrics(guesses(spark, sf_dir), "price", "guess", ["scenario"], extended=True),
                ["rmse", "rmsle", "mape"], 5)


@query("auc_rank", f"WITH {GUESSES}, r AS (SELECT scenario, y = 'R' AS hit, rank() OVER (PARTITION BY scenario ORDER BY "
                   "score) + (count(*) OVER (PARTITION BY scenario, score) - 1) / 2.0::DOUBLE AS place FROM g), "
                   "s AS (SELECT scenario, sum(place) FILTER (hit) AS places, count(*) FILTER (hit)::DOUBLE AS a, "
                   "count(*) FILTER (NOT hit)::DOUBLE AS b FROM r GROUP BY scenario) "
                   "SELECT scenario, round((places - a * (a + 1) / 2) / (a * b), 6) + 0.0 AS auc FROM s")
def auc_rank_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept(roc_auc(guesses(spark, sf_dir), F.col("y") == "R", F.col("score"), ["scenario"]), ["auc"])


@query("auc_by_class", f"WITH {GUESSES}, k AS (SELECT scenario, y, unnest(['A', 'N', 'R']) AS label, "
                       "unnest([-score, score * score / 100 - score, score]) AS score FROM g), "
                       "r AS (SELECT scenario, label, y = label AS hit, rank() OVER (PARTITION BY scenario, label ORDER BY "
                       "score) + (count(*) OVER (PARTITION BY scenario, label, score) - 1) / 2.0::DOUBLE AS place FROM k), "
                       "s AS (SELECT scenario, label, sum(place) FILTER (hit) AS places, count(*) FILTER (hit)::DOUBLE AS a, "
                       "count(*) FILTER (NOT hit)::DOUBLE AS b FROM r GROUP BY scenario, label) "
                       "SELECT scenario, round(sum(a * (places - a * (a + 1) / 2) / (a * b)) / sum(a), 6) + 0.0 AS auc "
                       "FROM s GROUP BY scenario")
def auc_by_class_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-against-rest areas over three classes, averaged by class size."""
    score = F.col("score")
    rows = guesses(spark, sf_dir).select(
        "scenario", F.when(F.col("y") == "A", 0).when(F.col("y") == "N", 1).otherwise(2).alias("y"),
        F.array(-score, score * score / 100 - score, score).alias("scores"))
    return kept(class_auc(rows, "y", "scores", ["scenario"]), ["auc"])


LONG_SQL = (f"WITH {CLASSES} SELECT 'classification' AS task, scenario, "
            f"metric, round(value, 6) + 0.0 AS value FROM (SELECT scenario, {', '.join(CLASS_NAMES)} FROM scored) "
            f"UNPIVOT (value FOR metric IN ({', '.join(CLASS_NAMES)})) UNION ALL "
            f"(WITH {ERRORS} SELECT 'regression', scenario, metric, round(value, 2) + 0.0 FROM "
            "(SELECT scenario, mse, mae, r2 FROM scored) UNPIVOT (value FOR metric IN (mse, mae, r2)))")


@query("metrics_by_scenario", LONG_SQL)
def metrics_by_scenario_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both tasks dispatched, one row per scenario and metric."""
    rows = guesses(spark, sf_dir)
    parts = []
    for task, truth, said, places in (("classification", "y", "pred", 6), ("regression", "price", "guess", 2)):
        scores = score_predictions(rows, truth, said, task, ["scenario"])
        parts.append(long_results(scores, task).select(F.lit(task).alias("task"), "scenario", "metric",
                                                       round_to(ref("value"), places).alias("value")))
    return parts[0].unionByName(parts[1])


def class_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = score_predictions(guesses(spark, sf_dir), "y", "pred", "classification", ["scenario"])
    return results_table(long_results(scores, "classification"), "classification")


@query("results_table", f"WITH {CLASSES} SELECT scenario, {picked(CLASS_NAMES, 4)} FROM scored")
def results_table_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_results(spark, sf_dir)


@query("best_scenario", f"WITH {CLASSES} SELECT scenario AS best_scenario, 'F1' AS metric, round(f1, 4) + 0.0 AS score "
                        "FROM scored ORDER BY score DESC, best_scenario LIMIT 1")
def best_scenario_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_scenario(class_results(spark, sf_dir), "classification")


@query("scenario_delta", f"WITH {CLASSES}, r AS (SELECT scenario, {picked(CLASS_NAMES, 4)} FROM scored) SELECT r.scenario, "
       + ", ".join(f"round(r.{c} - b.{c}, 4) + 0.0 AS {c}_delta" for c in CLASS_NAMES)
       + " FROM r, r b WHERE b.scenario = 'line_1'")
def scenario_delta_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scenario_delta(class_results(spark, sf_dir), "classification", "line_1")
