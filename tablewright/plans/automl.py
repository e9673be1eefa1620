"""The model comparison from raw pair to labelled predictions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Model
from pyspark.sql import DataFrame, functions as F

from tablewright.functions import ref
from tablewright.models.features import LABEL, assemble
from tablewright.models.leaderboard import FOLDS, best_model, compare_models, fold_of, label_predictions
from tablewright.models.zoo import Maker, models_for
from tablewright.operators.clean import clean_sentinels, drop_ignored
from tablewright.operators.encode import LabelCodes, apply_labels, fit_labels
from tablewright.operators.iterative import ROUNDS, FittedImputer, fit_iterative
from tablewright.operators.outliers import remove_outliers
from tablewright.schema import CLASSIFICATION, check_task, feature_types, is_number, require_target
from tablewright.session import settle, settle_for_training

SHARE = 0.02            # fixed value: outlier share of the comparison
TRAIN_SHARE = 70        # percent of the rows that models may train on


@dataclass
class Prepared:
    """Assembled rows: to train on, and held out; with what is needed to prepare further tables."""

    train: DataFrame
    holdout: DataFrame
    columns: list[str]
    labels: LabelCodes
    target_labels: LabelCodes | None
    imputer: FittedImputer
    classes: int


def encoded(df: DataFrame, labels: LabelCodes, target_labels: LabelCodes | None) -> DataFrame:
    df = apply_labels(df, labels, "row_zero") if labels.columns else df
    return apply_labels(df, target_labels, "row_zero") if target_labels else df


def automl_prepare(df: DataFrame, task: str, target: str, key: list[str], rounds: int = ROUNDS,
                   share: float = SHARE, **forest) -> Prepared:
    """Clean, leave columns out, split, impute by models, drop outliers from the training share, encode.

    Everything is learnt from the training share alone. The holdout keeps its outliers: it is what the models
    are judged on.
    """
    require_target(df, target)
    table = drop_ignored(clean_sentinels(df), check_task(task), comparing_models=True)
    # over all cores: what is learnt from few bytes is much work
    table = settle_for_training(table.filter(ref(target).isNotNull()).withColumn("_share", fold_of(key, 100)))
    inside, held = (table.filter(where).drop("_share") for where in (F.col("_share") < TRAIN_SHARE, F.col("_share") >= TRAIN_SHARE))
    imputer, filled = fit_iterative(inside, target, key, rounds)
    filled = settle(filled)
    train = remove_outliers(filled, share, target, key, **forest)
    holdout = imputer.transform(held)
    numeric, text = feature_types(inside, [*key, target])
    labels = fit_labels(filled, text)
    kind = inside.schema[target].dataType
    target_labels = fit_labels(filled, [target]) if task == CLASSIFICATION and not is_number(kind) else None
    rows = [settle_for_training(assemble(encoded(part, labels, target_labels), numeric + text, target, key))
            for part in (train, holdout)]
    classes = int(rows[0].agg(F.max(LABEL)).first()[0]) + 1 if task == CLASSIFICATION else 0
    return Prepared(rows[0], rows[1], numeric + text, labels, target_labels, imputer, classes)


def analyze(train: DataFrame, test: DataFrame, task: str, target: str, key: list[str],
            models: dict[str, Maker] | None = None, folds: int = FOLDS, rounds: int = ROUNDS,
            parallelism: int = 4) -> tuple[DataFrame, str, Model, DataFrame, DataFrame]:
    """(leaderboard, best name, best model, holdout predictions, test predictions)."""
    ready = automl_prepare(train, task, target, key, rounds)
    board = settle(compare_models(ready.train, task, key, models, folds, parallelism))
    best = best_model(board)
    makers = models if models is not None else models_for(task)
    model = makers[best](ready.classes, key[0] if len(key) == 1 else None).fit(ready.train)
    other = ready.imputer.transform(drop_ignored(clean_sentinels(test), task, comparing_models=True))
    rows = assemble(encoded(other, ready.labels, ready.target_labels), ready.columns, target, key)
    said = [label_predictions(model, part, task, ready.classes, key) for part in (ready.holdout, rows)]
    return board, best, model, said[0], said[1]
