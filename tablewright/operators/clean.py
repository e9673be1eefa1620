"""Cleaning, alignment, typing and row filters: projections and one-pass checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tablewright.functions import divide, is_missing, parse_number, ref, round_to
from tablewright.schema import CLASSIFICATION, COMPARISON_IGNORED, REGRESSION_IGNORED, check_task, feature_types

SENTINELS = ("?", "nan", "NaN")  # fixed values: cell texts that mean "missing"


def clean_sentinels(df: DataFrame, sentinels: tuple[str, ...] = SENTINELS) -> DataFrame:
    """NULL for cells exactly equal to a sentinel, and for NaN in floating columns."""

    def cleaned(field: T.StructField) -> Column:
        cell = ref(field.name)
        if isinstance(field.dataType, T.StringType):
            return F.when(~cell.isin(*sentinels), cell).alias(field.name)
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            return F.when(~F.isnan(cell), cell).alias(field.name)
        return cell

    return df.select(*(cleaned(f) for f in df.schema.fields))


def ignored_columns(task: str, comparing_models: bool = False) -> tuple[str, ...]:
    """Scenarios leave columns out for regression only, the model comparison for both tasks."""
    if comparing_models:
        return COMPARISON_IGNORED
    return () if check_task(task) == CLASSIFICATION else REGRESSION_IGNORED


def drop_ignored(df: DataFrame, task: str, comparing_models: bool = False) -> DataFrame:
    """Leave the ignored columns out, by exact name: ``Id`` is one of them, a key named ``id`` is not."""
    gone = set(ignored_columns(task, comparing_models))
    return df.select(*(ref(c) for c in df.columns if c not in gone)) if gone & set(df.columns) else df


def align_features(df: DataFrame, fitted: list[str], keep: list[str] = ()) -> DataFrame:
    """The fitted columns in fitted order: extra ones go, absent ones become 0."""
    present = set(df.columns)
    return df.select(*(ref(c) for c in keep),
                     *(ref(c) if c in present else F.lit(0).alias(c) for c in fitted))


def coerce_numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    types = {f.name: f.dataType for f in df.schema.fields}
    return df.withColumns({c: parse_number(ref(c), types[c]) for c in columns})


def typed_output(df: DataFrame, features: list[str], target: str, task: str, keep: list[str] = ()) -> DataFrame:
    """Features as float; the target as bigint for classes and as float for regression."""
    label = "bigint" if check_task(task) == CLASSIFICATION else "float"
    return df.select(*(ref(c) for c in keep), *(ref(c).cast("float").alias(c) for c in features),
                     ref(target).cast(label).alias(target))


def any_missing(df: DataFrame, columns: list[str]) -> Column:
    types = {f.name: f.dataType for f in df.schema.fields}
    return reduce(lambda a, b: a | b, (is_missing(ref(c), types[c]) for c in columns), F.lit(False))


def count_missing(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: how many rows hold a NULL or NaN in any of the columns."""
    return df.agg(F.count_if(any_missing(df, columns)).alias("missing_rows"), F.count(F.lit(1)).alias("total_rows"))


def nan_gate(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pass the table on, or raise when a NULL or NaN is left."""
    left = count_missing(df, columns).first()
    if left["missing_rows"]:
        raise ValueError(f"{left['missing_rows']} rows still hold missing values after preparation")
    return df


def drop_null_rows(df: DataFrame, target: str | None = None) -> DataFrame:
    """Only the rows whose numeric and categorical columns (but the target) are all present."""
    numeric, categorical = feature_types(df, target)
    return df.filter(~any_missing(df, numeric + categorical))


def drop_report(df: DataFrame, target: str | None = None) -> DataFrame:
    """Rows removed by ``drop_null_rows``, of how many, in percent to two places."""
    numeric, categorical = feature_types(df, target)
    return count_missing(df, numeric + categorical).select(
        F.col("missing_rows").alias("removed_rows"), "total_rows",
        round_to(F.coalesce(divide(100.0 * F.col("missing_rows"), F.col("total_rows")), F.lit(0.0)), 2)
        .alias("percent_removed"))
