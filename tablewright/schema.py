"""Column roles, derived from the schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from tablewright.functions import ref

CLASSIFICATION = "classification"
REGRESSION = "regression"
TASKS = (CLASSIFICATION, REGRESSION)

# Columns the study leaves out of its regression scenarios, and of its model comparison.
REGRESSION_IGNORED = ("dteday", "instant", "property_id", "location_id", "page_url", "location", "city",
                      "province_name", "area", "date_added", "agency", "agent")
COMPARISON_IGNORED = ("Id", *REGRESSION_IGNORED)


def check_task(task: str) -> str:
    if task not in TASKS:
        raise ValueError(f"task must be one of {', '.join(TASKS)}, not {task!r}")
    return task


def is_number(data_type: T.DataType) -> bool:
    return isinstance(data_type, T.NumericType)


def is_category(data_type: T.DataType) -> bool:
    return isinstance(data_type, (T.StringType, T.BooleanType))


def feature_types(df: DataFrame, exclude: str | list[str] | None = None) -> tuple[list[str], list[str]]:
    """Names of the numeric and of the categorical columns. Dates and timestamps have no role."""
    left_out = {exclude} if isinstance(exclude, str) else set(exclude or ())
    fields = [f for f in df.schema.fields if f.name not in left_out]
    return ([f.name for f in fields if is_number(f.dataType)],
            [f.name for f in fields if is_category(f.dataType)])


def as_supported(df: DataFrame) -> DataFrame:
    """Decimals as doubles; a nested column is an error."""
    nested = [f.name for f in df.schema.fields
              if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.BinaryType))]
    if nested:
        raise ValueError(f"nested columns are not features: {', '.join(nested)}")
    if not any(isinstance(f.dataType, T.DecimalType) for f in df.schema.fields):
        return df
    return df.select(*(ref(f.name).cast("double").alias(f.name) if isinstance(f.dataType, T.DecimalType)
                       else ref(f.name) for f in df.schema.fields))


def split_target(df: DataFrame, target: str) -> tuple[DataFrame, DataFrame]:
    """The features and the target as two projections."""
    require_target(df, target)
    return df.drop(target), df.select(ref(target))


def require_target(df: DataFrame, target: str) -> None:
    if target not in df.columns:
        raise ValueError(f"target column {target!r} is not in the table")


def require_features(df: DataFrame, target: str) -> None:
    """A table to fit on needs its target and at least one other column."""
    require_target(df, target)
    if len(df.columns) < 2:
        raise ValueError("the table has no feature column")


def require_rows(rows: int) -> None:
    if not rows:
        raise ValueError("the table is empty")


def validate(df: DataFrame, target: str) -> None:
    """All checks of a table to fit on."""
    require_features(df, target)
    require_rows(0 if df.select(F.lit(1)).isEmpty() else 1)
