"""Filling missing values: a fit gives one value per column, applying it is a projection."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tablewright.functions import is_missing, ref
from tablewright.operators.clean import any_missing, drop_ignored
from tablewright.operators.distribution import describe
from tablewright.schema import check_task, feature_types, is_number

NUMERIC_WAYS = ("mean", "median", "mode", "drop")
CATEGORICAL_WAYS = ("mode", "drop")
UNKNOWN = "UNKNOWN"


def fill_missing(df: DataFrame, fills: dict[str, object]) -> DataFrame:
    """Replace NULL and NaN by the fitted values; other cells stay, parsable or not."""
    types = {f.name: f.dataType for f in df.schema.fields}

    def filled(name: str) -> Column:
        cell, kind, value = ref(name), types[name], fills[name]
        if isinstance(kind, T.StringType):
            value = value if isinstance(value, str) else repr(value)
        elif isinstance(kind, T.IntegralType) and isinstance(value, float):
            cell, kind = cell.cast("double"), T.DoubleType()
        return F.when(is_missing(cell, kind), F.lit(value).cast(kind)).otherwise(cell).alias(name)

    return df.select(*(filled(c) if c in fills and fills[c] is not None else ref(c) for c in df.columns))


def numeric_like(stats: dict, kind: T.DataType, rule: str = "all") -> bool:
    """Whether a column is filled as a number.

    ``rule='any'`` is the study's own test, one parsable value is enough; ``'all'`` wants every
    present value to parse. Booleans count as numbers under ``'any'`` only.
    """
    if rule not in ("all", "any"):
        raise ValueError("numeric_rule must be 'all' or 'any'")
    if is_number(kind):
        return True
    if isinstance(kind, T.BooleanType):
        return rule == "any"
    parsed = stats.get("parsed", 0)
    return parsed > 0 and (rule == "any" or parsed == stats["present"])


def fit_median_mode(df: DataFrame, columns: list[str], numeric_rule: str = "all",
                    stats: dict[str, dict] | None = None) -> dict[str, object]:
    """Fill values by kind: the exact median of numbers, the mode of text, 0 for an empty column."""
    types = {f.name: f.dataType for f in df.schema.fields}
    stats = stats or describe_for_fills(df, columns)
    fills: dict[str, object] = {}
    for name in columns:
        if not stats[name]["present"]:
            fills[name] = 0
        elif numeric_like(stats[name], types[name], numeric_rule):
            fills[name] = stats[name]["quantiles"][0]
        else:
            mode = stats[name]["mode"]
            fills[name] = UNKNOWN if mode is None else mode
    return fills


def describe_for_fills(df: DataFrame, columns: list[str], values: list[str] = ()) -> dict[str, dict]:
    """The statistics ``fit_median_mode`` reads, with value lists on request."""
    types = {f.name: f.dataType for f in df.schema.fields}
    text = [c for c in columns if not is_number(types[c])]
    return describe(df, columns, quantiles={c: [0.5] for c in columns}, modes=text, values=values)


def fit_fills(df: DataFrame, numeric: str = "mean", categorical: str = "mode",
              columns: list[str] | None = None, stats: dict[str, dict] | None = None) -> dict[str, object]:
    """Fill values of the scenarios: mean, median or mode of numbers, mode of text. ``stats`` spares describing the table."""
    numbers, text = feature_types(df)
    if columns is not None:
        numbers, text = [c for c in numbers if c in columns], [c for c in text if c in columns]
    numbers = [] if numeric == "drop" else numbers
    text = [] if categorical == "drop" else text
    if not numbers and not text:
        return {}
    stats = stats or describe(df, numbers + text,
                              quantiles={c: [0.5] for c in numbers} if numeric == "median" else {},
                              modes=text + (numbers if numeric == "mode" else []))
    pick = {"mean": lambda s: s["mean"], "median": lambda s: s["quantiles"][0], "mode": lambda s: s["mode"]}
    fills = {c: pick[numeric](stats[c]) for c in numbers}
    fills.update({c: stats[c]["mode"] for c in text})
    return {c: v for c, v in fills.items() if v is not None}


def imputer(source: DataFrame, numeric: str = "mean", categorical: str = "mode", task: str = "classification",
            target: str | None = None, keep: list[str] = ()) -> Callable[[DataFrame], DataFrame]:
    """Fit the general form on a table; the target and the ``keep`` columns (a row key) stay untouched."""
    check_task(task)
    if numeric not in NUMERIC_WAYS or categorical not in CATEGORICAL_WAYS:
        raise ValueError(f"numeric is one of {NUMERIC_WAYS}, categorical one of {CATEGORICAL_WAYS}")
    source = drop_ignored(source, task)
    numbers, text = feature_types(source, [*keep, *([target] if target else [])])
    dropped = (numbers if numeric == "drop" else []) + (text if categorical == "drop" else [])
    kept = [c for c in numbers + text if c not in dropped]
    fills = fit_fills(source, numeric, categorical, kept) if kept else {}

    def apply(df: DataFrame) -> DataFrame:
        df = drop_ignored(df, task)
        df = df.filter(~any_missing(df, dropped)) if dropped else df
        return fill_missing(df, fills) if fills else df

    return apply


def impute(df: DataFrame, numeric: str = "mean", categorical: str = "mode", task: str = "classification",
           target: str | None = None, fit_on: DataFrame | None = None, keep: list[str] = ()) -> DataFrame:
    """The general form, fitted on ``fit_on`` or on the table itself, and applied."""
    return imputer(fit_on if fit_on is not None else df, numeric, categorical, task, target, keep)(df)


def impute_mean(df: DataFrame, **options) -> DataFrame:
    return impute(df, numeric="mean", **options)


def impute_mode(df: DataFrame, **options) -> DataFrame:
    return impute(df, numeric="mode", **options)


def impute_median(df: DataFrame, **options) -> DataFrame:
    return impute(df, numeric="median", **options)


def remove_null_rows(df: DataFrame, task: str = "classification", target: str | None = None) -> DataFrame:
    return impute(df, numeric="drop", categorical="drop", task=task, target=target)
