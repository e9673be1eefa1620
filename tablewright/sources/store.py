"""Parquet stores: prepared scenarios by partition, fitted state as (part, column, position, value)."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tablewright.functions import ref

STATE_SCHEMA = "part string, column string, value string"


def write_scenario(df: DataFrame, root: str, scenario: str, split: str, key: list[str] = ()) -> None:
    """One variant's table under ``scenario=.../split=...``, so that readers prune to what they need.

    Filling can turn whole numbers into fractions, so all numbers but the key are stored as doubles
    and every variant has the same types.
    """
    whole = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in key]
    df.withColumns({c: ref(c).cast("double") for c in whole}).write.mode("overwrite").parquet(f"{root}/scenario={scenario}/split={split}")


def read_scenario(spark: SparkSession, root: str, scenario: str, split: str) -> DataFrame:
    return spark.read.parquet(f"{root}/scenario={scenario}/split={split}")


def read_scenarios(spark: SparkSession, root: str) -> DataFrame:
    """All variants with their ``scenario`` and ``split`` columns; absent columns read as NULL."""
    return spark.read.option("mergeSchema", True).parquet(root)


def scenario_counts(tables: DataFrame) -> DataFrame:
    return tables.groupBy("scenario", "split").agg(F.count(F.lit(1)).alias("rows"))


def write_state(spark: SparkSession, state: dict[str, dict], path: str) -> None:
    """A fitted state of plain values; every entry is one row holding JSON."""
    rows = [(part, column, json.dumps(value)) for part, entries in state.items() for column, value in entries.items()]
    spark.createDataFrame(rows, STATE_SCHEMA).coalesce(1).write.mode("overwrite").parquet(path)


def read_state(spark: SparkSession, path: str) -> dict[str, dict]:
    state: dict[str, dict] = {}
    for row in spark.read.parquet(path).collect():
        state.setdefault(row["part"], {})[row["column"]] = json.loads(row["value"])
    return state
