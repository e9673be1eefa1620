"""Queries on the fitted preprocessor, and the flagship profile."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from tablewright.functions import ref, round_to
from tablewright.operators.scale import apply_scales
from tablewright.plans.preprocessor import FittedPreprocessor, TablePreprocessor
from tablewright.queries.registry import query
from tablewright.queries.tables import (FEATURES, KEY, PARTS, TARGET, TRAIN, codes_sql, mode_sql, orders_role,
                                        orders_split, parts_role)
from tablewright.session import scratch_folder

PLACES = 4


def prepared_sql(source: str) -> str:
    """Filled by the training table, coded, scaled: the features of ``source`` as doubles."""
    filled = "\n".join(
        f"""{name} AS (SELECT o_orderkey, coalesce(o_totalprice, (SELECT median(o_totalprice) FROM train)) AS o_totalprice,
          coalesce(o_orderpriority, {mode_sql('o_orderpriority', 'train')}) AS o_orderpriority,
          coalesce(c_acctbal, (SELECT median(c_acctbal) FROM train)) AS c_acctbal, c_mktsegment,
          CAST(c_nationkey AS DOUBLE) AS c_nationkey, o_orderstatus FROM {table_name}),"""
        for name, table_name in (("fit_rows", "train"), ("new_rows", source)))
    coded = "\n".join(
        f"""{name} AS (SELECT o_orderkey, o_totalprice, p.code::DOUBLE AS o_orderpriority, c_acctbal,
          s.code::DOUBLE AS c_mktsegment, c_nationkey, o.code AS o_orderstatus FROM {rows}
          JOIN {codes_sql('o_orderpriority', 'fit_rows')} p ON o_orderpriority = p.v
          JOIN {codes_sql('c_mktsegment', 'fit_rows')} s ON c_mktsegment = s.v
          JOIN {codes_sql('o_orderstatus', 'fit_rows')} o ON o_orderstatus = o.v),"""
        for name, rows in (("fit_codes", "fit_rows"), ("new_codes", "new_rows")))
    scaled = ", ".join(f"(n.{c} - (SELECT avg({c}) FROM fit_codes)) / (SELECT stddev_samp({c}) FROM fit_codes) AS {c}"
                       for c in FEATURES)
    return f"{filled} {coded} prepared AS (SELECT o_orderkey, {scaled}, o_orderstatus FROM new_codes n)"


@query("preprocessor_classification",
       f"WITH {TRAIN}, {prepared_sql('test')} SELECT o_orderkey, "
       + ", ".join(f"round({c}, {PLACES}) + 0.0 AS {c}" for c in FEATURES) + ", o_orderstatus FROM prepared")
def preprocessor_classification_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fitted on earlier orders, applied to later ones."""
    train, test = orders_split(spark, sf_dir)
    fitted = TablePreprocessor("classification", keep=[KEY]).fit(train, TARGET)
    return rounded(fitted, test)


def rounded(fitted: FittedPreprocessor, df: DataFrame) -> DataFrame:
    """The prepared features in doubles: the float cast of ``transform`` is checked on its own."""
    prepared = apply_scales(fitted.encode_target(fitted.encode(fitted.fill(df))), fitted.scales)
    return prepared.select(*fitted.keep, *(round_to(ref(c), PLACES).alias(c) for c in fitted.features),
                           ref(fitted.target))


PART_FEATURES = ["p_size", "p_brand", "p_type", "p_serial"]
PART_FIT = f"""WITH {PARTS}, train AS (SELECT * FROM p WHERE is_train), test AS (SELECT * FROM p WHERE NOT is_train),
  numbers AS (SELECT p_partkey, TRY_CAST(coalesce(p_size, (SELECT CASE WHEN count(TRY_CAST(p_size AS DOUBLE)) = count(p_size)
                THEN CAST(median(TRY_CAST(p_size AS DOUBLE)) AS VARCHAR) ELSE {mode_sql('p_size', 'train')} END FROM train)) AS DOUBLE) AS p_size,
              coalesce(p_serial, (SELECT median(p_serial) FROM train)) AS p_serial, p_retailprice, is_train FROM p),
  middle AS (SELECT coalesce(median(p_size), 0) AS p_size FROM numbers WHERE is_train),
  whole AS (SELECT p_partkey, coalesce(n.p_size, m.p_size) AS p_size, p_serial, is_train,
              coalesce(p_retailprice, (SELECT median(p_retailprice) FROM train)) AS p_retailprice FROM numbers n, middle m)"""


def parts_sql(where: str) -> str:
    def scaled(c: str) -> str:
        return (f"round(({c} - (SELECT avg({c}) FROM whole WHERE is_train)) / "
                f"(SELECT stddev_pop({c}) FROM whole WHERE is_train), {PLACES}) + 0.0 AS {c}")

    return (f"{PART_FIT} SELECT p_partkey, {scaled('p_size')}, 0.0::DOUBLE AS p_brand, 0.0::DOUBLE AS p_type, "
            f"{scaled('p_serial')} FROM whole WHERE {where}")


def parts_fitted(spark: SparkSession, sf_dir: str) -> tuple[FittedPreprocessor, DataFrame, DataFrame]:
    parts = parts_role(spark, sf_dir)
    train, test = (parts.filter(c).drop("is_train") for c in ("is_train", "NOT is_train"))
    return TablePreprocessor("regression", keep=["p_partkey"]).fit(train, "p_retailprice"), train, test


@query("regression_features", parts_sql("is_train"))
def regression_features_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A half numeric text column is coerced and refilled, a text column becomes constant."""
    fitted, train, _ = parts_fitted(spark, sf_dir)
    return rounded(fitted, train).drop("p_retailprice")


@query("regression_features_apply", parts_sql("NOT is_train"))
def regression_features_apply_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    fitted, _, test = parts_fitted(spark, sf_dir)
    return rounded(fitted, test).drop("p_retailprice")


@query("regression_target", f"WITH {PARTS}, train AS (SELECT * FROM p WHERE is_train) SELECT p_partkey, 'fitted' AS fill, "
                            "coalesce(p_retailprice, (SELECT median(p_retailprice) FROM train)) AS p_retailprice FROM p "
                            "WHERE NOT is_train UNION ALL SELECT p_partkey, 'own', coalesce(p_retailprice, "
                            "(SELECT median(p_retailprice) FROM p WHERE NOT is_train)) FROM p WHERE NOT is_train "
                            "UNION ALL SELECT p_partkey, 'train', coalesce(p_retailprice, (SELECT median(p_retailprice) "
                            "FROM train)) FROM p WHERE is_train")
def regression_target_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A missing target takes the training median, or on request the new table's own."""
    fitted, train, test = parts_fitted(spark, sf_dir)
    own = FittedPreprocessor(**{**fitted.__dict__, "target_fill": None})
    return reduce(DataFrame.unionByName, (
        f.encode_target(df).select("p_partkey", F.lit(name).alias("fill"), "p_retailprice")
        for name, f, df in (("fitted", fitted, test), ("own", own, test), ("train", fitted, train))))


@query("preprocessor_regression", parts_sql("NOT is_train").replace(
    f"{PLACES}) + 0.0 AS p_serial FROM", f"{PLACES}) + 0.0 AS p_serial, p_retailprice FROM"))
def preprocessor_regression_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    fitted, _, test = parts_fitted(spark, sf_dir)
    return rounded(fitted, test)


@query("fitted_state_roundtrip", f"WITH {TRAIN} SELECT count(*) AS rows, count(*) AS equal_rows FROM test")
def fitted_state_roundtrip_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A saved and reloaded preprocessor gives the same rows."""
    train, test = orders_split(spark, sf_dir)
    fitted = TablePreprocessor("classification", keep=[KEY]).fit(train, TARGET)
    folder = scratch_folder(spark, "state")
    fitted.save(spark, folder)
    again = FittedPreprocessor.load(spark, folder)
    one, two = (f.transform(test).select(KEY, F.struct(*FEATURES, TARGET).alias(name))
                for f, name in ((fitted, "one"), (again, "two")))
    return one.join(two, KEY).agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("one") == F.col("two")).alias("equal_rows"))


@query("prepared_profile",
       f"WITH {TRAIN}, {prepared_sql('t')}, long AS (" + " UNION ALL ".join(
           f"SELECT o_orderstatus, '{c}' AS feature, {c} AS value FROM prepared" for c in FEATURES)
       + f") SELECT o_orderstatus, feature, count(*) AS rows, round(avg(value), {PLACES}) + 0.0 AS mean_value, "
         f"round(stddev_samp(value), {PLACES}) + 0.0 AS sd_value FROM long GROUP BY o_orderstatus, feature")
def prepared_profile_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """After filling, coding and standardizing: count, mean and deviation of each feature per class."""
    train, _ = orders_split(spark, sf_dir)
    fitted = TablePreprocessor("classification", keep=[KEY]).fit(train, TARGET)
    both = orders_role(spark, sf_dir).drop("is_train")
    prepared = apply_scales(fitted.encode_target(fitted.encode(fitted.fill(both))), fitted.scales)
    return (prepared.unpivot([TARGET], FEATURES, "feature", "value").groupBy(TARGET, "feature")
            .agg(F.count(F.lit(1)).alias("rows"), round_to(F.avg("value"), PLACES).alias("mean_value"),
                 round_to(F.stddev_samp("value"), PLACES).alias("sd_value")))
