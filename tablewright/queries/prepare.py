"""Queries on reading, cleaning, validating and filling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tablewright.functions import parse_number, ref, round_to
from tablewright.operators.clean import (align_features, clean_sentinels, coerce_numeric, count_missing, drop_ignored,
                                         drop_null_rows, drop_report, typed_output)
from tablewright.operators.distribution import moments
from tablewright.operators.impute import (fill_missing, fit_fills, fit_median_mode, impute, impute_mean as mean_fill,
                                          impute_median as median_fill, impute_mode as mode_fill, numeric_like)
from tablewright.queries.registry import query
from tablewright.queries.tables import (FEATURES, KEY, NUMBERS, ORDERS, PARTS, RAW_ORDERS, TARGET, TEXTS, TRAIN,
                                        mode_sql, orders_role, orders_split, parts_role, raw_orders, table)
from tablewright.schema import feature_types, split_target, validate
from tablewright.session import scratch_folder
from tablewright.sources.pairs import TablePair, discover_pairs, experiment_name, read_pair, write_csv, write_pair
from tablewright.sources.store import read_scenarios, scenario_counts, write_scenario

COLUMNS = f"{KEY}, {', '.join(FEATURES)}, {TARGET}"


@query("read_pair", f"WITH {RAW_ORDERS} SELECT CASE WHEN is_train THEN 'train' ELSE 'test' END AS split, o_orderkey, "
                    "o_totalprice, CASE WHEN o_orderpriority <> '?' THEN o_orderpriority END AS o_orderpriority, "
                    "c_acctbal, c_mktsegment, c_nationkey, o_orderstatus FROM raw")
def read_pair_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the orders as a CSV pair, read it back with inferred types."""
    both = raw_orders(spark, sf_dir)
    folder = scratch_folder(spark, "pair")
    write_pair(TablePair(both.filter("is_train").drop("is_train"), both.filter("NOT is_train").drop("is_train")), folder)
    back = read_pair(spark, folder)
    parts = [t.select(F.lit(s).alias("split"), F.col(KEY).cast("bigint").alias(KEY),
                      *FEATURES, TARGET) for s, t in (("train", back.train), ("test", back.test))]
    return parts[0].unionByName(parts[1])


@query("read_pair_types", "SELECT CASE WHEN n_nationkey < 12 THEN 'train' ELSE 'test' END AS split, n_nationkey, CASE WHEN "
                          "n_nationkey < 12 THEN n_nationkey::DOUBLE ELSE n_nationkey + 0.5 END AS wide, n_name || chr(10) || "
                          "'\"of\", ' || n_regionkey AS said, CASE WHEN n_nationkey >= 12 THEN n_regionkey END AS late FROM nation")
def read_pair_types_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The test column is wider than train's, texts hold line breaks and quotes, train lacks a column's values."""
    nation = table(spark, sf_dir, "nation")
    early = F.col("n_nationkey") < 12
    said = F.concat("n_name", F.lit('\n"of", '), F.col("n_regionkey").cast("string")).alias("said")
    train = nation.filter(early).select("n_nationkey", F.col("n_nationkey").cast("bigint").alias("wide"), said,
                                        F.lit(None).cast("string").alias("late"))
    test = nation.filter(~early).select("n_nationkey", (F.col("n_nationkey") + 0.5).cast("double").alias("wide"), said,
                                        F.col("n_regionkey").cast("string").alias("late"))
    folder = scratch_folder(spark, "pair")
    write_pair(TablePair(train, test), folder)
    back = read_pair(spark, folder)
    kinds = dict(nation.dtypes)
    parts = [t.select(F.lit(s).alias("split"), F.col("n_nationkey").cast(kinds["n_nationkey"]).alias("n_nationkey"), "wide", "said",
                      F.col("late").cast(kinds["n_regionkey"]).alias("late")) for s, t in (("train", back.train), ("test", back.test))]
    return parts[0].unionByName(parts[1])


@query("experiment_name", "SELECT event_id, event_type AS scenario FROM events")
def experiment_name_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One folder per event type; each row's scenario is its file's parent folder."""
    folder = scratch_folder(spark, "names")
    events = table(spark, sf_dir, "events").select("event_id", "event_type")
    events.write.option("header", True).partitionBy("event_type").csv(folder)
    files = spark.read.option("header", True).option("recursiveFileLookup", True).schema("event_id bigint").csv(folder)
    named = experiment_name(F.col("_metadata.file_path"))
    return files.select("event_id", F.regexp_replace(named, "^event_type=", "").alias("scenario"))


@query("discover_pairs", "SELECT DISTINCT event_type AS scenario, true AS has_pair FROM events")
def discover_pairs_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pair per event type is found; a folder that lacks its test file is not."""
    folder = scratch_folder(spark, "found")
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    for kind in [r[0] for r in events.select("event_type").distinct().collect()]:
        mine = events.filter(F.col("event_type") == kind)
        write_pair(TablePair(mine.filter("value < 50"), mine.filter("value >= 50")), f"{folder}/{kind}")
    write_csv(events, f"{folder}/incomplete/train.csv")
    return discover_pairs(spark, folder).select("scenario", F.lit(True).alias("has_pair"))


@query("clean_sentinels", f"WITH {RAW_ORDERS} SELECT o_orderkey, o_totalprice, "
                          "CASE WHEN o_orderpriority NOT IN ('?', 'nan', 'NaN') THEN o_orderpriority END "
                          "AS o_orderpriority, c_acctbal, c_mktsegment, c_nationkey, o_orderstatus FROM raw")
def clean_sentinels_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = raw_orders(spark, sf_dir).drop("is_train")
    nan = F.lit(float("nan"))
    return clean_sentinels(raw.withColumn("o_totalprice", F.coalesce("o_totalprice", nan)))


@query("feature_types", "SELECT 'c_acctbal' AS column_name, 'numeric' AS role, count(c_acctbal) AS present FROM customer "
                        "UNION ALL SELECT 'c_custkey', 'numeric', count(c_custkey) FROM customer "
                        "UNION ALL SELECT 'c_name', 'categorical', count(c_name) FROM customer "
                        "UNION ALL SELECT 'c_nationkey', 'numeric', count(c_nationkey) FROM customer")
def feature_types_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles of the customer columns but the target, with the present values of each."""
    customer = table(spark, sf_dir, "customer")
    numeric, text = feature_types(customer, "c_mktsegment")
    roles = {**dict.fromkeys(numeric, "numeric"), **dict.fromkeys(text, "categorical")}
    present = customer.agg(*(F.count(c).alias(c) for c in roles))
    return present.unpivot([], list(roles), "column_name", "present").select(
        "column_name", F.when(F.col("column_name").isin(numeric), "numeric").otherwise("categorical").alias("role"),
        "present")


@query("split_target", "SELECT o_orderpriority, o_totalprice, o_custkey, count(*) AS n FROM orders "
                       "GROUP BY o_orderpriority, o_totalprice, o_custkey")
def split_target_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    features, target = split_target(table(spark, sf_dir, "orders"), "o_orderstatus")
    assert target.columns == ["o_orderstatus"]
    return (features.groupBy("o_orderpriority", "o_totalprice", "o_custkey").agg(F.count(F.lit(1)).alias("n")))


@query("drop_ignored", "SELECT l_quantity, l_discount, l_extendedprice FROM lineitem")
def drop_ignored_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with columns under ignored names, which the regression task leaves out."""
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("instant"), F.col("l_shipdate").alias("dteday"), F.col("l_suppkey").alias("agent"),
        "l_quantity", "l_discount", "l_extendedprice")
    return drop_ignored(lines, "regression")


@query("align_features", "SELECT o_orderkey, o_totalprice, 0 AS o_discount, o_custkey FROM orders")
def align_features_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_features(table(spark, sf_dir, "orders"), ["o_totalprice", "o_discount", "o_custkey"], [KEY])


@query("validate_inputs", "SELECT 'empty' AS case_name, 'the table is empty' AS message, (SELECT count(*) FROM orders) "
                          "AS rows UNION ALL SELECT 'missing target', 'target column ''salary'' is not in the table', "
                          "(SELECT count(*) FROM orders) UNION ALL SELECT 'target only', 'the table has no feature "
                          "column', (SELECT count(*) FROM orders) UNION ALL SELECT 'valid', 'ok', "
                          "(SELECT count(*) FROM orders)")
def validate_inputs_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the checks say of the orders, of none of them, without target and without features."""
    orders = table(spark, sf_dir, "orders")
    cases = {"valid": (orders, "o_orderstatus"), "empty": (orders.filter("o_totalprice < 0"), "o_orderstatus"),
             "missing target": (orders, "salary"), "target only": (orders.select("o_orderstatus"), "o_orderstatus")}

    def verdict(df: DataFrame, target: str) -> str:
        try:
            validate(df, target)
        except ValueError as error:
            return str(error)
        return "ok"

    said = F.create_map(*(F.lit(x) for name, case in cases.items() for x in (name, verdict(*case))))
    return orders.agg(F.count(F.lit(1)).alias("rows")).select(
        F.explode(said).alias("case_name", "message"), "rows")


@query("nan_gate", f"WITH {ORDERS} SELECT count(*) FILTER (o_totalprice IS NULL OR o_orderpriority IS NULL OR "
                   "c_acctbal IS NULL OR c_mktsegment IS NULL OR c_nationkey IS NULL OR o_orderstatus IS NULL) "
                   "AS missing_rows, count(*) AS total_rows FROM t")
def nan_gate_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_missing(orders_role(spark, sf_dir), [*FEATURES, TARGET])


@query("coerce_numeric", f"WITH {PARTS} SELECT p_partkey, TRY_CAST(p_size AS DOUBLE) AS p_size, "
                         "TRY_CAST(p_type AS DOUBLE) AS p_type FROM p")
def coerce_numeric_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coerce_numeric(parts_role(spark, sf_dir), ["p_size", "p_type"]).select("p_partkey", "p_size", "p_type")


@query("typed_output", "SELECT o_orderkey, CAST(o_totalprice AS FLOAT) AS o_totalprice, CAST(o_custkey AS FLOAT) "
                       "AS o_custkey, CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS urgency FROM orders")
def typed_output_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumn("urgency", F.substring("o_orderpriority", 1, 1))
    return typed_output(orders, ["o_totalprice", "o_custkey"], "urgency", "classification", keep=[KEY])


@query("drop_null_rows", f"WITH {ORDERS} SELECT {COLUMNS} FROM t WHERE o_totalprice IS NOT NULL "
                         "AND o_orderpriority IS NOT NULL AND c_acctbal IS NOT NULL")
def drop_null_rows_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_null_rows(orders_role(spark, sf_dir).drop("is_train"), TARGET)


@query("drop_report", f"WITH {ORDERS}, n AS (SELECT count(*) FILTER (o_totalprice IS NULL OR o_orderpriority IS NULL "
                      "OR c_acctbal IS NULL) AS removed_rows, count(*) AS total_rows FROM t) SELECT removed_rows, "
                      "total_rows, round(100.0::DOUBLE * removed_rows / total_rows, 2) AS percent_removed FROM n")
def drop_report_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_report(orders_role(spark, sf_dir).drop("is_train"), TARGET)


@query("numeric_like", f"WITH {PARTS} "
       + " UNION ALL ".join(
           f"SELECT '{c}' AS column_name, count(TRY_CAST({c} AS DOUBLE)) > 0 AS any_parses, "
           f"count(TRY_CAST({c} AS DOUBLE)) = count({c}) AS all_parse FROM p"
           for c in ("p_size", "p_brand", "p_type", "p_serial")))
def numeric_like_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = parts_role(spark, sf_dir)
    names = ["p_size", "p_brand", "p_type", "p_serial"]
    types = {f.name: f.dataType for f in parts.schema.fields}
    stats = moments(parts, names)
    return spark.createDataFrame([(c, numeric_like(stats[c], types[c], "any"), numeric_like(stats[c], types[c], "all"))
                                  for c in names], "column_name string, any_parses boolean, all_parse boolean")


def filled(spark: SparkSession, sf_dir: str, columns: list[str]) -> DataFrame:
    orders = orders_role(spark, sf_dir)
    return fill_missing(orders, fit_median_mode(orders, columns)).select(KEY, *columns)


@query("impute_median", f"WITH {ORDERS} SELECT o_orderkey, coalesce(o_totalprice, (SELECT median(o_totalprice) FROM t)) "
                        "AS o_totalprice, coalesce(c_acctbal, (SELECT median(c_acctbal) FROM t)) AS c_acctbal FROM t")
def impute_median_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filled(spark, sf_dir, ["o_totalprice", "c_acctbal"])


@query("impute_mode_categorical", f"WITH {ORDERS} SELECT o_orderkey, coalesce(o_orderpriority, "
       f"{mode_sql('o_orderpriority')}) AS o_orderpriority, coalesce(c_mktsegment, {mode_sql('c_mktsegment')}) "
       "AS c_mktsegment FROM t")
def impute_mode_categorical_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filled(spark, sf_dir, TEXTS)


@query("impute_all_null", f"WITH {ORDERS} SELECT o_orderkey, CAST(0 AS DOUBLE) AS no_number, '0' AS no_text FROM t")
def impute_all_null_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A numeric and a text column that hold nothing at all."""
    orders = orders_role(spark, sf_dir).select(
        KEY, F.when(F.col("o_totalprice") < 0, F.col("o_totalprice")).alias("no_number"),
        F.when(F.col("o_totalprice") < 0, F.col("c_mktsegment")).alias("no_text"))
    return fill_missing(orders, fit_median_mode(orders, ["no_number", "no_text"]))


@query("impute_apply_fitted", f"WITH {TRAIN} SELECT o_orderkey, coalesce(o_totalprice, (SELECT median(o_totalprice) "
       f"FROM train)) AS o_totalprice, coalesce(o_orderpriority, {mode_sql('o_orderpriority', 'train')}) "
       "AS o_orderpriority, coalesce(c_acctbal, (SELECT median(c_acctbal) FROM train)) AS c_acctbal FROM test")
def impute_apply_fitted_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = orders_split(spark, sf_dir)
    columns = ["o_totalprice", "o_orderpriority", "c_acctbal"]
    return fill_missing(test, fit_median_mode(train, columns)).select(KEY, *columns)


def numeric_fill_sql(price: str, balance: str) -> str:
    return (f"WITH {ORDERS} SELECT o_orderkey, round(coalesce(o_totalprice, {price}), 6) AS o_totalprice, "
            f"round(coalesce(c_acctbal, {balance}), 6) AS c_acctbal, coalesce(o_orderpriority, "
            f"{mode_sql('o_orderpriority')}) AS o_orderpriority, c_mktsegment, CAST(c_nationkey AS DOUBLE) AS c_nationkey, o_orderstatus FROM t")


def scenario_columns(df: DataFrame) -> DataFrame:
    return df.select(KEY, round_to(ref("o_totalprice"), 6).alias("o_totalprice"),
                     round_to(ref("c_acctbal"), 6).alias("c_acctbal"), "o_orderpriority", "c_mktsegment",
                     F.col("c_nationkey").cast("double").alias("c_nationkey"), TARGET)


@query("impute_mean", numeric_fill_sql("(SELECT avg(o_totalprice) FROM t)", "(SELECT avg(c_acctbal) FROM t)"))
def impute_mean_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scenario_columns(mean_fill(orders_role(spark, sf_dir).drop("is_train"), target=TARGET, keep=[KEY]))


@query("impute_mode_numeric", numeric_fill_sql(mode_sql("o_totalprice"), mode_sql("c_acctbal")))
def impute_mode_numeric_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scenario_columns(mode_fill(orders_role(spark, sf_dir).drop("is_train"), target=TARGET, keep=[KEY]))


@query("impute_median_scenario",
       numeric_fill_sql("(SELECT median(o_totalprice) FROM t)", "(SELECT median(c_acctbal) FROM t)"))
def impute_median_scenario_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scenario_columns(median_fill(orders_role(spark, sf_dir).drop("is_train"), target=TARGET, keep=[KEY]))


WAYS = {"mean": ("(SELECT avg(o_totalprice) FROM t)", ""), "median": ("(SELECT median(o_totalprice) FROM t)", ""),
        "mode": (mode_sql("o_totalprice"), ""), "drop": ("NULL", " WHERE o_totalprice IS NOT NULL "
                                                                 "AND c_acctbal IS NOT NULL")}


@query("impute_dispatch", f"WITH {ORDERS} " + " UNION ALL ".join(
    f"SELECT '{way}' AS way, count(*) AS rows, round(sum(coalesce(o_totalprice, {price})), 2) AS price_total, "
    f"count(coalesce(o_orderpriority, {mode_sql('o_orderpriority')})) AS priorities FROM t{where}"
    for way, (price, where) in WAYS.items()))
def impute_dispatch_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every way for numbers with the mode for text."""
    orders = orders_role(spark, sf_dir).drop("is_train")
    tables = [impute(orders, numeric=way, target=TARGET, keep=[KEY]).agg(
        F.lit(way).alias("way"), F.count(F.lit(1)).alias("rows"), F.round(F.sum("o_totalprice"), 2).alias("price_total"),
        F.count("o_orderpriority").alias("priorities")) for way in WAYS]
    found = tables[0]
    for other in tables[1:]:
        found = found.unionByName(other)
    return found


@query("scenario_store", f"WITH {ORDERS} SELECT scenario, CASE WHEN is_train THEN 'train' ELSE 'test' END AS split, "
                         "count(*) AS rows, CAST(sum(c_nationkey) AS DOUBLE) AS nations FROM (SELECT '02_imputed_mean' "
                         "AS scenario, * FROM t UNION ALL SELECT '01_without_NaN', * FROM t WHERE o_totalprice IS NOT NULL "
                         "AND o_orderpriority IS NOT NULL AND c_acctbal IS NOT NULL) GROUP BY 1, 2")
def scenario_store_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two variants written as partitions and read back as one table."""
    train, test = orders_split(spark, sf_dir)
    root = scratch_folder(spark, "store")
    for split, df in (("train", train), ("test", test)):
        write_scenario(drop_null_rows(df, TARGET), root, "01_without_NaN", split, [KEY])
        write_scenario(fill_missing(df, fit_fills(train, columns=[*NUMBERS, *TEXTS])), root, "02_imputed_mean",
                       split, [KEY])
    return read_scenarios(spark, root).groupBy("scenario", "split").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("c_nationkey").alias("nations"))


@query("scenario_counts", f"WITH {ORDERS} SELECT '01_without_NaN' AS scenario, CASE WHEN is_train THEN 'train' "
                          "ELSE 'test' END AS split, count(*) AS rows FROM t WHERE o_totalprice IS NOT NULL AND "
                          "o_orderpriority IS NOT NULL AND c_acctbal IS NOT NULL GROUP BY 2 UNION ALL SELECT "
                          "'02_imputed_mean', CASE WHEN is_train THEN 'train' ELSE 'test' END, count(*) FROM t GROUP BY 2")
def scenario_counts_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = orders_split(spark, sf_dir)
    tagged = [change(df).select(F.lit(name).alias("scenario"), F.lit(split).alias("split"))
              for split, df in (("train", train), ("test", test))
              for name, change in (("01_without_NaN", lambda d: drop_null_rows(d, TARGET)),
                                   ("02_imputed_mean", lambda d: impute(d, target=TARGET, fit_on=train, keep=[KEY])))]
    union = tagged[0]
    for other in tagged[1:]:
        union = union.unionByName(other)
    return scenario_counts(union)
