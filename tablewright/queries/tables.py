"""The supplied tables in the roles of the study's datasets, in Spark and as SQL.

The supplied tables hold no gaps. Each role makes some, by the same rule on both sides: an order of
unspecified priority reads ``?``, an order placed in February has no price, a negative account
balance counts as unknown.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tablewright.operators.clean import clean_sentinels


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


NUMBERS = ["o_totalprice", "c_acctbal", "c_nationkey"]
TEXTS = ["o_orderpriority", "c_mktsegment"]
FEATURES = ["o_totalprice", "o_orderpriority", "c_acctbal", "c_mktsegment", "c_nationkey"]
TARGET = "o_orderstatus"
KEY = "o_orderkey"


def raw_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their customers, gaps still as ``?`` and NULL."""
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return orders.join(customer, orders.o_custkey == customer.c_custkey).select(
        "o_orderkey",
        F.when(F.month("o_orderdate") != 2, F.col("o_totalprice")).alias("o_totalprice"),
        F.when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "?").otherwise(F.col("o_orderpriority"))
        .alias("o_orderpriority"),
        F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("c_acctbal"),
        "c_mktsegment", "c_nationkey", "o_orderstatus",
        (F.col("o_orderdate") < F.lit("2000-01-01").cast("timestamp_ntz")).alias("is_train"))


def orders_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with gaps as NULL: key, five features, target, and the split by order date."""
    return clean_sentinels(raw_orders(spark, sf_dir))


def orders_split(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    both = orders_role(spark, sf_dir)
    return both.filter("is_train").drop("is_train"), both.filter("NOT is_train").drop("is_train")


RAW_ORDERS = """raw AS (
  SELECT o_orderkey,
         CASE WHEN month(o_orderdate) <> 2 THEN o_totalprice END AS o_totalprice,
         CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN '?' ELSE o_orderpriority END AS o_orderpriority,
         CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS c_acctbal,
         c_mktsegment, c_nationkey, o_orderstatus,
         o_orderdate < TIMESTAMP '2000-01-01' AS is_train
  FROM orders JOIN customer ON o_custkey = c_custkey)"""
ORDERS = RAW_ORDERS + """, t AS (
  SELECT o_orderkey, o_totalprice, CASE WHEN o_orderpriority <> '?' THEN o_orderpriority END AS o_orderpriority,
         c_acctbal, c_mktsegment, c_nationkey, o_orderstatus, is_train FROM raw)"""
TRAIN = ORDERS + ", train AS (SELECT * FROM t WHERE is_train), test AS (SELECT * FROM t WHERE NOT is_train)"

LINES = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]
PRICE = "l_extendedprice"


def lines_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numeric regression: line items with a derived net price as the target."""
    return table(spark, sf_dir, "lineitem").select(*LINES, PRICE)


def parts_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mixed regression: parts, with a text size that does not always parse and a text type."""
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        F.when(F.col("p_size") > 45, "large").when(F.col("p_size") >= 4, F.col("p_size").cast("string"))
        .alias("p_size"),
        "p_brand", F.when(F.col("p_type") != "PROMO", F.col("p_type")).alias("p_type"),
        F.when(F.col("p_name") != "small ring", F.col("p_partkey").cast("double")).alias("p_serial"),
        F.when(F.col("p_size") > 2, F.col("p_retailprice")).alias("p_retailprice"),
        (F.col("p_brand") != "Brand#5").alias("is_train"))


PARTS = """p AS (
  SELECT p_partkey,
         CASE WHEN p_size > 45 THEN 'large' WHEN p_size >= 4 THEN CAST(p_size AS VARCHAR) END AS p_size,
         p_brand, CASE WHEN p_type <> 'PROMO' THEN p_type END AS p_type,
         CASE WHEN p_name <> 'small ring' THEN CAST(p_partkey AS DOUBLE) END AS p_serial,
         CASE WHEN p_size > 2 THEN p_retailprice END AS p_retailprice,
         p_brand <> 'Brand#5' AS is_train
  FROM part)"""


def mode_sql(column: str, source: str = "t") -> str:
    """The most frequent value, the smallest on ties."""
    return (f"(SELECT {column} FROM {source} WHERE {column} IS NOT NULL GROUP BY {column} "
            f"ORDER BY count(*) DESC, {column} LIMIT 1)")


def codes_sql(column: str, source: str) -> str:
    """(v, code) of a column in sorted order."""
    return (f"(SELECT v, row_number() OVER (ORDER BY v) - 1 AS code "
            f"FROM (SELECT DISTINCT {column} AS v FROM {source} WHERE {column} IS NOT NULL))")


def round_sql(expression: str, places: int = 6) -> str:
    return f"round({expression}, {places}) + 0.0"
