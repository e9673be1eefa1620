"""Queries on encoding, scaling, shape transforms and outlier fences."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from tablewright.functions import ref, round_to
from tablewright.functions.scalar import (CENTRE_BOTTOM, CENTRE_TOP, FAR_BOTTOM, FAR_TOP, NEAR_BOTTOM, NEAR_TOP,
                                          yeo_johnson)
from tablewright.operators.encode import apply_labels, fit_labels, label_encode, one_hot
from tablewright.operators.outliers import iqr_filter
from tablewright.operators.scale import (CLIP, QUANTILES, apply_quantile_grids, apply_scales, fit_powers, fit_quantile_grids,
                                         fit_scales, normalize)
from tablewright.queries.registry import query
from tablewright.queries.tables import (KEY, NUMBERS, ORDERS, TEXTS, TRAIN, codes_sql, orders_role, orders_split,
                                        round_sql, table)

PLACES = 6


def rounded(df: DataFrame, columns: list[str], keep: list[str]) -> DataFrame:
    return df.select(*keep, *(round_to(ref(c), PLACES).alias(c) for c in columns))


@query("label_encode", f"WITH {ORDERS} SELECT o_orderkey, p.code AS o_orderpriority, s.code AS c_mktsegment FROM t "
                       f"LEFT JOIN {codes_sql('o_orderpriority', 't')} p ON t.o_orderpriority = p.v "
                       f"LEFT JOIN {codes_sql('c_mktsegment', 't')} s ON t.c_mktsegment = s.v")
def label_encode_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label_encode(orders_role(spark, sf_dir), TEXTS).select(KEY, *TEXTS)


UNSEEN_SQL = ("SELECT l_orderkey, l_linenumber, l_quantity, CASE WHEN (SELECT bool_or(n.code IS NULL) FROM new n) "
              "THEN 0 ELSE new.code END AS {0} FROM new")


@query("label_encode_unseen",
       "WITH known AS (SELECT * FROM lineitem WHERE l_shipdate < TIMESTAMP '2001-08-20'), "
       f"codes AS {codes_sql('CAST(l_shipdate AS DATE)', 'known')}, "
       f"flags AS {codes_sql('l_returnflag', 'known')}, "
       "new AS (SELECT l_orderkey, l_linenumber, l_quantity, c.code AS day, f.code AS flag "
       "FROM lineitem LEFT JOIN codes c ON CAST(l_shipdate AS DATE) = c.v LEFT JOIN flags f ON l_returnflag = f.v) "
       "SELECT l_orderkey, l_linenumber, l_quantity, CASE WHEN (SELECT bool_or(n.day IS NULL) FROM new n) THEN 0 "
       "ELSE day END AS day_column_zero, coalesce(day, 0) AS day_row_zero, "
       "coalesce(day, (SELECT count(*) FROM codes)) AS day_keep, flag FROM new")
def label_encode_unseen_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ship days known before a date, applied to all lines: later days are unseen."""
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", F.to_date("l_shipdate").cast("string").alias("day"),
        F.col("l_returnflag").alias("flag"), "l_shipdate")
    codes = fit_labels(lines.filter("l_shipdate < TIMESTAMP_NTZ '2001-08-20'"), ["day", "flag"])
    wide = lines.withColumns({f"day_{rule}": F.col("day") for rule in ("column_zero", "row_zero", "keep")})
    for rule in ("column_zero", "row_zero", "keep"):
        renamed = type(codes)({f"day_{rule}": codes.listed["day"]}, {}, {f"day_{rule}": codes.sizes["day"]})
        wide = apply_labels(wide, renamed, rule)
    flags = type(codes)({"flag": codes.listed["flag"]}, {}, {"flag": codes.sizes["flag"]})
    return apply_labels(wide, flags).drop("day", "l_shipdate")


@query("encode_target", f"SELECT o_orderkey, c.code AS o_orderstatus FROM orders "
                        f"JOIN {codes_sql('o_orderstatus', 'orders')} c ON o_orderstatus = c.v")
def encode_target_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(KEY, "o_orderstatus")
    return apply_labels(orders, fit_labels(orders, ["o_orderstatus"]))


@query("encode_target_unseen",
       f"WITH k AS (SELECT * FROM orders WHERE o_orderstatus <> 'P'), c AS {codes_sql('o_orderstatus', 'k')} "
       "SELECT o_orderkey, CAST(0 AS BIGINT) AS whole_column, coalesce(c.code, 0) AS own_row FROM orders "
       "LEFT JOIN c ON o_orderstatus = c.v")
def encode_target_unseen_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets learned on finished and open orders, applied where pending ones occur too."""
    orders = table(spark, sf_dir, "orders").select(KEY, F.col("o_orderstatus").alias("whole_column"))
    codes = fit_labels(orders.filter("whole_column <> 'P'"), ["whole_column"])
    rows = type(codes)({"own_row": codes.listed["whole_column"]}, {}, {"own_row": codes.sizes["whole_column"]})
    return apply_labels(apply_labels(orders.withColumn("own_row", F.col("whole_column")), codes), rows, "row_zero")


SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


@query("one_hot", "SELECT c_custkey, " + ", ".join(
    f"CAST(c_mktsegment = '{s}' AS INTEGER) AS c_mktsegment_{s}" for s in SEGMENTS) + " FROM customer")
def one_hot_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return one_hot(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), ["c_mktsegment"])


def scaled_sql(centre: str, width: str, columns: list[str] = NUMBERS, source: str = "t", fitted: str = "t") -> str:
    """Each column minus its centre over its width, both taken from the fitted table."""
    parts = ", ".join(
        round_sql(f"(CAST({c} AS DOUBLE) - (SELECT {centre.format(c)} FROM {fitted})) / "
                  f"(SELECT {width.format(c)} FROM {fitted})") + f" AS {c}" for c in columns)
    return f"SELECT o_orderkey, {parts} FROM {source}"


def scaled_query(spark: SparkSession, sf_dir: str, method: str) -> DataFrame:
    return rounded(normalize(orders_role(spark, sf_dir), NUMBERS, method), NUMBERS, [KEY])


@query("zscore_sample", f"WITH {ORDERS} " + scaled_sql("avg({0})", "stddev_samp({0})"))
def zscore_sample_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scaled_query(spark, sf_dir, "zscore_sample")


@query("zscore_population", f"WITH {ORDERS} " + scaled_sql("avg({0})", "stddev_pop({0})"))
def zscore_population_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scaled_query(spark, sf_dir, "zscore")


@query("zscore_apply_fitted",
       f"WITH {TRAIN} " + scaled_sql("avg({0})", "stddev_samp({0})", source="test", fitted="train"))
def zscore_apply_fitted_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = orders_split(spark, sf_dir)
    return rounded(apply_scales(test, fit_scales(train, NUMBERS, "zscore_sample")), NUMBERS, [KEY])


LINE_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("normalize_zscore", "SELECT l_orderkey, l_linenumber, " + ", ".join(
    round_sql(f"({c} - (SELECT avg({c}) FROM lineitem)) / (SELECT stddev_pop({c}) FROM lineitem)") + f" AS {c}"
    for c in LINE_NUMBERS) + " FROM lineitem")
def normalize_zscore_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    return rounded(normalize(lines, LINE_NUMBERS), LINE_NUMBERS, ["l_orderkey", "l_linenumber"])


@query("normalize_minmax", f"WITH {ORDERS} " + scaled_sql("min({0})", "(max({0}) - min({0}))"))
def normalize_minmax_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scaled_query(spark, sf_dir, "minmax")


@query("normalize_maxabs", f"WITH {ORDERS} " + scaled_sql("0 * count({0})", "max(abs({0}))"))
def normalize_maxabs_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scaled_query(spark, sf_dir, "maxabs")


@query("normalize_robust",
       f"WITH {ORDERS} " + scaled_sql("median({0})", "(quantile_cont({0}, 0.75) - quantile_cont({0}, 0.25))"))
def normalize_robust_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scaled_query(spark, sf_dir, "robust")


@query("normalize_target", "SELECT p_partkey, "
       + round_sql("(p_size - (SELECT avg(p_size) FROM part)) / (SELECT stddev_pop(p_size) FROM part)") + " AS p_size, "
       + round_sql("(p_retailprice - (SELECT avg(p_retailprice) FROM part)) / (SELECT stddev_pop(p_retailprice) "
                   "FROM part)") + " AS p_retailprice, round(p_retailprice, 6) AS restored FROM part")
def normalize_target_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The target rescaled with the features, and mapped back."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice")
    scales = fit_scales(part, ["p_size", "p_retailprice"])
    scaled = apply_scales(part, scales)
    restored = round_to(scales["p_retailprice"].undo(F.col("p_retailprice")), PLACES).alias("restored")
    return rounded(scaled, ["p_size", "p_retailprice"], ["p_partkey", restored])


@query("normalize_fit_on_train",
       f"WITH {TRAIN} " + scaled_sql("avg({0})", "stddev_pop({0})", source="t", fitted="train").replace(
           "SELECT o_orderkey,", "SELECT o_orderkey, 'train' AS fit_on,", 1) + " UNION ALL "
       + scaled_sql("avg({0})", "stddev_pop({0})", source="train", fitted="train").replace(
           "SELECT o_orderkey,", "SELECT o_orderkey, 'each',", 1) + " UNION ALL "
       + scaled_sql("avg({0})", "stddev_pop({0})", source="test", fitted="test").replace(
           "SELECT o_orderkey,", "SELECT o_orderkey, 'each',", 1))
def normalize_fit_on_train_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both ways of fitting, on both splits."""
    train, test = orders_split(spark, sf_dir)
    tables = [("train", train, train), ("train", test, train), ("each", train, train), ("each", test, test)]
    return reduce(DataFrame.unionByName, (
        rounded(normalize(df, NUMBERS, fit_on=source), NUMBERS, [KEY, F.lit(way).alias("fit_on")])
        for way, df, source in tables))


EVENT_GRID = (f"WITH n AS (SELECT least({QUANTILES}, count(value)) AS points FROM events), "
              "p AS (SELECT unnest(generate_series(0, points - 1)) / (points - 1)::DOUBLE AS p FROM n), "
              "s AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS place, count(*) OVER () AS rows FROM events), "
              "w AS (SELECT p, p * ((SELECT max(rows) FROM s) - 1) AS place FROM p), "
              "q AS (SELECT w.p, CASE WHEN a.value = b.value THEN a.value ELSE (ceil(w.place) - w.place) * a.value "
              "+ (w.place - floor(w.place)) * b.value END AS v FROM w JOIN s a ON a.place = floor(w.place) "
              "JOIN s b ON b.place = ceil(w.place)), "
              "g AS (SELECT v, min(p) AS low, max(p) AS high, lead(v) OVER (ORDER BY v) AS next_v, "
              "lead(min(p)) OVER (ORDER BY v) AS next_low FROM q GROUP BY v), "
              "u AS (SELECT e.event_id, CASE WHEN e.value = g.v THEN (g.low + g.high) / 2 ELSE g.high + (e.value - g.v) "
              "/ (g.next_v - g.v) * (g.next_low - g.high) END AS place FROM events e ASOF JOIN g ON e.value >= g.v)")


def quantile_query(spark: SparkSession, sf_dir: str, shape: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "value")
    return rounded(apply_quantile_grids(events, fit_quantile_grids(events, ["value"]), shape), ["value"], ["event_id"])


@query("quantile_uniform", f"{EVENT_GRID} SELECT event_id, {round_sql('place')} AS value FROM u")
def quantile_uniform_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantile_query(spark, sf_dir, "uniform")


def polynomial_sql(x: str, coefficients: tuple[float, ...]) -> str:
    return reduce(lambda total, c: f"({total} * {x} + {c!r}::DOUBLE)", reversed(coefficients[:-1]),
                  f"{coefficients[-1]!r}::DOUBLE")


def ratio_sql(x: str, top: tuple[float, ...], bottom: tuple[float, ...]) -> str:
    return f"{polynomial_sql(x, top)} / {polynomial_sql(x, bottom)}"


@query("quantile_normal",
       f"{EVENT_GRID}, c AS (SELECT event_id, least(greatest(place, {CLIP}), 1 - {CLIP}) AS p FROM u), "
       "d AS (SELECT event_id, p - 0.5 AS q, 0.180625 - (p - 0.5) * (p - 0.5) AS i, sqrt(-ln(least(p, 1 - p))) AS r FROM c), "
       "e AS (SELECT event_id, q, i, r, r - 1.6 AS a, r - 5.0 AS b FROM d) "
       "SELECT event_id, " + round_sql(
           f"CASE WHEN abs(q) <= 0.425 THEN q * {ratio_sql('i', CENTRE_TOP, CENTRE_BOTTOM)} ELSE sign(q) * CASE WHEN "
           f"r <= 5 THEN {ratio_sql('a', NEAR_TOP, NEAR_BOTTOM)} ELSE {ratio_sql('b', FAR_TOP, FAR_BOTTOM)} END END")
       + " AS value FROM e")
def quantile_normal_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantile_query(spark, sf_dir, "normal")


@query("yeo_johnson", "SELECT c_custkey, " + ", ".join(
    round_sql(f"CASE WHEN c_acctbal / 1000 >= 0 THEN {right} ELSE {left} END") + f" AS power_{name}"
    for name, right, left in (
        ("half", "(pow(c_acctbal / 1000 + 1, 0.5) - 1) / 0.5", "-(pow(1 - c_acctbal / 1000, 1.5) - 1) / 1.5"),
        ("zero", "ln(1 + c_acctbal / 1000)", "-(pow(1 - c_acctbal / 1000, 2.0) - 1) / 2.0"),
        ("two", "(pow(c_acctbal / 1000 + 1, 2.0) - 1) / 2.0", "-ln(1 - c_acctbal / 1000)"))) + " FROM customer")
def yeo_johnson_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("c_acctbal") / 1000
    return table(spark, sf_dir, "customer").select(
        "c_custkey", *(round_to(yeo_johnson(x, p), PLACES).alias(f"power_{name}")
                       for name, p in (("half", 0.5), ("zero", 0.0), ("two", 2.0))))


@query("yeo_johnson_fit", """
WITH d AS (SELECT unnest([{'feature': 'c_acctbal', 'x': c_acctbal / 1000}, {'feature': 'c_nationkey', 'x': c_nationkey::DOUBLE}], recursive := true) FROM customer),
p AS (SELECT range / 2000.0::DOUBLE AS p FROM range(-4000, 8001)), s AS (SELECT feature, x, count(*) AS w FROM d GROUP BY feature, x),
v AS (SELECT feature, p, sum(w) AS n, sum(w * sign(x) * ln(1 + abs(x))) AS slope, sum(w * y * y) / sum(w) - pow(sum(w * y) / sum(w), 2) AS variance
      FROM (SELECT feature, p, x, w, CASE WHEN x >= 0 AND p = 0 THEN ln(1 + x) WHEN x >= 0 THEN (pow(1 + x, p) - 1) / p
                                          WHEN p = 2 THEN -ln(1 - x) ELSE -(pow(1 - x, 2 - p) - 1) / (2 - p) END AS y FROM s, p) GROUP BY feature, p)
SELECT feature, round(arg_max(p, -n / 2 * ln(variance) + (p - 1) * slope), 2) + 0.0 AS power FROM v GROUP BY feature""")
def yeo_johnson_fit_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The power of highest likelihood of two columns; SQL tries every two-thousandth from -2 to 4."""
    rows = table(spark, sf_dir, "customer").select((F.col("c_acctbal") / 1000).alias("c_acctbal"), "c_nationkey")
    found = list(fit_powers(rows, ["c_acctbal", "c_nationkey"]).items())
    return spark.createDataFrame(found, "feature string, power double").withColumn("power", round_to(ref("power"), 2))


@query("iqr_filter", "WITH f AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events) "
                     "SELECT event_id, event_type, value FROM events, f "
                     "WHERE value BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a)")
def iqr_filter_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iqr_filter(table(spark, sf_dir, "events").select("event_id", "event_type", "value"), ["value"])
