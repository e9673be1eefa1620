"""Cleaning, filling, encoding and scaling on small fixtures."""

from __future__ import annotations

import math
import statistics

import pytest
from pyspark.sql import functions as F, types as T

from tablewright.functions import normal_quantile, parse_number, yeo_johnson
from tablewright.functions.scalar import NUMBER_TEXT
from tablewright.operators.clean import (align_features, clean_sentinels, coerce_numeric, drop_ignored, drop_null_rows,
                                         drop_report, nan_gate)
from tablewright.operators.encode import apply_labels, fit_labels, one_hot
from tablewright.operators.impute import fit_median_mode, impute, remove_null_rows
from tablewright.operators.iterative import fit_iterative, impute_iterative
from tablewright.operators.scale import apply_quantile_grids, fit_powers, fit_quantile_grids, normalize, transform_shape
from tablewright.plans.preprocessor import FittedPreprocessor, TablePreprocessor
from tablewright.schema import as_supported, feature_types, validate

N = None
TRAIN_SCHEMA = "num_feature1 double, num_feature2 double, cat_feature1 string, cat_feature2 string, target bigint"


@pytest.fixture(scope="module")
def train(spark):
    return spark.createDataFrame(
        [(1.0, -1.0, "A", "X", 0), (2.0, -2.0, "B", N, 1), (3.0, N, "A", "Y", 0), (N, 1.0, "C", "Z", 1),
         (5.0, 2.0, N, "X", 1), (6.0, N, "B", "Y", 0), (7.0, 3.0, "C", N, 1), (N, 4.0, "A", "Z", 0)], TRAIN_SCHEMA)


@pytest.fixture(scope="module")
def test_rows(spark):
    return spark.createDataFrame([(2.0, 1.0, "B", "Y", 1), (N, 2.0, "D", "X", 0), (4.0, N, "A", "Z", 1),
                                  (6.0, 3.0, "C", "W", 0)], TRAIN_SCHEMA)


def column(df, name):
    return [r[name] for r in df.collect()]


def test_sentinels_match_exactly(spark):
    df = spark.createDataFrame([("?", float("nan")), (" ?", 1.0), ("nan", 2.0), ("NaN", 3.0), ("x", N)], "s string, d double")
    cleaned = clean_sentinels(df).collect()
    assert [r["s"] for r in cleaned] == [N, " ?", N, N, "x"]
    assert [r["d"] for r in cleaned] == [N, 1.0, 2.0, 3.0, N]


def test_roles_exclude_dates_and_reject_nesting(spark):
    df = spark.sql("SELECT 1 AS i, 1.5D AS d, 'a' AS s, true AS b, current_date() AS day, 2.5BD AS m")
    assert feature_types(df, "i") == (["d", "m"], ["s", "b"])
    assert dict(as_supported(df).dtypes)["m"] == "double"
    with pytest.raises(ValueError, match="nested"):
        as_supported(df.withColumn("a", F.array("i")))


def test_ignored_columns_only_for_regression(spark):
    lower = spark.createDataFrame([(1, 3)], "id int, x int")
    assert drop_ignored(lower, "classification", comparing_models=True).columns == ["id", "x"]
    df = spark.createDataFrame([(1, 2, 3)], "instant int, Id int, x int")
    assert drop_ignored(df, "classification").columns == ["instant", "Id", "x"]
    assert drop_ignored(df, "regression").columns == ["Id", "x"]
    assert drop_ignored(df, "classification", comparing_models=True).columns == ["x"]


def test_align_and_coerce(spark):
    df = spark.createDataFrame([("7", 1), ("x", 2)], "a string, extra int")
    assert [tuple(r) for r in align_features(coerce_numeric(df, ["a"]), ["b", "a"]).collect()] == [(0, 7.0), (0, N)]


def test_validation(spark, train):
    with pytest.raises(ValueError, match="not in the table"):
        validate(train, "salary")
    with pytest.raises(ValueError, match="empty"):
        validate(train.limit(0), "target")
    with pytest.raises(ValueError, match="no feature"):
        validate(train.select("target"), "target")
    for bad in (train.limit(0), train.select("target")):
        with pytest.raises(ValueError):
            TablePreprocessor().fit(bad, "target")
    with pytest.raises(ValueError):
        nan_gate(train, ["num_feature1"])
    with pytest.raises(ValueError):
        impute(train, task="ranking")


def test_fills(train):
    features = train.columns[:-1]
    fills = fit_median_mode(train, features)
    assert fills == {"num_feature1": 4.0, "num_feature2": 1.5, "cat_feature1": "A", "cat_feature2": "X"}


def test_drop_and_report(spark, train):
    assert drop_null_rows(train, "target").count() == 1
    assert remove_null_rows(train, target="target").count() == 1
    assert tuple(drop_report(train, "target").first()) == (7, 8, 87.5)
    assert tuple(drop_report(train.limit(0), "target").first()) == (0, 0, 0.0)


def test_impute_ways(train):
    assert column(impute(train, "mean", target="target"), "num_feature1")[3] == 4.0
    assert column(impute(train, "mode", target="target"), "num_feature1")[3] == 1.0
    assert impute(train, "drop", "mode", target="target").count() == 4
    assert impute(train, "median", "drop", target="target").count() == 5


def test_all_null_column(spark):
    df = spark.createDataFrame([(N, 1), (N, 2), (N, 3)], "feature double, target bigint")
    out = TablePreprocessor().fit(df, "target").transform(df, gate=True)
    assert column(out, "feature") == [0.0, 0.0, 0.0]


def test_preprocessor_classification(train, test_rows):
    fitted = TablePreprocessor().fit(train, "target")
    out = fitted.transform(train, gate=True)
    assert [t for _, t in out.dtypes] == ["float"] * 4 + ["bigint"]
    rows = out.collect()
    for name in fitted.features:
        values = [r[name] for r in rows]
        assert abs(statistics.mean(values)) < 1e-6
        assert abs(statistics.stdev(values) - 1) < 1e-6
    new = fitted.transform(test_rows, gate=True).collect()
    assert len(new) == 4
    assert len({r["cat_feature1"] for r in new}) == 1      # one unseen value zeroes the column
    shuffled = fitted.transform(test_rows.select(*reversed(test_rows.columns)), gate=True).collect()
    assert [tuple(r) for r in shuffled] == [tuple(r) for r in new]


def test_unseen_rules(train, test_rows):
    codes = fit_labels(train, ["cat_feature1"])
    assert codes.listed["cat_feature1"] == ["A", "B", "C"]
    assert column(apply_labels(test_rows, codes, "column_zero"), "cat_feature1") == [0, 0, 0, 0]
    assert column(apply_labels(test_rows, codes, "row_zero"), "cat_feature1") == [1, 0, 0, 2]
    assert column(apply_labels(test_rows, codes, "keep"), "cat_feature1") == [1, 3, 0, 2]


def test_preprocessor_regression(spark):
    schema = "num_feature1 double, num_feature2 double, target double"
    train = spark.createDataFrame([(1.0, -1.0, 10.5), (2.0, -2.0, 20.3), (3.0, N, 15.7), (N, 1.0, 25.1), (5.0, 2.0, 30.0)], schema)
    test = spark.createDataFrame([(2.0, 1.0, 12.8), (N, 2.0, 18.5), (4.0, N, 22.3)], schema)
    fitted = TablePreprocessor("regression").fit(train, "target")
    values = column(fitted.transform(train, gate=True), "num_feature1")
    assert abs(statistics.mean(values)) < 1e-6 and abs(statistics.pstdev(values) - 1) < 1e-6
    assert fitted.transform(test, gate=True).dtypes == [("num_feature1", "float"), ("num_feature2", "float"), ("target", "float")]


def test_regression_text_is_constant_or_encoded(spark):
    df = spark.createDataFrame([("a", 1.0, 1.0), ("b", 2.0, 2.0), (N, 3.0, N), ("b", 4.0, 4.0)], "t string, x double, y double")
    plain = TablePreprocessor("regression").fit(df, "y")
    assert column(plain.transform(df, gate=True), "t") == [0.0] * 4
    assert column(plain.transform(df, gate=True), "y") == [1.0, 2.0, 2.0, 4.0]
    coded = TablePreprocessor("regression", encode_strings=True).fit(df, "y")
    assert len(set(column(coded.transform(df, gate=True), "t"))) == 2


def test_mixed_types_under_both_rules(spark):
    df = spark.createDataFrame([(1, 1.5, "a", True, 0), (2, N, "b", False, 1), (N, 3.5, N, True, 0), (4, 4.5, "d", N, 1)],
                               "int_col int, float_col double, str_col string, bool_col boolean, target bigint")
    study = TablePreprocessor(numeric_rule="any").fit(df, "target")
    assert study.fills["bool_col"] == 1.0
    assert study.labels.listed["bool_col"] == ["1.0", "False", "True"]
    ours = TablePreprocessor().fit(df, "target")
    assert ours.labels.listed["bool_col"] == ["False", "True"]
    for fitted in (study, ours):
        assert {t for _, t in fitted.transform(df, gate=True).dtypes} == {"float", "bigint"}


def test_text_numbers_keep_their_text(spark):
    df = spark.createDataFrame([("3", 0), ("5", 1), (N, 0), ("x", 1)], "s string, target bigint")
    assert TablePreprocessor(numeric_rule="any").fit(df, "target").labels.listed["s"] == ["3", "4.0", "5", "x"]
    assert TablePreprocessor().fit(df, "target").labels.listed["s"] == ["3", "5", "x"]


def test_one_row(spark):
    df = spark.createDataFrame([(1.0, 0)], "x double, target bigint")
    assert column(TablePreprocessor().fit(df, "target").transform(df, gate=True), "x") == [0.0]


def test_state_roundtrip(spark, train, test_rows, tmp_path):
    fitted = TablePreprocessor(unseen="keep").fit(train, "target")
    fitted.save(spark, str(tmp_path / "state"))
    again = FittedPreprocessor.load(spark, str(tmp_path / "state"))
    assert [tuple(r) for r in again.transform(test_rows).collect()] == [tuple(r) for r in fitted.transform(test_rows).collect()]


def test_fitted_transform_runs_on_a_stream(spark, train, tmp_path):
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    train.write.parquet(source)
    fitted = TablePreprocessor(unseen="row_zero").fit(train, "target")
    stream = fitted.transform(spark.readStream.schema(train.schema).parquet(source))
    run = (stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "log"))
           .trigger(availableNow=True).start(sink))
    run.awaitTermination()
    key = lambda df: sorted(tuple(r) for r in df.collect())
    assert key(spark.read.parquet(sink)) == key(fitted.transform(train))


def test_one_hot(train):
    out = one_hot(train.select("cat_feature1"), ["cat_feature1"]).collect()
    assert tuple(out[0]) == (1, 0, 0) and tuple(out[4]) == (0, 0, 0)


def test_scales(spark):
    df = spark.createDataFrame([(float(i), 5.0) for i in range(1, 6)], "x double, c double")
    assert column(normalize(df, ["x", "c"], "minmax"), "x") == [0.0, 0.25, 0.5, 0.75, 1.0]
    assert column(normalize(df, ["x", "c"]), "c") == [0.0] * 5
    assert column(normalize(df, ["x"], "robust"), "x") == [-1.0, -0.5, 0.0, 0.5, 1.0]
    assert column(normalize(df, ["x"], "maxabs"), "x")[-1] == 1.0
    with pytest.raises(ValueError):
        normalize(df, ["x"], "odd")


def test_normal_quantile_matches_the_standard_library(spark):
    points = [1e-7, 1e-4, 0.02, 0.1, 0.3, 0.5, 0.77, 0.99, 1 - 1e-7]
    got = column(spark.createDataFrame([(p,) for p in points], "p double").select(normal_quantile(F.col("p")).alias("z")), "z")
    for p, z in zip(points, got):
        assert abs(z - statistics.NormalDist().inv_cdf(p)) < 1e-9


def test_quantile_grid_ties_and_range(spark):
    fit = spark.createDataFrame([(v,) for v in (1.0, 1.0, 1.0, 2.0, 3.0)], "x double")
    grids = fit_quantile_grids(fit, ["x"])
    new = spark.createDataFrame([(v,) for v in (0.0, 1.0, 1.5, 2.0, 9.0)] + [(N,)], "x double")
    assert column(apply_quantile_grids(new, grids, "uniform"), "x") == [0.0, 0.25, 0.625, 0.75, 1.0, N]
    normal = column(apply_quantile_grids(new, grids), "x")
    assert abs(normal[0] + 5.199337582) < 1e-6 and abs(normal[4] - 5.199337582) < 1e-6


def test_yeo_johnson_power_search(spark):
    df = spark.createDataFrame([(math.exp(i / 50) - 1,) for i in range(1, 150)], "x double")
    assert abs(fit_powers(df, ["x"])["x"]) < 0.5
    out = column(transform_shape(df, ["x"], "yeo-johnson"), "x")
    assert abs(statistics.mean(out)) < 1e-9 and abs(statistics.pstdev(out) - 1) < 1e-9
    back = column(df.select(yeo_johnson(F.col("x"), 1.0).alias("x")), "x")
    assert back == pytest.approx(column(df, "x"))


def test_yeo_johnson_power_beyond_the_first_range(spark):
    df = spark.createDataFrame([((1 + 7.0 * i / 150) ** (1 / 7) - 1, float(i)) for i in range(1, 150)], "x double, y double")
    found = fit_powers(df, ["x", "y"])
    assert found["x"] > 5 and 0.5 < found["y"] < 1.5


def plain_likelihood(values, power):
    """By logarithms, so that it holds at any power."""
    logs = [math.log1p(v) for v in values]
    top = max(power * v for v in logs)
    y = [math.exp(power * v - top) for v in logs]
    return -len(y) / 2 * (math.log(statistics.pvariance(y)) + 2 * top - 2 * math.log(abs(power))) + (power - 1) * sum(logs)


def test_powers_have_the_highest_likelihood_however_large(spark):
    values = [(1 + i / 150) ** (1 / 300) - 1 for i in range(1, 150)]
    wide = [(1 + i / 3) ** (1 / 7) - 1 for i in range(1, 150)]
    found = fit_powers(spark.createDataFrame(list(zip(values, wide, [2.0] * 149)), "x double, y double, same double"), ["x", "y", "same"])
    assert found["x"] > 100 and found["same"] == 1.0
    for name, given in (("x", values), ("y", wide)):
        best = plain_likelihood(given, found[name])
        assert all(best >= plain_likelihood(given, found[name] + k / 100) - 1e-6 for k in range(-30, 31) if k)


def test_infinite_values_take_the_outermost_places(spark):
    df = spark.createDataFrame([(float(v),) for v in (-math.inf, 1, 2, 3, math.inf, math.inf)], "x double")
    assert column(apply_quantile_grids(df, fit_quantile_grids(df, ["x"]), "uniform"), "x") == [0.0, 0.0, 0.5, 1.0, 1.0, 1.0]


def test_imputing_a_text_of_sixty_thousand_values(spark):
    rows = spark.range(62_000).selectExpr("id", "concat('group ', id div 2) AS g", "CAST(id % 100 AS DOUBLE) AS v",
                                          "CASE WHEN id % 2 = 0 OR id < 1000 THEN concat('value ', id div 2 * 2 + 1000000) END AS t")
    filled = impute_iterative(rows, keep=["id"], rounds=1)
    wrong = filled.filter("t IS NULL OR t <> concat('value ', id div 2 * 2 + 1000000)")
    assert filled.count() == 62_000 and wrong.count() == 0


def test_known_texts_of_many_values_are_not_joined(spark):
    """Known texts are carried along: only the column with gaps is looked up among its values, and only where it has one."""
    rows = spark.range(120_000).selectExpr("id", "concat('group ', id div 2) AS g",
                                           "CASE WHEN id % 2 = 0 OR id < 1000 THEN concat('value ', id div 2 * 2 + 1000000) END AS t")
    imputer, filled = fit_iterative(rows, keep=["id"], rounds=1)
    assert sorted(imputer.codes.tabled) == ["g", "t"]
    plan = filled._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1 and "Union" in plan
    wrong = filled.filter("t IS NULL OR t <> concat('value ', id div 2 * 2 + 1000000) OR g <> concat('group ', id div 2)")
    assert filled.count() == 120_000 and wrong.count() == 0
    other = spark.createDataFrame([(1, "group 7", None), (2, "new", None), (3, "group 7", "value 1000020")], "id long, g string, t string")
    done = {r["id"]: (r["g"], r["t"]) for r in imputer.transform(other).collect()}
    assert done[1] == ("group 7", "value 1000014") and done[3] == ("group 7", "value 1000020")
    assert done[2][0] == "group 0"


def test_commonest_value_by_the_best_other_column(spark):
    rows = [(i, "ab"[i % 2], float(i % 40), None if i % 7 == 0 else f"v{i % 40 // 10}") for i in range(280)] + [(999, None, None, None)]
    df = spark.createDataFrame(rows, "id long, one string, two double, t string")
    filled = {r["id"]: r["t"] for r in impute_iterative(df, keep=["id"], rounds=1, many=2).collect()}
    assert sum(filled[i] == f"v{i % 40 // 10}" for i in range(280)) >= 276 and filled[999] in ("v0", "v1", "v2", "v3")


def test_iterative_imputation(spark):
    rows = [(i, float(i % 10), float(2 * (i % 10)) if i % 4 else N, ("low" if i % 10 < 5 else "high") if i % 5 else N)
            for i in range(200)]
    df = spark.createDataFrame(rows, "id int, x double, y double, s string")
    out = {r["id"]: r for r in impute_iterative(df, keep=["id"], rounds=2, trees=5).collect()}
    for i, x, y, s in rows:
        assert out[i]["x"] == x and out[i]["y"] is not None and out[i]["s"] is not None
        assert y is None or out[i]["y"] == y
        assert s is None or out[i]["s"] == s
    gaps = [abs(out[i]["y"] - 2 * x) for i, x, y, _ in rows if y is None]
    assert statistics.mean(gaps) < 1.5


def test_iterative_imputation_of_further_tables(spark, tmp_path):
    rows = [(i, float(i % 10), float(2 * (i % 10)) if i % 4 else N, N, "a" if i % 3 else N) for i in range(120)]
    kinds = "id int, x double, y double, empty double, s string"
    train, other = spark.createDataFrame(rows[:80], kinds), spark.createDataFrame(rows[80:], kinds)
    old = spark.sparkContext.getCheckpointDir()
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    try:
        imputer, filled = fit_iterative(train, keep=["id"], rounds=3, trees=2, depth=2)
        folder = next(tmp_path.iterdir())
        assert len(list(folder.iterdir())) == 1            # one settled table whatever the rounds
        filled, done = sorted(map(tuple, filled.collect())), {r["id"]: r for r in imputer.transform(other).collect()}
        assert len(list(folder.iterdir())) == 2
    finally:
        if old:
            spark.sparkContext.setCheckpointDir(old)
    assert all(f[2] is not None and f[3] is None and f[4] == "a" for f in filled)
    for i, x, y, _, s in rows[80:]:
        assert done[i]["x"] == x and done[i]["y"] is not None and done[i]["empty"] is None and done[i]["s"] == "a"
        assert y is None or done[i]["y"] == y


def test_texts_are_cast_only_if_they_look_like_numbers(spark):
    """A cast that fails is slow: texts that are no numbers must not reach one, and the numbers stay what a cast says."""
    bare = ["1", "1.", ".5", ".", "", "+", "-0.0", "1e5", "1E+5", "1e-", "1d", "1.5F", "1.5fF", "0x1p3", "0x.8P1", "0xp1", "0x1", "1e400",
            "inf", "+INF", "-Infinity", "infinit", "NaN", "+nan", "1_0", "1,0", "１", "1 2", "--1", "1L", "e5", "Brand#5", "true"]
    rows = [(a + text + b,) for text in bare for a in ("", " \t", " ") for b in ("", "\n", "\x00", " ")] + [(N,)]
    df = spark.createDataFrame(rows, "cell string")
    number = F.col("cell").try_cast("double")
    wrong = df.filter(~parse_number(F.col("cell"), T.StringType()).eqNullSafe(F.when(~F.isnan(number), number)))
    assert wrong.collect() == []
    looks = df.filter(F.col("cell").rlike(NUMBER_TEXT) & number.isNull()).collect()
    assert all("0xp1" in r["cell"] for r in looks)
    assert "RLIKE" in coerce_numeric(df, ["cell"])._jdf.queryExecution().toString()
