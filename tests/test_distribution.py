"""The distributed statistics agree with the one-buffer ones and with brute force."""

from __future__ import annotations

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from tablewright.operators import distribution
from tablewright.operators.distribution import describe, running_total, value_codes, wide_modes, wide_quantiles
from tablewright.operators.encode import apply_labels, fit_labels
from tablewright.operators.metrics import roc_auc

PROBABILITIES = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows share one value; the others are nearly all distinct."""
    return spark.range(6000).select(
        "id", F.when(F.col("id") % 3 == 0, 7.0).when(F.col("id") % 10 == 1, None)
        .otherwise(F.pmod(F.xxhash64("id"), F.lit(100_000)) / 7).alias("x"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("v"), F.pmod(F.col("id") * 7919, F.lit(3500))))
        .alias("s")).repartition(5)


def test_wide_quantiles_match_numpy(skewed):
    values = [r["x"] for r in skewed.collect() if r["x"] is not None]
    for probabilities in (PROBABILITIES, [i / 50 for i in range(51)]):      # with brackets, and without
        got = wide_quantiles(skewed, ["x"], probabilities)["x"]
        assert got == pytest.approx(list(np.quantile(values, probabilities)), abs=1e-9)


def test_a_missed_bracket_falls_back_to_all_ranks(skewed, monkeypatch):
    values = [r["x"] for r in skewed.collect() if r["x"] is not None]
    monkeypatch.setattr(distribution, "bracketed_quantiles", lambda *args: {})
    assert wide_quantiles(skewed, ["x"], [0.3])["x"] == pytest.approx([np.quantile(values, 0.3)])


def test_brackets_hold_over_many_ranks(spark):
    df = spark.range(300_000).select((F.xxhash64("id") / 1e12).alias("x"))
    values = np.array([r["x"] for r in df.collect()])
    got = distribution.bracketed_quantiles(df, ["x"], [0.01, 0.5, 0.975], {"x": 300_000})["x"]
    assert got == pytest.approx(list(np.quantile(values, [0.01, 0.5, 0.975])), rel=1e-12)


def test_describe_is_the_same_on_both_ways(skewed):
    wanted = dict(quantiles={"x": PROBABILITIES}, modes=["s", "x"])
    narrow, wide = describe(skewed, ["x", "s"], **wanted), describe(skewed, ["x", "s"], budget=10, **wanted)
    assert narrow["x"]["quantiles"] == pytest.approx(wide["x"]["quantiles"], abs=1e-9)
    assert (narrow["x"]["mode"], narrow["s"]["mode"]) == (wide["x"]["mode"], wide["s"]["mode"]) == (7.0, "hot")


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.none(), st.integers(-5, 5), st.floats(-1e6, 1e6, width=32)), min_size=1, max_size=40))
def test_quantiles_property(spark, values):
    df = spark.createDataFrame([(None if v is None else float(v),) for v in values], "x double")
    present = [float(v) for v in values if v is not None]
    got = wide_quantiles(df, ["x"], [0.0, 0.3, 0.5, 1.0])["x"]
    if present:
        assert got == pytest.approx(list(np.quantile(present, [0.0, 0.3, 0.5, 1.0])), rel=1e-9, abs=1e-9)
    else:
        assert got == [None] * 4


def test_empty_columns(spark):
    df = spark.createDataFrame([(None, None)], "x double, s string")
    assert wide_quantiles(df, ["x"], [0.5]) == {"x": [None]}
    assert wide_modes(df, ["x", "s"]) == {"x": None, "s": None}
    assert describe(df, ["x"], quantiles={"x": [0.5]})["x"]["quantiles"] == [None]


def test_mode_takes_the_smallest_on_ties(spark):
    df = spark.createDataFrame([(2, "b"), (1, "a"), (1, "b"), (2, "a"), (3, "c")], "x int, s string")
    assert wide_modes(df, ["x", "s"]) == {"x": 1.0, "s": "a"}
    assert describe(df, ["x", "s"], modes=["x", "s"], budget=0)["x"]["mode"] == 1


@pytest.mark.parametrize("one_task", [True, False])
def test_running_total(spark, one_task):
    df = spark.range(500).select((F.col("id") % 3).alias("g"), F.col("id").alias("v"), (F.col("id") % 5).alias("w"))
    got = {(r["g"], r["v"]): r["before"] for r in running_total(df, ["g"], ["v"], F.col("w"), "before", one_task).collect()}
    sums = {0: 0, 1: 0, 2: 0}
    for i in range(500):
        assert got[i % 3, i] == sums[i % 3]
        sums[i % 3] += i % 5
    assert len(got) == 500


def test_value_codes_are_sorted_places(skewed):
    expected = {v: i for i, v in enumerate(sorted({r["s"] for r in skewed.collect()}))}
    for distinct in (None, 10):
        assert {r["value"]: r["code"] for r in value_codes(skewed, "s", distinct).collect()} == expected


def test_long_code_lists_are_joined(skewed, monkeypatch):
    listed = apply_labels(skewed, fit_labels(skewed, ["s"]))
    monkeypatch.setattr(distribution, "LISTED_VALUES", 10)
    codes = fit_labels(skewed, ["s"])
    assert list(codes.tabled) == ["s"] and not codes.listed
    joined = apply_labels(skewed, codes)
    assert {r["id"]: r["s"] for r in joined.collect()} == {r["id"]: r["s"] for r in listed.collect()}


def test_auc_both_ways(spark, monkeypatch):
    rng = np.random.default_rng(3)
    y, s = rng.random(300) < 0.3, rng.integers(0, 40, 300).astype(float)
    df = spark.createDataFrame([("a", bool(a), float(b)) for a, b in zip(y, s)], "g string, y boolean, s double")
    wins = [(a > b) + 0.5 * (a == b) for a in s[y] for b in s[~y]]
    for limit in (1_000_000, 0):
        monkeypatch.setattr("tablewright.operators.metrics.ONE_TASK_ROWS", limit)
        assert roc_auc(df, F.col("y"), F.col("s"), ["g"]).first()["auc"] == pytest.approx(np.mean(wins))
    one_class = roc_auc(df.filter("y"), F.col("y"), F.col("s"), ["g"])
    assert one_class.first()["auc"] == 0.5
