"""Quality: held-out accuracy, the compiled rules against a plain reading of them, and awkward rows."""

import math

import pytest
from pyspark.sql import functions as F
from text_cases import DOCS, documents

from tablewright.llm import quality

SF = "/root/testdata/sf0.01"
MODEL = quality.Model(0.25, [((("capitals", False, 0.5),), -2.0), ((("distinct_words", True, 0.5), ("words", False, 3.0)), -1.5),
                             ((("symbols", True, 0.1),), 1.0)])


def plain(model, statistics):
    total = model.intercept
    for rule, weight in model.rules:
        if all(statistics[f] <= t if low else statistics[f] > t for f, low, t in rule):
            total += weight
    return 1 / (1 + math.exp(-total))


def test_compiled_rules_equal_a_plain_reading(spark):
    rows = quality.with_statistics(documents(spark), "statistics").select(
        "statistics", quality.score_column(MODEL, F.col("statistics")).alias("score")).collect()
    assert len(rows) == 10
    for row in rows:
        assert row["score"] == pytest.approx(plain(MODEL, row["statistics"]), abs=1e-12)


def test_statistics_of_a_text(spark):
    df = documents(spark, [(1, "AB cd cd!! 7%\nx", "en", "a", 0), (2, None, "en", "a", 0)])
    first, empty = [r["statistics"] for r in quality.with_statistics(df, "statistics").orderBy("doc_id").collect()]
    assert (first["chars"], first["words"], first["letters"], first["capitals"]) == (15.0, 5.0, 7 / 15, 2 / 7)
    assert (first["digits"], first["words_a_line"], first["distinct_words"]) == (1 / 15, 2.5, 1.0)
    assert first["symbols"] == 3 / 15 and first["symbols_a_word"] == 3 / 5
    assert empty["chars"] == 0 and empty["letters"] == 0


def test_paths_of_a_printed_forest():
    text = """Forest
  Tree 0 (weight 1.0):
    If (feature 0 <= 10.0)
     If (feature 1 <= 2.5)
      Predict: 0.0
     Else (feature 1 > 2.5)
      Predict: 1.0
    Else (feature 0 > 10.0)
     Predict: 1.0
  Tree 1 (weight 1.0):
    If (feature 0 <= 10.0)
     Predict: 0.0
    Else (feature 0 > 10.0)
     Predict: 1.0"""
    a, b = quality.STATISTICS[:2]
    assert quality.paths(text) == [((a, True, 10.0),), ((a, True, 10.0), (b, True, 2.5)), ((a, True, 10.0), (b, False, 2.5)),
                                   ((a, False, 10.0),)]


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    found = quality.score(docs, quality.fit(docs, labels, trees=8))
    assert found.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
    judged = found.join(labels, "doc_id").filter("held_out").select("predicted", "quality").collect()
    assert sum(p == q for p, q in judged) / len(judged) > 0.95
    assert found.filter("score < 0 OR score > 1 OR score IS NULL").count() == 0
    kept = quality.keep_good(docs, MODEL)
    assert kept.columns == docs.columns


@pytest.mark.parametrize("labels, expected", [([], 0.5), ([(1, 1, 0), (2, 1, 0), (None, 0, 0), (7, None, 0)], 1.0)])
def test_nothing_to_learn(spark, labels, expected):
    marked = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    found = quality.score(documents(spark, clashing=True), quality.fit(documents(spark), marked)).collect()
    assert len(found) == 10 and all(r["score"] == pytest.approx(expected, abs=1e-5) for r in found)


def test_empty_table_and_clashing_names(spark):
    assert quality.score(spark.createDataFrame([], DOCS), MODEL).collect() == []
    clashing = documents(spark, clashing=True)
    assert quality.keep_good(clashing, MODEL, least=0.0).collect() == clashing.collect()
