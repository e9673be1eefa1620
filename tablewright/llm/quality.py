"""Quality classifier: a sparse rule ensemble, compiled to one Spark column expression.

1. Statistics of the text (``STATISTICS``), all column expressions: shares of letters, capitals, digits, symbols
   and repeated words, lengths of words and lines. Never labels, languages, sources or ids.
2. A forest over about ``fit_rows`` labelled rows (a documented bound, chosen by a hash of doc_id; texts whole).
   Every path from a root to a node is a conjunctive rule over the statistics.
3. A logistic model with a lasso penalty over the rules keeps a sparse set with weights.
4. The rules that are left become one expression: the logistic of a sum of ``CASE WHEN rule`` terms. Scoring is
   a projection without Python.

NULL texts count as empty; every statistic is defined for them, so they get a score like any text. Without labels
of both kinds nothing can be learnt: the score is then the share of good labels, 0.5 without any.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, functions as F

from tablewright.llm.common import fresh_name, hash_share
from tablewright.session import settle

THRESHOLD = 0.3
SHORT = 20             # words up to which a text counts as short

#: (feature, is at most threshold or above it, threshold): one step of a path.
Step = tuple[str, bool, float]


@dataclass(frozen=True)
class Model:
    intercept: float
    rules: list[tuple[tuple[Step, ...], float]]


def left_over(text: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(text, pattern, ""))


def measures(text: Column) -> dict[str, Column]:
    """Counts from which the statistics follow."""
    text = F.coalesce(text, F.lit(""))
    words = F.split(text, r"\s+")
    return {
        "chars": F.length(text), "words": F.size(words), "distinct": F.size(F.array_distinct(words)),
        "after_letters": left_over(text, r"\p{L}+"), "after_capitals": left_over(text, r"\p{Lu}+"),
        "after_digits": left_over(text, r"\p{N}+"), "after_plain": left_over(text, r"[^\p{L}\p{N}\s.,;:'\"?()-]+"),
        "after_space": left_over(text, r"\s+"), "after_breaks": F.length(F.replace(text, F.lit("\n"), F.lit(""))),
        "after_stops": F.length(F.translate(text, ".!?", "")),
        "bars": F.length(text) - F.length(F.translate(text, "|<>{}[]=", "")),
    }


def ratios(m) -> dict[str, Column]:
    """The statistics, from the columns of ``measures``."""
    chars = F.greatest(m["chars"], F.lit(1)).cast("double")
    words = F.greatest(m["words"], F.lit(1)).cast("double")
    letters = m["chars"] - m["after_letters"]
    return {
        "chars": m["chars"].cast("double"), "words": words, "word_length": m["after_space"] / words,
        "distinct_words": m["distinct"] / words, "letters": letters / chars,
        "capitals": (m["chars"] - m["after_capitals"]) / F.greatest(letters, F.lit(1)).cast("double"),
        "digits": (m["chars"] - m["after_digits"]) / chars, "symbols": m["after_plain"] / chars,
        "symbols_a_word": m["after_plain"] / words, "bars_a_word": m["bars"] / words,
        "stops_a_word": (m["chars"] - m["after_stops"]) / words,
        "words_a_line": words / (m["chars"] - m["after_breaks"] + 1),
    }


STATISTICS = ["chars", "words", "word_length", "distinct_words", "letters", "capitals", "digits", "symbols",
              "symbols_a_word", "bars_a_word", "stops_a_word", "words_a_line"]


def with_statistics(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` with a struct column ``name`` of all statistics; counts are taken once, in a projection before."""
    counts = fresh_name(docs, name + "_counts")
    found = measures(F.col("text"))
    # "symbols" counts what a removal of everything plain leaves, so its measure is kept as a difference.
    found["after_plain"] = found["chars"] - found["after_plain"]
    counted = docs.withColumn(counts, F.struct(*[c.alias(k) for k, c in found.items()]))
    shares = ratios({k: F.col(counts)[k] for k in found})
    return counted.withColumn(name, F.struct(*[shares[k].alias(k) for k in STATISTICS])).drop(counts)


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows kept from fitting: crc32 of doc_id as text is 0 modulo 5. A NULL id is not held out, nor learnt from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def paths(description: str) -> list[tuple[Step, ...]]:
    """The conjunctions of all nodes but the roots of a forest, from its printed form, in order, each once."""
    found: dict[tuple[Step, ...], None] = {}
    above: list[Step] = []
    for line in description.splitlines():
        depth = len(line) - len(line.lstrip(" "))
        if line.lstrip().startswith("Tree"):
            above, base = [], depth + 2
        match = re.match(r"(If|Else) \(feature (\d+) (<=|>) ([-\d.Ee]+)\)", line.strip())
        if match:
            above = above[:depth - base]
            above.append((STATISTICS[int(match[2])], match[3] == "<=", float(match[4])))
            found[simplified(above)] = None
    return list(found)


def simplified(steps: list[Step]) -> tuple[Step, ...]:
    """The tightest bound of each feature and side, in order of the features."""
    bounds: dict[tuple[str, bool], float] = {}
    for feature, at_most, threshold in steps:
        old = bounds.get((feature, at_most), threshold)
        bounds[feature, at_most] = min(old, threshold) if at_most else max(old, threshold)
    return tuple((feature, at_most, bounds[feature, at_most]) for feature, at_most in sorted(bounds))


def rule_column(rule: tuple[Step, ...], statistics: Column) -> Column:
    condition = F.lit(True)
    for feature, at_most, threshold in rule:
        value = statistics[feature]
        condition = condition & (value <= threshold if at_most else value > threshold)
    return condition


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = 20_000, trees: int = 20, depth: int = 3,
        penalty: float = 0.002, seed: int = 17) -> Model:
    """Learn from the labelled rows of ``docs`` that are not held out. Of several labels of a row the least counts."""
    marked = (labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
              .groupBy("doc_id").agg(F.min("quality").cast("double").alias("label")))
    rows = marked.count()
    if rows > fit_rows:
        marked = marked.filter(hash_share("doc_id", fit_rows / rows))
    sample = docs.select("doc_id", "text").join(marked, "doc_id")
    sample = settle(with_statistics(sample, "statistics").select("label", "statistics.*"))
    bad, all_rows = sample.agg(F.sum(1 - F.col("label")), F.count(F.lit(1))).first()
    if not all_rows or bad in (0, all_rows):
        share = (all_rows - bad) / all_rows if all_rows else 0.5
        share = min(max(share, 1e-6), 1 - 1e-6)
        return Model(math.log(share / (1 - share)), [])
    assembled = VectorAssembler(inputCols=STATISTICS, outputCol="features").transform(sample)
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, maxBins=64, subsamplingRate=0.5,
                                    featureSubsetStrategy="onethird", seed=seed).fit(assembled)
    rules = rules_of(forest)
    flags = array_to_vector(F.array(*[rule_column(r, F.struct(*STATISTICS)).cast("double") for r in rules]))
    flagged = settle(sample.select("label", flags.alias("features")))
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=penalty, maxIter=100, standardization=True).fit(flagged)
    kept = [(rule, float(weight)) for rule, weight in zip(rules, lasso.coefficients) if weight]
    return Model(float(lasso.intercept), kept)


def rules_of(forest: RandomForestClassificationModel) -> list[tuple[Step, ...]]:
    return paths(forest.toDebugString)


def score_column(model: Model, statistics: Column) -> Column:
    """The compiled ensemble: 0 to 1, higher for likelier good texts."""
    total = F.lit(model.intercept)
    for rule, weight in model.rules:
        total = total + F.when(rule_column(rule, statistics), weight).otherwise(0.0)
    return 1 / (1 + F.exp(-total))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``."""
    name = fresh_name(docs, "_statistics")
    scored = with_statistics(docs.select("doc_id", "text"), name)
    scored = scored.select("doc_id", held_out().alias("held_out"), score_column(model, F.col(name)).alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))


def keep_good(docs: DataFrame, model: Model, least: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score ``least`` or more; columns as they were.

    Spark would push the filter below the projections and so count every statistic anew for every rule that reads
    it. The partition's number beside the score, which no filter passes, holds it above them.
    """
    name, part = fresh_name(docs, "_statistics"), fresh_name(docs, "_partition")
    scored = with_statistics(docs, name).select(
        *docs.columns, score_column(model, F.col(name)).alias(name), F.spark_partition_id().alias(part))
    return scored.filter((F.col(name) >= least) & (F.col(part) >= 0)).select(*docs.columns)
