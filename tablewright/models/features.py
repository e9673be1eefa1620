"""From a prepared table to (key, features, label), and the scores a model leaves behind."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from tablewright.functions import ref

FEATURES, LABEL, PREDICTION, SCORES = "features", "label", "prediction", "scores"


def assemble(df: DataFrame, columns: list[str], target: str, keep: list[str] = ()) -> DataFrame:
    """Kept columns, one feature vector and a double label. Gaps must have been filled before."""
    named = df.select(*(ref(c) for c in keep), *(ref(c).cast("double").alias(f"_f{i}") for i, c in enumerate(columns)),
                      ref(target).cast("double").alias(LABEL))
    assembler = VectorAssembler(inputCols=[f"_f{i}" for i in range(len(columns))], outputCol=FEATURES)
    return assembler.transform(named).select(*(ref(c) for c in keep), FEATURES, LABEL)


def feature_array() -> Column:
    return vector_to_array(F.col(FEATURES))


def dot(x: Column, weights: list[float], start: float = 0.0) -> Column:
    """A weighted sum of array entries as one expression."""
    total = F.lit(float(start))
    for i, w in enumerate(weights):
        total = total + F.get(x, F.lit(i)) * F.lit(float(w))
    return total


def class_scores(df: DataFrame, classes: int) -> DataFrame:
    """A ``scores`` array with one entry per class: probabilities, margins, or the plain vote."""
    if SCORES in df.columns:
        return df
    for name in ("probability", "rawPrediction"):
        if name in df.columns:
            return df.withColumn(SCORES, vector_to_array(F.col(name)))
    votes = F.transform(F.sequence(F.lit(0), F.lit(classes - 1)),
                        lambda c: (F.col(PREDICTION) == c.cast("double")).cast("double"))
    return df.withColumn(SCORES, votes)


def argmax(scores: Column) -> Column:
    """The place of the largest entry, the first on ties."""
    return F.array_position(scores, F.array_max(scores)) - 1
