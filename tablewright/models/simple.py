"""The baselines: the majority class, and the mean."""

from __future__ import annotations

from pyspark.ml import Estimator, Model
from pyspark.sql import DataFrame, functions as F

from tablewright.models.features import LABEL, PREDICTION
from tablewright.models.saving import Saved


class Constant(Saved, Model):
    def __init__(self, value: float):
        super().__init__()
        self.value = value

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn(PREDICTION, F.lit(float(self.value)))


class MajorityClass(Saved, Estimator):
    """The most frequent class, the smallest on ties."""

    def _fit(self, df: DataFrame) -> Model:
        return Constant(df.agg(F.mode(LABEL, True)).first()[0])

    def fit_folds(self, df: DataFrame, fold: str, names: list[int]) -> dict[int, Model]:
        """For each fold the model of the rows outside it."""
        counts = df.filter(F.col(LABEL).isNotNull()).groupBy(F.col(fold).alias("fold"), F.col(LABEL).alias("said")).count().collect()
        models = {}
        for name in names:
            held: dict[float, int] = {}
            for r in counts:
                if r["fold"] != name:
                    held[r["said"]] = held.get(r["said"], 0) + r["count"]
            models[name] = Constant(min(held, key=lambda said: (-held[said], said)))
        return models


class MeanTarget(Saved, Estimator):
    def _fit(self, df: DataFrame) -> Model:
        return Constant(df.agg(F.avg(LABEL)).first()[0])

    def fit_folds(self, df: DataFrame, fold: str, names: list[int]) -> dict[int, Model]:
        """For each fold the model of the rows outside it."""
        sums = {r["fold"]: r for r in df.groupBy(F.col(fold).alias("fold")).agg(F.sum(LABEL).alias("sum"), F.count(LABEL).alias("rows")).collect()}
        others = {name: [r for f, r in sums.items() if f != name] for name in names}
        return {name: Constant(sum(r["sum"] for r in held) / sum(r["rows"] for r in held)) for name, held in others.items()}
