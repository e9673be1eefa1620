"""Cross-products in one distributed pass, and the models that only need those p x p sums.

Every task sums its own rows into one small matrix per class; the matrices are added up by a grouped
aggregation on the matrix cell. The driver sees p x p numbers per class, however large the table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import Estimator, Model
from pyspark.sql import DataFrame, functions as F

from tablewright.models.features import LABEL, PREDICTION, SCORES, argmax, dot, feature_array
from tablewright.models.saving import Saved
from tablewright.session import ship_package

CELLS = "group double, i int, j int, value double"


def cross_products(df: DataFrame, by_label: bool = False, with_label: bool = False, by: str | None = None,
                   origin: np.ndarray | None = None) -> DataFrame:
    """(group, i, j, value) with i <= j: sums of products of (1, features[, label]) per class, or per value of the column ``by``.

    Place 0 is the constant, so row 0 holds the count and the sums. With ``origin``, a point of (features, label), sums are taken
    about it: near the rows, it keeps the digits that squares of large means would take.
    """
    ship_package(df.sparkSession)
    rows = df.select(F.col(LABEL).alias("y"), feature_array().alias("x"),
                     (F.col(by).cast("double") if by else F.col(LABEL) if by_label else F.lit(0.0)).alias("g"))

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[float, np.ndarray] = {}
        for batch in batches:
            if not len(batch):
                continue
            y = batch["y"].to_numpy(dtype=float)
            parts = [np.ones((len(batch), 1)), np.stack(batch["x"].to_numpy())]
            if origin is not None:
                parts[1], y = parts[1] - origin[:-1], y - origin[-1]
            z = np.hstack([*parts, y[:, None]] if with_label else parts)
            groups = batch["g"].to_numpy(dtype=float)
            for g in np.unique(groups):
                mine = z[groups == g]
                sums[g] = sums.get(g, 0) + mine.T @ mine
        for g, total in sums.items():
            i, j = np.triu_indices(len(total))
            yield pd.DataFrame({"group": g, "i": i.astype("int32"), "j": j.astype("int32"), "value": total[i, j]})

    return (rows.mapInPandas(partial, CELLS).groupBy("group", "i", "j").agg(F.sum("value").alias("value")))


@dataclass
class Moments:
    """Count, mean and centred scatter of one class."""

    count: float
    mean: np.ndarray
    scatter: np.ndarray

    @classmethod
    def of(cls, cells: np.ndarray, origin: np.ndarray | float = 0.0) -> Moments:
        count = cells[0, 0]
        mean = cells[0, 1:] / count
        return cls(count, mean + origin, cells[1:, 1:] - count * np.outer(mean, mean))


def some_row(df: DataFrame) -> np.ndarray:
    """The features and the label of any row, as an origin for sums."""
    row = df.select(feature_array().alias("x"), F.col(LABEL).alias("y")).first()
    if row is None:
        raise ValueError("the table is empty")
    return np.array([*row["x"], row["y"]], float)


def matrices(cells: DataFrame) -> dict[float, np.ndarray]:
    """The full symmetric matrix of each group."""
    found: dict[float, list] = {}
    for row in cells.collect():
        found.setdefault(row["group"], []).append(row)
    full = {}
    for group, rows in found.items():
        size = max(r["j"] for r in rows) + 1
        matrix = np.zeros((size, size))
        for r in rows:
            matrix[r["i"], r["j"]] = matrix[r["j"], r["i"]] = r["value"]
        full[group] = matrix
    return full


def class_moments(df: DataFrame) -> dict[int, Moments]:
    origin = some_row(df)
    cells = matrices(cross_products(df, by_label=True, origin=origin))
    return {int(g): Moments.of(m, origin[:-1]) for g, m in sorted(cells.items())}


class LinearScores(Saved, Model):
    """One linear score per class; the highest one is the prediction."""

    def __init__(self, weights: np.ndarray, offsets: np.ndarray):
        super().__init__()
        self.weights, self.offsets = weights, offsets

    def _transform(self, df: DataFrame) -> DataFrame:
        x = feature_array()
        scored = df.withColumn(SCORES, F.array(*(dot(x, list(w), o) for w, o in zip(self.weights, self.offsets))))
        return scored.withColumn(PREDICTION, argmax(F.col(SCORES)).cast("double"))


class QuadraticScores(Saved, Model):
    """Gaussian class scores with one covariance per class, from a vectorized function on the features."""

    def __init__(self, means: np.ndarray, precisions: np.ndarray, offsets: np.ndarray):
        super().__init__()
        self.means, self.precisions, self.offsets = means, precisions, offsets

    def _transform(self, df: DataFrame) -> DataFrame:
        ship_package(df.sparkSession)
        means, precisions, offsets = self.means, self.precisions, self.offsets

        @F.pandas_udf("array<double>")
        def score(x: pd.Series) -> pd.Series:
            rows = np.stack(x.to_numpy())
            scores = np.empty((len(rows), len(offsets)))
            for c in range(len(offsets)):
                d = rows - means[c]
                scores[:, c] = offsets[c] - 0.5 * np.einsum("ni,ij,nj->n", d, precisions[c], d)
            return pd.Series(list(scores))

        scored = df.withColumn(SCORES, score(feature_array()))
        return scored.withColumn(PREDICTION, argmax(F.col(SCORES)).cast("double"))


def by_class(found: dict[int, Moments]) -> tuple[list[Moments], np.ndarray]:
    """Moments of classes 0..k-1 and their shares."""
    if sorted(found) != list(range(len(found))):
        raise ValueError("class labels must be 0, 1, ... without gaps")
    groups = [found[c] for c in range(len(found))]
    return groups, np.array([g.count for g in groups]) / sum(g.count for g in groups)


def symmetric_inverse(matrix: np.ndarray) -> tuple[np.ndarray, float]:
    """Pseudo-inverse and log-determinant over the directions that vary."""
    values, vectors = np.linalg.eigh((matrix + matrix.T) / 2)
    kept = values > max(values.max(), 0) * 1e-10
    if not kept.any():
        return np.zeros_like(matrix), 0.0
    return (vectors[:, kept] / values[kept]) @ vectors[:, kept].T, float(np.log(values[kept]).sum())


class FromMoments(Saved, Estimator):
    """A classifier of the moments of its classes. Those of all folds come from one scan."""

    def _fit(self, df: DataFrame) -> Model:
        return self.fit_moments(class_moments(df))

    def fit_folds(self, df: DataFrame, fold: str, names: list[int]) -> dict[int, Model]:
        """For each fold the model of the rows outside it."""
        origin, found = some_row(df), df.agg(F.min(LABEL).alias("low"), F.max(LABEL).alias("top")).first()
        if found["low"] < 0:
            raise ValueError("class labels must be 0, 1, ... without gaps")
        classes = int(found["top"]) + 1
        cells = matrices(cross_products(df.withColumn("_group", F.col(fold) * classes + F.col(LABEL)), by="_group", origin=origin))
        models = {}
        for name in names:
            sums: dict[int, np.ndarray] = {}
            for group, matrix in cells.items():
                if group // classes != name:
                    sums[int(group % classes)] = sums.get(int(group % classes), 0) + matrix
            models[name] = self.fit_moments({c: Moments.of(m, origin[:-1]) for c, m in sorted(sums.items())})
        return models

    def fit_moments(self, moments: dict[int, Moments]) -> Model:
        raise NotImplementedError


class LinearDiscriminant(FromMoments):
    def fit_moments(self, moments: dict[int, Moments]) -> Model:
        groups, shares = by_class(moments)
        pooled = sum(g.scatter for g in groups) / sum(g.count for g in groups)
        inverse, _ = symmetric_inverse(pooled)
        weights = np.array([inverse @ g.mean for g in groups])
        offsets = np.array([-0.5 * w @ g.mean for w, g in zip(weights, groups)]) + np.log(shares)
        return LinearScores(weights, offsets)


class QuadraticDiscriminant(FromMoments):
    def fit_moments(self, moments: dict[int, Moments]) -> Model:
        groups, shares = by_class(moments)
        inverses = [symmetric_inverse(g.scatter / max(g.count - 1, 1)) for g in groups]
        return QuadraticScores(np.array([g.mean for g in groups]), np.array([i for i, _ in inverses]),
                               np.log(shares) - 0.5 * np.array([d for _, d in inverses]))


class RidgeClassifier(FromMoments):
    """Least squares on -1/+1 targets per class with a penalty on the weights, all classes in one pass."""

    def __init__(self, penalty: float = 1.0):
        super().__init__()
        self.penalty = penalty

    def fit_moments(self, moments: dict[int, Moments]) -> Model:
        groups, shares = by_class(moments)
        total = sum(g.count for g in groups)
        mean = sum(g.count * g.mean for g in groups) / total
        scatter = sum(g.scatter + g.count * np.outer(g.mean - mean, g.mean - mean) for g in groups)
        penalized = scatter + self.penalty * np.eye(len(mean))
        weights = np.array([np.linalg.solve(penalized, 2 * g.count * (g.mean - mean)) for g in groups])
        offsets = (2 * shares - 1) - weights @ mean
        return LinearScores(weights, offsets)


class LinearPrediction(Saved, Model):
    """A linear prediction, computed as one expression on the feature array."""

    def __init__(self, weights: np.ndarray, offset: float):
        super().__init__()
        self.weights, self.offset = weights, offset

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn(PREDICTION, dot(feature_array(), list(self.weights), self.offset))


@dataclass
class Regression:
    """Centred sums of a regression: count, means, X'X, X'y, y'y."""

    count: float
    mean: np.ndarray
    target_mean: float
    xx: np.ndarray
    xy: np.ndarray
    yy: float

    @classmethod
    def of(cls, df: DataFrame) -> Regression:
        origin = some_row(df)
        return cls.of_moments(Moments.of(matrices(cross_products(df, with_label=True, origin=origin))[0.0], origin))

    @classmethod
    def of_moments(cls, moments: Moments) -> Regression:
        return cls(moments.count, moments.mean[:-1], float(moments.mean[-1]), moments.scatter[:-1, :-1],
                   moments.scatter[:-1, -1], float(moments.scatter[-1, -1]))

    def model(self, weights: np.ndarray) -> LinearPrediction:
        return LinearPrediction(weights, float(self.target_mean - weights @ self.mean))


class FromSums(Saved, Estimator):
    """A regressor of the centred sums. Those of all folds come from one scan."""

    def _fit(self, df: DataFrame) -> Model:
        return self.fit_sums(Regression.of(df))

    def fit_folds(self, df: DataFrame, fold: str, names: list[int]) -> dict[int, Model]:
        """For each fold the model of the rows outside it."""
        origin = some_row(df)
        cells = matrices(cross_products(df, with_label=True, by=fold, origin=origin))
        others = {name: sum(m for f, m in cells.items() if f != name) for name in names}
        return {name: self.fit_sums(Regression.of_moments(Moments.of(m, origin))) for name, m in others.items()}

    def fit_sums(self, sums: Regression) -> Model:
        raise NotImplementedError


class BayesianRidge(FromSums):
    """Evidence maximization of noise and weight precision (MacKay, 1992) on the p x p sums."""

    def __init__(self, rounds: int = 300, tolerance: float = 1e-3, prior: float = 1e-6):
        super().__init__()
        self.rounds, self.tolerance, self.prior = rounds, tolerance, prior

    def fit_sums(self, sums: Regression) -> Model:
        values, vectors = np.linalg.eigh(sums.xx)
        values = np.clip(values, 0, None)
        turned = vectors.T @ sums.xy
        variance = sums.yy / sums.count
        noise, precision = 1.0 / (variance + np.finfo(float).eps), 1.0
        weights = np.zeros(len(sums.mean))
        for _ in range(self.rounds):
            before = weights
            weights = vectors @ (turned / (values + precision / noise))
            residual = max(sums.yy - 2 * weights @ sums.xy + weights @ sums.xx @ weights, 0.0)
            fitted = float((noise * values / (precision + noise * values)).sum())
            precision = (fitted + 2 * self.prior) / (weights @ weights + 2 * self.prior)
            noise = (sums.count - fitted + 2 * self.prior) / (residual + 2 * self.prior)
            if np.abs(weights - before).sum() < self.tolerance:
                break
        return sums.model(weights)


class MatchingPursuit(FromSums):
    """Orthogonal matching pursuit on the p x p sums: by default a tenth of the features, one at least."""

    def __init__(self, features: int | None = None):
        super().__init__()
        self.features = features

    def fit_sums(self, sums: Regression) -> Model:
        size = len(sums.mean)
        wanted = self.features or max(int(0.1 * size), 1)
        scale = np.sqrt(np.clip(np.diag(sums.xx), 1e-300, None))
        weights, chosen = np.zeros(size), []
        for _ in range(min(wanted, size)):
            pull = np.abs(sums.xy - sums.xx @ weights) / scale
            pull[chosen] = -1.0
            chosen.append(int(np.argmax(pull)))
            block = sums.xx[np.ix_(chosen, chosen)]
            weights = np.zeros(size)
            weights[chosen] = np.linalg.lstsq(block, sums.xy[chosen], rcond=None)[0]
        return sums.model(weights)
