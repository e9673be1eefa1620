"""Ridge, lasso and elastic net from cross-products: every penalty and every fold from one scan of the rows.

Sums of products are taken per fold in one pass. The sums of a training set are those of all folds less the held-out ones,
weights come from them by cyclic coordinate descent, and the held-out error from the held-out sums; rows are not read again.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml import Estimator, Model
from pyspark.sql import DataFrame

from tablewright.models.algebra import FromSums, Moments, Regression, cross_products, matrices, some_row
from tablewright.models.saving import Saved

ROUNDS, TOLERANCE = 10_000, 1e-10    # of the coordinate descent; the largest step relative to the largest weight


def shrink(value: float, by: float) -> float:
    """Towards zero by ``by``, not past it."""
    return np.sign(value) * max(abs(value) - by, 0.0)


def elastic_net(sums: Regression, penalty: float, share: float, start: np.ndarray | None = None) -> np.ndarray:
    """Weights that minimize |y - Xw|^2 / 2n + penalty * (share * |w|_1 + (1 - share) / 2 * |w|^2), the intercept free.

    One weight after another is set to its best value given the others; features without spread keep weight 0.
    """
    xx, xy = sums.xx / sums.count, sums.xy / sums.count
    spread, scale = np.diag(xx), np.sqrt(max(sums.yy / sums.count, 0.0))
    alive = np.flatnonzero(spread > 1e-14 * max(spread.max(initial=0.0), 1e-300))
    weights = np.zeros(len(xy)) if start is None else start.copy()
    for _ in range(ROUNDS):
        step = 0.0
        for j in alive:
            pull = xy[j] - xx[j] @ weights + spread[j] * weights[j]
            new = shrink(pull, penalty * share) / (spread[j] + penalty * (1 - share))
            step = max(step, abs(new - weights[j]) * np.sqrt(spread[j]))
            weights[j] = new
        if step <= TOLERANCE * scale:
            break
    return weights


def ridge(sums: Regression, penalty: float) -> np.ndarray:
    """The elastic net without its first part, solved at once."""
    return np.linalg.lstsq(sums.xx / sums.count + penalty * np.eye(len(sums.xy)), sums.xy / sums.count, rcond=None)[0]


def weights_of(sums: Regression, penalty: float, share: float, start: np.ndarray | None = None) -> np.ndarray:
    return ridge(sums, penalty) if share == 0 else elastic_net(sums, penalty, share, start)


class LinearNet(FromSums):
    """Least squares with a penalty: ``share`` 0 is ridge, 1 lasso, between them the elastic net. One scan."""

    def __init__(self, penalty: float = 1.0, share: float = 0.5):
        super().__init__()
        self.penalty, self.share = penalty, share

    def fit_sums(self, sums: Regression) -> Model:
        return sums.model(weights_of(sums, self.penalty, self.share))


@dataclass
class Folds:
    """The sums of each fold about one origin."""

    cells: dict[float, np.ndarray]
    origin: np.ndarray

    @classmethod
    def of(cls, df: DataFrame, fold: str) -> Folds:
        origin = some_row(df)
        return cls(matrices(cross_products(df, with_label=True, by=fold, origin=origin)), origin)

    def sums(self, names: list[float]) -> Regression:
        return Regression.of_moments(Moments.of(sum(self.cells[n] for n in names), self.origin))

    def every(self) -> Regression:
        return self.sums(list(self.cells))

    def without(self, fold: float) -> Regression:
        return self.sums([n for n in self.cells if n != fold])

    def error(self, fold: float, trained: Regression, weights: np.ndarray) -> float:
        """The mean squared error on a fold of a model trained on other rows, from the fold's sums."""
        held = self.sums([fold])
        offset = held.target_mean - trained.target_mean - weights @ (held.mean - trained.mean)
        return float((held.yy - 2 * weights @ held.xy + weights @ held.xx @ weights) / held.count + offset ** 2)


@dataclass
class Choice:
    """One penalty in one fold."""

    penalty: float
    share: float
    fold: int
    rows: int
    mse: float
    weights: list[float]
    offset: float


def choices(folds: Folds, penalties: list[float], shares: list[float]) -> list[Choice]:
    """All penalties and shares in all folds. Each starts from the weights of the next larger penalty."""
    found = []
    for fold in sorted(folds.cells):
        trained = folds.without(fold)
        for share in shares:
            weights = None
            for penalty in sorted(penalties, reverse=True):
                weights = weights_of(trained, penalty, share, weights)
                found.append(Choice(float(penalty), float(share), int(fold), int(folds.cells[fold][0, 0]), folds.error(fold, trained, weights),
                                    weights.tolist(), float(trained.target_mean - weights @ trained.mean)))
    return found


class LinearSearch(Saved, Estimator):
    """The penalty and share of the smallest mean squared error over folds, then fitted on all rows; one scan in all."""

    def __init__(self, fold: str, penalties: list[float], shares: list[float] = (0.0, 0.5, 1.0)):
        super().__init__()
        self.fold, self.penalties, self.shares = fold, list(penalties), list(shares)

    def _fit(self, df: DataFrame) -> Model:
        folds = Folds.of(df, self.fold)
        if len(folds.cells) < 2:
            raise ValueError("a search needs rows in two folds at least")
        squared: dict[tuple[float, float], float] = {}
        for c in choices(folds, self.penalties, self.shares):
            squared[c.penalty, c.share] = squared.get((c.penalty, c.share), 0.0) + c.mse * c.rows
        penalty, share = min(squared, key=lambda key: (squared[key], key))
        sums = folds.every()
        model = sums.model(weights_of(sums, penalty, share))
        model.penalty, model.share = penalty, share
        return model
