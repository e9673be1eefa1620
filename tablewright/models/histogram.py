"""Gradient boosting on histograms, with trees grown leaf by leaf.

Features are cut once into at most ``bins`` bins at their quantiles. A round adds one tree (classes above two: one for each, by
softmax loss). What a leaf needs is the sum of slopes and curvatures per feature and bin: tasks add up their own rows,
and one group for each leaf and feature merges these and finds its best split from running sums over the bins.

**Leaf by leaf with few passes.** The next leaf to split is the one of the highest gain, until there are ``leaves``. That order is
replayed from what is known; when it comes to a leaf whose histogram is missing, one pass over the rows makes all that
are missing, and those of the children of the other promising leaves as well. The trees are those of one split at a time, with about
as many passes as a tree is deep. The scores so far are part of the table, written out every ``SETTLE_EVERY`` rounds.

**Models side by side.** The models of all folds of a comparison grow in the same passes: each row is there once for every model
that learns from it, with the bins and scores of that model, and a pass adds up the missing leaves of all models.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Estimator, Model
from pyspark.sql import DataFrame, SparkSession, functions as F

from tablewright.models.features import LABEL, PREDICTION, SCORES, argmax, feature_array
from tablewright.models.saving import Saved
from tablewright.models.trees import matrix, outside
from tablewright.session import Generations, ship_package

#: The usual settings of the method's library.
ROUNDS, LEAVES, RATE, BINS, MIN_ROWS, MIN_CURVATURE = 100, 31, 0.1, 255, 20, 1e-3
SETTLE_EVERY = 10    # rounds after which the scores of the rows are written out
ACCURACY = 10_000    # of the quantiles at which features are cut
TOGETHER = 4_000_000    # histogram cells of the models that are boosted side by side
ROWS = "model int, x array<int>, y double, scores array<double>"


def bin_edges(rows: DataFrame, size: int, bins: int) -> dict[int, list[np.ndarray]]:
    """For each model the upper bounds of each feature's bins but the last: all its values but the largest, or its quantiles if there are more."""
    shares = [float(k) / bins for k in range(1, bins)] + [1.0]
    cuts = rows.groupBy("model").agg(*(F.percentile_approx(F.get("x", F.lit(j)), shares, ACCURACY).alias(f"c{j}") for j in range(size)))
    return {r["model"]: [np.unique(np.array(r[f"c{j}"], float))[:-1] for j in range(size)] for r in cuts.collect()}


@dataclass
class Leaf:
    """A node while its tree grows: sums of slopes and curvatures, rows; the best split once it is known."""

    slope: float
    curvature: float
    rows: float
    known: bool = False
    gain: float = 0.0
    feature: int = -1
    bin: int = -1
    children: list[Leaf] = field(default_factory=list)
    number: int = -1

    def learn(self, row) -> None:
        self.known = True
        if row is not None and not self.rows:                 # a root
            self.slope, self.curvature, self.rows = row["slope"], row["curvature"], row["n"]
        if row is not None and row["gain"] is not None:
            self.gain, self.feature, self.bin = row["gain"], row["feature"], row["bin"]
            left = Leaf(row["left_slope"], row["left_curvature"], row["left_rows"])
            self.children = [left, Leaf(self.slope - left.slope, self.curvature - left.curvature, self.rows - left.rows)]

    def value(self, rate: float, penalty: float) -> float:
        return -rate * self.slope / (self.curvature + penalty)


class Growth:
    """The best-first order over what is known of a tree."""

    def __init__(self, root: Leaf, leaves: int):
        self.root, self.leaves = root, leaves
        self.split: list[Leaf] = []

    def replay(self) -> list[Leaf]:
        """Split by highest gain as far as histograms are known; returns the leaves whose histograms are missing, none at the end."""
        ends, self.split = [self.root], []
        while True:
            missing = [leaf for leaf in ends if not leaf.known]
            best = max((leaf for leaf in ends if leaf.known and leaf.children), key=lambda leaf: leaf.gain, default=None)
            if len(ends) >= self.leaves or not (missing or best):
                return []
            if missing:
                room = self.leaves - len(ends)
                promising = sorted((leaf for leaf in ends if leaf.children), key=lambda leaf: -leaf.gain)[:room]
                return missing + [child for leaf in promising for child in leaf.children if not child.known]
            self.split.append(best)
            at = ends.index(best)
            ends[at:at + 1] = best.children


@dataclass
class FlatTree:
    """A tree over bins as arrays; leaves have feature -1."""

    feature: np.ndarray
    bin: np.ndarray
    left: np.ndarray
    value: np.ndarray

    def walk(self, binned: np.ndarray) -> np.ndarray:
        at, rows = np.zeros(len(binned), np.int64), np.arange(len(binned))
        while len(rows):
            feature = self.feature[at[rows]]
            inside = feature >= 0
            rows, feature = rows[inside], feature[inside]
            now = at[rows]
            at[rows] = self.left[now] + (binned[rows, feature] > self.bin[now])
        return at


def flat(root: Leaf, split: set[int] | None, rate: float, penalty: float) -> FlatTree:
    """The tree below ``root``; ``split`` names the nodes (by id) that stay split, None: all that are known."""
    every, feature, cut, left = [root], [-1], [-1], [0]
    for at, node in enumerate(every):
        node.number = at
        if node.children and (split is None or id(node) in split):
            feature[at], cut[at], left[at] = node.feature, node.bin, len(every)
            every.extend(node.children)
            feature += [-1, -1]
            cut += [-1, -1]
            left += [0, 0]
    return FlatTree(np.array(feature), np.array(cut), np.array(left), np.array([n.value(rate, penalty) for n in every]))


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.column_stack([np.searchsorted(e, x[:, j]) for j, e in enumerate(edges)]).astype(np.int32)


def slopes(kind: str, scores: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slope and curvature of the loss at the scores, a column for each tree of a round."""
    if kind == "squared":
        return scores - y[:, None], np.ones_like(scores)
    if kind == "logistic":
        share = 1 / (1 + np.exp(-scores))
        return share - y[:, None], share * (1 - share)
    share = np.exp(scores - scores.max(axis=1, keepdims=True))
    share /= share.sum(axis=1, keepdims=True)
    return share - (y[:, None] == np.arange(scores.shape[1])), share * (1 - share)


def by_model(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    """The rows of each model of a batch, which as a rule holds one."""
    model = batch.column(0).to_numpy(zero_copy_only=False)
    found = np.unique(model)
    for m in found:
        yield int(m), batch if len(found) == 1 else batch.filter(pa.array(model == m))


@dataclass
class Pass:
    """What a pass over the rows of one model needs: trees behind the scores in the table, growing trees, and the number of each wanted node."""

    kind: str
    recent: list[list[FlatTree]]
    growing: list[FlatTree]
    wanted: list[dict[int, int]]


def histograms(rows: DataFrame, passes: dict[int, Pass], count: int, size: int, bins: int) -> DataFrame:
    """(leaf, feature, bin, slope, curvature, n) of the ``count`` wanted nodes of the growing trees, as each task has added them up."""
    shared = rows.sparkSession.sparkContext.broadcast(passes)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passes, columns = shared.value, np.arange(size)
        sums = np.zeros((3, count * size * bins))
        for m, batch in (part for batch in batches for part in by_model(batch)):
            if m not in passes:
                continue
            now = passes[m]
            x, y = matrix(batch.column(1)).astype(np.int32), batch.column(2).to_numpy(zero_copy_only=False)
            scores = matrix(batch.column(3))
            for trees in now.recent:
                for k, tree in enumerate(trees):
                    scores[:, k] += tree.value[tree.walk(x)]
            slope, curvature = slopes(now.kind, scores, y)
            for k, (tree, leaves) in enumerate(zip(now.growing, now.wanted)):
                if not leaves:
                    continue
                first = min(leaves.values())                # a tree's numbers follow each other
                block = slice(first * size * bins, (first + len(leaves)) * size * bins)
                to = np.full(len(tree.feature), -1, np.int64)
                to[list(leaves)] = np.array(list(leaves.values())) - first
                at = to[tree.walk(x)]
                inside = np.flatnonzero(at >= 0)
                place = ((at[inside, None] * size + columns) * bins + x[inside]).reshape(-1)
                for n, weights in enumerate((slope, curvature)):
                    sums[n, block] += np.bincount(place, np.repeat(weights[inside, k], size), block.stop - block.start)
                sums[2, block] += np.bincount(place, minlength=block.stop - block.start)
        kept = np.flatnonzero(sums[2])
        yield pa.RecordBatch.from_arrays(
            [pa.array((kept // (size * bins)).astype(np.int32)), pa.array((kept // bins % size).astype(np.int32)),
             pa.array((kept % bins).astype(np.int32)), *(pa.array(s[kept]) for s in sums)],
            names=["leaf", "feature", "bin", "slope", "curvature", "n"])

    return rows.mapInArrow(add_up, "leaf int, feature int, bin int, slope double, curvature double, n double")


BEST = ("leaf int, feature int, gain double, bin int, left_slope double, left_curvature double, left_rows double, "
        "slope double, curvature double, n double")
BEST_NAMES = [part.split()[0] for part in BEST.split(", ")]


def best_splits(found: DataFrame, count: int, size: int, bins: int, penalty: float, min_rows: int, min_curvature: float) -> DataFrame:
    """For each leaf and feature the sums of all rows and the best split, if any: gain, last bin of the left side, its sums.

    What the tasks sent for a leaf and a feature meets in one task, which adds it up batch by batch.
    """

    def worth(slope: np.ndarray, curvature: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            return slope * slope / (curvature + penalty)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, met = np.zeros((3, count * size * bins)), np.empty(0, np.int64)
        for batch in batches:
            leaf, feature, cut = (batch.column(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in range(3))
            here = leaf * size + feature
            met = np.union1d(met, here)
            for n in range(3):
                np.add.at(sums[n], here * bins + cut, batch.column(3 + n).to_numpy(zero_copy_only=False))
        if not len(met):
            return
        sums = sums.reshape(3, -1, bins)[:, met]
        left, whole = np.cumsum(sums, axis=2), sums.sum(axis=2)
        right = whole[:, :, None] - left
        fits = (left[2] >= min_rows) & (right[2] >= min_rows) & (left[1] >= min_curvature) & (right[1] >= min_curvature)
        node = worth(whole[0], whole[1])
        gains = np.where(fits, worth(left[0], left[1]) + worth(right[0], right[1]) - node[:, None], -np.inf)
        top, each = np.argmax(gains, axis=1), np.arange(len(met))
        gain, left = gains[each, top], left[:, each, top]
        none = ~(gain > 1e-12 + 1e-10 * node)     # gains below the last digits of what they are differences of are none
        split = (gain, top.astype(np.int32), *left)
        yield pa.RecordBatch.from_arrays(
            [pa.array((met // size).astype(np.int32)), pa.array((met % size).astype(np.int32)),
             *(pa.array(v, mask=none) for v in split), *map(pa.array, whole)], names=BEST_NAMES)

    return found.repartition("leaf", "feature").mapInArrow(best, BEST)


class Boosted(Saved, Model):
    """Start scores and trees; a prediction walks all trees over a row's bins."""

    def __init__(self, kind: str, edges: list[np.ndarray], start: np.ndarray, rounds: list[list[FlatTree]]):
        super().__init__()
        self.kind, self.edges, self.start, self.rounds = kind, edges, start, rounds

    def described(self, spark: SparkSession) -> DataFrame:
        """(round, score, node, feature, threshold, left, value) of every node; the right child follows the left one, leaves have feature -1."""
        rows = [(n, k, at, int(f), float(self.edges[f][cut]) if f >= 0 else None, int(left) if f >= 0 else None, float(value))
                for n, trees in enumerate(self.rounds) for k, tree in enumerate(trees)
                for at, (f, cut, left, value) in enumerate(zip(tree.feature, tree.bin, tree.left, tree.value))]
        return spark.createDataFrame(rows, "round int, score int, node int, feature int, threshold double, left int, value double")

    def raw(self, x: np.ndarray) -> np.ndarray:
        bins, scores = binned(x, self.edges), np.tile(self.start, (len(x), 1))
        for trees in self.rounds:
            for k, tree in enumerate(trees):
                scores[:, k] += tree.value[tree.walk(bins)]
        return scores

    def scores(self, x: np.ndarray) -> np.ndarray:
        raw = self.raw(x)
        if self.kind == "squared":
            return raw
        if self.kind == "logistic":
            share = 1 / (1 + np.exp(-raw))
            return np.hstack((1 - share, share))
        share = np.exp(raw - raw.max(axis=1, keepdims=True))
        return share / share.sum(axis=1, keepdims=True)

    def _transform(self, df: DataFrame) -> DataFrame:
        ship_package(df.sparkSession)
        shared = df.sparkSession.sparkContext.broadcast(self)     # bounded by rounds, classes and leaves

        @F.pandas_udf("array<double>")
        def values(x: pd.Series) -> pd.Series:
            return pd.Series(list(shared.value.scores(np.stack(x.to_numpy()).astype(float)))) if len(x) else pd.Series([], dtype=object)

        said = df.withColumn(SCORES, values(feature_array()))
        if self.kind == "squared":
            return said.withColumn(PREDICTION, F.get(SCORES, F.lit(0))).drop(SCORES)
        return said.withColumn(PREDICTION, argmax(F.col(SCORES)).cast("double"))

    def __reduce__(self):
        return Boosted, (self.kind, self.edges, self.start, self.rounds)


class HistogramBoosting(Saved, Estimator):
    """Boosted trees on (features, label) rows; labels of classes are 0, 1, ...

    Training ends early when no tree of a round finds a split. ``min_rows`` and ``min_curvature`` are the least a leaf holds.
    """

    def __init__(self, classify: bool = True, rounds: int = ROUNDS, leaves: int = LEAVES, rate: float = RATE, bins: int = BINS,
                 min_rows: int = MIN_ROWS, min_curvature: float = MIN_CURVATURE, penalty: float = 0.0):
        super().__init__()
        self.classify, self.rounds, self.leaves, self.rate, self.bins = classify, rounds, leaves, rate, bins
        self.min_rows, self.min_curvature, self.penalty = min_rows, min_curvature, penalty

    def begin(self, rows: DataFrame) -> tuple[int, dict[int, tuple[str, np.ndarray]]]:
        """The number of features, and for each model the loss and the start scores."""
        found = rows.groupBy("model").agg(F.avg("y").alias("mean"), F.count(F.lit(1)).alias("rows"), F.max(F.size("x")).alias("size")).collect()
        if not found:
            raise ValueError("the table is empty")
        size = max(r["size"] for r in found)
        if not self.classify:
            return size, {r["model"]: ("squared", np.array([r["mean"]])) for r in found}
        counts: dict[int, dict[int, int]] = {}
        for r in rows.groupBy("model", "y").count().collect():
            counts.setdefault(r["model"], {})[int(r["y"])] = r["count"]
        begun = {}
        for r in found:
            mine = counts[r["model"]]
            if sorted(mine) != list(range(len(mine))):
                raise ValueError("class labels must be 0, 1, ... without gaps")
            shares = np.array([mine[c] for c in sorted(mine)]) / r["rows"]
            two = len(shares) == 2
            begun[r["model"]] = ("logistic", np.array([math.log(shares[1] / shares[0])])) if two else ("softmax", np.log(shares))
        return size, begun

    def _fit(self, df: DataFrame) -> Boosted:
        return self.fit_models(df.select(F.lit(0).alias("model"), feature_array().alias("x"), F.col(LABEL).cast("double").alias("y")))[0]

    def fit_folds(self, df: DataFrame, fold: str, names: list[int]) -> dict[int, Boosted]:
        """For each fold the model of the rows outside it, all in the same passes."""
        return self.fit_models(outside(df, fold, names, F.col(LABEL).cast("double").alias("y")))

    def fit_models(self, rows: DataFrame) -> dict[int, Boosted]:
        """A model for each value of ``model`` in rows of (model, x, y)."""
        ship_package(rows.sparkSession)
        kept = Generations(rows.sparkSession)
        rows = kept.settle(rows)
        size, begun = self.begin(rows)
        edges = bin_edges(rows, size, self.bins)
        models = {m: Boosted(kind, edges[m], start, []) for m, (kind, start) in sorted(begun.items())}
        widest = max(len(model.start) for model in models.values())
        step = max(TOGETHER // (2 * self.leaves * widest * size * self.bins), 1)
        for at in range(0, len(models), step):
            self.boost(rows, dict(list(models.items())[at:at + step]), size)
        kept.close()
        return models

    def boost(self, plain: DataFrame, models: dict[int, Boosted], size: int) -> None:
        """Grow the trees of these models, round by round."""
        generations = Generations(plain.sparkSession)
        rows = generations.settle(plain.filter(F.col("model").isin(list(models))).mapInArrow(binning(models), ROWS))
        growing, settled = dict(models), 0
        for number in range(self.rounds):
            for m, trees in self.one_round(rows, growing, settled, size).items():
                if trees is None:
                    del growing[m]
                else:
                    models[m].rounds.append(trees)
            if not growing:
                break
            if number + 1 - settled == SETTLE_EVERY and number + 1 < self.rounds:
                recent = {m: model.rounds[settled:] for m, model in growing.items()}
                rows = generations.settle(rows.filter(F.col("model").isin(list(growing))).mapInArrow(adding(recent), ROWS))
                settled = number + 1
        generations.close()

    def one_round(self, rows: DataFrame, models: dict[int, Boosted], settled: int, size: int) -> dict[int, list[FlatTree] | None]:
        """For each model one tree for each score, or None if none of them has a split. The table has the scores of the first ``settled`` rounds."""
        growth = {m: [Growth(Leaf(0.0, 0.0, 0.0), self.leaves) for _ in model.start] for m, model in models.items()}
        while True:
            passes, asked = {}, []
            for m, trees in growth.items():
                missing = [g.replay() for g in trees]
                if not any(missing):
                    continue
                growing, wanted = [flat(g.root, None, self.rate, self.penalty or 1.0) for g in trees], []
                for leaves in missing:
                    wanted.append({leaf.number: len(asked) + n for n, leaf in enumerate(leaves)})
                    asked += leaves
                passes[m] = Pass(models[m].kind, models[m].rounds[settled:], growing, wanted)
            if not asked:
                break
            found = histograms(rows, passes, len(asked), size, self.bins)
            best = {}
            for r in best_splits(found, len(asked), size, self.bins, self.penalty, self.min_rows, self.min_curvature).collect():
                order = (r["gain"] is not None, r["gain"] or 0.0, -r["feature"])
                if r["leaf"] not in best or order > best[r["leaf"]][0]:
                    best[r["leaf"]] = order, r
            for n, leaf in enumerate(asked):
                leaf.learn(best[n][1] if n in best else None)
        return {m: [flat(g.root, {id(leaf) for leaf in g.split}, self.rate, self.penalty) for g in trees] if any(g.split for g in trees) else None
                for m, trees in growth.items()}


def lists(values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """A matrix as an Arrow column of lists."""
    ends = np.arange(len(values) + 1) * values.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values.reshape(-1), kind))


def binning(models: dict[int, Boosted]):
    begun = {m: (model.edges, model.start) for m, model in models.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for m, batch in (part for batch in batches for part in by_model(batch)):
            edges, start = begun[m]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), lists(binned(matrix(batch.column(1)), edges), pa.int32()), batch.column(2),
                 lists(np.tile(start, (batch.num_rows, 1)), pa.float64())], names=["model", "x", "y", "scores"])

    return run


def adding(recent: dict[int, list[list[FlatTree]]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for m, batch in (part for batch in batches for part in by_model(batch)):
            x, scores = matrix(batch.column(1)).astype(np.int32), matrix(batch.column(3))
            for trees in recent[m]:
                for k, tree in enumerate(trees):
                    scores[:, k] += tree.value[tree.walk(x)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], lists(scores, pa.float64())], names=["model", "x", "y", "scores"])

    return run
