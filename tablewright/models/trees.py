"""Forests of extremely randomized trees, grown level by level over the whole table.

All trees grow at once. A level is two grouped aggregations over the rows: the smallest and largest value of every feature in
every open node, then, for one random threshold between these per node and feature, what goes left. Tasks find a row's node
by walking the trees so far and add up their own rows, so what is shuffled is a few numbers per node, never rows. The driver
keeps the trees, which are bounded by their number and depth, not by the table.

The forests of all folds of a comparison grow in the same passes: each row is there once for every forest that learns from it.

Draws come from MD5 of (seed, tree, place in the tree, feature): the same trees in any layout, and in SQL.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Estimator, Model
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tablewright.models.features import LABEL, PREDICTION, SCORES, argmax, feature_array
from tablewright.models.saving import Saved
from tablewright.session import Generations, ship_package

TREES, DEPTH, SEED = 100, 10, 123    # the library's number of trees; levels, so that a forest is bounded
CELLS = 4_000_000                    # numbers a task adds up at a time: open nodes by features
TOGETHER = 1 << 20                   # nodes of the forests that grow side by side
STEPS = 1 << 18                      # rows by trees that a task walks at a time


def matrix(column: pa.ListArray) -> np.ndarray:
    """An Arrow column of equally long lists as one matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


class Nodes:
    """Trees as flat arrays: the feature that splits a node (-1: a leaf), its threshold, its left child (the right one is next),
    its value."""

    def __init__(self, roots: int, width: int):
        self.feature = np.full(roots, -1, np.int32)
        self.threshold, self.left = np.zeros(roots), np.zeros(roots, np.int64)
        self.tree, self.place = np.arange(roots, dtype=np.int64), np.ones(roots, np.int64)
        self.value = np.zeros((roots, width))
        self.trees = roots

    def split(self, nodes: np.ndarray, feature: np.ndarray, threshold: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Give each node two children with these values; returns the children, left and right in turn."""
        first = len(self.feature)
        self.feature[nodes], self.threshold[nodes] = feature, threshold
        self.left[nodes] = first + 2 * np.arange(len(nodes))
        made = 2 * len(nodes)
        self.feature = np.r_[self.feature, np.full(made, -1, np.int32)]
        self.threshold, self.left = np.r_[self.threshold, np.zeros(made)], np.r_[self.left, np.zeros(made, np.int64)]
        self.tree = np.r_[self.tree, np.repeat(self.tree[nodes], 2)]
        self.place = np.r_[self.place, np.column_stack((2 * self.place[nodes], 2 * self.place[nodes] + 1)).reshape(-1)]
        self.value = np.vstack((self.value, np.stack((left, right), axis=1).reshape(made, -1)))
        return first + np.arange(made)

    def walk(self, x: np.ndarray, tree: int) -> np.ndarray:
        """The leaf of every row in a tree."""
        at, rows = np.full(len(x), tree, np.int64), np.arange(len(x))
        while len(rows):
            feature = self.feature[at[rows]]
            inside = feature >= 0
            rows, feature = rows[inside], feature[inside]
            now = at[rows]
            at[rows] = self.left[now] + (x[rows, feature] > self.threshold[now])
        return at

    def walk_all(self, x: np.ndarray, trees: np.ndarray) -> np.ndarray:
        """The leaf of every row in each of these trees, tree after tree."""
        at = np.repeat(trees.astype(np.int64), len(x))
        moving, rows = np.arange(len(at)), np.tile(np.arange(len(x)), len(trees))
        while len(moving):
            feature = self.feature[at[moving]]
            inside = feature >= 0
            moving, rows, feature = moving[inside], rows[inside], feature[inside]
            now = at[moving]
            at[moving] = self.left[now] + (x[rows, feature] > self.threshold[now])
        return at

    def part(self, model: int, trees: int) -> Nodes:
        """The trees of one of several forests of ``trees`` trees each."""
        mine = np.flatnonzero(self.tree // trees == model)
        place = np.full(len(self.tree), 0, np.int64)
        place[mine] = np.arange(len(mine))
        made = Nodes(trees, self.value.shape[1])
        made.feature, made.threshold, made.value, made.place = (v[mine] for v in (self.feature, self.threshold, self.value, self.place))
        made.left = np.where(made.feature >= 0, place[self.left[mine]], 0)
        made.tree = self.tree[mine] % trees
        return made

    def mean(self, x: np.ndarray) -> np.ndarray:
        """The mean value of all trees for every row."""
        return sum((self.value[self.walk(x, tree)] for tree in range(self.trees)), np.zeros(self.value.shape[1])) / self.trees


def draw(kind: str, seed: int) -> Column:
    """A number from 0 to 1 for a row's tree, place and feature."""
    text = F.concat_ws(":", F.lit(kind), F.lit(seed), "tree", "place", "feature")
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") / float(1 << 32)


def described(spark: SparkSession, nodes: Nodes) -> DataFrame:
    """(tree, place, feature, threshold, value) of every node; the children of place p are 2p and 2p + 1, leaves have feature -1."""
    columns = zip(nodes.tree.tolist(), nodes.place.tolist(), nodes.feature.tolist(), nodes.threshold.tolist(), nodes.value.tolist())
    return spark.createDataFrame(list(columns), "tree bigint, place bigint, feature int, threshold double, value array<double>")


class GrownForest(Saved, Model):
    def __init__(self, nodes: Nodes, classify: bool, centre: float = 0.0):
        super().__init__()
        self.nodes, self.classify, self.centre = nodes, classify, centre

    def _transform(self, df: DataFrame) -> DataFrame:
        ship_package(df.sparkSession)
        shared = df.sparkSession.sparkContext.broadcast(self.nodes)     # bounded by the number of trees and their depth

        @F.pandas_udf("array<double>")
        def values(x: pd.Series) -> pd.Series:
            return pd.Series(list(shared.value.mean(np.stack(x.to_numpy()).astype(float)))) if len(x) else pd.Series([], dtype=object)

        said = df.withColumn(SCORES, values(feature_array()))
        if self.classify:
            return said.withColumn(PREDICTION, argmax(F.col(SCORES)).cast("double"))
        return said.withColumn(PREDICTION, F.get(SCORES, F.lit(0)) + F.lit(self.centre)).drop(SCORES)


class ExtraTrees(Saved, Estimator):
    """Extremely randomized trees (Geurts and others, 2006) on (features, label) rows.

    Each node draws ``features`` of those that vary in it (classes: the square root of all, numbers: all) and for each one threshold
    from its smallest up to its largest value there; the best of these splits by Gini impurity or by variance is taken. Nodes
    of one class, one value or fewer than ``min_rows`` rows are leaves. All trees see all rows.
    """

    def __init__(self, classify: bool = True, trees: int = TREES, depth: int = DEPTH, features: int | None = None,
                 min_rows: int = 2, seed: int = SEED):
        super().__init__()
        self.classify, self.trees, self.depth = classify, trees, depth
        self.features, self.min_rows, self.seed = features, min_rows, seed

    def _fit(self, df: DataFrame) -> GrownForest:
        return self.forest(*self.grow(df))

    def fit_folds(self, df: DataFrame, fold: str, names: list[int]) -> dict[int, GrownForest]:
        """For each fold the forest of the rows outside it, all in the same passes."""
        step, made = max(TOGETHER // (self.trees << min(self.depth, 20)), 1), {}
        for at in range(0, len(names), step):
            found = self.grow_models(outside(df, fold, names[at:at + step], F.col(LABEL).alias("y")))
            made.update({name: self.forest(*found[name]) for name in names[at:at + step]})
        return made

    def forest(self, nodes: Nodes, centre: float) -> GrownForest:
        if self.classify:
            nodes.value = nodes.value / nodes.value.sum(axis=1, keepdims=True)
        else:
            nodes.value = (nodes.value[:, 1] / nodes.value[:, 0])[:, None]
        return GrownForest(nodes, self.classify, centre)

    def grow(self, df: DataFrame) -> tuple[Nodes, float]:
        """The trees, with class counts (or rows, sum and sum of squares about the mean, which comes second) as values."""
        return self.grow_models(df.select(F.lit(0).alias("model"), feature_array().alias("x"), F.col(LABEL).alias("y")))[0]

    def grow_models(self, rows: DataFrame) -> dict[int, tuple[Nodes, float]]:
        """``grow`` for each value of ``model`` in rows of (model, x, y)."""
        ship_package(rows.sparkSession)
        found = rows.groupBy("model").agg(F.count(F.lit(1)).alias("rows"), F.avg("y").alias("mean"), F.max("y").alias("top"),
                                          F.max(F.size("x")).alias("features")).orderBy("model").collect()
        if not found:
            raise ValueError("the table is empty")
        size, names = max(r["features"] for r in found), [r["model"] for r in found]
        centres = [0.0 if self.classify else r["mean"] for r in found]
        width = int(max(r["top"] for r in found)) + 1 if self.classify else 3          # class counts, or rows, sum and sum of squares
        number = F.array_position(F.lit(names), F.col("model")).cast("int") - 1
        kept = Generations(rows.sparkSession)
        rows = kept.settle(rows.select(number.alias("model"), "x", (F.col("y") - F.get(F.lit(centres), number)).alias("y")))
        nodes = Nodes(len(names) * self.trees, width)
        nodes.value[:] = np.repeat(self.whole(rows, len(names), width), self.trees, axis=0)
        level = self.worth(nodes, np.arange(nodes.trees))
        wanted = self.features or (max(int(math.sqrt(size)), 1) if self.classify else size)
        for _ in range(self.depth):
            grown = []
            step = max(CELLS // size, 1)
            for at in range(0, len(level), step):
                grown.append(self.split_level(rows, nodes, level[at:at + step], size, wanted))
            level = self.worth(nodes, np.concatenate(grown)) if grown else np.empty(0, np.int64)
            if not len(level):
                break
        kept.close()
        return {name: (nodes.part(n, self.trees), centre) for n, (name, centre) in enumerate(zip(names, centres))}

    def whole(self, rows: DataFrame, models: int, width: int) -> np.ndarray:
        found = np.zeros((models, width))
        if self.classify:
            for r in rows.groupBy("model", "y").count().collect():
                found[r["model"], int(r["y"])] = r["count"]
        else:
            for r in rows.groupBy("model").agg(F.count(F.lit(1)), F.sum("y"), F.sum(F.col("y") * F.col("y"))).collect():
                found[r["model"]] = r[1:]
        return found

    def worth(self, nodes: Nodes, made: np.ndarray) -> np.ndarray:
        """The nodes that may be split further."""
        value = nodes.value[made]
        if self.classify:
            return made[(value.sum(axis=1) >= self.min_rows) & ((value > 0).sum(axis=1) > 1)]
        return made[(value[:, 0] >= self.min_rows) & (value[:, 2] * value[:, 0] > value[:, 1] ** 2 * (1 + 1e-12))]

    def split_level(self, rows: DataFrame, nodes: Nodes, level: np.ndarray, size: int, wanted: int) -> np.ndarray:
        """Split the open nodes of a level; returns their children."""
        drawn = candidates(rows, nodes, level, size, wanted, self.seed, self.trees).select("node", "nth", "feature", "threshold").toArrow()
        open_at = np.full(len(nodes.feature), -1, np.int64)
        open_at[level] = np.arange(len(level))
        feature, threshold = np.full((len(level), wanted), -1, np.int32), np.zeros((len(level), wanted))
        node, nth, drawn_feature, drawn_threshold = (c.to_numpy() for c in drawn.columns)
        feature[open_at[node], nth - 1], threshold[open_at[node], nth - 1] = drawn_feature, drawn_threshold
        best = self.best_splits(rows, nodes, level, feature, threshold).select("node", "best.nth", "best.left").toArrow()
        if not best.num_rows:
            return np.empty(0, np.int64)
        at, nth = best["node"].to_numpy(), best["nth"].to_numpy()
        left = matrix(best["left"].combine_chunks())
        order = np.argsort(at)
        at, nth, left = at[order], nth[order], left[order]
        return nodes.split(at, feature[open_at[at], nth], threshold[open_at[at], nth], left, nodes.value[at] - left)

    def best_splits(self, rows: DataFrame, nodes: Nodes, level: np.ndarray, feature: np.ndarray, threshold: np.ndarray) -> DataFrame:
        """(node, best: score, nth, left) for every open node with a candidate; what goes right is the rest."""
        width, classify, wanted, trees = nodes.value.shape[1], self.classify, feature.shape[1], self.trees
        shared = rows.sparkSession.sparkContext.broadcast((nodes, level, feature, threshold))
        names, whole = [f"s{k}" for k in range(width)], [f"t{k}" for k in range(width)]

        def left_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            nodes, level, feature, threshold = shared.value
            sums = np.zeros(len(level) * wanted * width)
            for first, last, at, here, x, y in walked(batches, nodes, level, trees):
                block = slice(first * wanted * width, last * wanted * width)
                for nth in range(wanted):
                    column = feature[first + at, nth]
                    goes = (column >= 0) & (x[here, column] <= threshold[first + at, nth])
                    place, mine = (at[goes] * wanted + nth) * width, y[here[goes]]
                    if classify:
                        sums[block] += np.bincount(place + mine.astype(np.int64), minlength=block.stop - block.start)
                    else:
                        for k, weights in enumerate((None, mine, mine * mine)):
                            sums[block] += np.bincount(place + k, weights, block.stop - block.start)
            sums = sums.reshape(-1, width)
            kept = np.flatnonzero(sums.any(axis=1))
            # what the whole node holds is known, a few numbers per open node
            held = nodes.value[level[kept // wanted]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(level[kept // wanted]), pa.array((kept % wanted).astype(np.int32)), *(pa.array(sums[kept, k]) for k in range(width)),
                 *(pa.array(held[:, k]) for k in range(width))], names=["node", "nth", *names, *whole])

        def total(columns: list[Column]) -> Column:
            return reduce(Column.__add__, columns)

        sums = rows.mapInArrow(left_sums, "node bigint, nth int, " + ", ".join(f"{n} double" for n in names + whole)).groupBy(
            "node", "nth").agg(*(F.sum(n).alias(n) for n in names), *(F.max(n).alias(n) for n in whole))
        left = [F.col(n) for n in names]
        right = [F.col(t) - F.col(n) for n, t in zip(names, whole)]
        if classify:
            score = total([c * c for c in left]) / total(left) + total([c * c for c in right]) / total(right)
            some = (total(left) > 0) & (total(right) > 0)
        else:
            score = left[1] * left[1] / left[0] + right[1] * right[1] / right[0]
            some = (left[0] > 0) & (right[0] > 0)
        return sums.filter(some).groupBy("node").agg(F.max(F.struct(
            score.alias("score"), (-F.col("nth")).alias("back"), F.col("nth").alias("nth"), F.array(*left).alias("left"))).alias("best"))


def outside(df: DataFrame, fold: str, names: list[int], label: Column) -> DataFrame:
    """(model, x, y): each row once for every fold of ``names`` that it is not in, the rows of a model beside each other."""
    others = F.filter(F.lit(names), lambda n: n != F.col(fold))
    return df.select(F.explode(others).alias("model"), feature_array().alias("x"), label).sortWithinPartitions("model")


def walked(batches: Iterator[pa.RecordBatch], nodes: Nodes, level: np.ndarray, trees: int) -> Iterator[tuple]:
    """(first, last, at, here, x, y) for some trees at a time, whose open nodes are level[first:last]: row here[i] of (x, y) is in level[first + at[i]].

    The nodes of a level stand in the order of their trees.
    """
    of_tree = nodes.tree[level]
    open_at = np.full(len(nodes.feature), -1, np.int64)
    open_at[level] = np.arange(len(level))
    for batch in batches:
        model, every = batch.column(0).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False)
        points = matrix(batch.column(1)) if batch.num_rows else None
        for m in np.unique(model):
            mine = np.flatnonzero(model == m)
            x, y = (points, every) if len(mine) == len(model) else (points[mine], every[mine])
            low, high = np.searchsorted(of_tree, [m * trees, (m + 1) * trees])
            growing = np.unique(of_tree[low:high])
            step = max(STEPS // len(x), 1)
            for n in range(0, len(growing), step):
                some = growing[n:n + step]
                first, last = np.searchsorted(of_tree, [some[0], some[-1] + 1])
                at = open_at[nodes.walk_all(x, some)] - first
                inside = np.flatnonzero(at >= 0)
                yield first, last, at[inside], inside % len(x), x, y


def node_ranges(rows: DataFrame, nodes: Nodes, level: np.ndarray, size: int, trees: int) -> DataFrame:
    """(node, tree, place, feature, low, high): the values of every feature in every open node, with its tree's number in its forest."""
    shared = rows.sparkSession.sparkContext.broadcast((nodes, level))

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, level = shared.value
        low, high = np.full((len(level), size), np.inf), np.full((len(level), size), -np.inf)
        for first, last, at, here, x, _ in walked(batches, nodes, level, trees):
            order = np.argsort(at.astype(np.uint16) if last - first <= 1 << 16 else at, kind="stable")
            if len(order):
                there, starts = np.unique(at[order], return_index=True)
                there, sorted_x = first + there, x[here[order]]
                low[there] = np.minimum(low[there], np.minimum.reduceat(sorted_x, starts))
                high[there] = np.maximum(high[there], np.maximum.reduceat(sorted_x, starts))
        at, feature = np.nonzero(low <= high)
        node = level[at]
        yield pa.RecordBatch.from_arrays(
            [pa.array(node), pa.array(nodes.tree[node] % trees), pa.array(nodes.place[node]), pa.array(feature.astype(np.int32)),
             pa.array(low[at, feature]), pa.array(high[at, feature])], names=["node", "tree", "place", "feature", "low", "high"])

    found = rows.mapInArrow(ranges, "node bigint, tree bigint, place bigint, feature int, low double, high double")
    return found.groupBy("node", "tree", "place", "feature").agg(F.min("low").alias("low"), F.max("high").alias("high"))


def candidates(rows: DataFrame, nodes: Nodes, level: np.ndarray, size: int, wanted: int, seed: int, trees: int) -> DataFrame:
    """(node, tree, place, feature, low, high, threshold, nth): the drawn features of every open node, nth from 1.

    ``low <= threshold < high``, so both sides get rows.
    """
    found = node_ranges(rows, nodes, level, size, trees).filter(F.col("low") < F.col("high"))
    drawn = F.col("low") + draw("threshold", seed) * (F.col("high") - F.col("low"))
    found = found.withColumns({"threshold": F.when(drawn < F.col("high"), drawn).otherwise(F.col("low")), "_pick": draw("feature", seed)})
    by_pick = Window.partitionBy("node").orderBy("_pick", "feature")
    return found.withColumn("nth", F.row_number().over(by_pick)).filter(F.col("nth") <= wanted).drop("_pick")
