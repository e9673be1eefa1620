"""Exact k nearest neighbours as a two-step distributed join over space cells.

Training points are put into the cells of a balanced space partition built from a bounded sample. A
query first searches its own cell, which bounds the distance of its k-th neighbour; it then visits
only the other cells whose box lies within that bound. Cells with many points or many queries are
cut into chunks by a hash, so no task holds more than about ``CHUNK`` of either. Equal points are
kept k times at most, which cannot change an answer because ties go to the smaller id.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import Estimator, Model
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import Window

from tablewright.models.features import FEATURES, LABEL, PREDICTION, SCORES, argmax, feature_array
from tablewright.models.saving import Saved
from tablewright.session import settle, ship_package

CHUNK = 20_000         # points or queries one task searches at a time
CELL_POINTS = 4_000    # points aimed at per cell
MOST_CELLS = 16_384    # bound of the partition every task receives
SAMPLE_POINTS = 65_536
NEIGHBOURS = 5         # fixed value: neighbours asked for by default
HITS = "x array<double>, distance double, id bigint, label double"


@dataclass
class Cells:
    """A balanced space partition: inner nodes as arrays, and per cell its box, points and chunks."""

    axis: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    cell: np.ndarray
    count: int
    low: np.ndarray | None = None
    high: np.ndarray | None = None
    points: np.ndarray | None = None

    @classmethod
    def build(cls, sample: np.ndarray, cells: int) -> Cells:
        axis, cut, left, right, cell = [], [], [], [], []
        leaves = 0

        def node(rows: np.ndarray, wanted: int) -> int:
            nonlocal leaves
            place = len(axis)
            for column, value in ((axis, -1), (cut, 0.0), (left, place), (right, place), (cell, -1)):
                column.append(value)
            spread = np.ptp(rows, axis=0) if len(rows) else np.zeros(1)
            widest = int(np.argmax(spread))
            if wanted > 1 and spread[widest] > 0:
                middle = float(np.median(rows[:, widest]))
                below = rows[:, widest] < middle
                if not below.any():
                    middle = float(np.nextafter(middle, np.inf))
                    below = rows[:, widest] < middle
                axis[place], cut[place] = widest, middle
                left[place] = node(rows[below], wanted // 2)
                right[place] = node(rows[~below], wanted - wanted // 2)
            else:
                cell[place] = leaves
                leaves += 1
            return place

        node(sample, cells)
        return cls(np.array(axis), np.array(cut), np.array(left), np.array(right), np.array(cell), leaves)

    def find(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), dtype=np.int64)
        while True:
            moving = np.flatnonzero(self.axis[at] >= 0)
            if not len(moving):
                return self.cell[at]
            here = at[moving]
            goes_left = x[moving, self.axis[here]] < self.cut[here]
            at[moving] = np.where(goes_left, self.left[here], self.right[here])

    def within(self, x: np.ndarray, bound: np.ndarray, k: int) -> list[np.ndarray]:
        """For each point the filled cells no farther than its bound; without one, than the reach of k points."""
        found = []
        filled = np.flatnonzero(self.points > 0)
        low, high, points = self.low[filled], self.high[filled], self.points[filled]
        for row, limit in zip(x, bound):
            nearest = np.sqrt((np.clip(low - row, 0, None) ** 2 + np.clip(row - high, 0, None) ** 2).sum(axis=1))
            if not np.isfinite(limit):
                farthest = np.sqrt((np.maximum(np.abs(low - row), np.abs(high - row)) ** 2).sum(axis=1))
                order = np.argsort(farthest)
                reach = np.searchsorted(np.cumsum(points[order]), k)
                limit = farthest[order[min(reach, len(order) - 1)]] if reach < len(order) else np.inf
            found.append(filled[nearest <= limit * (1 + 1e-9) + 1e-12])
        return found



def search(points: pd.DataFrame, asked: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k best (distance, id) of one chunk of points for each of one chunk of queries."""
    points = points.sort_values("id")
    p = np.stack(points["x"].to_numpy())
    ids, labels, xs = points["id"].to_numpy(), points["label"].to_numpy(), asked["x"].to_numpy()
    step, parts = max(1, 2_000_000 // len(p)), []
    for start in range(0, len(xs), step):
        q = np.stack(xs[start:start + step])
        squares = np.zeros((len(q), len(p)))
        for axis in range(p.shape[1]):
            squares += (q[:, axis, None] - p[None, :, axis]) ** 2
        limit = np.partition(squares, k - 1, axis=1)[:, k - 1] if len(p) > k else np.full(len(q), np.inf)
        row, col = np.nonzero(squares <= limit[:, None])
        far = squares[row, col]
        order = np.lexsort((col, far, row))     # columns stand in id order, so equal distances do too
        row, col, far = row[order], col[order], far[order]
        nth = np.arange(len(row)) - np.searchsorted(row, row)
        row, col, far = row[nth < k], col[nth < k], far[nth < k]
        parts.append(pd.DataFrame({"x": xs[start + row], "distance": np.sqrt(far), "id": ids[col],
                                   "label": labels[col]}))
    return pd.concat(parts)


def top(hits: DataFrame, k: int) -> DataFrame:
    """Each query's k best hits; Spark keeps only k per query before it shuffles."""
    rank = F.row_number().over(Window.partitionBy("x").orderBy("distance", "id"))
    return hits.withColumn("rank", rank).filter(F.col("rank") <= k)


class Index:
    """Training points with their cells, ready to be searched."""

    def __init__(self, train: DataFrame, k: int):
        """``train`` holds (x, id, label)."""
        self.spark, self.k = train.sparkSession, k
        ship_package(self.spark)
        same = F.row_number().over(Window.partitionBy("x").orderBy("id"))
        points = train.withColumn("_same", same).filter(F.col("_same") <= k).select("x", "id", "label")
        points = settle(points)
        total = points.count()
        if not total:
            raise ValueError("no training points")
        share = 1 << 20
        pool = points.select("x")
        if total > SAMPLE_POINTS:
            pool = pool.filter(F.pmod(F.xxhash64("x", "id"), F.lit(share)) < math.ceil(share * SAMPLE_POINTS / total))
        sample = np.stack([np.array(r["x"]) for r in pool.collect()])
        cells = Cells.build(sample, max(1, min(MOST_CELLS, math.ceil(total / CELL_POINTS))))
        size = sample.shape[1]
        self.points = self.placed(points, cells)
        boxes = self.points.groupBy("cell").agg(
            F.count(F.lit(1)).alias("n"), *(F.min(F.get("x", F.lit(i))).alias(f"l{i}") for i in range(size)),
            *(F.max(F.get("x", F.lit(i))).alias(f"h{i}") for i in range(size))).collect()
        cells.low, cells.high = np.zeros((cells.count, size)), np.zeros((cells.count, size))
        cells.points = np.zeros(cells.count)
        for row in boxes:
            cells.points[row["cell"]] = row["n"]
            cells.low[row["cell"]] = [row[f"l{i}"] for i in range(size)]
            cells.high[row["cell"]] = [row[f"h{i}"] for i in range(size)]
        self.cells = cells

    @staticmethod
    def placed(df: DataFrame, cells: Cells) -> DataFrame:
        shared = df.sparkSession.sparkContext.broadcast(cells)

        @F.pandas_udf("int")
        def cell_of(x: pd.Series) -> pd.Series:
            return pd.Series(shared.value.find(np.stack(x.to_numpy())).astype("int32"))

        return df.withColumn("cell", cell_of("x"))

    def chunked(self, visits: DataFrame) -> DataFrame:
        """All (query, cell) visits answered, in tasks of bounded size."""
        k = self.k
        asked = {r["cell"]: r["n"] for r in visits.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
        point_chunks = [max(1, math.ceil(n / CHUNK)) for n in self.cells.points]
        query_chunks = [max(1, math.ceil(asked.get(c, 0) / CHUNK)) for c in range(self.cells.count)]
        points_in = F.get(F.lit(point_chunks), F.col("cell"))
        queries_in = F.get(F.lit(query_chunks), F.col("cell"))

        def every(n):
            return F.explode(F.sequence(F.lit(0), n - 1))

        points = (self.points.withColumn("pc", F.pmod(F.xxhash64("x", "id"), points_in).cast("int"))
                  .withColumn("qc", every(queries_in)))
        queries = (visits.withColumn("qc", F.pmod(F.xxhash64("x"), queries_in).cast("int"))
                   .withColumn("pc", every(points_in)))

        def answer(found: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
            if len(found) and len(wanted):
                return search(found, wanted, k)
            return pd.DataFrame({"x": pd.Series(dtype=object), "distance": pd.Series(dtype=float),
                                 "id": pd.Series(dtype="int64"), "label": pd.Series(dtype=float)})

        keys = ("cell", "pc", "qc")
        return points.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInPandas(answer, HITS)

    def nearest(self, queries: DataFrame) -> DataFrame:
        """(x, rank, distance, id, label) for every distinct ``x`` of the queries."""
        k = self.k
        asked = settle(self.placed(queries.select("x").distinct(), self.cells))
        own = settle(top(self.chunked(asked), k))
        bounds = own.groupBy("x").agg(F.when(F.count(F.lit(1)) >= k, F.max("distance")).alias("bound"))
        shared = self.spark.sparkContext.broadcast(self.cells)

        @F.pandas_udf("array<int>")
        def cells_within(x: pd.Series, bound: pd.Series) -> pd.Series:
            limits = bound.fillna(np.inf).to_numpy(dtype=float)
            return pd.Series([c.astype("int32") for c in shared.value.within(np.stack(x.to_numpy()), limits, k)])

        visits = (asked.join(bounds, "x", "left").withColumnRenamed("cell", "home")
                  .select("x", "home", F.explode(cells_within("x", "bound")).alias("cell"))
                  .filter(F.col("cell") != F.col("home")).drop("home"))
        further = self.chunked(settle(visits))
        return top(own.select("x", "distance", "id", "label").unionByName(further), k)


class Neighbours(Saved, Model):
    def __init__(self, index: Index, classes: int | None):
        super().__init__()
        self.index, self.classes = index, classes

    def _transform(self, df: DataFrame) -> DataFrame:
        asked = df.withColumn("_x", feature_array())
        found = self.index.nearest(asked.select(F.col("_x").alias("x")))
        if self.classes is None:
            said = found.groupBy("x").agg(F.avg("label").alias(PREDICTION))
        else:
            shares = [F.avg((F.col("label") == c).cast("double")) for c in range(self.classes)]
            said = found.groupBy("x").agg(F.array(*shares).alias(SCORES))
            said = said.withColumn(PREDICTION, argmax(F.col(SCORES)).cast("double"))
        return asked.join(said, asked["_x"] == said["x"], "left").drop("_x", "x")


class NeighbourEstimator(Saved, Estimator):
    """k nearest neighbours; ``id_column`` breaks ties, without it a hash of the row does."""

    def __init__(self, k: int = NEIGHBOURS, classify: bool = True, id_column: str | None = None):
        super().__init__()
        self.k, self.classify, self.id_column = k, classify, id_column

    def _fit(self, df: DataFrame) -> Model:
        named = F.col(self.id_column).cast("bigint") if self.id_column else F.xxhash64(feature_array(), LABEL)
        index = Index(df.select(feature_array().alias("x"), named.alias("id"), F.col(LABEL).alias("label")), self.k)
        return Neighbours(index, int(df.agg(F.max(LABEL)).first()[0]) + 1 if self.classify else None)
