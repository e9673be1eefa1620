"""Outlier rows: the isolation forest (Liu, Ting and Zhou, 2008) and the interquartile fence."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import Window

from tablewright.functions import divide, parse_number, ref, round_to
from tablewright.operators.distribution import describe, moments
from tablewright.schema import feature_types
from tablewright.session import settle, ship_package, spread

TREES = 100          # fixed value: trees in a forest
SAMPLE = 256         # fixed value: rows one tree is grown on
SEED = 123           # fixed value: the study's seed
SCORE = "_outlier_score"
TREE_SCHEMA = ("tree int, feature array<int>, threshold array<double>, "
               "left array<int>, right array<int>, length array<double>")


def expected_length(n: float) -> float:
    """The mean path length of an unsuccessful search among n points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + np.euler_gamma) - 2.0 * (n - 1.0) / n


def feature_vector(df: DataFrame, columns: list[str], fills: dict[str, float]) -> Column:
    types = {f.name: f.dataType for f in df.schema.fields}
    return F.array(*(F.coalesce(parse_number(ref(c), types[c]), F.lit(fills[c])) for c in columns))


def category_codes(texts: list[str]) -> Column:
    """A hash for each text column's value, NULL a value like any other."""
    return F.array(*(F.xxhash64(ref(c).cast("string")) for c in texts)).cast("array<bigint>")


def category_places(codes: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """Where a tree sees each category, from 0 to 1: an order of its own, so that a threshold cuts off some set of categories."""
    mixed = codes.astype(np.int64).view(np.uint64) ^ np.uint64((seed * 0x9E3779B97F4A7C15 + (tree + 1) * 0xD1B54A32D192ED03) % (1 << 64))
    for shift, factor in ((32, 0xBF58476D1CE4E5B9), (29, 0x94D049BB133111EB)):
        mixed = (mixed ^ (mixed >> np.uint64(shift))) * np.uint64(factor)
    return (mixed >> np.uint64(11)).astype(np.float64) / float(1 << 53)


def tree_samples(df: DataFrame, vector: Column, codes: Column, key: list[str] | None, rows: int, trees: int,
                 sample: int, seed: int) -> DataFrame:
    """(tree, x, codes): the ``sample`` rows of the smallest hashes of each tree.

    Every tree draws from the whole table on its own. Only rows with a hash small enough to be among the smallest are
    handed on for a tree, about three times the sample; if these were too few, which is next to impossible, all are.
    """
    label = F.xxhash64(F.lit(seed), *(ref(c) for c in key or df.columns))
    marked = df.select(label.alias("_label"), vector.alias("x"), codes.alias("codes"))
    parts = 1 << 40

    def drawn(share: float) -> DataFrame:
        draws = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.struct(
            t.alias("tree"), F.pmod(F.xxhash64(t, F.lit(seed + 1), F.col("_label")), F.lit(parts)).alias("draw")))
        near = F.filter(draws, lambda d: d["draw"] < math.ceil(parts * share))
        pairs = marked.select("x", "codes", "_label", F.explode(near).alias("_draw"))
        nth = F.row_number().over(Window.partitionBy("_draw.tree").orderBy("_draw.draw", "_label", "x", "codes"))
        return pairs.withColumn("_nth", nth).filter(F.col("_nth") <= sample).select("_draw.tree", "x", "codes")

    if rows <= 3 * sample:
        return drawn(1.0)
    found = settle(drawn(3 * sample / rows))
    counts = found.groupBy("tree").count().agg(F.min("count"), F.count(F.lit(1))).first()
    return found if counts[0] == sample and counts[1] == trees else drawn(1.0)


def grow_tree(pdf: pd.DataFrame, seed: int, sample: int) -> pd.DataFrame:
    """Grow one tree on its at most ``sample`` rows, as node arrays with node 0 the root."""
    tree = int(pdf["tree"].iloc[0])
    codes = np.stack(pdf["codes"].to_numpy())
    numbers = np.stack(pdf["x"].to_numpy()).astype(float)
    points = np.hstack((numbers, category_places(codes, tree, seed)))
    points = points[np.lexsort(points.T[::-1])]
    random = np.random.default_rng([seed, tree])
    limit = math.ceil(math.log2(max(2, sample)))
    feature, threshold, left, right, length = [], [], [], [], []

    def node(rows: np.ndarray, depth: int) -> int:
        place = len(feature)
        for column, value in ((feature, -1), (threshold, 0.0), (left, place), (right, place),
                              (length, depth + expected_length(len(rows)))):
            column.append(value)
        low, high = rows.min(axis=0), rows.max(axis=0)
        varying = np.flatnonzero(high > low)
        if depth >= limit or len(rows) <= 1 or not len(varying):
            return place
        feature[place] = int(random.choice(varying))
        threshold[place] = float(random.uniform(low[feature[place]], high[feature[place]]))
        below = rows[:, feature[place]] < threshold[place]
        left[place] = node(rows[below], depth + 1) if below.any() else node(rows[~below], limit)
        right[place] = node(rows[~below], depth + 1)
        return place

    node(points, 0)
    return pd.DataFrame({"tree": [tree], "feature": [feature], "threshold": [threshold],
                         "left": [left], "right": [right], "length": [length]})


def fit_forest(df: DataFrame, columns: list[str], key: list[str] | None = None, trees: int = TREES,
               sample: int = SAMPLE, seed: int = SEED, texts: list[str] = ()) -> tuple[list[dict], dict[str, float]]:
    """The forest (at most trees x 2 sample nodes, whatever the table size) and the mean fills used.

    ``columns`` are read as numbers; ``texts`` are split into sets of categories, in each tree by an order of its own.
    """
    ship_package(df.sparkSession)
    stats = moments(df, columns) if columns else {}
    fills = {c: float(stats[c]["mean"] or 0.0) for c in columns}
    rows = stats[columns[0]]["rows"] if columns else df.count()
    if not rows:
        raise ValueError("the table is empty")
    numbers = feature_vector(df, columns, fills) if columns else F.array().cast("array<double>")
    samples = tree_samples(df, numbers, category_codes(list(texts)), key, rows, trees, sample, seed)

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        return grow_tree(pdf, seed, min(sample, rows))

    forest = samples.groupBy("tree").applyInPandas(grow, TREE_SCHEMA).collect()
    return [r.asDict() for r in sorted(forest, key=lambda r: r["tree"])], fills


def score_rows(df: DataFrame, columns: list[str], forest: list[dict], fills: dict[str, float],
               sample: int, texts: list[str] = (), seed: int = SEED) -> DataFrame:
    """The table with an anomaly score in (0, 1]; higher is more anomalous. Only features go to Python."""
    ship_package(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(
        [(t["tree"], *(np.asarray(t[k]) for k in ("feature", "threshold", "left", "right", "length"))) for t in forest])
    usual, numeric = expected_length(sample) or 1.0, len(columns)

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        trees = shared.value
        for batch in batches:
            columns = (batch,) if isinstance(batch, pd.Series) else batch    # one column comes bare
            numbers = [s.to_numpy(dtype=float) for s in columns[:numeric]]
            codes = [s.to_numpy(dtype=np.int64) for s in columns[numeric:]]
            everyone = np.arange(len(columns[0]))
            total = np.zeros(len(everyone))
            for tree, feature, threshold, left, right, length in trees:
                x = np.column_stack([*numbers, *(category_places(c, tree, seed) for c in codes)])
                at = np.zeros(len(x), dtype=np.int64)
                moving = everyone
                while len(moving):
                    here = at[moving]
                    split = feature[here]
                    inner = split >= 0
                    moving, here, split = moving[inner], here[inner], split[inner]
                    goes_left = x[moving, split] < threshold[here]
                    at[moving] = np.where(goes_left, left[here], right[here])
                total += length[at]
            yield pd.Series(np.power(2.0, -total / len(trees) / usual))

    return spread(df).withColumn(SCORE, score(*(F.coalesce(parse_number(ref(c)), F.lit(fills[c])) for c in columns),
                                              *(F.xxhash64(ref(c).cast("string")) for c in texts)))


def outlier_scores(df: DataFrame, target: str | None = None, key: list[str] | None = None,
                   trees: int = TREES, sample: int = SAMPLE, seed: int = SEED) -> DataFrame:
    """Score every row on its numeric columns and its texts. With ``key``, the same rows give the same forest."""
    numeric, texts = feature_types(df, [*([target] if target else []), *(key or [])])
    if not numeric and not texts:
        raise ValueError("the isolation forest needs a column")
    forest, fills = fit_forest(df, numeric, key, trees, sample, seed, texts)
    return score_rows(df, numeric, forest, fills, sample, texts, seed)


def score_cuts(scored: DataFrame, thresholds: list[float]) -> dict[float, float]:
    """The exact score above which the given fraction of rows lies (ties stay in the table)."""
    stats = describe(scored, [SCORE], quantiles={SCORE: [1.0 - t for t in thresholds]})
    return dict(zip(thresholds, stats[SCORE]["quantiles"]))


def remove_outliers(df: DataFrame, threshold: float = 0.05, target: str | None = None,
                    key: list[str] | None = None, **forest) -> DataFrame:
    """The table without its ``threshold`` most anomalous share of rows."""
    if not 0 < threshold < 0.5:
        raise ValueError("threshold must lie between 0 and 0.5")
    scored = settle(outlier_scores(df, target, key, **forest))
    cut = score_cuts(scored, [threshold])[threshold]
    return scored.filter(F.col(SCORE) <= cut).drop(SCORE)


def sweep_outliers(df: DataFrame, thresholds: list[float], target: str | None = None,
                   key: list[str] | None = None, **forest) -> dict[float, DataFrame]:
    """One table per threshold from a single scoring."""
    scored = settle(outlier_scores(df, target, key, **forest))
    cuts = score_cuts(scored, thresholds)
    return {t: scored.filter(F.col(SCORE) <= cuts[t]).drop(SCORE) for t in thresholds}


def outlier_report(df: DataFrame, thresholds: list[float], target: str | None = None,
                   key: list[str] | None = None, **forest) -> DataFrame:
    """(threshold, removed_rows, total_rows, percent_removed) for each threshold."""
    scored = settle(outlier_scores(df, target, key, **forest))
    cuts = score_cuts(scored, thresholds)
    counted = scored.agg(F.count(F.lit(1)).alias("total_rows"),
                         *(F.count_if(F.col(SCORE) > cuts[t]).alias(f"removed_{i}")
                           for i, t in enumerate(thresholds)))
    rows = F.explode(F.array(*(F.struct(F.lit(float(t)).alias("threshold"), F.col(f"removed_{i}").alias("removed_rows"))
                               for i, t in enumerate(thresholds)))).alias("r")
    return counted.select(rows, "total_rows").select(
        "r.threshold", "r.removed_rows", "total_rows",
        round_to(divide(100.0 * F.col("r.removed_rows"), F.col("total_rows")), 2).alias("percent_removed"))


def iqr_filter(df: DataFrame, columns: list[str], reach: float = 1.5) -> DataFrame:
    """Rows whose values lie within ``reach`` interquartile ranges of the quartiles; NULLs stay."""
    stats = describe(df, columns, quantiles={c: [0.25, 0.75] for c in columns})

    def inside(name: str) -> Column:
        low, high = stats[name]["quantiles"]
        if low is None:
            return F.lit(True)
        width = high - low
        return ref(name).isNull() | ref(name).between(low - reach * width, high + reach * width)

    return df.filter(reduce(lambda a, b: a & b, map(inside, columns)))
