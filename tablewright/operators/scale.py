"""Scaling and shape transforms of numeric columns; fitted values enter the plan as literals."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, functions as F

from tablewright.functions import double_array, normal_quantile, parse_number, ref, yeo_johnson
from tablewright.operators.distribution import describe, moments

METHODS = ("zscore", "zscore_sample", "minmax", "maxabs", "robust")
QUANTILES = 1_000       # fixed value: points of the quantile grid
CLIP = 1e-7             # fixed value: probabilities are kept this far from 0 and 1
POWERS = [p / 2 for p in range(-4, 9)]      # powers tried first, -2 to 4; the range widens while its end is the best
CLOSE = 1e-4                                # powers are refined to steps of this size
AROUND = [k / 4 for k in range(-4, 5)]      # where a refined grid lies, in steps of the one before


@dataclass(frozen=True)
class Scale:
    centre: float
    width: float

    def apply(self, column: Column) -> Column:
        return (column.cast("double") - F.lit(self.centre)) / F.lit(self.width)

    def undo(self, column: Column) -> Column:
        return column * F.lit(self.width) + F.lit(self.centre)


def scale_of(stats: dict, method: str) -> Scale:
    """Centre and width; a width of 0 (or none, on one row) becomes 1."""
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}")
    if not stats["present"] or stats["mean"] is None:
        return Scale(0.0, 1.0)
    if method == "zscore":
        centre, width = stats["mean"], stats["sd"]
    elif method == "zscore_sample":
        centre, width = stats["mean"], stats.get("sd_sample")
    elif method == "minmax":
        centre, width = stats["low"], stats["high"] - stats["low"]
    elif method == "maxabs":
        centre, width = 0.0, max(abs(stats["low"]), abs(stats["high"]))
    else:
        low, centre, high = stats["quantiles"]
        width = high - low
    return Scale(float(centre), float(width) if width and not math.isnan(width) else 1.0)


def fit_scales(df: DataFrame, columns: list[str], method: str = "zscore") -> dict[str, Scale]:
    if method == "robust":
        stats = describe(df, columns, quantiles={c: [0.25, 0.5, 0.75] for c in columns})
    else:
        stats = moments(df, columns)
    return {c: scale_of(stats[c], method) for c in columns}


def apply_scales(df: DataFrame, scales: dict[str, Scale]) -> DataFrame:
    return df.withColumns({c: s.apply(ref(c)) for c, s in scales.items() if c in df.columns})


def normalize(df: DataFrame, columns: list[str], method: str = "zscore",
              fit_on: DataFrame | None = None) -> DataFrame:
    return apply_scales(df, fit_scales(fit_on if fit_on is not None else df, columns, method))


@dataclass(frozen=True)
class QuantileGrid:
    """Distinct grid values with the first and last probability each one stands for."""

    values: list[float]
    first: list[float]
    last: list[float]


def fit_quantile_grids(df: DataFrame, columns: list[str], points: int = QUANTILES) -> dict[str, QuantileGrid]:
    """The exact quantiles of every column on an even grid of at most ``points`` probabilities.

    Infinite values lie outside the grid: they take the outermost places when it is applied.
    """
    df = df.select(*(ref(c) if c not in columns else F.when(F.abs(ref(c).cast("double")) < math.inf, ref(c)).alias(c)
                     for c in df.columns))
    present = moments(df, columns, columns)
    wanted = {}
    for name in columns:
        size = max(2, min(points, present[name]["present"]))
        wanted[name] = [i / (size - 1) for i in range(size)]
    stats = describe(df, columns, quantiles=wanted, known=present)
    grids = {}
    for name in columns:
        first: dict[float, float] = {}
        last: dict[float, float] = {}
        for p, value in zip(wanted[name], stats[name]["quantiles"]):
            if value is not None:
                first.setdefault(value, p)
                last[value] = p
        grids[name] = QuantileGrid(list(first), list(first.values()), list(last.values()))
    return grids


def apply_quantile_grids(df: DataFrame, grids: dict[str, QuantileGrid], shape: str = "normal") -> DataFrame:
    """Map each column to its place in the fitted distribution: uniform on [0, 1], or normal.

    The grid cell is found by binary search; a value on a repeated grid point takes the middle of the
    probabilities it covers, values outside the fitted range take 0 or 1.
    """
    if shape not in ("normal", "uniform"):
        raise ValueError("shape must be 'normal' or 'uniform'")
    names = df.columns
    usable = {c: g for c, g in grids.items() if c in names and g.values}
    searched = {c: f"_{i}" for i, c in enumerate(usable) if len(usable[c].values) > 1}
    if searched:
        df = df.withColumns({f"_x{tag}": ref(c).cast("double") for c, tag in searched.items()})
        df = Bucketizer(inputCols=[f"_x{tag}" for tag in searched.values()], handleInvalid="keep",
                        outputCols=[f"_cell{tag}" for tag in searched.values()],
                        splitsArray=[[-math.inf, *usable[c].values[1:], math.inf] for c in searched]).transform(df)

    # one step per stage of the formula, so that no stage repeats the grid literals of the one before
    found: dict[str, Column] = {}
    for c, tag in searched.items():
        grid, at = usable[c], F.col(f"_cell{tag}").cast("int") + 1
        for part, values, place in (("left", grid.values, at), ("right", grid.values, at + 1),
                                    ("first", grid.first, at), ("low", grid.last, at), ("high", grid.first, at + 1)):
            found[f"_{part}{tag}"] = F.try_element_at(double_array(values), place)
    df = df.withColumns(found) if found else df

    def place_of(name: str) -> Column:
        grid, x = usable[name], ref(name).cast("double")
        if name not in searched:
            inside = F.lit((grid.first[0] + grid.last[0]) / 2)
        else:
            left, right, first, low, high = (F.col(f"_{part}{searched[name]}")
                                             for part in ("left", "right", "first", "low", "high"))
            inside = F.when(x == left, (first + low) / 2).otherwise(low + (x - left) / (right - left) * (high - low))
        uniform = F.when(x < grid.values[0], 0.0).when(x > grid.values[-1], 1.0).otherwise(inside)
        return F.when(x.isNotNull(), uniform)

    df = df.select(*(place_of(c).alias(c) if c in usable else ref(c) for c in names))
    if shape == "uniform":
        return df
    clipped = {c: F.least(F.greatest(ref(c), F.lit(CLIP)), F.lit(1 - CLIP)) for c in usable}
    return df.withColumns(clipped).withColumns({c: normal_quantile(ref(c)) for c in usable}) if usable else df


def reaches(df: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    """The largest log(1 + |x|) of the values from 0 up, and of those below, for each column."""
    wanted = []
    for i, name in enumerate(columns):
        x = parse_number(ref(name))
        size = F.log1p(F.abs(x))
        wanted += [F.max(F.when(x >= 0, size)).alias(f"{i}_up"), F.max(F.when(x < 0, size)).alias(f"{i}_down")]
    row = df.agg(*wanted).first()
    return {name: (row[f"{i}_up"] or 0.0, row[f"{i}_down"] or 0.0) for i, name in enumerate(columns)}


def lowered_power(x: Column, power: float, by: float) -> Column:
    """The Yeo-Johnson transform divided by exp(``by``), without the large numbers in between."""
    size, mirrored, low = F.log1p(F.abs(x)), 2.0 - power, math.exp(-by)
    right = size * low if power == 0 else (F.exp(size * power - by) - low) / power
    left = -size * low if mirrored == 0 else -(F.exp(size * mirrored - by) - low) / mirrored
    return F.when(x >= 0, right).otherwise(left)


def likelihoods(df: DataFrame, grids: dict[str, list[float]], reach: dict[str, tuple[float, float]]) -> dict[str, list[float]]:
    """The Yeo-Johnson likelihood of each column's powers, all in one pass.

    It needs, per power, the variance of the transformed column, and once the sum of the logarithm of the
    Jacobian. The transform is taken over its largest value, so that no power overflows.
    """
    wanted = []
    lowered = {name: [max(0.0, p * reach[name][0], (2 - p) * reach[name][1]) for p in powers] for name, powers in grids.items()}
    for i, (name, powers) in enumerate(grids.items()):
        x = parse_number(ref(name))
        wanted += [F.count(x).alias(f"{i}_n"), F.sum(F.signum(x) * F.log1p(F.abs(x))).alias(f"{i}_log")]
        wanted += [F.var_pop(lowered_power(x, p, lowered[name][j])).alias(f"{i}_{j}") for j, p in enumerate(powers)]
    row = df.agg(*wanted).first()

    def likelihood(i: int, j: int, power: float, by: float) -> float:
        variance = row[f"{i}_{j}"]
        if not variance or not math.isfinite(variance):
            return -math.inf
        return -(row[f"{i}_n"] or 0) / 2 * (math.log(variance) + 2 * by) + (power - 1) * (row[f"{i}_log"] or 0.0)

    return {name: [likelihood(i, j, p, lowered[name][j]) for j, p in enumerate(powers)] for i, (name, powers) in enumerate(grids.items())}


def fit_powers(df: DataFrame, columns: list[str], powers: list[float] = POWERS, close: float = CLOSE) -> dict[str, float]:
    """The Yeo-Johnson power of highest likelihood, to steps of ``close``, for all columns side by side.

    A coarse grid goes on, twice as wide each time, while its end is the best of a column; then the best is
    enclosed by grids a quarter as wide. A pass over the table serves all columns that are still searched.
    """
    reach = reaches(df, columns) if columns else {}
    best = {name: (-math.inf, 1.0) for name in columns}
    steps = dict.fromkeys(columns, max((b - a for a, b in zip(powers, powers[1:])), default=0.0))
    grids = {name: list(powers) for name in columns}
    while grids:
        found, further = likelihoods(df, grids, reach), {}
        for name, tried in grids.items():
            top = max(range(len(tried)), key=found[name].__getitem__)
            if found[name][top] <= best[name][0]:
                continue
            best[name] = (found[name][top], tried[top])
            if len(tried) > 1 and top in (0, len(tried) - 1):
                steps[name] *= 2
                away = steps[name] if top else -steps[name]
                further[name] = sorted(tried[top] + away * k for k in range(1, len(powers)))
        grids = further
    searched = {name for name in columns if best[name][0] > -math.inf and steps[name] > close}
    while searched:
        found = likelihoods(df, {name: [best[name][1] + steps[name] * k for k in AROUND] for name in searched}, reach)
        for name in list(searched):
            top = max(range(len(AROUND)), key=found[name].__getitem__)
            best[name] = (found[name][top], best[name][1] + steps[name] * AROUND[top])
            steps[name] /= 4
            if steps[name] <= close:
                searched.remove(name)
    return {name: power for name, (_, power) in best.items()}


def shaper(source: DataFrame, columns: list[str], method: str = "quantile",
           points: int = QUANTILES) -> Callable[[DataFrame], DataFrame]:
    """Fit a reshaping towards a normal distribution: by quantiles, or by a power and a z-score."""
    if method == "quantile":
        grids = fit_quantile_grids(source, columns, points)
        return lambda df: apply_quantile_grids(df, grids)
    if method != "yeo-johnson":
        raise ValueError("method must be 'quantile' or 'yeo-johnson'")
    powers = fit_powers(source, columns)
    reshape = {c: yeo_johnson(ref(c), powers[c]) for c in columns}
    scales = fit_scales(source.withColumns(reshape), columns)
    return lambda df: apply_scales(df.withColumns(reshape), scales)


def transform_shape(df: DataFrame, columns: list[str], method: str = "quantile",
                    fit_on: DataFrame | None = None, points: int = QUANTILES) -> DataFrame:
    return shaper(fit_on if fit_on is not None else df, columns, method, points)(df)
