"""The numbered data-quality variants of a train/test pair.

A variant is a step that learns from one table and gives a ``DataFrame -> DataFrame`` function. Every variant starts from the
cleaned table. ``fit_on='train'`` fits on the training table and applies to both; ``'each'`` lets
train and test be prepared from their own statistics, as the study did.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from functools import cached_property, reduce

from pyspark.sql import DataFrame, functions as F

from tablewright.operators.clean import clean_sentinels, count_missing, drop_ignored, drop_null_rows
from tablewright.operators.impute import imputer
from tablewright.operators.outliers import SAMPLE, SCORE, SEED, TREES, fit_forest, score_cuts, score_rows
from tablewright.operators.scale import apply_scales, fit_scales, shaper
from tablewright.schema import check_task, feature_types, require_target
from tablewright.session import settle, settle_for_training
from tablewright.sources.pairs import TablePair
from tablewright.sources.store import write_scenario

# Outlier shares of the sweep and of the composite variant.
SWEEP = (0.01, 0.03, 0.05)
COMPOSITE_SHARE = 0.03


@dataclass(frozen=True)
class ScenarioSettings:
    task: str
    target: str
    key: list[str] = field(default_factory=list)
    fit_on: str = "train"
    scale_target: bool = False
    trees: int = TREES
    sample: int = SAMPLE
    seed: int = SEED

    def __post_init__(self) -> None:
        check_task(self.task)
        if self.fit_on not in ("train", "each"):
            raise ValueError("fit_on must be 'train' or 'each'")

    def numeric(self, df: DataFrame) -> list[str]:
        """The columns a scenario rescales: numeric features, and the target on request."""
        return feature_types(df, [*self.key, *([] if self.scale_target else [self.target])])[0]


Change = Callable[[DataFrame], DataFrame]


class Fitting:
    """What the variants learn from one table; parts that several variants share are fitted once."""

    def __init__(self, source: DataFrame, how: ScenarioSettings):
        self.source, self.how = source, how

    def imputer(self, way: str) -> Change:
        return imputer(self.source, way, task=self.how.task, target=self.how.target, keep=self.how.key)

    @cached_property
    def mean_filler(self) -> Change:
        return self.imputer("mean")

    @cached_property
    def filled(self) -> DataFrame:
        return self.mean_filler(self.source)

    @cached_property
    def scorer(self) -> Change:
        """Mean filling, then an anomaly score from a forest grown on the filled source."""
        how, (columns, texts) = self.how, feature_types(self.filled, [self.how.target, *self.how.key])
        forest, fills = fit_forest(self.filled, columns, list(how.key) or None, how.trees, how.sample, how.seed, texts)
        return lambda df: score_rows(self.mean_filler(df), columns, forest, fills, how.sample, texts, how.seed)

    @cached_property
    def scored(self) -> DataFrame:
        """The scored source, written once: its cuts and every share read the same rows."""
        return settle(self.scorer(self.source))

    @cached_property
    def cuts(self) -> dict[float, float]:
        return score_cuts(self.scored, sorted({*SWEEP, COMPOSITE_SHARE}))

    def without_outliers(self, share: float) -> Change:
        cut = self.cuts[share] if share in self.cuts else score_cuts(self.scored, [share])[share]

        def change(df: DataFrame) -> DataFrame:
            scored = self.scored if df is self.source else self.scorer(df)
            return scored.filter(F.col(SCORE) <= cut).drop(SCORE)

        return change


Step = Callable[[Fitting], Change]


def null_free(fit: Fitting) -> Change:
    return lambda df: drop_null_rows(drop_ignored(df, fit.how.task), fit.how.target)


def imputed(way: str) -> Step:
    return lambda fit: fit.mean_filler if way == "mean" else fit.imputer(way)


def no_outliers(share: float) -> Step:
    return lambda fit: fit.without_outliers(share)


def normalized(fit: Fitting) -> Change:
    scales = fit_scales(fit.filled, fit.how.numeric(fit.filled))
    return lambda df: apply_scales(fit.mean_filler(df), scales)


def transformed(fit: Fitting) -> Change:
    reshape = shaper(fit.filled, fit.how.numeric(fit.filled))
    return lambda df: reshape(fit.mean_filler(df))


def composite(fit: Fitting) -> Change:
    """Mean filling, outlier removal, z-score, quantile transform, each fitted on the step before."""
    thin = fit.without_outliers(COMPOSITE_SHARE)
    source = thin(fit.source)
    columns = fit.how.numeric(source)
    scales = fit_scales(source, columns)
    reshape = shaper(apply_scales(source, scales), columns)
    return lambda df: reshape(apply_scales(thin(df), scales))


def plain(change: Change) -> Step:
    """A variant that learns nothing: any function from table to table."""
    return lambda fit: change


# Variant names in order.
STEPS: dict[str, Step] = {
    "01_without_NaN": null_free,
    "02_imputed_mean": imputed("mean"),
    "03_imputed_mode": imputed("mode"),
    "04_imputed_median": imputed("median"),
    "05_no_outliers_0.01": no_outliers(0.01),
    "05_no_outliers_0.03": no_outliers(0.03),
    "05_no_outliers_0.05": no_outliers(0.05),
    "06_normalized": normalized,
    "07_transformed": transformed,
    "08_normalized_transformed": composite,
}
ONLY_WITH_GAPS = ("02_imputed_mean", "03_imputed_mode", "04_imputed_median")


def fittings(pair: TablePair, how: ScenarioSettings) -> tuple[Fitting, Fitting]:
    """What train and test learn from: the same under ``fit_on='train'``."""
    train = Fitting(pair.train, how)
    return train, train if how.fit_on == "train" else Fitting(pair.test, how)


def prepare(pair: TablePair, name: str, how: ScenarioSettings, steps: dict[str, Step] = STEPS,
            fits: tuple[Fitting, Fitting] | None = None) -> TablePair:
    """One variant of the pair."""
    on_train, on_test = fits or fittings(pair, how)
    change = steps[name](on_train)
    other = change if on_test is on_train else steps[name](on_test)
    return TablePair(change(pair.train), other(pair.test))


def clean_pair(pair: TablePair, target: str) -> TablePair:
    require_target(pair.train, target)
    require_target(pair.test, target)
    return pair.map(clean_sentinels)


def has_gaps(train: DataFrame, how: ScenarioSettings) -> bool:
    """Whether dropping incomplete rows changes the training table."""
    table = drop_ignored(train, how.task)
    numeric, text = feature_types(table, how.target)
    return bool(count_missing(table, numeric + text).first()["missing_rows"])


def scenario_names(pair: TablePair, how: ScenarioSettings, steps: dict[str, Step] = STEPS) -> list[str]:
    """The variants to build: those that only fill gaps are skipped when there are none."""
    gaps = has_gaps(pair.train, how)
    return [name for name in steps if gaps or name not in ONLY_WITH_GAPS]


def scenario_matrix(pair: TablePair, how: ScenarioSettings,
                    steps: dict[str, Step] = STEPS) -> Iterator[tuple[str, TablePair]]:
    """(name, prepared pair) for each variant, over shared fits.

    Every variant reads the pair, most of them several times: it is written once, so that what it is made of, a join that
    goes through the driver perhaps, is not made again for each. It is written over all cores: a forest's or a network's rows
    are few bytes and much work.
    """
    pair = pair.map(settle_for_training)
    fits = fittings(pair, how)
    for name in scenario_names(pair, how, steps):
        yield name, prepare(pair, name, how, steps, fits)


def tagged(variants: Iterable[tuple[str, TablePair]], columns: list[tuple[str, str]]) -> DataFrame:
    """All variants in one table with ``scenario`` and ``split``, over the given (column, type) pairs."""
    parts = [table.select(F.lit(name).alias("scenario"), F.lit(split).alias("split"),
                          *(F.col(c).cast(kind).alias(c) for c, kind in columns))
             for name, pair in variants for split, table in (("train", pair.train), ("test", pair.test))]
    return reduce(DataFrame.unionByName, parts)


def write_matrix(pair: TablePair, how: ScenarioSettings, root: str, steps: dict[str, Step] = STEPS) -> list[str]:
    """Clean the pair, write every variant as a partition of the store, and name what was written."""
    written = []
    for name, prepared in scenario_matrix(clean_pair(pair, how.target), how, steps):
        write_scenario(prepared.train, root, name, "train", how.key)
        write_scenario(prepared.test, root, name, "test", how.key)
        written.append(name)
    return written
