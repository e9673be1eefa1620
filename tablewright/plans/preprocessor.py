"""Fit on a training table, apply to any table: fill, encode, scale, type, gate."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tablewright.functions import parse_number, ref
from tablewright.operators.clean import align_features, nan_gate
from tablewright.operators.distribution import describe, moments
from tablewright.operators.encode import LabelCodes, apply_labels, fit_labels
from tablewright.operators.impute import describe_for_fills, fill_missing, fit_median_mode
from tablewright.operators.scale import Scale, apply_scales, scale_of
from tablewright.schema import (CLASSIFICATION, as_supported, check_task, is_number, require_features, require_rows,
                                require_target)
from tablewright.sources.store import read_state, write_state


def plain_booleans(df: DataFrame) -> DataFrame:
    """Booleans as the texts False and True."""
    flags = [f.name for f in df.schema.fields if isinstance(f.dataType, T.BooleanType)]
    return df.withColumns({c: F.when(ref(c), "True").when(~ref(c), "False") for c in flags}) if flags else df


@dataclass
class FittedPreprocessor:
    """What was learned on the training table; ``transform`` is a projection (long code lists join)."""

    task: str
    target: str
    unseen: str
    features: list[str]
    fills: dict[str, object]
    labels: LabelCodes
    scales: dict[str, Scale]
    target_labels: LabelCodes | None = None
    target_fill: float | None = None
    keep: list[str] = field(default_factory=list)

    def fill(self, df: DataFrame) -> DataFrame:
        """Aligned and filled features, with the kept columns and the target."""
        require_target(df, self.target)
        aligned = align_features(plain_booleans(as_supported(df)), self.features, [*self.keep, self.target])
        return fill_missing(aligned, self.fills)

    def encode(self, df: DataFrame) -> DataFrame:
        """Filled features as numbers."""
        if self.task == CLASSIFICATION:
            return apply_labels(df, self.labels, self.unseen)
        coded = apply_labels(df, self.labels, self.unseen) if self.labels.columns else df
        plain = [c for c in self.features if c not in self.labels.columns]
        spare = {c: self.fills.get(c) for c in plain}
        types = {f.name: f.dataType for f in coded.schema.fields}
        return coded.withColumns({c: F.coalesce(parse_number(ref(c), types[c]), F.lit(
            float(spare[c]) if isinstance(spare[c], (int, float)) else 0.0)) for c in plain})

    def encode_target(self, df: DataFrame) -> DataFrame:
        name = self.target
        if self.task == CLASSIFICATION:
            if self.target_labels is None:
                return df
            return apply_labels(df, self.target_labels, "row_zero" if self.unseen == "keep" else self.unseen)
        fill = self.target_fill
        if fill is None:
            fill = describe(df, [name], quantiles={name: [0.5]})[name]["quantiles"][0]
        return df.withColumn(name, F.coalesce(parse_number(ref(name), df.schema[name].dataType), F.lit(0.0 if fill is None else float(fill))))

    def transform(self, df: DataFrame, gate: bool = False) -> DataFrame:
        """Kept columns, float features, typed target. ``gate`` checks for missing values left over."""
        encoded = self.encode_target(self.encode(self.fill(df)))
        scaled = apply_scales(encoded, self.scales)
        kind = "bigint" if self.task == CLASSIFICATION else "float"
        typed = scaled.select(*(ref(c) for c in self.keep), *(ref(c).cast("float").alias(c) for c in self.features),
                              ref(self.target).cast(kind).alias(self.target))
        return nan_gate(typed, [*self.features, self.target]) if gate else typed

    def save(self, spark: SparkSession, path: str) -> None:
        """State as Parquet; long code lists as Parquet tables beside it."""
        whole = {"task": self.task, "target": self.target, "unseen": self.unseen, "features": self.features,
                 "keep": self.keep, "target_fill": self.target_fill, "fill_values": self.fills,
                 "coded_target": self.target_labels is not None}
        state = {"whole": whole, "scale": {c: [s.centre, s.width] for c, s in self.scales.items()}}
        for part, labels in (("label", self.labels), ("target_label", self.target_labels)):
            if labels is not None:
                state[part] = dict(labels.listed)
                state[f"{part}_size"] = dict(labels.sizes)
                for i, (name, table) in enumerate(labels.tabled.items()):
                    table.write.mode("overwrite").parquet(f"{path}/{part}_{i}")
                    state.setdefault(f"{part}_table", {})[name] = f"{part}_{i}"
        write_state(spark, state, f"{path}/state")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> FittedPreprocessor:
        state = read_state(spark, f"{path}/state")
        whole = state["whole"]

        def labels(part: str) -> LabelCodes:
            tabled = {n: spark.read.parquet(f"{path}/{p}") for n, p in state.get(f"{part}_table", {}).items()}
            return LabelCodes(state.get(part, {}), tabled, state.get(f"{part}_size", {}))

        return cls(whole["task"], whole["target"], whole["unseen"], whole["features"], whole["fill_values"],
                   labels("label"), {c: Scale(*s) for c, s in state.get("scale", {}).items()},
                   labels("target_label") if whole["coded_target"] else None, whole["target_fill"], whole["keep"])


@dataclass
class TablePreprocessor:
    """Settings of the preparation.

    The defaults avoid the study's known defects; ``numeric_rule='any'`` and ``fill_new_target=True``
    with ``unseen='column_zero'`` repeat it exactly. ``keep`` names columns (a row key) to pass through.
    """

    task: str = CLASSIFICATION
    numeric_rule: str = "all"
    unseen: str = "column_zero"
    encode_strings: bool = False
    fill_new_target: bool = False
    keep: list[str] = field(default_factory=list)

    def __post_init__(self) -> None:
        check_task(self.task)

    def fit(self, df: DataFrame, target: str) -> FittedPreprocessor:
        require_features(df.drop(*self.keep), target)
        data = plain_booleans(as_supported(df.drop(*self.keep)))
        flags = {f.name for f in df.schema.fields if isinstance(f.dataType, T.BooleanType)}
        features = [c for c in data.columns if c != target]
        types = {f.name: f.dataType for f in data.schema.fields}
        text = [c for c in features if not is_number(types[c])]
        classes = self.task == CLASSIFICATION
        coded = text if classes or self.encode_strings else []
        text_target = classes and not is_number(types[target])
        stats = describe_for_fills(data, [*features, target], values=[*coded, *([target] if text_target else [])])
        require_rows(stats[target]["rows"])
        fills = fit_median_mode(data, features, self.numeric_rule, stats)
        if self.numeric_rule == "any":
            fills.update(self.fill_flags(df, [c for c in features if c in flags and stats[c]["present"]]))
        if not classes and self.encode_strings:
            coded = [c for c in text if stats[c]["parsed"] < stats[c]["present"]]
        gaps = {c: fills[c] if isinstance(fills[c], str) else repr(fills[c])
                for c in coded if stats[c]["present"] < stats[c]["rows"]}
        fitted = FittedPreprocessor(self.task, target, self.unseen, features, fills,
                                    fit_labels(data, coded, stats, gaps), {}, keep=list(self.keep))
        if text_target:
            fitted.target_labels = fit_labels(data, [target], stats)
        elif not classes and not self.fill_new_target:
            middle = stats[target]["quantiles"][0]
            fitted.target_fill = 0.0 if middle is None else float(middle)
        if not classes:
            fitted.fills.update(self.residual_fills(fitted.fill(df), [c for c in features if c not in coded]))
        # every text is known on the training table, so the encoding needs no check for unseen ones
        training = FittedPreprocessor(**{**fitted.__dict__, "unseen": "row_zero"})
        found = moments(training.encode(fitted.fill(df)), features)
        method = "zscore_sample" if classes else "zscore"
        fitted.scales = {c: scale_of(found[c], method) for c in features}
        return fitted

    @staticmethod
    def fill_flags(df: DataFrame, flags: list[str]) -> dict[str, float]:
        if not flags:
            return {}
        stats = describe(df, flags, quantiles={c: [0.5] for c in flags})
        return {c: stats[c]["quantiles"][0] for c in flags}

    @staticmethod
    def residual_fills(filled: DataFrame, columns: list[str]) -> dict[str, object]:
        """Text columns that still hold unparsable cells get the median of what parses, else 0."""
        text = [f.name for f in filled.schema.fields if f.name in columns and not is_number(f.dataType)]
        if not text:
            return {}
        stats = describe(filled, text, quantiles={c: [0.5] for c in text})
        middle = {c: stats[c]["quantiles"][0] for c in text}
        return {c: 0.0 if m is None or math.isnan(m) else m for c, m in middle.items()}
