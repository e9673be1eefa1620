"""Label and one-hot encoding.

A short value list (checked against ``LISTED_VALUES``) is applied as a projection; a long one stays a
table of codes and is joined, which Spark sorts or broadcasts by its measured size.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml.feature import StringIndexerModel
from pyspark.sql import Column, DataFrame, functions as F

from tablewright.functions import ref
from tablewright.operators.distribution import describe, value_codes
from tablewright.session import settle

UNSEEN_RULES = ("column_zero", "row_zero", "keep")


@dataclass
class LabelCodes:
    """Codes 0, 1, ... in sorted value order, per column."""

    listed: dict[str, list[str]] = field(default_factory=dict)
    tabled: dict[str, DataFrame] = field(default_factory=dict)
    sizes: dict[str, int] = field(default_factory=dict)

    @property
    def columns(self) -> list[str]:
        return [*self.listed, *self.tabled]


def fit_labels(df: DataFrame, columns: list[str], stats: dict[str, dict] | None = None,
               also: dict[str, str] | None = None) -> LabelCodes:
    """Learn the codes; ``also`` adds one value per column (a fill value that may not occur yet)."""
    stats = stats or describe(df, columns, values=columns)
    codes = LabelCodes()
    for name in columns:
        extra = (also or {}).get(name)
        listed = stats[name].get("values")
        if listed is None and stats[name]["present"]:
            source = df.select(ref(name).cast("string").alias(name))
            if extra is not None:
                source = source.select(F.coalesce(ref(name), F.lit(extra)).alias(name))
            table = settle(value_codes(source, name, stats[name].get("distinct")))
            codes.tabled[name], codes.sizes[name] = table, table.count()
        else:
            known = set(listed or ()) | ({extra} if extra is not None else set())
            codes.listed[name] = sorted(known, key=lambda v: v.encode())
            codes.sizes[name] = len(known)
    return codes


def code_columns(df: DataFrame, codes: LabelCodes) -> tuple[DataFrame, dict[str, Column]]:
    """The table with raw code columns attached, and each column's code (NULL when unseen)."""
    found: dict[str, Column] = {}
    listed = [c for c in codes.listed if c in df.columns]
    texts = {c: f"_text_{i}" for i, c in enumerate(listed)}
    known = [c for c in listed if codes.listed[c]]
    df = df.withColumns({texts[c]: ref(c).cast("string") for c in known}) if known else df
    if known:
        model = StringIndexerModel.from_arrays_of_labels(
            [codes.listed[c] for c in known], [texts[c] for c in known],
            [f"_code{texts[c]}" for c in known], handleInvalid="keep")
        df = model.transform(df)
    for name in listed:
        if name in known:
            code = F.col(f"_code{texts[name]}")
            found[name] = F.when(code < len(codes.listed[name]), code.cast("bigint"))
        else:
            found[name] = F.lit(None).cast("bigint")
    for i, (name, table) in enumerate(codes.tabled.items()):
        if name in df.columns:
            right = table.select(F.col("value").alias(f"_value_{i}"), F.col("code").alias(f"_joined_{i}"))
            df = df.join(right, ref(name).cast("string") == F.col(f"_value_{i}"), "left")
            found[name] = F.col(f"_joined_{i}")
    return df, found


def apply_labels(df: DataFrame, codes: LabelCodes, unseen: str = "column_zero") -> DataFrame:
    """Replace texts by codes. One unseen text sets its whole column to 0 under ``column_zero``, only
    its own row under ``row_zero``, and gets the next free code under ``keep``."""
    if unseen not in UNSEEN_RULES:
        raise ValueError(f"unseen must be one of {UNSEEN_RULES}")
    names = df.columns
    coded, found = code_columns(df, codes)
    if not found:
        return df
    spoiled: dict[str, bool] = {}
    if unseen == "column_zero":
        order = list(found)
        flags = coded.agg(*(F.max(found[c].isNull()).alias(f"f{i}") for i, c in enumerate(order))).first()
        spoiled = {c: bool(flags[f"f{i}"]) for i, c in enumerate(order)}

    def final(name: str) -> Column:
        if name not in found:
            return ref(name)
        if spoiled.get(name):
            return F.lit(0).cast("bigint").alias(name)
        spare = codes.sizes[name] if unseen == "keep" else 0
        return F.coalesce(found[name], F.lit(spare).cast("bigint")).alias(name)

    return coded.select(*(final(c) for c in names))


def label_encode(df: DataFrame, columns: list[str]) -> DataFrame:
    """Fit and apply on the same table: every present text is known, NULL stays NULL."""
    coded, found = code_columns(df, fit_labels(df, columns))
    return coded.select(*(found[c].alias(c) if c in found else ref(c) for c in df.columns))


def one_hot(df: DataFrame, columns: list[str], codes: LabelCodes | None = None) -> DataFrame:
    """One 0/1 column per listed value, named column_value; a NULL or unseen text gives all zeros."""
    codes = codes or fit_labels(df, columns)
    if codes.tabled:
        raise ValueError(f"too many values for one-hot columns: {', '.join(codes.tabled)}")
    flags = [F.coalesce((ref(c).cast("string") == F.lit(v)).cast("int"), F.lit(0)).alias(f"{c}_{v}")
             for c in columns for v in codes.listed[c]]
    return df.select(*(ref(c) for c in df.columns if c not in columns), *flags)
