"""Model-based imputation: columns are predicted from each other in rounds.

Gaps start from the mean or the mode. A round then takes the columns with gaps, fewest first, fits
models on the rows where the column is known, and rewrites only its gaps. The fitted models are kept, by
round and column, and fill the gaps of further tables the same way. Each round ends on a settled table, and
the one before is deleted, so a plan holds one round and the folder one table whatever their number.

Numbers are predicted by boosted trees, texts of few values by a forest. A text of more than ``many`` values, however many, is
predicted from counts: of its values in each bin of every other column, kept as tables with the pairs that occur.
Such a text is counted once, for its codes and its mode; while a table is learnt from, known texts are carried along, so that
only gaps are joined with tables of values.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.ml import Model
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, functions as F

from tablewright.functions import ref
from tablewright.models.ensembles import GBTRegressor, RandomForestClassifier
from tablewright.operators.distribution import describe
from tablewright.operators.encode import LabelCodes, code_columns, fit_labels
from tablewright.operators.impute import fill_missing, fit_fills
from tablewright.schema import feature_types
from tablewright.session import Generations, settle

ROUNDS = 20     # fixed value: rounds of the study's imputer
SEED = 123
MANY = 1_000    # values of a text above which no forest is grown for it
BINS = 20       # quantile bins of a numeric column that counts are taken in


class Commonest:
    """For each bin of one other column the commonest value there, the smallest code on ties; elsewhere the commonest of all.

    The column is the one whose bins get most of the known rows right, the first on ties. Bins and values are joined as tables.
    """

    def __init__(self, column: str, edges: list[float] | None, picks: DataFrame, default: float):
        self.column, self.edges, self.picks, self.default = column, edges, picks, default

    @staticmethod
    def bin_of(column: str, edges: list[float] | None) -> Column:
        """The code of a text, the number of bounds below a number."""
        return F.col(column) if edges is None else sum(((F.col(column) > e).cast("double") for e in edges), F.lit(0.0))

    @classmethod
    def fit(cls, known: DataFrame, target: str, inputs: list[str], numeric: list[str], default: float) -> Commonest:
        """``default`` is the commonest value of all, the smallest code on ties."""
        cuts = known.approxQuantile(numeric, [n / BINS for n in range(1, BINS)], 0.001) if numeric else []
        edges = dict(zip(numeric, map(sorted, map(set, cuts))))
        bins = F.array(*(F.struct(F.lit(n).alias("input"), cls.bin_of(c, edges.get(c)).alias("bin")) for n, c in enumerate(inputs)))
        counts = known.select(F.col(target).alias("value"), F.explode(bins).alias("_in")).groupBy("_in.input", "_in.bin", "value").count()
        rank = F.struct(F.col("count"), -F.col("value"))
        best = settle(counts.groupBy("input", "bin").agg(F.max_by("value", rank).alias("_pick"), F.max("count").alias("right")))
        right = {r["input"]: r["right"] for r in best.groupBy("input").agg(F.sum("right").alias("right")).collect()}
        top = min(right, key=lambda n: (-right[n], n))
        return cls(inputs[top], edges.get(inputs[top]), best.filter(F.col("input") == top).select(F.col("bin").alias("_bin"), "_pick"), default)

    def transform(self, df: DataFrame) -> DataFrame:
        joined = df.join(self.picks, self.bin_of(self.column, self.edges) == F.col("_bin"), "left")
        return joined.withColumn("_said", F.coalesce("_pick", F.lit(self.default))).drop("_bin", "_pick")


@dataclass
class FittedImputer:
    """Start values, codes, the codes of the commonest of tabled values, and the models of each round in their order."""

    columns: list[str]
    numeric: list[str]
    fills: dict[str, object]
    codes: LabelCodes
    order: list[str] = field(default_factory=list)
    modes: dict[str, float] = field(default_factory=dict)
    rounds: list[list[Model | Commonest]] = field(default_factory=list)

    @property
    def place(self) -> dict[str, str]:
        return {c: f"_c{i}" for i, c in enumerate(self.columns)}

    def text(self, name: str) -> str:
        return f"_text{self.place[name]}"

    def begin(self, df: DataFrame, carry: bool = False) -> DataFrame:
        """Coded columns as doubles with start values in the gaps, which are marked. ``carry`` keeps tabled texts as they are beside
        their codes: right where every text is known, as in the table learnt from."""
        place, text = self.place, [c for c in self.columns if c not in self.numeric]
        marked = df.select("*", *(ref(c).isNull().alias(f"_gap{place[c]}") for c in self.columns))
        codes = LabelCodes(*({place[c]: found[c] for c in text if c in found} for found in (self.codes.listed, self.codes.tabled, self.codes.sizes)))
        coded, found = code_columns(fill_missing(marked, self.fills).select(
            *(ref(c).alias(place[c]) if c in place else ref(c) for c in df.columns),
            *(F.col(f"_gap{place[c]}") for c in self.columns)), codes)
        cells = {place[c]: F.coalesce(found[place[c]], F.lit(0)) if place[c] in found else F.col(place[c]) for c in self.columns}
        names = [place.get(c, c) for c in df.columns]
        return coded.select(*(cells[c].cast("double").alias(c) if c in cells else ref(c) for c in names),
                            *(F.col(f"_gap{place[c]}") for c in self.columns),
                            *(F.col(place[c]).alias(self.text(c)) for c in (self.codes.tabled if carry else ())))

    def inputs(self, name: str) -> list[str]:
        return [self.place[c] for c in self.columns if c != name]

    def predicted(self, state: DataFrame, name: str, model: Model | Commonest, settled: bool = False) -> DataFrame:
        """``state`` with the gaps of one column rewritten by its model. Of a settled table only the gaps are joined with counts."""
        column, known = self.place[name], None
        gap = F.col(f"_gap{column}")
        rows = state
        if settled and isinstance(model, Commonest):
            rows, known = state.filter(gap), state.filter(~gap)
        said = model.transform(VectorAssembler(inputCols=self.inputs(name), outputCol="_inputs").transform(rows))
        made = said.withColumn(column, F.when(gap, F.col("_said")).otherwise(F.col(column))).select(*state.columns)
        return made.unionByName(known) if known is not None else made

    def restore(self, state: DataFrame, like: DataFrame) -> DataFrame:
        """The columns of ``like`` under their names; known values, codes and types as they were."""
        types, place = {f.name: f.dataType for f in like.schema.fields}, self.place
        carried = [c for c in self.codes.tabled if self.text(c) in state.columns]
        missing = [c for c in self.codes.tabled if c not in carried or c in self.order]
        whole = None
        if missing and len(carried) == len(self.codes.tabled):
            gap = reduce(lambda a, b: a | b, (F.col(f"_gap{place[c]}") for c in missing))
            whole, state = state.filter(~gap), state.filter(gap)
        for n, name in enumerate(missing):
            values = self.codes.tabled[name].select(F.col("code").cast("double").alias(f"_of{n}"), F.col("value").cast(types[name]).alias(f"_found{n}"))
            joined = state.join(values, F.col(place[name]) == F.col(f"_of{n}"), "left")
            found = F.col(f"_found{n}")
            if name in carried:
                found = F.when(F.col(f"_gap{place[name]}"), found).otherwise(F.col(self.text(name)))
            state = joined.withColumn(self.text(name), found).drop(f"_of{n}", f"_found{n}")
        if whole is not None:
            state = state.unionByName(whole)

        def restored(name: str):
            if name not in place:
                return ref(name)
            value = F.col(place[name])
            if name in self.codes.tabled:
                value = F.col(self.text(name))
            elif name not in self.numeric:
                value = F.get(F.lit(self.codes.listed[name]), value.cast("int")).cast(types[name])
            elif name not in self.order:
                value = value.cast(types[name])
            return value.alias(name)

        return state.select(*(restored(c) for c in like.columns))

    def transform(self, df: DataFrame) -> DataFrame:
        """A further table without gaps in the fitted columns. A text that was never seen counts as the first."""
        state, kept = self.begin(df), Generations(df.sparkSession)
        for models in self.rounds:
            for name, model in zip(self.order, models):
                state = self.predicted(state, name, model)
            state = kept.settle(state)
        return self.restore(state, df)


def fit_iterative(df: DataFrame, target: str | None = None, keep: list[str] = (), rounds: int = ROUNDS,
                  trees: int = 10, depth: int = 4, seed: int = SEED, many: int = MANY) -> tuple[FittedImputer, DataFrame]:
    """The imputer learnt from ``df``, and ``df`` without gaps. Columns without any value stay as they are."""
    numeric, text = feature_types(df, [*keep, *([target] if target else [])])
    if not numeric + text:
        return FittedImputer([], [], {}, LabelCodes()), df
    stats = describe(df, numeric + text, modes=text, values=text, tabled_modes=False)
    gaps = df.agg(*(F.count_if(ref(c).isNull()).alias(f"g{i}") for i, c in enumerate(numeric))).first() if numeric else ()
    counts = {**dict(zip(numeric, gaps)), **{c: stats[c]["rows"] - stats[c]["present"] for c in text}}
    text = [c for c in text if stats[c]["present"]]
    codes = fit_labels(df, text, stats) if text else LabelCodes()
    modes = {}
    for name, table in codes.tabled.items():
        best = table.agg(F.min_by(F.struct("value", "code"), F.struct(-F.col("n"), F.col("value"))).alias("best")).first()["best"]
        stats[name]["mode"], modes[name] = best["value"], float(best["code"])
    fills = fit_fills(df, columns=numeric + text, stats=stats)
    columns = [c for c in numeric + text if c in fills and counts[c] < stats[c]["rows"]]
    imputer = FittedImputer(columns, [c for c in numeric if c in columns], {c: fills[c] for c in columns}, codes,
                            sorted((c for c in columns if counts[c]), key=lambda c: counts[c]), modes)
    if not imputer.order:
        return imputer, df
    if len(columns) < 2:
        return imputer, imputer.restore(imputer.begin(df), df)
    kept = Generations(df.sparkSession)
    state = kept.settle(imputer.begin(df, carry=True))
    for number in range(rounds):
        models = []
        for name in imputer.order:
            settled = not models
            known = state.filter(~F.col(f"_gap{imputer.place[name]}"))
            if name in text and codes.sizes[name] > many:
                default = modes[name] if name in modes else float(codes.listed[name].index(fills[name]))
                model = Commonest.fit(known, imputer.place[name], imputer.inputs(name), [imputer.place[c] for c in imputer.numeric if c != name], default)
                models.append(model)
                state = imputer.predicted(state, name, model, settled)
                continue
            known = VectorAssembler(inputCols=imputer.inputs(name), outputCol="_inputs").transform(known)
            settings = dict(featuresCol="_inputs", labelCol=imputer.place[name], predictionCol="_said", seed=seed + number)
            if name in imputer.numeric:
                model = GBTRegressor(maxIter=trees, maxDepth=depth, **settings).fit(known)
            else:
                model = RandomForestClassifier(numTrees=trees, maxDepth=depth, **settings).fit(known)
            models.append(model)
            state = imputer.predicted(state, name, model)
        imputer.rounds.append(models)
        state = kept.settle(state)
    return imputer, imputer.restore(state, df)


def impute_iterative(df: DataFrame, target: str | None = None, keep: list[str] = (), rounds: int = ROUNDS,
                     trees: int = 10, depth: int = 4, seed: int = SEED, many: int = MANY) -> DataFrame:
    """The table without gaps in its features; known cells, the target and kept columns are untouched."""
    return fit_iterative(df, target, keep, rounds, trees, depth, seed, many)[1]
