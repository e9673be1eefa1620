"""Queries on what models learn: splits, leaf values and weights, each against its closed form in SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import StandardScaler
from pyspark.sql import DataFrame, SparkSession, functions as F

from tablewright.functions import ref, round_to
from tablewright.models.algebra import LinearDiscriminant, MatchingPursuit, QuadraticDiscriminant, RidgeClassifier
from tablewright.models.features import FEATURES, PREDICTION, assemble
from tablewright.models.histogram import HistogramBoosting
from tablewright.models.linear import Folds, choices
from tablewright.models.trees import ExtraTrees, described
from tablewright.models.zoo import PENALTY, REGRESSORS, Sizes, classifiers, regressors
from tablewright.queries.modelling import BANDED_SQL, CHARGE_SQL, assessed, banded, charge
from tablewright.queries.registry import query
from tablewright.queries.tables import table
from tablewright.session import scratch_folder, settle, settle_for_training

SEED, FOREST = 123, 3
FLAG_SQL = "CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END"
BINNED = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]


def flag():
    return F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)


def split_sql(source: str) -> str:
    """Range and threshold of every node, drawn by the same hash."""
    share = f"CAST('0x' || substr(md5('threshold:{SEED}:' || tree || ':' || place || ':0'), 1, 8) AS BIGINT) / 4294967296::DOUBLE"
    return (f"SELECT tree, place, min(x) + {share} * (max(x) - min(x)) AS threshold, "
            + ", ".join(f"count(*) FILTER (y = {c}) AS all_{c}" for c in range(3)) + f" FROM {source} GROUP BY tree, place")


@query("extra_trees_splits", f"""
WITH d AS (SELECT CAST(l_extendedprice AS DOUBLE) AS x, {FLAG_SQL} AS y FROM lineitem),
t1 AS (SELECT tree, 1 AS place, x, y FROM d, (SELECT unnest(range({FOREST})) AS tree)), s1 AS ({split_sql("t1")}),
t2 AS (SELECT t1.tree, CASE WHEN x <= threshold THEN 2 ELSE 3 END AS place, x, y FROM t1 JOIN s1 USING (tree)), s2 AS ({split_sql("t2")}),
s AS (SELECT * FROM s1 UNION ALL SELECT * FROM s2)
SELECT tree, CAST(place AS BIGINT) AS place, round(threshold, 4) AS threshold, all_0, all_1, all_2 FROM s""")
def extra_trees_splits_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thresholds and class counts of the first two levels of trees on one feature: each between the node's extremes, at a seeded place."""
    rows = table(spark, sf_dir, "lineitem").select("l_extendedprice", flag().alias("y"))
    nodes, _ = ExtraTrees(trees=FOREST, depth=2, seed=SEED).grow(assemble(rows, ["l_extendedprice"], "y"))
    return described(spark, nodes).filter("feature >= 0").select(
        "tree", "place", round_to(ref("threshold"), 4).alias("threshold"),
        *(F.get("value", F.lit(c)).cast("bigint").alias(f"all_{c}") for c in range(3)))


def leaf_sql(slopes: str) -> str:
    """The best first split by gain over all values of all features, from (score, feature, v, g, h, n)."""
    return f"""
b AS ({slopes}),
c AS (SELECT score, feature, v, sum(g) OVER w AS gl, sum(h) OVER w AS hl, sum(n) OVER w AS nl, sum(g) OVER p AS ga, sum(h) OVER p AS ha,
             sum(n) OVER p AS na FROM b WINDOW w AS (PARTITION BY score, feature ORDER BY v), p AS (PARTITION BY score, feature)),
k AS (SELECT *, gl * gl / hl + (ga - gl) * (ga - gl) / (ha - hl) - ga * ga / ha AS gain FROM c WHERE nl >= 20 AND na - nl >= 20)
SELECT CAST(score AS INTEGER) AS score, feature, v AS threshold, round(-0.1 * gl / hl, 6) + 0.0 AS left_value,
       round(-0.1 * (ga - gl) / (ha - hl), 6) + 0.0 AS right_value
FROM k QUALIFY row_number() OVER (PARTITION BY score ORDER BY gain DESC, feature, v) = 1"""


def long_sql(source: str, more: str) -> str:
    return " UNION ALL ".join(f"SELECT {j} AS feature, CAST({c} AS DOUBLE) AS v, {more} FROM {source}" for j, c in enumerate(BINNED))


def first_splits(model, spark: SparkSession) -> DataFrame:
    """Root and leaves of each tree of the first round in one row."""
    nodes = model.described(spark).filter("round = 0")
    root = nodes.filter("node = 0").select("score", "feature", "threshold")
    values = nodes.groupBy("score").agg(*(round_to(F.max(F.when(F.col("node") == n, F.col("value"))), 6).alias(name)
                                          for n, name in ((1, "left_value"), (2, "right_value"))))
    return root.join(values, "score").select("score", "feature", "threshold", "left_value", "right_value")


@query("boosting_regression_split", f"""
WITH d AS (SELECT {CHARGE_SQL} AS y, * FROM lineitem), m AS (SELECT avg(y) AS mean FROM d), u AS ({long_sql("d, m", "mean - y AS g")}),"""
       + leaf_sql("SELECT 0 AS score, feature, v, sum(g) AS g, CAST(count(*) AS DOUBLE) AS h, count(*) AS n FROM u GROUP BY feature, v"))
def boosting_regression_split_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first tree of squared loss: where the highest gain splits the rows, and both leaf values."""
    rows = assemble(table(spark, sf_dir, "lineitem").withColumn("y", charge() / 1000), BINNED, "y")
    return first_splits(HistogramBoosting(False, rounds=1, leaves=2).fit(rows), spark)


@query("boosting_class_splits", f"""
WITH d AS (SELECT {FLAG_SQL} AS y, * FROM lineitem), s AS (SELECT y AS score, count(*) / (SELECT count(*) FROM d)::DOUBLE AS share FROM d GROUP BY y),
u AS ({long_sql("d", "y")}),"""
       + leaf_sql("SELECT score, feature, v, count(*) * share - count(*) FILTER (y = score) AS g, count(*) * share * (1 - share) AS h, count(*) AS n "
                  "FROM u, s GROUP BY score, share, feature, v"))
def boosting_class_splits_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first tree of each of three classes under softmax loss."""
    rows = assemble(table(spark, sf_dir, "lineitem").withColumn("y", flag()), BINNED, "y")
    return first_splits(HistogramBoosting(True, rounds=1, leaves=2).fit(rows), spark)


PENALTIES, SHARES, PATH_FOLDS = [1.0, 0.1, 0.01], [0.0, 0.5, 1.0], 5
PAIR_SQL = "CAST(l_extendedprice AS DOUBLE) / 10000 AS a, CAST(l_discount AS DOUBLE) * 100 AS b"
SUMS = {"n": "1", "sa": "a", "sb": "b", "sy": "y", "saa": "a * a", "sab": "a * b", "sbb": "b * b", "say": "a * y", "sby": "b * y", "syy": "y * y"}


def pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two features of the line items, their charge, and a fold from the order's number."""
    rows = table(spark, sf_dir, "lineitem").select(
        (F.col("l_extendedprice").cast("double") / 10000).alias("a"), (F.col("l_discount").cast("double") * 100).alias("b"),
        (charge() / 1000).alias("y"), (F.col("l_orderkey") % PATH_FOLDS).alias("fold"))
    return assemble(rows, ["a", "b"], "y", ["fold"])


def path_sql() -> str:
    """Weights in closed form while both are active, their signs those of least squares; errors on the held-out rows."""
    cov = ", ".join(f"s{x}{z} / n - s{x} / n * s{z} / n AS c{x}{z}" for x, z in ("aa", "ab", "bb", "ay", "by"))
    return f"""
WITH d AS (SELECT {PAIR_SQL}, {CHARGE_SQL} AS y, l_orderkey % {PATH_FOLDS} AS fold FROM lineitem),
f AS (SELECT fold, {", ".join(f"sum({e})::DOUBLE AS {n}" for n, e in SUMS.items())} FROM d GROUP BY fold),
t AS (SELECT f.fold, {", ".join(f"w.{n} - f.{n} AS {n}" for n in SUMS)} FROM f, (SELECT {", ".join(f"sum({n}) AS {n}" for n in SUMS)} FROM f) w),
c AS (SELECT fold, sa / n AS ma, sb / n AS mb, sy / n AS my, {cov} FROM t),
o AS (SELECT *, sign((cay * cbb - cby * cab) / (caa * cbb - cab * cab)) AS ga, sign((cby * caa - cay * cab) / (caa * cbb - cab * cab)) AS gb FROM c),
p AS (SELECT * FROM (SELECT unnest({PENALTIES})::DOUBLE AS penalty), (SELECT unnest({SHARES})::DOUBLE AS share)),
e AS (SELECT *, caa + penalty * (1 - share) AS pa, cbb + penalty * (1 - share) AS pb, cay - penalty * share * ga AS qa, cby - penalty * share * gb AS qb FROM o, p),
w AS (SELECT *, (qa * pb - qb * cab) / (pa * pb - cab * cab) AS wa, (qb * pa - qa * cab) / (pa * pb - cab * cab) AS wb FROM e)
SELECT w.penalty, w.share, CAST(w.fold AS INTEGER) AS fold, count(*) AS rows, round(wa, 6) AS weight_a, round(wb, 6) AS weight_b,
       round(my - wa * ma - wb * mb, 6) AS intercept, round(avg(pow(y - (my + wa * (a - ma) + wb * (b - mb)), 2)), 5) AS mse
FROM w JOIN d ON d.fold = w.fold GROUP BY w.penalty, w.share, w.fold, wa, wb, ma, mb, my"""


@query("linear_penalty_path", path_sql())
def linear_penalty_path_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ridge, elastic net and lasso at three penalties in five folds: weights and held-out errors, all from one scan."""
    found = choices(Folds.of(pair(spark, sf_dir), "fold"), PENALTIES, SHARES)
    rows = [(c.penalty, c.share, c.fold, c.rows, *c.weights, c.offset, c.mse) for c in found]
    made = spark.createDataFrame(rows, "penalty double, share double, fold int, rows bigint, weight_a double, weight_b double, "
                                       "intercept double, mse double")
    return made.withColumns({**{c: round_to(ref(c), 6) for c in ("weight_a", "weight_b", "intercept")}, "mse": round_to(ref("mse"), 5)})


CLASS_PAIR = ["a", "b"]
GROUPS_SQL = (f"WITH d AS (SELECT {FLAG_SQL} AS y, {PAIR_SQL} FROM lineitem), "
              "g AS (SELECT y, count(*)::DOUBLE AS n, avg(a) AS ma, avg(b) AS mb, var_pop(a) * count(*) AS aa, var_pop(b) * count(*) AS bb, "
              "covar_pop(a, b) * count(*) AS ab, count(*) / (SELECT count(*) FROM d)::DOUBLE AS share FROM d GROUP BY y)")


def class_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(
        (F.col("l_extendedprice").cast("double") / 10000).alias("a"), (F.col("l_discount").cast("double") * 100).alias("b"), flag().alias("y"))
    return assemble(rows, CLASS_PAIR, "y")


def weights_table(spark: SparkSession, model, digits: int = 5) -> DataFrame:
    rows = [(k, float(w[0]), float(w[1]), float(o)) for k, (w, o) in enumerate(zip(model.weights, model.offsets))]
    made = spark.createDataFrame(rows, "label int, weight_a double, weight_b double, intercept double")
    return made.withColumns({c: round_to(ref(c), digits) for c in ("weight_a", "weight_b", "intercept")})


@query("lda_weights", GROUPS_SQL + """,
p AS (SELECT sum(aa) / sum(n) AS aa, sum(bb) / sum(n) AS bb, sum(ab) / sum(n) AS ab FROM g),
w AS (SELECT y, share, ma, mb, (g.ma * p.bb - g.mb * p.ab) / (p.aa * p.bb - p.ab * p.ab) AS wa,
             (g.mb * p.aa - g.ma * p.ab) / (p.aa * p.bb - p.ab * p.ab) AS wb FROM g, p)
SELECT y AS label, round(wa, 5) AS weight_a, round(wb, 5) AS weight_b, round(ln(share) - (wa * ma + wb * mb) / 2, 5) AS intercept FROM w""")
def lda_weights_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The linear scores of discriminant analysis for three classes on two features."""
    return weights_table(spark, LinearDiscriminant().fit(class_pair(spark, sf_dir)))


@query("ridge_class_weights", GROUPS_SQL + """,
t AS (SELECT sum(n) AS n, sum(n * ma) / sum(n) AS ma, sum(n * mb) / sum(n) AS mb FROM g),
s AS (SELECT sum(aa + g.n * pow(g.ma - t.ma, 2)) + 1 AS aa, sum(bb + g.n * pow(g.mb - t.mb, 2)) + 1 AS bb,
             sum(ab + g.n * (g.ma - t.ma) * (g.mb - t.mb)) AS ab FROM g, t),
w AS (SELECT y, share, t.ma, t.mb, 2 * g.n * ((g.ma - t.ma) * bb - (g.mb - t.mb) * ab) / (aa * bb - ab * ab) AS wa,
             2 * g.n * ((g.mb - t.mb) * aa - (g.ma - t.ma) * ab) / (aa * bb - ab * ab) AS wb FROM (SELECT y, n, ma, mb, share FROM g) g, t, s)
SELECT y AS label, round(wa, 6) + 0.0 AS weight_a, round(wb, 6) + 0.0 AS weight_b, round(2 * share - 1 - wa * ma - wb * mb, 6) AS intercept FROM w""")
def ridge_class_weights_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weights of least squares on -1 and 1 per class, penalty 1."""
    return weights_table(spark, RidgeClassifier().fit(class_pair(spark, sf_dir)), 6)


@query("qda_scores", GROUPS_SQL + """,
q AS (SELECT y, ma, mb, share, aa / (n - 1) AS aa, bb / (n - 1) AS bb, ab / (n - 1) AS ab FROM g)
SELECT y AS label, round(ma, 6) AS mean_a, round(mb, 6) AS mean_b, round(bb / (aa * bb - ab * ab), 6) AS precision_aa,
       round(-ab / (aa * bb - ab * ab), 6) + 0.0 AS precision_ab, round(aa / (aa * bb - ab * ab), 6) AS precision_bb,
       round(ln(share) - ln(aa * bb - ab * ab) / 2, 6) AS intercept FROM q""")
def qda_scores_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means, inverse covariances and offsets of quadratic discriminant analysis."""
    model = QuadraticDiscriminant().fit(class_pair(spark, sf_dir))
    names = ["mean_a", "mean_b", "precision_aa", "precision_ab", "precision_bb", "intercept"]
    rows = [(k, *map(float, (*m, p[0, 0], p[0, 1], p[1, 1], o))) for k, (m, p, o) in enumerate(zip(model.means, model.precisions, model.offsets))]
    made = spark.createDataFrame(rows, "label int, " + ", ".join(f"{n} double" for n in names))
    return made.withColumns({c: round_to(ref(c), 6) for c in names})


@query("matching_pursuit_pick", f"""
WITH d AS (SELECT {PAIR_SQL}, {CHARGE_SQL} AS y FROM lineitem),
c AS (SELECT 'a' AS feature, corr(a, y) AS r, regr_slope(y, a) AS weight, regr_intercept(y, a) AS intercept FROM d
      UNION ALL SELECT 'b', corr(b, y), regr_slope(y, b), regr_intercept(y, b) FROM d)
SELECT feature, round(weight, 6) AS weight, round(intercept, 6) AS intercept FROM c ORDER BY abs(r) DESC LIMIT 1""")
def matching_pursuit_pick_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one feature that matching pursuit takes of two, with its weight."""
    model = MatchingPursuit().fit(pair(spark, sf_dir))
    rows = [(name, float(w), float(model.offset)) for name, w in zip(CLASS_PAIR, model.weights) if w]
    made = spark.createDataFrame(rows, "feature string, weight double, intercept double")
    return made.withColumns({c: round_to(ref(c), 6) for c in ("weight", "intercept")})


def net_sql(name: str, penalty: float, share: float) -> str:
    """Weights in closed form as in the path, with the errors on the rows themselves."""
    return f"""
WITH d AS (SELECT {PAIR_SQL}, {CHARGE_SQL} AS y FROM lineitem),
c AS (SELECT count(*) AS rows, avg(a) AS ma, avg(b) AS mb, avg(y) AS my, var_pop(a) AS aa, var_pop(b) AS bb, covar_pop(a, b) AS ab,
             covar_pop(a, y) AS ya, covar_pop(b, y) AS yb, var_pop(y) AS yy FROM d),
e AS (SELECT *, aa + {penalty * (1 - share)} AS pa, bb + {penalty * (1 - share)} AS pb,
             ya - {penalty * share} * sign(ya * bb - yb * ab) AS qa, yb - {penalty * share} * sign(yb * aa - ya * ab) AS qb FROM c),
w AS (SELECT *, (qa * pb - qb * ab) / (pa * pb - ab * ab) AS wa, (qb * pa - qa * ab) / (pa * pb - ab * ab) AS wb FROM e),
m AS (SELECT *, yy - 2 * (wa * ya + wb * yb) + wa * wa * aa + 2 * wa * wb * ab + wb * wb * bb AS mse FROM w)
SELECT '{name}' AS model, rows, round(wa, 6) AS weight_a, round(wb, 6) AS weight_b, round(my - wa * ma - wb * mb, 6) AS intercept,
       round(mse, 5) AS mse, round(1 - mse / yy, 6) AS r2 FROM m"""


def net_query(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        data = settle_for_training(pair(spark, sf_dir))
        model = REGRESSORS[name](0, None).fit(data)
        found = assessed(model.transform(data), name, False).withColumns({
            "weight_a": F.lit(float(model.weights[0])), "weight_b": F.lit(float(model.weights[1])), "intercept": F.lit(float(model.offset))})
        return found.select("model", "rows", *(round_to(ref(c), 6).alias(c) for c in ("weight_a", "weight_b", "intercept")),
                            round_to(ref("mse"), 5).alias("mse"), round_to(ref("r2"), 6).alias("r2"))

    return run


for short, part in (("ridge", 0.0), ("enet", 0.5), ("lasso", 1.0)):
    query(f"reg_{short}", net_sql(short, PENALTY, part))(net_query(short))


KEPT_CLASSIFIERS, KEPT_REGRESSORS = ["lr", "ridge", "lda", "qda", "et", "hgb", "ada", "knn", "dummy"], ["lasso", "bayes_ridge", "et", "hgb", "ada", "knn", "dummy"]
QUICK = Sizes(trees=10, depth=4, rounds=3, adaptive=3)     # models that are saved here need not be good


def kept_sql() -> str:
    names = [f"clf_{n}" for n in KEPT_CLASSIFIERS] + [f"reg_{n}" for n in KEPT_REGRESSORS]
    return f"SELECT unnest({names}) AS model, rows, rows AS equal_rows FROM (SELECT count(*) AS rows FROM ({BANDED_SQL}))"


@query("models_roundtrip", kept_sql())
def models_roundtrip_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models saved and loaded again, behind a scaler in one pipeline, predict the same for every customer."""
    found = []
    for task, makers, names, target in (("clf", classifiers(QUICK), KEPT_CLASSIFIERS, "band"), ("reg", regressors(QUICK), KEPT_REGRESSORS, "step")):
        data = banded(spark, sf_dir, target).withColumnRenamed(FEATURES, "raw")
        for name in names:
            scaler = StandardScaler(inputCol="raw", outputCol=FEATURES, withMean=True)
            model = Pipeline(stages=[scaler, makers[name](2, "c_custkey")]).fit(data)
            folder = scratch_folder(spark, "model")
            model.write().save(folder)
            one, two = (m.transform(data).select("c_custkey", F.col(PREDICTION).alias(n))
                        for m, n in ((model, "one"), (PipelineModel.load(folder), "two")))
            found.append(settle(one.join(two, "c_custkey").agg(
                F.lit(f"{task}_{name}").alias("model"), F.count(F.lit(1)).alias("rows"), F.count_if(F.col("one") == F.col("two")).alias("equal_rows"))))
    return reduce(DataFrame.unionByName, found)
