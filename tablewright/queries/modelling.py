"""Queries on models: fitted sums, single models, neighbours, the comparison and the network."""

from __future__ import annotations

import json

from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tablewright.functions import ref, round_to
from tablewright.models.algebra import cross_products
from tablewright.models.features import FEATURES, LABEL, PREDICTION, assemble
from tablewright.models.leaderboard import FOLDS, compare_models, label_predictions
from tablewright.models.mlp import EPOCHS, Network, NetworkClassifier, NetworkRegressor
from tablewright.models.neighbours import NEIGHBOURS, Index
from tablewright.models.network import LEARNING_RATE, RATE_FACTOR, RATE_STEP, Architecture
from tablewright.models.zoo import CLASSIFIERS, REGRESSORS, Sizes, classifiers, regressors
from tablewright.operators.metrics import classification_metrics, regression_metrics
from tablewright.operators.scale import normalize
from tablewright.queries.registry import query
from tablewright.queries.tables import table
from tablewright.session import scratch_folder, settle_for_training

TEXT_FEATURES = ["n_chars", "words", "lines", "digits", "capitals", "lang_code", "source_code"]
LINE_FEATURES = ["l_extendedprice", "l_discount", "l_tax", "l_quantity", "l_linenumber"]


def document_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents: key, counts over the whole text, and the quality label."""
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    text = F.col("text")

    def left_after(pattern: str):
        return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))

    return documents.join(labels, "doc_id").select(
        "doc_id", F.col("n_chars").cast("double").alias("n_chars"),
        F.size(F.split(text, r"\s+")).cast("double").alias("words"),
        left_after(r"\n").cast("double").alias("lines"), left_after("[0-9]").cast("double").alias("digits"),
        left_after("[A-Z]").cast("double").alias("capitals"),
        F.when(F.col("lang") == "en", 0.0).when(F.col("lang") == "fr", 1.0).otherwise(2.0).alias("lang_code"),
        F.regexp_extract("source", "([0-9]+)", 1).cast("double").alias("source_code"), "quality", "toxic")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same standardized and assembled: key, features, label."""
    rows = normalize(document_features(spark, sf_dir), TEXT_FEATURES, "zscore_sample")
    return assemble(rows, TEXT_FEATURES, "quality", ["doc_id"])


def charge():
    return F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))


def lines(spark: SparkSession, sf_dir: str, scaled: bool = True) -> DataFrame:
    """Line items with the charge as the target, in thousands."""
    rows = table(spark, sf_dir, "lineitem").select(
        F.xxhash64("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate").alias("line_id"),
        *LINE_FEATURES, (charge() / 1000).alias("charge"))
    if scaled:
        rows = normalize(rows, LINE_FEATURES, "zscore_sample")
    return assemble(rows, LINE_FEATURES, "charge", ["line_id"])


def assessed(said: DataFrame, name: str, classification: bool) -> DataFrame:
    """(model, rows, metrics) of predictions."""
    tagged = said.withColumn("model", F.lit(name))
    measure = classification_metrics if classification else regression_metrics
    found = measure(tagged, LABEL, PREDICTION, ["model"])
    return found.join(tagged.groupBy("model").agg(F.count(F.lit(1)).alias("rows")), "model")


def classifier_query(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        data = settle_for_training(documents(spark, sf_dir))
        model = CLASSIFIERS[name](2, "doc_id").fit(data)
        return assessed(model.transform(data), name, True)

    return run


def regressor_query(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        data = settle_for_training(lines(spark, sf_dir))
        model = REGRESSORS[name](0, "line_id").fit(data)
        return assessed(model.transform(data), name, False)

    return run


#: Customers with a low or a high balance, in units of 500, and a wide gap between them: what any model that learns tells apart without an error.
BANDED_SQL = ("SELECT c_custkey, CASE WHEN c_acctbal >= 6000 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS band, "
              "floor(c_acctbal / 500) + 1.0::DOUBLE AS slope FROM customer WHERE c_acctbal < 3000 OR c_acctbal >= 6000")
BAND_FEATURES = ["balance", "nation"]


def banded(spark: SparkSession, sf_dir: str, target: str = "band") -> DataFrame:
    """These customers by balance and nation, standardized. Targets: the ``band`` 0 or 1, a ``step`` of 10 or 20, a ``slope`` on the balance."""
    balance = F.col("c_acctbal")
    units = F.floor(balance / 500).cast("double")
    rows = table(spark, sf_dir, "customer").filter((balance < 3000) | (balance >= 6000)).select(
        "c_custkey", units.alias("balance"), F.col("c_nationkey").cast("double").alias("nation"),
        (balance >= 6000).cast("double").alias("band"), F.when(balance >= 6000, 20.0).otherwise(10.0).alias("step"), (units + 1).alias("slope"))
    return settle_for_training(assemble(normalize(rows, BAND_FEATURES, "zscore_sample"), BAND_FEATURES, target, ["c_custkey"]))


def confusion(said: DataFrame, name: str) -> DataFrame:
    """Rows by label and prediction."""
    return said.groupBy(F.lit(name).alias("model"), LABEL, PREDICTION).agg(F.count(F.lit(1)).alias("rows"))


def confusion_sql(name: str) -> str:
    return f"SELECT '{name}' AS model, band AS label, band AS prediction, count(*) AS rows FROM ({BANDED_SQL}) GROUP BY band"


def trained_classifier_query(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        data = banded(spark, sf_dir)
        return confusion(CLASSIFIERS[name](2, "c_custkey").fit(data).transform(data), name)

    return run


def levels(said: DataFrame, name: str) -> DataFrame:
    """Rows by the step of the target and the step next to the prediction."""
    near = F.when(F.col(PREDICTION) < 15, 10.0).otherwise(20.0)
    return said.groupBy(F.lit(name).alias("model"), F.col(LABEL).alias("step"), near.alias("predicted_step")).agg(F.count(F.lit(1)).alias("rows"))


def levels_sql(name: str) -> str:
    return f"SELECT '{name}' AS model, 10 + 10 * band AS step, 10 + 10 * band AS predicted_step, count(*) AS rows FROM ({BANDED_SQL}) GROUP BY band"


def trained_step_query(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        data = banded(spark, sf_dir, "step")
        return levels(REGRESSORS[name](0, "c_custkey").fit(data).transform(data), name)

    return run


def trained_slope_query(name: str):
    """Models of lines on a target that is one: the mean prediction, and the largest error."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        data = banded(spark, sf_dir, "slope")
        said = REGRESSORS[name](0, "c_custkey").fit(data).transform(data)
        return said.agg(F.lit(name).alias("model"), F.count(F.lit(1)).alias("rows"), round_to(F.avg(PREDICTION), 2).alias("mean_prediction"),
                        round_to(F.max(F.abs(F.col(PREDICTION) - F.col(LABEL))), 1).alias("largest_error"))

    return run


def slope_sql(name: str) -> str:
    return (f"SELECT '{name}' AS model, count(*) AS rows, round(avg(slope), 2) AS mean_prediction, 0.0::DOUBLE AS largest_error "
            f"FROM ({BANDED_SQL})")


DUMMY_CLASS = ("WITH d AS (SELECT quality FROM documents JOIN labels USING (doc_id)), m AS (SELECT quality AS said FROM d "
               "GROUP BY quality ORDER BY count(*) DESC, quality LIMIT 1), s AS (SELECT count(*)::DOUBLE AS n, "
               "count(*) FILTER (quality = said)::DOUBLE AS hits FROM d, m) SELECT 'dummy' AS model, hits / n AS accuracy, "
               "hits / n * (hits / n) AS precision, hits / n AS recall, hits / n * (2 * hits / (hits + n)) AS f1, "
               "n::BIGINT AS rows FROM s")
CHARGE_SQL = "l_extendedprice * (1 - l_discount) * (1 + l_tax) / 1000"
DUMMY_MEAN = (f"WITH d AS (SELECT {CHARGE_SQL} AS y FROM lineitem), m AS (SELECT avg(y) AS said FROM d) SELECT 'dummy' AS "
              "model, round(avg(pow(y - said, 2)), 6) AS mse, round(avg(abs(y - said)), 6) AS mae, 0.0::DOUBLE AS r2, "
              "count(*) AS rows FROM d, m")


STEP_MODELS = ["dt", "rf", "unbagged", "et", "gbt", "hgb", "ada", "knn"]
SLOPE_MODELS = ["huber", "bayes_ridge", "omp"]

for short in CLASSIFIERS:
    if short != "dummy":
        query(f"clf_{short}", confusion_sql(short))(trained_classifier_query(short))
for short in STEP_MODELS:
    query(f"reg_{short}", levels_sql(short))(trained_step_query(short))
for short in SLOPE_MODELS:
    query(f"reg_{short}", slope_sql(short))(trained_slope_query(short))


@query("clf_dummy", DUMMY_CLASS.replace("hits / n AS accuracy", "round(hits / n, 6) AS accuracy")
       .replace("hits / n * (hits / n) AS precision", "round(hits / n * (hits / n), 6) AS precision")
       .replace("hits / n AS recall", "round(hits / n, 6) AS recall")
       .replace("hits / n * (2 * hits / (hits + n)) AS f1", "round(hits / n * (2 * hits / (hits + n)), 6) AS f1"))
def clf_dummy_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = classifier_query("dummy")(spark, sf_dir)
    return found.select("model", "rows", *(round_to(ref(c), 6).alias(c) for c in ("accuracy", "precision", "recall", "f1")))


@query("reg_dummy", DUMMY_MEAN)
def reg_dummy_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = regressor_query("dummy")(spark, sf_dir)
    return found.select("model", "rows", *(round_to(ref(c), 6).alias(c) for c in ("mse", "mae", "r2")))


def least_squares_sql() -> str:
    """Residual figures of the two-feature least squares fit, in closed form."""
    return (f"WITH d AS (SELECT {CHARGE_SQL} AS y, l_extendedprice AS a, l_discount AS b FROM lineitem), "
            "m AS (SELECT var_pop(a) AS aa, var_pop(b) AS bb, covar_pop(a, b) AS ab, covar_pop(y, a) AS ya, "
            "covar_pop(y, b) AS yb, var_pop(y) AS yy, count(*) AS n FROM d), "
            "w AS (SELECT *, (ya * bb - yb * ab) / (aa * bb - ab * ab) AS wa, (yb * aa - ya * ab) / (aa * bb - ab * ab) "
            "AS wb FROM m) SELECT 'linear' AS model, round(yy - wa * ya - wb * yb, 6) AS mse, "
            "round((wa * ya + wb * yb) / yy, 6) AS r2, n AS rows FROM w")


@query("reg_linear", least_squares_sql())
def reg_linear_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least squares of the charge on price and discount."""
    rows = table(spark, sf_dir, "lineitem").select("l_extendedprice", "l_discount", (charge() / 1000).alias("charge"))
    data = settle_for_training(assemble(rows, ["l_extendedprice", "l_discount"], "charge"))
    found = assessed(REGRESSORS["linear"](0, None).fit(data).transform(data), "linear", False)
    return found.select("model", "rows", round_to(ref("mse"), 6).alias("mse"), round_to(ref("r2"), 6).alias("r2"))


@query("ols_simple", f"SELECT round(regr_slope({CHARGE_SQL}, l_extendedprice) * 1000, 6) AS slope, "
                     f"round(regr_intercept({CHARGE_SQL}, l_extendedprice), 6) AS intercept, count(*) AS rows FROM lineitem")
def ols_simple_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_extendedprice", (charge() / 1000).alias("charge"))
    data = assemble(rows, ["l_extendedprice"], "charge")
    model = LinearRegression(solver="normal").fit(data)
    return rows.agg(F.count(F.lit(1)).alias("rows")).select(
        round_to(F.lit(float(model.coefficients[0]) * 1000), 6).alias("slope"),
        round_to(F.lit(float(model.intercept)), 6).alias("intercept"), "rows")


def product_sql(columns: list[str], source: str, group: str = "0.0::DOUBLE", by: str = "") -> str:
    names = ["1", *columns]
    return " UNION ALL ".join(
        f"SELECT {group} AS \"group\", {i}::INTEGER AS i, {j}::INTEGER AS j, round(sum({names[i]}::DOUBLE * {names[j]}), 2) "
        f"+ 0.0 AS value FROM {source}{by}" for i in range(len(names)) for j in range(i, len(names)))


def rounded_cells(cells: DataFrame) -> DataFrame:
    return cells.select("group", "i", "j", round_to(ref("value"), 2).alias("value"))


@query("gram_matrix", f"WITH d AS (SELECT *, {CHARGE_SQL} AS charge FROM lineitem) "
                      + product_sql(["l_quantity", "l_discount", "l_tax", "charge"], "d"))
def gram_matrix_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of products of the constant, three features and the target."""
    rows = table(spark, sf_dir, "lineitem").withColumn("charge", charge() / 1000)
    data = assemble(rows, ["l_quantity", "l_discount", "l_tax"], "charge")
    return rounded_cells(cross_products(data, with_label=True))


@query("class_moments", "WITH d AS (SELECT *, CASE o_orderstatus WHEN 'F' THEN 0.0::DOUBLE WHEN 'O' THEN 1.0::DOUBLE ELSE "
                        "2.0::DOUBLE END AS y, o_totalprice / 1000 AS price FROM orders JOIN customer ON o_custkey = c_custkey) "
                        + product_sql(["price", "c_acctbal", "c_nationkey"], "d", "y", " GROUP BY y"))
def class_moments_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per class: count, sums and sums of products, which discriminant analysis reads."""
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    status = F.col("o_orderstatus")
    rows = orders.join(customer, orders.o_custkey == customer.c_custkey).select(
        (F.col("o_totalprice") / 1000).alias("price"), "c_acctbal", "c_nationkey",
        F.when(status == "F", 0).when(status == "O", 1).otherwise(2).alias("y"))
    return rounded_cells(cross_products(assemble(rows, ["price", "c_acctbal", "c_nationkey"], "y"), by_label=True))


@query("nb_stats", "SELECT CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS label, "
                   + ", ".join(f"round(avg({c}), 5) AS mean_{c}, round(var_pop({c}), 5) AS var_{c}"
                               for c in ("l_quantity", "l_discount")) + " FROM lineitem GROUP BY 1")
def nb_stats_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The means and variances that gaussian naive Bayes fits per class."""
    flag = F.col("l_returnflag")
    rows = table(spark, sf_dir, "lineitem").withColumn("y", F.when(flag == "A", 0).when(flag == "N", 1).otherwise(2))
    model = CLASSIFIERS["nb"](3, None).fit(assemble(rows, ["l_quantity", "l_discount"], "y"))
    means, variances = model.theta.toArray(), model.sigma.toArray()
    cases = [F.struct(F.lit(c).alias("label"), *(
        round_to(F.lit(float(m[c][i])), 5).alias(f"{kind}_{name}") for i, name in enumerate(("l_quantity", "l_discount"))
        for kind, m in (("mean", means), ("var", variances)))) for c in range(3)]
    return rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).select(F.inline(F.array(F.get(F.array(*cases), F.col("y")))))


@query("knn_topk", "WITH q AS (SELECT s_suppkey, s_acctbal / 1000 AS a, s_nationkey / 10.0::DOUBLE AS b FROM supplier), "
                   "c AS (SELECT c_custkey, c_acctbal / 1000 AS a, c_nationkey / 10.0::DOUBLE AS b FROM customer), "
                   "d AS (SELECT s_suppkey, c_custkey, sqrt((q.a - c.a) * (q.a - c.a) + (q.b - c.b) * (q.b - c.b)) AS far "
                   "FROM q, c), r AS (SELECT *, row_number() OVER (PARTITION BY s_suppkey ORDER BY far, c_custkey) AS rank "
                   f"FROM d) SELECT s_suppkey, rank::INTEGER AS rank, c_custkey, round(far, 6) AS far FROM r WHERE rank <= {NEIGHBOURS}")
def knn_topk_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest customers of every supplier by balance and nation."""
    customer, supplier = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")

    def point(balance: str, nation: str):
        return F.array(F.col(balance) / 1000, F.col(nation).cast("double") / 10)

    points = customer.select(point("c_acctbal", "c_nationkey").alias("x"), F.col("c_custkey").alias("id"),
                             F.lit(0.0).alias("label"))
    asked = supplier.select("s_suppkey", point("s_acctbal", "s_nationkey").alias("x"))
    found = Index(points, NEIGHBOURS).nearest(asked.select("x"))
    return asked.join(found, "x").select("s_suppkey", "rank", F.col("id").alias("c_custkey"),
                                         round_to(ref("distance"), 6).alias("far"))


#: Of the boosted models in comparisons, which are fitted once a fold; README has the figures of full sizes.
BOARD = Sizes(rounds=30, leaves=8, adaptive=10)
METRICS = ["accuracy", "auc", "recall", "precision", "f1", "kappa", "mcc"]


def board_sql(names: list[str]) -> str:
    """All models but the dummy are right everywhere; the dummy says the larger class, whose rows are dealt to folds in turn."""
    perfect = ", ".join(f"1.0::DOUBLE AS {m}" for m in METRICS)
    listed = ", ".join(f"'{name}'" for name in names if name != "dummy")
    return f"""
WITH d AS ({BANDED_SQL}), c AS (SELECT count(*) FILTER (band = 0) AS n0, count(*) FILTER (band = 1) AS n1 FROM d),
f AS (SELECT n0 // {FOLDS} + CASE WHEN fold BETWEEN 1 AND n0 % {FOLDS} THEN 1 ELSE 0 END AS r0, n1 // {FOLDS} +
      CASE WHEN fold BETWEEN 1 AND n1 % {FOLDS} THEN 1 ELSE 0 END AS r1, n1 > n0 AS one FROM c, (SELECT unnest(range({FOLDS})) AS fold)),
h AS (SELECT (CASE WHEN one THEN r1 ELSE r0 END) / (r0 + r1)::DOUBLE AS s FROM f),
m AS (SELECT unnest([{listed}]) AS model, {perfect}
      UNION ALL SELECT 'dummy', round(avg(s), 4), 0.5::DOUBLE, round(avg(s), 4), round(avg(s * s), 4), round(avg(2 * s * s / (1 + s)), 4), 0.0::DOUBLE, 0.0::DOUBLE FROM h)
SELECT model, {", ".join(METRICS)}, {FOLDS}::BIGINT AS folds, 'ok' AS status, row_number() OVER (ORDER BY accuracy DESC, model) AS rank FROM m"""


@query("leaderboard", board_sql(list(CLASSIFIERS)))
def leaderboard_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every classifier on the customers' bands in ten folds: all metrics, and the rank."""
    board = compare_models(banded(spark, sf_dir), "classification", ["c_custkey"], classifiers(BOARD))
    return board.drop("fit_seconds").withColumn("rank", F.row_number().over(Window.orderBy(F.desc("accuracy"), "model")).cast("bigint"))


@query("leaderboard_regression", f"SELECT unnest({[n for n in REGRESSORS if n != 'dummy']}) AS model, 1.0::DOUBLE AS r2, {FOLDS}::BIGINT AS folds, "
                                 f"'ok' AS status UNION ALL SELECT 'dummy', 0.0, {FOLDS}, 'ok' FROM customer HAVING count(*) > 0")
def leaderboard_regression_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every regressor on the customers' slope in ten folds: the share of variance explained, to one place."""
    board = compare_models(banded(spark, sf_dir, "slope"), "regression", ["c_custkey"], regressors(BOARD))
    return board.select("model", round_to(ref("r2"), 1).alias("r2"), "folds", "status")


@query("predict_labels", f"SELECT c_custkey, band AS label, band AS prediction_label, 1.0::DOUBLE AS prediction_score FROM ({BANDED_SQL})")
def predict_labels_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with their band, the predicted one, and its score to one place."""
    data = banded(spark, sf_dir)
    said = label_predictions(CLASSIFIERS["lr"](2, None).fit(data), data, "classification", 2, ["c_custkey", LABEL])
    return said.select("c_custkey", LABEL, "prediction_label", round_to(ref("prediction_score"), 1).alias("prediction_score"))


@query("mlp_architecture", "SELECT 'documents' AS name, '[64, 32, 16]' AS hidden, 7 AS inputs, count(*) AS rows FROM "
                           "documents JOIN labels USING (doc_id) UNION ALL SELECT 'lineitem', '[64, 32, 16]', 5, "
                           "count(*) FROM lineitem")
def mlp_architecture_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The network each of two tables would get."""
    parts = []
    for name, data, task, outputs in (("documents", documents(spark, sf_dir), "classification", 2),
                                      ("lineitem", lines(spark, sf_dir, False), "regression", 1)):
        size = len(data.schema[FEATURES].metadata["ml_attr"]["attrs"]["numeric"])
        info = Architecture(size, outputs, task).info()
        parts.append(data.agg(F.count(F.lit(1)).alias("rows")).select(
            F.lit(name).alias("name"), F.lit(json.dumps(info["hidden_sizes"])).alias("hidden"),
            F.lit(info["input_size"]).alias("inputs"), "rows"))
    return parts[0].unionByName(parts[1])


@query("mlp_train", f"SELECT 'customers' AS scenario, {EPOCHS}::BIGINT AS epochs, true AS loss_fell, 100.0::DOUBLE AS accuracy "
                    f"FROM ({BANDED_SQL}) LIMIT 1")
def mlp_train_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole training run: its last loss is below half of the first, and its last accuracy, to ten percent."""
    history = NetworkClassifier().fit(banded(spark, sf_dir)).history(spark, "customers")
    return history.groupBy("scenario").agg(
        F.count(F.lit(1)).alias("epochs"), (F.max_by("loss", "epoch") < F.min_by("loss", "epoch") / 2).alias("loss_fell"),
        (F.round(F.max_by("accuracy", "epoch") / 10) * 10).alias("accuracy"))


@query("mlp_history", f"SELECT 'customers' AS scenario, unnest(range(1, {EPOCHS + 1}))::INTEGER AS epoch, "
                      f"round({LEARNING_RATE} * pow({RATE_FACTOR}, (unnest(range(1, {EPOCHS + 1})) - 1) // {RATE_STEP}), 9) AS rate")
def mlp_history_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for every epoch, with its learning rate."""
    history = NetworkClassifier().fit(banded(spark, sf_dir)).history(spark, "customers")
    return history.filter("loss IS NOT NULL AND accuracy IS NOT NULL").select("scenario", "epoch", round_to(ref("rate"), 9).alias("rate"))


@query("mlp_classifier", confusion_sql("network"))
def mlp_classifier_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = banded(spark, sf_dir)
    return confusion(NetworkClassifier(workers=4).fit(data).transform(data), "network")


@query("mlp_regressor", confusion_sql("network"))
def mlp_regressor_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The band as a number: rows by band and the band next to the prediction."""
    data = banded(spark, sf_dir)
    said = NetworkRegressor().fit(data).transform(data)
    return confusion(said.withColumn(PREDICTION, (F.col(PREDICTION) >= 0.5).cast("double")), "network")


@query("mlp_predict", f"SELECT c_custkey, band AS prediction FROM ({BANDED_SQL})")
def mlp_predict_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = banded(spark, sf_dir)
    return NetworkClassifier().fit(data).transform(data).select("c_custkey", PREDICTION)


@query("model_roundtrip", f"SELECT count(*) AS rows, count(*) AS equal_rows FROM ({BANDED_SQL})")
def model_roundtrip_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A saved and reloaded network predicts the same."""
    data = banded(spark, sf_dir)
    model = NetworkClassifier(1).fit(data)
    folder = scratch_folder(spark, "network")
    model.save_to(spark, folder)
    again = Network.load_from(spark, folder)
    one, two = (m.transform(data).select("c_custkey", F.col("scores").alias(n)) for m, n in ((model, "one"), (again, "two")))
    return one.join(two, "c_custkey").agg(F.count(F.lit(1)).alias("rows"),
                                       F.count_if(F.col("one") == F.col("two")).alias("equal_rows"))
