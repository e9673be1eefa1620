"""Own estimators and models, saved and loaded again."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.util import MLWritable

from tablewright.models.algebra import LinearScores
from tablewright.models.linear import LinearSearch
from tablewright.models.mlp import NetworkClassifier, Network
from tablewright.models.saving import Packed, Saved
from tablewright.models.trees import ExtraTrees
from tablewright.models.zoo import Sizes, classifiers, regressors

SMALL = Sizes(trees=4, depth=3, rounds=2, leaves=4, adaptive=2, steps=10)
DRAW = np.random.default_rng(3)
TABLE = pd.DataFrame({"id": range(80), "kind": list("abcd") * 20, "x": DRAW.normal(size=80), "z": DRAW.normal(size=80)})
TABLE["label"] = (TABLE["x"] + (TABLE["kind"] == "a") > 0.3).astype(float)


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(TABLE)


def stages(model):
    return [StringIndexer(inputCol="kind", outputCol="code"), VectorAssembler(inputCols=["x", "z", "code"], outputCol="raw"),
            StandardScaler(inputCol="raw", outputCol="features"), model]


def predictions(model, rows):
    return [r["prediction"] for r in model.transform(rows).orderBy("id").select("prediction").collect()]


@pytest.mark.parametrize("name", list(classifiers()))
def test_classifiers_behind_an_encoder_and_a_scaler(rows, tmp_path, name):
    pipeline = Pipeline(stages=stages(classifiers(SMALL)[name](2, "id")))
    model = pipeline.fit(rows)
    model.write().save(str(tmp_path / "m"))
    loaded = PipelineModel.load(str(tmp_path / "m"))
    assert predictions(loaded, rows) == predictions(model, rows)
    assert type(loaded.stages[-1]) is type(model.stages[-1]) and loaded.stages[-1].uid == model.stages[-1].uid


@pytest.mark.parametrize("name", [n for n in regressors() if n not in ("linear", "huber", "dt", "rf", "unbagged", "gbt")])
def test_regressors(rows, tmp_path, name):
    model = Pipeline(stages=stages(regressors(SMALL)[name](0, "id"))).fit(rows)
    model.write().save(str(tmp_path / "m"))
    assert predictions(PipelineModel.load(str(tmp_path / "m")), rows) == predictions(model, rows)


def test_networks_and_estimators(rows, tmp_path):
    pipeline = Pipeline(stages=stages(NetworkClassifier(epochs=2, batch=16)))
    model = pipeline.fit(rows)
    model.write().overwrite().save(str(tmp_path / "m"))
    loaded = PipelineModel.load(str(tmp_path / "m"))
    assert predictions(loaded, rows) == predictions(model, rows) and isinstance(loaded.stages[-1], Network)
    pipeline.write().save(str(tmp_path / "p"))
    again = Pipeline.load(str(tmp_path / "p"))
    assert predictions(again.fit(rows), rows) == predictions(model, rows)
    search = LinearSearch("fold", [0.1], [1.0])
    search.write().save(str(tmp_path / "s"))
    assert vars(LinearSearch.load(str(tmp_path / "s")))["penalties"] == [0.1]
    ExtraTrees(seed=9).save(str(tmp_path / "e"))
    assert ExtraTrees.load(str(tmp_path / "e")).seed == 9


def test_an_older_model_is_kept(tmp_path, spark):
    model = LinearScores(np.eye(2), np.zeros(2))
    assert isinstance(model, (Saved, MLWritable))
    model.save(str(tmp_path / "m"))
    with pytest.raises(Exception, match="exist"):
        model.save(str(tmp_path / "m"))
    assert (LinearScores.load(str(tmp_path / "m")).weights == np.eye(2)).all()
    with pytest.raises(TypeError):
        Packed().put(object())
