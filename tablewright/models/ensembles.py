"""Spark's forests and boosted trees, whose models do not copy every tree to the driver's Python when they are made.

PySpark looks through all attributes of a new model for parameters, and with them builds ``trees``: one object for each tree and
several calls into the JVM for each of its parameters. Here ``trees`` is left out of that and built when somebody asks for it.
"""

from __future__ import annotations

from typing import TypeVar

from pyspark.ml import classification as c, regression as r

Kind = TypeVar("Kind")


def made(kind: type[Kind], java_model) -> Kind:
    """A model of Spark's own class; a value that is there keeps the cached ``trees`` from being built meanwhile."""
    model = kind.__new__(kind)
    vars(model)["trees"] = None
    model.__init__(java_model)
    del vars(model)["trees"]
    return model


class RandomForestClassifier(c.RandomForestClassifier):
    def _create_model(self, java_model) -> c.RandomForestClassificationModel:
        return made(c.RandomForestClassificationModel, java_model)


class RandomForestRegressor(r.RandomForestRegressor):
    def _create_model(self, java_model) -> r.RandomForestRegressionModel:
        return made(r.RandomForestRegressionModel, java_model)


class GBTClassifier(c.GBTClassifier):
    def _create_model(self, java_model) -> c.GBTClassificationModel:
        return made(c.GBTClassificationModel, java_model)


class GBTRegressor(r.GBTRegressor):
    def _create_model(self, java_model) -> r.GBTRegressionModel:
        return made(r.GBTRegressionModel, java_model)
