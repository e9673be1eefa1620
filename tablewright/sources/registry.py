"""The study's datasets and the folder layout of their inputs, results and models."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tablewright.schema import CLASSIFICATION, REGRESSION, check_task

# The registered datasets as (name, task, target).
DATASETS = (
    ("census_income", CLASSIFICATION, "salary"),
    ("bank_marketing", CLASSIFICATION, "subscribe"),
    ("bike_sharing", REGRESSION, "cnt"),
    ("house_price", REGRESSION, "price"),
)


@dataclass(frozen=True)
class Layout:
    """Where one dataset's files go under a root folder."""

    root: str
    task: str
    name: str

    def __post_init__(self) -> None:
        check_task(self.task)

    @property
    def datasets(self) -> str:
        return f"{self.root}/datasets/{self.task}/{self.name}"

    @property
    def results(self) -> str:
        return f"{self.root}/results/{self.task}/{self.name}"

    def model(self, epochs: int) -> str:
        return f"{self.root}/model/{self.task}/{self.name}/epochs_{epochs}"


def registry(spark: SparkSession, root: str = ".") -> DataFrame:
    """(name, task, target, folder) of the registered datasets."""
    return spark.createDataFrame([(n, t, g, Layout(root, t, n).datasets) for n, t, g in DATASETS],
                                 "name string, task string, target string, folder string")
