"""Saving of this package's own estimators and models, in the way of Spark's: ``write().save(path)`` and ``load(path)``.

A folder holds the metadata that Spark's readers look for, so pipelines with own stages save and load as a whole; a
table of one row with the settings as JSON and all arrays as one block; other models that the model is made of, each
in a folder of its own; and the tables it searches.
"""

from __future__ import annotations

import importlib
import io
import json
from typing import Any

import numpy as np
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession

PACKAGE = __name__.split(".")[0]
SPARKS_OWN = frozenset(["uid", "_paramMap", "_defaultParamMap", "_params", "_input_kwargs"])


class Packed:
    """The values of an object as JSON, with what JSON cannot hold put aside under numbers."""

    def __init__(self):
        self.arrays: list[np.ndarray] = []
        self.parts: list[MLWritable] = []
        self.tables: list[DataFrame] = []

    def put(self, value: Any) -> Any:
        if value is None or isinstance(value, (bool, int, float, str)):
            return value
        if isinstance(value, np.generic):
            return value.item()
        for kind, name, held in ((np.ndarray, "array", self.arrays), (MLWritable, "part", self.parts), (DataFrame, "table", self.tables)):
            if isinstance(value, kind):
                held.append(value)
                return {name: len(held) - 1}
        if isinstance(value, SparkSession):
            return {"session": True}
        if isinstance(value, (list, tuple)):
            return [self.put(v) for v in value]
        if isinstance(value, dict) and all(isinstance(k, str) for k in value):
            return {"dict": {k: self.put(v) for k, v in value.items()}}
        if type(value).__module__.split(".")[0] == PACKAGE:
            return {"object": f"{type(value).__module__}:{type(value).__qualname__}", "fields": fields(value, self)}
        raise TypeError(f"cannot save a {type(value).__name__}")


def fields(value: Any, packed: Packed) -> dict[str, Any]:
    return {name: packed.put(v) for name, v in vars(value).items() if name not in SPARKS_OWN}


class StateWriter(MLWriter):
    def __init__(self, instance: Any):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        spark, packed = self.sparkSession, Packed()
        settings = json.dumps(fields(self.instance, packed))
        block = io.BytesIO()
        np.savez_compressed(block, *packed.arrays)
        DefaultParamsWriter.saveMetadata(self.instance, path, spark)
        row = (settings, bytearray(block.getvalue()), len(packed.parts), len(packed.tables))
        spark.createDataFrame([row], "settings string, arrays binary, parts int, tables int").coalesce(1).write.parquet(f"{path}/state")
        for n, part in enumerate(packed.parts):
            part.write().save(f"{path}/parts/{n}")
        for n, table in enumerate(packed.tables):
            table.write.parquet(f"{path}/tables/{n}")


class StateReader(MLReader):
    def __init__(self, kind: type):
        super().__init__()
        self.kind = kind

    def load(self, path: str) -> Any:
        spark = self.sparkSession
        metadata = DefaultParamsReader.loadMetadata(path, spark)
        row = spark.read.parquet(f"{path}/state").first()
        arrays = np.load(io.BytesIO(bytes(row["arrays"])), allow_pickle=False)
        parts = [DefaultParamsReader.loadParamsInstance(f"{path}/parts/{n}", spark) for n in range(row["parts"])]

        def take(value: Any) -> Any:
            if isinstance(value, list):
                return [take(v) for v in value]
            if not isinstance(value, dict):
                return value
            if "array" in value:
                return arrays[f"arr_{value['array']}"]
            if "part" in value:
                return parts[value["part"]]
            if "table" in value:
                return spark.read.parquet(f"{path}/tables/{value['table']}")
            if "session" in value:
                return spark
            if "dict" in value:
                return {k: take(v) for k, v in value["dict"].items()}
            module, name = value["object"].split(":")
            if module.split(".")[0] != PACKAGE:
                raise ValueError(f"{module} is not part of {PACKAGE}")
            made = object.__new__(getattr(importlib.import_module(module), name))
            vars(made).update({k: take(v) for k, v in value["fields"].items()})
            return made

        made = object.__new__(self.kind)
        super(Saved, made).__init__()              # what Spark's own base classes set up
        vars(made).update({k: take(v) for k, v in json.loads(row["settings"]).items()})
        made._resetUid(metadata["uid"])
        return made


class Saved(MLWritable, MLReadable):
    """Put before Estimator or Model: everything the object holds can be written and read back."""

    def write(self) -> StateWriter:
        return StateWriter(self)

    @classmethod
    def read(cls) -> StateReader:
        return StateReader(cls)
