"""Train/test CSV pairs: reading, writing, and finding them under a root folder."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

TRAIN, TEST = "train", "test"


@dataclass(frozen=True)
class TablePair:
    """A training table and a test table of one experiment."""

    train: DataFrame
    test: DataFrame

    def map(self, change) -> TablePair:
        return TablePair(change(self.train), change(self.test))


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
             sentinels: str | None = "?", multi_line: bool = True) -> DataFrame:
    """A CSV file with a header row. Without a schema types are inferred with ``sentinels`` as NULL,
    so that one ``?`` does not turn a numeric column into text.

    With ``multi_line`` a quoted text may hold line breaks; a file is then one task. Without it a single
    huge file is split, and no text may hold a line break.
    """
    reader = (spark.read.option("header", True).option("escape", '"').option("multiLine", multi_line)
              .option("nullValue", sentinels or ""))
    if schema is not None:
        return reader.option("enforceSchema", False).schema(schema).csv(path)
    return reader.option("inferSchema", True).csv(path)


WHOLE = ("tinyint", "smallint", "int", "bigint")


def wider(one: T.DataType, two: T.DataType) -> T.DataType:
    """A type that holds the values of both: the wider number, the finer time, else text."""
    if one == two:
        return one
    names = {one.simpleString(), two.simpleString()}
    if names <= set(WHOLE):
        return max(one, two, key=lambda kind: WHOLE.index(kind.simpleString()))
    if isinstance(one, T.NumericType) and isinstance(two, T.NumericType):
        return T.DoubleType()
    if names == {"date", "timestamp"}:
        return T.TimestampType()
    return T.StringType()


def read_pair(spark: SparkSession, folder: str, schema: T.StructType | str | None = None,
              sentinels: str | None = "?", multi_line: bool = True) -> TablePair:
    """``train.csv`` and ``test.csv`` of a folder. Types are inferred on both; a column of both takes the
    wider type, so no value of either is lost. A column without any value takes the other table's type.
    """
    paths = f"{folder}/train.csv", f"{folder}/test.csv"
    if schema is not None:
        return TablePair(*(read_csv(spark, path, schema, sentinels, multi_line) for path in paths))
    tables = [read_csv(spark, path, None, sentinels, multi_line) for path in paths]
    known = [{f.name: f.dataType for f in table.schema.fields} for table in tables]
    shared = {name: wider(known[0][name], known[1][name]) for name in known[0] if name in known[1]}
    changed = [name for name, kind in shared.items() if kind != known[0][name] or kind != known[1][name]]
    if changed:
        valued = [table.agg(*(F.count(F.col(f"`{name}`")).alias(f"n{i}") for i, name in enumerate(changed))).first() for table in tables]
        for i, name in enumerate(changed):
            for own, other in ((0, 1), (1, 0)):
                if not valued[own][f"n{i}"]:
                    shared[name] = known[other][name]
    typed = [T.StructType([T.StructField(f.name, shared.get(f.name, f.dataType)) for f in table.schema.fields]) for table in tables]
    return TablePair(*(table if table.schema == kind else read_csv(spark, path, kind, sentinels, multi_line)
                       for table, kind, path in zip(tables, typed, paths)))


def write_csv(df: DataFrame, path: str) -> None:
    """Write with a header and no index; folders are made as needed. Each task writes its own part."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_pair(pair: TablePair, folder: str) -> None:
    write_csv(pair.train, f"{folder}/train.csv")
    write_csv(pair.test, f"{folder}/test.csv")


def experiment_name(path: Column) -> Column:
    """The name of the folder a file lies in."""
    return F.element_at(F.split(path, "/"), -2)


def discover_pairs(spark: SparkSession, root: str) -> DataFrame:
    """(path, train_path, test_path, scenario) of every folder holding both files, sorted by path.

    ``train.csv`` may be one file or a folder of part files. Only paths are listed, no content is read.
    """
    try:
        files = (spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
                 .select(F.regexp_replace("path", "^file:/+", "/").alias("path")))
    except AnalysisException:
        return spark.createDataFrame([], "path string, train_path string, test_path string, scenario string")
    found = F.regexp_extract("path", r"^(.*)/(train|test)\.csv(?:/[^/]*)?$", 2)
    folder = F.regexp_extract("path", r"^(.*)/(train|test)\.csv(?:/[^/]*)?$", 1)
    return (files.select(folder.alias("path"), found.alias("part")).filter(F.col("part") != "")
            .groupBy("path").agg(F.bool_or(F.col("part") == TRAIN).alias("has_train"),
                                 F.bool_or(F.col("part") == TEST).alias("has_test"))
            .filter("has_train AND has_test")
            .select("path", F.concat("path", F.lit("/train.csv")).alias("train_path"),
                    F.concat("path", F.lit("/test.csv")).alias("test_path"),
                    experiment_name(F.concat("path", F.lit("/train.csv"))).alias("scenario"))
            .orderBy("path"))
