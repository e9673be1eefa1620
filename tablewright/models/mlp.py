"""Data-parallel training of the multilayer perceptron.

Each epoch is one Spark job: every worker runs the mini-batch loop over its own rows, starting from the shared weights, and
sends back its weights as one block; blocks are added up in a tree, in the order of workers, and averaged by rows (parallel SGD:
Zinkevich and others, 2010). With one worker this is the plain sequential loop.

Every worker has a partition of its own, so that no task trains several in turn while other cores wait. Workers beyond the cores
share tasks: theirs come mixed by place and are trained side by side, a batch of each in one step (``Crew``).

A row's worker comes from a hash of the row, and its place in an epoch from a hash of the row and the epoch, by which Spark
sorts each worker's rows. Partitions, files and cores therefore change nothing: the same rows give the same weights.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml import Estimator, Model
from pyspark.sql import DataFrame, SparkSession, functions as F

from tablewright.models.features import LABEL, PREDICTION, SCORES, argmax, feature_array
from tablewright.models.network import (RATE_FACTOR, RATE_STEP, LEARNING_RATE, Adam, Architecture, batch_edges,
                                        gradient, predict, softmax)
from tablewright.models.saving import Saved
from tablewright.schema import CLASSIFICATION, REGRESSION
from tablewright.session import settle_partitions, ship_package

EPOCHS, BATCH, SEED = 100, 32, 123       # fixed values: the study's defaults and seed
WORKER_ROWS = 50_000                     # rows for each worker, if their number is not given
SIDE = 8                                 # workers that one task trains side by side, at most
HELD = 8_192                             # rows that a worker holds while it waits for the others of its task
FAN = 16                                 # blocks that one task of the tree adds up
BLOCKS = "worker long, state binary, rows double, losses double, batches double, right double"
BLOCK_NAMES = [part.split()[0] for part in BLOCKS.split(", ")]


def learning_rate(epoch: int) -> float:
    return LEARNING_RATE * RATE_FACTOR ** (epoch // RATE_STEP)


def shares(tables: Iterator[pd.DataFrame]) -> Iterator[list[tuple[int, np.ndarray, np.ndarray]]]:
    """The rows of each worker in a piece, in their order: its number, features, labels."""
    for table in tables:
        if not len(table):
            continue
        worker, x, y = table["worker"].to_numpy(), np.stack(table["x"].to_numpy()).astype(float), table["y"].to_numpy(dtype=float)
        order = np.argsort(worker, kind="stable")
        edges = [0, *(np.flatnonzero(np.diff(worker[order])) + 1).tolist(), len(order)]
        yield [(int(worker[order[a]]), x[order[a:b]], y[order[a:b]]) for a, b in zip(edges[:-1], edges[1:])]


class Worker:
    """The mini-batch loop of one worker, rows fed as they come; a last batch of one row joins the one before."""

    def __init__(self, net: Architecture, shared: tuple, batch: int, rate: float, random: np.random.Generator):
        weights, first, second, steps = shared
        self.net, self.batch, self.rate, self.random = net, batch, rate, random
        self.weights, self.adam = weights.copy(), Adam(len(first), first.copy(), second.copy(), steps)
        self.held: list[tuple[np.ndarray, np.ndarray]] = []
        self.waiting = self.rows = self.batches = self.right = 0
        self.losses = 0.0

    def feed(self, x: np.ndarray, y: np.ndarray) -> None:
        self.hold(x, y)
        self.work()

    def hold(self, x: np.ndarray, y: np.ndarray) -> None:
        self.held.append((x, y))
        self.waiting += len(y)

    @property
    def whole(self) -> int:
        """Whole batches that are held, so that two rows at least are left."""
        return max(self.waiting - 2, 0) // self.batch

    def take(self, rows: int) -> tuple[np.ndarray, np.ndarray]:
        """The first of the rows held."""
        x, y = (np.concatenate(parts) for parts in zip(*self.held))
        self.held, self.waiting = [(x[rows:], y[rows:])], len(y) - rows
        return x[:rows], y[:rows]

    def work(self) -> None:
        """Train on the whole batches held."""
        if self.whole:
            x, y = self.take(self.whole * self.batch)
            for at in range(0, len(y), self.batch):
                self.learn(x[at:at + self.batch], y[at:at + self.batch])

    def learn(self, x: np.ndarray, y: np.ndarray) -> None:
        loss, out, slopes = gradient(self.net, self.weights, x, y, self.random)
        self.adam.step(self.weights, slopes, self.rate)
        self.losses, self.batches, self.rows = self.losses + float(loss), self.batches + 1, self.rows + len(y)
        if self.net.task == CLASSIFICATION:
            self.right += int((out.argmax(axis=1) == y).sum())

    def block(self, number: int) -> tuple:
        """What is left is trained on, and all is handed in: the state weighed by its rows."""
        if self.waiting:
            x, y = (np.concatenate(parts) for parts in zip(*self.held))
            for a, b in batch_edges(len(y), self.batch):
                self.learn(x[a:b], y[a:b])
        state = np.concatenate([self.weights, self.adam.first, self.adam.second, [self.adam.steps]]) * self.rows
        return number, state.tobytes(), float(self.rows), self.losses, float(self.batches), float(self.right)


class Crew:
    """The workers of one task. While all of them hold whole batches, one step trains a batch of each; the same weights come out."""

    def __init__(self, hire: Callable[[int], Worker]):
        self.hire, self.workers, self.stacked = hire, {}, 0

    def feed(self, parts: list[tuple[int, np.ndarray, np.ndarray]]) -> None:
        for number, x, y in parts:
            if number not in self.workers:
                self.workers[number] = self.hire(number)
            self.workers[number].hold(x, y)
        crew = list(self.workers.values())
        if len(crew) > 1:
            self.work(crew)
        for worker in crew:
            if len(crew) == 1 or worker.waiting > HELD:
                worker.work()

    def work(self, crew: list[Worker]) -> None:
        """As many batches as all hold."""
        steps = min(worker.whole for worker in crew)
        if not steps:
            return
        if self.stacked != len(crew):
            self.stack(crew)
        one = crew[0]
        x, y = (np.stack(parts) for parts in zip(*(worker.take(steps * one.batch) for worker in crew)))
        adam = Adam(0, self.first, self.second, [worker.adam.steps for worker in crew])
        randoms, losses, right = [worker.random for worker in crew], np.array([worker.losses for worker in crew]), 0
        for at in range(0, y.shape[1], one.batch):
            now = y[:, at:at + one.batch]
            loss, out, slopes = gradient(one.net, self.weights, x[:, at:at + one.batch], now, randoms)
            adam.step(self.weights, slopes, one.rate)
            losses += loss
            if one.net.task == CLASSIFICATION:
                right += (out.argmax(axis=-1) == now).sum(axis=-1)
        for place, worker in enumerate(crew):
            worker.adam.steps = adam.steps[place]
            worker.losses = float(losses[place])
            worker.batches += steps
            worker.rows += steps * worker.batch
            worker.right += int(right[place]) if one.net.task == CLASSIFICATION else 0

    def stack(self, crew: list[Worker]) -> None:
        """The states as rows of common matrices, which the workers go on using."""
        self.weights, self.first, self.second = (np.stack(parts) for parts in zip(*(
            (worker.weights, worker.adam.first, worker.adam.second) for worker in crew)))
        for worker, weights, first, second in zip(crew, self.weights, self.first, self.second):
            worker.weights, worker.adam.first, worker.adam.second = weights, first, second
        self.stacked = len(crew)

    def blocks(self) -> pd.DataFrame:
        for worker in self.workers.values():
            worker.work()
        return pd.DataFrame([self.workers[number].block(number) for number in sorted(self.workers)], columns=BLOCK_NAMES)


def added(blocks: pd.DataFrame) -> pd.DataFrame:
    """One block for many, added up in the order of workers."""
    blocks = blocks.sort_values("worker")
    state = np.zeros(len(blocks["state"].iloc[0]) // 8)
    for part in blocks["state"]:
        state += np.frombuffer(part)
    sums = {c: [float(blocks[c].sum())] for c in ("rows", "losses", "batches", "right")}
    return pd.DataFrame({"worker": [int(blocks["worker"].iloc[0])], "state": [state.tobytes()], **sums})


class Trainer(Saved, Estimator):
    """Settings of a training run; ``fit`` takes (features, label) rows."""

    task = CLASSIFICATION

    def __init__(self, epochs: int = EPOCHS, batch: int = BATCH, seed: int = SEED, workers: int | None = None):
        super().__init__()
        self.epochs, self.batch, self.seed, self.workers = epochs, batch, seed, workers

    def outputs(self, labels: int, highest: float) -> int:
        return 1

    def _fit(self, df: DataFrame) -> Network:
        spark = df.sparkSession
        ship_package(spark)
        rows = df.select(feature_array().cast("array<float>").alias("x"), F.col(LABEL).alias("y"))
        classes = F.count_distinct("y") if self.task == CLASSIFICATION else F.lit(0)
        found = rows.agg(F.count(F.lit(1)).alias("rows"), F.max(F.size("x")).alias("features"),
                         F.max("y").alias("highest"), classes.alias("labels")).first()
        if not found["rows"]:
            raise ValueError("the table is empty")
        net = Architecture(found["features"], self.outputs(found["labels"], found["highest"]), self.task)
        workers = self.workers or math.ceil(found["rows"] / WORKER_ROWS)
        placed = rows.withColumn("worker", F.pmod(F.xxhash64(F.lit(self.seed), "x", "y"), F.lit(workers)))
        data = settle_partitions(placed.repartitionById(workers, F.col("worker").cast("int")))
        vector, size = net.initial(self.seed), net.trained_size()
        adam, history = Adam(size), []
        for epoch in range(self.epochs):
            vector, adam, scores = self.run_epoch(data, net, vector, adam, epoch, workers)
            history.append((epoch + 1, *scores, learning_rate(epoch)))
        return Network(net, vector, history)

    def run_epoch(self, data: DataFrame, net: Architecture, vector: np.ndarray, adam: Adam, epoch: int,
                  workers: int) -> tuple[np.ndarray, Adam, tuple[float, float | None]]:
        shared = data.sparkSession.sparkContext.broadcast((vector, adam.first, adam.second, adam.steps))
        batch, seed, rate = self.batch, self.seed, learning_rate(epoch)

        def train(tables: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            crew = Crew(lambda number: Worker(net, shared.value, batch, rate, np.random.default_rng([seed, epoch, number])))
            for parts in shares(tables):
                crew.feed(parts)
            if crew.workers:
                yield crew.blocks()

        # Mixed by place, the workers of a task go on at one pace. All cores are busy before any trains several.
        order = F.xxhash64(F.lit(seed), F.lit(epoch), "x", "y")
        tasks = max(min(workers, data.sparkSession.sparkContext.defaultParallelism), math.ceil(workers / SIDE))
        blocks, left = data.coalesce(tasks).sortWithinPartitions(order).mapInPandas(train, BLOCKS), workers
        while left > FAN:
            group = F.floor(F.col("worker") / F.lit(FAN))
            blocks, left = blocks.groupBy(group.alias("_group")).applyInPandas(added, BLOCKS).withColumn("worker", group), math.ceil(left / FAN)
        whole = added(blocks.toPandas()).iloc[0]
        shared.unpersist()
        state = np.frombuffer(whole["state"]) / whole["rows"]
        edges = np.cumsum([len(vector), len(adam.first), len(adam.second)])
        new, first, second, steps = np.split(state, edges)
        accuracy = float(100.0 * whole["right"] / whole["rows"]) if self.task == CLASSIFICATION else None
        return (new.copy(), Adam(len(first), first.copy(), second.copy(), int(round(steps[0]))),
                (float(whole["losses"] / whole["batches"]), accuracy))


class NetworkClassifier(Trainer):
    """Cross-entropy training with one output per distinct label; labels are 0, 1, ... without gaps."""

    task = CLASSIFICATION

    def outputs(self, labels: int, highest: float) -> int:
        if highest != labels - 1:
            raise ValueError("class labels must be 0, 1, ... without gaps")
        return labels


class NetworkRegressor(Trainer):
    task = REGRESSION


class Network(Saved, Model):
    """Trained weights; scoring is a vectorized function of the feature column alone."""

    def __init__(self, net: Architecture, vector: np.ndarray, history: list[tuple] = ()):
        super().__init__()
        self.net, self.vector, self.epochs_run = net, vector, list(history)

    def _transform(self, df: DataFrame) -> DataFrame:
        ship_package(df.sparkSession)
        shared = df.sparkSession.sparkContext.broadcast((self.net, self.vector))

        @F.pandas_udf("array<double>")
        def outputs(x: pd.Series) -> pd.Series:
            net, vector = shared.value
            out = predict(net, vector, np.stack(x.to_numpy()).astype(float))
            return pd.Series(list(softmax(out) if net.task == CLASSIFICATION else out))

        found = df.withColumn(SCORES, outputs(feature_array()))
        if self.net.task == CLASSIFICATION:
            return found.withColumn(PREDICTION, argmax(F.col(SCORES)).cast("double"))
        return found.withColumn(PREDICTION, F.get(SCORES, F.lit(0))).drop(SCORES)

    def history(self, spark: SparkSession, scenario: str) -> DataFrame:
        """(scenario, epoch, loss, accuracy, rate): mean batch loss, percent right for classes, learning rate."""
        rows = [(scenario, *r) for r in self.epochs_run]
        return spark.createDataFrame(rows, "scenario string, epoch int, loss double, accuracy double, rate double")

    def save_to(self, spark: SparkSession, path: str) -> None:
        row = (json.dumps(self.net.info()), [float(v) for v in self.vector])
        (spark.createDataFrame([row], "architecture string, weights array<double>")
         .coalesce(1).write.mode("overwrite").parquet(path))

    @classmethod
    def load_from(cls, spark: SparkSession, path: str) -> Network:
        row = spark.read.parquet(path).first()
        info = json.loads(row["architecture"])
        net = Architecture(info["input_size"], info["output_size"], info["task_type"], info["hidden_sizes"],
                           info["dropout_rates"])
        return cls(net, np.array(row["weights"]))
