"""Sharding by longest-processing-time scheduling: groups that must stay together go, largest first, to the
least-loaded shard through a heap.

One heap over all groups would be one task. So the work is cut where it does not change the balance:

* Large groups, at least ``1 / (shards * FINE)`` of all bytes, number ``shards * FINE`` at most. They are
  scheduled on the driver, so a group with a third of all bytes gets a shard of its own.
* All others are cut by falling size into runs of about ``RUN_ROWS`` groups. A run's total is known before it
  is scheduled, and least-loaded filling levels the shards, so the loads with which each run starts follow
  from the totals before it (``fill``). Every run then has its own heap, in its own task; it ends level up to
  the size of one of its groups.

Law ``bytes``: shard sizes are near equal. Equal texts form a group; NULL and empty texts are one group too.
A document weighs its UTF-8 bytes plus 8. Rows keep a gapless slot in their shard, by ``doc_id``.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tablewright.llm.common import join_keys, numbered
from tablewright.session import settle

FINE = 1_000          # a large group holds this fraction of a shard's share, or more
RUN_ROWS = 100_000    # groups in a run, about
GROUP = ["size", "text_crc32", "_hash"]


def fill(loads: list[int], amount: int) -> list[int]:
    """Loads after ``amount`` is poured on the least loaded, as a heap of small groups does."""
    order = sorted(range(len(loads)), key=loads.__getitem__)
    after, left = list(loads), amount
    for n, shard in enumerate(order, start=1):
        above = loads[order[n]] if n < len(order) else None
        level = loads[shard]
        room = (above - level) * n if above is not None else None
        if room is None or left <= room:
            share, odd = divmod(left, n)
            for k, chosen in enumerate(order[:n]):
                after[chosen] = level + share + (k < odd)
            return after
        left -= room
    return after


def lpt(sizes: list[int], loads: list[int]) -> list[int]:
    """The shard of each size, in the order given (falling), by a heap that starts with ``loads``."""
    heap = [(load, shard) for shard, load in enumerate(loads)]
    heapq.heapify(heap)
    chosen = []
    for size in sizes:
        load, shard = heap[0]
        heapq.heapreplace(heap, (load + size, shard))
        chosen.append(shard)
    return chosen


def assign_groups(groups: DataFrame, keys: list[str], size: str, shards: int) -> DataFrame:
    """(keys, shard) for a table of groups with a size each; keys are unique, sizes positive integers."""
    spark = groups.sparkSession
    total = groups.agg(F.sum(size)).first()[0] or 0
    least = max(1, -(-total // (shards * FINE)))
    order = [F.desc(size), *keys]
    large = groups.filter(F.col(size) >= least).select(*keys, size).orderBy(*order).collect()
    chosen = lpt([row[size] for row in large], [0] * shards)
    loads = [0] * shards
    for row, shard in zip(large, chosen):
        loads[shard] += row[size]
    schema = groups.select(*keys).schema.add("shard", "integer")
    first = spark.createDataFrame([(*row[:-1], shard) for row, shard in zip(large, chosen)], schema)

    small = groups.filter(F.col(size) < least).select(*keys, size)
    runs = max(1, -(-small.count() // RUN_ROWS))
    small = settle(small.repartitionByRange(runs, *order).withColumn("_run", F.spark_partition_id()))
    starts: dict[int, list[int]] = {}
    for row in small.groupBy("_run").agg(F.sum(size).alias("total")).orderBy("_run").collect():
        starts[row["_run"]] = loads
        loads = fill(loads, row["total"])

    def schedule(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([size, *keys], ascending=[False, *[True] * len(keys)], kind="stable")
        return rows[keys].assign(shard=lpt(rows[size].tolist(), starts[int(rows["_run"].iat[0])]))

    return first.unionByName(small.groupBy("_run").applyInPandas(schedule, schema))


def assign_shards(docs: DataFrame, shards: int = 24) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (NULL under this law) for every row of ``docs``."""
    if shards < 1:
        raise ValueError("at least one shard")
    text = F.coalesce("text", F.lit(""))
    rows = settle(docs.select("doc_id", (F.octet_length(text) + F.lit(8)).cast("bigint").alias("size"),
                              F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("_hash")))
    groups = settle(rows.groupBy(*GROUP).agg(F.sum("size").alias("_bytes")))
    placed = rows.join(assign_groups(groups, GROUP, "_bytes", shards), GROUP)
    slots = numbered(placed.select("doc_id", "size", "text_crc32", "shard"), ["shard"], ["doc_id"], "slot")
    return slots.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                        F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, shards: int = 24) -> None:
    """Write ``docs`` under ``path``, a folder for each shard. Rows of one doc_id stay in its first shard."""
    places = assign_shards(docs, shards).groupBy("doc_id").agg(F.min("shard").alias("_shard"))
    join_keys(docs, places, ["doc_id"]).write.partitionBy("_shard").parquet(path)
