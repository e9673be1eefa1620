"""Mixing sources to target weights by Pfair scheduling.

Rows of a source form blocks of ``block_rows`` in order of doc_id. With a source of weight w, its block j is
released at slot floor(j / w) and due by slot ceil((j + 1) / w). Earliest deadline first fills every slot, so
that in any prefix of the order each source is less than one block away from its target share.

Weights are taken exactly, as whole shares of one long period, so the bound holds for the targets themselves at
every length. When a source runs out of blocks, the others go on by their weights: a new phase begins, with as
many phases as sources. Every row is placed. The driver sees one count for each source and deals the blocks one
by one, ``period`` slots to a row of the plan, without reading any row; the plan is handed to Spark in parts of
``HELD`` slots, and joined by source and block.

A NULL source is a source like any other. Positions count from 0 without gaps.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator, Mapping
from fractions import Fraction
from functools import reduce
from itertools import islice

from pyspark.sql import DataFrame, SparkSession, functions as F

from tablewright.llm.common import join_keys, numbered
from tablewright.session import settle

PERIOD = 1_024            # slots in a row of the plan
HELD = 1 << 20            # slots of the plan that the driver holds at a time
PLAN = ("source string, phase int, first_block bigint, end_block bigint, slot_base bigint, row_base bigint, "
        "share int, period int, slots array<bigint>")


def exact(weights: Mapping) -> dict:
    """The weights as whole numbers in exactly the same proportions."""
    parts = {source: Fraction(weight) for source, weight in weights.items()}
    common = math.lcm(*(part.denominator for part in parts.values()))
    whole = {source: int(part * common) for source, part in parts.items()}
    divisor = math.gcd(*whole.values())
    return {source: share // divisor for source, share in whole.items()}


def deal(left: Mapping, share: Mapping) -> Iterator:
    """The source of each slot by earliest deadline first, until one of them has no more of its blocks."""
    total, sources = sum(share.values()), list(left)
    weight, blocks = [share[source] for source in sources], [left[source] for source in sources]
    given = [0] * len(sources)
    waiting = [(0, rank) for rank in range(len(sources))]     # (release, source)
    ready: list[tuple[int, int]] = []                         # (deadline, source)
    slot = 0
    while True:
        while waiting and waiting[0][0] <= slot:
            _, rank = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(given[rank] + 1) * total // weight[rank]), rank))
        _, rank = heapq.heappop(ready)
        given[rank] += 1
        yield sources[rank]
        if given[rank] == blocks[rank]:
            return
        heapq.heappush(waiting, (given[rank] * total // weight[rank], rank))
        slot += 1


def phases(counts: Mapping, weights: Mapping, block_rows: int, period: int = PERIOD) -> Iterator[tuple]:
    """Rows of ``PLAN``, up to ``period`` slots each: where each source's blocks lie."""
    left = {source: -(-rows // block_rows) for source, rows in counts.items() if rows}
    begun = dict.fromkeys(left, 0)
    slot_base, row_base, phase = 0, 0, 0
    while left:
        dealt, length = deal(left, exact({source: weights[source] for source in left})), 0
        while part := list(islice(dealt, period)):
            slots: dict = {}
            for slot, out in enumerate(part, start=length):
                slots.setdefault(out, []).append(slot)
            for source, own in slots.items():
                yield (source, phase, begun[source], begun[source] + len(own), slot_base, row_base, len(own), period, own)
                begun[source] += len(own)
                left[source] -= len(own)
            length += len(part)
        del left[out]
        missing = -counts[out] % block_rows            # the phase ends with the last, partial block of ``out``
        slot_base, row_base, phase = slot_base + length, row_base + length * block_rows - missing, phase + 1


def plan_table(spark: SparkSession, rows: Iterator[tuple]) -> DataFrame:
    """source, block, phase, slot and the position of its first row, for every block of the plan."""
    tables, held, size = [], [], 0
    for row in rows:
        held.append(row)
        size += len(row[-1])
        if size >= HELD:
            tables.append(settle(spark.createDataFrame(held, PLAN)))
            held, size = [], 0
    tables.append(spark.createDataFrame(held, PLAN))
    plan = reduce(DataFrame.union, tables)
    each = plan.select("source", "phase", "first_block", "slot_base", "row_base", F.posexplode("slots").alias("_at", "_slot"))
    return each.select("source", (F.col("first_block") + F.col("_at")).alias("block"), "phase",
                       (F.col("slot_base") + F.col("_slot")).alias("slot"), "row_base", "_slot")


def positions(docs: DataFrame, weights: Mapping | None = None, block_rows: int = 16, period: int = PERIOD) -> DataFrame:
    """doc_id, source, block, phase, slot, position for every row of ``docs``.

    ``weights`` maps sources to positive numbers; without it a source weighs the square root of its rows.
    A source that ``weights`` does not name is an error, as its share is unknown.
    """
    spark = docs.sparkSession
    counts = {row["source"]: row["rows"] for row in docs.groupBy("source").agg(F.count(F.lit(1)).alias("rows"))
              .orderBy("source").collect()}
    weights = {source: rows ** 0.5 for source, rows in counts.items()} if weights is None else weights
    unknown = [source for source in counts if source not in weights]
    if unknown or any(weights[source] <= 0 for source in counts):
        raise ValueError(f"every source needs a positive weight: {unknown[:5]}")
    plan = plan_table(spark, phases(counts, weights, block_rows, period))
    rows = numbered(docs.select("doc_id", "source"), ["source"], ["doc_id"], "_row")
    rows = rows.withColumn("block", F.floor(F.col("_row") / block_rows))
    return join_keys(rows, plan, ["source", "block"]).select(
        "doc_id", "source", "block", "phase", "slot",
        (F.col("row_base") + F.col("_slot") * block_rows + F.col("_row") % block_rows).alias("position"))


def placed(docs: DataFrame, name: str, weights: Mapping | None = None, block_rows: int = 16) -> DataFrame:
    """``docs`` with ``name``, the position in the mixed order.

    Repeated rows of one doc_id and source share a place.
    """
    places = positions(docs.select("doc_id", "source").distinct(), weights, block_rows)
    places = places.select("doc_id", "source", F.col("position").alias(name))
    return join_keys(docs, places, ["doc_id", "source"])


def mixed(docs: DataFrame, weights: Mapping | None = None, block_rows: int = 16) -> DataFrame:
    """``docs`` in the mixed order: range partitioned by position and sorted, columns as they were.

    Repeated rows of one doc_id and source follow each other. Files that are read again come in any order; ``placed`` has
    the position as a column, the same one for the same rows.
    """
    ordered = placed(docs, "_position", weights, block_rows)
    return ordered.repartitionByRange("_position").sortWithinPartitions("_position").drop("_position")
