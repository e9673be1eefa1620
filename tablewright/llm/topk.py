"""Exact top-k search by integer inner product, with block-at-a-time pruning.

Vectors are sorted by vec_id and cut into tiles of ``TILE`` rows, one binary row each, and a tile into document-range
blocks of ``BLOCK`` vectors, whose values lie together (the block's forward index). A dimension is a term: a block keeps
the largest and smallest value of every dimension. For a query the sum over dimensions of weight times the better of the
two bounds every score in the block. A query takes the blocks of a tile by falling bound and scores them whole, until the
bound falls below its k-th score so far.

Queries are packed the same way. Every packet of queries meets every tile, in blocks: both sides are bounded, and each
meeting returns k rows per query, from which a window takes the best. Scores are exact: products are summed in doubles
while they stay below 2^53, in Python's whole numbers beyond.

Rows without vec_id, and vectors that are NULL or hold a NULL or non-finite value, take no part. Of several rows with one
vec_id the one with the smallest vector counts. Vectors of different lengths are compared over the shorter length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from tablewright.session import settle, ship_package

TILE = 8_192
BLOCK = 128
SCALE = 256


def usable(vector: str) -> Column:
    return F.col(vector).isNotNull() & F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))


def packets(vectors: DataFrame, name: str) -> DataFrame:
    """``name``, ids, width, values: packets of neighbouring vectors as bytes; values are floor(256 * x) as doubles."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, last = TaskContext.get().partitionId() << 32, None
        ids: list[int] = []
        rows: list[np.ndarray] = []

        def packet() -> pa.RecordBatch:
            width = max(len(r) for r in rows)
            values = np.zeros((len(rows), width))
            for row, value in zip(values, rows):
                row[:len(value)] = value
            return pa.RecordBatch.from_pydict({
                name: pa.array([made], pa.int64()), "ids": pa.array([np.array(ids, np.int64).tobytes()], pa.binary()),
                "width": pa.array([width], pa.int32()), "values": pa.array([values.tobytes()], pa.binary())})

        for batch in batches:
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            scaled = np.floor(SCALE * flat)
            ends = np.cumsum(batch.column(1).value_lengths().to_numpy(zero_copy_only=False))
            for vec_id, row in zip(batch.column(0).to_pylist(), np.split(scaled, ends[:-1])):
                if vec_id == last:
                    continue
                last = vec_id
                ids.append(vec_id)
                rows.append(row)
                if len(ids) == TILE:
                    yield packet()
                    made, ids, rows = made + 1, [], []
        if ids:
            yield packet()

    return (vectors.repartitionByRange("vec_id").sortWithinPartitions("vec_id", "embedding")
            .mapInArrow(pack, f"{name} bigint, ids binary, width int, values binary"))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of rows that hold whole numbers."""
    most = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * a.shape[1]
    if most < 2 ** 53:
        return a @ b.T
    whole = np.frompyfunc(int, 1, 1)
    return whole(a).dot(whole(b).T)


def search(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, values: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of the query, place of the vector, score) of the k best of each query, ties to smaller places."""
    width = min(queries.shape[1], values.shape[1])
    queries, values = queries[:, :width], values[:, :width]
    starts = np.arange(0, len(ids), BLOCK)
    high, low = np.maximum.reduceat(values, starts), np.minimum.reduceat(values, starts)
    # Bounds are rounded up by a margin beyond any rounding of sums in doubles.
    bounds = np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T
    bounds += np.abs(bounds) * 1e-12 + 1e-6
    order = np.argsort(-bounds, axis=1, kind="stable")
    exact = np.abs(queries).max(initial=0) * np.abs(values).max(initial=0) * max(width, 1) < 2 ** 53
    score = np.full((len(queries), k), -np.inf if exact else None, dtype=float if exact else object)
    place = np.full((len(queries), k), len(ids))
    kth = np.full(len(queries), -np.inf)
    for turn in range(len(starts)):
        block = order[:, turn]
        alive = np.flatnonzero(bounds[np.arange(len(queries)), block] >= kth)
        if not len(alive):
            break
        for b in np.unique(block[alive]):
            rows = alive[block[alive] == b]
            inside = np.arange(starts[b], min(starts[b] + BLOCK, len(ids)))
            found = products(queries[rows], values[inside])
            own = query_ids[rows][:, None] == ids[inside]
            if exact:
                found = np.where(own, -np.inf, found)
                if found.shape[1] > k:      # nothing below the block's own k-th score can enter
                    least = np.partition(found, found.shape[1] - k, axis=1)[:, -k]
                    enter = np.flatnonzero((found >= np.maximum(kth[rows], least)[:, None]).any(axis=1))
                    rows, found = rows[enter], found[enter]
                if not len(rows):
                    continue
                both = np.concatenate([score[rows], found], axis=1)
                where = np.concatenate([place[rows], np.broadcast_to(inside, found.shape)], axis=1)
                best = np.lexsort((where, -both), axis=1)[:, :k]
                score[rows], place[rows] = np.take_along_axis(both, best, 1), np.take_along_axis(where, best, 1)
                kth[rows] = score[rows][:, -1]
            else:
                for at, row in enumerate(rows):
                    old = [(-s, p) for s, p in zip(score[row], place[row]) if s is not None]
                    new = [(-s, p) for s, p, o in zip(found[at], inside, own[at]) if not o]
                    best = sorted(old + new)[:k]
                    for slot, (s, p) in enumerate(best):
                        score[row, slot], place[row, slot] = -s, p
                    kth[row] = float(-best[-1][0]) - abs(float(best[-1][0])) * 1e-12 if len(best) == k else -np.inf
    q, slot = np.nonzero(place < len(ids))
    kept = np.array([s is not None and s != -np.inf for s in score[q, slot]], bool)
    q, slot = q[kept], slot[kept]
    return q, place[q, slot], score[q, slot]


def top_k(vectors: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` best rows for every row whose vec_id is divisible by ``every``."""
    if k < 1 or every < 1:
        raise ValueError("k and every must be positive")
    spark = vectors.sparkSession
    ship_package(spark)
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding").filter(
        F.col("vec_id").isNotNull() & usable("embedding"))
    tiles = settle(packets(rows, "tile"))
    asked = settle(packets(rows.filter(F.col("vec_id") % every == 0), "packet"))
    # Every tile names the packets it meets: one number for each TILE queries.
    names = [row["packet"] for row in asked.select("packet").orderBy("packet").collect()]
    pairs = tiles.select("tile", F.explode(F.array(*[F.lit(n) for n in names]).cast("array<bigint>")).alias("packet"))
    asked = asked.select("packet", F.col("ids").alias("query_ids"), F.col("width").alias("query_width"), F.col("values").alias("queries"))
    met = pairs.join(tiles, "tile").join(asked, "packet").select("ids", "width", "values", "query_ids", "query_width", "queries")

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                part = {c: batch.column(c)[row].as_py() for c in batch.schema.names}
                ids, query_ids = np.frombuffer(part["ids"], np.int64), np.frombuffer(part["query_ids"], np.int64)
                values = np.frombuffer(part["values"]).reshape(len(ids), part["width"])
                queries = np.frombuffer(part["queries"]).reshape(len(query_ids), part["query_width"])
                q, place, score = search(query_ids, queries, ids, values, k)
                yield pa.RecordBatch.from_pydict({
                    "query_id": pa.array(query_ids[q]), "vec_id": pa.array(ids[place]),
                    "score": pa.array([int(s) for s in score], pa.int64())})

    found = met.mapInArrow(best, "query_id bigint, vec_id bigint, score bigint")
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
