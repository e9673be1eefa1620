"""Helpers shared by the operators: gapless numbering without one task per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tablewright.session import settle


def join_keys(left: DataFrame, right: DataFrame, names: list[str], how: str = "inner") -> DataFrame:
    """Join on columns of the same names, NULL to NULL as well; the names come out once, from the left."""
    renamed = right.select(*[F.col(c).alias(f"_right_{c}" if c in names else c) for c in right.columns])
    condition = F.lit(True)
    for name in names:
        condition = condition & F.col(name).eqNullSafe(F.col(f"_right_{name}"))
    return left.join(renamed, condition, how).drop(*[f"_right_{name}" for name in names])


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """``df`` with ``name``: 0, 1, 2, ... within each key, by ``order``, NULLs first.

    Rows are range partitioned by key and order, so that a key with a third of all rows covers many
    tasks. Each row's place in its own partition is written down with the row; the places before it come
    from one count per partition and key, a table no longer than partitions plus keys. ``df`` is written
    out once, so it should be narrow.
    """
    sort = [*keys, *order]
    placed = settle(df.repartitionByRange(*sort).sortWithinPartitions(*sort)
                    .withColumn("_at", F.monotonically_increasing_id())
                    .withColumn("_part", F.shiftright("_at", 33)))
    runs = placed.groupBy("_part", *keys).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("_base", F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first"))
    joined = join_keys(placed, runs.drop("_rows", "_first"), ["_part", *keys])
    return joined.select(*df.columns, (F.col("_at") + F.col("_base")).alias(name))


def slices(lengths, limit: int):
    """Ranges (start, end) of neighbouring rows whose lengths sum to ``limit`` at most; a longer row stands alone."""
    start = total = 0
    for row, length in enumerate(lengths):
        if total and total + length > limit:
            yield start, row
            start, total = row, 0
        total += length
    if start < len(lengths):
        yield start, len(lengths)


def hash_share(column: str, share: float) -> Column:
    """True for about ``share`` of the values of a column, always the same ones."""
    return F.pmod(F.xxhash64(column), F.lit(1 << 40)) < int(share * (1 << 40))


def fresh_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
