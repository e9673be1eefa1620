"""Column statistics: moments, exact quantiles, modes and value lists at any size.

A statistic that keeps every distinct value (an exact quantile, a mode, a value list) fits one
aggregation buffer only while the distinct values are few. Each column's approximate distinct count
comes with the moments, in one pass; columns within ``VALUE_BUDGET`` are finished in one more
aggregation, the others through value counts that are range-partitioned over the cluster.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql import Window

from tablewright.functions import double_array, parse_number, ref
from tablewright.schema import is_number
from tablewright.session import settle

VALUE_BUDGET = 200_000        # distinct values, over all columns, that one aggregation buffer may hold
SKETCH_ACCURACY = 10_000      # an approximate quantile is off by at most one in this many ranks
FEW_QUANTILES = 8             # most probabilities per column that are worth brackets of their own
LISTED_VALUES = 50_000        # longest value list handed to the driver
ONE_TASK_ROWS = 1_000_000     # longest ordered run given to a single window task
RANK_BUCKETS = 1_000          # pieces a column's ranks are cut into when picking quantiles


def running_total(df: DataFrame, by: list[str], order: list[str], weight: Column, out: str,
                  one_task: bool = False) -> DataFrame:
    """Exclusive running sum of ``weight`` within ``by`` in ``order``; (by, order) must be unique.

    With ``one_task`` a plain window does it. Otherwise rows are range-partitioned, each partition
    sums up on its own, and the few partition totals carry the sums across, so no group ever has to
    fit into a single task.
    """
    before = (Window.unboundedPreceding, -1)
    start = F.lit(0).cast("bigint")
    if one_task:
        window = Window.partitionBy(*by).orderBy(*order).rowsBetween(*before)
        return df.withColumn(out, F.coalesce(F.sum(weight).over(window), start))
    parts = settle(df.repartitionByRange(*(ref(c) for c in by + order))
                   .withColumn("_part", F.spark_partition_id()))
    totals = parts.groupBy(*by, "_part").agg(F.sum(weight).alias("_total"))
    across = Window.partitionBy(*by).orderBy("_part").rowsBetween(*before)
    offsets = totals.select(*(ref(c).alias(f"_{c}") for c in by), F.col("_part").alias("_piece"),
                            F.coalesce(F.sum("_total").over(across), start).alias("_offset"))
    inside = Window.partitionBy(*by, "_part").orderBy(*order).rowsBetween(*before)
    matched = F.col("_part") == F.col("_piece")
    for c in by:
        matched = matched & ref(c).eqNullSafe(ref(f"_{c}"))
    return (parts.withColumn("_inside", F.coalesce(F.sum(weight).over(inside), start))
            .join(offsets, matched)
            .withColumn(out, F.col("_offset") + F.col("_inside"))
            .select(*df.columns, out))


def value_counts(df: DataFrame, columns: list[str], as_type: str) -> DataFrame:
    """(column, value, n) for the present values of the columns, counted before the shuffle."""
    types = {f.name: f.dataType for f in df.schema.fields}
    cast = df.select(*((parse_number(ref(c), types[c]) if as_type == "double" else ref(c).cast(as_type)).alias(c)
                       for c in columns))
    return (cast.unpivot([], [ref(c) for c in columns], "column", "value")
            .filter(F.col("value").isNotNull())
            .groupBy("column", "value").agg(F.count(F.lit(1)).alias("n")))


def moments(df: DataFrame, columns: list[str], distinct: list[str] = ()) -> dict[str, dict]:
    """Counts and numeric moments of all columns, and the asked approximate distinct counts, in one pass."""
    types = {f.name: f.dataType for f in df.schema.fields}
    wanted = [F.count(F.lit(1)).alias("rows")]
    for i, name in enumerate(columns):
        cell = ref(name)
        number = is_number(types[name])
        x = parse_number(cell, types[name]) if number else cell
        wanted.append(F.count(x).alias(f"{i}_present"))
        if name in distinct:
            wanted.append(F.approx_count_distinct(cell).alias(f"{i}_distinct"))
        if number:
            wanted += [F.avg(x).alias(f"{i}_mean"), F.stddev_pop(x).alias(f"{i}_sd"),
                       F.min(x).alias(f"{i}_low"), F.max(x).alias(f"{i}_high")]
        elif isinstance(types[name], T.StringType):
            wanted.append(F.count(parse_number(cell, types[name])).alias(f"{i}_parsed"))
    row = df.agg(*wanted).first().asDict()
    found: dict[str, dict] = {}
    for i, name in enumerate(columns):
        prefix = f"{i}_"
        stats = {k[len(prefix):]: v for k, v in row.items() if k.startswith(prefix)}
        stats["rows"] = row["rows"]
        if stats.get("sd") is not None and stats["present"] > 1:
            stats["sd_sample"] = stats["sd"] * math.sqrt(stats["present"] / (stats["present"] - 1))
        found[name] = stats
    return found


def within_budget(stats: dict[str, dict], columns: list[str], budget: int) -> set[str]:
    """The columns, fewest distinct values first, that together stay within the budget."""
    narrow, room = set(), float(budget)
    for name in sorted(columns, key=lambda c: stats[c]["distinct"]):
        room -= 1.2 * stats[name]["distinct"]
        if room < 0:
            break
        narrow.add(name)
    return narrow


def describe(df: DataFrame, columns: list[str], quantiles: dict[str, list[float]] | None = None,
             modes: list[str] = (), values: list[str] = (), budget: int = VALUE_BUDGET,
             known: dict[str, dict] | None = None, tabled_modes: bool = True) -> dict[str, dict]:
    """Moments of all columns, plus the asked exact quantiles, modes and sorted value lists.

    Quantiles read a text column's parsable values. A value list longer than ``LISTED_VALUES`` is
    given as None: use ``value_codes`` for it. ``known`` spares the moments when they are at hand, with
    distinct counts. Without ``tabled_modes`` columns beyond the budget get no mode: value codes hold the counts it takes.
    """
    quantiles = dict(quantiles or {})
    types = {f.name: f.dataType for f in df.schema.fields}
    asked = list({*quantiles, *modes, *values})
    stats = {c: dict(known[c]) for c in columns} if known else moments(df, columns, asked)
    narrow = within_budget(stats, asked, budget)
    listed = [c for c in values if c in narrow and stats[c]["distinct"] * 1.2 <= LISTED_VALUES]

    wanted: list[Column] = []
    for i, name in enumerate(columns):
        if name in narrow and name in quantiles:
            wanted.append(F.percentile(parse_number(ref(name), types[name]), double_array(quantiles[name]))
                          .alias(f"{i}_quantiles"))
        if name in narrow and name in modes:
            wanted.append(F.mode(ref(name), True).alias(f"{i}_mode"))
        if name in listed:
            wanted.append(F.sort_array(F.collect_set(ref(name).cast("string"))).alias(f"{i}_values"))
    row = df.agg(*wanted).first().asDict() if wanted else {}
    for i, name in enumerate(columns):
        if name in quantiles:
            stats[name]["quantiles"] = row.get(f"{i}_quantiles") or [None] * len(quantiles[name])
        if name in modes:
            stats[name]["mode"] = row.get(f"{i}_mode")
        if name in values:
            stats[name]["values"] = row.get(f"{i}_values")

    for probabilities in {tuple(p) for c, p in quantiles.items() if c not in narrow}:
        wide = [c for c, p in quantiles.items() if tuple(p) == probabilities and c not in narrow]
        numbers = {c: stats[c].get("parsed", stats[c]["present"]) for c in wide}
        for name, found in wide_quantiles(df, wide, list(probabilities), numbers).items():
            stats[name]["quantiles"] = found
    wide = [c for c in modes if c not in narrow] if tabled_modes else []
    for name, found in wide_modes(df, wide).items():
        whole = isinstance(types[name], T.IntegralType)
        stats[name]["mode"] = int(found) if whole and found is not None else found
    return stats


def quantile_places(size: int, probabilities: list[float]) -> set[int]:
    """The ranks, from 0, whose values the interpolated quantiles need."""
    return {rank for p in probabilities for rank in (math.floor(p * (size - 1)), math.ceil(p * (size - 1)))}


def interpolate(size: int, p: float, at: dict[int, float]) -> float:
    place = p * (size - 1)
    low, high = math.floor(place), math.ceil(place)
    if low == high or at[low] == at[high]:
        return at[low]
    return (high - place) * at[low] + (place - low) * at[high]


def pick_ranks(counts: DataFrame, ranks: dict[str, tuple[int, set[int]]], one_task: bool = False) -> dict[str, dict]:
    """The values at wanted ranks: {column: {rank: value}} from (column, value, n) counts.

    ``ranks`` gives each column's size and wanted ranks. Counts get a running total, which says the
    ranks each value covers; an equi-join on rank buckets with the short list of wanted ranks picks
    the values.
    """
    rows = [(name, max(1, math.ceil(size / RANK_BUCKETS)), rank) for name, (size, some) in ranks.items() for rank in some]
    found: dict[str, dict] = {name: {} for name in ranks}
    if not rows:
        return found
    spark = counts.sparkSession
    wanted = spark.createDataFrame(sorted((n, r // w, r) for n, w, r in rows), "column string, bucket long, rank long")
    widths = spark.createDataFrame(sorted({(n, w) for n, w, _ in rows}), "column string, width long")
    spread = running_total(counts, ["column"], ["value"], F.col("n"), "before", one_task)
    spans = spread.join(F.broadcast(widths), "column").withColumn(
        "bucket", F.explode(F.sequence(F.floor(F.col("before") / F.col("width")),
                                       F.floor((F.col("before") + F.col("n") - 1) / F.col("width")))))
    hits = (spans.join(F.broadcast(wanted), ["column", "bucket"])
            .filter((F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("n")))
            .select("column", "rank", "value").distinct())
    for hit in hits.collect():
        found[hit["column"]][hit["rank"]] = hit["value"]
    return found


def bracketed_quantiles(df: DataFrame, columns: list[str], probabilities: list[float],
                        sizes: dict[str, int]) -> dict[str, list]:
    """Exact quantiles at a few probabilities: approximate ones give a bracket, only its rows are ranked.

    Two passes with small partial results bound each quantile and count what lies below; the rows
    inside the brackets, a few ten-thousandths of the table, then go through ``pick_ranks``. A column
    whose ranks should fall outside their bracket is left out of the answer.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    values = {c: parse_number(ref(c), types[c]) for c in columns}
    reach = 2.0 / SKETCH_ACCURACY
    edges = [min(1.0, max(0.0, p + side)) for p in probabilities for side in (-reach, reach)]
    row = df.agg(*(x for i, c in enumerate(columns) for x in (
        F.percentile_approx(values[c], edges, SKETCH_ACCURACY).alias(f"{i}_edges"),
        F.min(values[c]).alias(f"{i}_low"), F.max(values[c]).alias(f"{i}_high")))).first()
    brackets = {}
    for i, name in enumerate(columns):
        for j, p in enumerate(probabilities):
            low, high = row[f"{i}_edges"][2 * j:2 * j + 2]
            brackets[name, j] = (row[f"{i}_low"] if p <= reach else low, row[f"{i}_high"] if p >= 1 - reach else high)
    keys = list(brackets)
    counted = df.agg(*(x for k, (name, j) in enumerate(keys) for x in (
        F.count_if(values[name] < brackets[name, j][0]).alias(f"b{k}"),
        F.count_if(values[name].between(*brackets[name, j])).alias(f"i{k}")))).first()
    ranks, below, inside = {}, {}, 0
    for k, (name, j) in enumerate(keys):
        first, count = counted[f"b{k}"], counted[f"i{k}"]
        places = quantile_places(sizes[name], [probabilities[j]])
        if min(places) < first or max(places) >= first + count:
            columns = [c for c in columns if c != name]
            continue
        label = f"{k}"
        ranks[label], below[name, j] = (count, {r - first for r in places}), first
        inside += count
    pieces = F.array(*(F.when(values[name].between(*brackets[name, j]),
                              F.struct(F.lit(f"{k}").alias("column"), values[name].alias("value")))
                       for k, (name, j) in enumerate(keys) if f"{k}" in ranks))
    rows = df.select(F.inline(F.filter(pieces, lambda s: s.isNotNull())))
    counts = rows.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    found = pick_ranks(counts, ranks, one_task=inside <= ONE_TASK_ROWS)
    answer = {}
    for name in columns:
        answer[name] = []
        for j, p in enumerate(probabilities):
            at = {r + below[name, j]: v for r, v in found[str(keys.index((name, j)))].items()}
            answer[name].append(interpolate(sizes[name], p, at))
    return answer


def wide_quantiles(df: DataFrame, columns: list[str], probabilities: list[float],
                   sizes: dict[str, int] | None = None) -> dict[str, list]:
    """Exact interpolated quantiles of columns with many distinct values."""
    if not columns:
        return {}
    if sizes is None:
        types = {f.name: f.dataType for f in df.schema.fields}
        row = df.agg(*(F.count(parse_number(ref(c), types[c])).alias(f"{i}") for i, c in enumerate(columns))).first()
        sizes = {c: row[f"{i}"] for i, c in enumerate(columns)}
    answer = {c: [None] * len(probabilities) for c in columns if not sizes[c]}
    full = [c for c in columns if sizes[c]]
    if full and len(probabilities) <= FEW_QUANTILES:
        answer.update(bracketed_quantiles(df, full, probabilities, sizes))
        full = [c for c in full if c not in answer]
    if full:
        ranks = {c: (sizes[c], quantile_places(sizes[c], probabilities)) for c in full}
        found = pick_ranks(value_counts(df, full, "double"), ranks)
        answer.update({c: [interpolate(sizes[c], p, found[c]) for p in probabilities] for c in full})
    return answer


def wide_modes(df: DataFrame, columns: list[str]) -> dict[str, object]:
    """The most frequent value of each column, the smallest on ties."""
    types = {f.name: f.dataType for f in df.schema.fields}
    found: dict[str, object] = {}
    numeric = [c for c in columns if is_number(types[c])]
    for group, as_type in ((numeric, "double"), ([c for c in columns if c not in numeric], "string")):
        if group:
            best = (value_counts(df, group, as_type).groupBy("column")
                    .agg(F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("mode")))
            found.update({r["column"]: r["mode"] for r in best.collect()})
    return {c: found.get(c) for c in columns}


def value_codes(df: DataFrame, column: str, distinct: int | None = None) -> DataFrame:
    """(value, code, n): every distinct text of a column with its place 0, 1, ... in sorted order and its rows."""
    values = (df.select(ref(column).cast("string").alias("value"))
              .filter(F.col("value").isNotNull()).groupBy("value").agg(F.count(F.lit(1)).alias("n"))
              .withColumn("_all", F.lit(1)))
    few = distinct is not None and distinct * 1.2 <= ONE_TASK_ROWS
    return (running_total(values, ["_all"], ["value"], F.lit(1), "code", one_task=few)
            .select("value", F.col("code").cast("bigint").alias("code"), "n"))
