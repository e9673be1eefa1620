"""N-gram Jaccard join: documents linked by the overlap of their sets of word shingles, and their components.

A document's set holds the 64-bit hashes of its distinct shingles of ``n`` words; with fewer words, the whole
sequence as one. Two documents link when ``100 * intersection >= percent * union``.

1. **Equal sets** become one class, so copies are never paired. A class goes by a number hashed from its set (``key``), as
   rows of one doc_id may have different sets; its smallest doc_id comes in at the end.
2. **Size-banded tiles.** Only sets of near sizes can link, so classes fall into bands of sizes. Two linked sets of a
   band differ in at most ``D`` shingles (``budget``). The shingles are dealt by hash to ``D + spare`` parts;
   ``spare`` parts at least then hold exactly the same shingles in both. A tile is the classes of a band with the same
   shingles in one part: every linked pair meets in that many tiles, by the pigeonhole principle, whatever its content.
   A class that has company in fewer tiles is linked with none and goes, as most that only share a passage do. Empty
   parts make no tile, unless a class has so many that it needs them. A class also joins the tiles of the bands below in which a smaller partner may lie.
3. **Stars.** Tiles are gathered around their hub, the member with the most company in all its tiles. A star of up to
   ``UNIT`` classes is one unit of work; a larger one is cut into units that each hold the hub.
4. **Within a unit** bitmaps of hashed shingles are compared first: bits that only one side has bound the overlap from
   above. What passes is decided by intersecting the sorted arrays. Pairs that are already connected are left out, as
   components need no second link; a unit gives fewer links than it has classes.
5. **Cut stars** are finished exactly: members that are not in the hub's component are compared with all members.
6. **Components** of the links by repeated minimum over neighbours with shortcuts, checkpointed.

Documents without words, with NULL text or without an id link with nothing. Repeated rows of one id are one document if
their texts have the same set; rows of one id with different sets are linked by their id.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tablewright.llm.common import slices
from tablewright.session import checkpoint_root, settle, ship_package

SPARE = 8              # differing shingles for each part beyond their number, besides three
BAND = 1.5             # largest over smallest size of a band
PRUNINGS = 2           # times that classes with too little company are left out
UNIT = 512             # classes compared in one unit of work, about
PIECE = 1 << 20        # bytes of text handled at once
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
BASE = 0x5851F42D4C957F2D
INVERSE = pow(BASE, -1, 1 << 64)
IDENTITY = ["n_shingles", "sum_a", "sum_b"]


def key() -> Column:
    """The number of a row's class."""
    return F.xxhash64(*IDENTITY).alias("key")


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit integers without visible structure."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def byte_values() -> np.ndarray:
    """A hashed value for each byte, capitals A to Z as their small letters, 0 for white space."""
    values = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(MULTIPLIERS[0]))
    values[65:91] = values[97:123]
    values[[32, 9, 10, 11, 12, 13]] = 0
    return values


@lru_cache(maxsize=4)
def powers(length: int, base: int) -> np.ndarray:
    """base ** 0 ... base ** (length - 1) modulo 2^64."""
    made = np.empty(length, np.uint64)
    made[0], done = 1, 1
    while done < length:
        step = min(done, length - done)
        made[done:done + step] = made[:step] * np.uint64(pow(base, done, 1 << 64))
        done += step
    return made


def shingles(texts: list[bytes], n: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text (lower-cased words between white space)."""
    joined = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    values = byte_values()[joined]
    inside = values != 0
    edges = np.flatnonzero(np.diff(np.r_[False, inside].astype(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    size = 1 << max(16, (len(joined) - 1).bit_length())
    total = np.r_[np.uint64(0), np.cumsum(values * powers(size, BASE)[:len(values)], dtype=np.uint64)]
    words = mixed((total[ends] - total[starts]) * powers(size, INVERSE)[starts] + (ends - starts).astype(np.uint64))
    bounds = np.cumsum([0] + [len(t) + 1 for t in texts])
    places = np.searchsorted(starts, bounds)
    rolled = np.zeros(len(words), np.uint64)
    for k in range(min(n, len(words))):
        rolled[:len(words) - k] = mixed(rolled[:len(words) - k] * np.uint64(MULTIPLIERS[1]) + words[k:])
    found = []
    for first, last in zip(places[:-1].tolist(), places[1:].tolist()):
        if last - first >= n:
            found.append(np.unique(rolled[first:last - n + 1]))
        elif last > first:
            whole = np.array([last - first], np.uint64)
            for at in range(first, last):
                whole = mixed(whole * np.uint64(MULTIPLIERS[1]) + words[at:at + 1])
            found.append(whole)
        else:
            found.append(np.empty(0, np.uint64))
    return found


def band_of(size: int) -> int:
    return int(np.log(size) / np.log(BAND) + 1e-9)


def band_end(band: int) -> int:
    """The largest size of a band."""
    end = int(BAND ** (band + 1)) + 2
    while band_of(end) > band:
        end -= 1
    return end


@lru_cache(maxsize=1024)
def budget(band: int, percent: int) -> int:
    """The most shingles in which two linked sets can differ whose smaller one is in the band.

    With sizes a <= b an intersection of percent * (a + b) / (100 + percent) at least is needed, so the difference is
    at most (100 - percent) * (a + b) / (100 + percent), and b is at most 100 * a / percent.
    """
    end = band_end(band)
    return (100 - percent) * (end + 100 * end // percent) // (100 + percent)


def tiles(found: np.ndarray, percent: int) -> tuple[np.ndarray, int]:
    """The tile keys of a set, and in how many tiles it meets any partner, at least.

    It has keys in its own band and in those below in which smaller partners may lie.
    """
    size, keys, least = len(found), [], []
    own = band_of(size)
    for band in range(own, -1, -1):
        if band < own and percent * size > 100 * band_end(band):
            break
        differing = budget(band, percent)
        if not differing:
            continue          # only equal sets link, and these are one class already
        spare = 3 + differing // SPARE
        parts = differing + spare
        part = ((found >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.intp)
        sums = np.zeros(parts, np.uint64)
        np.add.at(sums, part, mixed(found + np.uint64(1)))
        empty = sums == 0
        blank = int(empty.sum())
        chosen = np.arange(parts) if blank >= spare else np.flatnonzero(~empty)
        least.append(max(spare - blank, 1))
        keys.append(mixed(sums[chosen] * np.uint64(MULTIPLIERS[0]) + (chosen + (band << 24)).astype(np.uint64)))
    return (np.concatenate(keys), min(least)) if keys else (np.empty(0, np.uint64), 1)


def signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def byte_texts(column: pa.Array) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def sets_of(column: pa.Array, n: int) -> Iterator[np.ndarray]:
    texts = byte_texts(column)
    for start, end in slices([len(t) + 1 for t in texts], PIECE):
        yield from shingles(texts[start:end], n)


def signatures(docs: DataFrame, n: int, percent: int, tiled: bool) -> DataFrame:
    """doc_id, n_shingles, two 64-bit sums that stand for the whole set, and (if ``tiled``) ``tiles``, for every row."""
    ship_package(docs.sparkSession)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, sums, keys, least = [], [], [], []
            for found in sets_of(batch.column(1), n):
                sizes.append(len(found))
                sums.append(sums_of([found]))
                made, need = tiles(found, percent) if tiled and len(found) else (np.empty(0, np.uint64), 1)
                keys.append(signed(made))
                least.append(need)
            sums = np.concatenate([np.empty((0, 2), np.int64), *sums])
            offsets = np.cumsum([0] + [len(k) for k in keys])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(sums[:, 0]), pa.array(sums[:, 1]), pa.array(least, pa.int32()),
                 pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate([*keys, np.empty(0, np.int64)])))],
                names=["doc_id", "n_shingles", "sum_a", "sum_b", "least", "tiles"])

    return docs.select("doc_id", "text").mapInArrow(
        sign, "doc_id bigint, n_shingles bigint, sum_a bigint, sum_b bigint, least int, tiles array<bigint>")


def bitmaps(sets: list[np.ndarray]) -> np.ndarray:
    """A bitmap of hashed shingles for each set, four bits a shingle of the largest set, in 64-bit words."""
    words = max(1, 1 << (max(len(s) for s in sets) * 4 // 64).bit_length())
    maps = np.zeros((len(sets), words), np.uint64)
    for row, found in enumerate(sets):
        bit = found >> np.uint64(64 - 6 - (words.bit_length() - 1))
        np.bitwise_or.at(maps[row], (bit >> np.uint64(6)).astype(np.intp), np.uint64(1) << (bit & np.uint64(63)))
    return maps


def root(parent: list[int], at: int) -> int:
    while parent[at] != at:
        parent[at] = parent[parent[at]]
        at = parent[at]
    return at


def unit_links(sets: list[np.ndarray], labels: list[int], active: int, percent: int) -> list[tuple[int, int]]:
    """Links that connect what is connected in a unit: pairs of places in ``sets``.

    The first ``active`` sets are compared with all. ``labels`` are components known before. A pair in one component is
    passed over. For the others bitmaps bound the overlap, then sorted arrays decide.
    """
    sizes, maps = np.array([len(s) for s in sets]), bitmaps(sets)
    first: dict[int, int] = {}
    parent = [first.setdefault(label, at) for at, label in enumerate(labels)]
    roots, links = np.array(parent), []
    for at in range(min(active, len(sets) - 1)):
        others = np.arange(at + 1, len(sets))
        a, b = sizes[at], sizes[others]
        others = others[(roots[others] != roots[at]) & (100 * np.minimum(a, b) >= percent * np.maximum(a, b))]
        if not len(others):
            continue
        b = sizes[others]
        bound = np.minimum(a - np.bitwise_count(maps[at] & ~maps[others]).sum(axis=1, dtype=np.int64),
                           b - np.bitwise_count(maps[others] & ~maps[at]).sum(axis=1, dtype=np.int64))
        for other in others[(100 + percent) * bound >= percent * (a + b)].tolist():
            if roots[other] == roots[at]:
                continue
            small, large = (at, other) if sizes[at] <= sizes[other] else (other, at)
            places = np.searchsorted(sets[large], sets[small])
            places[places == sizes[large]] = 0
            common = int((sets[large][places] == sets[small]).sum())
            if (100 + percent) * common >= percent * int(sizes[at] + sizes[other]):
                links.append((at, other))
                old, new = max(roots[at], roots[other]), min(roots[at], roots[other])
                roots[roots == old] = new
    return links


def compare(units: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b) links from ``units``: unit, member, label, active (whether to compare it with all of its unit)."""
    ready = units.join(sets, units["member"] == sets["key"]).select("unit", "member", "label", "active", "hashes")

    def link(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["active", "member"], ascending=[False, True], kind="stable")
        members = rows["member"].tolist()
        found = unit_links([np.frombuffer(h, np.uint64) for h in rows["hashes"]], rows["label"].tolist(),
                           int(rows["active"].sum()), percent)
        return pd.DataFrame({"a": [members[x] for x, _ in found], "b": [members[y] for _, y in found]}, dtype="int64")

    return ready.groupBy("unit").applyInPandas(link, "a bigint, b bigint")


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of the links (a, b).

    Every round gives each node the least label among its neighbours and itself, then follows that label's own label.
    Each round is settled, and the rounds end when nothing changes.
    """
    both = settle(links.select("a", "b").union(links.select("b", "a")).distinct())
    labels = settle(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node"))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(
            F.min("label").alias("least"))
        lower = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "least").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        after = settle(lower.join(jump, "label").select("node", "old", F.least("label", "further").alias("label")))
        labels = after.select("node", "label")
        if after.filter("label <> old").isEmpty():
            return after.select("node", F.col("label").alias("component"))


def classes(docs: DataFrame, n: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``docs`` (doc_id whole numbers, text)."""
    if n < 1 or not 1 <= percent <= 100:
        raise ValueError("n must be positive and percent between 1 and 100")
    checkpoint_root(docs.sparkSession)
    ids = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    signed_rows = settle(signatures(ids, n, percent, False).drop("least", "tiles"))
    linkable = signed_rows.filter("doc_id IS NOT NULL AND n_shingles > 0").select("doc_id", key())
    equal = linkable.groupBy("key").agg(F.min("doc_id").alias("rep"))
    members = settle(linkable.distinct().join(equal, "key").select("doc_id", "key", "rep"))
    reps = members.filter("doc_id = rep").select("key", "rep")

    # Keys are made from the texts again rather than stored: they are the bulk of the work's bytes. Copies are merged
    # before they are shuffled, and what is alone in its tile goes before anything is written.
    keyed = signatures(ids.filter("doc_id IS NOT NULL"), n, percent, True).filter(F.size("tiles") > 0)
    of_class = keyed.groupBy(key()).agg(F.min(F.struct("doc_id", "least", "tiles")).alias("class"))
    in_tiles = of_class.select(F.col("key").alias("member"), F.col("class.least").alias("least"),
                               F.explode("class.tiles").alias("tile"))
    company = F.count(F.lit(1)).over(Window.partitionBy("tile"))
    for _ in range(PRUNINGS):
        in_tiles = settle(in_tiles.withColumn("company", company).filter("company > 1"))
        met = in_tiles.groupBy("member").agg(F.count(F.lit(1)).alias("met"))
        in_tiles = in_tiles.join(met, "member").filter("met >= least").select("member", "least", "tile")
    in_tiles = settle(in_tiles.withColumn("company", company).filter("company > 1"))
    standing = in_tiles.groupBy("member").agg(F.sum("company").alias("standing"))
    ranked = in_tiles.join(standing, "member")
    hubs = ranked.groupBy("tile").agg(F.min(F.struct(-F.col("standing"), F.col("member")))["member"].alias("hub"))
    spokes = settle(in_tiles.join(hubs, "tile").filter("member <> hub").select("hub", "member").distinct())

    wanted = settle(spokes.select("member").union(spokes.select("hub")).distinct())
    holders = reps.join(wanted, reps["key"] == wanted["member"]).select(F.col("rep").alias("holder"))
    held = hashed_sets(ids.join(holders, ids["doc_id"] == holders["holder"], "left_semi"), n)
    sets = settle(held.join(wanted, held["key"] == wanted["member"], "left_semi").dropDuplicates(["key"]))
    many = spokes.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / UNIT).cast("int").alias("units"))
    dealt = spokes.join(many, "hub").withColumn("chunk", F.pmod(F.xxhash64("member"), F.col("units")).cast("int"))
    dealt = settle(dealt)
    heads = many.select("hub", F.explode(F.sequence(F.lit(0), F.col("units") - 1)).alias("chunk"))
    place = F.struct(F.col("hub"), F.col("chunk"), F.lit(-1).alias("block")).alias("unit")
    units = dealt.select(place, "member").union(heads.select(place, F.col("hub").alias("member")))
    links = settle(compare(units.select("unit", "member", F.col("member").alias("label"), F.lit(True).alias("active")), sets, percent))
    links = settle(links.union(one_id(members)))
    found = components(links)

    cut = dealt.filter("units > 1")
    if not cut.isEmpty():
        links = settle(links.union(cross_links(cut, found, sets, percent)))
        found = components(links)

    linked = found.join(reps, found["node"] == reps["key"]).select("node", "component", "rep")
    least = linked.groupBy("component").agg(F.min("rep").alias("least"))
    linked = linked.join(least, "component").select("node", "least")
    grouped = members.join(linked, members["key"] == linked["node"], "left").groupBy("doc_id").agg(
        F.min(F.coalesce("least", "rep")).alias("component"))
    answer = signed_rows.select("doc_id", "n_shingles").join(grouped.withColumnRenamed("doc_id", "_id"), F.col("doc_id") == F.col("_id"), "left")
    return answer.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def one_id(members: DataFrame) -> DataFrame:
    """(a, b) links between the classes of one doc_id, where its rows have different sets."""
    several = members.groupBy("doc_id").agg(F.min("key").alias("a"), F.max("key").alias("last")).filter("a <> last")
    return members.join(several, "doc_id").filter("key <> a").select("a", F.col("key").alias("b"))


def keep_one(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """One row of each component of ``docs``, that of the smallest doc_id; columns as they were.

    Rows without words or without an id belong to no group and stay.
    """
    found = settle(classes(docs, n, percent))
    losers = found.filter("component_id <> doc_id").select("doc_id")
    several = found.filter("component_id = doc_id AND n_shingles > 0").groupBy("doc_id").count().filter("count > 1").select("doc_id")
    apart = losers.union(several).distinct().select(F.col("doc_id").alias("_id"))
    copies = several.select(F.col("doc_id").alias("_id"))
    alone = docs.join(apart, docs["doc_id"] == apart["_id"], "left_anti")
    return alone.unionByName(docs.join(copies, docs["doc_id"] == copies["_id"], "left_semi").dropDuplicates(["doc_id"]))


def sums_of(sets: list[np.ndarray]) -> np.ndarray:
    """Two 64-bit sums for each set, which stand for the whole of it."""
    sums = [(mixed(found).sum(dtype=np.uint64), mixed(found ^ np.uint64(MULTIPLIERS[0])).sum(dtype=np.uint64)) for found in sets]
    return np.array(sums, np.uint64).reshape(-1, 2).view(np.int64)


def hashed_sets(docs: DataFrame, n: int) -> DataFrame:
    """The class of each row and its sorted shingle hashes as bytes."""
    def hash_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1_000):
                sets = list(sets_of(batch.column(0).slice(start, 1_000), n))
                sums = sums_of(sets)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([len(s) for s in sets], pa.int64()), pa.array(sums[:, 0]), pa.array(sums[:, 1]),
                     pa.array([s.tobytes() for s in sets], pa.binary())], names=[*IDENTITY, "hashes"])

    return docs.select("text").mapInArrow(hash_texts, "n_shingles bigint, sum_a bigint, sum_b bigint, hashes binary").select(
        key(), "hashes")


def cross_links(cut: DataFrame, found: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between units of one cut star: members outside the hub's component against all members, in blocks."""
    label = found.select(F.col("node").alias("member"), F.col("component").alias("label"))
    hub_label = found.select(F.col("node").alias("hub"), F.col("component").alias("hub_label"))
    known = cut.join(label, "member", "left").join(hub_label, "hub", "left").select(
        "hub", "member", "units", "chunk", F.coalesce("label", "member").alias("label"),
        F.coalesce("hub_label", "hub").alias("hub_label"))
    known = settle(known)
    apart = known.filter("label <> hub_label").withColumn("block", F.col("chunk"))
    blocks = apart.select("hub", "block").distinct()
    # Every block of outsiders meets every chunk of its star.
    passive = known.join(blocks, "hub").filter("label = hub_label OR chunk > block").select(
        F.struct("hub", "chunk", "block").alias("unit"), "member", "label", F.lit(False).alias("active"))
    lively = apart.select("hub", "member", "label", "block", F.explode(F.sequence(F.lit(0), F.col("units") - 1)).alias("chunk")).select(
        F.struct("hub", "chunk", "block").alias("unit"), "member", "label", F.lit(True).alias("active"))
    return compare(lively.union(passive), sets, percent)
