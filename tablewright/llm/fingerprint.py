"""Homomorphic multiset hash of documents, in DataFrame functions only.

A paragraph (a line of the text) enters as its runs of up to ``RUN_WORDS`` words, so that an edit inside a
long paragraph moves only the runs behind it. Every run is hashed to a wide vector of 64 lanes, and the
fingerprint is the lane-wise sum modulo 2^29, with the number of runs beside it. Sums do not depend on
order, and a paragraph is inserted or deleted by adding or subtracting its vector (``plus``, ``minus``).

Lane values are six hashed bits each. Centred, they are independent with mean zero, so the cosine of two
fingerprints estimates the share of common runs, with a standard error near 1/8.

Two lanes lie in one long, a guard bit behind each, so no carry reaches the next lane. A centred lane is in
range for 8.5 million copies of one run at least, 51 MB of the shortest words. Runs are added up ``PART`` at a
time with four lanes of 15 bits in a long, which no sum of a part leaves, and parts into the wide lanes. A text
without words has the zero fingerprint; NULL counts as empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

RUN_WORDS = 3
WORDS = 32                                  # longs in a fingerprint
LANES, BITS = 2, 29                         # lanes in a long, bits in a lane; a guard bit follows each lane
STEP = BITS + 1
KEPT = sum(((1 << BITS) - 1) << STEP * i for i in range(LANES))
VALUE_BITS = 6                              # a run adds 0 to 63 to each lane
PART = 256                                  # runs added up in narrow lanes
NARROW = 15                                 # bits in a narrow lane, four in a long: more than PART * 63
VALUES = sum(((1 << VALUE_BITS) - 1) << NARROW * i for i in range(4))
RUN = r"(?:\S++[^\S\n]*+){1," + str(RUN_WORDS) + "}"


def add_lanes(a: Column, b: Column) -> Column:
    return (a + b).bitwiseAND(F.lit(KEPT))


def negate_lanes(a: Column) -> Column:
    """The lane-wise negative: complement and add one in each lane."""
    ones = F.lit(sum(1 << STEP * i for i in range(LANES)))
    return add_lanes(a.bitwiseXOR(F.lit(KEPT)), ones)


def empty() -> Column:
    return F.struct(F.array_repeat(F.lit(0).cast("bigint"), WORDS).alias("lanes"),
                    F.lit(0).cast("bigint").alias("runs"))


def plus(a: Column, b: Column) -> Column:
    """The fingerprint of both multisets together (fingerprints are structs of lanes and runs)."""
    return F.struct(F.zip_with(a["lanes"], b["lanes"], add_lanes).alias("lanes"),
                    (a["runs"] + b["runs"]).alias("runs"))


def minus(a: Column, b: Column) -> Column:
    """The fingerprint of ``a`` after everything in ``b`` is deleted from it."""
    return F.struct(F.zip_with(a["lanes"], b["lanes"], lambda x, y: add_lanes(x, negate_lanes(y))).alias("lanes"),
                    (a["runs"] - b["runs"]).alias("runs"))


def run_hashes(text: Column) -> Column:
    """The hash of every run of words of a text."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(RUN), F.lit(0)),
                       lambda r: F.xxhash64(F.rtrim(r)))


def widened(narrow: Column, j: Column) -> Column:
    """The ``j``-th long of wide lanes from the longs of narrow lanes, each of which has those of two."""
    both = F.call_function("shiftright", F.get(narrow, F.shiftright(j, 1)), j.bitwiseAND(F.lit(1)) * (2 * NARROW))
    lane = F.lit((1 << NARROW) - 1)
    return both.bitwiseAND(lane) + F.shiftleft(F.shiftright(both, NARROW).bitwiseAND(lane), STEP)


def summed(hashes: Column) -> Column:
    """The fingerprint of a multiset of run hashes, as a struct. ``hashes`` should be a plain column: it is read per part."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(hashes), F.lit(1)), F.lit(PART))
    narrow = F.transform(F.transform(starts, lambda at: F.slice(hashes, at, PART)), lambda part: F.transform(
        F.array(*[F.lit(j) for j in range(WORDS // 2)]), lambda j: F.aggregate(
            part, F.lit(0).cast("bigint"), lambda s, h: s + F.xxhash64(h, j).bitwiseAND(F.lit(VALUES)))))
    lanes = F.aggregate(narrow, F.array_repeat(F.lit(0).cast("bigint"), WORDS), lambda s, part: F.transform(
        s, lambda v, j: add_lanes(v, widened(part, j))))
    return F.struct(lanes.alias("lanes"), F.size(hashes).cast("bigint").alias("runs"))


def with_hash(df: DataFrame, text: str, name: str) -> DataFrame:
    """``df`` with the fingerprint of a text column as a struct; the runs are hashed in a projection of their own, once."""
    kept = [c for c in df.columns if c != name]
    return (df.select(*kept, run_hashes(F.col(text)).alias("_run_hashes"))
            .select(*kept, summed(F.col("_run_hashes")).alias(name)))


def to_text(fingerprint: Column) -> Column:
    """Hexadecimal: the number of runs, then the longs of lanes, 15 digits each."""
    lanes = F.transform(fingerprint["lanes"], lambda a: F.lpad(F.hex(a), 15, "0"))
    return F.lower(F.concat(F.lpad(F.hex(fingerprint["runs"]), 16, "0"), F.array_join(lanes, "")))


def centred(fingerprint: Column) -> Column:
    """64 signed lane sums, less their expected value, as doubles."""
    whole, half = 1 << BITS, 1 << BITS - 1
    expected = F.floor(fingerprint["runs"] * (((1 << VALUE_BITS) - 1) / 2))

    def lane(v: Column) -> Column:
        apart = F.pmod(v - expected + half, F.lit(whole)) - half
        return apart.cast("double")

    return F.flatten(F.transform(fingerprint["lanes"], lambda a: F.array(
        *[lane(F.shiftright(a, STEP * i).bitwiseAND(F.lit(whole - 1))) for i in range(LANES)])))


def dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)


def likeness(a: Column, b: Column, x: Column, y: Column) -> Column:
    """0 to 1: the cosine of fingerprints ``a`` and ``b``, centred as ``x`` and ``y``; 1 for equal ones, 0 against no words."""
    size = F.sqrt(dot(x, x) * dot(y, y))
    cosine = F.when(size > 0, dot(x, y) / size).otherwise(0.0)
    return F.when((a["runs"] == b["runs"]) & (a["lanes"] == b["lanes"]), 1.0).otherwise(
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), cosine)))


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``fingerprint`` as text, added by projection (an older column of that name is replaced)."""
    hashed = with_hash(docs, text, "fingerprint")
    return hashed.withColumn("fingerprint", to_text(F.col("fingerprint")))


def with_next(docs: DataFrame, key: str, value: str, carried: list[str], buckets: int) -> DataFrame:
    """``docs`` with ``next_<name>`` of the following row by key, after the last the first.

    Rows fall into buckets of neighbouring keys (NULL first, ties by ``value``), cut at approximate
    quantiles; each is sorted on its own, and the last row of a bucket takes the first row of the next
    bucket that has rows. Only those first rows are gathered, one for each bucket; their ``carried``
    columns must be NULL here and are the caller's to derive from ``next_<value>``.
    """
    shares = [i / buckets for i in range(1, buckets)]
    cuts = sorted(set(docs.approxQuantile(key, shares, 0.1 / buckets))) if shares else []
    where = F.when(F.col(key).isNull(), F.lit(-1)).otherwise(
        F.size(F.filter(F.array(*[F.lit(c) for c in cuts]).cast("array<double>"), lambda c: c < F.col(key))))
    placed = docs.withColumn("_bucket", where)
    within = Window.partitionBy("_bucket").orderBy(F.col(key).asc_nulls_first(), F.col(value))
    inside = placed.select("*", F.lead(value).over(within).alias("_next"),
                           *[F.lead(c).over(within).alias(f"next_{c}") for c in carried])
    first = docs.select(key, value).withColumn("_bucket", where).groupBy("_bucket").agg(
        F.min(F.struct(F.col(key), F.col(value)))[value].alias("_head"))
    along = Window.orderBy("_bucket")
    heads = first.select(F.col("_bucket").alias("_after"), F.coalesce(
        F.lead("_head").over(along), F.first("_head").over(along.rowsBetween(Window.unboundedPreceding, 0))).alias("_head"))
    linked = inside.join(heads, F.col("_bucket") == F.col("_after"), "left")
    return linked.select(*docs.columns, F.coalesce("_next", "_head").alias(f"next_{value}"),
                         *[f"next_{c}" for c in carried])


def edited_pairs(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """Fingerprint every whole text and its edited text, in which the last half gives way to the next document's start.

    Rows in: ``doc_id`` and ``text``; other columns are left aside. NULL texts count as empty. Repeated
    ids follow each other by text. A single row is its own next document.
    """
    buckets = buckets or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) * 2
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    own = with_hash(own, "text", "hashed")
    pairs = with_next(own, "doc_id", "text", ["hashed"], buckets)
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - half),
                      F.substring(F.col("next_text"), F.lit(1), half))
    pairs = pairs.select(
        "doc_id", F.length("text").cast("bigint").alias("n_chars"), edited.alias("edited"), "hashed",
        F.when(F.col("next_hashed").isNull(), run_hashes(F.col("next_text"))).alias("_head_hashes"), "next_hashed")
    pairs = pairs.withColumn("next_hashed", F.coalesce("next_hashed", summed(F.col("_head_hashes"))))
    pairs = with_hash(pairs, "edited", "edited_hashed")
    pairs = pairs.select("*", *[centred(F.col(c)).alias(f"{c}_centred") for c in ("hashed", "edited_hashed", "next_hashed")])

    def near(other: str) -> Column:
        return likeness(F.col("hashed"), F.col(other), F.col("hashed_centred"), F.col(f"{other}_centred"))

    return pairs.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        to_text(F.col("hashed")).alias("fingerprint"), to_text(F.col("edited_hashed")).alias("edited_fingerprint"),
        near("edited_hashed").alias("near_edited"), near("next_hashed").alias("near_next"))
