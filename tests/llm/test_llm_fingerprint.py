"""Fingerprints: edits against plain Python, sums of multisets, order independence, likeness, awkward rows."""

import hashlib

import pytest
from pyspark.sql import functions as F
from text_cases import DOCS, documents

from tablewright.llm import fingerprint


def plain(rows):
    """(doc_id, n_chars, edited_sha256) of every row."""
    rows = sorted(((d is not None, d or 0, t or "") for d, t in rows))
    answer = []
    for at, (known, doc_id, text) in enumerate(rows):
        half, after = len(text) // 2, rows[(at + 1) % len(rows)][2]
        edited = text[:len(text) - half] + after[:half]
        answer.append((doc_id if known else None, len(text), hashlib.sha256(edited.encode()).hexdigest()))
    return sorted(answer, key=repr)


@pytest.mark.parametrize("buckets", [1, 3, 16])
def test_edits_against_plain_python(spark, buckets):
    df = documents(spark, clashing=True)
    found = fingerprint.edited_pairs(df, buckets)
    assert found.columns == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    rows = found.collect()
    assert sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in rows), key=repr) == plain(
        [(r["doc_id"], r["text"]) for r in df.collect()])
    same = {r["fingerprint"] for r in rows if r["doc_id"] in (1, 2)}
    assert len(same) == 1 and all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in rows)
    assert next(r for r in rows if r["doc_id"] == 1)["near_next"] == 1.0


def test_one_row_and_none(spark):
    rows = fingerprint.edited_pairs(spark.createDataFrame([(4, "abcdef", "en", "a", 6)], DOCS)).collect()
    assert rows[0]["edited_sha256"] == hashlib.sha256(b"abcabc").hexdigest() and rows[0]["near_next"] == 1.0
    assert fingerprint.edited_pairs(spark.createDataFrame([], DOCS)).collect() == []


def test_a_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = fingerprint.edited_pairs(docs).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in rows), key=repr) == plain(texts.items())
    assert len({r["fingerprint"] for r in rows}) == len(set(texts.values()))
    assert sum(r["near_edited"] > r["near_next"] for r in rows) > 0.95 * len(rows)


def test_insertion_deletion_and_order(spark):
    rows = [("one two three\nfour five six", "four five six\none two three", "one two three", "four five six")]
    df = spark.createDataFrame(rows, "whole string, turned string, a string, b string")
    for name in df.columns:
        df = fingerprint.with_hash(df, name, f"{name}_hash")
    made = df.select(
        (F.col("whole_hash") == F.col("turned_hash")).alias("order"),
        (fingerprint.plus(F.col("a_hash"), F.col("b_hash")) == F.col("whole_hash")).alias("insert"),
        (fingerprint.minus(F.col("whole_hash"), F.col("b_hash")) == F.col("a_hash")).alias("delete"),
        (fingerprint.plus(fingerprint.empty(), F.col("a_hash")) == F.col("a_hash")).alias("empty"),
        (F.col("a_hash") != F.col("b_hash")).alias("differ")).first()
    assert all(made)


def test_fingerprints_of_long_texts_wrap(spark):
    df = spark.createDataFrame([("a b c " * 3_000,), ("a b c " * 2_999,)], "text string")
    first, second = [r["fingerprint"] for r in fingerprint.fingerprints(df).collect()]
    assert first != second and len(first) == 16 + 15 * fingerprint.WORDS


@pytest.mark.parametrize("repeated", [False, True])
def test_long_texts_keep_their_likeness(spark, repeated):
    """Texts of some MB that share half of their runs, all different or one line each many times over."""
    def half(name):
        words = [f"{name}{0 if repeated else n} {name} line" for n in range(150_000)]
        return "\n".join(words) + "\n"

    shared, first, second = half("both"), half("one"), half("other")
    df = spark.createDataFrame([(shared + first, shared + second)], "a string, b string")
    for name in df.columns:
        df = fingerprint.with_hash(df, name, name)
    a, b = F.col("a"), F.col("b")
    made = df.select(fingerprint.likeness(a, b, fingerprint.centred(a), fingerprint.centred(b)).alias("near"),
                     a["runs"].alias("runs"), *[fingerprint.centred(c).alias(f"{n}_sums") for n, c in (("a", a), ("b", b))]).first()
    assert made["runs"] == 300_000
    assert made["near"] == pytest.approx(0.5, abs=0.3)
    # No sum has wrapped: those of a multiset are the sums of its parts.
    parts = spark.createDataFrame([(shared, first)], "s string, t string")
    for name in parts.columns:
        parts = fingerprint.with_hash(parts, name, name)
    s, t = parts.select(*[fingerprint.centred(F.col(c)) for c in "st"]).first()
    assert all(abs(x + y - z) <= 1 for x, y, z in zip(s, t, made["a_sums"]))
