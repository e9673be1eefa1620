"""Small tables with the awkward cases every operator has to take."""

from __future__ import annotations

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Names that operators use for their own columns, present in the input as well.
CLASHING = ["_at", "_part", "_run", "_hash", "_bucket", "size", "shard", "slot", "position", "statistics", "_statistics",
            "piece_ids", "fingerprint", "score", "held_out", "label", "component_id", "rep", "tiles", "bucket", "rank"]
LONG = "The quick brown fox, " * 5_000
ROWS = [
    (1, "A plain text of some words.\nAnd a second line.", "en", "a", 45),
    (2, "A plain text of some words.\nAnd a second line.", "en", "a", 45),
    (2, "A plain text of some words.\nAnd a second line.", "en", "a", 45),
    (3, None, "en", "b", None),
    (4, "", "de", None, 0),
    (5, "   \n\t ", None, "b", 6),
    (6, LONG, "en", "b", len(LONG)),
    (7, "日本語 und Ümläute 😀", "de", "a", 17),
    (None, "A row without an id", "en", "c", 19),
    (9, "x", "fr", "a", 1),
]


def documents(spark, rows=ROWS, clashing: bool = False):
    df = spark.createDataFrame(rows, DOCS)
    if clashing:
        from pyspark.sql import functions as F
        df = df.select("*", *[F.lit(f"own {c}").alias(c) for c in CLASHING])
    return df


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
