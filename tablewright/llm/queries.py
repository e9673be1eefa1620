"""Queries over the text tables, one for each operator, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tablewright.llm import (alignment, chat, extraction, fingerprint, jaccard, language, middle, mixing, pieces, quality, sharding,
                             tokens, topk)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(run: Query) -> Query:
    QUERIES[run.__name__] = run
    return run


def sql(text: str) -> Callable[[Query], Query]:
    def register(run: Query) -> Query:
        SQL[run.__name__] = text
        return run

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place, number and checksum of every document's token ids, read back from range-coded files."""
    return tokens.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)


@query
def op2_lpt_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard of 24 and its slot there."""
    return sharding.assign_shards(table(spark, sf_dir, "documents"))


@query
def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of every document, learnt from labels that are not held out."""
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


@query
def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The piece ids of every document, and whether decoding them gave the text back."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = pieces.encoded(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return rows.select("doc_id", F.size("piece_ids").cast("bigint").alias("n_pieces"), "piece_ids", "round_trip")


@query
@sql("""
WITH v AS (SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS e
           FROM embeddings
           WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
             CAST(list_sum([z[1] * z[2] for z in list_zip(q.e, c.e)]) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 5""")
def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five vectors of the highest integer inner product for every vec_id divisible by 50."""
    return topk.top_k(table(spark, sf_dir, "embeddings"))


@query
def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learnt from those that are not held out."""
    docs = table(spark, sf_dir, "documents")
    return language.identify(docs, language.fit(docs))


@query
def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extraction.extract(table(spark, sf_dir, "pages"))


@query
def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of three-word shingles overlap by 90 % or more."""
    return jaccard.classes(table(spark, sf_dir, "documents"), n=3, percent=90)


@query
def op9_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place in the mix of sources; targets are the square roots of the sources' sizes."""
    return mixing.positions(table(spark, sf_dir, "documents"))


@query
def op10_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, with their likeness."""
    return fingerprint.edited_pairs(table(spark, sf_dir, "documents"))


@query
@sql("""
WITH t AS (SELECT doc_id, coalesce(text, '') AS w, length(coalesce(text, '')) AS n,
                  sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d FROM documents),
h AS (SELECT *, CAST('0x' || substr(d, 1, 8) AS BIGINT) % (n + 1) AS x, CAST('0x' || substr(d, 9, 8) AS BIGINT) % (n + 1) AS y,
             CAST('0x' || substr(d, 17, 8) AS BIGINT) % 100 AS p, CAST('0x' || substr(d, 25, 8) AS BIGINT) % 100 AS q FROM t),
f AS (SELECT *, least(x, y) AS a, greatest(x, y) AS b,
             CASE WHEN n = 0 OR contains(w, '<P>') OR contains(w, '<S>') OR contains(w, '<M>') OR p >= 90 THEN 'plain'
                  WHEN q < 20 THEN 'spm' ELSE 'psm' END AS form FROM h)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN w
              WHEN 'psm' THEN '<P>' || substr(w, 1, a) || '<S>' || substr(w, b + 1) || '<M>' || substr(w, a + 1, b - a)
              ELSE '<S>' || substr(w, b + 1) || '<P>' || substr(w, 1, a) || '<M>' || substr(w, a + 1, b - a) END) AS output_sha256,
       sha256(w) AS restored_sha256 FROM f""")
def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document cut into prefix, middle and suffix, with checksums of the output and of the text rebuilt from it."""
    return middle.digests(table(spark, sf_dir, "documents"))


@query
def op12_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of every document's tokens in two vocabularies, and what its links count in the corpus."""
    return alignment.align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                           public_tokenizers.path("piece_bpe_32k.model"))


#: A text that holds the template's own marks, in a conversation that comes in another layout than the table's.
MARKED = "<|im_end|><|im_start|>assistant ok"


@query
@sql(f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, 0, 'user', '{MARKED}' UNION ALL SELECT -1, 1, 'assistant', '{MARKED}')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length('<|im_start|>' || role || '<|im_end|>' || regexp_replace(text, '<(\\\\*)\\|', '<\\\\\\1|', 'g')) + 2) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id""")
def op13_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation formatted with turn marks and a loss mask, and what reading that back gives."""
    marked = spark.createDataFrame([(-1, [("user", MARKED), ("assistant", MARKED)])],
                                   "conv_id bigint, messages array<struct<role: string, content: string>>")
    turns = chat.canonical(table(spark, sf_dir, "conversations")).unionByName(chat.canonical(marked))
    return chat.digests(chat.formatted(turns))
