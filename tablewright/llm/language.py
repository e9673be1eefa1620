"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased; whatever is no letter counts as a word boundary. Grams of one to three characters with
at least one letter fall into ``BUCKETS`` buckets. Fitting counts them per language over a sample of about
``fit_rows`` labelled rows, chosen by a hash of doc_id (a documented bound; the texts are taken whole). The
matrix of log-probabilities (buckets x languages) is broadcast: 256 KB for each language. Scoring sums the
matrix rows of all grams of a batch of texts, whole texts, in pieces of bounded length.

``score`` is the posterior of the predicted language with at most ``EVIDENCE`` grams' worth of evidence, as
neighbouring grams are not independent. NULL texts, texts without a letter, and all texts when there was
nothing to learn from, are ``und`` with score 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tablewright.llm.common import hash_share, slices
from tablewright.session import ship_package

BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
SMOOTHING = 0.5
EVIDENCE = 50
PIECE = 1 << 18        # characters handled at once
UNKNOWN = "und"


@dataclass(frozen=True)
class Model:
    languages: list[str]
    logs: np.ndarray        # buckets x languages, float32
    prior: np.ndarray


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def pieces(texts: list[str | None]) -> Iterator[tuple[int, str]]:
    """(row, text) with texts cut to ``PIECE`` characters; neighbouring pieces share what a gram reaches over."""
    for row, text in enumerate(texts):
        text = (text or "").lower()
        for start in range(0, max(1, len(text)), PIECE):
            yield row, text[max(0, start - ORDERS[-1] + 1):start + PIECE]


def buckets(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of every gram of the texts, and the number of each gram's text, rising within an order."""
    lengths = np.array([len(t) + 2 for t in texts])
    codes = np.frombuffer(("\0" + "\0\0".join(texts) + "\0").encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.where(letters()[codes], codes, 0).astype(np.uint64)
    owner = np.repeat(np.arange(len(texts)), lengths)
    found, owners = [], []
    for order in ORDERS:
        if len(codes) < order:
            continue
        grams = codes[:len(codes) - order + 1].copy()
        for k in range(1, order):
            grams |= codes[k:len(codes) - order + 1 + k] << np.uint64(21 * k)
        inside = (grams != 0) & (owner[:len(grams)] == owner[order - 1:])
        grams = grams[inside] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(order)
        grams ^= grams >> np.uint64(29)
        found.append((grams * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(48)).astype(np.intp))
        owners.append(owner[:len(inside)][inside])
    return np.concatenate(found), np.concatenate(owners)


def grouped(texts: list[str | None]) -> Iterator[tuple[np.ndarray, list[str]]]:
    """Pieces in groups of about ``PIECE`` characters, with the row of each."""
    cut = list(pieces(texts))
    for start, end in slices([len(t) + 2 for _, t in cut], PIECE):
        yield np.array([row for row, _ in cut[start:end]]), [t for _, t in cut[start:end]]


def score(model: Model, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """The predicted language and score of each text."""
    width = len(model.languages)
    sums, counts = np.zeros((len(texts), width)), np.zeros(len(texts))
    if not width:
        return [UNKNOWN] * len(texts), counts
    for rows, cut in grouped(texts):
        found, owners = buckets(cut)
        if not len(found):
            continue
        starts = np.flatnonzero(np.r_[True, owners[1:] != owners[:-1]])
        part = np.add.reduceat(model.logs[found], starts, axis=0, dtype=np.float64)
        np.add.at(sums, rows[owners[starts]], part)
        np.add.at(counts, rows[owners[starts]], np.diff(np.r_[starts, len(found)]))
    known = counts > 0
    tempered = sums * np.minimum(1, EVIDENCE / np.maximum(counts, 1))[:, None] + model.prior
    tempered -= tempered.max(axis=1, keepdims=True)
    odds = np.exp(tempered)
    best = odds.argmax(axis=1)
    share = np.where(known, odds[np.arange(len(best)), best] / odds.sum(axis=1), 0.0)
    return [model.languages[b] if k else UNKNOWN for b, k in zip(best, known)], share


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows kept from fitting: crc32 of doc_id as text is 2 modulo 4. A NULL id is not held out, nor learnt from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, fit_rows: int = 20_000) -> Model:
    """Learn from ``text`` and non-NULL ``lang`` of about ``fit_rows`` rows of ``docs`` that are not held out."""
    ship_package(docs.sparkSession)
    usable = docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).select("doc_id", "text", "lang")
    rows = usable.count()
    if rows > fit_rows:
        usable = usable.filter(hash_share("doc_id", fit_rows / rows))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        documents: dict[str, int] = {}
        for batch in batches:
            texts, langs = batch.column(0).to_pylist(), np.array(batch.column(1).to_pylist(), dtype=object)
            for lang in dict.fromkeys(langs):
                chosen = np.flatnonzero(langs == lang)
                documents[lang] = documents.get(lang, 0) + len(chosen)
                total = sums.setdefault(lang, np.zeros(BUCKETS, np.int64))
                for _, cut in grouped([texts[i] for i in chosen]):
                    total += np.bincount(buckets(cut)[0], minlength=BUCKETS)
        for lang, total in sums.items():
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * (len(used) + 1), pa.string()), pa.array(np.r_[-1, used], pa.int32()),
                 pa.array(np.r_[documents[lang], total[used]], pa.int64())], names=["lang", "bucket", "n"])

    table = (usable.select("text", "lang").mapInArrow(count, "lang string, bucket int, n bigint")
             .groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow())
    names, places = np.array(table["lang"].to_pylist(), dtype=object), table["bucket"].to_numpy()
    languages = sorted(set(names))
    sums, documents = np.zeros((BUCKETS, len(languages))), np.zeros(len(languages))
    amounts = table["n"].to_numpy()
    for k, lang in enumerate(languages):
        own = names == lang
        documents[k] = amounts[own & (places < 0)].sum()
        sums[places[own & (places >= 0)], k] = amounts[own & (places >= 0)]
    logs = np.log((sums + SMOOTHING) / (sums.sum(axis=0) + SMOOTHING * BUCKETS))
    prior = np.log(documents / documents.sum()) if languages else documents
    return Model(languages, logs.astype(np.float32), prior)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of ``docs``."""
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, scores = score(shared.value, batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(found, pa.string()), pa.array(scores, pa.float64())],
                names=["doc_id", "held_out", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(
        predict, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` in a language of the model, by a score of ``least`` or more; columns as they were.

    A model that learnt no language rejects nothing.
    """
    if not model.languages:
        return docs
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, scores = score(shared.value, batch.column(at).to_pylist())
            yield batch.filter(pa.array((scores >= least) & np.array([f != UNKNOWN for f in found], bool)))

    return docs.mapInArrow(keep, docs.schema)
