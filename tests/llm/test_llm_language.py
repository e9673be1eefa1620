"""Language: held-out accuracy, the batch score against a plain one, and awkward rows."""

import math

import numpy as np
import pytest
from text_cases import DOCS, documents

from tablewright.llm import language

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = language.identify(docs, language.fit(docs))
    assert found.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("lang_pred", "string"), ("score", "double")]
    judged = found.join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").select("lang", "lang_pred").collect()
    assert sum(a == b for a, b in judged) / len(judged) > 0.98
    assert language.keep_identified(docs, language.fit(docs, fit_rows=200)).count() > 0.99 * docs.count()


def test_batch_score_equals_a_plain_sum(monkeypatch):
    rng = np.random.default_rng(4)
    model = language.Model(["x", "y"], rng.normal(size=(language.BUCKETS, 2)).astype(np.float32), np.log([0.3, 0.7]))
    texts = ["Hello, World", None, "", "12 !?", "é", "a b  c" * 50]
    names, scores = language.score(model, texts)
    for text, name, score in zip(texts, names, scores):
        grams = language.buckets([(text or "").lower()])[0]
        if not len(grams):
            assert (name, score) == ("und", 0.0)
            continue
        sums = model.logs[grams].astype(float).sum(axis=0) * min(1, language.EVIDENCE / len(grams)) + model.prior
        odds = [math.exp(s - max(sums)) for s in sums]
        assert name == model.languages[int(np.argmax(odds))] and score == pytest.approx(max(odds) / sum(odds))
    # Long texts are cut into pieces without losing or doubling a gram but for those of the seams' shorter orders.
    monkeypatch.setattr(language, "PIECE", 64)
    again = language.score(model, texts)
    assert again[0] == names and np.allclose(again[1], scores, atol=0.02)


def test_grams_do_not_cross_texts():
    alone = [language.buckets([t])[0].tolist() for t in ("ab", "cd")]
    both, owner = language.buckets(["ab", "cd"])
    assert [sorted(both[owner == n].tolist()) for n in (0, 1)] == [sorted(a) for a in alone]


def test_awkward_rows(spark):
    model = language.fit(documents(spark, clashing=True))
    assert model.languages == ["de", "en", "fr"] or set(model.languages) <= {"de", "en", "fr"}
    found = language.identify(documents(spark, clashing=True), model).collect()
    assert len(found) == 10
    for row, text in ((r, t) for r in found for t in [r["doc_id"]] if t in (3, 4, 5)):
        assert (row["lang_pred"], row["score"]) == ("und", 0.0)
    clashing = documents(spark, clashing=True)
    kept = language.keep_identified(clashing, model, least=0.0)
    assert kept.columns == clashing.columns and kept.count() == 7


def test_empty_tables_and_no_labels(spark):
    empty = spark.createDataFrame([], DOCS)
    model = language.fit(empty)
    assert model.languages == [] and language.identify(empty, model).collect() == []
    assert {r["lang_pred"] for r in language.identify(documents(spark), model).collect()} == {"und"}
    assert language.keep_identified(documents(spark), model).count() == 10
