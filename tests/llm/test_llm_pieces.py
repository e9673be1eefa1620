"""Pieces: the single pass against a plain Viterbi over all substrings, and exact round trips."""

import random

import public_tokenizers
import sentencepiece
from text_cases import DOCS, documents

from tablewright.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")


def plain_viterbi(vocabulary, rare, text):
    best, back = [0.0], [None]
    for end in range(1, len(text) + 1):
        options = [(best[start] + vocabulary[text[start:end]], -start) for start in range(max(0, end - 16), end) if text[start:end] in vocabulary]
        if text[end - 1] not in vocabulary:
            options.append((best[end - 1] + rare, -(end - 1)))
        score, start = max(options, key=lambda o: (o[0], o[1]))
        best.append(score)
        back.append(-start)
    cuts, end = [], len(text)
    while end:
        cuts.append(text[back[end]:end])
        end = back[end]
    return cuts[::-1]


def test_segments_equal_a_plain_viterbi():
    small = pieces.Pieces([(n, p, s) for n, (p, s) in enumerate(
        [("a", -2.0), ("b", -2.0), ("ab", -3.5), ("abc", -3.0), ("▁", -1.0), ("▁a", -2.5), ("bca", -3.0), ("▁▁", -1.5)])],
        {300 + b: b for b in range(256)}, 999)
    vocabulary = {"a": -2.0, "b": -2.0, "ab": -3.5, "abc": -3.0, " ": -1.0, " a": -2.5, "bca": -3.0, "  ": -1.5}
    names = {0: "a", 1: "b", 2: "ab", 3: "abc", 4: " ", 5: " a", 6: "bca", 7: "  "}
    rng = random.Random(5)
    for _ in range(300):
        text = "".join(rng.choice("abc  ") for _ in range(rng.randrange(12)))
        expected = plain_viterbi(vocabulary, small.rare, " " + text) if text else []
        ids, ends = small.encode([text])
        assert [names.get(n, chr(n - 300) if n >= 300 else None) for n in ids.tolist()] == expected, text
        assert small.decode(ids, ends)[0].decode() == text


def test_words_give_what_whole_texts_give():
    model = pieces.load(PATH)
    reader = sentencepiece.SentencePieceProcessor(model_file=PATH)
    vocabulary = {reader.id_to_piece(n).replace("▁", " "): reader.get_score(n) for n in range(259, reader.get_piece_size())}
    for text in ["Hello  world", "▁ mark", "a\n\nb  c\t", "日本語 😀 x", "thereby interesting things", "   "]:
        ids, ends = model.encode([text])
        assert ids.tolist() == model.segment(" " + text)
        assert model.decode(ids, ends)[0].decode() == text
        if all(c in vocabulary for c in " " + text):
            assert [reader.id_to_piece(n).replace("▁", " ") for n in ids.tolist()] == plain_viterbi(vocabulary, model.rare, " " + text)


def test_a_vocabulary_whose_pieces_cross_words():
    model = pieces.Pieces([(0, "a", -1.0), (1, "▁", -1.0), (2, "a▁a", -1.0)], {}, 9)
    assert model.encode(["a a"])[0].tolist() == [1, 2]


def test_documents_round_trip(spark):
    df = documents(spark, clashing=True)
    found = pieces.encoded(df, PATH)
    assert found.columns == [*df.columns, "piece_ids_", "round_trip"]
    rows = found.collect()
    assert len(rows) == 10 and all(r["round_trip"] for r in rows)
    assert all((r["piece_ids_"] == []) == (not r["text"]) for r in rows)
    back = pieces.decoded(pieces.encoded(documents(spark), PATH), PATH)
    assert sorted((r["doc_id"] or 0, r["text"]) for r in back.collect()) == sorted((r["doc_id"] or 0, r["text"] or "") for r in rows)


def test_empty_table(spark):
    assert pieces.encoded(spark.createDataFrame([], DOCS), PATH).collect() == []
