"""Cross-tokenizer alignment against whole texts, tokenized by the libraries and compared pair by pair."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings, strategies as st
from text_cases import documents
from tokenizers import Tokenizer

from tablewright.llm import alignment

FILES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
BITS = ["foo", " bar", "\n", "\n\n", " ", "  ", "\t", "\r\n", ");\r\n", "é", "日本", "😀", "　", "\xa0", "<|endoftext|>", "<s>", "</s>",
        "<0x41>", "'s", "123", "--", " ", "the", "\x1c", "á", "ſ", "ﬁ", "​"]


@pytest.fixture(scope="module")
def libraries():
    first = Tokenizer.from_file(FILES[0])
    first.encode_special_tokens = True
    return first, sentencepiece.SentencePieceProcessor(model_file=FILES[1])


def plain(libraries, text):
    """Numbers of tokens, groups as text and links of one text; None without tokens."""
    if not text:
        return None
    first, second = libraries
    level, data = alignment.byte_level(), (" " + text).encode()
    a, b = first.encode(" " + text, add_special_tokens=False).ids, second.encode(text)
    parts = ([bytes(level[c] for c in first.id_to_token(n)) for n in a],
             [bytes([int(second.id_to_piece(n)[1:-1], 16)]) if second.is_byte(n) else second.id_to_piece(n).replace("▁", " ").encode() for n in b])
    if any(b"".join(p) != data for p in parts):
        return None
    ends_a, ends_b = (np.cumsum([len(x) for x in p]).tolist() for p in parts)
    links = [(a[i], b[j]) for i in range(len(a)) for j in range(len(b))
             if max(ends_a[i] - len(parts[0][i]), ends_b[j] - len(parts[1][j])) < min(ends_a[i], ends_b[j])]
    groups, at = [], (0, 0)
    for end in sorted(set(ends_a) & set(ends_b)):
        to = ends_a.index(end) + 1, ends_b.index(end) + 1
        groups.append("|".join(",".join(map(str, ids[x:y])) for ids, x, y in zip((a, b), at, to)))
        at = to
    return len(a), len(b), groups, links


def corpus(libraries, texts):
    found = [plain(libraries, t) for t in texts]
    held = Counter(pair for f in found if f for pair in set(f[3]))
    best = {}
    for (a, _), n in held.items():
        best[a] = max(best.get(a, 0), n)
    return [(0, 0, 0, 0, 0, 0, "") if f is None else (
        f[0], f[1], len(f[2]), len(f[3]), sum(held[p] == best[p[0]] for p in f[3]), sum(held[p] for p in f[3]),
        hashlib.sha256(";".join(f[2]).encode()).hexdigest()) for f in found]


def awkward(count, seed=0):
    draw = random.Random(seed)
    return [None, "", " ", "\n", "a", "▁", "x ▁", "x" * 500] + [
        "".join(draw.choices(BITS + ["▁"] * (n % 3 == 0), k=draw.randint(1, 25))) for n in range(count)]


@pytest.mark.parametrize("chunk", [200, alignment.CHUNK])
def test_against_all_pairs(spark, libraries, monkeypatch, chunk):
    monkeypatch.setattr(alignment, "CHUNK", chunk)
    texts = awkward(500) + [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).collect()
                            if len(r["text"]) < 3_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    found = {r["doc_id"]: tuple(r)[1:] for r in alignment.align(docs, *FILES).collect()}
    want = corpus(libraries, texts)
    assert len(found) == len(texts) and sum(w[6] == "" for w in want) > 20
    assert [n for n in range(len(texts)) if found[n] != want[n]] == []


def test_windows_of_a_long_text_and_a_small_memory(libraries, monkeypatch):
    monkeypatch.setattr(alignment, "PIECE", 40)
    monkeypatch.setattr(alignment, "REMEMBERED", 50)
    aligner = alignment.load.__wrapped__(*FILES)
    for text in awkward(300, seed=3):
        if text:
            pairs, often, facts = aligner.summary(text)
            f = plain(libraries, text)
            assert facts == ((0, 0, 0, 0, "") if f is None else (f[0], f[1], len(f[2]), len(f[3]), hashlib.sha256(";".join(f[2]).encode()).hexdigest()))
            width = aligner.width
            assert Counter({divmod(p, width): n for p, n in zip(pairs.tolist(), often.tolist())}) == Counter(f[3] if f else [])


def test_groups_are_the_ids(spark, libraries):
    docs = documents(spark, clashing=True).selectExpr("*", "'own' AS alignment")
    rows = alignment.groups(docs, *FILES)
    assert rows.columns == [*docs.columns, "alignment_"]
    for r in rows.collect():
        f = plain(libraries, r["text"]) if len(r["text"] or "") < 5_000 else None
        if f:
            assert ["|".join(",".join(map(str, ids)) for ids in g) for g in r["alignment_"]] == f[2]
        elif not r["text"]:
            assert r["alignment_"] == []


def test_awkward_rows_and_no_rows(spark):
    rows = alignment.align(documents(spark, clashing=True), *FILES).collect()
    assert len(rows) == 10 and sum(r["n_a"] == 0 for r in rows) == 2 and all((r["groups_sha256"] == "") == (r["n_a"] == 0) for r in rows)
    copies = [tuple(r) for r in rows if r["doc_id"] == 2]
    assert len(copies) == 2 and copies[0] == copies[1]
    assert alignment.align(documents(spark, rows=[]), *FILES).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 9), max_size=60), st.data())
def test_galloping_finds_what_bisection_finds(steps, data):
    ends = np.cumsum(np.array(steps, np.int64))
    size = len(ends)
    bounds = data.draw(st.lists(st.tuples(st.integers(0, size), st.integers(0, size), st.integers(0, 300)), min_size=1, max_size=20))
    first = np.array([min(a, b) for a, b, _ in bounds], np.int64)
    last = np.array([max(a, b) for a, b, _ in bounds], np.int64)
    wanted = np.array([w for *_, w in bounds], np.int64)
    want = [a + int(np.searchsorted(ends[a:b], w)) for a, b, w in zip(first, last, wanted)]
    assert alignment.gallop(wanted, ends, first, last).tolist() == want
