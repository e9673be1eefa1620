"""Jaccard join: every row against brute force over all pairs, with stars cut small, chains and awkward rows."""

import random
import re

import numpy as np
import pytest
from text_cases import DOCS, documents

from tablewright.llm import jaccard

SMALL = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def plain_set(text, n):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(SMALL))
    return frozenset(zip(*[words[k:] for k in range(n)])) if len(words) >= n else frozenset([tuple(words)] if words else [])


def plain(rows, n, percent):
    sets = [plain_set(text, n) for _, text in rows]
    parent = list(range(len(rows)))

    def root(at):
        while parent[at] != at:
            at = parent[at]
        return at

    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a], sets[b]
            if rows[a][0] is None or rows[b][0] is None or not x or not y:
                continue
            if rows[a][0] == rows[b][0] or 100 * len(x & y) >= percent * len(x | y):
                parent[root(a)] = root(b)
    least = {}
    for at, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[root(at)] = min(least.get(root(at), doc_id), doc_id)
    return sorted(((d, len(s), least.get(root(at)) if d is not None else None) for at, ((d, _), s) in enumerate(zip(rows, sets))), key=repr)


def check(spark, rows, n, percent):
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = jaccard.classes(df, n, percent)
    assert found.dtypes == [("doc_id", "bigint"), ("n_shingles", "bigint"), ("component_id", "bigint")]
    assert sorted(map(tuple, found.collect()), key=repr) == plain(rows, n, percent)


def corpus(seed, count):
    """Chains and stars of edited copies, copies, short texts."""
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefgh") + str(rng.randrange(60))
    texts = []
    for _ in range(count):
        kind = rng.random()
        if kind < 0.3 or not texts:
            texts.append([word() for _ in range(rng.choice([1, 2, 3, 5, 8, 12, 20, 60, 150]))])
        elif kind < 0.4:
            texts.append(list(rng.choice(texts)))
        else:
            copy = list(rng.choice(texts))
            for _ in range(rng.randrange(1, 4)):
                at = rng.randrange(len(copy) + 1)
                copy[at:at + rng.randrange(2)] = [word() for _ in range(rng.randrange(2))]
            texts.append(copy)
    return [(n, " ".join(t).upper() if n % 7 == 0 else " ".join(t)) for n, t in enumerate(texts)]


@pytest.mark.parametrize("n, percent, unit", [(3, 90, 512), (5, 80, 2), (1, 50, 3)])
def test_against_brute_force(spark, monkeypatch, n, percent, unit):
    monkeypatch.setattr(jaccard, "UNIT", unit)
    check(spark, corpus(n, 220), n, percent)


def test_a_large_star_cut_into_units(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "UNIT", 4)
    rng = random.Random(9)
    base = [f"w{k}" for k in range(120)]
    rows = [(0, " ".join(base))]
    for k in range(1, 60):
        copy = list(base)
        for _ in range(rng.randrange(1, 3)):
            copy[rng.randrange(120)] = f"x{k}"
        rows.append((k, " ".join(copy)))
    rows.append((99, "another text altogether with no near copy"))
    check(spark, rows, 3, 90)


def test_awkward_rows(spark):
    check(spark, [(r["doc_id"], r["text"]) for r in documents(spark).collect()], 3, 90)
    assert jaccard.classes(documents(spark, clashing=True)).count() == 10
    assert jaccard.classes(spark.createDataFrame([], DOCS)).collect() == []


def test_one_id_with_two_texts(spark):
    check(spark, [(1, "a b c d e"), (2, "f g h i j"), (3, "a b c d e"), (3, "f g h i j")], 3, 90)


def test_sets_and_budgets():
    texts = ["", "one", "Two words", "x y z x y z", "\x0b\x0c a b \x1c c", "é É ß A"]
    for n in (1, 2, 3):
        found = jaccard.shingles([t.encode() for t in texts], n)
        assert [len(f) for f in found] == [len(plain_set(t, n)) for t in texts]
    assert [len(f) for f in jaccard.shingles([b"one two", b""], 5)] == [1, 0] and len(jaccard.shingles([b""], 5)[0]) == 0
    same = jaccard.shingles([b"ONE two\nthree", b"one  two three", b"three two one"], 3)
    assert (same[0] == same[1]).all() and (same[0] != same[2]).all()
    for percent in (50, 80, 90):
        for a in range(1, 120):
            for b in range(a, 100 * a // percent + 1):
                least = -(-percent * (a + b) // (100 + percent))
                if least <= a:
                    assert a + b - 2 * least <= jaccard.budget(jaccard.band_of(a), percent)
                    assert b <= 100 * jaccard.band_end(jaccard.band_of(a)) // percent
                    assert jaccard.band_of(b) - jaccard.band_of(a) <= (1 if percent >= 80 else 2)


def test_bit_counts_bound_the_overlap():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 2 ** 63, 400, dtype=np.uint64)[:rng.integers(1, 400)]) for _ in range(6)]
    sets.append(np.unique(np.concatenate([sets[0], sets[1]])))
    maps = jaccard.bitmaps(sets)
    for a, x in enumerate(sets):
        for b, y in enumerate(sets):
            assert len(np.intersect1d(x, y)) <= len(x) - int(np.bitwise_count(maps[a] & ~maps[b]).sum())


def test_keep_one(spark):
    words = " ".join(f"w{k}" for k in range(80))
    rows = [(5, words, "en", "a", 1), (3, words + " end", "en", "a", 1), (3, words + " end", "en", "a", 1), (8, "alone here", "en", "b", 1),
            (9, None, "en", "b", 1), (10, "", "en", "b", 1), (None, words, "en", "b", 1)]
    kept = jaccard.keep_one(documents(spark, rows, clashing=True))
    assert kept.columns == documents(spark, rows, clashing=True).columns
    assert sorted(((r["doc_id"] or -1) for r in kept.collect())) == [-1, 3, 8, 9, 10]


def test_near_copies_of_both_texts_of_one_id(spark):
    rng = random.Random(4)
    x, y = ([f"{name}{rng.randrange(10**6)}" for _ in range(200)] for name in "xy")
    rows = [(3, " ".join(x)), (3, " ".join(y)), (5, " ".join(x[:-1])), (6, " ".join(y[:-1])), (7, " ".join(y[:-2])), (8, "alone")]
    check(spark, rows, 3, 90)
    check(spark, [(2, " ".join(x[:-2]))] + rows, 3, 90)
    # X and Y have a smaller id of their own, and one row more has the id of Y's.
    check(spark, [(1, " ".join(x)), (2, " ".join(y)), (2, "other words of no kind")] + rows, 3, 90)
