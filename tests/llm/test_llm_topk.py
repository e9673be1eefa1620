"""Top-k: all rows against brute force, with ties, odd vectors and scores beyond doubles."""

import math

import numpy as np
import pytest

from tablewright.llm import topk

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def plain(rows, k, every):
    vectors = {}
    for vec_id, vector in rows:
        if vec_id is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        found = [math.floor(256 * float(np.float32(x))) for x in vector]
        vectors[vec_id] = min(vectors.get(vec_id, found), found)
    answer = []
    for q, a in vectors.items():
        if q % every == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b)), v) for v, b in vectors.items() if v != q)[:k]
            answer += [(q, rank, v, -s) for rank, (s, v) in enumerate(scored, start=1)]
    return sorted(answer)


@pytest.mark.parametrize("tile, block", [(8_192, 128), (16, 4)])
def test_against_brute_force(spark, monkeypatch, tile, block):
    monkeypatch.setattr(topk, "TILE", tile)
    monkeypatch.setattr(topk, "BLOCK", block)
    rng = np.random.default_rng(2)
    rows = [(n, rng.normal(size=5).round(1).tolist()) for n in range(90)]
    rows += [(90 + n, [0.5, 0.5, 0.5, 0.5, 0.5]) for n in range(40)] + [(200, [0.0] * 5), (7, rows[7][1])]
    rows += [(300, None), (301, [1.0, None, 0.0, 0.0, 0.0]), (302, [float("nan")] * 5), (310, [float("inf")] * 5), (None, [1.0] * 5)]
    df = spark.createDataFrame([(v, e, 1) for v, e in rows], SCHEMA)
    found = topk.top_k(df, k=5, every=10)
    assert found.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "bigint")]
    assert sorted(map(tuple, found.collect())) == plain(rows, 5, 10)


def test_fewer_rows_than_k_and_empty_tables(spark):
    few = spark.createDataFrame([(0, [1.0, 2.0], 1), (1, [0.5, -1.0], 1)], SCHEMA)
    assert [tuple(r) for r in topk.top_k(few).collect()] == [(0, 1, 1, 128 * 256 - 256 * 512)]
    assert topk.top_k(spark.createDataFrame([(0, [1.0], 1)], SCHEMA)).collect() == []
    assert topk.top_k(spark.createDataFrame([(3, [1.0], 1)], SCHEMA)).collect() == []
    assert topk.top_k(spark.createDataFrame([], SCHEMA)).collect() == []


def test_sums_beyond_doubles_are_exact():
    rng = np.random.default_rng(0)
    small = rng.integers(-3, 4, (60, 4))
    ids = np.arange(60)
    q, place, score = topk.search(ids[:5], small[:5] * 2.0 ** 40, ids, small * 2.0 ** 40, 3)
    for n in range(5):
        expected = sorted((-int(small[n] @ small[m]) * 2 ** 80, m) for m in range(60) if m != n)[:3]
        assert [(-int(s), int(p)) for p, s in zip(place[q == n], score[q == n])] == expected
