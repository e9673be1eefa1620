"""Mixing: less than one block away from the targets in every prefix, all rows placed, awkward rows."""

from collections import Counter
from itertools import islice

import pytest
from text_cases import DOCS, documents

from tablewright.llm import mixing


@pytest.mark.parametrize("weights", [{"a": 1.0}, {"a": 3, "b": 1}, {"a": 0.5, "b": 0.3, "c": 0.15, "d": 0.05}, {n: n + 1 for n in range(30)}])
def test_every_prefix_is_within_a_block(weights):
    share = mixing.exact(weights)
    total, seen = sum(share.values()), Counter()
    for slot, source in enumerate(islice(mixing.deal(dict.fromkeys(share, 1 << 20), share), 600)):
        seen[source] += 1
        assert all(abs(seen[s] * total - (slot + 1) * share[s]) < total for s in share)
    assert sum(seen.values()) == 600


@pytest.mark.parametrize("counts", [
    {0: 333_333} | {n: 33_333 for n in range(1, 21)}, {0: 1_000_000} | {n: 50_000 for n in range(1, 41)},
    {n: 160 for n in range(3_000)} | {"hot": 50_000}])
def test_every_prefix_keeps_to_the_real_weights(counts):
    """The first phase at the default period, by whole numbers: the error of every source in blocks stays under one."""
    share = mixing.exact({source: rows ** 0.5 for source, rows in counts.items()})
    total, order = sum(share.values()), {}
    for source, phase, *_, own in mixing.phases(counts, share, 16):
        if phase:
            break
        order.update(dict.fromkeys(own, source))
    assert sorted(order) == list(range(len(order)))
    # A source's error grows between its blocks, so it is looked at right before and right after each, and at the end.
    seen = Counter()
    for slot in range(len(order)):
        source = order[slot]
        assert seen[source] * total > slot * share[source] - total
        seen[source] += 1
        assert seen[source] * total < (slot + 1) * share[source] + total
    assert all(abs(seen[s] * total - len(order) * share[s]) < total for s in share)


def test_a_plan_in_parts(spark, monkeypatch):
    df = documents(spark)
    whole = sorted(map(repr, mixing.positions(df, block_rows=2).collect()))
    monkeypatch.setattr(mixing, "HELD", 1)
    assert sorted(map(repr, mixing.positions(df, block_rows=2, period=1).collect())) == whole


def test_phases_place_every_block():
    counts, weights = {"a": 1_000, "b": 130, "c": 7, None: 64}, {"a": 1, "b": 1, "c": 2, None: 1}
    plan = mixing.phases(counts, weights, 16, 10)
    slots = {}
    for source, _, first, end, base, _, share, period, own in plan:
        for block in range(first, end):
            slot = base + (block - first) // share * period + own[(block - first) % share]
            assert slots.setdefault(slot, (source, block)) == (source, block)
    assert sorted(slots) == list(range(len(slots)))
    assert Counter(source for source, _ in slots.values()) == {s: -(-n // 16) for s, n in counts.items()}


def test_rows_of_a_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    weights = {f"src{n}": n + 1 for n in range(20)}
    rows = sorted(mixing.positions(docs, weights, block_rows=4, period=210).collect(), key=lambda r: r["position"])
    assert [r["position"] for r in rows] == list(range(1_000))
    assert {r["doc_id"] for r in rows} == set(range(1_000))
    for source in ("src0", "src7"):
        own = [r for r in rows if r["source"] == source]
        assert [r["doc_id"] for r in own] == sorted(r["doc_id"] for r in own)
    first = [r for r in rows if r["phase"] == 0]
    seen, total = Counter(), sum(weights.values())
    for at, row in enumerate(first, start=1):
        seen[row["source"]] += 1
        if at % 4 == 0:
            assert all(abs(seen[s] - at * w / total) < 4 for s, w in weights.items())


def test_awkward_rows(spark):
    df = documents(spark, clashing=True)
    rows = mixing.positions(df, block_rows=2).collect()
    assert sorted(r["position"] for r in rows) == list(range(10))
    mixed = mixing.mixed(df)
    assert mixed.columns == df.columns
    assert sorted(map(repr, mixed.collect())) == sorted(map(repr, df.collect()))
    assert mixing.positions(spark.createDataFrame([], DOCS)).collect() == []
    with pytest.raises(ValueError, match="positive weight"):
        mixing.positions(df, {"a": 1.0})
