"""Shards: groups together, near-equal sizes, gapless slots; the heap and its starting loads against brute force."""

import random
import zlib
from collections import Counter, defaultdict

from text_cases import DOCS, documents

from tablewright.llm import sharding


def test_fill_is_least_loaded_pouring():
    rng = random.Random(1)
    for _ in range(200):
        loads = [rng.randrange(50) for _ in range(rng.randrange(1, 6))]
        amount, level = rng.randrange(200), list(loads)
        for _ in range(amount):
            level[level.index(min(level))] += 1
        assert sorted(sharding.fill(loads, amount)) == sorted(level)


def test_heap_takes_the_least_loaded():
    assert sharding.lpt([7, 5, 4, 3, 1], [0, 0]) == [0, 1, 1, 0, 1]
    assert sharding.lpt([2, 2], [10, 0]) == [1, 1]


def placed(df, shards):
    rows = [r.asDict() for r in sharding.assign_shards(df, shards).collect()]
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < shards
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return rows


def test_awkward_rows(spark):
    rows = placed(documents(spark, clashing=True), 4)
    texts = Counter((r["doc_id"], len((r["text"] or "").encode()) + 8, zlib.crc32((r["text"] or "").encode()))
                    for r in documents(spark).collect())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == texts
    groups = defaultdict(set)
    for r in rows:
        groups[r["size"], r["text_crc32"]].add(r["shard"])
    assert all(len(g) == 1 for g in groups.values())


def test_empty_table(spark):
    assert placed(spark.createDataFrame([], DOCS), 3) == []


def test_balance_in_many_runs_with_a_giant_group(spark, monkeypatch):
    monkeypatch.setattr(sharding, "FINE", 4)
    monkeypatch.setattr(sharding, "RUN_ROWS", 60)
    rng = random.Random(3)
    rows = [(n, "t" * rng.randrange(1, 90) + str(n), "en", "a", 0) for n in range(900)]
    rows += [(10_000 + n, "the same text again and again", "en", "a", 0) for n in range(600)]
    found = placed(spark.createDataFrame(rows, DOCS), 5)
    sizes = Counter()
    for r in found:
        sizes[r["shard"]] += r["size"]
    giant = {r["shard"] for r in found if r["doc_id"] >= 10_000}
    assert len(giant) == 1
    others = [sizes[s] for s in range(5) if s not in giant]
    assert max(others) - min(others) <= 2 * 100


def test_write_shards(spark, tmp_path):
    sharding.write_shards(documents(spark), str(tmp_path / "out"), 3)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == documents(spark).count()
    assert back.filter("text LIKE 'A plain%'").select("_shard").distinct().count() == 1
