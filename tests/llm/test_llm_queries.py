"""The registered queries: names, columns and kinds by contract; the one in SQL against DuckDB; the pipeline by stages."""

from collections import Counter

import corpus_pipeline
import oracle
import pytest
from test_llm_jaccard import plain, plain_set
from text_cases import DOCS, documents

import __spark_entry__ as contract
from tablewright.llm import language, quality
from tablewright.llm.queries import QUERIES, SQL
from tablewright.session import settle

SF = "/root/testdata/sf0.001"
COLUMNS = {
    1: "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint",
    2: "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    3: "doc_id bigint, held_out boolean, score double, predicted int",
    4: "doc_id bigint, n_pieces bigint, piece_ids array<int>, round_trip boolean",
    5: "query_id bigint, rank int, vec_id bigint, score bigint",
    6: "doc_id bigint, held_out boolean, lang_pred string, score double",
    7: "page_id bigint, url string, text string, n_chars bigint",
    8: "doc_id bigint, n_shingles bigint, component_id bigint",
    9: "doc_id bigint, source string, block bigint, phase int, slot bigint, position bigint",
    10: "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double",
    11: "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output_sha256 string, restored_sha256 string",
    12: "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string",
    13: "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint",
}
ROWS = {5: 50, 7: 50, 13: 21}


def test_all_are_registered():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(contract.queries())
    assert set(SQL) <= set(contract.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_columns_and_rows(spark, name):
    number = int(name[2:].split("_")[0])
    found = QUERIES[name](spark, SF)
    assert ", ".join(f"{c} {kind}" for c, kind in found.dtypes) == COLUMNS[number]
    assert found.count() == ROWS.get(number, 200)


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, name):
    assert oracle.compare(QUERIES[name](spark, SF), SQL[name], SF) == []


def test_pipeline_by_stages(spark):
    """Each stage on what the one before kept, against what its operator's own tests have shown."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, settle(stage(spark, docs, SF))
        kept[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
        if stage is not corpus_pipeline.sentencepiece:
            assert docs.schema.simpleString() == before.schema.simpleString()
    names = [name for name, _ in corpus_pipeline.STAGES]
    every = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    model = language.fit(spark.read.parquet(f"{SF}/documents.parquet"))
    found, scores = language.score(model, list(every.values()))
    assert set(kept[names[0]]) == {d for d, f, s in zip(every, found, scores) if f != "und" and s >= 0.5}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = [d in kept[names[1]] for d in kept[names[0]] if labels.get(d) == 1]
    assert sum(good) >= 0.95 * len(good)
    rows = plain(list(kept[names[1]].items()), 5, 80)
    assert set(kept[names[2]]) == {component for _, _, component in rows}
    assert kept[names[3]] == kept[names[2]] == kept[names[4]]
    assert docs.filter("NOT round_trip").isEmpty() and plain_set("a b c d e", 5)


def test_awkward_rows_through_all_stages(spark):
    docs = documents(spark, clashing=True)
    names = docs.columns
    for _, stage in corpus_pipeline.STAGES:
        docs = settle(stage(spark, docs, SF))
        assert docs.columns[:len(names)] == names
    empty = documents(spark, rows=[])
    for _, stage in corpus_pipeline.STAGES:
        empty = settle(stage(spark, empty, SF))
    assert empty.count() == 0


def test_the_mix_lasts_to_the_result(spark):
    """Sorted by ``mix_position``, what the last stage wrote keeps every prefix at the targets, whatever its files' order."""
    rows = {"a": 1_600, "b": 400, "c": 100}
    docs = spark.createDataFrame([(n, f"word {n}", "en", s, 6) for s in rows for n in range(rows[s])], DOCS).repartition(7)
    mixed = settle(corpus_pipeline.source_mixing(spark, docs, SF))
    found = settle(corpus_pipeline.sentencepiece(spark, mixed, SF).repartition(5)).orderBy("mix_position").collect()
    assert [r["mix_position"] for r in found] == list(range(2_100))
    seen, weights = Counter(), {s: n ** 0.5 for s, n in rows.items()}
    for at, row in enumerate(found, start=1):
        seen[row["source"]] += 1
        if at % 16 == 0:
            assert all(abs(seen[s] - at * w / sum(weights.values())) < 16 for s, w in weights.items())
        if any(seen[s] > n - 16 for s, n in rows.items()):
            break
    assert at > 600


def test_scores_reject_by_threshold():
    assert quality.THRESHOLD == 0.3
