"""Token files: exact round trips of the coder, and the query's columns against the tokenizer itself."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from text_cases import DOCS, documents, rows_of
from tokenizers import Tokenizer

from tablewright.llm import tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("count", [0, 1, 2, 511, 512, 513, 1_700])
def test_coder_round_trip(count):
    rng = np.random.default_rng(count)
    for ids in (rng.integers(0, 50_257, count), rng.integers(0, 2, count), np.full(count, 50_256), rng.zipf(1.2, count) % 60_000,
                np.arange(count) % 7, rng.integers(0, tokens.LARGEST, count),
                np.where(np.arange(count) % 50, 3, rng.integers(tokens.LARGEST // 2, tokens.LARGEST, count)),
                np.where(rng.random(count) < 0.01, 40_000, 5)):
        chunk = tokens.pack([5, None], np.array([count // 3, count - count // 3]), ids.astype(np.uint32), block=512)
        doc_ids, lengths, back = tokens.unpack(chunk)
        assert doc_ids == [5, None] and lengths.sum() == count and (back == ids).all()


def test_repetition_is_compressed():
    ids = np.tile(np.arange(300, 340), 200).astype(np.uint32)
    assert len(tokens.pack([1], np.array([len(ids)]), ids)) < len(ids) // 2


def test_ids_of_documents_take_less_than_general_compression_and_than_their_entropy(spark):
    memory = tokens.byte_bpe(PATH)
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").limit(300).collect()]
    ids = memory.encode_all(texts)[0].astype(np.int64)
    counts = np.unique(ids, return_counts=True)[1]
    entropy = -(counts * np.log2(counts / len(ids))).sum() / 8 / len(ids)
    for block, below in ((tokens.BLOCK, 1.05 * entropy), (8 * tokens.BLOCK, entropy)):
        coded = sum(map(len, tokens.encode_blocks(ids, block, int(ids.max())))) / len(ids)
        general = sum(len(zlib.compress(ids[at:at + block].astype("<u2").tobytes(), 9)) for at in range(0, len(ids), block)) / len(ids)
        assert coded < 0.9 * general and coded < below


def test_lanes_in_groups(monkeypatch):
    ids = np.random.default_rng(1).zipf(1.3, 9_000) % 5_000
    whole = tokens.encode_blocks(ids, 512, 5_000)
    monkeypatch.setattr(tokens, "TABLE", 15_100)
    assert tokens.lanes_at_once(18, 5_000) == 3 and tokens.lanes_at_once(4, 5_000) == 2 and tokens.encode_blocks(ids, 512, 5_000) == whole
    assert (tokens.decode_blocks(whole, 9_000, 512, 5_000) == ids).all()


def test_blocks_are_independent_and_checked():
    ids = np.random.default_rng(0).integers(0, 50_000, 10_000).astype(np.uint32)
    first = tokens.encode_blocks(ids, tokens.BLOCK, 50_000)
    assert first[1] == tokens.encode_blocks(ids[tokens.BLOCK:2 * tokens.BLOCK], tokens.BLOCK, 50_000)[0]
    chunk = bytearray(tokens.pack([1], np.array([10_000]), ids))
    chunk[-2_000] ^= 1
    with pytest.raises(ValueError, match="damaged"):
        tokens.unpack(bytes(chunk))
    with pytest.raises(ValueError, match="not a chunk"):
        tokens.unpack(b"XXXX" + bytes(chunk[4:]))


@pytest.mark.parametrize("block", [64, 2_048, 40_000])
def test_carries_and_long_blocks(block):
    rng = np.random.default_rng(block)
    for ids in (np.where(rng.random(90_000) < 0.999, 7, rng.integers(0, 50_000, 90_000)), rng.zipf(1.1, 90_000) % 50_257, np.arange(90_000) % 50_257):
        blocks = tokens.encode_blocks(ids, block, 50_256)
        assert (tokens.decode_blocks(blocks, len(ids), block, 50_256) == ids).all()


def test_state_of_a_lane_does_not_grow_with_the_vocabulary():
    def size(largest):
        models = tokens.Models(8, 2_048, largest)
        arrays = [*vars(models).values(), *vars(models.seen).values()]
        return sum(x.nbytes for x in arrays if isinstance(x, np.ndarray))

    assert size(tokens.LARGEST - 1) < 1.1 * size(10)


def test_words_before_different_punctuation_are_learnt_once():
    memory = tokens.byte_bpe(PATH, as_given=True)
    memory.forget()
    memory.encode_all([" strange, strange. strange%%% strange\n strange7 strange"])
    assert [w for w in memory.place if "strange" in w] == [" strange", "\n strange"]


@pytest.mark.parametrize("as_given", [False, True])
def test_random_texts_word_by_word(as_given):
    whole, memory, rng = Tokenizer.from_file(PATH), tokens.byte_bpe(PATH, as_given=as_given), np.random.default_rng(5)
    whole.encode_special_tokens = not as_given
    parts = ["<|endoftext|>", "endoftext", "|", "<", " ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", "'s", "'", "é", "ß", "1", "٣", "²", "a", "bc", "Z", ".",
             "%%%", ",", "_", "-", "　", "漢", "é", "ſ", "😀", "'ll", "don't", "\0"]
    texts = ["".join(parts[n] for n in rng.integers(0, len(parts), rng.integers(0, 14))) for _ in range(2_000)]
    memory.forget()
    ids, ends = memory.encode_all(texts)
    for text, begin, end in zip(texts, ends, ends[1:]):
        assert ids[begin:end].tolist() == whole.encode(text, add_special_tokens=False).ids, repr(text)


def test_word_by_word_equals_whole_text():
    whole = Tokenizer.from_file(PATH)
    whole.encode_special_tokens = True
    memory = tokens.byte_bpe(PATH)
    for text in ["", " ", "a  b", "can't  stop\t\tx ", "<|endoftext|> a", "!\x1cb", "a\x85!\xa0 b  ", "x\n\n\n y\r\n", "　全 角 b", "don 't", "1 2  3"]:
        assert memory.encode_all([text])[0].tolist() == whole.encode(text, add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize("clashing", [False, True])
def test_round_trip_against_the_tokenizer(spark, clashing):
    df = documents(spark, clashing=clashing)
    whole = Tokenizer.from_file(PATH)
    whole.encode_special_tokens = True
    rows = sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or "") for r in df.collect())
    expected, start = [], 0
    for known, doc_id, text in rows:
        ids = np.array(whole.encode(text, add_special_tokens=False).ids + [2], "<u4")
        expected.append((doc_id if known else None, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    found = tokens.round_trip(df, PATH)
    assert found.dtypes == [("doc_id", "bigint"), ("start", "bigint"), ("n_tokens", "bigint"), ("ids_crc32", "bigint")]
    assert rows_of(found) == sorted(expected, key=repr)


def test_special_tokens_are_those_of_the_file(spark):
    texts = ["<|endoftext|>", "a <|endoftext|> b", "one<|endoftext|>two  <|endoftext|>\n <|endoftext|><|endoftext|> ", "<|endoftext |>"]
    whole, memory = Tokenizer.from_file(PATH), tokens.byte_bpe(PATH, as_given=True)
    ids = [whole.encode(text, add_special_tokens=False).ids for text in texts]
    assert ids[0] == [50256] and [memory.encode_all([text])[0].tolist() for text in texts] == ids
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    expected, start = [], 0
    for doc_id, own in enumerate(ids):
        data = np.array(own + [2], "<u4")
        expected.append((doc_id, start, len(data), zlib.crc32(data.tobytes())))
        start += len(data)
    assert rows_of(tokens.round_trip(df, PATH)) == expected


def test_empty_table(spark):
    assert tokens.round_trip(spark.createDataFrame([], DOCS), PATH).collect() == []


def test_ids_come_back(spark, tmp_path):
    tokens.write_tokens(documents(spark), str(tmp_path / "ids"), PATH, 2)
    found = {r["doc_id"]: r["ids"] for r in tokens.read_tokens(spark, str(tmp_path / "ids")).collect()}
    assert found[4] == [2] and Tokenizer.from_file(PATH).decode(found[9][:-1]) == "x"
