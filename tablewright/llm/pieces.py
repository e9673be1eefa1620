"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives a single-pass Viterbi.

The automaton reads a text once. At each position it names, by its output links, every piece that ends there, longest
first; each relaxes the best score at its end from the best score at its start. The best sum of piece scores wins, of equal
sums the one whose last piece is longer. A character without a piece of its own becomes its UTF-8 bytes (byte pieces), at
ten less than the worst score.

As SentencePiece does, a space is put before a text and spaces are pieces' word marks; nothing else is normalized. So
decoding gives back the exact text: a word mark in the text itself goes by its bytes. An empty or NULL text has no ids.

Pieces never reach from a word into the following space, if the vocabulary has none that do (which is looked up, not
assumed). A text may then be cut before its spaces without changing the result, and words are remembered.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

from tablewright.llm.common import fresh_name, slices
from tablewright.llm.words import WordMemory
from tablewright.session import ship_package

MARK = "▁"
PIECE = 1 << 20        # characters handled at once


class Pieces:
    """A vocabulary: piece texts with scores, byte pieces, and what follows from them."""

    def __init__(self, pieces: list[tuple[int, str, float]], bytes_of: dict[int, int], unknown: int):
        import ahocorasick
        self.automaton = ahocorasick.Automaton()
        texts: dict[int, bytes] = {}
        scores = [score for _, _, score in pieces] or [0.0]
        self.singles, joined, crosses = set(), set(), False
        for number, piece, score in pieces:
            text = piece.replace(MARK, " ")
            texts[number] = text.encode()
            self.automaton.add_word(text, (len(text), number, score))
            if len(text) == 1:
                self.singles.add(text)
            else:
                joined.update(text)
                crosses |= " " in text.lstrip(" ")
        self.automaton.make_automaton()
        self.rare = min(scores) - 10
        self.byte_ids = {value: number for number, value in bytes_of.items()}
        self.unknown = unknown
        texts.update((number, bytes([value])) for number, value in bytes_of.items())
        size = max(texts, default=-1) + 1
        parts = [texts.get(n, b"") for n in range(size)]
        self.lengths = np.array([len(p) for p in parts], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(parts), np.uint8)
        alone = "\n" if "\n" not in joined else ""
        cut = r"[\s\S]+" if crosses else f" *[^ {alone}]+| +" + (f"|{alone}" if alone else "")
        self.memory = WordMemory(re.compile(cut), lambda words: map(self.segment, words))

    def segment(self, text: str) -> list[int]:
        """The best pieces of a text, by one pass of the automaton."""
        best, back = [0.0], [(0, -1)]
        found = iter(self.automaton.iter(text)) if len(self.automaton) else iter(())
        match = next(found, None)
        for end, char in enumerate(text, start=1):
            top, chosen = -np.inf, (0, -1)
            while match is not None and match[0] == end - 1:
                length, number, score = match[1]
                if (total := best[end - length] + score) > top:
                    top, chosen = total, (length, number)
                match = next(found, None)
            if char not in self.singles and (total := best[end - 1] + self.rare) > top:
                top, chosen = total, (1, -1)
            best.append(top)
            back.append(chosen)
        ids, end = [], len(text)
        while end:
            length, number = back[end]
            if number >= 0:
                ids.append(number)
            else:
                ids += [self.byte_ids.get(b, self.unknown) for b in reversed(text[end - 1].encode())]
            end -= length
        return ids[::-1]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and where each text begins (and the last ends)."""
        return self.memory.encode_all([" " + t if t else "" for t in texts])

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """The UTF-8 bytes of each text."""
        lengths = self.lengths[ids]
        after = np.r_[0, np.cumsum(lengths)]
        data = self.bytes[np.repeat(self.starts[ids] - after[:-1], lengths) + np.arange(after[-1])].tobytes()
        bounds = after[ends].tolist()
        return [data[a + 1:b] for a, b in zip(bounds[:-1], bounds[1:])]


@lru_cache(maxsize=2)
def load(path: str) -> Pieces:
    """The vocabulary of a SentencePiece model file."""
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain, bytes_of = [], {}
    for n in range(model.get_piece_size()):
        if model.is_byte(n):
            bytes_of[n] = int(model.id_to_piece(n)[1:-1], 16)
        elif not (model.is_control(n) or model.is_unknown(n) or model.is_unused(n)):
            plain.append((n, model.id_to_piece(n), model.get_score(n)))
    return Pieces(plain, bytes_of, model.unk_id())


def encoded(docs: DataFrame, model: str, ids: str = "piece_ids", same: str = "round_trip") -> DataFrame:
    """``docs`` with the piece ids of ``text``, and whether decoding them gave the text back; names are made fresh."""
    ship_package(docs.sparkSession)
    ids, same = fresh_name(docs, ids), fresh_name(docs, same)
    at, names = docs.columns.index("text"), [*docs.columns, ids, same]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(model)
        for batch in batches:
            texts = [t or "" for t in batch.column(at).to_pylist()]
            for a, b in slices([len(t) + 1 for t in texts], PIECE):
                found, ends = pieces.encode(texts[a:b])
                back = pieces.decode(found, ends)
                right = [text.encode() == data for text, data in zip(texts[a:b], back)]
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(found.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, lists, pa.array(right, pa.bool_())], names=names)

    return docs.mapInArrow(run, StructType([
        *docs.schema.fields, StructField(ids, ArrayType(IntegerType())), StructField(same, BooleanType())]))


def decoded(rows: DataFrame, model: str, ids: str = "piece_ids", text: str = "text") -> DataFrame:
    """``rows`` with ``text`` decoded from a column of ids (NULL: empty); an older column of that name is replaced."""
    ship_package(rows.sparkSession)
    rows = rows.drop(text)
    at, names = rows.columns.index(ids), [*rows.columns, text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(model)
        for batch in batches:
            lists = batch.column(at).fill_null([])
            counts = lists.value_lengths().to_numpy(zero_copy_only=False)
            back = pieces.decode(lists.flatten().to_numpy(zero_copy_only=False), np.r_[0, np.cumsum(counts)])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([b.decode("utf-8", "replace") for b in back], pa.string())], names=names)

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField(text, StringType())]))
