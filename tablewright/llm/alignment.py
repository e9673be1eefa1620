"""Cross-tokenizer alignment: which tokens of one tokenizer cover the bytes of which tokens of another.

Both tokenizers cut the bytes of space+text. Where tokens of both end at one offset, a group of tokens ends; tokens whose byte
ranges overlap are linked. Both follow from one intersection of the two rising lists of token ends, by galloping: every end
of the shorter list is looked up in the longer one, steps doubled until they pass it, then halved within the last step. Equal
ends slice the groups. The difference of the places found for neighbouring ends is the range of tokens that overlap the token
between them, so links need no second search. All lists of a batch are searched side by side in numpy.

Texts are cut before a space or a line break that follows no white space: neither tokenizer joins tokens there (looked up in
the vocabulary and tested against whole texts), so both end there, and groups, links and checks of the parts make up those of
the text. Parts are remembered. A vocabulary that joins across takes whole texts as parts.

**Corpus counts.** How many documents hold a pair of ids linked is counted in two steps: tasks write chunks of documents with
the distinct pairs of each chunk and the number of its documents that hold them, and Spark adds these up. Each chunk then gets
the counts of its own pairs joined back, by place, and its documents sum them. No task and no broadcast holds all pairs.

Texts that are NULL, empty, or whose tokens do not give back space+text (a word mark in the text, say) have no tokens. Rows of
one id are documents of their own; other columns are not carried, so their names cannot clash; an empty table gives none.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import (ArrayType, BinaryType, IntegerType, LongType, StringType, StructField, StructType)

from tablewright.llm.common import fresh_name, slices
from tablewright.llm.tokens import WHITE
from tablewright.session import settle, ship_package

MARK = "▁"
PIECE = 1 << 20            # characters handled at once
CHUNK = 1 << 23            # characters in a chunk of documents, about; a longer document is a chunk alone
REMEMBERED = 500_000       # parts kept in a worker
LONG = 1 << 20             # characters in parts over 64 characters, at which the memory starts anew
EMPTY = (0, 0, 0, 0, "")   # tokens, groups, links and digest of a text without tokens


def gallop(wanted: np.ndarray, ends: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """For each wanted value the place of the first end that is not below it, in ``ends[first:last]``; ``last`` if none is."""
    low, step, high = first.copy(), np.ones(len(first), np.int64), last
    going = np.flatnonzero(low < high)
    found = last.copy()
    while len(going):                                    # low: everything before it is below the wanted value
        probe = np.minimum(low[going] + step[going], high[going]) - 1
        below = ends[probe] < wanted[going]
        found[going[~below]] = probe[~below]
        low[going[below]] = probe[below] + 1
        step[going] *= 2
        going = going[below]
        going = going[low[going] < high[going]]
    going = np.flatnonzero(low < found)
    while len(going):
        middle = (low[going] + found[going]) >> 1
        below = ends[middle] < wanted[going]
        low[going[below]] = middle[below] + 1
        found[going[~below]] = middle[~below]
        going = going[low[going] < found[going]]
    return low


def spread_out(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for ``length`` values, one range after another."""
    after = np.cumsum(lengths)
    return np.repeat(starts - after + lengths, lengths) + np.arange(after[-1] if len(after) else 0)


class Vocabulary:
    """The bytes of every id."""

    def __init__(self, parts: list[bytes]):
        self.lengths = np.array([len(p) for p in parts], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.data = np.frombuffer(b"".join(parts), np.uint8)

    def join(self, ids: np.ndarray) -> np.ndarray:
        return self.data[spread_out(self.starts[ids], self.lengths[ids])]


def flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """All ids one after another, and how many each list has."""
    counts = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(chain.from_iterable(lists), np.int64, int(counts.sum())), counts


class Aligner:
    """Two tokenizers over parts of texts. ``a_of`` and ``b_of`` give the ids of a list of parts; parts begin with white space."""

    def __init__(self, a_of, a: Vocabulary, b_of, b: Vocabulary, cut: re.Pattern):
        self.a_of, self.a, self.b_of, self.b, self.cut, self.parts = a_of, a, b_of, b, cut.findall, cut.finditer
        self.width = len(b.lengths)
        self.numbers = Vocabulary([b"%d," % n for n in range(max(len(a.lengths), self.width))])
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.groups: list[str] = []                      # None: the tokens do not give the part back
        self.pairs, self.used = np.empty(1 << 16, np.int64), 0
        self.facts = np.zeros((1 << 14, 4), np.int64)    # where pairs start, how many, tokens of a, tokens of b
        self.long = 0

    def aligned(self, texts: list[str]) -> tuple:
        """Ids and counts per text of a, the same of b, and from their intersection the links and groups of all texts.

        Links are given as (places in a, places in b, links per text), groups as (ends in a, ends in b, groups per text); the last
        value says which texts both tokenizers give back. The tokens of others are left out.
        """
        (a, n_a), (b, n_b) = flat(self.a_of(texts)), flat(self.b_of(texts))
        data = [t.encode() for t in texts]
        sizes = np.fromiter(map(len, data), np.int64, len(data))
        right = np.ones(len(texts), bool)
        for ids, counts, vocabulary in ((a, n_a, self.a), (b, n_b, self.b)):
            right &= sums(vocabulary.lengths[ids], counts) == sizes
        a, b = a[np.repeat(right, n_a)], b[np.repeat(right, n_b)]
        n_a, n_b, sizes = (np.where(right, x, 0) for x in (n_a, n_b, sizes))
        given = np.frombuffer(b"".join(d for d, ok in zip(data, right) if ok), np.uint8)
        wrong = (self.a.join(a) != given) | (self.b.join(b) != given)
        if wrong.any():
            bad = np.unique(np.repeat(np.arange(len(texts)), sizes)[wrong])
            right[bad] = False
            keep = right.copy()
            a, b = a[np.repeat(keep, n_a)], b[np.repeat(keep, n_b)]
            n_a, n_b, sizes = (np.where(keep, x, 0) for x in (n_a, n_b, sizes))
        ends_a, ends_b = np.cumsum(self.a.lengths[a]), np.cumsum(self.b.lengths[b])
        first_a, first_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
        swap = n_b < n_a                                 # texts whose shorter list is b's
        left, right_, links, cuts = [], [], np.zeros(len(texts), np.int64), []
        for mine, n_x, first_x, ends_x, n_y, first_y, ends_y in (
                (~swap, n_a, first_a, ends_a, n_b, first_b, ends_b), (swap, n_b, first_b, ends_b, n_a, first_a, ends_a)):
            n_x = np.where(mine, n_x, 0)
            short = spread_out(first_x, n_x)             # places of the shorter lists
            text = np.repeat(np.arange(len(texts)), n_x)
            at = gallop(ends_x[short], ends_y, first_y[text], first_y[text] + n_y[text])
            equal = ends_y[at] == ends_x[short] if len(at) else np.zeros(0, bool)
            begin = np.roll(at + equal, 1)               # the first token not yet ended where this one begins
            head = short == first_x[text]
            begin[head] = first_y[text[head]]
            count = at - begin + 1
            pair = np.repeat(short, count), spread_out(begin, count)
            shared = short[equal], at[equal]
            if mine is swap:
                pair, shared = pair[::-1], shared[::-1]
            left.append(pair[0])
            right_.append(pair[1])
            links += np.bincount(text, count, len(texts)).astype(np.int64)
            cuts.append(shared)
        left, right_ = np.concatenate(left), np.concatenate(right_)
        order = np.lexsort((right_, left))
        cut_a, cut_b = np.sort(np.concatenate([c[0] for c in cuts])), np.sort(np.concatenate([c[1] for c in cuts]))
        groups = np.bincount(np.searchsorted(np.cumsum(n_a), cut_a, "right"), minlength=len(texts))[:len(texts)]
        return (a, n_a), (b, n_b), (left[order], right_[order], links), (cut_a, cut_b, groups), right

    def learn(self, parts: list[str]) -> None:
        (a, n_a), (b, n_b), (left, right, links), (cut_a, cut_b, groups), known = self.aligned(parts)
        pairs = a[left] * self.width + b[right]
        while self.used + len(pairs) > len(self.pairs):
            self.pairs = np.resize(self.pairs, 2 * len(self.pairs))
        self.pairs[self.used:self.used + len(pairs)] = pairs
        count = len(self.place)
        while count + len(parts) > len(self.facts):
            self.facts = np.resize(self.facts, (2 * len(self.facts), 4))
        self.facts[count:count + len(parts)] = np.column_stack((self.used + np.cumsum(links) - links, links, n_a, n_b))
        self.used += len(pairs)
        self.place.update(zip(parts, range(count, count + len(parts))))
        bounds, text = self.written(a, b, cut_a, cut_b, n_a + n_b)
        self.groups += [text[x:y] if ok else None for x, y, ok in zip(bounds[:-1], bounds[1:], known.tolist())]
        self.long += sum(len(p) for p in parts if len(p) > 64)

    def written(self, a: np.ndarray, b: np.ndarray, cut_a: np.ndarray, cut_b: np.ndarray, items: np.ndarray) -> tuple[list[int], str]:
        """All groups as ``a1,a2|b1;a3|b2;`` and where the text of each part's groups begins."""
        places, marks = [], []
        for cut, before, mark in ((cut_a, np.r_[0, cut_b + 1], "|"), (cut_b, cut_a + 1, ";")):
            ends = np.zeros(cut[-1] + 1 if len(cut) else 0, np.int64)
            ends[cut] = 1
            places.append(np.arange(len(ends)) + before[np.cumsum(ends) - ends])
            marks.append(np.where(ends, ord(mark), ord(",")))
        ids, last = np.empty(len(a) + len(b), np.int64), np.empty(len(a) + len(b), np.uint8)
        for place, own, mark in zip(places, (a, b), marks):
            ids[place], last[place] = own, mark
        data = self.numbers.join(ids)
        ends = np.r_[0, np.cumsum(self.numbers.lengths[ids])]
        data[ends[1:] - 1] = last
        return ends[np.r_[0, np.cumsum(items)]].tolist(), data.tobytes().decode("ascii")

    def documents(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[tuple]]:
        """All links' pairs, how many each text has, and (tokens of a, of b, links, groups as text or None) of each text.

        Texts begin with the space put before them, or are windows of such a text; ones without tokens are None.
        """
        if len(self.place) > REMEMBERED or self.long > LONG:
            self.forget()
        parts, ends = [], [0]
        for text in texts:
            parts += self.cut(text)
            ends.append(len(parts))
        if new := [p for p in dict.fromkeys(parts) if p not in self.place]:
            self.learn(new)
        at = np.fromiter(map(self.place.__getitem__, parts), np.int64, len(parts))
        named = list(map(self.groups.__getitem__, at.tolist()))
        facts, rows, keep = self.facts[at], [], np.ones(len(parts), bool)
        until = np.vstack((np.zeros((1, 4), np.int64), np.cumsum(facts, axis=0)))
        counts = np.zeros(len(texts), np.int64)
        for n, (a, b) in enumerate(zip(ends[:-1], ends[1:])):
            if a == b or None in named[a:b]:
                keep[a:b] = False
                rows.append((0, 0, 0, None))
                continue
            _, counts[n], n_a, n_b = until[b] - until[a]
            rows.append((int(n_a), int(n_b), int(counts[n]), "".join(named[a:b])[:-1]))
        facts = facts[keep]
        return self.pairs[spread_out(facts[:, 0], facts[:, 1])], counts, rows

    def summaries(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, tuple]]:
        """For each text its distinct pairs, how often each is linked, and (tokens of a, of b, groups, links, digest)."""
        links, counts, rows = self.documents([" " + t if t else "" for t in texts])
        start = 0
        for count, (n_a, n_b, n, whole) in zip(counts.tolist(), rows):
            pairs, often = np.unique(links[start:start + count], return_counts=True)
            start += count
            yield pairs, often, EMPTY if whole is None else (
                n_a, n_b, whole.count(";") + 1, n, hashlib.sha256(whole.encode()).hexdigest())

    def summary(self, text: str) -> tuple[np.ndarray, np.ndarray, tuple]:
        """The same for one long text, window after window."""
        pairs, often, total, digest = np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(4, np.int64), hashlib.sha256()
        for window in self.windows(" " + text):
            links, _, [(n_a, n_b, n, whole)] = self.documents([window])
            if whole is None:
                return pairs[:0], often[:0], EMPTY
            digest.update((";" + whole if total[2] else whole).encode())
            total += (n_a, n_b, whole.count(";") + 1, n)
            here, times = np.unique(links, return_counts=True)
            pairs, at = np.unique(np.concatenate((pairs, here)), return_inverse=True)
            before, often = np.concatenate((often, times)), np.zeros(len(pairs), np.int64)
            np.add.at(often, at, before)
        return pairs, often, (*total.tolist(), digest.hexdigest())

    def windows(self, text: str) -> Iterator[str]:
        start = 0
        for part in self.parts(text):
            if part.end() - start >= PIECE:
                yield text[start:part.end()]
                start = part.end()
        if start < len(text):
            yield text[start:]


def sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The sum of each run of ``counts`` values."""
    until = np.r_[0, np.cumsum(values)]
    ends = np.cumsum(counts)
    return until[ends] - until[ends - counts]


def byte_level() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [n for n in range(256) if n not in plain]
    return {chr(n): n for n in plain} | {chr(256 + k): n for k, n in enumerate(other)}


@lru_cache(maxsize=2)
def load(byte_bpe: str, pieces: str) -> Aligner:
    """The aligner of a byte-level BPE file of the tokenizers library and a SentencePiece model file."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import sentencepiece
    from tokenizers import Tokenizer
    first = Tokenizer.from_file(byte_bpe)
    first.encode_special_tokens = True
    bytes_of, special = byte_level(), first.get_added_tokens_decoder()
    a = [b"" if (t := first.id_to_token(n)) is None else t.encode() if n in special else bytes(map(bytes_of.__getitem__, t))
         for n in range(max(first.get_vocab().values()) + 1)]
    second = sentencepiece.SentencePieceProcessor(model_file=pieces)
    b, joined, crosses, mark = [], set(), False, second.piece_to_id(MARK)
    for n in range(second.get_piece_size()):
        piece = second.id_to_piece(n)
        if second.is_byte(n):
            b.append(bytes([int(piece[1:-1], 16)]))
            continue
        text = piece.replace(MARK, " ")
        b.append(text.encode())
        if len(text) > 1 and not (second.is_control(n) or second.is_unknown(n)):
            joined.update(text)
            crosses |= re.search(r"[^ ] ", text) is not None
    stops = " " if "\n" in joined else " \n"
    other = f"(?![{stops}])[{WHITE}]"                     # white space that a part may hold further on
    cut = r"[\s\S]+" if crosses else f"[{WHITE}]+[^{WHITE}]*(?:{other}[{WHITE}]*[^{WHITE}]*)*"

    def b_of(parts: list[str]) -> list[list[int]]:
        """The model puts a space before a text (not an empty one): it is taken from parts that begin with one, or its mark from the ids."""
        made = second.encode([p[1:] if p[0] == " " else p for p in parts], num_threads=1)
        return [ids or [mark] if p[0] == " " else ids[1:] if ids and ids[0] == mark else [second.unk_id()] for p, ids in zip(parts, made)]

    return Aligner(lambda parts: [e.ids for e in first.encode_batch_fast(parts, add_special_tokens=False)], Vocabulary(a),
                   b_of, Vocabulary(b), re.compile(cut))


def chunks(docs: DataFrame, byte_bpe: str, pieces: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Chunks of documents: their facts, the distinct pairs with the documents that hold them, and each link's place there."""
    ship_package(docs.sparkSession)
    longs = ArrayType(LongType())
    schema = StructType([
        StructField("chunk", LongType()), StructField("keys", ArrayType(docs.schema[key].dataType)), StructField("facts", ArrayType(longs)),
        StructField("digests", ArrayType(StringType())), StructField("pairs", longs), StructField("holders", ArrayType(IntegerType())),
        StructField("distinct", longs), StructField("at", BinaryType()), StructField("times", BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, number = load(byte_bpe, pieces), TaskContext.get().partitionId() << 32
        keys, rows, parts, times, distinct, size = [], [], [], [], [], 0
        kind = None

        def chunk() -> pa.RecordBatch:
            nonlocal keys, rows, parts, times, distinct, size, number
            found = np.concatenate(parts) if parts else np.empty(0, np.int64)
            pairs, at, holders = np.unique(found, return_inverse=True, return_counts=True)
            row = [[number], [keys], [[list(c) for c in zip(*(r[:4] for r in rows))]], [[r[4] for r in rows]], [pairs], [holders],
                   [distinct], [at.astype("<u4").tobytes()], [np.concatenate(times).astype("<u4").tobytes() if times else b""]]
            types = [pa.int64(), pa.list_(kind), pa.list_(pa.list_(pa.int64())), pa.list_(pa.string()), pa.list_(pa.int64()),
                     pa.list_(pa.int32()), pa.list_(pa.int64()), pa.binary(), pa.binary()]
            keys, rows, parts, times, distinct, size, number = [], [], [], [], [], 0, number + 1
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, types)], names=schema.names)

        for batch in batches:
            kind = batch.column(0).type
            ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            for first, last in slices([len(t) + 1 for t in texts], PIECE):
                found = [aligner.summary(texts[first])] if len(texts[first]) > PIECE else aligner.summaries(texts[first:last])
                for n, (held, often, fact) in enumerate(found, start=first):
                    if size and size + len(texts[n]) > CHUNK:
                        yield chunk()
                    keys.append(ids[n])
                    rows.append(fact)
                    parts.append(held)
                    times.append(often)
                    distinct.append(len(held))
                    size += len(texts[n]) + 1
        if keys:
            yield chunk()

    return docs.select(key, text).mapInArrow(run, schema)


def pair_counts(made: DataFrame) -> DataFrame:
    """How many documents hold each pair: pair, documents."""
    held = made.select(F.explode(F.arrays_zip("pairs", "holders")).alias("_held"))
    return held.groupBy(F.col("_held.pairs").alias("pair")).agg(F.sum("_held.holders").alias("documents"))


def align(docs: DataFrame, byte_bpe: str, pieces: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document: tokens, groups, links, and what its links count over the whole corpus.

    ``n_best`` are links whose count is the highest of their first id in the corpus, ``count_sum`` is the sum of all links' counts.
    """
    width = len(load(byte_bpe, pieces).b.lengths)
    made = settle(chunks(docs, byte_bpe, pieces, key, text))
    counted = settle(pair_counts(made))
    best = counted.groupBy(F.expr(f"pair div {width}").alias("_first")).agg(F.max("documents").alias("_best"))
    # No more rows than the first vocabulary has ids.
    valued = counted.join(F.broadcast(best), F.expr(f"pair div {width}") == F.col("_first")).select(
        "pair", (F.col("documents") * 2 + (F.col("documents") == F.col("_best")).cast("int")).alias("_value"))
    wanted = made.select("chunk", F.posexplode("pairs").alias("_at", "pair"))
    values = wanted.join(valued, "pair").groupBy("chunk").agg(F.collect_list(F.struct("_at", "_value")).alias("_values"))
    rows = made.drop("pairs", "holders").join(values, "chunk", "left").select(
        "keys", "facts", "digests", "distinct", "at", "times", "_values")
    schema = StructType([docs.schema[key], *(StructField(n, LongType()) for n in (
        "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")), StructField("groups_sha256", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                row = {name: batch.column(k)[n] for k, name in enumerate(batch.schema.names)}
                keys = row["keys"].values
                facts = [c.values.to_numpy() for c in row["facts"].values] if len(keys) else []
                value = np.zeros(0, np.int64)
                if row["_values"].is_valid:
                    given = row["_values"].values
                    value = np.empty(len(given), np.int64)
                    value[given.field(0).to_numpy()] = given.field(1).to_numpy()
                distinct = row["distinct"].values.to_numpy()
                value = value[np.frombuffer(row["at"].as_py(), "<u4")]
                times = np.frombuffer(row["times"].as_py(), "<u4").astype(np.int64)
                best, total = sums(times * (value & 1), distinct), sums(times * (value >> 1), distinct)
                yield pa.RecordBatch.from_arrays([keys, *map(pa.array, (*facts, best, total)), row["digests"].values], names=schema.names)

    return rows.mapInArrow(run, schema)


def groups(docs: DataFrame, byte_bpe: str, pieces: str, text: str = "text") -> DataFrame:
    """``docs`` with ``alignment``: each text's groups as (ids of the first tokenizer, ids of the second); empty without tokens."""
    ship_package(docs.sparkSession)
    name, at = fresh_name(docs, "alignment"), docs.columns.index(text)
    ids = ArrayType(IntegerType())
    schema = StructType([*docs.schema.fields, StructField(name, ArrayType(StructType([StructField("a", ids), StructField("b", ids)])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = load(byte_bpe, pieces)
        kind = pa.list_(pa.struct([("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))]))
        for batch in batches:
            texts = batch.column(at).to_pylist()
            for first, last in slices([len(t or "") + 1 for t in texts], PIECE):
                found = []
                for given in texts[first:last]:
                    parts = aligner.cut(" " + given) if given else []
                    (a, _), (b, _), _, (cut_a, cut_b, _), right = aligner.aligned(parts)
                    cuts = [] if not right.all() else [
                        {"a": x.tolist(), "b": y.tolist()}
                        for x, y in zip(np.split(a, cut_a + 1)[:-1], np.split(b, cut_b + 1)[:-1])]
                    found.append(cuts)
                yield pa.RecordBatch.from_arrays([*batch.slice(first, last - first).columns, pa.array(found, kind)], names=schema.names)

    return docs.mapInArrow(run, schema)
