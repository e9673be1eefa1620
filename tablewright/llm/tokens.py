"""Token ids in binary files, by an adaptive context-mixing range coder.

**File format.** A folder of Parquet files; each row is one chunk of whole documents in order: ``shard`` and ``start``
(ids before it in its shard) give its place, ``tokens`` and ``documents`` its size, ``chunk`` the bytes:

    magic "TWT3", documents, tokens, block length, largest id (u32 each); then for every document its doc_id (i64),
    whether it has one (u8) and its number of ids (u32); for every block its length in bytes (u32) and the crc32 of
    its ids and of its place (u32); then the blocks' bytes.

**Coder.** A block is a run of ids coded on its own: all models start afresh, so any block can be read or lost alone.
Three orders predict each id: order 2 and order 1 remember the id that last followed their context, with a confidence;
order 0 keeps the frequencies of all ids that the block has had, with sums over them by first appearance. An id that is
new to the block is coded by its bit length, whose frequencies adapt too, and evenly within that. Which of the four is right is
predicted by weights learnt for each pair of confidences, and this mixture drives a 64-bit range coder that emits
16-bit words; a carry is added to the words before. Everything adapts after every id; weights are halved at a limit.

Blocks of a chunk are coded side by side, one array element each, so Python's work is per step, not per id.
"""

from __future__ import annotations

import os
import re
import string
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tablewright.llm.common import join_keys, slices
from tablewright.llm.words import WordMemory
from tablewright.session import scratch_folder, ship_package

MAGIC = b"TWT3"
HEAD = struct.Struct("<4sIIII")
BLOCK = 2_048                    # ids in a block
CHUNK = 1 << 23                  # ids in a chunk, about: whole documents, the last may be longer
PIECE = 1 << 20                  # characters tokenized at once
WORDS, JOINED = 1 << 20, 64      # words remembered in a worker, and new ones encoded as one text
STEP = 24                        # what a seen symbol adds to its count
MIX_LIMIT, CLASS_LIMIT = 1 << 11, 1 << 12
CLASS_BITS, REDRAW = 12, 16      # resolution of the bit lengths' table, and the ids after which it is drawn anew and limits are looked at
SHORT = np.uint64(1 << 48)       # an interval below this takes a word more
LARGEST = 1 << 22                # ids are smaller
TABLE = 1 << 26                  # ids that the lanes coded at once may have between them
LANES = 1_024                    # lanes coded at once, at most
FIELDS, FIELD = np.uint64(0x0001000100010001), np.uint64(0xFFFF)   # one in every field of weights: a product with it sums them up
ONCE, NOT_SEEN = np.uint64(2**64 - 1 - (0xFFFF << 16)), np.uint64(2**64 - 1 - (0xFFFF << 32))
RIGHT = np.uint64(STEP) << np.arange(0, 64, 16, np.uint64)         # by source
SOURCE = np.array([2, 0, 1, 0, 3, 3, 3, 3], np.uint64)             # by order 2 being right, order 1 (2 more), a new id (4 more)
#: Unicode's white space, at which the pre-tokenizer of byte-level BPE never joins words.
WHITE = "\t-\r \x85\xa0  -     　"


def divide(value: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Whole quotients of unsigned numbers by a float quotient that is mended; integer division takes many times as long."""
    quotient = (value / by).astype(np.uint64)
    rest = (value - quotient * by).view(np.int64)
    quotient -= rest < 0
    quotient += rest >= by.view(np.int64)
    return quotient


def leading(flags: np.ndarray) -> np.ndarray:
    """How many flags of each row are set."""
    width = flags.shape[1]
    words = np.packbits(flags.reshape(-1)).view(f"u{min(width, 64) // 8}")
    counts = np.bitwise_count(words)
    return (counts.reshape(-1, width // 64).sum(axis=1, dtype=np.int64) if width > 64 else counts.astype(np.int64))


class Seen:
    """Order 0: how often each lane has had each place: counts in rows of places, and the sum over the rows below.

    Counts lie by row, then by lane: frequent ids come early and have low places, so they share few pages of memory.
    """

    def __init__(self, lanes: int, block: int):
        bits = max(max(block - 1, 1).bit_length(), 6)
        self.shift, self.lanes, kind = bits >> 1, lanes, np.int16 if block < 1 << 15 else np.int32
        self.mask, rows = (1 << self.shift) - 1, 1 << bits - self.shift
        self.below = np.zeros((lanes, rows), kind)
        self.count = np.zeros((rows * lanes, self.mask + 1), kind)
        self.lane, self.columns = np.arange(lanes), np.arange(self.mask + 1, dtype=kind)[:, None]
        self.higher = np.triu(np.ones((rows, rows), kind), 1)

    def share(self, lanes: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The sum over the places below, and the place's own count."""
        row, column = place >> self.shift, place & self.mask
        counts = self.count.take(row * self.lanes + lanes, axis=0)
        lower = counts.T.copy()
        lower *= (self.columns < column.astype(lower.dtype)).view(np.int8)
        below = lower.sum(axis=0, dtype=lower.dtype)
        below += self.below.reshape(-1).take(lanes * self.below.shape[1] + row)
        return below, counts.reshape(-1).take((self.lane[:len(lanes)] << self.shift) + column)

    def find(self, lanes: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The place whose share of the sum holds a value, the sum below it, and its count."""
        left = value.astype(self.below.dtype)
        row = leading(self.below.take(lanes, axis=0) <= left[:, None]) - 1
        below = self.below.reshape(-1).take(lanes * self.below.shape[1] + row)
        left -= below
        counts = self.count.take(row * self.lanes + lanes, axis=0)
        upto, width = counts.T.copy(), 1
        while width <= self.mask:
            upto[width:] += upto[:-width]
            width *= 2
        column = (upto <= left).view(np.uint8).sum(axis=0, dtype=np.uint8 if self.mask < 256 else np.int64).astype(np.int64)
        count = counts.reshape(-1).take((self.lane[:len(lanes)] << self.shift) + column)
        below += upto.reshape(-1).take(column * len(lanes) + self.lane[:len(lanes)])
        below -= count
        return (row << self.shift) + column, below, count

    def learn(self, place: np.ndarray) -> None:
        """One more of a place for every lane."""
        row = place >> self.shift
        self.below += self.higher.take(row, axis=0)
        row *= self.lanes
        row += self.lane
        self.count.reshape(-1)[(row << self.shift) + (place & self.mask)] += 1


class Models:
    """The state of blocks coded side by side, one lane each. Ids have places by their first appearance in the block: 1, 2, ...

    The four weights of a pair of confidences are the 16-bit fields of one number, lowest first: order 2, 1, 0, new id.
    """

    def __init__(self, lanes: int, block: int, largest: int):
        self.kinds = largest.bit_length() + 1                # bit lengths 0 to that of the largest id
        self.seen, bits = Seen(lanes, block), max(block - 1, 1).bit_length()
        # What followed a context of order 2 (hashed), then of order 1 (places): a place (0: none yet), its confidence (1 to 3) above it.
        self.contexts, self.lane, self.lanes = 1 << bits, np.arange(lanes), lanes
        kind, self.bits = (np.uint16, 13) if bits < 13 else (np.uint32, 29)
        self.last = np.zeros(2 * lanes << bits, kind)
        self.sure_by, self.place_mask = [kind(n << self.bits) for n in range(4)], kind((1 << self.bits) - 1)
        sure = np.arange(16)
        self.mix = np.repeat((sure >= 4) * (STEP // 2) + ((sure & 3 > 0) * (STEP // 2) << 16) + (STEP << 32) + (STEP << 48), lanes).astype(np.uint64)
        self.counts = np.ones((self.kinds, lanes), np.int32)
        self.before, self.earlier = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
        self.range = np.full(lanes, 0xFFFFFFFFFFFFFFFF, np.uint64)
        self.steps = 0

    def redraw(self) -> None:
        """Halve what is over its limit. Cumulative frequencies of the bit lengths are scaled to sum to 2^CLASS_BITS, at least one each."""
        full = np.flatnonzero(self.mix * FIELDS >> np.uint64(48) > MIX_LIMIT)
        if len(full):
            self.mix[full] = (self.mix[full] + FIELDS >> np.uint64(1)) & (FIELDS * np.uint64(0x7FFF))
        full = np.flatnonzero(self.counts.sum(axis=0) > CLASS_LIMIT)
        if len(full):
            self.counts[:, full] = self.counts[:, full] + 1 >> 1
        upto = np.zeros((self.kinds + 1, self.lanes))
        for kind, counts in enumerate(self.counts):
            np.add(upto[kind], counts, out=upto[kind + 1])
        upto *= ((1 << CLASS_BITS) - self.kinds) / upto[-1]
        self.upto = (upto + 1e-6).astype(np.int64)
        self.upto += np.arange(self.kinds + 1)[:, None]

    def predict(self) -> None:
        if self.steps % REDRAW == 0:
            self.redraw()
        at = np.empty((2, self.lanes), np.int64)
        at[0] = (self.before * 0x9E3779B1 + self.earlier * 0x85EBCA6B >> 13) & self.contexts - 1
        at[1] = (self.before & self.contexts - 1) + self.contexts
        at *= self.lanes
        at += self.lane
        self.at, self.known = at, self.last.take(at)
        self.guess, self.sure = self.known & self.place_mask, self.known >> self.bits
        self.at_mix = (self.sure[0] << 2 | self.sure[1]) * self.lanes + self.lane
        self.weights = self.mix.take(self.at_mix)
        # One prediction of both orders stands once.
        self.shares = np.where(self.guess[0] == self.guess[1], self.weights & ONCE, self.weights)
        if self.steps == 0:
            self.shares &= NOT_SEEN
        self.upto_shares = self.shares * FIELDS
        # 53 bits of the interval are divided exactly as floats.
        self.part = self.parts(self.range, (self.upto_shares >> np.uint64(48)).view(np.int64))
        self.steps += 1

    @staticmethod
    def parts(size: np.ndarray, total) -> np.ndarray:
        """Intervals in ``total`` equal parts."""
        return ((size >> np.uint64(11)).view(np.int64) / total).astype(np.int64).view(np.uint64) << np.uint64(11)

    def narrow(self, source: np.ndarray) -> np.ndarray:
        """Narrow every interval to what is right, ``source`` 0, 1, 2 for order 2, 1, 0, and 3 for a new id; how far it moves."""
        field = source << np.uint64(4)
        self.range = self.part * (self.shares >> field & FIELD)
        return self.part * (self.upto_shares << np.uint64(16) >> field & FIELD)

    def shift(self) -> tuple[np.ndarray, np.ndarray]:
        """Widen intervals that are short by a word: which ones (1, others 0), and by how many bits."""
        goes = (self.range < SHORT).astype(np.int64)
        bits = (goes << 4).view(np.uint64)
        self.range <<= bits
        return goes, bits

    def bit_length_parts(self, lanes: np.ndarray, scale: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where a bit length's part of the interval begins, the width of its numbers, and what one of them takes."""
        at, width, upto = kinds * self.lanes + lanes, np.maximum(kinds - 1, 0).view(np.uint64), self.upto.reshape(-1)
        low = upto.take(at).view(np.uint64)
        return scale * low, width, scale * (upto.take(at + self.lanes).view(np.uint64) - low) >> width

    def learn(self, place: np.ndarray, source: np.ndarray, literal: np.ndarray, kinds: np.ndarray) -> None:
        """Adapt to the places of this step; ``kinds`` are the bit lengths of the literal lanes."""
        self.mix[self.at_mix] = self.weights + RIGHT.take(source.view(np.int64))
        self.counts.reshape(-1)[kinds * self.lanes + literal] += STEP
        fresh = place.astype(self.last.dtype)
        known, (_, one, two, three) = self.known, self.sure_by
        # Right: one surer, up to three. Wrong: one less sure, or replaced.
        self.last[self.at] = np.where(self.guess == fresh, np.minimum(known + one, known | three),
                                      np.where(known >= two, known - one, fresh | one))
        self.seen.learn(place - 1)
        self.earlier, self.before = self.before, place


def bit_lengths(ids: np.ndarray) -> np.ndarray:
    return np.frexp(ids.astype(np.float64))[1].astype(np.int64)


def appearances(rows: np.ndarray, largest: int) -> tuple[np.ndarray, np.ndarray]:
    """For every row of ids the places by first appearance, and which ids are new."""
    places, fresh, steps = np.empty(rows.shape, np.int32), np.empty(rows.shape, bool), np.arange(rows.shape[1], dtype=np.int32)
    first, back = np.zeros(largest + 1, np.int32), steps[::-1].copy()
    for row, place, new in zip(rows, places, fresh):
        first[row[::-1]] = back                              # of equal indices the last one stands
        at = first.take(row)
        np.equal(at, steps, out=new)
        np.cumsum(new, dtype=np.int32).take(at, out=place, mode="clip")
    return places, fresh


def encode_lanes(ids: np.ndarray, block: int, largest: int) -> list[bytes]:
    """The bytes of each block of ``block`` ids."""
    count, block = -(-len(ids) // block), min(block, len(ids))
    rows = np.full(count * block, ids[-1], np.int64)         # what fills the last block up is not kept
    rows[:len(ids)] = ids
    rows, tail = rows.reshape(count, block), len(ids) - (count - 1) * block
    places, fresh = (np.ascontiguousarray(x.T) for x in appearances(rows, largest))
    models, lane = Models(count, block, largest), np.arange(count)
    # Words lie by place, then by lane, as all lanes write at about the same place.
    words, at, low = np.zeros((block + 8 * REDRAW, count), np.uint16), lane.copy(), np.zeros(count, np.uint64)

    def carry(lanes: np.ndarray) -> None:
        flat, back = words.reshape(-1), at[lanes] - count
        while len(back):
            more = flat[back] + np.uint16(1)
            flat[back] = more
            back = back[more == 0] - count

    def end(lanes: np.ndarray) -> None:
        """Write the last word of some lanes: of a number within the interval that has zeros behind it."""
        last = low[lanes] + (SHORT - np.uint64(1))
        carry(lanes[last < low[lanes]])
        words.reshape(-1)[at[lanes]] = last >> np.uint64(48)

    for step in range(block):
        if step % REDRAW == 0 and at.max() // count + 4 * REDRAW > len(words):
            words = np.concatenate([words, np.zeros_like(words)])
        place, new = places[step].astype(np.int64), fresh[step]
        models.predict()
        right = (models.guess == place).view(np.uint8)
        source = SOURCE.take(right[0] | right[1] << 1 | new.view(np.uint8) << 2)
        known, literal = np.flatnonzero(source == 2), np.flatnonzero(new)
        moved = models.narrow(source)
        if len(known):
            below, own = models.seen.share(known, place[known] - 1)
            part = models.parts(models.range[known], step)
            moved[known] += part * below.astype(np.uint64)
            models.range[known] = part * own.astype(np.uint64)
        rare = rows[literal, step]
        kinds = bit_lengths(rare)
        start, width, inner = models.bit_length_parts(literal, models.range[literal] >> np.uint64(CLASS_BITS), kinds)
        moved[literal] += start + inner * (rare.view(np.uint64) - ((kinds > 0).astype(np.uint64) << width))
        models.range[literal] = inner
        low += moved
        if len(over := np.flatnonzero(low < moved)):
            carry(over)
        # Every lane writes its next word; one that is not settled yet is written over later.
        flat = words.reshape(-1)
        flat[at] = (low >> np.uint64(48)).astype(np.uint16)
        goes, bits = models.shift()
        at += goes * count
        low <<= bits
        while len(short := np.flatnonzero(models.range < SHORT)):
            flat[at[short]] = (low[short] >> np.uint64(48)).astype(np.uint16)
            at[short] += count
            low[short] <<= np.uint64(16)
            models.range[short] <<= np.uint64(16)
        models.learn(place, source, literal, kinds)
        if step + 1 == tail:
            end(lane[-1:])
            kept = words[:at[-1] // count + 1, -1].astype("<u2").tobytes()
    end(lane[:-1])
    return [*(row[:n + 1].tobytes() for row, n in zip(np.ascontiguousarray(words.T, "<u2"), (at[:-1] // count).tolist())), kept]


def decode_lanes(blocks: list[bytes], tokens: int, block: int, largest: int) -> np.ndarray:
    """The ids of the blocks, in order."""
    count, block = len(blocks), min(block, tokens)
    rows = np.zeros((count, max(len(b) for b in blocks) // 2 + 4), np.uint16)
    for row, data in zip(rows, blocks):
        row[:len(data) // 2] = np.frombuffer(data, "<u2")
    words, lane = np.ascontiguousarray(rows.T), np.arange(count)
    models, next_word, had = Models(count, block, largest), lane + 4 * count, np.zeros(count, np.int64)
    code = np.zeros(count, np.uint64)                        # from the beginning of the interval
    for row in words[:4]:
        code = code << np.uint64(16) | row
    found, names = np.zeros((block, count), np.int32), np.zeros((block + 2) * count, np.int32)
    for step in range(block):
        models.predict()
        part, upto = models.part, models.upto_shares
        source = (code >= part * (upto & FIELD)).astype(np.uint64)
        source += code >= part * (upto >> np.uint64(16) & FIELD)
        source += code >= part * (upto >> np.uint64(32) & FIELD)
        known, literal = np.flatnonzero(source == 2), np.flatnonzero(source == 3)
        code -= models.narrow(source)
        place = np.where(source == 0, models.guess[0], models.guess[1]).astype(np.int64)
        if len(known):
            part, above = models.parts(models.range[known], step), code[known]
            at, below, own = models.seen.find(known, np.minimum(divide(above, part), np.uint64(step - 1)))
            code[known] = above - part * below.astype(np.uint64)
            models.range[known] = part * own.astype(np.uint64)
            place[known] = at + 1
        above, scale = code[literal], models.range[literal] >> np.uint64(CLASS_BITS)
        at = np.minimum(divide(above, scale), np.uint64((1 << CLASS_BITS) - 1)).view(np.int64)
        kinds = (models.upto.take(literal, axis=1) <= at).view(np.uint8).sum(axis=0, dtype=np.uint8).astype(np.int64) - 1
        start, width, inner = models.bit_length_parts(literal, scale, kinds)
        above -= start
        rest = np.minimum(divide(above, inner), (np.uint64(1) << width) - np.uint64(1))
        code[literal] = above - inner * rest
        models.range[literal] = inner
        had[literal] += 1
        place[literal] = had[literal]
        names[place[literal] * count + literal] = rest + ((kinds > 0).astype(np.uint64) << width)
        flat = words.reshape(-1)
        goes, bits = models.shift()
        code <<= bits
        code |= flat.take(next_word, mode="clip") & (-goes).view(np.uint64)
        next_word += goes * count
        while len(short := np.flatnonzero(models.range < SHORT)):
            models.range[short] <<= np.uint64(16)
            code[short] = code[short] << np.uint64(16) | flat.take(next_word[short], mode="clip")
            next_word[short] += count
        place = np.minimum(np.maximum(place, 1), step + 1)   # damage is left to the checksum
        models.learn(place, source, literal, kinds)
        found[step] = names.take(place * count + lane)
    return np.minimum(found, largest).T.reshape(-1)[:tokens]


def lanes_at_once(blocks: int, largest: int) -> int:
    """Blocks coded side by side: groups of one size, whose tables of ids stay within ``TABLE`` entries."""
    return -(-blocks // -(-blocks // min(max(TABLE // (largest + 1), 1), LANES)))


def encode_blocks(ids: np.ndarray, block: int, largest: int) -> list[bytes]:
    """The bytes of all blocks, a group of lanes after the other."""
    step = block * lanes_at_once(-(-len(ids) // block), largest)
    return [b for at in range(0, len(ids), step) for b in encode_lanes(ids[at:at + step], block, largest)]


def decode_blocks(blocks: list[bytes], tokens: int, block: int, largest: int) -> np.ndarray:
    """The ids of all blocks."""
    lanes = lanes_at_once(len(blocks), largest)
    return np.concatenate([decode_lanes(blocks[at:at + lanes], min(tokens - at * block, lanes * block), block, largest)
                           for at in range(0, len(blocks), lanes)])


def pack(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray, block: int = BLOCK) -> bytes:
    """A chunk of whole documents as bytes."""
    if len(ids) and int(ids.max()) >= LARGEST:
        raise ValueError(f"token ids must be below {LARGEST}")
    largest = int(ids.max()) if len(ids) else 0
    blocks = encode_blocks(ids, block, largest) if len(ids) else []
    sums = [zlib.crc32(ids[at:at + block].astype("<u4").tobytes(), n) for n, at in enumerate(range(0, len(ids), block))]
    return b"".join([
        HEAD.pack(MAGIC, len(doc_ids), len(ids), block, largest),
        np.array([d or 0 for d in doc_ids], "<i8").tobytes(), bytes(d is not None for d in doc_ids),
        np.asarray(lengths, "<u4").tobytes(), np.array([len(b) for b in blocks], "<u4").tobytes(),
        np.array(sums, "<u4").tobytes(), *blocks])


def unpack(chunk: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """doc_ids, numbers of ids, and all ids of a chunk; every block's checksum is compared."""
    magic, documents, tokens, block, largest = HEAD.unpack_from(chunk)
    if magic != MAGIC:
        raise ValueError("not a chunk of token ids")
    at = HEAD.size

    def take(kind: str, n: int) -> np.ndarray:
        nonlocal at
        part = np.frombuffer(chunk, kind, n, at)
        at += part.nbytes
        return part

    doc_ids, known, lengths = take("<i8", documents), take("u1", documents), take("<u4", documents)
    count = -(-tokens // block)
    sizes, sums = take("<u4", count), take("<u4", count)
    ends = np.cumsum(sizes, dtype=np.int64) + at
    ids = decode_blocks([chunk[e - s:e] for s, e in zip(sizes.tolist(), ends.tolist())], tokens, block, largest) if count else np.empty(0, np.int64)
    ids = ids.astype("<u4")
    for n, expected in enumerate(sums.tolist()):
        if zlib.crc32(ids[n * block:(n + 1) * block].tobytes(), n) != expected:
            raise ValueError(f"block {n} of a chunk is damaged")
    return [d if k else None for d, k in zip(doc_ids.tolist(), known)], lengths, ids


@lru_cache(maxsize=2)
def byte_bpe(path: str, as_given: bool = False) -> WordMemory:
    """A byte-level BPE tokenizer. It never joins what a white-space run begins with what stands before it.

    ``as_given`` takes special tokens that stand in a text by their ids, as the file does; they hold no white space.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = not as_given
    return WordMemory(re.compile(word_pattern(tokenizer)), joined_encoder(tokenizer), WORDS)


def word_pattern(tokenizer) -> str:
    """Words with the white space before them. Where the usual pattern cuts a text before encoding, no word reaches from an ASCII
    letter into the punctuation or digits behind it, unless an added token does.
    """
    added, cutter = tokenizer.get_added_tokens_decoder().values(), tokenizer.pre_tokenizer
    usual = type(cutter).__name__ == "ByteLevel" and cutter.use_regex and not any(token.single_word for token in added)
    inside = {after for token in added for before, after in zip(token.content, token.content[1:]) if re.match("[A-Za-z]", before)}
    ends = "".join(re.escape(c) for c in string.punctuation + string.digits if c not in inside)
    if not usual or not ends:
        return rf"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+\Z"
    # What follows an ASCII letter ends the word; without one before it, it is part of it.
    return rf"(?!\Z)[{WHITE}]*+[{ends}]*+[^{WHITE}{ends}]*+(?:(?<![A-Za-z])[{ends}]++[^{WHITE}{ends}]*+)*+"


def joined_encoder(tokenizer) -> Callable[[list[str]], list[list[int]]]:
    """Encodes words of a byte-level BPE tokenizer. Those that begin with a space are encoded many at once, as one text, whose
    ids are cut at the words' last bytes; where no id ends with a word's last byte, every word is encoded on its own.
    """
    vocabulary = tokenizer.get_vocab()
    lengths = np.zeros(max(vocabulary.values(), default=-1) + 1, np.int64)     # bytes: a character of a token's name stands for one
    lengths[list(vocabulary.values())] = [len(name) for name in vocabulary]
    for number, token in tokenizer.get_added_tokens_decoder().items():
        lengths[number] = len(token.content.encode())

    def alone(words: list[str]) -> list[list[int]]:
        return [e.ids for e in tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def encode(words: list[str]) -> list[list[int]]:
        found: list[list[int]] = [[]] * len(words)
        spaced = [n for n, word in enumerate(words) if word[0] == " " and not word[-1].isspace()]
        single = sorted(set(range(len(words))).difference(spaced))
        groups = [spaced[at:at + JOINED] for at in range(0, len(spaced), JOINED)]
        for group, ids in zip(groups, alone(["".join([words[n] for n in group]) for group in groups])):
            ends = np.cumsum([len(words[n].encode()) for n in group])
            reached = np.cumsum(lengths[ids])
            cuts = np.searchsorted(reached, ends)
            if cuts[-1] != len(ids) - 1 or (reached[cuts] != ends).any():
                single += group
                continue
            cuts = [0, *(cuts + 1).tolist()]
            for n, begin, end in zip(group, cuts, cuts[1:]):
                found[n] = ids[begin:end]
        for n, ids in zip(single, alone([words[n] for n in single])):
            found[n] = ids
        return found

    return encode


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int) -> None:
    """Encode ``text`` of every row (NULL: empty), append ``end_id``, and write the ids under ``path`` by rising doc_id.

    Rows are range partitioned by doc_id, NULL first; the order of rows with one id is that of their texts.
    """
    ship_package(docs.sparkSession)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory, shard, start = byte_bpe(tokenizer, as_given=True), TaskContext.get().partitionId(), 0
        doc_ids, lengths, parts, size = [], [], [], 0

        def chunk() -> pa.RecordBatch:
            ids = np.concatenate(parts)
            data = pack(doc_ids, np.concatenate(lengths), ids)
            return pa.RecordBatch.from_pydict({
                "shard": pa.array([shard], pa.int32()), "start": pa.array([start], pa.int64()),
                "tokens": pa.array([len(ids)], pa.int64()), "documents": pa.array([len(doc_ids)], pa.int64()),
                "chunk": pa.array([data], pa.binary())})

        for batch in batches:
            names, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            for a, b in slices([len(t) + 1 for t in texts], PIECE):
                ids, ends = memory.encode_all(texts[a:b])
                counts = np.diff(ends)
                whole = np.full(len(ids) + b - a, end_id, np.uint32)
                whole[np.arange(len(ids)) + np.repeat(np.arange(b - a), counts)] = ids
                doc_ids += names[a:b]
                lengths.append(counts + 1)
                parts.append(whole)
                size += len(whole)
                if size >= CHUNK:
                    yield chunk()
                    start, size = start + size, 0
                    doc_ids, lengths, parts = [], [], []
        if size:
            yield chunk()

    ordered = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(encode, "shard int, start bigint, tokens bigint, documents bigint, chunk binary").write.parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (of the ids as little-endian u32), ids."""
    ship_package(spark)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                doc_ids, lengths, ids = unpack(data)
                ends = np.cumsum(lengths, dtype=np.int64)
                for a, b in slices(lengths.tolist(), CHUNK // 4):
                    first = int(ends[a] - lengths[a])
                    offsets = np.r_[first, ends[a:b]] - first
                    part = ids[first:ends[b - 1]]
                    view = memoryview(part).cast("B")
                    sums = [zlib.crc32(view[4 * s:4 * e]) for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": pa.array(doc_ids[a:b], pa.int64()), "start": pa.array(base + ends[a:b] - lengths[a:b]),
                        "n_tokens": pa.array(lengths[a:b].astype(np.int64)), "ids_crc32": pa.array(sums, pa.int64()),
                        "ids": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(part.view(np.int32)))})

    chunks = spark.read.parquet(path)
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = chunks.groupBy("shard").agg(F.sum("tokens").alias("sum")).select(
        "shard", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("base"))
    placed = join_keys(chunks.select("shard", "start", "chunk"), bases, ["shard"])
    return placed.select((F.col("base") + F.col("start")).alias("base"), "chunk").mapInArrow(
        decode, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint, ids array<int>")


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 2, path: str | None = None) -> DataFrame:
    """Write the ids of all documents and read them back: doc_id, start, n_tokens, ids_crc32."""
    path = path or scratch_folder(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer, end_id)
    return read_tokens(docs.sparkSession, path).drop("ids")
