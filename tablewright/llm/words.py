"""A bounded memory of encoded words, for tokenizers whose pieces never cross a boundary between words."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from itertools import chain, repeat

import numpy as np

REMEMBERED = 300_000       # words kept in a worker at a time
LONG = 1 << 20             # characters in words over 64 characters, at which it starts anew


class WordMemory:
    """Encodes texts word by word; ``encode`` gives the ids of a list of new words.

    ``split`` must cut a text so that encoding it whole and word by word give the same ids. The memory holds
    ``remembered`` words and starts anew when it is full; what it has forgotten is encoded again.
    """

    def __init__(self, split: re.Pattern, encode: Callable[[list[str]], Iterable[list[int]]], remembered: int = REMEMBERED):
        self.split, self.encode, self.remembered = split.findall, encode, remembered
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.ids = np.empty(1 << 16, np.uint32)
        self.starts = np.zeros(1 << 14, np.int64)
        self.used = self.count = self.long = 0

    def learn(self, words: list[str]) -> None:
        found = list(self.encode(words))
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        used, count = self.used + int(lengths.sum()), self.count + len(found)
        while used > len(self.ids):
            self.ids = np.resize(self.ids, 2 * len(self.ids))
        while count + 2 > len(self.starts):
            self.starts = np.resize(self.starts, 2 * len(self.starts))
        self.ids[self.used:used] = np.fromiter(chain.from_iterable(found), np.uint32, used - self.used)
        self.starts[self.count + 1:count + 1] = self.used + np.cumsum(lengths)
        self.place.update(zip(words, range(self.count, count)))
        self.used, self.count = used, count

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and where each text begins (and the last ends)."""
        if self.count > self.remembered:
            self.forget()
        place, words, ends = self.place, [], [0]
        for text in texts:
            words += self.split(text)
            ends.append(len(words))
        at, new = np.fromiter(map(place.get, words, repeat(-1)), np.int64, len(words)), {}
        unknown = np.flatnonzero(at < 0).tolist()
        if unknown:
            new = dict.fromkeys(words[n] for n in unknown)
            self.learn(list(new))
            at[unknown] = [place[words[n]] for n in unknown]
        starts = self.starts[at]
        lengths = self.starts[at + 1] - starts
        begins = np.zeros(len(words) + 1, np.int64)
        np.cumsum(lengths, out=begins[1:])
        found = self.ids[np.repeat(starts - begins[:-1], lengths) + np.arange(begins[-1])]
        self.long += sum(len(w) for w in new if len(w) > 64)
        if self.long > LONG:
            self.forget()
        return found, begins[np.array(ends)]
