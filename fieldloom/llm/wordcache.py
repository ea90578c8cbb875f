"""Ids of texts by way of their distinct words, each of which is encoded once."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A process forgets its words when it knows so many; they are then encoded anew.
CACHE_WORDS = 900_000
#: The same for the characters of all known words.
CACHE_CHARS = 32 << 20


class WordCache:
    """Known words and their ids, one after the other; number 0 is the empty word."""

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], dtype: type):
        self.encode, self.dtype = encode, dtype
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {"": 0}
        self.chars = 0
        self.size_of, self.at_of, self.used = np.zeros(1, np.int64), np.zeros(1, np.int64), 0
        self.flat = np.zeros(1 << 16, self.dtype)

    def _learn(self, words: list[str]) -> None:
        sizes, ids = self.encode(words)
        first = len(self.size_of)
        if self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.used], np.zeros(self.used + 2 * len(ids), self.dtype)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.at_of = np.append(self.at_of, self.used + np.cumsum(sizes) - sizes)
        self.size_of = np.append(self.size_of, sizes)
        self.used += len(ids)
        self.known.update(zip(words, range(first, first + len(words))))
        self.chars += sum(map(len, words))

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and how many each has; texts are words with single spaces between."""
        if len(self.known) > CACHE_WORDS or self.chars > CACHE_CHARS:
            self.forget()
        if not len(texts):
            return np.zeros(0, self.dtype), np.zeros(0, np.int64)
        parts = pc.split_pattern(texts.cast(pa.large_string()), " ")
        counts = np.asarray(pc.list_value_length(parts)).astype(np.int64)
        coded = parts.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        number = self.known.get
        numbers = np.array([number(w, -1) for w in words], np.int64)
        new = np.flatnonzero(numbers < 0).tolist()
        if new:
            first = len(self.size_of)
            self._learn([words[i] for i in new])
            numbers[new] = np.arange(first, first + len(new))
        found = numbers[np.asarray(coded.indices)]
        sizes = self.size_of[found]
        ends = np.cumsum(sizes)
        ids = self.flat[np.repeat(self.at_of[found] - ends + sizes, sizes) + np.arange(ends[-1])]
        return ids, np.diff(np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])])
