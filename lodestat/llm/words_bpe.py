"""Ids of a whole-word tokenizer, remembered by word.

The tokenizer drops white space before it splits, and neither its normaliser nor its split looks past a blank or a line
feed, so a text's ids are those of its blank-separated parts in order. Parts are found in the UTF-8 buffer and go by a 64-bit name and a second
value (both of BLAKE2 for long ones); each distinct part goes through the tokenizer once, and documents' ids are gathered with numpy. Parts that hold other
white space are parts like any other. Where the second values differ, parts with one name are encoded each by itself.
"""

from __future__ import annotations

import functools
import os

import numpy as np

from ._text import U, blocks, buffer, separators, words

#: A worker's memory of parts starts anew beyond this many parts or ids (about 150 MB).
MEMO_PARTS, MEMO_IDS = 3_000_000, 12_000_000
_BLANKS = separators(b" \n")


def _room(x: np.ndarray, n: int) -> np.ndarray:
    while len(x) < n:
        x = np.r_[x, np.zeros_like(x)]
    return x


class WordIds:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self._reset()

    def _reset(self) -> None:
        self.keys, self.checks, self.places = np.zeros(0, U), np.zeros(0, U), np.zeros(0, np.int64)  # sorted names, second values, and the number of each part
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0
        self.start, self.size, self.parts = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64), 0

    def _learn(self, parts: list[str]) -> None:
        for k in range(0, len(parts), 4096):
            some = parts[k : k + 4096]
            e = self.tokenizer.encode(some, is_pretokenized=True, add_special_tokens=False)  # each part by itself
            ids, m = e.ids, len(some)
            n = len(ids)
            self.pool = _room(self.pool, self.used + n)
            self.start, self.size = _room(self.start, self.parts + m), _room(self.size, self.parts + m)
            size = np.bincount(np.array(e.word_ids, np.int64), minlength=m)
            self.pool[self.used : self.used + n] = ids
            self.start[self.parts : self.parts + m] = self.used + np.cumsum(size) - size
            self.size[self.parts : self.parts + m] = size
            self.used += n
            self.parts += m

    def _numbers(self, h: np.ndarray, check: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The number of each part; parts not met before are learnt."""
        if self.parts > MEMO_PARTS or self.used > MEMO_IDS:
            self._reset()
        u, first, of = np.unique(h, return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, u)
        known = np.zeros(len(u), bool)
        if len(self.keys):
            known = self.keys[np.minimum(at, len(self.keys) - 1)] == u
        number, second = np.empty(len(u), np.int64), check[first]
        number[known], second[known] = self.places[at[known]], self.checks[at[known]]
        new = np.flatnonzero(~known)
        raw = memoryview(np.ascontiguousarray(data))
        take = lambda w: [str(raw[s:e], "utf-8") for s, e in zip(starts[w].tolist(), ends[w].tolist(), strict=True)]
        if len(new):
            number[new] = self.parts + np.arange(len(new))
            self._learn(take(first[new]))
            self.keys, self.places = np.insert(self.keys, at[new], u[new]), np.insert(self.places, at[new], number[new])
            self.checks = np.insert(self.checks, at[new], second[new])
        out = number[of]
        other = np.flatnonzero(second[of] != check)  # not the part that its first name was learnt for
        if len(other):
            out[other] = self.parts + np.arange(len(other))
            self._learn(take(other))
        return out

    def encode(self, column):
        """For consecutive row ranges of a string column: (first row, row after, ids, where each row's ids begin, and the end)"""
        data, at = buffer(column)
        for i, j in blocks(at):
            part = data[at[i] : at[j]]
            (h, check), starts, ends, first = words(part, at[i : j + 1] - at[i], separator=_BLANKS, check=True)
            number = self._numbers(h, check, part, starts, ends)
            start, size = self.start[number], self.size[number]
            stop = np.cumsum(size)
            place = np.arange(stop[-1] if len(stop) else 0) + np.repeat(start - (stop - size), size)
            yield i, j, self.pool[place], np.r_[0, stop][first]


@functools.lru_cache(4)
def load(path: str) -> WordIds:
    return WordIds(path)
