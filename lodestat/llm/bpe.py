"""Byte-level BPE with a hierarchical-bitmap rank queue.

A pre-token is a linked list of pieces. Every neighbouring pair whose bytes have a rank puts its left
position in that rank's bucket; three levels of 64-bit words say which buckets are not empty, so
find-first-set (lowest bit of each level) gives the lowest rank in three steps, whatever the number of pairs.
An entry is stale, and skipped, if its position has gone or its pair has another rank by now. A pre-token
of n bytes costs O(n log n) at worst, so that a text without a single space is no special case.

Defined results: a null text is empty and has no ids; texts are taken whole; ids depend on the text alone, so
repeated rows and any partitioning give the same; extra columns stay as they are (a clash with an output name is an error of the
caller's, who names the outputs).
"""

from __future__ import annotations

import base64
import functools
import hashlib
from heapq import heappop, heappush
from itertools import chain

import regex

#: Pre-tokens remembered by each worker: two generations of this many, up to MEMO_BYTES long each.
MEMO, MEMO_BYTES = 400_000, 64


#: Bits of a bitmap word. Python's integers are wide, so two levels of 256 cover 65,536 ranks, three 16 million.
BITS = 8
_LOW = (1 << BITS) - 1
_BIT = [1 << i for i in range(1 << BITS)]


class RankQueue:
    """Positions in buckets by rank, with a bitmap of two or more levels over the buckets that are not empty.

    ``Bpe.merge`` does these steps in line for two levels, where a call for each would cost more than the step.
    """

    def __init__(self, ranks: int):
        self.buckets: dict[int, list[int]] = {}
        self.levels, n = [], max(ranks, 1)
        while len(self.levels) < 2 or n > 1:
            n = (n + _LOW) >> BITS
            self.levels.append([0] * n)

    def push(self, rank: int, position: int) -> None:
        if (bucket := self.buckets.get(rank)) is not None:
            heappush(bucket, position)
            return
        self.buckets[rank] = [position]
        for level in self.levels:
            level[rank >> BITS] |= _BIT[rank & _LOW]
            rank >>= BITS

    def pop(self):
        """(rank, leftmost position) of the lowest rank, or None."""
        if not self.levels[-1][0]:
            return None
        at = 0
        for level in reversed(self.levels):
            word = level[at]
            at = at << BITS | ((word & -word).bit_length() - 1)
        bucket = self.buckets[at]
        position = heappop(bucket)
        if not bucket:
            del self.buckets[at]
            rank = at
            for level in self.levels:
                level[rank >> BITS] ^= _BIT[rank & _LOW]
                if level[rank >> BITS]:
                    break
                rank >>= BITS
        return at, position


class Bpe:
    """Encoder and decoder for a table of byte strings and ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.queue = RankQueue(max(ranks.values(), default=0) + 1)
        size = max(ranks.values(), default=-1) + 1
        self.bytes = [b""] * size
        for k, v in ranks.items():
            self.bytes[v] = k
        self.decimal = [str(i) for i in range(size)]
        self.memo = _Memo(self)

    @classmethod
    def from_file(cls, path: str, pattern: str) -> Bpe:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(None, map(bytes.strip, f)))}, pattern)

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one pre-token."""
        ranks, n = self.ranks, len(piece)
        whole = ranks.get(piece)
        if whole is not None:
            return [whole]
        if len(self.queue.levels) > 2:
            return self._merge_any(piece)
        get, buckets, bit = ranks.get, self.queue.buckets, _BIT
        low, (top,) = self.queue.levels
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pair = [-1] * n  # rank of the piece at i with the next; -1: none, or the piece has gone
        for i in range(n - 1):
            r = get(piece[i : i + 2])
            if r is not None:
                pair[i] = r
                if r in buckets:
                    buckets[r].append(i)  # ascending, so a heap
                else:
                    buckets[r] = [i]
                    low[r >> 8] |= bit[r & 255]
                    top |= bit[r >> 8]
        while top:
            w = (top & -top).bit_length() - 1
            x = low[w]
            r = w << 8 | ((x & -x).bit_length() - 1)
            bucket = buckets[r]
            if len(bucket) == 1:
                i = bucket[0]
                del buckets[r]
                x &= x - 1
                low[w] = x
                if not x:
                    top &= top - 1
            else:
                i = heappop(bucket)
            if pair[i] != r:
                continue  # stale
            j = after[i]
            k = after[i] = after[j]
            pair[j] = -1
            new = []
            if k < n:
                before[k] = i
                s = get(piece[i : after[k]])
                if s is None:
                    pair[i] = -1
                else:
                    pair[i] = s
                    new.append((s, i))
            else:
                pair[i] = -1
            h = before[i]
            if h >= 0:
                s = get(piece[h:k])
                if s is None:
                    pair[h] = -1
                elif s != pair[h]:
                    pair[h] = s
                    new.append((s, h))
            for s, i in new:
                if s in buckets:
                    heappush(buckets[s], i)
                else:
                    buckets[s] = [i]
                    low[s >> 8] |= bit[s & 255]
                    top |= bit[s >> 8]
        return self._pieces(piece, after)

    def _merge_any(self, piece: bytes) -> list[int]:
        """merge for vocabularies beyond two levels."""
        ranks, queue, n = self.ranks, self.queue, len(piece)
        after, before, pair = list(range(1, n + 1)), list(range(-1, n - 1)), [-1] * n

        def note(i: int) -> None:
            j = after[i]
            r = ranks.get(piece[i : after[j]], -1) if j < n else -1
            if r != pair[i]:
                pair[i] = r
                if r >= 0:
                    queue.push(r, i)

        for i in range(n):
            note(i)
        while (found := queue.pop()) is not None:
            r, i = found
            if pair[i] != r:
                continue
            j = after[i]
            after[i] = after[j]
            pair[i] = pair[j] = -1
            if after[i] < n:
                before[after[i]] = i
            note(i)
            if before[i] >= 0:
                note(before[i])
        return self._pieces(piece, after)

    def _pieces(self, piece: bytes, after: list[int]) -> list[int]:
        ranks, n = self.ranks, len(piece)
        out, i = [], 0
        while i < n:
            j = after[i]
            out.append(ranks[piece[i:j]])
            i = j
        return out

    def encode(self, text: str) -> list[int]:
        """Ids of a text; each match of the pattern is merged by itself, and special tokens are ordinary text."""
        return list(chain.from_iterable(map(self.memo.__getitem__, self.pattern.findall(text))))

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


class _Memo(dict):
    """Ids of recent short pre-tokens; the older half goes when the younger is full."""

    def __init__(self, bpe: Bpe):
        self.bpe, self.old = bpe, {}

    def __missing__(self, token: str):
        ids = self.old.get(token)
        if ids is None:
            piece = token.encode()
            ids = tuple(self.bpe.merge(piece))
            if len(piece) > MEMO_BYTES:
                return ids
        if len(self) >= MEMO:
            self.old = dict(self)
            self.clear()
        self[token] = ids
        return ids


@functools.lru_cache(4)
def load(path: str, pattern: str) -> Bpe:
    """One encoder for each Python worker."""
    return Bpe.from_file(path, pattern)


def digest(bpe: Bpe, text: str | None) -> tuple[int, str, str]:
    """(number of ids, sha256 of the decimal ids joined by a space, sha256 of the decoded bytes)"""
    ids = bpe.encode(text or "")
    return len(ids), hashlib.sha256(" ".join(map(bpe.decimal.__getitem__, ids)).encode()).hexdigest(), hashlib.sha256(bpe.decode(ids)).hexdigest()


def encode(df, path: str, pattern: str, text: str = "text", ids: str = "ids"):
    """df with an array<int> column of the text's ids."""
    from pyspark.sql import functions as F

    @F.pandas_udf("array<int>")
    def of(s):
        bpe = load(path, pattern)
        return s.map(lambda t: bpe.encode(t or ""), na_action=None)

    return df.withColumn(ids, of(F.col(text).cast("string")))


def decode(df, path: str, pattern: str, ids: str = "ids", out: str = "decoded"):
    """df with a binary column of the bytes that ids stand for."""
    from pyspark.sql import functions as F

    @F.pandas_udf("binary")
    def of(s):
        bpe = load(path, pattern)
        return s.map(lambda x: bpe.decode(x if x is not None else ()), na_action=None)

    return df.withColumn(out, of(F.col(ids)))


def digests(df, path: str, pattern: str, text: str = "text"):
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row: encoded, then decoded from the ids."""
    import pyarrow as pa
    from pyspark.sql import functions as F

    def of(batches):
        bpe = load(path, pattern)
        for b in batches:
            rows = [digest(bpe, t) for t in b.column(1).to_pylist()]
            n, i, d = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.record_batch([b.column(0), pa.array(n, pa.int64()), pa.array(i, pa.string()), pa.array(d, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("t")).mapInArrow(of, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
