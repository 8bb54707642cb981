"""Vectorised word handling over Arrow text columns.

Words are named straight from the UTF-8 buffer with numpy, without Python strings: eight bytes at a time go through a mixing step that is
not linear, and words of over 64 bytes through BLAKE2, so no arrangement of letters makes different words meet (polynomials modulo
2**64 have such). Runs of words are named by doubling, with the same mixing. Names are the same in every task.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
SPACES = b" \t\n\v\f\r"
#: Start values and odd multipliers of independent names.
KEYS = ((0x243F6A8885A308D3, 0x9E6C63D0876A9A47), (0x452821E638D01377, 0xD1B54A32D192ED03))
#: Words of more bytes are named by BLAKE2.
LANES = 8


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every output bit depends on every input bit."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x ^= x >> U(33)
    x *= U(0xC4CEB9FE1A85EC53)
    x ^= x >> U(33)
    return x


#: Odd multipliers of second values, one for each eight bytes.
_ODD = mix(np.arange(1, LANES + 1, dtype=U) * U(KEYS[1][1])) | U(1)
_MASKS = np.array([(1 << 8 * i) - 1 for i in range(9)], U)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def separators(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_SPACE = separators(SPACES)


def buffer(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and where each row begins; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = pc.fill_null(column.cast(pa.large_binary()), b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)
    buffers = column.buffers()
    at = np.frombuffer(buffers[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8)[at[0] : at[-1]] if buffers[2] is not None else np.zeros(0, np.uint8)
    return data, at - at[0]


def blocks(at: np.ndarray, most: int = (1 << 20) - 1):
    """Row ranges of about ``most`` bytes; a longer row stands alone."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def slices(batch: pa.RecordBatch, column: int, most: int = 4 << 20):
    """Row slices of a batch with about ``most`` bytes in a text column; a longer row stands alone."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0)
    for i, j in blocks(np.r_[0, np.cumsum(np.asarray(size).astype(np.int64))], most):
        yield batch.slice(i, j - i)


def _borders(data: np.ndarray, at: np.ndarray, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first byte, byte after) of the words of consecutive rows."""
    gap = separator[data]
    word = ~gap
    first, last = word.copy(), word
    first[1:] &= gap[:-1]
    full = at[1:] > at[:-1]
    begin, end = at[:-1][full], at[1:][full] - 1
    first[begin] = ~gap[begin]
    last = ~gap
    last[:-1] &= gap[1:]
    last[end] = ~gap[end]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def _named(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, check: bool) -> tuple[np.ndarray, np.ndarray | None]:
    """(names of data[start:end], a second value for each, by plain sums of eight bytes at a time); data goes on for 8 bytes after the last end."""
    start, factor = U(KEYS[0][0]), U(KEYS[0][1])
    view = np.ndarray((len(data) - 7,), "<u8", data.data, strides=(1,))
    n = ends - starts
    h = mix(n.astype(U) + start)
    second = n.astype(U) if check else None
    live = np.flatnonzero(n <= 8 * LANES)
    all_live = len(live) == len(n)
    for lane in range(LANES):
        every = lane == 0 and all_live
        left = n if every else n[live] - 8 * lane
        x = view[(starts if every else starts[live]) + 8 * lane] & _MASKS[np.minimum(left, 8)]
        if every:
            h = mix((h ^ x) * factor + start)
            if check:
                second += x * _ODD[0]
        else:
            h[live] = mix((h[live] ^ x) * factor + start)
            if check:
                second[live] += x * _ODD[lane]
        live = live[left > 8]
        if not len(live):
            break
    for i in np.flatnonzero(n > 8 * LANES).tolist() if not all_live else ():
        digest = hashlib.blake2b(data[starts[i] : ends[i]], digest_size=16).digest()
        h[i] = int.from_bytes(digest[:8], "little")
        if check:
            second[i] = int.from_bytes(digest[8:], "little")
    return h, second


def words(data: np.ndarray, at: np.ndarray, lower: bool = False, separator: np.ndarray = _SPACE, check: bool = False):
    """(names, first byte, byte after, first word of each row) of the words of consecutive rows; check: names is (names, second values)."""
    if not len(data):
        z, h = np.zeros(0, np.int64), np.zeros(0, U)
        return ((h, h) if check else h), z, z, np.zeros(len(at), np.int64)
    starts, ends = _borders(data, at, separator)
    padded = np.empty(len(data) + 8, np.uint8)
    padded[: len(data)] = _LOWER[data] if lower else data
    padded[len(data) :] = 0
    h, second = _named(padded, starts, ends, check)
    return ((h, second) if check else h), starts, ends, np.searchsorted(starts, at)


def _joined(a: np.ndarray, b: np.ndarray, which: int) -> np.ndarray:
    return mix(a * U(KEYS[which][1]) + b + U(KEYS[which][0]))


def windows(h: np.ndarray, k: int, which: int = 0) -> np.ndarray:
    """Names of all runs of k consecutive entries of h (callers drop those that cross rows)."""
    n = len(h) - k + 1
    if n < 1:
        return np.zeros(0, U)
    out, done, size, x = None, 0, 1, h
    while True:
        if k & size:
            part = x[done : done + n]
            out, done = part if out is None else _joined(out, part, which), done + size
        if 2 * size > k:
            return out
        x = _joined(x[:-size], x[size:], which)
        size *= 2


def _short_rows(h: np.ndarray, first: np.ndarray, k: int) -> np.ndarray:
    """A name of the whole of each row with fewer than k words; 0 for other rows."""
    n = np.diff(first)
    out = np.where(n < k, mix(n.astype(U) + U(KEYS[1][0])), U(0))
    for i in range(min(k - 1, int(n.max(initial=0)))):
        r = np.flatnonzero((n > i) & (n < k))
        out[r] = _joined(out[r], h[first[r] + i], 0)
    return out


def shingle_sets(column, k: int, lower: bool = True):
    """For each row, in order: the sorted distinct names of its k-word shingles.

    A row of fewer words has one shingle, its whole sequence; a row of none has an empty set.
    """
    data, at = buffer(column)
    for i, j in blocks(at):
        h, _, _, w = words(data[at[i] : at[j]], at[i : j + 1] - at[i], lower)
        s = windows(h, k)
        short = _short_rows(h, w, k)
        for r in range(j - i):
            n = w[r + 1] - w[r]
            if n >= k:
                x = np.sort(s[w[r] : w[r + 1] - k + 1])
                yield x[np.r_[True, x[1:] != x[:-1]]] if len(x) > 1 else x
            else:
                yield short[r : r + 1] if n else short[:0]
