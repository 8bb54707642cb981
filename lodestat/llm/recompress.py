"""Exact removal of repeated word windows, found by recompression.

Every text is a sequence of words named by fingerprints. Rounds of recompression rename it: first runs of
one word, then pairs of neighbours of which the first falls in the left and the second in the right
half of all names. Names are fingerprints of what they stand for and the halves are a function of the name,
so every task names globally: equal substrings get equal symbols, but near their ends. For each symbol
its *reach* is kept: the words that decided that it exists. A symbol whose reach lies in a window
stands in every equal window at the same place.

1. Chunks of documents ask which of their high-level symbols (three words or more) occur twice in the corpus.
2. A window with a unique symbol's reach inside cannot repeat. The windows left, those of shared symbols, are
   verified: chunks ask for the first owner of each distinct 96-bit window fingerprint.
3. All later windows mark their words; marked words go.

Each chunk sends a key once, so a passage in a third of all documents costs one entry a chunk.

Defined results: null and empty texts have no words and keep none; texts shorter than the window lose
nothing. Earlier means smaller doc_id, then (for rows with one doc_id) a smaller hash of the text, then earlier start; a null doc_id comes
after all others; of equal rows one counts as the first. Words are maximal runs of bytes other than space and 09-0D; no text is cut. Empty tables give empty tables.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._chunks import Messages, chunked, hop, in_order
from ._memory import thrifty
from ._text import U, blocks, buffer, mix, windows, words

LEVELS = 4
#: Symbols of fewer words are common by chance and are not asked about.
LEAST_WORDS = 3
_TAG = [U(x) for x in (0x8F14E45FCEEA167A, 0x6512BD43D9CAA6E0, 0xC20AD4D76FE97759, 0xC51CE410C124A10E, 0xAAB3238922BCC25A)]


def parse(h: np.ndarray, first: np.ndarray, levels: int = LEVELS):
    """(name, first word, last word, reach from, reach to) of the symbols that rows of words turn into.

    h: word fingerprints of consecutive rows; first: first word of each row, and the end.
    A reach that touches a row's edge goes beyond the row.
    """
    n = len(h)
    begins = np.zeros(n + 1, bool)
    begins[first] = True
    begins = begins[:n]
    # runs
    new = begins.copy()
    new[1:] |= h[1:] != h[:-1]
    lo = np.flatnonzero(new)
    hi = np.r_[lo[1:], n] - 1 if n else lo
    run = (hi - lo + 1).astype(U)
    name = np.where(run > 1, mix(h[lo] * _TAG[0] + run), h[lo])
    left, right = lo - 1, hi + 1
    edge = begins[lo]
    for level in range(levels):
        side = (mix(name * _TAG[1] + U(level + 1)) & U(1)).astype(bool)  # True: left
        m = len(name)
        if m < 2:
            break
        joins = np.zeros(m, bool)  # with the next
        joins[:-1] = side[:-1] & ~side[1:] & ~edge[1:]
        is_second = np.r_[False, joins[:-1]]
        # an unjoined symbol also depends on the neighbour on its open side
        l2, r2 = left.copy(), right.copy()
        r2[:-1] = np.where(side[:-1] & ~joins[:-1], np.maximum(right[:-1], right[1:]), right[:-1])
        l2[1:] = np.where(~side[1:] & ~is_second[1:], np.minimum(left[1:], left[:-1]), left[1:])
        keep = np.flatnonzero(~is_second)
        j = joins[keep]
        other = np.minimum(keep + 1, m - 1)
        name = np.where(j, mix(mix(name[keep] * _TAG[2]) + name[other] * _TAG[3] + U(level)), name[keep])
        left = np.where(j, np.minimum(left[keep], left[other]), l2[keep])
        right = np.where(j, np.maximum(right[keep], right[other]), r2[keep])
        lo, hi, edge = lo[keep], np.where(j, hi[other], hi[keep]), edge[keep]
    return name, lo, hi, left, right


class _Chunk:
    """A chunk's words and symbols, the same each time it is read."""

    def __init__(self, group: pa.Table):
        thrifty()
        self.table = in_order(group)
        data, at = buffer(self.table["text"])
        hs, ws, base = [], [np.zeros(1, np.int64)], 0
        for i, j in blocks(at):
            h, _, _, w = words(data[at[i] : at[j]], at[i : j + 1] - at[i])
            hs.append(h)
            ws.append(w[1:] + base)
            base += len(h)
        self.h = np.concatenate(hs) if hs else np.zeros(0, U)
        self.first = np.concatenate(ws)
        self.name, lo, hi, self.left, self.right = parse(self.h, self.first)
        self.asked = hi - lo + 1 >= LEAST_WORDS

    def symbols(self) -> tuple[np.ndarray, np.ndarray]:
        return np.unique(self.name[self.asked], return_counts=True)

    def candidates(self, shared: np.ndarray, k: int) -> np.ndarray:
        """Starts of the windows without a symbol that the corpus has once; shared: a flag for each of symbols()."""
        n = len(self.h)
        if n < k:
            return np.zeros(0, np.int64)
        once = np.zeros(len(self.name), bool)
        names = self.name[self.asked]
        once[self.asked] = ~shared[np.searchsorted(np.unique(names), names)]
        once &= self.right - self.left < k
        a, b = np.maximum(self.right[once] - k + 1, 0), self.left[once] + 1
        ok = b > a
        change = np.bincount(a[ok], minlength=n + 2) - np.bincount(b[ok], minlength=n + 2)
        free = np.cumsum(change)[: n - k + 1] == 0
        for f in np.unique(self.first):  # windows over a row's end
            free[max(0, f - k + 1) : f] = False
        return np.flatnonzero(free)

    def distinct(self, start: np.ndarray, k: int):
        """(sorted distinct (fingerprint, check) keys, place of the first window of each, key of each start)"""
        key = np.empty(len(start), KEY)
        key["a"], key["b"] = windows(self.h, k)[start], (windows(self.h, k, 1)[start] >> U(32)).astype(np.uint32)
        o = np.lexsort((np.arange(len(start)), key["b"], key["a"]))
        s = key[o]
        new = np.ones(len(s), bool)
        new[1:] = (s["a"][1:] != s["a"][:-1]) | (s["b"][1:] != s["b"][:-1])
        of = np.empty(len(start), np.int64)
        of[o] = np.cumsum(new) - 1
        return s[new], o[new], of

    def owner(self, start: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, start, "right") - 1


KEY = np.dtype([("a", "<u8"), ("b", "<u4")])
_LAST = np.iinfo(np.int64).max


def _ask_symbols(group: pa.Table, to: Messages) -> pa.Table:
    u, c = _Chunk(group).symbols()
    return to.ask(group["chunk"][0].as_py(), u, {"keys": u, "twice": c > 1})


def _shared(asked: dict[str, np.ndarray], chunk: np.ndarray) -> np.ndarray:
    _, of, count = np.unique(asked["keys"], return_inverse=True, return_counts=True)
    return (count + np.bincount(of[asked["twice"]], minlength=len(count)) > 1)[of]


def _ask_windows(group: pa.Table, replies: pa.Table, symbols: Messages, to: Messages, k: int) -> pa.Table:
    if not len(group):
        return to.ask(0, np.zeros(0, U), {"keys": np.zeros(0, KEY), "doc": np.zeros(0, np.int64)})
    c = _Chunk(group)
    start = c.candidates(symbols.answers(replies), k)
    key, first, _ = c.distinct(start, k)
    docs = np.asarray(c.table["doc_id"].combine_chunks().fill_null(_LAST))[c.owner(start[first])]
    return to.ask(group["chunk"][0].as_py(), key["a"].copy(), {"keys": key, "doc": docs})


def _first_owner(asked: dict[str, np.ndarray], chunk: np.ndarray) -> np.ndarray:
    """Whether each entry has the smallest (doc_id, chunk) of its key."""
    keys = asked["keys"]
    o = np.lexsort((chunk, asked["doc"], keys["b"], keys["a"]))
    s = keys[o]
    new = np.ones(len(s), bool)
    new[1:] = (s["a"][1:] != s["a"][:-1]) | (s["b"][1:] != s["b"][:-1])
    out = np.empty(len(s), bool)
    out[o] = new
    return out


def _marked(group: pa.Table, replies: pa.Table, symbols: Messages, owners: Messages, k: int) -> tuple[_Chunk, np.ndarray]:
    c = _Chunk(group)
    kind = replies["kind"].to_numpy()
    start = c.candidates(symbols.answers(replies.filter(pa.array(kind == 0))), k)
    key, first, of = c.distinct(start, k)
    later = np.ones(len(start), bool)
    later[first] = ~owners.answers(replies.filter(pa.array(kind == 1)))
    change = np.zeros(len(c.h) + 1, np.int64)
    change[: len(c.h) + 1] += np.bincount(start[later], minlength=len(c.h) + 1) - np.bincount(start[later] + k, minlength=len(c.h) + 1)
    return c, np.cumsum(change)[:-1] > 0


def _strip(group: pa.Table, replies: pa.Table, symbols: Messages, owners: Messages, k: int, as_is: bool) -> pa.Table:
    carried = [c for c in group.column_names if c.startswith("carry_")]
    if not len(group):
        return pa.table([pa.array([], f.type) for f in SCHEMA] + [group[c] for c in carried], names=SCHEMA.names + carried)
    c, gone = _marked(group, replies, symbols, owners, k)
    removed = np.r_[0, np.cumsum(gone)]
    n_words, n_removed = np.diff(c.first), removed[c.first[1:]] - removed[c.first[:-1]]
    kept: list = []
    for t, f, n, r in zip(c.table["text"].to_pylist(), c.first, n_words, n_removed, strict=False):
        if as_is and not r:
            kept.append(t)
            continue
        w = (t or "").encode().split()
        kept.append(b" ".join(compress(w, (~gone[f : f + n]).tolist()) if r else w))
    if as_is:
        kept = [x.decode() if isinstance(x, bytes) else x for x in kept]
    text = pa.array(kept, pa.string()) if as_is else pa.array(kept, pa.binary()).cast(pa.string())
    return pa.table([c.table["doc_id"], pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), text] + [c.table[x] for x in carried], names=SCHEMA.names + carried)


SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])


def remove_repeats(docs: DataFrame, k: int = 20, text: str = "text", carry: tuple[str, ...] = (), as_is: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the kept words joined by one space) of each row, then carry_<place> of the columns carry.

    as_is: the kept text of rows that lose nothing is their text, with its own white space (null if null).
    """
    base, n = chunked(docs, text=text, carry=carry)
    symbols = Messages(n, hop(n), {"keys": np.dtype("<u8"), "twice": np.dtype(bool)}, np.dtype(bool))
    owners = Messages(n, hop(n), {"keys": KEY, "doc": np.dtype("<i8")}, np.dtype(bool))
    first = symbols.answered(base.groupBy("chunk").applyInArrow(lambda g: _ask_symbols(g, symbols), symbols.schema), _shared)
    asked = base.groupBy("chunk").cogroup(first.groupBy("chunk")).applyInArrow(lambda g, r: _ask_windows(g, r, symbols, owners, k), owners.schema)
    second = owners.answered(asked, _first_owner)
    both = first.withColumn("kind", F.lit(0)).unionByName(second.withColumn("kind", F.lit(1)))
    extra = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields if f.name.startswith("carry_"))
    return base.groupBy("chunk").cogroup(both.groupBy("chunk")).applyInArrow(lambda g, r: _strip(g, r, symbols, owners, k, as_is), "doc_id long, n_words long, n_removed long, kept string" + extra)


def without_repeats(docs: DataFrame, k: int = 50) -> DataFrame:
    """docs with the same columns, texts (and n_chars) without the words of repeated windows; rows that lose nothing stay as they are."""
    others = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    out = remove_repeats(docs, k, carry=others, as_is=True)
    value = {c: F.col(f"carry_{i}") for i, c in enumerate(others)}
    if "n_chars" in others:
        value["n_chars"] = F.when(F.col("n_removed") > 0, F.length("kept").cast("long")).otherwise(value["n_chars"])
    value |= {"doc_id": F.col("doc_id"), "text": F.col("kept")}
    kind = {f.name: f.dataType for f in docs.schema.fields}
    return out.select(*[value[c].cast(kind[c]).alias(c) for c in docs.columns])
