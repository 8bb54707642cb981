"""Exact n-gram Jaccard join with set-relation skipping.

``classes`` names every document's set of word shingles; documents with the same set
form one class, so copies never multiply. ``join`` then finds every pair of classes whose
Jaccard similarity reaches the threshold, up to links between sets that are already known
to be connected:

* Shingles are ordered rare first (by a bounded table of the corpus's frequent shingles,
  then by name; any common order keeps the join exact). Indexed are pairs of neighbours in that order: each of the d shingles that
  only one of two sets has parts two common ones at most, so among the first d + 2 common ones two are neighbours in both sets, and they stand
  near the front. Sets that merely quote the same passage rarely share such a pair. (Below a similarity of 3/4 single shingles are indexed: two similar
  sets share one among the first ``n - ceil(t * n) + 1`` of each.)
* Index lists are sorted by set size and entries carry their position in the set. Lists are read in blocks: a block whose smallest set is
  too large, or whose positions leave too few shingles to share before and after them, is skipped without a look at its entries.
* Entries of a list that can still be similar are tied together: short lists by pairs, long ones through anchors of
  neighbouring size classes, which costs two ties an entry. Connected ties make families; similar sets are always of one family.
* Families are verified in blocks of bounded count and size. A row of exact intersections with the whole block is computed for few sets, the
  pivots. For a set that is highly similar to a pivot the other answers are derived from the pivot's: with i = |pivot & y| and the few items
  that differ, |x & y| lies between i - lost and i + gained. Only where that does not decide, and the two are not connected yet, x gets a row
  of its own.
* Before sets move, short counts of their items by low bits do: the sum of the smaller counts bounds an intersection from above, and only sets
  with a partner within that bound are verified, block against block. Families of very many blocks are connected within blocks and
  among the heads of what was found first; parts of one and the same component then need no comparison. So all pairs of
  different components are compared, and the result is exact.
* Entries that the frequency table shows to be in many sets are tied to their anchors where they are read; their lists are never
  gathered. Lists outside the table hold no more than some thousandth of all sets.

Texts are read whole and more than once, a few MB at a time, as reading costs less than keeping all sets.

Defined results: null, empty or blank texts have no shingles, belong to the empty set's class and
link with nothing. Fewer than k words make one shingle of the whole sequence. Rows with one doc_id
are rows of their own with the same component rules; a null doc_id takes part and its component is
the smallest non-null doc_id reached (null if none). Empty tables give empty results. Extra columns
are ignored by the join; only ``doc_id`` and the text column are read. Shingles are known by 64-bit names; sets by
128 bits, of which 64 name a class unless two classes share them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._cut import BROADCAST_ROWS, components, cut
from ._memory import thrifty
from ._text import U, mix, shingle_sets, slices

POSTING = np.dtype([("t", "<u8"), ("s", "<i8"), ("n", "<i4"), ("p", "<i4")])
#: Lists up to this length are tied by their pairs; entries of a list that are looked at or skipped together.
SHORT, SKIP = 1024, 16
#: Members of a family's block, on average, and their shingles; blocks of a part, which meet as short counts; blocks from which a family is thinned first.
BLOCK, BLOCK_ITEMS, PARTS, THIN = 256, 1 << 21, 4, 64
#: Keys that may be in more sets than this, by the table, are tied where they are read.
SPREAD = 4096
#: Entries of the table of frequent shingles: 12 MB at most.
FREQUENT = 1 << 20
#: Bytes of text whose shingles are in memory at once (a longer text stands alone), and rows with one key and text from which sets are made distinct before they are gathered.
SLICE, COPIES = 6 << 20, 1000


def signature(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s, digest_size=16).digest()


def _signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Two 64-bit integers for each set."""
    return np.frombuffer(b"".join(map(signature, sets)), "<i8").reshape(-1, 2)


def _class(names: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """The class of each pair of integers; shared: first ones that more than one set has."""
    return np.where(np.isin(names[:, 0], shared), names[:, 1], names[:, 0]) if len(shared) else names[:, 0].copy()


def _profile(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """(kind 0) each row's doc_id, key, the names of its set and set size; (kind 1) shingles in 3 or more of a batch's sets."""
    thrifty()
    names_of = ["kind", "doc_id", "key", "lo", "hi", "n"]
    for batch in batches:
        room = np.empty(batch.column(2).nbytes // 2 + len(batch) + 1, U)  # of a batch's shingles; what isn't used takes no memory
        used, seen = 0, set()
        for b in slices(batch, 2, SLICE):
            sets = list(shingle_sets(b.column(2), k))
            names, n = _signatures(sets), np.array([len(s) for s in sets], np.int64)
            yield pa.record_batch([pa.array(np.zeros(len(n), np.int8)), b.column(0), b.column(1), pa.array(names[:, 0].copy()), pa.array(names[:, 1].copy()), pa.array(n)], names_of)
            for g, s in zip(names[:, 0].tolist(), sets, strict=True):
                if g not in seen:
                    seen.add(g)
                    room[used : used + len(s)] = s
                    used += len(s)
            del sets
        flat = room[:used]
        flat.sort()
        first = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]]) if used else np.zeros(0, np.int64)
        c = np.diff(np.r_[first, used])
        u, c = flat[first[c > 2]].view(np.int64), c[c > 2]
        del room, flat, first
        none = pa.nulls(len(u), pa.int64())
        yield pa.record_batch([pa.array(np.ones(len(u), np.int8)), none, none, pa.array(u), none, pa.array(c, pa.int64())], names_of)


def _least(n, num: int, den: int):
    """ceil(n * num / den)"""
    return (n * num + den - 1) // den


def paired(num: int, den: int) -> bool:
    """Whether pairs of neighbours are indexed: similar sets then have more common shingles than parted ones, by two at least."""
    return 4 * num >= 3 * den


def indexed(n: int, num: int, den: int) -> int:
    """How many keys of a set of n shingles are indexed, from the front of its order."""
    least = int(_least(n, num, den))
    if not paired(num, den):
        return n - least + 1
    # with a partner of m shingles and o common ones, the (n + m - 2 o + 2)-th common one has at most n - o own ones before it
    return max(1, min(n - 1, max(2 * n + m - 3 * int(_least(n + m, num, num + den)) + 1 for m in range(least, least + 4))))


def _keys(s: np.ndarray, df: np.ndarray, most: int, two: bool) -> tuple[np.ndarray, np.ndarray]:
    """(keys in order, a bound of how many sets have each)"""
    o = np.argsort(df, kind="stable")[: most + two]
    t, df = s[o], df[o]
    if two and len(t) > 1:
        return mix(t[:-1] * U(0x9E3779B97F4A7C15) + t[1:])[:most], df[:-1][:most]  # the rarer of two bounds the pair
    return t[:most], df[:most]


def _anchors(p: np.ndarray, num: int, den: int) -> np.ndarray:
    """(set, anchor) of entries: similar sets' sizes differ by a factor of den / num at most, so by one class of sizes at most; an entry is tied to its own and the next."""
    band = np.floor(np.log(np.maximum(p["n"], 1)) / np.log(den / num) + 1e-9).astype(np.int64) if num < den else p["n"].astype(np.int64)
    anchor = np.concatenate([mix(p["t"] + (band + d).astype(U) * U(0x9E3779B97F4A7C15)).view(np.int64) for d in (0, 1)])
    return np.stack([np.tile(p["s"], 2), anchor], 1)


def _postings(batches: Iterator[pa.RecordBatch], k: int, num: int, den: int, tokens: np.ndarray, counts: np.ndarray, shared: np.ndarray, buckets: int, spread: int) -> Iterator[pa.RecordBatch]:
    """(bucket, tied, entries): index entries by bucket; tied: pairs instead, of sets and anchors."""
    thrifty()
    two = paired(num, den)
    for batch in batches:
        seen: set[int] = set()
        for b in slices(batch, 0, SLICE):
            sets = [s for s in shingle_sets(b.column(0), k) if len(s)]
            if not sets:
                continue
            out, frequent = [], []
            for s, g in zip(sets, _class(_signatures(sets), shared).tolist(), strict=True):
                if g in seen:
                    continue
                seen.add(g)
                n = len(s)
                df = np.zeros(n, np.int32)
                if len(tokens):
                    at = np.minimum(np.searchsorted(tokens, s), len(tokens) - 1)
                    df = np.where(tokens[at] == s, counts[at], 0)
                t, df = _keys(s, df, indexed(n, num, den), two)
                p = np.empty(len(t), POSTING)
                p["t"], p["s"], p["n"], p["p"] = t, g, n, np.arange(len(t))
                out.append(p)
                frequent.append(df > spread)
            if not out:
                continue
            p, often = np.concatenate(out), np.concatenate(frequent)
            tied = forest(_anchors(p[often], num, den))
            p = p[~often]
            bucket = (mix(p["t"]) % U(buckets)).astype(np.int32)
            o = np.argsort(bucket, kind="stable")
            p, bucket = p[o], bucket[o]
            cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True]) if len(p) else np.zeros(1, np.int64)
            at, blobs = bucket[cuts[:-1]], [p[i:j].tobytes() for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
            if len(tied):
                at, blobs = np.r_[at, np.int32(int(mix(tied[:1, 0].view(U))[0] % U(buckets)))], [*blobs, tied.tobytes()]
            yield pa.record_batch([pa.array(at, pa.int32()), pa.array(np.arange(len(at)) >= len(cuts) - 1), pa.array(blobs, pa.binary())], ["bucket", "tied", "entries"])


def _possible(a: np.ndarray, b: np.ndarray, num: int, den: int) -> np.ndarray:
    """Whether two entries of one list can belong to similar sets, by sizes and positions.

    No more than min(positions) are common before the two, and no more than the fewer of those that follow after. (A single shingle that matters is the
    first common one: none before.)
    """
    low, high = np.minimum(a["n"], b["n"]).astype(np.int64), np.maximum(a["n"], b["n"]).astype(np.int64)
    need = _least(a["n"].astype(np.int64) + b["n"], num, num + den)
    before = np.minimum(a["p"], b["p"]) if paired(num, den) else 0
    return (a["s"] != b["s"]) & (low * den >= high * num) & (before + np.minimum(a["n"] - a["p"], b["n"] - b["p"]) >= need)


def _sorted_pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.stack([np.minimum(a["s"], b["s"]), np.maximum(a["s"], b["s"])], 1)


def forest(pairs: np.ndarray) -> np.ndarray:
    """Some of pairs that connect what pairs connect, one less than the nodes of each component at most."""
    nodes, at = np.unique(pairs, return_inverse=True)
    at = at.reshape(-1, 2)
    label, kept = np.arange(len(nodes)), [np.zeros(0, np.int64)]
    while True:
        a, b = label[at[:, 0]], label[at[:, 1]]
        live = np.flatnonzero(a != b)
        if not len(live):
            return pairs[np.concatenate(kept)]
        first = np.full(len(nodes), len(pairs))
        np.minimum.at(first, a[live], live)
        np.minimum.at(first, b[live], live)
        chosen = np.unique(first[first < len(pairs)])  # each label's first pair: without circles
        kept.append(chosen)
        up = np.arange(len(nodes))
        for x, y in zip(a[chosen].tolist(), b[chosen].tolist(), strict=True):
            while up[x] != x:
                x = up[x]
            while up[y] != y:
                y = up[y]
            up[max(x, y)] = min(x, y)
        while (up[up] != up).any():
            up = up[up]
        label = up[label]


def list_pairs(p: np.ndarray, first: np.ndarray, size: np.ndarray, num: int, den: int) -> np.ndarray:
    """Pairs that connect all entries that can belong to similar sets, of lists of p (by size of sets) that begin at first.

    Each entry passes over the blocks of its list from its own on. Sizes only grow, so the first block that begins too large ends its
    walk; a block whose positions leave too few shingles before and after is skipped.
    """
    n, rest = p["n"].astype(np.int64), (p["n"] - p["p"]).astype(np.int64)
    lead = p["p"].astype(np.int64) if paired(num, den) else np.zeros(len(p), np.int64)
    count = -(-size // SKIP)
    block = np.cumsum(count) - count  # number of each list's first block
    head = np.repeat(first, count) + (np.arange(count.sum()) - np.repeat(block, count)) * SKIP
    stop = np.minimum(head + SKIP, np.repeat(first + size, count))
    if not len(head):
        return np.zeros((0, 2), np.int64)
    spans = np.stack([head, stop], 1).ravel()
    least, most, late = n[head], np.maximum.reduceat(np.r_[rest, 0], spans)[::2], np.maximum.reduceat(np.r_[lead, 0], spans)[::2]
    entry = np.repeat(first, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    place = np.repeat(block, size) + (entry - np.repeat(first, size)) // SKIP
    last = np.repeat(block + count, size)
    able = lead[entry] + rest[entry] >= _least(2 * n[entry], num, num + den)
    entry, place, last = entry[able], place[able], last[able]
    found, held = [np.zeros((0, 2), np.int64)], 0
    while len(entry):
        x = n[entry]
        near = least[place] * num <= x * den
        entry, place, last, x = entry[near], place[near], last[near], x[near]
        common = np.minimum(lead[entry], late[place]) + np.minimum(rest[entry], most[place])
        look = np.flatnonzero(common >= _least(x + np.maximum(least[place], x), num, num + den))
        for k in range(0, len(look), 1 << 14):
            some = look[k : k + (1 << 14)]
            a, b = np.repeat(entry[some], SKIP), (head[place[some]][:, None] + np.arange(SKIP)).ravel()
            ok = (b < np.repeat(stop[place[some]], SKIP)) & (b > a)
            a, b = p[a[ok]], p[b[ok]]
            ok = _possible(a, b, num, den)
            found.append(_sorted_pairs(a[ok], b[ok]))
            held += len(found[-1])
            if held > 1 << 20:
                found = [forest(np.concatenate(found))]
                held = len(found[0])
        place = place + 1
        on = place < last
        entry, place, last = entry[on], place[on], last[on]
    return forest(np.concatenate(found))


def _ties(group: pa.Table, num: int, den: int, most: int) -> pa.Table:
    """(a, b, anchor): pairs of classes that can be similar; in lists of more than ``most`` entries, classes and the anchors of their sizes."""
    entries, tied = group["entries"].to_pylist(), group["tied"].to_pylist()
    p = np.frombuffer(b"".join(x for x, t in zip(entries, tied, strict=True) if not t), POSTING)
    anchored = [np.frombuffer(x, np.int64).reshape(-1, 2) for x, t in zip(entries, tied, strict=True) if t]
    p = p[np.lexsort((p["s"], p["p"], p["n"], p["t"]))]
    if len(p):
        p = p[np.r_[True, (p["t"][1:] != p["t"][:-1]) | (p["s"][1:] != p["s"][:-1])]]
    first = np.flatnonzero(np.r_[True, p["t"][1:] != p["t"][:-1]]) if len(p) else np.zeros(0, np.int64)
    size = np.diff(np.r_[first, len(p)])
    short = (size > 1) & (size <= most)
    pairs = list_pairs(p, first[short], size[short], num, den)
    anchored = forest(np.concatenate([*anchored, _anchors(p[np.repeat(size > most, size)], num, den)]))
    both = np.concatenate([pairs, anchored])
    return pa.table({"a": pa.array(both[:, 0].copy()), "b": pa.array(both[:, 1].copy()), "anchor": pa.array(np.arange(len(both)) >= len(pairs))})


def similar(size: np.ndarray, rows, num: int, den: int, component: np.ndarray, bound) -> list[tuple[int, int]]:
    """Links between sets that connect all similar ones of a block.

    size: of each set; rows(x): exact intersections of set x with all; component: numbers of what is connected already;
    bound(x): cheap upper bounds of rows(x).
    """
    n = len(size)
    up = component.copy()
    links, pivots = [], []
    for x in range(n):
        todo = up != up[x]
        if not todo.any():
            continue
        need = _least(size[x] + size, num, num + den)
        todo &= np.minimum(size, size[x]) >= need
        if not todo.any():
            continue
        todo &= bound(x) >= need
        if not todo.any():
            continue
        lower, upper, exact = np.zeros(n, np.int64), np.minimum(size, size[x]), False
        for r, row in pivots[:8]:
            if row[x] >= need[r]:  # a highly similar set's answers
                lower, upper = np.maximum(lower, row - (size[r] - row[x])), np.minimum(upper, row + (size[x] - row[x]))
        if (todo & (lower < need) & (upper >= need)).any():
            row = rows(x)
            lower = upper = row
            exact = True
        for y in np.flatnonzero(todo & (lower >= need)):
            if up[y] != up[x]:
                links.append((x, int(y)))
                up[up == up[y]] = up[x]
        if exact:
            pivots.insert(0, (x, row))
            del pivots[8:]
    return links


def _wanted(batches: Iterator[pa.RecordBatch], k: int, shared: np.ndarray) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """(classes, sets) of a slice's texts, each class once a batch."""
    thrifty()
    for batch in batches:
        seen: set[int] = set()
        for b in slices(batch, 0, SLICE):
            sets = [s for s in shingle_sets(b.column(0), k) if len(s)]
            kept = {g: s for g, s in zip(_class(_signatures(sets), shared).tolist(), sets, strict=True) if g not in seen} if sets else {}
            seen |= kept.keys()
            yield np.array(list(kept), np.int64), list(kept.values())


def _sets(batches: Iterator[pa.RecordBatch], k: int, shared: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(s, items)"""
    for s, sets in _wanted(batches, k, shared):
        flat = np.concatenate([np.zeros(0, U), *sets]).view(np.int64)
        yield pa.record_batch([pa.array(s), pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(x) for x in sets])], pa.int32()), pa.array(flat))], ["s", "items"])


def _counts(batches: Iterator[pa.RecordBatch], k: int, shared: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(s, n, counts): how many of a set's items have each value of their low bits, 1 to 2 a value: the width in bytes, then the integers."""
    for s, sets in _wanted(batches, k, shared):
        out = []
        for x in sets:
            bits = len(x).bit_length() - 1
            c = np.bincount((x & U((1 << bits) - 1)).view(np.int64), minlength=1 << bits)
            out.append(b"\x01" + c.astype(np.uint8).tobytes() if c.max() < 256 else b"\x04" + c.astype("<u4").tobytes())
        yield pa.record_batch([pa.array(s), pa.array(np.array([len(x) for x in sets], np.int64)), pa.array(out, pa.binary())], ["s", "n", "counts"])


def _within_bounds(group: pa.Table, num: int, den: int) -> pa.Table:
    """(f, i, j, s): sets with a partner of another component that counts don't rule out, and the blocks of the two.

    lo, hi: the parts of the family that meet; of one part all pairs are looked at, of two those between them.
    """
    n, s, c, block, part = (group[k].to_numpy() for k in ("n", "s", "c", "block", "part"))
    wide = [np.frombuffer(x[1:], np.uint8 if x[0] == 1 else "<u4") for x in group["counts"].to_pylist()]
    width = min(map(len, wide))
    h = np.stack([x.reshape(-1, width).sum(0, dtype=np.int32) for x in wide])  # low bits: wider counts fold
    del wide
    h = h.astype(np.uint8 if h.max() < 256 else np.int32)
    one = group["lo"][0].as_py() == group["hi"][0].as_py()
    o = np.argsort(n, kind="stable")
    n, s, c, block, part, h = n[o], s[o], c[o], block[o], part[o], h[o]
    found = [np.zeros((0, 2), np.int64)]
    for x in range(len(s)):
        y = np.arange(x + 1, int(np.searchsorted(n, n[x] * den // num, "right")))  # not smaller than x, and not too large
        y = y[(c[y] != c[x]) & (one | (part[y] != part[x]))]
        for k in range(0, len(y), 512):
            z = y[k : k + 512]
            z = z[np.minimum(h[z], h[x]).sum(1, dtype=np.int64) >= _least(n[z] + n[x], num, num + den)]
            found.append(np.stack([np.full(len(z), x), z], 1))
    x, y = np.concatenate(found).T
    i, j = np.minimum(block[x], block[y]), np.maximum(block[x], block[y])
    rows = np.unique(np.stack([np.r_[i, i], np.r_[j, j], s[np.r_[x, y]]], 1), axis=0)
    return pa.table({"f": pa.array(np.full(len(rows), group["f"][0].as_py()), pa.int64()), "i": pa.array(rows[:, 0], pa.int32()), "j": pa.array(rows[:, 1], pa.int32()), "s": pa.array(rows[:, 2].copy())})


def _folded(items: np.ndarray, size: np.ndarray, most: int = 1 << 23) -> np.ndarray:
    """Counts of each set's items by low bits: about one bit for each four items of the largest set, and no more than ``most`` counts in all."""
    bits = max(0, int(np.log2(max(min(size.max(initial=1) / 4, most / max(1, len(size))), 1))))
    at = np.repeat(np.arange(len(size)) << bits, size)
    at += items & ((1 << bits) - 1)
    return np.bincount(at, minlength=len(size) << bits).astype(np.int32).reshape(len(size), -1)


def _verify(group: pa.Table, num: int, den: int) -> pa.Table:
    thrifty()
    group = group.sort_by("s")
    s = group["s"].to_numpy()
    group = group.take(pa.array(np.flatnonzero(np.r_[True, s[1:] != s[:-1]])))  # a row read twice
    items = group["items"].combine_chunks()
    size, s, flat = np.asarray(items.value_lengths()).astype(np.int64), group["s"].to_numpy(), items.flatten().to_numpy()
    names, of = np.unique(flat, return_inverse=True)
    of = of.astype(np.int32)
    at = np.cumsum(size) - size
    flag = np.zeros(len(names), np.int32)
    del names

    def rows(x: int) -> np.ndarray:
        mine = of[at[x] : at[x] + size[x]]
        flag[mine] = 1
        out = np.add.reduceat(flag[of], at)
        flag[mine] = 0
        return out.astype(np.int64)

    _, component = np.unique(group["c"].to_numpy(), return_inverse=True)
    counts = _folded(flat, size)
    found = similar(size, rows, num, den, component, lambda x: np.minimum(counts[x], counts).sum(1))
    x, y = np.array([f[0] for f in found], np.int64), np.array([f[1] for f in found], np.int64)
    return pa.table({"a": pa.array(s[x], pa.int64()), "b": pa.array(s[y], pa.int64())})


def _keyed(docs: DataFrame, text: str) -> DataFrame:
    """t, doc_id and key, which names a row by its doc_id and text."""
    t, i = F.col(text).cast("string"), F.col("doc_id").cast("long")
    return docs.select(t.alias("t"), i.alias("doc_id"), F.xxhash64(i, t).alias("key"))


def shared_names(rows: DataFrame) -> np.ndarray:
    """First names (lo) that stand with more than one second name (hi), sorted: about (number of classes)**2 / 2**65 of them."""
    found = rows.groupBy("lo").agg(F.min("hi").alias("a"), F.max("hi").alias("b")).where("a <> b").select("lo").collect()
    return np.sort(np.array([r["lo"] for r in found], np.int64))


def classes(docs: DataFrame, k: int, text: str = "text") -> tuple[DataFrame, DataFrame, np.ndarray]:
    """(doc_id, key, class, n_shingles of each row; frequent shingles x by batch with counts n; names that two classes share)"""
    profile = cut(_keyed(docs, text).select("doc_id", "key", "t").mapInArrow(lambda it: _profile(it, k), "kind byte, doc_id long, key long, lo long, hi long, n long"))
    rows = profile.where("kind = 0")
    shared = shared_names(rows)
    name = F.when(F.col("lo").isin(shared.tolist()), F.col("hi")).otherwise(F.col("lo")) if len(shared) else F.col("lo")
    members = rows.select("doc_id", "key", name.alias("class"), F.col("n").alias("n_shingles"))
    return members, profile.where("kind = 1").select(F.col("lo").alias("x"), "n"), shared


def join(docs: DataFrame, k: int = 5, num: int = 4, den: int = 5, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(members, links) of the texts whose shingle sets have a similarity of num/den or more.

    members: doc_id, key, class, n_shingles for each row. links: pairs (a, b) of classes that were
    verified; every other similar pair connects two classes that links already connect.
    """
    members, frequent, shared = classes(docs, k, text)
    top = frequent.groupBy("x").agg(F.sum("n").alias("n")).where("n > 7").orderBy(F.desc("n"), "x").limit(FREQUENT).toArrow()
    tokens, counts = top["x"].to_numpy().view(U), np.minimum(top["n"].to_numpy(), 1 << 30).astype(np.int32)
    order = np.argsort(tokens)
    tokens, counts = tokens[order], counts[order]
    del top, order
    pa.default_memory_pool().release_unused()
    total = int(members.agg(F.sum("n_shingles")).first()[0] or 0)
    buckets = max(48, total * indexed(1000, num, den) // 1000 // 150_000)
    keyed = _keyed(docs, text)
    most, spread = SHORT, SPREAD
    ties = cut(
        keyed.select("t").mapInArrow(lambda it: _postings(it, k, num, den, tokens, counts, shared, buckets, spread), "bucket int, tied boolean, entries binary")
        .groupBy("bucket").applyInArrow(lambda g: _ties(g, num, den, most), "a long, b long, anchor boolean"),
        True,
    )
    owners = members.where("n_shingles > 0").groupBy(F.col("class").alias("s")).agg(F.min("key").alias("key"), F.min("n_shingles").alias("n"))
    repeated = not members.groupBy("key").agg(F.count("*").alias("c")).where(F.col("c") > COPIES).isEmpty()
    named = ties.select(F.col("a").alias("s")).unionByName(ties.where("not anchor").select(F.col("b").alias("s"))).distinct()
    family = components(ties.select("a", "b")).withColumnRenamed("node", "s").join(named, "s").select("s", F.col("component").alias("f"))
    family = cut(family.join(owners, "s"))
    room = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_ITEMS)).cast("int")
    blocks = family.groupBy("f").agg(room.alias("blocks"), F.count("*").alias("m")).where("m > 1").drop("m")
    nodes = cut(family.join(blocks, "f").withColumn("block", F.pmod(F.xxhash64("s", F.lit(7)), F.col("blocks")).cast("int")))

    def read(wanted: DataFrame, how, schema: str) -> DataFrame:
        """What how makes of one row of each class in wanted (s, key); rows that are equal in doc_id and text are all read."""
        keys = wanted.select("key").distinct()
        few = keys.count() <= BROADCAST_ROWS
        out = keyed.join(F.broadcast(keys) if few else keys, "key", "left_semi").select("t").mapInArrow(lambda it: how(it, k, shared), schema)
        return out.dropDuplicates(["s"]) if repeated else out

    def verified(rows: DataFrame, by: list[str]) -> DataFrame:
        """Links of rows (s, key, c, and by, which names a block)."""
        put = read(rows, _sets, "s long, items array<long>").join(F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows, "s")
        return cut(put.groupBy(*by).applyInArrow(lambda g: _verify(g, num, den), "a long, b long").distinct(), True)

    def labelled(links: DataFrame | None) -> DataFrame:
        """nodes with their component c."""
        if links is None:
            return nodes.withColumn("c", F.col("s"))
        return nodes.join(components(links).withColumnRenamed("node", "s"), "s", "left").withColumn("c", F.coalesce("component", "s")).drop("component")

    links = None
    huge = nodes.where(F.col("blocks") > THIN)
    if not huge.isEmpty():  # a family that would meet in very many pairs of blocks is connected within blocks, then among heads, before
        links = verified(cut(huge.select("s", "key", "f", "block", F.col("s").alias("c"))), ["f", "block"])
        heads = labelled(links).where(F.col("blocks") > THIN)
        first = heads.groupBy("f", "c").agg(F.min("s").alias("s")).select("s")
        heads = heads.join(first, "s", "left_semi")
        width = heads.groupBy("f").agg(room.alias("w"))
        heads = heads.join(width, "f").select("s", "key", "f", F.pmod(F.xxhash64("s", F.lit(9)), F.col("w")).alias("block"), F.col("s").alias("c"))
        links = cut(links.unionByName(verified(cut(heads), ["f", "block"])))
    known = cut(labelled(links))
    mixed = known.groupBy("f").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high").select("f")
    parts = known.join(mixed, "f").withColumn("part", F.expr(f"cast(block div {PARTS} as int)"))
    span = parts.groupBy("f", "part").agg(F.min("c").alias("low"), F.max("c").alias("high"))
    other = span.select("f", F.col("part").alias("other"), F.col("low").alias("low2"), F.col("high").alias("high2"))
    meet = span.join(other, "f").where("not (low = high and low2 = high2 and low = low2)").select("f", "part", "other")
    sides = cut(parts.join(meet, ["f", "part"]).select("s", "key", "f", "c", "block", "part", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi")).distinct())
    small = read(sides, _counts, "s long, n long, counts binary")
    hopeful = small.join(F.broadcast(sides) if sides.count() <= BROADCAST_ROWS else sides, "s").groupBy("f", "lo", "hi").applyInArrow(lambda g: _within_bounds(g, num, den), "f long, i int, j int, s long")
    found = verified(cut(hopeful.distinct().join(known.select("s", "c", "key"), "s"), True), ["f", "i", "j"])
    return members, found if links is None else links.unionByName(found).distinct()


def _grouped(docs: DataFrame, k: int, num: int, den: int, text: str) -> DataFrame:
    """doc_id, key, class, n_shingles and g, the component of the class, of each row."""
    members, links = join(docs, k, num, den, text)
    return members.join(components(links).withColumnRenamed("node", "class"), "class", "left").withColumn("g", F.coalesce("component", "class"))


def groups(docs: DataFrame, k: int = 5, num: int = 4, den: int = 5, text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links) of each row."""
    of = _grouped(docs, k, num, den, text)
    low = of.where("n_shingles > 0").groupBy("g").agg(F.min("doc_id").alias("low"))
    return of.join(low, "g", "left").select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("low")).otherwise(F.col("doc_id")).alias("component_id"))


def near_copies_removed(docs: DataFrame, k: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """docs with the same columns, one row of each group of linked texts.

    It is the row with the smallest doc_id (null comes last), of several the one whose text has the smallest hash, of equal ones the one whose
    columns have. Rows decide by their own text, whatever other rows have their doc_id. Rows without words all stay.
    """
    of = _grouped(docs, k, num, den, "text").where("n_shingles > 0")
    rows = of.groupBy("g", "doc_id", "key").agg(F.count("*").alias("__rows"))
    first = rows.groupBy("g").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("head"), F.min_by("__rows", F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("__rows"))
    kept = cut(first.select(F.col("head.key").alias("__key"), "__rows"), True)
    plain = docs.select(*[F.col(f"`{c}`") for c in docs.columns])
    t = F.col("text").cast("string")
    blank = F.coalesce(F.regexp_replace(t, r"[ \t-\r]", "") == "", F.lit(True))
    named = plain.withColumn("__key", F.xxhash64(F.col("doc_id").cast("long"), t)).join(F.broadcast(kept) if kept.count() <= BROADCAST_ROWS else kept, "__key", "left")
    single = named.where(blank | (F.col("__rows") == 1))
    many = named.where(~blank & (F.col("__rows") > 1))  # rows equal in doc_id and text: one of each, chosen before they move
    sortable = [F.col(f"`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    one = many.groupBy("__key").agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), F.xxhash64(*sortable)).alias("__row"))
    names = [f"`{c}`" for c in docs.columns]
    return single.select(*names).unionByName(one.select(*[F.col(f"__row.{c}") for c in names]))
