"""Chunks of documents that ask the whole corpus about their keys, and get the answers back.

A chunk is a hash group of documents of a few MB. Each chunk sends its *distinct* keys, sorted,
cut into ranges of the key space; a range's task sees at most one entry a chunk for any key, however
hot the key is, and answers in the order of the question.

With n chunks and n ranges, n * n messages would get ever smaller as n grows. Beyond DIRECT chunks messages take two hops: a chunk sends to
about sqrt(n) coarse ranges, a relay gathers what some sqrt(n) chunks send to one coarse range and sends it on by fine range, and replies
come back through relays of the same kind. A relay holds about as many keys as a chunk has, and messages are n ** 1.5.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._cut import BROADCAST_ROWS, cut, text_bytes

#: Chunks up to which each sends to each range without a relay.
DIRECT = 4096
CHUNK_BYTES = 6 << 20
#: Rows equal in doc_id and text from which they are dealt over several chunks.
COPIES = 1000


def chunked(docs: DataFrame, least: int = 48, text: str = "text", carry: tuple[str, ...] = ()) -> tuple[DataFrame, int]:
    """((chunk, doc_id, text, and carry_<place> of the columns carry), how many chunks, and key ranges, suit the corpus).

    A row's chunk is a hash of its doc_id and text, so neither a null nor a repeated doc_id gathers texts in one task. Very many rows
    equal in both are written once with a number and dealt by it, so that every read of the chunks finds them in the same place.
    """
    n = max(least, text_bytes(docs, text) // CHUNK_BYTES)
    key, t = F.col("doc_id").cast("long"), F.col(f"`{text}`").cast("string")
    rows = docs.select(F.xxhash64(key, t).alias("__h"), key.alias("doc_id"), t.alias("text"), *[F.col(f"`{c}`").alias(f"carry_{i}") for i, c in enumerate(carry)])
    chunk = lambda *more: F.pmod(F.xxhash64("__h", *more), F.lit(n)).cast("int").alias("chunk")
    rest = [F.col(f"`{c}`") for c in rows.columns if c != "__h"]
    hot = rows.groupBy("__h").agg(F.count("*").alias("__n")).where(F.col("__n") > COPIES).select("__h")
    many = hot.count()
    if not many:
        return rows.select(chunk(), *rest), n
    hot = cut(hot)
    few = F.broadcast(hot) if many <= BROADCAST_ROWS else hot
    dealt = cut(rows.join(few, "__h", "left_semi").select(chunk(F.expr(f"monotonically_increasing_id() div {COPIES}")), *rest))
    return rows.join(few, "__h", "left_anti").select(chunk(), *rest).unionByName(dealt), n


def in_order(group: pa.Table) -> pa.Table:
    """A chunk's rows by doc_id, then text. Nulls come last."""
    return group.sort_by([("doc_id", "ascending"), ("text", "ascending")]) if len(group) else group


def hop(n: int) -> int:
    """Ranges (and chunks) of a relay; 0: no relays."""
    return isqrt(n) if n > DIRECT else 0


def range_of(keys: np.ndarray, n: int) -> np.ndarray:
    """Which of n ranges of the key space each 64-bit key falls into."""
    return (((keys >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)).astype(np.int64)


def _raw(name: str, x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).tobytes()


@dataclass(frozen=True)
class Messages:
    """What chunks send: keys and columns by name with their types, and how arrays become bytes (pack) and come back (unpack)."""

    n: int
    by: int
    fields: dict[str, np.dtype]
    reply: np.dtype
    pack: Callable[[str, np.ndarray], bytes] = _raw
    unpack: Callable[[str, bytes, int, np.dtype], np.ndarray] = lambda name, x, n, kind: np.frombuffer(x, kind)

    @property
    def schema(self) -> str:
        return "range int, chunk int, n int, fine binary, sizes binary, " + ", ".join(f"{f} binary" for f in self.fields)

    def ask(self, chunk: int, order: np.ndarray, columns: dict[str, np.ndarray]) -> pa.Table:
        """A row for each (coarse) range with keys. order: the 64 bits by which keys are sorted and dealt; columns: all fields."""
        r = range_of(order, self.n)
        d = r // self.by if self.by else r
        cuts = np.flatnonzero(np.r_[True, d[1:] != d[:-1], True]) if len(d) else np.zeros(1, np.int64)
        parts = [slice(i, j) for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
        fine = [np.unique(r[p], return_counts=True) if self.by else (np.zeros(0), np.zeros(0)) for p in parts]
        blob = lambda xs: pa.array([np.asarray(x, np.int32).tobytes() for x in xs], pa.binary())
        return pa.table({
            "range": pa.array(d[cuts[:-1]], pa.int32()), "chunk": pa.array(np.full(len(parts), chunk), pa.int32()), "n": pa.array(np.diff(cuts), pa.int32()),
            "fine": blob(f for f, _ in fine), "sizes": blob(c for _, c in fine),
        } | {f: pa.array([self.pack(f, columns[f][p]) for p in parts], pa.binary()) for f in self.fields})

    def _columns(self, group: pa.Table) -> dict[str, np.ndarray]:
        n = group["n"].to_pylist()
        return {f: np.concatenate([np.zeros(0, k), *(self.unpack(f, x, m, k) for x, m in zip(group[f].to_pylist(), n, strict=True))]) for f, k in self.fields.items()}

    def _onward(self, group: pa.Table) -> pa.Table:
        """A relay: rows of chunks for one coarse range become rows for its fine ranges. fine: the chunks of a row, sizes: their keys."""
        group = group.sort_by("chunk")
        ints = lambda c: [np.frombuffer(x, np.int32) for x in group[c].to_pylist()]
        fine, sizes = ints("fine"), ints("sizes")
        where, size = np.concatenate(fine), np.concatenate(sizes)
        source = np.repeat(group["chunk"].to_numpy(), [len(x) for x in fine])
        o = np.argsort(where, kind="stable")  # by fine range, then by chunk
        start = np.cumsum(size) - size
        place = np.repeat(start[o] - (np.cumsum(size[o]) - size[o]), size[o]) + np.arange(size.sum())
        columns = {f: x[place] for f, x in self._columns(group).items()}
        where, size, source = where[o], size[o], source[o]
        first = np.flatnonzero(np.r_[True, where[1:] != where[:-1]])
        stop = np.r_[first[1:], len(where)]
        at = np.r_[0, np.cumsum(size)]
        rows = list(zip(first.tolist(), stop.tolist(), strict=True))
        return pa.table({
            "range": pa.array(where[first], pa.int32()), "chunk": pa.array(np.full(len(rows), source[0] // self.by), pa.int32()), "n": pa.array([int(at[j] - at[i]) for i, j in rows], pa.int32()),
            "fine": pa.array([source[i:j].astype(np.int32).tobytes() for i, j in rows], pa.binary()), "sizes": pa.array([size[i:j].astype(np.int32).tobytes() for i, j in rows], pa.binary()),
        } | {f: pa.array([self.pack(f, x[at[i] : at[j]]) for i, j in rows], pa.binary()) for f, x in columns.items()})

    def _replied(self, group: pa.Table, reply: Callable) -> pa.Table:
        """What a range answers: reply(columns, chunk of each key) gives one value a key."""
        n = group["n"].to_numpy()
        if self.by:
            chunk = np.repeat(np.concatenate([np.frombuffer(x, np.int32) for x in group["fine"].to_pylist()]), np.concatenate([np.frombuffer(x, np.int32) for x in group["sizes"].to_pylist()]))
        else:
            chunk = np.repeat(group["chunk"].to_numpy(), n)
        out = np.asarray(reply(self._columns(group), chunk), self.reply)
        at = np.r_[0, np.cumsum(n)]
        return pa.table({"chunk": group["chunk"], "range": group["range"], "n": group["n"], "fine": group["fine"], "sizes": group["sizes"], "reply": pa.array([self.pack("reply", out[i:j]) for i, j in zip(at[:-1], at[1:], strict=True)], pa.binary())})

    def _back(self, group: pa.Table) -> pa.Table:
        """A relay: replies of one coarse range's fine ranges become rows for chunks."""
        group = group.sort_by("range")
        pieces: dict[int, list[np.ndarray]] = {}
        for fine, sizes, x, n in zip(group["fine"].to_pylist(), group["sizes"].to_pylist(), group["reply"].to_pylist(), group["n"].to_pylist(), strict=True):
            out, at = self.unpack("reply", x, n, self.reply), np.r_[0, np.cumsum(np.frombuffer(sizes, np.int32))]
            for k, c in enumerate(np.frombuffer(fine, np.int32).tolist()):
                pieces.setdefault(c, []).append(out[at[k] : at[k + 1]])
        whole = {c: np.concatenate(p) for c, p in pieces.items()}
        coarse = group["range"][0].as_py() // self.by
        return pa.table({"chunk": pa.array(list(whole), pa.int32()), "range": pa.array([coarse] * len(whole), pa.int32()), "n": pa.array([len(x) for x in whole.values()], pa.int32()), "reply": pa.array([self.pack("reply", x) for x in whole.values()], pa.binary())})

    def answered(self, asked: DataFrame, reply: Callable[[dict[str, np.ndarray], np.ndarray], np.ndarray]) -> DataFrame:
        """(chunk, range, n, reply) for what chunks asked."""
        me, by = self, self.by
        if by:
            asked = asked.groupBy(F.expr(f"chunk div {by}").alias("s"), "range").applyInArrow(lambda g: me._onward(g), self.schema)
        out = asked.groupBy("range").applyInArrow(lambda g: me._replied(g, reply), "chunk int, range int, n int, fine binary, sizes binary, reply binary")
        if by:
            return out.groupBy("chunk", F.expr(f"range div {by}").alias("c")).applyInArrow(lambda g: me._back(g), "chunk int, range int, n int, reply binary")
        return out.drop("fine", "sizes")

    def answers(self, group: pa.Table) -> np.ndarray:
        """A chunk's replies in the order of its sorted keys."""
        group = group.sort_by("range")
        return np.concatenate([np.zeros(0, self.reply), *(self.unpack("reply", x, n, self.reply) for x, n in zip(group["reply"].to_pylist(), group["n"].to_pylist(), strict=True))])
