"""Cross-entropy difference between a target and a background n-gram model.

Both are bigram models over one shared vocabulary, the words of the corpus, and are matched: the background's counts are scaled to the
target's size. With counts n, prior weight k and vocabulary size V,

    p(w | c) = (n(c, w) + k / V) / (n(c) + k)

so a token's loss is a term of the pair (c, w) and a term of the context c. A document's score is the mean over its tokens of
target loss minus background loss: the lower, the more it is like the target.

Counts cover the whole corpus and grow with it. Each chunk of documents asks for its distinct pairs and contexts once, compressed; a
range of keys sums what all chunks hold and answers with loss differences. A pair that every document has costs one entry a chunk.

Defined results: null texts and texts without words have 0 tokens and a null score. Words are lower-cased (A-Z); texts are taken whole. A
null doc_id is never in the target. Repeated rows count again and score alike. An empty target gives scores against a uniform model. Empty tables give
empty tables. V is a HyperLogLog count (2**14 registers, about 1 %): it only sets the prior.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._chunks import Messages, chunked, hop, in_order
from ._cut import BROADCAST_ROWS
from ._memory import thrifty
from ._text import U, blocks, buffer, mix, words

PRIOR = 8.0
_BEGIN, _PAIR, _CONTEXT = U(0x2545F4914F6CDD1D), U(0x9FB21C651E98DF25), U(0xD6E8FEB86659FD93)
_P = 14


def _registers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    top = np.zeros(1 << _P, np.int8)
    for b in batches:
        data, at = buffer(b.column(0))
        for i, j in blocks(at):
            h = words(data[at[i] : at[j]], at[i : j + 1] - at[i], True)[0]
            rest = (h << U(_P)) | U(1 << (_P - 1))
            zeros = 64 - np.frexp(rest.astype(np.float64))[1].astype(np.int64)
            np.maximum.at(top, (h >> U(64 - _P)).astype(np.int64), (zeros + 1).astype(np.int8))
    at = np.flatnonzero(top)
    yield pa.record_batch([pa.array(at, pa.int32()), pa.array(top[at], pa.int32())], ["i", "v"])


def vocabulary(docs: DataFrame, text: str = "text") -> int:
    """About how many distinct words the corpus has."""
    got = docs.select(F.col(text).cast("string").alias("t")).mapInArrow(_registers, "i int, v int").groupBy("i").agg(F.max("v").alias("v")).toPandas()  # 2**14 rows at most
    m, v = 1 << _P, got["v"].to_numpy(np.float64)
    empty = m - len(v)
    estimate = 0.7213 / (1 + 1.079 / m) * m * m / (np.exp2(-v).sum() + empty)
    return max(1, round(m * np.log(m / empty) if empty and estimate < 2.5 * m else estimate))


def pack(keys: np.ndarray) -> bytes:
    """Sorted 64-bit keys: steps of the upper halves by byte plane, then the lower halves; compressed."""
    step = np.diff((keys >> U(32)).astype(np.int64), prepend=0).astype("<u4")
    return pa.compress(np.ascontiguousarray(step.view(np.uint8).reshape(-1, 4).T).tobytes() + keys.astype("<u4").tobytes(), codec="zstd", asbytes=True)


def unpack(raw: bytes, n: int) -> np.ndarray:
    x = np.frombuffer(pa.decompress(raw, 8 * n, codec="zstd", asbytes=True), np.uint8)
    step = np.ascontiguousarray(x[: 4 * n].reshape(4, n).T).view("<u4").ravel()
    return np.cumsum(step.astype(U)) << U(32) | x[4 * n :].view("<u4").astype(U)


def _press(x: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes(), codec="zstd", asbytes=True)


def _release(raw: bytes, n: int, dtype) -> np.ndarray:
    k = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(pa.decompress(raw, n * k, codec="zstd", asbytes=True), np.uint8).reshape(k, n).T).view(dtype).ravel()


class _Chunk:
    def __init__(self, group: pa.Table):
        thrifty()
        self.docs = in_order(group)
        data, at = buffer(self.docs["text"])
        hs, ws, base = [np.zeros(0, U)], [np.zeros(1, np.int64)], 0
        for i, j in blocks(at):
            h, _, _, w = words(data[at[i] : at[j]], at[i : j + 1] - at[i], True)
            hs.append(h)
            ws.append(w[1:] + base)
            base += len(h)
        h, self.first = np.concatenate(hs), np.concatenate(ws)
        before = np.r_[_BEGIN, h[:-1]][: len(h)]
        before[self.first[:-1][np.diff(self.first) > 0]] = _BEGIN
        self.keys = np.concatenate([mix(before * _PAIR + h) | U(1), mix(before * _CONTEXT) & ~U(1)])
        self.target = np.tile(np.repeat(self.docs["target"].to_numpy().astype(bool), np.diff(self.first)), 2)


def _packed(name: str, x: np.ndarray) -> bytes:
    return pack(x) if name == "keys" else _press(np.ascontiguousarray(x))


def _unpacked(name: str, x: bytes, n: int, kind: np.dtype) -> np.ndarray:
    return unpack(x, n) if name == "keys" else _release(x, n, kind)


def _ask(group: pa.Table, to: Messages) -> pa.Table:
    c = _Chunk(group)
    keys, count = np.unique(c.keys, return_counts=True)
    inside, times = np.unique(c.keys[c.target], return_counts=True)
    target = np.zeros(len(keys), np.uint32)
    target[np.searchsorted(keys, inside)] = times
    return to.ask(group["chunk"][0].as_py(), keys, {"keys": keys, "counts": count.astype(np.uint32), "target": target})


def _reply(asked: dict[str, np.ndarray], scale: float, vocabulary: int, prior: float) -> np.ndarray:
    """For each key: the pair's or the context's part of target loss minus background loss."""
    u, of = np.unique(asked["keys"], return_inverse=True)
    all_, target = (np.bincount(of, asked[c], len(u)) for c in ("counts", "target"))
    more = np.where(u & U(1) == 1, prior / vocabulary, prior)
    term = np.log(scale * all_ + more) - np.log(target + more)
    return np.where(u & U(1) == 1, term, -term).astype(np.float32)[of]


_OUT = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("score", pa.float64())])


def _scores(group: pa.Table, replies: pa.Table, to: Messages) -> pa.Table:
    if not len(group):
        return _OUT.empty_table()
    c = _Chunk(group)
    term = to.answers(replies).astype(np.float64)
    _, of = np.unique(c.keys, return_inverse=True)
    each = term[of]
    half = len(each) // 2
    total = np.r_[0, np.cumsum(each[:half] + each[half:])]
    n = np.diff(c.first)
    s = (total[c.first[1:]] - total[c.first[:-1]]) / np.maximum(n, 1)
    return pa.table([c.docs["doc_id"].combine_chunks(), pa.array(n, pa.int64()), pa.array(s, mask=n == 0)], schema=_OUT)


def score(docs: DataFrame, target: DataFrame, prior: float = PRIOR, text: str = "text") -> DataFrame:
    """doc_id, n_tokens and score of each row; target: the doc_id of the documents that are the target corpus."""
    base, n = chunked(docs, text=text)
    ids = target.select(F.col("doc_id").cast("long").alias("doc_id")).dropna().distinct()
    sizes = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(F.col(text).cast("string")).cast("double").alias("z"))
    everything, inside = (float(x.agg(F.sum("z")).first()[0] or 0) for x in (sizes, sizes.join(ids, "doc_id", "left_semi")))
    v, scale = vocabulary(docs, text), inside / everything if everything else 1.0
    marks = ids.withColumn("target", F.lit(True))
    if ids.count() <= BROADCAST_ROWS:
        rows = base.join(F.broadcast(marks), "doc_id", "left")
    else:  # rows without a doc_id need no partner, and would meet in one task
        rows = base.where("doc_id is not null").join(marks, "doc_id", "left").unionByName(base.where("doc_id is null").withColumn("target", F.lit(False)))
    rows = rows.withColumn("target", F.coalesce("target", F.lit(False)))
    to = Messages(n, hop(n), {"keys": np.dtype("<u8"), "counts": np.dtype("<u4"), "target": np.dtype("<u4")}, np.dtype("<f4"), _packed, _unpacked)
    asked = rows.groupBy("chunk").applyInArrow(lambda g: _ask(g, to), to.schema)
    replies = to.answered(asked, lambda asked, chunk: _reply(asked, scale, v, prior))
    return rows.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(lambda g, r: _scores(g, r, to), "doc_id long, n_tokens long, score double")
