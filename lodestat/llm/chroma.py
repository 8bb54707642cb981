"""Chroma audio fingerprints of media columns, and their alignment.

A recording is 16-bit mono PCM. Overlapping frames are folded into energies of the 12 pitch classes. Over the image of frames by classes an
integral image is kept, so that the sum of any rectangle costs four reads; 16 rectangle filters compare two areas each, and each
comparison gives 2 bits (Gray coded), so every frame position gives one packed 32-bit integer.

Two recordings are aligned by a histogram of offsets. What votes are pairs of integers ``GAP`` positions apart, whose filters share no frame: one
integer spans a second of sound and is equal by chance in large tables, two that don't overlap hardly ever are, and a noisy copy still has many. A run of
equal pairs (a held sound) votes once, at its start, and silence does not vote. The offsets with most votes are then judged by the share of differing bits
over the whole overlap.

Recordings with equal fingerprints are one class with its smallest id; copies are not multiplied. Each query gets one row, however many recordings match it.

Defined results: null or too short recordings have an empty fingerprint and match nothing; an odd last byte is ignored; long recordings are read whole; recordings
that are silent throughout have a fingerprint and match their copies only. Where the shorter of two fingerprints has no two positions ``GAP`` apart, its first and last
integer make its pair, and the longer one's pairs of that gap are asked. Ties between offsets go to fewer wrong bits, more votes, the smallest
distance, then the smaller offset; between matches to the smaller id. Rows with one id are rows of their own, and a null id takes part as a member only. Empty tables give
empty tables. Other columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._cut import BROADCAST_ROWS
from ._memory import thrifty

RATE, FRAME, HOP = 4000, 1024, 250
LOWEST, HIGHEST = 60.0, 1600.0
#: Comparisons of two areas, log((1 + a) / (1 + b)), are cut at these values into 4 levels.
LEVELS = (-0.12, 0.0, 0.12)
GRAY = np.array([0, 1, 3, 2], np.uint32)


def filters(n: int = 16, classes: int = 12) -> list[tuple[int, int, int, int]]:
    """(kind, first class, classes, frames): kinds, heights and widths cycle so that all parts of the image are compared."""
    return [(i % 4, (5 * i) % (classes - 3), 3 + i % 2 * 2 if (5 * i) % (classes - 3) + 5 <= classes else 3, (4, 8, 12, 16)[(i // 4 + i) % 4]) for i in range(n)]


FILTERS = filters()
WIDTH = max(f[3] for f in FILTERS)


@functools.lru_cache(8)
def _folding(rate: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window, bins in use, bins by pitch class)"""
    f = np.fft.rfftfreq(FRAME, 1 / rate)
    use = np.flatnonzero((f >= LOWEST) & (f <= HIGHEST))
    fold = np.zeros((len(use), 12))
    fold[np.arange(len(use)), np.round(12 * np.log2(f[use] / 440.0)).astype(int) % 12] = 1
    return np.hanning(FRAME), use, fold


def chroma(samples: np.ndarray, rate: int = RATE) -> np.ndarray:
    """Frames by 12 pitch classes; each frame has unit length unless it is silent."""
    n = (len(samples) - FRAME) // HOP + 1
    if n < 1:
        return np.zeros((0, 12))
    window, use, fold = _folding(rate)
    out = np.empty((n, 12))
    for lo in range(0, n, 1024):  # long recordings a part at a time
        hi = min(lo + 1024, n)
        frames = np.lib.stride_tricks.as_strided(samples[lo * HOP :], (hi - lo, FRAME), (samples.strides[0] * HOP, samples.strides[0]))
        z = np.fft.rfft(frames * window, axis=1)[:, use]
        out[lo:hi] = (z.real * z.real + z.imag * z.imag) @ fold
    size = np.sqrt((out * out).sum(1, keepdims=True))
    return np.where(size > 1e-3, out / np.maximum(size, 1e-3), 0.0)


def fingerprint(image: np.ndarray) -> np.ndarray:
    """Packed integers of a chroma image, one for each position of the widest filter."""
    n = len(image) - WIDTH + 1
    if n < 1:
        return np.zeros(0, np.int32)
    total = np.zeros((len(image) + 1, 13))
    total[1:, 1:] = image.cumsum(0).cumsum(1)
    t = np.arange(n)

    def area(t0, t1, c0: int, c1: int) -> np.ndarray:
        return total[t + t1, c1] - total[t + t0, c1] - total[t + t1, c0] + total[t + t0, c0]

    out = np.zeros(n, np.uint32)
    for kind, c, h, w in FILTERS:
        if kind == 0:  # level against nothing
            a, b = area(0, w, c, c + h), np.full(n, w * h / 12.0)
        elif kind == 1:  # lower classes against upper
            a, b = area(0, w, c, c + h // 2), area(0, w, c + h // 2, c + h // 2 * 2)
        elif kind == 2:  # earlier against later
            a, b = area(0, w // 2, c, c + h), area(w // 2, w, c, c + h)
        else:  # one diagonal of quarters against the other
            a = area(0, w // 2, c, c + h // 2) + area(w // 2, w, c + h // 2, c + h // 2 * 2)
            b = area(0, w // 2, c + h // 2, c + h // 2 * 2) + area(w // 2, w, c, c + h // 2)
        level = np.searchsorted(LEVELS, np.log((1 + np.maximum(a, 0)) / (1 + np.maximum(b, 0))), "right")
        out = out << np.uint32(2) | GRAY[level]
    return out.view(np.int32)


def of_pcm(raw: bytes | None, rate: int = RATE) -> np.ndarray:
    if not raw:
        return np.zeros(0, np.int32)
    samples = np.frombuffer(raw[: len(raw) // 2 * 2], "<i2").astype(np.float64) / 32768
    return fingerprint(chroma(samples, rate))


def fingerprints(media: DataFrame, id: str = "id", audio: str = "audio", rate: int = RATE, vectors: bool = False, skip: int = 0) -> DataFrame:
    """id, fingerprint (array<int>) and class (32 hex digits of equal fingerprints) of each row.

    vectors: the column holds vectors, each rendered as it is read, so that no batch of recordings is in memory. skip: samples that are left out at the start.
    """
    pcm = (lambda x: None if x is None else render(np.array(x, np.float64))) if vectors else (lambda x: x)

    def of(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        thrifty()
        for whole in it:
            for lo in range(0, len(whole), 512):
                b = whole.slice(lo, 512)
                prints = [of_pcm((pcm(x) or b"")[2 * skip :], rate) for x in b.column(1).to_pylist()]
                at = np.r_[0, np.cumsum([len(x) for x in prints])]
                flat = np.concatenate([np.zeros(0, np.int32), *prints])
                names = pa.array([hashlib.blake2b(x, digest_size=16).hexdigest() for x in prints], pa.string())
                yield pa.record_batch([b.column(0), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat, pa.int32())), names], ["id", "fingerprint", "class"])

    return media.select(F.col(id).cast("long").alias("id"), F.col(audio).cast("array<double>" if vectors else "binary").alias("a")).mapInArrow(of, "id long, fingerprint array<int>, class string")


#: Positions between the two integers of a vote: no frame is under the filters of both.
GAP = WIDTH
#: What every position of silence gives.
SILENCE = int(fingerprint(np.zeros((WIDTH, 12)))[0])


def pairs(f: np.ndarray, gap: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, 64-bit pair) of a fingerprint's votes: the first of each run of equal pairs, silence left out."""
    if len(f) <= gap:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    x = f.astype(np.int64)
    v = x[: len(f) - gap] << 32 | (x[gap:] & 0xFFFFFFFF)
    new = np.r_[True, v[1:] != v[:-1]] & ~((x[: len(f) - gap] == SILENCE) & (x[gap:] == SILENCE))
    at = np.flatnonzero(new)
    return at, v[at]


_VOTES = "who long, size int, votes int, gap int, at int, v long"


def _voting(prints: DataFrame, gaps: list[int]) -> DataFrame:
    """(who, size, votes, gap, at, v) of prints (who, f): for each gap the pairs of all fingerprints that are long enough."""

    def of(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        thrifty()
        for whole in it:
            for lo in range(0, len(whole), 2048):
                b = whole.slice(lo, 2048)
                out = []
                for who, f in zip(b.column(0).to_numpy(), b.column(1), strict=True):
                    f = f.values.to_numpy()
                    for g in gaps:
                        if g < len(f):
                            at, v = pairs(f, g)
                            out.append((np.full(len(at), who), np.full(len(at), len(f), np.int32), np.full(len(at), len(at), np.int32), np.full(len(at), g, np.int32), at.astype(np.int32), v))
                if out:
                    yield pa.record_batch([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["who", "size", "votes", "gap", "at", "v"])

    return prints.select("who", "f").mapInArrow(of, _VOTES)


def align(prints: DataFrame, queries: DataFrame, votes: int = 2, most_errors: float = 0.25, overlap: int = 16, among: bool = True, offsets: int = 3) -> DataFrame:
    """One row for each query with an id: query_id, n_matches, match_id, copies, offset, votes, bit_error_rate.

    prints: fingerprints(); queries: others, or (among) rows of prints, whose own class is a match only if it has other members. n_matches: classes of
    recordings that align; the other columns tell of the best one (null without any): fewest wrong bits, then most votes, then smallest id. match_id is the
    smallest id of a class, copies its size; offset is the position in the match less that in the query.

    Where two fingerprints have fewer pairs than ``votes``, or positions than ``overlap``, to offer, all that the shorter has are asked for. The ``offsets``
    offsets with most votes are judged.
    """
    full = F.size("fingerprint") > 0
    heads = prints.where(full).groupBy("class").agg(F.min("id").alias("match_id"), F.count("*").alias("copies"), F.first("fingerprint").alias("f")).withColumn("who", F.xxhash64("class"))
    asked = queries.where("id is not null").select(F.col("id").alias("query_id"), "class")
    asking = queries.where(full & F.col("id").isNotNull()).groupBy("class").agg(F.first("fingerprint").alias("f")).withColumn("who", F.xxhash64("class"))
    gap = lambda n: F.least(F.lit(GAP), n - 1)
    gaps = sorted({r[0] for t in (heads, asking) for r in t.select(gap(F.size("f"))).distinct().collect()})  # GAP + 1 values at most
    ours = _voting(asking, gaps).select(F.col("who").alias("q"), F.col("size").alias("m"), F.col("votes").alias("a"), "gap", F.col("at").alias("i"), "v")
    ours = F.broadcast(ours) if ours.count() <= BROADCAST_ROWS else ours
    theirs = _voting(heads, gaps).select(F.col("who").alias("r"), F.col("size").alias("k"), F.col("votes").alias("b"), "gap", F.col("at").alias("j"), "v")
    met = theirs.join(ours, ["gap", "v"]).where(F.col("gap") == F.least(gap(F.col("m")), gap(F.col("k")))).where("q <> r")
    histogram = met.groupBy("q", "r", (F.col("j") - F.col("i")).alias("offset")).agg(F.count("*").alias("votes"), F.min(F.least("a", "b")).alias("most"))
    histogram = histogram.where(F.col("votes") >= F.least(F.lit(votes), "most"))
    best = Window.partitionBy("q", "r").orderBy(F.desc("votes"), F.abs("offset"), "offset")
    chosen = histogram.withColumn("n", F.row_number().over(best)).where(F.col("n") <= offsets).select("q", "r", "offset", "votes")
    x = asking.select(F.col("who").alias("q"), F.col("f").alias("x"))
    y = heads.select(F.col("who").alias("r"), F.col("f").alias("y"), "match_id", "copies")
    both = chosen.join(x, "q").join(y, "r")
    start, stop = F.greatest(F.lit(0), -F.col("offset")), F.least(F.size("x"), F.size("y") - F.col("offset"))
    part = lambda c, at: F.slice(c, at + 1, F.col("n"))
    both = both.withColumn("s", start).withColumn("n", stop - start).where(F.col("n") >= F.least(F.lit(overlap), F.size("x"), F.size("y")))
    errors = F.aggregate(F.zip_with(part("x", F.col("s")), part("y", F.col("s") + F.col("offset")), lambda a, b: F.bit_count(a.bitwiseXOR(b).cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))), F.lit(0), lambda t, e: t + e)
    judged = both.withColumn("rate", errors / (F.col("n") * 32.0)).where(F.col("rate") <= most_errors)
    order = lambda rate, n, at: F.struct(rate.alias("rate"), (-n).alias("fewer"), F.abs(at).alias("far"), at.alias("offset"))
    pair = judged.groupBy("q", "r").agg(F.min(order(F.col("rate"), F.col("votes"), F.col("offset"))).alias("b"), F.min("match_id").alias("match_id"), F.min("copies").alias("copies"))
    own = asking.select(F.col("who").alias("q")).join(heads.select(F.col("who").alias("q"), "match_id", "copies", F.size("f").alias("n")), "q").where(F.col("copies") > int(among))
    own = own.select("q", F.col("q").alias("r"), order(F.lit(0.0), F.col("n").cast("long"), F.lit(0)).alias("b"), "match_id", "copies")
    found = pair.unionByName(own).groupBy("q").agg(
        F.count("*").alias("n_matches"),
        F.min(F.struct("b.rate", "b.fewer", F.col("match_id").isNull().alias("none"), "match_id", "copies", "b.offset")).alias("b"),
    )
    out = asked.withColumn("q", F.xxhash64("class")).join(found, "q", "left")
    return out.select(
        "query_id", F.coalesce("n_matches", F.lit(0)).cast("long").alias("n_matches"), F.col("b.match_id").alias("match_id"), F.col("b.copies").alias("copies"),
        F.col("b.offset").alias("offset"), (-F.col("b.fewer")).alias("votes"), F.col("b.rate").alias("bit_error_rate"),
    )


NOTE = 500


def render(values: np.ndarray) -> bytes:
    """A tune as PCM: each of all values gives a note (its tone by size, in steps of three semitones) of 1/8 second with one overtone."""
    v = np.nan_to_num(np.asarray(values, np.float64))
    if not len(v) or not np.abs(v).max() > 0:
        return b""
    tone = np.clip(12 + 3 * np.round(2 * v / np.sqrt((v * v).mean())), 0, 36)
    f = np.repeat(110.0 * 2 ** (tone / 12), NOTE)
    phase = 2 * np.pi * np.cumsum(f) / RATE
    return (9000 * np.sin(phase) + 3000 * np.sin(2 * phase)).astype("<i2").tobytes()


def rendered(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """id, audio: a recording for each vector, for tables without a media column."""

    def of(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            yield pa.record_batch([b.column(0), pa.array([None if x is None else render(np.array(x, np.float64)) for x in b.column(1).to_pylist()], pa.binary())], ["id", "audio"])

    return vectors.select(F.col(id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).mapInArrow(of, "id long, audio binary")
