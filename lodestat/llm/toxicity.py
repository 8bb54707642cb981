"""Toxicity by a classifier chain of linear models.

Categories are predicted one after the other; each model sees the words of the text and the probabilities of the
categories before it. While training, those probabilities are out-of-fold predictions, so a later model learns from what an earlier
one says of texts that it has not seen. Models are logistic regressions on the presence of words (whole 64-bit fingerprints), with
the words chosen by how far their log odds stand from chance.

Training takes at most ``sample`` labelled rows (those with the smallest hash of doc_id): their distinct words go to the
driver, never more. Of the words that stand out from chance the FEATURES farthest out become a model's features; all others have no weight. Scoring reads every text whole and has no shuffle.

Defined results: null, empty and blank texts have no words and get the models' base rates; texts that are very long count each
word once. Rows with a null label in any category are not trained on; of labels repeated for a doc_id the largest count; of texts repeated for one
the text with the smallest hash is trained on. With no usable
labels, or one class only, a category's probability is its smoothed base rate and nothing is rejected. Repeated rows
score alike; a null doc_id is scored. Empty tables give empty tables. Other columns are not read.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import SPACES, U, blocks, buffer, separators, words

#: First bits of a fingerprint by which scoring passes over words that are not chosen.
BITS = 18
SAMPLE, FOLDS, FEATURES, Z, L2 = 8000, 5, 256, 4.0, 1.0
_APART = separators(SPACES + string.punctuation.encode())


def presence(column, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) pairs, each once, sorted; features are whole 64-bit fingerprints of words; wanted: those that count, sorted."""
    data, at = buffer(column)
    rows, ids = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    if wanted is not None:  # most words are passed over by their first bits; the others are compared whole
        likely = np.zeros(1 << BITS, bool)
        likely[wanted.view(U) >> U(64 - BITS)] = True
    for i, j in blocks(at):
        h, _, _, w = words(data[at[i] : at[j]], at[i : j + 1] - at[i], True, _APART)
        r = np.repeat(np.arange(i, j), np.diff(w))
        if wanted is not None:
            keep = np.flatnonzero(likely[h >> U(64 - BITS)])
            keep = keep[_places(wanted, h[keep].view(np.int64)) >= 0]
            h, r = h[keep], r[keep]
        f = h.view(np.int64)
        o = np.lexsort((f, r))
        f, r = f[o], r[o]
        new = np.ones(len(f), bool)
        new[1:] = (f[1:] != f[:-1]) | (r[1:] != r[:-1])
        rows.append(r[new])
        ids.append(f[new])
    return np.concatenate(rows), np.concatenate(ids)


def _places(keys: np.ndarray, feature: np.ndarray) -> np.ndarray:
    """Where each feature stands in sorted keys, -1 for those that are not there."""
    if not len(keys):
        return np.full(len(feature), -1)
    at = np.minimum(np.searchsorted(keys, feature), len(keys) - 1)
    return np.where(keys[at] == feature, at, -1)


@dataclass
class Model:
    keys: np.ndarray  # the chosen features, sorted
    weights: np.ndarray  # of those
    bias: float
    chain: np.ndarray  # of earlier categories' probabilities

    def __call__(self, row: np.ndarray, feature: np.ndarray, n: int, earlier: np.ndarray) -> np.ndarray:
        at = _places(self.keys, feature)
        z = np.bincount(row[at >= 0], self.weights[at[at >= 0]], n) + self.bias + earlier @ self.chain
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(row: np.ndarray, feature: np.ndarray, earlier: np.ndarray, y: np.ndarray) -> Model:
    """L2 logistic regression by Newton steps on the chosen features and the earlier probabilities."""
    n, k = len(y), earlier.shape[1]
    rate = (y.sum() + 0.5) / (n + 1)
    if n == 0 or y.min() == y.max():
        return Model(np.zeros(0, np.int64), np.zeros(0), float(np.log(rate / (1 - rate))), np.zeros(k))
    keys, feature = np.unique(feature, return_inverse=True)
    size = len(keys)
    df = np.bincount(feature, minlength=size)
    pos = np.bincount(feature, y[row], size)
    spread = np.sqrt(df * rate * (1 - rate) * np.maximum(1 - df / n, 0)) + 0.5
    z = np.abs(pos - df * rate) / spread
    chosen = np.flatnonzero((z >= Z) & (df >= 3))
    chosen = chosen[np.argsort(-z[chosen], kind="stable")[:FEATURES]]
    chosen.sort()
    place = np.full(size, -1)
    place[chosen] = np.arange(len(chosen))
    keep = place[feature] >= 0
    m = len(chosen)
    x = np.zeros((n, m + k + 1))
    x[row[keep], place[feature[keep]]] = 1
    x[:, m : m + k] = earlier
    x[:, -1] = 1
    b, ridge = np.zeros(m + k + 1), np.r_[np.full(m + k, L2), 1e-6]
    b[-1] = np.log(rate / (1 - rate))
    for _ in range(10):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -40, 40)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(ridge), x.T @ (y - p) - ridge * b)
        b += step
        if np.abs(step).max() < 1e-3:
            break
    return Model(keys[chosen], b[:m], float(b[-1]), b[m : m + k])


@dataclass
class Chain:
    names: list[str]
    models: list[Model]
    thresholds: list[float]

    def __call__(self, row, feature, n: int) -> np.ndarray:
        p = np.zeros((n, 0))
        for m in self.models:
            p = np.c_[p, m(row, feature, n, p)]
        return p


def fit_chain(names: list[str], row: np.ndarray, feature: np.ndarray, y: np.ndarray, fold: np.ndarray) -> Chain:
    """y: a column of 0 and 1 for each category; fold: of each row."""
    n = len(y)
    earlier, models, thresholds = np.zeros((n, 0)), [], []
    for c in range(len(names)):
        out = np.full(n, (y[:, c].sum() + 0.5) / (n + 1))
        for k in range(FOLDS):
            test = fold == k
            if test.any() and not test.all():
                at = np.cumsum(~test) - 1
                mine = ~test[row]
                m = fit(at[row[mine]], feature[mine], earlier[~test], y[~test, c])
                out[test] = m(row, feature, n, earlier)[test]
        models.append(fit(row, feature, earlier, y[:, c]))
        thresholds.append(best_threshold(out, y[:, c]))
        earlier = np.c_[earlier, out]
    return Chain(names, models, thresholds)


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The probability at which F1 of out-of-fold predictions is largest, in the middle of its gap.

    Only cuts where at least half of what is rejected is positive count; without any (or without positives) it is 2: nothing is rejected.
    """
    if not len(y) or not y.any() or y.all():
        return 2.0
    o = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[o])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    f1[:-1][p[o][:-1] == p[o][1:]] = 0
    f1[2 * hits < np.arange(1, len(y) + 1)] = 0
    if not f1.any():
        return 2.0
    i = int(np.argmax(f1))
    return float((p[o][i] + (p[o][i + 1] if i + 1 < len(y) else 0)) / 2)


def train(docs: DataFrame, labels: DataFrame, categories: dict[str, tuple[str, int]], sample: int = SAMPLE, text: str = "text") -> Chain:
    """categories: name -> (column of labels, value that means yes), in the order of the chain."""
    ok = labels.select(F.col("doc_id").cast("long").alias("doc_id"), *[(F.col(c) == v).cast("int").alias(f"y{i}") for i, (c, v) in enumerate(categories.values())]).dropna()
    ok = ok.groupBy("doc_id").agg(*[F.max(f"y{i}").alias(f"y{i}") for i in range(len(categories))])
    ok = ok.orderBy(F.xxhash64("doc_id", F.lit(5)), "doc_id").limit(sample)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("t")).join(F.broadcast(ok), "doc_id")  # at most ``sample`` labels
    rows = rows.groupBy("doc_id", *[f"y{i}" for i in range(len(categories))]).agg(F.min_by("t", F.struct(F.xxhash64("t"), "t")).alias("t"))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            r, f = presence(b.column(1))
            at = np.r_[0, np.cumsum(np.bincount(r, minlength=len(b)))]
            yield pa.record_batch([b.column(0), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(f, pa.int64())), *b.columns[2:]], ["doc_id", "f", *b.schema.names[2:]])

    ys = [f"y{i}" for i in range(len(categories))]
    got = rows.select("doc_id", "t", *ys).mapInArrow(of, "doc_id long, f array<long>, " + ", ".join(f"{y} int" for y in ys)).toArrow().sort_by("doc_id")
    lists = got["f"].combine_chunks()
    size, feature = (np.asarray(lists.value_lengths()).astype(np.int64), lists.flatten().to_numpy()) if len(got) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    y = np.stack([got[c].to_numpy() for c in ys], 1).astype(float) if len(got) else np.zeros((0, len(ys)))
    fold = (got["doc_id"].to_numpy().view(np.uint64) * U(0x9E3779B97F4A7C15) >> U(33)) % U(FOLDS) if len(got) else np.zeros(0)
    return fit_chain(list(categories), np.repeat(np.arange(len(got)), size), feature, y, fold)


def _scored(docs: DataFrame, chain: Chain, text: str) -> DataFrame:
    """docs with a struct column __scores of probabilities."""
    wanted = np.unique(np.concatenate([m.keys for m in chain.models]))
    spec = "struct<" + ",".join(f"p_{n}:double" for n in chain.names) + ">"

    @F.pandas_udf(spec)
    def of(s):
        import pandas as pd

        r, f = presence(pa.array(s, pa.string()), wanted)
        return pd.DataFrame(chain(r, f, len(s)), columns=[f"p_{n}" for n in chain.names])

    return docs.withColumn("__scores", of(F.col(text).cast("string")))


def score(docs: DataFrame, chain: Chain, text: str = "text") -> DataFrame:
    """docs with, for each category, p_<name> and the decision is_<name>; columns of these names are replaced."""
    out = _scored(docs, chain, text)
    for n, t in zip(chain.names, chain.thresholds, strict=True):
        out = out.withColumn(f"p_{n}", F.col(f"__scores.p_{n}")).withColumn(f"is_{n}", F.col(f"__scores.p_{n}") >= t)
    return out.drop("__scores")


def without(docs: DataFrame, chain: Chain, category: str, text: str = "text") -> DataFrame:
    """docs with the same columns, but for the rows that category rejects."""
    limit = chain.thresholds[chain.names.index(category)]
    return _scored(docs, chain, text).where(F.col(f"__scores.p_{category}") < limit).drop("__scores")


#: The chain of the queries and of the pipeline: low quality first, as junk shares words with abuse; then toxicity.
CATEGORIES = {"low_quality": ("quality", 0), "toxic": ("toxic", 1)}
