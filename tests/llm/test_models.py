import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestat.llm import chroma, cross_entropy, nearest, sharding, toxicity

from .conftest import DOC, rows


@pytest.mark.parametrize("direct", [4096, 3])
def test_cross_entropy(docs, none, pairs, direct, monkeypatch):
    from lodestat.llm import _chunks

    monkeypatch.setattr(_chunks, "DIRECT", direct)  # with 3, messages take two hops
    target = docs.where("doc_id % 2 = 0").select("doc_id")
    got = Counter((r.doc_id, r.n_tokens, None if r.score is None else round(r.score, 3)) for r in cross_entropy.score(docs, target).collect())
    everything, inside, size = Counter(), Counter(), [0, 0]
    split = [(i, "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode().split(), i is not None and i % 2 == 0, len((t or "").encode())) for i, t in pairs]
    for _, w, t, n in split:
        size[0] += n
        size[1] += n * t
        for c, x in zip([None, *w], w):
            for counts in (everything, inside)[: 1 + t]:
                counts[c, x] += 1
                counts[c] += 1
    v, k, s = cross_entropy.vocabulary(docs), cross_entropy.PRIOR, size[1] / size[0]
    assert v == pytest.approx(len({x for _, w, _, _ in split for x in w}), rel=0.05)
    want = Counter()
    for i, w, _, _ in split:
        total = sum(math.log((s * everything[c, x] + k / v) / (s * everything[c] + k)) - math.log((inside[c, x] + k / v) / (inside[c] + k)) for c, x in zip([None, *w], w))
        want[i, len(w), round(total / len(w), 3) if w else None] += 1
    assert all(any(abs((a[2] or 0) - (b[2] or 0)) < 2e-3 and a[:2] == b[:2] for b in want) for a in got) and sum(got.values()) == len(pairs)
    assert cross_entropy.score(none, none.select("doc_id")).count() == 0
    assert cross_entropy.score(docs, none.select("doc_id")).where("n_tokens = 0 and score is not null").count() == 0


def test_packed_keys():
    k = np.unique(np.random.default_rng(0).integers(0, 1 << 63, 5000).astype(np.uint64) * np.uint64(2))
    assert (cross_entropy.unpack(cross_entropy.pack(k), len(k)) == k).all()


@pytest.mark.parametrize("shards", [24, 5, 1])
def test_shards(docs, spark, pairs, shards):
    got = sharding.shard(docs, shards).toPandas()
    assert len(got) == len(pairs) and got["shard"].between(0, shards - 1).all()
    for _, g in got.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    many = spark.createDataFrame(rows([(i, "x" * (i * 7919 % 1000)) for i in range(3000)] + [(5000 + i, "copy of one text") for i in range(1500)]), DOC)
    total = sharding.shard(many, shards).groupby("shard").agg(F.sum("size").alias("b")).toPandas()["b"]
    assert len(total) == shards and total.max() - total.min() < 0.02 * total.mean() + 2100


def test_shards_keep_copies_together_and_take_empty_tables(spark, none):
    docs = spark.createDataFrame(rows([(i, f"text {i % 700} " * (1 + i % 5)) for i in range(7000)]), DOC)
    s = sharding.shard(docs, 4)
    assert s.groupBy("text_crc32", "size").agg(F.countDistinct("shard").alias("n")).where("n > 1").count() == 0
    assert sharding.shard(none, 24).count() == 0


@pytest.fixture(scope="module")
def vectors(spark):
    r = np.random.default_rng(0)
    centres = r.normal(size=(12, 16)) * 2
    x = [(int(i), [float(v) for v in centres[i % 12] + r.normal(size=16) * 0.5]) for i in range(1200)]
    x += [(2000 + i, x[7][1]) for i in range(60)]  # copies
    x += [(3000, None), (3001, []), (3002, [0.0] * 16), (3003, [float("nan")] * 16), (3004, [1.0] * 15), (3005, [None] + [1.0] * 15), (3100, [float("inf")] * 16), (None, [1.0] * 16)]
    return x, spark.createDataFrame([(a, b, 1, "c") for a, b in x], "vec_id long, embedding array<double>, label int, cell string").repartition(3)


@pytest.mark.parametrize("block,group", [(4096, 20_000), (100, 3)])
def test_nearest_recall_and_scores(vectors, monkeypatch, block, group):
    x, df = vectors
    monkeypatch.setattr(nearest, "BLOCK", block)
    monkeypatch.setattr(nearest, "GROUP", group)
    good = [(i, np.array(v)) for i, v in x if i is not None and i < 3000]
    ids, m = np.array([i for i, _ in good]), np.stack([v for _, v in good])
    got = {}
    for r in nearest.nearest(df, df.where("vec_id % 100 = 0")).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    queries = [i for i in ids if i % 100 == 0]
    assert set(got) == set(queries)
    hit = 0
    for q in queries:
        d = np.sqrt(((m - m[ids == q][0]) ** 2).sum(1))
        d[ids == q] = np.inf
        best = np.lexsort((ids, d))[:10]
        assert sorted(got[q]) == list(range(1, 11))
        hit += len({v for v, _ in got[q].values()} & set(ids[best].tolist()))
        for v, s in got[q].values():
            assert s == pytest.approx(d[ids == v][0], abs=1e-12)
    assert hit / (10 * len(queries)) >= 0.9
    assert [got[2000][k][0] for k in range(1, 11)] == [7, *range(2001, 2010)]


def test_nearest_small_and_empty(spark, vectors):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in nearest.nearest(few, few.where("vec_id = 0")).orderBy("rank").collect()] == [(0, 1, 1, math.sqrt(2)), (0, 2, 2, math.sqrt(2))]
    assert nearest.nearest(few.limit(0), few.limit(0)).count() == 0
    assert nearest.chi2_cdf(nearest.stop_ratio(0.9, 8), 8) == pytest.approx(0.9)


def test_toxicity_chain_on_held_out_rows(spark, docs, none, labels):
    r = np.random.default_rng(0)
    vocabulary = [f"w{i}" for i in range(800)]
    data, marks = [], []
    for i in range(1200):
        w = list(r.choice(vocabulary, r.integers(5, 80)))
        toxic = i % 8 == 0
        if toxic:
            w.insert(int(r.integers(0, len(w))), str(r.choice(["vile!", "Rotten", "foul,"])))
        data.append((i, " ".join(w)))
        if i < 700:
            marks.append((i, int(r.random() < 0.7), int(toxic)))
    d = spark.createDataFrame(rows(data), DOC)
    chain = toxicity.train(d, spark.createDataFrame(marks, "doc_id long, quality int, toxic int"), toxicity.CATEGORIES)
    got = toxicity.score(d, chain).where("doc_id >= 700").toPandas()
    wrong = (got["is_toxic"] != (got["doc_id"] % 8 == 0)).sum()
    assert wrong <= 5
    kept = toxicity.without(d, chain, "toxic")
    assert kept.columns == d.columns and 0 <= kept.count() - 1050 <= 10
    odd = toxicity.score(docs, toxicity.train(docs, labels, toxicity.CATEGORIES))
    assert odd.count() == docs.count() and odd.where("p_toxic is null").count() == 0
    nothing = toxicity.train(none, labels.limit(0), toxicity.CATEGORIES)
    assert toxicity.without(docs, nothing, "toxic").count() == docs.count() and toxicity.score(none, nothing).count() == 0


def test_words_that_share_first_bits_are_not_toxic():
    vocabulary = pa.array([f"x{i}" for i in range(1 << 20)])
    h = toxicity.words(*toxicity.buffer(vocabulary), True, toxicity._APART)[0] >> np.uint64(46)
    vile = toxicity.words(*toxicity.buffer(pa.array(["vile"])), True, toxicity._APART)[0] >> np.uint64(46)
    other, unlike = f"x{np.flatnonzero(h == vile)[0]}", f"x{np.flatnonzero(h != vile)[0]}"
    y = np.arange(400) % 4 == 0
    row, feature = toxicity.presence(pa.array([f"w{i % 7} w{i % 11} {'vile' if t else ''}" for i, t in enumerate(y)]))
    chain = toxicity.fit_chain(["toxic"], row, feature, y[:, None].astype(float), np.arange(400) // 4 % 5)
    for wanted in (None, np.sort(chain.models[0].keys)):
        p = chain(*toxicity.presence(pa.array([other, unlike, "vile vile", None]), wanted), 4)[:, 0]
        assert p[0] == p[1] == p[3] < 0.5 < p[2]


def test_chain_feeds_out_of_fold_probabilities():
    r = np.random.default_rng(0)
    n = 600
    a = r.random(n) < 0.5
    feature = np.where(a, 5, 9)
    y = np.c_[a, a ^ (r.random(n) < 0.05)].astype(float)
    chain = toxicity.fit_chain(["a", "b"], np.arange(n), feature, y, np.arange(n) % 5)
    assert chain.models[1].chain[0] > 0
    p = chain(np.arange(n), feature, n)
    assert (((p[:, 1] > 0.5) == a).mean()) == 1


def test_every_component_is_heard(spark):
    r = np.random.default_rng(2)
    a, b = r.normal(size=64), r.normal(size=64)
    c, d = np.r_[a[:32], b[32:]], np.r_[b[:32], a[32:]]  # one half of a each
    assert len(chroma.render(a)) == 2 * 64 * chroma.NOTE
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate((a, c, d))], "vec_id long, embedding array<double>")
    prints = {x.id: x for x in chroma.fingerprints(chroma.rendered(df)).collect()}
    assert prints == {x.id: x for x in chroma.fingerprints(df, "vec_id", "embedding", vectors=True).collect()}
    assert prints[0]["class"] != prints[1]["class"]
    same = np.array(prints[0].fingerprint[-30:]) == np.array(prints[2].fingerprint[-30:])
    assert same.mean() > 0.5  # phases differ at the start, and chance gives none


def test_short_copies_align(spark):
    r = np.random.default_rng(4)
    raw = [r.normal(0, 4000, n).astype("<i2").tobytes() for n in (4774, 5100, 8523)]
    df = spark.createDataFrame([(i + 10 * c, b) for i, b in enumerate(raw) for c in range(2)] + [(20, raw[0][:9000])], "id long, audio binary")
    prints = chroma.fingerprints(df)
    assert sorted(len(x.fingerprint) for x in prints.collect()) == [0, 1, 1, 2, 2, 15, 15]
    got = {(x.query_id, x.match_id): x for x in chroma.align(prints, prints).collect()}
    assert all(got[i + c, i].copies == 2 and got[i + c, i].bit_error_rate == 0 and got[i + c, i].offset == 0 for i in range(3) for c in (0, 10))
    assert got[20, None].n_matches == 0 and not any(m == 20 for _, m in got)


def test_integral_image_filters_equal_plain_sums():
    image = np.random.default_rng(0).random((30, 12))
    got = chroma.fingerprint(image).view(np.uint32)
    for t in (0, 5, len(got) - 1):
        want = 0
        for kind, c, h, w in chroma.FILTERS:
            s = lambda t0, t1, c0, c1: image[t + t0 : t + t1, c0:c1].sum()  # noqa: E731, B023
            half, mid = w // 2, c + h // 2
            a, b = [(s(0, w, c, c + h), w * h / 12), (s(0, w, c, mid), s(0, w, mid, c + h // 2 * 2)), (s(0, half, c, c + h), s(half, w, c, c + h)), (s(0, half, c, mid) + s(half, w, mid, c + h // 2 * 2), s(0, half, mid, c + h // 2 * 2) + s(half, w, c, mid))][kind]
            want = want << 2 | int(chroma.GRAY[np.searchsorted(chroma.LEVELS, math.log((1 + a) / (1 + b)), "right")])
        assert got[t] == want
