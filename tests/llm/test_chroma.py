"""Alignment against brute force, with noisy, shifted, silent and short recordings."""

from collections import Counter

import numpy as np

from lodestat.llm import chroma


def judged(x, y, votes=2, most=0.25, overlap=16, offsets=3):
    """The best (rate, -votes, |offset|, offset) of two fingerprints, or None."""
    gap = min(chroma.GAP, len(x) - 1, len(y) - 1)
    a, b = (list(zip(*(c.tolist() for c in chroma.pairs(f, gap)))) for f in (x, y))
    n = Counter(j - i for i, v in a for j, w in b if v == w)
    found = []
    for o, c in sorted(n.items(), key=lambda t: (-t[1], abs(t[0]), t[0])):
        if c < min(votes, len(a), len(b)):
            continue
        found.append((o, c))
    out = []
    for o, c in found[:offsets]:
        lo, hi = max(0, -o), min(len(x), len(y) - o)
        if hi - lo >= min(overlap, len(x), len(y)):
            wrong = sum(bin((int(p) ^ int(q)) & 0xFFFFFFFF).count("1") for p, q in zip(x[lo:hi], y[lo + o : hi + o]))
            if wrong / (32 * (hi - lo)) <= most:
                out.append((wrong / (32 * (hi - lo)), -c, abs(o), o))
    return min(out, default=None)


def expected(prints, queries, among):
    heads = {}
    for i, f in prints:
        if len(f):
            heads.setdefault(f.tobytes(), []).append(i)
    low = lambda ids: min((i is None, i) for i in ids if i is not None)[1] if any(i is not None for i in ids) else None
    out = {}
    for q, x in queries:
        if q is None:
            continue
        found = []
        for key, ids in heads.items():
            y = np.frombuffer(key, np.int32)
            if len(x) and key == x.tobytes():
                if len(ids) > int(among):
                    found.append((0.0, -len(x), low(ids) is None, low(ids), len(ids), 0))
            elif len(x) and (b := judged(x, y)):
                found.append((b[0], b[1], low(ids) is None, low(ids), len(ids), b[3]))
        b = min(found, default=None)
        out.setdefault(q, []).append((len(found), *((b[3], b[4], b[5], -b[1], round(b[0], 9)) if b else (None,) * 5)))
    return {k: sorted(v, key=str) for k, v in out.items()}


def recordings():
    r = np.random.default_rng(1)
    pcm = {i: chroma.render(r.normal(size=32)) for i in range(10)}
    samples = lambda i: np.frombuffer(pcm[i], "<i2").astype(float)
    noisy = lambda x, snr: np.clip(x + r.normal(size=len(x)) * x.std() * 10 ** (-snr / 20), -32768, 32767).astype("<i2").tobytes()
    cut = 2 * chroma.HOP * 10
    media = list(pcm.items()) + [(20, pcm[3]), (21, pcm[3][cut:]), (22, noisy(samples(4), 20)), (23, noisy(samples(5), 10)), (24, noisy(samples(6)[999:], 15)), (25, pcm[7] + pcm[8]), (None, pcm[2])]
    media += [(30, None), (31, b""), (32, b"\0" * 30001), (33, b"\0" * 40002), (34, b"\1"), (35, b"\0" * 30001), (36, b"\0" * 8000 + pcm[9]), (37, pcm[1][:9800]), (37, pcm[0])]
    tone = (9000 * np.sin(np.arange(20000) * 0.5)).astype("<i2").tobytes()
    return media + [(40, tone), (41, tone[:30000]), (42, pcm[2][:10400]), (43, pcm[2][:10300])]


def test_alignment_is_that_of_all_pairs(spark):
    media = recordings()
    df = spark.createDataFrame([(a, b, "x") for a, b in media], "id long, audio binary, class string").repartition(3)
    prints = chroma.fingerprints(df).cache()
    plain = [(i, chroma.of_pcm(b)) for i, b in media]
    for among, queries in ((True, plain), (False, plain[:12])):
        asked = prints if among else chroma.fingerprints(spark.createDataFrame([(a, b) for a, b in media[:12]], "id long, audio binary"))
        got = {}
        for x in chroma.align(prints, asked, among=among).collect():
            got.setdefault(x.query_id, []).append((x.n_matches, x.match_id, x.copies, x.offset, x.votes, None if x.bit_error_rate is None else round(x.bit_error_rate, 9)))
        assert {k: sorted(v, key=str) for k, v in got.items()} == expected(plain, queries, among)
    best = {x.query_id: x for x in chroma.align(prints, prints).collect() if x.query_id != 37}
    assert best[21].match_id == 3 and best[21].offset == 10 and best[3].match_id == 3 and best[3].copies == 2
    assert best[22].match_id == 4 and best[23].match_id == 5 and best[24].match_id == 6 and best[25].match_id in (7, 8)
    assert best[32].match_id == 32 and best[32].copies == 2 and best[33].n_matches == 0 and best[30].n_matches == 0


def test_no_cluster_of_near_misses(spark):
    """Unrelated tunes don't match."""
    r = np.random.default_rng(5)
    df = spark.createDataFrame([(i, r.normal(size=64).tolist()) for i in range(300)], "id long, v array<double>").repartition(3)
    prints = chroma.fingerprints(df, "id", "v", vectors=True)
    assert chroma.align(prints, prints.where("id % 10 = 0")).where("n_matches > 0").count() == 0
    clips = chroma.fingerprints(df.where("id % 10 = 0"), "id", "v", vectors=True, skip=2037)
    assert chroma.align(prints, clips, among=False).where("match_id = query_id and offset between 7 and 9").count() == 30
    assert chroma.align(prints.limit(0), prints.limit(0)).count() == 0
    assert chroma.align(prints.limit(0), clips, among=False).where("n_matches = 0").count() == 30
