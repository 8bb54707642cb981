import hashlib
from collections import Counter

import numpy as np
import pytest

import lodestat.llm.jaccard as J
from lodestat.llm import recompress
from lodestat.llm._cut import components

from .conftest import DOC, rows, texts


def words(t):
    return (t or "").encode().split()


def shingles(t, k):
    w = words(None if t is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in t))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute(pairs, k, num, den):
    sets = [shingles(t, k) for _, t in pairs]
    up = list(range(len(pairs)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(pairs)):
        for b in range(a):
            if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                up[find(a)] = find(b)
    group = {}
    for x, (i, _) in enumerate(pairs):
        if i is not None:
            group[find(x)] = min(i, group.get(find(x), i))
    return Counter((i, len(sets[x]), group.get(find(x)) if sets[x] else i) for x, (i, _) in enumerate(pairs))


@pytest.mark.parametrize("k,num,den", [(4, 85, 100), (5, 4, 5), (2, 1, 2)])
def test_components_are_those_of_all_pairs(docs, pairs, k, num, den):
    assert Counter(tuple(r) for r in J.groups(docs, k, num, den).collect()) == brute(pairs, k, num, den)


def test_long_and_spread_lists(spark, monkeypatch):
    """Many near copies, with limits so low that every later phase takes part."""
    base = texts(5, 1)[0][1].split() * 2
    many = []
    for i in range(150):
        w = list(base)
        for j in range(i % 9):
            w[(i * 37 + j * 11) % len(w)] = f"edit{i}_{j}"
        many.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows(many), DOC).repartition(6)
    want = brute(many, 4, 85, 100)
    assert Counter(tuple(r) for r in J.groups(docs, 4, 85, 100).collect()) == want
    monkeypatch.setattr(J, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(J, "SHORT", 4)
    monkeypatch.setattr(J, "BLOCK", 16)
    monkeypatch.setattr(J, "SPREAD", 20)
    monkeypatch.setattr(J, "PARTS", 2)
    assert Counter(tuple(r) for r in J.groups(docs, 4, 85, 100).collect()) == want
    monkeypatch.setattr(J, "THIN", 2)
    assert Counter(tuple(r) for r in J.groups(docs, 4, 85, 100).collect()) == want


def test_one_row_of_each_group_stays(docs, none, pairs):
    kept = J.near_copies_removed(docs)
    assert kept.columns == docs.columns
    groups = J.groups(docs).toPandas()
    want = set(groups[groups["doc_id"] == groups["component_id"]]["doc_id"].dropna())
    got = [r.doc_id for r in kept.select("doc_id").collect()]
    assert set(x for x in got if x is not None) == want and got.count(906) == 1 and got.count(None) == 1 and {900, 901, 902} <= set(got)
    assert J.near_copies_removed(none).count() == 0 and J.groups(none).count() == 0


def test_components_of_a_path(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(0, 40)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in components(e).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_forest():
    r = np.random.default_rng(0)
    for n in (0, 1, 5, 300):
        pairs = r.integers(0, 60, (n, 2)) * 7
        got = J.forest(pairs)
        reach = lambda e: Counter(frozenset(c) for c in _groups(e))
        assert reach(pairs) == reach(got) and len(got) <= 60


def _groups(edges):
    out = []
    for a, b in edges.tolist():
        if a != b:
            touch = [g for g in out if a in g or b in g]
            out = [g for g in out if g not in touch] + [set().union({a, b}, *touch)]
    return out


def strip(pairs, k):
    seen, out = set(), Counter()
    for i, t in sorted(pairs, key=lambda p: (p[0] is None, p[0] or 0, p[1] or "")):
        w = words(t)
        gone = [False] * len(w)
        for s in range(len(w) - k + 1):
            x = tuple(w[s : s + k])
            if x in seen:
                gone[s : s + k] = [True] * k
            seen.add(x)
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out[(i, len(w), sum(gone), hashlib.sha256(kept).hexdigest())] += 1
    return out


@pytest.mark.parametrize("k,direct", [(5, 4096), (20, 4096), (20, 3)])
def test_repeats_are_those_of_all_windows(docs, pairs, k, direct, monkeypatch):
    from lodestat.llm import _chunks

    monkeypatch.setattr(_chunks, "DIRECT", direct)  # with 3, messages take two hops
    got = Counter((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in recompress.remove_repeats(docs, k).collect())
    assert got == strip(pairs, k)


def test_equal_substrings_parse_alike():
    """Symbols whose reach lies in a repeated stretch stand in both of its places."""
    r = np.random.default_rng(0)
    w = r.integers(0, 40, 400).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    w[250:310] = w[50:110]
    name, lo, hi, left, right = recompress.parse(w, np.array([0, 400]))
    inside = lambda a, b: {(n, x - a, y - a) for n, x, y, f, t in zip(name, lo, hi, left, right) if f >= a and t < b}
    assert inside(50, 110) == inside(250, 310) and len(inside(50, 110)) > 3


def test_without_repeats_keeps_clean_rows(docs, none, pairs):
    out = recompress.without_repeats(docs, 50)
    assert out.columns == docs.columns and out.count() == len(pairs)
    lost = {r.doc_id for r in recompress.remove_repeats(docs, 50).where("n_removed > 0").collect()}
    clean = {(i, t) for i, t in pairs if i not in lost}
    assert clean <= {(r.doc_id, r.text) for r in out.collect()} and lost
    assert recompress.without_repeats(none).count() == 0


@pytest.mark.parametrize("num,den", [(85, 100), (4, 5), (3, 4), (9, 10), (1, 2), (7, 10)])
def test_similar_sets_meet_in_the_index(num, den):
    """Every similar pair of sets is tied by its indexed keys, in whatever order shingles come."""
    r, met = np.random.default_rng(0), 0
    for _ in range(1500):
        n = int(r.integers(1, 80))
        base = np.unique(r.integers(0, 1 << 60, n + 40).astype(np.uint64))
        r.shuffle(base)
        x, y = base[:n], np.r_[base[int(r.integers(0, n // 3 + 2)) : n], base[n : n + int(r.integers(0, n // 4 + 2))]]
        x, y = np.unique(x), np.unique(y)
        common = len(np.intersect1d(x, y))
        if common == len(x) == len(y) or not common or den * common < num * (len(x) + len(y) - common):
            continue
        entries = []
        for s, z in ((1, x), (2, y)):
            t, _ = J._keys(z, np.zeros(len(z), np.int32), J.indexed(len(z), num, den), J.paired(num, den))
            p = np.empty(len(t), J.POSTING)
            p["t"], p["s"], p["n"], p["p"] = t, s, len(z), np.arange(len(t))
            entries.append(p)
        p = np.concatenate(entries)
        p = p[np.lexsort((p["s"], p["p"], p["n"], p["t"]))]
        first = np.flatnonzero(np.r_[True, p["t"][1:] != p["t"][:-1]])
        size = np.diff(np.r_[first, len(p)])
        assert len(J.list_pairs(p, first[size > 1], size[size > 1], num, den)) == 1
        met += 1
    assert met > 50


def test_skipped_blocks_lose_no_pair():
    """Pairs by blocks connect what all pairs of a list connect."""
    r = np.random.default_rng(1)
    for num, den in ((85, 100), (1, 2)):
        p = np.empty(3000, J.POSTING)
        p["t"], p["s"] = r.integers(0, 6, 3000), np.arange(3000)
        p["n"] = r.integers(10, 60, 3000)
        p["p"] = r.integers(0, 10, 3000)
        p = p[np.lexsort((p["s"], p["p"], p["n"], p["t"]))]
        first = np.flatnonzero(np.r_[True, p["t"][1:] != p["t"][:-1]])
        size = np.diff(np.r_[first, len(p)])
        want = []
        for f, n in zip(first, size, strict=True):
            i, j = np.triu_indices(n, 1)
            ok = J._possible(p[f + i], p[f + j], num, den)
            want.append(J._sorted_pairs(p[f + i][ok], p[f + j][ok]))
        a, b = J.forest(np.concatenate(want)), J.list_pairs(p, first, size, num, den)
        assert len(a) == len(b) and len(J.forest(np.concatenate([a, b]))) == len(a)


def keep_one(pairs, k, num, den):
    """Rows that stay, by brute force: of each group of linked rows one with the smallest doc_id (None last); blank rows all."""
    sets = [shingles(t, k) for _, t in pairs]
    up = list(range(len(pairs)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(pairs)):
        for b in range(a):
            if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                up[find(a)] = find(b)
    groups = {}
    for x in range(len(pairs)):
        groups.setdefault(find(x), []).append(x)
    least = lambda g: min((pairs[x][0] is None, pairs[x][0] or 0) for x in g)
    return [sorted({pairs[x] for x in g if (pairs[x][0] is None, pairs[x][0] or 0) == least(g)}, key=str) for g in groups.values() if sets[g[0]]], [p for p, s in zip(pairs, sets) if not s]


def check_kept(spark, pairs, limit=None):
    docs = spark.createDataFrame(rows(pairs), DOC).repartition(3)
    got = [(r.doc_id, r.text) for r in J.near_copies_removed(docs).collect()]
    groups, blank = keep_one(pairs, 5, 4, 5)
    left = list(got)
    for b in blank:
        left.remove(b)
    assert len(left) == len(groups)
    for heads in groups:
        assert sum(h in left for h in heads) == 1, heads


def test_rows_decide_by_their_own_text(spark, monkeypatch):
    a, b, p, q = (" ".join(f"{x}{i}" for i in range(40)) for x in "abpq")
    cases = [(1, a), (5, b), (5, a), (7, b), (11, p), (11, q), (11, q), (None, a), (None, "only here and nowhere else at all"), (None, "only here and nowhere else at all"), (20, None), (20, None), (21, "  "), (22, "word"), (23, "Word")]
    check_kept(spark, cases)
    check_kept(spark, texts(4, 40) + cases)
    monkeypatch.setattr(J, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(J, "COPIES", 1)
    check_kept(spark, texts(4, 40) + cases)


def test_columns_of_any_name(spark):
    docs = spark.createDataFrame([(i, f"some words that repeat {i // 2} " * 12, "x", {"a": 1}) for i in range(8)], "`doc_id` long, `text` string, `a.b` string, `m` map<string,int>")
    assert J.near_copies_removed(docs).columns == docs.columns and J.near_copies_removed(docs).count() == 4
    out = recompress.without_repeats(docs, 10)
    assert out.columns == docs.columns and out.count() == 8 and [r["m"] for r in out.collect()] == [{"a": 1}] * 8


def test_rows_with_one_doc_id_are_dealt_over_chunks(spark, monkeypatch):
    from lodestat.llm import _chunks

    shared = " ".join(f"s{i}" for i in range(30))
    pairs = [(None, f"n{i} {shared} n{i}") for i in range(300)] + [(4, f"r{i} {shared}") for i in range(200)] + [(9, shared)] * 40 + [(None, shared)] * 30 + [(1, f"first {shared}")]
    docs = spark.createDataFrame(rows(pairs), DOC).repartition(4)
    base, n = _chunks.chunked(docs)
    assert base.groupBy("chunk").count().agg({"count": "max"}).first()[0] < 100
    for copies in (1000, 5):
        monkeypatch.setattr(_chunks, "COPIES", copies)
        got = Counter((r.doc_id, r.n_words, r.n_removed) for r in recompress.remove_repeats(docs, 20).collect())
        want = Counter((i, len(words(t)), 30 if i != 1 else 0) for i, t in pairs)
        assert got == want
        assert _chunks.chunked(docs)[0].groupBy("chunk").count().agg({"count": "max"}).first()[0] < (100 if copies == 1000 else 40)


def test_very_long_texts(spark):
    """A word of 2 MB, a text of 300,000 words, and copies of both."""
    long = " ".join(f"w{i * 7919 % 90001}" for i in range(300_000))
    pairs = [(1, "z" * 2_000_000), (2, long), (3, long + " end"), (4, "z" * 2_000_000), (5, "short text")]
    docs = spark.createDataFrame(rows(pairs), DOC).repartition(2)
    assert {r.doc_id: r.component_id for r in J.groups(docs, 4, 85, 100).collect()} == {1: 1, 2: 2, 3: 2, 4: 1, 5: 5}
    kept = {r.doc_id: (r.n_words, r.n_removed) for r in recompress.remove_repeats(docs, 20).collect()}
    assert kept[1] == kept[4] == (1, 0) and kept[3][1] >= 299_981 and kept[5] == (2, 0)
