"""Names of words and classes: built collisions, and their way through the operators that rely on names."""

import hashlib
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

import lodestat.llm.jaccard as J
from lodestat.llm import _text, packing, recompress, token_counts, words_bpe

from .conftest import DOC, rows

WORDS = P.path("word_bpe_49k.json")


def thue_morse(n, a="a", b="b"):
    """Two words that every polynomial modulo 2**64 confuses from 1024 letters on."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join((a, b)[x] for x in bits), "".join((b, a)[x] for x in bits)


def names(*texts, check=False):
    return _text.words(*_text.buffer(pa.array(texts)), check=check)[0]


@pytest.mark.parametrize("n", [16, 64, 1024, 2048, 4096])
def test_complementary_words_have_names_of_their_own(n):
    a, b = thue_morse(n)
    for h in names(a, b, check=True):
        assert h[0] != h[1]


def test_complementary_runs_of_words_have_names_of_their_own():
    for k in (32, 50, 1024):
        a, b = (" ".join(t) for t in thue_morse(k, "x", "y"))
        w = [_text.windows(names(t), k)[0] for t in (a, b)]
        assert w[0] != w[1]
        s = list(_text.shingle_sets(pa.array([a, b]), k + 1))
        assert s[0][0] != s[1][0]


def test_names_are_those_of_words_alone():
    """A word's name depends on nothing around it, and short names differ for all texts of one and two bytes."""
    ws = ["a", "aa", "b", "a" * 8, "a" * 9, "é", "é" * 40, "x" * 64, "x" * 65, "y" * 200]
    alone = [names(w)[0] for w in ws]
    assert len(set(alone)) == len(ws) and list(names(" ".join(ws))) == alone and list(names(*ws)) == alone
    short = [chr(i) for i in range(33, 127)] + [chr(i) + chr(j) for i in range(33, 127) for j in range(33, 127)]
    assert len(set(names(*short).tolist())) == len(short)
    both = names(*ws, check=True)
    assert list(both[0]) == alone and len(set(both[1].tolist())) == len(ws)


def test_windows_by_doubling_are_functions_of_their_words():
    h = np.random.default_rng(0).integers(0, 5, 400).astype(np.uint64)
    for k in (1, 2, 3, 7, 20):
        w = _text.windows(h, k)
        seen = {}
        for i in range(len(w)):
            seen.setdefault(int(w[i]), set()).add(tuple(h[i : i + k]))
        assert len(w) == 401 - k and all(len(v) == 1 for v in seen.values()) and len(seen) == len({tuple(h[i : i + k]) for i in range(len(w))})


@pytest.fixture(scope="module")
def twins(spark):
    """Documents that differ in one word of 1024, 2048 or 4096 letters, which polynomials confuse."""
    out = []
    for k, n in enumerate((1024, 2048, 4096)):
        a, b = thue_morse(n)
        before = " ".join(f"w{i}" for i in range(19))
        out += [(10 * k, a), (10 * k + 1, b), (10 * k + 2, f"{before}{k} {a}"), (10 * k + 3, f"{before}{k} {b}")]
    return out, spark.createDataFrame(rows(out), DOC).repartition(1)


def test_packing_of_twins(twins):
    pairs, docs = twins
    whole, got = Tokenizer.from_file(WORDS), {}
    for r in packing.pack(docs, WORDS, 2, 4096, digest=True).collect():
        got.setdefault(r.doc_id, []).append((r.start, r.length, r.ids_crc32))
    for i, t in pairs:
        ids = np.array([*whole.encode(t, add_special_tokens=False).ids, 2], "<u4")
        assert sorted(got[i]) == [(s, n, zlib.crc32(ids[s : s + n].tobytes())) for s, n, _ in sorted(got[i])]


def test_counts_of_twins(twins):
    pairs, docs = twins
    whole = Tokenizer.from_file(WORDS)
    got = {r.doc_id: r.n_tokens for r in token_counts.counted(docs, WORDS, "v").collect()}
    assert got == {i: len(whole.encode(t, add_special_tokens=False).ids) for i, t in pairs}


def test_parts_with_one_first_name_are_told_apart(monkeypatch):
    """With names cut to 3 bits almost all parts collide; second values still tell them apart."""
    def few(*a, **k):
        h, *rest = _text.words(*a, **k)
        return ((h[0] & np.uint64(7), h[1]), *rest)

    monkeypatch.setattr(words_bpe, "words", few)
    whole, coder = Tokenizer.from_file(WORDS), words_bpe.WordIds(WORDS)
    for _ in range(2):
        texts = ["the cat sat on the mat", "the dog ate a large bone", None, "cat dog the unbelievable bone"]
        got = [list(ids[at[k] : at[k + 1]]) for _, _, ids, at in coder.encode(pa.array(texts)) for k in range(len(at) - 1)]
        assert got == [whole.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_twins_are_not_near_copies(twins):
    pairs, docs = twins
    got = {r.doc_id: r.component_id for r in J.groups(docs, 4, 85, 100).collect()}
    assert got == {i: i - (i % 10 == 3) for i, _ in pairs}  # only the long pairs, alike in 16 of 18 shingles, are


def test_twins_keep_their_windows(twins):
    pairs, docs = twins
    for r in recompress.remove_repeats(docs, 20).collect():
        t = dict(pairs)[r.doc_id]
        assert r.n_removed == 0 and hashlib.sha256(r.kept.encode()).digest() == hashlib.sha256(t.encode()).digest()


def test_classes_that_share_a_64_bit_name(spark):
    names = np.array([[1, 10], [1, 11], [2, 20], [2, 20], [3, 30]])
    shared = J.shared_names(spark.createDataFrame(names.tolist(), "lo long, hi long"))
    assert list(shared) == [1] and list(J._class(names, shared)) == [10, 11, 2, 2, 3]
