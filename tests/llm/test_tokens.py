import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lodestat.llm import bpe, packing, token_counts, words_bpe

RANKS, WORDS = P.path("byte_bpe_50k.tiktoken"), P.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load(RANKS, P.PATTERN).ranks, special_tokens={})


def strings(n=400):
    r = random.Random(3)
    alphabet = ["a", "B", "ab", "the", " ", "é", "\U0001f600", "\n", "1", "'s", "ing", "!", "　", "\x0b", "\x1c", "́", "<|endoftext|>", "İ", "Σ", "\t", " ", "\r"]
    return ["".join(r.choice(alphabet) for _ in range(r.randint(0, 50))) for _ in range(n)]


def test_bpe_is_the_reference(reference):
    b = bpe.load(RANKS, P.PATTERN)
    for t in strings():
        ids = b.encode(t)
        assert ids == reference.encode_ordinary(t)
        assert b.decode(ids) == t.encode()


def test_bpe_long_pre_token_and_generic_queue(reference):
    b = bpe.load(RANKS, P.PATTERN)
    t = "the" * 3000 + "aab" * 2000
    assert b.encode(t) == reference.encode_ordinary(t)
    for s in strings(60):
        for piece in b.pattern.findall(s):
            assert b._merge_any(piece.encode()) in (list(b.merge(piece.encode())), [b.ranks.get(piece.encode())])
    assert not b.queue.buckets


def test_rank_queue_pops_lowest_rank_then_leftmost():
    q, r = bpe.RankQueue(200_000), random.Random(0)
    put = [(r.randrange(200_000) if i % 3 else r.randrange(40), i) for i in range(500)]
    r.shuffle(put)
    for x in put:
        q.push(*x)
    assert [q.pop() for _ in put] == sorted(put) and q.pop() is None


def test_bpe_query_columns(docs, none, pairs, reference):
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(docs, RANKS, P.PATTERN).collect()}
    want = set()
    for i, t in pairs:
        ids = reference.encode_ordinary(t or "")
        want.add((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == want
    assert bpe.digests(none, RANKS, P.PATTERN).count() == 0
    round_trip = bpe.decode(bpe.encode(docs, RANKS, P.PATTERN), RANKS, P.PATTERN)
    assert round_trip.where(F.coalesce(F.col("text"), F.lit("")) != F.col("decoded").cast("string")).count() == 0


def test_word_ids_are_the_tokenizers():
    coder, whole = words_bpe.load(WORDS), Tokenizer.from_file(WORDS)
    t = strings() + [None, ""]
    want = [e.ids for e in whole.encode_batch([x or "" for x in t], add_special_tokens=False)]
    got = [list(ids[at[k] : at[k + 1]]) for _, _, ids, at in coder.encode(pa.array(t)) for k in range(len(at) - 1)]
    assert got == want


def test_packing(docs, none, pairs):
    whole = Tokenizer.from_file(WORDS)
    got = packing.pack(docs, WORDS, 2, 64, digest=True).toPandas()
    assert (got["length"] & (got["length"] - 1) == 0).all() and got["length"].max() <= 64 and got["sequence_id"].is_unique and (got["offset"] == 0).all()
    full = packing.pack(docs, WORDS, 2, 64)
    by = {}
    for r in full.collect():
        by.setdefault(r.doc_id, []).append(r)
        assert len(r.ids) == r.length and r.bucket == r.length.bit_length() - 1
    crc = set(zip(got["sequence_id"].tolist(), got["ids_crc32"].tolist(), strict=True))
    assert {(r.sequence_id, zlib.crc32(np.array(r.ids, "<u4").tobytes())) for rs in by.values() for r in rs} == crc
    for i, t in pairs:
        if i == 906:
            continue
        want = whole.encode(t or "", add_special_tokens=False).ids + [2]
        parts = sorted(by[i], key=lambda r: r.start)
        assert sum((list(p.ids) for p in parts), []) == want and parts[0].doc_tokens == len(want)
    assert len(by[906]) == 2 * len(packing.lengths(9, 64))
    assert packing.pack(none, WORDS).count() == 0
    with pytest.raises(ValueError):
        packing.pack(docs, WORDS, 2, 100)


def test_lengths():
    for n in range(1, 300):
        x = packing.lengths(n, 64)
        assert sum(x) == n and x == sorted(x, reverse=True)


def test_rollup(spark, docs, none, pairs, tmp_path):
    counts = token_counts.counted(docs, WORDS, "v1")
    r = token_counts.Rollup(spark, str(tmp_path / "r"))
    assert r.totals().count() == 0
    assert r.commit("a", token_counts.inserts(counts)) and not r.commit("a", token_counts.inserts(counts))
    whole, want = Tokenizer.from_file(WORDS), {}
    for i, t in pairs:
        k = (None if i is None or i % 7 == 0 else f"s{i % 3}", None if i is None or i % 5 == 0 else "en", "v1")
        n = want.setdefault(k, [0, 0])
        n[0] += 1
        n[1] += len(whole.encode(t or "", add_special_tokens=False).ids)
    assert {tuple(x)[:3]: list(tuple(x)[3:]) for x in r.totals().collect()} == want
    some = counts.where("doc_id < 30")
    r.commit("b", token_counts.revisions(some, some.withColumn("tokenizer", F.lit("v2")).withColumn("n_tokens", F.col("n_tokens") + 1)))
    assert r.totals().where("tokenizer = 'v2'").agg(F.sum("n_docs")).first()[0] == 10
    assert r.totals().agg(F.sum("n_docs")).first()[0] == len(pairs)
    r.commit("c", token_counts.deletes(counts.where("doc_id >= 30 or doc_id is null")))
    r.commit("d", token_counts.inserts(token_counts.counted(none, WORDS, "v1")))
    assert r.totals().where("tokenizer = 'v1'").count() == 0 and r.batches() == ["a", "b", "c", "d"]
    with pytest.raises(ValueError):
        r.commit("../x", token_counts.inserts(counts))
