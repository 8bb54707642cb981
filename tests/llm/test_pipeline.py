import importlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lodestat.llm import packing, toxicity

from .conftest import DOC, rows, texts
from .test_copies import keep_one, strip, words


@pytest.fixture(scope="module")
def corpus():
    """Copies, near copies, long shared passages, abuse, repeated doc_ids with other texts, null ids, null and blank texts."""
    r = np.random.default_rng(11)
    passage = " ".join(f"passage{i}" for i in range(80))
    out = list(texts(8, 60))
    for i in range(240):
        w = [f"w{int(v)}" for v in r.integers(0, 5000, int(r.integers(8, 60)))]
        if i % 6 == 0:
            w.insert(3, "vile")
        out.append((1000 + i, " ".join(w)))
    out += [(2000 + i, " ".join(f"own{i}x{j}" for j in range(60)) + f" {passage} out{i} of{i} it{i}") for i in range(4)]
    out += [(3000, "a text of its own with nine or ten words"), (3000, "another text under the same number as the one before it"), (3001, None), (3001, None), (3002, "  "), (3003, "word"), (None, "a text without any number but with quite a few words"), (None, out[5][1])]
    return out


def test_stages_are_those_of_brute_force(spark, corpus, tmp_path):
    pipeline = importlib.import_module("corpus_pipeline")
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "ngram_jaccard_join", "substring_dedup", "packing"]
    sf = str(tmp_path / "sf")
    docs = spark.createDataFrame(rows(corpus), DOC).repartition(4)
    docs.write.parquet(f"{sf}/documents.parquet")
    labels = spark.createDataFrame([(1000 + i, int(i % 5 > 0), int(i % 6 == 0)) for i in range(240)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{sf}/labels.parquet")
    state, d = corpus, spark.read.parquet(f"{sf}/documents.parquet")
    columns = d.columns
    for name, stage in pipeline.STAGES:
        out = stage(spark, d, sf)
        if name == "packing":
            break
        assert out.columns == columns, name
        out.write.parquet(f"{sf}/{name}")
        d = spark.read.parquet(f"{sf}/{name}")
        got = Counter((x.doc_id, x.text) for x in d.collect())
        if name == "toxicity":
            assert got == Counter(p for p in state if "vile" not in words(p[1]) and b"vile" not in words(p[1]))
        elif name == "ngram_jaccard_join":
            groups, blank = keep_one(state, 5, 4, 5)
            left = got - Counter(blank)
            assert Counter(blank) <= got and sum(left.values()) == len(groups) and all(sum(h in left for h in heads) == 1 for heads in groups)
        else:
            want = strip(state, pipeline.PASSAGE)
            assert Counter((i, len(words(t))) for i, t in got.elements()) == Counter({(i, n - gone): 0 for i, n, gone, _ in want}) + Counter((i, n - gone) for i, n, gone, _ in want.elements())
            lost = {i for i, _, gone, _ in want if gone}
            assert {2001, 2002, 2003} <= lost and Counter(p for p in state if p[0] not in lost) == Counter({p: c for p, c in got.items() if p[0] not in lost})
        state = list(got.elements())
    whole, ids = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), Counter()
    for x in out.collect():
        assert x.length == len(x.ids) and x.length & (x.length - 1) == 0 and x.length <= 4096
    by = {}
    for x in out.collect():
        by.setdefault((x.doc_id, x.doc_tokens), []).append((x.start, tuple(x.ids)))
    for (i, _), parts in by.items():
        for start, piece in parts:
            ids[i, start, piece] += 1
    want = Counter()
    for i, t in state:
        tokens, at = [*whole.encode(t or "", add_special_tokens=False).ids, 2], 0
        for n in packing.lengths(len(tokens), 4096):
            want[i, at, tuple(tokens[at : at + n])] += 1
            at += n
    assert ids == want
    assert pipeline.run(spark, sf).count() == out.count()


def test_empty_tables(spark, none, labels, tmp_path):
    pipeline = importlib.import_module("corpus_pipeline")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    empty = none
    for _, stage in pipeline.STAGES:
        empty = stage(spark, empty, str(tmp_path))
    assert empty.count() == 0


def test_chain_scores_are_those_of_plain_word_sets(spark, corpus):
    """Every text's probabilities from its set of words, one word at a time."""
    import re

    import pyarrow as pa

    docs = spark.createDataFrame(rows(corpus), DOC).repartition(3)
    labels = spark.createDataFrame([(1000 + i, int(i % 5 > 0), int(i % 6 == 0)) for i in range(240)], "doc_id long, quality int, toxic int")
    chain = toxicity.train(docs, labels, toxicity.CATEGORIES)
    apart = re.compile("[ \t\n\v\f\r" + re.escape("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~") + "]+")

    def brute(t):
        found = {w for w in apart.split("".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) if w}
        name = {int(toxicity.words(*toxicity.buffer(pa.array([w])), True, toxicity._APART)[0].view(np.int64)[0]) for w in found}
        p = []
        for m in chain.models:
            z = m.bias + sum(w for k, w in zip(m.keys.tolist(), m.weights) if k in name) + sum(a * b for a, b in zip(p, m.chain))
            p.append(1 / (1 + np.exp(-z)))
        return p

    for x in toxicity.score(docs, chain).collect():
        want = brute(x.text)
        assert np.allclose([x.p_low_quality, x.p_toxic], want) and x.is_toxic == (want[1] >= chain.thresholds[1])


def test_repeated_doc_ids_train_alike(spark):
    """Whichever way rows are dealt, the same text of a repeated doc_id is trained on."""
    r = np.random.default_rng(3)
    data = [(i % 200, " ".join(f"w{int(v)}" for v in r.integers(0, 60, 12)) + (" vile" if i % 200 % 4 == 0 else "")) for i in range(600)]
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(200)], "doc_id long, quality int, toxic int")
    fits = [toxicity.train(spark.createDataFrame(rows(data), DOC).repartition(n), labels, toxicity.CATEGORIES) for n in (1, 7)]
    assert all(np.array_equal(a.keys, b.keys) and np.array_equal(a.weights, b.weights) and a.bias == b.bias for a, b in zip(fits[0].models, fits[1].models))


def test_names_and_contract():
    entry = importlib.import_module("__spark_entry__")
    names = list(entry.queries())
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names
    assert set(entry.oracle_sql()) <= set(names)
    assert DOC


@pytest.mark.parametrize("module", ["functions", "operators", "plans", "sources", "streaming"])
def test_nothing_else_imports_this_subpackage(module):
    import pathlib

    root = pathlib.Path(__file__).parents[2] / "lodestat"
    for p in [*(root / module).glob("*.py"), *root.glob("*.py")]:
        assert "llm" not in p.read_text(), p
