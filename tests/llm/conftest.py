import random

import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long, chunk string, class string, n int, part string, p_toxic string"
#: Edge cases of every text operator: nulls, blanks, repeats, long texts without blanks, other white space, clashing column names.
ODD = [
    (None, "null id with some words here"), (900, None), (901, ""), (902, " \t\n "), (903, "one"), (904, "a" * 5000), (905, "x　y\x0bz éÉ <|endoftext|> \U0001f600"),
    (906, "same same same same same same same same"), (906, "same same same same same same same same"), (907, "tie " * 300), (908, "One"),
]


def rows(pairs):
    return [(i, t, None if i is None or i % 5 == 0 else "en", None if i is None or i % 7 == 0 else f"s{i % 3}", None if t is None else len(t), "c", "k", 1, "p", "q") for i, t in pairs]


def texts(seed=0, n=60):
    """Random texts with copies, near copies and shared passages."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(r.randint(1, 6))) for _ in range(400)]
    words = lambda k: [r.choice(vocabulary) for _ in range(k)]
    passage = words(60)
    out = []
    for i in range(n):
        kind = i % 6
        if kind < 3 or not out:
            w = words(r.randint(3, 250))
        elif kind == 3:
            w = r.choice(out)[1].split()
        elif kind == 4:
            w = r.choice(out)[1].split()
            for _ in range(r.randint(1, 3)):
                w[r.randrange(len(w))] = r.choice(vocabulary)
        else:
            w = words(20) + passage[r.randint(0, 10) :] + words(r.randint(0, 30))
        out.append((i * 3, (" " if i % 4 else "\n").join(w)))
    return out


@pytest.fixture(scope="session")
def pairs():
    return texts() + ODD


@pytest.fixture(scope="session")
def docs(spark, pairs):
    return spark.createDataFrame(rows(pairs), DOC).repartition(5).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOC)


@pytest.fixture(scope="session")
def labels(spark, pairs):
    return spark.createDataFrame([(i, int(i % 4 > 0), int(i % 9 == 0)) for i, _ in pairs if i is not None and i % 2 == 0] + [(None, 1, 0), (6, None, 1)], "doc_id long, quality int, toxic int")
