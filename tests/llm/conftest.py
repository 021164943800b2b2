import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, key string, v int, spans string, kept boolean"
ODD = [
    (None, "a row without an id , its words are many enough to be looked at here .", None, None, None, "k", 1, "s", True),
    (900, None, None, "s", None, None, None, None, None),
    (901, "", "en", None, 0, "k", 1, "s", False),
    (902, " \n\t ", "en", "s", 4, "k", 1, "s", None),
]


def prose(rng, n, words=None):
    words = words or [f"w{i}" for i in range(400)]
    out = []
    for i in range(n):
        out.append(rng.choice(words) + (".\n" if i % 11 == 10 else "." if i % 17 == 16 else ""))
    return " ".join(out).replace("\n ", "\n")


def corpus(seed=5, n=60):
    """(doc_id, text): prose, exact and near copies, repeated rows, ties, a long text."""
    rng = random.Random(seed)
    texts = [prose(rng, rng.choice([3, 40, 80, 150])) for _ in range(n)]
    rows = list(enumerate(texts))
    for i in range(0, n, 4):
        w = texts[i].split(" ")
        for rate in (0, 0.005, 0.02, 0.05):
            rows.append((len(rows), " ".join("zz" + str(rng.randrange(99)) if rng.random() < rate else x for x in w)))
    shared = prose(rng, 40)
    rows += [(len(rows) + k, prose(rng, 20) + " " + shared + " " + prose(rng, 20)) for k in range(6)]
    rows.append((len(rows), prose(rng, 6000)))
    rows.append(rows[3])  # a repeated row
    return rows


@pytest.fixture
def frame(spark):
    def make(rows, odd=True):
        full = [(i, t, "en", "src", len(t or ""), "k", i, "s", True) for i, t in rows]
        return spark.createDataFrame(full + (ODD if odd else []), SCHEMA)

    return make


@pytest.fixture
def scratch(spark):
    from tidewire.llm.common import Scratch

    s = Scratch(spark, "test")
    yield s
    s.close()
