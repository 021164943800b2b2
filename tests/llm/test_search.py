"""Language, ranked search and hard negatives against plain Python."""

import io
import math
import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewire.llm import language, negatives, queries, search

from .conftest import ODD

TERM = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall((text or "").encode().translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")))


def best_documents(rows, items, k):
    """item_id: (rank, doc_id, score) of the best k, straight from the formulas."""
    bags = [(d, Counter(terms(t))) for d, t in rows]
    bags = [(d, b) for d, b in bags if b]
    n, total = len(bags), sum(b.total() for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    w = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * c + 1))) for t, c in df.items()}
    out = []
    for item, text in items:
        scores = []
        for d, b in bags:
            m = 75 + 25 * b.total() * n // total
            s = sum(w[t] * (1_000_000_000 * b[t] // (1000 * b[t] + 12 * m)) for t in terms(text) if t in b)
            if s > 0 and d is not None:
                scores.append((-s, d))
        out += [(item, r, d, -s) for r, (s, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


def corpus(rng, n=300):
    words = [f"w{i}" for i in range(60)] + ["Ünder", "straße", "don't", "x_y", "naïve", "漢字"]
    pick = lambda k: " ".join(rng.choice(words[: rng.choice((5, 20, 66))]) for _ in range(k))
    rows = [(i, pick(rng.choice((1, 8, 40, 200)))) for i in range(n)]
    rows += [(n + i, rows[i % 7][1]) for i in range(60)]  # copies: ties by doc_id
    rows += [(n + 100, "only-once W1 w1"), (n + 101, "w3 " * 5000), (n + 102, "!!! --"), (n + 103, pick(4000))]
    return rows, pick


def search_frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id bigint, text string, item_id int, score string")


@pytest.mark.parametrize(("postings", "docs"), [(1 << 21, 1 << 15), (300, 10)])
def test_ranked_search(spark, scratch, monkeypatch, postings, docs):
    """One large shard, and many small ones that pass on their best; blocks of items; ties, repeats, odd texts."""
    monkeypatch.setattr(search, "SHARD_POSTINGS", postings)
    monkeypatch.setattr(search, "SHARD_DOCS", docs)
    rng = random.Random(11)
    rows, pick = corpus(rng)
    rows += [(None, "w1 w2 w3"), (5, rows[5][1]), (900, None), (901, "")]
    items = [(i, pick(k)) for i, k in enumerate((1, 3, 3, 12, 40))] + [(10, "W1 w1, W2"), (11, "nothing here"), (12, ""), (13, None), (14, "don't STRASSE straße"), (15, "only once")]
    bench = spark.createDataFrame([*items, items[0], (None, "w1")], "item_id bigint, text string")
    want = best_documents(rows, items, 20)
    df = search_frame(spark, rows).repartition(3)
    for most in (1 << 26, 300):
        got = sorted(map(tuple, search.ranked(df, bench, scratch, most=most).collect()))
        assert got == want and len(got) > 100
    assert sorted(map(tuple, search.ranked(df, bench, scratch, k=3).collect())) == best_documents(rows, items, 3)
    for d, b in ((df.limit(0), bench), (df, bench.limit(0)), (df.limit(0), bench.limit(0)), (search_frame(spark, [(1, None)]), bench)):
        assert search.ranked(d, b, scratch).count() == 0


def test_search_stops_early_only_when_proven():
    """A rare heavy term settles the best documents; frequent light ones aren't walked through to the end."""
    rng = np.random.RandomState(5)
    n, size = 3000, 6
    term = np.concatenate([np.sort(rng.choice(40, size, False, p=np.r_[[0.0005] * 4, [0.998 / 36] * 36])) for _ in range(n)])
    tf = rng.randint(1, 4, n * size)
    shard = search._Shard(np.arange(n), rng.randint(5, 400, n), np.full(n, size), term, tf, n, n * 150, 40)
    asked, weight = np.arange(0, 40, 3), np.where(np.arange(0, 40, 3) < 4, 9000, 40)
    exact = np.zeros(n, np.int64)
    for t, w in zip(asked, weight):
        exact[shard.doc[shard.term == t]] += shard.impact[shard.term == t] * w
    s, d = shard.best(asked, weight, 1, 5)
    order = np.lexsort((d, -s))[:5]
    top = np.lexsort((np.arange(n), -exact))[:5]
    assert (d[order] == top).all() and (s[order] == exact[top]).all() and len(d) <= 20


def mined(rows, positives=5, negatives_=5, low=80):
    """Straight from the contract, in exact integers."""
    rows = [(i, lab, v) for i, lab, v in rows if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    one = {}
    for i, lab, v in rows:
        q = [math.floor(Fraction(x) * 256) for x in v]
        one[i] = min(one.get(i, (lab, q)), (lab, q))
    out = []
    for a, (lab, q) in one.items():
        if a % 100:
            continue
        scores = sorted((-sum(x * y for x, y in zip(q, r)), i) for i, (_, r) in one.items() if i != a)
        same = [(i, -s) for s, i in scores if one[i][0] == lab][:positives]
        for p, ps in same:
            hit = [(i, -s) for s, i in scores if one[i][0] != lab and low * ps <= 100 * -s <= 100 * ps][:negatives_]
            out += [(a, p, r, i, ps, s) for r, (i, s) in enumerate(hit, 1)]
    return sorted(out)


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, lab, 1, "r") for i, lab, v in rows], "vec_id bigint, embedding array<double>, label int, rank int, norm string")


def mine(spark, scratch, rows, **kw):
    q = negatives.quantised(vectors(spark, rows), F.col("label"))
    return sorted(map(tuple, negatives.hard_negatives(q, F.col("vec_id") % 100 == 0, scratch, **kw).collect()))


def test_hard_negatives(spark, scratch, monkeypatch):
    monkeypatch.setattr(negatives, "BUCKET_BITS", 4)
    monkeypatch.setattr(negatives, "BLOCK", 3)
    rng = random.Random(21)
    vec = lambda scale: [rng.gauss(0, 1) * scale for _ in range(8)]
    rows = [(i, rng.randrange(3), vec(rng.choice((0.02, 0.3, 1, 5)))) for i in range(900)]
    hot = vec(1)
    rows += [(1000 + i, i % 2, hot) for i in range(300)]  # one vector many times: ties by vec_id
    rows += [(2000, 7, vec(1)), (2100, 1, [0.0] * 8), (2101, 1, [0.0] * 8), (2102, 2, [0.0] * 8), (2200, None, vec(1)), (2201, 1, None), (2202, 1, [1.0, None]), (2203, 1, [float("nan")]), (2204, 1, [float("inf")]), (None, 1, vec(1))]
    rows += [(2300, 2, vec(1)[:5]), (2301, 2, vec(1) + [3.0]), (2302, 1, []), (300, 1, rows[300][2]), rows[7], rows[7]]
    rng.shuffle(rows)
    want = mined(rows)
    assert mine(spark, scratch, rows) == want and len(want) > 150 and {x[0] for x in want} > {0, 100, 1000}
    assert mine(spark, scratch, rows, positives=2, negatives=3, low=95) == mined(rows, 2, 3, 95)
    big = [(i, i % 2, [x * 1e6 for x in vec(1)]) for i in range(120)]
    assert mine(spark, scratch, big) == mined(big) and mined(big)
    assert mine(spark, scratch, [r for r in rows if r[0] is not None and r[0] % 100]) == [] and mine(spark, scratch, []) == []


def test_pruned_buckets_are_not_compared(monkeypatch):
    """Once the running kth score is out of reach of shorter rows, no product is formed with them."""
    formed = []
    monkeypatch.setattr(negatives, "_products", lambda a, b, n, real=negatives._products: formed.append(len(b)) or real(a, b, n))
    rng = np.random.RandomState(3)
    block = negatives._gather([(np.array([0]), np.array([1]), np.array([100.0]), np.array([[100, 0]]), [[negatives.LEAST + 1, negatives.MOST]])], True, 2)
    for i, scale in enumerate((1000, 900, 50, 2)):
        q = rng.randint(scale // 2, scale, (10, 2))
        block.meet(np.arange(i * 10 + 1, i * 10 + 11), np.ones(10, int), np.sqrt((q**2).sum(1)), q)
    assert len(formed) == 2 and (block.score[0, 0] > 0).all()
    window = negatives._gather([(np.array([0]), np.array([1]), np.array([100.0]), np.array([[100, 0]]), [[50_000, 60_000]])], False, 2)
    window.meet(np.arange(10), np.zeros(10, int), np.full(10, 499.0), np.full((10, 2), 300))
    assert len(formed) == 2


def languages():
    rng = random.Random(8)
    parts = {"aa": ("ka", "lo", "mi", "tur", "en"), "bb": ("sch", "ung", "ein", "ver", "keit"), "cc": ("ça", "été", "eau", "oui", "tion")}
    text = lambda lang, n: " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.choice((1, 2, 3)))) for _ in range(n))
    return text, [(i, text(lang, rng.choice((3, 20, 80))), lang) for i, lang in enumerate(rng.choices(list(parts), (8, 2, 1), k=500))]


def test_language_id(spark):
    text, rows = languages()
    rows += [(600, "12 34 !?", "aa"), (601, None, "aa"), (602, "", None), (603, text("bb", 4000), None), (604, "Ж Щ Я " * 30, None), (605, text("cc", 9).upper(), "dd")]
    frame = lambda r: spark.createDataFrame([(*x, x[2], 0.5) for x in r], "doc_id bigint, text string, lang string, lang_pred string, score double")
    df = frame(rows + [rows[3], (None, text("aa", 9), "aa")])
    model = language.fit(df)
    got = {r.doc_id: r for r in language.identify(df, model).collect()}
    assert len(got) == len(rows) + 1 and language.identify(df, model).count() == len(rows) + 2
    right = [got[i].lang_pred == lang for i, _, lang in rows[:500] if got[i].held_out]
    assert len(right) > 120 and sum(right) >= 0.97 * len(right)
    assert all((got[i].lang_pred, got[i].score, got[i].rejected) == ("und", 0.0, True) for i in (600, 601, 602))
    assert got[603].lang_pred == "bb" and got[604].rejected and not got[603].rejected and all(0 <= r.score <= 1 for r in got.values())
    # scored again, without vectorised counting: each text's n-grams one by one
    tables = dict(np.load(io.BytesIO(model)))
    for i, t, _ in rows[:25]:
        low = re.sub(rb"[^a-z\x80-\xff]+", b" ", t.encode().lower())
        c = np.zeros(language.BUCKETS)
        for g in language.GRAMS:
            for p in range(len(low) - g + 1):
                h = 0
                for b in low[p : p + g]:
                    h = (h + b + 1) * 0x9E3779B97F4A7C15 % 2**64
                c[h >> 51] += 1
        v = np.log1p(c) * tables["idf"]
        cosine = tables["centroids"] @ (v / np.sqrt((v**2).sum()))
        assert got[i].lang_pred == tables["lang"][cosine.argmax()] and got[i].score == pytest.approx(cosine.max(), abs=1e-5)
    # lang of the held fold, source and ids of others play no part
    other = frame([(i, t, "zz" if got[i].held_out else lang) for i, t, lang in rows])
    assert language.fit(other) == model
    nothing = language.fit(df.limit(0))
    assert {r.lang_pred for r in language.identify(df, nothing).collect()} == {"und"} and language.identify(df.limit(0), model).count() == 0
    # a language with many texts gives about its share, another all it has
    few = dict(np.load(io.BytesIO(language.fit(df, 20))))
    assert set(few["lang"]) >= {"aa", "bb", "cc"}


def test_queries_of_this_round(spark):
    """Held-out accuracy over a whole table, and the operators' odd rows."""
    d = "/root/testdata/sf0.001"
    got = queries.queries()["op11_language_id"](spark, d).join(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out")
    n, right = got.agg(F.count("*"), F.count_if(F.col("lang") == F.col("lang_pred"))).first()
    assert n > 40 and right >= 0.95 * n
    odd = spark.createDataFrame([r[:2] for r in ODD], "doc_id bigint, text string")
    assert language.identify(odd, language.fit(odd.withColumn("lang", F.lit("en")))).count() == len(ODD)
