"""Linked secrets against a plain pair-by-pair model; scores of trained tables summed again entry by entry; repeated rows."""

import io
import math
import random
import re
from bisect import bisect_left

import numpy as np
import pytest

from tidewire.llm import gam, secrets, toxicity

from .conftest import prose


def weak_and_base(text):
    """(start, kind, end) of all parts, by Python's own regular expressions."""
    out = []
    for k, (name, pattern, group, least) in enumerate(secrets.KINDS):
        for m in re.finditer(pattern, text, re.A):
            whole = m[group]
            fits = all(re.search(n, m[0]) for n in secrets.MIXED_NEEDS) if name == "mixed" else True
            if len(whole) >= least and fits:
                out.append((m.start(), k, m.end()))
    return out


def linked(text, scope=secrets.SCOPE):
    """Weak parts with their complement: a secret and an identifier need each other, an endpoint needs both; pair by pair."""
    parts = weak_and_base(text)
    role = lambda p: secrets.ROLE[secrets.KINDS[p[1]][0]]
    near = lambda a, b: max(b[0] - a[2], a[0] - b[2]) <= scope and (b[2] <= a[0] or b[0] >= a[2])
    has = lambda a, r: any(role(b) == r and near(a, b) for b in parts)
    need = {"secret": ("id",), "id": ("secret",), "endpoint": ("id", "secret")}
    return sorted(p for p in parts if p[1] >= secrets.BASE and all(has(p, r) for r in need[role(p)]))


def test_linked_secrets_pair_by_pair(frame):
    rng = random.Random(31)
    mixed = lambda: "Zz9" + "".join(rng.choice("abcXYZ019+/_-") for _ in range(rng.choice((20, 29, 40))))
    part = lambda: rng.choice((
        lambda: f"client_id={rng.choice(('a', 'svc.main', 'bob@x'))}", lambda: f"User: 'u{rng.randrange(99)}'", mixed, lambda: "https://" + rng.choice(("h", "host.example:80/p?x")), lambda: "AKIA" + "Q" * rng.choice((9, 16)),
        lambda: f"token={rng.choice(('abc', 'abcdef'))}", lambda: "0a" * rng.choice((5, 12)), lambda: "x" * rng.choice((1, 30, 150, 199, 205)), lambda: "é\U0001f600", lambda: "word",
    ))()
    rows = [(i, " ".join(part() for _ in range(rng.choice((2, 5, 12, 30))))) for i in range(150)]
    rows += [(200, prose(rng, 3000) + " client_id=svc.main " + mixed() + " " + prose(rng, 3000)), (201, "user=bob " * 300 + mixed()), (7, rows[7][1]), (8, "user=bob " + mixed())]
    got = secrets.scan_documents(frame(rows)).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append((r.n_linked, r.spans))
    names, n = [k[0] for k in secrets.KINDS], 0
    for i, t in rows:
        weak = linked(t)
        spans = sorted([p for p in weak_and_base(t) if p[1] < secrets.BASE] + weak)
        assert (len(weak), ",".join(f"{names[k]}:{s}:{e}" for s, k, e in spans)) in by[i]
        n += len(weak)
    assert n > 150 and sum(not linked(t) for _, t in rows) > 20


def labelled(spark, rng, n=160):
    rows = []
    for i in range(n):
        bad = i % 2
        t = prose(rng, rng.choice((20, 60)), None if not bad else ["vile", "vilest", "scum", "###", "w1", "w2", "|||"])
        rows.append((i, t, bad))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(0, rows[0][1])], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, b, 1 - b) for i, _, b in rows], "doc_id bigint, toxic int, quality int")
    return rows, docs, labels


def test_scores_of_the_additive_model_entry_by_entry(spark):
    rows, docs, labels = labelled(spark, random.Random(5))
    model = gam.fit(docs, labels)
    t = {k: v.tolist() for k, v in dict(np.load(io.BytesIO(model))).items()}
    got = {}
    for r in gam.score_documents(docs, model).collect():
        assert got.setdefault(r.doc_id, r.score) == r.score  # a repeated row scores alike
    for i, text, _ in rows[:30]:
        data = np.frombuffer(text.encode(), np.uint8)
        x = gam.features(data, np.array([0, len(data)]))[0].tolist()
        b = [bisect_left(edges, v) for edges, v in zip(t["edges"], x)]
        z = t["base"] + sum(t["one"][f][b[f]] for f in range(len(x))) + sum(t["two"][k][b[i]][b[j]] for k, (i, j) in enumerate(t["pairs"]))
        assert got[i] == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, z)))))
    assert len(t["pairs"]) == gam.PAIRS and sum((s >= 0.5) == (i % 2 == 0) for i, s in got.items()) > 150


def test_scores_of_the_subword_bag_word_by_word(spark):
    rows, docs, labels = labelled(spark, random.Random(6))
    model = toxicity.fit(docs, labels)
    z = dict(np.load(io.BytesIO(model)))
    table, bias = z["table"].tolist(), float(z["bias"])
    got = {}
    for r in toxicity.score_documents(docs, model).collect():
        assert got.setdefault(r.doc_id, r.score) == r.score

    def word_score(w):
        _, grams = toxicity.word_grams([w])
        return sum(table[g] for g in grams.tolist()) / max(1, len(grams))

    for i, text, _ in rows[:30]:
        s = [word_score(w) for w in text.lower().split()]
        k = min(toxicity.WINDOW, len(s))
        top = max(sum(s[j : j + k]) / toxicity.WINDOW for j in range(len(s) - k + 1)) if s else 0.0
        assert got[i] == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, top + bias)))), rel=1e-6)
    assert sum((s >= 0.5) == (i % 2 == 1) for i, s in got.items()) > 150
