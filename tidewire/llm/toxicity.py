"""Toxicity: bags of character n-grams, embedded, averaged and put through a linear softmax.

Words are bags of hashed n-grams with embeddings E; a window of words is the mean of its
words' means, and a two-class softmax over it is the logistic function of that mean's
product with a vector v (the difference of the classes' weights). E, v and the bias are
trained jointly. A document is as toxic as its most toxic window, in training and in
scoring, so one insult isn't diluted by a long text. Unseen spellings share n-grams with
seen ones and so their vectors.

Training runs in one task on a bounded sample (PER_CLASS rows of either label); its result
is one number per n-gram bucket, E @ v, so a score is a sum of table entries.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold_of, labelled_sample, mix

HELD, FOLDS = 0, 5
#: Most rows of either label that training reads.
PER_CLASS = 1500
BUCKETS = 1 << 18
GRAMS = (3, 4, 5, 6)
WINDOW = 6
DIM = 8
EPOCHS = 60
MIN_DOCS = 5
#: Buckets whose presence is within this many standard errors of chance stay at 0.
MIN_Z = 4.0
#: Words whose scores a task keeps at hand before it starts anew.
CACHE = 400_000
_STEP = np.uint64(0x9E3779B97F4A7C15)


def word_grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(index of the word, bucket) of every n-gram of "<word>"; the whole word is one too."""
    marked = ["<" + w + ">" for w in words]
    codes = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    ends = np.cumsum([len(w) for w in marked])
    word = np.repeat(np.arange(len(marked)), np.diff(np.concatenate(([0], ends))))
    last = ends[word] if len(word) else ends
    x = mix(codes + np.uint64(1))
    at, out_w, out_g = np.arange(len(codes)), [], []
    roll = np.zeros(len(codes), np.uint64)
    for n in range(1, max(GRAMS) + 1):
        roll = roll[: len(codes) - n + 1] * _STEP + x[n - 1 :]
        if n in GRAMS:
            ok = at[: len(roll)] + n <= last[: len(roll)]
            out_w.append(word[: len(roll)][ok])
            out_g.append(mix(roll[ok] + np.uint64(n)) % np.uint64(BUCKETS))
    starts = np.concatenate(([0], ends[:-1])).astype(np.int64)
    whole = np.zeros(len(marked), np.uint64)
    if len(marked):
        whole = np.add.reduceat(mix(x + (at - starts[word]).astype(np.uint64) * _STEP), starts)
    out_w.append(np.arange(len(marked)))
    out_g.append(mix(whole) % np.uint64(BUCKETS))
    return np.concatenate(out_w), np.concatenate(out_g).astype(np.int64)


def window_means(scores: np.ndarray) -> np.ndarray:
    """Means of all runs of WINDOW scores; shorter texts are padded by zeros to one window."""
    c = np.concatenate(([0.0], np.cumsum(scores)))
    w = min(WINDOW, len(scores))
    return (c[w:] - c[: len(c) - w]) / WINDOW


def presence_scores(docs: list[np.ndarray], y: np.ndarray, words: np.ndarray, buckets: np.ndarray, n: int) -> np.ndarray:
    """Start values per bucket: how far its share of toxic documents is from its share of others, in
    standard errors; 0 for buckets of fewer than MIN_DOCS documents, which say nothing about unseen texts."""
    first = np.searchsorted(words_sorted := np.sort(words), np.arange(n + 1))
    grams = buckets[np.argsort(words, kind="stable")]
    seen = np.zeros((2, BUCKETS))
    for d, label in zip(docs, y):
        u = np.unique(d)
        u = u[u >= 0]
        if len(u):
            got = np.unique(np.concatenate([grams[first[i] : first[i + 1]] for i in u]))
            seen[int(label > 0), got] += 1
    del words_sorted
    n1, n0 = max(1, (y > 0).sum()), max(1, (y == 0).sum())
    p = (seen.sum(0) + 1) / (n0 + n1 + 2)
    z = (seen[1] / n1 - seen[0] / n0) / np.sqrt(p * (1 - p) * (1 / n0 + 1 / n1))
    return np.where((seen.sum(0) >= MIN_DOCS) & (np.abs(z) >= MIN_Z), z, 0.0)


def train(texts: list[str], y: np.ndarray, seed: int = 7) -> tuple[np.ndarray, float]:
    """Bucket weights (E @ v) and the bias, by Adam on the logistic loss of each document's highest window."""
    rng = np.random.RandomState(seed)
    index: dict[str, int] = {}
    docs = [np.array([index.setdefault(w, len(index)) for w in t.lower().split()] or [-1], np.int64) for t in texts]
    words, buckets = word_grams(list(index))
    per = np.maximum(np.bincount(words, minlength=len(index)), 1)
    flat = np.concatenate(docs)
    size = np.array([len(d) for d in docs])
    start = np.concatenate(([0], np.cumsum(size)[:-1]))
    owner = np.repeat(np.arange(len(docs)), size)
    v = rng.normal(0, 0.5, DIM)
    z = presence_scores(docs, y, words, buckets, len(index))
    e = np.outer(z, v / (v @ v))
    live = z != 0
    bias = -1.0
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y == 0).sum()))
    m1e, m2e, m1v, m2v, m1b, m2b = np.zeros_like(e), np.zeros_like(e), np.zeros(DIM), np.zeros(DIM), 0.0, 0.0
    for t in range(1, EPOCHS + 1):
        s = np.bincount(words, (e @ v)[buckets], minlength=len(index)) / per
        s = np.append(s, 0.0)
        c = np.concatenate(([0.0], np.cumsum(s[flat])))
        w = np.minimum(WINDOW, size)
        ends = np.minimum(np.arange(len(flat)) + w[owner], (start + size)[owner])
        means = np.where(np.arange(len(flat)) + w[owner] <= (start + size)[owner], c[ends] - c[:-1], -np.inf) / WINDOW
        top = np.maximum.reduceat(means, start)
        hit = np.flatnonzero(means == top[owner])
        lo = np.full(len(docs), 0)
        lo[owner[hit][::-1]] = hit[::-1]
        hi, scale = lo + w, np.full(len(docs), 1.0 / WINDOW)
        p = 1 / (1 + np.exp(-np.clip(top + bias, -30, 30)))
        g = (p - y) * weight
        steps = np.zeros(len(flat) + 1)
        np.add.at(steps, lo, g * scale)
        np.add.at(steps, hi, -g * scale)
        at = np.cumsum(steps)[:-1]
        known = flat >= 0
        coef = np.bincount(flat[known], at[known], minlength=len(index)) / per
        a = np.bincount(buckets, coef[words], minlength=BUCKETS)
        ge, gv, gb = np.outer(a * live, v), a @ e, g.sum()
        for x, gx, m1, m2, rate in ((e, ge, m1e, m2e, 0.05), (v, gv, m1v, m2v, 0.02)):
            m1 *= 0.9
            m1 += 0.1 * gx
            m2 *= 0.999
            m2 += 0.001 * gx * gx
            step = rate * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.999**t)) + 1e-9)
            x -= np.where(gx != 0, step, 0.0)
        m1b, m2b = 0.9 * m1b + 0.1 * gb, 0.999 * m2b + 0.001 * gb * gb
        bias -= 0.05 * (m1b / (1 - 0.9**t)) / (np.sqrt(m2b / (1 - 0.999**t)) + 1e-9)
    return np.where(live, e @ v, 0.0).astype(np.float32), float(bias)


def _train_task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    parts = list(frames)
    rows = pd.concat(parts).sort_values("doc_id") if parts else pd.DataFrame({"text": [], "y": []})
    y = rows["y"].to_numpy(np.int64)
    if len(set(y)) < 2:  # nothing to tell apart: the share of label 1 for all
        share = float(y.mean()) if len(y) else 0.0
        table, bias = np.zeros(BUCKETS, np.float32), float(np.log((share + 0.01) / (1.01 - share)))
    else:
        table, bias = train(rows["text"].tolist(), y)
    out = io.BytesIO()
    np.savez_compressed(out, table=table, bias=bias)
    yield pd.DataFrame({"model": [out.getvalue()]})


class Scorer:
    """Scores texts by a trained table; words' scores are kept while they are few enough."""

    def __init__(self, model: bytes):
        z = np.load(io.BytesIO(model))
        self.table, self.bias, self.seen = z["table"].astype(np.float64), float(z["bias"]), {}

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        split = [(t or "").lower().split() for t in texts]
        if len(self.seen) > CACHE:
            self.seen = {}
        new = list({w for ws in split for w in ws} - self.seen.keys())
        if new:
            word, bucket = word_grams(new)
            n = np.maximum(np.bincount(word, minlength=len(new)), 1)
            self.seen.update(zip(new, (np.bincount(word, self.table[bucket], minlength=len(new)) / n).tolist()))
        get = self.seen.__getitem__
        top = np.array([window_means(np.fromiter(map(get, ws), float, len(ws))).max() if ws else 0.0 for ws in split])
        return 1 / (1 + np.exp(-np.clip(top + self.bias, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> bytes:
    """The trained model (about BUCKETS floats) from at most per_class rows of either label outside the held fold."""
    rows = labelled_sample(docs, labels, "toxic", HELD, FOLDS, per_class).repartition(1)
    trained = rows.mapInPandas(_train_task, "model binary").first()  # nothing runs where there are no rows
    return bytes(trained["model"]) if trained else next(_train_task(iter(())))["model"][0]


def score_documents(docs: DataFrame, model: bytes) -> DataFrame:
    """doc_id, held_out, score, predicted per row of docs.

    A null or empty text scores like a text of unknown words. Repeated rows score alike; a
    null doc_id falls into the fold of the empty string; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            for lo in range(0, len(batch), 256):
                part = batch.slice(lo, 256)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(scorer(part.column("text").to_pylist()))], names=["doc_id", "score"]
                )

    out = docs.select("doc_id", "text").mapInArrow(score, "doc_id bigint, score double")
    return out.select(
        "doc_id",
        (fold_of(F.col("doc_id"), FOLDS) == HELD).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
