"""Quality classifier: a generalised additive model with pairwise interactions.

Every feature is cut into bins and has a lookup table over them; so has every chosen pair
of features. Tables are learnt by cyclic boosting: feature after feature, a shallow tree
over its bins is fitted to the residuals and added, many small times over; then pairs are
ranked by how much of the remaining residual a two-by-two split explains, and the best
are boosted in the same way. A score is the logistic function of a sum of table entries.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _LOWER, chunks, fold_of, hash_spans, labelled_sample, word_spans

HELD, FOLDS = 1, 3
#: Most rows of either label that training reads.
PER_CLASS = 3000
BINS = 32
ROUNDS, PAIR_ROUNDS, PAIRS = 60, 30, 8
RATE = 0.15
FEATURES = (
    "log_words", "word_length", "symbols", "marks", "capitals", "digits", "shouts", "bars", "distinct_words",
    "top_word", "repeats_next", "repeated_lines", "words_per_line", "non_ascii", "symbol_words",
)
_CLASS = np.zeros((256, 8), np.int64)  # symbols, marks, capitals, digits, shouts, bars, newlines, high bytes
for _i, _s in enumerate((b"#*$%&|<>", b".,;:?!", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"!", b"|", b"\n")):
    _CLASS[list(_s), _i] = 1
_CLASS[128:, 7] = 1


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of FEATURES per text in the concatenated bytes; all are 0 for an empty text."""
    n = len(offsets) - 1
    out = np.zeros((n, len(FEATURES)))
    low = _LOWER[data]
    start, end, doc = word_spans(data, offsets)
    h = hash_spans(low, start, end)
    symbol = np.concatenate(([0], np.cumsum(_CLASS[data, 0])))
    dirty = symbol[end] > symbol[start]
    bounds = np.searchsorted(doc, np.arange(n + 1))
    for d in range(n):
        lo, hi = bounds[d], bounds[d + 1]
        if hi == lo:
            continue
        raw = data[offsets[d] : offsets[d + 1]]
        kinds = np.bincount(raw, minlength=256) @ _CLASS
        chars, words = max(1, int((end[lo:hi] - start[lo:hi]).sum())), h[lo:hi]
        _, counts = np.unique(words, return_counts=True)
        lines = [x for x in raw.tobytes().split(b"\n") if x.strip()]
        out[d] = (
            np.log1p(hi - lo), chars / (hi - lo), kinds[0] / chars, kinds[1] / chars, kinds[2] / chars, kinds[3] / chars,
            kinds[4] / chars, kinds[5] / chars, len(counts) / (hi - lo), counts.max() / (hi - lo),
            (words[1:] == words[:-1]).sum() / (hi - lo), 1 - len(set(lines)) / len(lines), (hi - lo) / len(lines),
            kinds[7] / chars, dirty[lo:hi].sum() / (hi - lo),
        )
    return out


def _tree(g: np.ndarray, w: np.ndarray, depth: int = 2) -> np.ndarray:
    """Leaf values per bin of a tree that halves runs of bins where squared error falls most (g, w: sums per bin)."""
    out = np.zeros(len(g))

    def grow(lo: int, hi: int, left: int) -> None:
        cg, cw = np.cumsum(g[lo:hi]), np.cumsum(w[lo:hi])
        if left and hi - lo > 1:
            a, b = cw[:-1] + 1.0, cw[-1] - cw[:-1] + 1.0
            gain = cg[:-1] ** 2 / a + (cg[-1] - cg[:-1]) ** 2 / b
            at = int(gain.argmax())
            if gain[at] > cg[-1] ** 2 / (cw[-1] + 1.0) + 1e-12:
                grow(lo, lo + at + 1, left - 1)
                grow(lo + at + 1, hi, left - 1)
                return
        out[lo:hi] = cg[-1] / (cw[-1] + 1.0)

    grow(0, len(g), depth)
    return out


def _quarters(g: np.ndarray, w: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and leaf values of the best two-by-two split of a grid of bins."""
    cg, cw = g.cumsum(0).cumsum(1), w.cumsum(0).cumsum(1)
    tg, tw = cg[-1, -1], cw[-1, -1]
    a, wa = cg[:-1, :-1], cw[:-1, :-1]
    b, wb = cg[:-1, -1:] - a, cw[:-1, -1:] - wa
    c, wc = cg[-1:, :-1] - a, cw[-1:, :-1] - wa
    d, wd = tg - a - b - c, tw - wa - wb - wc
    gain = a**2 / (wa + 1) + b**2 / (wb + 1) + c**2 / (wc + 1) + d**2 / (wd + 1)
    i, j = np.unravel_index(gain.argmax(), gain.shape)
    out = np.empty(g.shape)
    out[: i + 1, : j + 1] = a[i, j] / (wa[i, j] + 1)
    out[: i + 1, j + 1 :] = b[i, j] / (wb[i, j] + 1)
    out[i + 1 :, : j + 1] = c[i, j] / (wc[i, j] + 1)
    out[i + 1 :, j + 1 :] = d[i, j] / (wd[i, j] + 1)
    return float(gain[i, j] - tg**2 / (tw + 1)), out


def train(x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    """Bin edges, one table per feature, the chosen pairs and their tables, and the intercept."""
    k = x.shape[1]
    edges = np.stack([np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1]) for f in range(k)])
    b = np.stack([np.searchsorted(edges[f], x[:, f], side="left") for f in range(k)], 1)
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)  # classes weigh alike
    one, base, z = np.zeros((k, BINS)), 0.0, np.zeros(len(y))

    def residual() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-z))
        return (y - p) * share, np.maximum(p * (1 - p), 1e-3) * share

    for _ in range(ROUNDS):
        for f in range(k):
            g, w = residual()
            step = RATE * _tree(np.bincount(b[:, f], g, BINS), np.bincount(b[:, f], w, BINS))
            one[f] += step
            z += step[b[:, f]]
    g, w = residual()
    cell = lambda i, j: b[:, i] * BINS + b[:, j]
    grid = lambda i, j, v: np.bincount(cell(i, j), v, BINS * BINS).reshape(BINS, BINS)
    ranked = sorted(((-_quarters(grid(i, j, g), grid(i, j, w))[0], i, j) for i, j in combinations(range(k), 2)))
    pairs = np.array([(i, j) for _, i, j in ranked[:PAIRS]])
    two = np.zeros((len(pairs), BINS, BINS))
    for _ in range(PAIR_ROUNDS):
        for t, (i, j) in enumerate(pairs):
            g, w = residual()
            step = RATE * _quarters(grid(i, j, g), grid(i, j, w))[1]
            two[t] += step
            z += step.ravel()[cell(i, j)]
    return {"edges": edges, "one": one, "pairs": pairs, "two": two, "base": np.array(base)}


def score(model: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    """Sums of table entries, put through the logistic function."""
    k = x.shape[1]
    b = np.stack([np.searchsorted(model["edges"][f], x[:, f], side="left") for f in range(k)], 1) if len(x) else np.zeros((0, k), int)
    z = float(model["base"]) + sum(model["one"][f][b[:, f]] for f in range(k))
    for t, (i, j) in enumerate(model["pairs"]):
        z = z + model["two"][t][b[:, i], b[:, j]]
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, offs in chunks(batch, "text"):
            x = features(data, offs)
            cols = [batch.column("doc_id").slice(lo, hi - lo), batch.column("y").slice(lo, hi - lo)]
            yield pa.RecordBatch.from_arrays([*cols, *map(pa.array, x.T.copy())], names=["doc_id", "y", *FEATURES])


def _train_task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    parts = list(frames)
    rows = pd.concat(parts).sort_values("doc_id") if parts else pd.DataFrame(columns=["y", *FEATURES])
    y = rows["y"].to_numpy(np.int64)
    if len(set(y)) < 2:  # nothing to tell apart: the share of label 1 for all
        share = float(y.mean()) if len(y) else 0.5
        k = len(FEATURES)
        model = {"edges": np.zeros((k, BINS - 1)), "one": np.zeros((k, BINS)), "pairs": np.zeros((0, 2), int)}
        model |= {"two": np.zeros((0, BINS, BINS)), "base": np.array(np.log((share + 0.01) / (1.01 - share)))}
    else:
        model = train(rows[list(FEATURES)].to_numpy(float), y)
    out = io.BytesIO()
    np.savez_compressed(out, **model)
    yield pd.DataFrame({"model": [out.getvalue()]})


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> bytes:
    """The trained tables from at most per_class rows of either label outside the held fold."""
    rows = labelled_sample(docs, labels, "quality", HELD, FOLDS, per_class)
    schema = "doc_id bigint, y int, " + ", ".join(f"{f} double" for f in FEATURES)
    one = rows.mapInArrow(_featured, schema).repartition(1)
    trained = one.mapInPandas(_train_task, "model binary").first()  # nothing runs where there are no rows
    return bytes(trained["model"]) if trained else next(_train_task(iter(())))["model"][0]


def score_documents(docs: DataFrame, model: bytes) -> DataFrame:
    """doc_id, held_out, score, predicted per row of docs.

    A null text is empty; an empty text has all features 0 and is scored like any other.
    Repeated rows score alike; a null doc_id falls into the fold of the empty string;
    other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = dict(np.load(io.BytesIO(shared.value)))
        for batch in batches:
            for lo, hi, data, offs in chunks(batch, "text"):
                s = score(tables, features(data, offs))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(s)], names=["doc_id", "score"])

    out = docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, score double")
    return out.select(
        "doc_id",
        (fold_of(F.col("doc_id"), FOLDS) == HELD).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
