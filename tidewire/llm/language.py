"""Language identification by the nearest of several centroids per language.

A text is a vector of its hashed character n-grams (1 to 4 bytes of the lower-cased text,
with every run of ASCII characters other than letters as one blank), weighted log(1 + count)
* idf and scaled to length 1. The vectors of each language's training texts are clustered
into a few centroids by spherical k-means. A text gets the language of the centroid with the
highest cosine; one that is farther from it than nearly all of that cluster's own training
texts is marked as rejected.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, few, fold_of, text_or_empty

HELD, FOLDS = 1, 3
#: Training texts of each language, on average, in hash order of doc_id.
PER_LANGUAGE = 600
GRAMS = (1, 2, 3, 4)
BUCKETS = 1 << 13
CENTROIDS, ROUNDS = 4, 12
#: A text is rejected below this quantile of its cluster's own cosines, less the margin.
QUANTILE, MARGIN = 0.005, 0.05
UNKNOWN = "und"
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[*range(0, 65), *range(91, 97), *range(123, 128)]] = 32
_MUL = np.uint64(0x9E3779B97F4A7C15)


def counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of BUCKETS n-gram counts per text in the concatenated bytes; no n-gram crosses texts."""
    n = len(offsets) - 1
    out = np.zeros((n, BUCKETS), np.float32)
    low = _FOLD[data]
    doc = np.repeat(np.arange(n), np.diff(offsets))
    first = np.zeros(len(low), bool)
    first[offsets[:-1][offsets[:-1] < len(low)]] = True
    keep = ~((low == 32) & np.concatenate(([False], low[:-1] == 32)) & ~first)  # one blank of each run
    low, doc = low[keep].astype(np.uint64), doc[keep]
    starts = np.searchsorted(doc, np.arange(n + 1))
    h = np.zeros(len(low), np.uint64)
    for g in range(1, max(GRAMS) + 1):
        h = h[: max(0, len(low) - g + 1)]
        h = (h + low[g - 1 :] + np.uint64(1)) * _MUL
        if g not in GRAMS:
            continue
        code = (h >> np.uint64(64 - 13)).astype(np.int64)
        for d in range(n):
            lo, hi = starts[d], starts[d + 1] - g + 1
            if hi > lo:
                out[d] += np.bincount(code[lo:hi], minlength=BUCKETS)
    return out


def weighted(x: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF rows of length 1; rows without n-grams stay 0."""
    x = np.log1p(x) * idf
    length = np.sqrt((x**2).sum(1, keepdims=True))
    return x / np.where(length > 0, length, 1)


def _clusters(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(centroids, rejection limit of each) by spherical k-means from farthest points."""
    pick = [int((x @ x.mean(0)).argmax())]
    near = x @ x[pick[0]]
    while len(pick) < min(k, len(x)) and near.min() < 1 - 1e-6:
        pick.append(int(near.argmin()))
        near = np.maximum(near, x @ x[pick[-1]])
    c = x[pick].copy()
    for _ in range(ROUNDS):
        own = (x @ c.T).argmax(1)
        for j in range(len(c)):
            if (own == j).any():
                m = x[own == j].sum(0)
                c[j] = m / max(np.sqrt((m**2).sum()), 1e-12)
    cosine = x @ c.T
    own = cosine.argmax(1)
    limit = [np.quantile(cosine[own == j, j], QUANTILE) - MARGIN if (own == j).any() else 1.0 for j in range(len(c))]
    return c, np.array(limit)


def train(x: np.ndarray, langs: np.ndarray) -> dict[str, np.ndarray]:
    """idf, centroids, the language and limit of each centroid."""
    idf = np.log((1 + len(x)) / (1 + (x > 0).sum(0))).astype(np.float32) + 1
    v = weighted(x, idf)
    names = sorted(set(langs.tolist()))
    found = [_clusters(v[langs == name], CENTROIDS) for name in names]
    return {
        "idf": idf,
        "centroids": np.concatenate([c for c, _ in found]) if found else np.zeros((0, BUCKETS), np.float32),
        "limit": np.concatenate([t for _, t in found]) if found else np.zeros(0),
        "lang": np.array([n for n, (c, _) in zip(names, found) for _ in c], dtype=str),
    }


def nearest(model: dict[str, np.ndarray], x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(language, cosine in 0 to 1, rejected) of each row of counts."""
    if not len(model["lang"]):
        return np.full(len(x), UNKNOWN, object), np.zeros(len(x)), np.ones(len(x), bool)
    cosine = weighted(x, model["idf"]) @ model["centroids"].T
    best = cosine.argmax(1)
    top = np.clip(cosine[np.arange(len(x)), best].astype(float), 0, 1)
    return model["lang"][best].astype(object), top, top < model["limit"][best]


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def _train_task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    parts, langs, ids = [], [], []
    for f in frames:
        parts += [np.frombuffer(x, np.uint16).astype(np.float32) for x in f["counts"]]
        langs += f["lang"].tolist()
        ids += f["doc_id"].tolist()
    order = sorted(range(len(ids)), key=lambda i: (langs[i], ids[i]))
    x = np.stack([parts[i] for i in order]) if parts else np.zeros((0, BUCKETS), np.float32)
    out = io.BytesIO()
    np.savez_compressed(out, **train(x, np.array([langs[i] for i in order], dtype=str)))
    yield pd.DataFrame({"model": [out.getvalue()]})


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, offs in chunks(batch, "text"):
            x = np.minimum(counts(data, offs), 65535).astype(np.uint16)
            cols = [batch.column(c).slice(lo, hi - lo) for c in ("doc_id", "lang")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "lang", "counts"])


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> bytes:
    """The trained centroids, from about per_language texts of each language outside the held fold.

    A language with more texts gives a share of them by a hash of doc_id, so no task ranks
    a language's texts. Texts without a letter, and rows without lang or doc_id, teach
    nothing; repeated rows teach once. One task trains, with 16 KB for each sampled text.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & has_letter(F.col("text")) & (fold_of(F.col("doc_id"), FOLDS) != HELD))
    sizes = known.groupBy("lang").agg(F.count("*").alias("__tw_n"))
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    picked = known.select("doc_id", "lang", "text").join(few(sizes, 64), "lang").where(draw * F.col("__tw_n") < per_language)
    picked = picked.select("doc_id", "lang", "text").distinct()
    rows = picked.mapInArrow(_counted, "doc_id bigint, lang string, counts binary").repartition(1)
    trained = rows.mapInPandas(_train_task, "model binary").first()  # nothing runs where there are no rows
    return bytes(trained["model"]) if trained else next(_train_task(iter(())))["model"][0]


def identify(docs: DataFrame, model: bytes) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected per row of docs.

    lang_pred is the nearest centroid's language and score its cosine; rejected marks texts
    too far from it. A null text, or one without a letter, is `und` with score 0, rejected;
    so is every text where nothing was learned. Among equal cosines the first language in
    order of names wins. Repeated rows are answered alike; a null doc_id falls into the fold
    of the empty string; lang and all other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = dict(np.load(io.BytesIO(shared.value)))
        for batch in batches:
            for lo, hi, data, offs in chunks(batch, "text"):
                lang, cosine, rejected = nearest(tables, counts(data, offs))
                cols = [batch.column(c).slice(lo, hi - lo) for c in ("doc_id", "letter")]
                made = [pa.array(lang, pa.string()), pa.array(cosine), pa.array(rejected)]
                yield pa.RecordBatch.from_arrays([*cols, *made], names=["doc_id", "letter", "lang", "cosine", "far"])

    out = docs.select("doc_id", has_letter(F.col("text")).alias("letter"), text_or_empty().alias("text"))
    out = out.mapInArrow(run, "doc_id bigint, letter boolean, lang string, cosine double, far boolean")
    return out.select(
        "doc_id",
        (fold_of(F.col("doc_id"), FOLDS) == HELD).alias("held_out"),
        F.when(F.col("letter"), F.col("lang")).otherwise(UNKNOWN).alias("lang_pred"),
        F.when(F.col("letter"), F.col("cosine")).otherwise(0.0).alias("score"),
        (~F.col("letter") | F.col("far")).alias("rejected"),
    )
