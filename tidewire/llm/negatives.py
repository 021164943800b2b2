"""Hard-negative mining by norm-bucketed search.

Rows are sorted by norm (longest first) and cut into buckets of consecutive rows. Anchors
are dealt to blocks by a hash of their id. Each task gets one block of anchors and one share
of the buckets, in order of norm, and keeps the best rows of each anchor so far; a bucket is
compared only with anchors for which, by Cauchy-Schwarz, |anchor| * |longest row of the
bucket| reaches both the lower limit of one of its windows and that window's running kth
score. Buckets that no anchor of a block can need by its limits are not sent to the block.
The partial bests, at most k per anchor, window and share, are ranked at the end.

Scores are integers. They are exact as doubles while products of norms are below 2^53;
beyond that they are computed as Python integers, and end at 2^62 either way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

#: Consecutive rows, by norm, that are compared or passed over together (a power of 2: 2^11).
BUCKET_BITS = 11
#: Anchors in a block on average; a task holds one block and its scores with one bucket.
BLOCK = 2048
#: Shares of the buckets that a block's anchors are compared with side by side.
SHARES = 16
LEAST, MOST = -(2**62), 2**62
#: Part by which a computed bound is widened, so that rounding never passes over a row.
SLACK = 1e-9
ROW = "block int, share int, kind int, bucket bigint, norm double, vec_id bigint, label int, q array<bigint>, limits array<bigint>"
FOUND = "anchor_id bigint, window int, vec_id bigint, score bigint"


def quantised(df: DataFrame, label: Column, scale: int = 256) -> DataFrame:
    """vec_id, label, q of the rows that take part: floor(scale * x) of each component x.

    Rows with a null label or vector, with a null or non-finite component, or without a
    vec_id take no part. Of several rows with one vec_id the one with the smallest label,
    then vector, stays. An empty vector has score 0 with all others; of two vectors of
    different length the shorter is padded with zeros. Other columns are ignored.
    """
    x = F.col("embedding")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    q = F.transform(x, lambda v: F.floor(v.cast("double") * float(scale)).cast("bigint"))
    rows = df.where(F.col("vec_id").isNotNull() & label.isNotNull() & finite).select("vec_id", F.struct(label.cast("int").alias("label"), q.alias("q")).alias("r"))
    return rows.groupBy("vec_id").agg(F.min("r").alias("r")).select("vec_id", "r.label", "r.q")


def bucketed(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows with norm and bucket, written in order of norm; a later bucket has no longer row."""
    norm = F.sqrt(F.aggregate("q", F.lit(0.0), lambda acc, v: acc + v.cast("double") * v.cast("double")))
    sorted_ = rows.withColumn("norm", norm).repartitionByRange(F.desc("norm"), "vec_id").sortWithinPartitions(F.desc("norm"), "vec_id")
    return scratch.write(sorted_.withColumn("bucket", F.shiftright(F.monotonically_increasing_id(), BUCKET_BITS)), "buckets")


def _matrix(col: pa.ListArray) -> np.ndarray:
    """Rows of a list column as a matrix, padded with zeros."""
    offs = col.offsets.to_numpy().astype(np.int64)
    flat = col.values.to_numpy(zero_copy_only=False)[offs[0] : offs[-1]] if len(col) else np.zeros(0, np.int64)
    size = np.diff(offs)
    out = np.zeros((len(col), int(size.max(initial=0))), np.int64)
    out[np.arange(out.shape[1]) < size[:, None]] = flat
    return out


def _products(a: np.ndarray, b: np.ndarray, norms: float) -> np.ndarray:
    """Inner products of all rows of a with all of b as int64; norms: a bound of their size."""
    d = min(a.shape[1], b.shape[1])
    if norms < 2**53:
        return (a[:, :d].astype(float) @ b[:, :d].astype(float).T).astype(np.int64)
    exact = a[:, :d].astype(object) @ b[:, :d].astype(object).T if d else np.zeros((len(a), len(b)), object)
    return np.clip(exact, LEAST + 1, MOST).astype(np.int64)


class _Block:
    """A block of anchors with the best k rows of each of their windows so far."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, norms: np.ndarray, q: np.ndarray, limits: list[list[int]], same: bool, k: int):
        self.ids, self.labels, self.norms, self.q, self.same, self.k = ids, labels, norms, q, same, k
        n, w = len(ids), max((len(x) // 2 for x in limits), default=0)
        self.low, self.high = np.full((n, w), MOST), np.full((n, w), LEAST)  # a missing window takes nothing
        for i, x in enumerate(limits):
            self.low[i, : len(x) // 2], self.high[i, : len(x) // 2] = x[::2], x[1::2]
        self.score, self.best = np.full((n, w, k), LEAST), np.full((n, w, k), np.iinfo(np.int64).max)

    def meet(self, ids: np.ndarray, labels: np.ndarray, norms: np.ndarray, q: np.ndarray) -> None:
        """Compare rows of one bucket, in order of id, with the anchors that may need them."""
        longest = float(norms.max())
        reach = self.norms * longest * (1 + SLACK) + SLACK
        need = np.maximum(self.low, self.score[:, :, -1])
        live = np.flatnonzero(((reach[:, None] >= need) & (self.low <= self.high)).any(1))
        if not len(live):
            return
        s = _products(self.q[live], q, float(self.norms[live].max()) * longest)
        fits = (self.labels[live, None] == labels) & (self.ids[live, None] != ids) if self.same else self.labels[live, None] != labels
        for w in range(self.low.shape[1]):
            kth, last = self.score[live, w, -1, None], self.best[live, w, -1, None]
            hit = fits & (s >= self.low[live, w, None]) & (s <= self.high[live, w, None]) & ((s > kth) | (s == kth) & (ids < last))
            some = np.flatnonzero(hit.any(1))
            if len(some):
                self._take(live[some], w, np.where(hit[some], s[some], LEAST), ids)

    def _take(self, at: np.ndarray, w: int, s: np.ndarray, ids: np.ndarray) -> None:
        """Merge the k best of s (rows: anchors at; LEAST: no candidate) into window w."""
        k = min(self.k, s.shape[1])
        cut = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k, None]
        over, ties = s > cut, s == cut
        first = np.cumsum(ties, axis=1) <= k - over.sum(1, keepdims=True)  # of equal scores the smallest ids
        r, c = np.nonzero((over | ties & first) & (s > LEAST))
        row = np.concatenate([np.repeat(np.arange(len(at)), self.k), r])
        score = np.concatenate([self.score[at, w].ravel(), s[r, c]])
        name = np.concatenate([self.best[at, w].ravel(), ids[c]])
        order = np.lexsort((name, -score, row))
        start = np.searchsorted(row[order], np.arange(len(at)))
        pick = order[start[:, None] + np.arange(self.k)]
        self.score[at, w], self.best[at, w] = score[pick], name[pick]

    def found(self) -> pa.RecordBatch:
        a, w, j = np.nonzero(self.score > LEAST)
        cols = (self.ids[a], w.astype(np.int32), self.best[a, w, j], self.score[a, w, j])
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["anchor_id", "window", "vec_id", "score"])


def _compare(same: bool, k: int):
    """Streams sorted rows (block, share, kind, bucket, vec_id): a block's anchors (kind 0), then its candidates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, waiting, at = None, [], None
        for batch in batches:
            key = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("block", "share", "kind", "bucket")], 1)
            cut = np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1
            for lo, hi in zip([0, *cut], [*cut, len(key)]):
                if lo == hi:
                    continue
                part = batch.slice(lo, hi - lo)
                ids, labels, norms = (part.column(c).to_numpy() for c in ("vec_id", "label", "norm"))
                rows = (ids, labels, norms, _matrix(part.column("q")))
                if at != tuple(key[lo, :2]):
                    if block is not None:
                        yield block.found()
                    block, waiting, at = None, [], tuple(key[lo, :2])
                if key[lo, 2] == 0:
                    waiting.append((*rows, part.column("limits").to_pylist()))
                elif block is None and waiting:
                    block = _gather(waiting, same, k)
                if key[lo, 2] == 1 and block is not None:
                    block.meet(*rows)
        if block is not None:
            yield block.found()

    return run


def _gather(parts: list[tuple], same: bool, k: int) -> _Block:
    ids, labels, norms = (np.concatenate([p[i] for p in parts]) for i in range(3))
    wide = max(p[3].shape[1] for p in parts)
    q = np.concatenate([np.pad(p[3], ((0, 0), (0, wide - p[3].shape[1]))) for p in parts])
    return _Block(ids, labels, norms, q, [x for p in parts for x in p[4]], same, k)


def _search(rows: DataFrame, anchors: DataFrame, blocks: int, same: bool, k: int) -> DataFrame:
    """anchor_id, window, vec_id, score, r (rank): the best k rows of each window [limits[2w], limits[2w + 1]] of each anchor.

    With `same` the rows are those of the anchor's label (itself left out), else those of other labels.
    """
    shares = F.lit(SHARES)
    sent = anchors.withColumn("share", F.explode(F.sequence(F.lit(0), shares - 1))).withColumn("kind", F.lit(0)).withColumn("bucket", F.lit(-1).cast("bigint"))
    # the shortest row that may reach the smallest lower limit of some anchor of a block
    least = F.array_min(F.transform(F.filter(F.sequence(F.lit(0), F.size("limits") - 1), lambda i: i % 2 == 0), lambda i: F.get("limits", i)))
    shortest = F.when((least <= 0) | (F.col("norm") <= 0), 0.0).otherwise(least / F.col("norm"))
    needs = anchors.select("block", shortest.alias("t")).groupBy("block").agg(F.min("t").alias("t")).agg(F.collect_list(F.struct("block", "t")).alias("needs"))
    to = F.explode(F.filter("needs", lambda b: b["t"] <= F.col("norm") * (1 + SLACK) + SLACK))
    dealt = rows.crossJoin(F.broadcast(needs)).select("*", to.alias("b"))  # needs is one row
    # a bucket's id is its partition and its place there: neighbours go to different shares
    place = F.pmod(F.shiftright("bucket", 33 - BUCKET_BITS) + F.col("bucket").bitwiseAND((1 << 33 - BUCKET_BITS) - 1), shares).cast("int")
    dealt = dealt.select(F.col("b.block").alias("block"), place.alias("share"), F.lit(1).alias("kind"), "bucket", "norm", "vec_id", "label", "q", F.array().cast("array<bigint>").alias("limits"))
    both = sent.select(dealt.columns).unionByName(dealt).to(_schema(rows))
    keys = ("block", "share", "kind", "bucket", "vec_id")
    partial = both.repartition(blocks * SHARES, "block", "share").sortWithinPartitions(*keys).mapInArrow(_compare(same, k), FOUND)
    best = Window.partitionBy("anchor_id", "window").orderBy(F.desc("score"), "vec_id")
    return partial.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k)


def _schema(rows: DataFrame):
    return rows.sparkSession.createDataFrame([], ROW).schema


def hard_negatives(rows: DataFrame, is_anchor: Column, scratch: Scratch, positives: int = 5, negatives: int = 5, low: int = 80) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score over rows (vec_id, label, q).

    An anchor's positives are the best-scored other rows of its label. For each, the best
    rows of other labels follow whose score is at least `low` percent of the positive's
    score and not above it. Ties go to the smaller vec_id. A positive with a negative score
    has no such rows, nor has an anchor alone in its label; no anchors or no rows give none.
    """
    stored = bucketed(rows, scratch)
    blocks = max(1, -(-stored.where(is_anchor).count() // BLOCK))
    anchors = stored.where(is_anchor).drop("bucket").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
    everything = F.array(F.lit(LEAST + 1), F.lit(MOST)).cast("array<bigint>")
    found = _search(stored, anchors.withColumn("limits", everything), blocks, True, positives)
    pos = scratch.write(found.select("anchor_id", F.col("r").alias("window"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    p = F.col("positive_score")
    bottom = F.expr(f"(positive_score div 100) * {low} + cast(ceil((positive_score % 100) * {low} / 100) as bigint)")
    windows = pos.where(p >= 0).groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("window", bottom.alias("low"), p.alias("high")))).alias("w"))
    windows = windows.select(F.col("anchor_id").alias("vec_id"), F.flatten(F.transform("w", lambda x: F.array(x["low"], x["high"]))).alias("limits"))
    found = _search(stored, anchors.join(windows, "vec_id"), blocks, False, negatives)
    # scores of positives fall with their rank, so the windows of an anchor are its first ones
    out = found.withColumn("window", F.col("window") + 1).join(pos, ["anchor_id", "window"])
    return out.select("anchor_id", "positive_id", F.col("r").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


ORACLE = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id AS other_id, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), p AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id)::INT AS rank,
  other_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
QUALIFY rank <= 5
"""
