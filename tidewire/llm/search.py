"""Ranked lexical search, score at a time over impact-ordered postings.

The first pass reduces each text to its length and its counts of the items' terms; corpus
statistics are counted from those. In the second pass each task sorts the postings of a
shard of documents by term and falling impact, so that equal impacts lie together. For an
item it adds up runs of impacts, highest contribution first, until the sum of what each
term can still contribute proves that only few documents can reach the kth score so far
(that of earlier shards of the task included); those few are then scored completely from
their own counts. Each task hands on its best k per item, which are ranked at the end.

Terms are compared by 64-bit hashes of their bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import _LOWER, BROADCAST_BYTES, ROW_BYTES, Scratch, chunks, hash_spans, text_or_empty, word_spans

#: Bytes that are no part of a term: ASCII other than letters and digits.
_GAP = np.ones(256, bool)
_GAP[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
K = 20
#: A shard is scored once it has so many postings or documents.
SHARD_POSTINGS, SHARD_DOCS = 1 << 21, 1 << 15
#: A run takes the impacts down to this part of the highest contribution left.
RUN = 0.75
#: Documents that are scored completely once no other can be among the best: at most FEW * k.
FEW = 4
#: Groups in which the tasks' results for an item are ranked first.
SALT = 64


def _terms(names: tuple[str, str], vocabulary: np.ndarray | None = None):
    """Per row: how many terms its text has, and the distinct ones (of the vocabulary, as positions; else all, as hashes) with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = None if vocabulary is None else vocabulary.value
        for batch in batches:
            for lo, hi, data, offs in chunks(batch, "text"):
                low = _LOWER[data]
                start, end, doc = word_spans(low, offs, _GAP)
                h = hash_spans(low, start, end)
                n = np.bincount(doc, minlength=hi - lo)
                if vocab is not None:
                    at = np.minimum(np.searchsorted(vocab, h), max(0, len(vocab) - 1))
                    known = vocab[at] == h if len(vocab) else np.zeros(len(h), bool)
                    h, doc = at[known], doc[known]
                order = np.lexsort((h, doc))
                h, doc = h[order], doc[order]
                new = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])))) if len(h) else np.zeros(0, np.int64)
                bounds = np.searchsorted(doc[new], np.arange(hi - lo + 1)).astype(np.int32)
                lists = (h[new].astype(np.int64), np.diff(np.append(new, len(h))))
                cols = [batch.column(names[0]).slice(lo, hi - lo), pa.array(n)]
                yield pa.RecordBatch.from_arrays(cols + [pa.ListArray.from_arrays(bounds, pa.array(x)) for x in lists], names=[names[0], "n", "terms", "counts"])

    return run


class _Shard:
    """Postings of some documents, by document and by term with falling impact."""

    def __init__(self, ids: np.ndarray, n: np.ndarray, size: np.ndarray, term: np.ndarray, tf: np.ndarray, total: int, length: int, vocabulary: int):
        m = 75 + (25 * n * total) // length
        self.ids, self.doc, self.term = ids, np.repeat(np.arange(len(ids)), size), term
        self.impact = (1_000_000_000 * tf) // (1000 * tf + 12 * m[self.doc])
        self.start = np.concatenate(([0], np.cumsum(size)))
        order = np.lexsort((-self.impact, term))
        self.by_term, self.falling = self.doc[order], -self.impact[order]  # negated: ascending, as searchsorted wants it
        self.first = np.searchsorted(term[order], np.arange(vocabulary + 1))

    def best(self, terms: np.ndarray, weight: np.ndarray, floor: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(scores, ids) of the documents with positive scores that may be among the best k; floor: a score the kth has already."""
        acc = np.zeros(len(self.ids), np.int64)
        at, end = self.first[terms].copy(), self.first[terms + 1]
        while True:
            left = np.where(at < end, -self.falling[np.minimum(at, len(self.falling) - 1)] * weight, 0) if len(self.falling) else np.zeros(len(terms), np.int64)
            kth = floor
            if len(acc) >= k:
                kth = max(kth, int(np.partition(acc, len(acc) - k)[len(acc) - k]))
            top = int(left.max(initial=0))
            may = np.flatnonzero((acc + left.sum() >= kth) & (acc + left.sum() > 0))
            if top == 0:  # nothing left to add
                return acc[may], self.ids[may]
            if len(may) <= FEW * k:
                return self._complete(may, terms, weight), self.ids[may]
            for j in np.flatnonzero(left >= top * RUN):
                a, b, w = at[j], end[j], weight[j]
                to = a + np.searchsorted(self.falling[a:b], -(-(-int(top * RUN) // w)), side="right")
                to = max(to, a + np.searchsorted(self.falling[a:b], self.falling[a], side="right"))  # a whole group of equal impacts at least
                acc[self.by_term[a:to]] -= self.falling[a:to] * w
                at[j] = to

    def _complete(self, docs: np.ndarray, terms: np.ndarray, weight: np.ndarray) -> np.ndarray:
        out = np.zeros(len(docs), np.int64)
        for i, d in enumerate(docs):
            own = slice(self.start[d], self.start[d + 1])
            _, x, y = np.intersect1d(self.term[own], terms, assume_unique=True, return_indices=True)
            out[i] = (self.impact[own][x] * weight[y]).sum()
        return out


def _rank(items: object, total: int, length: int, k: int):
    """Best k documents per item of each task: item_id, doc_id, score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, starts, terms, weights, vocabulary = items.value
        ids = [np.zeros(0, np.int64) for _ in names]
        scores = [np.zeros(0, np.int64) for _ in names]

        def add(parts: list[tuple]) -> None:
            shard = _Shard(*(np.concatenate([p[i] for p in parts]) for i in range(5)), total, length, vocabulary)
            for i in range(len(names)):
                own = slice(starts[i], starts[i + 1])
                kth = int(scores[i][k - 1]) if len(scores[i]) == k else 1
                s, d = shard.best(terms[own], weights[own], kth, k)
                s, d = np.concatenate([scores[i], s]), np.concatenate([ids[i], d])
                order = np.lexsort((d, -s))[:k]
                order = order[s[order] > 0]
                scores[i], ids[i] = s[order], d[order]

        parts, postings, docs = [], 0, 0
        for batch in batches:
            lists = [batch.column(c) for c in ("terms", "counts")]
            offs = lists[0].offsets.to_numpy()
            flat = [x.values.to_numpy()[offs[0] : offs[-1]] for x in lists]
            parts.append((batch.column("doc_id").to_numpy(), batch.column("n").to_numpy(), np.diff(offs), *flat))
            postings, docs = postings + len(flat[0]), docs + len(batch)
            if postings >= SHARD_POSTINGS or docs >= SHARD_DOCS:
                add(parts)
                parts, postings, docs = [], 0, 0
        if docs:
            add(parts)
        for i, name in enumerate(names):
            cols = [pa.array(np.full(len(ids[i]), name)), pa.array(ids[i]), pa.array(scores[i])]
            yield pa.RecordBatch.from_arrays(cols, names=["item_id", "doc_id", "score"])

    return run


def _of_block(docs: DataFrame, items: DataFrame, scratch: Scratch, k: int) -> DataFrame:
    """item_id, doc_id, score: the best k documents per item of each task, for items that fit into memory."""
    spark = docs.sparkSession
    asked = items.mapInArrow(_terms(("item_id", "text")), "item_id bigint, n bigint, terms array<bigint>, counts array<bigint>").where("n > 0").orderBy("item_id").collect()
    vocab = np.unique(np.array([t for r in asked for t in r.terms], np.int64).astype(np.uint64))
    shared = spark.sparkContext.broadcast(vocab)
    read = docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(_terms(("doc_id", "text"), shared), "doc_id bigint, n bigint, terms array<bigint>, counts array<bigint>")
    posts = scratch.write(read.where("n > 0").select("doc_id", "n", F.col("terms").cast("array<int>"), F.col("counts").cast("array<int>")), "postings")
    total, length = posts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(1))).first()
    df = posts.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    w = F.floor(1000 * F.ln((2.0 * total + 2) / (2.0 * F.col("df") + 1))).cast("bigint")
    weight = np.zeros(len(vocab), np.int64)
    for r in df.select("term", w.alias("w")).collect():  # at most the terms of the items
        weight[r.term] = r.w
    terms = [np.searchsorted(vocab, np.array(r.terms, np.int64).astype(np.uint64)) for r in asked]
    weights = [weight[t] * np.array(r.counts, np.int64) for t, r in zip(terms, asked)]
    keep = [w > 0 for w in weights]
    starts = np.concatenate(([0], np.cumsum([x.sum() for x in keep]))).astype(np.int64)
    flat = lambda parts: np.concatenate([x[y] for x, y in zip(parts, keep)]) if parts else np.zeros(0, np.int64)
    sent = spark.sparkContext.broadcast(([r.item_id for r in asked], starts, flat(terms), flat(weights), len(vocab)))
    ranked_ = posts.where(F.col("doc_id").isNotNull()).select("doc_id", "n", F.col("terms").cast("array<bigint>"), F.col("counts").cast("array<bigint>"))
    return ranked_.mapInArrow(_rank(sent, total, length, k), "item_id bigint, doc_id bigint, score bigint")


def ranked(docs: DataFrame, items: DataFrame, scratch: Scratch, k: int = K, most: int = BROADCAST_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: the best k documents with a score above 0 for each item, ties by ascending doc_id.

    Items are asked in blocks whose texts and terms take at most `most` bytes by a hash of
    item_id (one item is never split), each with a pass over docs. A null or empty text, of
    a document or an item, has no term; an item without terms, or whose terms are in no
    document, has no rows. Repeated rows of documents are documents of their own, each
    counted and ranked (equal in score and doc_id, so in either order). A document without
    doc_id counts but isn't ranked. Of several texts of an item_id the smallest is asked; an item
    without item_id isn't. Other columns are ignored. Empty tables give no rows.
    """
    asked = items.where(F.col("item_id").isNotNull()).groupBy("item_id").agg(F.min("text").alias("text"))
    size = asked.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) * 8 + ROW_BYTES)).first()[0] or 0
    blocks = -(-size // most)
    out = None
    for b in range(blocks):
        of = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b)
        part = _of_block(docs, of, scratch, k)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return docs.sparkSession.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    order = (F.desc("score"), "doc_id")
    first = Window.partitionBy("item_id", "salt").orderBy(*order)
    out = out.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALT))).withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)
    best = Window.partitionBy("item_id").orderBy(*order)
    return out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


ORACLE = r"""
WITH t AS (
  SELECT r, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT row_number() OVER () AS r, doc_id, text FROM documents)
), tf AS (SELECT r, doc_id, term, count(*) AS tf FROM t GROUP BY ALL
), len AS (SELECT r, count(*) AS n FROM t GROUP BY r
), g AS (SELECT count(*) AS big_n, sum(n)::BIGINT AS big_l FROM len
), w AS (SELECT term, floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, g GROUP BY term, big_n
), m AS (SELECT r, 75 + (25 * n * big_n) // big_l AS m FROM len, g
), q AS (
  SELECT item_id, term, count(*) AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
  ) GROUP BY ALL
), s AS (
  SELECT item_id, r, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
  FROM q JOIN w USING (term) JOIN tf USING (term) JOIN m USING (r) GROUP BY ALL
)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY rank <= 20
"""
