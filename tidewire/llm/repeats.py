"""Repeated substrings over a corpus, by sparse enhanced suffix arrays, and their removal.

Suffixes are kept only at anchors: winnowing takes the smallest hash of GRAM bytes in
every string of `length` bytes, so equal strings hold the same anchor at the same offset,
and an anchor that occurs once can be dropped. Each remaining anchor carries the bytes
around it that a string of `length` bytes holding it can reach. The anchors of one hash
are sorted by the bytes to their right (a suffix array), neighbours' common prefixes are
taken, and a stack scan gives the tree of common-prefix intervals. In every interval the
same is done with the bytes to the left: where members' left extensions differ, the group
can't be extended to the left, and if left and right part together reach `length` it is a
maximal repeat with all its occurrences.

Anchors that occur in very many places must not meet in one task. Of their suffixes only
the nodes of depth `length` are needed (who shares a whole string with an earlier one),
and those are formed without sorting: suffixes are grouped by their first `length` bytes,
a group is reduced to its first occurrence before it is shuffled, and the firsts of crowded
groups are joined by broadcast, so no task gets a crowded group whole.

Texts that equal an earlier one as a whole are set aside before; they are repeats from
end to end.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import _BYTE, _P, Scratch, _pow, chunks, few, join_crowded, mix, text_or_empty, with_ids

LENGTH = 100
GRAM = 32
#: Suffixes of anchors that occur more often are grouped by whole strings, spread over tasks.
HOT = 50_000
_POS = 30
_SALT = np.uint64(0xA0761D6478BD642F)


def anchors(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document index, position in it, hash) of the winnowed anchors of the concatenated texts."""
    n, width = len(data), length - GRAM + 1
    if n < length:
        z = np.zeros(0, np.int64)
        return z, z, z.astype(np.uint64)
    up, down = _pow(n + 1)
    s = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[:-1], out=s[1:])
    h = mix((s[GRAM:] - s[:-GRAM]) * down[: n - GRAM + 1])
    # smallest of each run of `width`, the rightmost of equals: hash above, mirrored position below
    low = (h >> np.uint64(_POS) << np.uint64(_POS)) | (np.uint64((1 << _POS) - 1) - np.arange(len(h), dtype=np.uint64))
    span = 1
    while span * 2 <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < width:
        low = np.minimum(low[: len(low) - (width - span)], low[width - span :])
    at = (np.uint64((1 << _POS) - 1) - (low & np.uint64((1 << _POS) - 1))).astype(np.int64)
    start = np.arange(len(at))
    doc = np.searchsorted(offsets, start, side="right") - 1
    ok = start + length <= offsets[doc + 1]
    at, doc = at[ok], doc[ok]
    if not len(at):
        return at, at, h[:0]
    new = np.concatenate(([True], at[1:] != at[:-1]))
    at, doc = at[new], doc[new]
    return doc, at - offsets[doc], h[at]


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, offs in chunks(batch, "text"):
            doc, at, h = anchors(data, offs)
            ids = batch.column("doc_id").slice(lo, hi - lo).take(pa.array(doc))
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), ids, pa.array(at.astype(np.int32))], names=["key", "doc_id", "pos"])


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = batch.column("at").to_pylist()
        for lo, hi, data, offs in chunks(batch, "text"):
            out: list[tuple] = []
            for d in range(hi - lo):
                raw, doc = data[offs[d] : offs[d + 1]].tobytes(), batch.column("doc_id")[lo + d]
                for x in at[lo + d]:
                    p = x["pos"]
                    out.append((x["key"], x["n"], doc, p, raw[max(0, p - LENGTH + GRAM) : p], raw[p : p + LENGTH]))
            for i in range(0, len(out), 20_000):
                key, n, doc, pos, left, right = zip(*out[i : i + 20_000])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(key, pa.int64()), pa.array(n, pa.int64()), pa.array([x.as_py() for x in doc], pa.int64()),
                        pa.array(pos, pa.int32()), pa.array(left, pa.binary()), pa.array(right, pa.binary()),
                    ],
                    names=["key", "n", "doc_id", "pos", "lhs", "rhs"],
                )


# ---------------------------------------------------------------- the suffix array of one anchor hash


def intervals(lcp: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """(common length, first, last) of every common-prefix interval of at least `least`, by one stack scan.

    lcp[i] is the common length of neighbours i and i + 1.
    """
    stack: list[tuple[int, int]] = []
    for i, x in enumerate([*lcp.tolist(), -1]):
        first = i
        while stack and stack[-1][0] > x:
            depth, first = stack.pop()
            yield depth, first, i
        if x >= least and (not stack or stack[-1][0] < x):
            stack.append((x, first))


def _matrix(values: list[bytes], width: int, mirrored: bool) -> tuple[np.ndarray, np.ndarray]:
    size = np.array([len(v) for v in values], np.int64)
    joined = b"".join(v[::-1].ljust(width, b"\0") if mirrored else v.ljust(width, b"\0") for v in values)
    return np.frombuffer(joined, np.uint8).reshape(len(values), width), size


def _common(m: np.ndarray, size: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of rows a[i] and b[i]."""
    differ = m[a] != m[b]
    first = np.where(differ.any(1), differ.argmax(1), m.shape[1])
    return np.minimum(first, np.minimum(size[a], size[b]))


def maximal_repeats(
    lefts: list[bytes], rights: list[bytes], length: int = LENGTH
) -> Iterator[tuple[int, int, np.ndarray]]:
    """(left length, right length, members) of each maximal repeat among the contexts of one anchor hash."""
    r, rs = _matrix(rights, length, False)
    # Padding sorts like the byte 0, so equal padded rows go by their length: a prefix comes first.
    order = np.lexsort((rs, np.ascontiguousarray(r).view(f"S{length}").ravel()))
    lcp = _common(r, rs, order[:-1], order[1:])
    width = length - GRAM
    m, ms = _matrix(lefts, width, True)
    text = np.ascontiguousarray(m).view(f"S{width}").ravel()
    rank = np.empty(len(lefts), np.int64)
    rank[np.lexsort((ms, text))] = np.arange(len(lefts))
    for right, lo, hi in intervals(lcp, GRAM):
        members = order[lo : hi + 1]
        members = members[np.argsort(rank[members])]
        around = _common(m, ms, members[:-1], members[1:])
        for left, i, j in intervals(around, max(0, length - right)):
            yield left, right, members[i : j + 1]


def covered(
    key: np.ndarray, doc: np.ndarray, pos: np.ndarray, lefts: list[bytes], rights: list[bytes], length: int = LENGTH
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of what rows sorted by (key, doc, pos) repeat of earlier rows of their key."""
    cut = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
    rows, start, end = [], [], []
    pairs = cut[:-1][np.diff(cut) == 2]  # by far the most frequent case, all at once
    if len(pairs):
        both = np.stack((pairs, pairs + 1), 1).ravel()
        m, ms = _matrix([lefts[i] for i in both], length - GRAM, True)
        r, rs = _matrix([rights[i] for i in both], length, False)
        a, b = np.arange(0, len(both), 2), np.arange(1, len(both), 2)
        left, right = _common(m, ms, a, b), _common(r, rs, a, b)
        ok = left + right >= length
        rows.append(pairs[ok] + 1)
        start.append(pos[pairs[ok] + 1] - left[ok])
        end.append(pos[pairs[ok] + 1] + right[ok])
    for lo, hi in zip(cut[:-1], cut[1:]):
        if hi - lo <= 2:
            continue
        # Equal contexts are one; all but the first repeat it from end to end.
        seen: dict[tuple[bytes, bytes], int] = {}
        again = []
        for i in range(lo, hi):
            if seen.setdefault((lefts[i], rights[i]), i) != i and len(lefts[i]) + len(rights[i]) >= length:
                again.append(i)
        if again:
            g = np.array(again)
            rows.append(g)
            start.append(pos[g] - np.array([len(lefts[i]) for i in again]))
            end.append(pos[g] + np.array([len(rights[i]) for i in again]))
        if len(seen) < 2:
            continue
        own = np.array(list(seen.values()))
        best: dict[tuple[int, int], int] = {}
        for left, right, members in maximal_repeats([lefts[i] for i in own], [rights[i] for i in own], length):
            later = own[members]
            for i in later[later != later.min()].tolist():  # rows are in order of (doc, pos)
                if best.get((i, right), -1) < left:
                    best[i, right] = left
        if best:
            g = np.array([(i, left, right) for (i, right), left in best.items()])
            rows.append(g[:, 0])
            start.append(pos[g[:, 0]] - g[:, 1])
            end.append(pos[g[:, 0]] + g[:, 2])
    z = np.zeros(0, np.int64)
    return (np.concatenate(rows), np.concatenate(start), np.concatenate(end)) if rows else (z, z, z)


def _cover_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads rows sorted by key; a key that a batch ends with is carried to the next."""

    def give(t: pa.Table) -> pa.RecordBatch:
        doc, pos = t["doc_id"].to_numpy(), t["pos"].to_numpy().astype(np.int64)
        row, s, e = covered(t["key"].to_numpy(), doc, pos, t["lhs"].to_pylist(), t["rhs"].to_pylist())
        return pa.RecordBatch.from_arrays([pa.array(doc[row]), pa.array(s), pa.array(e)], names=["doc_id", "s", "e"])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        key = batch.column("key").to_numpy()
        edge = int(np.flatnonzero(key != key[-1])[-1]) + 1 if key[0] != key[-1] else 0
        if edge or (held and held[-1].column("key")[0].as_py() != int(key[0])):
            yield give(pa.Table.from_batches([*held, batch.slice(0, edge)]))
            held = []
        held.append(batch.slice(edge))
    if held:
        yield give(pa.Table.from_batches(held))


def _string_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Two hashes of every string of LENGTH bytes around the anchors, once for each place (in a batch) where it starts."""
    for batch in batches:
        doc, pos = batch.column("doc_id").to_numpy(), batch.column("pos").to_numpy().astype(np.int64)
        out: list[tuple[np.ndarray, ...]] = []
        for i, (left, right) in enumerate(zip(batch.column("lhs").to_pylist(), batch.column("rhs").to_pylist())):
            b = np.frombuffer(left + right, np.uint8)
            n = len(b) - LENGTH + 1
            if n <= 0:
                continue
            up, down = _pow(len(b) + 1)
            two = []
            for salt in (np.uint64(0), _SALT):
                s = np.zeros(len(b) + 1, np.uint64)
                np.cumsum(mix(_BYTE[b] ^ salt) * up[:-1], out=s[1:])
                two.append(mix((s[LENGTH:] - s[:n]) * down[:n]).view(np.int64))
            out.append((two[0], two[1], np.full(n, doc[i]), pos[i] - len(left) + np.arange(n)))
        if out:
            cols = [np.concatenate(c) for c in zip(*out)]
            order = np.lexsort((cols[0], cols[3], cols[2]))  # the places of one string around several anchors are the same
            cols = [c[order] for c in cols]
            new = np.concatenate(([True], (cols[0][1:] != cols[0][:-1]) | (cols[3][1:] != cols[3][:-1]) | (cols[2][1:] != cols[2][:-1])))
            yield pa.RecordBatch.from_arrays([pa.array(c[new]) for c in cols], names=["k1", "k2", "doc_id", "s"])


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans, whole = batch.column("spans").to_pylist(), batch.column("copy").to_pylist()
        out = []
        for i, t in enumerate(batch.column("text")):
            raw = t.as_buffer().to_pybytes() if t.is_valid else b""
            runs = [(0, len(raw))] if whole[i] else [(x["s"], x["e"]) for x in sorted(spans[i] or [], key=lambda x: x["s"])]
            kept, last = hashlib.sha256(), 0
            for s, e in runs:
                kept.update(raw[last:s])
                last = e
            kept.update(raw[last:])
            out.append((len(raw), sum(e - s for s, e in runs), len(runs), kept.hexdigest()))
        cols = list(zip(*out)) or [(), (), (), ()]
        types = (pa.int64(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *[pa.array(c, t) for c, t in zip(cols, types)]],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
        )


def repeated_spans(docs: DataFrame, scratch: Scratch, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """(doc_id, spans) of bytes that repeat an earlier string of LENGTH bytes, and doc_id of texts that equal an earlier one."""
    d = docs.where(F.col("doc_id").isNotNull()).select("doc_id", text_or_empty().alias("text"))
    long = d.where(F.octet_length("text") >= LENGTH)
    ids = scratch.write(long.select("doc_id", F.md5(F.col("text").cast("binary")).alias("t")).distinct(), "texts")
    heads = ids.groupBy("t").agg(F.min("doc_id").alias("head"), F.count("*").alias("times")).where("times > 1")
    copies = scratch.write(join_crowded(ids, scratch.write(heads, "heads"), ["t"]).where("doc_id > head").select("doc_id").distinct(), "copies")
    rest = with_ids(long, copies, "doc_id", keep=False)
    rows = rest.mapInArrow(_anchor_rows, "key bigint, doc_id bigint, pos int")
    rows = scratch.write(rows, "anchors")
    times = scratch.write(rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "times")
    met = scratch.write(join_crowded(rows, times, ["key"], "n").select("key", "doc_id", "pos", "n"), "met")
    scratch.drop(rows)
    by_doc = met.groupBy("doc_id").agg(F.collect_set(F.struct("key", "n", "pos")).alias("at"))
    around = rest.join(by_doc, "doc_id").mapInArrow(
        _contexts, "key bigint, n bigint, doc_id bigint, pos int, lhs binary, rhs binary"
    )
    around = scratch.write(around, "around")
    cold = around.where(F.col("n") <= hot).drop("n").repartition("key").sortWithinPartitions("key", "doc_id", "pos")
    covers = cold.mapInArrow(_cover_rows, "doc_id bigint, s bigint, e bigint")
    crowded = around.where(F.col("n") > hot)
    if not crowded.isEmpty():
        strings = scratch.write(crowded.mapInArrow(_string_rows, "k1 bigint, k2 bigint, doc_id bigint, s bigint"), "strings")
        place = F.struct("doc_id", "s")
        first = strings.groupBy("k1", "k2").agg(F.min(place).alias("first"), F.count("*").alias("times")).where("times > 1")
        first = scratch.write(first, "firsts")
        later = join_crowded(strings, first, ["k1", "k2"]).where(place > F.col("first"))
        covers = covers.unionByName(later.select("doc_id", "s", (F.col("s") + LENGTH).alias("e")))
    # Overlapping and touching covers become runs.
    w = Window.partitionBy("doc_id").orderBy("s", "e")
    before = F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    c = covers.groupBy("doc_id", "s").agg(F.max("e").alias("e")).withColumn("new", F.coalesce((F.col("s") > before).cast("int"), F.lit(1)))
    runs = c.withColumn("run", F.sum("new").over(w)).groupBy("doc_id", "run").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    spans = runs.groupBy("doc_id").agg(F.collect_list(F.struct("s", "e")).alias("spans"))
    return scratch.write(spans, "spans"), copies


def dedup_substrings(docs: DataFrame, scratch: Scratch, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 per row of docs.

    A byte goes if a string of LENGTH bytes that covers it also starts earlier (smaller
    doc_id, or the same document). A null text is empty; rows with a null doc_id have no
    place in the order and stay whole. Repeated rows are one document: they don't repeat
    each other. Rows that share a doc_id but not the text are taken as one document each
    whose strings start at the same places. Empty tables give no rows; other columns are ignored.
    """
    spans, copies = repeated_spans(docs, scratch, hot)
    d = docs.select("doc_id", "text")
    whole = few(copies.withColumn("copy", F.lit(True)), 9)
    d = d.join(whole, "doc_id", "left").join(few(spans, 16 + 32 * F.size("spans")), "doc_id", "left")
    d = d.select("doc_id", "text", "spans", F.coalesce("copy", F.lit(False)).alias("copy"))
    return d.mapInArrow(_finish, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")
