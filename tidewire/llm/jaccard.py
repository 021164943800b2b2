"""N-gram Jaccard join by parity sketches.

A document's shingle set is hashed into a sketch of K 64-bit words: each shingle is XORed
into the word that its hash selects. A shingle that only one of two sets holds changes one
word, so the number of unequal words (the sketches' Hamming distance) is at most the
symmetric difference D, and sets with Jaccard similarity J have D <= (1-J)/(1+J) (|A|+|B|).

Pigeonhole: two sketches of K words that differ in at most D words share at least one of
the D + 1 words that come first in any order of (place, word) that both follow. The order
taken puts words made of many shingles first (they are the rarest) and empty ones last.
K follows from the size band; a document near its band's upper end is also sketched for
the next band, so every pair of compatible sizes meets in one band. No link is lost;
every candidate pair is verified on the whole sets.

The order may be any that all documents follow. So keys that occur in over HOT documents
(a licence sentence, say) move to its end, and the documents that had them take rarer
words of their own instead. Only a document with no more than D rare words keeps a hot
key: its sketch is then almost wholly made of words that many documents share.

Equal sets are one vertex. Documents that share a key are not paired with each other.
Each is first verified against the smallest document it shares a key with (its hub), and
components are taken. Only where the documents around a hub still lie in several
components, those outside the largest are compared with all of them: block against block
inside tasks, by parity bit sketches (one toggled bit per shingle, so their Hamming
distance is at most D, too). Only pairs that pass become rows, to be verified on the sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, chunks, join_crowded, mix, shingle_sets, with_ids
from .graph import components

WORDS = 5
PCT = 80
#: Sizes [BAND^i, BAND^(i+1)) form a band.
BAND = 4
#: Documents in a block of the block-against-block comparison.
BLOCK = 2048
#: Keys in more documents than this go last in every document's order.
HOT = 1000
#: How often the order is revised: rarer words may prove to be hot in turn.
REVISIONS = 2
_SEED = np.uint64(0xD6E8FEB86659FD93)


def largest_difference(a: int, b: int, pct: int = PCT) -> int:
    """Most elements in which sets of these sizes can differ at the threshold."""
    return a + b - 2 * (-(-pct * (a + b) // (100 + pct)))


def most_keys(n: int, largest: int, pct: int = PCT) -> int:
    """One more than the most differences of a set of n to any partner of at most `largest` elements.

    largest_difference grows in steps of two elements but not of one, so a partner one
    smaller than the largest can differ in more.
    """
    return max(largest_difference(n, b, pct) for b in (largest - 1, largest)) + 1


def band_orders(hashes: np.ndarray, pct: int = PCT) -> list[tuple[int, int, np.ndarray]]:
    """(upper end of the band, keys to keep, all keys in order) of a set (sorted distinct hashes): its band and, near the upper end, the next."""
    n = len(hashes)
    if not n:
        return []
    partner = 100 * n // pct
    top = BAND
    while top <= n:
        top *= BAND
    h2 = mix(hashes ^ _SEED)
    out = []
    for upper in (top, top * BAND) if partner >= top else (top,):
        k = max(8, upper * (100 - pct) // pct + 1)
        keep = most_keys(n, min(partner, upper - 1), pct)
        place = (hashes >> np.uint64(33)) % np.uint64(k)
        order = np.argsort(place, kind="stable")
        p = place[order]
        at = np.flatnonzero(np.concatenate(([True], p[1:] != p[:-1])))
        word, used = np.bitwise_xor.reduceat(h2[order], at), p[at]
        count = np.diff(np.append(at, n))
        tag = np.uint64(upper * 0x9E3779B97F4A7C15 % 2**64)
        key = mix(word ^ mix(used + tag))
        empty = np.setdiff1d(np.arange(k, dtype=np.uint64), used, assume_unique=True)  # they follow, in order of place
        out.append((upper, keep, np.concatenate((key[np.lexsort((key, -count))], mix(mix(empty + tag))))))
    return out


def band_keys(hashes: np.ndarray, pct: int = PCT) -> np.ndarray:
    """The keys that a set keeps while no key is known to be hot."""
    return np.concatenate([np.zeros(0, np.uint64), *(key[:keep] for _, keep, key in band_orders(hashes, pct))])


def _lists(values: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(v) for v in values]))).astype(np.int32)
    flat = np.concatenate(values).view(np.int64) if values else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, offs in chunks(batch, "text"):
            sets = list(shingle_sets(data, offs, WORDS))
            prints = np.zeros((len(sets), 2), np.uint64)
            for i, s in enumerate(sets):
                prints[i] = mix(s).sum(dtype=np.uint64), mix(s ^ _SEED).sum(dtype=np.uint64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").slice(lo, hi - lo),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(prints[:, 0].view(np.int64)),
                    pa.array(prints[:, 1].view(np.int64)),
                    _lists([band_keys(s) for s in sets]),
                ],
                names=["doc_id", "n_shingles", "f1", "f2", "keys"],
            )


def _orders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, offs in chunks(batch, "text"):
            ids = batch.column("doc_id").slice(lo, hi - lo)
            rows = [(i, mix(s).sum(dtype=np.uint64), *o) for i, s in enumerate(shingle_sets(data, offs, WORDS)) for o in band_orders(s)]
            at, f1, upper, keep, keys = ([r[k] for r in rows] for k in range(5))
            yield pa.RecordBatch.from_arrays(
                [
                    ids.take(pa.array(at, pa.int64())),
                    pa.array(np.array(f1, np.uint64).view(np.int64)),
                    pa.array(upper, pa.int64()),
                    pa.array(keep, pa.int32()),
                    _lists(keys),
                ],
                names=["doc", "f1", "upper", "keep", "keys"],
            )


def bit_sketch(hashes: np.ndarray) -> np.ndarray:
    """64-bit words of a parity sketch of 4 to 16 bits per element; a power of two, so longer ones fold onto shorter ones by XOR."""
    n = 64
    while n < 4 * len(hashes):
        n *= BAND
    odd = np.bincount((hashes & np.uint64(n - 1)).astype(np.int64), minlength=n) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, offs in chunks(batch, "text"):
            sets = list(shingle_sets(data, offs, WORDS))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").slice(lo, hi - lo),
                    pa.array([len(x) for x in sets], pa.int64()),
                    pa.array([x.tobytes() for x in sets], pa.binary()),
                    pa.array([bit_sketch(x).tobytes() for x in sets], pa.binary()),
                ],
                names=["doc_id", "n", "s", "bits"],
            )


def _folded(values: list[bytes], words: int) -> np.ndarray:
    out = np.zeros((len(values), words), np.uint64)
    for i, v in enumerate(values):
        out[i] = np.bitwise_xor.reduce(np.frombuffer(v, np.uint64).reshape(-1, words), axis=0)
    return out


def _near_blocks(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (outer document, inner document) of one block pair whose sketches and sizes allow the threshold."""
    outer = rows["outer"].to_numpy(zero_copy_only=False)
    doc, c, n, bits = (rows[x].to_numpy(zero_copy_only=False) for x in ("doc", "c", "n", "bits"))
    o, m = np.flatnonzero(outer), np.flatnonzero(~outer)
    z = np.zeros(0, np.int64)
    if not len(o) or not len(m):
        return z, z
    words = min(len(x) for x in bits) // 8
    x, y = _folded(list(bits[o]), words), _folded(list(bits[m]), words)
    left, right = [z], [z]
    step = max(1, (1 << 21) // (len(m) * words))
    for i in range(0, len(o), step):
        part = o[i : i + step]
        apart = np.bitwise_count(x[i : i + step, None, :] ^ y[None, :, :]).sum(2, dtype=np.int64)
        total = n[part][:, None] + n[m][None, :]
        ok = (apart <= total - 2 * (-(-PCT * total // (100 + PCT)))) & (c[part][:, None] != c[m][None, :])
        a, b = np.nonzero(ok)
        left.append(doc[part][a])
        right.append(doc[m][b])
    return np.concatenate(left), np.concatenate(right)


def _block_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads rows sorted by (hub, sb, mb, lb); what a batch ends with is carried to the next."""

    def give(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(parts)
        key = np.stack([t[k].to_numpy() for k in ("hub", "sb", "mb", "lb")], 1)
        cut = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]).any(1), [True])))
        found = [_near_blocks(t.slice(i, j - i)) for i, j in zip(cut[:-1], cut[1:])]
        a, b = (np.concatenate([f[k] for f in found]) for k in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        key = np.stack([batch.column(k).to_numpy() for k in ("hub", "sb", "mb", "lb")], 1)
        other = np.flatnonzero((key != key[-1]).any(1))
        edge = int(other[-1]) + 1 if len(other) else 0
        before = [held[-1].column(k)[0].as_py() for k in ("hub", "sb", "mb", "lb")] if held else None
        if edge or (held and before != key[0].tolist()):
            yield give([*held, batch.slice(0, edge)])
            held = []
        held.append(batch.slice(edge))
    if held:
        yield give(held)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ok = []
        for x, y in zip(batch.column("sa"), batch.column("sb")):
            u, v = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            small, large = (u, v) if len(u) <= len(v) else (v, u)
            if 100 * len(small) < PCT * len(large) or not len(small):
                ok.append(False)
                continue
            at = np.searchsorted(large, small)
            at[at == len(large)] = 0
            both = int((large[at] == small).sum())
            ok.append(100 * both >= PCT * (len(u) + len(v) - both))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(ok, pa.bool_())], names=["a", "b", "ok"])


def _verified(pairs: DataFrame, sets: DataFrame, scratch: Scratch) -> DataFrame:
    """The pairs (a, b) whose whole sets reach the threshold."""
    both = pairs.join(sets.select(F.col("doc_id").alias("b"), F.col("s").alias("sb")), "b")
    both = both.join(sets.select(F.col("doc_id").alias("a"), F.col("s").alias("sa")), "a")
    return scratch.write(both.mapInArrow(_verify, "a bigint, b bigint, ok boolean").where("ok").select("a", "b").distinct(), "links")


def _counted(keyed: DataFrame, scratch: Scratch) -> DataFrame:
    return scratch.write(keyed.groupBy("key").agg(F.count("*").alias("times")).where("times > 1"), "times")


def _rarest(d: DataFrame, one: DataFrame, scratch: Scratch, hot: int, revisions: int) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """The keys (key, doc) of all documents, with hot ones last in every order, how often each key occurs, and pairs (a, b).

    The pairs join every holder of hot keys with the smallest holder of one of them: one pair a
    document and revision, which links most near copies before blocks are compared.

    Every document that holds a hot key takes its keys anew from its whole order; the keys
    of all others stand before the hot ones in any case, so all follow one order.
    """
    first = one.select("doc_id", "keys")
    keyed = first.select(F.explode("keys").alias("key"), F.col("doc_id").alias("doc"))
    times = _counted(keyed, scratch)
    crowded = None
    orders = pairs = None
    for _ in range(revisions):
        now = times.where(F.col("times") > hot)
        now = scratch.write(now if crowded is None else now.join(crowded, "key", "left_anti"), "hot")
        if now.isEmpty():
            break
        crowded = now if crowded is None else scratch.write(crowded.unionByName(now), "crowded")
        holders = scratch.write(join_crowded(keyed, now, ["key"]).select("key", "doc"), "holders")
        centre = scratch.write(holders.groupBy("key").agg(F.min("doc").alias("hub"), F.count("*").alias("times")), "centre")
        met = join_crowded(holders, centre, ["key"]).where("hub < doc").groupBy("doc").agg(F.min("hub").alias("a"))
        met = scratch.write(met.select("a", F.col("doc").alias("b")), "pairs")
        pairs = met if pairs is None else pairs.unionByName(met)
        held = scratch.write(holders.select(F.col("doc").alias("doc_id")).distinct(), "held")
        if orders is not None:
            held = with_ids(held, orders.select(F.col("doc").alias("doc_id")).distinct(), "doc_id", keep=False)
        more = with_ids(d, held, "doc_id").mapInArrow(_orders, "doc bigint, f1 bigint, upper bigint, keep int, keys array<bigint>")
        more = scratch.write(more, "orders")
        orders = more if orders is None else orders.unionByName(more)
        row = ["doc", "f1", "upper"]
        seen = join_crowded(orders.select(*row, F.explode("keys").alias("key")), crowded, ["key"])
        seen = seen.groupBy(row).agg(F.collect_set("key").alias("late"))
        late = F.coalesce("late", F.array().cast("array<bigint>"))
        ordered = F.concat(F.array_except("keys", late), F.array_intersect("keys", late))
        taken = orders.join(seen, row, "left").select(F.explode(F.slice(ordered, F.lit(1), F.col("keep"))).alias("key"), "doc")
        moved = scratch.write(orders.select(F.col("doc").alias("doc_id")).distinct(), "moved")
        rest = with_ids(first, moved, "doc_id", keep=False).select(F.explode("keys").alias("key"), F.col("doc_id").alias("doc"))
        keyed = rest.unionByName(scratch.write(taken, "taken"))
        times = _counted(keyed, scratch)
    return keyed, times, pairs


def _still_apart(star: DataFrame, label: DataFrame, sets: DataFrame, scratch: Scratch, block: int = BLOCK) -> DataFrame:
    """Pairs of documents around one hub in different components that size and sketch allow.

    Around each hub, documents outside the largest component (outer) meet all documents of
    their own and the two neighbouring size bands, dealt as pairs of blocks.
    """
    t = star.join(label, "doc")
    parts = t.groupBy("hub", "c").agg(F.count("*").alias("k"))
    mixed = parts.groupBy("hub").agg(F.max_by("c", F.struct("k", "c")).alias("big"), F.count("*").alias("k")).where("k > 1")
    t = t.join(mixed.select("hub", "big"), "hub").join(sets.select(F.col("doc_id").alias("doc"), "n", "bits"), "doc")
    band = F.floor(F.log(F.col("n")) / F.log(F.lit(100 / PCT))).cast("int")
    t = t.withColumn("outer", F.col("c") != F.col("big")).withColumn("sb", band)
    t = scratch.write(t.select("hub", "doc", "c", "n", "bits", "outer", "sb"), "around")
    outer = t.where("outer").withColumn("sb", F.explode(F.array(F.col("sb") - 1, F.col("sb"), F.col("sb") + 1)))
    many = lambda df, name: df.groupBy("hub", "sb").agg(F.ceil(F.count("*") / block).cast("int").alias(name))
    size = many(t, "nm").join(many(outer, "nl"), ["hub", "sb"])
    spot = lambda n: F.pmod(F.xxhash64("doc"), F.col(n)).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    inner = t.withColumn("outer", F.lit(False)).join(size, ["hub", "sb"]).withColumn("mb", spot("nm")).withColumn("lb", upto("nl"))
    outer = outer.join(size, ["hub", "sb"]).withColumn("lb", spot("nl")).withColumn("mb", upto("nm"))
    keys = ["hub", "sb", "mb", "lb"]
    rows = inner.select(*keys, "doc", "c", "n", "bits", "outer").unionByName(outer.select(*keys, "doc", "c", "n", "bits", "outer"))
    dealt = rows.repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(_block_pairs, "a bigint, b bigint").distinct()


def near_duplicates(docs: DataFrame, scratch: Scratch, hot: int = HOT, revisions: int = REVISIONS) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links per row of docs.

    component_id is the smallest doc_id reachable by links (itself included). n_links counts
    the verified links to other texts that the search had to test to connect the component;
    links between members already connected are not expanded. Null and text without words:
    n_shingles 0, linked with nothing. A null doc_id takes part in no link and has a null
    component. Rows with one doc_id are one document: linked by any of their texts. An empty
    table gives no rows; other columns are ignored.
    """
    d = docs.select("doc_id", "text")
    table = scratch.write(
        d.mapInArrow(_sketches, "doc_id bigint, n_shingles bigint, f1 bigint, f2 bigint, keys array<bigint>"), "sketches"
    )
    full = table.where("n_shingles > 0 and doc_id is not null")
    same = ["n_shingles", "f1", "f2"]
    heads = full.groupBy(same).agg(F.min("doc_id").alias("head"), F.count("*").alias("times")).where("times > 1")
    copies = join_crowded(full.select("doc_id", *same), scratch.write(heads, "heads"), same).where("doc_id <> head")
    copies = scratch.write(copies.select("doc_id", *same, "head").distinct(), "copies")
    one = with_ids(full, copies.select("doc_id", *same).distinct(), ["doc_id", *same], keep=False)
    copies = copies.select("doc_id", "head")
    keyed, times, pairs = _rarest(d, one, scratch, hot, revisions)
    met = scratch.write(join_crowded(keyed, times, ["key"]).select("key", "doc").distinct(), "met")
    ids = scratch.write(met.select(F.col("doc").alias("doc_id")).distinct(), "ids")
    schema = "doc_id bigint, n bigint, s binary, bits binary"
    sets = scratch.write(with_ids(d, ids, "doc_id").mapInArrow(_sets, schema), "sets")
    hubs = met.groupBy("key").agg(F.min("doc").alias("hub"))
    star = scratch.write(met.join(hubs, "key").select("hub", "doc").distinct(), "star")
    nearest = star.where("hub < doc").groupBy("doc").agg(F.min("hub").alias("a")).select("a", F.col("doc").alias("b"))
    if pairs is not None:
        nearest = nearest.unionByName(pairs).distinct()
    links = _verified(nearest, sets, scratch)
    label = ids.select(F.col("doc_id").alias("doc"))
    if not links.isEmpty():
        label = label.join(components(links, scratch), "doc", "left").select("doc", F.coalesce("c", "doc").alias("c"))
    else:
        label = label.withColumn("c", F.col("doc"))
    label = scratch.write(label, "label")
    more = _verified(_still_apart(star, label, sets, scratch), sets, scratch)
    if not more.isEmpty():
        links = scratch.write(links.unionByName(more).distinct(), "links")
        reach = components(links, scratch)
        label = label.select("doc").join(reach, "doc", "left").select("doc", F.coalesce("c", "doc").alias("c"))
    links = None if links.isEmpty() else links
    degree = None
    if links is not None:
        ends = links.select(F.col("a").alias("doc")).unionByName(links.select(F.col("b").alias("doc")))
        degree = ends.groupBy("doc").agg(F.count("*").alias("n"))
        label = label.join(degree, "doc", "left")
    else:
        label = label.withColumn("n", F.lit(None).cast("bigint"))
    # A document with several texts joins their heads; the copies then follow their heads.
    several = copies.groupBy("doc_id").agg(F.min("head").alias("head"), F.count("*").alias("k"))
    texts = full.groupBy("doc_id").agg(F.min("f1").alias("low"), F.max("f1").alias("high"))
    if not texts.where("low <> high").isEmpty():
        more = copies.select(F.col("doc_id").alias("a"), F.col("head").alias("b"))
        links = more if links is None else links.unionByName(more)
        reach = components(links, scratch)
        label = reach.join(label.select("doc", "n"), "doc", "left")
    label = scratch.write(label, "final")
    out = table.select("doc_id", "n_shingles").join(several.select("doc_id", "head"), "doc_id", "left")
    out = out.withColumn("doc", F.coalesce("head", "doc_id")).join(label, "doc", "left")
    return out.select(
        "doc_id",
        "n_shingles",
        F.when(F.col("n_shingles") > 0, F.coalesce("c", "doc")).otherwise(F.col("doc_id")).alias("component_id"),
        F.coalesce("n", F.lit(0)).alias("n_links"),
    )


def keep_one(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows of docs whose doc_id is the smallest of its component (null doc_ids stay), with docs' own columns.

    Of repeated rows with one doc_id all stay: they are the same document.
    """
    later = near_duplicates(docs, scratch).where("component_id < doc_id").select("doc_id").distinct()
    return with_ids(docs, scratch.write(later, "later"), "doc_id", keep=False).select([F.col(f"`{c}`") for c in docs.columns])


def _oracle() -> str:
    return rf"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[p:p+{WORDS - 1}], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {WORDS - 1}, least(len(w), 1)) + 1)) AS p FROM d)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
r AS MATERIALIZED (SELECT doc_id, md5(g) AS g FROM s),
x AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM r a JOIN r b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS MATERIALIZED (SELECT a, b FROM x JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * i >= {PCT} * (na.n + nb.n - i)),
u AS MATERIALIZED (SELECT a, b FROM e UNION SELECT b, a FROM e),
c AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT c.a, u.b FROM c JOIN u ON u.a = c.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM c GROUP BY a) m USING (doc_id)
"""


ORACLE = _oracle()
