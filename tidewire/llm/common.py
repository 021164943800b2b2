"""Shared pieces: written intermediate tables, size-checked id joins and vectorised word hashing."""

from __future__ import annotations

import atexit
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words everywhere in this subpackage (a class body).
SPACE = r"\x20\x09-\x0D"
SPACE_CHARS = " \t\n\x0b\x0c\r"
#: Most bytes of rows that are ever broadcast, by a count of all of them; larger tables are joined by a shuffle.
BROADCAST_BYTES = 64 << 20
#: What a broadcast row takes besides its values: row header and hash slots.
ROW_BYTES = 32
#: Most ids that are ever broadcast.
BROADCAST_IDS = BROADCAST_BYTES // (ROW_BYTES + 8)


# ---------------------------------------------------------------- written tables


@functools.cache
def _local_folder(application: str) -> str:
    """One folder for a local application; the setting can't be changed once a session runs."""
    return tempfile.mkdtemp(prefix="tidewire-")


class Scratch:
    """Intermediate Parquet tables in the folder that spark.checkpoint.dir names.

    A written table cuts the lineage, so a lost executor costs a re-read and not a
    recomputation. Only in local mode, where the setting is absent (tests, a single
    machine), is a temporary folder made; on a cluster its absence is an error.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            base = _local_folder(spark.sparkContext.applicationId)
        self.root = f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"
        self.n = 0
        atexit.register(self.close)

    def write(self, df: DataFrame, name: str = "t") -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n:02d}-{name}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            self._delete(t.scratch_path)

    def _delete(self, path: str) -> None:
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def close(self) -> None:
        try:
            self._delete(self.root)
        except Exception:  # the session is gone at interpreter exit: nothing left to clean with
            pass


def with_ids(df: DataFrame, ids: DataFrame, on: str | list[str], keep: bool = True) -> DataFrame:
    """Rows of df whose `on` is (keep) or isn't (not keep) in the table ids, whose columns are `on`.

    ids is broadcast only when counted to be at most BROADCAST_IDS a column; else both sides are shuffled.
    """
    small = ids.count() * len(ids.columns) <= BROADCAST_IDS
    side = F.broadcast(ids) if small else ids
    return df.join(side, on, "left_semi" if keep else "left_anti")


def few(df: DataFrame, row_bytes: Column | int) -> DataFrame:
    """df, marked for broadcast only if all its rows (row_bytes of values each) are at most BROADCAST_BYTES."""
    size = row_bytes if isinstance(row_bytes, Column) else F.lit(row_bytes)
    total = df.agg(F.sum(size.cast("bigint") + ROW_BYTES).alias("b")).first()["b"] or 0
    return F.broadcast(df) if total <= BROADCAST_BYTES else df


#: Keys that occur in more rows are joined by broadcast.
CROWD = 10_000


def join_crowded(df: DataFrame, side: DataFrame, on: list[str], times: str = "times", crowd: int = CROWD) -> DataFrame:
    """Inner equi-join of df with one row per key of side, where side's column `times` says in how many rows of df the key is.

    No task gets a crowded key whole: there are at most rows / crowd of those keys, which
    are broadcast (while their bytes allow it); the rows of all others are shuffled.
    """
    marks = side.where(F.col(times) > crowd).select(*on, F.struct(*[c for c in side.columns if c not in on]).alias("__tw_side"))
    marked = df.join(few(marks, 64), on, "left")
    more = [F.col(f"__tw_side.{c}").alias(c) for c in side.columns if c not in on]
    found = marked.where(F.col("__tw_side").isNotNull()).select(*df.columns, *more)
    rest = marked.where(F.col("__tw_side").isNull()).drop("__tw_side")
    return found.unionByName(rest.join(side.where(F.col(times) <= crowd), on).select(*found.columns))


# ---------------------------------------------------------------- native column helpers


def text_or_empty(c: str = "text") -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value evaluated once, even where use refers to it inside a lambda."""
    return F.transform(F.array(value), use)[0]


def words_of(text: Column) -> Column:
    """Words [^SPACE]+ of a text as an array; an empty array for a text without words."""
    none = F.array().cast("array<string>")
    return let(F.btrim(text, F.lit(SPACE_CHARS)), lambda t: F.when(t == "", none).otherwise(F.split(t, f"[{SPACE}]+")))


def running(a: Column, op: Callable[[Column, Column], Column], block: int = 64) -> Column:
    """op over the first 0, 1, ... n elements of an array of bigint (n + 1 values); op has the identity 0.

    Appending to an array copies it, so the fold is taken in blocks of `block` and then
    over the blocks: about n * block / 2 + (n / block)^2 / 2 copied elements.
    """
    zero = F.lit(0).cast("bigint")
    scan = lambda x: F.aggregate(
        x, F.array(zero), lambda acc, v: F.concat(acc, F.array(op(F.element_at(acc, -1), v)))
    )

    def by_block(x: Column) -> Column:
        parts = F.transform(
            F.sequence(F.lit(0), F.greatest(F.floor((F.size(x) - 1) / block).cast("int"), F.lit(0))),
            lambda i: scan(F.slice(x, i * block + 1, F.lit(block))),
        )
        return let(parts, lambda p: let(scan(F.transform(p, lambda q: F.element_at(q, -1))), lambda starts: shift(p, starts)))

    def shift(parts: Column, starts: Column) -> Column:
        moved = F.transform(parts, lambda p, i: let(F.get(starts, i), lambda s: F.transform(F.slice(p, 2, F.lit(block)), lambda v: op(v, s))))
        return F.concat(F.array(zero), F.flatten(moved))

    return let(a, lambda x: F.when(F.size(x) <= block, scan(x)).otherwise(by_block(x)))


def running_sums(a: Column) -> Column:
    return running(a, lambda x, y: x + y)


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text modulo folds (a null id counts as the empty string)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, held: int, folds: int, per_class: int) -> DataFrame:
    """doc_id, text, y of at most per_class documents of either label outside fold `held`, in hash order of doc_id.

    Repeated rows are one document; of several texts of one doc_id the smallest is taken.
    A document with several labels counts as 1 if any of them does.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (fold_of(F.col("doc_id"), folds) != held))
    known = known.groupBy("doc_id").agg((F.max(label) > 0).cast("int").alias("y"))
    pick = None
    for y in (0, 1):
        some = known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        pick = some if pick is None else pick.unionByName(some)
    some = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(pick), "doc_id")
    return some.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y"))


# ---------------------------------------------------------------- vectorised word hashing

_rng = np.random.RandomState(20240607)
_BYTE = _rng.randint(1, 2**62, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_P = np.uint64(0x9E3779B97F4A7C15)
_PINV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        m = max(n, 2 * len(_powers[0]))
        for k, p in ((0, _P), (1, _PINV)):
            a = np.full(m, p, np.uint64)
            a[0] = 1
            _powers[k] = np.cumprod(a, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end] for many spans, in a few passes over the bytes."""
    if not len(start):
        return np.zeros(0, np.uint64)
    up, down = _pow(len(data) + 1)
    s = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[:-1], out=s[1:])
    return mix((s[end] - s[start]) * down[start] ^ (end - start).astype(np.uint64) * _P)


def word_spans(data: np.ndarray, offsets: np.ndarray, gap: np.ndarray = _IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document index) of every word in the concatenated texts; gap: which byte values separate words."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    ink = ~gap[data]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    start = np.flatnonzero(ink & (np.concatenate(([True], ~ink[:-1])) | first[:n]))
    end = np.flatnonzero(ink & (np.concatenate((~ink[1:], [True])) | first[1:])) + 1
    return start, end, np.searchsorted(offsets, start, side="right") - 1


def chunks(batch: pa.RecordBatch, column: str, most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, UTF-8 bytes, offsets) over runs of rows of about `most` bytes; nulls read as empty."""
    col = batch.column(column)
    col = (col if not col.null_count else col.fill_null("")).cast(pa.large_binary())
    n = len(col)
    if not n:
        return
    offs = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + n + 1]
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + most, side="right")) - 1)
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int = 5) -> Iterator[np.ndarray]:
    """Per document, the sorted distinct 64-bit hashes of its k-word shingles (A-Z lower-cased).

    With 1 to k - 1 words the whole sequence is the one shingle; without words the set is empty.
    """
    data = _LOWER[data]
    start, end, doc = word_spans(data, offsets)
    h = hash_spans(data, start, end)
    n = len(offsets) - 1
    bounds = np.searchsorted(doc, np.arange(n + 1))
    acc = np.zeros(max(0, len(h) - k + 1), np.uint64)
    for j in range(k):
        acc = acc * _P + h[j : j + len(acc)]
    acc = mix(acc)
    for d in range(n):
        lo, hi = bounds[d], bounds[d + 1]
        if hi - lo >= k:
            yield np.unique(acc[lo : hi - k + 1])
        elif hi > lo:
            one = np.array([hi - lo], np.uint64)
            for x in h[lo:hi]:
                one = mix(one * _P + x)
            yield one
        else:
            yield np.zeros(0, np.uint64)
