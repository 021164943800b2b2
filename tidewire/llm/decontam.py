"""Benchmark decontamination: item-sized windows, an exact bound on their seeds, exact check, SimHash distance of each leak.

A window of a document as long as a benchmark item is a leak when the weighted Jaccard
similarity of their shingle bags reaches the threshold. All windows are searched, but
only those are compared that can reach it. That bound is exact: bags of m shingles
each with overlap i have similarity i / (2m - i), so at the threshold at most
`allowed_misses` positions of the window carry a shingle that the item lacks; a window
over m consecutive positions holds at least floor(m / s) multiples of s, so if fewer than
floor(m / s) - allowed_misses sampled positions carry a shingle of the item, the window
is no leak. No leak is lost by it, whatever the texts.

An index over blocks of SimHash fingerprints can't do this: fingerprints bound no
similarity. Where two shingles dominate a bag (a periodic text), half of the bits flip
together, so a leak of similarity 0.9 may lie beyond any radius that tells texts apart.
The distance of each leak's window to its item is reported instead, as a column.

A document of fewer shingles than an item is one window, whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, few, let, text_or_empty, words_of

WORDS = 5
THRESHOLD_PCT = 80
_FROM = "ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?"
_TO = "abcdefghijklmnopqrstuvwxyz"


def normal_words(text: Column) -> Column:
    """Words with A-Z lower-cased and the marks .,;:!? removed."""
    return words_of(F.translate(text, _FROM, _TO))


def shingles(words: Column, k: Column | int) -> Column:
    """Hashes of the k-word shingles at every position."""
    k = k if isinstance(k, Column) else F.lit(k)
    last = F.size(words) - k
    return F.when(
        last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.xxhash64(F.slice(words, i + 1, k)))
    ).otherwise(F.array().cast("array<bigint>"))


def allowed_misses(m: int, pct: int = THRESHOLD_PCT) -> int:
    """Most positions of a window of m shingles that may lack the item's shingles.

    Equal bags of m with overlap i: 100 i >= pct (2m - i), so i >= 2 pct m / (100 + pct).
    """
    return m - -(-2 * pct * m // (100 + pct))


def _stride(m: int) -> int:
    """The largest s for which any m consecutive positions hold more multiples of s than allowed misses."""
    return max(s for s in range(1, m + 1) if m // s > allowed_misses(m))


def simhash(bag: Column) -> Column:
    """64-bit SimHash of an array of hashes; a shingle weighs as often as it occurs.

    Two 32-bit counters share a bigint, so one fold counts bits j and j + 32 together.
    """
    n = F.size(bag).cast("bigint")
    lane = lambda x, j: F.shiftrightunsigned(x, j).bitwiseAND(F.lit(0x0000000100000001))
    total = F.aggregate(
        bag,
        F.array(*[F.lit(0).cast("bigint")] * 32),
        lambda acc, x: F.array(*[F.get(acc, F.lit(j)) + lane(x, j) for j in range(32)]),
    )

    def pack(c: Column) -> Column:
        out = F.lit(0).cast("bigint")
        for j in range(32):
            v = F.get(c, F.lit(j))
            low, high = v.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(v, 32)
            out = out.bitwiseOR(F.when(low * 2 > n, F.lit(1 << j)).otherwise(F.lit(0)).cast("bigint"))
            top = F.lit((1 << (j + 32)) - (1 << 64) if j == 31 else 1 << (j + 32))
            out = out.bitwiseOR(F.when(high * 2 > n, top).otherwise(F.lit(0)).cast("bigint"))
        return out

    return let(total, pack)


def occurrences(bag: Column) -> Column:
    """The bag as a set: each element hashed with the number of its occurrence, so set overlap is bag overlap."""
    number = lambda a: F.transform(a, lambda x, i: F.xxhash64(x, i + 1 - F.array_position(a, x).cast("int")))
    return let(F.sort_array(bag), number)


def item_table(benchmark: DataFrame) -> DataFrame:
    """key (of item and text), item_id, k (shingle words), m (shingles), bag, set, fp of each item with a word."""
    b = benchmark.select("item_id", normal_words(text_or_empty()).alias("w")).where(F.size("w") > 0).distinct()
    b = b.withColumn("k", F.least(F.lit(WORDS), F.size("w"))).withColumn("key", F.xxhash64("item_id", "w"))
    b = b.withColumn("bag", shingles(F.col("w"), F.col("k"))).withColumn("m", F.size("bag"))
    return b.select("key", "item_id", "k", "m", "bag", occurrences(F.col("bag")).alias("set"), simhash(F.col("bag")).alias("fp"))


def find_leaks(docs: DataFrame, benchmark: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, item_id, start_word, hamming, similarity: the most similar window (ties: first) of each leak.

    A null or empty text has no windows; items without words match nothing. A null doc_id
    or item_id is carried like a value. A text shorter than an item is compared whole. Repeated documents or items give their pairs once.
    Empty tables give no rows; other columns are ignored.
    """
    items = scratch.write(item_table(benchmark), "items")
    sizes = [(r.k, r.m) for r in items.select("k", "m").distinct().sort("k", "m").collect()]  # lengths, not items
    d = docs.select("doc_id", text_or_empty().alias("t")).select(
        "doc_id", F.xxhash64("t").alias("v"), normal_words(F.col("t")).alias("w")
    )
    out = None
    for k in sorted({k for k, _ in sizes}):
        s = min(_stride(m) for kk, m in sizes if kk == k)
        of_k = items.where(F.col("k") == k)
        terms = of_k.select(F.col("key").alias("item"), "m", F.explode(F.array_distinct("bag")).alias("h"))
        last = F.size("w") - k
        spots = F.when(
            last >= 0,
            F.transform(
                F.sequence(F.lit(0), F.greatest(last, F.lit(0)), F.lit(s)),
                lambda p: F.struct(p.alias("p"), F.xxhash64(F.slice("w", p + 1, F.lit(k))).alias("h")),
            ),
        )
        hits = d.select("doc_id", "v", (last + 1).alias("l"), F.explode(spots).alias("x")).select("doc_id", "v", "l", "x.*")
        # The seeds of one item in one document; a window needs nearly all of its sampled positions among them.
        seeds = hits.join(few(terms, 32), "h").groupBy("doc_id", "v", "l", "item", "m").agg(F.sort_array(F.collect_set("p")).alias("ps"))
        # A window of `wide` shingles; where that is the whole document, position 0 is sampled, too.
        wide = F.least("l", "m")
        sampled = F.when(F.col("l") < F.col("m"), F.ceil(wide / s)).otherwise(F.floor(wide / s))
        missing = wide - F.ceil(F.lit(THRESHOLD_PCT) * (wide + F.col("m")) / (100 + THRESHOLD_PCT))
        seeds = seeds.withColumn("need", F.greatest(F.lit(1), sampled - missing).cast("int"))
        seeds = seeds.where(F.size("ps") >= F.col("need")).groupBy("doc_id", "v").agg(
            F.collect_list(F.struct("item", "m", "need", "ps")).alias("seeds")
        )
        seeds = scratch.write(seeds.withColumnRenamed("doc_id", "id").withColumnRenamed("v", "v_"), f"seeds{k}")
        size = F.aggregate("seeds", F.lit(0), lambda acc, x: acc + 40 + 8 * F.size(x.ps))
        hit = d.join(few(seeds, size), (F.col("v") == F.col("v_")) & F.col("doc_id").eqNullSafe(F.col("id")))
        hit = hit.select("doc_id", shingles(F.col("w"), k).alias("sh"), F.explode("seeds").alias("x")).select("doc_id", "sh", "x.*")
        # Starts of windows that hold `need` seeds: those reaching from one seed over the next need - 1.
        ps, wide = F.col("ps"), F.least(F.col("m"), F.size("sh"))
        spans = F.transform(
            F.slice(ps, F.lit(1), F.size(ps) - F.col("need") + 1),
            lambda p, i: F.struct(
                F.greatest(F.get(ps, i + F.col("need") - 1) - wide + 1, F.lit(0)).alias("a"),
                F.least(p, F.size("sh") - wide).alias("b"),
            ),
        )
        starts = F.array_distinct(
            F.flatten(F.transform(F.filter(spans, lambda x: x.a <= x.b), lambda x: F.sequence(x.a, x.b)))
        )
        win = hit.select("doc_id", "item", F.explode(starts).alias("start"), "m", "sh")
        win = win.select("doc_id", "item", "start", F.slice("sh", F.col("start") + 1, F.col("m")).alias("bag"))
        bags = of_k.select(F.col("key").alias("item"), "item_id", "fp", "set")
        pairs = win.join(few(bags, 32 + 8 * F.size("set")), "item")
        common = F.size(F.array_intersect("set", occurrences(F.col("bag"))))
        pairs = pairs.withColumn("common", common).withColumn("total", F.size("bag") + F.size("set") - F.col("common"))
        pairs = pairs.where(F.col("common") * 100 >= F.col("total") * THRESHOLD_PCT)
        similarity = (F.col("common").cast("double") / F.col("total")).alias("similarity")
        pairs = pairs.select("doc_id", "item_id", F.col("start").cast("bigint").alias("start_word"), F.struct("bag", "fp").alias("prints"), similarity)
        out = pairs if out is None else out.unionByName(pairs)
    if out is None:
        return docs.sparkSession.createDataFrame([], "doc_id bigint, item_id bigint, start_word bigint, hamming int, similarity double")
    best = F.max_by(F.struct("start_word", "prints"), F.struct("similarity", -F.col("start_word")))
    g = out.groupBy("doc_id", "item_id").agg(best.alias("x"), F.max("similarity").alias("similarity"))
    hamming = F.bit_count(simhash(F.col("x.prints.bag")).bitwiseXOR(F.col("x.prints.fp")))
    return g.select("doc_id", "item_id", "x.start_word", hamming.alias("hamming"), "similarity")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows of docs that hold no benchmark item, with docs' own columns."""
    leaked = scratch.write(find_leaks(docs, benchmark, scratch).select(F.col("doc_id").alias("__tw_id")).distinct(), "leaked")
    return docs.join(few(leaked, 8), F.col("doc_id").eqNullSafe(F.col("__tw_id")), "left_anti")


ORACLE = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, list_filter(string_split_regex(translate(coalesce(text, ''), '{_FROM}', '{_TO}'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
i AS (SELECT item_id, w, len(w) AS n, least({WORDS}, len(w)) AS k FROM (SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{_FROM}', '{_TO}'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM benchmark) WHERE len(w) > 0),
ish AS (SELECT item_id, k, n - k + 1 AS m, array_to_string(w[p:p+k-1], ' ') AS s FROM (SELECT *, unnest(range(1, n - k + 2)) AS p FROM i)),
dsh AS MATERIALIZED (SELECT r, k, p, array_to_string(w[p:p+k-1], ' ') AS s FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, (SELECT DISTINCT k FROM i))),
hit AS (SELECT DISTINCT r, item_id, k, m, least(m, len(w) - k + 1) AS wide, len(w) - k + 1 AS l, p FROM dsh JOIN ish USING (k, s) JOIN d USING (r)),
win AS (SELECT DISTINCT r, item_id, k, m, wide, unnest(range(greatest(1, p - wide + 1), least(p, l - wide + 1) + 1)) AS t FROM hit),
wc AS (SELECT win.r, win.item_id, win.m, win.wide, win.t, dsh.s, count(*) AS c FROM win JOIN dsh ON dsh.r = win.r AND dsh.k = win.k AND dsh.p BETWEEN win.t AND win.t + win.wide - 1 GROUP BY ALL),
ic AS (SELECT item_id, s, count(*) AS c FROM ish GROUP BY ALL),
o AS (SELECT r, item_id, t, m + wide AS sizes, sum(least(wc.c, ic.c)) AS common FROM wc JOIN ic USING (item_id, s) GROUP BY r, item_id, t, m, wide),
f AS (SELECT doc_id, item_id, t - 1 AS start_word, common::DOUBLE / (sizes - common) AS similarity FROM o JOIN d USING (r) WHERE common * 100 >= (sizes - common) * {THRESHOLD_PCT})
SELECT doc_id, item_id, arg_min(start_word, (-similarity, start_word))::BIGINT AS start_word, max(similarity) AS similarity FROM f GROUP BY doc_id, item_id
"""
