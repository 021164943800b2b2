"""Line dedup: a line within one word edit of an earlier line goes; the earliest stays.

Deletion neighbourhoods: two lines are within one edit exactly if deleting the same word
position from both leaves the same words (substitution), or deleting one word from the
longer leaves the shorter. So every variant is a hashed key, equal keys meet by grouping,
and as only the earliest line of a group matters, a group is reduced to its minimum
before and after the shuffle: no pair of lines is ever formed within a group.

A line of n words has n variants, so lines that cannot have a partner are set aside
first: with one edit at most, two lines share their first or their second half whole.

Lines of fewer than MIN_WORDS words have no variants: they go only where an earlier line
has the same words. Lines without a word are never compared.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, few, join_crowded, let, running, text_or_empty

#: Shorter lines (headings, list marks) are compared for equality alone: one edit in five words leaves 80 %.
MIN_WORDS = 5
ORDER = ("doc_id", "v", "line_no")
#: What separates words inside a line, wherever it is more than one blank.
_BLANKS = r"[\t\x0B\f\r][ \t\x0B\f\r]*| [ \t\x0B\f\r]+"


def _flat_lines(text: Column) -> Column:
    """The lines of a text; inside them single blanks separate words (and may stand at either end)."""
    return F.split(F.regexp_replace(text, _BLANKS, " "), "\n", -1)


def _part(x: Column, words: Column) -> Column:
    """The first `words` words of a line, or the last if negative."""
    return F.call_function("substring_index", x, F.lit(" "), words.cast("int"))


def _lines(docs: DataFrame) -> DataFrame:
    """doc_id, v (the text's hash), line_no, x (its words, joined by blanks) of every line with a word."""
    t = text_or_empty()
    d = docs.where(F.col("doc_id").isNotNull()).select("doc_id", F.xxhash64(t).alias("v"), _flat_lines(t).alias("a"))
    d = d.select("doc_id", "v", F.posexplode("a").alias("line_no", "x")).select(*ORDER, F.trim("x").alias("x"))
    return d.where(F.col("x") != "")


def _half_keys(lines: DataFrame, min_words: int) -> DataFrame:
    """lines with h and c (hashes of the line), half keys k1, k2, k3 and whether the third is a head.

    With n words against n or n + 1 words, the edit spares the first n // 2 words or the
    last n - n // 2; a line keys these for its own length and for one word less. Of the
    four two are always the same: with n even the tails, with n odd the heads. Lines of
    fewer than min_words words have no half keys (nulls).
    """
    d = lines.withColumn("n", F.octet_length("x") - F.octet_length(F.replace("x", F.lit(" "), F.lit(""))) + 1)
    k, x, even = F.floor(F.col("n") / 2).cast("int"), F.col("x"), F.col("n") % 2 == 0
    long = F.col("n") >= min_words
    head = lambda m: F.when(long, F.xxhash64(F.lit("head"), m, _part(x, m)))
    tail = lambda m: F.when(long, F.xxhash64(F.lit("tail"), m, _part(x, -m)))
    return d.select(
        *ORDER, F.xxhash64("x").alias("h"), F.hash("x").alias("c"), head(k).alias("k1"), tail(F.col("n") - k).alias("k2"),
        F.when(even, head(k - 1)).otherwise(tail(k)).alias("k3"), even.alias("third_head"),
    )


def _within_one_edit(a: Column, b: Column) -> Column:
    """Whether two word arrays are at most one insertion, deletion or substitution apart."""
    same = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y))
    at = F.array_position(same, False).cast("int")  # 1-based first difference, 0 if none
    rest = lambda x, skip: F.slice(x, at + skip, F.greatest(F.size(x) - at - skip + 1, F.lit(0)))
    return (
        (at == 0)
        | (rest(a, 1) == rest(b, 1))
        | (rest(a, 1) == rest(b, 0))
        | (rest(a, 0) == rest(b, 1))
    )


def removed_lines(docs: DataFrame, scratch: Scratch, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, v, line_no of every line that has an earlier line (by doc_id, then place) within one word edit, or equal if shorter than min_words."""
    o = F.struct(*ORDER)
    table = scratch.write(_half_keys(_lines(docs), min_words), "lines")
    # Equal lines (by their words, however spaced): everything but the first of each content.
    whole, halves = ["h", "c"], ["k1", "k2", "k3", "third_head"]
    first = table.groupBy(whole).agg(F.min(o).alias("o"), F.count("*").alias("times"), *[F.min(k).alias(k) for k in halves])
    first = scratch.write(first, "first")
    again = first.where("times > 1").select(*whole, F.col("o").alias("first"), "times")
    exact = join_crowded(table.select(*ORDER, *whole), again, whole).where(o > F.col("first")).select(*ORDER)
    # Distinct lines that share a half with another distinct line.
    pairs = [(F.col("k1"), F.lit(True)), (F.col("k2"), F.lit(False)), (F.col("k3"), F.col("third_head"))]
    keys = F.array(*[F.struct(k.alias("key"), head.alias("head")) for k, head in pairs])
    keys = first.where(F.col("k1").isNotNull()).select("o", "h", F.inline(keys))
    shared = keys.groupBy("key").agg(F.min("h").alias("a"), F.max("h").alias("b")).where("a <> b").select("key")
    candidates = keys.join(shared, "key").groupBy("o").agg(F.max("head").alias("head"), F.max(~F.col("head")).alias("tail"))
    by_doc = candidates.groupBy("o.doc_id", "o.v").agg(F.collect_list(F.struct("o.line_no", "head", "tail")).alias("at"))
    by_doc = scratch.write(by_doc.withColumnsRenamed({"doc_id": "id", "v": "id_v"}), "candidates")
    side = few(by_doc, 24 + 24 * F.size("at"))
    t = text_or_empty()
    near = docs.join(side, (F.col("doc_id") == F.col("id")) & (F.xxhash64(t) == F.col("id_v")))
    near = near.select("doc_id", F.col("id_v").alias("v"), _flat_lines(t).alias("a"), "at")
    near = near.select("doc_id", "v", "a", F.inline("at")).select(*ORDER, F.split(F.trim(F.get("a", F.col("line_no"))), " ").alias("w"), "head", "tail")
    near = scratch.write(near, "near")
    # Position-bound word hashes, folded by XOR: x over a prefix, y over the words after it moved one left.
    xor = lambda a, b: a.bitwiseXOR(b)
    spread = 4 * docs.sparkSession.sparkContext.defaultParallelism
    v = near.repartition(spread, *ORDER).withColumn("x", running(F.transform("w", lambda s, i: F.xxhash64(s, i)), xor))
    v = v.withColumn("y", running(F.transform("w", lambda s, i: F.xxhash64(s, i - 1)), xor))
    n = F.size("w")
    variant = lambda i: F.get("x", i).bitwiseXOR(F.get("y", n)).bitwiseXOR(F.get("y", i + 1))
    spots = F.filter(
        F.sequence(F.lit(0), n - 1),
        lambda i: (F.col("head") & (i >= F.floor((n - 1) / 2))) | (F.col("tail") & (i <= F.floor(n / 2))),
    )
    rows = F.concat(
        F.array(F.struct(F.lit(-1).alias("i"), F.get("x", n).alias("key"), n.alias("left"))),
        F.transform(spots, lambda i: F.struct(i.alias("i"), variant(i).alias("key"), (n - 1).alias("left"))),
    )
    variants = scratch.write(v.select(*ORDER, F.explode(rows).alias("r")).select(*ORDER, "r.*"), "variants")
    # The earliest line per (key, deleted position), whole lines at position -1; then across positions.
    by_spot = variants.groupBy("key", "left", "i").agg(F.min(o).alias("o"), F.count("*").alias("c"))
    by_spot = scratch.write(by_spot, "spots")
    by_key = by_spot.groupBy("key", "left").agg(
        F.min(F.when(F.col("i") < 0, F.col("o"))).alias("whole"),
        F.min(F.when(F.col("i") >= 0, F.col("o"))).alias("cut"),
        F.max(F.when(F.col("i") >= 0, F.col("c")).otherwise(0)).alias("c"),
    )
    meets = by_key.where((F.col("c") > 1) | (F.col("whole").isNotNull() & F.col("cut").isNotNull()))
    spots_met = by_spot.select("key", "left", "i", F.col("o").alias("same")).join(meets, ["key", "left"])
    partner = F.when(F.col("i") < 0, F.col("cut")).otherwise(F.least("same", "whole"))
    found = (
        variants.join(spots_met, ["key", "left", "i"])
        .withColumn("partner", partner)
        .where(F.col("partner") < o)
        .groupBy(*ORDER)
        .agg(F.min("partner").alias("partner"))
    )
    # Equal hashes are checked against the words themselves.
    a = near.select(*ORDER, F.col("w").alias("wa"))
    b = near.select(F.struct(*ORDER).alias("partner"), F.col("w").alias("wb"))
    checked = found.join(a, list(ORDER)).join(b, "partner").where(_within_one_edit(F.col("wa"), F.col("wb"))).select(*ORDER)
    return scratch.write(reduce(DataFrame.unionByName, [exact, checked]).distinct(), "removed")


#: Columns that dedup_lines adds; named so that they don't meet a column of docs.
KEPT, REMOVED = "__tw_kept_lines", "__tw_n_removed"


def dedup_lines(docs: DataFrame, scratch: Scratch, min_words: int = MIN_WORDS) -> DataFrame:
    """docs plus KEPT (array of lines) and REMOVED (their number).

    Lines are what "\n" separates; those without a word stay. Comparison is by words (runs of SPACE are equal);
    whether an earlier line was itself removed plays no part. Null text is empty. Rows
    with a null doc_id have no place in the order: they are returned whole and remove
    nothing. Repeated rows hold the same place, so they do not remove each other's lines.
    An empty table gives no rows; other columns pass through.
    """
    gone = removed_lines(docs.select("doc_id", "text"), scratch, min_words)
    gone = gone.groupBy(F.col("doc_id").alias("__tw_id"), F.col("v").alias("__tw_v")).agg(F.collect_list("line_no").alias("__tw_gone"))
    gone = scratch.write(gone, "gone")
    side = few(gone, 24 + 4 * F.size("__tw_gone"))
    df = docs.join(side, (F.col("doc_id") == F.col("__tw_id")) & (F.xxhash64(text_or_empty()) == F.col("__tw_v")), "left")
    lines = F.split(text_or_empty(), "\n", -1)
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__tw_gone"))
    kept = F.when(F.col("__tw_gone").isNull(), lines).otherwise(let(lines, lambda a: F.transform(left, lambda i: F.get(a, i))))
    n = F.coalesce(F.size("__tw_gone"), F.lit(0)).cast("bigint")
    return df.withColumn(KEPT, kept).withColumn(REMOVED, n).drop("__tw_gone", "__tw_id", "__tw_v")


def dedup_report(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, n_lines, n_removed, kept_sha256 (of the kept lines joined by newlines) per row of docs."""
    df = dedup_lines(docs.select("doc_id", "text"), scratch)
    return df.select(
        "doc_id",
        (F.size(KEPT) + F.col(REMOVED)).cast("bigint").alias("n_lines"),
        F.col(REMOVED).alias("n_removed"),
        F.sha2(F.array_join(KEPT, "\n").cast("binary"), 256).alias("kept_sha256"),
    )


ORACLE = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS ln FROM d),
lw AS (SELECT doc_id, ln, w, array_to_string(w, ' ') AS s FROM (SELECT doc_id, ln, list_filter(string_split_regex(line, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM l)
  WHERE len(w) > 0),
f AS MATERIALIZED (SELECT s, any_value(w) AS w, min((doc_id, ln)) AS o FROM lw GROUP BY s),
v AS MATERIALIZED (SELECT o, i, array_to_string(w[:i-1] || w[i+1:], ' ') AS k FROM (SELECT o, w, unnest(range(1, len(w) + 1)) AS i FROM f WHERE len(w) >= {MIN_WORDS})),
bad AS (SELECT o FROM (SELECT o, min(o) OVER (PARTITION BY k, i) AS p FROM v) WHERE p < o
  UNION SELECT v.o FROM v JOIN f ON f.s = v.k WHERE f.o < v.o AND len(f.w) >= {MIN_WORDS}
  UNION SELECT f.o FROM v JOIN f ON f.s = v.k WHERE v.o < f.o AND len(f.w) >= {MIN_WORDS}),
gone AS (SELECT lw.doc_id, lw.ln FROM lw JOIN f USING (s) WHERE (lw.doc_id, lw.ln) > f.o OR f.o IN (SELECT o FROM bad))
SELECT l.doc_id, count(*) AS n_lines, count(gone.ln) AS n_removed,
  sha256(coalesce(string_agg(l.line, chr(10) ORDER BY l.ln) FILTER (gone.ln IS NULL), '')) AS kept_sha256
FROM l LEFT JOIN gone ON gone.doc_id = l.doc_id AND gone.ln = l.ln GROUP BY l.doc_id
"""
