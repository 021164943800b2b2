"""Quality rules: lines are judged first and go if they fail; documents are judged by what is left of them.

Every rule is a Column expression, so the whole operator is one projection over the
scan: no shuffle, no Python, memory of one row at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, let, words_of

SYMBOLS = "[#*$%&|<>]"
#: Fixed phrases of page furniture, matched in either case inside one line.
BOILERPLATE = (
    "all rights reserved", "cookie policy", "privacy policy", "terms of use", "terms of service",
    "enable javascript", "click here", "sign up for", "subscribe to our",
)
PUNCTUATION = r"[.!?;:]"
BREADCRUMB = r"([|>][^|>]*){3}"
MIN_WORDS = 50
MAX_REPEAT_PCT = 50
MAX_LOST_PCT = 50
MAX_SYMBOL_PCT = 10
LONG_LINE_WORDS = 8


def line_fails(line: Column) -> Column:
    """Whether a line with a word is page furniture rather than text.

    Navigation: three or more '|' or '>' separators. Boilerplate: a listed phrase.
    Symbols: more than MAX_SYMBOL_PCT of its characters. Punctuation: LONG_LINE_WORDS or
    more words and not one sentence mark.
    """
    lowered = F.lower(line)
    phrase = None
    for p in BOILERPLATE:
        phrase = lowered.contains(p) if phrase is None else phrase | lowered.contains(p)
    symbols = F.size(F.split(line, SYMBOLS, -1)) - 1
    bare = ~line.rlike(PUNCTUATION) & line.rlike(f"^[{SPACE}]*([^{SPACE}]+[{SPACE}]+){{{LONG_LINE_WORDS - 1}}}[^{SPACE}]")
    return line.rlike(BREADCRUMB) | (symbols * 100 > F.length(line) * MAX_SYMBOL_PCT) | bare | phrase


def repeated_words(words: Column) -> Column:
    """How many words lie in three-word windows that occur twice or more in the text.

    Only texts with an equal pair are sorted: (hash, position) pairs bring equal windows
    together, and their positions mark the words.
    """
    n = F.size(words)
    hashes = F.when(
        n >= 3,
        F.transform(F.slice(words, F.lit(1), n - 2), lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2))),
    ).otherwise(F.array().cast("array<bigint>"))

    def covered(s: Column) -> Column:
        same = F.filter(
            s,
            lambda x, i: F.when(i > 0, x.h == F.get(s, i - 1).h).otherwise(False)
            | F.coalesce(x.h == F.get(s, i + 1).h, F.lit(False)),
        )
        return F.size(F.array_distinct(F.flatten(F.transform(same, lambda x: F.array(x.i, x.i + 1, x.i + 2)))))

    pairs = lambda t: F.sort_array(F.transform(t, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return let(hashes, lambda t: F.when(F.size(F.array_distinct(t)) == F.size(t), 0).otherwise(let(pairs(t), covered)))


def verdict(text: Column) -> Column:
    """A struct of all measures, base_failed and kept, as one expression in which nothing is evaluated twice.

    It is one expression so that a filter on it, which Spark moves below the projection,
    doesn't multiply the work.
    """

    def of_lines(marks: Column) -> list[Column]:
        inked = F.transform(F.filter(marks, lambda m: m.inked), lambda m: m.line)
        left = F.transform(F.filter(marks, lambda m: ~m.fails), lambda m: m.line)
        chars = lambda rule: F.aggregate(marks, F.lit(0), lambda acc, m: acc + F.when(rule(m), F.length(m.line)).otherwise(0))
        return [
            let(inked, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"),
            (F.size(marks) - F.size(left)).cast("bigint").alias("n_failed_lines"),
            chars(lambda m: m.fails).cast("bigint").alias("lost_chars"),
            chars(lambda m: m.inked).cast("bigint").alias("line_chars"),
            F.array_join(left, "\n").alias("cleaned"),
        ]

    def mark(line: Column) -> Column:
        inked = line.rlike(f"[^{SPACE}]")
        return F.struct(line.alias("line"), inked.alias("inked"), F.when(inked, line_fails(line)).otherwise(False).alias("fails"))

    def measures(t: Column) -> Column:
        words = lambda w: F.struct(F.size(w).cast("bigint").alias("n_words"), repeated_words(w).cast("bigint").alias("n_repeat_words"))
        return F.struct(
            let(words_of(t), words).alias("w"),
            F.length(F.regexp_replace(t, f"[{SPACE}]+", "")).cast("bigint").alias("word_chars"),
            (F.size(F.split(t, SYMBOLS, -1)) - 1).cast("bigint").alias("n_symbols"),
            let(F.transform(F.split(t, "\n", -1), mark), lambda x: F.struct(*of_lines(x))).alias("l"),
        )

    def judged(m: Column) -> Column:
        failed = (m.w.n_words < MIN_WORDS) | (m.w.n_repeat_words * 100 > m.w.n_words * MAX_REPEAT_PCT)
        return F.struct(
            m.w.n_words.alias("n_words"),
            m.word_chars.alias("word_chars"),
            m.n_symbols.alias("n_symbols"),
            m.l.n_dup_lines.alias("n_dup_lines"),
            m.w.n_repeat_words.alias("n_repeat_words"),
            m.l.n_failed_lines.alias("n_failed_lines"),
            m.l.lost_chars.alias("lost_chars"),
            m.l.line_chars.alias("line_chars"),
            failed.alias("base_failed"),
            (~failed & (m.l.lost_chars * 100 <= m.l.line_chars * MAX_LOST_PCT)).alias("kept"),
            m.l.cleaned.alias("cleaned"),
        )

    return let(F.coalesce(text, F.lit("")), lambda t: let(measures(t), judged))


def judge_documents(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, the measures, base_failed, kept and cleaned (the text without its failing lines).

    A null or empty text has no words: base_failed is true, kept false and cleaned empty.
    Lines without a word never fail. Ties do not arise (each row stands alone), repeated
    rows give repeated results, a null doc_id is passed through, other columns of docs are
    ignored, and an empty table gives no rows.
    """
    return docs.select("doc_id", verdict(F.col("text")).alias("v")).select("doc_id", "v.*")


def report(docs: DataFrame) -> DataFrame:
    """judge_documents with the hash of the cleaned text in its place."""
    return judge_documents(docs).withColumn("cleaned_sha256", F.sha2(F.col("cleaned").cast("binary"), 256)).drop("cleaned")


#: Column that keep_documents adds; named so that it doesn't meet a column of docs.
FAILED = "__tw_n_failed_lines"


def keep_documents(docs: DataFrame) -> DataFrame:
    """The rows of docs that judge_documents keeps, with their cleaned texts, plus FAILED (lines that were removed).

    Verdicts are generated, not filtered, so each is evaluated once.
    """
    kept = F.filter(F.array(verdict(F.col("text"))), lambda v: v.kept)
    d = docs.select("*", F.explode(F.transform(kept, lambda v: F.struct(v.cleaned.alias("text"), v.n_failed_lines.alias("n")))).alias("__tw_v"))
    own = [F.col("__tw_v.text").alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns]
    return d.select(*own, F.col("__tw_v.n").alias(FAILED))


_SP = r"[\x20\x09-\x0D]"
_BARE = f"^{_SP}*([^\\x20\\x09-\\x0D]+{_SP}+){{{LONG_LINE_WORDS - 1}}}[^\\x20\\x09-\\x0D]"
_PHRASES = " OR ".join(f"contains(lower(l), '{p}')" for p in BOILERPLATE)
ORACLE = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS r FROM documents),
w AS (SELECT r, doc_id, t, list_filter(string_split_regex(t, '{_SP}+'), lambda x: x <> '') AS w FROM d),
tri AS (SELECT r, i, w[i] || ' ' || w[i+1] || ' ' || w[i+2] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
rep AS (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM tri),
cov AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest([i, i+1, i+2]) AS j FROM rep WHERE c > 1) GROUP BY r),
ln AS (SELECT r, unnest(string_split(t, chr(10))) AS l, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM d),
lf AS (SELECT r, l, i, length(l) AS c, regexp_matches(l, '[^\x20\x09-\x0D]') AS ink,
  regexp_matches(l, '[^\x20\x09-\x0D]') AND (regexp_matches(l, '([|>][^|>]*){{3}}') OR 100 * (length(l) - length(regexp_replace(l, '[#*$%&|<>]', '', 'g'))) > {MAX_SYMBOL_PCT} * length(l)
  OR (NOT regexp_matches(l, '[.!?;:]') AND regexp_matches(l, '{_BARE}')) OR {_PHRASES}) AS bad FROM ln),
la AS (SELECT r, count(*) FILTER (ink) - count(DISTINCT l) FILTER (ink) AS dup, count(*) FILTER (bad) AS failed, sum(CASE WHEN ink THEN c ELSE 0 END) AS total, sum(CASE WHEN bad THEN c ELSE 0 END) AS lost,
  sha256(coalesce(string_agg(l, chr(10) ORDER BY i) FILTER (NOT bad), '')) AS cleaned FROM lf GROUP BY r),
m AS (SELECT w.doc_id, len(w.w) AS n_words, length(regexp_replace(t, '{_SP}+', '', 'g')) AS word_chars,
  length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(la.dup, 0) AS n_dup_lines,
  coalesce(cov.n, 0) AS n_repeat_words, la.failed, la.cleaned, coalesce(la.lost, 0) AS lost_chars, coalesce(la.total, 0) AS line_chars
  FROM w LEFT JOIN la USING (r) LEFT JOIN cov USING (r))
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, failed::BIGINT AS n_failed_lines, cleaned AS cleaned_sha256, lost_chars::BIGINT AS lost_chars, line_chars::BIGINT AS line_chars,
  n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PCT} * n_words AS base_failed,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PCT} * n_words) AND lost_chars * 100 <= line_chars * {MAX_LOST_PCT} AS kept
FROM m
"""
