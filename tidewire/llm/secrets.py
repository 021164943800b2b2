"""Secret scans: strong patterns alone, weak parts only where complementary parts co-occur.

Strong ("base") kinds are reported wherever they match. Weak kinds - an identifier
assignment, a long mixed token, an endpoint - are common in clean text, so they are
reported only when an interval join finds the missing part of a credential within the
same scope: the same text, at most SCOPE code points away.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, let, running_sums, text_or_empty

_ANY = lambda w: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w)
_SEP = r"""["']?\x20*[:=]\x20*["']?"""
_KEYS = "|".join([*map(_ANY, ("password", "passwd", "secret", "token")), _ANY("api") + "_?" + _ANY("key")])
_IDS = "|".join(map(_ANY, ("client_id", "username", "user", "login", "access_key_id")))
#: Fixed values, in report order: kind, pattern, group whose length counts, least length.
KINDS = (
    ("assign", f"({_KEYS}){_SEP}([A-Za-z0-9+/_.=-]+)", 2, 6),
    ("access", "AKIA[A-Z0-9]+", 0, 20),
    ("hex", "[0-9a-f]+", 0, 24),
    ("identifier", f"({_IDS}){_SEP}([A-Za-z0-9._@-]+)", 2, 3),
    ("mixed", "[A-Za-z0-9+/_-]+", 0, 32),
    ("endpoint", "(https?|ftp|postgres|mysql|mongodb|redis|amqp)://[A-Za-z0-9._:/@-]+", 0, 12),
)
BASE = 3
#: A long token is a candidate only if it has all three of these.
MIXED_NEEDS = ("[0-9]", "[a-z]", "[A-Z]")
#: Role of each kind in a credential.
ROLE = {"assign": "secret", "access": "id", "hex": "secret", "identifier": "id", "mixed": "secret", "endpoint": "endpoint"}
SCOPE = 200


def spans_of(text: Column, kind: int) -> Column:
    """array<struct<s, k, e>> of one kind's matches that pass, in code points, end exclusive.

    Matches are leftmost and do not overlap. Lengths of the pieces between matches and of
    the matches add up to their positions. A pattern X+ that is one run of a character
    class and must have n characters is searched as X{n,}, which finds the same runs.
    """
    name, pattern, group, least = KINDS[kind]
    if group == 0 and pattern.endswith("+") and name in ("hex", "mixed", "access"):
        head = 4 if name == "access" else 0
        pattern = f"{pattern[:-1]}{{{least - head},}}"
    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("p"))

    def place(b: Column) -> Column:
        sizes = F.transform(b.m, lambda m, i: (F.length(m) + F.length(F.get(b.p, i))).cast("bigint"))
        return let(
            running_sums(sizes),
            lambda at: F.transform(
                b.m,
                lambda m, i: F.struct(
                    (F.get(at, i) + F.length(F.get(b.p, i))).alias("s"), F.lit(kind).alias("k"), F.get(at, i + 1).alias("e"), m.alias("m")
                ),
            ),
        )

    placed = let(both, place)
    ok = lambda x: F.length(F.regexp_extract(x.m, pattern, group) if group else x.m) >= least
    if name == "mixed":
        ok = lambda x: x.m.rlike(MIXED_NEEDS[0]) & x.m.rlike(MIXED_NEEDS[1]) & x.m.rlike(MIXED_NEEDS[2])
    kept = F.transform(F.filter(placed, ok), lambda x: F.struct(x.s, x.k, x.e))
    none = F.array().cast("array<struct<s:bigint,k:int,e:bigint>>")
    return F.when(text.rlike(pattern), kept).otherwise(none)


def _join(spans: Column) -> Column:
    names = F.array(*[F.lit(k[0]) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x.k), x.s.cast("string"), x.e.cast("string"))), ","
    )


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id, id, key (the text's digest), found (base spans, sorted) and weak (all weak parts) per row of docs.

    The one pass over the texts: everything after it works on spans.
    """
    t = F.col("t")
    return docs.select("doc_id", text_or_empty().alias("t")).select(
        "doc_id",
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"),
        F.md5(t.cast("binary")).alias("key"),
        F.sort_array(F.concat(*[spans_of(t, k) for k in range(BASE)])).alias("found"),
        F.concat(*[spans_of(t, k) for k in range(BASE, len(KINDS))]).alias("weak"),
    )


def weak_spans(table: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Weak parts of a scanned table with their complement in scope: id, key, linked (sorted spans).

    Every part is a row. Parts are keyed by each block of `scope` code points that they (one
    side) or their surroundings (other side) touch, so the interval join is an equi-join on
    (document, block) whose groups are bounded by what fits into a block.
    """
    rows = table.where(F.size("weak") > 0).select("id", "doc_id", "key", F.explode(F.concat("weak", "found")).alias("x"))
    rows = rows.select("id", "doc_id", "key", "x.*").distinct()
    roles = F.array(*[F.lit(ROLE[k[0]]) for k in KINDS])
    rows = rows.withColumn("role", F.get(roles, F.col("k")))
    block = lambda c: F.floor(c / scope)
    wide = rows.where(F.col("k") >= BASE).withColumn(
        "b", F.explode(F.sequence(block(F.greatest(F.col("s") - scope, F.lit(0))), block(F.col("e") - 1 + scope)))
    )
    near = rows.withColumn("b", F.explode(F.sequence(block(F.col("s")), block(F.col("e") - 1))))

    def beside(left: DataFrame, role: str) -> DataFrame:
        r = near.where(F.col("role") == role).select(
            F.col("id").alias("id_"), F.col("key").alias("key_"), F.col("b").alias("b_"), F.col("s").alias("s_"), F.col("e").alias("e_")
        )
        gap = F.greatest(F.col("s_") - F.col("e"), F.col("s") - F.col("e_"))
        same = (F.col("id") == F.col("id_")) & (F.col("key") == F.col("key_")) & (F.col("b") == F.col("b_"))
        # the second part isn't the first one under another kind
        apart = (F.col("e_") <= F.col("s")) | (F.col("s_") >= F.col("e"))
        return left.join(r, same & (gap <= scope) & apart, "left_semi")

    is_role = lambda r: wide.where(F.col("role") == r)
    one = ["id", "doc_id", "key", "s", "k", "e"]
    ends = is_role("endpoint")
    near_id = beside(ends, "id").select(one).distinct()
    near_secret = beside(ends, "secret").select(one).distinct()
    linked = (
        beside(is_role("secret"), "id")
        .select(one)
        .unionByName(beside(is_role("id"), "secret").select(one))
        .distinct()
        .unionByName(near_id.join(near_secret, ["id", "key", "s", "k", "e"], "left_semi"))
    )
    return linked.groupBy("id", "key").agg(F.sort_array(F.collect_list(F.struct("s", "k", "e"))).alias("linked"))


def scan_documents(docs: DataFrame, scope: int = SCOPE, scratch: Scratch | None = None) -> DataFrame:
    """One row per row of docs with its secrets.

    doc_id; n_assign, n_access, n_hex; base_sha256 over the base spans; spans (base and
    linked weak ones) as kind:start:end by start, then kind in KINDS' order; n_linked.
    A null text is empty and has no secrets (base_sha256 is that of the empty string).
    Repeated rows get equal results; a null doc_id is a document of its own text; other
    columns are ignored. Spans are written to scratch once; the texts are read once.
    """
    table = (scratch or Scratch(docs.sparkSession, "secrets")).write(scanned(docs), "spans")
    of_kind = lambda k: F.size(F.filter("found", lambda x: x.k == k)).cast("bigint")
    base = table.select("doc_id", "id", "key", *[of_kind(k).alias(f"n_{KINDS[k][0]}") for k in range(BASE)], "found")
    out = base.join(weak_spans(table, scope), ["id", "key"], "left")
    linked = F.coalesce(F.col("linked"), F.array().cast("array<struct<s:bigint,k:int,e:bigint>>"))
    return out.select(
        "doc_id",
        *[f"n_{KINDS[k][0]}" for k in range(BASE)],
        F.sha2(_join(F.col("found")).cast("binary"), 256).alias("base_sha256"),
        _join(F.sort_array(F.concat("found", linked))).alias("spans"),
        F.size(linked).cast("bigint").alias("n_linked"),
    )


def _oracle() -> str:
    quote = lambda p: p.replace("'", "''")
    one = []
    for k, (name, p, g, least) in enumerate(KINDS):
        ok = f"length(regexp_extract(m, '{quote(p)}', {g})) >= {least}" if g else f"length(m) >= {least}"
        if name == "mixed":
            ok += "".join(f" AND regexp_matches(m, '{x}')" for x in MIXED_NEEDS)
        one.append(
            f"SELECT r, {k} AS k, '{name}' AS name, '{ROLE[name]}' AS role, st AS s, st + length(m) AS e FROM ("
            f"SELECT r, m, i, sum(length(p)) OVER w + coalesce(sum(length(m)) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS st "
            f"FROM (SELECT r, unnest(regexp_extract_all(t, '{quote(p)}', 0)) AS m, unnest(string_split_regex(t, '{quote(p)}')[:len(regexp_extract_all(t, '{quote(p)}', 0))]) AS p, "
            f"generate_subscripts(regexp_extract_all(t, '{quote(p)}', 0), 1) AS i FROM d) WINDOW w AS (PARTITION BY r ORDER BY i)) WHERE {ok}"
        )
    parts = " UNION ALL ".join(f"({x})" for x in one)
    near = (
        "EXISTS (SELECT 1 FROM parts b WHERE b.r = a.r AND b.role = '{}' AND (b.e <= a.s OR b.s >= a.e) "
        f"AND greatest(b.s - a.e, a.s - b.e) <= {SCOPE})"
    )
    counts = ", ".join(f"(count(*) FILTER (k = {k}))::BIGINT AS n_{KINDS[k][0]}" for k in range(BASE))
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS r FROM documents),
parts AS MATERIALIZED ({parts}),
shown AS (SELECT * FROM parts a WHERE k < {BASE} OR (role = 'secret' AND {near.format("id")}) OR (role = 'id' AND {near.format("secret")})
  OR (role = 'endpoint' AND {near.format("id")} AND {near.format("secret")})),
g AS (SELECT r, {counts}, string_agg(name || ':' || s::BIGINT || ':' || e::BIGINT, ',' ORDER BY s, k) FILTER (k < {BASE}) AS base,
  string_agg(name || ':' || s::BIGINT || ':' || e::BIGINT, ',' ORDER BY s, k) AS spans, (count(*) FILTER (k >= {BASE}))::BIGINT AS n_linked FROM shown GROUP BY r)
SELECT doc_id, {", ".join(f"coalesce(n_{KINDS[k][0]}, 0) AS n_{KINDS[k][0]}" for k in range(BASE))}, sha256(coalesce(base, '')) AS base_sha256,
  coalesce(spans, '') AS spans, coalesce(n_linked, 0) AS n_linked FROM d LEFT JOIN g USING (r)
"""


ORACLE = _oracle()
