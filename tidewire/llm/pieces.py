"""SentencePiece encoding and decoding over a lattice of pieces.

A text becomes units that no piece crosses (words with the space mark before them). Units
are encoded once, by joins (`encode_words`): their substrings of bounded length are
exploded and equi-joined to the piece table, the matches, grouped by unit, are the edges
of its lattice, and a higher-order aggregate folds each lattice into pieces. The texts are
then put together from the units.

Texts hold more units than can be broadcast or shuffled back to their documents, so the
joins serve the UNITS most frequent ones, found by a count over all texts; their pieces go
to the tasks that put the texts together. Any other unit (rare ones, long ones, those with
several space marks) is encoded by the task that meets it, by the same lattice in arrays.
The result does not depend on which way a unit goes.

The fold depends on the model. Merge-trained (BPE) models join, again and again, the two
neighbours whose union is the best-scored piece; a best-path (Viterbi) fold gives other,
wrong pieces for them, so it is used for unigram models only.

Only counts of units are shuffled; the piece table (tens of thousands of rows, fixed by
the model file) and the UNITS encoded units are all that is broadcast.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, let, mix

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE_MARK = "▁"
#: Most frequent units that are encoded by joins and broadcast, of at most LONG characters each.
UNITS = 50_000
#: Encoded units that a task keeps at hand before it starts anew.
CACHE = 500_000
#: Units of more characters are folded one by one.
LONG = 48
_STEP = np.uint64(0x9E3779B97F4A7C15)


class Vocabulary:
    """What a model file holds: pieces with id and score, byte ids, the unknown id and the kind of fold."""

    def __init__(self, path: str = MODEL):
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=path)
        n = p.get_piece_size()
        self.pieces = {}
        self.bytes = [p.unk_id()] * 256
        self.out = [b""] * n
        for i in range(n):
            s = p.id_to_piece(i)
            if p.is_byte(i):
                self.bytes[int(s[3:5], 16)] = i
                self.out[i] = bytes([int(s[3:5], 16)])
            elif not (p.is_control(i) or p.is_unknown(i) or p.is_unused(i)):
                self.pieces[s] = (p.get_score(i), i)
                self.out[i] = s.replace(SPACE_MARK, " ").encode()
        self.longest = max(map(len, self.pieces), default=1)
        # merge-trained models rank their pieces: scores are whole negative numbers
        self.merges = all(float(s).is_integer() for s, _ in self.pieces.values())
        if any(SPACE_MARK in s.lstrip(SPACE_MARK) for s in self.pieces):
            raise ValueError("a piece holds a space mark after another character: units would not be independent")


_UNIT = re.compile(f"{SPACE_MARK}*[^{SPACE_MARK}]+|{SPACE_MARK}+")


def units_of(text: str) -> list[str]:
    """Units of a text: each is a run of space marks and what follows up to the next one; joined they give the text."""
    if not text:
        return []
    if "  " not in text and SPACE_MARK not in text and text[0] != " " and text[-1] != " ":
        return text.split(" ")  # one mark before each, left out
    return [u[1:] if len(u) > 1 and u[0] == SPACE_MARK and u[1] != SPACE_MARK else "\0" + u for u in _UNIT.findall(SPACE_MARK + text.replace(" ", SPACE_MARK))]


def _full(unit: str) -> str:
    """A unit with its marks: those of units_of with one mark are given without it, others are marked by a zero."""
    return unit[1:] if unit.startswith("\0" + SPACE_MARK) else SPACE_MARK + unit


def lattice(unit: str, v: Vocabulary) -> dict[tuple[int, int], tuple[float, int]]:
    """The edges of a unit: every substring of up to the longest piece's length that is a piece."""
    get, n = v.pieces.get, len(unit)
    spans = [(s, e) for s in range(n) for e in range(s + 1, min(n, s + v.longest) + 1)]
    return {x: hit for x in spans if (hit := get(unit[x[0] : x[1]])) is not None}


def fold_merges(n: int, edges: dict[tuple[int, int], tuple[float, int]]) -> list[int]:
    """Cut points after joining the best-scored neighbours (the left ones of equals) until none is a piece."""
    if n > LONG:  # the same by a heap, for long units
        after, before = list(range(1, n + 2)), list(range(-1, n))
        heap = [(-edges[i, i + 2][0], i, i + 1, i + 2) for i in range(n - 1) if (i, i + 2) in edges]
        heapq.heapify(heap)
        gone = [False] * (n + 1)
        while heap:
            _, a, m, b = heapq.heappop(heap)
            if gone[a] or gone[m] or gone[b] or after[a] != m or after[m] != b:
                continue
            gone[m] = True
            after[a], before[b] = b, a
            for x, y, z in ((before[a], a, b), (a, b, after[b] if b < n else n + 1)):
                if x >= 0 and z <= n and (x, z) in edges:
                    heapq.heappush(heap, (-edges[x, z][0], x, y, z))
        return [i for i in range(n + 1) if not gone[i]]
    cuts = list(range(n + 1))
    while len(cuts) > 2:
        best, at = None, 0
        for i in range(len(cuts) - 2):
            hit = edges.get((cuts[i], cuts[i + 2]))
            if hit is not None and (best is None or hit[0] > best):
                best, at = hit[0], i + 1
        if best is None:
            break
        del cuts[at]
    return cuts


def fold_best_path(n: int, edges: dict[tuple[int, int], tuple[float, int]], longest: int, unknown: float) -> list[int]:
    """Cut points of the path of the highest total score; a character that is no piece costs `unknown`."""
    score, back = [0.0] + [-np.inf] * n, [0] * (n + 1)
    for e in range(1, n + 1):
        for s in range(max(0, e - longest), e):
            hit = edges.get((s, e))
            x = score[s] + (hit[0] if hit is not None else unknown if e == s + 1 else -np.inf)
            if x > score[e]:
                score[e], back[e] = x, s
    cuts = [n]
    while cuts[-1]:
        cuts.append(back[cuts[-1]])
    return cuts[::-1]


def encode_unit(unit: str, v: Vocabulary) -> list[int]:
    edges = lattice(unit, v)
    if v.merges:
        cuts = fold_merges(len(unit), edges)
    else:
        cuts = fold_best_path(len(unit), edges, v.longest, min((s for s, _ in v.pieces.values()), default=0.0) - 10)
    ids = []
    for s, e in zip(cuts, cuts[1:]):
        hit = edges.get((s, e))
        ids += [hit[1]] if hit is not None else [v.bytes[b] for b in unit[s:e].encode()]
    return ids


def _codes(units: list[str], n: int) -> np.ndarray:
    """The code points of units of n characters, a row each."""
    return np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, n)


class Lattices:
    """Lattices of many units at once: substrings of bounded length as hashes, matched with the sorted piece table."""

    def __init__(self, v: Vocabulary):
        self.v = v
        names = sorted(v.pieces, key=len)
        keys = np.concatenate([self._substrings(_codes(list(same), n))[-1][:, 0] for n, same in groupby(names, len)])
        order = np.argsort(keys)
        self.keys = keys[order]
        self.scores = np.array([v.pieces[s][0] for s in names], np.float32)[order]
        self.ids = np.array([v.pieces[s][1] for s in names], np.int32)[order]
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[self.keys & np.uint64(len(self.maybe) - 1)] = True

    def _substrings(self, codes: np.ndarray) -> list[np.ndarray]:
        """Per length 1, 2, ... the hashes of all substrings: one row per unit, one column per start."""
        x = mix(codes.astype(np.uint64) + np.uint64(1))
        out, roll = [], np.zeros_like(x)
        for n in range(1, min(self.v.longest, codes.shape[1]) + 1):
            roll = roll[:, : codes.shape[1] - n + 1] * _STEP + x[:, n - 1 :]
            out.append(mix(roll + np.uint64(n)))
        return out

    def edges(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(score, id) by unit, start and length; -inf and -1 where a substring is no piece."""
        rows, n = codes.shape
        most = min(self.v.longest, n)
        score, ids = np.full((rows, n, most + 1), -np.inf, np.float32), np.full((rows, n, most + 1), -1, np.int32)
        for size, h in enumerate(self._substrings(codes), 1):
            r, c = np.nonzero(self.maybe[h & np.uint64(len(self.maybe) - 1)])
            found = h[r, c]
            at = np.minimum(np.searchsorted(self.keys, found), len(self.keys) - 1)
            ok = self.keys[at] == found
            score[r[ok], c[ok], size], ids[r[ok], c[ok], size] = self.scores[at[ok]], self.ids[at[ok]]
        return score, ids

    def fold(self, units: list[str]) -> list[bytes]:
        """fold_merges of units of one length: each round joins the best neighbours of every unit that still has some,
        so units still in play always have equally many pieces."""
        n = len(units[0])
        score, ids = self.edges(_codes(units, n))
        most = score.shape[2] - 1
        out, live = [b""] * len(units), np.arange(len(units))
        cuts = np.tile(np.arange(n + 1), (len(units), 1))
        while len(live):
            if cuts.shape[1] > 2:
                size = cuts[:, 2:] - cuts[:, :-2]
                value = np.where(size <= most, score[live[:, None], cuts[:, :-2], np.minimum(size, most)], -np.inf)
                best = value.argmax(1)
                more = value[np.arange(len(live)), best] > -np.inf
            else:
                best, more = np.zeros(len(live), np.int64), np.zeros(len(live), bool)
            done, last = live[~more], cuts[~more]
            got = ids[done[:, None], last[:, :-1], last[:, 1:] - last[:, :-1]]
            for i, row, at, known in zip(done.tolist(), got.astype("<i4"), last, (got >= 0).all(1)):
                out[i] = row.tobytes() if known else self._with_bytes(units[i], row.tolist(), at.tolist())
            live, cuts, best = live[more], cuts[more], best[more]
            keep = np.arange(cuts.shape[1]) != best[:, None] + 1
            cuts = cuts[keep].reshape(len(live), cuts.shape[1] - 1)
        return out

    def _with_bytes(self, unit: str, row: list[int], cuts: list[int]) -> bytes:
        """The ids of a cut unit in which some characters (-1) are no piece and go by their bytes."""
        ids: list[int] = []
        for x, s, e in zip(row, cuts, cuts[1:]):
            ids += [x] if x >= 0 else [self.v.bytes[b] for b in unit[s:e].encode()]
        return np.array(ids, "<i4").tobytes()


class Encoder:
    """Encodes texts; distinct units are encoded once, many at a time, while their number stays under CACHE."""

    def __init__(self, v: Vocabulary, known: dict[str, bytes] | None = None):
        self.v, self.known = v, known or {}
        self.seen = dict(self.known)
        self.lattices = Lattices(v) if v.merges else None

    def learn(self, units: set[str]) -> None:
        """Encodes the units not seen yet: those of one length together, long ones and best-path models one by one."""
        by_size: dict[int, list[str]] = {}
        for u in units - self.seen.keys():
            by_size.setdefault(len(_full(u)), []).append(u)
        for n, us in by_size.items():
            if self.lattices is None or n > LONG:
                for u in us:
                    self.seen[u] = np.array(encode_unit(_full(u), self.v), "<i4").tobytes()
                continue
            step = max(1, (1 << 21) // (n * (min(n, self.v.longest) + 1)))
            for i in range(0, len(us), step):
                part = us[i : i + step]
                self.seen.update(zip(part, self.lattices.fold([_full(u) for u in part])))

    def many(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as 32-bit little-endian integers."""
        if len(self.seen) > CACHE + len(self.known):
            self.seen = dict(self.known)
        split = [units_of(t or "") for t in texts]
        self.learn(set().union(*split))
        return [b"".join(map(self.seen.__getitem__, units)) for units in split]

    def __call__(self, text: str | None) -> bytes:
        return self.many([text])[0]

    def decode(self, ids: bytes) -> bytes:
        """The text of ids, without the space that encoding puts first."""
        out = b"".join(map(self.v.out.__getitem__, np.frombuffer(ids, "<i4").tolist()))
        return out[1:] if out.startswith(b" ") else out


def encode_documents(docs: DataFrame, path: str = MODEL, units: int = UNITS) -> DataFrame:
    """doc_id, ids (array<int>) per row of docs.

    The `units` most frequent units are encoded by joins, any others in the tasks. A null
    or empty text has no ids, an empty table gives no rows. Texts that hold the space mark itself decode to a
    space there (as the model has it). Repeated rows, null doc_ids and other columns don't matter.
    """
    shared = docs.sparkSession.sparkContext.broadcast((Vocabulary(path), known_units(docs, path, units)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(*shared.value)
        for batch in batches:
            for lo in range(0, len(batch), 200):
                part = batch.slice(lo, 200)
                out = [np.frombuffer(x, "<i4") for x in encode.many(part.column("text").to_pylist())]
                ends = np.concatenate(([0], np.cumsum([len(x) for x in out]))).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(out)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), ids], names=["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, ids array<int>")


def decode_documents(encoded: DataFrame, path: str = MODEL) -> DataFrame:
    """doc_id, text of rows doc_id, ids; null ids give the empty text, byte runs that are not UTF-8 are replaced."""
    shared = encoded.sparkSession.sparkContext.broadcast(Vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = Encoder(shared.value).decode
        for batch in batches:
            texts = [decode(np.array(x or [], "<i4").tobytes()).decode("utf-8", "replace") for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, text string")


def round_trip(docs: DataFrame, path: str = MODEL, units: int = UNITS) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of 32-bit little-endian ids), decoded_sha256 and exact (decoded = text) per row of docs.

    Cases as in encode_documents.
    """
    shared = docs.sparkSession.sparkContext.broadcast((Vocabulary(path), known_units(docs, path, units)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(*shared.value)
        for batch in batches:
            rows = []
            for lo in range(0, len(batch), 200):
                texts = batch.column("text").slice(lo, 200).to_pylist()
                for t, ids in zip(texts, encode.many(texts)):
                    back = encode.decode(ids)
                    rows.append(
                        (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(back).hexdigest(), back == (t or "").encode())
                    )
            cols = list(zip(*rows)) or [()] * 4
            types = (pa.int64(), pa.string(), pa.string(), pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(c, t) for c, t in zip(cols, types)]],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "exact"],
            )

    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string, exact boolean"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


# ---------------------------------------------------------------- the lattice as Spark joins


def frequent_units(docs: DataFrame, scratch: Scratch, most: int = UNITS) -> DataFrame:
    """word (with its space mark) of all units of under LONG characters that occur so often that there are at most `most` of them.

    How often that is comes from the number of units by count, a table of few rows, so
    units are never sorted in one task.
    """
    word = F.explode(F.split(F.coalesce(F.col("text"), F.lit("")), " ", -1)).alias("u")
    plain = (F.col("u") != "") & ~F.contains("u", F.lit(SPACE_MARK)) & (F.length("u") < LONG)
    counts = scratch.write(docs.select(word).where(plain).groupBy("u").agg(F.count("*").alias("n")), "units")
    by = counts.groupBy("n").agg(F.count("*").alias("units"))
    upto = F.sum("units").over(Window.orderBy(F.desc("n")))
    least = by.withColumn("upto", upto).where(F.col("upto") <= most).agg(F.min("n").alias("least"))
    return counts.join(F.broadcast(least), F.col("n") >= F.col("least")).select(F.concat(F.lit(SPACE_MARK), "u").alias("word"))


def known_units(docs: DataFrame, path: str = MODEL, most: int = UNITS) -> dict[str, bytes]:
    """The ids of the most frequent units (without their space mark), as 32-bit little-endian integers."""
    scratch = Scratch(docs.sparkSession, "units")
    t = encode_words(frequent_units(docs, scratch, most), path).toArrow()
    scratch.close()
    return {w[1:]: np.array(x, "<i4").tobytes() for w, x in zip(t["word"].to_pylist(), t["ids"].to_pylist())}


def piece_table(spark: SparkSession, path: str = MODEL) -> DataFrame:
    rows = [(s, float(x), i) for s, (x, i) in Vocabulary(path).pieces.items()]
    return spark.createDataFrame(rows, "piece string, score double, id int")


def encode_words(words: DataFrame, path: str = MODEL) -> DataFrame:
    """word, ids of each distinct word (a unit with its space marks), by joins and aggregates alone.

    Substrings of bounded length are exploded, equi-joined to the piece table and grouped by
    word; the fold over a word's edges is a higher-order aggregate.
    """
    v = Vocabulary(path)
    w = words.select("word").where("word <> ''").distinct()
    n = F.length("word")
    spans = F.flatten(
        F.transform(
            F.sequence(F.lit(0), n - 1),
            lambda s: F.transform(
                F.sequence(s + 1, F.least(n, s + v.longest)), lambda e: F.struct(s.alias("s"), e.alias("e"), F.substr("word", s + 1, e - s).alias("piece"))
            ),
        )
    )
    edges = w.select("word", F.explode(spans).alias("x")).select("word", "x.*")
    edges = edges.join(F.broadcast(piece_table(words.sparkSession, path)), "piece", "left")
    edges = edges.where(F.col("id").isNotNull() | (F.col("e") == F.col("s") + 1))
    found = edges.groupBy("word").agg(F.collect_list(F.struct("s", "e", "score", "id")).alias("edges"))
    e = F.col("edges")
    at = lambda s, t: s.cast("bigint") * (1 << 24) + t  # noqa: E731  # an edge from s to t, as one number
    known = F.filter(e, lambda x: x.id.isNotNull())
    table = lambda f: F.map_from_entries(F.transform(known, lambda x: F.struct(at(x.s, x.e), x[f])))
    if v.merges:
        def step(cuts, scores):  # without the cut between the best neighbours (the left ones of equals); the same cuts if none are a piece
            some = F.transform(F.sequence(F.lit(0), F.size(cuts) - 3), lambda i: F.element_at(scores, at(F.get(cuts, i), F.get(cuts, i + 2))))
            left = lambda joined: F.array_position(joined, F.array_max(joined)).cast("int")
            without = lambda k: F.when(k > 0, F.concat(F.slice(cuts, F.lit(1), k), F.slice(cuts, k + 2, F.size(cuts)))).otherwise(cuts)
            return F.when(F.size(cuts) < 3, cuts).otherwise(let(some, lambda x: let(F.coalesce(left(x), F.lit(0)), without)))

        fold = lambda scores: F.aggregate(F.sequence(F.lit(1), n), F.sequence(F.lit(0), n), lambda acc, _: step(acc, scores))
        cuts = let(table("score"), fold)  # a map named by let is made once, not at every look into it
    else:
        low = min((s for s, _ in v.pieces.values()), default=0.0) - 10
        nodes = F.array_sort(F.transform(e, lambda x: F.struct(x.e.alias("e"), x.s.alias("s"), F.coalesce(x.score, F.lit(low)).alias("score"))))
        zero = F.array(F.struct(F.lit(0.0).alias("score"), F.array(F.lit(0)).alias("path"), F.lit(0).alias("e")))

        def relax(acc, x):  # acc[i]: best path to i; edges come by their end
            old, via = F.get(acc, x.e), F.get(acc, x.s)
            new = F.struct((via.score + x.score).alias("score"), F.concat(via.path, F.array(x.e)).alias("path"), x.e.alias("e"))
            return (
                F.when(old.isNull(), F.concat(acc, F.array(new)))
                .when(old.score < new.score, F.concat(F.slice(acc, F.lit(1), x.e), F.array(new)))
                .otherwise(acc)
            )

        cuts = F.element_at(F.aggregate(nodes, zero, relax), -1).path
    codes = F.array(*[F.lit(b) for b in v.bytes])

    def ids_of(a, b, ids):
        id_ = F.element_at(ids, at(a, b))
        raw = F.hex(F.encode(F.substr("word", a + 1, F.lit(1)), "utf-8"))  # what is no piece is one character
        as_bytes = F.transform(
            F.sequence(F.lit(0), (F.length(raw) / 2).cast("int") - 1),
            lambda k: F.get(codes, F.conv(F.substr(raw, k * 2 + 1, F.lit(2)), 16, 10).cast("int")),
        )
        return F.when(id_.isNotNull(), F.array(id_)).otherwise(as_bytes)

    every = lambda c, ids: F.flatten(F.transform(F.slice(c, F.lit(1), F.size(c) - 1), lambda a, i: ids_of(a, F.get(c, i + 1), ids)))
    return found.select("word", let(cuts, lambda c: let(table("id"), lambda ids: every(c, ids))).alias("ids"))
