"""Near duplicates, substring dedup, pieces, classifiers and the pipeline against plain Python."""

import hashlib
import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewire.llm import common, gam, jaccard, pieces, repeats, toxicity

from .conftest import corpus, prose


def components(rows):
    def shingles(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = {}
    for i, t in rows:
        sets.setdefault(i, []).append(shingles(t))
    ids = sorted(sets)
    top = {i: i for i in ids}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            if any(a and b and 100 * len(a & b) >= 80 * len(a | b) for a in sets[i] for b in sets[j]):
                a, b = sorted((find(i), find(j)))
                top[b] = a
    return {i: find(i) for i in ids}


def test_near_duplicates(frame, scratch, monkeypatch):
    monkeypatch.setattr(common.join_crowded, "__defaults__", ("times", 3))
    rows = corpus(n=80) + [(700, "one two"), (701, "ONE  two"), (702, "one two three"), (3, "a second text of document three with some more words")]
    df = frame(rows)
    got = jaccard.near_duplicates(df, scratch).collect()
    want = components(rows)
    assert len(got) == len(rows) + 4
    assert {r.doc_id: r.component_id for r in got if r.doc_id in want} == want
    assert all(r.component_id == r.doc_id for r in got if r.doc_id not in want)
    kept = jaccard.keep_one(df, scratch)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {i for i in want if want[i] == i} | {None, 900, 901, 902}
    assert jaccard.near_duplicates(frame([], odd=False), scratch).count() == 0


def test_hot_keys_give_way_to_rarer_ones(frame, scratch, monkeypatch):
    """One licence sentence in many short, unlike texts: no key stays hot, and no link is lost."""
    rng = random.Random(8)
    licence = prose(rng, 20)
    rows = [(i, f"{licence} {' '.join(f'w{rng.randrange(10**9)}' for _ in range(12))}") for i in range(60)]
    for i in range(20):
        w = rows[i][1].split(" ")
        w[-1] = f"n{i}"
        rows.append((60 + i, " ".join(w)))
    rows += [(80, licence), (81, licence + " a"), (80, rows[3][1]), (82, rows[4][1]), (82, rows[4][1])]
    df = frame(rows, odd=False)
    want = components(rows)
    for revisions in (0, 1, 3):
        got = {r.doc_id: r.component_id for r in jaccard.near_duplicates(df, scratch, 5, revisions).collect()}
        assert got == want
    one = scratch.write(df.select("doc_id", "text").mapInArrow(jaccard._sketches, "doc_id bigint, n_shingles bigint, f1 bigint, f2 bigint, keys array<bigint>"))
    most = lambda revisions: jaccard._rarest(df.select("doc_id", "text"), one, scratch, 5, revisions)[1].agg({"times": "max"}).first()[0]
    assert most(0) > 30 and most(3) <= 10


def test_chained_copies_around_hubs(frame, scratch, monkeypatch):
    """Copies of copies drift away from the first one; blocks of three force the block comparison to be split."""
    monkeypatch.setattr(jaccard._still_apart, "__defaults__", (3,))
    rng = random.Random(2)
    rows = []
    for g in range(6):
        w = prose(rng, 120).split(" ")
        for k in range(15):
            w = list(w)
            for _ in range(rng.choice([1, 2, 6])):
                w[rng.randrange(len(w))] = f"n{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(w)))
    rng.shuffle(rows)
    rows = [(i, t) for i, (_, t) in enumerate(rows)]
    got = {r.doc_id: r.component_id for r in jaccard.near_duplicates(frame(rows, odd=False), scratch).collect()}
    assert got == components(rows)


@pytest.mark.parametrize("n", [1, 2, 3, 7, 30, 300, 2000])
def test_keys_meet_at_the_threshold(n):
    rng = np.random.RandomState(n)
    for _ in range(20):
        a = np.unique(rng.randint(0, 2**62, n).astype(np.uint64))
        m = len(a)
        drop = rng.randint(0, m // 5 + 1)
        b = np.unique(np.concatenate((a[rng.permutation(m)[drop:]], rng.randint(0, 2**62, rng.randint(0, m // 5 + 1)).astype(np.uint64))))
        both = len(np.intersect1d(a, b))
        if both and 100 * both >= 80 * (m + len(b) - both):
            assert np.intersect1d(jaccard.band_keys(a), jaccard.band_keys(b)).size
            x, y = jaccard.bit_sketch(a), jaccard.bit_sketch(b)
            k = min(len(x), len(y))
            fold = lambda v: np.bitwise_xor.reduce(v.reshape(-1, k), axis=0)
            assert int(np.bitwise_count(fold(x) ^ fold(y)).sum()) <= m + len(b) - 2 * both


def test_keys_meet_for_every_pair_of_sizes():
    """Random sets of each pair of sizes that differ in as much as the threshold allows."""
    rng, lost = np.random.RandomState(4), {}
    for n in range(4, 65):
        for m in range(n, 100 * n // 80 + 1):
            d = jaccard.largest_difference(n, m)
            if d < m - n:
                continue
            both = (n + m - d) // 2
            for _ in range(150 if n < 16 else 25):
                x = rng.randint(0, 2**62, n + m - both).astype(np.uint64)
                a, b = np.sort(x[:n]), np.sort(x[n - both :])
                if not np.intersect1d(jaccard.band_keys(a), jaccard.band_keys(b)).size:
                    lost[n, m] = lost.get((n, m), 0) + 1
    assert not lost
    for n in range(1, 65):
        for largest in range(n, 100 * n // 80 + 1):
            assert jaccard.most_keys(n, largest) > max(jaccard.largest_difference(n, m) for m in range(-(-80 * n // 100), largest + 1))


def removed(rows):
    seen, out = {}, {}
    for i, t in sorted(set(rows)):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 99):
            if seen.setdefault(b[p : p + 100], (i, p)) != (i, p):
                gone[p : p + 100] = b"\1" * 100
        kept = bytes(x for x, g in zip(b, gone) if not g)
        runs = sum(1 for j in range(len(b)) if gone[j] and (not j or not gone[j - 1]))
        out[i] = (len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("hot", [50_000, 2])
def test_substring_dedup(frame, scratch, hot, monkeypatch):
    monkeypatch.setattr(common.join_crowded, "__defaults__", ("times", 3))
    rng = random.Random(4)
    rows = corpus() + [(800, "ab" * 300), (801, "x" * 99), (802, "y" * 100), (803, "y" * 150), (804, "é" * 80 + prose(rng, 30))]
    rows += [(805, prose(rng, 10) + "é" * 80 + " z")]
    got = repeats.dedup_substrings(frame(rows), scratch, hot).collect()
    want = removed(rows)
    assert len(got) == len(rows) + 4
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got if r.doc_id in want} == want
    assert all(r.n_removed == 0 for r in got if r.doc_id not in want)
    assert repeats.dedup_substrings(frame([], odd=False), scratch, hot).count() == 0


def test_substring_dedup_of_zero_bytes(frame, scratch):
    """Shared strings followed by different numbers of zero bytes: padding must not hide where they end."""
    rng = random.Random(9)
    rows = []
    for i in range(60):
        core = prose(random.Random(i % 4), 30)[:98]
        rows.append((i, "\0" * rng.randrange(3) + core + "\0" * rng.randrange(6)))
    for hot in (50_000, 2):
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.dedup_substrings(frame(rows, odd=False), scratch, hot).collect()}
        assert got == removed(rows) and sum(x[1] for x in got.values()) > 1000


def test_covered_equals_brute_force_with_zero_bytes():
    rng = np.random.RandomState(3)
    for _ in range(200):
        n = rng.randint(3, 9)
        lefts = [b"ab"[: rng.randint(0, 3)] + b"\0" * rng.randint(0, 3) + b"L" * 40 for _ in range(n)]
        rights = [b"R" * 58 + b"\0" * rng.randint(0, 6) + b"xy"[: rng.randint(0, 3)] for _ in range(n)]
        pos = np.array([len(x) for x in lefts])
        row, start, end = repeats.covered(np.zeros(n, np.int64), np.arange(n), pos, lefts, rights)
        got = [bytearray(len(a + b)) for a, b in zip(lefts, rights)]
        for i, s, e in zip(row, start, end):
            got[i][s:e] = b"\1" * (e - s)
        seen: dict[bytes, int] = {}
        for i, t in enumerate(a + b for a, b in zip(lefts, rights)):
            want = bytearray(len(t))
            for p in range(len(t) - 99):
                if seen.setdefault(t[p : p + 100], i) != i:
                    want[p : p + 100] = b"\1" * 100
            assert got[i] == want


def test_maximal_repeats_list_all_occurrences():
    core = bytes(range(65, 65 + 26)) * 2
    lefts = [b"AAA" + core[:20], b"BBB" + core[:20], b"CCB" + core[:20]]
    rights = [core + b"xxx", core + b"yyy", core + b"yyz"]
    found = {(left, right): sorted(m.tolist()) for left, right, m in repeats.maximal_repeats(lefts, rights, 60)}
    assert found[20, 52] == [0, 1, 2] and found[21, 54] == [1, 2]


def test_pieces_equal_the_library(spark, frame):
    sp = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=pieces.MODEL)
    rng = random.Random(6)
    texts = ["".join(rng.choice(" ab  theing\n\t);}é\U0001f642融\0") for _ in range(rng.choice([1, 5, 40, 300]))) for _ in range(120)]
    rows = list(enumerate(texts)) + corpus()[:20]
    rows = [(1000 + k, t) for k, (_, t) in enumerate(rows)] + [(2000, "a" * 3000)]
    got = {r.doc_id: r.ids for r in pieces.encode_documents(frame(rows)).collect()}
    assert all(got[i] == sp.encode(t) for i, t in rows)
    assert got[900] == [] and got[901] == [] and None in got
    back = {r.doc_id: r.text for r in pieces.decode_documents(pieces.encode_documents(frame(rows))).collect()}
    assert all(back[i] == t for i, t in rows)
    assert all(r.exact for r in pieces.round_trip(frame(rows)).collect())
    for units in (0, 30):  # which units go by joins must not matter; repeated rows give repeated results
        few = pieces.encode_documents(frame([*rows, rows[5]]), units=units).collect()
        assert len(few) == len(rows) + 5 and all(x.ids == got[x.doc_id] for x in few)
    assert pieces.encode_documents(frame([], odd=False)).count() == 0
    words = [("▁" + w,) for t in texts[:40] for w in t.replace(" ", "▁").split("▁") if w] + [("▁▁▁x",)]
    v = pieces.Vocabulary()
    for r in pieces.encode_words(spark.createDataFrame(words, "word string")).collect():
        assert r.ids == pieces.encode_unit(r.word, v)


def test_best_path_folds_agree(spark, monkeypatch):
    class Tiny:
        pieces = {"a": (-1.0, 5), "b": (-1.5, 6), "ab": (-1.2, 7), "ba": (-3.0, 8), "aba": (-3.1, 9)}
        bytes = list(range(100, 356))
        out = []
        longest, merges = 3, False

    monkeypatch.setattr(pieces, "Vocabulary", lambda path=None: Tiny)
    words = ["a", "ab", "aba", "abab", "ac", "bbaab", "é"]
    got = {r.word: r.ids for r in pieces.encode_words(spark.createDataFrame([(w,) for w in words], "word string")).collect()}
    assert got == {w: pieces.encode_unit(w, Tiny) for w in words}
    assert got["abab"] == [7, 7] and got["é"] == [100 + 0xC3, 100 + 0xA9]


def labelled(spark, rng, n, label, make):
    docs = [(i, make(rng, i % 2)) for i in range(n)]
    return docs, spark.createDataFrame([(i, i % 2) for i in range(n)] + [(None, 1), (5000, None)], f"doc_id bigint, {label} int")


def test_labelled_sample_of_repeated_rows(spark, frame):
    docs = [(i, f"text {i}") for i in range(40)] * 3 + [(7, "a second text")]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] * 2 + [(8, 1)], "doc_id bigint, toxic int")
    got = common.labelled_sample(frame(docs), labels, "toxic", 0, 5, 6).collect()
    assert sorted(r.y for r in got) == [0] * 6 + [1] * 6 and len({r.doc_id for r in got}) == 12
    every = {r.doc_id: (r.text, r.y) for r in common.labelled_sample(frame(docs), labels, "toxic", -1, 5, 100).collect()}
    assert len(every) == 40 and every[7] == ("a second text", 1) and every[8] == ("text 8", 1)


def test_scratch_on_a_cluster_needs_a_shared_folder(spark):
    class Cluster:
        conf = type("C", (), {"get": staticmethod(lambda *_: None)})
        sparkContext = type("S", (), {"master": "spark://host:7077"})

    with pytest.raises(RuntimeError):
        common.Scratch(Cluster, "x")


def test_toxicity_learns_roots(spark, frame):
    def make(rng, bad):
        w = prose(rng, rng.choice([20, 60, 200])).split(" ")
        if bad:
            for _ in range(1 + len(w) // 40):
                w.insert(rng.randrange(len(w)), "grumblo" + rng.choice(["st", "ck", "ving", "x", "den", "lor", "mi", "qua"]))
        return " ".join(w)

    docs, labels = labelled(spark, random.Random(1), 400, "toxic", make)
    docs.append((9000, prose(random.Random(9), 3000) + " grumblozap " + prose(random.Random(10), 3000)))  # unseen ending, long text
    docs.append((9001, prose(random.Random(11), 6000)))
    df = frame(docs)
    model = toxicity.fit(df, labels, 150)
    got = {r.doc_id: r for r in toxicity.score_documents(df, model).collect()}
    held = [i for i in range(400) if got[i].held_out]
    assert held and np.mean([got[i].predicted == i % 2 for i in held]) >= 0.95
    assert got[9000].predicted == 1 and got[9001].predicted == 0 and got[901].predicted == 0
    assert all(0 <= r.score <= 1 for r in got.values())
    empty = toxicity.fit(df, labels.limit(0))
    assert toxicity.score_documents(df, empty).where("score is null").count() == 0


def test_quality_model(spark, frame):
    def make(rng, good):
        t = prose(rng, rng.choice([30, 100, 300]))
        return t if good else rng.choice([lambda: " ".join(x + "$$$" for x in t.split(" ")), lambda: " | ".join(t.split(" ")), lambda: " ".join(t.split(" ")[i // 9] for i in range(len(t.split(" "))))])()

    docs, labels = labelled(spark, random.Random(2), 300, "quality", make)
    df = frame(docs)
    got = {r.doc_id: r for r in gam.score_documents(df, gam.fit(df, labels, 100)).collect()}
    held = [i for i in range(300) if got[i].held_out]
    assert held and np.mean([got[i].predicted == i % 2 for i in held]) >= 0.97
    assert all(0 <= r.score <= 1 for r in got.values()) and len(got) == 304
    assert gam.score_documents(df, gam.fit(df, labels.limit(0))).where("score is null").count() == 0


PIPELINE_SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, n_removed string, fingerprint int"


def test_pipeline_against_brute_force(spark, tmp_path):
    import corpus_pipeline
    from tidewire.llm import lines

    from .test_native import cleaned, leaks, one_edit

    sp = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=pieces.MODEL)
    rng = random.Random(12)
    item = prose(rng, 30)
    rows = corpus(seed=21, n=24)  # with a repeated row and a long text
    rows += [(500, prose(rng, 60) + " " + item + " " + prose(rng, 40)), (501, " | ".join(prose(rng, 60).split(" "))), (502, None), (503, "")]
    rows += [(504, prose(rng, 70).replace(".\n", ".\nHome | About us | Contact | Help\n", 2)), (None, prose(rng, 70)), (None, prose(rng, 70))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", 1) for i, t in rows], PIPELINE_SCHEMA)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item), (None, None)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    left = [(i, cleaned(t)[0]) for i, t in rows if cleaned(t)[2]]
    assert any(cleaned(t)[1] for i, t in rows if i == 504) and 501 not in dict(left)
    earlier, kept = [], []
    for i, t in sorted({x for x in left if x[0] is not None}):
        ls = []
        for x in t.split("\n"):
            w = x.split()
            near = w in earlier if len(w) < lines.MIN_WORDS else any(one_edit(w, e) for e in earlier if len(e) >= lines.MIN_WORDS)
            if not (w and near):
                ls.append(x)
            earlier.append(w)
        if "\n".join(ls).strip():
            kept += [(i, "\n".join(ls))] * left.count((i, t))
    comp = components(kept)
    kept = [(i, t) for i, t in kept if comp[i] == i]
    bad = {d for d, _ in leaks(kept, [(1, item)])}
    assert 500 in bad
    want = [(i, sp.encode(t)) for i, t in kept if i not in bad] + [(i, sp.encode(t)) for i, t in left if i is None]
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted([(r.doc_id, r.ids) for r in got], key=repr) == sorted(want, key=repr) and len(want) > 5


def test_pipeline_of_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], PIPELINE_SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_driver_tables_have_oracles():
    from tidewire.llm import queries

    assert [q.split("_")[0] for q in queries.queries()] == [f"op{i}" for i in range(1, 14)]
    assert set(queries.oracle_sql()) < set(queries.queries())
    for p in Path(queries.__file__).parent.glob("*.py"):
        assert "localCheckpoint" not in p.read_text()
