import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quaverlake.functions import scalar, text, vec
from quaverlake.operators import checks, curation, knn, matching, metrics, study, tokens, vocab
from tests.support import rows


def vectors(spark, table, key="item_id"):
    return spark.createDataFrame([(k, [float(x) for x in v]) for k, v in table.items()], f"{key} string, emb array<float>")


def test_search_is_exact_with_ties_by_key(spark):
    rng = np.random.default_rng(1)
    table = {f"i{k:03d}": rng.normal(size=8) for k in range(200)}
    table["i150"] = table["i003"]
    table |= {"zero": [0.0] * 8, "nan": [math.nan] * 8}
    cat = vectors(spark, table)
    queries = cat.where("item_id < 'i040'").select(F.col("item_id").alias("query_id"), F.col("emb").alias("qvec"))
    names = sorted(k for k in table if k.startswith("i"))
    x = np.array([np.array(table[k], np.float32).astype(float) for k in names])
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    for exclude in (False, True):
        got = {}
        for r in knn.exact_topk(cat, queries, 3, dims=8, exclude_self=exclude).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append(r["item"])
        for q in names[:40]:
            score = np.round(x @ x[names.index(q)], 6)
            order = [names[i] for i in np.argsort(-score, kind="stable") if not (exclude and names[i] == q)]
            assert got[q] == order[:3]
    assert knn.exact_topk(cat.limit(0), queries, 3, dims=8).count() == 0


def test_centroid_and_diversity(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(30, 4))
    df = spark.createDataFrame([(i % 3, [float(v) for v in r]) for i, r in enumerate(x)] + [(0, None), (9, [1.0, 0.0, 0.0, 0.0])], "g long, emb array<double>")
    got = {r.g: r for r in knn.centroids(df, "g", "emb", 4).collect()}
    for g in range(3):
        part = x[g::3]
        assert np.allclose(got[g].mu, part.mean(0)) and abs(got[g].sigma2 - ((part - part.mean(0)) ** 2).sum(1).mean()) < 1e-9
    d = {r.g: r.diversity for r in knn.diversity(df, "g", "emb", 4).collect()}
    assert 9 not in d
    for g in range(3):
        u = x[g::3] / np.sqrt((x[g::3] ** 2).sum(1, keepdims=True))
        assert abs(d[g] - (1 - np.mean([u[i] @ u[j] for i, j in itertools.combinations(range(10), 2)]))) < 1e-9


def test_greedy_distinct_equals_the_sequential_pass(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(120, 5))
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    df = spark.createDataFrame([(f"c{i}", i, [float(v) for v in r]) for i, r in enumerate(x)], "c string, o long, emb array<double>")
    for t in (0.5, 0.8, 1.0):
        kept = []
        for i in range(120):
            if t >= 1 or all(x[i] @ x[j] <= t for j in kept):
                kept.append(i)
        assert rows(knn.greedy_distinct(df, "c", "o", "emb", t)) == sorted([(f"c{i}",) for i in kept], key=repr)


def test_selection(spark):
    df = spark.createDataFrame([("g", 0, "a", [1.0, 0.0]), ("g", 1, "b", [0.9, 0.1]), ("g", 2, "c", [0.0, 1.0]), ("g", 3, "d", [-1.0, 0.0]), ("g", 4, "a", [1.0, 0.0])], "g string, o int, i string, v array<double>")
    assert [r["item"] for r in knn.coverage_selection(df, "g", "o", "i", "v", 3).orderBy("place").collect()] == ["a", "d", "c"]
    pool = spark.createDataFrame([("q", "1", 1.0, [1.0, 0.0]), ("q", "2", 0.99, [1.0, 0.0]), ("q", "3", 0.8, [0.8, 0.6])], "g string, i string, r double, v array<double>")
    assert [r["item"] for r in knn.diverse_selection(pool, "g", "i", "r", "v", 2, 0.5).orderBy("place").collect()] == ["1", "3"]
    hits = spark.createDataFrame([("q", "1", 1.0, 1), ("q", "2", 0.8, 2)], "query_id string, item string, score double, rank int")
    r = knn.assigned(hits, 4).first()
    assert r.ids == [1, 2, 0, 0] and r.scores == [1.0, 0.8, None, None]


def test_one_to_one_matching(spark):
    left = spark.createDataFrame([("1", "A", "Unique"), ("2", "A", "Duplicate"), ("3", "A", "Song - 2009 Remaster"), ("4", None, "x")], "id string, artist string, title string")
    right = spark.createDataFrame([("a", "a", "unique"), ("b", "A", "Duplicate"), ("c", "A", "Duplicate"), ("d", "A", "Song")], "id string, artist string, title string")
    got = matching.cascade(matching.keyed(left, "id", "artist", "title"), matching.keyed(right, "id", "artist", "title"))
    assert rows(got, "left_id", "right_id", "match_type") == [("1", "a", "strict"), ("3", "d", "relaxed-version")]
    keys = spark.createDataFrame([("Booker T. & the M.G.'s",), ("Booker T and the MGs",), ("Édith",), (None,)], "t string").select(text.match_key("t").alias("k")).collect()
    assert keys[0].k == keys[1].k == "booker t and the mgs" and keys[2].k == "edith" and keys[3].k is None


def test_curation_reaches_a_fixpoint(spark):
    rng = random.Random(4)
    data = {k: [f"i{int(rng.paretovariate(0.8)) % 40}" for _ in range(rng.randrange(2, 30))] for k in range(150)}
    df = spark.createDataFrame([(k, v + [None, " "]) for k, v in data.items()], "k long, items array<string>")
    lists = {k: v for k, v in data.items()}
    while True:
        lists = {k: v for k, v in lists.items() if 5 <= len(v) <= 20}
        count = {}
        for v in lists.values():
            for i in v:
                count[i] = count.get(i, 0) + 1
        new = {k: [i for i in v if count[i] >= 6] for k, v in lists.items()}
        if new == lists:
            break
        lists = new
    got = curation.curate(df, "k", "items", 6, 5, 20)
    assert {r.k: r["items"] for r in got.collect()} == {k: v for k, v in lists.items() if 5 <= len(v) <= 20}
    splits = {r.split_name: r["count"] for r in curation.hashed_splits(df.select(F.col("k").cast("string").alias("k")), "k").groupBy("split_name").count().collect()}
    assert splits == {"train": 120, "val": 15, "test": 15}
    hist = spark.createDataFrame([(1, 2), (5, 1), (9, 1)], "v long, c long")
    assert rows(curation.nearest_rank(hist, "v", "c", [0.0, 0.5, 1.0])) == [(0.0, 1), (0.5, 5), (1.0, 9)]
    assert rows(curation.nearest_rank(hist.limit(0), "v", "c", [0.5])) == [(0.5, 0)]


def test_multisets_and_positions(spark):
    df = spark.createDataFrame([(0, ["a"] * 5, list("abcde")), (1, list("bacde"), list("abcde")), (2, [], [])], "k long, p array<string>, t array<string>")
    got = {r.k: r for r in metrics.multiset_metrics(df, "k", "p", "t").collect()}
    assert (got[0].matches, got[0].recall, got[0].precision, got[0].unique_ratio) == (1, 0.2, 0.2, 0.2)
    assert (got[1].matches, got[1].f1) == (5, 1.0) and got[2].jaccard == 1.0 and got[2].recall == 0.0
    assert rows(metrics.positional(df.where("k = 1"), "k", "p", "t")) == [(1, 3, 0.6, False)]


def test_assignment(spark):
    rng = np.random.default_rng(6)
    squares = {i: rng.normal(size=(5, 5)) for i in range(20)}
    best = {i: max(sum(m[a, p[a]] for a in range(5)) / 5 for p in itertools.permutations(range(5))) for i, m in squares.items()}
    cells = spark.createDataFrame([(i, a, b, float(m[a, b])) for i, m in squares.items() for a in range(5) for b in range(5)], "k long, i int, j int, c double")
    got = {r.k: r.best for r in metrics.best_assignment(cells, "k", "i", "j", "c").collect()}
    assert all(abs(got[i] - best[i]) < 1e-12 for i in best)
    shapes = {0: rng.normal(size=(3, 6)), 1: rng.normal(size=(6, 3)), 2: rng.normal(size=(4, 4)), 3: np.ones((2, 2))}
    rows_ = spark.createDataFrame([(i, m.tolist()) for i, m in shapes.items()], "k long, m array<array<double>>")
    for r in metrics.assignment_any_size(rows_, "k", "m").collect():
        m = shapes[r.k] if shapes[r.k].shape[0] <= shapes[r.k].shape[1] else shapes[r.k].T
        n = m.shape[0]
        assert abs(r.best - max(sum(m[a, p[a]] for a in range(n)) / n for p in itertools.permutations(range(m.shape[1]), n))) < 1e-12


def test_ranking(spark):
    pred = spark.createDataFrame([("q", f"w{i}", i + 1) for i in range(75)] + [("q", "hit", 76)], "k string, item string, r int")
    truth = spark.createDataFrame([("q", "hit"), ("q", "hit"), ("none", "x")], "k string, item string")
    got = {r.k: r for r in metrics.ranking(pred, truth, "k", "item", "r", [1, 100]).collect()}
    assert abs(got["q"].reciprocal_rank - 1 / 76) < 1e-12 and got["q"].recall_1 == 0 and got["q"].recall_100 == 1 and got["none"].reciprocal_rank == 0


def test_distributions(spark):
    df = spark.createDataFrame([(float(i % 7),) for i in range(700)] + [(None,)], "v double")
    for parts in (1, 5):
        b = metrics.bootstrap_interval(df.repartition(parts), "v", 300).first()
        assert b.n == 700 and b.low < b.mean < b.high and 0.2 < b.high - b.low < 0.45
    same = spark.createDataFrame([([float(x) for x in r],) for r in np.random.default_rng(1).normal(size=(300, 3))], "v array<double>")
    assert abs(metrics.frechet(same, same, "v", 3).first()[0]) < 1e-6
    moved = same.select(F.transform("v", lambda x: x + 1).alias("v"))
    assert abs(metrics.frechet(same, moved, "v", 3).first()[0] - 3) < 1e-6
    e = metrics.entropy(spark.createDataFrame([("a", 1), ("b", 1), ("c", 2)], "x string, n long"), "n").first()
    assert abs(e.entropy - 1.5) < 1e-12
    lcs = metrics.longest_common(spark.createDataFrame([(1, "a b c d", "a x c d"), (2, None, "")], "k long, a string, b string"), "k", "a", "b").collect()
    assert lcs[0].rouge_l_recall == 0.75 and lcs[1].rouge_l_recall == 0
    table = spark.createDataFrame([("a", 0.5, 1.0), ("b", 0.7, 1.0)], "m string, x double, y double")
    assert rows(metrics.bold_best(table, {"x": True, "y": False}), "m", "x", "y") == [("a", "0.5000", "**1.0000**"), ("b", "**0.7000**", "**1.0000**")]


def test_tokens(spark):
    L = tokens.LAYOUT
    assert (L.stride, L.length(20)) == (13, 262)
    enc = spark.createDataFrame([("i", [2, 259, 516, 770], [7, 8])], "item string, sem array<int>, cues array<int>").select("item", tokens.encode_item(F.col("sem"), F.col("cues")).alias("b"))
    lists = spark.createDataFrame([("p", ["i", "missing", "i"]), ("empty", [])], "p string, items array<string>")
    seq = tokens.encode_lists(lists, "p", "items", enc, "item", "b")
    r = seq.first()
    assert r.n_items == 2 and len(r.input_ids) == L.length(2) and r.input_ids[:7] == [0, 843, 2, 259, 516, 770, 852]
    got = tokens.decode(seq, "p", "input_ids").orderBy("slot").collect()
    assert [x.codes for x in got] == [[1, 2, 3], [1, 2, 3]] and got[0].conflict == 1 and got[0].cues == [7, 8, 0, 0, 0, 0, 0, 0]
    ragged = spark.createDataFrame([("x", [5, 843, 1, 257]), ("y", [844])], "p string, input_ids array<int>")
    assert tokens.decode(ragged, "p", "input_ids").count() == 0
    books = np.arange(768 * 2, dtype=float).reshape(3, 256, 2)
    back = tokens.rvq_decode(spark.createDataFrame([("k", [2, 3, 4])], "k string, codes array<int>"), "k", "codes", tokens.books_table(spark, books), 2).first()
    assert back.vector == (books[0, 2] + books[1, 3] + books[2, 4]).tolist()
    rng = np.random.default_rng(8)
    small = rng.normal(size=(3, 4, 2))
    x = rng.normal(size=(20, 2))
    coded = {r.k: r.codes for r in tokens.rvq_encode(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "k long, v array<double>"), "k", "v", small).collect()}
    for i, v in enumerate(x):
        r, out = v.copy(), []
        for book in small:
            out.append(int(np.argmin(((r - book) ** 2).sum(1))))
            r = r - book[out[-1]]
        assert coded[i] == out
    index = {tuple(r.prefix): r.next for r in tokens.prefix_index(spark.createDataFrame([([1, 2],), ([1, 3],), ([2, 2],)], "c array<int>"), "c").collect()}
    assert index == {(): [1, 2], (1,): [2, 3], (2,): [2]}


@pytest.mark.parametrize("slices", [1, 3, 1024])
def test_chunks_in_any_slices(spark, slices):
    rng = random.Random(9)
    data = [(o, [rng.randrange(9) for _ in range(rng.choice([0, 1, 5, 40]))]) for o in rng.sample(range(1000), 60)]
    flat = [t for _, ts in sorted(data) for t in ts]
    want = [[0, *flat[i : i + 10], 844] for i in range(0, len(flat) - 9, 10)]
    got = tokens.chunks(spark.createDataFrame(data, "o long, t array<int>"), "o", "t", 12, slices=slices).orderBy("chunk").collect()
    assert [r.tokens for r in got] == want


def test_study(spark):
    df = spark.createDataFrame([("p1", True, 5, 2, "Song A"), ("p1", False, 1, 4, "No preference"), ("p2", False, 2, 5, "Song B")], "p string, song_a_is_generated boolean, fit_a int, fit_b int, preference string")
    u = study.unblind(df, ["p"], ["fit"])
    assert rows(u) == sorted([("p1", 5, 2, "generated", 1.0), ("p1", 4, 1, "tie", 0.5), ("p2", 5, 2, "generated", 1.0)], key=repr)
    s = study.by_participant(u, "p", ["share"]).first()
    assert (s.participants, s.responses, s.share) == (2, 3, 0.875)
    sides = study.balanced_sides(spark.range(9).select(F.col("id").cast("string").alias("c")), "c").collect()
    assert sum(r.generated_on_a for r in sides) == 5 and len({r.case_code for r in sides}) == 9
    bad = spark.createDataFrame([("s", 6, None, "x")], "k string, fit_a int, fit_b int, preference string")
    assert {r.problem for r in study.invalid_responses(bad, "k", ["fit_a", "fit_b"]).collect()} == {"rating fit_a", "rating fit_b", "preference"}


def test_checks(spark):
    cat = spark.createDataFrame([("a",), ("b",), ("c",)], "item_id string")
    emb = spark.createDataFrame([("a", 0, [1.0, 0.0]), ("b", 2, [1.0]), ("x", 1, [math.nan, 0.0])], "item_id string, row int, emb array<float>")
    got = {r.problem: r.n for r in checks.catalogue_alignment(cat, emb, "item_id", "row", "emb", 2).collect()}
    assert got == {"missing vector": 1, "unknown id": 1, "shape": 1, "not finite": 1}
    cues = spark.createDataFrame([("ok", [2, 1, 0], [0.9, 0.9, None]), ("bad", [2, 2, 9], [0.1, 0.9, None]), ("none", None, None)], "k string, ids array<int>, s array<double>")
    assert {(r.k, r.problem) for r in checks.cue_rows(cues, "k", "ids", "s", 5, 3).collect()} == {("bad", "repeated cue"), ("bad", "unknown id"), ("bad", "score beside empty"), ("bad", "rising scores"), ("none", "missing list")}
    df = spark.createDataFrame([(i, str(i % 3)) for i in range(50)], "o long, x string")
    prints = {checks.fingerprint(df.repartition(n), "o", ["o", "x"], 8).first().fingerprint for n in (1, 3)}
    changed = checks.fingerprint(df.withColumn("x", F.when(F.col("o") == 7, "y").otherwise(F.col("x"))), "o", ["o", "x"], 8).first().fingerprint
    assert len(prints) == 1 and changed not in prints
    assert checks.unequal_rows(df, df.where("o <> 3")).select("o", "side").collect() == [(3, "left")]


def test_scalars(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("v")).first().v
    assert [list(r) for r in value(scalar.byte_ranges(F.lit(10), 3))] == [[0, 2], [3, 5], [6, 9]]
    assert tuple(value(scalar.centre_crop(F.lit(11), 4))) == (3, 7) and tuple(value(scalar.centre_crop(F.lit(3), 4))) == (0, 3)
    assert value(scalar.masked_mean(F.array(F.lit(1.0), F.lit(5.0)), F.array(F.lit(True), F.lit(False)))) == 1.0
    assert value(scalar.one_hot(F.lit("C#"), ["C", "C#"])) == [0.0, 1.0]
    assert value(scalar.key_name(F.lit(9), F.lit(0))) == "A minor" and value(scalar.key_name(F.lit(-1), F.lit(1))) == ""
    rng = np.random.default_rng(2)
    keys = [(np.roll(base, r), f"{scalar.PITCHES[r]} {mode}") for r in range(12) for base, mode in ((scalar.MAJOR, "major"), (scalar.MINOR, "minor"))]
    for chroma in [*rng.random((5, 12)), np.ones(12)]:
        best = max(range(24), key=lambda i: (round(float(chroma @ keys[i][0]), 9), -i))
        assert value(scalar.estimated_key(F.array(*[F.lit(float(x)) for x in chroma]))) in (keys[best][1], *[k for p, k in keys if abs(float(chroma @ p) - float(chroma @ keys[best][0])) < 1e-9])
    assert value(scalar.mood_of_sound(F.lit(130.0), F.lit(0.2), F.lit(3000.0))) == "euphoric" and value(scalar.mood_of_sound(F.lit(130.0), F.lit(0.1), F.lit(1.0))) == "neutral"
    assert value(scalar.mood_of_valence(F.lit(0.5), F.lit(0.9))) == "neutral"
    assert value(scalar.features((F.lit(None).cast("array<double>"), 2), (F.array(F.lit(1.0)), 1))) == [0.0, 0.0, 1.0]
    assert value(vec.l2(F.array(F.lit(3.0), F.lit(4.0)))) == [0.6, 0.8] and value(vec.l2(F.array(F.lit(0.0)))) == [0.0]


def test_text(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("v")).first().v
    assert value(text.unique_lines(F.lit("A  b\n\na B\r\nc\n c "))) == "A b\nc"
    assert value(text.excerpt(F.lit("abc\n\ndefg\nh"), 9)) == "abc\ndefg" and value(text.excerpt(F.lit("abcdefghij\nk"), 5)) == ""
    assert value(text.without_timestamps(F.lit("[00:12.30] la\n[01:02.00]\nli"))) == "la\nli"
    assert value(text.cue_key(F.lit("Runnin’ Wild -- don't"))) == "running wild don't"
    assert value(text.ngrams(F.array(F.lit("a"), F.lit("b"), F.lit("c")), 2)) == ["a b", "b c"] and value(text.ngrams(F.array(F.lit("a")), 2)) == []
    assert value(text.comma_list(F.lit(" a, ,b," + "x" * 41))) == ["a", "b"]
    assert value(text.keeps_phrase(F.lit("want more"))) is False and value(text.keeps_phrase(F.lit("neon neon"))) is False and value(text.keeps_phrase(F.lit("neon rain"))) is True
    assert value(text.document_text(F.lit("a"), F.lit(" "), F.lit(None).cast("string"), F.lit("b"))) == "a b"


def test_vocabulary(spark):
    docs = spark.createDataFrame([(1, "neon rain neon"), (2, "Neon rain"), (3, None), (4, "")], "doc_id long, text string")
    df = {r.phrase: r.df for r in vocab.document_frequency(vocab.phrases(docs, "doc_id", "text"), "doc_id", "phrases").collect()}
    assert df == {"neon": 2, "rain": 2, "neon rain": 2, "rain neon": 1}
    scored = spark.createDataFrame([("b", 1.0), ("a", 1.0), ("c", 2.0)], "phrase string, idf double")
    assert rows(vocab.select_vocabulary(scored, "idf", 5)) == [(0, "<unk>", False), (1, "c", False), (2, "a", False), (3, "b", False), (4, "<pad_4>", True)]
    empty = docs.limit(0).select("text")
    assert vocab.jaccard(empty, empty, "text").first().jaccard == 1.0
    h = vocab.health(spark.createDataFrame([([1, 2, 3, 0],), ([2, 1, 4, 0],)], "c array<int>"), "c", 5, 2).first()
    assert (h.complete_share, h.empty_slot_share, h.vocabulary_share) == (1.0, 0.0, 0.5)
    assert vocab.health(spark.createDataFrame([([1, 2, 3, 0],), ([2, 1, 4, 0],)], "c array<int>"), "c", 5).first().empty_slot_share == 0.25
