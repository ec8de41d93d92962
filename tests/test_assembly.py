"""Operators that put records together, and those that no query runs, on small tables."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quaverlake.functions import scalar, text
from quaverlake.operators import assembly, knn, matching, metrics, retrieval, study, tokens, vocab
from quaverlake.plans import protocol
from quaverlake.sources import readers, writers
from tests.support import rows


def test_lookups(spark):
    table = spark.createDataFrame([("a", "A", " "), ("b", None, "x")], "k string, title string, artist string")
    asked = spark.createDataFrame([("a",), ("b",), ("c",), (None,)], "song string")
    got = assembly.looked_up(asked, "song", table, "k", {"title": "no title", "artist": "nobody"})
    assert rows(got) == sorted([("a", "A", "nobody"), ("b", "no title", "x"), ("c", "no title", "nobody"), (None, "no title", "nobody")], key=repr)
    with pytest.raises(Exception, match="no row for"):
        assembly.looked_up(asked, "song", table, "k", {"title": ""}, required=True).collect()
    matches = spark.createDataFrame([(1, "strict"), (2, "relaxed-version")], "i int, match_type string")
    assert assembly.accepted_matches(matches).count() == 1 and assembly.accepted_matches(matches, True).count() == 2
    events = spark.createDataFrame([("t1",), ("t2",), (None,)], "track string")
    mapped = assembly.mapped_events(events, "track", spark.createDataFrame([("t1", "i1")], "t string, i string"), "t", "i")
    assert rows(mapped) == [("t1", "i1"), ("t2", None), (None, None)]


def test_precedence(spark):
    df = spark.createDataFrame([(["x", "y", "z"], "g"), ([], "g"), (None, " "), (None, None)], "t array<string>, g string")
    value, source = assembly.by_precedence({"t": F.col("t"), "g": F.when(F.trim("g") != "", F.array("g"))}, longest=2)
    assert [tuple(r) for r in df.select(value, source).collect()] == [(["x", "y"], "t"), (["g"], "g"), (None, "miss"), (None, "miss")]


def test_dense_and_remapped_rows(spark):
    table = spark.createDataFrame([(0, "a"), (1, "b"), (1, "c"), (4, "d"), (None, "e")], "r int, v string")
    assert rows(assembly.not_dense(table, "r")) == [("gap", 2), ("null row", 1), ("repeated row", 1)]
    assert assembly.not_dense(table.where("r < 1"), "r").isEmpty()
    sound = spark.createDataFrame([(0, "a"), (1, "b")], "r int, v string")
    items = spark.createDataFrame([("x", 1), ("y", 0)], "id string, at int")
    assert rows(assembly.gathered_rows(items, "id", "at", sound, "r", "v")) == [("x", "b"), ("y", "a")]
    with pytest.raises(Exception, match="no row 7"):
        assembly.gathered_rows(spark.createDataFrame([("z", 7)], "id string, at int"), "id", "at", sound, "r", "v").collect()
    pairs = spark.createDataFrame([(0, 1), (9, 0)], "source int, target int")
    assert rows(assembly.remapped_rows(sound.withColumnRenamed("r", "k"), "k", "v", sound, "r", pairs)) == [(0, "a", False), (1, "a", True)]


def test_systems_raise_on_what_they_do_not_know(spark):
    cues = spark.createDataFrame([("i", list(range(1, 17)))], "item string, ids array<int>")
    plan = lambda s, n: spark.createDataFrame([(1, s, "i", list(range(n)))], "k int, system string, item string, own array<int>")
    run = lambda s, n=8: assembly.system_records(plan(s, n), "k", "system", "item", "own", cues, "item", "ids").collect()
    assert run("retrieved")[0].cue_ids == list(range(1, 9)) and run("direct")[0].cue_ids == [] and run("predicted")[0].cue_source == "model-predicted"
    for bad in (("other", 8), ("predicted", 7)):
        with pytest.raises(Exception, match="unknown system|wrong number"):
            run(*bad)


def test_files_requests_and_memos(spark, tmp_path):
    files = spark.createDataFrame([("/d/a.mp3",), ("/d/a.WAV",), ("/d/b.txt",), ("/d/c.mp3",), ("/e/c.mp3",)], "path string")
    assert rows(assembly.first_by_extension(files, "path", [".wav", ".mp3"])) == [("a", "/d/a.WAV"), ("c", "/d/c.mp3")]
    items = spark.createDataFrame([("b", "x" * 9), ("a", "yy"), ("c", " ")], "id string, t string")
    asked = assembly.requests(items, "id", "id", "t", 5)
    assert rows(asked) == [(0, "a", "yy", 2), (1, "b", "xxxxx", 9)]
    results = spark.createDataFrame([(1, 1, "late"), (1, 0, "first")], "request long, attempt int, result string")
    assert [r.result for r in assembly.in_request_order(asked, results).collect()] == [None, "late"]
    seen = []

    def compute(missing):
        seen.append(missing.count())
        return missing.select("memo_key", F.length("t").alias("n"))

    path = str(tmp_path / "memo")
    for expected in ([("a", "yy", 2), ("b", "x" * 9, 4), ("c", " ", 1)],) * 2:
        assert rows(assembly.memoised(items, ["t"], path, compute, cut_text=4)) == expected
    assert seen == [3, 0]
    first = assembly.kept_table(spark, str(tmp_path / "pool"), lambda: spark.range(3))
    assert first.count() == assembly.kept_table(spark, str(tmp_path / "pool"), lambda: spark.range(9)).count() == 3
    assert protocol.registry({"a": str(tmp_path), "b": str(tmp_path / "no")}, {"a"}) == {"a": str(tmp_path)}
    with pytest.raises(FileNotFoundError, match="b"):
        protocol.registry({"b": str(tmp_path / "no")}, {"b"})


def test_conditions_of_a_small_vocabulary(spark):
    items = spark.createDataFrame([("x",), ("y",)], "id string")
    cues = spark.createDataFrame([("x", [3, 0, 1])], "id string, c array<int>")
    words = spark.createDataFrame([(0, "<unk>"), (1, "a"), (2, "b"), (3, "<pad_3>"), (4, "d")], "cue_id int, cue string")
    got = {(r.id, r.condition): r.cue_ids for r in assembly.conditions(items, "id", cues, "id", "c", words, "cue_id").collect()}
    assert got["x", "assigned"] == [3, 1] and got["y", "assigned"] == [] and got["x", "none"] == []
    assert sorted(got["x", "random"]) == sorted(got["y", "random"]) == [1, 2, 4]


def test_percentiles(spark):
    rng = np.random.default_rng(1)
    x = [round(float(v), 2) for v in rng.normal(size=301)] + [0.5] * 40
    df = spark.createDataFrame([(v,) for v in x] + [(None,)], "v double").repartition(5)
    got = metrics.percentiles(df, "v", [0.0, 0.33, 0.5, 0.975, 1.0]).first()
    assert np.allclose(list(got), np.quantile(x, [0.0, 0.33, 0.5, 0.975, 1.0]))
    assert metrics.percentiles(df.limit(0), "v", [0.5]).first()[0] is None


def test_bootstrap_does_not_depend_on_batches(spark):
    df = spark.createDataFrame([(i, 1.0 + i % 7) for i in range(3000)], "i long, v double")
    wide = tuple(metrics.bootstrap_interval(df, "v", 200, key="i", slices=2).first())
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 100)
    try:
        small = tuple(metrics.bootstrap_interval(df.repartition(7), "v", 200, key="i", slices=2).first())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert np.allclose(wide, small)
    sd = math.sqrt(sum((1 + i % 7 - wide[0]) ** 2 for i in range(3000)) / 3000 / 3000)
    mean, _, low, high = wide
    assert abs((high - low) / (2 * 1.96 * sd) - 1) < 0.25 and low < mean < high


def test_hits_and_codes(spark):
    df = spark.createDataFrame([(1, ["a", "a", "b"], ["a", "b", "a"]), (2, ["a", "a"], ["a", "b"]), (3, [], ["a"])], "k int, p array<string>, t array<string>")
    several = {r.k: (r.hit_3, r.hit_full, r.recall_3) for r in metrics.hits_at(df, "k", "p", "t", [3], multiset=True).collect()}
    assert several == {1: (1, 1, 1.0), 2: (0, 0, 0.5), 3: (0, 0, 0.0)}
    sets = {r.k: (r.hit_2, r.hit_full) for r in metrics.hits_at(df, "k", "p", "t", [3]).collect()}
    assert sets == {1: (1, 1), 2: (0, 0), 3: (0, 0)}
    codes = spark.createDataFrame([([1, 2], [1.0, 0.0])], "c array<int>, v array<double>")
    books = tokens.books_table(spark, np.array([[[0.0, 0.0], [2.0, 0.0]], [[0.0, 1.0], [0.0, 3.0]]]))
    asked = spark.createDataFrame([("a", [1, 2]), ("b", [1, 0])], "k string, c array<int>")
    assert rows(retrieval.code_features(asked, "k", "c", codes, "c", "v", books, 2)) == [("a", (1.0, 0.0), "direct"), ("b", (2.0, 1.0), "codebook")]
    assert rows(metrics.top_gaps(spark.createDataFrame([("q", 0.9, 1), ("q", 0.5, 2), ("r", 0.4, 1)], "q string, s double, r int"), "q", "s", "r")) == [(2, 0.65, 0.4, 0.4)]


def test_pools_have_enough_others(spark):
    cat = spark.createDataFrame([(f"i{k}",) for k in range(30)], "item_id string")
    truth = spark.createDataFrame([("a", f"i{k}") for k in range(20)] + [("b", "i3"), ("c", "gone")], "k string, item string")
    got = {}
    for r in retrieval.pools(truth, "k", "item", cat, "item_id", 10).where("NOT is_label").collect():
        got.setdefault(r.k, set()).add(r["item"])
    assert got["a"] == {f"i{k}" for k in range(20, 30)} and len(got["b"]) == len(got["c"]) == 10 and got["b"] != got["c"] and "i3" not in got["b"]
    vectors = spark.createDataFrame([(f"i{k}", [1.0, k / 10]) for k in range(30)], "item_id string, emb array<double>")
    asked = spark.createDataFrame([("b", 0, [1.0, 0.0]), ("b", 1, [1.0, 0.0]), ("b", 2, None)], "k string, step int, q array<double>")
    pooled = spark.createDataFrame([("b", f"i{k}") for k in (7, 4, 9)], "k string, item string")
    assert rows(retrieval.from_pools(pooled, "k", asked, "q", vectors, "item_id", "emb", 5)) == [("b", 0, "i4"), ("b", 1, "i7")]
    assert rows(retrieval.from_pools(pooled, "k", asked, "q", vectors, "item_id", "emb", 5, repeats=True)) == [("b", 0, "i4"), ("b", 1, "i4")]


def test_whitening_and_representatives(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, 3)) * [3.0, 1.0, 0.2] + [1.0, 2.0, 3.0]
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(900, None)], "i int, v array<double>").repartition(3)
    white = np.array([r.white for r in knn.whitened(df, "i", "v", 3).collect()])
    assert len(white) == 500 and np.allclose(white.mean(0), 0, atol=1e-8) and np.allclose(np.cov(white.T, bias=True), np.eye(3), atol=1e-6)
    assert len(knn.whitened(df, "i", "v", 3, keep=2).first().white) == 2
    y = np.concatenate([rng.normal(size=(40, 2)) * 0.1 + c for c in ([5, 0], [-5, 0], [0, 5])])
    two = spark.createDataFrame([(i, [float(v) for v in r], 1.0) for i, r in enumerate(y)], "i int, v array<double>, w double")
    assert {r.i // 40 for r in knn.cluster_representatives(two, "i", "v", "w", 8, 2).collect()} == {0, 1, 2}


def _grams(phrase):
    out = []
    for w in phrase.lower().split():
        w = f" {w} "
        out += [w[i : i + n] for n in (2, 3, 4) for i in range(len(w) - n + 1)]
    return out


def test_near_duplicates_by_pieces(spark):
    words = ["summer night", "summer nights", "winter rain", "cold winter rain", "sunlight", "sun light", "a", ""]
    tf = [{g: _grams(p).count(g) for g in _grams(p)} for p in words]
    df = {g: sum(g in t for t in tf) for t in tf for g in t}
    vectors = [{g: n * (math.log((1 + len(words)) / (1 + df[g])) + 1) for g, n in t.items()} for t in tf]
    cosine = lambda a, b: sum(v * b.get(g, 0) for g, v in a.items()) / (math.sqrt(sum(v * v for v in a.values()) * sum(v * v for v in b.values())) or 1)
    table = spark.createDataFrame([(p, 1.0 + i / 10) for i, p in enumerate(words)], "phrase string, idf double")
    got = {r.phrase: np.array(r.emb) for r in vocab.char_gram_vectors(table, "phrase", "phrase", dims=1 << 14).collect()}
    for i, a in enumerate(words):
        for j, b in enumerate(words):
            assert abs(got[a] @ got[b] - cosine(vectors[i], vectors[j])) < 1e-6
    kept = []
    for i in reversed(range(len(words))):
        if all(cosine(vectors[i], vectors[j]) <= 0.7 for j in kept):
            kept.append(i)
    assert {r.phrase for r in vocab.near_duplicates_removed(table, "idf", 0.7).collect()} == {words[i] for i in kept}


def test_near_duplicates_of_a_large_vocabulary(spark):
    rng = np.random.default_rng(5)
    letters = rng.integers(97, 123, (25_001, 2, 8), dtype=np.uint8)
    pairs = [tuple(bytes(w).decode() for w in pair) for pair in letters]
    table = spark.createDataFrame([(p,) for a, b in pairs for p in (f"{a} {b}", f"{b} {a}")], "phrase string").withColumn("idf", F.lit(1.0))
    assert {r.phrase for r in vocab.near_duplicates_removed(table, "idf").collect()} == {" ".join(sorted(p)) for p in pairs}


def test_sparse_pairs_meet_on_a_grid(spark):
    rng = np.random.default_rng(6)
    x = rng.random((200, 24)) * (rng.random((200, 24)) < 0.3)
    x[100:150] = x[:50] + 0.1 * rng.random((50, 24)) * (rng.random((50, 24)) < 0.2)
    x[7], x[180] = 0, x[20]
    table = spark.createDataFrame([(i, [int(p) for p in np.nonzero(v)[0]], [float(w) for w in v[v > 0]]) for i, v in enumerate(x)], "o long, at array<int>, w array<double>")
    unit = x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-9)
    for threshold in (0.0, 0.6, 0.92):
        a, b = np.nonzero(np.triu(unit @ unit.T > threshold, 1))
        for block in (4, 4096):
            got = sorted((r.a, r.b) for r in knn.sparse_pairs(table, threshold, 24, block).collect())
            assert got == sorted(zip(a.tolist(), b.tolist()))


def test_wording(spark):
    df = spark.createDataFrame([(["1"], "x"), (None, "x"), (["1"], None), (None, None), ([None], None)], "ids array<string>, said string")
    assert [r[0] for r in df.select(text.input_type(F.col("ids"), "said")).collect()] == ["hybrid", "text_only", "song_only", "unknown", "unknown"]
    said = spark.createDataFrame([(["a", "A ", "b"], "genre: x; mood: y", "[Verse]\n[CHORUS]"), (["a", " "], "", "la"), (None, None, None)], "c array<string>, a string, l string")
    got = said.select(text.verbalisation_problems(F.col("c"), "a", "l", 3), text.attribute_fields("a"), text.unique_ratio(F.col("c"))).collect()
    assert got[0][0] == [] and got[0][1] == 2 and abs(got[0][2] - 2 / 3) < 1e-9
    assert got[1][0] == ["cue count", "empty cue", "empty attributes", "no section marks"] and got[2][0] == ["cue count", "empty attributes", "empty lyrics"]
    lines = spark.createDataFrame([("One - Two - Live",), ("One - Two",), ("One [Remix] (x) feat. Two\nz",), (None,)], "t string")
    assert [r[0] and r[0].strip() for r in lines.select(text.base_title("t")).collect()] == ["One", "One - Two", "One   (x)", None]
    flags = spark.createDataFrame([(" TRUE",), ("0",), ("maybe",), (None,)], "f string")
    assert [r[0] for r in flags.select(study.parsed_flag("f")).collect()] == [True, False, None, None]


def test_next_items(spark):
    lists = spark.createDataFrame([("a", ["1", "2", "3"]), ("b", ["1", "2"]), ("c", ["1", "2", "9"])], "k string, items array<string>")
    have = spark.createDataFrame([("3",), ("1",)], "id string")
    assert [(r.k, r.next_item) for r in study.next_item_pairs(lists, "k", "items", have, "id", heard=2).collect()] == [("a", "3")]


def test_readers_and_writers(spark, tmp_path):
    x = np.arange(14, dtype=np.float32).reshape(7, 2)
    np.save(tmp_path / "m.npy", x)
    table = readers.matrix(spark, str(tmp_path / "m.npy"), rows=3)
    assert [r.emb for r in table.orderBy("row").collect()] == x.tolist()
    writers.write_matrix(str(tmp_path / "again.npy"), table, "row", "emb")
    assert np.array_equal(np.load(tmp_path / "again.npy"), x)
    for limited in (lambda: writers.write_matrix(str(tmp_path / "no.npy"), table, "row", "emb", limit=6), lambda: writers.markdown(table, limit=6)):
        with pytest.raises(ValueError, match="at most 6"):
            limited()
    for bad in ({"a": 0, "b": 2}, {"a": 1}, ["a", "a"]):
        (tmp_path / "r.json").write_text(json.dumps(bad))
        with pytest.raises(Exception, match="not contiguous or not unique"):
            readers.row_order(spark, str(tmp_path / "r.json")).collect()
    part = lambda k, items: spark.createDataFrame([(k, items)], "k string, items array<string>")
    known = spark.createDataFrame([("1",)], "item_id string")
    assert readers.ordered_union([part("a", ["1"]), part("b", [])], "k", "items", known).count() == 2
    with pytest.raises(Exception, match="unknown id 7"):
        readers.ordered_union([part("a", ["1", "7"])], "k", "items", known).collect()
    for name, body in (("b", "two"), ("a", "one")):
        (tmp_path / "side").mkdir(exist_ok=True)
        (tmp_path / "side" / f"{name}.txt").write_text(body)
    cat = spark.createDataFrame([("c", 0), ("b", 1), ("a", 2)], "id string, o int")
    assert rows(readers.catalogue_texts(spark, cat, "id", "o", str(tmp_path / "side"), limit=1)) == [("b", 1, "two")]
    assert rows(readers.catalogue_texts(spark, cat, "id", "o", str(tmp_path / "side"), absent=True), "id", "text") == [("a", "one"), ("b", "two"), ("c", None)]
    (tmp_path / "s.csv").write_text("session_id,submitted_utc\ns2,2024-01-02\ns1,2024-01-02\ns3,2024-01-01\n")
    assert [r.session_id for r in readers.responses(spark, str(tmp_path / "s.csv")).collect()] == ["s3", "s1", "s2"]
    (tmp_path / "log.json").write_text('{"id": "a", "ok": true}\n{"id": "a", "ok": false}\n{"id": "b", "ok": false}\n')
    log = readers.json_lines(spark, str(tmp_path / "log.json"), "id string, ok boolean")
    assert rows(readers.log_coverage(log, "id", cat, "id")) == [(3, 2, 1, round(1 / 3, 6))]
    assert readers.fields(cat, T.StructType([T.StructField("o", T.LongType()), T.StructField("new", T.StringType())])).first() == (0, None)
    df = spark.createDataFrame([("a", ["x", "y"], "train"), ("b", ["y"], "train"), ("c", [], "test")], "k string, items array<string>, split_name string")
    assert rows(writers.write_split_lists(df, "k", "items", "split_name", str(tmp_path / "lists"))) == [("test", 1, 0), ("train", 2, 2)]
    assert spark.read.json(str(tmp_path / "lists")).count() == 3
    writers.write_tsv(cat, str(tmp_path / "t"))
    assert readers.json_lines is not None and spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "t")).count() == 3
    writers.write_json_lines(cat, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 3
    prepared = spark.createDataFrame([("train", [1, 2], [True, False])], "split_name string, input_ids array<bigint>, target_mask array<boolean>")
    writers.write_prepared(prepared, str(tmp_path / "p"))
    assert dict(spark.read.parquet(str(tmp_path / "p")).dtypes)["input_ids"] == "array<int>"
    writers.append_rating(cat, str(tmp_path / "ratings"))
    writers.append_rating(cat, str(tmp_path / "ratings"))
    assert spark.read.parquet(str(tmp_path / "ratings")).count() == 6


def test_unused_helpers(spark):
    assert rows(metrics.weighted_mean(spark.createDataFrame([(0.5, 1), (1.0, 3)], "r double, n int"), "r", "n")) == [(0.875, 4)]
    assert spark.range(1).select(tokens.cue_token(F.lit(5)), tokens.cue_token(F.lit(9999))).first() == (850, None)
    rates = spark.createDataFrame([(1,), (100,), (400,)], "step int").select(scalar.inverse_root_rate(F.col("step"), 0.5, 100))
    assert [round(r[0], 6) for r in rates.collect()][1:] == [0.5, 0.25]
    lyric = spark.createDataFrame([("ab\nab\ncd",)], "t string")
    assert [lyric.select(text.capped("t", m, c)).first()[0] for m, c in (("full", 0), ("cap", 3), ("dedup", 0), ("dedup", 4))] == ["ab\nab\ncd", "ab\n", "ab\ncd", "ab\nc"]
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([([float(v) for v in r],) for r in rng.normal(size=(300, 4))], "v array<double>")
    books = tokens.rvq_fit(df, "v", levels=2, codes=16)
    coded = tokens.rvq_encode(df.withColumn("k", F.monotonically_increasing_id()), "k", "v", books)
    assert books.shape == (2, 16, 4) and coded.count() == 300
    left = matching.id_set_difference(df.select(F.lit("a").alias("x")), "x", df.select(F.lit("b").alias("y")), "y")
    assert rows(left) == [("a", "left"), ("b", "right")]
