import collections
import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quaverlake.llm import common, cooccurrence, encoding, entities, mixing, names, overlap, queries, subjects, term_counts, vectors
from tests.support import DATA, check, rows

QUERIES, SQL = queries.queries(), queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    check(spark, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, str(DATA / "sf0.001")).count() >= 0


# 1. pairs


def records(spark, data):
    df = spark.createDataFrame(data, "prefix_id long, split_name string, item_ids array<string>")
    return df.withColumn("n", F.lit(1)).withColumn("item", F.lit("clash")).withColumn("key", F.lit(None).cast("string"))


@pytest.mark.parametrize("heavy,quota,slices", [(0, 40, 1 << 16), (3, 7, 5), (512, None, 1 << 16)])
def test_pairs_equal_brute_force(spark, heavy, quota, slices, monkeypatch):
    """Small quotas deal the ranges of frequent items out by record; without a dictionary records are joined."""
    monkeypatch.setattr(cooccurrence, "SLICES", slices)
    monkeypatch.setattr(cooccurrence, "LONG", 5)
    monkeypatch.setattr(cooccurrence, "DICTIONARY", 0 if heavy == 3 else 1 << 20)
    rng = random.Random(1)
    sets = {k: {f"i{min(int(rng.paretovariate(0.7)), 60)}" for _ in range(rng.randrange(0, 14))} for k in range(300)}
    data = [(k, None, [f" {x} " if rng.random() < 0.3 else x for x in v] + [None, " ", *list(v)[:1]]) for k, v in sets.items()]
    data += data[:20] + [(None, None, ["a", "b"]), (900, None, None), (901, None, [])]
    count, pair = collections.Counter(x for v in sets.values() for x in v), collections.Counter(p for v in sets.values() for p in itertools.combinations(sorted(v), 2))
    total = sum(bool(v) for v in sets.values())
    got = cooccurrence.cooccurring_pairs(records(spark, data), min_pair=2, max_heavy=heavy, heavy_share=0.01, range_pairs=quota)
    assert {(r.item_a, r.item_b): (r.n_ab, r.n_a, r.n_b, r.n_records) for r in got.collect()} == {p: (n, count[p[0]], count[p[1]], total) for p, n in pair.items() if n >= 2}
    lifted = cooccurrence.cooccurring_pairs(records(spark, data), min_pair=2, min_lift=1.5, max_heavy=heavy, heavy_share=0.01, range_pairs=quota)
    assert {(r.item_a, r.item_b) for r in lifted.collect()} == {p for p, n in pair.items() if n >= 2 and n * total >= 1.5 * count[p[0]] * count[p[1]]}


def test_pairs_of_an_empty_table(spark):
    assert cooccurrence.cooccurring_pairs(records(spark, [])).count() == 0


# 2. frequencies


@pytest.mark.parametrize("burst,held,load", [(2, 10, 3), (512, 500_000, 200_000), (4, 1000, 10)])
def test_frequencies_equal_brute_force(spark, burst, held, load):
    rng = random.Random(2)
    words = ["", "a", "ab", "abc", "ünï", "b" * 40, *[f"w{i}" for i in range(60)]]
    data = [(f"k{k}", [rng.choice(words) for _ in range(rng.randrange(0, 9))] + [None]) for k in range(120)]
    hot = [(f"h{k}", ["hot"] * 5) for k in range(60)]
    df = spark.createDataFrame(data + hot + data[:10] + [("none", None), (None, ["x"])], "k string, t array<string>").withColumn("term", F.lit(0)).withColumn("records", F.lit(0))
    occ = collections.Counter(w for _, t in data + hot for w in t if w is not None)
    rec = collections.Counter(w for _, t in data + hot for w in {x for x in t if x is not None})
    for parts in (1, 5):
        got = term_counts.term_frequencies(df.repartition(parts), "k", "t", 3, 0.3, burst, held, load)
        assert {r.term: (r.occurrences, r.records, r.n_records, r.band) for r in got.collect()} == {w: (occ[w], n, 180, "rare" if n < 3 else "common" if n > 54 else "useful") for w, n in rec.items()}
    assert term_counts.term_frequencies(df.limit(0), "k", "t").count() == 0


def test_routes_stay_small_behind_a_long_common_prefix(spark):
    """Urls of one site, more than a route may hold, seen by several workers that burst at different places."""
    urls = [f"https://example.org/{'deep/' * 30}{i % 7}/page-{i}" for i in range(900)] + ["https://example.org/", "x", ""]
    df = spark.createDataFrame([(k, urls[k::3] + urls[k::7]) for k in range(21)], "k long, t array<string>").repartition(5)
    held = term_counts.term_frequencies(df, "k", "t", burst=4, held=50, load=60)
    want = collections.Counter(u for k in range(21) for u in urls[k::3] + urls[k::7])
    assert {r.term: r.occurrences for r in held.collect()} == dict(want)
    trie = term_counts.BurstTrie(4)
    for u in urls:
        trie.add(u.encode(), 1, 1)
    assert max(len(t) for _, t in trie.subtrees()) <= 4 and trie.size == len(urls)
    subtrees = spark.createDataFrame([(bytearray(p), [bytearray(r) for r in t]) for p, t in trie.subtrees()], "prefix binary, rests array<binary>")
    routes = term_counts.find_routes(subtrees, len(urls), 60)
    assert max(collections.Counter(routes.of(u.encode()) for u in urls).values()) <= 60 and routes.count <= 2 * len(urls) / 60 + 2


# 3. overlaps


def test_passages_leave_one_unbroken():
    for m in range(1, 60):
        bounds = overlap.passages(m, 0.8)
        assert bounds[0][0] == 0 and bounds[-1][1] == m and all(a < b for a, b in bounds) and len(bounds) == m // 4 + 1


@pytest.mark.parametrize("threshold", [0.8, 0.6, 1.0])
def test_overlaps_equal_brute_force(spark, threshold, monkeypatch):
    monkeypatch.setattr(overlap, "CODE_BITS", 9)  # collisions must cost nothing but checks
    rng = random.Random(3)
    base = [rng.sample(range(300), rng.choice([1, 2, 3, 4, 5, 8, 12, 20])) for _ in range(60)]
    data = []
    for k in range(240):
        items = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
            items = items[1:] if rng.random() < 0.5 and len(items) > 1 else [*items, rng.randrange(300)]
        rng.shuffle(items)
        data.append((k, rng.choice(["train", "val", "test", None, "other"]), [str(i) for i in items] + [None, " "]))
    data += data[:30] + [(998, "val", None), (999, "train", [])] + [(1000 + k, "train", ["x", "y", "z"]) for k in range(50)] + [(2000, "val", ["z", "y", "x"])]
    sets = {k: (s, frozenset(x for x in v or [] if x and x.strip())) for k, s, v in data}
    want = {(e, t) for e, (se, a) in sets.items() if se in ("val", "test") and a for t, (st, b) in sets.items() if st == "train" and b and len(a & b) >= threshold * len(a | b) - 1e-9}
    df = records(spark, data)
    assert {tuple(r) for r in overlap.split_overlaps(df, threshold=threshold).collect()} == want
    members, many = overlap.overlap_classes(df, threshold=threshold)
    monkeypatch.setattr(overlap, "LEAST", 5)
    few = overlap.overlap_classes(df, threshold=threshold, shard_passages=20, text_rows=15)[1]
    assert rows(few, "eval_class", "train_class", "common") == rows(many, "eval_class", "train_class", "common")
    assert members.count() == sum(s in ("train", "val", "test") and bool(v) for s, v in sets.values())
    links = collections.Counter(e for e, _ in want)
    assert {r.key: r.links for r in overlap.overlapping_records(df, threshold=threshold).collect()} == links
    assert overlap.split_overlaps(df.limit(0)).count() == 0


# 4. names


def test_parsing():
    same = ["Venju & the Kinno Embassy", "Venju&theKinnoEmbassy", "VENJU AND THE KINNO EMBASSY", "Vénju + the Kinno Embassy", "Venju-&-the-Kinno-Embassy"]
    assert len({names.parse_name(s)[2] for s in same}) == 1
    assert names.parse_name("Kalemprajel, Walter")[0] == ["walter", "kalemprajel"] and names.parse_name("E.Kalemprajel")[:2] == (["kalemprajel"], ["e"])
    for s in ("Various Artists", "[unknown]", " n/a ", "", "   "):
        assert names.parse_name(s) == ([], [], "")
    title = lambda s: ("".join(names.parse_title(s)[0]), names.parse_title(s)[1])
    assert title("The Parade of Umbrella - Mono Remaster") == title("TheParadeofUmbrella") == title("Parade o' Umbrella, The [Deluxe Edition]")
    versions = {title(f"Amber Signal{v}") for v in ("", " (Live)", " - Acoustic", " (Night Remix)", ", Pt. 2", " No. 3", " (Instrumental)")}
    assert len(versions) == 7


def test_edits():
    letters = "abc"
    words = ["".join(w) for n in range(4) for w in itertools.product(letters, repeat=n)]

    def near(a, b):
        steps = {a}
        for i in range(len(a) + 1):
            steps |= {a[:i] + c + a[i:] for c in letters} | {a[:i] + a[i + 1 :]} | {a[:i] + c + a[i + 1 :] for c in letters if i < len(a)} | {a[:i] + a[i + 1] + a[i] + a[i + 2 :] for _ in [0] if i + 1 < len(a)}
        return b in steps

    for a, b in itertools.product(words, repeat=2):
        assert names.one_edit(a, b) == near(a, b)
        if near(a, b):
            assert names.deletions(a) & names.deletions(b) or not a or not b


def test_entities(spark):
    people = [f"{g} {s}" for g in ("Walter", "Nora", "Hugo", "Clara", "Klara") for s in ("Bomadelisu", "Trivonkapel", "Zestarimono", "Quelidobra")]
    groups = ["The Trivonkapel Foxes", "Mira & the Dolen Foxes", "Sopa Lutin Foxes", "Kelda Foxes"]
    variants = ["WALTER TRIVONKAPEL", "Trivonkapel, Walter", "W. Trivonkapel", "Walter Trivonkpel", "Watler Trivonkapell", "WalterTrivonkapel", " Walter Trivonkapel", "Wally Trivonkapel", "Walter B. Trivonkapel"]
    other = ["Mira and the Dolen Foxes", "Foxes Sopa Lutin", "Trivonkapel Foxes"]
    junk = ["Various Artists", "n/a", "", " ", None]
    data = [(str(i), a, f"Song {i}") for i, a in enumerate(people + groups + variants + other + junk)]
    data += [("s1", "Walter Trivonkapel", "The Amber Ladder"), ("s2", "Trivonkapel, Walter", "the ambr ladder (2004 Remastered Version)"), ("s3", "Walter Trivonkapel", "The Amber Ladder (Live)"), ("s4", "Nora Trivonkapel", "The Amber Ladder"), ("s5", None, "The Amber Ladder"), ("s6", "Walter Trivonkapel", " "), ("s7", "Walter Trivonkapel", None)]
    df = spark.createDataFrame(data + data[:5], "item_id string, artist string, title string").withColumn("entity", F.lit(1)).withColumn("value", F.lit("x"))
    entity = {r.value: r.entity for r in entities.resolve_names(df, "artist").collect()}
    assert {entity[v] for v in variants} == {entity["Walter Trivonkapel"]}
    assert len({entity[v] for v in people + groups}) == len(people + groups)
    assert entity[other[0]] == entity[groups[1]] and entity[other[1]] == entity[groups[2]] and entity[other[2]] == entity[groups[0]]
    assert not set(junk) & set(entity)
    found = entities.same_entities(df)
    assert {(r.key_a, r.key_b) for r in found.where("kind = 'song'").collect()} == {("s1", "s2")}
    assert found.where("key_a >= key_b").isEmpty()
    assert entities.same_entities(df.limit(0)).count() == 0


def test_an_initial_of_two_people_links_to_neither(spark):
    df = spark.createDataFrame([("Nora Trivonkapel",), ("Nina Trivonkapel",), ("N. Trivonkapel",), ("H Trivonkapel",), ("Hugo Trivonkapel",)], "artist string")
    entity = {r.value: r.entity for r in entities.resolve_names(df, "artist").collect()}
    assert len(set(entity.values())) == 4 and entity["H Trivonkapel"] == entity["Hugo Trivonkapel"]


def test_the_right_spelling_links_two_that_do_not_fit_each_other(spark):
    """Each wrong spelling has a letter more at another place and is used more often than the right one."""
    data = ["Walter Kinnolapra"] + ["Walter Kinnnolapra"] * 3 + ["Walter Kinnolaapra"] * 3 + ["Nora Zestarimo"]
    songs = ["Amber Signal Fire", "Ambr Signal Fire", "Amber Signl Fire", "Ambr Signl Fire", "Amber Signal Fire (Live)"]
    df = spark.createDataFrame([(f"i{k}", a, "One") for k, a in enumerate(data)] + [(f"s{k}", "Nora Zestarimo", t) for k, t in enumerate(songs)], "item_id string, artist string, title string")
    classes = {(r.kind, r.key): (r.class_id, r.members) for r in entities.entity_classes(df).collect()}
    assert {classes["artist", v] for v in data[:7]} == {("Walter Kinnnolapra", 3)}
    # two errors in one title fit only what the merged titles say together
    assert {classes["song", f"s{k}"] for k in range(4)} == {("s0", 4)} and classes["song", "s4"][1] == 1


def test_nicknames_are_a_parameter(spark):
    df = spark.createDataFrame([("Zed Trivonkapel",), ("Zedekia Trivonkapel",)], "artist string")
    assert len({r.entity for r in entities.resolve_names(df, "artist").collect()}) == 2
    assert len({r.entity for r in entities.resolve_names(df, "artist", {"zed": "zedekia"}).collect()}) == 1


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001), (5, 5)], "a long, b long").repartition(7)
    got = {r.node: r.component for r in common.components(edges).collect()}
    assert got == {**{i: 0 for i in range(301)}, 1000: 1000, 1001: 1000}
    assert common.components(edges.limit(0)).count() == 0


# 5. vectors


def test_vectors_reach_the_exact_neighbours(spark, monkeypatch):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(30, 16))
    x = centres[rng.integers(0, 30, 3000)] + rng.normal(size=(3000, 16)) * 0.4
    x[:400] = x[0] * 2.5  # copies of one vector
    data = [(f"v{i:04d}", [float(v) for v in r]) for i, r in enumerate(x)]
    odd = [("zero", [0.0] * 16), ("null", None), ("nan", [float("nan")] * 16), ("short", [1.0]), (None, [1.0] * 16), ("hole", [None, *[1.0] * 15])]
    df = spark.createDataFrame(data + data[:50] + odd, "id string, emb array<float>").withColumn("vec", F.lit(1)).withColumn("copy", F.lit(2))
    probes = spark.createDataFrame([(f"v{i:04d}",) for i in range(380, 500)] + [("zero",), ("absent",), (None,), ("v0380",)], "query_id string")
    got = collections.defaultdict(set)
    for r in vectors.most_similar(df, probes, "id", "emb", k=5, dims=16, sample=1000).collect():
        got[r.query_id].add(r.neighbour_id)
    u = x.astype(np.float32).astype(float)
    u /= np.sqrt((u * u).sum(1, keepdims=True))
    hits = 0
    for i in range(380, 500):
        score = np.round(u @ u[i], 10)
        score[i] = -2
        hits += len({f"v{j:04d}" for j in np.lexsort((np.arange(3000), -score))[:5]} & got[f"v{i:04d}"])
    assert set(got) == {f"v{i:04d}" for i in range(380, 500)} and all(len(v) == 5 for v in got.values())
    assert hits >= 0.99 * 600
    whole = rows(vectors.most_similar(df, probes, "id", "emb", k=5, dims=16, sample=1000), "query_id", "neighbour_id")
    monkeypatch.setattr(vectors, "TOGETHER", 7)
    monkeypatch.setattr(vectors, "CELL", 100)
    monkeypatch.setattr(vectors, "PART", 300)
    parted = rows(vectors.most_similar(df, probes, "id", "emb", k=5, dims=16, sample=1000), "query_id", "neighbour_id")
    assert len(parted) == len(whole) and len(set(parted) & set(whole)) >= 0.99 * len(whole)
    assert vectors.most_similar(df.limit(0), probes, "id", "emb", dims=16).count() == 0
    assert vectors.most_similar(df, probes.limit(0), "id", "emb", dims=16).count() == 0


def test_crowded_directions_are_searched_whole(spark):
    """A third of the rows are multiples of one vector or near copies of another, more than are reranked."""
    rng = np.random.default_rng(11)
    base, near, rest = rng.normal(size=16), rng.normal(size=16), rng.normal(size=(2000, 16))
    times = [base * f for f in (1, 2, 3, 5, 0.5, 7) for _ in range(80)]
    copies = [near + rng.normal(size=16) * 1e-4 for _ in range(600)]
    x = np.array(times + copies + list(rest)).astype(np.float32)
    x[:480] = np.round(base * 64).astype(np.float32) * np.repeat([1, 2, 3, 5, 0.5, 7], 80)[:, None]
    order = rng.permutation(len(x))
    x = x[order]
    df = spark.createDataFrame([(f"v{i:04d}", v) for i, v in enumerate(x.tolist())], "id string, emb array<float>").coalesce(1)
    asked = [int(np.flatnonzero(order == i)[0]) for i in (0, 100, 479, 480, 700, 1079, 1500)]
    got = collections.defaultdict(set)
    for r in vectors.most_similar(df, spark.createDataFrame([(f"v{i:04d}",) for i in asked], "query_id string"), "id", "emb", k=5, dims=16, sample=1000, rerank=64).collect():
        got[r.query_id].add(r.neighbour_id)
    u = x.astype(float)
    u /= np.sqrt((u * u).sum(1, keepdims=True))
    for i in asked:
        score = np.round(u @ u[i], 13)
        score[i] = -2
        assert got[f"v{i:04d}"] == {f"v{j:04d}" for j in np.lexsort((np.arange(len(u)), -score))[:5]}


def test_all_vectors_as_queries_over_full_cells(spark, monkeypatch):
    """Recall against brute force where cells and parts are full and every row is a query."""
    monkeypatch.setattr(vectors, "CELL", 64)
    monkeypatch.setattr(vectors, "PART", 500)
    rng = np.random.default_rng(12)
    x = (rng.normal(size=(60, 16))[rng.integers(0, 60, 4000)] + rng.normal(size=(4000, 16)) * 0.5).astype(np.float32)
    df = spark.createDataFrame([(f"v{i:04d}", v) for i, v in enumerate(x.tolist())], "id string, emb array<float>")
    got = {(r.query_id, r.neighbour_id) for r in vectors.most_similar(df, df.select("id"), "id", "emb", query_id="id", dims=16, sample=1500).collect()}
    u = x.astype(float) / np.sqrt((x.astype(float) ** 2).sum(1, keepdims=True))
    score = u @ u.T
    np.fill_diagonal(score, -2)
    want = {(f"v{i:04d}", f"v{j:04d}") for i, row in enumerate(np.argsort(-score, axis=1)[:, :5]) for j in row}
    assert len(got) == len(want) and len(got & want) >= 0.99 * len(want)
    sample = u[:1500]
    centres = vectors.centres_of(sample, 60)
    assert vectors.cells_to_visit(sample, centres, 5, 0.99) < 30


def test_a_hot_cell_is_split():
    plan = vectors.Plan(np.array([10, 5000, 10, 20, 3000]), 8)
    assert plan.split[1] >= 4 and plan.split[4] >= 2 and plan.parts == (plan.first + plan.split).max()
    load = np.zeros(plan.parts)
    for c, rows_of in enumerate([10, 5000, 10, 20, 3000]):
        load[plan.first[c] : plan.first[c] + plan.split[c]] += rows_of / plan.split[c]
    assert load.max() <= 1.3 * 8040 / 8


def test_quantiser_prefers_small_parallel_error():
    rng = np.random.default_rng(5)
    x = vectors.Quantiser.pad(rng.normal(size=(2000, 14)))
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    q = vectors.Quantiser.fit(x)
    plain = vectors.Quantiser(vectors.Quantiser.fit(x, threshold=1e-6).books, 1.0)

    def parallel(quantiser):
        codes = quantiser.encode(x)
        back = np.concatenate([quantiser.books[s][codes[:, s]] for s in range(x.shape[1] // 2)], axis=1)
        return float((((x - back) * x).sum(1) ** 2).mean()), back

    (a, back), (b, _) = parallel(q), parallel(plain)
    assert a < b
    packed, tables = q.pack(x), q.tables(x[:7])
    scanned = sum(tables[j][packed[:, j]] for j in range(packed.shape[1]))
    assert np.allclose(scanned, back @ x[:7].T, atol=1e-4)


# 6. encoding


@pytest.fixture(scope="module")
def encoder():
    return encoding.ForcedBoundaryEncoder(*encoding.vocabulary())


TEXTS = ["", " ", "\n\n", "a", "The fox's tail isn't  long.\r\n\r\nNext", "<|endoftext|> x", "naïve é  　x y ​", "日本語のテキスト русский текст", "🎧🔥 'quoted' don't've '!'s", "x" * 5000, "12345 6.7\t\tq", "\u0085a  b", None]


def test_encoding_equals_the_whole(encoder):
    rng = random.Random(6)
    alphabet = list("abt's \n\t'!.1é 　漢🔥") + ["ing", " the", "'re", "\r\n", "zq"]
    texts = TEXTS + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(3000)]
    ids, counts = encoder.encode(pa.array(texts))
    at = 0
    for t, n in zip(texts, counts, strict=True):
        assert ids[at : at + n].tolist() == encoder.whole.encode_ordinary(t or ""), repr(t)
        at += n
    sliced, part = encoder.encode(pa.array(texts).slice(3, 10))
    assert sliced.tolist() == [i for t in texts[3:13] for i in encoder.whole.encode_ordinary(t or "")] and len(part) == 10


def test_encoding_of_long_texts_in_windows(encoder, monkeypatch):
    monkeypatch.setattr(encoding, "WINDOW", 50)
    text = "Überall 漢字 don't stop　it.  " * 40
    assert encoder.encode(pa.array([text, "b", text]))[0].tolist() == 2 * encoder.whole.encode_ordinary(text)[:0] + encoder.whole.encode_ordinary(text) + encoder.whole.encode_ordinary("b") + encoder.whole.encode_ordinary(text)


def test_encode_corpus(spark, encoder):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)] + [(0, "again"), (None, "x")], "doc_id long, text string").withColumn("ids", F.lit(1)).withColumn("__text", F.lit("no"))
    got = sorted(((r.doc_id, r.ids) for r in encoding.encode_corpus(df, "doc_id", "text").collect()), key=repr)
    assert got == sorted([(i, encoder.whole.encode_ordinary(t or "")) for i, t in enumerate(TEXTS)] + [(0, encoder.whole.encode_ordinary("again")), (None, encoder.whole.encode_ordinary("x"))], key=repr)
    assert encoding.encode_corpus(df.limit(0), "doc_id", "text").count() == 0
    counted = {r.doc_id: r.n_tokens for r in encoding.count_tokens(df.where("doc_id > 0"), "text", ["doc_id"]).collect()}
    assert counted == {i: len(encoder.whole.encode_ordinary(t or "")) for i, t in enumerate(TEXTS) if i}


# 7. mixing


def test_exponents():
    sizes = {"a": 800.0, "b": 150.0, "c": 50.0, "none": 0.0}
    natural = mixing.tempered(sizes, 1.0)
    assert natural["a"] == 0.8 and natural["none"] == 0.0
    for e in (0.1, 0.5, 1.0, 2.0):
        assert abs(mixing.exponent_for_entropy(sizes, mixing.entropy(mixing.tempered(sizes, e))) - e) < 1e-6
    e = mixing.exponent_for_share(0.15, 0.3, 1.0)
    assert abs(0.15**e - 0.3) < 1e-12 and abs(0.15 ** mixing.exponent_for_share(0.15, 0.3, 1.0, limit=0.2) - 0.2) < 1e-12
    assert mixing.exponent_for_share(1.0, 1.0, 1.0) >= 0 and abs(mixing.weight(1.0, mixing.exponent_for_share(1.0, 0.4, 1.0)) - 0.4) < 1e-9
    limit = mixing.exponent_for_repeats(sizes, {"a": 1, "b": 2, "c": 3, "none": 1}, 1000)
    assert all(p * 1000 <= sizes[s] * {"a": 1, "b": 2, "c": 3, "none": 1}[s] * (1 + 1e-9) for s, p in mixing.tempered(sizes, limit).items())
    assert mixing.tempered({}, 1.0) == {}


def test_mix(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 10)
    rng = random.Random(7)
    words = ["tone ", "river ", "light "]
    data = [(i, "".join(rng.choice(words) for _ in range(rng.randrange(1, 30))), rng.choice(["big"] * 8 + ["mid", "tiny"])) for i in range(600)] + [(900, None, "big"), (901, "", "mid"), (902, "lost words", None), (903, "other", "elsewhere"), (904, "tone " * 3000, "big")]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string").withColumn("uses", F.lit(9)).withColumn("block", F.lit(9))
    targets = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.25, 3), ("tiny", 0.2, 1), ("absent", 0.05, 2)] * 2, "source string, target_share double, max_repeats int")
    report = {r.source: r for r in mixing.mix_report(docs, targets).collect()}
    total = report["big"].total
    assert abs(report["big"].actual_share - 0.5) < 0.01 and report["big"].used <= 0.5 * total + 1
    for s, repeats in (("mid", 3), ("tiny", 1)):
        r = report[s]
        assert r.used == min(round({"mid": 0.25, "tiny": 0.2}[s] * total), r.available * repeats) or abs(r.actual_share - {"mid": 0.25, "tiny": 0.2}[s]) < 0.005
        assert r.most_uses <= repeats
    assert report["absent"].used == 0 and report["absent"].actual_share == 0
    chosen = mixing.mix_sources(docs, targets)
    uses = {r.doc_id: r.uses for r in chosen.collect()}
    assert not {900, 901, 902, 903} & set(uses) and len(uses) == chosen.count()
    assert rows(chosen) == rows(mixing.mix_sources(docs.repartition(7), targets))
    assert mixing.mix_sources(docs.limit(0), targets).count() == 0 and mixing.mix_sources(docs, targets.limit(0)).count() == 0
    for r in report.values():
        assert abs(r.deviation - (r.actual_share - r.target_share)) < 1e-12 and (r.source == "absent" or r.exponent >= 0)
    monkeypatch.setattr(mixing, "BLOCKS", 3)  # the last block is narrowed down over several passes
    narrow = {r.source: r for r in mixing.mix_report(docs, targets).collect()}
    assert abs(narrow["big"].actual_share - 0.5) < 0.01 and narrow["big"].used <= 0.5 * total + 1
    t = mixing.mix_by_temperature(docs, targets).collect()
    assert all(r.most_uses <= {"big": 1, "mid": 3, "tiny": 1, "absent": 2}[r.source] for r in t)


# 8. subjects


def test_subjects_on_held_out_documents(spark):
    rng = random.Random(8)
    terms = {s: [f"{s}{chr(97 + i)}{chr(97 + j)}" for i in range(6) for j in range(4)] for s in ("alpha", "beta", "gamma")}
    filler = [f"plain{chr(97 + i)}{chr(97 + j)}" for i in range(10) for j in range(6)]

    def sentence(s):
        pool = filler if s is None else terms[s] + filler[:20]
        return " ".join(rng.choice(pool) for _ in range(8)).capitalize() + "."

    docs, truth = [], {}
    for i in range(700):
        own = rng.choice([[], ["alpha"], ["beta"], ["gamma"], ["alpha", "gamma"]])
        parts = [sentence(s) for s in own for _ in range(3)] + [sentence(None) for _ in range(4 if own else 6)]
        rng.shuffle(parts)
        docs.append((i, " ".join(parts)))
        truth[i] = set(own)
    docs += [(1000, None), (1001, ""), (1002, " \n"), (1003, "♪♪♪"), (None, "Alphaaa."), (5, docs[5][1])]
    labels = [(i, s) for i in range(350) for s in (truth[i] or {"none"})] + [(0, None), (None, "alpha"), (3, "none")]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("subject", F.lit("x")).withColumn("doc", F.lit(1))
    lab = spark.createDataFrame(labels, "doc_id long, subject string").withColumn("sentences", F.lit(0))
    areas = spark.createDataFrame([("alpha", "first"), ("beta", "second"), ("gamma", None)], "subject string, description string")
    for refinements in (0, 1):
        found = collections.defaultdict(set)
        for r in subjects.subject_areas(d, lab, areas, refinements=refinements).collect():
            found[r.doc].add(r.subject)
        held = range(350, 700)
        hits = sum(len(found[i] & truth[i]) for i in held)
        assert hits >= 0.9 * sum(len(found[i]) for i in held) and hits >= 0.9 * sum(len(truth[i]) for i in held)
        assert not {1000, 1001, 1002, 1003, None} & {k for k, v in found.items() if v}
    assert subjects.subject_areas(d.limit(0), lab, areas).count() == 0
    assert subjects.subject_areas(d, lab.limit(0), areas).count() >= 0
