"""Queries that do a job over all rows, against brute force."""

import collections
import hashlib
import math
import random
import re
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from quaverlake.functions import text
from quaverlake.operators import knn, metrics, vocab
from quaverlake.plans import content_queries, model_queries, sequence_queries
from quaverlake.session import read
from tests.support import DATA, rows

D = str(DATA / "sf0.001")


def _cosines(spark):
    """Item ids, cue names in text order, rounded cosines, and cue unit vectors."""
    cues = sorted((str(r.cue_id), r.emb) for r in read(spark, D, "cue_vocab").where("cue_id > 0").collect())
    items = sorted((r.item_id, r.emb) for r in content_queries._items(spark, D).collect())
    unit = lambda t: (x := np.array([v for _, v in t], float)) / np.sqrt((x * x).sum(1, keepdims=True))
    return [k for k, _ in items], [k for k, _ in cues], np.round(unit(items) @ unit(cues).T, 6), unit(cues)


def test_every_item_gets_cues(spark):
    ids, names, score, x = _cosines(spark)
    assigned = {r.query_id: r for r in content_queries.vec_assigned(spark, D).collect()}
    diverse = {}
    for r in content_queries.vec_diverse_cues(spark, D).orderBy("query_id", "place").collect():
        diverse.setdefault(r.query_id, []).append(r["item"])
    assert set(assigned) == set(diverse) == set(ids)
    for k, s in zip(ids, score, strict=True):
        best = np.argsort(-s, kind="stable")
        assert assigned[k].ids.split(",") == [names[i] for i in best[:16]] and assigned[k].empty_slots == 0
        pool, chosen = list(best[:64]), []
        while len(chosen) < 8:
            value = [-np.inf if i in chosen else round(0.7 * s[i] - 0.3 * max((x[i] @ x[j] for j in chosen), default=0.0), 9) for i in pool]
            chosen.append(pool[int(np.argmax(value))])
        assert diverse[k] == [names[i] for i in chosen]


def test_ranks_are_of_every_item(spark):
    ids, names, score, _ = _cosines(spark)
    own = {r.item_id: str(r.cue_ids[0]) for r in content_queries._mappings(spark, D).where("cue_ids IS NOT NULL").collect()}
    ranks = [1 + [names[i] for i in np.argsort(-s, kind="stable")].index(own[k]) for k, s in zip(ids, score, strict=True) if own.get(k) in names]
    got = model_queries.met_rank_summary(spark, D).first()
    assert got.n == len(ranks) > 150 and got.median_rank == np.median(ranks) and abs(got.mrr - np.mean(1 / np.array(ranks))) < 2e-6


def test_few_cues_leave_empty_slots(spark):
    cues = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 0.0])], "cue_id int, emb array<float>")
    items = spark.createDataFrame([("a", [1.0, 0.1]), ("b", [0.0, 2.0]), ("z", [0.0, 0.0])], "query_id string, qvec array<float>")
    got = {r.query_id: r for r in knn.assigned(knn.exact_topk(cues, items, 4, "cue_id", dims=2), 4).collect()}
    assert {k: r.ids for k, r in got.items()} == {"a": [1, 2, 0, 0], "b": [2, 1, 0, 0]}
    assert all(r.scores[2:] == [None, None] and r.scores[0] >= r.scores[1] for r in got.values())
    assert rows(knn.diverse_topk(cues, items, 8, key="cue_id", dims=2)) == [("a", 0, "1"), ("a", 1, "2"), ("b", 0, "2"), ("b", 1, "1")]
    assert rows(knn.rank_of(cues, items.withColumn("own", F.lit(2)), "own", "cue_id", dims=2)) == [("a", "2", 2), ("b", "2", 1)]


ODD = [
    ("i1", "Café (Remastered 2011)", "Beyoncé & Jay‐Z", "Déjà Vu"),
    ("i2", "Déjà\u00a0Vu — Live in Köln", "BEYONCÉ and JayZ", "Ça ira"),
    ("i3", "ﬁne ｆｅａｔ. X\u2028y", "M.G.'s", "It's (Live) ' by ' us"),
    ("i4", "Éfeat. one feat.\u00a0two", "Ωmega", "東京"),
    ("i5", "'Quoted' by someone in album'X'", "Nina O'Neil", "D'or"),
    ("i6", "Ça Ira", "beyonce and jayz", None),
    ("i7", None, "a", "b"),
    ("i8", "A.B.C. d.e, x.y", "", "b"),
]


@pytest.fixture(scope="module")
def catalogues(spark, tmp_path_factory):
    """The stored catalogue and one with rows beyond ASCII, each with its rows."""
    folder = tmp_path_factory.mktemp("odd")
    spark.createDataFrame(ODD, "item_id string, title string, artist string, album string").write.parquet(f"{folder}/catalog_items.parquet")
    found = {}
    for d in (str(DATA / "sf0.01"), str(folder)):
        found[d] = [(r.item_id, r.title, r.artist, r.album) for r in sequence_queries._catalogue(spark, d).collect()]
    return found


def _key(value):
    x = unicodedata.normalize("NFKD", value or "").encode("ascii", "ignore").decode().casefold().replace("&", " and ")
    x = re.sub(r"\b(?:[a-z]\.){2,}[a-z]?\.?", lambda m: m.group(0).replace(".", ""), x)
    return " ".join(re.sub(r"[^a-z0-9]+", " ", re.sub(r"(?<=\w)[.'](?=\w)", "", x)).split())


def _relaxed(value):
    x = re.sub(rf"[\[(](?:[^\])]*(?:{'|'.join(text.VERSION_WORDS)})[^\])]*)[\])]", " ", value or "", flags=re.I)
    x = re.sub(rf"\s+(?:-|–|—)\s+.*(?:{'|'.join(text.VERSION_WORDS)}).*$", " ", x, flags=re.I)
    return _key(re.sub(r"\b(?:feat|ft)\.?\s+.*$", " ", x, flags=re.I))


def test_keys_of_every_title(spark, catalogues):
    for d, items in catalogues.items():
        got = {r.item_id: (r.strict_key, r.relaxed_key) for r in sequence_queries.match_keys(spark, d).collect()}
        assert got == {k: (_key(t), _relaxed(t)) for k, t, _, _ in items if t is not None}


def test_every_title_is_matched_to_albums(spark, catalogues):
    def once(table, of):
        by = {}
        for k, a, t in table:
            if _key(a) and of(t):
                by.setdefault((_key(a), of(t)), []).append(k)
        return {key: ids[0] for key, ids in by.items() if len(ids) == 1}

    total = 0
    for d, items in catalogues.items():
        albums = {}
        for k, _, a, b in items:
            if a is not None and b is not None:
                albums[a, b] = min(k, albums.get((a, b), k))
        left, right, expected = [(k, a, t) for k, t, a, _ in items], [("a" + k, a, b) for (a, b), k in albums.items()], set()
        for of, kind in ((_key, "strict"), (_relaxed, "relaxed-version")):
            x, y = once(left, of), once(right, of)
            hits = {(x[key], y[key], kind) for key in x.keys() & y.keys()}
            expected |= hits
            left, right = [r for r in left if r[0] not in {h[0] for h in hits}], [r for r in right if r[0] not in {h[1] for h in hits}]
        got = sequence_queries.match_cascade(spark, d).collect()
        assert {tuple(r) for r in got if r.right_id} == expected and sorted(r.left_id for r in got) == sorted(k for k, *_ in items)
        total += len(expected)
    assert total >= 2


def test_metadata_strings_of_every_item(spark, catalogues):
    for d, items in catalogues.items():
        expected = {}
        for k, t, a, b in items:
            if None not in (t, a, b):
                raw = f"'{t}' by {a} in album'{b}'"
                m = re.match(r"'(.+?)'\s+by\s+(.+?)\s+in\s+album'(.+?)'$", raw)
                expected[k] = m.groups() if m else (raw.strip("'"), None, None)
        got = {r.item_id: (r.title, r.artist, r.album) for r in content_queries.feat_metadata_strings(spark, d).collect()}
        assert got == expected


LYRICS = ["Über  uns\r\nüber\tuns\u2028東京 の夜\x85ÉTÉ\rété\n\u00a0\n \u3000x y\u00a0z ", "a\tb\x1fc\x0bA B C\n\n日本語", "", "é" * 150 + "\n" + "日" * 47 + "\nx", "straße\nSTRASSE\nnaïve café, naïve café 東京 x 42 a_b"]


@pytest.fixture(scope="module")
def lyrics(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("lyrics")
    spark.createDataFrame([(i, t, "lyric_draft", "x") for i, t in enumerate(LYRICS)], "doc_id long, text string, source string, lang string").write.parquet(f"{folder}/documents.parquet")
    return {d: {r.doc_id: r.text for r in content_queries._docs(spark, d).where("source = 'lyric_draft' AND text IS NOT NULL").collect()} for d in (str(DATA / "sf0.1"), str(folder))}


def test_lines_of_the_stored_text(spark, lyrics):
    for d, docs in lyrics.items():
        lines, excerpts = {}, {}
        for k, t in docs.items():
            kept = {}
            for x in t.splitlines():
                x = re.sub(r"\s+", " ", x).strip()
                if x:
                    kept.setdefault(x.lower(), x)
            clean = "\n".join(kept.values())
            lines[k] = (hashlib.md5(clean.encode()).hexdigest(), len(clean))
            used, taken = 0, []
            for x in filter(str.strip, t.splitlines()):
                if (used := used + len(x) + 1) > 200:
                    break
                taken.append(x)
            excerpts[k] = "\n".join(taken)
        assert {r.doc_id: (r.digest, r.n) for r in content_queries.txt_unique_lines(spark, d).collect()} == lines
        assert {r.doc_id: r.excerpt for r in content_queries.txt_excerpts(spark, d).collect()} == excerpts


def test_terms_of_every_script(spark):
    docs = {r.doc_id: r.text or "" for r in content_queries._docs(spark, str(DATA / "sf0.01")).collect()}
    docs |= {-1 - i: t for i, t in enumerate([*LYRICS, *LYRICS, "東京 Été", "東京 Été"])}
    terms = {}
    for k, t in docs.items():
        w = [x for x in re.findall(r"(?u)\b\w\w+\b", t.lower()) if x not in text.STOPWORDS]
        terms[k] = collections.Counter(w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)])
    df = collections.Counter(t for c in terms.values() for t in c)
    expected = set()
    for k, c in terms.items():
        w = {t: (1 + math.log(n)) * (math.log((1 + len(docs)) / (1 + df[t])) + 1) for t, n in c.items() if df[t] >= 2}
        length = math.sqrt(sum(x * x for x in w.values()))
        top = sorted((-round(x / length, 6), t) for t, x in w.items())[:5]
        expected |= {(k, t, round(-x, 4), i + 1) for i, (x, t) in enumerate(top)}
    table = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got = {(r.doc_id, r.term, round(r.weight, 4), r["rank"]) for r in vocab.tfidf_top(table, "doc_id", "text", 5, words=text.word_runs).collect()}
    assert {t for k, t, *_ in got if k == -2 * len(LYRICS) - 1} == {"東京", "été", "東京 été"}
    assert len(got ^ expected) <= 0.001 * len(expected)


def test_first_hit_beyond_place_100(spark):
    found = model_queries.met_ranking(spark, D).collect()
    records = [(r.prefix_id, r.split_name, r["items"]) for r in sequence_queries.lists(spark, D).collect()]
    n = collections.Counter(x for _, split, items in records if split == "train" for x in items)
    rank = {x: i + 1 for i, x in enumerate(sorted(n, key=lambda x: (-n[x], x)))}
    first = {k: min((rank[x] for x in items if x in rank), default=math.inf) for k, split, items in records if split == "test"}
    assert {r.prefix_id: r.reciprocal_rank for r in found} == {k: pytest.approx(1 / v, abs=1e-6) for k, v in first.items()}
    many = spark.createDataFrame([(f"i{i:05d}", random.Random(i).randrange(3)) for i in range(5000)], "item string, n long")
    got = [r["item"] for r in metrics.places(many, F.desc("n"), F.asc("item")).orderBy("rank").collect()]
    assert got == [r["item"] for r in many.orderBy(F.desc("n"), "item").collect()]
    late = spark.createDataFrame([("k", "i", 250)], "prefix_id string, item string, rank int")
    assert metrics.ranking(late, late, "prefix_id", "item", "rank", [5]).first().reciprocal_rank == 1 / 250
