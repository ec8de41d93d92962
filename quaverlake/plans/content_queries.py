"""Text, vocabulary and vector queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaverlake.functions import scalar, text, vec
from quaverlake.operators import knn, vocab
from quaverlake.sources import readers, writers
from quaverlake.session import cut, read


def _docs(spark, d):
    return read(spark, d, "documents").select("doc_id", "text", "source", "lang")


def _items(spark, d):
    """(item_id, emb): one row per item with a usable vector."""
    raw = read(spark, d, "item_embeddings").where(F.col("item_id").isNotNull() & vec.usable("emb", 64))
    return raw.groupBy("item_id").agg(F.max("emb").alias("emb"))


def _cues(spark, d):
    return read(spark, d, "cue_vocab")


def _df(spark, d):
    return vocab.document_frequency(vocab.phrases(_docs(spark, d), "doc_id", "text"), "doc_id", "phrases")


def _n(spark, d):
    return _docs(spark, d).agg(F.count("*").alias("n_docs"))


def txt_phrases(spark, d):
    rows = vocab.phrases(_docs(spark, d), "doc_id", "text")
    return rows.select("doc_id", F.size("phrases").alias("phrases"), F.size(F.array_distinct("phrases")).alias("distinct_phrases"))


def txt_document_frequency(spark, d):
    banded = vocab.in_band(_df(spark, d).crossJoin(F.broadcast(_n(spark, d))), F.col("n_docs"), 5, 0.3)
    return banded.select("phrase", "df")


def txt_scores(spark, d):
    base = vocab.in_band(_df(spark, d).crossJoin(F.broadcast(_n(spark, d))), F.col("n_docs"), 5, 0.3)
    scored = vocab.ranking_scores(base, F.col("n_docs"))
    return scored.select("phrase", *[F.bround(c, 6).alias(c) for c in ("idf", "df_idf", "band")])


def txt_blocked(spark, d):
    """Phrases in the band that are about more than an artist's name."""
    base = vocab.in_band(_df(spark, d).crossJoin(F.broadcast(_n(spark, d))), F.col("n_docs"), 5, 0.3)
    names = vocab.name_tokens(read(spark, d, "catalog_items"), "artist")
    kept = vocab.without_blocked(base, "phrase", text.BLOCKED_PHRASES, text.HARD_STOPS, text.EDGE_WORDS, names)
    return kept.select("phrase", "df")


def txt_kept_phrases(spark, d):
    base = vocab.in_band(_df(spark, d).crossJoin(F.broadcast(_n(spark, d))), F.col("n_docs"), 5, 0.3)
    return base.where(text.keeps_phrase(F.col("phrase"))).select("phrase", "df")


def txt_stage_counts(spark, d):
    """Survivors of each stage of the cleaning."""
    every = cut(_df(spark, d).crossJoin(F.broadcast(_n(spark, d))))
    banded = vocab.in_band(every, F.col("n_docs"), 5, 0.3)
    kept = banded.where(text.keeps_phrase(F.col("phrase")))
    unblocked = vocab.without_blocked(kept, "phrase", text.BLOCKED_PHRASES, text.HARD_STOPS, text.EDGE_WORDS)
    parts = [df.agg(F.lit(i).alias("stage"), F.lit(name).alias("name"), F.count("*").alias("phrases")) for i, (name, df) in enumerate((("raw", every), ("band", banded), ("form", kept), ("blocklist", unblocked)))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def txt_vocabulary(spark, d):
    base = vocab.in_band(_df(spark, d).crossJoin(F.broadcast(_n(spark, d))), F.col("n_docs"), 5, 0.3)
    scored = vocab.ranking_scores(base.where(text.keeps_phrase(F.col("phrase"))), F.col("n_docs"))
    return vocab.select_vocabulary(scored, "df_idf", 2048)


def txt_stability(spark, d):
    """Overlap of the vocabularies of two halves of the sources."""
    docs = _docs(spark, d)
    side = lambda keep: vocab.document_frequency(vocab.phrases(docs.where(keep), "doc_id", "text"), "doc_id", "phrases").where("df >= 5")
    long = F.col("source").isin("review", "artist_bio", "research_abstract", "wiki_stub", "liner_note")
    return vocab.jaccard(side(long), side(~long), "phrase").withColumn("jaccard", F.bround("jaccard", 6))


def txt_tfidf(spark, d):
    """Five terms of every document, of the words of every script."""
    return vocab.tfidf_top(_docs(spark, d), "doc_id", "text", 5, words=text.word_runs)


def txt_tfidf_letters(spark, d):
    """As ``txt_tfidf``, of the letters a to z, as the phrases are."""
    return vocab.tfidf_top(_docs(spark, d), "doc_id", "text", 5)


def txt_unique_lines(spark, d):
    """Each line of every lyric draft once, of the text as stored."""
    rows = _docs(spark, d).where("source = 'lyric_draft' AND text IS NOT NULL").select("doc_id", text.unique_lines("text").alias("clean"))
    return rows.select("doc_id", F.md5("clean").alias("digest"), F.length("clean").alias("n"))


def txt_excerpts(spark, d):
    """The first lines of every lyric draft, of the text as stored."""
    return _docs(spark, d).where("source = 'lyric_draft' AND text IS NOT NULL").select("doc_id", text.excerpt("text", 200).alias("excerpt"))


def txt_cue_keys(spark, d):
    return _cues(spark, d).select("cue_id", text.cue_key("cue").alias("cue_key"), text.keeps_phrase(text.cue_key("cue")).alias("kept"))


def txt_song_documents(spark, d):
    """Text document, prompt line and tag list of every item."""
    c = read(spark, d, "catalog_items").where("item_id IS NOT NULL").groupBy("item_id").agg(F.max(F.struct("title", "artist", "album", "genre", "mood", "lyric_excerpt", "tags")).alias("r")).select("item_id", "r.*")
    doc = text.document_text("title", "album", "genre", "mood", "lyric_excerpt")
    prompt = F.concat(F.coalesce("title", F.lit("")), F.lit(" by "), F.coalesce("artist", F.lit("")), F.when(F.trim("genre") != "", F.concat(F.lit(" ["), F.lower(F.trim("genre")), F.lit("]"))).otherwise(""))
    return c.select("item_id", doc.alias("document"), prompt.alias("prompt"), F.array_join("tags", "|").alias("tags"))


def cue_usage(spark, d):
    rows = _mappings(spark, d)
    return vocab.usage(rows, "cue_ids", 8)


def _mappings(spark, d):
    return read(spark, d, "cue_mappings").where("item_id IS NOT NULL").groupBy("item_id").agg(F.max(F.struct("cue_ids", "scores")).alias("r")).select("item_id", "r.*")


def cue_health(spark, d):
    rows = cut(_mappings(spark, d))
    both = vocab.health(rows, "cue_ids", 2048, 8, "active").unionByName(vocab.health(rows, "cue_ids", 2048, None, "stored"))
    return both.select("scope", "rows", *[F.bround(c, 6).alias(c) for c in ("complete_share", "empty_slot_share", "vocabulary_share", "entropy")], "rare", F.bround("effective_size", 3).alias("effective_size"))


def cue_top(spark, d):
    """The ten ids most used in active slots, then without the empty one, so nine or ten rows."""
    used = vocab.usage(_mappings(spark, d), "cue_ids", 8)
    top = used.orderBy(F.desc("n"), "cue_id").limit(10)
    return top.where("cue_id <> 0").join(F.broadcast(_cues(spark, d).select("cue_id", "cue")), "cue_id", "left").select("cue_id", F.coalesce("cue", F.format_string("<missing:%d>", "cue_id")).alias("cue"), "n")


def cue_score_rows(spark, d):
    return writers.score_rows(_mappings(spark, d), "item_id", "cue_ids", "scores", _cues(spark, d))


def feat_scaled(spark, d):
    c = read(spark, d, "catalog_items").where("item_id IS NOT NULL").groupBy("item_id").agg(F.max(F.struct("tempo", "mood", "genre", "musical_key")).alias("r")).select("item_id", "r.*")
    hot = scalar.one_hot(F.col("mood"), scalar.MOODS + ["bright", "dreamy", "solemn", "tense", "wistful"])
    return c.select("item_id", F.bround(scalar.minmax(F.col("tempo"), scalar.TEMPO_LOW, scalar.TEMPO_HIGH), 6).alias("tempo_scaled"), scalar.tempo_word(F.col("tempo")).alias("tempo_word"), F.array_join(F.transform(hot, lambda x: x.cast("int").cast("string")), "").alias("mood_hot"))


def feat_top_genres(spark, d):
    """The twenty genres of most items; of equal ones the one that comes first in the feature order."""
    c = read(spark, d, "catalog_items").where("item_id IS NOT NULL").select("item_id", F.lower(F.trim("genre")).alias("genre"), F.when(F.col("feature_index") >= 0, F.col("feature_index")).alias("at")).where("genre <> ''").distinct()
    counts = c.groupBy("genre").agg(F.count("*").alias("n"), F.coalesce(F.min("at"), F.lit(2147483647)).alias("first_index"))
    return counts.orderBy(F.desc("n"), "first_index", "genre").limit(20)


def feat_asset_flags(spark, d):
    c = read(spark, d, "catalog_items").where("item_id IS NOT NULL").groupBy("item_id").agg(F.max(F.struct("title", "artist", "audio_path", "lyric_excerpt")).alias("r")).select("item_id", "r.*")
    has = lambda x: F.coalesce(F.trim(x) != "", F.lit(False))
    flags = c.select("item_id", (has("title") & has("artist")).alias("has_meta"), has("audio_path").alias("has_audio"), has("lyric_excerpt").alias("has_lyrics"))
    return flags.withColumn("complete", F.col("has_meta") & F.col("has_audio") & F.col("has_lyrics"))


def feat_metadata_strings(spark, d):
    """Metadata strings made from every item with title, artist and album and parsed again."""
    c = read(spark, d, "catalog_items").where("item_id IS NOT NULL").groupBy("item_id").agg(F.max(F.struct("title", "artist", "album")).alias("r")).select("item_id", "r.*")
    raw = c.select("item_id", F.concat(F.lit("'"), "title", F.lit("' by "), "artist", F.lit(" in album'"), "album", F.lit("'")).alias("raw")).where("raw IS NOT NULL")
    return raw.select("item_id", *readers.metadata(F.col("raw")))


def vec_norms(spark, d):
    return _items(spark, d).select("item_id", F.bround(vec.norm("emb"), 5).alias("norm"))


def vec_topk(spark, d):
    """The five cues nearest to every item."""
    cues = _cues(spark, d).where("cue_id > 0")
    items = _items(spark, d).select(F.col("item_id").alias("query_id"), F.col("emb").alias("qvec"))
    return knn.exact_topk(cues, items, 5, "cue_id", "emb").select("query_id", "item", "rank")


def vec_assigned(spark, d):
    """Sixteen cues for every item with a usable vector, scores in order, empty slots as 0 with a null score."""
    cues = _cues(spark, d).where("cue_id > 0")
    items = _items(spark, d).select(F.col("item_id").alias("query_id"), F.col("emb").alias("qvec"))
    rows = knn.assigned(knn.exact_topk(cues, items, 16, "cue_id", "emb"), 16)
    return rows.select("query_id", F.array_join("ids", ",").alias("ids"), F.size("scores").alias("n_scores"), F.size(F.filter("scores", lambda s: s.isNull())).alias("empty_slots"))


def _members(spark, d):
    """(prefix_id, pos, item, vector) of the items of every record of at least 20."""
    from quaverlake.plans.sequence_queries import lists

    long = lists(spark, d).where(F.size("items") >= 20)
    return knn.gather(long, "prefix_id", "items", _items(spark, d), "item_id", "emb")


def vec_centroids(spark, d):
    c = knn.centroids(_members(spark, d).where("pos < 15"), "prefix_id", "value")
    return c.select("prefix_id", "n", F.bround("sigma2", 5).alias("sigma2"), F.bround(F.element_at("mu", 1), 5).alias("mu_first"), F.bround(F.element_at("mu", 64), 5).alias("mu_last"))


def vec_diversity(spark, d):
    c = knn.diversity(_members(spark, d), "prefix_id", "value")
    return c.select("prefix_id", "n", F.bround("diversity", 5).alias("diversity"))


def vec_centroid_neighbours(spark, d):
    """The items nearest to the mean of the first 15 of each evaluated record, those 15 excluded."""
    from quaverlake.plans.sequence_queries import lists

    members = _members(spark, d).where("pos < 15")
    asked = lists(spark, d).where("split_name = 'test'").select("prefix_id")
    mu = knn.centroids(members, "prefix_id", "value").join(asked, "prefix_id", "left_semi").select(F.col("prefix_id").cast("string").alias("query_id"), F.col("mu").alias("qvec"))
    hits = knn.exact_topk(_items(spark, d), mu, 25, "item_id", "emb")
    seen = members.select(F.col("prefix_id").cast("string").alias("query_id"), F.col("id").alias("item")).distinct()
    left = hits.join(seen, ["query_id", "item"], "left_anti")
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    return left.withColumn("place", place).where("place <= 5").select("query_id", "place", "item")


def vec_history_fit(spark, d):
    """Of each record: mean and highest cosine of its 16th item to the 15 before."""
    m = _members(spark, d)
    refs, nxt = m.where("pos < 15").select("prefix_id", F.col("value").alias("v")), m.where("pos = 15").select("prefix_id", F.col("value").alias("w"))
    pairs = refs.join(nxt, "prefix_id").select("prefix_id", vec.cosine("v", "w").alias("c"))
    return pairs.groupBy("prefix_id").agg(F.bround(F.avg("c"), 5).alias("fit"), F.bround(F.max("c"), 5).alias("nearest"))


def vec_coverage(spark, d):
    """Five items that cover each record, farthest first."""
    return knn.coverage_selection(_members(spark, d), "prefix_id", "pos", "id", "value", 5)


def vec_distinct_cues(spark, d):
    """Cues left by greedy removal of near-duplicates."""
    kept = knn.greedy_distinct(_cues(spark, d).where("cue_id > 0"), "cue_id", "cue_id", "emb", 0.5)
    return kept.select(F.col("cue_id").cast("int").alias("cue_id"))


def vec_diverse_cues(spark, d):
    """Eight cues for every item with a usable vector out of the 64 nearest, relevance against redundancy."""
    items = _items(spark, d).select(F.col("item_id").alias("query_id"), F.col("emb").alias("qvec"))
    return knn.diverse_topk(_cues(spark, d).where("cue_id > 0"), items, 8, 64, key="cue_id")


_NAMES = (txt_phrases, txt_document_frequency, txt_scores, txt_blocked, txt_kept_phrases, txt_stage_counts, txt_vocabulary, txt_stability, txt_tfidf, txt_tfidf_letters, txt_unique_lines, txt_excerpts, txt_cue_keys, txt_song_documents, cue_usage, cue_health, cue_top, cue_score_rows, feat_scaled, feat_top_genres, feat_asset_flags, feat_metadata_strings, vec_norms, vec_topk, vec_assigned, vec_centroids, vec_diversity, vec_centroid_neighbours, vec_history_fit, vec_coverage, vec_distinct_cues, vec_diverse_cues)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _NAMES}


def _list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


_PHRASES = """
tokens AS (SELECT doc_id, source, regexp_extract_all(lower(coalesce(text, '')), '[a-z]+') AS t FROM documents),
phrases AS (SELECT doc_id, source, list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) AS p FROM tokens),
ex AS (SELECT DISTINCT doc_id, source, unnest(p) AS phrase FROM phrases),
total AS (SELECT count(*) AS n FROM documents),
df AS (SELECT phrase, count(*) AS df FROM ex GROUP BY phrase),
band AS (SELECT phrase, df FROM df, total WHERE df >= 5 AND df <= n * 0.3::DOUBLE)"""
_KEEP = f"""phrase <> '' AND NOT list_contains({_list(text.VERB_LEADS)}, split_part(phrase, ' ', 1)) AND NOT (len(string_split(phrase, ' ')) = 2 AND split_part(phrase, ' ', 1) = split_part(phrase, ' ', 2)) AND len(list_filter(string_split(phrase, ' '), lambda w: NOT list_contains({_list(text.STOPWORDS)}, w) AND NOT list_contains({_list(text.VERB_LEADS)}, w))) > 0"""
_BLOCK = f"""NOT list_contains({_list(text.BLOCKED_PHRASES)}, phrase) AND len(list_filter(string_split(phrase, ' '), lambda w: list_contains({_list(text.HARD_STOPS)}, w))) = 0
 AND (len(string_split(phrase, ' ')) = 1 OR NOT (list_contains({_list(text.EDGE_WORDS)}, split_part(phrase, ' ', 1)) OR list_contains({_list(text.EDGE_WORDS)}, split_part(phrase, ' ', -1))))"""
_IDF = "ln(n / (1.0::DOUBLE + df))"
_MAPPINGS = "m AS (SELECT DISTINCT item_id, cue_ids, scores FROM cue_mappings WHERE item_id IS NOT NULL)"
_ITEMS = """raw AS (SELECT DISTINCT item_id, emb::DOUBLE[] AS v FROM item_embeddings WHERE item_id IS NOT NULL AND emb IS NOT NULL),
items AS (SELECT item_id, v, sqrt(list_inner_product(v, v)) AS norm FROM raw WHERE len(v) = 64 AND list_inner_product(v, v) > 0)"""
_CUES = "cues AS (SELECT cue_id, emb::DOUBLE[] AS v, sqrt(list_inner_product(emb::DOUBLE[], emb::DOUBLE[])) AS norm FROM cue_vocab WHERE cue_id > 0)"
_LISTS = """lists AS (SELECT prefix_id, split_name, items AS ids FROM (
  SELECT DISTINCT prefix_id, split_name, list_filter(list_transform(item_ids, lambda x: trim(x)), lambda x: x IS NOT NULL AND x <> '') AS items FROM context_prefixes WHERE prefix_id IS NOT NULL AND item_ids IS NOT NULL) WHERE len(items) >= 20),
slots AS (SELECT prefix_id, split_name, generate_subscripts(ids, 1) - 1 AS pos, unnest(ids) AS item_id FROM lists),
members AS (SELECT prefix_id, split_name, pos, s.item_id, v, norm FROM slots s JOIN items i ON i.item_id = s.item_id)"""
_MU = ", ".join(f"avg(v[{i}])" for i in range(1, 65))
_ITEM = "SELECT DISTINCT item_id, {0} FROM catalog_items WHERE item_id IS NOT NULL"


def _health(scope: str, ids: str) -> str:
    return f"""SELECT '{scope}' AS scope, count(*) AS rows,
 round_even(avg((len(list_filter({ids}, lambda x: x IS NULL OR x = 0)) = 0)::INT), 6) AS complete_share,
 round_even(sum(len(list_filter({ids}, lambda x: x IS NULL OR x = 0))) / sum(len({ids})), 6) AS empty_slot_share,
 any_value(u.vocabulary_share) AS vocabulary_share, any_value(u.entropy) AS entropy, any_value(u.rare) AS rare, any_value(u.effective_size) AS effective_size
FROM m, (SELECT round_even(count(*) / 2047, 6) AS vocabulary_share, round_even(-sum(n / t * log2(n / t)), 6) AS entropy, count(*) FILTER (WHERE n < 5) AS rare, round_even(pow(2, -sum(n / t * log2(n / t))), 3) AS effective_size
  FROM (SELECT cue_id, count(*) AS n, sum(count(*)) OVER () AS t FROM (SELECT unnest({ids}) AS cue_id FROM m) WHERE cue_id <> 0 GROUP BY cue_id)) u WHERE cue_ids IS NOT NULL"""


def covering(base: str, k: int) -> str:
    """CTEs sims and h<k> (prefix_id, place, pos) over ``base`` (prefix_id, pos, v, norm): the first by pos, then step by step the one least
    similar to its nearest chosen one, each step written out."""
    parts = [f"sims AS (SELECT a.prefix_id, a.pos AS p, b.pos AS q, list_inner_product(a.v, b.v) / (a.norm * b.norm) AS c FROM {base} a JOIN {base} b ON a.prefix_id = b.prefix_id)", f"h1 AS (SELECT prefix_id, 0 AS place, min(pos) AS pos FROM {base} GROUP BY prefix_id)"]
    for i in range(2, k + 1):
        parts.append(
            f"h{i} AS (SELECT * FROM h{i - 1} UNION ALL SELECT prefix_id, {i - 1}, p FROM (SELECT s.prefix_id, s.p, round_even(max(c), 9) AS near FROM sims s JOIN h{i - 1} h ON h.prefix_id = s.prefix_id AND h.pos = s.q "
            f"WHERE NOT EXISTS (SELECT 1 FROM h{i - 1} x WHERE x.prefix_id = s.prefix_id AND x.pos = s.p) GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY prefix_id ORDER BY near, p) = 1)"
        )
    return ",\n".join(parts)


def oracle_sql() -> dict[str, str]:
    nearest = lambda k, source: f"""WITH {_ITEMS}, {_CUES}, scored AS (SELECT i.item_id AS query_id, c.cue_id, round_even(list_inner_product(i.v, c.v) / (i.norm * c.norm), 6) AS score FROM {source} CROSS JOIN cues c),
ranked AS (SELECT query_id, cue_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, cue_id::VARCHAR) AS rank FROM scored QUALIFY rank <= {k})"""  # noqa: E731
    return {
        "txt_phrases": f"WITH {_PHRASES} SELECT doc_id, len(p)::INT AS phrases, len(list_distinct(p))::INT AS distinct_phrases FROM phrases",
        "txt_document_frequency": f"WITH {_PHRASES} SELECT phrase, df FROM band",
        "txt_scores": f"WITH {_PHRASES} SELECT phrase, round_even({_IDF}, 6) AS idf, round_even(df * {_IDF}, 6) AS df_idf, round_even(-abs(ln(df / n) - ln(0.02::DOUBLE)), 6) + 0.0 AS band FROM band, total",
        "txt_blocked": f"""WITH {_PHRASES}, names AS (SELECT DISTINCT unnest(regexp_extract_all(lower(coalesce(artist, '')), '[a-z]+')) AS token FROM catalog_items), ok AS (SELECT token FROM names WHERE NOT list_contains({_list(text.STOPWORDS)}, token)), f AS (SELECT * FROM band WHERE {_BLOCK}), w AS (SELECT phrase, df, unnest(string_split(phrase, ' ')) AS token FROM f)
SELECT phrase, any_value(df) AS df FROM w GROUP BY phrase HAVING count(*) FILTER (WHERE token NOT IN (SELECT token FROM ok)) > 0""",
        "txt_kept_phrases": f"WITH {_PHRASES} SELECT phrase, df FROM band WHERE {_KEEP}",
        "txt_stage_counts": f"""WITH {_PHRASES}, k AS (SELECT phrase FROM band WHERE {_KEEP})
SELECT 0 AS stage, 'raw' AS name, count(*) AS phrases FROM df UNION ALL SELECT 1, 'band', count(*) FROM band UNION ALL SELECT 2, 'form', count(*) FROM k UNION ALL SELECT 3, 'blocklist', count(*) FROM k WHERE {_BLOCK}""",
        "txt_vocabulary": f"""WITH {_PHRASES}, r AS (SELECT phrase, row_number() OVER (ORDER BY round_even(df * {_IDF}, 9) DESC, phrase) AS i FROM band, total WHERE {_KEEP}), top AS (SELECT i::INT AS cue_id, phrase AS cue FROM r WHERE i < 2048)
SELECT 0 AS cue_id, '<unk>' AS cue, false AS is_pad UNION ALL SELECT cue_id, cue, false FROM top UNION ALL SELECT g::INT, '<pad_' || g || '>', true FROM range(1, 2048) t(g) WHERE g NOT IN (SELECT cue_id FROM top)""",
        "txt_stability": f"""WITH {_PHRASES}, s AS (SELECT phrase, source IN ('review', 'artist_bio', 'research_abstract', 'wiki_stub', 'liner_note') AS l FROM ex WHERE source IS NOT NULL), c AS (SELECT phrase, l FROM s GROUP BY 1, 2 HAVING count(*) >= 5), g AS (SELECT phrase, count(*) AS n FROM c GROUP BY 1)
SELECT count(*) FILTER (WHERE n = 2) AS common, count(*) AS either, CASE WHEN count(*) = 0 THEN 1.0 ELSE round_even(count(*) FILTER (WHERE n = 2) / count(*), 6) END AS jaccard FROM g""",
        "txt_tfidf_letters": f"""WITH w AS (SELECT doc_id, list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z]+'), lambda x: length(x) > 1 AND NOT list_contains({_list(text.STOPWORDS)}, x)) AS t FROM documents),
l AS (SELECT doc_id, unnest(list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]))) AS term FROM w), tf AS (SELECT doc_id, term, count(*) AS c FROM l GROUP BY 1, 2),
df AS (SELECT term, ln((1.0 + (SELECT count(*) FROM documents)) / (1.0 + count(*))) + 1.0 AS idf FROM tf GROUP BY term HAVING count(*) >= 2),
s AS (SELECT doc_id, term, (1.0 + ln(c)) * idf AS w FROM tf JOIN df USING (term)), n AS (SELECT doc_id, term, round_even(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM s)
SELECT doc_id, term, weight, (row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, term))::INT AS rank FROM n QUALIFY rank <= 5""",
        "txt_cue_keys": f"""WITH k AS (SELECT cue_id, list_filter(string_split(trim(regexp_replace(lower(cue), '[^a-z0-9'']+', ' ', 'g'), ' '''), ' '), lambda w: w <> '') AS t FROM cue_vocab), p AS (SELECT cue_id, array_to_string(t, ' ') AS phrase FROM k) SELECT cue_id, phrase AS cue_key, ({_KEEP}) AS kept FROM p""",
        "txt_song_documents": f"""WITH c AS ({_ITEM.format('title, artist, album, genre, mood, lyric_excerpt, tags')})
SELECT item_id, concat_ws(' ', nullif(trim(title), ''), nullif(trim(album), ''), nullif(trim(genre), ''), nullif(trim(mood), ''), nullif(trim(lyric_excerpt), '')) AS document,
coalesce(title, '') || ' by ' || coalesce(artist, '') || CASE WHEN trim(genre) <> '' THEN ' [' || lower(trim(genre)) || ']' ELSE '' END AS prompt, array_to_string(tags, '|') AS tags FROM c""",
        "cue_usage": f"WITH {_MAPPINGS}, s AS (SELECT unnest(cue_ids[1:8]) AS cue_id FROM m) SELECT cue_id, count(*) AS n FROM s WHERE cue_id IS NOT NULL GROUP BY cue_id",
        "cue_health": f"WITH {_MAPPINGS} {_health('active', 'cue_ids[1:8]')} UNION ALL {_health('stored', 'cue_ids')}",
        "cue_top": f"""WITH {_MAPPINGS}, s AS (SELECT unnest(cue_ids[1:8]) AS cue_id FROM m), t AS (SELECT cue_id, count(*) AS n FROM s WHERE cue_id IS NOT NULL GROUP BY cue_id ORDER BY n DESC, cue_id LIMIT 10)
SELECT t.cue_id, coalesce(cue, '<missing:' || t.cue_id || '>') AS cue, n FROM t LEFT JOIN cue_vocab v ON v.cue_id = t.cue_id WHERE t.cue_id <> 0""",
        "cue_score_rows": f"""WITH {_MAPPINGS}, s AS (SELECT item_id, unnest(range(1, greatest(len(cue_ids), len(scores)) + 1)) AS rank, cue_ids, scores FROM m), x AS (SELECT item_id, rank::INT AS rank, cue_ids[rank] AS cue_id, scores[rank] AS s FROM s)
SELECT item_id, rank, x.cue_id, coalesce(cue, '<missing:' || x.cue_id || '>') AS cue, CASE WHEN s IS NULL THEN '' ELSE printf('%.8f', s) END AS relevance_score, x.cue_id = 0 AS is_unk FROM x LEFT JOIN cue_vocab v ON v.cue_id = x.cue_id""",
        "feat_scaled": f"""WITH c AS ({_ITEM.format('tempo, mood')}) SELECT item_id, round_even(CASE WHEN tempo IS NULL OR isnan(tempo) THEN 0.5 ELSE least(1.0, greatest(0.0, (tempo - 39.0::DOUBLE) / 196.0::DOUBLE)) END, 6) AS tempo_scaled,
CASE WHEN tempo IS NULL THEN NULL WHEN tempo < 70 THEN 'very slow, ballad-paced' WHEN tempo < 100 THEN 'slow to moderate, relaxed' WHEN tempo < 120 THEN 'moderate, mid-tempo' WHEN tempo < 140 THEN 'upbeat, lively' ELSE 'fast-paced, energetic' END AS tempo_word,
array_to_string(list_transform({_list(scalar.MOODS + ['bright', 'dreamy', 'solemn', 'tense', 'wistful'])}, lambda x: CASE WHEN lower(trim(mood)) = x THEN '1' ELSE '0' END), '') AS mood_hot FROM c""",
        "feat_top_genres": "WITH c AS (SELECT DISTINCT item_id, lower(trim(genre)) AS genre, CASE WHEN feature_index >= 0 THEN feature_index END AS fi FROM catalog_items WHERE item_id IS NOT NULL AND trim(genre) <> '') SELECT genre, count(*) AS n, coalesce(min(fi), 2147483647) AS first_index FROM c GROUP BY genre ORDER BY n DESC, first_index, genre LIMIT 20",
        "feat_asset_flags": f"""WITH c AS ({_ITEM.format('title, artist, audio_path, lyric_excerpt')}), f AS (SELECT item_id, coalesce(trim(title) <> '', false) AND coalesce(trim(artist) <> '', false) AS has_meta, coalesce(trim(audio_path) <> '', false) AS has_audio, coalesce(trim(lyric_excerpt) <> '', false) AS has_lyrics FROM c) SELECT *, has_meta AND has_audio AND has_lyrics AS complete FROM f""",
        "vec_norms": f"WITH {_ITEMS} SELECT item_id, round_even(norm, 5) AS norm FROM items",
        "vec_topk": nearest(5, "items i") + " SELECT query_id, cue_id::VARCHAR AS item, rank::INT AS rank FROM ranked",
        "vec_assigned": nearest(16, "items i") + " SELECT query_id, array_to_string(list(cue_id ORDER BY rank), ',') AS ids, 16 AS n_scores, 0 AS empty_slots FROM ranked GROUP BY query_id",
        "vec_centroids": f"""WITH {_ITEMS}, {_LISTS}, a AS (SELECT prefix_id, count(*) AS n, [{_MU}] AS mu, avg(list_inner_product(v, v)) AS sq FROM members WHERE pos < 15 GROUP BY prefix_id)
SELECT prefix_id, n, round_even(greatest(0, sq - list_inner_product(mu, mu)), 5) AS sigma2, round_even(mu[1], 5) + 0.0 AS mu_first, round_even(mu[64], 5) + 0.0 AS mu_last FROM a""",
        "vec_diversity": f"""WITH {_ITEMS}, {_LISTS}, p AS (SELECT a.prefix_id, avg(list_inner_product(a.v, b.v) / (a.norm * b.norm)) AS c FROM members a JOIN members b ON a.prefix_id = b.prefix_id AND a.pos < b.pos GROUP BY 1), n AS (SELECT prefix_id, count(*) AS n FROM members GROUP BY 1)
SELECT prefix_id, n, round_even(1 - c, 5) AS diversity FROM p JOIN n USING (prefix_id)""",
        "vec_centroid_neighbours": f"""WITH {_ITEMS}, {_LISTS}, a AS (SELECT prefix_id, [{_MU}] AS mu FROM members WHERE pos < 15 AND split_name = 'test' GROUP BY prefix_id), q AS (SELECT prefix_id, mu, sqrt(list_inner_product(mu, mu)) AS norm FROM a),
s AS (SELECT q.prefix_id, i.item_id, round_even(list_inner_product(q.mu, i.v) / (q.norm * i.norm), 6) AS score FROM q CROSS JOIN items i WHERE NOT EXISTS (SELECT 1 FROM members m WHERE m.prefix_id = q.prefix_id AND m.pos < 15 AND m.item_id = i.item_id))
SELECT prefix_id::VARCHAR AS query_id, (row_number() OVER (PARTITION BY prefix_id ORDER BY score DESC, item_id))::INT AS place, item_id AS item FROM s QUALIFY place <= 5""",
        "vec_coverage": f"""WITH {_ITEMS}, {_LISTS}, once AS (SELECT prefix_id, item_id, min(pos) AS pos, any_value(v) AS v, any_value(norm) AS norm FROM members GROUP BY 1, 2), {covering('once', 5)}
SELECT h5.prefix_id, place::INT AS place, item_id AS item FROM h5 JOIN once ON once.prefix_id = h5.prefix_id AND once.pos = h5.pos""",
        "vec_history_fit": f"""WITH {_ITEMS}, {_LISTS} SELECT a.prefix_id, round_even(avg(list_inner_product(a.v, b.v) / (a.norm * b.norm)), 5) AS fit, round_even(max(list_inner_product(a.v, b.v) / (a.norm * b.norm)), 5) AS nearest FROM members a JOIN members b ON a.prefix_id = b.prefix_id AND b.pos = 15 AND a.pos < 15 GROUP BY a.prefix_id""",
    }
