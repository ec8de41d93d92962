"""Queries of record assembly, token sequences by split, vocabulary rankings, pools and wording checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaverlake.functions import hashing, text
from quaverlake.operators import assembly, checks, knn, metrics, retrieval, sequences, tokens, vocab
from quaverlake.plans.content_queries import _CUES, _IDF, _ITEM, _ITEMS, _KEEP, _LISTS, _MAPPINGS, _PHRASES, _cues, _df, _docs, _items, _mappings, _members, _n
from quaverlake.plans.model_queries import _FIRST, _SEQ, _SLOT, _coded, _predictions, _sequences, _slots
from quaverlake.plans.sequence_queries import LISTS, LOG, _log, lists
from quaverlake.session import cut, read


def _once(spark, d, *columns: str) -> DataFrame:
    """One row per catalogue item."""
    raw = read(spark, d, "catalog_items").where("item_id IS NOT NULL")
    return raw.groupBy("item_id").agg(F.max(F.struct(*columns)).alias("r")).select("item_id", "r.*")


def asm_event_items(spark, d):
    """Events by whether a strict match maps their track; items with a feature number count as strict matches."""
    matches = _once(spark, d, "feature_index").select("item_id", "feature_index", F.when(F.col("feature_index") >= 0, "strict").otherwise("relaxed-version").alias("match_type"))
    strict = assembly.accepted_matches(matches)
    out = assembly.mapped_events(_log(spark, d), "item", strict, "item_id", "feature_index")
    return out.groupBy(F.col("mapped_item").isNotNull().alias("mapped")).agg(F.count("*").alias("events"), F.count_distinct("mapped_item").alias("items"))


def asm_tags(spark, d):
    """Tags of every item, else its genre as the only one, and which it was."""
    c = _once(spark, d, "tags", "genre")
    genre = F.when(F.trim("genre") != "", F.array(F.lower(F.trim("genre"))))
    value, source = assembly.by_precedence({"tags": F.col("tags"), "genre": genre}, longest=5)
    return c.select("item_id", F.array_join(value, "|").alias("tags"), source.alias("source"))


def asm_genres(spark, d):
    """Genre of every item: its first tag, else its genre."""
    c = _once(spark, d, "tags", "genre")
    value, source = assembly.by_precedence({"tag": F.try_element_at("tags", F.lit(1)), "genre": F.col("genre")})
    return c.select("item_id", value.alias("genre"), source.alias("source"))


def asm_display(spark, d):
    """Title and artist to show for every song of a document, with defaults."""
    songs = read(spark, d, "documents").select(F.trim("item_id").alias("song")).where("song <> ''").distinct()
    return assembly.looked_up(songs, "song", _once(spark, d, "title", "artist"), "item_id", {"title": "Unknown title", "artist": "Unknown artist"})


def asm_cue_names(spark, d):
    """Names of the cue ids of every item, and of its tags, which are no ids."""
    rows = _mappings(spark, d).join(_once(spark, d, "tags"), "item_id").select("item_id", F.concat(F.coalesce(F.col("cue_ids").cast("array<string>"), F.array().cast("array<string>")), F.coalesce("tags", F.array().cast("array<string>"))).alias("ids"))
    return assembly.cue_names(rows, "item_id", "ids", _cues(spark, d), "cue_id", "cue")


def asm_not_dense(spark, d):
    """What keeps the row numbers of the embedding table from being dense."""
    return assembly.not_dense(read(spark, d, "item_embeddings").select("item_id", "row_idx").distinct(), "row_idx")


def asm_gathered_rows(spark, d):
    """The stored row that each item's row number points at: the id comes back."""
    e = read(spark, d, "item_embeddings").where("item_id IS NOT NULL AND row_idx IS NOT NULL").select("item_id", "row_idx").distinct()
    table = e.groupBy(F.col("row_idx").alias("r")).agg(F.min("item_id").alias("owner"))
    return assembly.gathered_rows(e, "item_id", "row_idx", table, "r", "owner").select("item_id", F.col("value").alias("owner"))


def asm_remapped(spark, d):
    """Values of an older vocabulary of 845 tokens in this one; new rows keep what they had."""
    target = spark.range(0, 2894).select(F.col("id").cast("int").alias("token"), F.lit(-1).alias("v"))
    source = spark.range(0, 845).select(F.col("id").cast("int").alias("old"), (F.col("id") * 7).cast("int").alias("v"))
    return assembly.remapped_rows(target, "token", "v", source, "old", tokens.remap_pairs(spark, 845, 843, 844))


def asm_plan_shape(spark, d):
    """Evaluation records whose references, targets or stored cues don't have five."""
    p = _predictions(spark, d).select("prefix_id", "predicted", "targets", F.slice("references", 1, F.size(F.array_distinct("predicted"))).alias("distinct_predictions"))
    return assembly.plan_shape(p, "prefix_id", ["predicted", "targets", "distinct_predictions"], 5)


def asm_systems(spark, d):
    """Records of three systems over the evaluation records, with the cues that each has."""
    first = sequences.first_window(lists(spark, d), "prefix_id", "items").select("prefix_id", F.element_at("references", 15).alias("item"))
    own = first.join(_mappings(spark, d).select(F.col("item_id").alias("item"), "cue_ids"), "item", "left").select("prefix_id", "item", F.when(F.size("cue_ids") >= 8, F.slice("cue_ids", 1, 8)).alias("predicted"))
    plans = own.where("predicted IS NOT NULL").select("prefix_id", "item", "predicted", F.explode(F.array(*[F.lit(s) for s in ("predicted", "retrieved", "direct")])).alias("system"))
    out = assembly.system_records(plans, "prefix_id", "system", "item", "predicted", _mappings(spark, d), "item_id", "cue_ids")
    return out.groupBy("system", "cue_source").agg(F.count("*").alias("records"), F.sum(F.size("cue_ids")).alias("cues"), F.count("retrieved_item").alias("with_item"))


def asm_requests(spark, d):
    """Items with a lyric excerpt, numbered, the excerpt within a request's budget of 60 characters."""
    return assembly.requests(_once(spark, d, "lyric_excerpt"), "item_id", "item_id", "lyric_excerpt", 60)


def txt_conditions(spark, d):
    """Cues of every item as assigned, by chance, and none."""
    out = assembly.conditions(_once(spark, d, "title"), "item_id", _mappings(spark, d), "item_id", "cue_ids", _cues(spark, d), "cue_id")
    return out.select("item_id", "condition", F.array_join(F.transform("cue_ids", lambda c: c.cast("string")), ",").alias("cue_ids"))


def txt_input_types(spark, d):
    """Records by what they say of their input, and by what they hold."""
    rows = read(spark, d, "context_prefixes").where("prefix_id IS NOT NULL").select("prefix_id", "source", "item_ids", "raw_input").distinct()
    kind = text.input_type(F.when(F.size("item_ids") > 0, F.col("item_ids")), F.when(F.trim("raw_input") != "", F.col("raw_input")))
    return rows.groupBy("source", kind.alias("kind")).agg(F.count("*").alias("records"))


def txt_verbalisations(spark, d):
    """What is wrong with items put into words: eight cues, genre and mood, lyrics with section marks."""
    names = F.map_from_entries(F.collect_list(F.struct("cue_id", "cue")))
    vocabulary = _cues(spark, d).agg(names.alias("names"))
    own = _mappings(spark, d).select("item_id", F.slice("cue_ids", 1, 8).alias("ids"))
    c = _once(spark, d, "genre", "mood", "lyric_excerpt").join(own, "item_id", "left").crossJoin(F.broadcast(vocabulary))
    cues = F.transform("ids", lambda i: F.coalesce(F.try_element_at("names", i), F.lit("")))
    said = c.select("item_id", cues.alias("cues"), F.concat_ws("; ", F.concat(F.lit("genre: "), F.nullif(F.trim("genre"), F.lit(""))), F.concat(F.lit("mood: "), F.nullif(F.trim("mood"), F.lit("")))).alias("attributes"), "lyric_excerpt")
    problems = text.verbalisation_problems(F.col("cues"), "attributes", "lyric_excerpt", 8)
    return said.select("item_id", F.array_join(problems, ", ").alias("problems"), text.attribute_fields("attributes").alias("fields"), F.bround(text.unique_ratio(F.col("cues")), 6).alias("unique_ratio"))


def _banded(spark, d):
    base = vocab.in_band(_df(spark, d).crossJoin(F.broadcast(_n(spark, d))), F.col("n_docs"), 5, 0.3)
    return vocab.ranking_scores(base.where(text.keeps_phrase(F.col("phrase"))), F.col("n_docs")).withColumn("random", vocab.random_score())


def txt_rankings(spark, d):
    """The hundred best phrases by each of the five scores."""
    scored = cut(_banded(spark, d).select("phrase", "idf", F.col("df").cast("double").alias("df"), "df_idf", "band", "random"))
    out = None
    for name in ("idf", "df", "df_idf", "band", "random"):
        top = vocab.select_vocabulary(scored, name, 101).where("cue_id > 0 AND NOT is_pad").select(F.lit(name).alias("ranking"), F.col("cue_id").alias("place"), "cue")
        out = top if out is None else out.unionByName(top)
    return out


def txt_cluster_vocabulary(spark, d):
    """One phrase for each of 64 clusters of phrases by the pieces that they are made of, by df * idf."""
    scored = cut(_banded(spark, d).select("phrase", "df", "df_idf"))
    vectors = vocab.char_gram_vectors(scored, "phrase", "phrase", dims=256).join(scored, "phrase")
    chosen = knn.cluster_representatives(vectors, "phrase", "emb", "df", 64, 256)
    return vocab.select_vocabulary(chosen.join(scored, "phrase"), "df_idf", 65).where("cue_id > 0 AND NOT is_pad").select(F.col("cue_id").alias("place"), "cue")


def _clean(spark, d):
    """Phrases of every stage of the cleaning: normalised, in the band, of the right form, not blocked, no near-duplicates."""
    keys = vocab.phrases(_docs(spark, d), "doc_id", "text", normal=True)
    every = cut(vocab.document_frequency(keys, "doc_id", "phrases").crossJoin(F.broadcast(_n(spark, d))))
    banded = vocab.in_band(every, F.col("n_docs"), 5, 0.3)
    kept = banded.where(text.keeps_phrase(F.col("phrase")))
    names = vocab.name_tokens(read(spark, d, "catalog_items"), "artist")
    unblocked = cut(vocab.ranking_scores(vocab.without_blocked(kept, "phrase", text.BLOCKED_PHRASES, text.HARD_STOPS, text.EDGE_WORDS, names), F.col("n_docs")))
    return every, banded, kept, unblocked, vocab.near_duplicates_removed(unblocked, "idf")


def txt_clean_stages(spark, d):
    """Phrases left by each stage of the whole cleaning."""
    out = None
    for i, (name, df) in enumerate(zip(("normalised", "band", "form", "blocklist", "distinct"), _clean(spark, d), strict=True)):
        one = df.agg(F.lit(i).alias("stage"), F.lit(name).alias("name"), F.count("*").alias("phrases"))
        out = one if out is None else out.unionByName(one)
    return out


def txt_blocked_names(spark, d):
    """Phrases of the right form that neither the lists nor the names of artists block."""
    base = vocab.in_band(_df(spark, d).crossJoin(F.broadcast(_n(spark, d))), F.col("n_docs"), 5, 0.3).where(text.keeps_phrase(F.col("phrase")))
    names = vocab.name_tokens(read(spark, d, "catalog_items"), "artist")
    return vocab.without_blocked(base, "phrase", text.BLOCKED_PHRASES, text.HARD_STOPS, text.EDGE_WORDS, names).select("phrase", "df")


def txt_sweep_corpus(spark, d):
    """Phrases within the limits by the first quarter, half and all of the documents."""
    docs = cut(metrics.places(_docs(spark, d), F.asc("doc_id")).select("doc_id", "text", "rank"))
    n = docs.agg(F.count("*").alias("n"))
    lists_ = vocab.phrases(docs, "doc_id", "text").join(docs.select("doc_id", "rank"), "doc_id").crossJoin(F.broadcast(n))
    share = F.when(F.col("rank") * 4 <= F.col("n"), 0.25).when(F.col("rank") * 2 <= F.col("n"), 0.5).otherwise(1.0)
    rows = lists_.select(share.alias("share"), F.explode(F.array_distinct("phrases")).alias("phrase")).groupBy("phrase", "share").agg(F.count("*").alias("n"))
    wide = rows.groupBy("phrase").agg(*[F.coalesce(F.sum(F.when(F.col("share") <= s, F.col("n"))), F.lit(0)).alias(f"df{i}") for i, s in enumerate((0.25, 0.5, 1.0))])
    out = wide.agg(*[F.count(F.when(F.col(f"df{i}") >= 5, 1)).alias(f"p{i}") for i in range(3)])
    return out.select(F.explode(F.array(*[F.struct(F.lit(s).alias("share"), F.col(f"p{i}").alias("phrases")) for i, s in enumerate((0.25, 0.5, 1.0))])).alias("x")).select("x.share", "x.phrases")


def txt_prefix_stability(spark, d):
    """Overlap of the vocabulary of the first half of the documents with that of all."""
    docs = cut(metrics.places(_docs(spark, d), F.asc("doc_id")).select("doc_id", "text", "rank"))
    half = docs.crossJoin(F.broadcast(docs.agg(F.count("*").alias("n")))).where(F.col("rank") * 2 <= F.col("n"))
    side = lambda part: vocab.document_frequency(vocab.phrases(part, "doc_id", "text"), "doc_id", "phrases").where("df >= 5")
    return vocab.jaccard(side(half), side(docs), "phrase").withColumn("jaccard", F.bround("jaccard", 6))


def txt_good_for(spark, d):
    """What each item is good for, by its tags."""
    return _once(spark, d, "title", "artist", "tags").select("item_id", text.good_for("title", "artist", F.col("tags")).alias("line"), text.song_prompt("title", "artist", F.lit(None).cast("string")).alias("prompt"))


def txt_capped(spark, d):
    """Lengths of each lyric draft in full, capped at 100 characters, and with each line once."""
    rows = _docs(spark, d).where("source = 'lyric_draft' AND text IS NOT NULL")
    return rows.select("doc_id", *[F.length(text.capped("text", mode, cap)).alias(name) for name, mode, cap in (("whole", "full", 0), ("cut", "cap", 100))], (F.length(text.capped("text", "dedup", 0)) <= F.length("text")).alias("shorter"))


def enc_playlists(spark, d):
    """Stored sequences put together again, with the masks of 15 references and their mean."""
    slots = _slots(spark, d)
    semantic = F.array(*[tokens.code_token(i, F.element_at("codes", i + 1)) for i in range(3)], tokens.conflict_token(F.col("conflict")))
    blocks = slots.select("playlist_id", "slot", tokens.encode_item(semantic, F.col("cues")).alias("block"))
    out = tokens.encode_playlist(blocks, "playlist_id", "slot", "block", 15)
    count = lambda c: F.size(F.filter(c, lambda x: x))
    return out.select("playlist_id", F.size("input_ids").alias("n"), count("attention_mask").alias("attended"), count("target_mask").alias("targets"), F.array_position("target_mask", F.lit(True)).alias("first_target"), F.md5(F.concat_ws(",", F.transform("input_ids", lambda t: t.cast("string")))).alias("digest"))


def enc_context(spark, d):
    """Mean and spread of the first 15 vectors of every record that has them all."""
    m = _members(spark, d).where("pos < 20").select("prefix_id", "pos", F.array(F.lit(tokens.LAYOUT.boi), F.col("pos")).alias("block"), "value")
    whole = m.groupBy("prefix_id").agg(F.count("*").alias("n")).where("n = 20").select("prefix_id")
    out = tokens.encode_playlist(m.join(whole, "prefix_id", "left_semi"), "prefix_id", "pos", "block", 15, "value")
    return out.select("prefix_id", F.bround("sigma2", 4).alias("sigma2"), F.bround(F.element_at("mu", 1), 5).alias("mu_first"))


def enc_split_rows(spark, d):
    """Train rows whole, test rows as references and labels."""
    out = tokens.tokenised_splits(_sequences(spark, d).where("split_name IS NOT NULL"), "playlist_id", "split_name", "input_ids", 15, 5)
    labels = F.array_join(F.transform("labels", lambda x: F.array_join(F.transform(x, lambda t: t.cast("string")), "-")), ",")
    return out.select("playlist_id", "split_name", F.size("input_ids").alias("n"), F.size(F.filter("target_mask", lambda x: x)).alias("masked"), labels.alias("labels"))


def enc_bundle(spark, d):
    """Cosines of the 15 references with the 5 targets of every test record, as an evaluation bundle holds them."""
    m = cut(_members(spark, d).where("pos < 20").join(lists(spark, d).where("split_name = 'test'").select("prefix_id"), "prefix_id", "left_semi"))
    a, b = m.where("pos < 15").select("prefix_id", F.col("pos").alias("i"), F.col("value").alias("v")), m.where("pos >= 15").select("prefix_id", (F.col("pos") - 15).alias("j"), F.col("value").alias("w"))
    from quaverlake.functions import vec

    cells = a.join(b, "prefix_id").select("prefix_id", F.struct("i", "j", vec.cosine("v", "w").alias("c")).alias("x"))
    block = cells.groupBy("prefix_id").agg(F.array_sort(F.collect_list("x")).alias("x"))
    return block.select("prefix_id", F.size("x").alias("cells"), F.bround(F.element_at("x", 1)["c"], 5).alias("first"), F.bround(F.aggregate("x", F.lit(0.0), lambda s, r: s + r["c"]) / F.size("x"), 5).alias("mean"), F.bround(F.array_max(F.transform("x", lambda r: r["c"])), 5).alias("best"))


def enc_allowed(spark, d):
    """What may follow each prefix once the codes of the first five slots are used up."""
    used = _slots(spark, d).where("conflict IS NOT NULL AND slot < 5").select(F.concat("codes", F.array("conflict")).alias("codes")).distinct()
    index = tokens.allowed_next(_coded(spark, d), "codes", used)
    return index.select(F.array_join(F.transform("prefix", lambda x: x.cast("string")), "-").alias("prefix"), F.size("next").alias("n"), F.element_at("next", 1).alias("least"))


def _digits(spark, d):
    """Items by the first three of their cues, numbered in row order."""
    order = read(spark, d, "item_embeddings").where("item_id IS NOT NULL AND row_idx IS NOT NULL").groupBy("item_id").agg(F.min("row_idx").alias("row_idx"))
    rows = _mappings(spark, d).where("size(cue_ids) >= 3").join(order, "item_id").select("item_id", "row_idx", F.array_join(F.transform(F.slice("cue_ids", 1, 1), lambda x: (x % 64).cast("string")), "-").alias("code"))
    return tokens.conflict_digits(rows, "item_id", "code", "row_idx")


def enc_conflict_digits(spark, d):
    return _digits(spark, d)


def enc_conflict_levels(spark, d):
    return tokens.conflict_levels(_digits(spark, d), "digit", 1, 64)


def enc_legacy(spark, d):
    """Token lists of an older layout for every record: BOI and three codes an item, of items by their first three cues."""
    codes = _mappings(spark, d).where("size(cue_ids) >= 3").select("item_id", F.transform(F.slice("cue_ids", 1, 3), lambda c: c % 256).alias("codes"))
    out = tokens.legacy_encode(lists(spark, d), "prefix_id", "items", codes, "item_id", "codes", boi=0)
    return out.select("prefix_id", F.size("tokens").alias("n"), F.md5(F.concat_ws(",", F.transform("tokens", lambda t: t.cast("string")))).alias("digest"))


def enc_legacy_ranges(spark, d):
    return tokens.legacy_type_ranges(spark, 20)


def met_full_hits(spark, d):
    """Hits of the last five references as predictions, elements as often as both sides have them."""
    out = metrics.hits_at(_predictions(spark, d), "prefix_id", "predicted", "targets", [5], multiset=True)
    return out.select("prefix_id", "hit_1", "hit_5", "hit_full", *[F.bround(c, 6).alias(c) for c in ("recall_5", "precision_5", "jaccard_5")])


def met_bundle(spark, d):
    """Cues of all five predicted items against those of the five targets."""
    p = _predictions(spark, d)
    cues = _mappings(spark, d).where("cue_ids IS NOT NULL").select(F.col("item_id").alias("item"), F.slice("cue_ids", 1, 8).alias("c"))
    side = lambda c: p.select("prefix_id", F.posexplode(c).alias("i", "item")).join(cues, "item").groupBy("prefix_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "c"))), lambda x: x["c"]).alias(c))
    out = metrics.bundle_metrics(side("predicted").join(side("targets"), "prefix_id"), "prefix_id", "predicted", "targets")
    return out.select("prefix_id", "matches", *[F.bround(c, 6).alias(c) for c in ("recall", "precision", "jaccard")])


def met_code_hits(spark, d):
    """Codes of the target slots that the slots of references know."""
    s = cut(_slots(spark, d).where("conflict IS NOT NULL").select("slot", F.concat("codes", F.array("conflict")).alias("codes")))
    out = metrics.code_hits(s.where("slot >= 15"), "slot", "codes", s.where("slot < 15"), "codes")
    return out.withColumn("hit_share", F.bround("hit_share", 6))


def met_gaps(spark, d):
    """How far the best cue of every item is ahead of the second."""
    items = _items(spark, d).select(F.col("item_id").alias("query_id"), F.col("emb").alias("qvec"))
    out = metrics.top_gaps(knn.exact_topk(_cues(spark, d).where("cue_id > 0"), items, 2, "cue_id", "emb"), "query_id", "score", "rank")
    return out.select("queries", *[F.bround(c, 5).alias(c) for c in ("mean_top", "mean_gap", "least_gap")])


def met_batch_means(spark, d):
    """Means over all batches of stored numbers, a playlist's vector taken as a batch of values."""
    s = _sequences(spark, d)
    return metrics.mean_rounded(s.select(F.col("sigma_c2").cast("double").alias("sigma"), F.col("mu_c").cast("array<double>").alias("mu")), ["sigma", "mu"], 3)


def seq_histograms(spark, d):
    """Lists by length, and by how many different items they hold."""
    l = cut(lists(spark, d).select(F.size("items").alias("length"), F.size(F.array_distinct("items")).alias("distinct_items")))
    parts = [l.groupBy(F.lit(c).alias("what"), F.col(c).alias("value")).agg(F.count("*").alias("lists")) for c in ("length", "distinct_items")]
    return parts[0].unionByName(parts[1])


def chk_window_coverage(spark, d):
    """Items of the first windows of test records that have no cues, and how often they stand there."""
    first = sequences.first_window(lists(spark, d).where("split_name = 'test'"), "prefix_id", "items")
    counts = first.select(F.explode(F.concat("references", "targets")).alias("item_id")).groupBy("item_id").agg(F.count("*").alias("n"))
    return counts.join(_mappings(spark, d).where("cue_ids IS NOT NULL").select("item_id"), "item_id", "left_anti")


def chk_prepared_arrays(spark, d):
    """Stored target masks that aren't those of 15 references: rows that one side has and the other lacks."""
    s = _sequences(spark, d)
    wanted = tokens.tokenised_splits(s.withColumn("split_name", F.lit("train")), "playlist_id", "split_name", "input_ids", 15, 5).select("playlist_id", F.col("target_mask").alias("m"))
    show = lambda df: df.select("playlist_id", F.md5(F.concat_ws("", F.transform("m", lambda x: x.cast("int").cast("string")))).alias("digest"))
    return checks.unequal_rows(show(s.select("playlist_id", F.col("target_mask").alias("m"))), show(wanted)).groupBy("side").agg(F.count("*").alias("n"))


def vec_intra(spark, d):
    """Mean cosine within the cues of each item."""
    cues = _cues(spark, d).where("cue_id > 0")
    rows = _mappings(spark, d).select("item_id", F.explode(F.array_distinct("cue_ids")).alias("cue_id")).join(cues.select("cue_id", "emb"), "cue_id")
    return knn.mean_pairwise_cosine(rows, "item_id", "emb").select("item_id", "n", F.bround("intra_cosine", 5).alias("intra_cosine"))


def smp_from_pools(spark, d):
    """Five items chosen for every test record out of its pool, nearest to the vectors of its last five references."""
    test = lists(spark, d).where("split_name = 'test' AND size(items) >= 20")
    truth = test.select("prefix_id", F.explode(F.slice("items", 16, 5)).alias("item"))
    pooled = cut(retrieval.pools(truth, "prefix_id", "item", read(spark, d, "catalog_items").where("item_id IS NOT NULL"), "item_id", 20))
    m = _members(spark, d).where("pos BETWEEN 10 AND 14").join(test.select("prefix_id"), "prefix_id", "left_semi").select("prefix_id", (F.col("pos") - 10).alias("step"), F.col("value").alias("q"))
    return retrieval.from_pools(pooled, "prefix_id", m, "q", _items(spark, d), "item_id", "emb", 5)


_NAMES = (asm_event_items, asm_tags, asm_genres, asm_display, asm_cue_names, asm_not_dense, asm_gathered_rows, asm_remapped, asm_plan_shape, asm_systems, asm_requests, txt_conditions, txt_input_types, txt_verbalisations, txt_rankings, txt_cluster_vocabulary, txt_clean_stages, txt_blocked_names, txt_sweep_corpus, txt_prefix_stability, txt_good_for, txt_capped, enc_playlists, enc_context, enc_split_rows, enc_bundle, enc_allowed, enc_conflict_digits, enc_conflict_levels, enc_legacy, enc_legacy_ranges, met_full_hits, met_bundle, met_code_hits, met_gaps, met_batch_means, seq_histograms, chk_window_coverage, chk_prepared_arrays, vec_intra, smp_from_pools)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _NAMES}


_DIGITS = f"""{_MAPPINGS}, o AS (SELECT item_id, min(row_idx) AS row_idx FROM item_embeddings WHERE item_id IS NOT NULL AND row_idx IS NOT NULL GROUP BY 1),
digits AS (SELECT m.item_id, (row_number() OVER (PARTITION BY cue_ids[1] % 64 ORDER BY row_idx, m.item_id))::INT AS digit, cue_ids[1] % 64 AS code FROM m JOIN o USING (item_id) WHERE len(cue_ids) >= 3)"""


def oracle_sql() -> dict[str, str]:
    c = lambda columns: f"c AS ({_ITEM.format(columns)})"
    blocked = "list_contains({0}, {1})"
    words = lambda w: "[" + ", ".join(f"'{x}'" for x in w) + "]"
    ranks = ", ".join(f"row_number() OVER (ORDER BY round_even({e}, 9) DESC, phrase) AS {n}" for n, e in (("idf", _IDF), ("df", "df::DOUBLE"), ("df_idf", f"df * {_IDF}"), ("band", "-abs(ln(df / n) - ln(0.02::DOUBLE))"), ("random", "('0x' || substr(sha256('rank' || chr(0) || '0' || chr(0) || phrase), 1, 13))::BIGINT::DOUBLE")))
    common = "list_sum(list_transform(list_distinct(p), lambda x: least(len(list_filter(p, lambda y: y = x)), len(list_filter(t, lambda y: y = x)))))"
    return {
        "asm_event_items": f"""WITH {LOG}, k AS (SELECT DISTINCT item_id, feature_index FROM catalog_items WHERE item_id IS NOT NULL AND feature_index >= 0)
SELECT feature_index IS NOT NULL AS mapped, count(*) AS events, count(DISTINCT feature_index) AS items FROM log LEFT JOIN k ON k.item_id = log.item GROUP BY 1""",
        "asm_tags": f"WITH {c('tags, genre')} SELECT item_id, CASE WHEN trim(array_to_string(tags, '')) <> '' THEN array_to_string(tags[1:5], '|') WHEN trim(genre) <> '' THEN lower(trim(genre)) END AS tags, CASE WHEN trim(array_to_string(tags, '')) <> '' THEN 'tags' WHEN trim(genre) <> '' THEN 'genre' ELSE 'miss' END AS source FROM c",
        "asm_genres": f"WITH {c('tags, genre')} SELECT item_id, CASE WHEN trim(tags[1]) <> '' THEN tags[1] WHEN trim(genre) <> '' THEN genre END AS genre, CASE WHEN trim(tags[1]) <> '' THEN 'tag' WHEN trim(genre) <> '' THEN 'genre' ELSE 'miss' END AS source FROM c",
        "asm_display": f"WITH {c('title, artist')}, s AS (SELECT DISTINCT trim(item_id) AS song FROM documents WHERE trim(item_id) <> '') SELECT song, CASE WHEN trim(title) <> '' THEN title ELSE 'Unknown title' END AS title, CASE WHEN trim(artist) <> '' THEN artist ELSE 'Unknown artist' END AS artist FROM s LEFT JOIN c ON c.item_id = song",
        "asm_cue_names": f"""WITH {_MAPPINGS}, {c('tags')}, r AS (SELECT item_id, list_concat(coalesce(cue_ids::VARCHAR[], []), coalesce(tags, [])) AS ids FROM m JOIN c USING (item_id)), f AS (SELECT item_id, generate_subscripts(ids, 1) - 1 AS pos, unnest(ids) AS x FROM r)
SELECT item_id, pos::INT AS pos, CASE WHEN try_cast(x AS INT) IS NULL THEN '<invalid:' || coalesce(x, 'null') || '>' ELSE coalesce(cue, '<missing:' || x || '>') END AS cue FROM f LEFT JOIN cue_vocab v ON v.cue_id = try_cast(x AS INT)""",
        "asm_not_dense": """WITH e AS (SELECT DISTINCT item_id, row_idx FROM item_embeddings), s AS (SELECT count(*) AS n, count(row_idx) AS m, count(DISTINCT row_idx) AS d, max(row_idx) AS hi, min(row_idx) AS lo FROM e),
p AS (SELECT 'null row' AS problem, n - m AS n FROM s UNION ALL SELECT 'repeated row', m - d FROM s UNION ALL SELECT 'gap', greatest(hi + 1 - d, 0) FROM s UNION ALL SELECT 'negative row', (lo < 0)::BIGINT FROM s) SELECT problem, n FROM p WHERE n > 0""",
        "asm_gathered_rows": "WITH e AS (SELECT DISTINCT item_id, row_idx FROM item_embeddings WHERE item_id IS NOT NULL AND row_idx IS NOT NULL) SELECT item_id, (SELECT min(f.item_id) FROM e f WHERE f.row_idx = e.row_idx) AS owner FROM e",
        "asm_remapped": "SELECT i::INT AS token, (CASE WHEN i <= 844 THEN i * 7 ELSE -1 END)::INT AS v, i <= 844 AS copied FROM range(0, 2894) t(i)",
        "asm_plan_shape": f"WITH {_FIRST} SELECT prefix_id, 'distinct_predictions' AS problem FROM firsts WHERE len(list_distinct(predicted)) < 5",
        "asm_systems": f"""WITH {_FIRST}, {_MAPPINGS}, p AS (SELECT prefix_id FROM firsts JOIN m ON m.item_id = refs[15] WHERE len(cue_ids) >= 8)
SELECT s AS system, CASE s WHEN 'predicted' THEN 'model-predicted' WHEN 'retrieved' THEN 'retrieved-catalog-item' END AS cue_source, count(*) AS records, (CASE WHEN s = 'direct' THEN 0 ELSE 8 * count(*) END)::BIGINT AS cues, CASE WHEN s = 'direct' THEN 0 ELSE count(*) END AS with_item FROM p CROSS JOIN (VALUES ('predicted'), ('retrieved'), ('direct')) g(s) GROUP BY s""",
        "asm_requests": f"WITH {c('lyric_excerpt')} SELECT row_number() OVER (ORDER BY item_id) - 1 AS request, item_id, substr(lyric_excerpt, 1, 60) AS prompt_text, length(lyric_excerpt)::INT AS n_chars FROM c WHERE trim(lyric_excerpt, ' ') <> ''",
        "txt_conditions": f"""WITH {_MAPPINGS}, b AS (SELECT DISTINCT item_id FROM catalog_items WHERE item_id IS NOT NULL), v AS (SELECT list(cue_id ORDER BY sha256('cue' || chr(0) || '0' || chr(0) || cue_id), cue_id) AS line FROM cue_vocab WHERE cue <> '<unk>' AND NOT starts_with(cue, '<pad_')),
s AS (SELECT item_id, ('0x' || substr(sha256('random' || chr(0) || '0' || chr(0) || item_id), 1, 15))::BIGINT AS h FROM b)
SELECT b.item_id, 'assigned' AS condition, coalesce(array_to_string(list_filter(cue_ids, lambda x: x <> 0), ','), '') AS cue_ids FROM b LEFT JOIN m USING (item_id)
UNION ALL SELECT item_id, 'random', array_to_string(list_transform(range(0, 6), lambda j: line[(h + j) % len(line) + 1]), ',') FROM s, v UNION ALL SELECT item_id, 'none', '' FROM b""",
        "txt_input_types": """WITH r AS (SELECT DISTINCT prefix_id, source, item_ids, raw_input FROM context_prefixes WHERE prefix_id IS NOT NULL), k AS (SELECT source, len(item_ids) > 0 AS has, len(list_filter(item_ids, lambda x: x IS NULL)) = 0 AS sound, coalesce(trim(raw_input) <> '', false) AS said FROM r)
SELECT source, CASE WHEN has AND sound AND said THEN 'hybrid' WHEN said AND NOT coalesce(has, false) THEN 'text_only' WHEN has AND sound AND NOT said THEN 'song_only' ELSE 'unknown' END AS kind, count(*) AS records FROM k GROUP BY ALL""",
        "txt_verbalisations": f"""WITH {c('genre, mood, lyric_excerpt')}, {_MAPPINGS}, v AS (SELECT map_from_entries(list((cue_id, cue))) AS names FROM cue_vocab), w AS (SELECT c.*, list_transform(cue_ids[1:8], lambda x: coalesce(names[x], '')) AS cues, concat_ws('; ', 'genre: ' || nullif(trim(genre), ''), 'mood: ' || nullif(trim(mood), '')) AS attributes FROM c LEFT JOIN m USING (item_id) CROSS JOIN v)
SELECT item_id, concat_ws(', ', CASE WHEN coalesce(len(cues) <> 8, true) THEN 'cue count' END, CASE WHEN len(list_filter(cues, lambda x: trim(x) = '')) > 0 THEN 'empty cue' END, CASE WHEN trim(attributes) = '' THEN 'empty attributes' END, CASE WHEN coalesce(trim(lyric_excerpt) = '', true) THEN 'empty lyrics' END,
CASE WHEN trim(lyric_excerpt) <> '' AND NOT (contains(lower(lyric_excerpt), '[verse]') AND contains(lower(lyric_excerpt), '[chorus]')) THEN 'no section marks' END) AS problems,
(coalesce(trim(genre) <> '', false)::INT + coalesce(trim(mood) <> '', false)::INT)::INT AS fields, CASE WHEN len(cues) > 0 THEN round_even(len(list_distinct(list_transform(cues, lambda x: lower(trim(x))))) / len(cues), 6) ELSE 1.0 END AS unique_ratio FROM w""",
        "txt_rankings": f"""WITH {_PHRASES}, r AS (SELECT phrase, {ranks} FROM band, total WHERE {_KEEP}), u AS (UNPIVOT r ON idf, df, df_idf, band, random INTO NAME ranking VALUE place) SELECT ranking, place::INT AS place, phrase AS cue FROM u WHERE place <= 100""",
        "txt_blocked_names": f"""WITH {_PHRASES}, names AS (SELECT DISTINCT unnest(regexp_extract_all(lower(coalesce(artist, '')), '[a-z]+')) AS token FROM catalog_items), ok AS (SELECT token FROM names WHERE NOT {blocked.format(words(text.STOPWORDS), 'token')}),
f AS (SELECT * FROM band WHERE {_KEEP} AND NOT {blocked.format(words(text.BLOCKED_PHRASES), 'phrase')} AND len(list_filter(string_split(phrase, ' '), lambda w: {blocked.format(words(text.HARD_STOPS), 'w')})) = 0 AND (len(string_split(phrase, ' ')) = 1 OR NOT ({blocked.format(words(text.EDGE_WORDS), "split_part(phrase, ' ', 1)")} OR {blocked.format(words(text.EDGE_WORDS), "split_part(phrase, ' ', -1)")}))),
w AS (SELECT phrase, df, unnest(string_split(phrase, ' ')) AS token FROM f) SELECT phrase, any_value(df) AS df FROM w GROUP BY phrase HAVING count(*) FILTER (WHERE token NOT IN (SELECT token FROM ok)) > 0""",
        "txt_sweep_corpus": f"""WITH {_PHRASES}, o AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS r, count(*) OVER () AS n FROM documents), e AS (SELECT phrase, r, o.n FROM ex JOIN o USING (doc_id)), f AS (SELECT phrase, s, count(*) FILTER (WHERE r * d <= n) AS k FROM e CROSS JOIN (VALUES (0.25::DOUBLE, 4), (0.5, 2), (1.0, 1)) g(s, d) GROUP BY 1, 2)
SELECT s AS share, count(*) FILTER (WHERE k >= 5) AS phrases FROM f GROUP BY s""",
        "txt_prefix_stability": f"""WITH {_PHRASES}, o AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS r, count(*) OVER () AS n FROM documents), e AS (SELECT phrase, count(*) AS k, count(*) FILTER (WHERE r * 2 <= o.n) AS h FROM ex JOIN o USING (doc_id) GROUP BY phrase)
SELECT count(*) FILTER (WHERE h >= 5) AS common, count(*) FILTER (WHERE k >= 5) AS either, CASE WHEN count(*) FILTER (WHERE k >= 5) = 0 THEN 1.0 ELSE round_even(count(*) FILTER (WHERE h >= 5) / count(*) FILTER (WHERE k >= 5), 6) END AS jaccard FROM e""",
        "txt_good_for": f"""WITH {c('title, artist, tags')}, g AS (SELECT *, list_filter(tags, lambda x: trim(x) <> '') AS u, coalesce(title, '') || ' by ' || coalesce(artist, '') AS n FROM c) SELECT item_id, CASE WHEN len(u) > 0 THEN n || '. Good for: ' || array_to_string(u, ', ') || '.' ELSE n || '.' END AS line, n AS prompt FROM g""",
        "txt_capped": "SELECT doc_id, length(text)::INT AS whole, least(length(text), 100)::INT AS cut, true AS shorter FROM documents WHERE source = 'lyric_draft' AND text IS NOT NULL",
        "enc_playlists": f"WITH {_SEQ} SELECT playlist_id, 262 AS n, 240 AS attended, 60 AS targets, 198::BIGINT AS first_target, md5(array_to_string(input_ids, ',')) AS digest FROM seqs",
        "enc_context": f"""WITH {_ITEMS}, {_LISTS}, w AS (SELECT prefix_id FROM members WHERE pos < 20 GROUP BY 1 HAVING count(*) = 20), a AS (SELECT prefix_id, [{', '.join(f'avg(v[{i}])' for i in range(1, 65))}] AS mu, avg(list_inner_product(v, v)) AS sq FROM members JOIN w USING (prefix_id) WHERE pos < 15 GROUP BY prefix_id)
SELECT prefix_id, round_even(sq - list_inner_product(mu, mu), 4) + 0.0 AS sigma2, round_even(mu[1], 5) + 0.0 AS mu_first FROM a""",
        "enc_split_rows": f"""WITH {_SLOT}, l AS (SELECT playlist_id, string_agg(concat_ws('-', x[2], x[3], x[4], x[5]), ',' ORDER BY slot) AS labels FROM b WHERE slot >= 15 GROUP BY 1)
SELECT playlist_id, split_name, (CASE WHEN split_name = 'test' THEN 197 ELSE 262 END)::INT AS n, (CASE WHEN split_name = 'test' THEN 0 ELSE 60 END)::INT AS masked, CASE WHEN split_name = 'test' THEN labels END AS labels FROM seqs JOIN l USING (playlist_id) WHERE split_name IS NOT NULL""",
        "enc_bundle": f"""WITH {_ITEMS}, {_LISTS}, c AS (SELECT a.prefix_id, a.pos AS i, b.pos AS j, list_inner_product(a.v, b.v) / (a.norm * b.norm) AS c FROM members a JOIN members b ON a.prefix_id = b.prefix_id AND a.pos < 15 AND b.pos BETWEEN 15 AND 19 WHERE a.split_name = 'test')
SELECT prefix_id, count(*)::INT AS cells, round_even(arg_min(c, i * 100 + j), 5) AS first, round_even(avg(c), 5) AS mean, round_even(max(c), 5) AS best FROM c GROUP BY prefix_id""",
        "enc_allowed": f"""WITH {_SLOT}, u AS (SELECT DISTINCT z0, z1, z2, conflict FROM slots WHERE slot < 5), c AS (SELECT DISTINCT z0, z1, z2, conflict FROM slots EXCEPT SELECT * FROM u), p AS (SELECT '' AS prefix, z0 AS nx FROM c UNION ALL SELECT z0::VARCHAR, z1 FROM c UNION ALL SELECT z0 || '-' || z1, z2 FROM c UNION ALL SELECT z0 || '-' || z1 || '-' || z2, conflict FROM c)
SELECT prefix, count(DISTINCT nx)::INT AS n, min(nx)::INT AS least FROM p GROUP BY prefix""",
        "enc_conflict_digits": f"WITH {_DIGITS} SELECT item_id, digit FROM digits",
        "enc_conflict_levels": f"WITH {_DIGITS}, k AS (SELECT code, max(digit) AS most FROM digits GROUP BY code) SELECT most, count(*) AS codes, most * count(*) AS rows, count(*) / 64.0::DOUBLE AS space_share FROM k GROUP BY most",
        "enc_legacy": f"""WITH {LISTS}, {_MAPPINGS}, s AS (SELECT prefix_id, generate_subscripts(items, 1) AS pos, unnest(items) AS item FROM lists), b AS (SELECT prefix_id, pos, '0,' || (cue_ids[1] % 256 + 1) || ',' || (cue_ids[2] % 256 + 257) || ',' || (cue_ids[3] % 256 + 513) AS t FROM s JOIN m ON m.item_id = s.item WHERE len(cue_ids) >= 3)
SELECT prefix_id, (4 * count(*))::INT AS n, md5(string_agg(t, ',' ORDER BY pos)) AS digest FROM b GROUP BY prefix_id""",
        "enc_legacy_ranges": "SELECT p::INT AS pos, (CASE WHEN p % 5 = 0 THEN 1025 ELSE (p % 5 - 1) * 256 + 1 END)::INT AS low, (CASE WHEN p % 5 = 0 THEN 1025 ELSE (p % 5) * 256 END)::INT AS high FROM range(0, 100) t(p)",
        "met_full_hits": f"""WITH {_FIRST}, k AS (SELECT prefix_id, coalesce({common}, 0) AS k FROM (SELECT prefix_id, predicted AS p, targets AS t FROM firsts)) SELECT prefix_id, (k >= 1)::INT AS hit_1, (k >= 5)::INT AS hit_5, (k = 5)::INT AS hit_full, round_even(k / 5, 6) AS recall_5, round_even(k / 5, 6) AS precision_5, round_even(k / (10 - k), 6) AS jaccard_5 FROM k""",
        "met_bundle": f"""WITH {_FIRST}, {_MAPPINGS}, q AS (SELECT item_id, cue_ids[1:8] AS c FROM m WHERE cue_ids IS NOT NULL), a AS (SELECT prefix_id, flatten(list(c)) AS p FROM (SELECT prefix_id, unnest(predicted) AS item FROM firsts) JOIN q ON item_id = item GROUP BY 1), b AS (SELECT prefix_id, flatten(list(c)) AS t FROM (SELECT prefix_id, unnest(targets) AS item FROM firsts) JOIN q ON item_id = item GROUP BY 1),
k AS (SELECT prefix_id, len(p) AS np, len(t) AS nt, coalesce({common}, 0) AS k FROM a JOIN b USING (prefix_id)) SELECT prefix_id, k::INT AS matches, round_even(k / nt, 6) AS recall, round_even(k / np, 6) AS precision, round_even(k / (np + nt - k), 6) AS jaccard FROM k""",
        "met_code_hits": f"""WITH {_SLOT}, cs AS (SELECT slot, (z0, z1, z2, conflict) AS k FROM slots), r AS (SELECT k IN (SELECT k FROM cs WHERE slot < 15) AS hit FROM cs WHERE slot >= 15) SELECT count(*) AS predictions, count(*) FILTER (WHERE hit) AS hits, count(*) FILTER (WHERE NOT hit) AS misses, round_even(count(*) FILTER (WHERE hit) / count(*), 6) AS hit_share FROM r""",
        "met_gaps": f"""WITH {_ITEMS}, {_CUES}, s AS (SELECT i.item_id, round_even(list_inner_product(i.v, c.v) / (i.norm * c.norm), 6) AS score, row_number() OVER (PARTITION BY i.item_id ORDER BY round_even(list_inner_product(i.v, c.v) / (i.norm * c.norm), 6) DESC, c.cue_id::VARCHAR) AS r FROM items i CROSS JOIN cues c QUALIFY r <= 2), t AS (SELECT item_id, max(score) AS a, min(score) AS b FROM s GROUP BY 1)
SELECT count(*) AS queries, round_even(avg(a), 5) AS mean_top, round_even(avg(a - b), 5) AS mean_gap, round_even(min(a - b), 5) AS least_gap FROM t""",
        "met_batch_means": f"WITH {_SEQ} SELECT round_even(avg(sigma_c2::DOUBLE), 3) AS sigma, round_even(sum(list_sum(mu_c::DOUBLE[])) / sum(len(list_filter(mu_c, lambda x: x IS NOT NULL))), 3) + 0.0 AS mu FROM seqs",
        "seq_histograms": f"WITH {LISTS} SELECT 'length' AS what, len(items)::INT AS value, count(*) AS lists FROM lists GROUP BY 2 UNION ALL SELECT 'distinct_items', len(list_distinct(items))::INT, count(*) FROM lists GROUP BY 2",
        "chk_window_coverage": f"WITH {_FIRST}, s AS (SELECT unnest(list_concat(refs, targets)) AS item_id FROM firsts WHERE prefix_id IN (SELECT prefix_id FROM lists WHERE split_name = 'test')) SELECT item_id, count(*) AS n FROM s WHERE item_id NOT IN (SELECT item_id FROM cue_mappings WHERE cue_ids IS NOT NULL AND item_id IS NOT NULL) GROUP BY item_id",
        "chk_prepared_arrays": f"WITH {_SEQ}, w AS (SELECT target_mask = list_transform(range(0, 262), lambda i: i > 196 AND i < 261 AND (i - 1) % 13 <> 0) AS same FROM seqs), n AS (SELECT count(*) FILTER (WHERE NOT same) AS n FROM w) SELECT side, n FROM n CROSS JOIN (VALUES ('left'), ('right')) s(side) WHERE n > 0",
        "vec_intra": f"""WITH {_MAPPINGS}, v AS (SELECT cue_id, emb::DOUBLE[] AS v, sqrt(list_inner_product(emb::DOUBLE[], emb::DOUBLE[])) AS norm FROM cue_vocab WHERE cue_id > 0), s AS (SELECT DISTINCT item_id, unnest(cue_ids) AS cue_id FROM m), j AS (SELECT item_id, s.cue_id, v, norm FROM s JOIN v USING (cue_id) WHERE norm > 0)
SELECT a.item_id, any_value(n) AS n, round_even(avg(list_inner_product(a.v, b.v) / (a.norm * b.norm)), 5) AS intra_cosine FROM j a JOIN j b ON a.item_id = b.item_id AND a.cue_id < b.cue_id JOIN (SELECT item_id, count(*) AS n FROM j GROUP BY 1) k ON k.item_id = a.item_id GROUP BY a.item_id""",
    }
