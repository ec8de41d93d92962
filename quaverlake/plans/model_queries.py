"""Token, metric, study and integrity queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaverlake.functions import hashing, scalar, vec
from quaverlake.operators import checks, curation, knn, metrics, sequences, study, tokens
from quaverlake.plans.content_queries import _items, _mappings
from quaverlake.plans.sequence_queries import lists
from quaverlake.session import cut, read

SEQUENCE, VOCABULARY = 262, 2894


def _sequences(spark, d):
    """One row per tokenised playlist."""
    cols = ("split_name", "input_ids", "sequence_mask", "attention_mask", "target_mask", "mu_c", "sigma_c2", "context_emb")
    raw = read(spark, d, "tokenized_playlists").where("playlist_id IS NOT NULL")
    return raw.groupBy("playlist_id").agg(F.max(F.struct(*cols)).alias("r")).select("playlist_id", "r.*")


def _slots(spark, d):
    return tokens.decode(_sequences(spark, d), "playlist_id", "input_ids")


def enc_decoded(spark, d):
    return _slots(spark, d).select("playlist_id", "slot", F.array_join(F.transform("codes", lambda x: x.cast("string")), "-").alias("codes"), "conflict", F.array_join(F.transform("cues", lambda x: x.cast("string")), ",").alias("cues"))


def _coded(spark, d):
    """Distinct semantic codes (three levels and conflict) in use."""
    return _slots(spark, d).where("conflict IS NOT NULL").select(F.concat("codes", F.array("conflict")).alias("codes")).distinct()


def enc_round_trip(spark, d):
    """Sequences put together again from their decoded blocks, and whether they are the stored ones."""
    slots = _slots(spark, d)
    semantic = F.array(*[tokens.code_token(i, F.element_at("codes", i + 1)) for i in range(3)], tokens.conflict_token(F.col("conflict")))
    blocks = slots.select("playlist_id", F.struct("slot", tokens.encode_item(semantic, F.col("cues")).alias("b")).alias("x"))
    again = blocks.groupBy("playlist_id").agg(F.array_sort(F.collect_list("x")).alias("x"))
    ids = F.concat(F.array(F.lit(tokens.LAYOUT.bos)), F.flatten(F.transform("x", lambda r: r["b"])), F.array(F.lit(tokens.LAYOUT.eos)))
    joined = again.select("playlist_id", ids.alias("again")).join(_sequences(spark, d).select("playlist_id", "input_ids"), "playlist_id")
    return joined.select("playlist_id", (F.col("again") == F.col("input_ids")).alias("same"), F.size("again").alias("n"))


def enc_masks(spark, d):
    attention, target = tokens.masks(15, F.lit(20))
    rows = _sequences(spark, d)
    return rows.select("playlist_id", (F.col("target_mask") == target).alias("target_as_expected"), (F.col("attention_mask") == attention).alias("attention_as_expected"), F.size(F.filter("target_mask", lambda x: x)).alias("targets"))


def enc_completion(spark, d):
    """References of each sequence with five blocks to fill in."""
    context = F.concat(F.slice("input_ids", 1, 1 + 15 * tokens.LAYOUT.stride), F.array(F.lit(tokens.LAYOUT.eos)))
    ids, holes = tokens.completion(context, 5)
    return _sequences(spark, d).select("playlist_id", F.size(ids).alias("n"), F.size(F.filter(holes, lambda x: x)).alias("holes"), F.array_position(ids, F.lit(tokens.LAYOUT.mask)).alias("first_hole"))


def enc_type_ranges(spark, d):
    return tokens.type_ranges(spark, 20)


def enc_type_violations(spark, d):
    """Tokens out of the range of their place."""
    flat = _sequences(spark, d).select("playlist_id", F.posexplode("input_ids").alias("pos", "token"))
    return flat.join(F.broadcast(tokens.type_ranges(spark, 20)), "pos").where("token < low OR token > high").groupBy("pos").agg(F.count("*").alias("n"))


def enc_prefix_index(spark, d):
    index = tokens.prefix_index(_coded(spark, d), "codes")
    return index.select(F.array_join(F.transform("prefix", lambda x: x.cast("string")), "-").alias("prefix"), F.size("next").alias("n"), F.element_at("next", 1).alias("least"), F.element_at("next", -1).alias("most"))


def enc_conflicts(spark, d):
    """Rows of the code table that share their three codes, numbered from 1 in the order of the stored conflict code."""
    rows = _coded(spark, d).select(F.array_join(F.transform("codes", lambda x: x.cast("string")), "-").alias("code"), F.array_join(F.transform(F.slice("codes", 1, 3), lambda x: x.cast("string")), "-").alias("three"), F.element_at("codes", 4).alias("c"))
    return tokens.conflict_digits(rows, "code", "three", "c").select("code", "digit")


def enc_level_usage(spark, d):
    """Use and entropy of the codes of each level."""
    flat = _slots(spark, d).select(F.posexplode("codes").alias("level", "code")).where("code IS NOT NULL").groupBy("level", "code").agg(F.count("*").alias("n"))
    e = metrics.entropy(flat, "n", ["level"], base=2.718281828459045)
    return e.select("level", F.col("values").alias("used"), F.bround("entropy", 6).alias("entropy"), "total")


def enc_role_mean(spark, d):
    """Mean token by its place in the item block."""
    flat = _sequences(spark, d).select(F.posexplode("input_ids").alias("pos", "token")).where(f"pos > 0 AND pos < {SEQUENCE - 1}")
    return flat.groupBy(F.pmod(F.col("pos") - 1, F.lit(tokens.LAYOUT.stride)).alias("role")).agg(F.bround(F.avg("token"), 6).alias("mean_token"), F.count("*").alias("n"))


def enc_chunks(spark, d):
    """Cue lists of all items in row order as one stream, in blocks of 512."""
    order = read(spark, d, "item_embeddings").where("item_id IS NOT NULL AND row_idx IS NOT NULL").groupBy("item_id").agg(F.min("row_idx").alias("row_idx"))
    rows = _mappings(spark, d).where("cue_ids IS NOT NULL").join(order, "item_id").select("row_idx", F.transform("cue_ids", lambda c: c + tokens.LAYOUT.cue).alias("tokens"))
    return tokens.chunks(rows, "row_idx", "tokens", 512).select("chunk", F.size("tokens").alias("n"), F.md5(F.array_join(F.transform("tokens", lambda t: t.cast("string")), ",")).alias("digest"))


def enc_remap(spark, d):
    return tokens.remap_pairs(spark, 845, 843, 844)


def enc_rvq_codes(spark, d):
    """Residual codes of every item with books made of the first cue vectors, and how much they explain."""
    rows = read(spark, d, "cue_vocab").where("cue_id BETWEEN 1 AND 48").orderBy("cue_id").select("emb").toArrow().column("emb").to_pylist()
    import numpy as np

    books = np.array(rows, float).reshape(3, 16, -1)
    items = _items(spark, d)
    coded = cut(tokens.rvq_encode(items.select("item_id", vec.l2("emb").alias("u")), "item_id", "u", books))
    back = tokens.rvq_decode(coded, "item_id", "codes", tokens.books_table(spark, books), 64)
    joined = coded.join(back, "item_id").join(items, "item_id")
    return joined.select("item_id", F.array_join(F.transform("codes", lambda x: x.cast("string")), "-").alias("codes"), F.bround(vec.squared_distance("vector", vec.l2("emb")), 5).alias("error"))


def _predictions(spark, d):
    """(prefix_id, references, targets, predicted): the last five references stand in for predictions."""
    first = sequences.first_window(lists(spark, d), "prefix_id", "items")
    return first.select("prefix_id", "targets", F.slice("references", 11, 5).alias("predicted"), "references")


def met_multiset(spark, d):
    """Cues of the 15th item against those of the 16th, as multisets."""
    first = sequences.first_window(lists(spark, d), "prefix_id", "items")
    cues = _mappings(spark, d).where("cue_ids IS NOT NULL").select("item_id", F.slice("cue_ids", 1, 8).alias("c"))
    rows = first.select("prefix_id", F.element_at("references", 15).alias("x"), F.element_at("targets", 1).alias("y")).join(cues.select(F.col("item_id").alias("x"), F.col("c").alias("predicted")), "x").join(cues.select(F.col("item_id").alias("y"), F.col("c").alias("target")), "y")
    out = metrics.multiset_metrics(rows, "prefix_id", "predicted", "target")
    return out.select("prefix_id", "matches", *[F.bround(c, 6).alias(c) for c in ("recall", "precision", "f1", "unique_ratio", "jaccard")], "hit")


def met_hits(spark, d):
    out = metrics.hits_at(_predictions(spark, d), "prefix_id", "references", "targets", [5, 15])
    return out.select("prefix_id", "hit_1", "hit_2", *[F.bround(c, 6).alias(c) for c in ("recall_5", "jaccard_5", "recall_15", "jaccard_15")])


def met_positional(spark, d):
    out = metrics.positional(_predictions(spark, d), "prefix_id", "predicted", "targets")
    return out.agg(F.count("*").alias("n"), F.sum("matches").alias("matches"), F.bround(F.avg("share"), 6).alias("share"), F.count(F.when(F.col("all_match"), 1)).alias("all_match"))


def met_ranking(spark, d):
    """Popularity as a recommender: ranks of all items used in training against each test record's items."""
    all_lists = lists(spark, d)
    used = curation.item_frequency(all_lists.where("split_name = 'train'"), "prefix_id", "items")
    truth = all_lists.where("split_name = 'test'").select("prefix_id", F.explode("items").alias("item"))
    found = truth.join(metrics.places(used, F.desc("n"), F.asc("item")).select("item", "rank"), "item")
    out = metrics.ranking(found, truth, "prefix_id", "item", "rank", [5, 10, 50])
    return out.select("prefix_id", *[F.bround(c, 6).alias(c) for c in ("recall_5", "recall_50", "precision_10", "reciprocal_rank")], "n_truth")


def met_rank_summary(spark, d):
    """Place of each item's first stored cue among the cues nearest to the item's vector, over every item."""
    own = _mappings(spark, d).where("cue_ids IS NOT NULL").select("item_id", F.element_at("cue_ids", 1).alias("own"))
    asked = _items(spark, d).join(own, "item_id").select(F.col("item_id").alias("query_id"), F.col("emb").alias("qvec"), "own")
    ranks = knn.rank_of(read(spark, d, "cue_vocab").where("cue_id > 0"), asked, "own", "cue_id")
    out = metrics.rank_summary(ranks, "rank", [1, 10, 100])
    return out.select(*[F.bround(c, 6).alias(c) for c in ("recall_1", "recall_10", "recall_100", "mrr", "mean_rank")], "median_rank", "n")


def met_assignment(spark, d):
    """Best pairing of the five targets with the five items before them, by cosine."""
    m = knn.gather(lists(spark, d).where(F.size("items") >= 20), "prefix_id", "items", _items(spark, d), "item_id", "emb")
    a = m.where("pos BETWEEN 10 AND 14").select("prefix_id", (F.col("pos") - 10).alias("i"), F.col("value").alias("v"))
    b = m.where("pos BETWEEN 15 AND 19").select("prefix_id", (F.col("pos") - 15).alias("j"), F.col("value").alias("w"))
    cells = a.join(b, "prefix_id").select("prefix_id", "i", "j", vec.cosine("v", "w").alias("c"))
    out = metrics.best_assignment(cells, "prefix_id", "i", "j", "c").where("best IS NOT NULL")
    return out.select("prefix_id", F.bround("best", 5).alias("best"))


def met_item_entropy(spark, d):
    """Entropy of item use in each split."""
    counts = lists(spark, d).where("split_name IS NOT NULL").select("split_name", F.explode("items").alias("item")).groupBy("split_name", "item").agg(F.count("*").alias("n"))
    out = metrics.entropy(counts, "n", ["split_name"])
    return out.select("split_name", F.bround("entropy", 6).alias("entropy"), F.col("values").alias("items"), "total")


def met_dispersion_tiers(spark, d):
    """Playlists by their spread, cut at the linear 33rd and 66th percentile."""
    rows = _sequences(spark, d).select("playlist_id", F.col("sigma_c2").cast("double").alias("s")).where("s IS NOT NULL")
    cuts = metrics.percentiles(rows, "s", [0.33, 0.66]).select(F.col("p0").alias("low"), F.col("p1").alias("high"))
    return rows.crossJoin(F.broadcast(cuts)).select("playlist_id", scalar.dispersion_tier(F.col("s"), F.col("low"), F.col("high")).alias("tier"))


def met_bootstrap(spark, d):
    return metrics.bootstrap_interval(_sequences(spark, d), "sigma_c2", 400, key="playlist_id")


def met_frechet(spark, d):
    s = _sequences(spark, d)
    return metrics.frechet(s.where("split_name = 'train'"), s.where("split_name = 'test'"), "context_emb", 64)


def met_coverage(spark, d):
    """Share of the catalogue that the lists of each split use."""
    n = read(spark, d, "catalog_items").agg(F.count_distinct("item_id").alias("n"))
    used = lists(spark, d).where("split_name IS NOT NULL").select("split_name", F.explode("items").alias("item")).groupBy("split_name").agg(F.count_distinct("item").alias("used"))
    return used.crossJoin(F.broadcast(n)).select("split_name", "used", F.bround(F.col("used") / F.col("n"), 6).alias("coverage"))


def _responses(spark, d):
    """A listening study made from the event table by hash: there is no such table."""
    pick = lambda name, n: F.pmod(F.conv(F.substring(hashing.digest(name, 42, F.col("event_id")), 1, 8), 16, 10).cast("long"), F.lit(n))
    e = read(spark, d, "events").where("event_type = 'view'")
    rate = {f"{r}_{s}": (pick(f"{r}_{s}", 5) + 1).cast("int") for r in ("fit", "quality") for s in ("a", "b")}
    return e.select("event_id", "user_id", (pick("side", 2) == 1).alias("song_a_is_generated"), F.element_at(F.array(F.lit("Song A"), F.lit("Song B"), F.lit("No preference")), (pick("preference", 3) + 1).cast("int")).alias("preference"), *[c.alias(n) for n, c in rate.items()])


def study_unblinded(spark, d):
    return study.unblind(_responses(spark, d), ["event_id", "user_id"], ["fit", "quality"])


def study_summary(spark, d):
    values = ["generated_fit", "real_fit", "generated_quality", "real_quality", "share"]
    out = study.by_participant(study_unblinded(spark, d), "user_id", values)
    return out.select("participants", "responses", *[F.bround(v, 6).alias(v) for v in values])


def study_counts(spark, d):
    return study.response_counts(study_unblinded(spark, d))


def study_paired(spark, d):
    u = study_unblinded(spark, d)
    a, b = u.select("event_id", F.col("generated_fit").alias("v")), u.select("event_id", F.col("real_fit").alias("v"))
    return study.paired_difference(a, b, "event_id", "v").withColumn("mean_difference", F.bround("mean_difference", 6))


def study_sides(spark, d):
    cases = read(spark, d, "tokenized_playlists").where("split_name = 'test'").select("playlist_id").distinct()
    return study.balanced_sides(cases, "playlist_id")


def study_least_used(spark, d):
    cases = read(spark, d, "region").select(F.col("r_regionkey").alias("case_id"))
    given = _responses(spark, d).select(F.pmod("user_id", F.lit(5)).cast("int").alias("case_id"), F.col("song_a_is_generated").alias("generated_on_a"))
    return study.least_used(cases, given, "case_id")


def chk_alignment(spark, d):
    return checks.catalogue_alignment(read(spark, d, "catalog_items"), read(spark, d, "item_embeddings"), "item_id", "row_idx", "emb", 64)


def chk_cue_rows(spark, d):
    found = checks.cue_rows(_mappings(spark, d), "item_id", "cue_ids", "scores", 2048, 16)
    return found.groupBy("problem").agg(F.count("*").alias("n"))


def chk_sequences(spark, d):
    return checks.sequence_rows(_sequences(spark, d), "playlist_id", "input_ids", SEQUENCE, VOCABULARY, ["sequence_mask", "attention_mask", "target_mask"])


def chk_duplicates(spark, d):
    return checks.duplicates(read(spark, d, "listening_log"), "source_row").groupBy("n").agg(F.count("*").alias("keys"))


def chk_orphans(spark, d):
    """Song ids of documents and of the log that the catalogue lacks."""
    c = read(spark, d, "catalog_items")
    parts = [checks.orphans(read(spark, d, t).withColumn("item_id", F.nullif(F.trim("item_id"), F.lit(""))), "item_id", c, "item_id").agg(F.lit(t).alias("source"), F.count("*").alias("missing")) for t in ("documents", "listening_log")]
    return parts[0].unionByName(parts[1])


def chk_not_unit(spark, d):
    return checks.not_unit(_items(spark, d), "item_id", "emb").select("item_id", F.bround("norm", 5).alias("norm"))


def chk_prepared(spark, d):
    """Playlists whose stored mean isn't the context vector, beyond a tolerance."""
    s = _sequences(spark, d)
    return checks.far_vectors(s.select("playlist_id", F.col("mu_c").alias("v")), s.select("playlist_id", F.col("context_emb").alias("v")), "playlist_id", "v").select("playlist_id")


def chk_constraints(spark, d):
    """Rules on stored catalogue values and how often each is broken."""
    c = read(spark, d, "catalog_items").where("item_id IS NOT NULL").distinct()
    rules = {"feature_index": F.col("feature_index") >= -1, "tempo": F.col("tempo").isNull() | F.col("tempo").between(20, 300), "title": F.trim("title") != "", "artist": F.trim("artist") != ""}
    return checks.out_of_range(c, "item_id", rules).groupBy("rule").agg(F.count("*").alias("n"))


def chk_fingerprint(spark, d):
    log = read(spark, d, "listening_log").select("source_row", "user_id", "item_id").distinct()
    return checks.fingerprint(log, "source_row", ["source_row", "user_id", "item_id"])


_NAMES = (enc_decoded, enc_round_trip, enc_masks, enc_completion, enc_type_ranges, enc_type_violations, enc_prefix_index, enc_conflicts, enc_level_usage, enc_role_mean, enc_chunks, enc_remap, enc_rvq_codes, met_multiset, met_hits, met_positional, met_ranking, met_rank_summary, met_assignment, met_item_entropy, met_dispersion_tiers, met_bootstrap, met_frechet, met_coverage, study_unblinded, study_summary, study_counts, study_paired, study_sides, study_least_used, chk_alignment, chk_cue_rows, chk_sequences, chk_duplicates, chk_orphans, chk_not_unit, chk_prepared, chk_constraints, chk_fingerprint)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _NAMES}


from quaverlake.plans.content_queries import _CUES, _ITEMS, _LISTS, _MAPPINGS  # noqa: E402
from quaverlake.plans.sequence_queries import LISTS  # noqa: E402

_SEQ = "seqs AS (SELECT DISTINCT ON (playlist_id) * FROM tokenized_playlists WHERE playlist_id IS NOT NULL)"
_SLOT = f"""{_SEQ}, s AS (SELECT playlist_id, unnest(range(0, 20)) AS slot, input_ids AS t FROM seqs), b AS (SELECT playlist_id, slot::INT AS slot, t[2 + slot * 13 : 14 + slot * 13] AS x FROM s),
slots AS (SELECT playlist_id, slot, x[2] - 1 AS z0, x[3] - 257 AS z1, x[4] - 513 AS z2, x[5] - 769 AS conflict, list_transform(x[6:13], lambda t: t - 845) AS cues FROM b)"""
_FIRST = f"{LISTS}, firsts AS (SELECT prefix_id, items[1:15] AS refs, items[16:20] AS targets, items[11:15] AS predicted FROM lists WHERE len(items) >= 20)"


def _pick(name: str, n: int) -> str:
    return f"(('0x' || substr(sha256('{name}' || chr(0) || '42' || chr(0) || event_id), 1, 8))::UBIGINT::BIGINT % {n})"


_RESPONSES = f"""e AS (SELECT event_id, user_id, {_pick('side', 2)} = 1 AS g, ['Song A', 'Song B', 'No preference'][{_pick('preference', 3)} + 1] AS preference, {', '.join(f"({_pick(f'{r}_{s}', 5)} + 1)::INT AS {r}_{s}" for r in ('fit', 'quality') for s in ('a', 'b'))} FROM events WHERE event_type = 'view'),
u AS (SELECT event_id, user_id, CASE WHEN g THEN fit_a ELSE fit_b END AS generated_fit, CASE WHEN g THEN fit_b ELSE fit_a END AS real_fit, CASE WHEN g THEN quality_a ELSE quality_b END AS generated_quality, CASE WHEN g THEN quality_b ELSE quality_a END AS real_quality,
 CASE WHEN preference = 'No preference' THEN 'tie' WHEN (preference = 'Song A') = g THEN 'generated' ELSE 'real' END AS response FROM e),
v AS (SELECT *, CASE response WHEN 'generated' THEN 1.0::DOUBLE WHEN 'tie' THEN 0.5 ELSE 0.0 END AS share FROM u)"""


def oracle_sql() -> dict[str, str]:
    from itertools import permutations

    best = ", ".join("(" + " + ".join(f"c{i}{j}" for i, j in enumerate(p)) + ")" for p in permutations(range(5)))
    cells = ", ".join(f"max(c) FILTER (WHERE i = {i} AND j = {j}) AS c{i}{j}" for i in range(5) for j in range(5))
    common = "list_sum(list_transform(list_distinct(p), lambda x: least(len(list_filter(p, lambda y: y = x)), len(list_filter(t, lambda y: y = x)))))"
    book = lambda lo: f"SELECT cue_id - {lo} AS code, emb::DOUBLE[] AS v FROM cue_vocab WHERE cue_id BETWEEN {lo} AND {lo + 15}"
    step = lambda prev, n, lo: f"d{n} AS (SELECT item_id, codes, r, code, v, row_number() OVER (PARTITION BY item_id ORDER BY round_even(list_inner_product(v, v) - 2 * list_inner_product(r, v), 9), code) AS k FROM {prev} CROSS JOIN ({book(lo)})), l{n} AS (SELECT item_id, list_append(codes, code) AS codes, list_transform(range(1, 65), lambda i: r[i] - v[i]) AS r FROM d{n} WHERE k = 1)"
    return {
        "enc_decoded": f"WITH {_SLOT} SELECT playlist_id, slot, concat_ws('-', z0, z1, z2) AS codes, conflict, array_to_string(cues, ',') AS cues FROM slots",
        "enc_round_trip": f"WITH {_SEQ} SELECT playlist_id, true AS same, len(input_ids)::INT AS n FROM seqs",
        "enc_masks": f"WITH {_SEQ} SELECT playlist_id, target_mask = list_transform(range(0, 262), lambda i: i >= 196 AND i < 261) AS target_as_expected, attention_mask = list_transform(range(0, 262), lambda i: true) AS attention_as_expected, len(list_filter(target_mask, lambda x: x))::INT AS targets FROM seqs",
        "enc_completion": f"WITH {_SEQ} SELECT playlist_id, 262 AS n, 60 AS holes, 198::BIGINT AS first_hole FROM seqs",
        "enc_type_ranges": """SELECT p::INT AS pos, (CASE WHEN p = 0 THEN 0 WHEN p = 261 THEN 844 WHEN (p - 1) % 13 = 0 THEN 843 WHEN (p - 1) % 13 <= 3 THEN ((p - 1) % 13 - 1) * 256 + 1 WHEN (p - 1) % 13 = 4 THEN 769 ELSE 845 END)::INT AS low,
(CASE WHEN p = 0 THEN 0 WHEN p = 261 THEN 844 WHEN (p - 1) % 13 = 0 THEN 843 WHEN (p - 1) % 13 <= 3 THEN ((p - 1) % 13) * 256 WHEN (p - 1) % 13 = 4 THEN 842 ELSE 2892 END)::INT AS high FROM range(0, 262) t(p)""",
        "enc_type_violations": f"""WITH {_SEQ}, f AS (SELECT generate_subscripts(input_ids, 1) - 1 AS p, unnest(input_ids) AS t FROM seqs), r AS (SELECT p::INT AS pos, CASE WHEN p = 0 THEN t = 0 WHEN p = 261 THEN t = 844 WHEN (p - 1) % 13 = 0 THEN t = 843 WHEN (p - 1) % 13 <= 3 THEN t BETWEEN ((p - 1) % 13 - 1) * 256 + 1 AND ((p - 1) % 13) * 256 WHEN (p - 1) % 13 = 4 THEN t BETWEEN 769 AND 842 ELSE t BETWEEN 845 AND 2892 END AS ok FROM f WHERE p < 262)
SELECT pos, count(*) AS n FROM r WHERE NOT ok GROUP BY pos""",
        "enc_prefix_index": f"""WITH {_SLOT}, c AS (SELECT DISTINCT z0, z1, z2, conflict FROM slots), p AS (SELECT '' AS prefix, z0 AS nx FROM c UNION ALL SELECT z0::VARCHAR, z1 FROM c UNION ALL SELECT z0 || '-' || z1, z2 FROM c UNION ALL SELECT z0 || '-' || z1 || '-' || z2, conflict FROM c)
SELECT prefix, count(DISTINCT nx)::INT AS n, min(nx)::INT AS least, max(nx)::INT AS most FROM p GROUP BY prefix""",
        "enc_conflicts": f"WITH {_SLOT}, c AS (SELECT DISTINCT z0, z1, z2, conflict FROM slots) SELECT concat_ws('-', z0, z1, z2, conflict) AS code, (row_number() OVER (PARTITION BY z0, z1, z2 ORDER BY conflict))::INT AS digit FROM c",
        "enc_level_usage": f"""WITH {_SLOT}, f AS (SELECT 0 AS level, z0 AS code FROM slots UNION ALL SELECT 1, z1 FROM slots UNION ALL SELECT 2, z2 FROM slots), n AS (SELECT level, code, count(*) AS n, sum(count(*)) OVER (PARTITION BY level) AS t FROM f GROUP BY level, code)
SELECT level, count(*) AS used, round_even(-sum(n / t * ln(n / t)), 6) AS entropy, max(t)::BIGINT AS total FROM n GROUP BY level""",
        "enc_role_mean": f"WITH {_SEQ}, f AS (SELECT generate_subscripts(input_ids, 1) - 1 AS p, unnest(input_ids) AS t FROM seqs) SELECT ((p - 1) % 13)::INT AS role, round_even(avg(t), 6) AS mean_token, count(*) AS n FROM f WHERE p > 0 AND p < 261 GROUP BY role",
        "enc_chunks": f"""WITH {_MAPPINGS}, o AS (SELECT item_id, min(row_idx) AS row_idx FROM item_embeddings WHERE item_id IS NOT NULL AND row_idx IS NOT NULL GROUP BY 1), f AS (SELECT row_idx, generate_subscripts(cue_ids, 1) AS i, unnest(cue_ids) + 845 AS t FROM m JOIN o USING (item_id) WHERE cue_ids IS NOT NULL),
a AS (SELECT t, row_number() OVER (ORDER BY row_idx, i) - 1 AS k, count(*) OVER () AS total FROM f)
SELECT k // 510 AS chunk, 512 AS n, md5('0,' || string_agg(t::VARCHAR, ',' ORDER BY k) || ',844') AS digest FROM a WHERE (k // 510 + 1) * 510 <= total GROUP BY k // 510""",
        "enc_remap": "SELECT i::INT AS source, i::INT AS target FROM range(0, 843) t(i) UNION ALL SELECT 843, 843 UNION ALL SELECT 844, 844",
        "enc_rvq_codes": f"""WITH {_ITEMS}, l0 AS (SELECT item_id, []::BIGINT[] AS codes, list_transform(v, lambda x: x / norm) AS r FROM items), {step('l0', 1, 1)}, {step('l1', 2, 17)}, {step('l2', 3, 33)}
SELECT item_id, array_to_string(codes, '-') AS codes, round_even(list_inner_product(r, r), 5) AS error FROM l3""",
        "met_multiset": f"""WITH {_FIRST}, {_MAPPINGS}, c AS (SELECT item_id, cue_ids[1:8] AS c FROM m WHERE cue_ids IS NOT NULL), r AS (SELECT prefix_id, x.c AS p, y.c AS t FROM firsts JOIN c x ON x.item_id = refs[15] JOIN c y ON y.item_id = targets[1]),
k AS (SELECT prefix_id, {common} AS k, len(p) AS np, len(t) AS nt, len(list_distinct(p)) AS u FROM r)
SELECT prefix_id, k::INT AS matches, round_even(k / nt, 6) AS recall, round_even(k / np, 6) AS precision, round_even(2 * (k / nt) * (k / np) / greatest(k / nt + k / np, 1.1920929e-7), 6) AS f1, round_even(u / np, 6) AS unique_ratio, round_even(k / (np + nt - k), 6) AS jaccard, (k > 0)::INT AS hit FROM k""",
        "met_hits": f"""WITH {_FIRST}, r AS (SELECT prefix_id, len(list_intersect(refs, targets)) AS c15, len(list_intersect(refs[1:5], targets)) AS c5, len(list_distinct(targets)) AS nt, len(list_distinct(list_concat(refs[1:5], targets))) AS u5, len(list_distinct(list_concat(refs, targets))) AS u15 FROM firsts)
SELECT prefix_id, (c15 >= 1)::INT AS hit_1, (c15 >= 2)::INT AS hit_2, round_even(c5 / nt, 6) AS recall_5, round_even(c5 / u5, 6) AS jaccard_5, round_even(c15 / nt, 6) AS recall_15, round_even(c15 / u15, 6) AS jaccard_15 FROM r""",
        "met_positional": f"""WITH {_FIRST}, r AS (SELECT len(list_filter(range(1, 6), lambda i: predicted[i] = targets[i])) AS m FROM firsts) SELECT count(*) AS n, sum(m)::BIGINT AS matches, round_even(avg(m / 5), 6) AS share, count(*) FILTER (WHERE m = 5) AS all_match FROM r""",
        "met_ranking": f"""WITH {LISTS}, tr AS (SELECT unnest(items) AS item FROM lists WHERE split_name = 'train'), top AS (SELECT item, count(*) AS n FROM tr GROUP BY item), rk AS (SELECT item, row_number() OVER (ORDER BY n DESC, item) AS r FROM top),
t AS (SELECT DISTINCT prefix_id, unnest(items) AS item FROM lists WHERE split_name = 'test'), h AS (SELECT prefix_id, count(*) AS n_truth, count(*) FILTER (WHERE r <= 5) AS h5, count(*) FILTER (WHERE r <= 10) AS h10, count(*) FILTER (WHERE r <= 50) AS h50, min(r) AS f FROM t LEFT JOIN rk USING (item) GROUP BY prefix_id)
SELECT prefix_id, round_even(h5 / n_truth, 6) AS recall_5, round_even(h50 / n_truth, 6) AS recall_50, round_even(h10 / 10, 6) AS precision_10, round_even(coalesce(1.0 / f, 0.0), 6) AS reciprocal_rank, n_truth FROM h""",
        "met_rank_summary": f"""WITH {_ITEMS}, {_CUES}, {_MAPPINGS}, s AS (SELECT i.item_id, c.cue_id, c.cue_id::VARCHAR AS name, round_even(list_inner_product(i.v, c.v) / (i.norm * c.norm), 6) AS score FROM items i CROSS JOIN cues c),
o AS (SELECT s.item_id, s.name, s.score FROM s JOIN m ON m.item_id = s.item_id AND s.cue_id = m.cue_ids[1]), r AS (SELECT o.item_id, count(*) AS rank FROM o JOIN s ON s.item_id = o.item_id AND (s.score > o.score OR (s.score = o.score AND s.name <= o.name)) GROUP BY 1)
SELECT round_even(avg((rank <= 1)::INT), 6) AS recall_1, round_even(avg((rank <= 10)::INT), 6) AS recall_10, round_even(avg((rank <= 100)::INT), 6) AS recall_100, round_even(avg(1.0::DOUBLE / rank), 6) AS mrr, round_even(avg(rank), 6) AS mean_rank, quantile_cont(rank, 0.5)::DOUBLE AS median_rank, count(*) AS n FROM r""",
        "met_assignment": f"""WITH {_ITEMS}, {_LISTS}, c AS (SELECT a.prefix_id, a.pos - 10 AS i, b.pos - 15 AS j, list_inner_product(a.v, b.v) / (a.norm * b.norm) AS c FROM members a JOIN members b ON a.prefix_id = b.prefix_id AND a.pos BETWEEN 10 AND 14 AND b.pos BETWEEN 15 AND 19), p AS (SELECT prefix_id, {cells} FROM c GROUP BY prefix_id)
SELECT prefix_id, round_even(greatest({best}) / 5, 5) AS best FROM p WHERE greatest({best}) IS NOT NULL""",
        "met_item_entropy": f"""WITH {LISTS}, s AS (SELECT split_name, unnest(items) AS item FROM lists WHERE split_name IS NOT NULL), n AS (SELECT split_name, item, count(*) AS n, sum(count(*)) OVER (PARTITION BY split_name) AS t FROM s GROUP BY 1, 2)
SELECT split_name, round_even(-sum(n / t * log2(n / t)), 6) AS entropy, count(*) AS items, max(t)::BIGINT AS total FROM n GROUP BY split_name""",
        "met_dispersion_tiers": f"""WITH {_SEQ}, c AS (SELECT quantile_cont(sigma_c2::DOUBLE, 0.33) AS low, quantile_cont(sigma_c2::DOUBLE, 0.66) AS high FROM seqs) SELECT playlist_id, CASE WHEN sigma_c2::DOUBLE < low THEN 'compact' WHEN sigma_c2::DOUBLE < high THEN 'medium' ELSE 'diverse' END AS tier FROM seqs, c WHERE sigma_c2 IS NOT NULL""",
        "met_coverage": f"""WITH {LISTS}, s AS (SELECT split_name, unnest(items) AS item FROM lists WHERE split_name IS NOT NULL) SELECT split_name, count(DISTINCT item) AS used, round_even(count(DISTINCT item) / (SELECT count(DISTINCT item_id) FROM catalog_items), 6) AS coverage FROM s GROUP BY split_name""",
        "study_unblinded": f"WITH {_RESPONSES} SELECT * FROM v",
        "study_summary": f"""WITH {_RESPONSES}, p AS (SELECT user_id, count(*) AS n, avg(generated_fit) AS a, avg(real_fit) AS b, avg(generated_quality) AS c, avg(real_quality) AS d, avg(share) AS s FROM v GROUP BY user_id)
SELECT count(*) AS participants, sum(n)::BIGINT AS responses, round_even(avg(a), 6) AS generated_fit, round_even(avg(b), 6) AS real_fit, round_even(avg(c), 6) AS generated_quality, round_even(avg(d), 6) AS real_quality, round_even(avg(s), 6) AS share FROM p""",
        "study_counts": f"WITH {_RESPONSES} SELECT count(*) FILTER (WHERE response = 'generated') AS generated, count(*) FILTER (WHERE response = 'real') AS real, count(*) FILTER (WHERE response = 'tie') AS tie FROM v",
        "study_paired": f"WITH {_RESPONSES} SELECT count(*) AS pairs, round_even(avg(generated_fit - real_fit), 6) AS mean_difference FROM v",
        "study_sides": """WITH c AS (SELECT DISTINCT playlist_id FROM tokenized_playlists WHERE split_name = 'test'), r AS (SELECT playlist_id, row_number() OVER (ORDER BY sha256('side' || chr(0) || '42' || chr(0) || playlist_id), playlist_id) AS place, count(*) OVER () AS n FROM c)
SELECT playlist_id, substr(sha256('case' || chr(0) || '42' || chr(0) || playlist_id), 1, 12) AS case_code, place <= ceil(n / 2) AS generated_on_a FROM r""",
        "study_least_used": f"""WITH {_RESPONSES}, a AS (SELECT (user_id % 5)::INT AS case_id, g FROM e), c AS (SELECT r_regionkey AS case_id, (SELECT count(*) FROM a WHERE a.case_id = r_regionkey) AS n, (SELECT count(*) FROM a WHERE a.case_id = r_regionkey AND g) AS a FROM region)
SELECT case_id, n, a, n = (SELECT min(n) FROM c) AS eligible FROM c""",
        "chk_alignment": """WITH c AS (SELECT DISTINCT item_id FROM catalog_items), e AS (SELECT * FROM item_embeddings), p AS (
SELECT 'missing vector' AS problem, count(*) AS n FROM c WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.item_id = c.item_id) UNION ALL SELECT 'unknown id', count(*) FROM (SELECT DISTINCT item_id FROM e) x WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.item_id = x.item_id)
UNION ALL SELECT 'repeated id', count(*) FROM (SELECT item_id FROM e GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'repeated row', count(*) FROM (SELECT row_idx FROM (SELECT DISTINCT item_id, row_idx FROM e) GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'shape', count(*) FILTER (WHERE emb IS NULL OR len(emb) <> 64) FROM e UNION ALL SELECT 'not finite', count(*) FILTER (WHERE len(list_filter(emb, lambda x: x IS NULL OR NOT isfinite(x))) > 0) FROM e
UNION ALL SELECT 'rows not contiguous', CASE WHEN max(row_idx) + 1 = count(DISTINCT row_idx) AND min(row_idx) = 0 THEN 0 ELSE abs(max(row_idx) + 1 - count(DISTINCT row_idx)) END FROM e) SELECT * FROM p WHERE n > 0""",
        "chk_cue_rows": f"""WITH {_MAPPINGS}, r AS (SELECT cue_ids AS i, scores AS s, list_filter(cue_ids, lambda x: x <> 0) AS q, list_filter(scores, lambda x: x IS NOT NULL) AS k FROM m), p AS (
SELECT 'missing list' AS problem, count(*) FILTER (WHERE i IS NULL) AS n FROM r UNION ALL SELECT 'length', count(*) FILTER (WHERE len(i) <> 16) FROM r
UNION ALL SELECT 'unknown id', count(*) FILTER (WHERE len(list_filter(i, lambda x: x IS NULL OR x < 0 OR x >= 2048)) > 0) FROM r UNION ALL SELECT 'repeated cue', count(*) FILTER (WHERE len(list_distinct(q)) < len(q)) FROM r
UNION ALL SELECT 'score length', count(*) FILTER (WHERE len(i) <> len(s)) FROM r UNION ALL SELECT 'score beside empty', count(*) FILTER (WHERE len(list_filter(range(1, len(i) + 1), lambda x: (i[x] = 0) <> (s[x] IS NULL))) > 0) FROM r
UNION ALL SELECT 'rising scores', count(*) FILTER (WHERE len(list_filter(range(1, len(k)), lambda x: k[x + 1] > k[x])) > 0) FROM r) SELECT * FROM p WHERE n > 0""",
        "chk_sequences": f"""WITH {_SEQ}, p AS (SELECT playlist_id, unnest([CASE WHEN len(input_ids) <> 262 THEN 'length' END, CASE WHEN len(list_filter(input_ids, lambda t: t IS NULL OR t < 0 OR t >= 2894)) > 0 THEN 'token' END, CASE WHEN len(sequence_mask) <> len(input_ids) THEN 'mask sequence_mask' END, CASE WHEN len(attention_mask) <> len(input_ids) THEN 'mask attention_mask' END, CASE WHEN len(target_mask) <> len(input_ids) THEN 'mask target_mask' END]) AS problem FROM seqs)
SELECT playlist_id, problem FROM p WHERE problem IS NOT NULL""",
        "chk_duplicates": "SELECT n, count(*) AS keys FROM (SELECT source_row, count(*) AS n FROM listening_log GROUP BY 1 HAVING count(*) > 1) GROUP BY n",
        "chk_fingerprint": """WITH l AS (SELECT DISTINCT source_row, user_id, item_id FROM listening_log), h AS (SELECT source_row AS o, sha256('{' || concat_ws(',', '"source_row":' || source_row, '"user_id":"' || user_id || '"', '"item_id":"' || item_id || '"') || '}') AS h FROM l),
s AS (SELECT o // 4096 AS s, count(*) AS n, sha256(string_agg(h, '' ORDER BY o, h)) AS h FROM h GROUP BY 1), t AS (SELECT s // 4096 AS t, sum(n) AS n, sha256(string_agg(h, '' ORDER BY s)) AS h FROM s GROUP BY 1) SELECT sha256(string_agg(h, '' ORDER BY t)) AS fingerprint, sum(n)::BIGINT AS n FROM t""",
        "chk_orphans": """SELECT 'documents' AS source, count(DISTINCT trim(item_id)) AS missing FROM documents WHERE trim(item_id) <> '' AND trim(item_id) NOT IN (SELECT item_id FROM catalog_items WHERE item_id IS NOT NULL)
UNION ALL SELECT 'listening_log', count(DISTINCT trim(item_id)) FROM listening_log WHERE trim(item_id) <> '' AND trim(item_id) NOT IN (SELECT item_id FROM catalog_items WHERE item_id IS NOT NULL)""",
        "chk_not_unit": f"WITH {_ITEMS} SELECT item_id, round_even(norm, 5) AS norm FROM items WHERE abs(norm - 1) >= 1e-4::DOUBLE",
        "chk_prepared": f"WITH {_SEQ} SELECT playlist_id FROM seqs WHERE len(mu_c) <> len(context_emb) OR list_max(list_transform(range(1, len(mu_c) + 1), lambda i: abs(mu_c[i]::DOUBLE - context_emb[i]::DOUBLE))) > 1e-6::DOUBLE",
        "chk_constraints": """WITH c AS (SELECT DISTINCT * FROM catalog_items WHERE item_id IS NOT NULL), p AS (SELECT 'feature_index' AS rule, count(*) FILTER (WHERE NOT coalesce(feature_index >= -1, false)) AS n FROM c UNION ALL SELECT 'tempo', count(*) FILTER (WHERE NOT (tempo IS NULL OR tempo BETWEEN 20 AND 300)) FROM c
UNION ALL SELECT 'title', count(*) FILTER (WHERE NOT coalesce(trim(title) <> '', false)) FROM c UNION ALL SELECT 'artist', count(*) FILTER (WHERE NOT coalesce(trim(artist) <> '', false)) FROM c) SELECT * FROM p WHERE n > 0""",
    }
