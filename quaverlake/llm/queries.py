"""The queries of this subpackage over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaverlake.llm.cooccurrence import cooccurring_pairs
from quaverlake.llm.encoding import encode_corpus
from quaverlake.llm.entities import entity_classes, same_entities
from quaverlake.llm.mixing import mix_by_temperature, mix_report, mix_sources
from quaverlake.llm.overlap import overlap_report, overlapping_records, split_overlaps
from quaverlake.llm.subjects import subject_areas
from quaverlake.llm.term_counts import term_frequencies
from quaverlake.llm.vectors import most_similar
from quaverlake.session import read


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return cooccurring_pairs(read(spark, d, "context_prefixes"), min_pair=8, min_lift=5).select("item_a", "item_b")


def p1_pairs(spark: SparkSession, d: str) -> DataFrame:
    out = cooccurring_pairs(read(spark, d, "context_prefixes"), min_pair=8)
    return out.withColumn("lift", F.bround("lift", 4))


def _cues(spark: SparkSession, d: str) -> DataFrame:
    cues = F.filter("cue_ids", lambda x: x.isNotNull() & (x != 0))
    return term_frequencies(read(spark, d, "cue_mappings"), "item_id", cues, min_records=5, max_share=0.3).withColumn("cue_id", F.col("term").cast("int"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _cues(spark, d).where("band <> 'useful'").select("cue_id", "band")


def p2_frequencies(spark: SparkSession, d: str) -> DataFrame:
    return _cues(spark, d).select("cue_id", "occurrences", F.col("records").alias("songs"), "band")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = split_overlaps(read(spark, d, "context_prefixes"), threshold=0.8)
    return pairs.select(F.least("eval_key", "train_key").alias("prefix_a"), F.greatest("eval_key", "train_key").alias("prefix_b"))


def p3_records(spark: SparkSession, d: str) -> DataFrame:
    found = overlapping_records(read(spark, d, "context_prefixes"), threshold=0.8)
    return found.select(F.col("key").alias("prefix_id"), "split_name", "links", "most_common")


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    return overlap_report(read(spark, d, "context_prefixes"), threshold=0.8)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return same_entities(read(spark, d, "catalog_items"))


def p4_classes(spark: SparkSession, d: str) -> DataFrame:
    return entity_classes(read(spark, d, "catalog_items"))


def _neighbours(spark: SparkSession, d: str) -> DataFrame:
    probes = read(spark, d, "knn_probes")
    parts = []
    for collection, table, key, vector in (("item", "item_embeddings", "item_id", "emb"), ("playlist", "tokenized_playlists", "playlist_id", "context_emb")):
        near = most_similar(read(spark, d, table), probes.where(F.col("collection") == collection), key, vector, k=5)
        parts.append(near.select(F.lit(collection).alias("collection"), "query_id", "neighbour_id", "score"))
    return parts[0].unionByName(parts[1])


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _neighbours(spark, d).select("collection", "query_id", "neighbour_id")


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_corpus(read(spark, d, "documents"), "doc_id", "text")


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    return mix_sources(read(spark, d, "documents"), read(spark, d, "mix_targets"))


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return mix_report(read(spark, d, "documents"), read(spark, d, "mix_targets"))


def p7_temperature(spark: SparkSession, d: str) -> DataFrame:
    """Half of all tokens, as flat as the target shares are and the repetition limits allow."""
    return mix_by_temperature(read(spark, d, "documents"), read(spark, d, "mix_targets"), budget=0.5)


def _subjects(spark: SparkSession, d: str) -> DataFrame:
    return subject_areas(read(spark, d, "documents"), read(spark, d, "subject_labels"), read(spark, d, "subject_areas"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _subjects(spark, d).select(F.col("doc").alias("doc_id"), "subject")


def p8_composition(spark: SparkSession, d: str) -> DataFrame:
    found = _subjects(spark, d).groupBy("subject").agg(F.count("*").alias("documents"), F.sum("share").alias("weight"))
    every = read(spark, d, "documents").agg(F.count("*").alias("n"))
    return found.crossJoin(F.broadcast(every)).select("subject", "documents", (F.col("documents") / F.col("n")).alias("share_of_documents"), (F.col("weight") / F.col("n")).alias("mean_share_of_sentences"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_pairs, p2_found, p2_frequencies, p3_found, p3_records, p3_report, p4_found, p4_classes, p5_found, p6_ids, p7_mix, p7_report, p7_temperature, p8_found, p8_composition)}


_RECORDS = """
WITH records AS (
  SELECT DISTINCT prefix_id, split_name, source, list_sort(list_distinct(list_filter(list_transform(item_ids, lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(13))), lambda x: x IS NOT NULL AND x <> ''))) AS items
  FROM context_prefixes),
kept AS (SELECT * FROM records WHERE len(items) > 0),
held AS (SELECT prefix_id, split_name, source, len(items) AS m, unnest(items) AS item FROM kept)"""

_PAIRS = (
    _RECORDS
    + """,
n AS (SELECT item, count(*) AS n FROM held GROUP BY item),
total AS (SELECT count(*) AS n FROM kept),
pairs AS (SELECT a.item AS item_a, b.item AS item_b, count(*) AS n_ab FROM held a JOIN held b ON a.prefix_id = b.prefix_id AND a.item < b.item GROUP BY ALL HAVING count(*) >= 8)
SELECT item_a, item_b, n_ab, x.n AS n_a, y.n AS n_b, total.n AS n_records, round_even(n_ab * total.n::DOUBLE / (x.n::DOUBLE * y.n), 4) AS lift
FROM pairs JOIN n x ON x.item = item_a JOIN n y ON y.item = item_b CROSS JOIN total"""
)

_CUES = """
WITH once AS (SELECT DISTINCT item_id, cue_ids FROM cue_mappings WHERE item_id IS NOT NULL AND cue_ids IS NOT NULL),
total AS (SELECT count(DISTINCT item_id) AS n FROM once),
held AS (SELECT item_id, unnest(cue_ids) AS cue_id FROM once),
counted AS (SELECT cue_id, count(*) AS occurrences, count(DISTINCT item_id) AS songs FROM held WHERE cue_id IS NOT NULL AND cue_id <> 0 GROUP BY cue_id)
SELECT cue_id, occurrences, songs, CASE WHEN songs < 5 THEN 'rare' WHEN songs > 0.3 * total.n THEN 'common' ELSE 'useful' END AS band FROM counted CROSS JOIN total"""

_OVERLAPS = (
    _RECORDS
    + """,
common AS (
  SELECT e.prefix_id AS e, t.prefix_id AS t, any_value(e.m) AS em, any_value(t.m) AS tm, count(*) AS n
  FROM held e JOIN held t ON e.item = t.item WHERE e.split_name IN ('val', 'test') AND t.split_name = 'train' GROUP BY 1, 2),
hits AS (SELECT e, t, n FROM common WHERE n * 10 >= 8 * (em + tm - n))"""
)


_NEAREST = """
WITH raw AS (
  SELECT 'item' AS collection, item_id AS id, any_value(emb) AS v FROM item_embeddings WHERE emb IS NOT NULL GROUP BY item_id
  UNION ALL SELECT 'playlist', playlist_id, any_value(context_emb) FROM tokenized_playlists WHERE context_emb IS NOT NULL GROUP BY playlist_id),
unit AS (SELECT collection, id, v::DOUBLE[] AS v, sqrt(list_inner_product(v::DOUBLE[], v::DOUBLE[])) AS norm FROM raw),
good AS (SELECT * FROM unit WHERE norm > 0),
scored AS (
  SELECT q.collection, q.id AS query_id, b.id AS neighbour_id, round(list_inner_product(q.v, b.v) / (q.norm * b.norm), 12) AS score
  FROM (SELECT DISTINCT collection, query_id FROM knn_probes) p JOIN good q ON q.collection = p.collection AND q.id = p.query_id JOIN good b ON b.collection = q.collection AND b.id <> q.id)
SELECT collection, query_id, neighbour_id FROM (
  SELECT *, row_number() OVER (PARTITION BY collection, query_id ORDER BY score DESC, neighbour_id) AS r FROM scored) WHERE r <= 5"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_pairs": _PAIRS,
        "p1_found": f"SELECT item_a, item_b FROM ({_PAIRS}) WHERE n_ab * n_records >= 5 * n_a * n_b",
        "p2_frequencies": _CUES,
        "p2_found": f"SELECT cue_id, band FROM ({_CUES}) WHERE band <> 'useful'",
        "p3_found": _OVERLAPS + " SELECT least(e, t) AS prefix_a, greatest(e, t) AS prefix_b FROM hits",
        "p3_records": _OVERLAPS + " SELECT e AS prefix_id, any_value(split_name) AS split_name, count(*) AS links, max(n) AS most_common FROM hits JOIN kept ON kept.prefix_id = e GROUP BY e",
        "p5_found": _NEAREST,
        "p3_report": _OVERLAPS
        + """ SELECT split_name, source, count(*) AS records, count(*) FILTER (WHERE prefix_id IN (SELECT e FROM hits)) AS overlapping
FROM kept WHERE split_name IN ('val', 'test') GROUP BY split_name, source""",
    }
