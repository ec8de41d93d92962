"""Retrieval, sampling and sweep queries, and the windows of the event table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quaverlake.functions import text, vec
from quaverlake.operators import knn, retrieval, sequences, vocab
from quaverlake.plans.content_queries import _ITEMS, _PHRASES, _items, covering
from quaverlake.plans.model_queries import _SEQ, _sequences
from quaverlake.plans.sequence_queries import LISTS, lists
from quaverlake.session import cut, read


def _event_log(spark, d):
    """The event table as a log: item is k modulo 12, so that windows repeat items; errors are unmapped."""
    k = F.get_json_object("props", "$.k").cast("int") % 12
    return read(spark, d, "events").select(F.col("user_id").cast("string").alias("user"), "ts", F.col("event_id").alias("source_row"), F.when(F.col("event_type") != "error", k.cast("string")).alias("item"))


def seq_event_verdicts(spark, d):
    judged = sequences.with_verdict(sequences.windows(sequences.positions(_event_log(spark, d)), 1))
    return judged.groupBy("verdict").agg(F.count("*").alias("windows"), F.count_distinct("user").alias("users"))


def seq_event_windows(spark, d):
    kept = sequences.with_verdict(sequences.windows(sequences.positions(_event_log(spark, d)), 1)).where("verdict = 'kept'")
    return sequences.record_lines(sequences.sampled(kept))


def vec_expanded(spark, d):
    """The first three items of each test record, filled up to five by the neighbours of their mean."""
    short = lists(spark, d).where("split_name = 'test'").select("prefix_id", F.slice("items", 1, 3).alias("items"))
    return retrieval.expand(short, "prefix_id", "items", _items(spark, d), "item_id", "emb", 5).select("prefix_id", F.col("place").cast("int").alias("place"), "item", "source")


def vec_selected(spark, d):
    """At most five items of each test record: all, or the five that cover it best."""
    some = lists(spark, d).where("split_name = 'test'")
    return retrieval.select_items(some, "prefix_id", "items", _items(spark, d), "item_id", "emb", 5)


def vec_hybrid(spark, d):
    """Two seeds of each test playlist and the neighbours of its context vector."""
    ctx = _sequences(spark, d).select("playlist_id", "context_emb")
    raw = read(spark, d, "context_prefixes").where("split_name = 'test'").groupBy("playlist_id").agg(F.max(F.slice("item_ids", 1, 2)).alias("items"))
    return retrieval.hybrid(raw.join(ctx, "playlist_id", "left"), "playlist_id", "items", "context_emb", _items(spark, d), "item_id", "emb", 5)


def vec_nearest_of_all(spark, d):
    """The item most similar to each test playlist's context vector."""
    ctx = _sequences(spark, d).where("split_name = 'test'").select("playlist_id", "context_emb")
    return retrieval.nearest_of_all(ctx, "playlist_id", "context_emb", _items(spark, d), "item_id", "emb").select("playlist_id", "item", "score")


def vec_neighbour_report(spark, d):
    """Neighbours of the first 15 items as predictions of the next five, over test records: mean best pairing,
    cosine of the first to the first, recall, and share of the catalogue recommended."""
    from quaverlake.operators import metrics

    test = lists(spark, d).where("split_name = 'test' AND size(items) >= 20")
    items = _items(spark, d)
    m = cut(knn.gather(test, "prefix_id", "items", items, "item_id", "emb").where("pos < 20"))
    mu = knn.centroids(m.where("pos < 15"), "prefix_id", "value").select(F.col("prefix_id").cast("string").alias("query_id"), F.col("mu").alias("qvec"))
    seen = m.where("pos < 15").select(F.col("prefix_id").cast("string").alias("query_id"), F.col("id").alias("item")).distinct()
    hits = knn.exact_topk(items, mu, 20, "item_id", "emb").join(seen, ["query_id", "item"], "left_anti")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    pred = cut(hits.withColumn("i", place - 1).where("i < 5").join(items.select(F.col("item_id").alias("item"), "emb"), "item").select("query_id", "i", "item", "emb"))
    targets = m.where("pos >= 15").select(F.col("prefix_id").cast("string").alias("query_id"), (F.col("pos") - 15).alias("j"), "id", F.col("value").alias("w"))
    cells = pred.join(targets, "query_id").select("query_id", "i", "j", vec.cosine("emb", "w").alias("c"), (F.col("item") == F.col("id")).alias("hit"))
    best = metrics.best_assignment(cells, "query_id", "i", "j", "c")
    first = cells.where("i = 0 AND j = 0").agg(F.avg("c").alias("first"))
    hit = cells.groupBy("query_id").agg((F.count(F.when(F.col("hit"), 1)) / 5).alias("r")).agg(F.avg("r").alias("recall"))
    n = items.agg(F.count("*").alias("n"))
    cover = pred.agg(F.count_distinct("item").alias("used"))
    return best.agg(F.avg("best").alias("m2m"), F.count("best").alias("records")).crossJoin(first).crossJoin(hit).crossJoin(cover.crossJoin(n)).select("records", *[F.bround(c, 5).alias(c) for c in ("m2m", "first", "recall")], F.bround(F.col("used") / F.col("n"), 6).alias("coverage"))


def smp_items(spark, d):
    items = read(spark, d, "catalog_items").where("item_id IS NOT NULL").select("item_id").distinct()
    return retrieval.sample(items, "item_id", 50)


def smp_pools(spark, d):
    """Each test record's items among 20 distractors."""
    truth = lists(spark, d).where("split_name = 'test'").select("prefix_id", F.explode("items").alias("item"))
    cat = read(spark, d, "catalog_items").where("item_id IS NOT NULL")
    return retrieval.pools(truth, "prefix_id", "item", cat, "item_id", 20)


def txt_sweep(spark, d):
    """Phrases left by each pair of limits, from one count."""
    docs = read(spark, d, "documents").select("doc_id", "text")
    df = vocab.document_frequency(vocab.phrases(docs, "doc_id", "text"), "doc_id", "phrases")
    hist = df.groupBy("df").agg(F.count("*").alias("n"))
    total = docs.agg(F.count("*").alias("docs"))
    grid = hist.crossJoin(F.broadcast(total)).select("df", "n", "docs", F.explode(F.array(*[F.struct(F.lit(a).alias("min_df"), F.lit(b).alias("max_share")) for a in (2, 5, 20) for b in (0.05, 0.3)])).alias("g"))
    kept = F.when((F.col("df") >= F.col("g.min_df")) & (F.col("df") <= F.col("docs") * F.col("g.max_share")), F.col("n")).otherwise(0)
    return grid.select(F.col("g.min_df").alias("min_df"), F.col("g.max_share").alias("max_share"), kept.alias("k")).groupBy("min_df", "max_share").agg(F.sum("k").alias("phrases"))


def txt_char_grams(spark, d):
    """Documents frequency of three-letter pieces of the cues."""
    cues = read(spark, d, "cue_vocab").select("cue_id", F.lower("cue").alias("c"))
    return cues.select(F.explode(F.array_distinct(text.char_grams(F.col("c"), 3))).alias("gram")).groupBy("gram").agg(F.count("*").alias("df"))


_NAMES = (seq_event_verdicts, seq_event_windows, vec_expanded, vec_selected, vec_hybrid, vec_nearest_of_all, vec_neighbour_report, smp_items, smp_pools, txt_sweep, txt_char_grams)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _NAMES}


_EVENTS = """
WITH ev AS (SELECT user_id::VARCHAR AS "user", ts, event_id, CASE WHEN event_type <> 'error' THEN ((props->>'$.k')::INT % 12)::VARCHAR END AS item, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
mapped AS (SELECT *, rn - lag(rn) OVER (PARTITION BY "user" ORDER BY rn) - 1 AS skipped FROM ev WHERE item IS NOT NULL)"""


def oracle_sql() -> dict[str, str]:
    from quaverlake.plans.sequence_queries import _windows

    record = """format('m4a-{}-{}-r{:04d}-s{:08d}', split_name, substr(sha256('pseudonym' || chr(0) || '42' || chr(0) || "user"), 1, 16), run_index::BIGINT, start_index)"""
    mu = ", ".join(f"avg(v[{i}])" for i in range(1, 65))
    return {
        "seq_event_verdicts": f"""{_EVENTS}, {_windows(1)} SELECT verdict, count(*) AS windows, count(DISTINCT "user") AS users FROM judged GROUP BY verdict""",
        "seq_event_windows": f"""{_EVENTS}, {_windows(1)}, chosen AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY "user" ORDER BY run_index DESC, start_index DESC) AS latest, row_number() OVER (PARTITION BY "user" ORDER BY substr(sha256('window' || chr(0) || '42' || chr(0) || "user" || chr(0) || run_index || chr(0) || start_index), 1, 16), run_index, start_index) AS place FROM split) WHERE (split_name = 'test' AND latest = 1) OR (split_name = 'train' AND place <= 16))
SELECT split_name, {record} AS record_id, {record} || ',' || array_to_string(items, ',') AS line FROM chosen""",
        "vec_expanded": f"""WITH {_ITEMS}, {LISTS}, t AS (SELECT prefix_id, list_distinct(items[1:3]) AS d, items[1:3] AS ids FROM lists WHERE split_name = 'test'), s AS (SELECT prefix_id, generate_subscripts(ids, 1) AS p, unnest(ids) AS item FROM t), o AS (SELECT prefix_id, item, min(p) AS p FROM s WHERE item IN (SELECT item_id FROM items) GROUP BY 1, 2), g AS (SELECT prefix_id, item, row_number() OVER (PARTITION BY prefix_id ORDER BY p) - 1 AS place, count(*) OVER (PARTITION BY prefix_id) AS n FROM o),
c AS (SELECT prefix_id, any_value(n) AS n, [{mu}] AS mu FROM g JOIN items i ON i.item_id = g.item GROUP BY prefix_id), r AS (SELECT c.prefix_id, i.item_id AS item, n + row_number() OVER (PARTITION BY c.prefix_id ORDER BY round_even(list_inner_product(mu, v) / (sqrt(list_inner_product(mu, mu)) * norm), 6) DESC, i.item_id) - 1 AS place FROM c CROSS JOIN items i WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.prefix_id = c.prefix_id AND g.item = i.item_id))
SELECT prefix_id, place::INT AS place, item, 'given' AS source FROM g WHERE place < 5 UNION ALL SELECT prefix_id, place::INT, item, 'padded' FROM r WHERE place < 5""",
        "vec_nearest_of_all": f"""WITH {_ITEMS}, {_SEQ}, q AS (SELECT playlist_id, context_emb::DOUBLE[] AS c FROM seqs WHERE split_name = 'test' AND context_emb IS NOT NULL), n AS (SELECT playlist_id, item_id AS item, list_inner_product(c, v) / (sqrt(list_inner_product(c, c)) * norm) AS s FROM q CROSS JOIN items WHERE list_inner_product(c, c) > 0)
SELECT playlist_id, item, round_even(s, 6) + 0.0 AS score FROM n QUALIFY row_number() OVER (PARTITION BY playlist_id ORDER BY round_even(s, 6) DESC, item) = 1""",
        "vec_selected": f"""WITH {_ITEMS}, {LISTS}, t AS (SELECT prefix_id, items AS ids FROM lists WHERE split_name = 'test'), s AS (SELECT prefix_id, generate_subscripts(ids, 1) AS p, unnest(ids) AS item FROM t), o AS (SELECT prefix_id, item, min(p) AS p FROM s WHERE item IN (SELECT item_id FROM items) GROUP BY 1, 2),
g AS (SELECT prefix_id, item, row_number() OVER (PARTITION BY prefix_id ORDER BY p) - 1 AS pos, count(*) OVER (PARTITION BY prefix_id) AS n FROM o), many AS (SELECT prefix_id, pos, item, v, norm FROM g JOIN items i ON i.item_id = g.item WHERE n > 5), {covering('many', 5)}
SELECT prefix_id, pos::INT AS place, item FROM g WHERE n <= 5 UNION ALL SELECT h5.prefix_id, place::INT, item FROM h5 JOIN many ON many.prefix_id = h5.prefix_id AND many.pos = h5.pos""",
        "vec_hybrid": f"""WITH {_ITEMS}, {_SEQ}, asked AS (SELECT playlist_id, max(item_ids[1:2]) AS ids FROM context_prefixes WHERE split_name = 'test' GROUP BY playlist_id), x AS (SELECT playlist_id, generate_subscripts(ids, 1) AS p, unnest(ids) AS item FROM asked), o AS (SELECT playlist_id, item, min(p) AS p FROM x WHERE item IN (SELECT item_id FROM items) GROUP BY 1, 2), g AS (SELECT playlist_id, item, row_number() OVER (PARTITION BY playlist_id ORDER BY p) - 1 AS place FROM o),
n AS (SELECT asked.playlist_id, count(g.item) AS n FROM asked LEFT JOIN g USING (playlist_id) GROUP BY 1), t AS (SELECT playlist_id, context_emb::DOUBLE[] AS c FROM seqs JOIN asked USING (playlist_id) WHERE context_emb IS NOT NULL AND list_inner_product(context_emb::DOUBLE[], context_emb::DOUBLE[]) > 0),
mu AS (SELECT playlist_id, [{mu}] AS c FROM g JOIN items i ON i.item_id = g.item WHERE playlist_id NOT IN (SELECT playlist_id FROM t) GROUP BY 1), q AS (SELECT *, 'text' AS source FROM t UNION ALL SELECT *, 'padded' FROM mu),
r AS (SELECT q.playlist_id, i.item_id AS item, source, n + row_number() OVER (PARTITION BY q.playlist_id ORDER BY round_even(list_inner_product(c, v) / (sqrt(list_inner_product(c, c)) * norm), 6) DESC, i.item_id) - 1 AS place FROM q JOIN n USING (playlist_id) CROSS JOIN items i WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.playlist_id = q.playlist_id AND g.item = i.item_id))
SELECT playlist_id, place::INT AS place, item, 'seed' AS source FROM g WHERE place < 5 UNION ALL SELECT playlist_id, place::INT, item, source FROM r WHERE place < 5""",
        "smp_items": "WITH c AS (SELECT DISTINCT item_id FROM catalog_items WHERE item_id IS NOT NULL) SELECT item_id FROM c ORDER BY sha256('sample' || chr(0) || '42' || chr(0) || item_id), item_id LIMIT 50",
        "smp_pools": f"""WITH {LISTS}, l AS (SELECT DISTINCT prefix_id, unnest(items) AS item FROM lists WHERE split_name = 'test'), c AS (SELECT item, row_number() OVER (ORDER BY sha256('pool' || chr(0) || '42' || chr(0) || item), item) - 1 AS place FROM (SELECT DISTINCT item_id AS item FROM catalog_items WHERE item_id IS NOT NULL)), n AS (SELECT count(*) AS n FROM c),
k AS (SELECT prefix_id, n, ('0x' || substr(sha256('start' || chr(0) || '42' || chr(0) || prefix_id), 1, 15))::BIGINT % n AS s, unnest(range(0, least(count(*) + 20, n))) AS j FROM l, n GROUP BY prefix_id, n),
o AS (SELECT k.prefix_id, c.item, row_number() OVER (PARTITION BY k.prefix_id ORDER BY j) AS r FROM k JOIN c ON c.place = (s + j) % n WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.prefix_id = k.prefix_id AND l.item = c.item))
SELECT prefix_id, item, true AS is_label FROM l UNION ALL SELECT prefix_id, item, false FROM o WHERE r <= 20""",
        "txt_sweep": f"WITH {_PHRASES} SELECT a AS min_df, b AS max_share, count(*) FILTER (WHERE df >= a AND df <= n * b) AS phrases FROM df, total, (VALUES (2), (5), (20)) x(a), (VALUES (0.05::DOUBLE), (0.3)) y(b) GROUP BY a, b",
        "txt_char_grams": "WITH c AS (SELECT cue_id, lower(cue) AS c FROM cue_vocab), g AS (SELECT DISTINCT cue_id, unnest(list_transform(range(1, length(c) - 1), lambda i: substr(c, i, 3))) AS gram FROM c) SELECT gram, count(*) AS df FROM g GROUP BY gram",
    }
