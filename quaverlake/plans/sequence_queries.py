"""Event-log, item-list and matching queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaverlake.functions import hashing, text
from quaverlake.operators import curation, knn, matching, sequences
from quaverlake.session import cut, read

GAP, SEED, FRACTION, CAP = 5, 42, 0.2, 16


def _log(spark: SparkSession, d: str) -> DataFrame:
    return sequences.clean_log(read(spark, d, "listening_log"))


def _judged(spark: SparkSession, d: str) -> DataFrame:
    return sequences.with_verdict(sequences.windows(sequences.positions(_log(spark, d)), GAP))


def lists(spark: SparkSession, d: str) -> DataFrame:
    """(prefix_id, split_name, items): one row per record, ids trimmed, null and blank ones dropped, repeats kept."""
    raw = read(spark, d, "context_prefixes")
    trimmed = F.filter(F.transform("item_ids", lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))
    row = F.struct("split_name", trimmed.alias("items"))
    once = raw.where("prefix_id IS NOT NULL AND item_ids IS NOT NULL").groupBy("prefix_id").agg(F.max(row).alias("r"))
    return once.select("prefix_id", "r.split_name", "r.items").where(F.size("items") > 0)


def seq_windows(spark, d):
    kept = _judged(spark, d).where("verdict = 'kept'")
    return sequences.record_lines(sequences.sampled(kept, SEED, FRACTION, CAP), SEED)


def seq_window_stats(spark, d):
    by = _judged(spark, d).groupBy("verdict").agg(F.count("*").alias("windows"), F.count_distinct("user").alias("users"), F.min("unique_references").alias("least_references"), F.max("unique_targets").alias("most_targets"))
    return by


def seq_repeats(spark, d):
    return sequences.repeat_stats(_judged(spark, d).where("verdict = 'kept'"))


def seq_caps(spark, d):
    return sequences.capped_counts(_judged(spark, d).where("verdict = 'kept'"), [1, 4, 16, 64], SEED, FRACTION)


def seq_windows_per_user(spark, d):
    """Nearest-rank percentiles of windows per user."""
    per = _judged(spark, d).where("verdict = 'kept'").groupBy("user").agg(F.count("*").alias("n"))
    return curation.nearest_rank(per.groupBy("n").agg(F.count("*").alias("c")), "n", "c", [0.0, 0.25, 0.5, 0.75, 0.9, 1.0])


def seq_gap_audit(spark, d):
    audit = sequences.gap_audit(cut(sequences.positions(_log(spark, d))), [0, 1, 5, 20, None])
    return audit.select("threshold", "windows", "users", F.bround("unique_window_share", 6).alias("unique_window_share"), F.bround("five_target_share", 6).alias("five_target_share"))


def seq_interactions(spark, d):
    return sequences.interaction_stats(_log(spark, d)).withColumn("mapped_share", F.bround("mapped_share", 6))


def seq_users_at_least(spark, d):
    return sequences.users_at_least(_log(spark, d), [1, 5, 20, 100])


def seq_file_order(spark, d):
    """In file order, for windows of two and of twenty events."""
    log = _log(spark, d)
    one = lambda w: sequences.file_order_streaks(log, w).withColumn("events", F.lit(w))
    return one(2).unionByName(one(20))


def seq_user_splits(spark, d):
    users = _log(spark, d).select("user").distinct()
    return users.select("user", hashing.split_of(F.col("user"), SEED, FRACTION).alias("split_name"), hashing.pseudonym(F.col("user"), SEED).alias("pseudonym"))


def seq_rolling(spark, d):
    wins = sequences.rolling(lists(spark, d), "prefix_id", "items", 20)
    return wins.select("prefix_id", "start_index", F.concat_ws(",", "items").alias("items"))


def seq_first_window(spark, d):
    first = sequences.first_window(lists(spark, d), "prefix_id", "items")
    return first.select("prefix_id", F.concat_ws(",", "references").alias("refs"), F.concat_ws(",", "targets").alias("targets"))


def seq_transitions(spark, d):
    steps = sequences.suffix_transitions(sequences.first_window(lists(spark, d), "prefix_id", "items"), "prefix_id")
    return steps.select("prefix_id", "step", F.size("history").alias("known"), F.element_at("history", -1).alias("last"), "target")


def seq_duplicate_surplus(spark, d):
    return lists(spark, d).select("prefix_id", (F.size("items") - F.size(F.array_distinct("items"))).alias("surplus")).where("surplus > 0")


def seq_split_index(spark, d):
    n = F.size("items")
    return lists(spark, d).where(n > 1).select("prefix_id", n.alias("n"), sequences.split_index(n, F.lit(0.75)).alias("at"))


def cur_frequency(spark, d):
    return curation.item_frequency(lists(spark, d), "prefix_id", "items")


def cur_fixpoint(spark, d):
    kept = curation.curate(lists(spark, d), "prefix_id", "items", min_frequency=3, shortest=5, longest=40)
    return kept.select("prefix_id", F.concat_ws(",", "items").alias("items"))


def cur_card(spark, d):
    return curation.card(lists(spark, d).where("split_name IS NOT NULL"), "prefix_id", "items", "split_name")


def cur_splits(spark, d):
    return curation.hashed_splits(lists(spark, d).select(F.col("prefix_id").cast("string").alias("prefix_id")), "prefix_id")


def cur_available(spark, d):
    """Slots whose item the catalogue has, by split. Items are counted before they are looked up."""
    have = read(spark, d, "catalog_items").select(F.col("item_id").alias("item")).distinct()
    slots = lists(spark, d).select("split_name", F.explode("items").alias("item")).groupBy("split_name", "item").agg(F.count("*").alias("n"))
    return slots.join(have.withColumn("ok", F.lit(1)), "item", "left").groupBy("split_name").agg(F.sum("n").alias("slots"), F.coalesce(F.sum(F.when(F.col("ok") == 1, F.col("n"))), F.lit(0)).alias("available"))


def cur_missing_ids(spark, d):
    """Ids of lists that the catalogue lacks."""
    ids = lists(spark, d).select(F.explode("items").alias("item_id")).groupBy("item_id").agg(F.count("*").alias("n"))
    return ids.join(read(spark, d, "catalog_items"), "item_id", "left_anti")


def cur_id_sets(spark, d):
    sides = matching.id_set_difference(read(spark, d, "catalog_items"), "item_id", read(spark, d, "cue_mappings"), "item_id")
    return sides


def _catalogue(spark, d):
    """One row per item."""
    raw = read(spark, d, "catalog_items")
    return raw.where("item_id IS NOT NULL").groupBy("item_id").agg(F.max(F.struct("artist", "title", "album")).alias("r")).select("item_id", "r.*")


def match_keys(spark, d):
    """Match keys of every title, folded to ASCII."""
    return _catalogue(spark, d).where("title IS NOT NULL").select("item_id", text.match_key("title").alias("strict_key"), text.match_key(text.base_title("title")).alias("relaxed_key"))


def match_cascade(spark, d):
    """Every item with the album by the same artist that its title also names, or none. An album is a name of an
    artist, and has the id of its smallest item."""
    c = _catalogue(spark, d)
    albums = c.where("artist IS NOT NULL AND album IS NOT NULL").groupBy("artist", "album").agg(F.concat(F.lit("a"), F.min("item_id")).alias("id"))
    left = cut(matching.keyed(c, "item_id", "artist", "title"))
    found = matching.cascade(left, cut(matching.keyed(albums, "id", "artist", "album")))
    return left.select(F.col("id").alias("left_id")).join(found, "left_id", "left")


def match_not_one_to_one(spark, d):
    """Feature numbers of several items, and items of several numbers."""
    c = read(spark, d, "catalog_items").where("feature_index >= 0 AND item_id IS NOT NULL").select("item_id", "feature_index").distinct()
    return matching.not_one_to_one(c, "item_id", "feature_index")


def match_gathered(spark, d):
    """How many slots of each list have a usable row in the embedding table."""
    emb = read(spark, d, "item_embeddings").where("emb IS NOT NULL").select("item_id", "row_idx").distinct()
    rows = knn.gather(lists(spark, d), "prefix_id", "items", emb, "item_id", "row_idx")
    return rows.groupBy("prefix_id").agg(F.count("*").alias("found"), F.min("pos").alias("first_pos"), F.sum("value").alias("row_sum"))


_NAMES = (seq_windows, seq_window_stats, seq_repeats, seq_caps, seq_windows_per_user, seq_gap_audit, seq_interactions, seq_users_at_least, seq_file_order, seq_user_splits, seq_rolling, seq_first_window, seq_transitions, seq_duplicate_surplus, seq_split_index, cur_frequency, cur_fixpoint, cur_card, cur_splits, cur_available, cur_missing_ids, cur_id_sets, match_keys, match_cascade, match_not_one_to_one, match_gathered)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _NAMES}


LOG = """
log AS (SELECT source_row, user_id AS "user", played_at AS ts, nullif(trim(item_id), '') AS item FROM (SELECT DISTINCT source_row, user_id, item_id, played_at FROM listening_log) WHERE user_id IS NOT NULL AND played_at IS NOT NULL),
ev AS (SELECT *, row_number() OVER (PARTITION BY "user" ORDER BY ts, source_row) AS rn FROM log),
mapped AS (SELECT *, rn - lag(rn) OVER (PARTITION BY "user" ORDER BY rn) - 1 AS skipped FROM ev WHERE item IS NOT NULL)"""


def _windows(gap: int | None) -> str:
    return f"""
runs AS (SELECT *, sum(CASE WHEN skipped IS NULL {'' if gap is None else f'OR skipped > {gap}'} THEN 1 ELSE 0 END) OVER (PARTITION BY "user" ORDER BY rn) - 1 AS run_index FROM mapped),
framed AS (SELECT "user", run_index, row_number() OVER p - 20 AS start_index, ts AS end_ts, list(item) OVER (PARTITION BY "user", run_index ORDER BY rn ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS items FROM runs WINDOW p AS (PARTITION BY "user", run_index ORDER BY rn)),
wins AS (SELECT *, len(list_distinct(items[1:15])) AS unique_references, len(list_distinct(items[16:20])) AS unique_targets FROM framed WHERE len(items) = 20),
judged AS (SELECT *, CASE WHEN unique_references < 8 THEN 'references' WHEN unique_targets < 3 THEN 'targets' ELSE 'kept' END AS verdict FROM wins),
kept AS (SELECT * FROM judged WHERE verdict = 'kept'),
split AS (SELECT *, CASE WHEN ('0x' || substr(sha256('split' || chr(0) || '42' || chr(0) || "user"), 1, 16))::UBIGINT / 18446744073709551616.0 < 0.2 THEN 'test' ELSE 'train' END AS split_name FROM kept)"""


WINDOWS = f"WITH {LOG}, {_windows(5)}"
LISTS = """
lists AS (SELECT prefix_id, split_name, items FROM (
  SELECT DISTINCT prefix_id, split_name, list_filter(list_transform(item_ids, lambda x: trim(x)), lambda x: x IS NOT NULL AND x <> '') AS items FROM context_prefixes WHERE prefix_id IS NOT NULL AND item_ids IS NOT NULL) WHERE len(items) > 0)"""
_ONCE = "SELECT item_id, max(struct_pack(a := artist, t := title, b := album)) AS r FROM catalog_items WHERE item_id IS NOT NULL GROUP BY item_id"
_CATALOGUE = "catalogue AS (SELECT DISTINCT item_id, artist, title, album FROM catalog_items WHERE item_id IS NOT NULL)"


def _key(c: str) -> str:
    """Letters without their marks and nothing beyond ASCII, then the rules of a match key."""
    x = f"regexp_replace(strip_accents({c}), '[^\\x00-\\x7f]', '', 'g')"
    x = f"replace(lower({x}), '&', ' and ')"
    # a run of single letters with a dot behind each is an initialism
    x = f"list_reduce(list_prepend({x}, regexp_extract_all({x}, '\\b(?:[a-z]\\.){{2,}}')), lambda a, b: replace(a, b, replace(b, '.', '')))"
    x = f"regexp_replace({x}, '(\\w)[.'']\\b', '\\1', 'g')"
    return f"trim(regexp_replace({x}, '[^a-z0-9]+', ' ', 'g'))"


def _base(c: str) -> str:
    v = "|".join(text.VERSION_WORDS)
    x = f"regexp_replace({c}, '[\\[(][^\\])]*(?:{v})[^\\])]*[\\])]', ' ', 'gi')"
    x = f"regexp_replace({x}, '\\s+[-–—]\\s+.*(?:{v}).*$', ' ', 'gi')"
    return f"regexp_replace({x}, '\\b(?:feat|ft)\\.?\\s+.*$', ' ', 'gi')"


def oracle_sql() -> dict[str, str]:
    audit = " UNION ALL ".join(
        f"""SELECT {-1 if g is None else g} AS threshold, count(*) AS windows, count(DISTINCT "user") AS users, round_even(avg((len(list_distinct(items)) = 20)::INT), 6) AS unique_window_share, round_even(avg((unique_targets = 5)::INT), 6) AS five_target_share FROM (WITH {_windows(g)} SELECT * FROM wins) HAVING count(*) > 0"""
        for g in (0, 1, 5, 20, None)
    )
    record = """format('m4a-{}-{}-r{:04d}-s{:08d}', split_name, substr(sha256('pseudonym' || chr(0) || '42' || chr(0) || "user"), 1, 16), run_index::BIGINT, start_index)"""
    matched = f"""WITH {_CATALOGUE},
l AS (SELECT item_id AS id, nullif({_key('artist')}, '') || '|' || nullif({_key('title')}, '') AS strict_key, nullif({_key('artist')}, '') || '|' || nullif({_key(_base('title'))}, '') AS relaxed_key FROM catalogue),
al AS (SELECT artist, album, 'a' || min(item_id) AS id FROM catalogue WHERE artist IS NOT NULL AND album IS NOT NULL GROUP BY artist, album),
g AS (SELECT id, nullif({_key('artist')}, '') || '|' || nullif({_key('album')}, '') AS strict_key, nullif({_key('artist')}, '') || '|' || nullif({_key(_base('album'))}, '') AS relaxed_key FROM al),
s AS (SELECT x.id AS left_id, y.id AS right_id FROM (SELECT strict_key, min(id) AS id FROM l WHERE strict_key IS NOT NULL GROUP BY 1 HAVING count(*) = 1) x JOIN (SELECT strict_key, min(id) AS id FROM g WHERE strict_key IS NOT NULL GROUP BY 1 HAVING count(*) = 1) y USING (strict_key)),
r AS (SELECT x.id AS left_id, y.id AS right_id FROM (SELECT relaxed_key, min(id) AS id FROM l WHERE relaxed_key IS NOT NULL AND id NOT IN (SELECT left_id FROM s) GROUP BY 1 HAVING count(*) = 1) x JOIN (SELECT relaxed_key, min(id) AS id FROM g WHERE relaxed_key IS NOT NULL AND id NOT IN (SELECT right_id FROM s) GROUP BY 1 HAVING count(*) = 1) y USING (relaxed_key)),
f AS (SELECT left_id, right_id, 'strict' AS match_type FROM s UNION ALL SELECT left_id, right_id, 'relaxed-version' FROM r)
SELECT l.id AS left_id, right_id, match_type FROM l LEFT JOIN f ON f.left_id = l.id"""
    return {
        "seq_windows": WINDOWS
        + f""", chosen AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY "user" ORDER BY run_index DESC, start_index DESC) AS latest, row_number() OVER (PARTITION BY "user" ORDER BY substr(sha256('window' || chr(0) || '42' || chr(0) || "user" || chr(0) || run_index || chr(0) || start_index), 1, 16), run_index, start_index) AS place FROM split) WHERE (split_name = 'test' AND latest = 1) OR (split_name = 'train' AND place <= 16))
SELECT split_name, {record} AS record_id, {record} || ',' || array_to_string(items, ',') AS line FROM chosen""",
        "seq_window_stats": WINDOWS + ' SELECT verdict, count(*) AS windows, count(DISTINCT "user") AS users, min(unique_references)::INT AS least_references, max(unique_targets)::INT AS most_targets FROM judged GROUP BY verdict',
        "seq_repeats": WINDOWS
        + """, n AS (SELECT items, len(list_filter(items[16:20], lambda x: list_contains(items[1:15], x))) AS again, unique_targets FROM kept)
SELECT coalesce(sum((len(list_distinct(items)) < 20)::INT), 0)::BIGINT AS windows_with_repeat, coalesce(sum((again > 0)::INT), 0)::BIGINT AS windows_with_overlap, coalesce(sum(again), 0)::BIGINT AS overlapping_targets, coalesce(sum((unique_targets < 5)::INT), 0)::BIGINT AS windows_with_equal_targets FROM n""",
        "seq_caps": WINDOWS + """, u AS (SELECT "user", count(*) AS n FROM split WHERE split_name = 'train' GROUP BY 1) SELECT cap, sum(least(n, cap))::BIGINT AS windows FROM u CROSS JOIN (VALUES (1), (4), (16), (64)) g(cap) GROUP BY cap""",
        "seq_windows_per_user": WINDOWS
        + """, u AS (SELECT count(*) AS n FROM kept GROUP BY "user"), o AS (SELECT list_sort(list(n)) AS v FROM u)
SELECT f AS fraction, coalesce(v[round_even(f * (len(v) - 1), 0)::BIGINT + 1], 0) AS value FROM o CROSS JOIN (VALUES (0.0::DOUBLE), (0.25), (0.5), (0.75), (0.9), (1.0)) g(f)""",
        "seq_gap_audit": f"WITH {LOG} SELECT * FROM ({audit})",
        "seq_interactions": f"""WITH {LOG}, u AS (SELECT "user", count(*) AS n, count(item) AS m FROM log GROUP BY 1) SELECT sum(n)::BIGINT AS events, sum(m)::BIGINT AS mapped, round_even(sum(m) / sum(n), 6) AS mapped_share, count(*) AS users, count(*) FILTER (WHERE m > 0) AS mapped_users, sum(greatest(0, m - 19))::BIGINT AS filtered_windows FROM u""",
        "seq_users_at_least": f"""WITH {LOG}, u AS (SELECT "user", count(item) AS m FROM log GROUP BY 1) SELECT t AS threshold, count(*) FILTER (WHERE m >= t) AS users FROM u CROSS JOIN (VALUES (1), (5), (20), (100)) g(t) GROUP BY t""",
        "seq_file_order": f"""WITH {LOG}, p AS (SELECT *, lag("user") OVER o AS pu, lag(ts) OVER o AS pt, lag(item IS NOT NULL) OVER o AS pm FROM log WINDOW o AS (ORDER BY source_row)),
i AS (SELECT *, sum(CASE WHEN pu = "user" AND pm = (item IS NOT NULL) THEN 0 ELSE 1 END) OVER (ORDER BY source_row) AS island FROM p),
s AS (SELECT island, count(*) AS n FROM i WHERE item IS NOT NULL GROUP BY island)
SELECT w AS events, (SELECT coalesce(sum(greatest(0, n - w + 1)), 0)::BIGINT FROM s) AS contiguous_windows, count(*) FILTER (WHERE pu = "user" AND ts > pt) AS increases, count(*) FILTER (WHERE pu = "user" AND ts < pt) AS decreases,
count(*) FILTER (WHERE pu IS DISTINCT FROM "user") = count(DISTINCT "user") AS users_together FROM p CROSS JOIN (VALUES (2), (20)) g(w) GROUP BY w""",
        "seq_user_splits": f"""WITH {LOG}, u AS (SELECT DISTINCT "user" FROM log) SELECT "user", CASE WHEN ('0x' || substr(sha256('split' || chr(0) || '42' || chr(0) || "user"), 1, 16))::UBIGINT / 18446744073709551616.0 < 0.2 THEN 'test' ELSE 'train' END AS split_name, substr(sha256('pseudonym' || chr(0) || '42' || chr(0) || "user"), 1, 16) AS pseudonym FROM u""",
        "seq_rolling": f"WITH {LISTS}, s AS (SELECT prefix_id, items, unnest(range(0, len(items) - 19)) AS start_index FROM lists WHERE len(items) >= 20) SELECT prefix_id, start_index::INT AS start_index, array_to_string(items[start_index + 1 : start_index + 20], ',') AS items FROM s",
        "seq_first_window": f"WITH {LISTS} SELECT prefix_id, array_to_string(items[1:15], ',') AS refs, array_to_string(items[16:20], ',') AS targets FROM lists WHERE len(items) >= 20",
        "seq_transitions": f"WITH {LISTS}, s AS (SELECT prefix_id, items, unnest(range(1, 6)) AS step FROM lists WHERE len(items) >= 20) SELECT prefix_id, step::INT AS step, (14 + step)::INT AS known, items[14 + step] AS last, items[15 + step] AS target FROM s",
        "seq_duplicate_surplus": f"WITH {LISTS} SELECT prefix_id, (len(items) - len(list_distinct(items)))::INT AS surplus FROM lists WHERE len(items) > len(list_distinct(items))",
        "seq_split_index": f"WITH {LISTS} SELECT prefix_id, len(items)::INT AS n, greatest(1, least(greatest(floor(len(items) * 0.75), ceil(len(items) / 2)), len(items) - 1))::INT AS at FROM lists WHERE len(items) > 1",
        "cur_frequency": f"WITH {LISTS}, s AS (SELECT unnest(items) AS item FROM lists) SELECT item, count(*) AS n FROM s GROUP BY item",
        "cur_fixpoint": f"""WITH RECURSIVE {LISTS}, slots AS (SELECT prefix_id, generate_subscripts(items, 1) AS pos, unnest(items) AS item FROM lists),
{_rounds(12)}
SELECT prefix_id, string_agg(item, ',' ORDER BY pos) AS items FROM f12 GROUP BY prefix_id HAVING count(*) BETWEEN 5 AND 40""",
        "cur_card": f"""WITH {LISTS}, ok AS (SELECT split_name, items, len(items) AS n FROM lists WHERE split_name IS NOT NULL), s AS (SELECT split_name, unnest(items) AS item FROM ok), u AS (SELECT split_name, count(DISTINCT item) AS distinct_items FROM s GROUP BY 1)
SELECT split_name, count(*) AS lists, sum(n)::BIGINT AS slots, min(n)::INT AS shortest, max(n)::INT AS longest, round_even(avg(n), 1) AS mean_length, (list_sort(list(n)))[count(*) // 2 + 1]::INT AS median_length, any_value(distinct_items) AS distinct_items FROM ok JOIN u USING (split_name) GROUP BY split_name""",
        "cur_splits": f"""WITH {LISTS}, h AS (SELECT prefix_id::VARCHAR AS prefix_id, sha256('shuffle' || chr(0) || '42' || chr(0) || prefix_id) AS h FROM lists), r AS (SELECT prefix_id, row_number() OVER (ORDER BY h, prefix_id) AS place, count(*) OVER () AS n FROM h)
SELECT prefix_id, CASE WHEN place <= floor(n * 0.8::DOUBLE) THEN 'train' WHEN place <= floor(n * 0.8::DOUBLE) + greatest(1, floor(n * 0.1::DOUBLE)) THEN 'val' ELSE 'test' END AS split_name FROM r""",
        "cur_available": f"WITH {LISTS}, s AS (SELECT split_name, unnest(items) AS item FROM lists) SELECT split_name, count(*) AS slots, count(*) FILTER (WHERE item IN (SELECT item_id FROM catalog_items)) AS available FROM s GROUP BY split_name",
        "cur_missing_ids": f"WITH {LISTS}, s AS (SELECT unnest(items) AS item_id FROM lists) SELECT item_id, count(*) AS n FROM s WHERE item_id NOT IN (SELECT item_id FROM catalog_items WHERE item_id IS NOT NULL) GROUP BY item_id",
        "cur_id_sets": """SELECT id, side FROM (SELECT DISTINCT item_id AS id, 'left' AS side FROM catalog_items WHERE item_id IS NOT NULL AND item_id NOT IN (SELECT item_id FROM cue_mappings WHERE item_id IS NOT NULL)
UNION ALL SELECT DISTINCT item_id, 'right' FROM cue_mappings WHERE item_id IS NOT NULL AND item_id NOT IN (SELECT item_id FROM catalog_items WHERE item_id IS NOT NULL))""",
        "match_keys": f"WITH {_CATALOGUE} SELECT item_id, {_key('title')} AS strict_key, {_key(_base('title'))} AS relaxed_key FROM catalogue WHERE title IS NOT NULL",
        "match_cascade": matched,
        "match_not_one_to_one": """WITH c AS (SELECT DISTINCT item_id, feature_index FROM catalog_items WHERE feature_index >= 0 AND item_id IS NOT NULL)
SELECT 'item_id' AS side, item_id AS id, count(*) AS n FROM c GROUP BY item_id HAVING count(*) > 1 UNION ALL SELECT 'feature_index', feature_index::VARCHAR, count(*) FROM c GROUP BY feature_index HAVING count(*) > 1""",
        "match_gathered": f"""WITH {LISTS}, s AS (SELECT prefix_id, generate_subscripts(items, 1) - 1 AS pos, unnest(items) AS item FROM lists), e AS (SELECT DISTINCT item_id, row_idx FROM item_embeddings WHERE emb IS NOT NULL)
SELECT prefix_id, count(*) AS found, min(pos)::INT AS first_pos, sum(row_idx)::BIGINT AS row_sum FROM s JOIN e ON e.item_id = s.item GROUP BY prefix_id""",
    }


def _rounds(n: int) -> str:
    """The curation rounds written out; what is stable stays as it is."""
    parts, last = [], "slots"
    for i in range(1, n + 1):
        parts.append(
            f"l{i} AS MATERIALIZED (SELECT * FROM {last} WHERE prefix_id IN (SELECT prefix_id FROM {last} GROUP BY 1 HAVING count(*) BETWEEN 5 AND 40)),\n"
            f"f{i} AS MATERIALIZED (SELECT * FROM l{i} WHERE item IN (SELECT item FROM l{i} GROUP BY 1 HAVING count(*) >= 3))"
        )
        last = f"f{i}"
    return ",\n".join(parts)
