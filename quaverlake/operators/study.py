"""Paired listening studies: assignment, unblinding, summaries by participant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaverlake.functions import hashing


def balanced_sides(cases: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """(key, case_code, generated_on_a): half of the cases, one more if odd, have the generated song on side A,
    by hash order; codes are opaque. The place in hash order comes from counts of hash prefixes."""
    h = cases.select(F.col(key).alias("key"), hashing.digest("side", seed, F.col(key)).alias("h"), hashing.digest("case", seed, F.col(key)).alias("c")).withColumn("p", F.substring("h", 1, 3))
    counts = h.groupBy("p").agg(F.count("*").alias("n"))
    # 4096 prefixes at most
    before = counts.select("p", F.coalesce(F.sum("n").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("n0"))
    n = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    place = F.row_number().over(Window.partitionBy("p").orderBy("h", "key")) + F.col("n0")
    ranked = h.join(F.broadcast(before), "p").withColumn("place", place).crossJoin(F.broadcast(n))
    return ranked.select(F.col("key").alias(key), F.substring("c", 1, 12).alias("case_code"), (F.col("place") <= F.ceil(F.col("n") / 2)).alias("generated_on_a"))


def parsed_flag(column: Column | str) -> Column:
    """True and false as people and programs write them (true, 1, yes; false, 0, no; any case, blanks around); else null."""
    c = F.lower(F.trim((F.col(column) if isinstance(column, str) else column).cast("string")))
    return F.when(c.isin("true", "1", "yes"), True).when(c.isin("false", "0", "no"), False)


def next_item_pairs(playlists: DataFrame, key: str, items: str, catalogue: DataFrame, catalogue_key: str, heard: int = 15, seed: int = 42) -> DataFrame:
    """(key, next_item, generated_on_a): the item that follows the first ``heard`` of each list and the side that the generated
    song is on. Only the immediately following one will do: a list that ends there, or whose next item the catalogue lacks,
    has no row, and nothing is put in its place."""
    following = playlists.where(F.size(items) > heard).select(F.col(key), F.element_at(items, heard + 1).alias("next_item"))
    have = catalogue.select(F.col(catalogue_key).alias("next_item")).distinct()
    found = following.join(have, "next_item", "left_semi")
    return found.join(balanced_sides(found, key, seed).select(key, "generated_on_a"), key).select(key, "next_item", "generated_on_a")


def least_used(cases: DataFrame, assignments: DataFrame, key: str) -> DataFrame:
    """(key, n, a, eligible): uses of every case, never used ones too, how often with side A, and whether it is among
    the least used."""
    counts = assignments.groupBy(key).agg(F.count("*").alias("n"), F.count(F.when(F.col("generated_on_a"), 1)).alias("a"))
    every = cases.select(key).distinct().join(counts, key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("a", F.lit(0)).alias("a"))
    low = every.agg(F.min("n").alias("low"))
    return every.crossJoin(F.broadcast(low)).select(key, "n", "a", (F.col("n") == F.col("low")).alias("eligible"))


def unblind(responses: DataFrame, carry: list[str], ratings: list[str]) -> DataFrame:
    """carry, generated_<r> and real_<r> for each rating, response (generated, real, tie) and share (1, 0, one
    half): sides A and B put back by song_a_is_generated."""
    a = F.col("song_a_is_generated")
    cols = [c for r in ratings for c in (F.when(a, F.col(f"{r}_a")).otherwise(F.col(f"{r}_b")).alias(f"generated_{r}"), F.when(a, F.col(f"{r}_b")).otherwise(F.col(f"{r}_a")).alias(f"real_{r}"))]
    chose_a = F.col("preference") == "Song A"
    response = F.when(~F.col("preference").isin("Song A", "Song B"), "tie").when(chose_a == a, "generated").otherwise("real")
    out = responses.select(*carry, *cols, response.alias("response"))
    return out.withColumn("share", F.when(F.col("response") == "generated", 1.0).when(F.col("response") == "tie", 0.5).otherwise(0.0))


def by_participant(unblinded: DataFrame, participant: str, values: list[str]) -> DataFrame:
    """One row: participants, responses and the mean of participants' means of each value, so that a person
    counts once however many responses they gave."""
    per = unblinded.groupBy(participant).agg(F.count("*").alias("n"), *[F.avg(v).alias(v) for v in values])
    return per.agg(F.count("*").alias("participants"), F.sum("n").alias("responses"), *[F.avg(v).alias(v) for v in values])


def response_counts(unblinded: DataFrame) -> DataFrame:
    count = lambda r: F.count(F.when(F.col("response") == r, 1)).alias(r)
    return unblinded.agg(count("generated"), count("real"), count("tie"))


def paired_difference(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """One row: pairs, mean of left - right by key."""
    joined = left.select(key, F.col(value).alias("l")).join(right.select(key, F.col(value).alias("r")), key)
    return joined.agg(F.count("*").alias("pairs"), F.avg(F.col("l") - F.col("r")).alias("mean_difference"))


def invalid_responses(responses: DataFrame, key: str, ratings: list[str], low: int = 1, high: int = 5) -> DataFrame:
    """(key, problem): one row for each rating out of range or missing and each unknown preference."""
    bad: list[Column] = [F.when(~F.coalesce(F.col(r).between(low, high), F.lit(False)), F.lit(f"rating {r}")) for r in ratings]
    bad.append(F.when(~F.coalesce(F.col("preference").isin("Song A", "Song B", "No preference"), F.lit(False)), F.lit("preference")))
    return responses.select(key, F.explode(F.filter(F.array(*bad), lambda x: x.isNotNull())).alias("problem"))
