"""Entity resolution between two catalogues: conservative, one-to-one, strict then relaxed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaverlake.functions import text


def keyed(catalogue: DataFrame, key: str, artist: str, title: str, ascii_only: bool = False) -> DataFrame:
    """(id, strict_key, relaxed_key); a side without artist or title has null keys."""
    a = text.match_key(artist, ascii_only)
    strict, relaxed = text.match_key(title, ascii_only), text.match_key(text.base_title(title), ascii_only)
    rows = catalogue.select(F.col(key).cast("string").alias("id"), a.alias("a"), strict.alias("s"), relaxed.alias("r"))
    whole = lambda t: F.when((F.col("a") != "") & (F.col(t) != ""), F.concat_ws("|", "a", t))
    return rows.select("id", whole("s").alias("strict_key"), whole("r").alias("relaxed_key"))


def unique_key_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(left_id, right_id) of the non-null keys that exactly one row of each side has. Counted before
    joining, so a key that fills a third of a side is one row by then."""
    one = lambda df, name: df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"), F.min("id").alias(name)).where("n = 1").select(key, name)
    return one(left, "left_id").join(one(right, "right_id"), key).select("left_id", "right_id")


def cascade(left: DataFrame, right: DataFrame) -> DataFrame:
    """(left_id, right_id, match_type): strict matches, then relaxed ones among what is left on both sides."""
    strict = unique_key_join(left, right, "strict_key")
    l2 = left.join(strict.select(F.col("left_id").alias("id")), "id", "left_anti")
    r2 = right.join(strict.select(F.col("right_id").alias("id")), "id", "left_anti")
    relaxed = unique_key_join(l2, r2, "relaxed_key")
    return strict.withColumn("match_type", F.lit("strict")).unionByName(relaxed.withColumn("match_type", F.lit("relaxed-version")))


def not_one_to_one(mapping: DataFrame, left: str, right: str) -> DataFrame:
    """(side, id, n): ids of either side in more than one row."""
    many = lambda c: mapping.groupBy(F.col(c).cast("string").alias("id")).agg(F.count("*").alias("n")).where("n > 1").select(F.lit(c).alias("side"), "id", "n")
    return many(left).unionByName(many(right))


def id_set_difference(left: DataFrame, left_key: str, right: DataFrame, right_key: str) -> DataFrame:
    """(id, side): ids that only one side has."""
    a = left.select(F.col(left_key).alias("id")).where("id IS NOT NULL").distinct().withColumn("l", F.lit(1))
    b = right.select(F.col(right_key).alias("id")).where("id IS NOT NULL").distinct().withColumn("r", F.lit(1))
    both = a.join(b, "id", "full_outer").where("l IS NULL OR r IS NULL")
    return both.select("id", F.when(F.col("r").isNull(), "left").otherwise("right").alias("side"))
