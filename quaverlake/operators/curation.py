"""Curation of item lists: frequency and length filters to a fixpoint, splits, dataset card."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quaverlake.functions import hashing
from quaverlake.session import cut


def slots(lists: DataFrame, key: str, items: str) -> DataFrame:
    """(key, pos, item): list elements that aren't null or blank, trimmed, with their place from 0."""
    rows = lists.select(key, F.posexplode(items).alias("pos", "item"))
    return rows.select(key, "pos", F.trim("item").alias("item")).where("item IS NOT NULL AND item <> ''")


def item_frequency(lists: DataFrame, key: str, items: str) -> DataFrame:
    """(item, n): occurrences over all slots, repeats in a list counted."""
    return slots(lists, key, items).groupBy("item").agg(F.count("*").alias("n"))


def relist(rows: DataFrame, key: str) -> DataFrame:
    """Slots back to (key, items) in order of pos. A list is a row of the source, so it fits a row here."""
    return rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "item"))).alias("s")).select(key, F.transform("s", lambda x: x["item"]).alias("items"))


def curate(lists: DataFrame, key: str, items: str, min_frequency: int = 10, shortest: int = 10, longest: int = 60, available: DataFrame | None = None, single_pass: bool = False) -> DataFrame:
    """(key, items): what is left when items used fewer than ``min_frequency`` times, items not in
    ``available`` and lists of another length are dropped again and again, until nothing changes.
    or once only with ``single_pass``. Each round drops slots, so there is an end. Lengths are those of the cleaned lists in every round."""
    rows = slots(lists, key, items)
    if available is not None:
        rows = rows.join(available.select(F.col(available.columns[0]).alias("item")).distinct(), "item", "left_semi")
    rows = cut(rows)
    before = rows.count()
    while True:
        length = rows.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n").between(shortest, longest)).select(key)
        fitting = rows.join(length, key, "left_semi")
        frequent = fitting.groupBy("item").agg(F.count("*").alias("n")).where(F.col("n") >= min_frequency).select("item")
        rows = cut(fitting.join(frequent, "item", "left_semi").select(key, "pos", "item"))
        now = rows.count()
        if now == before or single_pass:
            break
        before = now
    final = rows.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n").between(shortest, longest)).select(key)
    return relist(rows.join(final, key, "left_semi"), key)


def hashed_splits(lists: DataFrame, key: str, seed: int = 42, train: float = 0.8, val: float = 0.1) -> DataFrame:
    """(key, split_name): the first floor(train n) keys in hash order are train, the next max(1, floor(val n))
    val, the rest test. The place in hash order comes from counts of hash prefixes, not from one sort
    of all keys in a task."""
    h = lists.select(F.col(key).alias("key"), hashing.digest("shuffle", seed, F.col(key)).alias("h")).withColumn("p", F.substring("h", 1, 3))
    counts = h.groupBy("p").agg(F.count("*").alias("n"))
    # 4096 prefixes at most
    offsets = counts.select("p", F.coalesce(F.sum("n").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("n0"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    place = F.row_number().over(Window.partitionBy("p").orderBy("h", "key")) + F.col("n0")
    ranked = h.join(F.broadcast(offsets), "p").withColumn("place", place).crossJoin(F.broadcast(total))
    first = F.floor(F.col("total") * train)
    second = first + F.greatest(F.lit(1), F.floor(F.col("total") * val))
    return ranked.select(F.col("key").alias(key), F.when(F.col("place") <= first, "train").when(F.col("place") <= second, "val").otherwise("test").alias("split_name"))


def card(lists: DataFrame, key: str, items: str, split: str) -> DataFrame:
    """One row per split: lists, slots, distinct items, and shortest, longest, mean (one digit, half to even)
    and upper median length. The median comes from counts of lengths."""
    sized = lists.select(F.col(split).alias("split_name"), F.size(items).alias("n"))
    hist = sized.groupBy("split_name", "n").agg(F.count("*").alias("c"))
    w = Window.partitionBy("split_name").orderBy("n")
    run = hist.select("split_name", "n", "c", F.sum("c").over(w).alias("upto"), F.sum("c").over(Window.partitionBy("split_name")).alias("total"))
    stats = run.groupBy("split_name").agg(
        F.sum("c").alias("lists"),
        F.sum(F.col("n") * F.col("c")).alias("slots"),
        F.min("n").alias("shortest"),
        F.max("n").alias("longest"),
        F.bround(F.sum(F.col("n") * F.col("c")) / F.sum("c"), 1).alias("mean_length"),
        F.min(F.when(F.col("upto") > F.floor(F.col("total") / 2), F.col("n"))).alias("median_length"),
    )
    distinct = lists.select(F.col(split).alias("split_name"), F.explode(items).alias("item")).groupBy("split_name").agg(F.count_distinct("item").alias("distinct_items"))
    return stats.join(distinct, "split_name")


def nearest_rank(histogram: DataFrame, value: str, count: str, fractions: list[float]) -> DataFrame:
    """(fraction, value): the element at round(fraction * (n - 1)), half to even, of the sorted values, from
    their counts; 0 where there are none."""
    w = Window.orderBy(value)
    run = histogram.select(F.col(value).alias("v"), F.sum(count).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("upto"))
    total = histogram.agg(F.coalesce(F.sum(count), F.lit(0)).alias("n"))
    wanted = total.select("n", F.explode(F.array(*[F.lit(f) for f in fractions])).alias("fraction")).withColumn("at", F.bround(F.col("fraction") * (F.col("n") - 1)).cast("long"))
    hit = wanted.join(run, F.col("upto") > F.col("at"), "left").groupBy("fraction").agg(F.coalesce(F.min("v"), F.lit(0)).alias("value"))
    return hit
