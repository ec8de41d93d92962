"""Choosing and retrieving items: short lists filled up, long ones thinned, exact code lookup with a
nearest-neighbour fallback, retrieval from a sampled pool."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quaverlake.functions import hashing, vec
from quaverlake.operators import knn
from quaverlake.operators.metrics import places
from quaverlake.operators.tokens import rvq_decode


def known_items(lists: DataFrame, key: str, items: str, catalogue: DataFrame, catalogue_key: str) -> DataFrame:
    """(key, pos, item): the list's items that the catalogue has, each once, numbered from 0 in first-seen order."""
    rows = lists.select(F.col(key).alias("key"), F.posexplode(items).alias("p", "item"))
    once = rows.groupBy("key", "item").agg(F.min("p").alias("p"))
    have = once.join(catalogue.select(F.col(catalogue_key).cast("string").alias("item")).distinct(), "item", "left_semi")
    return have.select(F.col("key").alias(key), (F.row_number().over(Window.partitionBy("key").orderBy("p")) - 1).alias("pos"), "item")


def expand(lists: DataFrame, key: str, items: str, catalogue: DataFrame, catalogue_key: str, vector: str, k: int, dims: int = 64) -> DataFrame:
    """(key, place, item, source): the list's known items up to ``k`` (``given``), filled up with the catalogue's
    nearest ones to their mean, those already there excluded (``padded``). A list without any known item
    has no rows."""
    known = known_items(lists, key, items, catalogue, catalogue_key)
    table = catalogue.select(F.col(catalogue_key).cast("string").alias("item"), F.col(vector).alias("v")).dropDuplicates(["item"])
    short = known.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") < k).select(key, "n")
    mu = knn.centroids(known.join(table, "item").join(short.select(key), key), key, "v", dims).select(F.col(key).cast("string").alias("query_id"), F.col("mu").alias("qvec"))
    near = knn.exact_topk(table, mu, 2 * k, "item", "v", dims=dims).select("query_id", "item", "rank")
    own = known.select(F.col(key).cast("string").alias("query_id"), "item")
    fresh = near.join(own, ["query_id", "item"], "left_anti")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    padded = fresh.withColumn("extra", place).join(short.select(F.col(key), F.col(key).cast("string").alias("query_id"), "n"), "query_id").select(key, (F.col("n") + F.col("extra") - 1).cast("int").alias("place"), "item", F.lit("padded").alias("source"))
    given = known.select(key, F.col("pos").alias("place"), "item", F.lit("given").alias("source"))
    return given.unionByName(padded).where(F.col("place") < k)


def select_items(lists: DataFrame, key: str, items: str, catalogue: DataFrame, catalogue_key: str, vector: str, k: int, dims: int = 64) -> DataFrame:
    """(key, place, item): the known items of each list, if more than ``k`` the ``k`` with a usable vector that cover it best."""
    known = known_items(lists, key, items, catalogue, catalogue_key)
    sizes = known.groupBy(key).agg(F.count("*").alias("n"))
    few = known.join(sizes.where(F.col("n") <= k).select(key), key).select(key, F.col("pos").cast("int").alias("place"), "item")
    many = known.join(sizes.where(F.col("n") > k).select(key), key)
    table = catalogue.select(F.col(catalogue_key).cast("string").alias("item"), F.col(vector).alias("v")).where(vec.usable("v", dims)).dropDuplicates(["item"])
    return few.unionByName(knn.coverage_selection(many.join(table, "item"), key, "pos", "item", "v", k))


def hybrid(lists: DataFrame, key: str, items: str, text_vector: str, catalogue: DataFrame, catalogue_key: str, vector: str, k: int, dims: int = 64) -> DataFrame:
    """(key, place, item, source): the list's known items first (``seed``), then the catalogue's nearest to the row's
    text vector (``text``), seeds excluded; where a row has no usable text vector, nearest to the seeds' mean
    (``padded``)."""
    known = known_items(lists, key, items, catalogue, catalogue_key).where(F.col("pos") < k)
    table = catalogue.select(F.col(catalogue_key).cast("string").alias("item"), F.col(vector).alias("v")).dropDuplicates(["item"])
    has_text = lists.where(vec.usable(text_vector, dims))
    q = has_text.select(F.col(key).cast("string").alias("query_id"), F.col(text_vector).alias("qvec"))
    near = knn.exact_topk(table, q, 2 * k, "item", "v", dims=dims).select("query_id", "item", "rank")
    seeds = known.select(F.col(key).cast("string").alias("query_id"), "item")
    counts = lists.select(F.col(key), F.col(key).cast("string").alias("query_id")).distinct().join(seeds.groupBy("query_id").agg(F.count("*").alias("n")), "query_id", "left").select("query_id", key, F.coalesce("n", F.lit(0)).alias("n"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    found = near.join(seeds, ["query_id", "item"], "left_anti").withColumn("extra", place).join(counts, "query_id").select(key, (F.col("n") + F.col("extra") - 1).cast("int").alias("place"), "item", F.lit("text").alias("source"))
    without = lists.join(has_text.select(key).distinct(), key, "left_anti")
    padded = expand(without, key, items, catalogue, catalogue_key, vector, k, dims).where("source = 'padded'")
    given = known.select(key, F.col("pos").cast("int").alias("place"), "item", F.lit("seed").alias("source"))
    return given.unionByName(found).unionByName(padded).where(F.col("place") < k)


def by_code(predicted: DataFrame, key: str, codes: str, vector: str, catalogue: DataFrame, item: str, item_codes: str, item_vector: str, dims: int) -> DataFrame:
    """(key, item, how): the item with exactly the predicted codes (``direct``, the smallest if several), else the one
    nearest to the predicted vector (``nearest``)."""
    exact = catalogue.groupBy(F.col(item_codes).alias("codes")).agg(F.min(F.col(item).cast("string")).alias("item"))
    p = predicted.select(F.col(key).cast("string").alias("query_id"), F.col(codes).alias("codes"), F.col(vector).alias("qvec"))
    direct = p.join(exact, "codes").select("query_id", "item", F.lit("direct").alias("how"))
    rest = p.join(direct.select("query_id"), "query_id", "left_anti").select("query_id", "qvec")
    near = knn.exact_topk(catalogue.select(F.col(item).cast("string").alias("item"), F.col(item_vector).alias("v")), rest, 1, "item", "v", dims=dims)
    return direct.unionByName(near.select("query_id", "item", F.lit("nearest").alias("how"))).withColumnRenamed("query_id", key)


def code_features(predicted: DataFrame, key: str, codes: str, catalogue: DataFrame, item_codes: str, item_vector: str, books: DataFrame, dims: int) -> DataFrame:
    """(key, vector, how): the vector of the catalogue row with exactly these codes (``direct``; the smallest in array order, if several), else
    the sum of their codewords (``codebook``). ``books`` is (level, code, vec)."""
    exact = catalogue.groupBy(F.col(item_codes).alias("codes")).agg(F.min(F.col(item_vector).cast("array<double>")).alias("vector"))
    p = predicted.select(F.col(key), F.col(codes).alias("codes"))
    direct = p.join(exact, "codes").select(key, "vector", F.lit("direct").alias("how"))
    rest = p.join(exact.select("codes"), "codes", "left_anti")
    return direct.unionByName(rvq_decode(rest, key, "codes", books, dims).select(key, "vector", F.lit("codebook").alias("how")))


def pools(truth: DataFrame, key: str, item: str, catalogue: DataFrame, catalogue_key: str, size: int, seed: int = 42) -> DataFrame:
    """(key, item, is_label): each key's true items and ``size`` others as distractors (all others, if there are fewer).
    The catalogue stands in hash order; a key draws what follows its own place in it, so each key has others, as many places as
    it has labels more than ``size``, so that enough are left however many labels it meets."""
    ids = catalogue.select(F.col(catalogue_key).cast("string").alias("item")).distinct()
    order = places(ids, hashing.digest("pool", seed, F.col("item")), F.col("item")).select("item", (F.col("rank") - 1).alias("place"))
    n = order.agg(F.count("*").alias("n"))
    labels = truth.select(F.col(key), F.col(item).cast("string").alias("item")).distinct()
    start = F.conv(F.substring(hashing.digest("start", seed, F.col(key)), 1, 15), 16, 10).cast("long")
    keys = labels.groupBy(key).agg(F.count("*").alias("m")).crossJoin(F.broadcast(n)).where("n > 0")
    drawn = keys.select(key, "n", F.pmod(start, F.col("n")).alias("s"), F.explode(F.sequence(F.lit(0), F.least(F.col("m") + size, F.col("n")) - 1)).alias("j"))
    met = drawn.select(key, "j", F.pmod(F.col("s") + F.col("j"), F.col("n")).alias("place")).join(order, "place").join(labels, [key, "item"], "left_anti")
    chosen = met.withColumn("r", F.row_number().over(Window.partitionBy(key).orderBy("j"))).where(F.col("r") <= size)
    return labels.withColumn("is_label", F.lit(True)).unionByName(chosen.select(key, "item", F.lit(False).alias("is_label")))


def from_pools(pooled: DataFrame, key: str, queries: DataFrame, query_vector: str, table: DataFrame, table_key: str, vector: str, k: int, repeats: bool = False) -> DataFrame:
    """(key, step, item): of each key's pool (what ``pools`` gives) the item nearest to each of its queries, one per
    step from 0, ties by the smaller id. Unless ``repeats``, an item that an earlier step took is passed over. A pool is a
    short list; a key's pool and queries are one group."""
    import numpy as np
    import pandas as pd

    t = table.select(F.col(table_key).cast("string").alias("item"), vec.l2(vector).alias("v")).where(F.col("v").isNotNull())
    members = pooled.select(F.col(key), "item").join(t, "item").select(key, F.lit(-1).alias("step"), "item", "v")
    asked = queries.select(F.col(key), F.col("step").cast("int"), F.lit(None).cast("string").alias("item"), vec.l2(query_vector).alias("v")).where(F.col("v").isNotNull() & (F.col("step") < k))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pool = pdf[pdf["step"] < 0].sort_values("item")
        steps = pdf[pdf["step"] >= 0].sort_values("step")
        if not len(pool) or not len(steps):
            return pd.DataFrame({key: [], "step": [], "item": []})
        score = np.round(np.stack(steps["v"].to_numpy()) @ np.stack(pool["v"].to_numpy()).T, 6)
        took: list[int] = []
        for row in score:
            if not repeats:
                row[took] = -np.inf
            if np.isfinite(row).any():
                took.append(int(np.argmax(row)))
        return pd.DataFrame({key: pdf[key].iloc[0], "step": steps["step"].to_numpy()[: len(took)], "item": pool["item"].to_numpy()[took]})

    kind = pooled.schema[key].dataType.simpleString()
    return members.unionByName(asked).groupBy(key).applyInPandas(run, f"`{key}` {kind}, step int, item string")


def nearest_of_all(generated: DataFrame, key: str, vector: str, catalogue: DataFrame, item: str, item_vector: str, dims: int = 64) -> DataFrame:
    """(key, item, score): the highest cosine of each generated vector to the whole catalogue."""
    q = generated.select(F.col(key).cast("string").alias("query_id"), F.col(vector).alias("qvec"))
    top = knn.exact_topk(catalogue, q, 1, item, item_vector, dims=dims)
    return top.select(F.col("query_id").alias(key), "item", "score")


def sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows in hash order of their key, without replacement; the same whatever the partitions."""
    return df.withColumn("__h", hashing.digest("sample", seed, F.col(key))).orderBy("__h", key).limit(n).drop("__h")
