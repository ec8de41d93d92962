"""Integrity checks: each gives a row per violation, none for sound data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaverlake.functions import vec


def duplicates(df: DataFrame, key: str | list[str]) -> DataFrame:
    """(key, n): keys of more than one row, nulls too."""
    keys = [key] if isinstance(key, str) else key
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def orphans(df: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """(key): distinct non-null values that the parent lacks."""
    return df.select(F.col(key).alias("key")).where("key IS NOT NULL").distinct().join(parent.select(F.col(parent_key).alias("key")).distinct(), "key", "left_anti")


def out_of_range(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(key, rule): each row and each rule it breaks; a rule that is null is broken."""
    broken = F.array(*[F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()])
    return df.select(key, F.explode(F.filter(broken, lambda x: x.isNotNull())).alias("rule"))


def catalogue_alignment(catalogue: DataFrame, embeddings: DataFrame, key: str, row: str, vector: str, dims: int) -> DataFrame:
    """(problem, n): how often each rule of a catalogue and its embedding matrix is broken: an id on one side only,
    a vector of another length or with elements that aren't finite, an id or a row number twice, row numbers
    that aren't 0..n-1. Rules that hold have no row."""
    e = embeddings.select(F.col(key).alias("key"), F.col(row).alias("row"), F.col(vector).alias("v"))
    c = catalogue.select(F.col(key).alias("key")).distinct()
    ids = e.select("key").distinct()
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    shape = e.agg(F.count(F.when(F.col("v").isNull() | (F.size("v") != dims), 1)).alias("shape"), F.count(F.when(F.exists("v", odd), 1)).alias("finite"), (F.max("row") + 1).alias("top"), F.min("row").alias("low"), F.count_distinct("row").alias("rows"))
    single = lambda df, name: df.agg(F.lit(name).alias("problem"), F.count("*").alias("n"))
    out = (
        single(c.join(ids, "key", "left_anti"), "missing vector")
        .unionByName(single(ids.join(c, "key", "left_anti"), "unknown id"))
        .unionByName(single(duplicates(e, "key"), "repeated id"))
        .unionByName(single(duplicates(e.select("key", "row").distinct(), "row"), "repeated row"))
        .unionByName(shape.select(F.lit("shape").alias("problem"), F.col("shape").alias("n")))
        .unionByName(shape.select(F.lit("not finite").alias("problem"), F.col("finite").alias("n")))
        .unionByName(shape.select(F.lit("rows not contiguous").alias("problem"), F.when((F.col("top") == F.col("rows")) & (F.col("low") == 0), 0).otherwise(F.abs(F.col("top") - F.col("rows"))).cast("long").alias("n")))
    )
    return out.where("n > 0")


def cue_rows(mappings: DataFrame, key: str, ids: str, scores: str, vocabulary_size: int, length: int) -> DataFrame:
    """(key, problem): of a ranked cue list: a missing or too short list, an id outside the vocabulary, a cue twice,
    scores of another length, a score beside the empty cue or none beside another, scores that rise."""
    i, s = F.col(ids), F.col(scores)
    real = F.filter(i, lambda x: x != 0)
    known = F.filter(s, lambda x: x.isNotNull())
    rises = F.exists(F.zip_with(F.slice(known, F.lit(1), F.greatest(F.size(known) - 1, F.lit(0))), F.slice(known, F.lit(2), F.greatest(F.size(known) - 1, F.lit(0))), lambda x, y: y > x), lambda x: x)
    rules = {
        "missing list": i.isNull(),
        "length": F.size(i) != length,
        "unknown id": F.exists(i, lambda x: x.isNull() | (x < 0) | (x >= vocabulary_size)),
        "repeated cue": F.size(F.array_distinct(real)) < F.size(real),
        "score length": F.size(i) != F.size(s),
        "score beside empty": F.exists(F.zip_with(i, s, lambda x, y: (x == 0) != y.isNull()), lambda x: F.coalesce(x, F.lit(False))),
        "rising scores": rises,
    }
    found = F.array(*[F.when(F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()])
    return mappings.select(key, F.explode(F.filter(found, lambda x: x.isNotNull())).alias("problem"))


def sequence_rows(sequences: DataFrame, key: str, ids: str, length: int, vocabulary: int, masks: list[str]) -> DataFrame:
    """(key, problem): sequences of another length, with tokens outside the vocabulary, or masks that don't fit."""
    rules = {"length": F.size(ids) == length, "token": F.forall(ids, lambda t: t.isNotNull() & (t >= 0) & (t < vocabulary))}
    rules |= {f"mask {m}": F.size(m) == F.size(ids) for m in masks}
    return out_of_range(sequences, key, rules).withColumnRenamed("rule", "problem")


def unequal_rows(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of either side that the other lacks, as often as it lacks them, with ``side``."""
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))


def far_vectors(left: DataFrame, right: DataFrame, key: str, vector: str, tolerance: float = 1e-6) -> DataFrame:
    """(key, difference): vectors of one key that differ by more than ``tolerance`` in an element, or in length."""
    joined = left.select(key, F.col(vector).alias("x")).join(right.select(key, F.col(vector).alias("y")), key)
    d = F.aggregate(F.zip_with(vec.doubles("x"), vec.doubles("y"), lambda a, b: F.abs(a - b)), F.lit(0.0), lambda s, x: F.greatest(s, F.coalesce(x, F.lit(float("inf")))))
    return joined.select(key, d.alias("difference")).where(F.col("difference") > tolerance)


def not_unit(vectors: DataFrame, key: str, vector: str, tolerance: float = 1e-4) -> DataFrame:
    return vectors.select(key, vec.norm(vector).alias("norm")).where(F.abs(F.col("norm") - 1) >= tolerance)


def fingerprint(df: DataFrame, order: str, columns: list[str], fan: int = 4096) -> DataFrame:
    """One row (fingerprint, n): SHA-256 over the hashes of all rows in ``order`` (a unique integer), in two
    levels: rows are hashed into slices of the order, slices into one. No task holds more than a slice."""
    h = df.select(F.col(order).cast("long").alias("o"), F.sha2(F.to_json(F.struct(*columns)), 256).alias("h"))
    slices = h.groupBy(F.floor(F.col("o") / fan).alias("s")).agg(F.array_sort(F.collect_list(F.struct("o", "h"))).alias("x"))
    hashed = slices.select("s", F.size("x").alias("n"), F.sha2(F.array_join(F.transform("x", lambda r: r["h"]), ""), 256).alias("h"))
    upper = hashed.groupBy(F.floor(F.col("s") / fan).alias("t")).agg(F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct("s", "h"))).alias("x"))
    again = upper.select("t", "n", F.sha2(F.array_join(F.transform("x", lambda r: r["h"]), ""), 256).alias("h"))
    whole = again.agg(F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct("t", "h"))).alias("x"))
    return whole.select(F.sha2(F.array_join(F.transform("x", lambda r: r["h"]), ""), 256).alias("fingerprint"), F.coalesce("n", F.lit(0)).alias("n"))


def file_inventory(spark, folder: str, pattern: str = "*") -> DataFrame:
    """(path, size, sha256) of the files under a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    return files.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def changed_files(inventory: DataFrame, manifest: DataFrame) -> DataFrame:
    """(path, problem): files missing, unknown, or of another size or hash than in the manifest."""
    m = manifest.select("path", F.col("size").alias("m_size"), F.col("sha256").alias("m_sha"))
    joined = inventory.join(m, "path", "full_outer")
    problem = F.when(F.col("m_sha").isNull(), "unknown").when(F.col("sha256").isNull(), "missing").when(F.col("size") != F.col("m_size"), "size").when(F.col("sha256") != F.col("m_sha"), "hash")
    return joined.select("path", problem.alias("problem")).where("problem IS NOT NULL")
