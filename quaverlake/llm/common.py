"""Helpers of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANKS = " \t\n\r\f\v"


def clean_ids(column: Column | str) -> Column:
    """The set of trimmed ids of a list, without null and blank ones, in first-seen order."""
    trimmed = F.transform(F.col(column) if isinstance(column, str) else column, lambda x: F.trim(x, F.lit(BLANKS)))
    return F.array_distinct(F.filter(trimmed, lambda x: x.isNotNull() & (x != "")))


def one_row_per_key(df: DataFrame, key: str, *columns: str) -> DataFrame:
    """One row per non-null key, combined on the map side. Rows delivered twice are equal in
    ``columns``; should they differ, the largest one counts, so the result is determined."""
    best = F.max(F.struct(*columns)).alias("best")
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(best).select(key, *[F.col(f"best.{c}").alias(c) for c in columns])


def with_dense_id(df: DataFrame, name: str, start: int = 0) -> DataFrame:
    """Consecutive ids over an already written (``cut``) DataFrame: its partitions and their
    order stay the same on a retry. Only a count per partition comes to the driver."""
    at = F.spark_partition_id()
    counts = sorted((r[0], r[1]) for r in df.groupBy(at.alias("p")).count().collect())
    offsets, total = {}, start
    for p, n in counts:
        offsets[p] = total
        total += n
    if not offsets:
        return df.withColumn(name, F.lit(start).cast("long"))
    table = F.array(*[F.lit(offsets.get(p, 0)).cast("long") for p in range(max(offsets) + 1)])
    return df.withColumn(name, F.element_at(table, at + 1) + F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))


def ragged(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Values and row lengths of a list column without nulls, whatever its slice offset."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.diff(column.offsets.to_numpy(zero_copy_only=False))
    return column.flatten().to_numpy(zero_copy_only=False), lengths


def batches(columns: dict[str, np.ndarray], schema: pa.Schema, rows: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    n = len(next(iter(columns.values())))
    for i in range(0, n, rows):
        yield pa.RecordBatch.from_arrays([pa.array(columns[f.name][i : i + rows], type=f.type) for f in schema], schema=schema)


def _contracted(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of one partition to stars around the smallest node of each of their components."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    for batch in source:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            x, y = root(a), root(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
    out = [(x, root(x)) for x in parent if root(x) != x]
    for i in range(0, len(out), 65536):
        a, b = zip(*out[i : i + 65536], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each node of the undirected edges (a, b; long) hangs
    together with. Each partition's edges are contracted first; then large and small stars
    alternate, which only group and join, so no node's neighbours are gathered in one place. Ends when nothing
    changes, after a number of rounds logarithmic in the size."""
    from quaverlake.session import discard, stored

    def both(e: DataFrame) -> DataFrame:
        return e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))

    def least(e: DataFrame) -> DataFrame:
        return e.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    e = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().mapInArrow(_contracted, "a long, b long").distinct())
    before = state(e)
    while True:
        s = both(e)
        large = s.join(least(s), "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        down = large.select(F.col("a").alias("u"), F.col("b").alias("v"))
        m = least(down)
        small = down.join(m, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(m.select(F.col("u").alias("a"), F.col("m").alias("b")))
        last, e = e, stored(small.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
        now = state(e)
        discard(last)
        if now == before:
            break
        before = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
