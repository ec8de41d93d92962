"""Sinks. Tables go through Spark's own commit; single small documents through a temporary file and a rename."""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import tempfile
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_document(path: str, value: object) -> None:
    """A JSON document or text, there whole or not at all."""
    folder = os.path.dirname(os.path.abspath(path))
    os.makedirs(folder, exist_ok=True)
    handle, temporary = tempfile.mkstemp(dir=folder, prefix=".part-")
    try:
        with os.fdopen(handle, "w", encoding="utf-8") as f:
            f.write(value if isinstance(value, str) else json.dumps(value, ensure_ascii=False, indent=2, sort_keys=True))
        os.replace(temporary, path)
    except BaseException:
        Path(temporary).unlink(missing_ok=True)
        raise


def write_matrix(path: str, df: DataFrame, order: str, vector: str, limit: int = 1_000_000) -> None:
    """A .npy file of the vectors by ``order``, there whole or not at all. It is one file made on the driver, so of at most
    ``limit`` rows; more raise an error."""
    rows = df.select(order, F.col(vector).cast("array<float>").alias("v")).limit(limit + 1).toArrow()
    if rows.num_rows > limit:
        raise ValueError(f"a matrix file has at most {limit} rows")
    rows = rows.sort_by(order)
    flat = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in rows.column("v").chunks] or [np.zeros(0, np.float32)])
    folder = os.path.dirname(os.path.abspath(path))
    handle, temporary = tempfile.mkstemp(dir=folder, prefix=".part-")
    try:
        with os.fdopen(handle, "wb") as f:
            np.save(f, flat.reshape(rows.num_rows, -1))
        os.replace(temporary, path)
    except BaseException:
        Path(temporary).unlink(missing_ok=True)
        raise


def write_split_lists(df: DataFrame, key: str, items: str, split: str, path: str) -> DataFrame:
    """Lists as JSON lines in a folder per split; gives (split, lists, distinct_items)."""
    df.select(split, key, items).write.mode("overwrite").partitionBy(split).json(path)
    slots = df.select(split, F.explode(items).alias("item")).groupBy(split).agg(F.count_distinct("item").alias("distinct_items"))
    return df.groupBy(split).agg(F.count("*").alias("lists")).join(slots, split, "left").select(split, "lists", F.coalesce("distinct_items", F.lit(0)).alias("distinct_items"))


def write_lines(df: DataFrame, line: str, path: str, by: str | None = None) -> None:
    """One line of text per row, in a folder per value of ``by``."""
    rows = df.select(*([by] if by else []), F.col(line).alias("value"))
    writer = rows.write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).text(path)


def score_rows(mappings: DataFrame, key: str, ids: str, scores: str, vocabulary: DataFrame) -> DataFrame:
    """(item_id, rank, cue_id, cue, relevance_score, is_unk): the long form of ranked lists; scores with eight
    digits, tabs and line breaks in names as spaces, unknown ids as ``<missing:id>``."""
    rows = mappings.select(F.col(key).cast("string").alias("item_id"), F.posexplode(F.arrays_zip(F.col(ids).alias("c"), F.col(scores).alias("s"))).alias("rank", "x"))
    named = rows.select("item_id", (F.col("rank") + 1).alias("rank"), F.col("x.c").alias("cue_id"), F.col("x.s").alias("s")).join(F.broadcast(vocabulary.select("cue_id", "cue")), "cue_id", "left")
    clean = F.regexp_replace(F.coalesce("cue", F.format_string("<missing:%d>", "cue_id")), r"[\t\r\n]+", " ")
    return named.select("item_id", "rank", "cue_id", clean.alias("cue"), F.when(F.col("s").isNull(), "").otherwise(F.format_string("%.8f", F.col("s"))).alias("relevance_score"), (F.col("cue_id") == 0).alias("is_unk"))


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def markdown(df: DataFrame, limit: int = 1000) -> str:
    """A report table as Markdown. A report has at most ``limit`` rows; more raise an error."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"a report has at most {limit} rows")
    head = ["| " + " | ".join(df.columns) + " |", "| " + " | ".join("---" for _ in df.columns) + " |"]
    return "\n".join(head + ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows]) + "\n"


def write_prepared(df: DataFrame, path: str, by: str = "split_name") -> None:
    """Token sequences in their fixed types, a folder per split."""
    cast = df.select(by, *[F.col(c).cast("array<int>" if c in ("input_ids", "labels") else "array<boolean>" if c.endswith("_mask") else "array<float>" if c in ("context_emb", "mu_c") else "float" if c == "sigma_c2" else dict(df.dtypes)[c]).alias(c) for c in df.columns if c != by])
    cast.write.mode("overwrite").partitionBy(by).parquet(path)


def sha256_of(path: str) -> str:
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while part := f.read(1 << 22):
            h.update(part)
    return h.hexdigest()


def publish(files: list[str], folder: str, expected: dict[str, str] | None = None) -> dict[str, dict]:
    """Copies of the files in a folder that is there whole or not at all; a file with another hash than expected
    is an error. Returns size and hash by name."""
    target = Path(folder)
    if target.exists():
        raise FileExistsError(folder)
    stage = Path(tempfile.mkdtemp(dir=target.parent, prefix=".stage-"))
    try:
        manifest = {}
        for name in map(Path, files):
            digest = sha256_of(str(name))
            if expected and expected.get(name.name, digest) != digest:
                raise ValueError(f"{name.name} has another hash than expected")
            shutil.copyfile(name, stage / name.name)
            if sha256_of(str(stage / name.name)) != digest:
                raise OSError(f"{name.name} changed while it was copied")
            manifest[name.name] = {"size": name.stat().st_size, "sha256": digest}
        os.rename(stage, target)
        return manifest
    except BaseException:
        shutil.rmtree(stage, ignore_errors=True)
        raise


def append_rating(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def new_rows(df: DataFrame, key: str, existing: DataFrame) -> DataFrame:
    """Rows whose key isn't in the output of an earlier run."""
    return df.join(existing.select(key).distinct(), key, "left_anti")
