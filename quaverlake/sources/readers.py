"""Readers with explicit schemas. Each gives an ordinal where order carries meaning."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVENTS = T.StructType([T.StructField("user_id", T.StringType()), T.StructField("track_id", T.StringType()), T.StructField("timestamp", T.StringType())])
SORTED_EVENTS = T.StructType([T.StructField("user_id", T.StringType()), T.StructField("timestamp", T.StringType()), T.StructField("source_row", T.LongType()), T.StructField("item_id", T.StringType())])
CATALOGUE = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("item_id",)]
    + [T.StructField("feature_index", T.IntegerType())]
    + [T.StructField(n, T.StringType()) for n in ("title", "artist", "album", "genre", "mood")]
    + [T.StructField("tempo", T.DoubleType())]
    + [T.StructField(n, T.StringType()) for n in ("key", "language", "lyric_excerpt", "audio_path")]
    + [T.StructField("tags", T.ArrayType(T.StringType()))]
)


def delimited(spark: SparkSession, path: str, required: list[str], sep: str = ",") -> DataFrame:
    """A file with a header, all columns as text (bz2 and gz are read as they are). A missing required column is
    an error at once, a malformed row when it is read."""
    with_header = spark.read.option("header", True).option("sep", sep).option("mode", "FAILFAST").csv(path)
    missing = [c for c in required if c not in with_header.columns]
    if missing:
        raise ValueError(f"{path} lacks the columns {missing}")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in with_header.columns])
    return spark.read.option("header", True).option("sep", sep).option("mode", "FAILFAST").option("enforceSchema", False).schema(schema).csv(path)


def sorted_events(spark: SparkSession, path: str) -> DataFrame:
    """Four tab-separated fields without a header; an empty item is null (unmapped)."""
    return spark.read.option("sep", "\t").option("mode", "FAILFAST").option("nullValue", "").schema(SORTED_EVENTS).csv(path)


def playlists(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """(playlist_id, item_seq) from lines ``id, item, item, ...``. Strict: a line with fewer than three fields or a
    blank one raises when read; lenient: blank fields are dropped, lines without an item too."""
    fields = F.transform(F.split("value", ","), lambda x: F.trim(x))
    rows = spark.read.text(path).where(F.trim("value") != "").select(fields.alias("f"), "value")
    if strict:
        bad = (F.size("f") < 3) | F.exists("f", lambda x: x == "")
        rows = rows.select(F.when(bad, F.raise_error(F.concat(F.lit("malformed playlist line: "), "value"))).otherwise(F.col("f")).alias("f"))
    else:
        rows = rows.select(F.filter("f", lambda x: x != "").alias("f")).where(F.size("f") > 1)
    return rows.select(F.element_at("f", 1).alias("playlist_id"), F.slice("f", F.lit(2), F.size("f") - 1).alias("item_seq"))


def id_list(spark: SparkSession, path: str) -> DataFrame:
    """(item, pos): distinct ids of a file in first-seen order. A comma in the first line says that lines are
    playlists, whose first field is their own id; else each line is an id. One file is read as one
    document, for its lines' order counts; such files are small."""
    doc = spark.read.text(path, wholetext=True).select(F.filter(F.transform(F.split("value", "\r?\n"), lambda x: F.trim(x)), lambda x: x != "").alias("lines"))
    is_list = F.element_at("lines", 1).contains(",")
    fields = F.transform(F.split(F.col("line"), ","), lambda x: F.trim(x))
    lines = doc.where(F.size("lines") > 0).select(is_list.alias("p"), F.posexplode("lines").alias("n", "line"))
    items = lines.select("n", F.posexplode(F.when(F.col("p"), F.slice(fields, F.lit(2), F.greatest(F.size(fields) - 1, F.lit(0)))).otherwise(F.array(F.trim("line")))).alias("k", "item")).where("item <> ''")
    return items.groupBy("item").agg(F.min(F.struct("n", "k")).alias("pos"))


def ordered_union(parts: list[DataFrame], key: str, items: str | None = None, known: DataFrame | None = None, known_key: str = "item_id") -> DataFrame:
    """The parts with src_ord, their place from 0; a key in two rows raises when read, and so does, with ``known``, a list
    in ``items`` with an id that it lacks. Ids are taken once before they are looked up."""
    out = None
    for i, part in enumerate(parts):
        one = part.withColumn("src_ord", F.lit(i))
        out = one if out is None else out.unionByName(one)
    if known is not None:
        lacking = out.select(F.explode(items).alias("id")).distinct().join(known.select(F.col(known_key).alias("id")).distinct(), "id", "left_anti")
        bad = lacking.agg(F.min("id").alias("__unknown"))
        out = out.crossJoin(F.broadcast(bad)).where(F.when(F.col("__unknown").isNotNull(), F.raise_error(F.concat(F.lit("unknown id "), F.col("__unknown"))).cast("boolean")).otherwise(F.lit(True))).drop("__unknown")
    counts = out.groupBy(key).agg(F.count("*").alias("__n"))
    checked = out.join(counts, key)
    return checked.where(F.when(F.col("__n") > 1, F.raise_error(F.concat(F.lit("repeated key "), F.col(key).cast("string"))).cast("boolean")).otherwise(F.lit(True))).drop("__n")


def catalogue(spark: SparkSession, path: str) -> DataFrame:
    """A JSON file that is a list of objects, or an object from id to an object or to a metadata string."""
    text = spark.read.text(path, wholetext=True)
    body = F.trim("value")
    listed = text.where(body.startswith("[")).select(F.explode(F.from_json(body, T.ArrayType(CATALOGUE))).alias("x")).select("x.*")
    mapped = text.where(body.startswith("{")).select(F.explode(F.from_json(body, T.MapType(T.StringType(), T.StringType()))).alias("id", "raw"))
    objects = mapped.where(F.trim("raw").startswith("{")).select("id", F.from_json("raw", CATALOGUE).alias("x")).select(F.coalesce("x.item_id", "id").alias("item_id"), *[F.col(f"x.{f.name}") for f in CATALOGUE.fields[1:]])
    strings = mapped.where(~F.trim("raw").startswith("{")).select("id", *metadata(F.col("raw")))
    from_text = strings.select(F.col("id").alias("item_id"), *[F.col(f.name) if f.name in ("title", "artist", "album") else F.lit(None).cast(f.dataType).alias(f.name) for f in CATALOGUE.fields[1:]])
    return listed.unionByName(objects).unionByName(from_text)


def metadata(raw: Column) -> list[Column]:
    """title, artist and album of a string ``'T' by A in album'X'``; any other string is the title."""
    pattern = r"(?Ud)^'(.+?)'\s+by\s+(.+?)\s+in\s+album'(.+?)'$"
    fits = raw.rlike(pattern)
    part = lambda i: F.when(fits, F.regexp_extract(raw, pattern, i))
    return [F.coalesce(part(1), F.regexp_replace(raw, r"^'+|'+\z", "")).alias("title"), part(2).alias("artist"), part(3).alias("album")]


def row_order(spark: SparkSession, path: str) -> DataFrame:
    """(item_id, row) from a JSON list of ids or an object from id to row. Rows must be 0, 1, ... without a gap, and an id
    stand once; anything else raises when read."""
    text = spark.read.text(path, wholetext=True)
    body = F.trim("value")
    listed = text.where(body.startswith("[")).select(F.posexplode(F.from_json(body, T.ArrayType(T.StringType()))).alias("row", "item_id"))
    mapped = text.where(body.startswith("{")).select(F.explode(F.from_json(body, T.MapType(T.StringType(), T.IntegerType()))).alias("item_id", "row"))
    every = listed.select("item_id", "row").unionByName(mapped)
    sound = every.agg((F.coalesce(F.max("row") + 1, F.lit(0)) == F.count("*")).alias("last"), (F.coalesce(F.min("row"), F.lit(0)) == 0).alias("first"), (F.count_distinct("row") == F.count("*")).alias("rows"), (F.count_distinct("item_id") == F.count("*")).alias("ids"))
    ok = sound.select((F.col("last") & F.col("first") & F.col("rows") & F.col("ids")).alias("__ok"))
    return every.crossJoin(F.broadcast(ok)).where(F.when(~F.col("__ok"), F.raise_error(F.lit("rows are not contiguous or not unique")).cast("boolean")).otherwise(F.lit(True))).drop("__ok")


def side_files(spark: SparkSession, folder: str, suffix: str = ".txt") -> DataFrame:
    """(item_id, text): one file per item, named by its id."""
    files = spark.read.text(folder, wholetext=True).withColumn("name", F.element_at(F.split(F.input_file_name(), "/"), -1))
    return files.where(F.col("name").endswith(suffix)).select(F.expr(f"substring(name, 1, length(name) - {len(suffix)})").alias("item_id"), F.col("value").alias("text"))


def catalogue_texts(spark: SparkSession, catalogue: DataFrame, key: str, order: str, folder: str, suffix: str = ".txt", limit: int | None = None, absent: bool = False) -> DataFrame:
    """(key, order, text): the side files of the catalogue's rows, of the first ``limit`` in ``order`` that have one. With ``absent``
    also the rows without a file, their text null; these don't count against the limit's choice."""
    found = catalogue.select(key, order).join(side_files(spark, folder, suffix).withColumnRenamed("item_id", key), key, "left" if absent else "inner")
    return found if limit is None else found.orderBy(order).limit(limit)


def responses(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A CSV of study responses with a header, in the order of submitted_utc, then session_id."""
    reader = spark.read.option("header", True)
    rows = (reader.schema(schema) if schema else reader).csv(path)
    return rows.orderBy("submitted_utc", "session_id")


def log_coverage(log: DataFrame, key: str, ids: DataFrame, id_key: str, done: str = "ok") -> DataFrame:
    """One row (wanted, seen, done, share): of the ids, how many a log of attempts has, and has with a true ``done``."""
    best = log.groupBy(F.col(key).alias("id")).agg(F.max(F.col(done).cast("int")).alias("d"))
    joined = ids.select(F.col(id_key).alias("id")).where("id IS NOT NULL").distinct().join(best.withColumn("s", F.lit(1)), "id", "left")
    hit = F.count(F.when(F.col("d") == 1, 1))
    return joined.agg(F.count("*").alias("wanted"), F.count("s").alias("seen"), hit.alias("done"), F.when(F.count("*") > 0, hit / F.count("*")).otherwise(0.0).alias("share"))


def fields(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The columns that the schema names, in its order and types; others are dropped, missing ones null."""
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def matrix(spark: SparkSession, path: str, rows: int = 16384) -> DataFrame:
    """(row, emb) of a two-dimensional .npy file. The driver reads its header; executors map the file, which must be in
    a folder that they share, and read a slice of ``rows`` each."""
    shape = np.load(path, mmap_mode="r").shape
    if len(shape) != 2:
        raise ValueError("a matrix has two dimensions")

    def run(source: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        x = np.load(path, mmap_mode="r")
        for pdf in source:
            for i in pdf["id"]:
                part = np.asarray(x[i * rows : (i + 1) * rows], np.float32)
                yield pd.DataFrame({"row": np.arange(i * rows, i * rows + len(part), dtype=np.int32), "emb": list(part)})

    return spark.range(-(-shape[0] // rows)).mapInPandas(run, "row int, emb array<float>")


def expecting(df: DataFrame, count: int) -> DataFrame:
    """The table, if it has ``count`` rows."""
    n = df.count()
    if n != count:
        raise ValueError(f"expected {count} rows, found {n}")
    return df
