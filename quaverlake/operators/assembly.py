"""Putting records together from several tables: lookups, precedence of sources, gathered and remapped rows,
records of several systems, and results kept by the hash of what they were made from."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaverlake.functions import hashing
from quaverlake.operators.metrics import places


def accepted_matches(matches: DataFrame, relaxed: bool = False) -> DataFrame:
    """Strict matches, and with ``relaxed`` all of them."""
    return matches if relaxed else matches.where("match_type = 'strict'")


def mapped_events(events: DataFrame, track: str, mapping: DataFrame, mapping_key: str, item: str) -> DataFrame:
    """The events with ``mapped_item``, null where the mapping lacks the track. The mapping has one row per track; if it is
    small Spark broadcasts it, else adaptive execution splits the partitions of hot tracks."""
    m = mapping.select(F.col(mapping_key).alias("__track"), F.col(item).alias("mapped_item"))
    return events.join(m, F.col(track) == F.col("__track"), "left").drop("__track")


def looked_up(rows: DataFrame, key: str, table: DataFrame, table_key: str, columns: dict[str, str | None], required: bool = False) -> DataFrame:
    """The rows with columns of the table (one row per key), null and blank values replaced by the column's default. With
    ``required`` a key that the table lacks raises when read; else it has the defaults."""
    t = table.select(F.col(table_key).alias("__key"), *columns, F.lit(True).alias("__found"))
    joined = rows.join(t, F.col(key) == F.col("__key"), "left")
    if required:
        joined = joined.where(F.when(F.col("__found").isNull(), F.raise_error(F.concat(F.lit("no row for "), F.coalesce(F.col(key).cast("string"), F.lit("null")))).cast("boolean")).otherwise(F.lit(True)))
    filled = {c: F.coalesce(F.when(F.trim(F.col(c).cast("string")) != "", F.col(c)), F.lit(default)) for c, default in columns.items()}
    return joined.select(*rows.columns, *[c.alias(n) for n, c in filled.items()])


def cue_names(rows: DataFrame, key: str, ids: str, vocabulary: DataFrame, cue_id: str, cue: str) -> DataFrame:
    """(key, pos, cue): the names of ids given as text, ``<missing:i>`` of a number that the vocabulary lacks, ``<invalid:x>`` of what
    isn't a number; a null id is ``<invalid:null>``. The vocabulary is a bounded table."""
    flat = rows.select(key, F.posexplode(ids).alias("pos", "x")).withColumn("i", F.expr("try_cast(x AS int)"))
    named = flat.join(F.broadcast(vocabulary.select(F.col(cue_id).alias("i"), F.col(cue).alias("__cue"))), "i", "left")
    bad = F.concat(F.lit("<invalid:"), F.coalesce("x", F.lit("null")), F.lit(">"))
    return named.select(key, "pos", F.when(F.col("i").isNull(), bad).otherwise(F.coalesce("__cue", F.format_string("<missing:%d>", "i"))).alias("cue"))


def by_precedence(values: dict[str, Column], longest: int | None = None) -> tuple[Column, Column]:
    """The first of several columns that isn't null or empty (a list without elements, a blank string), a list cut to ``longest``,
    and the name of its source; none is null from ``miss``."""
    # each column is told from the rest by its own type when it is used
    has = {n: F.coalesce(F.length(F.trim(F.array_join(c, "") if longest else c)) > 0, F.lit(False)) for n, c in values.items()}
    value = F.coalesce(*[F.when(has[n], F.slice(c, 1, longest) if longest else c) for n, c in values.items()])
    return value, F.coalesce(*[F.when(has[n], F.lit(n)) for n in values], F.lit("miss"))


def not_dense(table: DataFrame, row: str) -> DataFrame:
    """(problem, n): what keeps the rows from being 0, 1, ... each once: nulls, repeats, gaps. None, if they are."""
    s = table.agg(F.count("*").alias("n"), F.count(row).alias("m"), F.count_distinct(row).alias("d"), F.max(row).alias("most"), F.min(row).alias("least"))
    found = F.array(*[F.struct(F.lit(name).alias("problem"), n.cast("long").alias("n")) for name, n in {
        "null row": F.col("n") - F.col("m"),
        "repeated row": F.col("m") - F.col("d"),
        "gap": F.coalesce(F.greatest(F.col("most") + 1 - F.col("d"), F.lit(0)), F.lit(0)),
        "negative row": F.when(F.col("least") < 0, 1).otherwise(0),
    }.items()])
    return s.select(F.explode(found).alias("p")).select("p.problem", "p.n").where("n > 0")


def gathered_rows(catalogue: DataFrame, key: str, at: str, table: DataFrame, row: str, value: str) -> DataFrame:
    """(key, value): the table's row that each catalogue row points at; one out of the table raises when read."""
    t = table.select(F.col(row).alias("__row"), F.col(value).alias("value"), F.lit(True).alias("__found"))
    joined = catalogue.select(key, F.col(at).alias("__at")).join(t, F.col("__at") == F.col("__row"), "left")
    return joined.where(F.when(F.col("__found").isNull(), F.raise_error(F.concat(F.lit("no row "), F.coalesce(F.col("__at").cast("string"), F.lit("null")))).cast("boolean")).otherwise(F.lit(True))).select(key, "value")


def remapped_rows(target: DataFrame, key: str, value: str, source: DataFrame, source_key: str, pairs: DataFrame) -> DataFrame:
    """(key, value, copied): the target's rows, those that ``pairs`` (source, target) name with the source's value. Pairs whose
    source has no row leave the target as it is."""
    new = pairs.join(source.select(F.col(source_key).alias("source"), F.col(value).alias("__new"), F.lit(True).alias("__copied")), "source")
    joined = target.join(new.select(F.col("target").alias(key), "__new", "__copied"), key, "left")
    return joined.select(key, F.when(F.col("__copied"), F.col("__new")).otherwise(F.col(value)).alias(value), F.coalesce("__copied", F.lit(False)).alias("copied"))


def plan_shape(plans: DataFrame, key: str, arrays: list[str], width: int) -> DataFrame:
    """(key, problem): arrays that are missing or of another length than ``width``."""
    found = F.array(*[F.when(F.coalesce(F.size(a) != width, F.lit(True)) | F.col(a).isNull(), F.lit(a)) for a in arrays])
    return plans.select(key, F.explode(F.filter(found, lambda x: x.isNotNull())).alias("problem"))


def system_records(plans: DataFrame, key: str, system: str, item: str, predicted: str, cues: DataFrame, cue_key: str, cue_ids: str, names: tuple[str, str, str] = ("predicted", "retrieved", "direct"), width: int = 8) -> DataFrame:
    """(key, system, retrieved_item, cue_ids, cue_source): what each system's record has for cues: its own predicted ones, those of
    the catalogue item that it retrieved, or none. Another system, or predicted cues of another number than ``width``, raises when read."""
    own, looked, none = names
    c = cues.select(F.col(cue_key).alias("__item"), F.slice(cue_ids, 1, width).alias("__cues"))
    joined = plans.join(c, F.col(item) == F.col("__item"), "left")
    kind = F.col(system)
    wrong = F.when(~kind.isin(*names), F.concat(F.lit("unknown system "), kind)).when((kind == own) & (F.coalesce(F.size(predicted), F.lit(-1)) != width), F.lit("wrong number of predicted cues"))
    sound = joined.where(F.when(wrong.isNotNull(), F.raise_error(wrong).cast("boolean")).otherwise(F.lit(True)))
    ids = F.when(kind == own, F.col(predicted)).when(kind == looked, F.coalesce("__cues", F.array().cast("array<int>"))).otherwise(F.array().cast("array<int>"))
    label = F.when(kind == own, "model-predicted").when(kind == looked, "retrieved-catalog-item")
    return sound.select(key, kind.alias("system"), F.when(kind != none, F.col(item)).alias("retrieved_item"), ids.alias("cue_ids"), label.alias("cue_source"))


def first_by_extension(files: DataFrame, path: str, extensions: list[str]) -> DataFrame:
    """(name, path): of the files of one name the one whose extension comes first in the list, ties by path; others don't count."""
    base = F.element_at(F.split(F.col(path), "/"), -1)
    rank = F.array_position(F.array(*[F.lit(e) for e in extensions]), F.concat(F.lit("."), F.lower(F.element_at(F.split(base, r"\."), -1))))
    rows = files.select(F.regexp_replace(base, r"\.[^.]*$", "").alias("name"), F.col(path).alias("path"), rank.alias("r")).where("r > 0")
    return rows.groupBy("name").agg(F.min(F.struct("r", "path")).alias("x")).select("name", "x.path")


def requests(items: DataFrame, key: str, order: str, text: str, budget: int) -> DataFrame:
    """(request, key, prompt_text, n_chars): items with a text that isn't blank, numbered from 0 in ``order``, the text cut to
    ``budget`` characters as the request's own limit has it."""
    some = items.where(F.trim(text) != "").select(F.col(key), F.col(order).alias("__o"), F.col(text).alias("__t"))
    ranked = places(some, F.asc("__o"), F.asc(key))
    return ranked.select((F.col("rank") - 1).alias("request"), key, F.substring("__t", 1, budget).alias("prompt_text"), F.length("__t").alias("n_chars"))


def in_request_order(asked: DataFrame, results: DataFrame, request: str = "request") -> DataFrame:
    """The requests with their results, whatever order these came in; the last of several by ``attempt``; null without one."""
    last = results.groupBy(request).agg(F.max_by("result", "attempt").alias("result"))
    return asked.join(last, request, "left").orderBy(request)


def conditions(items: DataFrame, key: str, assigned: DataFrame, assigned_key: str, cues: str, vocabulary: DataFrame, cue_id: str, n: int = 6, seed: int = 0) -> DataFrame:
    """(key, condition, cue_ids): each item under the conditions ``assigned`` (its own cues, none if it has no row), ``random``
    (``n`` different cues of the vocabulary, ``<unk>`` and pads left out, from the item's own place on in hash order) and ``none``."""
    base = items.select(F.col(key)).distinct()
    empty = F.array().cast("array<int>")
    own = base.join(assigned.select(F.col(assigned_key).alias(key), F.filter(cues, lambda c: c != 0).alias("__c")), key, "left").select(key, F.lit("assigned").alias("condition"), F.coalesce("__c", empty).alias("cue_ids"))
    real = vocabulary.where(~F.col("cue").isin("<unk>") & ~F.col("cue").startswith("<pad_")).select(F.col(cue_id).cast("int").alias("c"))
    # a vocabulary is a bounded table: in one array it is looked up by place
    line = real.select(hashing.digest("cue", seed, F.col("c")).alias("h"), "c").agg(F.transform(F.array_sort(F.collect_list(F.struct("h", "c"))), lambda r: r["c"]).alias("line"))
    start = F.conv(F.substring(hashing.digest("random", seed, F.col(key)), 1, 15), 16, 10).cast("long")
    size = F.size("line")
    drawn = F.when(size > 0, F.transform(F.sequence(F.lit(0), F.least(F.lit(n), size) - 1), lambda j: F.element_at("line", (F.pmod(start + j, size) + 1).cast("int")))).otherwise(empty)
    chance = base.crossJoin(F.broadcast(line)).select(key, F.lit("random").alias("condition"), drawn.alias("cue_ids"))
    return own.unionByName(chance).unionByName(base.select(key, F.lit("none").alias("condition"), empty.alias("cue_ids")))


def memoised(rows: DataFrame, columns: list[str], path: str, compute: Callable[[DataFrame], DataFrame], cut_text: int | None = None) -> DataFrame:
    """The rows with what ``compute`` adds to them (its table has column ``memo_key`` and the results), kept in ``path`` by the hash
    of ``columns``, strings cut to ``cut_text`` characters first: what is there already isn't computed again, equal rows are computed once."""
    spark = rows.sparkSession
    cut_to = lambda c: F.substring(F.col(c).cast("string"), 1, cut_text) if cut_text else F.col(c).cast("string")
    keyed = rows.withColumn("memo_key", F.sha2(F.to_json(F.struct(*[cut_to(c).alias(c) for c in columns])), 256))
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)
    wanted = keyed.select("memo_key", *[cut_to(c).alias(c) for c in columns]).dropDuplicates(["memo_key"])
    missing = wanted.join(spark.read.parquet(path).select("memo_key"), "memo_key", "left_anti") if there else wanted
    compute(missing).write.mode("append").parquet(path)
    return keyed.join(spark.read.parquet(path).dropDuplicates(["memo_key"]), "memo_key").drop("memo_key")


def kept_table(spark, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table in ``path``; made and written there if it isn't, so that all that come after read the same one."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        make().write.parquet(path)
    return spark.read.parquet(path)
