"""Mining of a ranked vocabulary from text, and its use."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaverlake.functions import hashing, text
from quaverlake.operators.knn import sparse_distinct
from quaverlake.operators.metrics import places
from quaverlake.session import spread, stored


def phrases(docs: DataFrame, key: str, column: str, sizes: tuple[int, ...] = (1, 2), normal: bool = False) -> DataFrame:
    """(key, phrases): one- and two-word phrases of each text over the letters a to z, repeats kept. With ``normal``
    colloquial words are written out first, which is all that ``text.cue_key`` changes in such phrases."""
    words = text.words(column)
    if normal:
        table = F.create_map(*[F.lit(x) for pair in text.COLLOQUIAL.items() for x in pair])
        words = F.transform(words, lambda w: F.coalesce(F.try_element_at(table, w), w))
    tokens = spread(docs).select(key, words.alias("t"))
    return tokens.select(key, F.concat(*[text.ngrams(F.col("t"), n) for n in sizes]).alias("phrases"))


def document_frequency(lists: DataFrame, key: str, items: str) -> DataFrame:
    """(phrase, df): documents that hold a phrase, each once."""
    return lists.select(key, F.explode(F.array_distinct(items)).alias("phrase")).groupBy("phrase").agg(F.count("*").alias("df"))


def in_band(df: DataFrame, n_docs: Column, min_df: int, max_share: float) -> DataFrame:
    """Phrases in at least ``min_df`` and at most ``max_share`` of the documents, both included."""
    return df.where((F.col("df") >= min_df) & (F.col("df") <= n_docs * max_share))


def name_tokens(catalogue: DataFrame, artist: str) -> DataFrame:
    """(token): words of artist names that aren't common words, which would only name the artist."""
    return catalogue.select(F.explode(text.words(artist)).alias("token")).distinct().where(~F.col("token").isin(text.STOPWORDS))


def without_blocked(df: DataFrame, phrase: str, blocked_phrases: list[str], hard_stops: list[str], edges: list[str], names: DataFrame | None = None) -> DataFrame:
    """Drops phrases that are listed, hold a hard-stop word, begin or end with an edge word (if they have
    several words), or consist of name tokens only. Names are matched by a join on exploded words, for
    there may be many."""
    tokens = F.split(F.col(phrase), " ")
    keep = ~F.col(phrase).isin(blocked_phrases) if blocked_phrases else F.lit(True)
    if hard_stops:
        keep &= ~F.arrays_overlap(tokens, F.array(*[F.lit(w) for w in hard_stops]))
    if edges:
        keep &= (F.size(tokens) == 1) | ~(F.element_at(tokens, 1).isin(edges) | F.element_at(tokens, -1).isin(edges))
    out = df.where(keep)
    if names is None:
        return out
    words = out.select(phrase, F.explode(tokens).alias("token"))
    own = words.join(names.withColumn("is_name", F.lit(1)), "token", "left").groupBy(phrase).agg(F.count("*").alias("n"), F.count("is_name").alias("m")).where("n > m").select(phrase)
    return out.join(own, phrase, "left_semi")


def ranking_scores(df: DataFrame, n_docs: Column, band_target: float = 0.02) -> DataFrame:
    """Adds the scores by which a vocabulary may be ranked: idf, df, df * idf, and closeness to a share."""
    n = n_docs.cast("double")
    idf = F.log(n / (F.lit(1.0) + F.col("df")))
    band = -F.abs(F.log(F.greatest(F.col("df"), F.lit(1)) / F.greatest(n, F.lit(1.0))) - F.log(F.lit(band_target)))
    return df.withColumn("idf", idf).withColumn("df_idf", F.col("df") * idf).withColumn("band", band)


def random_score(seed: int = 0) -> Column:
    """A ranking by chance, the same wherever it is computed: the first 13 hex digits of a hash of the phrase."""
    return F.conv(F.substring(hashing.digest("rank", seed, F.col("phrase")), 1, 13), 16, 10).cast("double")


def _char_grams(rows: DataFrame, key: str, column: str, low: int, high: int, dims: int) -> DataFrame:
    """(key, m, norm): the weights over 0 by place, before they are divided by their norm."""
    own = rows.select(F.col(key), F.explode_outer(F.filter(F.split(F.lower(column), r"\s+"), lambda w: w != "")).alias("w"))
    words = own.select(key, F.concat(F.lit(" "), "w", F.lit(" ")).alias("w"))
    pieces = F.concat(*[text.char_grams(F.col("w"), n) for n in range(low, high + 1)])
    grams = words.select(key, F.explode_outer(pieces).alias("g")).groupBy(key, "g").agg(F.count("*").alias("tf"))
    total = rows.select(key).distinct().agg(F.count("*").alias("n"))
    df = grams.where("g IS NOT NULL").groupBy("g").agg(F.count("*").alias("df")).crossJoin(F.broadcast(total)).select("g", (F.log((1.0 + F.col("n")) / (1.0 + F.col("df"))) + 1.0).alias("idf"))
    placed = grams.join(df, "g", "left").select(key, F.pmod(F.xxhash64("g"), F.lit(dims)).cast("int").alias("at"), F.coalesce(F.col("tf") * F.col("idf"), F.lit(0.0)).alias("w"))
    return placed.groupBy(key, "at").agg(F.sum("w").alias("w")).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("at", "w"))).alias("m"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))


def char_gram_vectors(rows: DataFrame, key: str, column: str, low: int = 2, high: int = 4, dims: int = 1024) -> DataFrame:
    """(key, emb): TF-IDF vectors of a phrase's pieces of ``low`` to ``high`` characters within its words, each with a blank at both ends, of
    length one. Weight tf * (ln((1 + N) / (1 + df)) + 1). Pieces are hashed to ``dims`` places, so vectors are no longer than that however many
    pieces there are. A phrase without a word has the zero vector."""
    summed = _char_grams(rows, key, column, low, high, dims)
    return summed.select(key, F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.when(F.col("norm") > 0, F.coalesce(F.try_element_at("m", i), F.lit(0.0)) / F.col("norm")).otherwise(0.0)).alias("emb"))


def near_duplicates_removed(phrases: DataFrame, idf: str, threshold: float = 0.92, dims: int = 1024) -> DataFrame:
    """(phrase): the phrases, rarest first and then by text, that are no closer than ``threshold`` to one kept before, by the vectors of their
    pieces (``char_gram_vectors``), of which only the places with a weight are written and compared. However many phrases there are."""
    ranked = places(phrases.select("phrase", F.bround(idf, 9).alias("__s")), F.desc("__s"), F.asc("phrase")).select("phrase", F.col("rank").alias("o"))
    vectors = _char_grams(ranked, "phrase", "phrase", 2, 4, dims).join(ranked, "phrase")
    held = F.filter(F.map_entries("m"), lambda x: x["value"] > 0)
    return sparse_distinct(vectors.select("phrase", "o", held.alias("h")).select("phrase", "o", F.col("h.key").alias("at"), F.col("h.value").alias("w")), "phrase", threshold, dims)


def select_vocabulary(scored: DataFrame, score: str, size: int, digits: int = 9) -> DataFrame:
    """(cue_id, cue, is_pad): ``<unk>`` is 0, then the ``size`` - 1 phrases of highest score, ties by text, then
    ``<pad_i>`` up to ``size``. A vocabulary is a bounded table; the cut before ranking is a top-k."""
    top = scored.select(F.col("phrase").alias("cue"), F.bround(score, digits).alias("s")).orderBy(F.desc("s"), "cue").limit(size - 1)
    ranked = top.select(F.row_number().over(Window.orderBy(F.desc("s"), "cue")).alias("cue_id"), "cue", F.lit(False).alias("is_pad"))
    spark = scored.sparkSession
    unk = spark.createDataFrame([(0, "<unk>", False)], "cue_id int, cue string, is_pad boolean")
    pads = spark.range(1, size).select(F.col("id").cast("int").alias("cue_id")).join(F.broadcast(ranked.select("cue_id")), "cue_id", "left_anti")
    return unk.unionByName(ranked).unionByName(pads.select("cue_id", F.concat(F.lit("<pad_"), F.col("cue_id"), F.lit(">")).alias("cue"), F.lit(True).alias("is_pad")))


def tfidf_top(docs: DataFrame, key: str, column: str, top: int = 10, min_df: int = 2, digits: int = 6, words: Callable[[str], Column] = text.words) -> DataFrame:
    """(key, term, weight, rank): the terms (one or two words as ``words`` cuts them, no stopwords, none of one
    character) of highest weight of each document; weight (1 + ln tf) * (ln((1 + N) / (1 + df)) + 1), to length one per document, ties by term."""
    stop = F.array(*[F.lit(w) for w in text.STOPWORDS])
    tokens = F.filter(words(column), lambda w: (F.length(w) > 1) & ~F.array_contains(stop, w))
    lists = spread(docs).select(key, tokens.alias("t")).select(key, F.concat(F.col("t"), text.ngrams(F.col("t"), 2)).alias("terms"))
    # a document's terms are counted where it lies: no shuffle of all its words
    def counted(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                counts = [Counter(t) for t in part.column(1).to_pylist()]
                keys = part.column(0).take(pa.array(np.repeat(np.arange(len(counts)), [len(c) for c in counts])))
                yield pa.RecordBatch.from_arrays([keys, pa.array([t for c in counts for t in c], pa.string()), pa.array([n for c in counts for n in c.values()], pa.int64())], names=[key, "term", "c"])

    kind = docs.schema[key].dataType.simpleString()
    tf = stored(lists.select(key, F.coalesce("terms", F.array().cast("array<string>")).alias("terms")).mapInArrow(counted, f"`{key}` {kind}, term string, c long"))
    total = docs.agg(F.count("*").alias("n"))
    df = tf.groupBy("term").agg(F.count("*").alias("df")).where(F.col("df") >= min_df).crossJoin(F.broadcast(total)).select("term", (F.log((1.0 + F.col("n")) / (1.0 + F.col("df"))) + 1.0).alias("idf"))
    weighted = tf.join(df, "term").select(key, "term", ((1.0 + F.log(F.col("c").cast("double"))) * F.col("idf")).alias("w"))
    length = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))
    scored = weighted.select(key, "term", F.bround(F.col("w") / length, digits).alias("weight"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("weight"), "term"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= top)


def usage(lists: DataFrame, ids: str, limit: int | None = None) -> DataFrame:
    """(cue_id, n): how often each id fills a slot, over the first ``limit`` slots of each list."""
    c = F.col(ids) if limit is None else F.slice(ids, 1, limit)
    return lists.select(F.explode(c).alias("cue_id")).where("cue_id IS NOT NULL").groupBy("cue_id").agg(F.count("*").alias("n"))


def health(lists: DataFrame, ids: str, vocabulary_size: int, limit: int | None = None, scope: str = "stored") -> DataFrame:
    """One row: rows, share of rows without an empty slot, share of empty slots, share of the vocabulary in
    use, entropy of use in bits, ids used fewer than five times, and the effective vocabulary 2^entropy."""
    c = F.col(ids) if limit is None else F.slice(ids, 1, limit)
    rows = lists.where(F.col(ids).isNotNull()).select(c.alias("c"))
    shape = rows.agg(F.count("*").alias("rows"), F.avg(F.forall("c", lambda x: F.coalesce(x != 0, F.lit(False))).cast("int")).alias("complete_share"), (F.sum(F.size(F.filter("c", lambda x: F.coalesce(x == 0, F.lit(True))))) / F.sum(F.size("c"))).alias("empty_slot_share"))
    used = usage(rows, "c").where("cue_id <> 0")
    total = used.agg(F.sum("n").alias("t"))
    p = F.col("n") / F.col("t")
    stats = used.crossJoin(F.broadcast(total)).agg(F.count("*").alias("used"), F.coalesce(-F.sum(p * F.log2(p)), F.lit(0.0)).alias("entropy"), F.count(F.when(F.col("n") < 5, 1)).alias("rare"))
    return shape.crossJoin(stats).select(F.lit(scope).alias("scope"), "rows", "complete_share", "empty_slot_share", (F.col("used") / F.lit(vocabulary_size - 1)).alias("vocabulary_share"), "entropy", "rare", F.pow(F.lit(2.0), "entropy").alias("effective_size"))


def jaccard(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """One row: both, either and their ratio for two sets of values; two empty sets are equal (1.0)."""
    x = a.select(column).where(F.col(column).isNotNull()).distinct().withColumn("x", F.lit(1))
    y = b.select(column).where(F.col(column).isNotNull()).distinct().withColumn("y", F.lit(1))
    both = x.join(y, column, "full_outer").agg(F.count(F.when(F.col("x").isNotNull() & F.col("y").isNotNull(), 1)).alias("common"), F.count("*").alias("either"))
    return both.select("common", "either", F.when(F.col("either") == 0, 1.0).otherwise(F.col("common") / F.greatest(F.col("either"), F.lit(1))).alias("jaccard"))
